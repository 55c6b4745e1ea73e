"""Forward sums and Viterbi paths as joins: states are rows, one step is a join with the transitions.

For models beyond the bound of what is shipped to executors. A step joins the
frontier's states to the edges by k-mer, weighs them and merges states that meet
(at most four come from one place, so a merge gathers at most four scores). Every
step is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.config import EngineConfig
from helixframe.functions import bits
from helixframe.plans.storage import stored


def _table(a: np.ndarray, *index: Column) -> Column:
    """a[index] of a small array, as a literal."""
    at = F.lit(0)
    for n, i in zip(a.shape, index, strict=True):
        at = at * n + i
    return F.get(F.lit([float(x) for x in a.ravel()]), at.cast("int"))


def _letter(place: int) -> Column:
    return bits.effective_base(F.substr("seq", F.lit(place + 1), F.lit(1)))


def _quality(place: int, offset: int, most: int) -> Column:
    return F.greatest(F.least(F.ascii(F.substr("qual", F.lit(place + 1), F.lit(1))) - offset, F.lit(most)), F.lit(0))


def first_scores(reads: DataFrame, first: DataFrame, base: np.ndarray, qual: np.ndarray, k: int, offset: int) -> DataFrame:
    """States of the first place: ``first`` (read_id, kid) with hd, score and the read's letters."""
    d = first.select("read_id", "kid").join(reads.select("read_id", "seq", "qual"), "read_id")
    score, hd = F.lit(0.0), F.lit(0)
    for i in range(k):
        b = F.shiftrightunsigned("kid", 2 * i).bitwiseAND(F.lit(3)).cast("int")
        o, q = _letter(i), _quality(i, offset, qual.shape[2] - 1)
        score = score + _table(base[i], b, o) + _table(qual[i], (b == o).cast("int"), q)
        hd = hd + (b != o).cast("int")
    return d.select("read_id", "kid", hd.alias("hd"), score.alias("score"), F.lit("").alias("path"), "seq", "qual")


def step(states: DataFrame, edges: DataFrame, t: int, base: np.ndarray, qual: np.ndarray, config: EngineConfig, offset: int, *, best: bool) -> DataFrame:
    """The states of place ``t`` from those of t - 1 and ``edges`` (kid, base, lp)."""
    k = config.k
    slot = min(k + (t - 1) // config.slot, len(base) - 1)
    o, q = _letter(t + k - 1), _quality(t + k - 1, offset, qual.shape[2] - 1)
    rest = F.col("hd") - (bits.first_base(F.col("kid")) != _letter(t - 1)).cast("int")
    e = states.join(edges, "kid").withColumns({"rest": rest, "o": o, "q": q}).where((F.col("rest") < config.hamming) | (F.col("base") == F.col("o")))
    weight = F.col("score") + F.col("lp") + _table(base[slot], F.col("base"), F.col("o")) + _table(qual[slot], (F.col("base") == F.col("o")).cast("int"), F.col("q"))
    path = F.concat("path", F.substr(F.lit(bits.BASES), bits.first_base(F.col("kid")) + 1, F.lit(1)))
    e = e.select("read_id", bits.successor(F.col("kid"), F.col("base"), k).alias("next"), (F.col("rest") + (F.col("base") != F.col("o")).cast("int")).alias("hd"), weight.alias("w"), "kid", path.alias("path"), "seq", "qual")
    e = e.where(F.col("w") > float("-inf"))
    if best:  # of equal scores the smaller k-mer before wins
        top = F.max(F.struct("w", (-F.col("kid")).alias("first"), "path")).alias("top")
        g = e.groupBy("read_id", "next").agg(F.first("hd").alias("hd"), top, F.first("seq").alias("seq"), F.first("qual").alias("qual"))
        return g.select("read_id", F.col("next").alias("kid"), "hd", F.col("top.w").alias("score"), F.col("top.path").alias("path"), "seq", "qual")
    g = e.groupBy("read_id", "next").agg(F.first("hd").alias("hd"), bits.log_sum(F.sort_array(F.collect_list("w"))).alias("score"), F.first("seq").alias("seq"), F.first("qual").alias("qual"))
    return g.select("read_id", F.col("next").alias("kid"), "hd", "score", F.lit("").alias("path"), "seq", "qual")


def last_states(reads: DataFrame, first: DataFrame, edges: DataFrame, kmers: DataFrame, base: np.ndarray, qual: np.ndarray, config: EngineConfig, offset: int, *, best: bool) -> DataFrame:
    """States of each read's last place. Reads may differ in length; the loop runs to the longest."""
    reads = reads.where(F.length("seq") > config.k)
    length = reads.agg(F.max(F.length("seq"))).first()[0] or 0
    states, done = stored(first_scores(reads, first, base, qual, config.k, offset), "states"), None
    for t in range(1, length - config.k + 1):
        states = stored(step(states.where(F.length("seq") >= t + config.k), edges, t, base, qual, config, offset, best=best).join(kmers.select("kid"), "kid", "left_semi"), "states")
        ended = states.where(F.length("seq") == t + config.k)
        done = ended if done is None else done.unionByName(ended)
    return states.where("false") if done is None else done


def log_likelihood(*args, **options) -> DataFrame:
    """read_id, loglik of the reads whose trellis lives (arguments of ``last_states``)."""
    s = last_states(*args, best=False, **options)
    top = s.groupBy("read_id").agg(F.max("score").alias("top"))
    return s.join(top, "read_id").groupBy("read_id").agg((F.first("top") + F.ln(F.sum(F.exp(F.col("score") - F.col("top"))))).alias("loglik"))


def viterbi(reads: DataFrame, first: DataFrame, edges: DataFrame, kmers: DataFrame, base: np.ndarray, qual: np.ndarray, config: EngineConfig, offset: int) -> DataFrame:
    """read_id, seq (corrected; N of the last k-mer stay), score of the best paths."""
    s = last_states(reads, first, edges, kmers, base, qual, config, offset, best=True)
    best = s.groupBy("read_id").agg(F.max(F.struct("score", (-F.col("kid")).alias("kid"), "path", "seq")).alias("b")).select("read_id", "b.*")
    tail = bits.kmer_string(-F.col("kid"), config.k)
    observed = F.substr("seq", F.length("path") + 1, F.lit(config.k))
    kept = F.array_join(F.zip_with(F.filter(F.split(tail, ""), lambda c: c != ""), F.filter(F.split(observed, ""), lambda c: c != ""), lambda a, b: F.when(b == "N", b).otherwise(a)), "")
    return best.select("read_id", F.concat("path", kept).alias("seq"), "score")
