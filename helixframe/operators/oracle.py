"""Oracle modes: the model of the true reads, and correction restricted to it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.config import EngineConfig
from helixframe.functions import bits
from helixframe.operators import em, kernel, packed, spectrum
from helixframe.plans.storage import stored


def apply_truth(reads: DataFrame, truth: DataFrame) -> DataFrame:
    """Reads with their listed errors undone: all columns, seq replaced. Reads without an entry stay."""
    edits = truth.groupBy("identifier").agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("edits"))
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    fixed = F.array_join(F.transform(letters, lambda c, i: F.coalesce(F.element_at("edits", (i + 1).cast("int")), c)), "")
    return reads.join(edits, "identifier", "left").withColumn("seq", F.when(F.col("edits").isNull(), F.col("seq")).otherwise(fixed)).select(reads.columns)


def missing_kmers(reads: DataFrame, true_reads: DataFrame, k: int) -> DataFrame:
    """kid, n: k-mers of the true reads that the observed reads never show."""
    seen = spectrum.count_spectrum(reads, k).select("kid")
    return packed.sightings_of(true_reads, k).join(seen, "kid", "left_anti")


def true_table(both: DataFrame, k: int) -> DataFrame:
    """The model's table of the shares of true transitions: kid, label, flag, mass, log_init, lp0..lp3, genomic (a k-mer of a true read).

    both: seq and true_seq. Transitions of the true reads count jointly over the strands, within the observed spectrum; those that no true read takes on
    either strand are dropped. A bucket of pieces has a k-mer's sightings on both strands, so it also shows which k-mers a path may end in without a
    transition of their own: those whose reverse complements have one. Only the sum of masses needs all buckets; both passes read one shuffle.
    """
    reads = F.when(F.col("seq") == F.col("true_seq"), F.array(F.struct("seq", F.lit(3).alias("mark")))).otherwise(F.array(F.struct("seq", F.lit(1).alias("mark")), F.struct(F.col("true_seq").alias("seq"), F.lit(2).alias("mark"))))
    found = packed.pieces(both.select(F.explode(reads).alias("r")).select("r.*"), k, marked=True)

    def kept(observed: packed.Tally, true: packed.Tally) -> tuple[np.ndarray, np.ndarray]:
        """(k-mers of the true reads and their reverse complements, counts of their transitions that the spectrum holds)."""
        own, (back, taken) = true.kid.view(np.int64), true.other_strand()
        every = np.unique(np.concatenate([own, back]))
        joint, seen = np.zeros((4, len(every)), np.int64), np.zeros((4, len(every)), bool)
        joint[:, np.searchsorted(every, own)] = true.sums[:4]
        joint[:, np.searchsorted(every, back)] += taken
        for ids, counts in ((observed.kid.view(np.int64), observed.sums[:4]), observed.other_strand()):
            here = np.isin(ids, every)
            seen[:, np.searchsorted(every, ids[here])] |= counts[:, here] > 0
        return every, np.where(seen, joint, 0)

    def model(observed: packed.Tally, true: packed.Tally) -> list[np.ndarray]:
        every, n = kept(observed, true)
        mass, other = n.sum(axis=0), np.searchsorted(every, bits.rc_ids(every, k))
        inside = (mass > 0) | (mass[other] > 0)
        genomic = np.isin(every, true.kid.view(np.int64))
        return [x[inside] for x in (every, mass, *n, genomic)]

    whole = packed.marked_tallies(found, k, lambda *x: [kept(*x)[1].sum(keepdims=True).ravel()], "mass long").agg(F.coalesce(F.sum("mass"), F.lit(0)).alias("whole"))
    rows = packed.marked_tallies(found, k, model, "kid long, mass long, " + ", ".join(f"n{b} long" for b in range(4)) + ", genomic boolean").crossJoin(F.broadcast(whole))
    flag = sum((F.when(F.col(f"n{b}") > 0, 1 << b).otherwise(0) for b in range(1, 4)), F.when(F.col("n0") > 0, 1).otherwise(0))
    lp = [F.when(F.col(f"n{b}") > 0, F.ln(F.col(f"n{b}") / F.col("mass"))).alias(f"lp{b}") for b in range(4)]
    return rows.select("kid", F.lit(0).alias("label"), flag.alias("flag"), F.col("mass").cast("double").alias("mass"), F.when(F.col("mass") > 0, F.ln(F.col("mass") / F.col("whole"))).alias("log_init"), *lp, "genomic")


def true_fit(both: DataFrame, config: EngineConfig) -> em.Fit:
    """The model of reads (seq, qual, true_seq) whose transitions are the shares of the true ones; everything else is dropped."""
    offset, q_max, max_len = spectrum.phred_offset(both)
    base, qual = kernel.first_emission(config.k, em.slots(config, max_len), q_max, config.error_rate, config.emission)
    return em.Fit(stored(true_table(both, config.k), "true-model"), base, qual, config.eta or 0.0, offset, config.slot, [])


def with_true_seq(reads: DataFrame, truth: DataFrame) -> DataFrame:
    """read_id, identifier, seq, qual, and true_seq: the read with its listed errors undone."""
    true = apply_truth(reads.select("read_id", "identifier", "seq"), truth).select("read_id", F.col("seq").alias("true_seq"))
    return reads.select("read_id", "identifier", "seq", "qual").join(true, "read_id")


def perfect_oracle(reads: DataFrame, truth: DataFrame, config: EngineConfig) -> DataFrame:
    """Corrections by the true model for the reads with listed errors; all others are emitted as they are.

    The first state is the true first k-mer; every later one must be a true k-mer that differs from the read exactly at listed errors. Of
    the paths left the one of the likeliest transitions is taken (emission counts for nothing). Qualities stay.
    """
    both = stored(with_true_seq(reads, truth), "true-reads")
    fitted = true_fit(both, config)
    fitted = em.Fit(fitted.table, np.zeros_like(fitted.base), np.zeros_like(fitted.qual), fitted.eta, fitted.offset, fitted.window, [])
    listed = truth.select("identifier").distinct()
    fixed = em.decode(both.join(listed, "identifier", "left_semi"), fitted, config.with_(update_quality=False, adaptive=False, max_hamming=None, use_init_prob=False), restrict=True)
    rest = reads.join(listed, "identifier", "left_anti").select("read_id", "identifier", "seq", "qual", F.lit(0).alias("zl"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("n_changed"))
    return fixed.unionByName(rest)


def oracle_em(reads: DataFrame, truth: DataFrame, config: EngineConfig) -> em.Fit:
    """Expectation maximisation on the true graph: the first state is the true first k-mer, transitions stay, emission is fitted."""
    both = stored(with_true_seq(reads, truth), "true-reads")
    initial = true_fit(both, config)
    return em.fit(both, config, initial=initial, transitions=False)
