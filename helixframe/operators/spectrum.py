"""The k-mer spectrum: exploding reads, counting, flags, pairing, histograms, weights.

Reads become packed k-mers in Arrow batches (bit arithmetic over whole arrays);
everything after that is grouped aggregation, so map-side partial aggregates carry
most of the work and a common k-mer cannot make a task large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import bits
from helixframe.operators import packed

#: How a k-mer was seen, and where counts saturate.
FIRST, NORMAL, LAST = 1, 2, 4
COUNT_MAX, COVERAGE_MAX, HISTOGRAM_MAX = 16383, 1023, 1000
#: Steps of a weight in one unit.
WEIGHT_STEPS = 1 << 30
#: Probability that a base of a quality is right; the C library's pow, as in other engines.
RIGHT = np.array([1 - math.pow(10, -q / 10) for q in range(128)])


def read_arrays(b: pa.RecordBatch, seq: str = "seq") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length: (row numbers, letters as a rows x length byte array)."""
    col = b.column(seq).cast(pa.large_string())
    lengths = np.asarray(pa.compute.binary_length(col).fill_null(0))
    data = col.to_pylist()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if n:
            yield rows, np.frombuffer("".join(data[i] for i in rows).encode(), np.uint8).reshape(len(rows), int(n))


def explode_kmers(reads: DataFrame, k: int, *, both_strands: bool = True, places: bool = False) -> DataFrame:
    """One row per k-mer without N: kid, nxt (the next base's code, null for none or N), rc, status.

    Forward: the k-mer and the base after it. Reverse strand (``rc``): the reverse complement and the complement of
    the base before. status holds FIRST, NORMAL, LAST. Reads no longer than k have none. With ``places``: read_id, pos.
    """
    cols = (["read_id"] if places else []) + ["seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, letters in read_arrays(b):
                if letters.shape[1] <= k:
                    continue
                codes, is_n = bits.CODE[letters], bits.IS_N[letters]
                kid = bits.rolling_ids(codes, k)
                bad = np.cumsum(np.pad(is_n, ((0, 0), (1, 0))), axis=1)
                clean = (bad[:, k:] - bad[:, :-k]) == 0
                m = kid.shape[1]
                none = np.full((len(rows), 1), -1)
                after = np.concatenate([np.where(is_n[:, k:], -1, codes[:, k:]), none], axis=1)
                before = np.concatenate([none, np.where(is_n[:, : m - 1], -1, codes[:, : m - 1] ^ 2)], axis=1)
                status = np.full(m, NORMAL, np.int8)
                status[0], status[-1] = FIRST, LAST
                back = np.full(m, NORMAL, np.int8)
                back[0], back[-1] = LAST, FIRST
                at = np.broadcast_to(np.arange(m), kid.shape)
                who = np.broadcast_to(rows[:, None], kid.shape)
                parts = [(kid, after, False, np.broadcast_to(status, kid.shape))]
                if both_strands:
                    parts.append((bits.rc_ids(kid, k), before, True, np.broadcast_to(back, kid.shape)))
                for ids, nxt, rc, st in parts:
                    n = nxt[clean]
                    out = [pa.array(ids[clean]), pa.array(n.astype(np.int8), mask=n < 0), pa.array(np.full(len(n), rc)), pa.array(st[clean])]
                    names = ["kid", "nxt", "rc", "status"]
                    if places:
                        out += [b.column("read_id").take(pa.array(who[clean])), pa.array(at[clean].astype(np.int32))]
                        names += ["read_id", "pos"]
                    yield pa.RecordBatch.from_arrays(out, names)

    schema = "kid long, nxt byte, rc boolean, status byte" + (", read_id long, pos int" if places else "")
    return reads.select(*cols).mapInArrow(run, schema)


def count_spectrum(reads: DataFrame, k: int, *, weights: int | None = None) -> DataFrame:
    """Per k-mer of either strand: cnt0..cnt3 (forward transitions, saturating), rc_flag, status, and n (forward sightings).

    With ``weights``, the offset of qualities, w0..w3 too: what ``weighted_transitions`` gives, 0 where it has none.
    """
    own = "" if weights is None else "".join(f", w{b} long" for b in range(4))
    rows = packed.tallies(reads, k, packed.Tally.both_strands, "kid long, cnt0 long, cnt1 long, cnt2 long, cnt3 long, rc_flag int, status int, n long" + own, weights=weights)
    rows = rows.withColumns({f"cnt{b}": F.least(f"cnt{b}", F.lit(COUNT_MAX)) for b in range(4)})
    return rows.withColumns({f"w{b}": F.col(f"w{b}") / WEIGHT_STEPS for b in range(4)}) if own else rows


def nodes(spectrum: DataFrame, *, combine: bool = True) -> DataFrame:
    """The spectrum with flag (own transitions, united with those of the other strand), n_trans, coverage, last_kmer."""
    own = sum((F.when(F.col(f"cnt{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(1, 4)), F.when(F.col("cnt0") > 0, F.lit(1)).otherwise(F.lit(0)))
    d = spectrum.withColumn("own_flag", own)
    d = d.withColumn("flag", F.col("own_flag").bitwiseOR(F.col("rc_flag")) if combine else F.col("own_flag"))
    total = F.col("cnt0") + F.col("cnt1") + F.col("cnt2") + F.col("cnt3")
    return d.withColumns({"n_trans": F.bit_count("flag"), "total": total, "coverage": F.least(total, F.lit(COVERAGE_MAX)), "last_kmer": F.col("status").bitwiseAND(F.lit(LAST)) != 0})


def transition_probabilities(node_table: DataFrame) -> DataFrame:
    """kid, base, p: shares of the forward counts (zero for those that only the other strand shows)."""
    d = node_table.select("kid", "flag", "total", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(f"cnt{b}").alias("cnt")) for b in range(4)])).alias("t"))
    d = d.where(F.call_function("shiftright", F.col("flag"), F.col("t.base")).bitwiseAND(F.lit(1)) == 1)
    return d.select("kid", F.col("t.base").alias("base"), F.col("t.cnt").alias("cnt"), F.when(F.col("total") > 0, F.col("t.cnt") / F.col("total")).alias("p"))


def canonical_pairs(node_table: DataFrame, k: int) -> DataFrame:
    """Per pair of a k-mer and its reverse complement: canon (the smaller id), joint count, single_stranded.

    A palindrome meets itself and counts twice.
    """
    rc = bits.rc_id(F.col("kid"), k)
    d = node_table.select(F.least(F.col("kid"), rc).alias("canon"), (F.col("kid") <= rc).alias("low"), (F.col("kid") == rc).alias("own"), "total")
    side = lambda low: F.sum(F.when(F.col("low") == low, F.col("total")).otherwise(0))
    g = d.groupBy("canon").agg(side(True).alias("a"), side(False).alias("b"), F.max("own").alias("own"))
    b = F.when(F.col("own"), F.col("a")).otherwise(F.col("b"))
    return g.select("canon", (F.col("a") + b).alias("joint"), ((F.col("a") == 0) | (b == 0)).alias("single_stranded"))


def histogram(pairs: DataFrame) -> DataFrame:
    """Pairs per joint count, capped at the last bin; n_single: those seen on one strand only."""
    bin_ = F.least(F.col("joint"), F.lit(HISTOGRAM_MAX)).cast("int")
    return pairs.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("single_stranded").cast("long")).alias("n_single"))


def threshold(counts: dict[int, int], gamma: float, *, halve: bool = True) -> tuple[float, int]:
    """(multiplicity threshold, penalty eta) from a histogram of at most 1001 bins.

    The valley ends the first descent from bin 1; the peak is the highest bin from there on; the valley then moves to
    the lowest bin before the peak that holds at least 100 pairs. Where bins hardly differ or rise to the end the threshold is 1.
    """
    h = np.array([counts.get(i, 0) for i in range(HISTOGRAM_MAX + 1)])
    rises = np.flatnonzero(h[2:] > h[1:-1])
    valley = int(rises[0]) + 1 if len(rises) else HISTOGRAM_MAX
    peak = valley + int(h[valley:].argmax())
    between = np.flatnonzero(h[valley:peak] >= 100) + valley
    if len(between) and h[between].min() < h[valley]:
        valley = int(between[h[between].argmin()])
    thr = 1.0 if valley == 1 else valley / (2 if halve else 1)
    if peak == HISTOGRAM_MAX or h[peak] - h[valley] < 1000:
        thr = 1.0
    return thr, math.ceil((thr + 0.1) * math.log(1 + 1 / gamma) + 0.5)


def threshold_eta(hist: DataFrame, gamma: float = 1e-20) -> tuple[float, int]:
    return threshold({r.bin: r.n for r in hist.collect()}, gamma)  # at most 1001 rows


def phred_offset(reads: DataFrame) -> tuple[int, int, int]:
    """(offset, largest quality, longest read): offset 33 if the least character is at most 35, else 64 if at most 66."""
    codes = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c))
    r = reads.select(F.array_min(codes).alias("low"), F.array_max(codes).alias("high"), F.length("seq").alias("len")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("len").alias("len")).first()
    if r.low is None:
        return 33, 40, 0
    if r.low > 66:
        raise ValueError("qualities are neither Phred+33 nor Phred+64")
    offset = 33 if r.low <= 35 else 64
    return offset, r.high - offset, r.len


def transition_weights(letters: np.ndarray, quals: bytes, k: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights in steps, whether there is a transition of that weight) of all places of reads of equal length but the last."""
    q = np.frombuffer(quals, np.uint8).reshape(letters.shape).astype(int) - offset
    p, n = RIGHT[np.clip(q, 0, 127)], letters.shape[1] - k
    w = p[:, :n].copy()
    for j in range(1, k + 1):
        w *= p[:, j : j + n]
    zeros = np.cumsum(np.pad((p <= 0) | bits.IS_N[letters], ((0, 0), (1, 0))), axis=1)
    return np.floor(w * WEIGHT_STEPS + 0.5).astype(np.int64), (zeros[:, k + 1 :] - zeros[:, : -(k + 1)]) == 0


def weight_total(reads: DataFrame, k: int, offset: int = 33) -> float:
    """The sum of all weights that ``weighted_transitions`` gives, without its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quals, whole = b.column("qual").to_pylist(), 0
            for rows, letters in read_arrays(b):
                if letters.shape[1] > k:
                    w, good = transition_weights(letters, "".join(quals[i] for i in rows).encode(), k, offset)
                    whole += int(w[good].sum())
            yield pa.RecordBatch.from_arrays([pa.array([whole])], ["w"])

    rows = reads.select("seq", "qual").mapInArrow(run, "w long")
    return int(rows.agg(F.sum(F.col("w").cast("decimal(20,0)"))).first()[0] or 0) / WEIGHT_STEPS


def weighted_transitions(reads: DataFrame, k: int, offset: int = 33) -> DataFrame:
    """kid, base, weight: transitions weighted by the probability that all their k + 1 bases are right.

    Weights are summed in steps of 2**-30 as integers, so the sums are exact and depend on no order. A transition with a base of quality 0 has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quals = b.column("qual").to_pylist()
            for rows, letters in read_arrays(b):
                if letters.shape[1] <= k:
                    continue
                w, good = transition_weights(letters, "".join(quals[i] for i in rows).encode(), k, offset)
                codes = bits.CODE[letters]
                kid = bits.rolling_ids(codes, k)[:, :-1][good]
                yield pa.RecordBatch.from_arrays([pa.array(kid), pa.array(codes[:, k:][good].astype(np.int32)), pa.array(w[good])], ["kid", "base", "w"])

    rows = reads.select("seq", "qual").mapInArrow(run, "kid long, base int, w long")
    return rows.groupBy("kid", "base").agg((F.sum("w") / WEIGHT_STEPS).alias("weight"))


def select_reads(reads: DataFrame, offset: int = 33, least: float = 30.0) -> DataFrame:
    """Reads of a mean quality of at least ``least``."""
    q = bits.qualities(F.col("qual"), offset)
    return reads.where(F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x) >= least * F.size(q))


def sample_reads(reads: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """A sample without replacement that depends on read_id alone."""
    return reads.where(F.pmod(F.xxhash64(F.lit(seed), F.col("read_id")), F.lit(1_000_000)) < int(share * 1_000_000))


def read_coverage(reads: DataFrame, node_table: DataFrame, k: int) -> DataFrame:
    """read_id, mean and least coverage of its k-mers."""
    seen = explode_kmers(reads, k, both_strands=False, places=True).select("read_id", "kid")
    return seen.join(node_table.select("kid", "coverage"), "kid").groupBy("read_id").agg(F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("least_coverage"))


def own_totals(reads: DataFrame, k: int, most: int) -> DataFrame:
    """read_id, mean, least, n of the totals (at most ``most``) that the reads' own k-mers have among all reads."""
    seen = packed.piece_totals(reads, k, COUNT_MAX, most).groupBy("read_id").agg(F.sum("whole").alias("whole"), F.min("least").alias("least"), F.sum("n").alias("n"))
    return seen.select("read_id", (F.col("whole") / F.col("n")).alias("mean"), "least", "n")


def order_statistic(values: DataFrame, column: str, share: float) -> float | None:
    """The value of rank floor(share * n) (0-based) by exact counts per value. The running sum over the distinct values is one task's: for
    coverages there are at most 1,024."""
    n = values.count()
    if not n:
        return None
    counts = values.groupBy(column).count()
    w = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("count").over(w)).where(F.col("upto") > int(share * n)).agg(F.min(column)).first()[0]


def reciprocal_edges(node_table: DataFrame, k: int) -> DataFrame:
    """Each edge kid -base-> and its reciprocal on the other strand: kid, base, rkid, rbase."""
    e = node_table.select("kid", F.explode(bits.flag_bases(F.col("flag"))).alias("base"))
    rkid = bits.rc_id(bits.successor(F.col("kid"), F.col("base"), k), k)
    return e.select("kid", "base", rkid.alias("rkid"), bits.complement_bits(bits.first_base(F.col("kid"))).alias("rbase"))


def hamming1_neighbours(node_table: DataFrame, k: int) -> DataFrame:
    """Pairs of k-mers (kid < other) that differ in one base, at pos.

    Every k-mer is written once per place with that base masked out. A masked k-mer and the set of its bases, four bits, are all its members, so
    a group is a partial aggregate of its bits.
    """
    place = lambda i: F.shiftrightunsigned("kid", 2 * i).bitwiseAND(F.lit(3)).cast("int")
    masked = F.array(*[F.struct(F.lit(i).alias("pos"), F.col("kid").bitwiseAND(F.lit(~(3 << (2 * i))).cast("long")).alias("rest"), F.call_function("shiftleft", F.lit(1), place(i)).alias("bit")) for i in range(k)])
    groups = node_table.select(F.explode(masked).alias("m")).groupBy("m.pos", "m.rest").agg(F.bit_or("m.bit").alias("bases")).where(F.bit_count("bases") > 1)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(4) for b in range(a + 1, 4)])
    here = F.filter(pairs, lambda p: F.call_function("shiftright", F.col("bases"), p["a"]).bitwiseAND(F.call_function("shiftright", F.col("bases"), p["b"])).bitwiseAND(F.lit(1)) == 1)
    member = lambda c: F.col("rest").bitwiseOR(F.call_function("shiftleft", F.col(f"p.{c}").cast("long"), 2 * F.col("pos")))
    return groups.select("pos", "rest", F.explode(here).alias("p")).select(member("a").alias("kid"), member("b").alias("other"), "pos")


def hamming_neighbours(node_table: DataFrame, ids: DataFrame, k: int, d: int) -> DataFrame:
    """(kid, other): members of the spectrum that differ from ``ids`` (kid) in exactly ``d`` places."""
    from itertools import product

    masks = []
    for m in bits.error_masks(k, d):
        at = [i for i in range(k) if m >> (2 * i) & 3]
        masks += [sum(x << (2 * i) for i, x in zip(at, xs, strict=True)) for xs in product((1, 2, 3), repeat=d)]
    probes = ids.select("kid", F.explode(F.transform(F.lit(masks), lambda m: F.col("kid").bitwiseXOR(m.cast("long")))).alias("other"))
    return probes.join(node_table.select(F.col("kid").alias("other")), "other", "left_semi").select("kid", "other")


def _observed_mass(reads: DataFrame, mass: DataFrame, k: int) -> DataFrame:
    """read_id, pos, mass (kid, mass) of the reads' k-mers; those with N or outside the table are left out."""
    seen = explode_kmers(reads, k, both_strands=False, places=True).select("read_id", "pos", "kid")
    return seen.join(mass.select("kid", "mass"), "kid").select("read_id", "pos", "mass")


def starting_positions(reads: DataFrame, mass: DataFrame, k: int, rho: float) -> DataFrame:
    """read_id, start: the first place whose k-mer has a mass above ``rho``; the number of places where none has."""
    first = _observed_mass(reads, mass, k).where(F.col("mass") > rho).groupBy("read_id").agg(F.min("pos").alias("start"))
    return reads.where(F.length("seq") > k).select("read_id", (F.length("seq") - k + 1).alias("none")).join(first, "read_id", "left").select("read_id", F.coalesce("start", "none").alias("start"))


def coverage_caps(reads: DataFrame, mass: DataFrame, k: int, rho: float, high: float, most: int) -> DataFrame:
    """read_id, cap: a Hamming cap by coverage: ``most``; half of it where every k-mer's mass exceeds ``rho``, a quarter where their mean also exceeds ``high``."""
    seen = _observed_mass(reads, mass, k).groupBy("read_id").agg(F.avg("mass").alias("mean"), F.min("mass").alias("least"), F.count(F.lit(1)).alias("n"))
    return caps_of(reads, seen, k, rho, high, most)


def caps_of(reads: DataFrame, seen: DataFrame, k: int, rho: float, high: float, most: int) -> DataFrame:
    """``coverage_caps`` from read_id, mean, least, n of the masses of a read's k-mers."""
    d = reads.where(F.length("seq") > k).select("read_id", (F.length("seq") - k + 1).alias("places")).join(seen, "read_id", "left")
    covered = (F.col("n") == F.col("places")) & (F.col("least") > rho)
    return d.select("read_id", F.when(covered & (F.col("mean") > high), most // 4).when(covered, most // 2).otherwise(most).alias("cap"))


def low_coverage_runs(reads: DataFrame, node_table: DataFrame, k: int, least: int) -> DataFrame:
    """read_id, start, n: maximal runs of places whose k-mers have a coverage below ``least`` (absent ones count as 0)."""
    seen = explode_kmers(reads, k, both_strands=False, places=True).select("read_id", "pos", "kid")
    low = seen.join(node_table.select("kid", "coverage"), "kid", "left").where(F.coalesce("coverage", F.lit(0)) < least)
    island = F.col("pos") - F.row_number().over(Window.partitionBy("read_id").orderBy("pos"))
    return low.select("read_id", "pos", island.alias("island")).groupBy("read_id", "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n")).drop("island")


def describe_kmer(node_table: DataFrame, kmer: str) -> DataFrame:
    """Everything known of one k-mer and its reverse complement."""
    k = len(kmer)
    kid = bits.kmer_id(F.lit(kmer))
    return node_table.where((F.col("kid") == kid) | (F.col("kid") == bits.rc_id(kid, k))).withColumn("kmer", bits.kmer_string(F.col("kid"), k))


def draw_transitions(p: DataFrame, seed: int) -> DataFrame:
    """kid, base: one transition per k-mer drawn with its probability ``p``; the draw depends on the k-mer and the seed alone."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("kid")), F.lit(1 << 40)) / float(1 << 40)
    g = p.groupBy("kid").agg(F.sort_array(F.collect_list(F.struct("base", "p"))).alias("t"))  # at most four
    upto = F.aggregate("t", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("base")), lambda a, x: F.struct((a["sum"] + x["p"]).alias("sum"), F.when(a["base"].isNull() & (a["sum"] + x["p"] > u), x["base"]).otherwise(a["base"]).alias("base")), lambda a: a["base"])
    return g.select("kid", F.coalesce(upto, F.element_at("t", -1)["base"]).alias("base"))
