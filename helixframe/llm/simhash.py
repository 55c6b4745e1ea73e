"""SimHash near-duplicates by the general pigeonhole principle.

1. One fingerprint per document; equal fingerprints are one class. ``near_duplicates`` takes 64 bits of
   three-word shingles, ``similar_groups`` (the pipeline's) 128 bits of five-word shingles, of which the first
   64 are probed and all are verified.
2. The number m of partitions is the one whose estimated rows and candidates cost least. The correlation of bits over all classes orders them into partitions:
   correlated bits share a partition, so its values are uneven and the
   estimated candidates of a probe differ from partition to partition.
3. With m partitions and distance tau, every pair within tau agrees to within T_i
   in some partition i whenever the thresholds T_i (-1: not probed) sum to
   tau - m + 1. Per fingerprint the thresholds are allocated by dynamic
   programming on the candidates that histograms of the partitions' values predict.
4. Each fingerprint is stored under its value in every partition and probes all
   values within T_i there. Rows that meet are verified on the whole fingerprint
   and each bucket passes on a spanning forest of its links, never its pairs.
5. Components of the links are found by a distributed star algorithm.

Buckets larger than ``block`` are dealt out over blocks, every block of stored
rows meeting every block of probes, so no task holds a whole hot bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

SEED = 42
BITS = 64


def fingerprint(text: str, shingle: int = 3) -> int:
    """The SimHash of a text: ASCII-lower-cased words, ``shingle``-word shingles with repeats,
    XXH64 (seed 42), a bit set if set in over half the hashes. Fewer words: the whole sequence; none: 0."""
    words = text.encode().lower().split()  # bytes: splits at x20 and x09-x0D, lower-cases A-Z
    if not words:
        return 0
    norm = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(norm, SEED)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(norm)]
    digest, seed, counts = xxhash.xxh64_intdigest, SEED, np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        h = np.array([digest(norm[a:b], seed) for a, b in zip(starts[i : i + 65536], ends[i : i + 65536], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def wide_fingerprint(text: str, shingle: int) -> tuple[int, int]:
    """The same in 128 bits, by XXH3: (low 64 bits, high 64 bits)."""
    words = text.encode().lower().split()
    if not words:
        return 0, 0
    norm = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        whole = xxhash.xxh3_128_digest(norm, SEED)
        return int.from_bytes(whole[:8], "little"), int.from_bytes(whole[8:], "little")
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(norm)]
    digest, seed, counts = xxhash.xxh3_128_digest, SEED, np.zeros(2 * BITS, np.int64)
    for i in range(0, n, 65536):
        h = b"".join([digest(norm[a:b], seed) for a, b in zip(starts[i : i + 65536], ends[i : i + 65536], strict=True)])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    low, high = np.packbits(2 * counts > n, bitorder="little").view("<u8").tolist()
    return low, high


def fingerprints(docs: DataFrame, shingle: int = 3, wide: bool = False) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp is the fingerprint as a signed long. A null text has no words. wide: and its next 64 bits, fp2."""
    shared.small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.sliced(batches):
            texts = b.column(1).to_pylist()
            found = [wide_fingerprint(t, shingle) if wide else (fingerprint(t, shingle),) for t in texts]
            cols = [pa.array(np.array([f[i] for f in found], dtype="u8").view("i8")) for i in range(1 + wide)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "fp", "fp2"][: 2 + wide])

    return source.mapInArrow(shared.releasing(run), "doc_id long, fp long" + (", fp2 long" if wide else ""))


def bit_groups(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Bits in ``m`` groups of near-equal size; each group grows by the bit most correlated with it."""
    strength, left, groups = np.abs(correlation), set(range(BITS)), []
    for g in range(m):
        want = len(left) // (m - g)
        rest = sorted(left)
        group = [max(rest, key=lambda i: (strength[i, rest].sum(), -i))]
        left.discard(group[0])
        while len(group) < want:
            best = max(sorted(left), key=lambda i: (strength[i, group].sum(), -i))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of the chosen bits, the first one lowest."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(width: int, most: int) -> list[np.ndarray]:
    """For t = 0..most the masks of ``width`` bits with exactly t set."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(width), t)], dtype=np.uint64) for t in range(most + 1)]


def allocate(cost: np.ndarray, tau: int) -> np.ndarray:
    """Thresholds by dynamic programming.

    cost[q, i, t + 1] is the estimated cost of threshold t (-1..tau) in partition i for
    fingerprint q; the result's rows sum to tau - m + 1 with the least total cost.
    """
    n, m, _ = cost.shape
    budget = tau + 1  # sum of (t + 1) over the partitions
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((m, n, budget + 1), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for b in range(budget + 1):
            for t in range(b + 1):
                c = best[:, b - t] + cost[:, i, t]
                better = c < new[:, b]
                new[better, b] = c[better]
                choice[i, better, b] = t
        best = new
    out, left = np.zeros((n, m), np.int8), np.full(n, budget)
    for i in reversed(range(m)):
        out[:, i] = choice[i, np.arange(n), left]
        left = left - out[:, i]
    return out - 1


class Plan:
    """The partitions of the bits and, per partition, a histogram of its values' low ``coarse`` bits."""

    def __init__(self, groups: list[list[int]], coarse: int, histograms: list[np.ndarray], tau: int, row_cost: float):
        self.groups, self.coarse, self.histograms, self.tau, self.row_cost = groups, coarse, histograms, tau, row_cost

    def estimate(self, fp: np.ndarray) -> np.ndarray:
        """cost[q, i, t + 1]: expected stored rows met, and ``row_cost`` per probe that is sent."""
        out = np.zeros((len(fp), len(self.groups), self.tau + 2))
        for i, bits in enumerate(self.groups):
            v, width = values(fp, bits), len(bits)
            low = min(width, self.coarse)
            h, share = self.histograms[i], 2.0 ** (low - width)
            own = (v & np.uint64((1 << low) - 1)).astype(np.int64)
            near = h[own].astype(float)
            met = near * share
            out[:, i, 1] = met + self.row_cost
            sent, total = 1, met
            for t in range(1, self.tau + 1):
                ring = masks(width, t)[t]
                sent += len(ring)
                if t == 1:  # flips of low bits lead to other histogram cells, flips of high bits stay in theirs
                    flips = sum((h[own ^ (1 << b)] for b in range(low)), np.zeros(len(fp)))
                    total = total + (flips + (width - low) * near) * share
                else:
                    total = total * (width / t)
                out[:, i, t + 1] = total + sent * self.row_cost
        return out


def _plan(classes: DataFrame, tau: int, m: int, coarse: int, row_cost: float) -> Plan:
    """Two passes over the classes; only a 64 x 64 matrix and m * 2**coarse counts reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            fp = b.column(0).to_numpy().view("u8")
            x = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            together += x.T @ x
            n += len(fp)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "xx": pa.array([together.ravel().tolist()], pa.list_(pa.float64()))})

    parts = classes.select("fp").mapInArrow(moments, "n long, xx array<double>")
    sums = parts.select("n", F.posexplode("xx").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas().sort_values("at")
    n = float(sums["n"].iloc[0]) if len(sums) else 0.0
    correlation = np.eye(BITS)
    if n > 1:
        together = sums["x"].to_numpy().reshape(BITS, BITS) / n
        p = np.diag(together)
        sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        correlation = (together - np.outer(p, p)) / np.outer(sd, sd)
    groups = bit_groups(correlation, m)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = [np.zeros(1 << min(len(g), coarse), np.int64) for g in groups]
        for b in batches:
            fp = b.column(0).to_numpy().view("u8")
            for h, g in zip(hist, groups, strict=True):
                h += np.bincount((values(fp, g) & np.uint64(len(h) - 1)).astype(np.int64), minlength=len(h))
        for i, h in enumerate(hist):
            at = np.flatnonzero(h)
            if len(at):
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(at), i, "i4")), "cell": pa.array(at.astype("i4")), "n": pa.array(h[at])})

    table = classes.select("fp").mapInArrow(counts, "part int, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n")).toPandas()
    hist = [np.zeros(1 << min(len(g), coarse), np.int64) for g in groups]
    for i, h in enumerate(hist):
        own = table[table["part"] == i]
        h[own["cell"].to_numpy()] = own["n"].to_numpy()
    return Plan(groups, coarse, hist, tau, row_cost)


def partitions_for(n: int, tau: int, row_cost: float, block: int) -> int:
    """The number of partitions that costs least for ``n`` fingerprints: rows dealt and rows met, were all bits even."""

    def cost(m: int) -> float:
        rows = met = 0.0
        for i in range(m):
            width = BITS // m + (i < BITS % m)
            t = (tau + 1) // m + (i < (tau + 1) % m) - 1  # thresholds sum to tau - m + 1
            probes = sum(math.comb(width, x) for x in range(t + 1))
            rows += (max(probes, 1)) * max(1.0, n / 2**width / block)
            met += probes * n / 2**width
        return rows * row_cost + met

    return min(range(1, tau + 2), key=cost)


STORED, PROBE = 1, 2
#: Rows whose buckets are compared together; a bucket's rows up to which all of them meet; comparisons that are held at once.
VERIFY_ROWS, SMALL_GROUP, TABLE = 16_384, 32, 1 << 17


def _probes(fp: np.ndarray, plan: Plan, block: int) -> tuple[np.ndarray, ...]:
    """(key, block, role, row) of fingerprints: where they are stored and what they probe; row: the number in ``fp``."""
    thresholds = allocate(plan.estimate(fp), plan.tau)
    key, blk, role, who = [], [], [], []
    every = np.arange(len(fp))

    def put(i, v, as_what, rows):
        h = plan.histograms[i]
        n_blocks = -(-h[(v & np.uint64(len(h) - 1)).astype(np.int64)] // block)  # stored rows of a bucket: at most this many blocks
        n_blocks = np.maximum(n_blocks, 1)
        base = (np.uint64(i + 1) << np.uint64(58)) ^ v
        one = n_blocks == 1
        key.append(base[one]), blk.append(np.zeros(one.sum(), np.int64)), role.append(np.full(one.sum(), as_what, np.int8)), who.append(rows[one])
        for k in np.flatnonzero(~one).tolist():
            n = int(n_blocks[k])
            mine = int(_mix(fp[rows[k : k + 1]])[0] % np.uint64(n))
            for w in (STORED, PROBE):
                if as_what & w:
                    at = mine * n + np.arange(n) if w == STORED else np.arange(n) * n + mine
                    key.append(np.full(n, base[k])), blk.append(at.astype(np.int64)), role.append(np.full(n, w, np.int8)), who.append(np.full(n, rows[k]))

    for i, bits in enumerate(plan.groups):
        v = values(fp, bits)
        probing = thresholds[:, i] >= 0
        put(i, v[probing], STORED | PROBE, every[probing])
        put(i, v[~probing], STORED, every[~probing])
        rings = masks(len(bits), int(thresholds[:, i].max(initial=0)))
        for t in range(1, len(rings)):
            out = thresholds[:, i] >= t
            for mask in rings[t]:
                put(i, v[out] ^ mask, PROBE, every[out])
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(key, np.uint64), cat(blk, np.int64), cat(role, np.int8), cat(who, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def forest(group: np.ndarray, fp: np.ndarray, role: np.ndarray, tau: int, fp2: np.ndarray | None = None, tau_all: int = 0) -> list[tuple[int, int]]:
    """Links (row, row) that join all rows of equal ``group`` (sorted) which lie within ``tau``, and with ``fp2`` within ``tau_all`` in both
    words together, and of which one probes the other."""
    n = len(fp)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    linked, label = set(), np.arange(n)

    def join(a, b):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                linked.update((x, y))

    def near(a, b):
        bits = np.bitwise_count(fp[a] ^ fp[b])
        return (bits <= tau) if fp2 is None else (bits <= tau) & (bits + np.bitwise_count(fp2[a] ^ fp2[b]) <= tau_all)

    starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    # small groups: all rows meet the next one, then the one after, and so on
    ends, at, shift = np.repeat(starts + sizes, sizes), np.flatnonzero(np.repeat(sizes <= SMALL_GROUP, sizes)), 1
    while len(at := at[ends[at] > at + shift]):
        other = at + shift
        meet = ((role[at] & PROBE) != 0) & ((role[other] & STORED) != 0) | ((role[at] & STORED) != 0) & ((role[other] & PROBE) != 0)
        a, b = at[meet], other[meet]
        hit = near(a, b)
        join(a[hit], b[hit])
        shift += 1
    # large groups: tables of stored rows by probes
    for lo, size in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist(), strict=True):
        own = role[lo : lo + size]
        stored, probes = lo + np.flatnonzero(own & STORED), lo + np.flatnonzero(own & PROBE)
        if not len(stored) or not len(probes):
            continue
        step, sought = max(1, TABLE // len(probes)), fp[probes]
        for i in range(0, len(stored), step):
            part = stored[i : i + step]
            a, b = np.divmod(np.flatnonzero(np.bitwise_count(fp[part][:, None] ^ sought) <= tau), len(probes))
            a, b = part[a], probes[b]
            left = label[a] != label[b]  # joined rows need no further look
            if fp2 is not None:
                left &= near(a, b)
            while len(a := a[left]):
                b = b[left]
                first = np.zeros(n, np.int64)
                for x in (a, b):  # each row's first link of those left: components that have one at least halve
                    first[x[::-1]] = np.arange(len(x))[::-1]
                    take = np.flatnonzero(first[x] == np.arange(len(x)))
                    join(a[take], b[take])
                mine = np.array(parent[lo : lo + size])
                while (mine != mine[mine - lo]).any():
                    mine = mine[mine - lo]
                label[lo : lo + size] = mine
                left = label[a] != label[b]
    return [(x, root(x)) for x in sorted(linked) if root(x) != x]  # stars: paths of the forest would take more rounds to contract


def links(classes: DataFrame, *, tau: int = 3, tau_all: int | None = None, partitions: int | None = None, coarse: int = 16, row_cost: float = 1500.0, block: int = 4096) -> DataFrame:
    """(u, v): links that have the same components as all links between the distinct fingerprints ``classes``.

    classes (fp): links within ``tau`` of fp; u and v are fingerprints. classes (fp, fp2, node): links within ``tau`` of fp and
    ``tau_all`` of both words; u and v are nodes. partitions: None for the number that costs least.
    """
    spark = classes.sparkSession
    wide = tau_all is not None
    if partitions is None:
        partitions = partitions_for(classes.count(), tau, row_cost, block)
    shipped = spark.sparkContext.broadcast(_plan(classes, tau, partitions, coarse, row_cost))  # partitions * 2**coarse counts
    own = ["fp", "fp2", "node"] if wide else ["fp"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.sliced(batches):
            key, blk, role, row = _probes(b.column(0).to_numpy().view("u8"), shipped.value, block)
            taken = pa.array(row)
            # one number, so Spark sorts by it without comparing rows; blocks that chance gives the same one only meet in addition
            bucket = _mix(key + blk.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view("i8")), pa.array(role), *[b.column(i).take(taken) for i in range(len(own))]], ["bucket", "role", *own])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy() for i in range(2 + len(own))])
            n += b.num_rows
            if n < VERIFY_ROWS:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero(rows[0] != rows[0][-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield found([x[:cut] for x in rows])
            held, n = [[x[cut:] for x in rows]], len(rows[0]) - cut
        if n:
            yield found([np.concatenate(x) for x in zip(*held, strict=True)])

    def found(rows):
        bucket, role, fp, *more = rows
        group = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]]))
        fp2 = more[0].view("u8") if wide else None
        pairs = np.array(forest(group, fp.view("u8"), role, tau, fp2, tau_all or 0), dtype=np.int64).reshape(-1, 2)
        name = more[1] if wide else fp
        return pa.RecordBatch.from_arrays([pa.array(name[pairs[:, k]]) for k in (0, 1)], ["u", "v"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select(*own).mapInArrow(shared.releasing(deal), "bucket long, role byte, " + ", ".join(f"{c} long" for c in own))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(shared.releasing(verify), "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, **linking) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, fp.

    component_id is the smallest doc_id reachable over links of at most ``tau``
    differing bits, the row's own included. A null or empty text has no words and
    fingerprint zero, which links like any other. Null doc_ids keep their rows; they
    count for no component_id, which is null where no row reached has an id.
    Repeated rows and ids all stay. An empty table gives no rows; other columns are ignored.
    """
    rows = shared.written(fingerprints(docs, shingle), "fingerprints")
    classes = shared.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    linked = components(links(classes, **linking))
    named = linked.join(classes, linked.node == classes.fp).select("node", "component", "least")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = named.join(smallest, "component").select("node", "smallest")
    ids = classes.join(linked, classes.fp == linked.node, "left").select("fp", "n", F.when(F.col("node").isNotNull(), F.col("smallest")).otherwise(F.col("least")).alias("component_id"))
    named = _with_classes(rows, shared.written(ids, "class-components"), ["fp"])
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def _with_classes(rows: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of their class; classes (n: its rows) is a written table.

    At most 1000 classes can hold over a thousandth of the rows each: these are broadcast, so no task gets a hot class.
    """
    often = F.col("n") * 1000 > rows.count()
    hot = F.broadcast(classes.where(often).drop("n"))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(classes.where(~often).drop("n"), on))


def similar_groups(docs: DataFrame, *, shingle: int = 5, tau: int = 10, tau_all: int = 20, **linking) -> DataFrame:
    """(doc_id, component_id) per row of ``docs`` (doc_id, text): the smallest doc_id reachable over links of similar texts.

    Fingerprints have 128 bits of ``shingle``-word shingles. The share of differing bits estimates the angle between two texts'
    shingle counts: a Jaccard similarity of 0.8 gives 19.4 of 128 on average, so ``tau_all`` = 20 accepts from about there, and pairs
    must lie within ``tau`` in the first 64 (9.7 on average), which are probed. Both are estimates; the README states the shares found.

    Texts without words, null and empty ones are one group. Rows that repeat a doc_id are one document, which links the groups
    of its texts. Rows with a null doc_id take no part. An empty table gives no rows.
    """
    rows = shared.written(fingerprints(docs.where("doc_id is not null"), shingle, wide=True), "fingerprints")
    classes = shared.written(rows.groupBy("fp", "fp2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    several = rows.groupBy("doc_id").agg(F.min(F.struct("fp", "fp2")).alias("a"), F.max(F.struct("fp", "fp2")).alias("b")).where("a <> b").select("doc_id")
    same = rows.join(several, "doc_id", "left_semi").distinct().join(classes, ["fp", "fp2"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    linked = components(links(classes, tau=tau, tau_all=tau_all, **linking).unionByName(same))
    ids = classes.join(linked, "node", "left").select("fp", "fp2", "n", F.coalesce("component", "node").alias("component_id"))
    return _with_classes(rows, shared.written(ids, "class-components"), ["fp", "fp2"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those that ``similar_groups`` finds together with a smaller doc_id.

    Rows that repeat a doc_id are one document and stay or go together; rows with a null doc_id stay.
    """
    drop = shared.written(similar_groups(docs, **options).where(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct(), "later-duplicates")
    own = shared.narrowed(docs, "doc_id", "text")
    maybe, unique = shared.divided(own, F.col("doc_id"), drop)
    return shared.widened(unique.unionByName(maybe.join(drop, "doc_id", "left_anti").select(own.columns)), docs.columns)
