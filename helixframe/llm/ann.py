"""Maximum inner product search with score-aware anisotropic quantisation.

Codebooks: the dimensions are cut into subspaces of ``sub_dims``, each with 16
centres. Training weighs the residual's part parallel to a vector by ``eta``
against the orthogonal part, since for the queries that score a vector highly the
parallel part is what changes the score: codes are assigned by coordinate descent
on that loss and centres solve its weighted least squares. Every row's direction
is encoded to four-bit codes, what they leave of it to 16-bit steps, and what
these leave is kept as a length.

Search: queries in blocks meet the codes of rows in blocks, never their vectors.
The inner product with what the codes restore is off by at most the length that
they leave, so a cell knows bounds of every score, and a row goes on unless ``k``
others are surely better. The rows of all cells are then scored exactly: a block
of queries gets each vector that any of its queries asks for once. So the result
is that of comparing all pairs, whatever the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared


class Quantiser:
    """16 centres for each of the subspaces (``centres``: subspaces x 16 x sub_dims), for vectors of ``dims``."""

    def __init__(self, dims: int, sub_dims: int, eta: float):
        self.dims, self.sub_dims, self.eta = dims, sub_dims, eta
        self.n_sub = -(-dims // sub_dims)
        self.n_sub += self.n_sub % 2  # two codes to a byte
        self.centres = np.zeros((self.n_sub, 16, sub_dims), np.float32)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """rows x subspaces x sub_dims, padded with zeros."""
        pad = np.zeros((len(x), self.n_sub * self.sub_dims), np.float32)
        pad[:, : self.dims] = x
        return pad.reshape(len(x), self.n_sub, self.sub_dims)

    def assign(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows x subspaces) that minimise |r|^2 + (eta - 1) * <r, x>^2 / |x|^2 over coordinate descent."""
        p = self.parts(x)
        norm = np.maximum((p * p).sum(axis=(1, 2)), 1e-30)
        loss = np.stack([((p[:, s, None, :] - self.centres[s]) ** 2).sum(-1) for s in range(self.n_sub)], axis=1)
        dot = np.stack([((p[:, s, None, :] - self.centres[s]) * p[:, s, None, :]).sum(-1) for s in range(self.n_sub)], axis=1)
        codes = loss.argmin(-1)
        rows = np.arange(len(x))
        along = np.take_along_axis(dot, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for s in range(self.n_sub):
                rest = along - dot[rows, s, codes[:, s]]
                total = loss[:, s] + (self.eta - 1) * (rest[:, None] + dot[:, s]) ** 2 / norm[:, None]
                codes[:, s] = total.argmin(-1)
                along = rest + dot[rows, s, codes[:, s]]
        return codes.astype(np.uint8)

    def train(self, x: np.ndarray, rounds: int, seed: int) -> Quantiser:
        rng = np.random.default_rng(seed)
        p = self.parts(x)
        for s in range(self.n_sub):  # a few plain steps first
            c = p[rng.choice(len(x), 16, replace=len(x) < 16), s].copy()
            for _ in range(8):
                near = ((p[:, s, None, :] - c) ** 2).sum(-1).argmin(1)
                for k in range(16):
                    if (near == k).any():
                        c[k] = p[near == k, s].mean(0)
            self.centres[s] = c
        unit = p / np.sqrt(np.maximum((p * p).sum(axis=(1, 2)), 1e-30))[:, None, None]
        for _ in range(rounds):
            codes = self.assign(x)
            residual = p - self.decoded(codes)
            for s in range(self.n_sub):  # weighted least squares for one subspace, the others fixed
                along = (residual * unit).sum(axis=(1, 2)) + (self.centres[s][codes[:, s]] * unit[:, s]).sum(-1) - (p[:, s] * unit[:, s]).sum(-1)
                for k in range(16):
                    own = codes[:, s] == k
                    if own.sum() < 4:
                        continue
                    u, y = unit[own, s], p[own, s]
                    left = own.sum() * np.eye(self.sub_dims) + (self.eta - 1) * u.T @ u
                    right = y.sum(0) + (self.eta - 1) * (u * (along[own] + (y * u).sum(-1))[:, None]).sum(0)
                    self.centres[s, k] = np.linalg.solve(left, right)
                residual[:, s] = p[:, s] - self.centres[s][codes[:, s]]
        return self

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([self.centres[s][codes[:, s]] for s in range(self.n_sub)], axis=1)

    def layout(self) -> np.dtype:
        """What is kept of a row: codes, steps from what they name, a step's length, what is left, and the vector's length."""
        return np.dtype([("code", np.uint8, (self.n_sub // 2,)), ("fine", "<i2", (self.dims,)), ("step", "<f4"), ("left", "<f4"), ("norm", "<f8")])

    def encoded(self, x: np.ndarray) -> np.ndarray:
        unit, norm = directions(x)
        out = np.zeros(len(x), self.layout())
        out["code"], out["norm"] = packed(self.assign(unit.astype(np.float32))), norm
        rest = unit - self.restored(out)
        out["step"] = np.abs(rest).max(axis=1) / 32_000
        out["fine"] = np.rint(rest / np.where(out["step"] > 0, out["step"], 1)[:, None])
        out["left"] = np.sqrt(((unit - self.restored(out)) ** 2).sum(axis=1)) * (1 + 1e-6)
        return out

    def restored(self, rows: np.ndarray) -> np.ndarray:
        """rows x dims, in single precision: the directions as far as they are kept."""
        codes = np.stack([rows["code"] >> 4, rows["code"] & 15], axis=2).reshape(len(rows), self.n_sub)
        return self.decoded(codes).reshape(len(rows), -1)[:, : self.dims] + rows["fine"] * rows["step"][:, None]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and the vectors' lengths, in double precision (no square over- or underflows)."""
    most = np.abs(x).max(axis=1, keepdims=True)
    unit = x / most
    length = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        return unit / length, np.minimum(most * length, np.finfo(float).max)[:, 0]


def packed(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def _usable(table: DataFrame) -> DataFrame:
    """vec_id and vector of the rows whose vector has components, all finite, and not all zero."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), good.alias("good")).where(F.coalesce("good", F.lit(False))).drop("good")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its ``k + 1`` smallest vec_ids: more of them cannot reach a result.

    Every task first reduces its own rows, so copies of a common vector are never gathered.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict = {}
        for b in batches:
            flat = b.column("vector").flatten().to_numpy()
            ends = np.cumsum([0, *b.column("vector").value_lengths().to_pylist()])
            for i, vec_id in enumerate(b.column("vec_id").to_pylist()):
                ids = have.setdefault((flat[ends[i] : ends[i + 1]] + 0.0).tobytes(), [])
                ids.append(vec_id)
                if len(ids) > 8 * (k + 1):
                    ids[:] = sorted(set(ids))[: k + 1]
            if len(have) >= 20_000:
                yield out(have)
                have.clear()
        yield out(have)

    def out(have):
        vectors = [np.frombuffer(v) for v in have]
        return pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float64())), pa.array([sorted(set(i))[: k + 1] for i in have.values()], pa.list_(pa.int64()))], ["vector", "ids"])

    part = rows.mapInArrow(smallest, "vector array<double>, ids array<long>")
    return part.groupBy("vector").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def blocks_of(n: int, most: int, parallel: int = 1, least: int = 64) -> int:
    """Into how many blocks of at most ``most`` ``n`` go: ``parallel`` if these hold at least ``least`` each."""
    return max(1, -(-n // most), min(parallel, n // least))


def search(
    table: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    sub_dims: int = 2,
    eta: float = 4.0,
    rerank: int = 400,
    query_block: int = 4096,
    row_block: int = 262_144,
    train_rows: int = 10_000,
    train_rounds: int = 4,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` rows of ``table`` with the largest inner product, for every row of ``queries`` (both: vec_id, embedding).

    Columns: query_id, rank (from 1), vec_id, score (the inner product of the original vectors in double precision). A row
    is no neighbour of its own vec_id; ties go to the smaller vec_id. Null, empty, zero and non-finite vectors and
    null vec_ids take no part, nor do vectors of another length than the commonest meet a query of it (lengths are kept
    apart). Repeated rows of a vec_id count once. An empty table or no queries give no rows; other columns are ignored.

    The quantiser is fitted to at most ``train_rows`` distinct vectors; all rows are encoded and searched. A cell holds at most
    ``row_block`` codes and ``query_block`` queries, a block for reranking ``query_block / 4`` queries with the vectors they ask for.
    Tasks come from blocks of queries, which copy codes, rather than from blocks of rows, each of which finds ``k`` rows a query or more.
    A scan thins what it holds when that is over ``rerank`` rows a query; all rows that the bounds leave are scored exactly, however many.
    """
    spark = table.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _classes(_usable(table), k).select(F.monotonically_increasing_id().alias("row"), "vector", "ids", F.size("vector").alias("dims"))
    rows = shared.written(rows, "ann-rows")
    asked = _usable(queries).dropDuplicates(["vec_id", "vector"]).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dims"))
    asked = shared.written(asked, "ann-queries")
    numbers = lambda m: F.sequence(F.lit(0).cast("int"), F.lit(m - 1).cast("int"))
    none = F.lit(None)
    parts = []
    for size in sorted(r.dims for r in rows.select("dims").distinct().collect()):
        own, query = rows.where(F.col("dims") == size), asked.where(F.col("dims") == size)
        sample = own.orderBy(F.xxhash64("vector")).limit(train_rows).select("vector").toArrow().column(0)
        x = directions(np.array(sample.to_pylist()))[0].astype(np.float32)
        quantiser = spark.sparkContext.broadcast(Quantiser(size, sub_dims, eta).train(x, train_rounds, seed))  # 16 centres a subspace
        n_query, parallel = query.count(), max(1, n // 2)
        first_id = F.element_at("ids", 1)
        n_row, n_first = own.agg(F.count(F.lit(1)), F.countDistinct(first_id)).first()
        row_blocks, query_blocks = blocks_of(n_row, row_block), blocks_of(n_query, query_block, parallel)
        code = own.select("row", "vector").mapInArrow(_encoder(quantiser), "row long, code binary")
        if n_first < n_row:  # some vec_ids have several vectors: only one of them counts towards the k that are surely better
            firsts = own.groupBy(first_id.alias("first")).agg(F.min("row").alias("row")).select("row", F.lit(True).alias("counts"))
            code = code.join(firsts, "row", "left")
        else:
            code = code.withColumn("counts", F.lit(True))
        left = code.select(F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int").alias("rb"), F.explode(numbers(query_blocks)).alias("qb"), F.col("row").alias("id"), "code", F.coalesce("counts", F.lit(False)).alias("counts"), none.cast("array<double>").alias("vector"))
        right = query.select(F.explode(numbers(row_blocks)).alias("rb"), F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("qb"), F.col("query").alias("id"), none.cast("binary").alias("code"), F.lit(False).alias("counts"), "vector")
        cells = left.unionByName(right).repartition(min(4 * n, row_blocks * query_blocks), "rb", "qb").sortWithinPartitions("rb", "qb", "id")
        near = cells.mapInArrow(_grouped(2, lambda t, q=quantiser: scan_cell(t, q.value, k + 1, rerank)), "query long, row long, low double, high double, counts boolean")
        if row_blocks > 1:
            best = Window.partitionBy("query").orderBy(F.desc("counts"), F.desc("low"))
            near = near.withColumn("place", F.row_number().over(best))
            sure = F.max(F.when(F.col("counts") & (F.col("place") == k + 1), F.col("low"))).over(Window.partitionBy("query"))
            near = near.withColumn("sure", sure).where(F.col("sure").isNull() | (F.col("high") >= F.col("sure")))
        near = near.select("query", "row")
        groups = blocks_of(n_query, max(1, query_block // 4), parallel)
        near = shared.written(near.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")), "ann-near")
        wanted = near.groupBy("group", "row").agg(F.lit(1).alias("one")).join(own, "row").select("group", "row", "vector", "ids", none.cast("long").alias("query"), none.cast("long").alias("query_id"), none.cast("array<long>").alias("near"))
        lists = near.groupBy("query").agg(F.sort_array(F.collect_list("row")).alias("near"))
        asking = query.join(lists, "query").select(F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("group"), none.cast("long").alias("row"), "vector", none.cast("array<long>").alias("ids"), "query", "query_id", "near")
        meeting = wanted.unionByName(asking).repartition(min(4 * n, groups), "group").sortWithinPartitions("group", "row", "query")
        parts.append(meeting.mapInArrow(_grouped(1, lambda t, k=k: rerank_group(t, k)), "query_id long, rank int, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if len(parts) == 1 and not asked.groupBy("query_id").count().where("count > 1").limit(1).count():
        return found
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a query_id with several vectors
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """rows x dims of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _encoder(quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column("vector"))
            codes = np.concatenate([quantiser.value.encoded(x[i : i + 2048]) for i in range(0, len(x), 2048)])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([c.tobytes() for c in codes], pa.binary())], ["row", "code"])

    return shared.releasing(run)


def _grouped(keys: int, of):
    """For mapInArrow: ``of`` applied to the table of each run of rows that are equal in the first ``keys`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(keys)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if now is not None and tuple(key[i]) != now:
                    yield from of(pa.Table.from_batches(held))
                    held = []
                now = tuple(key[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from of(pa.Table.from_batches(held))

    return shared.releasing(run)


#: Scores that a scan holds at once.
SCAN_SCORES = 4_000_000


def scan_cell(t: pa.Table, quantiser: Quantiser, most: int, rerank: int, group: int = 128) -> Iterator[pa.RecordBatch]:
    """(query, row, bounds of the score, whether it counts): per query of the cell the rows that fewer than ``most`` rows that count surely exceed.

    Scores are of queries of length one.
    """
    is_query = np.asarray(t.column("vector").is_valid())
    rows, queries = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
    if not rows.num_rows or not queries.num_rows:
        return
    kept = np.frombuffer(b"".join(rows.column("code").to_pylist()), quantiser.layout())
    row_ids, query_ids, counts = rows.column("id").to_numpy(), queries.column("id").to_numpy(), np.asarray(rows.column("counts"))
    q, step = directions(_vectors(queries.column("vector")))[0].astype(np.float32), max(1, SCAN_SCORES // group)
    rounding = (quantiser.dims + 16) * 2.0**-23  # of sums of products in single precision
    whole = kept["norm"].max()
    norm, off = (kept["norm"] / whole).astype(np.float32), (kept["left"] + rounding).astype(np.float32)
    sure = np.full(len(q), -np.inf, np.float32)  # the ``most``-th best lower bound so far
    held: list[list] = [[] for _ in range(-(-len(q) // group))]

    def thinned(parts: list, first: int) -> list:
        who, row, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = np.flatnonzero(counts[row])
        own = own[np.lexsort((-low[own], who[own]))]
        start = np.searchsorted(who[own], np.arange(group + 1))
        for i in np.flatnonzero(np.diff(start) >= most).tolist():
            sure[first + i] = max(sure[first + i], low[own[start[i] + most - 1]])
        keep = high >= sure[first + who]
        return [(who[keep], row[keep], low[keep], high[keep])]

    for at in range(0, len(kept), step):  # blocks of rows: what a scan holds does not grow with the cell
        here = slice(at, at + step)
        x, counted = quantiser.restored(kept[here]), np.flatnonzero(counts[here])
        for g, parts in enumerate(held):
            first = g * group
            score = x @ q[first : first + group].T
            low, high = (score - off[here, None]) * norm[here, None], (score + off[here, None]) * norm[here, None]
            if len(counted) >= most:
                best = np.partition(low if len(counted) == len(low) else low[counted], len(counted) - most, axis=0)[len(counted) - most]
                sure[first : first + group] = np.maximum(sure[first : first + group], best)
            row, who = np.nonzero(high >= sure[first : first + group])
            parts.append((who, at + row, low[row, who], high[row, who]))
            if sum(len(p[0]) for p in parts) > rerank * group:
                parts[:] = thinned(parts, first)
    for g, parts in enumerate(held):
        ((who, row, low, high),) = thinned(parts, g * group)
        columns = [query_ids[g * group + who], row_ids[row], low.astype(float) * whole, high.astype(float) * whole, counts[row]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "row", "low", "high", "counts"])


def rerank_group(t: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The exact ranking of a block's queries among the rows they ask for."""
    is_query = np.asarray(t.column("query").is_valid())
    rows, queries = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
    if not rows.num_rows or not queries.num_rows:
        return
    x, q = _vectors(rows.column("vector")), _vectors(queries.column("vector"))
    row_ids, ids = rows.column("row").to_numpy(), rows.column("ids").to_pylist()
    out: list[list] = [[], [], [], []]
    for vector, name, near in zip(q, queries.column("query_id").to_pylist(), queries.column("near").to_pylist(), strict=True):
        chosen = np.searchsorted(row_ids, near)
        exact = (x[chosen] * vector).sum(axis=1)
        found, last = {}, None  # a vec_id with several vectors counts with its best
        for o in np.argsort(-exact, kind="stable").tolist():
            if len(found) >= k and exact[o] != last:
                break
            last = exact[o]
            for v in ids[chosen[o]]:
                if v != name:
                    found.setdefault(v, float(last))
        best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
        out[0] += [name] * len(best)
        out[1] += range(1, len(best) + 1)
        out[2] += [v for v, _ in best]
        out[3] += [score for _, score in best]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])
