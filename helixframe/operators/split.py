"""The context-split model: transitions of a k-mer with several may depend on the ``d`` bases before it.

A context and its k-mer are one (k + d)-mer, so the split transitions are a model
over those, shipped or read in pages like any other; contexts that were not kept
share a k-mer's remaining transitions. A state's context is what its best path
emitted before it. Fitting takes ``ITERATIONS`` rounds, then reads are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.config import EngineConfig
from helixframe.functions import bits
from helixframe.operators import context, em, kernel, mstep, packed, spectrum
from helixframe.plans.storage import stored

#: Fixed value: rounds of expectation and maximisation.
ITERATIONS = 4


@dataclass
class SplitFit:
    """A fit, and the split transitions p (kid, ctx, base, p) over contexts of d bases; ctx -1: all contexts that were not kept."""

    fit: em.Fit
    p: DataFrame
    d: int


class SplitTrellis(kernel.Trellis):
    """A trellis whose states take the transitions of their contexts. wide: the model over (k + d)-mers; rest: that of the other contexts."""

    def __init__(self, model, wide, rest, d: int, *args):
        super().__init__(model, *args)
        self.wide, self.rest, self.d = wide, rest, d

    def state_logps(self, t: int, layer: kernel.Layer) -> np.ndarray:
        out = self.m.logps(layer.row)
        if layer.ctx is None:  # caps are set without contexts
            return out
        row = self.rest.rows(layer.kid)
        split = np.flatnonzero(row >= 0)
        out[split] = self.rest.logps(row[split])
        if t > self.d:
            row = self.wide.rows(self.key(layer, split))
            out[split[row >= 0]] = self.wide.logps(row[row >= 0])
        return out

    def key(self, layer: kernel.Layer, states: np.ndarray) -> np.ndarray:
        """The (k + d)-mers of states with their contexts."""
        return (layer.kid[states] << (2 * self.d)) | layer.ctx[states]

    def build(self):
        if self._built is None:
            first, caps, _ = super().build()
            self._built = first, caps, self._split_layers(first, caps)
        return self._built

    def _split_layers(self, first: tuple, caps: np.ndarray) -> list[kernel.Layer]:
        layer = self.first_layer(first)
        layer.ctx = np.zeros(len(layer.read), np.int64)
        layers, now = [layer], kernel.Step(layer, self.first_scores(first[0], first[1]))
        for t in range(1, self.steps + 1):
            layer = self.expand(t, layers[-1], self._cap(t, caps))
            now = self.step(t, now, layer, best=True)
            before = layers[-1]
            layer.ctx = (before.ctx[now.back] >> 2) | ((before.kid[now.back] & 3) << (2 * (self.d - 1)))
            layers.append(layer)
        return layers


def graph_contexts(node_table: DataFrame, counts: DataFrame, k: int, d: int) -> DataFrame:
    """kid, ctx, supported: the paths of d bases that lead to k-mers with several transitions, and whether a read shows them.

    One join with the transitions per base, upstream; contexts that no read supports stay, marked.
    """
    edges = node_table.select("kid", F.explode(bits.flag_bases(F.col("flag"))).alias("base"))
    back = edges.select(bits.successor(F.col("kid"), F.col("base"), k).alias("head"), F.col("kid").alias("before"))
    now = node_table.where("n_trans > 1").select("kid", F.col("kid").alias("head"), F.lit(0).cast("long").alias("ctx"))
    for i in range(d):
        # bases are found from the k-mer outwards: the first one found is the last of the context
        now = now.join(back, "head").select("kid", F.col("before").alias("head"), F.col("ctx").bitwiseOR(F.shiftleft(F.col("before").bitwiseAND(F.lit(3).cast("long")), 2 * (d - 1 - i))).alias("ctx")).distinct()
    seen = counts.select("kid", "ctx").distinct().withColumn("supported", F.lit(True))
    return now.select("kid", "ctx").distinct().join(seen, ["kid", "ctx"], "left").select("kid", "ctx", F.coalesce("supported", F.lit(False)).alias("supported"))


def counted_graph_contexts(reads: DataFrame, k: int) -> DataFrame:
    """``graph_contexts`` of two bases from one shuffle: kid, ctx, supported. k is 5 to 23.

    A k-mer, the two before it on a path and its own transitions all hold its first k - 1 bases, so the bucket of these shows, on both strands,
    every edge that is needed.
    """
    core = k - 1

    def walk(w: np.ndarray, front: np.ndarray, tail: np.ndarray, before: np.ndarray, after: np.ndarray, _: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        b2, b1, x, y = front & np.uint64(3), front >> np.uint64(2), tail & np.uint64(3), tail >> np.uint64(2)
        two = np.uint64(2)
        bit = lambda needs, place: np.where(needs, np.uint64(1) << place, np.uint64(0))
        seen = [
            bit(after == 2, x << two | y),  # transitions of the k-mer
            bit((before >= 1) & (after >= 1), b1 << two | x),  # into it
            bit(before == 2, b1 << two | b2),  # into the one before
            bit(own & (before == 2) & (after == 2), b1 << np.uint64(4) | b2 << two | x),
        ]
        at = packed._firsts(w)
        out, into, before_it, shown = (np.bitwise_or.reduceat(z, at) for z in seen)
        w, rows = w[at], []
        has = lambda z, i: z >> np.uint64(i) & np.uint64(1) == 1
        for i in range(4):
            several = np.bitwise_count(out >> np.uint64(4 * i) & np.uint64(15)) > 1
            for j in range(4):
                for h in range(4):
                    here = several & has(into, j << 2 | i) & has(before_it, j << 2 | h)
                    kid = (w[here] | np.uint64(i << 2 * core)).view(np.int64)
                    rows.append((kid, np.full(len(kid), h | j << 2), has(shown, j << 4 | h << 2 | i)[here]))
        return [np.concatenate(z) for z in zip(*rows, strict=True)]

    return packed.surrounding_tallies(reads, core, 2, 2, walk, "kid long, ctx long, supported boolean", shortest=k + 1, both=True)


def _wide(column: Column, d: int) -> Column:
    return F.shiftleft(column, 2 * d).bitwiseOR(F.col("ctx"))


def _models(split: SplitFit, config: EngineConfig):
    """(model, wide model, model of the other contexts)."""
    f, lps = split.fit, [f"lp{b}" for b in range(4)]
    wide_rows = lambda p: p.groupBy("kid").agg(*[F.max(F.when(F.col("base") == b, F.ln("p"))).alias(f"lp{b}") for b in range(4)])

    def of(rows: DataFrame, k: int):
        table = rows.select("kid", F.lit(0).alias("label"), F.lit(1).alias("flag"), F.lit(0.0).alias("mass"), F.lit(None).cast("double").alias("log_init"), *lps)
        return em.model_of(em.Fit(stored(table, "split-model"), f.base, f.qual, f.eta, f.offset, f.window, []), config.with_(k=k))

    wide = of(wide_rows(split.p.where("ctx >= 0").select(_wide(F.col("kid"), split.d).alias("kid"), "base", "p")), config.k + split.d)
    # a k-mer all of whose contexts were kept has the model's own transitions for any other
    others = wide_rows(split.p.where("ctx < 0")).withColumn("own", F.lit(True)).select("kid", "own", *[F.col(c).alias(f"o{c}") for c in lps])
    rest = split.p.select("kid").distinct().join(f.table.select("kid", *lps), "kid", "left").join(others, "kid", "left")
    rest = of(rest.select("kid", *[F.when(F.col("own"), F.col(f"o{c}")).otherwise(F.col(c)).alias(c) for c in lps]), config.k)
    return em.model_of(f, config), wide, rest


def _each(b: pa.RecordBatch, models, config: EngineConfig, d: int) -> Iterator[tuple[np.ndarray, SplitTrellis]]:
    model, wide, rest = models
    for rows, t in em.trellises(b, model, config):
        yield rows, SplitTrellis(model, wide, rest, d, config, t.codes, t.is_n, t.raw_q)


def e_step(reads: DataFrame, split: SplitFit, config: EngineConfig) -> DataFrame:
    """Sufficient statistics: kind (split, base, qual, loglik), slot, ctx, obs, value. A split k-mer is the slot, its context the ctx."""
    d = split.d
    shipped = reads.sparkSession.sparkContext.broadcast(_models(split, config))  # each within broadcast_bytes, or the index of its pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in _each(b, shipped.value, config, d):
                steps = t.run(best=False)
                ll, x = t.expected(steps)
                kid, ctx, base, value = [], [], [], []
                for at, s, p, g, _ in t._backward(steps, ll):
                    source = s.layer.source
                    split_ = t.rest.rows(p.layer.kid) >= 0
                    c = np.full(len(p.layer.kid), -1)
                    if at > d:
                        own = np.flatnonzero(split_)
                        c[own] = np.where(t.wide.rows(t.key(p.layer, own)) >= 0, p.layer.ctx[own], -1)
                    keep = split_[source]
                    kid.append(p.layer.kid[source][keep]), ctx.append(c[source][keep]), base.append(s.layer.base[keep]), value.append(g[keep])
                parts = [("split", *(np.concatenate(v) if v else np.zeros(0) for v in (kid, ctx, base, value)))]
                for kind in ("base", "qual"):
                    i, j, o = np.nonzero(x[kind])
                    parts.append((kind, i, j, o, x[kind][i, j, o]))
                zero = np.zeros(1, int)
                parts.append(("loglik", zero, zero, zero, np.array([ll[np.isfinite(ll)].sum()])))
                for kind, slot, c, o, v in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(v), pa.string()), pa.array(slot.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(o.astype(np.int32)), pa.array(v.astype(float))], ["kind", "slot", "ctx", "obs", "value"])

    rows = reads.select("seq", "qual").mapInArrow(run, "kind string, slot long, ctx long, obs int, value double")
    return rows.groupBy("kind", "slot", "ctx", "obs").agg(F.sum("value").alias("value"))


def fit(reads: DataFrame, fitted: em.Fit, config: EngineConfig, d: int, iterations: int = ITERATIONS) -> SplitFit:
    """Split transitions of a fitted model: counted on the reads first, then ``iterations`` rounds of expectation and maximisation."""
    if config.k + d > 31:
        raise ValueError("a k-mer and its context must not exceed 31 bases")
    rho = config.rho(fitted.eta)
    counts = stored(context.context_counts(reads, config.k, d), "context-counts")
    nodes = spectrum.nodes(spectrum.count_spectrum(reads, config.k))
    kept = stored(context.upstream_contexts(counts, nodes, rho), "contexts")
    now = SplitFit(fitted, stored(context.context_transitions(counts, kept, rho, config.gamma, d), "split"), d)
    for _ in range(iterations):
        stats = stored(e_step(reads, now, config), "split-statistics")
        xi = stats.where("kind = 'split'").select(F.struct(F.col("slot").alias("kid"), "ctx").alias("kid"), F.col("obs").alias("base"), F.col("value").alias("xi"))
        p = mstep.penalised_transitions(xi, rho, config.gamma).select("kid.kid", "kid.ctx", "base", "p")
        ll = stats.where("kind = 'loglik'").agg(F.sum("value")).first()[0] or 0.0
        emission = stats.where("kind in ('base', 'qual')").withColumn("ctx", F.col("ctx").cast("int"))
        f = em.m_step(now.fit, emission, None, config, transitions=False)
        f.loglik = [*now.fit.loglik, ll]
        now = SplitFit(f, stored(p, "split"), d)
    return now


def decode(reads: DataFrame, split: SplitFit, config: EngineConfig) -> DataFrame:
    """Corrected reads: read_id, seq, zl (1: the trellis died, the read stays), score."""
    shipped = reads.sparkSession.sparkContext.broadcast(_models(split, config))  # each within broadcast_bytes, or the index of its pages
    letters, d = np.frombuffer(b"ACTGN", np.uint8), split.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = b.column("seq").to_pylist()
            zl, score = np.ones(b.num_rows, np.int32), np.full(b.num_rows, np.nan)
            for rows, t in _each(b, shipped.value, config, d):
                codes, decoded, s = t.decode(t.run(best=True))
                for i in np.flatnonzero(decoded).tolist():
                    seq[rows[i]] = letters[codes[i]].tobytes().decode()
                zl[rows], score[rows] = ~decoded, np.where(decoded, s, np.nan)
            yield pa.RecordBatch.from_arrays([b.column("read_id"), pa.array(seq, pa.string()), pa.array(zl), pa.array(score, mask=np.isnan(score))], ["read_id", "seq", "zl", "score"])

    return reads.select("read_id", "seq", "qual").mapInArrow(run, "read_id long, seq string, zl int, score double")
