"""Transitions split by upstream context: what follows a k-mer may depend on the bases before it.

A context of ``d`` bases and its k-mer are one (k + d)-mer, so contexts are counted
like k-mers; parameters are estimated per (k-mer, context) and contexts that lead
to the same bases are merged again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import bits
from helixframe.operators import mstep, packed, spectrum

#: Fixed value: contexts kept per k-mer at most.
MOST_CONTEXTS = 127


def context_counts(reads: DataFrame, k: int, d: int) -> DataFrame:
    """kid, ctx (packed bases before it), base, n over the reads' forward strand; k + d must not exceed 31."""
    return packed.transitions_of(reads, k + d).select(F.shiftrightunsigned("kid", 2 * d).alias("kid"), F.col("kid").bitwiseAND(F.lit((1 << (2 * d)) - 1)).alias("ctx"), "base", "n")


def upstream_contexts(counts: DataFrame, node_table: DataFrame, rho: float) -> DataFrame:
    """kid, ctx, n of k-mers with several transitions: per k-mer the most frequent contexts, at most
    min(127, half its coverage / rho) and one at least; ties go to the smaller context."""
    branching = node_table.where("n_trans > 1").select("kid", "total")
    seen = counts.join(branching, "kid").groupBy("kid", "ctx").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    order = Window.partitionBy("kid").orderBy(F.desc("n"), "ctx")  # at most 4**d rows
    limit = F.greatest(F.least(F.lit(MOST_CONTEXTS), F.floor(F.col("total") / 2 / rho)), F.lit(1))
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("kid", "ctx", "n")


def context_transitions(counts: DataFrame, contexts: DataFrame, rho: float, gamma: float, d: int) -> DataFrame:
    """kid, ctx, base, p: penalised transitions per kept context; all others of a k-mer share the context -1."""
    known = counts.join(contexts.select("kid", "ctx", F.lit(True).alias("kept")), ["kid", "ctx"], "left")
    every = known.join(contexts.select("kid").distinct(), "kid", "left_semi").groupBy("kid", F.when(F.col("kept"), F.col("ctx")).otherwise(F.lit(-1).cast("long")).alias("ctx"), "base").agg(F.sum("n").cast("double").alias("xi"))
    p = mstep.penalised_transitions(every.select(F.struct("kid", "ctx").alias("kid"), "base", "xi"), rho, gamma)
    return p.select("kid.kid", "kid.ctx", "base", "p")


def counted_context_transitions(reads: DataFrame, k: int, d: int, rho: float, gamma: float) -> DataFrame:
    """``context_transitions`` of the contexts that ``upstream_contexts`` keeps, from one shuffle: kid, ctx, base, p.

    A bucket of pieces with ``d`` bases before them has all sightings of its k-mers on both strands and in all contexts. d is 2 to 7, gamma at most 1e-6.
    """
    low = np.uint64(2 * d + 2)

    def counts(tally: packed.ContextTally) -> list[np.ndarray]:
        kid, total = tally.branching(spectrum.COUNT_MAX)
        inside = np.isin((tally.key >> low).view(np.int64), kid)
        key, n = tally.key[inside], tally.n[inside]
        pair, seen = packed._summed(key >> np.uint64(2), n[None])  # (k-mer, context)
        own = np.searchsorted(kid, (pair >> np.uint64(2 * d)).view(np.int64))
        order = np.lexsort((pair, -seen[0], own))
        first = np.flatnonzero(np.diff(own, prepend=-1))
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        limit = np.maximum(np.minimum(MOST_CONTEXTS, np.floor(total / 2 / rho)), 1)
        kept = rank < limit[own]
        at = np.searchsorted(pair, key >> np.uint64(2))
        context = np.where(kept[at], key >> np.uint64(2) & np.uint64((1 << 2 * d) - 1), 1 << 2 * d)  # the last one: all others
        group = (own[at].astype(np.uint64) << np.uint64(2 * d + 1) | context.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
        xi = np.zeros((4, len(at)), np.int64)
        xi[(key & np.uint64(3)).astype(np.int64), np.arange(len(at))] = n
        group, xi = packed._summed(group, xi)
        context = (group & np.uint64((1 << 2 * d + 1) - 1)).astype(np.int64)
        return [kid[(group >> np.uint64(2 * d + 1)).astype(np.int64)], np.where(context == 1 << 2 * d, -1, context), *xi]

    rows = packed.context_tallies(reads, k, d, counts, "kid long, ctx long, x0 long, x1 long, x2 long, x3 long")
    own = F.array(*[F.struct(F.lit(b).alias("base"), F.col(f"x{b}").cast("double").alias("xi")) for b in range(4)])
    p = mstep.penalised_rows(rows.select(F.struct("kid", "ctx").alias("kid"), F.filter(own, lambda x: x["xi"] > 0).alias("t")), rho, gamma)
    return p.select("kid.kid", "kid.ctx", "base", "p")


def merged_contexts(p: DataFrame) -> DataFrame:
    """kid, bases (the transitions that stay, as a flag), contexts: contexts of a k-mer with equal transitions are one."""
    flag = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("base")))
    return p.groupBy("kid", "ctx").agg(flag.alias("bases")).groupBy("kid", "bases").agg(F.sort_array(F.collect_list("ctx")).alias("contexts"))


def split_share(p: DataFrame) -> DataFrame:
    """One row: k-mers with contexts, and those whose contexts differ in their transitions."""
    g = merged_contexts(p).groupBy("kid").agg(F.count(F.lit(1)).alias("m"))
    return g.agg(F.count(F.lit(1)).alias("n_kmers"), F.coalesce(F.sum((F.col("m") > 1).cast("long")), F.lit(0)).alias("n_split"))


def extension_probability(p: DataFrame, k: int, levels: int = 5) -> DataFrame:
    """kid, p_ext: the probability that a path from a k-mer goes on for ``levels`` transitions (one join per level)."""
    edges = p.select("kid", bits.successor(F.col("kid"), F.col("base"), k).alias("next"), "p")
    now = edges.groupBy("kid").agg(F.sum("p").alias("p_ext"))
    for _ in range(levels - 1):
        ahead = now.select(F.col("kid").alias("next"), F.col("p_ext").alias("ahead"))
        now = edges.join(ahead, "next", "left").groupBy("kid").agg(F.sum(F.col("p") * F.coalesce("ahead", F.lit(0.0))).alias("p_ext"))
    return now


def counted_extension_probability(reads: DataFrame, k: int) -> DataFrame:
    """``extension_probability`` of three levels from the counted shares, from one shuffle: kid, p_ext. k is 7 to 24.

    A path's three transitions all hold the k-mer's last k - 2 bases, so the bucket of these has every count that they need.
    """
    core = k - 2

    def extend(w: np.ndarray, front: np.ndarray, tail: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, _: np.ndarray) -> list[np.ndarray]:
        bases = front | w << np.uint64(4) | tail << np.uint64(2 * k)

        def counted(at: int, needs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """k + 1 bases from ``at``, and their counts."""
            key = bases[needs] >> np.uint64(2 * at) & np.uint64((1 << 2 * k + 2) - 1)
            key, c = packed._summed(key, n[needs][None])
            return key, np.minimum(c[0], spectrum.COUNT_MAX)

        def shares(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(k-mers, rows of the transitions' k-mers, transitions' shares, next k-mers)."""
            kid, row = np.unique(key & np.uint64((1 << 2 * k) - 1), return_inverse=True)
            return kid, row, c / np.bincount(row, c, len(kid))[row] if len(kid) else np.zeros(0), key >> np.uint64(2)

        goes_on = np.unique(bases[after == 3] >> np.uint64(4) & np.uint64((1 << 2 * k) - 1))
        kid2, row2, p2, next2 = shares(*counted(1, (before >= 1) & (after >= 2)))
        ahead2 = np.bincount(row2, np.where(np.isin(next2, goes_on), p2, 0), len(kid2))
        kid1, row1, p1, next1 = shares(*counted(0, (before == 2) & (after >= 1)))
        at = np.minimum(np.searchsorted(kid2, next1), max(len(kid2) - 1, 0))
        ahead = np.where(kid2[at] == next1, ahead2[at], 0) if len(kid2) else np.zeros(len(next1))
        return [kid1.view(np.int64), np.bincount(row1, p1 * ahead, len(kid1))]

    return packed.surrounding_tallies(reads, core, 2, 3, extend, "kid long, p_ext double", shortest=k + 1)
