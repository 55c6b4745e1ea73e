"""Scalar functions over bases, packed k-mers, qualities and log probabilities.

Bases are A=0, C=1, T=2, G=3; a k-mer packs two bits a base, the first base in
the lowest bits, so k <= 31 fits a BIGINT. Log zero is NULL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of bases in two bits.
BASES = "ACTG"
LOW = 0x5555555555555555


def base_to_bits(c: Column) -> Column:
    """Two bits of a base letter; N shares those of G."""
    return F.shiftright(F.ascii(c), 1).bitwiseAND(F.lit(3))


def complement_bits(b: Column) -> Column:
    return b.bitwiseXOR(F.lit(2))


def effective_base(c: Column) -> Column:
    """The code, or 4 for N."""
    return F.when(F.upper(c) == "N", F.lit(4)).otherwise(base_to_bits(c))


def complement_flag(f: Column) -> Column:
    """A transition flag with the bits of A and T, and of C and G, swapped."""
    return F.shiftright(f, 2).bitwiseOR(F.shiftleft(f.bitwiseAND(F.lit(3)), 2))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def kmer_id(seq: Column) -> Column:
    """The packed id of a short string (row-wise; whole reads go through ``rolling_ids``)."""
    codes = F.transform(F.split(seq, ""), lambda c, i: F.when(c != "", F.call_function("shiftleft", base_to_bits(c).cast("long"), (2 * i).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def kmer_string(kid: Column, k: int) -> Column:
    letter = lambda i: F.substr(F.lit(BASES), F.shiftrightunsigned(kid, 2 * i).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(i) for i in range(k)])


def rc_id(kid: Column, k: int) -> Column:
    """The id of the reverse complement. Every base is moved by itself, so the expression grows with k alone, wherever it is inlined."""
    terms = [F.shiftleft(F.shiftrightunsigned(kid, 2 * j).bitwiseAND(F.lit(3).cast("long")).bitwiseXOR(F.lit(2).cast("long")), 2 * (k - 1 - j)) for j in range(k)]
    while len(terms) > 1:  # a balanced tree
        terms = [a.bitwiseOR(b) for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
    return terms[0]


def successor(kid: Column, base: Column | int, k: int) -> Column:
    b = base if isinstance(base, Column) else F.lit(base)
    return F.shiftrightunsigned(kid, 2).bitwiseOR(F.shiftleft(b.cast("long"), 2 * (k - 1)))


def suffix(kid: Column) -> Column:
    return F.shiftrightunsigned(kid, 2)


def prefix(kid: Column, k: int) -> Column:
    return kid.bitwiseAND(F.lit((1 << (2 * (k - 1))) - 1))


def first_base(kid: Column) -> Column:
    return kid.bitwiseAND(F.lit(3).cast("long")).cast("int")


def last_base(kid: Column, k: int) -> Column:
    return F.shiftrightunsigned(kid, 2 * (k - 1)).cast("int")


def hamming(a: Column, b: Column, n_mask: Column | None = None) -> Column:
    """Differing bases of two ids; positions set in ``n_mask`` (11 per base) always differ."""
    x = a.bitwiseXOR(b)
    if n_mask is not None:
        x = x.bitwiseOR(n_mask)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW).cast("long")))


def mutation_flag(a: Column, b: Column) -> Column:
    """11 at each differing base."""
    x = a.bitwiseXOR(b)
    one = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW).cast("long"))
    return one.bitwiseOR(F.shiftleft(one, 1))


def n_transitions(flag: Column) -> Column:
    return F.bit_count(flag)


def transition_rank(flag: Column, base: Column) -> Column:
    """How many set bits lie below ``base``."""
    return F.bit_count(flag.bitwiseAND(F.call_function("shiftleft", F.lit(1), base) - 1))


def flag_bases(flag: Column) -> Column:
    return F.filter(F.array(*[F.lit(b) for b in range(4)]), lambda b: F.call_function("shiftright", flag, b).bitwiseAND(F.lit(1)) == 1)


def admissible(flag: Column, suffix_hd: Column, dmax: Column | int, observed: Column) -> Column:
    """Transitions a state may take: all of them below the cap, else the observed base's alone (none for N, code 4)."""
    only = flag.bitwiseAND(F.when(observed < 4, F.call_function("shiftleft", F.lit(1), F.least(observed, F.lit(3)))).otherwise(F.lit(0)))
    return F.when(suffix_hd >= dmax, only).otherwise(flag)


def phred_correct(q: Column) -> Column:
    """Probability that a base of quality ``q`` is right."""
    return 1 - F.pow(F.lit(10.0), -q / 10)


def phred_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def qualities(qual: Column, offset: Column | int) -> Column:
    o = offset if isinstance(offset, Column) else F.lit(offset)
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - o)


def safe_log(x: Column) -> Column:
    """ln, with NULL for zero and below."""
    return F.when(x > 0, F.ln(x))


def safe_exp(x: Column) -> Column:
    return F.coalesce(F.exp(x), F.lit(0.0))


def log_product(*x: Column) -> Column:
    """Product in logs: NULL (log zero) absorbs."""
    out = x[0]
    for y in x[1:]:
        out = out + y
    return out


def log_add(a: Column, b: Column) -> Column:
    """Sum in logs: NULL (log zero) is neutral."""
    top = F.greatest(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(top + F.log1p(F.exp(F.least(a, b) - top)))


def log_sum(values: Column) -> Column:
    """Sum in logs of an array."""
    known = F.filter(values, lambda x: x.isNotNull())
    top = F.array_max(known)
    return top + F.ln(F.aggregate(known, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def normalized_emission(log_p: Column, flag: Column, observed: Column) -> Column:
    """Log emission of ``observed`` renormalised over the admissible bases of ``flag`` and N (the fifth of the log probabilities)."""
    admissible = F.filter(F.transform(log_p, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: (e["i"] == 4) | (F.call_function("shiftright", flag, e["i"].cast("int")).bitwiseAND(F.lit(1)) == 1))
    return F.get(log_p, observed) - F.when(flag == 15, F.lit(0.0)).otherwise(log_sum(F.transform(admissible, lambda e: e["x"])))


def renormalized(log_p: Column) -> Column:
    """Log probabilities shifted so that their sum is one."""
    whole = log_sum(log_p)
    return F.transform(log_p, lambda x: x - whole)


def descending_order(values: Column) -> Column:
    """The places (from 0) of an array's values, the largest first; ties in their order."""
    tagged = F.transform(values, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda e: e["i"])


def emission_context(last: Column, distance: Column | None = None) -> Column:
    """The emission context of a state: its last base, or with its Hamming distance 4 * (highest bit of the distance, from 1) + the base."""
    if distance is None:
        return last
    return 4 * F.when(distance > 0, F.floor(F.log2(distance.cast("double"))).cast("int") + 1).otherwise(F.lit(0)) + last


def quality_context(last: Column, observed: Column, n_lowest: Column | None = None, buckets: int = 4) -> Column:
    """Whether the bases match; with the number of qualities 2 in a window, 2 * (its bucket, the last one open) + that."""
    match = (last == observed).cast("int")
    return match if n_lowest is None else 2 * F.least(n_lowest, F.lit(buckets - 1)) + match


def packed_read(seq: Column) -> Column:
    """A whole read as an array of longs, two bits a base, 31 bases each."""
    return F.transform(F.sequence(F.lit(0), F.greatest((F.length(seq) - 1) / 31, F.lit(0)).cast("int")), lambda i: kmer_id(F.substr(seq, 31 * i + 1, F.lit(31))))


def binomial(n: int, d: int) -> int:
    return math.comb(n, d)


def error_masks(k: int, d: int) -> list[int]:
    """All masks of ``k`` bases with ``d`` of them set (11 a base)."""
    from itertools import combinations

    return [sum(3 << (2 * i) for i in c) for c in combinations(range(k), d)]


def error_patterns(d: int) -> list[tuple[int, ...]]:
    """All base patterns of ``d`` places."""
    from itertools import product

    return list(product(range(4), repeat=d))


# The same over numpy, for kernels.
CODE = np.full(256, 3, np.int64)
for _i, _c in enumerate(BASES):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i
IS_N = np.zeros(256, bool)
IS_N[[ord("N"), ord("n")]] = True


def rolling_ids(codes: np.ndarray, k: int) -> np.ndarray:
    """Packed ids of all k-mers of a code array (any leading shape, last axis the places)."""
    n = codes.shape[-1] - k + 1
    out = np.zeros((*codes.shape[:-1], max(n, 0)), np.int64)
    for j in range(k):
        out |= codes[..., j : j + n] << (2 * j)
    return out


def rc_ids(kid: np.ndarray, k: int) -> np.ndarray:
    x = kid.view(np.uint64) ^ np.uint64(0xAAAAAAAAAAAAAAAA)
    for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = ((x >> np.uint64(width)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(width))
    return (x >> np.uint64(64 - 2 * k)).view(np.int64)


def hamming_ids(a: np.ndarray, b: np.ndarray, n_mask: np.ndarray | int = 0) -> np.ndarray:
    x = (a ^ b) | n_mask
    return np.bitwise_count((x | (x >> 1)) & LOW).astype(np.int64)
