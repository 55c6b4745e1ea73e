import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import bits


def pack(s):
    return sum("ACTG".index(c) << (2 * i) for i, c in enumerate(s))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@given(st.text("ACGT", min_size=4, max_size=31))
def test_reverse_complement_ids(s):
    k = len(s)
    x = np.array([pack(s)], np.int64)
    assert bits.rc_ids(x, k)[0] == pack(rc(s))
    assert bits.rc_ids(bits.rc_ids(x, k), k)[0] == x[0]


@given(st.text("ACGTN", min_size=12, max_size=40), st.integers(4, 12))
def test_rolling_ids(s, k):
    codes = bits.CODE[np.frombuffer(s.encode(), np.uint8)]
    clean = s.replace("N", "G")  # N shares the bits of G
    assert bits.rolling_ids(codes, k).tolist() == [pack(clean[i : i + k]) for i in range(len(s) - k + 1)]


@given(st.integers(0, 2**30 - 1), st.integers(0, 2**30 - 1))
def test_hamming(a, b):
    d = sum((a >> 2 * i & 3) != (b >> 2 * i & 3) for i in range(15))
    assert bits.hamming_ids(np.array([a]), np.array([b]))[0] == d == bits.hamming_ids(np.array([b]), np.array([a]))[0]


def test_columns(spark):
    words = ["ACTGA", "GGGGG", "ACGTA", "TTTTT"]
    d = spark.createDataFrame([(w, 9, 3) for w in words], "s string, flag int, base int")
    kid = bits.kmer_id(F.col("s"))
    rows = d.select(
        "s", kid.alias("kid"), bits.kmer_string(kid, 5).alias("back"), bits.rc_id(kid, 5).alias("rc"), bits.suffix(kid).alias("suffix"), bits.prefix(kid, 5).alias("prefix"),
        bits.first_base(kid).alias("first"), bits.last_base(kid, 5).alias("last"), bits.successor(kid, 2, 5).alias("next"), bits.complement_flag(F.col("flag")).alias("cf"),
        bits.transition_rank(F.col("flag"), F.col("base")).alias("rank"), bits.flag_bases(F.col("flag")).alias("bases"), bits.hamming(kid, F.lit(pack("ACTGA")), F.lit(0xC0)).alias("hd"),
        bits.mutation_flag(kid, F.lit(pack("ACTGA"))).alias("mut"), bits.admissible(F.col("flag"), F.lit(3), 3, F.lit(0)).alias("adm"), bits.admissible(F.col("flag"), F.lit(3), 3, F.lit(4)).alias("none"),
    ).collect()
    for r in rows:
        assert r.kid == pack(r.s) and r.back == r.s and r.rc == pack(rc(r.s))
        assert r.suffix == pack(r.s[1:]) and r.prefix == pack(r.s[:-1])
        assert (r["first"], r["last"]) == ("ACTG".index(r.s[0]), "ACTG".index(r.s[-1]))
        assert r["next"] == pack(r.s[1:] + "T")
        assert r.cf == 6 and r["rank"] == 1 and r.bases == [0, 3] and r.adm == 1 and r.none == 0
        assert r.hd == sum(x != y or i == 3 for i, (x, y) in enumerate(zip(r.s, "ACTGA", strict=True)))
        assert r.mut == sum(3 << 2 * i for i, (x, y) in enumerate(zip(r.s, "ACTGA", strict=True)) if x != y)
    assert rows[0].kid == 228


def test_logs(spark):
    d = spark.createDataFrame([(-1.0, None), (-1.0, -2.0), (None, None)], "a double, b double")
    got = [r.x for r in d.select(bits.log_add(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == -1.0 and got[1] == pytest.approx(np.logaddexp(-1, -2)) and got[2] is None
    r = spark.range(1).select(bits.log_sum(F.array(F.lit(-1.0), F.lit(None).cast("double"), F.lit(-3.0))).alias("s"), bits.safe_log(F.lit(0.0)).alias("l"), bits.safe_exp(F.lit(None).cast("double")).alias("e"), bits.phred_correct(F.lit(10.0)).alias("p")).first()
    assert r.s == pytest.approx(np.logaddexp(-1, -3)) and r.l is None and r.e == 0.0 and r.p == pytest.approx(0.9)


def test_generators():
    assert len(bits.error_masks(6, 2)) == bits.binomial(6, 2) == 15
    assert len(bits.error_patterns(2)) == 16


def test_messages_are_teed(tmp_path):
    import logging

    from helixframe.config import log_to

    log = log_to(str(tmp_path / "log"))
    try:
        log.info("iteration %d", 3)
        for h in log.handlers:
            h.flush()
        assert (tmp_path / "log").read_text().endswith("INFO iteration 3\n")
    finally:
        log.handlers.clear()
        log.setLevel(logging.NOTSET)


def test_emission_helpers(spark):
    import math

    lp = [math.log(x) for x in (0.9, 0.04, 0.03, 0.02, 0.01)]
    d = spark.createDataFrame([(lp, 3, 2, [3.0, 5.0, 5.0, 1.0])], "lp array<double>, flag int, hd int, v array<double>")
    r = d.select(
        bits.normalized_emission(F.col("lp"), F.col("flag"), F.lit(0)).alias("a"),
        bits.normalized_emission(F.col("lp"), F.lit(15), F.lit(1)).alias("b"),
        bits.renormalized(F.transform("lp", lambda x: x + 1)).alias("c"),
        bits.descending_order(F.col("v")).alias("o"),
        bits.emission_context(F.lit(3), F.col("hd")).alias("e"),
        bits.emission_context(F.lit(3)).alias("f"),
        bits.quality_context(F.lit(1), F.lit(1), F.lit(9)).alias("q"),
        bits.quality_context(F.lit(1), F.lit(2)).alias("p"),
    ).first()
    assert r.a == pytest.approx(math.log(0.9 / (0.9 + 0.04 + 0.01))) and r.b == pytest.approx(lp[1])
    assert r.c == pytest.approx(lp) and r.o == [1, 2, 0, 3] and (r.e, r.f, r.q, r.p) == (11, 3, 7, 0)
