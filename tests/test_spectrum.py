from collections import Counter, defaultdict

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import labels, mstep, spectrum
from helixframe.sources import reads as source

K = 4
READS = [
    (0, "r0", "ACGTACGTACGT", "IIIIIIIIIIII"),
    (1, "r1", "ACGTTCGTACGA", "IIII#IIIIIII"),
    (2, "r2", "NCGTACNTACGT", "#IIIII#IIIII"),
    (3, "r3", "TTTTT", "55555"),
    (4, "r4", "ACGT", "IIII"),  # no longer than k: no k-mers
    (5, "r5", "ACG", "III"),
]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def pack(s):
    return sum("ACTG".index(c) << (2 * i) for i, c in enumerate(s))


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(READS, "read_id long, identifier string, seq string, qual string")


def brute(k):
    cnt, flag, status, n = defaultdict(Counter), Counter(), Counter(), Counter()
    for _, _, s, _ in READS:
        m = len(s) - k + 1
        if m < 2:
            continue
        for i in range(m):
            km = s[i : i + k]
            if "N" in km:
                continue
            first, last = i == 0, i == m - 1
            n[km] += 1
            status[km] |= 1 if first else 4 if last else 2
            if i + k < len(s) and s[i + k] != "N":
                cnt[km][s[i + k]] += 1
            r = rc(km)
            status[r] |= 1 if last else 4 if first else 2
            if i and s[i - 1] != "N":
                flag[r] |= 1 << "ACTG".index(rc(s[i - 1]))
    return cnt, flag, status, n


@pytest.mark.parametrize("k", [4, 5])
def test_counts(spark, reads, k):
    cnt, flag, status, n = brute(k)
    got = {r.kid: r for r in spectrum.count_spectrum(reads, k).collect()}
    assert set(got) == {pack(s) for s in status}
    for s in status:
        r = got[pack(s)]
        assert [r[f"cnt{b}"] for b in range(4)] == [cnt[s][c] for c in "ACTG"]
        assert (r.rc_flag, r.status, r.n) == (flag[s], status[s], n[s])


def test_saturation(spark):
    many = spark.range(20_000).select("id", F.lit("ACGTA").alias("seq"))
    r = spectrum.count_spectrum(many, 4).where(F.col("kid") == pack("ACGT")).first()
    assert r.cnt0 == spectrum.COUNT_MAX and r.n == 20_000


def test_pairs_count_palindromes_twice(reads):
    nodes = spectrum.nodes(spectrum.count_spectrum(reads, K))
    total = {r.kid: r.total for r in nodes.collect()}
    for r in spectrum.canonical_pairs(nodes, K).collect():
        s = "".join("ACTG"[r.canon >> 2 * i & 3] for i in range(K))
        assert r.joint == total[pack(s)] + total[pack(rc(s))]
        assert r.single_stranded == (total[pack(s)] == 0 or total[pack(rc(s))] == 0)


def test_threshold():
    assert spectrum.threshold({1: 100, 2: 10, 3: 5}, 1e-20) == (1.0, 52)
    h = {1: 188184, 2: 12503, 3: 934, 4: 471, 5: 475, 6: 480, 20: 2000, 36: 3036, 50: 200}
    assert spectrum.threshold(h, 1e-20)[0] == 2.0
    assert spectrum.threshold({}, 1e-20) == (1.0, 52)


def test_weights(reads):
    want = Counter()
    for _, _, s, q in READS:
        for i in range(len(s) - K):
            if "N" not in s[i : i + K + 1]:
                w = 1.0
                for c in q[i : i + K + 1]:
                    w *= 1 - 10 ** (-(ord(c) - 33) / 10)
                want[pack(s[i : i + K]), "ACTG".index(s[i + K])] += w
    got = {(r.kid, r.base): r.weight for r in spectrum.weighted_transitions(reads, K).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_stats_and_selection(reads):
    assert spectrum.phred_offset(reads) == (33, 40, 12)
    kept = {r.read_id for r in spectrum.select_reads(reads).collect()}
    assert kept == {i for i, _, s, q in READS if sum(map(ord, q)) - 33 * len(q) >= 30 * len(q)}


def test_empty(spark, reads):
    none = reads.where("false")
    assert spectrum.count_spectrum(none, K).count() == 0
    assert spectrum.phred_offset(none) == (33, 40, 0)
    assert spectrum.histogram(spectrum.canonical_pairs(spectrum.nodes(spectrum.count_spectrum(none, K)), K)).count() == 0


def test_reciprocal_edges_come_in_pairs(reads):
    nodes = spectrum.nodes(spectrum.count_spectrum(reads, K))
    edges = {((r.kid, r.base), (r.rkid, r.rbase)) for r in spectrum.reciprocal_edges(nodes, K).collect()}
    have = {a for a, _ in edges}
    assert all(b in have for _, b in edges)


@pytest.mark.parametrize("d", [1, 2])
def test_hamming_neighbours(reads, d):
    nodes = spectrum.nodes(spectrum.count_spectrum(reads, K))
    kids = [r.kid for r in nodes.collect()]
    far = lambda a, b: sum((a >> 2 * i & 3) != (b >> 2 * i & 3) for i in range(K))
    want = {(a, b) for a in kids for b in kids if far(a, b) == d}
    assert {(r.kid, r.other) for r in spectrum.hamming_neighbours(nodes, nodes, K, d).collect()} == want
    if d == 1:
        assert {(r.kid, r.other) for r in spectrum.hamming1_neighbours(nodes, K).collect()} == {(a, b) for a, b in want if a < b}


def label_group(side: list[int], place: list[int], flag: list[int], phantom: list[int], coverage: list[float]) -> tuple[list[int], list[bool]]:
    """Labels and ambiguity of one group.

    side: 0 for suffix w, 1 for its reverse complement; place: the code of the k-mer's first base; flag: its
    transitions. A k-mer u of side 0 meets v of side 1 where u's flag has the base that leads to v's reverse
    complement, which is the complement of v's first base.
    """
    n = len(side)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(n):
            if side[i] == 0 and side[j] == 1 and (flag[i] >> (place[j] ^ 2) & 1 or flag[j] >> (place[i] ^ 2) & 1):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    label, ambiguous = [0] * n, [False] * n
    for r in {root(i) for i in range(n)}:
        own = [i for i in range(n) if root(i) == r]
        u, v = [i for i in own if side[i] == 0], [i for i in own if side[i] == 1]
        many = lambda s: sum(flag[i].bit_count() > 1 for i in s)
        if many(u) != many(v):
            first = many(u) < many(v)
        elif len(u) != len(v):
            first = len(u) > len(v)
        elif len(u) == 1 and phantom[u[0]] != phantom[v[0]]:
            first = phantom[u[0]] < phantom[v[0]]
        else:
            first = sum(coverage[i] for i in u) > sum(coverage[i] for i in v)
        both = many(u) > 0 and many(v) > 0
        for s, value in ((u, int(first)), (v, 1 - int(first))):
            for i in s:
                label[i], ambiguous[i] = value, both
    return label, ambiguous


def test_label_groups_against_plain_search():
    import numpy as np

    rng = np.random.default_rng(1)
    group, members = [], []
    for g in range(400):
        for slot in range(8):
            if rng.random() < 0.5:
                group.append(g)
                members.append((slot // 4, slot % 4, int(rng.integers(0, 16)), int(rng.integers(0, 3)), float(rng.integers(0, 4))))
    tables = [np.zeros((400, 8), kind) for kind in (bool, np.int64, np.int64, float)]
    for g, (side, place, flag, odd, weight) in zip(group, members, strict=True):
        for t, v in zip(tables, (True, flag, odd, weight), strict=True):
            t[g, 4 * side + place] = v
    label, ambiguous = labels.label_groups(*tables)
    for g in range(400):
        own = [i for i, x in enumerate(group) if x == g]
        want = label_group(*[[members[i][j] for i in own] for j in range(5)])
        at = [4 * members[i][0] + members[i][1] for i in own]
        assert (label[g, at].tolist(), ambiguous[g, at].tolist()) == want


@pytest.mark.parametrize("k", [4, 5])
def test_labels_are_opposite_across_edges(spark, reads, k):
    nodes = spectrum.nodes(spectrum.count_spectrum(reads, k))
    got = {r.kid: r for r in labels.labels(nodes, k).collect()}
    flags = {r.kid: r.flag for r in nodes.collect()}
    assert set(got) == set(flags)
    text = lambda x, n: "".join("ACTG"[x >> 2 * i & 3] for i in range(n))
    for kid, flag in flags.items():
        s = text(kid, k)
        if s[1:] == rc(s[1:]):
            assert got[kid].label == 0
            continue
        for b in range(4):
            if flag >> b & 1:
                other = pack(rc(s[1:] + "ACTG"[b]))
                assert got[other].label == 1 - got[kid].label


def test_soft_threshold_drops_and_keeps(spark):
    rho = 52 / 46.051701859880914
    xi = [(1, 0, 0.4), (1, 1, 0.3), (2, 0, 0.5), (2, 1, 0.5), (3, 0, 1.0), (3, 1, 0.2), (3, 2, 0.1), (4, 0, 0.0), (4, 1, 0.0), (5, 0, 40.0), (5, 1, 0.7), (5, 2, 0.2), (6, 0, 40.0), (6, 1, 1.5), (6, 2, 0.0), (7, 3, 0.1)]
    d = spark.createDataFrame(xi, "kid long, base int, xi double")
    got = {}
    for r in mstep.penalised_transitions(d, rho).collect():
        got.setdefault(r.kid, {})[r.base] = r.p
    assert got[1] == {0: 1.0} and got[2] == {0: 0.5, 1: 0.5} and got[3] == {0: 1.0} and got[4] == {0: 0.5, 1: 0.5} and got[7] == {3: 1.0}
    assert got[5][0] == pytest.approx(1.0) and set(got[6]) == {0, 1}
    lam = 40 - rho + 1.5 - rho
    assert got[6][0] == pytest.approx((40 - rho) / lam)
    for x in ([40.0, 1.5], [10.0, 9.0, 3.0]):
        want = mstep.solve_penalised(np.array([x]), rho, 1e-20)[0]
        d = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "kid long, base int, xi double")
        assert {r.base: r.p for r in mstep.penalised_transitions(d, rho).collect()} == {i: pytest.approx(p, abs=1e-9) for i, p in enumerate(want) if p > 1e-12}


@pytest.mark.parametrize("rho,gamma", [(1.0, 0.5), (2.0, 0.1), (1.0, 0.01), (6.0, 0.3), (3.0, 2.0), (12.0, 1e-3)])
def test_solver_for_large_gamma(rho, gamma):
    rows = [[5.0, 2.0, 0.5], [10.0, 4.0, 3.0], [1.0, 0.9, 0.2], [0.5, 0.1, 0.05], [3.0, 3.0, 1.0], [8.0, 0.0, 0.0]]
    got = mstep.solve_penalised(np.array([[*r, np.nan] for r in rows]), rho, gamma)
    grid = [(a, b, 1 - a - b) for a in np.linspace(1e-9, 1, 401) for b in np.linspace(1e-9, 1, 401) if a + b < 1]
    q = np.maximum(np.array(grid), 1e-12)
    for xi, p in zip(rows, got, strict=True):
        f = lambda q, x=np.array(xi): (x * np.log(q)).sum(axis=-1) - rho * np.log1p(q / gamma).sum(axis=-1)
        assert np.isnan(p[3]) and p[:3].sum() == pytest.approx(1)
        if xi[0] != xi[1]:
            assert f(np.maximum(p[:3], 1e-12)) >= f(q).max() - 0.02 * abs(f(q).max())
    one = mstep.solve_penalised(np.array([[np.nan, 3.0, np.nan, np.nan], [0.0, 0.0, np.nan, np.nan]]), rho, gamma)
    assert one[0, 1] == 1 and one[1, :2].tolist() == [0.5, 0.5]


def test_large_gamma_takes_the_solver(spark):
    xi = [(1, 0, 10.0), (1, 1, 4.0), (1, 2, 3.0), (2, 3, 2.0)]
    d = spark.createDataFrame(xi, "kid long, base int, xi double")
    p = {(r.kid, r.base): r.p for r in mstep.penalised_transitions(d, 2.0, 0.1).collect()}
    assert [round(p[1, b], 3) for b in range(3)] == [0.649, 0.208, 0.143] and p[2, 3] == 1


def test_second_penalty_and_penalised_initial(spark):
    p = mstep.reciprocal_penalty([5.0, 2.0, 0.5], [0.2, 0.5, 0.1], 0.4, 0.5)
    f = lambda q: (np.array([5.0, 2.0, 0.5]) * np.log(q)).sum() - 0.8 * np.log1p((q + np.array([0.2, 0.5, 0.1])) / 1.0).sum()
    rng = np.random.default_rng(1)
    assert p.sum() == pytest.approx(1) and all(f(p) >= f(q) - 1e-9 for q in rng.dirichlet(np.ones(3), 5000))
    assert mstep.reciprocal_penalty([0.1, 0.2], [0.0, 0.0], 5.0, 0.01).tolist() == [0, 1]
    mass = spark.createDataFrame([(1, 10.0), (2, 4.0), (3, 0.5), (4, 0.0)], "kid long, mass double")
    got = {r.kid: r.init for r in mstep.penalised_initial(mass, 1.0).collect()}
    assert got == {1: pytest.approx(9 / 12), 2: pytest.approx(3 / 12)}
    assert {r.kid: r.init for r in mstep.penalised_initial(mass.where("kid > 2"), 1.0).collect()} == {3: 1.0}


def test_strand_tail_is_a_constant_quantile(spark):
    import math

    for level in (1e-16, 1e-10, 1e-4, 0.3):
        z = mstep.normal_quantile(level)
        assert math.erfc(-z / math.sqrt(2)) / 2 == pytest.approx(level, rel=1e-6)


def test_initial_distribution(spark):
    k = 4
    mass = [(pack("ACCA"), 4.0, 1), (pack(rc("ACCA")), 2.0, 2), (pack("ACGT"), 3.0, 1), (pack("AAAA"), 0.1, 1), (pack("TTTT"), 0.0, 0)]
    d = spark.createDataFrame(mass, "kid long, mass double, flag int")
    got = {r.kid: r.init for r in mstep.initial_distribution(d, 1.0, 1e-20, k).collect()}
    assert got[pack("ACCA")] == got[pack(rc("ACCA"))] == pytest.approx(3 / 9.1)
    assert got[pack("ACGT")] == pytest.approx(3 / 9.1) and got[pack("AAAA")] == pytest.approx(1e-20 / 9.1)


def test_emission_variants(spark):
    rows = [("base", 0, 0, 0, 90.0), ("base", 0, 0, 1, 10.0), ("base", 0, 1, 4, 0.0), ("qual", 0, 0, 2, 3.0), ("qual", 0, 1, 2, 1.0), ("qual", 0, 1, 40, 9.0)]
    d = spark.createDataFrame(rows, "kind string, slot int, ctx int, obs int, value double")
    p = {(r.kind, r.ctx, r.obs): r.p for r in mstep.emission(d).collect()}
    assert p["base", 0, 0] == 0.9 and p["base", 1, 4] == 0 and p["qual", 1, 40] == 0.9
    q = {(r.kind, r.ctx, r.obs): r.p for r in mstep.phred_emission(d).collect()}
    assert q["base", 0, 1] == 1.0 and q["qual", 0, 2] == 0.75 and q["qual", 1, 40] == 1.0
    assert mstep.error_rate(d) == pytest.approx(0.1)


def test_fastq_round_trip(spark, tmp_path):
    reads = spark.createDataFrame(READS, "read_id long, identifier string, seq string, qual string")
    source.write_fastq(reads.withColumn("zl", F.lit(0)), str(tmp_path / "out"))
    back = source.read_fastq(spark, str(tmp_path / "out"))
    assert sorted((r.identifier, r.seq, r.qual) for r in back.collect()) == sorted((i, s, q) for _, i, s, q in READS)
    f = tmp_path / "one.fastq"
    for end in ("", "\n"):
        f.write_text("@r1 x\nacgtACGT\n+\nIIIIIIII\n@r2\nAAAAA\n+r2\n@@@@@" + end)
        got = sorted(source.read_fastq(spark, str(f)).collect())
        assert [(r.read_id, r.identifier, r.seq, r.qual, r.len) for r in got] == [(0, "r1", "ACGTACGT", "IIIIIIII", 8), (1, "r2", "AAAAA", "@@@@@", 5)]


def test_fastq_across_splits_and_files(spark, tmp_path):
    rng = random.Random(2)
    records = [(f"r{i}", "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 90)))) for i in range(500)]
    text = ["".join(f"@{n} x\n{s}\n+\n{'@' * len(s)}\n" for n, s in part) for part in (records[:300], records[300:])]
    for i, t in enumerate(text):
        (tmp_path / f"{i}.fastq").write_text(t)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "5000b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.read_id, r.identifier, r.seq, r.qual) for r in source.read_fastq(spark, str(tmp_path)).collect())
            assert got == [(i, n, s, "@" * len(s)) for i, (n, s) in enumerate(records)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.fastq").write_text("")
    assert source.read_fastq(spark, str(tmp_path / "none")).count() == 0


def test_output_names():
    from datetime import datetime

    from helixframe.config import EngineConfig

    assert source.output_name("run", EngineConfig(k=15)) == "run_K15D7_EautoG1e-20R1e-04.txt"
    assert source.output_name("run", EngineConfig(k=9, eta=52.4), "_params", "csv", parameters=False, at=datetime(2026, 3, 4, 5, 6)) == "run_0304_0506_params.csv"


def test_truth_file(spark, tmp_path):
    f = tmp_path / "truth.txt"
    f.write_text("# errors\nr1 3 A 7 C\n\nr2 1 G\n")
    want = [("r1", 3, "A"), ("r1", 7, "C"), ("r2", 1, "G")]
    assert sorted(tuple(r) for r in source.read_truth(spark, str(f)).collect()) == want
    source.write_truth(spark.createDataFrame(want, "identifier string, pos int, base string"), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in source.read_truth(spark, str(tmp_path / "t")).collect()) == want


def test_model_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(pack("ACGT"), 1, -0.5, 0.0, None, None, None), (pack("AAAA"), 0, None, None, -0.1, -2.0, None)], "kid long, label int, log_init double, lp0 double, lp1 double, lp2 double, lp3 double")
    source.write_model(m, str(tmp_path / "m"), 4)
    assert sorted(map(str, source.read_model(spark, str(tmp_path / "m")).collect())) == sorted(map(str, m.collect()))


def test_stream_counts(spark, reads, tmp_path):
    from helixframe.plans.storage import stored
    from helixframe.streaming import counting

    d = stored(reads.select("read_id", "seq").repartition(6), "reads")
    got = {r.kid: r.n for r in counting.count_stream(spark, d, K, files_per_batch=2).collect()}
    assert got == {pack(s): n for s, n in brute(K)[3].items() if n}


def test_low_coverage_runs(spark, reads):
    nodes = spectrum.nodes(spectrum.count_spectrum(reads, K))
    coverage = {r.kid: r.coverage for r in nodes.collect()}
    want = set()
    for i, _, s, _ in READS:
        low = [p for p in range(len(s) - K + 1) if len(s) > K and "N" not in s[p : p + K] and coverage[pack(s[p : p + K])] < 3]
        runs = []
        for p in low:
            if runs and runs[-1][1] == p:
                runs[-1][1] += 1
            else:
                runs.append([p, p + 1])
        want |= {(i, a, b - a) for a, b in runs}
    assert {tuple(r) for r in spectrum.low_coverage_runs(reads, nodes, K, 3).collect()} == want


def test_draws_follow_probabilities(spark):
    p = spark.range(4000).select(F.col("id").alias("kid"), F.explode(F.array(F.struct(F.lit(0).alias("base"), F.lit(0.25).alias("p")), F.struct(F.lit(3).alias("base"), F.lit(0.75).alias("p")))).alias("t")).select("kid", "t.*")
    n = spectrum.draw_transitions(p, 1).where("base = 3").count()
    assert 2900 < n < 3100


def test_describe(reads):
    nodes = spectrum.nodes(spectrum.count_spectrum(reads, K))
    assert {r.kmer for r in spectrum.describe_kmer(nodes, "CGTA").collect()} == {"CGTA", "TACG"}
