"""Fitting, correction and the registered queries on a small synthetic genome."""

import pickle

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helixframe.config import EngineConfig
from helixframe.functions import emitexpr
from helixframe.operators import context, em, oracle, spectrum, split
from helixframe.plans import catalog

CONFIG = EngineConfig(k=11, max_iterations=3)
SLOW = {"em_fit", "correct_reads", "correction_gain", "read_loglik", "split_corrections", "oracle_em", "auto_k", "stream_kmer_count"}


@pytest.fixture(scope="module")
def reads(spark):
    rng = np.random.default_rng(5)
    genome = "".join(rng.choice(list("ACGT"), 400))
    rows = []
    for i in range(600):
        at = int(rng.integers(0, 360))
        true = genome[at : at + 40]
        if i % 2:
            true = true[::-1].translate(str.maketrans("ACGT", "TGCA"))
        seq, qual, pos = true, "I" * 40, None
        if i % 3 == 0:
            pos = int(rng.integers(0, 40))
            seq = true[:pos] + {"A": "C", "C": "G", "G": "T", "T": "A"}[true[pos]] + true[pos + 1 :]
            qual = "I" * pos + "#" + "I" * (39 - pos)
        rows.append((i, f"r{i}", seq, qual, true, pos if pos is not None else 99))
    return spark.createDataFrame(rows, "read_id long, identifier string, seq string, qual string, truth_seq string, ep int").cache()


def test_fit_and_correct(spark, reads):
    f = em.fit(reads, CONFIG)
    assert f.loglik == sorted(f.loglik)
    p = f.edges().groupBy("kid").agg(F.sum(F.exp("lp")).alias("whole"))
    assert p.where("abs(whole - 1) > 1e-9").count() == 0
    done = em.decode(reads, f, CONFIG)
    assert done.where("length(seq) <> 40 or length(qual) <> 40").count() == 0
    g = em.gain(reads, done, reads.select("read_id", "truth_seq")).first()
    assert g.gain > 0.85 and g.precision > 0.99
    assert em.decode(reads.where("false"), f, CONFIG).count() == 0


def test_save_load_and_inspect(spark, reads, tmp_path):
    f = em.start(reads, CONFIG)
    em.save(f, f"file://{tmp_path}/model")
    g = em.load(spark, f"file://{tmp_path}/model")
    few = reads.limit(20)
    a, b = ({r.read_id: r.loglik for r in em.read_scores(few, x, CONFIG).collect()} for x in (f, g))
    assert a == b and any(v is not None for v in a.values())
    s = em.trellis_states(few, g, CONFIG).where("t = 3").groupBy("read_id").agg(F.sum("posterior").alias("p"))
    assert all(r.p == pytest.approx(1) for r in s.collect())
    thin = {r.read_id: r.n_states for r in em.read_scores(few, g, CONFIG.with_(thin_nats=1.0)).collect()}
    wide = {r.read_id: r.n_states for r in em.read_scores(few, g, CONFIG).collect()}
    assert all(thin[i] <= wide[i] for i in wide)


def test_oracles(spark, reads):
    truth = reads.where("ep < 40").select("identifier", (F.col("ep") + 1).alias("pos"), F.substr("truth_seq", F.col("ep") + 1, F.lit(1)).alias("base"))
    fixed = oracle.apply_truth(reads, truth)
    assert fixed.where("seq <> truth_seq").count() == 0
    done = oracle.perfect_oracle(reads, truth, CONFIG)
    assert done.count() == 600
    assert em.gain(reads, done, reads.select("read_id", "truth_seq")).first().precision > 0.99


def test_variants(spark, reads):
    some = reads.limit(120)
    for emission in ("phred", "primitive"):
        f = em.fit(some, CONFIG.with_(emission=emission, max_iterations=2))
        assert len(f.loglik) == 2 and all(np.isfinite(f.loglik))
    f = em.start(some, CONFIG.with_(use_init_prob=True, penalized_em=False))
    fixed = em.read_scores(some, f, CONFIG.with_(adaptive=False, max_hamming=2)).agg(F.max("n_states")).first()[0]
    assert 0 < fixed <= em.read_scores(some, f, CONFIG).agg(F.max("n_states")).first()[0]


def test_models_in_pages_give_the_same(spark, reads):
    """With no room to ship a model whole, fitting, decoding and scoring agree with the shipped one."""
    some = reads.where("read_id < 200")
    small = CONFIG.with_(broadcast_bytes=0, cache_bytes=20_000, max_iterations=2)
    whole = CONFIG.with_(max_iterations=2)
    a, b = em.start(some, whole), em.start(some, small)
    assert isinstance(em.model_of(b, small), em.paged.PagedModel) and isinstance(em.model_of(a, whole), em.kernel.Model)
    f, g = em.fit(some, whole, initial=a), em.fit(some, small, initial=b)
    assert f.loglik == pytest.approx(g.loglik)
    lp = [{r.kid: r for r in x.table.collect()} for x in (f, g)]
    assert set(lp[0]) == set(lp[1])
    for kid, r in lp[0].items():
        for i in range(4):
            x, y = r[f"lp{i}"], lp[1][kid][f"lp{i}"]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-6))
    done = [{r.read_id: r for r in em.decode(some, x, c).collect()} for x, c in ((f, whole), (f, small))]
    assert {i: (r.seq, r.qual, r.zl) for i, r in done[0].items()} == {i: (r.seq, r.qual, r.zl) for i, r in done[1].items()}
    scores = [{r.read_id: (r.loglik, r.n_states, r.n_edges) for r in em.read_scores(some, f, c).collect()} for c in (whole, small)]
    assert scores[0] == {i: (v and pytest.approx(v), s, e) for i, (v, s, e) in scores[1].items()}
    assert em.decode(some.where("false"), f, small).count() == 0


def test_pages_hold_every_kmer(spark):
    from helixframe.operators import paged

    rng = np.random.default_rng(4)
    kid = np.unique(rng.integers(0, 4**11, 5000))
    d = spark.createDataFrame([(int(k), bool(i % 3), -1.0 * i, float(-i), None, None, -2.0 * i) for i, k in enumerate(kid)], "kid long, solid boolean, log_init double, lp0 double, lp1 double, lp2 double, lp3 double")
    m = paged.PagedModel(*paged.write(d.repartition(5), 11, page_rows=64), 11, np.zeros((12, 4, 5)), np.zeros((12, 2, 41)), 2, 33, 10_000)
    ask = np.concatenate([kid, rng.integers(0, 4**11, 2000)])
    row = m.rows(ask)
    there = np.isin(ask, kid)
    assert ((row >= 0) == there).all() and (m.kids(row[there]) == ask[there]).all() and m.size == len(kid)
    i = np.searchsorted(kid, ask[there])
    assert (m.logps(row[there])[:, 3] == -2.0 * i).all() and (m.logps(row[there])[:, 1] == -np.inf).all()
    assert (m.solids(row[there]) == (i % 3 > 0)).all() and (m.inits(row[there]) == -1.0 * i).all()
    assert (m.usable(row) == np.where(there, np.isin(ask, kid[np.arange(len(kid)) % 3 > 0]), False)).all()


def test_mapped_models_hold_every_kmer(spark, reads, monkeypatch):
    """A whole model comes to workers as the place of its files, with every row and transition of the one in memory; an empty one too."""
    f = em.counted(reads, CONFIG)
    m = em.model_of(f, CONFIG)
    sent = pickle.dumps(m)
    assert len(sent) < m.base.nbytes + m.qual.nbytes + 4096 and m.bytes() > 4 * len(sent) > 0
    n = pickle.loads(sent)
    monkeypatch.setattr(em.mapped, "possible", lambda _: False)
    held = em.model_of(f, CONFIG)
    assert type(held) is em.kernel.Model and type(n) is em.mapped.MappedModel
    for x in ("kid", "logp", "log_init", "solid"):
        assert np.array_equal(getattr(n, x), getattr(held, x)), x
    row, base = np.divmod(np.arange(4 * n.size), 4)
    after = n.kid[row] >> 2 | base << 2 * (CONFIG.k - 1)
    assert np.array_equal(n.rows_after(row, base, after), held.rows(after)) and (n.rows(after) >= 0).any()
    none = em.mapped.MappedModel(*em.mapped.write(f.table.where("false").withColumn("solid", F.lit(True)), CONFIG.k), CONFIG.k, m.base, m.qual, m.window, m.offset)
    assert none.size == 0 and none.rows(after[:5]).tolist() == [-1] * 5


def test_paths_and_reverse_decoding(spark, reads):
    f = em.start(reads, CONFIG)
    few = reads.where("read_id < 60")
    best = em.decode(few, f, CONFIG).where("zl = 0").select("read_id", F.col("seq").alias("target"), "score")
    got = em.path_scores(few.join(best, "read_id"), f, CONFIG).join(best.select("read_id", F.col("score").alias("want")), "read_id").collect()
    assert len(got) > 40 and all(r.score == pytest.approx(r.want) for r in got)
    lost = em.path_scores(few.withColumn("target", F.lit("A" * 40)), f, CONFIG).where("score is not null").count()
    assert lost == 0
    alone, both = (em.decode(reads, f, CONFIG.with_(reverse_decode=x)).agg(F.sum("zl")).first()[0] for x in (False, True))
    assert both <= alone


def test_contexts_decide_after_a_repeat(spark):
    """Both copies of a repeat occur in the genome; what follows depends on the bases before it."""
    rng = np.random.default_rng(8)
    part = lambda n: "".join(rng.choice(list("ACGT"), n))
    repeat = part(7)
    genome = part(60) + "CA" + repeat + "A" + part(60) + "GT" + repeat + "C" + part(60)
    rows = []
    for i in range(0, len(genome) - 30):
        other = genome[i : i + 30][::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows += [(10 * i + j, other if j % 2 else genome[i : i + 30], "I" * 30) for j in range(4)]
    ends = [genome.index("CA" + repeat), genome.index("GT" + repeat)]
    wrong = []
    for n, at in enumerate(ends):  # a read that ends with the base after the repeat, and that base is wrong
        true = genome[at + 2 + 8 - 30 : at + 2 + 8]
        wrong.append((90000 + n, true[:-1] + {"A": "C", "C": "A"}[true[-1]], "I" * 29 + "#", true))
    reads = spark.createDataFrame([(i, f"r{i}", s, q) for i, s, q in rows] + [(i, f"r{i}", s, q) for i, s, q, _ in wrong], "read_id long, identifier string, seq string, qual string")
    c = EngineConfig(k=7)
    fitted = em.start(reads, c)
    for config in (c, c.with_(broadcast_bytes=0)):
        s = split.fit(reads, fitted, config, 2)
        assert len(s.fit.loglik) == split.ITERATIONS and s.fit.loglik[-1] >= s.fit.loglik[0]
        done = {r.read_id: r for r in split.decode(reads, s, config).where("read_id >= 90000").collect()}
        assert [done[i].seq for i, *_ in wrong] == [t for *_, t in wrong]
    counts = context.context_counts(reads, 7, 2)
    graph = {(r.kid, r.ctx) for r in split.graph_contexts(spectrum.nodes(spectrum.count_spectrum(reads, 7)), counts, 7, 2).where("supported").collect()}
    pack = lambda x: sum("ACTG".index(b) << (2 * i) for i, b in enumerate(x))
    assert {(pack(repeat), pack("CA")), (pack(repeat), pack("GT"))} <= graph


def test_context_language(spark):
    d = spark.createDataFrame([([1, 2, 3, 4], [0, 2, 3, 1], [2, 30, 40, 2])], "x array<int>, s array<int>, y array<int>")
    names = {"x": "x", "s": "s", "y": "y"}

    def value(text):
        return d.select(emitexpr.compile_context(text, names, k=2, length=4).alias("c")).first().c

    assert value("count x = s") == 2
    assert value("any y[0..3] > 30, all y[1..2] >= 30") == 3
    assert value("count y[0..3] = 2, x[k] = s[k]") == 2 * 2 + 1
    assert value("x[0] + 1 - 1 = s[0] + 1") == 1
    assert emitexpr.radix("count x = s, any y < 3", names, length=4) == 10
    for bad in ("x[", "x[3..1] = 2", "z = 1", "x ~ 1", "x[0..1] = s[0..2]"):
        with pytest.raises(emitexpr.ExpressionError):
            value(bad)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_queries_match_sql(spark, tables, name, tmp_path):
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    got.write.parquet(str(tmp_path / "q"))
    tables.sql(f"create or replace temp table g as select * from '{tmp_path}/q/*.parquet'")
    tables.sql(f"create or replace temp table o as {catalog.ORACLE_SQL[name]}")
    cols = ", ".join(f'"{c}"' for c in sorted(got.columns))
    assert tables.sql("select count(*) from g").fetchall()[0][0] == tables.sql("select count(*) from o").fetchall()[0][0] > 0
    for a, b in (("g", "o"), ("o", "g")):
        assert tables.sql(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall() == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_scores_of_all_paths_and_of_the_best_come_from_one_trellis(spark, reads):
    c = CONFIG.with_(search_first=False, adaptive=False, max_hamming=1)
    some = reads.limit(200)
    f = em.counted(reads, c)
    both = {x.read_id: (x.loglik, x.best) for x in em.read_scores(some, f, c, best=True).collect()}
    assert {i: x[0] for i, x in both.items()} == {x.read_id: x.loglik for x in em.read_scores(some, f, c).collect()}
    scored = [x for x in both.values() if x[0] is not None]
    assert scored and all(best is not None and best <= ll + 1e-9 for ll, best in scored)
    assert any(best < ll - 1e-6 for ll, best in scored)
