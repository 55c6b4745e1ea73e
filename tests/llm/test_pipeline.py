"""The pipeline's stages on the small tables, each against what its operator finds."""

import re
import zlib

import pytest
import regex

import corpus_pipeline
from helixframe.llm import packing, pii, simhash, substring
from tests.llm import test_operators as ops

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(stages):
    first = stages[0][0].columns
    assert all(after.columns == first for _, after in stages[:-1])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_each_stage_takes_effect(stages):
    (raw, good), (_, single), (before, cut), (_, clean), (_, packed) = stages
    assert 0 < good.count() < raw.count()
    found = simhash.similar_groups(good).where("doc_id = component_id").select("doc_id").distinct().count()
    assert single.count() == found
    assert cut.count() == before.count() and substring.duplicate_passages(cut).where("doc_id <> source_doc_id").count() <= 0.05 * cut.count()
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text or "") for r in clean.collect())
    assert pii.detect(clean).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert packed.select("doc_id").distinct().count() == clean.count()


def rows_of(df):
    return sorted(df.collect(), key=lambda r: r.doc_id)


def test_stages_equal_brute_force(stages):
    """Every stage against a plain computation over all its documents."""
    (raw, good), (_, single), (_, cut), (_, clean), (_, packed) = stages
    docs = rows_of(raw)
    kept = ops.brute_verdicts([(r.lang, r.source, r.text) for r in docs])
    assert [r.doc_id for r in rows_of(good)] == [r.doc_id for r, k in zip(docs, kept, strict=True) if k]

    docs = rows_of(good)
    prints, group = [simhash.wide_fingerprint(r.text or "", 5) for r in docs], list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            near = (a[0] ^ prints[j][0]).bit_count()
            if near <= 10 and near + (a[1] ^ prints[j][1]).bit_count() <= 20:
                group[max(root(i), root(j))] = min(root(i), root(j))
    assert [r.doc_id for r in rows_of(single)] == [r.doc_id for i, r in enumerate(docs) if root(i) == i]

    docs, after = rows_of(single), {r.doc_id: r.text for r in rows_of(cut)}
    want, removed, wanted, over = ops.brute_passages([(r.doc_id, r.text) for r in docs]), 0, 0, 0
    for r in docs:
        words = ops.WORD.findall(r.text or "")
        left = ops.WORD.findall(after[r.doc_id] or "")
        gone = len(words) - len(left)
        wanted, removed, over = wanted + len(want[r.doc_id]), removed + min(gone, len(want[r.doc_id])), over + max(0, gone - len(want[r.doc_id]))
    assert removed >= 0.9 * wanted and over <= 0.02 * sum(len(ops.WORD.findall(r.text or "")) for r in docs)  # repeats within a text are cut too

    docs, after = rows_of(cut), {r.doc_id: r.text for r in rows_of(clean)}
    telling = {t for (_, t), v in ops.brute_terms([(r.doc_id, r.text) for r in docs]).items() if v[4]}
    for r in docs:
        base = ops.brute_pii(r.text)
        terms = [(m.start(), 4, m.end()) for m in regex.finditer(r"\p{L}{4,}+", r.text or "") if m[0].lower() in telling]
        spans, out, at = sorted(base + [t for t in terms if not any(a <= t[0] and t[2] <= e for a, _, e in base)]), "", 0
        for a, k, e in spans:
            if a >= at:
                out += r.text[at:a] + pii.GENERAL[pii.KINDS[k]]
            at = max(at, e)
        assert after[r.doc_id] == out + (r.text or "")[at:]

    docs = rows_of(clean)
    ids = ops.library_ids("word_bpe_49k.json", [r.text or "" for r in docs])
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r, own in zip(docs, ids, strict=True):
        own, at = [*own, 1], 0
        for start, length, crc in sorted(pieces[r.doc_id]):
            assert start == at and crc == zlib.crc32(ops.raw(own[start : start + length]))
            at += length
        assert at == len(own)


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.doc_tokens) for r in got.where("start = 0").collect()) == sorted((r.doc_id, r.doc_tokens) for r in stages[-1][1].where("start = 0").collect())


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, _tag string, text string, lang string, source string, n_chars long, _doc string, _cuts int, _bit int, `a.b` int, kept boolean"
    more = ("t", 1, 2, 3, True)
    rows = [(1, "a", None, None, None, None, *more), (None, "b", "", "en", "s", 0, *more), (2, "c", "word " * 5000, "en", "s", 25000, *more), (3, "d", "x", "en", None, 1, *more), (3, "d", "x", "en", None, 1, *more)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SF)
            if name not in ("quality_rules", "packing"):
                assert {(r["_tag"], r["_bit"], r["a.b"], r.kept) for r in out.collect()} <= {(x[1], 2, 3, True) for x in data}
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= (len(data) if name in ("passages", "personal_data", "packing") else 0)


def test_packing_is_the_last_stage(stages):
    assert set(stages[-1][1].columns) >= set(packing.SCHEMA.replace(" long", "").replace(" binary", "").split(", ")) - {"ids"}
