"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import ann, catalog, chat, components, packing, pieces, pii, quality, shared, simhash, spans, substring, textids, token_store, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans int, _key int"


def words(n, rng, vocab=None):
    vocab = vocab or ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(120, rng) for _ in range(12)]
    passage = words(70, rng)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[0]) for i in range(5)]
    edited = base[1].split()
    edited[60] = "changed"
    out += [(200, " ".join(edited)), (201, base[2].upper()), (300, words(60, rng) + " " + passage + " " + words(40, rng)), (301, words(30, rng) + "\n" + passage), (302, passage)]
    out += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one two"), (404, "one two"), (405, "Ünïcode ▁ x  y   end"), (406, words(6000, rng)), (None, base[3]), (None, None)]
    out += [(407, "a@b.co, x@y.z 10.0.0.256 10.0.0.1 4111 1111 1111 1111 and +1 (988) 555-2485\n1.2.3.4.5.6.7.8"), (408, "same line here again\n" * 6), (409, "x#*$%&|<> y " * 20), (410, "<|endoftext|> a <s> </s>")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t), "x", 1, 2) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


# -- 1 ----------------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, tau):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    own = [[ids[j] for j in range(len(fps)) if root(j) == root(i) and ids[j] is not None] for i in range(len(fps))]
    return [min(x, default=None) for x in own]


def test_simhash(docs, texts):
    fps = [brute_fingerprint(t) for _, t in texts]
    comp = brute_components([d for d, _ in texts], fps, 3)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert ordered(got) == ordered((d, f"{f:016x}", c) for (d, _), f, c in zip(texts, fps, comp, strict=True))
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("partitions,block", [(4, 4096), (3, 4096), (2, 4096), (4, 8)])
def test_simhash_links_random_fingerprints(spark, partitions, block):
    rng = random.Random(partitions)
    fps = [rng.getrandbits(64) & 0xFFFF0000FFFFFFFF for _ in range(150)]  # one partition's bits mostly equal
    for _ in range(150):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(classes, partitions=partitions, block=block)).collect()}
    want = brute_components(signed, fps, 3)
    assert all(found.get(s, s) == c for s, c in zip(signed, want, strict=True))


def test_number_of_partitions_follows_the_cost():
    few, many = simhash.partitions_for(100_000, 3, 200.0, 4096), simhash.partitions_for(10**10, 3, 200.0, 4096)
    assert few == 4 and many == 2
    assert simhash.partitions_for(1000, 10, 200.0, 4096) > simhash.partitions_for(10**8, 10, 200.0, 4096)


def similar_pair(rng, n, share):
    """Two texts of which single words differ, of about that Jaccard similarity of five-word shingles, and the similarity."""
    a = [f"{rng.choice('bcdfghk')}{rng.randrange(10**5)}" for _ in range(n)]
    b = list(a)
    while True:
        x, y = ({tuple(t[i : i + 5]) for i in range(n - 4)} for t in (a, b))
        j = len(x & y) / len(x | y)
        if j <= share:
            return " ".join(a), " ".join(b), j
        b[rng.randrange(n)] = f"x{rng.randrange(10**6)}"


def test_rows_of_a_bucket_meet_only_what_they_probe(monkeypatch):
    rng, count, compared = np.random.default_rng(3), np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.append(np.size(x)), count(x))[1])
    fp = rng.integers(0, 1 << 63, 3000).astype("u8")
    fp[1500] = fp[10] ^ np.uint64(7)
    fp[2500] = fp[1500] ^ np.uint64(1 << 40)
    role = np.full(3000, simhash.PROBE, np.int8)
    role[[10, 20, 1500]] = simhash.STORED, simhash.STORED | simhash.PROBE, simhash.STORED | simhash.PROBE
    assert simhash.forest(np.zeros(3000, int), fp, role, 10) == [(1500, 10), (2500, 10)]
    assert sum(compared) < 4 * 3 * 3000  # all pairs before: 4.5 million


def test_forests_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    for n, tau in [(0, 2), (1, 2), (300, 2), (300, 4), (900, 3)]:
        group, fp, fp2 = np.sort(rng.integers(0, 5, n)), rng.integers(0, 1 << 12, n).astype("u8"), rng.integers(0, 1 << 6, n).astype("u8")
        role = rng.choice(np.array([simhash.STORED, simhash.PROBE, simhash.PROBE, simhash.STORED | simhash.PROBE], np.int8), n)
        least, bits = np.arange(n), lambda i, j, x: np.bitwise_count(x[i] ^ x[j])  # noqa: B023
        pairs = [(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and bits(i, j, fp) <= tau and bits(i, j, fp) + bits(i, j, fp2) <= tau + 1 and (role[i] & 1 and role[j] & 2 or role[i] & 2 and role[j] & 1)]
        for links in (pairs, simhash.forest(group, fp, role, tau, fp2, tau + 1)):
            own = np.arange(n)
            for _ in range(n):
                before = own.copy()
                for i, j in links:
                    own[i] = own[j] = min(own[i], own[j])
                if (own == before).all():
                    break
            assert links is pairs or (own == least).all()
            least = own


def test_similar_groups_equal_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for g in range(60):
        a, b, _ = similar_pair(rng, rng.choice([60, 150, 400]), rng.choice([0.99, 0.9, 0.8, 0.6]))
        rows += [(2 * g, a), (2 * g + 1, b)]
    rows += [(500, rows[0][1]), (501, rows[8][1] + " "), (502, None), (503, ""), (504, "one"), (504, rows[10][1]), (None, rows[0][1]), (505, "a b c d"), (506, "A b c d")]
    fps = {(d, t): simhash.wide_fingerprint(t or "", 5) for d, t in rows if d is not None}
    parent = {d: d for d, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (d, _), f in fps.items():
        for (e, _), g in fps.items():
            near = (f[0] ^ g[0]).bit_count()
            if near <= 10 and near + (f[1] ^ g[1]).bit_count() <= 20:
                parent[max(root(d), root(e))] = min(root(d), root(e))
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp2 int").repartition(3)
    for partitions in (None, 4):
        got = simhash.similar_groups(d, partitions=partitions).collect()
        assert ordered(got) == ordered((i, root(i)) for i, _ in rows if i is not None)
    kept = sorted((r.doc_id or -1, r.text or "") for r in simhash.keep_one(d).collect())
    assert kept == sorted((i or -1, t or "") for i, t in rows if i is None or root(i) == i)
    assert simhash.similar_groups(d.where("false")).count() == 0


def test_share_of_similar_pairs_that_are_linked():
    rng, linked = random.Random(22), collections.defaultdict(list)
    for _ in range(400):
        a, b, j = similar_pair(rng, rng.choice([100, 200, 400]), rng.choice([0.99, 0.95, 0.9, 0.85, 0.4]))
        f, g = simhash.wide_fingerprint(a, 5), simhash.wide_fingerprint(b, 5)
        near = (f[0] ^ g[0]).bit_count()
        linked[min(int(j * 10), 9)].append(near <= 10 and near + (f[1] ^ g[1]).bit_count() <= 20)
    share = {k: np.mean(v) for k, v in linked.items()}
    assert share[9] >= 0.9 and share[8] >= 0.5 and share[3] == 0, share


def test_threshold_allocation():
    rng = np.random.default_rng(1)
    cost = np.cumsum(rng.random((20, 4, 5)), axis=2)
    t = simhash.allocate(cost, 3)
    assert (t.sum(axis=1) == 0).all() and t.min() >= -1
    from itertools import product

    for q in range(20):
        every = [sum(cost[q, i, x + 1] for i, x in enumerate(c)) for c in product(range(-1, 4), repeat=4) if sum(c) == 0]
        assert sum(cost[q, i, x + 1] for i, x in enumerate(t[q])) == pytest.approx(min(every))


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 5), (2000, 2001), (7, 7), (5, 1000)]
    d = spark.createDataFrame([*chain, (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.components(d).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 0, 2000: 2000, 2001: 2000}
    assert components.components(d.where("false")).count() == 0


def test_keep_one(docs):
    kept = [r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()]
    assert 0 in kept and not {100, 101, 102, 103, 104, 201} & set(kept)
    assert simhash.keep_one(docs).columns == docs.columns


# -- 2, 5, 7 ------------------------------------------------------------------------------------------------


def library_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


ODD = [" ", "  a", "a  b", "a \n b", "x  y", "É é ß Σς", "don't stop'll 's", "3.14, a.b!. ...", "​́a é", "日本 語", "a\x1cb \x85 c", "Wörd, wörd. ª²½"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunk_table_equals_library(name, spaced, texts):
    rng = random.Random(4)
    alphabet = " \n\t.'abcABCéÉßΣς  ​́日İ½²ª\x1c\x85\r#<|>12 "
    every = [t or "" for _, t in texts] + ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    table = textids.LibraryTable(public_tokenizers.path(name), spaced, rows=50)  # small: generations change
    assert list(table.ids(every)) == [raw(i) for i in library_ids(name, every)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_hash_confuses():
    """Polynomials over bytes modulo 2**64 are equal for these pairs, whatever the base."""
    pairs = [(thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))) for n in (1024, 2048, 4096)]
    every = [w for p in pairs for w in p] + ["x" * n for n in range(55, 75)] + [" ".join(w for p in pairs for w in p), "é" * 300 + " " + "é" * 299 + "e"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        assert list(textids.LibraryTable(public_tokenizers.path(name), spaced, rows=50).ids(every)) == [raw(i) for i in library_ids(name, every)]
    for a, b in pairs:
        h = substring.shingle_hashes(f"{a} {b} {a}".encode(), 1)[0]
        assert h[0] == h[2] != h[1]


def test_equal_hashes_of_different_spans(monkeypatch):
    monkeypatch.setattr(spans.Spans, "hashes", lambda self, seed=0: self.size.astype(np.uint64) % np.uint64(3))
    every = ["one two six", "ten one", "six", "two, one. six x", "aaaaaaaaa aaaaaaaab aaaaaaaaa", "b " * 40, "z" * 100 + " " + "z" * 99 + "y"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        assert list(textids.LibraryTable(public_tokenizers.path(name), spaced, rows=50).ids(every)) == [raw(i) for i in library_ids(name, every)]


def test_packing(docs, texts):
    ids = [i + [1] for i in library_ids("word_bpe_49k.json", [t or "" for _, t in texts])]
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=256, block_tokens=3000, keep_ids=True).collect()
    sequences = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for (d, _), i in zip(texts, ids, strict=True):
        same = [x for (e, _), x in zip(texts, ids, strict=True) if e == d]
        if len(same) > 1:
            assert sum(r.length for r in by_doc[d]) == sum(map(len, same))
            continue
        own = sorted(by_doc[d], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == raw(i) and {r.doc_tokens for r in own} == {len(i)}
    assert packing.pack(docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_block_is_balanced_and_tight():
    rng = random.Random(1)
    lengths = [rng.randint(1, 256) for _ in range(500)]
    got = packing.pack_block(lengths, 256, 1.0, 1 / 128)
    n = -(-sum(lengths) // 256)
    used, cost = [0] * n, [0.0] * n
    for _, _, m, s, offset in got:
        assert offset == used[s]
        used[s] += m
        cost[s] += m + m * m / 128
    assert sum(used) == sum(lengths) and max(used) <= 256 and n * 256 - sum(used) < 256
    assert np.std(cost) < 0.35 * np.mean(cost)
    assert packing.pack_block([], 256, 1, 1) == [] == packing.pack_block([0, 0], 256, 1, 1)


def test_token_files(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared.workspace(spark, "t")
    manifest = token_store.write(docs, folder, path, shard_docs=5)
    rows = token_store.read(spark, folder, manifest).collect()
    ids = {d: None for d, _ in texts}
    for (d, _), i in zip(texts, library_ids("byte_bpe_50k.json", [t or "" for _, t in texts]), strict=True):
        ids[d] = (ids[d] or []) + [raw(i + [2])]
    assert len(rows) == len(texts)
    for d, want in ids.items():
        assert sorted(bytes(r.ids) for r in rows if r.doc_id == d) == sorted(want)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.n_ids == len(r.ids) // 4
        at += r.n_ids
    known = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert known[:2] == [None, None] and known[2:] == sorted(known[2:])
    files = {r.file for r in manifest.collect()}
    assert len(files) > 3
    assert sorted(bytes(raw(x)) for f in files for x in token_store.read_document(folder, f, 404)) == sorted(ids[404])
    empty = token_store.write(docs.where("false"), shared.workspace(spark, "t"), path)
    assert empty.count() == 0 and token_store.read(spark, folder, empty).count() == 0


def test_pieces(docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for d, t in texts:
        i = [*sp.encode(t or ""), 2]
        want.append((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(sp.decode(i).encode()).hexdigest()))
    assert ordered(pieces.encode_decode(docs, path, digests_only=True).collect()) == ordered(want)
    full = pieces.encode_decode(docs, path).collect()
    assert ordered((r.doc_id, r.id_text, r.decoded) for r in full) == ordered((d, " ".join(map(str, [*sp.encode(t or ""), 2])), sp.decode([*sp.encode(t or ""), 2])) for d, t in texts)
    table = pieces.piece_table(path)
    assert table.independent
    rng = random.Random(5)
    spaced = ["".join(rng.choice(["  ", " ", " ", "\u2581", "a", "the", "\n", "\t", "\u00a0", "é", "<s>", "\u3000", "ab", ".", "日"]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for t in ODD + spaced + [" " * n for n in range(40)] + ["x" + " " * n for n in range(40)]:
        assert b"".join(v[0] for v in next(table.values([t]))) == raw(sp.encode(t)), repr(t)
    assert pieces.encode_decode(docs.where("false"), path).count() == 0


# -- 3 ----------------------------------------------------------------------------------------------------


def test_chat(spark):
    turns = [(1, 0, "system", "be good"), (1, 2, "assistant", "b\\h#<\\"), (1, 1, "user", "### Assistant: </turn>\n x"), (2, 0, "user", None), (2, 0, "user", None), (3, 0, "tool: x", "a"), (3, None, None, "first"), (None, 0, "assistant", "z" * 5000), (4, 0, "user", "é "), (4, 1, "assistant", "")]
    d = spark.createDataFrame([(*t, "extra", 1) for t in turns], "conv_id long, turn long, role string, text string, formatted string, turns int")
    formatted = chat.format_chats(d).cache()
    assert formatted.where(F.array_join(F.transform("segments", lambda s: s["text"]), "") != F.col("formatted")).count() == 0
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in formatted.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        own = [(role, text) for _, _, role, text in own]
        assert back[conv] == own
        r, loss = got[conv], "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: True}
    assert chat.digests(chat.format_chats(d.where("false"))).count() == 0


# -- 4 ----------------------------------------------------------------------------------------------------


def test_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:730] = x[3]  # ties: more copies than a result holds
    rows = [(i, v.tolist(), "y") for i, v in enumerate(x)] + [(2000, None, "n"), (2001, [0.0] * 16, "z"), (2002, [float("nan")] + [1.0] * 15, "q"), (2003, [float("inf")] * 16, "w"), (None, [1.0] * 16, "v"), (2004, [], "e"), (2005, [None] * 16, "u"), (40, x[40].tolist(), "again")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector string")
    got = collections.defaultdict(list)
    for r in ann.search(d, d.where("vec_id % 20 = 0"), k=20, row_block=400, query_block=30, rerank=80).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y, hits = x.astype(float), []
    assert set(got) == set(range(0, 1500, 20))
    for q in got:
        s = (y * y[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(c == pytest.approx(s[v], abs=1e-9) for _, v, c in own)
        assert [(c, -v) for _, v, c in own] == sorted(((c, -v) for _, v, c in own), reverse=True)
        hits.append(len({v for _, v, _ in own} & set(want.tolist())) / 20)
    assert np.mean(hits) >= 0.95
    assert ann.search(d.where("false"), d).count() == 0 and ann.search(d, d.where("false")).count() == 0


def test_search_finds_all_nearest_of_other_vectors(spark):
    """Tight clusters larger than what is reranked, lengths over many orders, one dimension that outweighs the others, vec_ids with several vectors."""
    rng = np.random.default_rng(5)
    tight = np.repeat(rng.normal(size=(4, 16)), 400, axis=0) + 0.01 * rng.normal(size=(1600, 16))
    tables = {
        "tight": tight,
        "lengths": rng.normal(size=(1600, 16)) * 10.0 ** rng.uniform(-30, 30, size=(1600, 1)),
        "outweighed": rng.normal(size=(1600, 16)) * np.array([1000.0] + [1.0] * 15),
        "shared": tight[rng.permutation(1600)],
    }
    for name, x in tables.items():
        ids = np.arange(1600) % 400 if name == "shared" else np.arange(1600)
        d = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<double>")
        asked = [(int(i), x[i].tolist()) for i in range(0, 400, 20)]
        got = collections.defaultdict(list)
        found = ann.search(d, spark.createDataFrame(asked, d.schema), k=20, row_block=500, query_block=30, rerank=80)
        for r in found.orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        for q, v in asked:
            score = np.full(ids.max() + 1, -np.inf)
            np.maximum.at(score, ids, (x * np.array(v)).sum(axis=1))
            score[q] = -np.inf
            assert got[q] == np.lexsort((np.arange(len(score)), -score))[:20].tolist(), (name, q)


def test_anisotropic_training_lowers_its_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8)).astype(np.float32)

    def loss(q):
        r = x - q.decoded(q.assign(x)).reshape(len(x), -1)[:, :8]
        along = (r * x).sum(1) / np.linalg.norm(x, axis=1)
        return ((r**2).sum(1) + (q.eta - 1) * along**2).mean()

    assert loss(ann.Quantiser(8, 2, 4.0).train(x, 6, 1)) < loss(ann.Quantiser(8, 2, 4.0).train(x, 0, 1))


# -- 6 ----------------------------------------------------------------------------------------------------


def brute_statistics(t):
    w = WORD.findall(t or "")
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(docs, texts):
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for d, t in texts:
        s = brute_statistics(t)
        want.append((d, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert ordered(got) == ordered(want)
    assert quality.judge(docs.where("false")).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs).count() == sum(r.kept for r in quality.judge(docs).collect())


def brute_mcd(x, floors, share, tolerance=1e-3):
    """x: grid steps."""
    x = np.asarray(x, float)
    m = np.quantile(x, 0.5, axis=0)
    mad = np.quantile(np.abs(x - m), 0.5, axis=0) / quality.GRID
    m, cov, logdet = m / quality.GRID, np.diag((1.4826 * mad) ** 2 + floors**2), np.inf
    while True:
        y = x / quality.GRID
        cell = np.floor(np.log1p(np.einsum("ij,jk,ik->i", y - m, np.linalg.inv(cov), y - m)) * quality.CELLS)
        own = y[cell <= np.sort(cell)[int(np.ceil(share * len(x))) - 1]]
        new_cov = np.cov(own.T, bias=True) * quality.consistency(x.shape[1], share) + np.diag(floors**2)
        new = np.linalg.slogdet(new_cov)[1]
        if new >= logdet:
            return m, cov
        fell, m, cov, logdet = logdet - new, own.mean(axis=0), new_cov, new
        if fell <= tolerance:
            return m, cov


def test_minimum_covariance_determinant(spark):
    rng = np.random.default_rng(3)
    names = {"f_word": 0.1, "f_symbol": 0.2, "f_line": 0.3, "f_repeat": 0.4}
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    x[:60] += 25  # a cluster of outliers
    x = np.round(x * quality.GRID).astype(int)
    other = np.round(rng.normal(size=(150, 4)) * quality.GRID).astype(int)
    rows = [("g", *r) for r in x.tolist()] + [("h", *r) for r in other.tolist()] + [("one", 1, 2, 3, 4)]
    d = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{n} long" for n in names)).repartition(3)
    got = {r.grp: r for r in quality.fit(d, names).collect()}
    for grp, own in (("g", x), ("h", other)):
        p = got[grp]
        m, cov = brute_mcd(own, np.array(list(names.values())), 0.75)
        lower = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                lower[i, j] = p[f"l{i}{j}"]
        assert [p[f"m{i}"] for i in range(4)] == pytest.approx(m.tolist()) and lower @ lower.T == pytest.approx(cov)
        assert p.logdet == pytest.approx(np.linalg.slogdet(cov)[1])
        assert np.abs(m).max() < 3  # the outliers do not pull
    assert [got["one"][f"l{i}{i}"] for i in range(4)] == pytest.approx(list(names.values()))
    assert quality.consistency(4, 0.75) == pytest.approx(0.75 / 0.5046, abs=1e-3)


def brute_verdicts(rows, min_group=100, cutoff=28.0):
    """kept of (lang, source, text) rows, pooled as documented."""
    floors, share = np.array(list(quality.FEATURES.values())), lambda a, b: np.log1p(100 * a / (b + 1))
    x, base = [], []
    for _, _, t in rows:
        n, chars, symbols, dup, repeat = brute_statistics(t)
        lines = sum(bool(WORD.search(line)) for line in (t or "").split("\n")) if "\n" in (t or "") else min(n, 1)
        x.append([np.log((chars + 1) / (n + 1)), share(symbols, chars), share(dup, lines), share(repeat, n)])
        base.append(n < 10 or 100 * repeat > 20 * n)
    x = np.floor(np.array(x) * quality.GRID + 0.5)
    own = collections.Counter(r[:2] for r, b in zip(rows, base, strict=True) if not b)
    rest = collections.Counter()
    for (lang, _), n in own.items():
        rest[lang] += n if n < min_group else 0
    group = [r[:2] if own[r[:2]] >= min_group else r[0] if rest[r[0]] >= min_group else "all" for r in rows]
    kept = [False] * len(rows)
    for g in set(group):
        mine = [i for i in range(len(rows)) if group[i] == g and not base[i]]
        if mine:
            m, cov = brute_mcd(x[mine], floors, 0.75)
            for i in mine:
                y = x[i] / quality.GRID - m
                kept[i] = bool(y @ np.linalg.inv(cov) @ y <= cutoff)
    return kept


@pytest.mark.parametrize("broadcast_groups", [100_000, 0])
def test_quality_verdicts_equal_brute_force(spark, broadcast_groups):
    rng = random.Random(12)
    rows = []
    for lang, source, n in (("en", "web", 260), ("en", "a", 70), ("en", None, 45), ("de", "web", 110), ("fr", "a", 30), (None, "b", 20)):
        vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6 if lang == "en" else 11))) for _ in range(300)]
        for i in range(n):
            t = words(rng.randint(5, 300), rng, vocab)
            if i % 9 == 0:
                t = " ".join(w + rng.choice(["", "", "#", "$%"]) for w in t.split())
            if i % 11 == 0:
                t += "\nread more here\nx y" + "\nread more here" * rng.randint(1, 30)
            if i % 13 == 0:
                t += " " + " ".join(t.split()[: rng.randint(5, 40)])
            if i % 17 == 0:
                t = " ".join(w * rng.randint(1, 4) for w in t.split())
            rows.append((lang, source, t))
    rows += [("en", "web", None), ("en", "web", "")]
    d = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, kept string").repartition(3)
    want = {i for i, k in enumerate(brute_verdicts(rows)) if k}
    assert 0 < len(want) < len(rows) - 20
    assert {r.doc_id for r in quality.judge(d, broadcast_groups=broadcast_groups).where("kept").collect()} == want
    assert {r.doc_id for r in quality.keep_good(d, broadcast_groups=broadcast_groups).where("kept = 'x'").collect()} == want


def test_each_statistic_can_reject():
    most = {"f_word": 1e9, "f_symbol": np.log1p(100), "f_line": np.log1p(100), "f_repeat": np.log1p(20)}
    assert all((most[f] / floor) ** 2 > 28 for f, floor in quality.FEATURES.items())


def test_quality_rejects_outliers_of_their_group(spark):
    rng = random.Random(2)
    clean = [(i, words(rng.randint(20, 400), rng), "en", "web") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$%&#" for w in words(50, rng).split()), "en", "web") for i in range(20)]
    d = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(d).where("kept").collect()}
    assert len(kept & set(range(300))) >= 297 and not kept & {1000 + i for i in range(20)}


# -- 8 ----------------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "http://a/ b\n", big), (3, None, big), (9, "http://c", big), (3, None, big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "v", None), (None, "w", big), (6, "x", "\r\n\r\n" * 60), (7, "y", "z" * 99), (8, "y", "z" * 100), (10, "y", "z" * 100)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    folder = shared.workspace(spark, "w")
    index = warc.write(d, folder)
    first = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in rows:
        h = (h or "").encode()
        f = first.get(h)
        want.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if f not in (None, p) else "response", f if f != p else None))
    got = warc.read(spark, folder, index)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert ordered(got.select(cols).collect()) == ordered(want)
    assert {bytes(r.payload) for r in got.where("record_type = 'response'").collect()} == {(h or "").encode() for _, _, h in rows}
    some = warc.read(spark, folder, index, F.col("page_id") == 9).collect()
    assert len(some) == 1 and some[0].url == "http://c" and some[0].refers_to == 3
    assert warc.coalesced([(0, 10), (10, 5), (100, 5), (106, 4)], 2, 1000) == [(0, 2, 0, 15), (2, 4, 100, 110)]
    assert warc.coalesced([(0, 10), (10, 5)], 2, 12) == [(0, 1, 0, 10), (1, 2, 10, 15)]
    assert warc.write(d.where("false"), shared.workspace(spark, "w")).count() == 0


# -- 9 ----------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            luhn = sum((v if i % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v)) for i, v in enumerate(map(int, reversed(digits))))
            return 12 <= len(digits) <= 19 and luhn % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if good(k, m[0]))


def test_personal_data(spark, docs, texts):
    rng = random.Random(8)
    alphabet = ["a", "b", "_", "@", ".", "-", "+", "1", "2", "0", "255", " ", "(", ")", "é", "\n", "4111111111111111", "@x.co", "10.1.2.3"]
    more = [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    more += [(3000, "1" * 3000 + " " + "1 " * 3000), (3001, "a.b" * 3000 + "@"), (3002, "x@y" + ".z" * 3000), (3003, "+1" + " " * 3000), (3004, "@".join(["a.b"] * 500))]
    d = docs.select("doc_id", "text", "spans").unionByName(spark.createDataFrame([(i, t, 1) for i, t in more], "doc_id long, text string, spans int"))
    want = []
    for i, t in texts + more:
        s = brute_pii(t)
        want.append((i, *[sum(x[1] == k for x in s) for k in range(4)], hashlib.sha256(",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()))
    got = pii.detect(d).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert ordered(got) == ordered(want)
    assert pii.detect(docs.where("false")).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_terms(rows, support=2, disclosure=0.95):
    """entity, term -> (n_e, n_t, n_et, pmi, discloses) of (doc_id, text) rows, by plain counting."""
    words = [list(dict.fromkeys(w.lower() for w in regex.findall(r"\p{L}{4,}+", t or ""))) for _, t in rows]
    held = []
    for _, t in rows:
        found = [(k, t[a:e]) for a, k, e in brute_pii(t)]
        held.append({f"{k}:{v.lower() if k == 0 else v if k == 1 else re.sub('[^0-9]', '', v)}" for k, v in found})
    sketch = []
    for own, w in zip(held, words, strict=True):
        sketch.append([min((signed(xxhash.xxh64_intdigest(x.encode(), xxhash.xxh64_intdigest(struct.pack("<i", i), 42))) for x in w), default=None) for i in range(8)] if own else None)
    where = collections.defaultdict(list)
    for i, own in enumerate(held):
        for e in own:
            where[e].append(i)
    other, scored = {}, {}
    for e, docs in where.items():
        if len(docs) < support:
            continue
        by_hash = collections.defaultdict(list)
        for i in docs:
            by_hash[sketch[i][0]].append(sketch[i])
        typical = min(max(by_hash.items(), key=lambda x: (len(x[1]), x[0]))[1])
        flags = {i for i in docs if sum(x == y for x, y in zip(sketch[i], typical, strict=True)) <= 3}
        if flags:
            other[e] = flags
    df = collections.Counter(w for own in words for w in own)
    for e, flags in other.items():
        for t in {w for i in where[e] for w in words[i]}:
            both = [i for i in where[e] if t in words[i]]
            if len(both) >= support and flags & set(both):
                scored[e, t] = (len(where[e]), df[t], len(both))
    n, out = len(rows), {}
    for (e, t), (n_e, n_t, n_et) in scored.items():
        pmi = math.log(n_et * n / n_e / n_t)
        out[e, t] = (n_e, n_t, n_et, pmi, n_e < n and pmi >= disclosure * math.log(n / n_e) and n_et * pmi >= math.log(len(scored)))
    return out


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    rows = [(i, words(30, rng, vocab)) for i in range(200)]
    rows += [(500 + i, f"{words(20, rng, vocab)} Zyxwvut\n{words(9, rng, vocab)} jo@x.org {words(10, rng, vocab)}") for i in range(5)]  # on another line
    rows += [(600 + i, f"lonely qqqqqq ann@x.org {words(0, rng)} end") for i in range(3)]  # copies: no evidence
    family = words(80, rng) + " +1 988 555 2485 " + words(80, rng)  # edited copies of one document: none either
    for i in range(12):
        w = family.split()
        w[rng.randrange(60)] = f"edited{'abcdefghijkl'[i]}"
        rows.append((700 + i, " ".join(w)))
    rows += [(800 + i, f"{words(25, rng, vocab)}\nWrite to Tarquin Ostrander, 10.1.2.3\n{words(12, rng, vocab)}") for i in range(6)]  # a signature, word for word
    rows += [(900, "somewhere else Zyxwvut is named, zyxwvut and Ostrander"), (901, None), (None, "Zyxwvut here jo@x.org too"), (902, "tarquinish")]
    rows += [(500, rows[200][1])]
    return rows


def test_scored_terms_equal_brute_force(spark, letters):
    d = spark.createDataFrame([(i, t, "x") for i, t in letters], "doc_id long, text string, term string").repartition(4)
    got = {(r.entity, r.term): (r.n_e, r.n_t, r.n_et, r.pmi, r.discloses) for r in pii.disclosing_terms(pii.found_spans(d), d).collect()}
    want = brute_terms(letters)
    assert set(got) == set(want) and any(v[4] for v in want.values()) and not all(v[4] for v in want.values())
    for k, v in want.items():
        assert got[k][:3] == v[:3] and got[k][3] == pytest.approx(v[3]) and got[k][4] == v[4], k


def test_disclosing_terms(spark, letters):
    d = spark.createDataFrame([(i, t, 1) for i, t in letters], "doc_id long, text string, tag int").repartition(4)
    telling = {t for (_, t), v in brute_terms(letters).items() if v[4]}
    assert {"zyxwvut", "tarquin", "ostrander"} <= telling and not {"lonely", "qqqqqq"} & telling
    want = []
    for i, t in letters:
        base = brute_pii(t)
        found = [(m.start(), m.end()) for m in regex.finditer(r"\p{L}{4,}+", t or "") if m[0].lower() in telling]
        found = [(a, 4, e) for a, e in found if not any(s <= a and e <= f for s, _, f in base)]
        want.append((i, len(found), ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in sorted(base + found))))
    assert ordered(pii.detect(d).select("doc_id", "n_term", "spans").collect()) == ordered(want)
    by_id = {i: n for i, n, _ in want}
    assert by_id[900] == 3 and by_id[902] == 0 and by_id[600] == 0 and by_id[700] == 0
    clean = pii.sanitise(d).collect()
    assert len(clean) == len(letters) and not any(re.search("jo@x.org|zyxwvut|tarquin |ostrander", r.text or "", re.I) for r in clean)
    same = {r.doc_id: r.text for r in clean}
    assert all(same[i] == t for i, t in letters if by_id[i] == 0 and not brute_pii(t))


# -- 10 ---------------------------------------------------------------------------------------------------


def test_passages(docs, texts):
    text = dict(texts)
    rows = substring.duplicate_passages(docs).collect()
    for r in rows:
        assert text[r.doc_id][r.start : r.end].split() == text[r.doc_id].split()[r.start_word : r.end_word]
        assert r.end_word - r.start_word >= 50 and r.similarity >= 0.8 and r.source_doc_id <= r.doc_id
    hit = collections.defaultdict(set)
    for r in rows:
        hit[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert all(len(hit[d]) == 120 for d in (100, 101, 102, 103, 104, 201))
    assert len(hit[200]) >= 115 and len(hit[301]) >= 70 and len(hit[302]) == 70
    assert not set(hit) & ({300, 400, 401, 402, 403, 404, 406} | set(range(12)))
    assert substring.duplicate_passages(docs.where("false")).count() == 0
    cut = {r.doc_id: r.text for r in substring.remove_passages(docs).where("doc_id is not null").collect()}
    assert cut[300] == text[300] and cut[302] == "" and cut[400] is None and len(cut[301].split()) <= 30
    assert substring.remove_passages(docs).count() == len(texts) and substring.remove_passages(docs).columns == docs.columns


def brute_passages(rows, shingle=5, least_words=50, similarity=0.8):
    """(later doc, words of it in near-duplicate passages) by comparing every text with every earlier one, on the shingles themselves."""
    number, cover = {}, collections.defaultdict(set)
    arrays = []
    for _, t in rows:
        w = [x.lower() for x in WORD.findall(t or "")]
        arrays.append(np.array([number.setdefault(tuple(w[i : i + shingle]), len(number)) for i in range(len(w) - shingle + 1)], np.int64))
    for i, (d, _) in enumerate(rows):
        for j, (e, _) in enumerate(rows):
            if e < d:
                for s, end, _, _, _ in substring.verified(arrays[i], arrays[j], least_words - shingle + 1, similarity, 2 * shingle):
                    cover[d] |= set(range(s, end + shingle - 1))
    return cover


def edited(passage, n, rng):
    out = list(passage)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.6:
            out[at] = f"e{rng.randrange(10**6)}"
        elif kind < 0.8:
            del out[at]
        else:
            out.insert(at, f"e{rng.randrange(10**6)}")
    return out


def test_edited_passages_against_all_pairs(spark):
    rng = random.Random(31)
    vocab = [f"{rng.choice('bcdfghk')}{rng.randrange(3000)}" for _ in range(1500)]
    filler = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [filler(rng.choice([60, 80, 120, 250])) for _ in range(12)]
    rows = []
    for i in range(60):
        p = passages[i % 12]
        rows.append((i, " ".join(filler(rng.randint(5, 60)) + edited(p, 0 if i < 12 else rng.randint(0, len(p) // 60), rng) + filler(rng.randint(5, 60)))))
    want = brute_passages(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.defaultdict(set)
    for r in substring.duplicate_passages(d).where("doc_id <> source_doc_id").collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    wanted, found = sum(map(len, want.values())), sum(len(got[i] & want[i]) for i in want)
    assert len(want) >= 40 and found >= 0.9 * wanted, (found, wanted)
    assert sum(len(got[i] - want[i]) for i in got) <= 0.02 * wanted
    print(f"words of near-duplicate passages found: {found} of {wanted}")


def test_cut_copies_with_an_edit_each_find_every_earlier_one(spark):
    # 28 texts with a piece of one passage each, every piece edited once: few pairs share enough, and mostly not with a group's first
    rng = random.Random(6)
    filler = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, rows = filler(140), []
    for i in range(28):
        at = rng.randrange(80)
        rows.append((i, " ".join(filler(15) + edited(passage[at : at + rng.randint(52, 60)], 1, rng) + filler(15))))
    want, got = brute_passages(rows), collections.defaultdict(set)
    for r in substring.duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert sum(map(len, want.values())) > 300
    assert not {i: want[i] - got[i] for i in want if want[i] - got[i]}


def test_rows_of_a_small_key_are_linked_each_to_each():
    rng = np.random.default_rng(2)
    sizes = [1, 2, substring.EACH_ROWS, substring.EACH_ROWS + 1]
    key = np.repeat(np.arange(4), sizes)
    left, right = (rng.integers(-(2**63), 2**63 - 1, len(key)) for _ in range(2))
    a, b, _ = substring._links_within(key, left, right, np.arange(len(key)) << 40)
    assert (key[a] == key[b]).all() and (a > b).all() and len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a)
    assert [int((key[a] == i).sum()) for i in range(3)] == [n * (n - 1) // 2 for n in sizes[:3]]
    assert set(a[key[a] == 3].tolist()) | set(b[key[a] == 3].tolist()) == set(np.flatnonzero(key == 3).tolist())


def test_repeated_passage_in_many_texts(spark):
    rng = random.Random(9)
    passage, line = words(60, rng), words(8, rng)
    rows = [(i, f"{words(rng.randint(10, 80), rng)} {passage if i % 3 == 0 else line} {words(rng.randint(10, 80), rng)}") for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in substring.duplicate_passages(d).collect():
        found[r.doc_id] |= set(range(r.start_word, r.end_word))
    wanted = [i for i, _ in rows if i % 3 == 0][1:]
    assert not set(found) - set(wanted)  # a common line is no passage
    assert sum(len(found[i]) >= 55 for i in wanted) >= 0.95 * len(wanted)


def test_texts_of_a_batch_look_their_chunks_up_together(monkeypatch):
    path, looked = public_tokenizers.path("byte_bpe_50k.json"), []
    get = textids.Generations.get
    monkeypatch.setattr(textids.Generations, "get", lambda self, keys: looked.append(len(keys)) or get(self, keys))
    table, texts = textids.LibraryTable(path, True), ["alpha beta gamma " * 50_000 + "end"] * 3
    ids = list(table.ids(texts))
    assert sum(looked) <= 6  # alpha with and without a space before it, beta, gamma, end
    assert ids[0] == ids[1] == ids[2] == table.whole(texts[0])


def test_compact_windows_cover_all_subsequences():
    rng = np.random.default_rng(1)
    for least in (3, 6):
        v = rng.integers(0, 40, 30).astype(np.uint64)
        w = substring.compact_windows(v, least)
        for i in range(30):
            for j in range(i + least - 1, 30):
                own = [(low, c, high) for low, c, high in w if low <= i <= c <= j <= high]
                assert len(own) == 1 and v[own[0][1]] == v[i : j + 1].min()


def test_shingle_hashes_are_consistent():
    t = ("Alpha beta\tGAMMA  delta " * 30).strip().encode()
    h, s, e = substring.shingle_hashes(t, 5)
    assert len(h) == 116 and (h[:4] == h[4:8]).all() and len(np.unique(h)) == 4
    assert [t[a:b] for a, b in zip(s, e, strict=True)] == t.split()
    assert not set(h.tolist()) & set(substring.shingle_hashes(t, 5, 1)[0].tolist())


# -- registered queries -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_match_sql(spark, name, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    got.write.parquet(str(tmp_path / "q"))
    cols = ", ".join(f'"{c}"' for c in sorted(got.columns))
    g, o = f"(select {cols} from '{tmp_path}/q/*.parquet')", f"(select {cols} from ({catalog.ORACLE_SQL[name]}))"
    assert con.sql(f"select count(*) from {g}").fetchall() == con.sql(f"select count(*) from {o}").fetchall()
    assert con.sql(f"{g} except all {o}").fetchall() == [] == con.sql(f"{o} except all {g}").fetchall()


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in catalog.QUERIES)
    assert numbers == list(range(1, 11))


def test_tables_lie_in_the_checkpoint_folder(spark):
    assert shared.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        conf = type("C", (), {"get": lambda self, *a: None})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.checkpoint_root(Session())


def test_tables_are_deleted_with_their_reader(spark):
    a = shared.written(spark.range(3), "a")
    b = shared.written(a.where("id > 0"), "b", a)
    files, path = shared.filesystem(a.shared_path)
    assert b.count() == 2 and files.get_file_info(path).type.name == "NotFound"
    with pytest.raises(ValueError):
        shared.delete(spark, "/elsewhere")


def test_backticks_in_other_columns(spark):
    d = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, `a``b.c` int")
    assert shared.widened(shared.narrowed(d, "doc_id", "text"), d.columns).collect() == d.collect()
