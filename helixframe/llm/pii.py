"""Personal data: patterns for identifiers, and terms that give them away.

All in DataFrame expressions. Identifiers are found by pattern and checked
(octets, Luhn, digit counts). Then, by information theory, terms that disclose an
identifier are found too: over the corpus, a term t (a word of the whole text) has
pointwise mutual information ln(n_et * N / (n_e * n_t)) with the identifier e
(n: documents that hold them; N: all), against the information ln(N / n_e) of e
itself. t discloses e where

* the quotient reaches ``disclosure``;
* the information that all their common documents give, n_et times the mutual
  information, pays for naming one of the pairs that were scored, ln(pairs);
* ``support`` documents show both, one of which is no copy of the typical
  document of e. Copies are told by a sketch of eight least word hashes.

Every occurrence of such a term, in any document, is a span of kind "term".
Sanitising replaces spans by what their kind generalises to, and removes terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

# The patterns find the same leftmost matches as the plain ones in their comments. Possessive quantifiers
# and the look-behinds (with \G, the end of the match before) only spare restarts within a run.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+, of which only chains of 12 digits or more can pass
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
GENERAL = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": ""}
#: Least hashes in a document's sketch, and how many may agree in documents that are no copies.
SKETCH, ALIKE = 8, 3


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    back = F.split(F.reverse(s), "")

    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    digits = _digits(s)
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= F.lit("255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: Spans that are gathered before they join the others: appending to one long array would copy it each time.
CHUNK = 128


def matches(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost matches, in code points.

    What lies between matches is split off by the same pattern, so lengths add up to positions.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    lengths = F.transform(found, lambda v, i: F.struct(v.alias("value"), F.length(v).alias("n"), F.length(F.get(gaps, i)).alias("gap")))
    kind = "array<struct<start:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("done"))

    def step(acc: Column, m: Column) -> Column:
        first = acc["at"] + m["gap"]
        one = F.array(F.struct(first.alias("start"), (first + m["n"]).alias("end"), m["value"].alias("value")))
        full = F.size(acc["now"]) >= CHUNK
        now = F.when(full, one).otherwise(F.concat(acc["now"], one))
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct((first + m["n"]).alias("at"), now.alias("now"), done.alias("done"))

    return F.aggregate(lengths, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))


def _checked(text: Column, no: int, kind: str) -> Column:
    good = F.filter(matches(text, PATTERNS[kind]), lambda m: _passes(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end, value>> of all identifiers, sorted."""
    digit, at = F.rlike(text, F.lit("[0-9]")), F.contains(text, F.lit("@"))
    need = {"email": at, "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,value:string>>")
    each = []
    for no, kind in enumerate(PATTERNS):
        each.append(F.when(need[kind], _checked(text, no, kind)).otherwise(empty))
    return F.when(digit | at, F.array_sort(F.concat(*each))).otherwise(empty)


def _entity(kind_no: Column, value: Column) -> Column:
    """The identifier that a match stands for: lower-cased, numbers by their digits."""
    return F.concat(kind_no.cast("string"), F.lit(":"), F.when(kind_no == 0, F.lower(value)).when(kind_no == 1, value).otherwise(_digits(value)))


def _term_pattern(term_chars: int) -> str:
    return r"\p{L}{" + str(term_chars) + ",}+"


def _terms(text: Column, term_chars: int) -> Column:
    """The distinct words of at least ``term_chars`` letters, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_term_pattern(term_chars)), F.lit(0)), F.lower))


def _least_hash(words: Column, no: int) -> Column:
    return F.array_min(F.transform(words, lambda w: F.xxhash64(F.lit(no), w)))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def found_spans(docs: DataFrame, *, term_chars: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, tag (hash of the text), spans, and for texts with spans the sketch of their words."""
    d = _texts(docs).withColumn("spans", base_spans(F.col("text")))
    d = d.select("doc_id", "tag", "spans", F.when(F.size("spans") > 0, _terms(F.col("text"), term_chars)).alias("words"))
    return d.select("doc_id", "tag", "spans", F.when(F.col("words").isNotNull(), F.array(*[_least_hash(F.col("words"), i) for i in range(SKETCH)])).alias("sketch"))


def disclosing_terms(found: DataFrame, docs: DataFrame, *, term_chars: int = 4, support: int = 2, disclosure: float = 0.95) -> DataFrame | None:
    """The pairs that are scored: entity, term, n_e, n_t, n_et, pmi and discloses. None where no identifier has two documents that are no copies.

    Counts are of rows of the whole table; the terms of all texts are counted once, whatever identifiers there are. Only texts with such identifiers are moved.
    """
    words = docs.select(F.explode(_terms(F.coalesce("text", F.lit("")), term_chars)).alias("term"))
    counts = shared.written(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") >= support), "pii-words")
    entities = F.array_distinct(F.transform("spans", lambda s: _entity(s["kind_no"], s["value"])))
    mention = found.where(F.size("spans") > 0).select("doc_id", "tag", "sketch", F.explode(entities).alias("entity"))
    # the typical document of an identifier is one with the commonest first hash
    typical = mention.groupBy("entity", F.col("sketch")[0].alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("sketch").alias("s"))
    typical = typical.groupBy("entity").agg(F.sum("n").alias("n_e"), F.max_by("s", F.struct("n", "h")).alias("typical")).where(F.col("n_e") >= support)
    typical = shared.written(typical, "pii-identifiers")
    alike = F.size(F.filter(F.zip_with("sketch", "typical", lambda x, y: x.eqNullSafe(y)), lambda x: x))
    held = mention.join(typical, "entity").select("doc_id", "tag", "entity", "n_e", (alike <= ALIKE).alias("other"))
    several = shared.written(held.groupBy("entity").agg(F.max("other").alias("other")).where("other").select("entity"), "pii-several")
    if several.isEmpty():
        return None
    own = held.join(several, "entity", "left_semi").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("entity", "n_e", "other")).alias("held"))
    own = shared.written(own.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "held"), "pii-holders", several)
    some = shared.divided(_texts(docs), F.col("tag"), own.select("_tag").distinct())[0]
    some = some.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")))
    both = some.select("held", F.explode(_terms(F.col("text"), term_chars)).alias("term")).select("term", F.explode("held").alias("h")).select("term", "h.*")
    pairs = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), F.max("other").alias("other"), F.first("n_e").alias("n_e")).where((F.col("n_et") >= support) & F.col("other")).drop("other")
    pairs = shared.written(pairs, "pii-pairs")
    rows, n_pairs = docs.count(), pairs.count()
    scored = pairs.join(counts, "term").withColumn("pmi", F.ln(F.col("n_et") * F.lit(float(rows)) / F.col("n_e") / F.col("n_t")))
    tells = (F.col("n_e") < rows) & (F.col("pmi") >= disclosure * F.ln(F.lit(float(rows)) / F.col("n_e"))) & (F.col("n_et") * F.col("pmi") >= F.lit(math.log(max(n_pairs, 1))))
    return scored.withColumn("discloses", tells)


def term_spans(found: DataFrame, docs: DataFrame, *, term_chars: int = 4, **options) -> DataFrame | None:
    """Every occurrence of disclosing terms, per text that has some: _doc, _tag, _terms (array of start, kind_no, end). None where there are none."""
    scored = disclosing_terms(found, docs, term_chars=term_chars, **options)
    if scored is None:
        return None
    telling = shared.written(scored.where("discloses").select(F.col("term").alias("_term")).distinct(), "pii-terms")
    if telling.isEmpty():
        return None
    own = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(_term_pattern(term_chars)), F.lit(0)))
    words = _texts(docs).select("doc_id", "tag", F.explode(own).alias("word")).withColumn("term", F.lower("word"))
    uses = shared.divided(words, F.col("term"), telling)[0].join(telling, F.col("term") == F.col("_term"), "left_semi")
    uses = uses.groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_set("word").alias("_uses"))
    uses = shared.written(uses, "pii-uses")
    some = shared.divided(_texts(docs), F.col("tag"), uses.select("_tag").distinct())[0]
    some = some.join(uses, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")))
    # a text is searched for its own few words, which are letters alone
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("_uses", "|"), F.lit(r")(?!\p{L})"))
    no = F.lit(len(PATTERNS))
    spans = F.transform(matches(F.col("text"), pattern), lambda m: F.struct(m["start"].alias("start"), no.alias("kind_no"), m["end"].alias("end")))
    return shared.written(some.select("_doc", "_tag", spans.alias("_terms")).dropDuplicates(["_doc", "_tag"]), "pii-term-spans", uses)


def _all_spans(base: Column, terms: Column) -> Column:
    """Identifiers and terms in order; what lies inside an identifier is generalised with it and no span."""
    outside = F.filter(terms, lambda t: ~F.exists(base, lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"])))
    return F.when(terms.isNull(), base).otherwise(F.array_sort(F.concat(base, outside)))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))


def _with_terms(d: DataFrame, terms: DataFrame | None, tag: Column) -> DataFrame:
    """``d`` (doc_id, ...) with _terms: null where a text has none."""
    if terms is None:
        return d.withColumn("_terms", F.lit(None).cast("array<struct<start:int,kind_no:int,end:int>>"))
    return d.join(terms, F.col("doc_id").eqNullSafe(F.col("_doc")) & (tag == F.col("_tag")), "left")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind_no"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, then kind in the
    order of ``KINDS``; base_sha256 is the digest of the same list without terms.
    A null or empty text has none. Null and repeated doc_ids keep their rows; rows of
    equal doc_id and text get equal results. An empty table gives no rows; other columns are ignored.
    """
    found = shared.written(found_spans(docs), "pii-spans")
    d = _with_terms(found.withColumn("spans", _plain(F.col("spans"))), term_spans(found, docs, **options), F.col("tag"))
    d = d.withColumn("all", _all_spans(F.col("spans"), F.col("_terms")))
    count = lambda no: F.size(F.filter("all", lambda s: s["kind_no"] == no)).cast("long")
    return d.select("doc_id", *[count(no).alias(f"n_{k}") for no, k in enumerate(KINDS)], F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with spans replaced; of overlapping ones the first covers, as far as the farthest end."""
    names = F.array(*[F.lit(GENERAL[k]) for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        between = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(between, F.get(names, s["kind_no"])))).alias("parts"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the personal data of text replaced; all columns and rows stay, a null text stays null.

    An n_chars column is set to the new length. Only documents that may have term spans take part in a join.
    """
    found = shared.written(found_spans(docs), "pii-spans")
    terms = term_spans(found, docs, **options)
    d = shared.narrowed(docs, "doc_id", "text", "n_chars")
    parts = [d]
    if terms is not None:
        changed, same = shared.divided(d.withColumn("_own", F.xxhash64("text")), F.col("_own"), terms.select("_tag").distinct())
        parts = [_with_terms(changed, terms, F.col("_own")).select(*d.columns, "_terms"), same.select(d.columns)]
    done = None
    for part in parts:
        own = _plain(base_spans(F.coalesce("text", F.lit(""))))
        part = part.withColumn("_spans", _all_spans(own, F.col("_terms")) if "_terms" in part.columns else own)
        part = part.withColumn("text", F.when(F.size("_spans") > 0, _masked(F.col("text"), F.col("_spans"))).otherwise(F.col("text")))
        if "n_chars" in docs.columns:
            part = part.withColumn("n_chars", F.length("text").cast("long"))
        part = part.select(d.columns)
        done = part if done is None else done.unionByName(part)
    return shared.widened(done, docs.columns)
