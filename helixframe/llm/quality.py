"""Quality rules: counted base rules, then robust multivariate outliers.

All in DataFrame expressions. Per (language, source) a minimum covariance
determinant estimate is fitted to transformed statistics of the documents that
pass the base rules: start from medians and absolute deviations, then repeat
concentration steps (keep the ``keep_share`` nearest by Mahalanobis distance,
take their mean and covariance) until no group's determinant falls any more. A
document farther than ``cutoff`` is rejected.

Statistics lie on a grid, so medians, nearest shares and sums of squares are exact
whatever the order of tasks, and so is the verdict. Groups are reduced to sums per
cell of distance before any shuffle, so a hot source costs no more than a partial
aggregation per task.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

log = logging.getLogger("helixframe")
WHITE = " \t\n\x0b\x0c\r"
WORD_GAP = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
#: The transformed statistics and the least standard deviation each is given. The square of a statistic's largest value
#: over that deviation exceeds the cutoff, so each of them can reject by itself.
FEATURES = {"f_word": 0.12, "f_symbol": 0.4, "f_line": 0.85, "f_repeat": 0.57}
#: Steps of the grid of statistics in one unit, and cells of distances in one unit of ln(1 + distance).
GRID, CELLS = 1024, 64


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP, -1))


def _windows(words_: Column, n: int) -> Column:
    at = lambda i, k: F.get(words_, i + k)
    return F.when(F.size(words_) >= n, F.transform(F.sequence(F.lit(0), F.size(words_) - n), lambda i: F.xxhash64(*[at(i, k) for k in range(n)]))).otherwise(F.array().cast("array<long>"))


def statistics(docs: DataFrame, *, window: int = 5, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs`` the columns it has (text only with ``keep_text``), and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    A null text has no words. n_repeat_words counts the words that lie in some
    ``window``-word window that the text has twice or more.
    """
    keep = [c for c in docs.columns if c != "text"]
    d = docs.withColumn("_text", F.col("text")) if keep_text else docs
    keep += ["_text"] if keep_text else []
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select(*keep, "text", words(F.col("text")).alias("_words"), F.when(F.contains("text", F.lit("\n")), F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))).alias("_lines"))
    d = d.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_lines").isNull(), F.least(F.size("_words"), F.lit(1))).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        _windows(F.col("_words"), window).alias("_win"),
    )
    d = d.withColumn("_again", F.size(F.array_distinct("_win")) < F.size("_win"))
    # windows in the order of hash and place; equal neighbours are repeats
    d = d.withColumn("_by", F.when(F.col("_again"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get("_by", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_by", i + 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_at", F.when(F.col("_again"), F.sort_array(F.transform(F.filter("_by", same), lambda x: x["i"]))))
    covered = F.transform("_at", lambda x, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get("_at", i - 1))))
    n_repeat = F.when(F.col("_again"), F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("n_repeat_words", n_repeat).drop("_win", "_again", "_by", "_at")
    return d.withColumnRenamed("_text", "text") if keep_text else d


def with_features(stats: DataFrame) -> DataFrame:
    """The statistics of ``FEATURES`` as numbers of grid steps."""
    share = lambda a, b: F.log1p(F.lit(100.0) * F.col(a) / (F.col(b) + 1))
    each = {"f_word": F.ln((F.col("word_chars") + 1) / (F.col("n_words") + 1)), "f_symbol": share("n_symbols", "word_chars"), "f_line": share("n_dup_lines", "n_lines"), "f_repeat": share("n_repeat_words", "n_words")}
    return stats.withColumns({n: F.round(c * GRID).cast("long") for n, c in each.items()})


def consistency(p: int, share: float) -> float:
    """The factor that makes the covariance of the nearest ``share`` consistent for normal data; p even."""
    terms = lambda x, k: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k))  # noqa: E731  upper tail of chi-square, 2k degrees
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - terms(mid, p // 2) < share else (low, mid)
    return share / (1 - terms(low, p // 2 + 1))


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor in columns l<i><j>."""
    y = []
    for i, f in enumerate(names):
        z = F.col(f) / GRID - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * y[j]
        y.append(z / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(moments: DataFrame, p: int) -> DataFrame:
    """Replaces the covariance columns c<i><j> by those of its Cholesky factor, and adds the determinant's logarithm."""
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            moments = moments.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.ln(f"l{i}{i}") for i in range(1, p)), 2 * F.ln("l00"))
    return moments.drop(*[f"c{i}{j}" for i in range(p) for j in range(i + 1)]).withColumn("logdet", logdet)


def _parameters(p: int) -> list[str]:
    return [*[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], "logdet"]


def start(rows: DataFrame, features: dict[str, float]) -> DataFrame:
    """Per grp the medians and the deviations' medians (exact: a group has at most as many values as the grid has steps), as an estimate."""
    names, p = list(features), len(features)
    middle = shared.written(rows.groupBy("grp").agg(*[F.percentile(f, 0.5).alias(f"m{i}") for i, f in enumerate(names)]), "mcd-middle")
    spread = rows.join(middle, "grp").groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(p)], *[F.percentile(F.abs(F.col(f) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, f in enumerate(names)])
    factor = {f"l{i}{j}": F.sqrt((F.col(f"s{i}") / GRID * 1.4826) ** 2 + F.lit(features[names[i]] ** 2)) if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)}
    first = spread.withColumns(factor).withColumns({f"m{i}": F.col(f"m{i}") / GRID for i in range(p)})
    # the start is no covariance of any subset: the first step's determinant is below its "infinity"
    return first.withColumn("logdet", F.lit(float("inf"))).select("grp", *_parameters(p))


def concentrated(rows: DataFrame, params: DataFrame, features: dict[str, float], keep_share: float) -> DataFrame:
    """One step: per grp the estimate from the nearest rows, those cells of distance that reach ``keep_share``, or the old one
    where its determinant is no larger. fell: by how much the determinant's logarithm fell."""
    names, p = list(features), len(features)
    floor = [features[f] ** 2 for f in names]
    centre = [F.round(F.col(f"m{i}") * GRID).cast("long") for i in range(p)]
    near = rows.join(params, "grp").select("grp", F.floor(F.log1p(_distance(names)) * CELLS).alias("cell"), *[(F.col(f) - c).alias(f"z{i}") for i, (f, c) in enumerate(zip(names, centre, strict=True))])
    products = [(i, j) for i in range(p) for j in range(i + 1)]
    cells = near.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"z{i}") for i in range(p)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in products])
    by_cell = Window.partitionBy("grp").orderBy("cell")  # a few hundred cells a group
    cells = cells.withColumns({"before": F.sum("n").over(by_cell) - F.col("n"), "all": F.sum("n").over(Window.partitionBy("grp"))})
    sums = cells.where(F.col("before") < F.ceil(F.col("all") * keep_share)).groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("n", *[f"z{i}" for i in range(p)], *[f"q{i}{j}" for i, j in products])])
    scale = consistency(p, keep_share)
    mean = [F.col(f"z{i}") / F.col("n") for i in range(p)]
    cov = {f"c{i}{j}": (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) * (scale / GRID**2) + (floor[i] if i == j else 0.0) for i, j in products}
    old = params.select("grp", F.struct(*_parameters(p)).alias("old"), *[c.alias(f"o{i}") for i, c in enumerate(centre)])
    moments = sums.join(old, "grp").select("grp", "old", *[((F.col(f"o{i}") + mean[i]) / GRID).alias(f"m{i}") for i in range(p)], *[c.alias(n) for n, c in cov.items()])
    new = _factor(moments, p)
    better = F.col("logdet") < F.col("old.logdet")
    return new.select("grp", *[F.when(better, F.col(c)).otherwise(F.col("old")[c]).alias(c) for c in _parameters(p)], F.when(better, F.col("old.logdet") - F.col("logdet")).otherwise(0.0).alias("fell"))


def fit(rows: DataFrame, features: dict[str, float] = FEATURES, *, keep_share: float = 0.75, tolerance: float = 1e-3, most_steps: int = 100) -> DataFrame:
    """The estimate per ``grp`` of ``rows`` (features in grid steps): means m<i>, the Cholesky factor l<i><j> of the covariance, and logdet.

    Steps go on for a group until the logarithm of its determinant falls by no more than ``tolerance``. The covariance gets the square of each
    feature's least deviation on its diagonal, so constant features stay usable.
    """
    # estimates are written before they meet the rows: a join then knows their size and moves no rows for small ones
    params = shared.written(start(rows, features).withColumn("fell", F.lit(float("inf"))), "mcd-start")
    for _ in range(most_steps):
        moving = F.col("fell") > tolerance
        now = concentrated(rows, params.where(moving).drop("fell"), features, keep_share)
        params = shared.written(now.unionByName(params.where(~moving)), "mcd-step", params)
        if params.where(moving).isEmpty():
            break
    else:
        log.warning("determinants still fall after %d steps", most_steps)
    return params.drop("fell")


def _judged(stats: DataFrame, *, min_group: int, cutoff: float, features: dict[str, float], broadcast_groups: int, fitting: dict) -> DataFrame:
    """``stats`` (a written table of _own, _lang, base_failed, the features and more) with distance and kept, without those columns."""
    good = stats.where(~F.col("base_failed"))
    counts = good.groupBy("_lang", "_own").agg(F.count(F.lit(1)).alias("_n"))
    by_lang = counts.where(F.col("_n") < min_group).groupBy("_lang").agg(F.sum("_n").alias("_pooled"))
    level = F.when(F.col("_n") >= min_group, F.concat(F.lit("s"), "_own")).when(F.col("_pooled") >= min_group, F.concat(F.lit("l"), "_lang")).otherwise(F.lit("all"))
    level = shared.written(counts.join(by_lang, "_lang", "left").select("_own", level.alias("grp")), "quality-groups")
    rows = shared.written(good.select("_own", *features).join(level, "_own").drop("_own"), "quality-rows")
    params = level.join(fit(rows, features, **fitting), "grp").drop("grp", "logdet")
    params = shared.written(params, "quality-estimates", rows)
    small = params.count() <= broadcast_groups
    judged = stats.join(F.broadcast(params) if small else params, "_own", "left")
    distance = F.when(~F.col("base_failed"), _distance(list(features)))
    judged = judged.withColumn("distance", distance)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff)).drop("_own", "_lang", *params.columns, *features)


def _measured(docs: DataFrame, min_words: int, repeat_percent: int, keep_text: bool) -> DataFrame:
    mark = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    stats = with_features(statistics(docs, keep_text=keep_text))
    stats = stats.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    return stats.withColumns({"_own": F.concat_ws("\x01", mark("lang"), mark("source")), "_lang": mark("lang")})


def judge(
    docs: DataFrame, *, min_words: int = 10, repeat_percent: int = 20, min_group: int = 100, cutoff: float = 28.0, features: dict[str, float] = FEATURES, broadcast_groups: int = 100_000, **fitting
) -> DataFrame:
    """The columns doc_id, lang and source of ``docs``, the statistics, base_failed, distance and kept.

    base_failed: fewer than ``min_words`` words, or more than ``repeat_percent`` percent of
    them in repeated windows. kept: passed the base rules and lies within ``cutoff``
    (squared distance; 28 is exceeded by 1 in 80,000 of four normal statistics) of its group.
    A (lang, source) group of fewer than ``min_group`` passing rows is pooled with the others of
    its language, and where these are fewer than that, over all languages: no estimate can be had from a
    handful of rows. Estimates of up to ``broadcast_groups`` groups are broadcast, more are joined.

    Null lang and source are groups of their own. Null texts fail the base rules.
    Null and repeated doc_ids are kept, one row out per row in. An empty table gives no rows.
    """
    stats = shared.written(_measured(docs.select("doc_id", "lang", "source", "text"), min_words, repeat_percent, False), "quality-statistics")
    return _judged(stats, min_group=min_group, cutoff=cutoff, features=features, broadcast_groups=broadcast_groups, fitting=fitting)


def keep_good(
    docs: DataFrame, *, min_words: int = 10, repeat_percent: int = 20, min_group: int = 100, cutoff: float = 28.0, features: dict[str, float] = FEATURES, broadcast_groups: int = 100_000, **fitting
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are read once and written beside their statistics; the verdict then needs no join by document. With more than
    ``broadcast_groups`` groups it is reached on narrow rows, and only texts that may be rejected are moved.
    """
    own = _measured(shared.narrowed(docs, "doc_id", "text", "lang", "source"), min_words, repeat_percent, True)
    stats = shared.written(own.withColumn("_row", F.monotonically_increasing_id()), "quality-documents")
    rules = {"min_group": min_group, "cutoff": cutoff, "features": features, "broadcast_groups": broadcast_groups, "fitting": fitting}
    columns = ["doc_id", "text", "lang", "source", shared.EXTRA]
    if stats.select("_own").distinct().limit(broadcast_groups + 1).count() <= broadcast_groups:
        kept = _judged(stats, **rules).where("kept").select(columns)
    else:
        narrow = stats.drop("text", shared.EXTRA)
        bad = shared.written(_judged(narrow, **rules).where("not kept").select(F.col("_row").alias("_bad")), "quality-rejected")
        maybe, good = shared.divided(stats, F.col("_row"), bad)
        kept = good.select(columns).unionByName(maybe.join(bad, F.col("_row") == F.col("_bad"), "left_anti").select(columns))
    return shared.widened(kept, docs.columns)
