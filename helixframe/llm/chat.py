"""Chat formatting from a declarative template, with a finite-state machine over roles.

Everything is DataFrame expressions. Control strings cannot occur in formatted
texts: backslash, ``#`` and ``<`` are written as ``\\b``, ``\\h`` and ``\\l`` (and
``:`` as ``\\c`` in the name of a role that the template does not know), which is
undone when the output is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default template: what opens and closes a turn, whether its text is under the loss,
#: and which role may follow which (the state is the last role; "start" before the first).
TEMPLATE = {
    "roles": {
        "system": {"open": "### System: ", "loss": False},
        "user": {"open": "### User: ", "loss": False},
        "assistant": {"open": "### Assistant: ", "loss": True},
    },
    "other": {"open": "### Role ", "mid": ": "},
    "close": "</turn>\n",
    "follows": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
}
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def escape(text: Column, pairs=ESCAPES) -> Column:
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for raw, safe in [*pairs[1:], pairs[0]]:  # the backslash last: until then each one starts an escape
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _marker(role: Column, template: dict) -> Column:
    other = template["other"]
    out = F.concat(F.lit(other["open"]), escape(role, ROLE_ESCAPES), F.lit(other["mid"]))
    for name, rule in template["roles"].items():
        out = F.when(role == name, F.lit(rule["open"])).otherwise(out)
    return out


def _loss(role: Column, template: dict) -> Column:
    return role.isin([r for r, rule in template["roles"].items() if rule["loss"]])


def _next(state: Column, role: Column, template: dict) -> Column:
    out = F.lit("invalid")
    for before, after in template["follows"].items():
        out = F.when((state == before) & role.isin(after), role).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, formatted (the whole conversation as one string), segments
    (array of text and loss flag; their texts concatenated are ``formatted``), and
    valid: whether the roles follow the machine from start to end.

    Turns are ordered by turn, then role, then text, nulls first, so ties and
    repeated rows have a fixed order and all stay. A null text or role counts as
    empty; rows with a null conv_id form one conversation. Conversations that the
    machine rejects are formatted all the same (roles it does not know get a general
    marker) with valid = false. An empty table gives no rows; other columns are
    ignored. A conversation is one row of output, so it is the unit of memory.
    """
    close = F.lit(template["close"])
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: _next(s, t["role"], template))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(_marker(t["role"], template).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), _loss(t["role"], template).alias("loss")),
                F.struct(close.alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    convs = convs.select("conv_id", segments.alias("segments"), ((state != "invalid") & (state != "start")).alias("valid"))
    return convs.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (role, text, loss) of a formatted conversation."""
    other, parts = template["other"], F.split(formatted, "\\Q" + template["close"] + "\\E", -1)
    body = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(s: Column) -> Column:
        name = F.substring_index(F.substr(s, F.lit(len(other["open"]) + 1)), other["mid"], 1)
        role, at = unescape(name, ROLE_ESCAPES), F.length(name) + len(other["open"]) + len(other["mid"])
        for r, rule in template["roles"].items():
            here = F.startswith(s, F.lit(rule["open"]))
            role, at = F.when(here, F.lit(r)).otherwise(role), F.when(here, F.lit(len(rule["open"]))).otherwise(at)
        return F.struct(role.alias("role"), unescape(F.substr(s, at + 1)).alias("text"), _loss(role, template).alias("loss"))

    return F.transform(body, turn)


def digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Per conversation, read back from ``formatted``: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = formatted.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted"), template).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    back = back.select("conv_id", "valid", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"))
    return back.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (
  SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
              ELSE 11 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) END
            + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 8 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE coalesce(before, 'start') WHEN 'start' THEN n = 1 AND role IN ('system', 'user') WHEN 'system' THEN role = 'user'
             WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END) AS valid
FROM u GROUP BY conv_id
"""
