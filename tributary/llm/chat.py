r"""Chat formatting: a finite-state machine over roles, and a template that marks turns and loss.

A conversation's turns, in order, become segments (text, loss).  The template
is a table: for each role the control strings before and after the text and
whether the text bears loss; any other role is written out between the marks
of ``OTHER``.  Control strings inside texts are broken by a backslash after
their first character and backslashes are doubled, so that a marker in the
output is always a turn's own and the text comes back unchanged.

The machine checks the order: an optional ``system`` turn first, then
``user`` and ``assistant`` in turns, beginning with ``user`` and ending with
``assistant``.  It decides ``valid`` and ``first_bad``, the first turn that it
has no move for (or the number of turns, where the end comes too early).
Conversations it rejects are formatted all the same; the caller filters.

Native: DataFrame functions only.  A conversation becomes one row of output,
so its own turns meet in one task; that is the size of one output value,
not of a group of rows that the operator itself gathers.

Defined cases: a null text is empty, a null role is the empty role; null
turns come first; turns with equal numbers are sorted by role, then text;
repeated rows are turns of their own; a null conv_id is a conversation; an
empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role: (before the text, after it, loss on the text)
TEMPLATE = {
    "system": ("[SYS] ", " [/SYS]", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Marks of any other role: before the role's name, between it and the text, after the text.
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: (state, role) to the next state; all else is refused.  A conversation may end in the states of FINAL.
MOVES = {("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked",
         ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
FINAL = ("answered",)


def _controls(template: dict, other: tuple) -> list[str]:
    return sorted({m.strip() for before, after, _ in template.values() for m in (before, after)} | set(other))


def escape(text: Column, controls: list[str]) -> Column:
    ahead = "|".join(re.escape(c[1:]) for c in controls)
    firsts = "".join(sorted({re.escape(c[0]) for c in controls}))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([{firsts}])(?={ahead})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(turns: DataFrame, template: dict = TEMPLATE, other: tuple = OTHER, moves: dict = MOVES, final: tuple = FINAL) -> DataFrame:
    """conv_id, valid, first_bad, segments (array of text, loss) and formatted, the segments' text in a row."""
    controls = _controls(template, other)
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("__t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("__t")).alias("__turns"))

    def segments(t: Column) -> Column:
        seg = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
        body = escape(t["text"], controls)
        out = F.array(seg(F.lit(other[0])), seg(escape(t["role"], controls)), seg(F.lit(other[1])), seg(body), seg(F.lit(other[2])))
        for role, (before, after, loss) in template.items():
            out = F.when(t["role"] == role, F.array(seg(F.lit(before)), seg(body, loss), seg(F.lit(after)))).otherwise(out)
        return out

    table = F.create_map(*[F.lit(x) for (state, role), to in moves.items() for x in (f"{state}\n{role}", to)])

    def move(acc: Column, t: Column) -> Column:
        to = F.coalesce(table[F.concat_ws("\n", acc["state"], t["role"])], F.lit("refused"))
        return F.struct(to.alias("state"), (acc["read"] + F.when(to != "refused", 1).otherwise(0)).cast("int").alias("read"))

    ran = F.aggregate("__turns", F.struct(F.lit("start").alias("state"), F.lit(0).cast("int").alias("read")), move)
    return (
        convs.withColumn("__ran", ran)
        .withColumn("segments", F.flatten(F.transform("__turns", segments)))
        .select(
            "conv_id",
            F.col("__ran.state").isin(*final).alias("valid"),
            F.when(~F.col("__ran.state").isin(*final), F.col("__ran.read")).alias("first_bad"),
            "segments",
            F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        )
    )


def turns_of(formatted: Column, template: dict = TEMPLATE, other: tuple = OTHER) -> Column:
    """The turns (role, text) in a formatted conversation, read from its control strings alone."""
    kinds = [rf"{re.escape(before)}.*?{re.escape(after)}" for before, after, _ in template.values()]
    kinds.append(rf"{re.escape(other[0])}.*?{re.escape(other[2])}")
    whole = F.regexp_extract_all(formatted, F.lit(f"(?s)({'|'.join(kinds)})"), F.lit(1))

    def turn(piece: Column) -> Column:
        part = lambda role, text: F.struct(role.alias("role"), unescape(text).alias("text"))
        inner = F.substring(piece, F.lit(len(other[0]) + 1), F.length(piece) - len(other[0]) - len(other[2]))
        cut = F.instr(inner, other[1])
        out = part(unescape(F.substring(inner, F.lit(1), cut - 1)), F.substring(inner, cut + len(other[1]), F.length(inner)))
        for role, (before, after, _) in template.items():
            text = F.substring(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(after))
            out = F.when(piece.startswith(before), part(F.lit(role), text)).otherwise(out)
        return out

    return F.transform(whole, turn)


def loss_text(segments: Column) -> Column:
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back of each formatted conversation, as counts and digests."""
    read = turns_of(F.col("formatted"))
    return formatted.withColumn("__read", read).withColumn("__loss", loss_text(F.col("segments"))).select(
        "conv_id",
        F.size("__read").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("__read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("__loss").cast("bigint").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid", "first_bad",
    )


#: The expected digests come from the rows themselves, not from a formatted text.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
         length(text) + (length(text) - length(replace(text, '\', '')))
           + len(regexp_extract_all(replace(text, '\', '\\'), '\[(SYS\]|/SYS\]|INST\]|/INST\]|ROLE\]|TEXT\]|/ROLE\])|<(s>|/s>)')) AS body,
         CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS marks
  FROM rows),
m AS (SELECT *, CASE WHEN role = 'system' THEN i = 0
                     WHEN role = 'user' THEN i = 0 OR (i = 1 AND prev = 'system') OR prev = 'assistant'
                     WHEN role = 'assistant' THEN coalesce(prev = 'user', false) ELSE false END AS ok FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS all_text,
             coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
             sum(body + marks)::BIGINT AS formatted_chars, min(i) FILTER (NOT ok) AS bad, max_by(role, i) AS last_role
      FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       (bad IS NULL AND last_role = 'assistant') AS valid,
       CASE WHEN bad IS NULL AND last_role = 'assistant' THEN NULL ELSE coalesce(bad, n_turns) END::INTEGER AS first_bad
FROM c
"""
