"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is rendered as ``### Label: text</turn>\\n`` and read back by a
deterministic parser, which takes every ``### Label: `` as the start of a turn and
every ``</turn>`` as the end of one.  Where what it recovers is not the source, the
text's control strings are escaped, the turn is marked (``### Label~: ``), and it
is rendered and read again.  A turn ends at its own mark and the mark has no
border with itself, so turns can be checked one by one and a conversation of any
length is never gathered to be formatted.

Escapes: ``\\`` is ``\\\\``, ``</turn>`` is ``\\e``, ``###`` is ``\\h``.  They stand
only in turns that are marked.

Defined results: null text is empty, null role is the empty role; rows of a
conversation that share a turn number are ordered by role, then text; null turn
numbers come first.  Null conversation ids form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
#: Fixed labels of the usual roles; any other role is ``@`` and its escaped name.
LABELS = {"user": "User", "assistant": "Assistant", "system": "System"}
#: What the parser takes for the start of a turn.
START = r"### (User|Assistant|System|@[^:~#<\n]*)(~?): "
_ROLE_ESCAPES = (("\\", "\\\\"), (":", "\\c"), ("~", "\\t"), ("#", "\\h"), ("<", "\\l"), ("\n", "\\n"))
_TEXT_ESCAPES = (("\\", "\\\\"), (END, "\\e"), ("###", "\\h"))


def _escaped(c: Column, pairs: tuple) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _unescaped(c: Column, pairs: tuple) -> Column:
    """Codes never end in a backslash, so cutting at pairs of them from the left reads the escapes as they were written."""

    def codes(x: Column) -> Column:
        for plain, code in pairs[1:]:
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), codes), "\\")


def _label(role: Column) -> Column:
    label = F.concat(F.lit("@"), _escaped(role, _ROLE_ESCAPES))
    for name, shown in LABELS.items():
        label = F.when(role == name, shown).otherwise(label)
    return label


def render(role: Column, text: Column, escape: bool) -> Column:
    return F.concat(F.lit("### "), _label(role), F.lit("~: " if escape else ": "), _escaped(text, _TEXT_ESCAPES) if escape else text, F.lit(END + "\n"))


def parse(segment: Column) -> Column:
    """struct(role, text) of one rendered turn; null if it does not read as exactly one."""
    whole = r"(?s)^" + START + r"(.*)" + END + r"\n$"
    label, marked, body = (F.regexp_extract(segment, whole, i) for i in (1, 2, 3))
    role = _unescaped(F.substring(label, 2, 1 << 30), _ROLE_ESCAPES)
    for name, shown in LABELS.items():
        role = F.when(label == shown, name).otherwise(role)
    ends = F.length(segment) - F.length(F.replace(segment, F.lit(END), F.lit("")))
    one = (F.regexp_count(segment, F.lit(START)) == 1) & (ends == len(END)) & (label != "")
    return F.when(one, F.struct(role.alias("role"), F.when(marked == "~", _unescaped(body, _TEXT_ESCAPES)).otherwise(body).alias("text")))


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``segment``, the rendered turn, and ``escaped``.

    A conversation's formatted text is its segments in order of turn, role, text.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    for escape in (False, True):
        segment = render(F.col("role"), F.col("text"), escape)
        if not escape:
            rows = rows.withColumn("segment", segment).withColumn("escaped", F.lit(False))
        else:
            back = parse(F.col("segment"))
            same = F.coalesce(back == F.struct("role", "text"), F.lit(False))
            rows = rows.withColumn("escaped", ~same).withColumn("segment", F.when(same, F.col("segment")).otherwise(segment))
    return rows


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss, segment) as the parser recovers them; ``loss`` marks text under the loss mask."""
    got = formatted.withColumn("_turn", parse(F.col("segment")))
    checked = F.when(F.col("_turn").isNull(), F.raise_error(F.lit("a turn does not survive the round trip"))).otherwise(F.col("_turn"))
    return got.select("conv_id", "turn", "segment", checked.alias("_turn")).select(
        "conv_id", "turn", "segment", F.col("_turn.role").alias("role"), F.col("_turn.text").alias("text"), (F.col("_turn.role") == "assistant").alias("loss")
    )


def conversations(parsed: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of what was read back."""
    row = F.struct("turn", "role", "text", F.length("segment").cast("long").alias("n"))
    listed = parsed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    loss = F.array_join(F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return listed.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), labelled AS (
  SELECT *, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE
    '@' || replace(replace(replace(replace(replace(replace(role, '\', '\\'), ':', '\c'), '~', '\t'), '#', '\h'), '<', '\l'), chr(10), '\n') END AS label
  FROM turns
), sized AS (
  SELECT *, 14 + length(label) + CASE WHEN contains(text, '</turn>') OR regexp_matches(text, '### (User|Assistant|System|@[^:~#<\n]*)(~?): ')
    THEN 1 + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h')) ELSE length(text) END AS n
  FROM labelled
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
