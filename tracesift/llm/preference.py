"""Preference pairs as one prompt and two masked completions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before a role, between role and text, and after a text (fixed values).
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: The role whose words a model learns.
LEARNT = "assistant"


def as_turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key``, ``turns``: each conversation's turns (``turn``, ``role``, ``text``) in order.

    Repeated rows count once, before the shuffle; turns that share a number are
    ordered by role and text; null numbers come first. A null role is ``user``, a
    null text empty. Rows without key are left out.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return conversations.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(turn)).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """How many turns at the start of both have the same role and text."""
    n = F.least(F.size(a), F.size(b))
    differs = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                          lambda i: (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"]))
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BREAK), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """``start:end`` of the learnt characters in the rendered turns, with commas between; all others are masked."""
    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + len(OPEN) + F.length(t["role"]) + len(BREAK)
        end = begin + F.length(t["text"]) + len(CLOSE)
        mark = F.concat(F.when(state["spans"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == LEARNT, F.concat(state["spans"], mark)).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))
    return F.aggregate(turns, start, add, lambda s: s["spans"])


def formatted(pairs: DataFrame, key: str) -> DataFrame:
    """One row per pair of ``key``, ``chosen`` and ``rejected`` (arrays of turns, as from ``as_turns``).

    ``prompt``: the longest common prefix of turns (equal role and text),
    rendered once; ``prompt_turns``: their number; ``chosen`` and ``rejected``:
    the remaining turns of each, rendered; ``chosen_spans`` and
    ``rejected_spans``: the character ranges of a completion that a model learns
    (assistant texts with their end mark), everything else and the whole prompt
    being masked. Null arrays count as empty. Equal conversations give two empty
    completions, conversations without a common turn an empty prompt.
    """
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = pairs.select(key, F.coalesce("chosen", empty).alias("_c"), F.coalesce("rejected", empty).alias("_r"))
    cut = both.withColumn("prompt_turns", _common(F.col("_c"), F.col("_r")))
    rest = {name: F.slice(name, F.col("prompt_turns") + 1, F.size(name)) for name in ("_c", "_r")}
    split = cut.select(key, "prompt_turns", F.slice("_c", 1, F.col("prompt_turns")).alias("_p"),
                       *(F.when(F.size(name) > F.col("prompt_turns"), x).otherwise(empty).alias(name) for name, x in rest.items()))
    return split.select(
        key, "prompt_turns", _rendered(F.col("_p")).alias("prompt"),
        _rendered(F.col("_c")).alias("chosen"), _rendered(F.col("_r")).alias("rejected"),
        _spans(F.col("_c")).alias("chosen_spans"), _spans(F.col("_r")).alias("rejected_spans"))


def exchanged_replies(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs from plain conversations: chosen ends with its own last reply, rejected with a stranger's.

    ``chosen`` is a conversation up to its last assistant turn; in ``rejected``
    that turn has the text of the last assistant turn of conversation ``key``
    XOR 1. Without such a neighbour, or if that has no reply, the turn is
    missing. A conversation without assistant turn is both sides as it stands.
    """
    turns = as_turns(conversations, key)
    replies = F.filter("turns", lambda t: t["role"] == LEARNT)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == LEARNT, i + 1)))
    own = turns.select(key, "turns", last.alias("_last"))
    others = turns.select(F.col(key).bitwiseXOR(F.lit(1).cast("long")).alias(key), F.get(replies, F.size(replies) - 1)["text"].alias("_reply"))
    joined = own.join(others, key, "left")
    before = F.slice("turns", 1, F.col("_last") - 1)
    stranger = F.struct(F.get("turns", F.col("_last") - 1)["turn"].alias("turn"), F.lit(LEARNT).alias("role"), F.col("_reply").alias("text"))
    return joined.select(
        key, F.when(F.col("_last").isNull(), F.col("turns")).otherwise(F.slice("turns", 1, F.col("_last"))).alias("chosen"),
        F.when(F.col("_last").isNull(), F.col("turns")).when(F.col("_reply").isNull(), before).otherwise(
            F.concat(before, F.array(stranger))).alias("rejected"))


#: DuckDB SQL for the rows of ``formatted(exchanged_replies(conversations))``.
ORACLE = """
WITH rows_ AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_),
lasts AS (SELECT conv_id, max(n) FILTER (WHERE role = 'assistant') AS last, arg_max(text, n) FILTER (WHERE role = 'assistant') AS reply FROM numbered GROUP BY conv_id),
sides AS (
  SELECT 'c' AS side, t.conv_id, n, role, text FROM numbered t JOIN lasts l USING (conv_id) WHERE l.last IS NULL OR n <= l.last
  UNION ALL
  SELECT 'r', t.conv_id, n, role, text FROM numbered t JOIN lasts l USING (conv_id) WHERE l.last IS NULL OR n < l.last
  UNION ALL
  SELECT 'r', l.conv_id, l.last, 'assistant', o.reply FROM lasts l JOIN lasts o ON o.conv_id = xor(l.conv_id, 1) WHERE l.last IS NOT NULL AND o.reply IS NOT NULL
),
prefix AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.n, r.n)) FILTER (WHERE c.n IS NULL OR r.n IS NULL OR c.role <> r.role OR c.text <> r.text) AS stop,
         max(coalesce(c.n, r.n)) AS most
  FROM (SELECT * FROM sides WHERE side = 'c') c FULL JOIN (SELECT * FROM sides WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.n = r.n
  GROUP BY 1
),
parts AS (
  SELECT s.*, coalesce(p.stop - 1, p.most) AS cut, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM sides s JOIN prefix p USING (conv_id)
),
placed AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY side, conv_id, n > cut ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM parts
)
SELECT conv_id, CAST(max(cut) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (WHERE side = 'c' AND n <= cut), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (WHERE side = 'c' AND n > cut), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY n) FILTER (WHERE side = 'r' AND n > cut), '') AS rejected,
  coalesce(string_agg(CAST(CAST(pos + 13 + length(role) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(shown) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE side = 'c' AND n > cut AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(CAST(pos + 13 + length(role) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(shown) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE side = 'r' AND n > cut AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""
