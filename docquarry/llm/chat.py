r"""Chat formatting with DataFrame functions only.

A conversation is one string: per block ``<|im_start|>role\n``, the texts of adjacent turns of that role
with ``<|im_sep|>`` between them, and ``<|im_end|>\n``. Inside roles and texts a backslash is written
``\s`` and ``<|`` is written ``\p`` (in roles a line feed ``\n`` too), so that no control string can be
part of them and reading back is exact. The loss mask is an array of spans of the string, one for each assistant text,
in bytes of its UTF-8 form, so that cutting a span out takes no longer at the end of a long string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import let, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Lengths are summed in blocks of so many.
BLOCK = 256


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped(c: Column, role: bool = False) -> Column:
    return _replace(c, [("\\", "\\s"), ("<|", "\\p")] + [("\n", "\\n")] * role)


def unescaped(c: Column, role: bool = False) -> Column:
    return _replace(c, [("\\n", "\n")] * role + [("\\p", "<|"), ("\\s", "\\")])


def _before(lengths: Column) -> Column:
    """Sums of the lengths that come before each, by blocks."""
    total = lambda xs, start, n: F.aggregate(F.slice(xs, start, n), F.lit(0), lambda a, x: a + x)

    def sums(xs: Column) -> Column:
        blocks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        own = F.transform(blocks, lambda k: total(xs, k * BLOCK + 1, F.lit(BLOCK)))
        upto = let(own, lambda ss: F.transform(ss, lambda _, k: total(ss, F.lit(1), k)))
        at = lambda i: F.floor(i / BLOCK).cast("int")
        return let(upto, lambda u: F.transform(xs, lambda _, i: F.get(u, at(i)) + total(xs, at(i) * BLOCK + 1, i - at(i) * BLOCK)))

    return let(lengths, sums)


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) from turns(conv_id, turn, role, text); mask: (start, end) of each assistant text in it.

    Turns are ordered by turn (nulls last), ties by role and text; null roles and texts are empty. A
    repeated row is a further turn. All rows with a null conv_id are one conversation. The string of a
    conversation is a single value, so one conversation has to fit into a task; other columns are ignored
    and an empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = F.struct(F.col("turn").isNull(), F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        same = F.get("turns", i - 1)["role"] == x["role"]
        head = F.concat(F.when(i == 0, "").otherwise(END), F.lit(START), escaped(x["role"], True), F.lit("\n"))
        return F.struct(F.when(same, SEP).otherwise(head).alias("head"), escaped(x["text"]).alias("body"), (x["role"] == "assistant").alias("loss"))

    def put(ps: Column) -> Column:
        joined = F.concat(F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END))
        size = lambda p: F.octet_length(p["head"]) + F.octet_length(p["body"])
        spans = lambda before: F.transform(
            ps, lambda p, i: F.when(p["loss"], let(F.get(before, i) + F.octet_length(p["head"]), lambda s: F.struct(s.alias("start"), (s + F.octet_length(p["body"])).alias("end"))))
        )
        return F.struct(joined.alias("formatted"), F.array_compact(let(_before(F.transform(ps, size)), spans)).alias("mask"))

    return one.select("conv_id", let(F.transform("turns", piece), put).alias("f")).select("conv_id", "f.formatted", "f.mask")


def under_mask() -> Column:
    """The texts that the mask shows, read out of formatted."""
    cut = lambda raw: F.transform("mask", lambda m: unescaped(F.substring(raw, m["start"] + 1, m["end"] - m["start"]).cast("string")))
    return F.array_join(let(F.col("formatted").cast("binary"), cut), "")


def read_back(of: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text) that is read from formatted."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(
            F.split(body, r"<\|im_sep\|>"),
            lambda x: F.struct(unescaped(role, True).alias("role"), unescaped(x).alias("text")),
        )

    return of.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    back = read_back(formatted(rows.unionByName(extra)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", "formatted", "turns", under_mask().alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t AS (SELECT *, row_number() OVER o AS n, lag(role) OVER o AS last FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
p AS (SELECT *, length(replace(replace(text, '\', '\s'), '<|', '\p'))
    + CASE WHEN role = last THEN 10 ELSE 12 + length(replace(replace(replace(role, '\', '\s'), '<|', '\p'), chr(10), '\n')) + 1 + 11 END AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
