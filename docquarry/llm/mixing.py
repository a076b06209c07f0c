"""Mixing sources to target weights: hash-random order within each source, prefix sums of sizes, exact cuts.

The order of a source is that of hash-random keys, so equal ranges of the key are equal shares of its rows:
sizes are summed per source and key range with map-side combining, a prefix sum over those few sums finds
the range of the cut, and only that range's rows are put in order. What is left is one row per source,
against which each document decides alone; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.llm.common import WORD, fresh, let, own, small_broadcast, table, word_count, written

WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: Rows of a key range, about.
RANGE = 4096


def _key(doc_id: Column, text: Column) -> Column:
    """60 random bits of a row: of its id, or for a null id of its text."""
    digits = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds target to sizes(source, source_size), which has one row per source.

    Sources in order of code points (null last) weigh weights, repeating. Each target is its weight's share of
    all sizes, but at most epochs times its source's size, and the excess goes to the others by weight: sorted
    by cap over weight, a source is capped if the share that is left for it and those after it exceeds its cap.
    """
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (number - 1) % len(weights)).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * epochs)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(every) - before,
            "weights": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    ).withColumn("capped", big("cap") * big("weights") < big("weight") * big("left"))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0).cast("long"))
    over = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    share = rest.cast("double") * F.col("weight").cast("double") / over.cast("double")
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("source", "source_size", "target")


def _cuts(sized: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """A row per source: source, source_size, target, whole epochs, and the cut: cut_key, of whose rows' cut_size words cut_part are taken."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(per.select("source", "source_size"), weights, epochs)
    goal = goal.join(per.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    words = F.least(F.round("target").cast("long"), F.col("source_size") * epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("whole", F.when(F.col("whole") * F.col("source_size") > words, F.col("whole") - 1).otherwise(F.col("whole")))
    goal = goal.withColumn("rest", words - F.col("whole") * F.col("source_size"))
    goal = written(goal.withColumn("ranges", F.ceil(F.col("rows") / RANGE).cast("long")), "targets")
    near = small_broadcast(goal.select(F.col("source").alias("s"), "ranges", "rest"))
    ranged = sized.join(near, F.col("source").eqNullSafe(F.col("s")))
    ranged = ranged.withColumn("range", F.shiftright(F.shiftright("key", 30) * F.col("ranges"), 30))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    so_far = F.sum("size").over(W.partitionBy("source").orderBy("range")) - F.col("size")
    at = sums.withColumn("before", so_far).where("before < rest and rest <= before + size")
    at = small_broadcast(at.select(F.col("source").alias("s2"), F.col("range").alias("r2"), "before"))
    inside = ranged.join(at, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    units = inside.groupBy("source", "key").agg(F.sum("size").alias("cut_size"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    so_far = F.sum("cut_size").over(W.partitionBy("source").orderBy("key")) - F.col("cut_size") + F.col("before")
    units = units.withColumn("before", so_far).where("before < rest and rest <= before + cut_size")
    cut = units.select(F.col("source").alias("s"), F.col("key").alias("cut_key"), "cut_size", (F.col("rest") - F.col("before")).alias("cut_part"))
    return written(goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rows", "ranges", "rest"), "cuts")


def _taken(own: str = "", cut: str = "") -> Column:
    size, key, at = F.col(f"{own}size"), F.col(f"{own}key"), F.col(f"{cut}cut_key")
    # Rows that share the key of the cut, repeated rows that is, share its part.
    exact = lambda c: c.cast("decimal(18,0)")
    inside = F.floor(exact(size) * exact(F.col(f"{cut}cut_part")) / exact(F.greatest(F.col(f"{cut}cut_size"), F.lit(1).cast("long"))))
    part = F.when(at.isNull() | (key > at), 0).when(key < at, size).otherwise(inside.cast("long"))
    return (F.col(f"{cut}whole") * size + part).cast("long")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, text, source).

    A null text has size 0 and gives nothing; null sources are one source, the last. Rows with the same id
    have the same key and share a cut that falls on them; a null id takes its key from the text. Sources
    without words have target 0. An empty table gives an empty result; other columns are ignored.
    """
    text = F.col("text").cast("string")
    sized = docs.select("doc_id", F.col("source").cast("string"), word_count(text).alias("size"), _key(F.col("doc_id"), text).alias("key"))
    sized = written(sized, "sizes")
    cuts = _cuts(sized, weights, epochs)
    cuts = small_broadcast(cuts.withColumnRenamed("source", "s"))
    out = sized.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: a row of docs for each time that it is taken, with epoch (from 0) and taken (its words) as further columns.

    The document at which a source's target is reached is taken in part: its text ends after the words that are taken. Columns epoch
    and taken of docs are replaced. Null texts and texts without words are never taken; repeated rows are taken as often as
    they are given, those at the cut in equal parts; an empty table gives an empty result.
    """
    docs = docs.select(*own(docs, "epoch", "taken"))
    mine, cut, whole, epoch = fresh(docs, "_own", "_cut", "_taken", "_epoch")
    text = F.col("text").cast("string")
    parts = {"source": F.col("source").cast("string"), "size": word_count(text), "key": _key(F.col("doc_id"), text)}
    cuts = _cuts(written(docs.select(*(c.alias(n) for n, c in parts.items())), "sizes"), weights, epochs)
    # Structs hold what is computed, under names that docs doesn't use.
    cuts = small_broadcast(cuts.select(F.struct(*cuts.columns).alias(cut)))
    out = docs.withColumn(mine, F.struct(*(c.alias(n) for n, c in parts.items())))
    out = out.join(cuts, F.col(f"{mine}.source").eqNullSafe(F.col(f"{cut}.source"))).withColumn(whole, _taken(f"{mine}.", f"{cut}.")).where(F.col(whole) > 0)
    size = F.col(f"{mine}.size")
    last = F.floor((F.col(whole) - 1) / size).cast("int")
    out = out.select(*own(docs), size.alias(mine), F.col(whole), F.explode(F.sequence(F.lit(0), last)).alias(epoch))
    taken = F.least(F.col(mine), F.col(whole) - F.col(epoch) * F.col(mine))
    some = let(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*+{WORD}+"), F.lit(0)), lambda ws: F.array_join(F.slice(ws, F.lit(1), taken.cast("int")), ""))
    cut_text = F.when(taken == F.col(mine), text).otherwise(some)
    columns = zip(docs.columns, own(docs))
    return out.select(*(cut_text.alias("text") if c == "text" else col for c, col in columns), F.col(epoch).alias("epoch"), taken.cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * sum(size)::BIGINT AS cap FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
c AS (SELECT *, cap * weights < weight * rest AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (sum(source_size) OVER () - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE * weight::DOUBLE
  / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM c),
b AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS words FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM b),
u AS (SELECT source, key, sum(size) AS unit, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS before FROM d GROUP BY source, key)
SELECT d.doc_id, d.size, e.source_size, e.target,
  (whole * size + CASE WHEN unit = 0 THEN 0 ELSE size * least(unit, greatest(0, words - whole * source_size - before)) // unit END)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.key = u.key
"""
