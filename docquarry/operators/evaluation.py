"""Retrieval quality: recall, precision and reciprocal rank by document and by chunk, per question and averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)
METRICS = [f"{level}_{m}" for level in ("document", "chunk") for m in (*(f"recall_{k}" for k in CUTS), "precision_5", "mrr")]


def _share(found: Column, of: Column) -> Column:
    return F.when(F.size(of) > 0, F.size(F.array_intersect(found, of)) / F.size(of)).otherwise(0.0)


def _ranks(field: str, expected: Column) -> Column:
    """Of the column got: the ranks of what was expected."""
    return F.transform(F.filter("got", lambda x: F.array_contains(expected, x[field])), lambda x: x["rank"])


def per_query(items: DataFrame, results: DataFrame) -> DataFrame:
    """The metrics of each row of items(query_id, expected_documents, expected_chunks, ...) over results(query_id, rank, chunk_id, document).

    Recall is over the distinct expected ones, precision over the distinct retrieved ones; nothing expected or retrieved gives 0.
    Items without results count, with 0.
    """
    got = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "document"))).alias("got"))
    rows = items.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast(got.schema["got"].dataType)))
    out = {}
    for level, field in (("document", "document"), ("chunk", "chunk_id")):
        expected = F.array_distinct(F.coalesce(F.col(f"expected_{level}s"), F.array().cast("array<string>")))

        def top(k: int, field=field) -> Column:
            named = F.filter("got", lambda x: (x["rank"] <= k) & x[field].isNotNull() & (x[field] != ""))
            return F.array_distinct(F.transform(named, lambda x: x[field]))

        for k in CUTS:
            out[f"{level}_recall_{k}"] = _share(top(k), expected)
        out[f"{level}_precision_5"] = _share(expected, top(5))
        out[f"{level}_mrr"] = F.coalesce(F.lit(1.0) / F.array_min(_ranks(field, expected)), F.lit(0.0))
    return rows.withColumns(out).drop("got")


def _means() -> list[Column]:
    return [F.avg(m).alias(m) for m in METRICS]


def overall(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("queries"), *_means())


def by_group(metrics: DataFrame, group: str) -> DataFrame:
    """Means by group; questions without one are left out."""
    return metrics.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_value")).agg(F.count("*").alias("queries"), *_means())


def report(metrics: DataFrame, groups: list[str]) -> DataFrame:
    """Overall and grouped means from one pass, told apart by group_name and group_value; rounded to 4 decimals."""
    every = [F.struct(F.lit("overall").alias("group_name"), F.lit("").alias("group_value"))]
    every += [F.when(F.col(g).isNotNull(), F.struct(F.lit(g).alias("group_name"), F.col(g).cast("string").alias("group_value"))) for g in groups]
    rows = metrics.select(F.explode(F.array_compact(F.array(*every))).alias("g"), *METRICS)
    out = rows.groupBy("g.group_name", "g.group_value").agg(F.count("*").alias("queries"), *_means())
    return out.select("group_name", "group_value", "queries", *(F.round(m, 4).alias(m) for m in METRICS))
