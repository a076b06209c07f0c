"""Shared helpers of the training-data operators: text conventions, ways back to whole rows, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.durable import BATCH_BYTES, BROADCAST_ROWS, Scratch, drop_written, fresh, own, shared_dir, small_batches, small_broadcast, written

__all__ = ["BATCH_BYTES", "BROADCAST_ROWS", "Scratch", "drop_written", "fresh", "own", "shared_dir", "small_batches", "small_broadcast", "written"]

#: Bits of the map of joined_back(): 4 MB, whatever the size of the data.
BITS = 1 << 25

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text leaves that remainder; a null id is taken as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds) == fold


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once: named inside a lambda, it would be computed anew for each element."""
    return F.transform(F.array(x), f)[0]


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def bit_map(keys: DataFrame, key: Column, names: tuple[str, str]) -> DataFrame:
    """The set of key's values in BITS bits, marked for broadcast: two columns of those names, place and bits."""
    p = F.pmod(key, F.lit(BITS)) + 1
    place, bits = names
    maps = keys.select(p.alias("p")).groupBy(F.bitmap_bucket_number("p").alias(place)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    return F.broadcast(maps)


def may_hold(rows: DataFrame, key: Column, maps: DataFrame, name: str) -> DataFrame:
    """rows and the column `name`: false where maps, a bit_map(), rules key out."""
    at = F.pmod(key, F.lit(BITS)) + 1
    bit = F.bitmap_bit_position(at)
    place, bits = maps.columns
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    seen = F.call_function("shiftright", byte, bit.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    found = rows.join(maps, F.bitmap_bucket_number(at) == F.col(place), "left")
    return found.select(*own(rows), F.coalesce(seen, F.lit(False)).alias(name))


def joined_back(docs: DataFrame, found: DataFrame, name: str, of_text: Column | None = None) -> DataFrame:
    """docs and the struct column `name`: the row of found(doc_id, text_hash, ...) for that row, or null.

    found is a written table with a row for each pair at most, and docs' text hash is of_text, by default that of its text.
    The plan is the same at any size and shuffles no text in vain: a bit map of BITS bits over found's keys, a size that
    doesn't follow the data, is broadcast; rows that it rules out pass, and only the others are shuffled to meet found.
    With far more rows in found than bits, that comes to all rows, each shuffled once.
    """
    of_text = text_hash() if of_text is None else of_text
    hashed, seen, place, bits, key, other = fresh(docs, "_hashed", "_seen", "_place", "_bits", "_key", "_other")
    of_key = lambda doc_id, h: F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\x00")), h)
    rows = docs.withColumn(hashed, of_text)
    rows = rows.withColumn(key, of_key(F.col("doc_id"), F.col(hashed)))
    known = of_key(F.col("doc_id"), F.col("text_hash"))
    rows = may_hold(rows, F.col(key), bit_map(found, known, (place, bits)), seen)
    keyed = found.select(F.struct(*own(found)).alias(name), known.alias(other))
    same = (F.col(key) == F.col(other)) & (F.col(hashed) == F.col(f"{name}.text_hash")) & F.col("doc_id").eqNullSafe(F.col(f"{name}.doc_id"))
    some = rows.where(F.col(seen)).join(keyed, same, "left").select(*own(docs), F.col(name))
    none = rows.where(~F.col(seen)).select(*own(docs), F.lit(None).cast(keyed.schema[name].dataType).alias(name))
    return none.unionAll(some)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b), component being the smallest node reachable.

    Repeated contraction: each node points to its smallest neighbour, pointers are followed to their
    roots, and the edges are rewritten between roots until none is left. Nodes are longs. Every grouping
    is a minimum with map-side combining and every join may be split where a root is hot. All rounds'
    tables lie in the shared folder.
    """
    spark = edges.sparkSession
    edges = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        point = written(point, "pointers")
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(
                point.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved")),
                "pointers",
            )
            moved = not jumped.where("moved").isEmpty()
            drop_written(point)
            point = jumped
            if not moved:
                break
        point = point.select("node", "root")
        if labels is None:
            new = point
        else:
            to = point.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = labels.join(to, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        new = written(new, "labels")
        to_a = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        contracted = contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        contracted = written(contracted, "edges")
        drop_written(jumped)
        drop_written(edges)
        if labels is not None:
            drop_written(labels)
        edges, labels = contracted, new
    drop_written(edges)
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels.select("node", F.col("root").alias("component"))
