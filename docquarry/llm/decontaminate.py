"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). Any 13 consecutive
words of a text contain one whole block of the text's partition into blocks of 7 words, so only every
seventh 7-gram of a document is probed against the hash set of all 7-grams of the items. A block that is
found carries its two neighbours along; the windows around it are then verified word by word, by a join on
their whole strings. The hash set is broadcast within a bound on its bytes; beyond it a bit map of fixed size is, which rules out nearly
all blocks, and what is left meets the grams in a join. In general windows of m words are found by blocks of (m + 1) // 2 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import Scratch, ascii_lower, bit_map, fresh, joined_back, let, may_hold, own, small_broadcast, table, written

WINDOW = 13
_LONG = "long"


def normalised(text: Column) -> Column:
    """Words after lower-casing A-Z, each followed by one blank; null: empty."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    plain = F.trim(plain)
    return F.when(plain == "", "").otherwise(F.concat(plain, F.lit(" ")))


def _words(spaced: Column) -> Column:
    return F.split(F.rtrim(spaced), " ")


def _benchmark(benchmark: DataFrame, window: int, tmp: Scratch) -> tuple[DataFrame, DataFrame, list[int]]:
    """(m, gram) of block size, (m, win, items), and the m that occur."""
    items = benchmark.select("item_id", normalised(F.col("text").cast("string")).alias("spaced")).where("spaced <> ''")
    items = items.select("item_id", _words(F.col("spaced")).alias("words"))
    items = tmp(items.withColumn("m", F.least(F.size("words"), F.lit(window))), "items")
    lengths = sorted((r.m for r in items.select("m").distinct().collect()), reverse=True)  # at most `window` values

    def runs(n: Column) -> Column:
        return F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("words") - n + 1),
                lambda i: F.concat(F.array_join(F.slice("words", i, n), " "), F.lit(" ")),
            )
        )

    block = F.floor((F.col("m") + 1) / 2).cast("int")
    grams = tmp(items.select("m", runs(block).alias("gram")).distinct(), "grams")
    wins = items.select("m", "item_id", runs(F.col("m")).alias("win"))
    wins = tmp(wins.groupBy("m", "win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")), "windows")
    return grams, wins, lengths


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, hits (sorted array of (start, words)), n_hit, items (sorted array) for each row of docs.

    Null texts and texts without words have n_words 0 and no hits; so have all texts if no item has a word.
    Repeated rows stay as often as they are given, rows with a null doc_id are kept, and items with a
    null item_id hit words but are not named. Long texts are split into small blocks before anything is
    joined. An empty table of documents gives an empty result; other columns are ignored.
    """
    return _contamination(docs, _benchmark(benchmark, window, Scratch()))


def _contamination(docs: DataFrame, bench: tuple[DataFrame, DataFrame, list[int]]) -> DataFrame:
    grams, wins, lengths = bench
    text = F.col("text").cast("string")
    d = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), normalised(text).alias("spaced"))
    n_words = (F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(" "), F.lit("")))).cast(_LONG)
    d = d.withColumns(
        {"n_words": n_words}
        | {f"b{m}": F.regexp_extract_all("spaced", F.lit(rf"(?:[^ ]++ ){{1,{(m + 1) // 2}}}"), F.lit(0)) for m in lengths}
    )

    def blocks(m: int) -> Column:
        b = F.col(f"b{m}")
        return F.transform(
            b,
            lambda x, i: F.struct(
                F.lit(m).alias("m"), i.alias("j"), F.get(b, i - 1).alias("before"), x.alias("gram"), F.get(b, i + 1).alias("after")
            ),
        )

    empty = "array<struct<m:int,j:int,before:string,gram:string,after:string>>"
    every = F.concat(*(blocks(m) for m in lengths)) if lengths else F.array().cast(empty)
    d = d.select("doc_id", "text_hash", "n_words", F.posexplode_outer(every).alias("at", "x"))
    d = d.select("doc_id", "text_hash", "n_words", F.coalesce("at", F.lit(0)).alias("at"), "x.*")
    small = small_broadcast(grams, size=1 + F.octet_length("gram") / 40)
    if small is grams:
        hashed = F.xxhash64("m", "gram")
        d = may_hold(d, hashed, bit_map(grams, hashed, ("place", "bits")), "maybe").where("maybe or at = 0").drop("maybe")
    found = d.join(small.withColumn("found", F.lit(True)), ["m", "gram"], "left")
    found = found.where("found or at = 0")
    # Windows of m words around a found block; the block is the first whole one of each such window.
    size = F.floor((F.col("m") + 1) / 2).cast("int")
    found = found.withColumns(
        {
            "around": _words(F.concat(F.coalesce("before", F.lit("")), "gram", F.coalesce("after", F.lit("")))),
            "own": F.when(F.col("before").isNull(), 0).otherwise(size),
            "size": size,
        }
    )
    starts = F.filter(
        F.sequence(F.col("own") - F.col("size") + 1, F.col("own")), lambda s: (s >= 0) & (s + F.col("m") <= F.size("around"))
    )
    near = F.when(
        F.col("found"),
        F.transform(
            starts,
            lambda s: F.struct(
                (F.col("j") * F.col("size") - F.col("own") + s).cast(_LONG).alias("start"),
                F.concat(F.array_join(F.slice("around", s + 1, F.col("m")), " "), F.lit(" ")).alias("win"),
            ),
        ),
    )
    found = found.select("doc_id", "text_hash", "n_words", "at", "m", F.posexplode_outer(near).alias("nth", "w"))
    found = found.select(
        "doc_id", "text_hash", "n_words", "m", "w.start", "w.win", ((F.col("at") == 0) & (F.coalesce("nth", F.lit(0)) == 0)).alias("head")
    )
    found = found.join(small_broadcast(wins, size=1 + (F.octet_length("win") + 12 * F.size("items")) / 40), ["m", "win"], "left").where("head or items is not null")
    hit = F.when(F.col("items").isNotNull(), F.struct("start", F.col("m").cast(_LONG).alias("words")))
    per = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum(F.col("head").cast("int")).alias("rows"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast(_LONG).alias("end"), F.lit(0).cast(_LONG).alias("total"))
    n_hit = F.aggregate(
        "hits",
        zero,
        lambda a, h: F.struct(
            F.greatest(a["end"], h["start"] + h["words"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0).cast(_LONG), h["start"] + h["words"] - F.greatest(a["end"], h["start"]))).alias("total"),
        ),
        lambda a: a["total"],
    )
    per = per.withColumn("n_hit", n_hit)
    # A row that was given n times comes back n times.
    per = per.withColumn("nth", F.explode(F.sequence(F.lit(1).cast(_LONG), F.col("rows"))))
    return per.select("doc_id", "text_hash", "n_words", "hits", "n_hit", "items")


def contaminated() -> Column:
    """Of the columns of contamination(): hit words are a twentieth of all or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_hits(text: Column, hits: Column) -> Column:
    """text without the words that hits(start, words) cover; each goes with the signs after it, the others stay as they are."""
    sign = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
    words = F.regexp_extract_all(text, F.lit(rf"[^{sign}]++[{sign}]*+"), F.lit(0))
    gone = F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["words"] - 1)))

    def kept(w: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0).cast(_LONG), F.size(w).cast(_LONG) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(w, i.cast("int"))), "")

    return F.concat(F.regexp_extract(text, rf"^[{sign}]*+", 0), let(words, kept))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated rows, and without the hit words of the others.

    All columns are kept, and rows with null ids or texts stay. Where words that a cut brings together are hits again, they are cut
    too. Repeated rows are treated alike; an empty table, or one without items, comes back as it is.
    """
    tmp = Scratch()
    bench = _benchmark(benchmark, window, tmp)
    (name,) = fresh(docs, "found")

    def looked_up(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = _contamination(rows, bench).where("n_hit > 0").select("doc_id", "text_hash", contaminated().alias("bad"), "hits")
        found = written(found.groupBy("doc_id", "text_hash").agg(F.first("bad").alias("bad"), F.first("hits").alias("hits")), "hits")
        return found, joined_back(rows, found, name)

    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(without_hits(F.col("text").cast("string"), F.col(f"{name}.hits")))
    cut = lambda rows: rows.select(*(text.alias("text") if c == "text" else col for c, col in zip(docs.columns, own(docs))))
    _, rows = looked_up(docs)
    clean = rows.where(F.col(name).isNull()).select(*own(docs))
    rest = written(cut(rows.where(~F.col(f"{name}.bad"))), "cut")
    while True:
        found, rows = looked_up(rest)
        if found.isEmpty():
            break
        rest = written(cut(rows), "cut")
    tmp.drop()
    return clean.unionByName(rest)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast(_LONG).alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i + 1 : i + m], ' ') AS win
  FROM (SELECT *, least(len(w), 13) AS m, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, m, i, array_to_string(w[i + 1 : i + m], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT r, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
