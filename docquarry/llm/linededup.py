r"""Line dedup by winnowing, with DataFrame functions only.

Texts are cut at ``\n``; lines without a word never count. A window is the shortest run of following lines
from a line on that has MIN_WORDS words, or of preceding lines up to it; of each forward window the line with
the smallest hash is selected as fingerprint, so any run of MIN_WORDS words that occurs twice shares a
fingerprint. Positions whose fingerprint occurs elsewhere too are the matches, joined back to their texts. From each
match it is extended both ways: a match reaches over every forward and backward window that contains it, each told by a hash of
128 bits and compared with its first occurrence, by doc_id and position; windows that follow each other carry
the match on. (Extending line by line against one partner would lose longer matches with others, and against all partners would
make pairs.) Windows that occur later are deleted with all their lines; their union is every line of every run of
MIN_WORDS words or more that has an earlier occurrence.

All steps within a text are linear in its lines, for MIN_WORDS as a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import WORD, Scratch, fresh, joined_back, let, own, table, text_hash, written

MIN_WORDS = 50
_LOW = (1 << 31) - 1


def _ends(words: Column, min_words: int) -> Column:
    """Of word counts: the last place of the forward window from each place on (from 1), as long as there is one."""

    def end(_: Column, i: Column) -> Column:
        # Words so far in the lower half, lines so far in the upper one.
        low = lambda a: a.bitwiseAND(F.lit((1 << 32) - 1))
        reach = F.aggregate(
            F.slice(words, i + 1, min_words), F.lit(0).cast("long"), lambda a, x: F.when(low(a) >= min_words, a).otherwise(a + x + F.lit(1 << 32))
        )
        return let(reach, lambda r: F.when(low(r) >= min_words, i + F.shiftright(r, 32).cast("int")))

    return F.array_compact(F.transform(words, end))


def _minima(hashes: Column, ends: Column) -> Column:
    """The place of the smallest hash of each forward window, the last of equals."""
    # Compared by their upper halves; the place goes into the lower one.
    keys = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.lit(_LOW) - i.cast("long")))
    least = lambda ks: F.transform(ends, lambda b, i: F.array_min(F.slice(ks, i + 1, b - i)))
    return F.transform(let(keys, least), lambda k: (F.lit(_LOW) - k.bitwiseAND(F.lit(_LOW))).cast("int") + 1)


def _upto(places: Column, n: Column) -> Column:
    """Of ascending places: for each of 1 to n, how many of them lie at or before it."""
    runs = F.flatten(F.transform(places, lambda x, k: F.array_repeat(k + 1, F.coalesce(F.get(places, k + 1), n + 1) - x)))
    return F.concat(F.array_repeat(F.lit(0), F.coalesce(F.get(places, F.lit(0)), n + 1) - 1), runs)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, removed): indices, from 0, of the lines to delete; a row for each text that has some.

    Occurrences are ordered by doc_id (null last), then a hash of the text, then position. Rows that agree in doc_id and text
    are one document. Null and empty texts have no lines that count; an empty table gives an empty result.
    """
    tmp = Scratch()
    lines = F.filter(
        F.transform(
            F.split(F.col("text").cast("string"), "\n"),
            lambda x, i: F.struct(
                i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit("line"), x).alias("g"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words")
            ),
        ),
        lambda x: x["words"] > 0,
    )
    arrays = let(lines, lambda x: F.struct(*(x[c].alias(c) for c in ("i", "h", "g", "words"))))
    windows = lambda x: let(_ends(x["words"], min_words), lambda e: F.struct(e.alias("ends"), _minima(x["h"], e).alias("minima")))
    base = docs.select("doc_id", text_hash().alias("text_hash"), let(arrays, lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"), x["g"].alias("g"), windows(x).alias("w"))).alias("x"))
    base = base.select("doc_id", "text_hash", "x.i", "x.h", "x.g", "x.w.ends", "x.w.minima").where(F.size("ends") > 0)
    base = tmp(base, "lines")

    prints = base.select("doc_id", "text_hash", "h", F.explode(F.array_distinct("minima")).alias("at"))
    prints = prints.select("doc_id", "text_hash", "at", F.element_at("h", F.col("at")).alias("h"))
    where = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "at")
    twice = tmp(prints.groupBy("h").agg(F.min(where).alias("least"), F.max(where).alias("most")).where("least <> most").select("h"), "twice")
    matched = prints.join(twice, "h").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("matched"))
    near = joined_back(base, tmp(matched, "matched"), "m", F.col("text_hash")).where("m is not null")

    def touched(x: Column) -> Column:
        """Structs of first and last place of the windows to compare; x: upto of the matches, starts."""
        upto = lambda i: F.coalesce(F.get(x["upto"], i - 1), F.lit(0))
        # A forward window's minimum is a selected fingerprint of its text; a backward one's need not be, so there any match inside counts.
        ahead = F.transform("ends", lambda b, i: let(F.get("minima", i), lambda m: F.when(upto(m) > upto(m - 1), F.struct((i + 1).alias("a"), b.alias("b")))))
        behind = F.transform(x["starts"], lambda a, i: F.when((a > 0) & (F.get("ends", a - 1) != i + 1) & (upto(i + 1) > upto(a - 1)), F.struct(a.alias("a"), (i + 1).alias("b"))))
        return F.array_compact(F.concat(ahead, behind))

    # The backward window up to a place starts where the last forward window that ends there or before does.
    counts = F.struct(_upto(F.col("m.matched"), F.size("h")).alias("upto"), _upto(F.col("ends"), F.size("h")).alias("starts"))
    near = near.select("doc_id", "text_hash", "i", "h", "g", F.explode(let(counts, touched)).alias("w"))
    part = lambda c: F.xxhash64(F.slice(c, F.col("w.a"), F.col("w.b") - F.col("w.a") + 1))
    runs = near.select(
        "doc_id", "text_hash", F.element_at("i", F.col("w.a")).alias("first"), F.element_at("i", F.col("w.b")).alias("last"), part("h").alias("h"), part("g").alias("g")
    )
    runs = tmp(runs.withColumn("at", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "first")), "runs")
    firsts = runs.groupBy("h", "g").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least <> most").drop("most")
    # Written first, so that both sides are plain exchanges, of which Spark splits that of a frequent run.
    later = runs.join(tmp(firsts, "firsts"), ["h", "g"]).where("least < at")
    gone = later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))

    def lines_of(runs: Column) -> Column:
        """Sorted by first place, windows are sorted by last place too; each adds what the one before doesn't hold."""
        start = lambda x, k: F.greatest(x["first"], F.coalesce(F.get(runs, k - 1)["last"] + 1, x["first"]))
        return F.flatten(F.transform(runs, lambda x, k: F.when(start(x, k) <= x["last"], F.sequence(start(x, k), x["last"])).otherwise(F.array().cast("array<int>"))))

    out = written(gone.select("doc_id", "text_hash", let(F.col("runs"), lines_of).alias("removed")), "removed")
    tmp.drop()
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less its later repeated lines, and n_lines and n_removed in the struct column _lines.

    All rows and columns stay, but for a column _lines, which is replaced; a null text stays null with no lines, and an empty one
    has one line. Rows that agree in doc_id and text, null ones too, lose the same lines. An empty table gives an empty result.
    """
    docs = docs.select(*own(docs, "_lines"))
    (name,) = fresh(docs, "gone")
    out = joined_back(docs, repeated_lines(docs, min_words), name)
    text, removed = F.col("text").cast("string"), F.col(f"{name}.removed")

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    count = F.struct(
        F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.when(F.col(name).isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed")
    )
    cut = F.when(F.col(name).isNull(), text).otherwise(let(F.split(text, "\n"), left))
    columns = zip(docs.columns, own(docs))
    return out.select(*(cut.alias("text") if c == "text" else col for c, col in columns), count.alias("_lines"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "_lines.n_lines", "_lines.n_removed", "text")


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS i, s[i] AS line, len(regexp_extract_all(s[i], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
n AS (SELECT *, row_number() OVER w AS r, sum(words) OVER w AS upto FROM l WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, list(line ORDER BY r) AS ls, list(i ORDER BY r) AS ix FROM n GROUP BY doc_id),
p AS (
  SELECT a.doc_id, a.r AS x, min(b.r) AS y FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.r), b.r FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY 1, 3),
w AS (SELECT doc_id, ix[x] AS first, ix[y] AS last, array_to_string(ls[x:y], chr(10)) AS run FROM p JOIN g USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM f WHERE nth > 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed,
  CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) c ON c.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id) k ON k.doc_id = d.doc_id
"""
