"""Chapters of a document's text, their file names, and the records that chapter files stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.durable import with_position
from docquarry.functions import text as T


def chapters(texts: DataFrame) -> DataFrame:
    """(document, chapter_no, title, content) from (document, text).

    A numbered line of one or two parts, or an appendix line, opens a chapter and is its first line; what stands before the
    first of them is dropped, and so are blank lines.
    """
    lines = texts.select("document", F.posexplode(T.stripped_lines("text")).alias("pos", "line")).where("line <> ''")
    lines = lines.withColumn("kind", T.chapter_title_kind("line"))
    order = W.partitionBy("document").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("chapter_no", F.count("kind").over(order).cast("int")).where("chapter_no > 0")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    out = lines.groupBy("document", "chapter_no").agg(ordered.alias("ls"))
    return out.select("document", "chapter_no", F.col("ls")[0]["line"].alias("title"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


def file_name(number: Column, title: Column) -> Column:
    """NNN_number_title.txt, NNN_附录_letter_title.txt or NNN_unknown.txt."""
    index = F.format_string("%03d", number)
    p = r"(?U)^(\d+(?:\.\d+)?)\s+(.+)$"
    letter = F.regexp_extract(title, r"(?U)^附录\s+([A-Z])", 1)
    numbered = F.concat_ws("_", index, F.regexp_extract(title, p, 1), T.safe_filename(F.regexp_extract(title, p, 2)))
    appendix = F.concat_ws("_", index, F.lit("附录"), letter, T.safe_filename(title))
    return F.concat(F.when(title.rlike(p), numbered).when(letter != "", appendix).otherwise(F.concat(index, F.lit("_unknown"))), F.lit(".txt"))


def structured_chunks(files: DataFrame) -> DataFrame:
    """Chunk records from (document, file, content): ids from the file's name, hash of the content, position in the corpus."""
    stem = F.regexp_replace("file", r"\.txt$", "")
    p = r"(?Us)^(\d+)_(.+?)_(.+)$"
    fits = F.col("stem").rlike(p)
    part = lambda i: F.regexp_extract("stem", p, i)
    rows = files.withColumns({"stem": stem, "content": T.utrim("content"), "document_id": T.slug("document")}).where("content <> ''")
    rows = rows.withColumns(
        {
            "chunk_id": F.when(fits, F.concat_ws("_", "document_id", part(1), part(2))).otherwise(F.concat_ws("_", "document_id", "stem")),
            "chapter": F.when(fits, part(2)).otherwise(""),
            "title": F.when(fits, T.clean_title(part(3))).otherwise(F.col("stem")),
            "level": F.when(fits, T.level_of_number(part(2))).otherwise(0),
        }
    )
    rows = with_position(rows, ["document", "file"], "chunk_pos")
    return rows.select(
        "chunk_pos", "chunk_id", "document_id", "document", F.concat("document", F.lit(".pdf")).alias("source"),
        T.version_of("document").alias("version"), "chapter", "title", F.col("level").cast("int").alias("level"), F.col("title").alias("parent_path"),
        "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), F.lit(False).alias("is_deleted"),
    )


def split_documents(texts: DataFrame) -> DataFrame:
    """Chunk records straight from (document, text), as through chapter files."""
    files = chapters(texts).select("document", file_name(F.col("chapter_no"), F.col("title")).alias("file"), "content")
    return structured_chunks(files)
