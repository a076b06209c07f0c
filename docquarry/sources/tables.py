"""Sources and sinks: explicit schemas, readers, writers, and validation that tells good rows from rejects."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.durable import with_position
from docquarry.functions.text import utrim
from docquarry.operators.layout import WORDS

CHUNKS = (
    "chunk_pos long, chunk_id string, document_id string, document string, source string, version string, chapter string, title string, level int, parent_path string, "
    "content string, content_hash string, is_deleted boolean, chunk_strategy string, chunk_index int, token_count int, embedding_model string, embedding_model_version string, "
    "embedding_dimension int, page_start int, page_end int, embedding array<float>"
)
EVAL_ITEMS = "id string, query string, expected_documents array<string>, expected_chunks array<string>, expected_keywords array<string>, category string, difficulty string"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path)


def read_pdf_words(spark: SparkSession, directory: str, extract: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Words of all *.pdf below a directory, and an error per file that can't be read.

    extract takes a file's bytes and gives (page, page_height, text, x0, y0, x1, y1, block_no, line_no, word_no); it comes with a PDF
    library that this package doesn't bring. A failing file doesn't end the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(directory)
    names = ["page", "page_height", "text", "x0", "y0", "x1", "y1", "block_no", "line_no", "word_no"]

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                document, error = path.rsplit("/", 1)[-1][:-4], None
                try:
                    rows = [w for w in extract(bytes(content)) if w[2].strip()]
                except Exception as e:  # noqa: BLE001 - whatever a PDF library raises is that file's error
                    rows, error = [(None,) * len(names)], f"{type(e).__name__}: {e}"
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "document", document)
                yield out.assign(error=error)

    return files.select("path", "content").mapInPandas(words, f"{WORDS}, error string")


#: Bytes of file contents in a batch that read_chapter_files() hands on, besides a longer file, and files in it.
FILE_BYTES, FILES = 1 << 20, 1000


def read_chapter_files(spark: SparkSession, directory: str) -> DataFrame:
    """(document, file, content) of <directory>/<document>/*.txt; blank files are left out, a missing directory is an error.

    Executors list the files and read them, so all of them have to reach the directory; one task streams the names of the folders, and the driver holds
    no names at all. Only in a store that pyarrow doesn't know Spark lists the files, in the driver.
    """
    parts = F.split("path", "/")
    try:
        store, root = fs.FileSystem.from_uri(directory)
    except pa.ArrowInvalid:
        # binaryFile's path isn't percent-encoded, other than input_file_name().
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(directory)
    else:
        if store.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(directory)
        # So many tasks by number, as names are too few bytes for adaptive execution to keep them apart.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        files = spark.range(1).repartition(1).mapInArrow(_folders(directory), "path string").repartition(tasks).mapInArrow(_contents(directory), "path string, content binary")
    rows = files.select(F.element_at(parts, -2).alias("document"), F.element_at(parts, -1).alias("file"), utrim(F.decode("content", "UTF-8")).alias("content"))
    return rows.where("content <> ''")


def _folders(directory: str):
    """Paths of what lies in the directory, for mapInArrow over one row."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory)
        for b in batches:
            if not b.num_rows:
                continue
            if isinstance(store, fs.LocalFileSystem):
                with os.scandir(root) as found:
                    yield from _by(FILES, (e.path for e in found))
            else:
                yield from _by(FILES, (i.path for i in store.get_file_info(fs.FileSelector(root))))

    return names


def _by(n: int, paths: Iterator[str]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(paths, n)):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["path"])


def _contents(directory: str):
    """Paths and contents of the *.txt that are or lie below each path, for mapInArrow."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(directory)
        for b in batches:
            paths, contents, size = [], [], 0
            for top in store.get_file_info(b.column(0).to_pylist()):
                below = store.get_file_info(fs.FileSelector(top.path, recursive=True)) if top.type == fs.FileType.Directory else [top]
                for i in below:
                    if i.type == fs.FileType.File and i.path.endswith(".txt"):
                        with store.open_input_stream(i.path) as file:
                            paths.append(i.path)
                            contents.append(file.read())
                        size += len(contents[-1])
                    if size >= FILE_BYTES or len(paths) >= FILES:
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                        paths, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return read


def write_chapters(chapters: DataFrame, path: str) -> None:
    """chapters(document, file, content) as Parquet, partitioned by document."""
    chapters.write.mode("overwrite").partitionBy("document").parquet(path)


def write_chapter_files(chapters: DataFrame, directory: str) -> None:
    """A text file for each row of chapters(document, file, content), at <directory>/<document>/<file>, by the executors.

    The directory has to be one that all of them reach; a file is written under another name first, so that a task that is run again, or twice,
    leaves a whole one. / and \\ in a document's name become _.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory)
        for b in batches:
            for document, file, content in zip(*(c.to_pylist() for c in b.columns)):
                folder = f"{root}/{re.sub(r'[/\\\\]', '_', document)}"
                store.create_dir(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write((content or "").encode())
                store.move(part, f"{folder}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["files"])

    chapters.select("document", "file", "content").mapInArrow(put, "files long").agg(F.sum("files")).collect()


def read_dictionary(spark: SparkSession, path: str) -> list[str]:
    """One term per line; blank lines are left out. A dictionary is small and used by every tokenizer."""
    rows = spark.read.text(path).select(utrim("value").alias("term")).where("term <> ''")
    return [r.term for r in rows.collect()]


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_ITEMS).option("multiLine", True).json(path)


def evaluation_json(report: DataFrame, metrics: DataFrame) -> DataFrame:
    """(kind, json): a line for each group's means and for each question."""
    means = report.select(F.col("group_name").alias("kind"), F.to_json(F.struct(*report.columns)).alias("json"))
    return means.unionByName(metrics.select(F.lit("query").alias("kind"), F.to_json(F.struct(*metrics.columns)).alias("json")))


def validate_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): rejects have a column problems, an array of the fields that break a rule."""
    rules = {
        "chunk_id": F.length("chunk_id") >= 1,
        "document_id": F.length("document_id") >= 1,
        "content": F.length("content") >= 1,
        "content_hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"),
        "level": F.col("level").isNull() | F.col("level").between(0, 4),
    }
    for c in ("chunk_index", "token_count", "embedding_dimension", "page_start", "page_end"):
        if c in chunks.columns:
            rules[c] = F.col(c).isNull() | (F.col(c) >= 1)
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    checked = chunks.withColumn("problems", bad)
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


def save_index(chunks: DataFrame, path: str) -> None:
    """Chunks with their embeddings on the same row, so that vectors and chunks can't come apart."""
    chunks.write.mode("overwrite").parquet(path)


def append_index(chunks: DataFrame, path: str) -> None:
    """Further chunks to a saved index; columns are matched by name, and a column that the index lacks, or has and chunks lack, is an error."""
    saved = chunks.sparkSession.read.parquet(path).columns
    if set(saved) != set(chunks.columns):
        raise ValueError(f"the index has the columns {sorted(saved)}, not {sorted(chunks.columns)}")
    chunks.select(*saved).write.mode("append").parquet(path)


def load_index(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """The saved chunks; with a dimension, a vector of another length is an error when it is read."""
    chunks = spark.read.parquet(path)
    if dimension is None:
        return chunks
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") != dimension)
    return chunks.withColumn("embedding", F.when(wrong, F.raise_error(F.lit(f"a vector's length isn't {dimension}"))).otherwise(F.col("embedding")))


def chunks_json(chunks: DataFrame) -> DataFrame:
    """One JSON object a row, nulls included, in corpus order by chunk_pos."""
    fields = [c for c in chunks.columns if c != "embedding"]
    return chunks.select("chunk_pos", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def read_chunks_json(spark: SparkSession, path: str, vectors: int | None = None, lines: bool = False) -> DataFrame:
    """Chunks from files of a JSON array each, or of an object a line; a number of vectors that differs from that of the chunks is an error."""
    chunks = spark.read.schema(CHUNKS).option("multiLine", not lines).json(path)
    if vectors is not None and (n := chunks.count()) != vectors:
        raise ValueError(f"{n} chunks but {vectors} vectors")
    return chunks


def read_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """(vector_id, chunk_id) from a JSON array of chunk ids in vector order."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("vector_id", "chunk_id")).withColumn("vector_id", F.col("vector_id").cast("long"))


def write_metadata(chunks: DataFrame, path: str) -> None:
    """The ids in vector order, a JSON object a line with its vector_id; the executors write them."""
    with_position(chunks.select("chunk_pos", "chunk_id"), ["chunk_pos"], "vector_id").select("vector_id", "chunk_id").write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vector_id long, chunk_id string").json(path)


def metadata_json(chunks: DataFrame) -> str:
    """The ids in vector order as one JSON array, for an index of bounded size; write_metadata() has no bound."""
    ids = chunks.select("chunk_pos", "chunk_id").orderBy("chunk_pos").select("chunk_id").toLocalIterator()
    return json.dumps([r.chunk_id for r in ids], ensure_ascii=False)
