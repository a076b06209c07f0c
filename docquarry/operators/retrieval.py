"""Batch retrieval: BM25 over all live chunks, exact inner products, reciprocal-rank fusion, reranking.

Every step answers a whole table of questions. Ranks are by scores rounded to PLACES decimals, so that the
order of summation can't flip ties, then by corpus order. Questions go to the chunks, in blocks of bounded size: each task scores
its own chunks and keeps the best of each question, so that only positions and scores of these are shuffled, never pairs of questions and
chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.durable import BROADCAST_ROWS, small_batches, small_broadcast, spread, written
from docquarry.functions.models import overlap_scorer, scoring
from docquarry.functions.tokenizers import Tokenizer, regex_tokenizer

#: Fixed values of BM25 and of the fusion; PLACES is the package's own.
K1, B, EPSILON, PLACES, RRF = 1.5, 0.75, 0.25, 9, 60
#: Questions of a block, about, and chunks that a task scores at once.
QUERIES, CHUNKS = 1024, 1024


def live(chunks: DataFrame) -> DataFrame:
    return chunks.where(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in chunks.columns else chunks


@dataclass(frozen=True)
class Bm25Index:
    chunks: DataFrame  # chunk_pos, dl, terms: array of (term, tf)
    terms: DataFrame  # term, df, idf
    stats: DataFrame  # n, avgdl, avg_idf
    tokenizer: Tokenizer

    def save(self, path: str) -> None:
        for name in ("chunks", "terms", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str, tokenizer: Tokenizer) -> Bm25Index:
        return Bm25Index(*(spark.read.parquet(f"{path}/{n}") for n in ("chunks", "terms", "stats")), tokenizer)


def bm25_index(chunks: DataFrame, tokenizer: Tokenizer | None = None) -> Bm25Index:
    """Statistics of the live chunks(chunk_pos, content); texts are read and cut into terms once, and nothing but term counts is shuffled."""
    tokenizer = tokenizer or regex_tokenizer()
    rows = spread(live(chunks)).select("chunk_pos", F.sort_array(tokenizer(F.coalesce("content", F.lit("")))).alias("ts"))

    def counted(ts: Column) -> Column:
        """Runs of equal terms, of sorted ones."""
        starts = F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: (i == 1) | (F.get(ts, i - 1) != F.get(ts, i - 2)))
        tf = lambda ss: F.transform(ss, lambda i, k: F.struct(F.get(ts, i - 1).alias("term"), (F.coalesce(F.get(ss, k + 1), F.size(ts) + 1) - i).alias("tf")))
        return F.transform(F.array(starts), tf)[0]

    terms = F.when(F.size("ts") > 0, F.transform(F.array("ts"), counted)[0]).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))
    with small_batches(chunks.sparkSession):  # for tokenizers in Python
        index = written(rows.select("chunk_pos", F.size("ts").alias("dl"), terms.alias("terms")), "index")
    size = index.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = index.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(size.select("n")))
    raw = written(raw.withColumn("raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    mean = raw.agg(F.avg("raw_idf").alias("avg_idf"))
    stats = size.join(F.broadcast(mean))
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw_idf") < 0, EPSILON * F.col("avg_idf")).otherwise(F.col("raw_idf")).alias("idf"))
    return Bm25Index(index, terms, stats, tokenizer)


def ranked(rows: DataFrame, k: int, by: str = "query_id", tie: str = "chunk_pos") -> DataFrame:
    """The first k rows of each question by score, with rank from 1."""
    order = W.partitionBy(by).orderBy(F.round("score", PLACES).desc(), F.col(tie).asc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Best:
    """The best k of each question among the chunks that a task has seen: by rounded score, then by position."""

    def __init__(self, questions: int, k: int) -> None:
        self.k, self.score, self.pos = k, np.zeros((questions, 0)), np.zeros((questions, 0), np.int64)

    def add(self, score: np.ndarray, pos: np.ndarray) -> None:
        """score: (questions, chunks)."""
        order = np.argsort(pos, kind="stable")
        score, pos = score[:, order], pos[order]
        top = np.argsort(-np.round(score, PLACES), axis=1, kind="stable")[:, : self.k]
        score, pos = np.hstack((self.score, np.take_along_axis(score, top, 1))), np.hstack((self.pos, pos[top]))
        top = np.lexsort((pos, -np.round(score, PLACES)), axis=1)[:, : self.k]
        self.score, self.pos = np.take_along_axis(score, top, 1), np.take_along_axis(pos, top, 1)

    def rows(self) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(self.score)), self.score.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(self.pos.ravel()), pa.array(self.score.ravel())], ["at", "chunk_pos", "score"])


def _in_blocks(queries: DataFrame, size: int, answer, k: int) -> DataFrame:
    """(query_id, rank, chunk_pos, score) of answer(rows of a block), which gives (at, chunk_pos, score), for all questions.

    A block holds the questions whose hash leaves one remainder, and is all that the driver holds of them.
    """
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    queries = written(queries, "questions")
    blocks = max(1, -(-queries.count() // size))
    out = None
    for n in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect() if blocks > 1 else queries.collect()
        if asked:
            names = spark.createDataFrame(list(enumerate(dict.fromkeys(q.query_id for q in asked))), f"at long, query_id {kind}")
            with small_batches(spark):
                best = written(answer(asked), "best")  # k rows a question and task
            part = best.join(F.broadcast(names), "at").select("query_id", "chunk_pos", "score")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"query_id {kind}, chunk_pos long, score double")
    return ranked(out, k).select("query_id", "rank", "chunk_pos", "score")


def bm25_top_k(index: Bm25Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, chunk_pos, score) over all live chunks of queries(query_id, query); those without a shared term score 0, in corpus order.

    Question ids are distinct; a null question has no terms.
    """
    asked = queries.select("query_id", index.tokenizer(F.coalesce("query", F.lit(""))).alias("ts")).select("query_id", F.posexplode_outer("ts").alias("at", "term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("times")).join(index.terms, "term", "left")
    weights = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("weight"))).alias("weights"))
    spark = queries.sparkSession
    avgdl = index.stats.first()["avgdl"]
    rows = index.chunks.select("chunk_pos", "dl", F.col("terms.term").alias("terms"), F.col("terms.tf").alias("tf"))

    def answer(questions: list) -> DataFrame:
        known = sorted({w.term for q in questions for w in q.weights if w.weight is not None})
        number = {t: i for i, t in enumerate(known)}
        weight = np.zeros((len(known), len(questions)))
        for at, q in enumerate(questions):
            for w in q.weights:
                if w.weight is not None:
                    weight[number[w.term], at] = w.weight
        shared = spark.sparkContext.broadcast((known, weight))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, weight = shared.value
            best, names = _Best(weight.shape[1], k), pa.array(known, pa.string())
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNKS):
                    b = whole.slice(at, CHUNKS)
                    ids = pc.index_in(b.column(2).flatten(), value_set=names)
                    here = pc.is_valid(ids).to_numpy(zero_copy_only=False)
                    row = pc.list_parent_indices(b.column(2)).to_numpy()[here]
                    ids, tf = ids.drop_null().to_numpy(), b.column(3).flatten().to_numpy()[here]
                    norm = K1 * (1 - B + B * b.column(1).to_numpy() / avgdl) if avgdl else np.zeros(b.num_rows)
                    part = tf * (K1 + 1) / (tf + norm[row])
                    score, ends = np.zeros((weight.shape[1], b.num_rows)), np.searchsorted(row, np.arange(b.num_rows + 1))
                    for i in np.unique(row):
                        own = slice(ends[i], ends[i + 1])
                        score[:, i] = part[own] @ weight[ids[own]]
                    best.add(score, b.column(0).to_numpy())
            yield best.rows()

        return rows.select(F.col("chunk_pos").cast("long"), "dl", "terms", "tf").mapInArrow(scored, "at long, chunk_pos long, score double")

    return _in_blocks(weights, QUERIES, answer, k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, chunk_pos, score): exact inner products of vectors(chunk_pos, embedding) and queries(query_id, embedding).

    Products are in double precision. Questions without a vector have no results; vectors of another length than the
    questions' are an error; an empty index gives an empty result.
    """
    vectors = vectors.select(F.col("chunk_pos").cast("long"), F.col("embedding").cast("array<double>"))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>")).where("embedding is not null")
    lengths = [r[0] for r in asked.select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("question vectors differ in length")
    dim = lengths[0] if lengths else 0

    def answer(questions: list) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(np.array([q.embedding for q in questions]))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(shared.value), k)
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNKS):
                    b = whole.slice(at, CHUNKS)
                    flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
                    if len(flat) != dim * b.num_rows:
                        raise ValueError(f"the index holds vectors of another length than {dim}")
                    best.add(shared.value @ flat.reshape(-1, dim).T, b.column(0).to_numpy())
            yield best.rows()

        return vectors.mapInArrow(scored, "at long, chunk_pos long, score double")

    return _in_blocks(asked, QUERIES, answer, k)


def holding(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, chunk_pos): chunks(chunk_pos, content) that hold the text of items(query_id, query) verbatim.

    Words within an item are whole words of a chunk that holds it: chunks are looked up by the second to fourth word of an item, and what
    is found is compared as a whole. Only items of fewer than five words are compared with every chunk.
    """
    words = lambda c: F.split(F.col(c), " ")
    items = written(items.select("query_id", "query").where("query is not null"), "items")
    long, size = F.size(words("query")) >= 5, 1 + F.octet_length("query") / 40
    keyed = items.where(long).withColumn("key", F.xxhash64(*(F.get(words("query"), F.lit(i)) for i in (1, 2, 3))))
    rows = chunks.select("chunk_pos", "content")
    # A row a place that holds three words, without a list of them, which would be made for each place by an interpreted function.
    places = spread(rows).select("chunk_pos", "content", words("content").alias("ws")).where(F.size("ws") >= 3)
    places = places.select("chunk_pos", "content", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - 3)).alias("i"))
    key = F.xxhash64(*(F.get("ws", F.col("i") + k) for k in (0, 1, 2))).alias("key")
    if (keyed.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_ROWS:
        # Items are compared where their chunk is read, and no text is shuffled.
        found = places.select("chunk_pos", "content", key).join(F.broadcast(keyed), "key").where(F.contains("content", "query")).select("query_id", "chunk_pos").distinct()
    else:
        found = places.select("chunk_pos", key).distinct().join(keyed, "key").join(rows, "chunk_pos").where(F.contains("content", "query")).select("query_id", "chunk_pos")
    few = small_broadcast(items.where(~long), size=size)
    return found.unionByName(rows.join(few, F.contains(F.col("content"), F.col("query"))).select("query_id", "chunk_pos"))


def fuse(lists: list[DataFrame], k: int = 10, constant: int = RRF) -> DataFrame:
    """(query_id, rank, chunk_pos, score): reciprocal-rank fusion of lists(query_id, rank, chunk_pos).

    A chunk counts once in a list, with its first rank, and ranks aren't closed up. Ties go to what came first, in list order.
    """
    if k > 0 and constant < 0:
        raise ValueError("the constant must not be negative")
    rows = None
    for n, part in enumerate(lists):
        part = part.groupBy("query_id", "chunk_pos").agg(F.min("rank").alias("rank")).withColumn("list_no", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "chunk_pos").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("came"))
    return ranked(fused, max(k, 0), tie="came").select("query_id", "rank", "chunk_pos", "score")


def with_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with their chunks' columns; positions outside the table are dropped."""
    return results.join(chunks, "chunk_pos")


def rerank(results: DataFrame, queries: DataFrame, contents: DataFrame, k: int = 10, scorer=overlap_scorer) -> DataFrame:
    """(query_id, rank, chunk_pos, score, fusion_score): candidates in order of a scorer's score, ties in incoming order."""
    rows = results.join(queries.select("query_id", "query"), "query_id").join(contents.select("chunk_pos", "content"), "chunk_pos")
    scored = rows.select("query_id", "chunk_pos", F.col("score").alias("fusion_score"), F.col("rank").alias("came"), scoring(scorer)(F.col("query"), F.col("content")).alias("score"))
    return ranked(scored, max(k, 0), tie="came").select("query_id", "rank", "chunk_pos", "score", "fusion_score")


def embedded(chunks: DataFrame, embed, model: str, version: str | None, dimension: int) -> DataFrame:
    """chunks with embedding and the model's name, version and dimension."""
    out = chunks.withColumn("embedding", embed(F.col("content")))
    return out.withColumns({"embedding_model": F.lit(model), "embedding_model_version": F.lit(version).cast("string"), "embedding_dimension": F.lit(dimension)})
