"""Whole plans: hybrid retrieval, answering, and the offline build."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.durable import written
from docquarry.functions.models import embedding, extractive_generator, hashed_embedder, overlap_scorer
from docquarry.functions.text import utrim
from docquarry.functions.tokenizers import Tokenizer
from docquarry.operators import chapters, chunking, context, evaluation, layout, retrieval


@dataclass(frozen=True)
class Depth:
    """How many candidates of each list, of the fusion, and of the result."""

    candidates: int = 25
    fusion: int = 10
    top: int = 10


#: What evaluation runs use; recall at 10 then sees five results.
EVALUATION = Depth(top=5)


@dataclass(frozen=True)
class Corpus:
    """chunks has chunk_pos, chunk_id, document, chapter, title, content and embedding."""

    chunks: DataFrame
    bm25: retrieval.Bm25Index
    embed: Callable[[Column], Column]


def hybrid(corpus: Corpus, queries: DataFrame, depth: Depth = Depth(), scorer=overlap_scorer) -> DataFrame:
    """(query_id, rank, chunk_pos, score, fusion_score): BM25 and vector candidates, fused, then reranked.

    queries(query_id, query) may bring its own embedding column. The cheap lists are cut before anything in Python runs.
    """
    asked = queries if "embedding" in queries.columns else queries.withColumn("embedding", corpus.embed(F.col("query")))
    lexical = retrieval.bm25_top_k(corpus.bm25, queries, depth.candidates)
    near = retrieval.vector_top_k(corpus.chunks.where("embedding is not null"), asked, depth.candidates)  # questions without a vector: lexical only
    fused = retrieval.fuse([lexical, near], depth.fusion)
    return retrieval.rerank(fused, queries, corpus.chunks, depth.top, scorer)


def contexts(corpus: Corpus, results: DataFrame, limits: context.Limits = context.Limits()) -> DataFrame:
    cited = corpus.chunks.select("chunk_pos", "chunk_id", "document", "chapter", "title", "content")
    return context.build_context(retrieval.with_chunks(results, cited), limits)


def answers(questions: DataFrame, contexts_: DataFrame, generator: Callable[[], Callable] = extractive_generator) -> DataFrame:
    """(query_id, query, answer, sources, retrieval): a generator's pieces joined; empty pieces are left out."""
    blank = utrim(F.coalesce("query", F.lit(""))) == ""
    query = F.when(blank, F.raise_error(F.lit("question must not be empty"))).otherwise(F.col("query"))
    rows = questions.select("query_id", query.alias("query")).join(contexts_, "query_id", "left")

    def generate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = generator()
        for qs, cs in batches:
            yield pd.Series(["".join(p for p in model(q, c or "") if p) for q, c in zip(qs, cs)], dtype=object)

    answer = F.pandas_udf(generate, "string")
    return rows.select(
        "query_id", "query", answer("query", "context").alias("answer"), "sources",
        F.struct(F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("context_chars", F.lit(0)).alias("context_chars")).alias("retrieval"),
    )


def answer_questions(corpus: Corpus, questions: DataFrame, depth: Depth = Depth(), limits: context.Limits = context.Limits(), scorer=overlap_scorer, generator=extractive_generator) -> DataFrame:
    return answers(questions, contexts(corpus, hybrid(corpus, questions, depth, scorer), limits), generator)


def evaluate(corpus: Corpus, items: DataFrame, depth: Depth = EVALUATION, scorer=overlap_scorer) -> DataFrame:
    """per_query() metrics of items(id, query, expected_documents, expected_chunks, category, difficulty)."""
    items = items.withColumnRenamed("id", "query_id")
    asked = items.select("query_id", "query", *(["embedding"] if "embedding" in items.columns else []))
    found = retrieval.with_chunks(hybrid(corpus, asked, depth, scorer), corpus.chunks.select("chunk_pos", "chunk_id", "document"))
    return evaluation.per_query(items, found)


def corpus_of(chunks: DataFrame, tokenizer: Tokenizer | None = None, embedder=None, dimension: int = 64, model: str = "hashed-words") -> Corpus:
    """Embeds chunks(chunk_pos, content, ...) and indexes them; an empty table is an error."""
    if chunks.isEmpty():
        raise ValueError("there are no chunks to index")
    embed = embedding(embedder or hashed_embedder(dimension))
    done = written(retrieval.embedded(chunks, embed, model, None, dimension), "chunks")
    return Corpus(done, retrieval.bm25_index(done, tokenizer), embed)


def build(words: DataFrame, budget: chunking.Budget = chunking.Budget(), tokenizer=chunking.PieceTokenizer, **options) -> Corpus:
    """From positioned words to an indexed corpus of retrieval chunks."""
    structured = chapters.split_documents(written(layout.parse(words), "texts"))
    return build_from_chunks(structured, budget, tokenizer, **options)


def build_from_chunks(structured: DataFrame, budget: chunking.Budget = chunking.Budget(), tokenizer=chunking.PieceTokenizer, **options) -> Corpus:
    from docquarry.durable import with_position

    pieces = chunking.retrieval_chunks(structured, budget, tokenizer).withColumnRenamed("chunk_pos", "source_pos")
    return corpus_of(with_position(pieces.drop("error"), ["source_pos", "piece"], "chunk_pos"), **options)
