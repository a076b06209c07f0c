"""Answers as a sequence of events, and questions that arrive on a stream."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.functions.models import extractive_generator
from docquarry.plans import rag


def events(corpus: rag.Corpus, question: str, generator=extractive_generator, depth: rag.Depth = rag.Depth()) -> Iterator[dict]:
    """sources, then a token event for each piece, then metrics and done, for one question."""
    if not question.strip():
        raise ValueError("question must not be empty")
    spark = corpus.chunks.sparkSession
    began = time.monotonic()
    asked = spark.createDataFrame([(0, question)], "query_id long, query string")
    results = rag.hybrid(corpus, asked, depth)
    found = rag.contexts(corpus, results).collect()  # one row
    context, sources = (found[0].context, [s.asDict() for s in found[0].sources]) if found else ("", [])
    retrieved = time.monotonic()
    yield {"type": "sources", "sources": sources, "chunk_count": len(sources), "context_chars": len(context)}
    first = None
    for piece in generator()(question, context):
        if piece:
            first = first or time.monotonic()
            yield {"type": "token", "content": piece}
    ended = time.monotonic()
    yield {
        "type": "metrics",
        "retrieval_seconds": round(retrieved - began, 3),
        "first_token_seconds": round(first - retrieved, 3) if first else None,
        "generation_seconds": round(ended - retrieved, 3),
        "pipeline_seconds": round(ended - began, 3),
    }
    yield {"type": "done"}


def framed(stream: Iterator[dict]) -> Iterator[str]:
    """Events as server-sent frames; what fails ends the stream with an error event."""
    try:
        for e in stream:
            yield f"data: {json.dumps(e, ensure_ascii=False)}\n\n"
    except Exception as e:  # noqa: BLE001 - the client is told, whatever it is
        yield f"data: {json.dumps({'type': 'error', 'message': str(e)}, ensure_ascii=False)}\n\n"


def answer_stream(corpus: rag.Corpus, questions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch of a streaming questions(query_id, query) against the static corpus."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(rag.answer_questions(corpus, df), epoch)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_counts(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and type, with a watermark; beyond what batch retrieval needs."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
