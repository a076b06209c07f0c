"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.durable import shared_dir
from docquarry.functions import text as T
from docquarry.functions.models import embedding, hashed_embedder
from docquarry.functions.tokenizers import dictionary_tokenizer
from docquarry.operators import chapters, chunking, context, evaluation, layout, retrieval
from docquarry.operators.layout import is_incomplete_heading
from docquarry.plans import rag
from docquarry.sources import tables

PLACES = 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_pos"), F.col("text").alias("content"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_pos"), "embedding")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


# --- lexical ------------------------------------------------------------------------------------------------

_STATS = r"""
c AS (SELECT doc_id AS chunk_pos, text AS content, lang, source FROM documents{live}),
tok AS (SELECT chunk_pos, unnest(regexp_extract_all(content, '[\p{{L}}\p{{N}}]+')) AS term FROM c),
post AS (SELECT term, chunk_pos, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT chunk_pos, len(regexp_extract_all(content, '[\p{{L}}\p{{N}}]+')) AS dl FROM c),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_BM25 = _STATS + r""",
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark) GROUP BY ALL),
hit AS (SELECT query_id, chunk_pos, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN idf USING (term) JOIN post USING (term) JOIN len USING (chunk_pos), st GROUP BY ALL),
every AS (SELECT item_id AS query_id, c.chunk_pos, coalesce(score, 0) AS score FROM benchmark CROSS JOIN c LEFT JOIN hit ON hit.query_id = item_id AND hit.chunk_pos = c.chunk_pos),
lex AS (SELECT query_id, chunk_pos, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_pos) AS rank FROM every)"""


def bm25_corpus_stats(spark, sf_dir):
    stats = retrieval.bm25_index(_chunks(spark, sf_dir)).stats
    return _rounded(stats.select("n", "avgdl", "avg_idf"), "avgdl", "avg_idf")


def bm25_terms(spark, sf_dir):
    return _rounded(retrieval.bm25_index(_chunks(spark, sf_dir)).terms, "idf")


def bm25_topk(spark, sf_dir):
    index = retrieval.bm25_index(_chunks(spark, sf_dir))
    return _rounded(retrieval.bm25_top_k(index, _questions(spark, sf_dir), 25), "score")


def soft_delete_filter(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    flagged = docs.select(F.col("doc_id").alias("chunk_pos"), F.col("text").alias("content"), (F.col("lang") == "en").alias("is_deleted"))
    index = retrieval.bm25_index(flagged)
    return _rounded(retrieval.bm25_top_k(index, _questions(spark, sf_dir), 10), "score")


# --- vectors ------------------------------------------------------------------------------------------------

_VEC = """
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
dot AS (SELECT query_id, vec_id AS chunk_pos, list_inner_product(q, embedding::DOUBLE[]) AS score FROM qv, embeddings),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_pos) AS rank FROM dot)"""


def _asked(spark, sf_dir):
    return _vectors(spark, sf_dir).where("chunk_pos % 100 = 0").withColumnRenamed("chunk_pos", "query_id")


def vector_topk(spark, sf_dir):
    return _rounded(retrieval.vector_top_k(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10), "score")


def vector_metadata_join(spark, sf_dir):
    found = retrieval.vector_top_k(_vectors(spark, sf_dir), _asked(spark, sf_dir), 5)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_pos"), "lang", "source")
    return _rounded(retrieval.with_chunks(found, docs), "score")


# --- fusion and rerank --------------------------------------------------------------------------------------
# The vector list of a benchmark question is that of the vector with its item_id.


def _lists(spark, sf_dir):
    index = retrieval.bm25_index(_chunks(spark, sf_dir))
    questions = _questions(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    asked = vectors.join(F.broadcast(questions.select(F.col("query_id").alias("chunk_pos"))), "chunk_pos", "left_semi").withColumnRenamed("chunk_pos", "query_id")
    return [retrieval.bm25_top_k(index, questions, 25), retrieval.vector_top_k(vectors, asked, 25)]


_FUSED = _BM25 + """,
dot AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_pos, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_pos) AS rank FROM dot),
both_ AS (SELECT query_id, chunk_pos, rank, 0 AS l FROM lex WHERE rank <= 25 UNION ALL SELECT query_id, chunk_pos, rank, 1 FROM vec WHERE rank <= 25),
rrf AS (SELECT query_id, chunk_pos, sum(1 / (60 + rank)) AS score, min(l * 1000 + rank) AS came FROM both_ GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, came) AS rank FROM rrf)"""


def rrf_fusion(spark, sf_dir):
    return _rounded(retrieval.fuse(_lists(spark, sf_dir), 10), "score")


def _length_scorer():
    """Deterministic and sayable in SQL: shorter texts first."""
    return lambda pairs: [1.0 / (1 + len(text or "")) for _, text in pairs]


def _corpus(spark, sf_dir) -> rag.Corpus:
    """Documents as chunks, with the embedding of their number where there is one."""
    docs = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_pos"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document"), F.col("lang").alias("chapter"),
        F.lit(None).cast("string").alias("title"), F.col("text").alias("content"),
    )
    chunks = docs.join(_vectors(spark, sf_dir), "chunk_pos", "left")
    return rag.Corpus(chunks, retrieval.bm25_index(docs), embedding(hashed_embedder()))


def _with_vectors(spark, sf_dir, questions):
    return questions.join(_vectors(spark, sf_dir).withColumnRenamed("chunk_pos", "query_id"), "query_id", "left")


def _hybrid(spark, sf_dir, k):
    fused = retrieval.fuse(_lists(spark, sf_dir), 10)
    return retrieval.rerank(fused, _questions(spark, sf_dir), _chunks(spark, sf_dir), k, _length_scorer)


def hybrid_topk(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir, 10), "score", "fusion_score")


def rag_hybrid(spark, sf_dir):
    """As the whole plan has it: only chunks have vectors, and a question without one goes by terms alone."""
    asked = _with_vectors(spark, sf_dir, _questions(spark, sf_dir))
    return _rounded(rag.hybrid(_corpus(spark, sf_dir), asked, rag.Depth(25, 10, 10), _length_scorer), "score", "fusion_score")


def rag_evaluate(spark, sf_dir):
    items = _eval_items(spark, sf_dir).withColumnRenamed("query_id", "id")
    items = _with_vectors(spark, sf_dir, items.join(_questions(spark, sf_dir).withColumnRenamed("query_id", "id"), "id").withColumnRenamed("id", "query_id"))
    out = rag.evaluate(_corpus(spark, sf_dir), items.withColumnRenamed("query_id", "id"), rag.EVALUATION, _length_scorer)
    return _rounded(out.select("query_id", *evaluation.METRICS), *evaluation.METRICS)


_HYBRID = _FUSED + """,
re AS (SELECT query_id, chunk_pos, 1.0::DOUBLE / (1 + length(text)) AS score, f.score AS fusion_score, f.rank AS came FROM fused f JOIN documents ON doc_id = chunk_pos WHERE rank <= 10),
hyb AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, came) AS rank, chunk_pos, score, fusion_score FROM re)"""

_PLAN = _HYBRID.replace("embeddings b)", "embeddings b WHERE b.vec_id IN (SELECT doc_id FROM documents))")

# --- evaluation ---------------------------------------------------------------------------------------------
# Relevant to an item are the documents that hold its text verbatim; a document's source stands for the document of a chunk.


def _eval_items(spark, sf_dir):
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    held = retrieval.holding(_chunks(spark, sf_dir), _questions(spark, sf_dir))
    pairs = held.join(docs.select(F.col("doc_id").alias("chunk_pos"), "doc_id", "source", "lang"), "chunk_pos")
    truth = pairs.groupBy("query_id").agg(
        F.collect_set("source").alias("expected_documents"), F.collect_set(F.col("doc_id").cast("string")).alias("expected_chunks"), F.min("lang").alias("category")
    )
    return items.select(F.col("item_id").alias("query_id")).join(truth, "query_id", "left").withColumn("difficulty", F.when(F.col("query_id") % 3 == 0, "easy").when(F.col("query_id") % 3 == 1, "hard"))


def _metrics(spark, sf_dir):
    index = retrieval.bm25_index(_chunks(spark, sf_dir))
    found = retrieval.bm25_top_k(index, _questions(spark, sf_dir), 10)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_pos"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document"))
    return evaluation.per_query(_eval_items(spark, sf_dir), retrieval.with_chunks(found, docs))


def eval_per_query(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir).select("query_id", "category", "difficulty", *evaluation.METRICS), *evaluation.METRICS)


def eval_overall(spark, sf_dir):
    return _rounded(evaluation.overall(_metrics(spark, sf_dir)), *evaluation.METRICS)


def eval_by_group(spark, sf_dir):
    out = evaluation.report(_metrics(spark, sf_dir), ["difficulty", "category"])
    return out


def _metric_sql() -> str:
    out = []
    for level in ("document", "chunk"):
        e, g = f"e_{level}", f"g_{level}"
        top = lambda k, g=g: f"list_distinct({g}[1:{k}])"
        for k in evaluation.CUTS:
            out.append(f"CASE WHEN len({e}) > 0 THEN len(list_intersect({top(k)}, {e})) / len({e}) ELSE 0 END AS {level}_recall_{k}")
        out.append(f"CASE WHEN len({top(5)}) > 0 THEN len(list_intersect({top(5)}, {e})) / len({top(5)}) ELSE 0 END AS {level}_precision_5")
        out.append(f"coalesce(1.0::DOUBLE / list_min([i for i in range(1, len({g}) + 1) if list_contains({e}, {g}[i])]), 0.0::DOUBLE) AS {level}_mrr")
    return ", ".join(out)


_EVAL = _BM25 + f""",
truth AS (SELECT item_id AS query_id, list(DISTINCT source) AS e_document, list(DISTINCT doc_id::VARCHAR) AS e_chunk, min(lang) AS category FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
got AS (SELECT query_id, list(source ORDER BY rank) AS g_document, list(chunk_pos::VARCHAR ORDER BY rank) AS g_chunk FROM lex JOIN c USING (chunk_pos) WHERE rank <= 10 GROUP BY query_id),
ev AS (SELECT item_id AS query_id, category, CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' END AS difficulty, coalesce(e_document, []) AS e_document, coalesce(e_chunk, []) AS e_chunk, g_document, g_chunk
  FROM benchmark LEFT JOIN truth ON truth.query_id = item_id LEFT JOIN got ON got.query_id = item_id),
m AS (SELECT query_id, category, difficulty, {_metric_sql()} FROM ev)"""
_EVAL = _EVAL.replace("{{", "{").replace("}}", "}")

# --- text and chapters --------------------------------------------------------------------------------------
# The documents have no headings; the first line of each becomes "n Title", every third line "n.k Title".


def content_hash_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def doc_slug_version(spark, sf_dir):
    name = F.concat(F.lit("GB/T+"), F.col("doc_id").cast("string"), F.lit("."), F.upper("lang"), F.lit("-"), (2000 + F.col("doc_id") % 30).cast("string"))
    number = F.array_join(F.slice(F.split(F.lit("1.2.3.4"), r"\."), 1, (F.col("doc_id") % 5).cast("int")), ".")
    docs = _table(spark, sf_dir, "documents").select("doc_id", name.alias("document"), number.alias("number"))
    return docs.select("doc_id", T.slug("document").alias("document_id"), T.version_of("document").alias("version"), T.level_of_number("number").alias("level"))


def _headed(spark, sf_dir):
    """(document, text) with derived headings."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    line = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(
            F.when(i == 0, F.concat((F.col("doc_id") % 120).cast("string"), F.lit(" ")))
            .when(i % 7 == 3, F.concat((i + 1).cast("string"), F.lit(".1 ")))
            .when(i % 7 == 5, F.concat((i + 1).cast("string"), F.lit(".1.2 ")))
            .otherwise(""),
            x,
        ),
    )
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("document"), F.array_join(line, "\n").alias("text"))


_HEADED = r"""
raw AS (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
ln AS (SELECT doc_id, i, trim(CASE WHEN i = 0 THEN (doc_id % 120) || ' ' WHEN i % 7 = 3 THEN (i + 1) || '.1 ' WHEN i % 7 = 5 THEN (i + 1) || '.1.2 ' ELSE '' END || s[i + 1]) AS line FROM raw),
lv AS (SELECT *, CASE WHEN regexp_matches(line, '^\d+\.\d+\.\d+\.\d+\s+.+$') THEN 4 WHEN regexp_matches(line, '^\d+\.\d+\.\d+\s+.+$') THEN 3 WHEN regexp_matches(line, '^\d+\.\d+\s+.+$') THEN 2
  WHEN regexp_matches(line, '^\d+\s+.+$') THEN 1 ELSE 0 END AS level FROM ln)"""
_LEVEL_COLS = ", ".join(f"last_value(CASE WHEN level = {n} THEN {{'i': i, 'line': line}} END IGNORE NULLS) OVER w AS l{n}" for n in range(1, 5))
_LIVE = ", ".join(
    f"CASE WHEN l{n}.i > greatest(-1{''.join(f', coalesce(l{m}.i, -1)' for m in range(1, n))}) THEN l{n}.line END" for n in range(1, 5)
)
_SECTIONS = _HEADED + f""",
st AS (SELECT doc_id, i, line, level, sum((level > 0)::INT) OVER w AS section_no, {_LEVEL_COLS} FROM lv WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sec AS (SELECT doc_id, section_no, i, line, list_filter([{_LIVE}], lambda x: x IS NOT NULL) AS headings FROM st WHERE level = 0)"""


def heading_levels(spark, sf_dir):
    lines = _headed(spark, sf_dir).select("doc_id", F.explode(T.stripped_lines("text")).alias("line"))
    return lines.groupBy("doc_id", T.heading_level("line").cast("int").alias("level")).agg(F.count("*").alias("lines"))


def chapter_segments(spark, sf_dir):
    out = chapters.chapters(_headed(spark, sf_dir)).withColumn("file", chapters.file_name(F.col("chapter_no"), F.col("title")))
    return out.select(F.col("document").cast("long").alias("doc_id"), "chapter_no", "file", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), F.length("content").alias("chars"))


def section_paths(spark, sf_dir):
    out = chunking.sections(_headed(spark, sf_dir))
    return out.select("doc_id", "section_no", "parent_path", F.size("headings").alias("depth"), F.size("lines").alias("n_lines"))


def paragraphs(spark, sf_dir):
    out = chunking.paragraphs(chunking.sections(_headed(spark, sf_dir)))
    return out.select("doc_id", "section_no", "paragraph_no", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def sentence_split(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.sentences("text", ".!?;。！？；").alias("s"))
    return docs.select("doc_id", F.size("s").alias("sentences"), F.sha2(F.array_join("s", "\n").cast("binary"), 256).alias("hash"))


def token_windows(spark, sf_dir):
    out = chunking.token_windows(_table(spark, sf_dir, "documents"), 600, 80)
    return out.select("doc_id", "window_no", "start", "tokens", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def normalize_text(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", T.normalize("html").alias("t"))
    return pages.select("page_id", F.length("t").alias("chars"), F.sha2(F.col("t").cast("binary"), 256).alias("hash"))


_NORMAL = r"trim(regexp_replace(html, '[\s\x0b\x1c-\x1f]+', ' ', 'g'))"
for _p, _r in (
    (r"([一-鿿])\s+([一-鿿])", r"\1\2"), (r"(\d)([一-鿿])", r"\1 \2"), (r"([一-鿿])(\d)", r"\1 \2"), (r"([A-Za-z])([一-鿿])", r"\1 \2"), (r"([一-鿿])([A-Za-z])", r"\1 \2"),
    (r"(\d)([A-Za-z])", r"\1 \2"), (r"([A-Za-z])(\d)", r"\1 \2"), (r"^((?:[A-Z]\.)?\d+(?:\.\d+){0,3})([一-鿿])", r"\1 \2"), (r"^(图[A-Z]?\d+(?:\.\d+)*)([一-鿿])", r"\1 \2"), (r" {2,}", " "),
):
    _NORMAL = f"regexp_replace({_NORMAL}, '{_p}', '{_r}', 'g')"


def _placed(spark, sf_dir):
    """Lines of documents with derived positions; every ninth line is a page number, every eleventh a standard's number."""
    docs = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text = F.when(F.col("pos") % 9 == 4, (F.col("pos") + 1).cast("string")).when(F.col("pos") % 11 == 0, "GB/T 1589—2026").otherwise(F.col("line"))
    y0 = ((F.col("pos") * 7) % 100).cast("double")
    return docs.select("doc_id", "pos", text.alias("text"), y0.alias("y0"), F.lit(100.0).alias("page_height"))


_PLACED = """
pl AS (SELECT doc_id, i AS pos, CASE WHEN i % 9 = 4 THEN (i + 1)::VARCHAR WHEN i % 11 = 0 THEN 'GB/T 1589—2026' ELSE s[i + 1] END AS text, (i * 7) % 100 AS y0
  FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)))"""


def page_number_filter(spark, sf_dir):
    return layout.without_page_numbers(_placed(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("lines"))


def footer_number_filter(spark, sf_dir):
    return layout.without_footer_numbers(_placed(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("lines"))


def header_filter(spark, sf_dir):
    return layout.without_headers(_placed(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("lines"))


def incomplete_headings(spark, sf_dir):
    lines = _headed(spark, sf_dir).select("doc_id", F.explode(T.stripped_lines("text")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(is_incomplete_heading(F.col("line"))).alias("incomplete"))


def _words(spark, sf_dir):
    """Words of documents on pages of 40 lines of 8 words."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))).alias("n", "text"))
    line, place = F.floor(F.col("n") / 8).cast("int"), F.col("n") % 8
    y0 = (line % 40 * 20).cast("double")
    return words.select(
        F.col("doc_id").cast("string").alias("document"), F.floor(line / 40).cast("int").alias("page"), F.lit(800.0).alias("page_height"), "text", (place * 50.0).alias("x0"), (y0 + place % 3).alias("y0"),
        (place * 50.0 + 40).alias("x1"), (y0 + 12).alias("y1"), F.lit(0).alias("block_no"), (line % 40).cast("int").alias("line_no"), place.cast("int").alias("word_no"),
    )


def line_grouping(spark, sf_dir):
    out = layout.block_lines(_words(spark, sf_dir))
    return out.select(F.col("document").cast("long").alias("doc_id"), "page", "line_seq", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "x0", "y0", "x1", "y1")


def visual_lines(spark, sf_dir):
    out = layout.visual_lines(_words(spark, sf_dir))
    return out.groupBy(F.col("document").cast("long").alias("doc_id"), "page").agg(F.count("*").alias("lines"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


_WORDS = r"""
wd AS (SELECT doc_id, n, w[n + 1] AS text, n // 8 AS line, n % 8 AS place FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM documents WHERE text IS NOT NULL)))"""


# A blank between words only at a change between Chinese, digits and Latin letters; twice, as a word of one sign is both sides.
_SPACED = "t"
for _ in range(2):
    for _p in (r"([A-Za-z])\x01(\d)", r"(\d)\x01([A-Za-z])", r"([㐀-䶿一-鿿])\x01([A-Za-z\d])", r"([A-Za-z\d])\x01([㐀-䶿一-鿿])"):
        _SPACED = f"regexp_replace({_SPACED}, '{_p}', '\\1 \\2', 'g')"


# --- chunks -------------------------------------------------------------------------------------------------


def _packed(spark, sf_dir):
    headed = _headed(spark, sf_dir)
    source = headed.select(F.col("doc_id").alias("chunk_pos"), F.concat(F.lit("doc_"), "document").alias("chunk_id"), F.col("document").alias("document_id"), "document", F.col("text").alias("content"), F.lit(False).alias("is_deleted"))
    return source, chunking.retrieval_chunks(source, chunking.Budget(200, 50, 40, ".!?;。！？；"), chunking.WordTokenizer, on_error="keep")


def chunk_pack(spark, sf_dir):
    return _packed(spark, sf_dir)[1].select("chunk_pos", "piece", "chunk_id", "chapter", "title", "level", "parent_path", "chunk_index", "token_count", "content_hash", "error")


def token_stats(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), F.lit(0)).alias("token_count"))
    return _rounded(chunking.token_stats(docs), "mean_tokens")


def over_limit_audit(spark, sf_dir):
    n = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), F.lit(0))
    docs = _table(spark, sf_dir, "documents").select(F.col("text").alias("content"), n.alias("token_count"))
    return chunking.audit(docs, docs, 600, 8192)


def token_offenders(spark, sf_dir):
    """Chunks without a count are counted first."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.lit(None).cast("int").alias("token_count"))
    n = F.coalesce(F.size(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), F.lit(0))
    return chunking.offenders(chunking.with_token_count(docs, n), 600, 20).select("chunk_id", "token_count")


def chunk_samples(spark, sf_dir):
    """The windows of a document stand for its pieces."""
    rows = chunking.token_windows(_table(spark, sf_dir, "documents"), 600, 80)
    rows = rows.select(F.col("doc_id").alias("chunk_pos"), F.col("window_no").alias("piece"), F.concat_ws("_", "doc_id", "window_no").alias("chunk_id"), F.col("tokens").alias("token_count"), "content")
    return chunking.samples(rows, 5, 3, 300)


def structured_chunks(spark, sf_dir):
    out = chapters.split_documents(_headed(spark, sf_dir).withColumn("document", F.concat(F.lit("GB/T "), "document", F.lit("-2024"))))
    return out.select("chunk_pos", "chunk_id", "document_id", "document", "source", "version", "chapter", "title", "level", "parent_path", "content_hash", "is_deleted")


def dictionary_terms(spark, sf_dir):
    """The vocabulary of a BM25 index whose tokenizer segments by a dictionary."""
    index = retrieval.bm25_index(_chunks(spark, sf_dir), dictionary_tokenizer(["tion", "the", "ing", "er"]))
    return _rounded(index.terms, "idf")


# --- sources and sinks: what was written is read back ----------------------------------------------------------


def _shelf(spark, name: str) -> str:
    return f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"


def _records(spark, sf_dir):
    """Chunk records of documents, with the embedding of their number."""
    docs = _table(spark, sf_dir, "documents").where("text <> ''")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_pos"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("d").alias("document_id"), F.col("source").alias("document"), F.col("text").alias("content"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit(1).alias("level"), F.lit(False).alias("is_deleted"),
    )
    return chunks.join(_vectors(spark, sf_dir), "chunk_pos", "left")


def index_roundtrip(spark, sf_dir):
    path = _shelf(spark, "saved")
    rows = _records(spark, sf_dir)
    tables.save_index(rows.where("chunk_pos % 2 = 0"), path)
    tables.append_index(rows.where("chunk_pos % 2 = 1"), path)
    out = tables.load_index(spark, path, 64 if rows.where("size(embedding) = 64").limit(1).count() else None)
    return out.select("chunk_pos", "chunk_id", "content_hash", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def chunks_json_roundtrip(spark, sf_dir):
    path = _shelf(spark, "json")
    rows = _records(spark, sf_dir).drop("embedding")
    tables.chunks_json(rows).select("json").write.text(path)
    good, _ = tables.validate_chunks(tables.read_chunks_json(spark, path, rows.count(), lines=True))
    return good.select("chunk_pos", "chunk_id", "document_id", "document", "level", "content_hash", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "is_deleted")


def metadata_roundtrip(spark, sf_dir):
    path = _shelf(spark, "ids")
    tables.write_metadata(_records(spark, sf_dir), path)
    return tables.read_metadata(spark, path)


def chapter_files_roundtrip(spark, sf_dir):
    path = _shelf(spark, "chapters")
    found = chapters.chapters(_headed(spark, sf_dir))
    tables.write_chapter_files(found.select("document", chapters.file_name(F.col("chapter_no"), F.col("title")).alias("file"), "content"), path)
    out = tables.read_chapter_files(spark, path)
    return out.select(F.col("document").cast("long").alias("doc_id"), "file", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


def embedding_stage(spark, sf_dir):
    done = retrieval.embedded(_chunks(spark, sf_dir).where("content is not null"), embedding(hashed_embedder(48)), "hashed-words", "1", 48)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x * x).cast("double")))
    return done.select("chunk_pos", "embedding_model", "embedding_model_version", "embedding_dimension", F.size("embedding").alias("length"), F.round(norm, 3).alias("norm"))


# --- both parsers from end to end -------------------------------------------------------------------------------


def parsed_text(spark, sf_dir):
    out = layout.parse(_words(spark, sf_dir))
    return out.select(F.col("document").cast("long").alias("doc_id"), F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def structured_blocks(spark, sf_dir):
    out = layout.parse_structured(_words(spark, sf_dir))
    return out.select(
        F.col("document").cast("long").alias("doc_id"), F.col("block").cast("long").alias("block"), "page_start", "page_end", "chapter", "section",
        F.array_join("heading_path", " > ").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
    )


# --- context and prompts ------------------------------------------------------------------------------------


def _context(spark, sf_dir):
    index = retrieval.bm25_index(_chunks(spark, sf_dir))
    found = retrieval.bm25_top_k(index, _questions(spark, sf_dir), 10)
    docs = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_pos"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document"), F.col("lang").alias("chapter"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content")
    )
    return context.build_context(retrieval.with_chunks(found, docs), context.Limits(5, 6000))


def context_budget(spark, sf_dir):
    out = _context(spark, sf_dir)
    ids = F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",")
    return out.select("query_id", ids.alias("chunk_ids"), "chunk_count", "context_chars", F.sha2(F.col("context").cast("binary"), 256).alias("hash"))


def prompt_messages(spark, sf_dir):
    out = context.messages(_questions(spark, sf_dir), _context(spark, sf_dir))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return out.select("query_id", F.length(text).alias("chars"), F.sha2(text.cast("binary"), 256).alias("hash"))


_CONTEXT = _BM25.replace("{{", "{").replace("}}", "}").replace("{live}", "") + r""",
item AS (SELECT query_id, rank, chunk_pos, '标准名称：' || source || chr(10) || '章节：' || lang || chr(10) || '标题：未提供标题' || chr(10) || 'Chunk ID：' || chunk_pos || chr(10) || chr(10)
    || regexp_replace(text, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') AS body
  FROM lex JOIN documents ON doc_id = chunk_pos WHERE rank <= 10 AND regexp_matches(text, '[^\s\x0b\x1c-\x1f]')),
it AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM item),
fold AS (
  SELECT item_id AS query_id, 0::BIGINT AS k, '' AS text, 0 AS n, '' AS ids FROM benchmark
  UNION ALL
  SELECT f.query_id, it.k, CASE WHEN takes THEN new ELSE f.text END, f.n + takes::INT, CASE WHEN takes THEN f.ids || CASE WHEN f.n > 0 THEN ',' ELSE '' END || it.chunk_pos ELSE f.ids END
  FROM fold f JOIN it ON it.query_id = f.query_id AND it.k = f.k + 1,
  LATERAL (SELECT f.text || CASE WHEN f.n > 0 THEN chr(10) || chr(10) ELSE '' END || '[' || (f.n + 1) || ']' || chr(10) || it.body AS new),
  LATERAL (SELECT f.n < 5 AND length(new) <= 6000 AS takes)),
ctx AS (SELECT query_id, arg_max(text, k) AS text, arg_max(n, k) AS n, arg_max(ids, k) AS ids FROM fold GROUP BY query_id)"""


def _with(sql: str, live: str = "") -> str:
    return "WITH " + sql.replace("{live}", live).replace("{{", "{").replace("}}", "}")


_TOK = r"coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 0)"
_GROUPS = "SELECT 'overall' AS group_name, '' AS group_value, * FROM m UNION ALL SELECT 'difficulty', difficulty, * FROM m WHERE difficulty IS NOT NULL UNION ALL SELECT 'category', category, * FROM m WHERE category IS NOT NULL"
_CHAPTER = r"""CASE WHEN regexp_matches(line, '^\d+\s+.+$') THEN len(ltrim(regexp_extract(line, '^(\d+)', 1), '0')) BETWEEN 1 AND 2 WHEN regexp_matches(line, '^\d+\.\d+\s+.+$') THEN true ELSE false END"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_corpus_stats, bm25_terms, bm25_topk, soft_delete_filter, vector_topk, vector_metadata_join, rrf_fusion, hybrid_topk, eval_per_query, eval_overall, eval_by_group,
        content_hash_dedup, doc_slug_version, heading_levels, chapter_segments, section_paths, paragraphs, sentence_split, token_windows, normalize_text,
        page_number_filter, footer_number_filter, header_filter, incomplete_headings, line_grouping, visual_lines, chunk_pack, token_stats, over_limit_audit, context_budget, prompt_messages,
        rag_hybrid, rag_evaluate, token_offenders, chunk_samples, structured_chunks, dictionary_terms, index_roundtrip, chunks_json_roundtrip, metadata_roundtrip, chapter_files_roundtrip, embedding_stage,
        parsed_text, structured_blocks,
    )
}

ORACLES = {
    "bm25_corpus_stats": _with(_STATS) + " SELECT n, round(avgdl, 6) AS avgdl, (SELECT round(avg(r), 6) FROM raw) AS avg_idf FROM st",
    "bm25_terms": r"""WITH d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS term FROM documents) GROUP BY term),
r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM d, (SELECT count(*) AS n FROM documents)), m AS (SELECT avg(r) AS m FROM r)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * m ELSE r END, 6) AS idf FROM r, m""",
    "bm25_topk": _with(_BM25) + " SELECT query_id, rank::INT AS rank, chunk_pos, round(score, 6) AS score FROM lex WHERE rank <= 25",
    "soft_delete_filter": _with(_BM25, " WHERE lang IS DISTINCT FROM 'en'") + " SELECT query_id, rank::INT AS rank, chunk_pos, round(score, 6) AS score FROM lex WHERE rank <= 10",
    "vector_topk": _with(_VEC) + " SELECT query_id, rank::INT AS rank, chunk_pos, round(score, 6) AS score FROM vec WHERE rank <= 10",
    "vector_metadata_join": _with(_VEC) + " SELECT chunk_pos, query_id, rank::INT AS rank, round(score, 6) AS score, lang, source FROM vec JOIN documents ON doc_id = chunk_pos WHERE rank <= 5",
    "rrf_fusion": _with(_FUSED) + " SELECT query_id, rank::INT AS rank, chunk_pos, round(score, 6) AS score FROM fused WHERE rank <= 10",
    "hybrid_topk": _with(_HYBRID) + " SELECT query_id, rank::INT AS rank, chunk_pos, round(score, 6) AS score, round(fusion_score, 6) AS fusion_score FROM hyb WHERE rank <= 10",
    "rag_hybrid": _with(_PLAN) + " SELECT query_id, rank::INT AS rank, chunk_pos, round(score, 6) AS score, round(fusion_score, 6) AS fusion_score FROM hyb WHERE rank <= 10",
    "eval_per_query": _with(_EVAL) + " SELECT query_id, category, difficulty, " + ", ".join(f"round({m}, 6) AS {m}" for m in evaluation.METRICS) + " FROM m",
    "eval_overall": _with(_EVAL) + " SELECT count(*) AS queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluation.METRICS) + " FROM m",
    "eval_by_group": _with(_EVAL) + " SELECT group_name, group_value, count(*) AS queries, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in evaluation.METRICS) + f" FROM ({_GROUPS}) GROUP BY ALL",
    "content_hash_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1",
    "doc_slug_version": r"""SELECT doc_id, regexp_replace(regexp_replace(lower(document), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS document_id, regexp_extract(document, '([0-9]{4})$', 1) AS version,
  (doc_id % 5)::INT AS level FROM (SELECT doc_id, 'GB/T+' || doc_id || '.' || upper(lang) || '-' || (2000 + doc_id % 30) AS document FROM documents)""",
    "heading_levels": _with(_HEADED) + " SELECT doc_id, level, count(*) AS lines FROM lv GROUP BY ALL",
    "chapter_segments": _with(_HEADED) + rf""",
t AS (SELECT doc_id, i, line, {_CHAPTER} AS opens FROM ln WHERE line <> ''),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i)::INT AS chapter_no FROM t),
g AS (SELECT doc_id, chapter_no, string_agg(line, chr(10) ORDER BY i) AS content, arg_min(line, i) AS title FROM n WHERE chapter_no > 0 GROUP BY ALL)
SELECT doc_id, chapter_no, printf('%03d', chapter_no) || '_' || regexp_extract(title, '^(\d+(\.\d+)?)\s', 1) || '_' ||
  left(trim(regexp_replace(regexp_extract(title, '^\d+(\.\d+)?\s+(.+)$', 2), '[\\/:*?"<>|]', '_', 'g')), 80) || '.txt' AS file, sha256(content) AS content_hash, length(content)::INT AS chars FROM g""",
    "section_paths": _with(_SECTIONS) + """ SELECT doc_id, section_no::INT AS section_no, CASE WHEN len(any_value(headings)) > 1 THEN array_to_string(any_value(headings)[:-2], ' > ') END AS parent_path,
  len(any_value(headings))::INT AS depth, count(*)::INT AS n_lines FROM sec GROUP BY doc_id, section_no""",
    "paragraphs": _with(_SECTIONS) + """,
b AS (SELECT doc_id, section_no, i, line, sum((line = '')::INT) OVER (PARTITION BY doc_id, section_no ORDER BY i) AS run FROM sec),
p AS (SELECT doc_id, section_no, run, string_agg(line, '' ORDER BY i) AS text FROM b WHERE line <> '' GROUP BY ALL)
SELECT doc_id, section_no::INT AS section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY run)::INT AS paragraph_no, length(text)::INT AS chars, sha256(text) AS hash FROM p""",
    "sentence_split": r"""SELECT doc_id, len(s)::INT AS sentences, sha256(coalesce(array_to_string(s, chr(10)), '')) AS hash FROM (SELECT doc_id, list_filter([regexp_replace(x, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') for x in
  regexp_extract_all(text, '[^.!?;。！？；]*[.!?;。！？；]|[^.!?;。！？；]+')], lambda x: x <> '') AS s FROM documents)""",
    "token_windows": r"""SELECT doc_id, i::INT AS window_no, (i * 520)::INT AS start, len(w[i * 520 + 1 : i * 520 + 600])::INT AS tokens, sha256(array_to_string(w[i * 520 + 1 : i * 520 + 600], ' ')) AS hash
  FROM (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 600) / 520)::BIGINT))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM documents) WHERE len(w) > 0)""",
    "normalize_text": f"SELECT page_id, length(t)::INT AS chars, sha256(t) AS hash FROM (SELECT page_id, trim({_NORMAL}) AS t FROM pages)",
    "page_number_filter": _with(_PLACED) + r" SELECT doc_id, count(*) AS lines FROM pl WHERE NOT regexp_matches(trim(text), '^(\d{1,4}|第\s*\d+\s*页)$') GROUP BY doc_id",
    "footer_number_filter": _with(_PLACED) + r" SELECT doc_id, count(*) AS lines FROM pl WHERE NOT (regexp_matches(trim(text), '^\d+$') AND y0 >= 90) GROUP BY doc_id",
    "header_filter": _with(_PLACED) + " SELECT doc_id, count(*) AS lines FROM pl WHERE NOT (text LIKE 'GB/T 1589—2026' AND y0 <= 5) GROUP BY doc_id",
    "incomplete_headings": _with(_HEADED) + r" SELECT doc_id, count(*) FILTER (regexp_matches(line, '^(\d+(\.\d+){0,2}|[A-Z](\.\d+){0,2}|图\s*[A-Z](\.\d+){0,2}|表\s*\d+(\.\d+){0,2})\.')) AS incomplete FROM ln GROUP BY doc_id",
    "line_grouping": _with(_WORDS) + """ SELECT doc_id, (line // 40)::INT AS page, (line % 40)::INT AS line_seq, sha256(string_agg(text, ' ' ORDER BY place)) AS hash, 0.0::DOUBLE AS x0,
  min(line % 40 * 20 + place % 3)::DOUBLE AS y0, max(place * 50 + 40)::DOUBLE AS x1, (line % 40 * 20 + 12)::DOUBLE AS y1 FROM wd GROUP BY doc_id, line""",
    "visual_lines": _with(_WORDS) + """ SELECT doc_id, (line // 40)::INT AS page, count(DISTINCT line) AS lines, min(line % 40 * 20 + place % 3)::DOUBLE AS y0, max(line % 40 * 20 + 12)::DOUBLE AS y1 FROM wd GROUP BY 1, 2""",
    "token_stats": f"SELECT count(*) AS chunks, min({_TOK})::INT AS min_tokens, max({_TOK})::INT AS max_tokens, round(avg({_TOK}), 6) AS mean_tokens FROM documents",
    "over_limit_audit": f"""SELECT *, CASE WHEN over_budget + over_model + blank > 0 THEN 'FAILED' WHEN structured_over_model > 0 THEN 'WARNING' ELSE 'PASSED' END AS verdict FROM (
  SELECT count(*) FILTER (t > 8192) AS structured_over_model, count(*) FILTER (t > 600) AS over_budget, count(*) FILTER (t > 8192) AS over_model, count(*) FILTER (NOT coalesce(regexp_matches(text, '\\S'), false)) AS blank
  FROM (SELECT text, {_TOK} AS t FROM documents))""",
    "token_offenders": f"SELECT doc_id::VARCHAR AS chunk_id, {_TOK}::INT AS token_count FROM documents WHERE {_TOK} > 600 ORDER BY token_count DESC, chunk_id LIMIT 20",
    "chunk_samples": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM documents),
f AS (SELECT * FROM w WHERE len(w) > 0 ORDER BY doc_id LIMIT 5)
SELECT doc_id AS chunk_pos, doc_id || '_' || i AS chunk_id, len(w[i * 520 + 1 : i * 520 + 600])::INT AS token_count, left(array_to_string(w[i * 520 + 1 : i * 520 + 600], ' '), 300) AS preview
FROM (SELECT *, unnest(range(0, 1 + greatest(0, ceil((len(w) - 600) / 520)::BIGINT))) AS i FROM f) WHERE i < 3""",
    "structured_chunks": _with(_HEADED) + rf""",
t AS (SELECT doc_id, i, line, {_CHAPTER} AS opens FROM ln WHERE line <> ''),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i)::INT AS chapter_no FROM t),
g AS (SELECT doc_id, chapter_no, string_agg(line, chr(10) ORDER BY i) AS content, arg_min(line, i) AS head FROM n WHERE chapter_no > 0 GROUP BY ALL),
h AS (SELECT doc_id, printf('%03d', chapter_no) AS no, regexp_extract(head, '^(\d+(\.\d+)?)\s', 1) AS number,
  left(trim(regexp_replace(regexp_extract(head, '^\d+(\.\d+)?\s+(.+)$', 2), '[\\/:*?"<>|]', '_', 'g')), 80) AS name, content FROM g)
SELECT row_number() OVER (ORDER BY 'GB/T ' || doc_id || '-2024', no || '_' || number || '_' || name || '.txt') - 1 AS chunk_pos, 'gb_t_' || doc_id || '_2024_' || no || '_' || number AS chunk_id,
  'gb_t_' || doc_id || '_2024' AS document_id, 'GB/T ' || doc_id || '-2024' AS document, 'GB/T ' || doc_id || '-2024.pdf' AS source, '2024' AS version, number AS chapter,
  trim(regexp_replace(regexp_replace(trim(name), '[·•]+$', ''), '\.+$', '')) AS title, len(string_split(number, '.'))::INT AS level,
  trim(regexp_replace(regexp_replace(trim(name), '[·•]+$', ''), '\.+$', '')) AS parent_path, sha256(content) AS content_hash, false AS is_deleted FROM h""",
    "dictionary_terms": r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(text, 'tion|the|ing|er|[\p{L}\p{N}]+|[^\s\x0b\x1c-\x1f]')) AS term FROM documents),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM d, n), m AS (SELECT avg(r) AS m FROM r)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * m ELSE r END, 6) AS idf FROM r, m""",
    "rag_evaluate": _with(_PLAN) + f""",
truth AS (SELECT item_id AS query_id, list(DISTINCT source) AS e_document, list(DISTINCT doc_id::VARCHAR) AS e_chunk FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
got AS (SELECT query_id, list(source ORDER BY rank) AS g_document, list(chunk_pos::VARCHAR ORDER BY rank) AS g_chunk FROM hyb JOIN c USING (chunk_pos) WHERE rank <= 5 GROUP BY query_id),
ev AS (SELECT item_id AS query_id, coalesce(e_document, []) AS e_document, coalesce(e_chunk, []) AS e_chunk, coalesce(g_document, []) AS g_document, coalesce(g_chunk, []) AS g_chunk
  FROM benchmark LEFT JOIN truth ON truth.query_id = item_id LEFT JOIN got ON got.query_id = item_id),
m AS (SELECT query_id, {_metric_sql()} FROM ev)
SELECT query_id, """ + ", ".join(f"round({m}, 6) AS {m}" for m in evaluation.METRICS) + " FROM m",
    "index_roundtrip": """SELECT doc_id AS chunk_pos, 'c' || doc_id AS chunk_id, sha256(text) AS content_hash, len(embedding)::INT AS dimension, round(list_sum([x::DOUBLE for x in embedding]), 4) AS total
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE text <> ''""",
    "chunks_json_roundtrip": "SELECT doc_id AS chunk_pos, 'c' || doc_id AS chunk_id, 'd' AS document_id, source AS document, 1::INT AS level, sha256(text) AS content_hash, sha256(text) AS hash, false AS is_deleted FROM documents WHERE text <> ''",
    "metadata_roundtrip": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS vector_id, 'c' || doc_id AS chunk_id FROM documents WHERE text <> ''",
    "embedding_stage": r"SELECT doc_id AS chunk_pos, 'hashed-words' AS embedding_model, '1' AS embedding_model_version, 48::INT AS embedding_dimension, 48::INT AS length, CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents WHERE text IS NOT NULL",
    "parsed_text": _with(_WORDS) + rf""",
jn AS (SELECT doc_id, line, trim(string_agg(text, chr(1) ORDER BY place)) AS t FROM wd GROUP BY ALL),
sp AS (SELECT doc_id, line, replace({_SPACED}, chr(1), '') AS html FROM jn),
kept AS (SELECT doc_id, line, trim({_NORMAL}) AS t FROM sp WHERE NOT regexp_matches(html, '^(\d{{1,4}}|第\s*\d+\s*页)$') AND NOT regexp_matches(html, '(?i)^GB(?:/T)?\s*\d+(?:\.\d+)*\s*[—-]\s*\d{{4}}$'))
SELECT doc_id, length(string_agg(t, chr(10) ORDER BY line))::INT AS chars, sha256(string_agg(t, chr(10) ORDER BY line)) AS hash FROM kept WHERE t <> '' GROUP BY doc_id""",
    "structured_blocks": _with(_WORDS) + rf""",
l AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY place) AS text, trim(regexp_replace(string_agg(text, ' ' ORDER BY place), '[\s\x0b\x1c-\x1f]+', ' ', 'g')) AS c, min(line % 40 * 20 + place % 3) AS y0 FROM wd GROUP BY doc_id, line),
k AS (SELECT * FROM l WHERE NOT (regexp_matches(c, '^\d+$') AND y0 >= 720)),
h AS (SELECT *, regexp_extract(c, '^(\d+(?:\.\d+){{0,3}})\s*(.*)$', ['n', 't']) AS m, regexp_extract(c, '^([A-Z](?:\.\d+){{0,3}})\s*(.*)$', ['n', 't']) AS a FROM k),
fits AS (SELECT *, m.n <> '' AND (trim(m.t) = '' OR (length(trim(m.t)) <= 100 AND NOT regexp_matches(m.t, '[。；]$'))) AS is_m, a.n <> '' AND (trim(a.t) = '' OR (length(trim(a.t)) <= 100 AND NOT regexp_matches(a.t, '[。；]$'))) AS is_a FROM h),
e AS (SELECT doc_id, line, text, is_m OR is_a AS opens, CASE WHEN is_m THEN m.n WHEN is_a THEN a.n END AS number, CASE WHEN is_m THEN trim(m.t) WHEN is_a THEN trim(a.t) END AS title FROM fits),
v AS (SELECT *, CASE WHEN opens THEN len(string_split(number, '.')) ELSE 0 END AS level, CASE WHEN title = '' THEN number ELSE number || ' ' || title END AS whole FROM e),
s AS (SELECT doc_id, line, text, opens, sum(opens::INT) OVER w AS block, {", ".join(f"last_value(CASE WHEN level = {n} THEN {{'i': line, 'line': whole}} END IGNORE NULLS) OVER w AS l{n}" for n in range(1, 5))} FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
p AS (SELECT doc_id, line, trim(text) AS body, block, list_filter([{_LIVE}], lambda x: x IS NOT NULL) AS path, l1.line AS chapter FROM s WHERE NOT opens)
SELECT doc_id, block::BIGINT AS block, (min(line) // 40)::INT AS page_start, (max(line) // 40)::INT AS page_end, any_value(chapter) AS chapter, any_value(path)[-1] AS section,
  coalesce(array_to_string(any_value(path), ' > '), '') AS path, sha256(string_agg(body, chr(10) ORDER BY line)) AS hash FROM p WHERE body <> '' GROUP BY doc_id, block""",
    "context_budget": "WITH RECURSIVE " + _CONTEXT + " SELECT query_id, ids AS chunk_ids, n AS chunk_count, length(text)::INT AS context_chars, sha256(text) AS hash FROM ctx",
    "prompt_messages": "WITH RECURSIVE " + _CONTEXT + f""",
p AS (SELECT query_id, 'system:{context.SYSTEM}' || chr(10) || 'user:问题：' || chr(10) || b.text || chr(10) || chr(10) || '参考资料：' || chr(10) || coalesce(nullif(trim(ctx.text), ''), '暂无参考资料') AS t FROM ctx JOIN benchmark b ON item_id = query_id)
SELECT query_id, length(t)::INT AS chars, sha256(t) AS hash FROM p""",
}
ORACLES["chapter_files_roundtrip"] = f"SELECT doc_id, file, content_hash FROM ({ORACLES['chapter_segments']})"
