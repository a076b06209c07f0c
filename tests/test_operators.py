"""Hand-derived cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.models import hashed_embedder
from docquarry.functions.tokenizers import segment
from docquarry.operators import chapters, chunking, context, evaluation, layout, retrieval
from docquarry.plans import rag
from docquarry.sources import tables
from docquarry.streaming import questions as stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.normalize, "汉 字 符", "汉字 符"),
        (T.normalize, "55000kg", "55000 kg"),
        (T.slug, "GB+1589-2026", "gb_1589_2026"),
        (T.slug, "GBT+46991.1-2025", "gbt_46991_1_2025"),
        (T.version_of, "GB+1589-2026", "2026"),
        (T.version_of, "GB 158", ""),
        (T.clean_title, "一般要求············", "一般要求"),
        (T.clean_title, "一般要求............", "一般要求"),
        (T.utrim, "　 a b\x1c\n", "a b"),
        (T.split_lines, "a\r\nb\u2028c\n", ["a", "b", "c"]),
        (T.sentences, "一。二！三", ["一。", "二！", "三"]),
        (T.heading_level, "4.1.2 制动", 3),
        (T.heading_level, "附录A（规范性）", 1),
        (T.heading_level, "正文", 0),
        (T.chapter_title_kind, "100 a", None),
        (T.chapter_title_kind, "4车辆", "level1"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


@pytest.mark.parametrize(
    "line, want",
    [
        ("4 车辆外廓尺寸要求", ("main", "4", 1)),
        ("4.4车辆通过性要求", ("main", "4.4", 2)),
        ("4.4.1.1 特殊车辆要求", ("main", "4.4.1.1", 4)),
        ("A.4.2.2 以下装置不在车辆宽度测量范围:", ("appendix", "A.4.2.2", 4)),
        ("图 B.1 车辆外摆值示意图", ("figure", "图 B.1", 2)),
        ("表 5.1 车辆长度", ("table", "表 5.1", 2)),
        ("车辆长度应符合4.1的规定。", None),
    ],
)
def test_headings(spark, line, want):
    got = one(spark, line, layout.heading)
    assert (got and (got.kind, got.number, got.level)) == want


@pytest.mark.parametrize(
    "line, digit, want",
    [
        ("4.7.2.最大允许总质量应不超过55000kg。", "4", "4.7.2.4 最大允许总质量应不超过55000kg。"),
        ("A.2.车辆横向平面(X基准平面)", "3", "A.2.3 车辆横向平面(X基准平面)"),
        ("图B.车辆外摆值示意图(汽车)", "1", "图 B1 车辆外摆值示意图(汽车)"),
    ],
)
def test_split_numbers(spark, line, digit, want):
    rows = [("d", 0, i, t, 0.0, 10.0 * i, 9.0, 10.0 * i + 8) for i, t in enumerate([line, digit, "其他"])]
    out = layout.merge_split_numbers(spark.createDataFrame(rows, layout.LINES)).orderBy("line_seq").collect()
    assert [r.text for r in out] == [want, "其他"]


def test_layout(spark):
    words = [("GB", 10, 5), ("1589—2026", 30, 5), ("hello", 10, 100), ("world", 60, 101), ("3", 10, 200), ("车辆", 30, 202), ("12", 10, 780)]
    rows = [("d", 0, 800.0, t, float(x), float(y), x + 20.0, y + 8.0, 0, i, 0) for i, (t, x, y) in enumerate(words)]
    df = spark.createDataFrame(rows, layout.WORDS)
    assert layout.parse(df).first().text == "helloworld\n3 车辆"
    assert layout.merge_headings(["B.", "2.", "4 宽度"], [10.0, 11.0, 12.0])[0][0] == 0


def test_chapters(spark):
    df = spark.createDataFrame([("GB+1-2026", "前言\n\n1 范围\n一\n\n2.1 术语\n二\n附录 A\n三")], "document string, text string")
    out = {r.file: r for r in chapters.chapters(df).withColumn("file", chapters.file_name(F.col("chapter_no"), F.col("title"))).collect()}
    assert [out[k].content for k in sorted(out)] == ["1 范围\n一", "2.1 术语\n二", "附录 A\n三"]
    got = chapters.split_documents(df).orderBy("chunk_pos").collect()
    assert [r.chunk_pos for r in got] == [0, 1, 2]
    assert (got[0].chunk_id, got[0].chapter, got[0].title, got[0].level) == ("gb_1_2026_001_1", "1", "范围", 1)


def packed(content, budget, tokenizer):
    return chunking.Packer(budget, tokenizer).chunks({"chunk_id": "s", "content": content})


def test_packing():
    words = chunking.WordTokenizer()
    assert [c["content"] for c in packed("4 A\n4.1 B\ntext", chunking.Budget(50, 0, 5), words)] == ["4 A\n\n4.1 B\n\ntext"]
    assert chunking.paragraphs_of(["ab", "cd", "", "ef"]) == ["abcd", "ef"]
    assert chunking.Packer(chunking.Budget(4, 0, 1), words).windows("0 1 2 3 4 5 6 7 8 9", 4) == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    text = "\n\n".join(" ".join(f"w{i}.{k}" for k in range(7)) for i in range(9))
    out = packed(text, chunking.Budget(20, 0, 7), words)
    assert all(c["token_count"] <= 20 for c in out) and len({c["chunk_id"] for c in out}) == len(out)
    assert [c["chunk_index"] for c in out] == list(range(1, len(out) + 1))
    assert packed(" \n ", chunking.Budget(), words) == []
    for bad in ((0, 0, 0), (10, 11, 0), (10, 0, 10), (10, -1, 0), (10, 0, -1)):
        with pytest.raises(ValueError):
            chunking.Budget(*bad)


def test_bm25(spark):
    texts = ["a b b", "b c", "d", "a a e"]
    chunks = spark.createDataFrame([(i, t, i == 3) for i, t in enumerate(texts)], "chunk_pos long, content string, is_deleted boolean")
    asked = spark.createDataFrame([(1, "b b zz"), (2, "nothing")], "query_id long, query string")
    out = retrieval.bm25_top_k(retrieval.bm25_index(chunks), asked, 10).orderBy("query_id", "rank").collect()
    live, n, avg = [t.split() for t in texts[:3]], 3, 2.0
    idf = {}
    for w in {w for t in live for w in t}:
        df = sum(w in t for t in live)
        idf[w] = math.log(n - df + 0.5) - math.log(df + 0.5)
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    score = lambda t: 2 * idf["b"] * t.count("b") * 2.5 / (t.count("b") + 1.5 * (0.25 + 0.75 * len(t) / avg))
    want = sorted(((score(t), i) for i, t in enumerate(live)), key=lambda x: (-round(x[0], 9), x[1]))
    assert [(r.chunk_pos, round(r.score, 9)) for r in out if r.query_id == 1] == [(i, round(s, 9)) for s, i in want]
    assert [(r.chunk_pos, r.score) for r in out if r.query_id == 2] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def ranked(spark, ids):
    return spark.createDataFrame([(1, i, c) for i, c in enumerate(ids, 1)], "query_id long, rank int, chunk_pos long")


def test_fusion(spark):
    fuse = lambda a, b, k=10: [(r.chunk_pos, r.score) for r in retrieval.fuse([ranked(spark, a), ranked(spark, b)], k).orderBy("rank").collect()]
    got = fuse([1, 2], [2, 3])
    assert [c for c, _ in got] == [2, 1, 3] and got[0][1] == pytest.approx(1 / 62 + 1 / 61)
    assert [c for c, _ in fuse([1], [2])] == [1, 2]
    assert dict(fuse([1, 1, 2], [9])) == pytest.approx({1: 1 / 61, 2: 1 / 63, 9: 1 / 61})
    assert fuse([1], [2], 0) == []
    with pytest.raises(ValueError):
        retrieval.fuse([ranked(spark, [1])], 1, -1)


def test_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [1.0, 0.0])], "chunk_pos long, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.chunk_pos for r in retrieval.vector_top_k(vectors, asked, 5).orderBy("rank").collect()] == [0, 2, 1]
    assert retrieval.vector_top_k(vectors.limit(0), asked, 5).count() == 0


def test_context(spark):
    rows = [(1, 1, "a", "d", "1", "t", "x" * 20), (1, 2, "b", None, "", None, "y" * 500), (1, 3, "a", "d", "1", "t", "z"), (1, 4, "c", "d", "1", "t", " "), (1, 5, "e", "d", "1", "t", "w")]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, document string, chapter string, title string, content string")
    got = context.build_context(df, context.Limits(5, 150)).first()
    assert [(s.ref, s.chunk_id) for s in got.sources] == [(1, "a"), (2, "e")]
    assert got.context_chars == len(got.context) <= 150 and got.context.startswith("[1]\n标准名称：d\n")
    assert "未知文档" in context.build_context(df, context.Limits()).first().context
    assert context.build_context(df, context.Limits(1, 12_000)).first().chunk_count == 1
    with pytest.raises(ValueError):
        context.Limits(0, 1)


def test_evaluation(spark):
    items = spark.createDataFrame([(1, ["d"], ["c3", "c9"], "x", None), (2, [], [], "x", "easy")], "query_id long, expected_documents array<string>, expected_chunks array<string>, category string, difficulty string")
    results = spark.createDataFrame([(1, r, f"c{r}", "d" if r > 1 else "e") for r in range(1, 6)], "query_id long, rank int, chunk_id string, document string")
    m = {r.query_id: r for r in evaluation.per_query(items, results).collect()}
    assert (m[1].chunk_mrr, m[1].chunk_recall_1, m[1].chunk_recall_3, m[1].chunk_precision_5) == (pytest.approx(1 / 3), 0.0, 0.5, 0.2)
    assert (m[1].document_precision_5, m[1].document_mrr, m[2].chunk_recall_10) == (0.5, 0.5, 0.0)
    report = {(r.group_name, r.group_value): r.queries for r in evaluation.report(evaluation.per_query(items, results), ["difficulty", "category"]).collect()}
    assert report == {("overall", ""): 2, ("difficulty", "easy"): 1, ("category", "x"): 2}


def test_segment():
    assert segment("制动系统 ABS2 的", {"制动系统"}, 4) == ["制动系统", "ABS2", "的"]


def test_whole_plan(spark, tmp_path):
    texts = spark.createDataFrame([("GB+1-2026", "1 范围\n制动 brake rules。\n2 灯光\nlamp rules for lamps。")], "document string, text string")
    corpus = rag.build_from_chunks(chapters.split_documents(texts))
    asked = spark.createDataFrame([(1, "lamp rules")], "query_id long, query string")
    got = rag.answer_questions(corpus, asked).first()
    assert got.sources[0].chapter == "2" and got.retrieval.chunk_count == 2 and got.answer == "2 灯光 [1]"
    kinds = [e["type"] for e in stream.events(corpus, "lamp")]
    assert kinds[0] == "sources" and kinds[-2:] == ["metrics", "done"] and set(kinds[1:-2]) == {"token"}
    with pytest.raises(ValueError):
        next(stream.events(corpus, "  "))
    tables.save_index(corpus.chunks, f"{tmp_path}/index")
    assert tables.load_index(spark, f"{tmp_path}/index", 64).count() == 2
    good, bad = tables.validate_chunks(corpus.chunks.withColumn("level", F.when(F.col("chunk_pos") == 0, 9).otherwise(F.col("level"))))
    assert (good.count(), bad.first().problems) == (1, ["level"])
    with pytest.raises(ValueError):
        rag.corpus_of(corpus.chunks.limit(0), embedder=hashed_embedder(8))


def test_chapter_files(spark, tmp_path):
    folder = tmp_path / "GB+1 a-2026"
    folder.mkdir()
    (folder / "003_3_术语和定义.txt").write_text("3 术语和定义\n词")
    (folder / "004_x.txt").write_text(" \n")
    got = chapters.structured_chunks(tables.read_chapter_files(spark, str(tmp_path))).collect()
    assert [(r.document, r.chapter, r.title, r.level, r.source) for r in got] == [("GB+1 a-2026", "3", "术语和定义", 1, "GB+1 a-2026.pdf")]


def test_embedding_whose_signs_cancel():
    a, b, c = hashed_embedder(48)()(["w0 w88", "w0 w0", " .\n"])
    assert (float(a @ a), float(b @ b), float(c @ c)) == (1.0, 1.0, 0.0)


def test_chapter_files_are_listed_by_executors(spark, tmp_path):
    rows = [(f"d{i}", f"001_{i}_t.txt", f"{i} t") for i in range(30)] + [("_d", "001_1_t.txt", "1 t"), ("d e%20", "001_1_t.txt", "1 t"), ("d0", "002_1_t.txt", "1 t"), ("d1", "002_1_t.txt", " ")]
    tables.write_chapter_files(spark.createDataFrame(rows, "document string, file string, content string"), f"file://{tmp_path}")
    found = tables.read_chapter_files(spark, f"file://{tmp_path}")
    assert "binaryFile" not in found._jdf.queryExecution().toString()  # that source's index holds each file's name in the driver
    assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[2] != " ")
    with pytest.raises(FileNotFoundError):
        tables.read_chapter_files(spark, f"file://{tmp_path}/missing")


def test_holding_shuffles_no_text(spark, monkeypatch):
    texts = ["x one two three four five y", "one two three four five", "one two three", "a b", "", None, "one two three four five one two three four five", "a b c d e f"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_pos long, content string")
    items = spark.createDataFrame([(1, "one two three four five"), (2, "b"), (3, None), (4, "a b c d e"), (5, "zz two three four qq")], "query_id long, query string")
    want = [(1, 0), (1, 1), (1, 6), (2, 3), (2, 7), (4, 7)]
    found = retrieval.holding(chunks, items)
    assert sorted(map(tuple, found.collect())) == want
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, retrieval.holding(chunks, items).collect())) == want
