"""Rows of pages against a plain reading of the rules, on odd pages."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.durable import slices
from docquarry.operators import chunking, layout, pages


def rows_by_hand(words, tolerance):
    """(page, line_seq) of each word: down by y0, a word joins the row while it is near the mean of that row."""
    out, total, n, row, last = [], None, 0, -1, None
    for page, y, k in sorted(words, key=lambda w: (w[0], w[1] is not None, w[1] or 0.0)):
        if page != last:
            total, n, row, last = None, 0, -1, page
        if total is not None and n and abs(y - total / n) <= tolerance:
            total, n = total + y, n + 1
        else:
            total, n, row = y, 1, row + 1
        out.append((k, page, row))
    return sorted(out)


def test_rows_of_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(pages, "ROWS", 50)
    draw = random.Random(3)
    words = [(n % 7, None if n % 97 == 0 else draw.choice([draw.uniform(0, 60), draw.randrange(20) * 3.0]), n) for n in range(900)]
    rows = [("d" if p % 2 else None, p, 800.0, f"w{k}", float(k), y, k + 1.0, None, 0, k, k) for p, y, k in words]
    lines = layout.visual_lines(spark.createDataFrame(rows, layout.WORDS).repartition(5))
    got = lines.select("page", "line_seq", F.explode(F.regexp_extract_all("text", F.lit(r"w\d+"), F.lit(0))).alias("w")).collect()
    assert sorted((int(r.w[1:]), r.page, r.line_seq) for r in got) == rows_by_hand(words, layout.Y_TOLERANCE)
    assert lines.where("y1 is not null").isEmpty() and lines.where("document is null").select("page").distinct().count() == 4


def test_block_lines_of_odd_words(spark):
    rows = [("d", 0, None, t, x, y, None, 5.0, b, 0, 0) for t, x, y, b in [("b", 1.0, 4.5, 1), ("a", 1.0, 1.5, 1), ("", 0.0, 9.0, 1), (None, 2.0, None, 1), ("图", 3.0, 7.5, 2), ("，", 4.0, 7.5, 2), (None, 0.0, 0.0, None)]]
    got = layout.block_lines(spark.createDataFrame(rows, layout.WORDS)).orderBy("line_seq").collect()
    assert [(r.line_seq, r.text, r.x0, r.y0, r.x1, r.block_no) for r in got] == [(0, "", 0.0, 0.0, None, None), (1, "a b", 0.0, 1.5, None, 1), (2, "图，", 3.0, 7.5, None, 2)]


def test_words_reach_the_shuffle_as_pages(spark):
    """A row a word was shuffled before, and a page went through pandas by itself."""
    words = spark.createDataFrame([("d", 0, 800.0, f"w{k}", float(k), 0.0, k + 1.0, 8.0, 0, 0, k) for k in range(320)], layout.WORDS).coalesce(1)
    for out in (layout.visual_lines(words), layout.block_lines(words), layout.parse(words)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "collect_list(struct(x0" not in plan


@pytest.mark.parametrize("texts, want", [(["4 宽度", "B.", "2.", "a"], ["B.2.4 宽度", "a"]), (["图B", "1 示意"], ["图 B.1 示意"]), (["4 宽度", "a"], ["4 宽度", "a"])])
def test_recovered_headings(spark, texts, want):
    rows = [(p, 0, 800.0, i, t, float(i), 10.0 + i, 50.0, 20.0 + i) for p in ("p", None) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "document string, page int, page_height double, line_seq int, text string, x0 double, y0 double, x1 double, y1 double")
    got = layout.recover_headings(lines).orderBy("document", "line_seq").collect()
    assert [r.text for r in got] == want * 2


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "b" * 90, None, "c" * 10, "d" * 10, "", "e" * 200, "f"]), pa.array(range(8))], ["text", "n"])
    parts = list(slices(batch, 0, 25))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()[:-1]) < 25 for p in parts) and len(parts) >= 4


def test_packing_goes_by_slices(spark):
    """Whole batches of 10000 texts became Python objects before."""
    rows = spark.createDataFrame([(i, f"c{i}", "word " * 50) for i in range(9)] + [(9, "c9", None)], "chunk_pos long, chunk_id string, content string").coalesce(1)
    out = chunking.retrieval_chunks(rows, chunking.Budget(20, 0, 5), chunking.WordTokenizer)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.chunk_pos: r.n for r in out.groupBy("chunk_pos").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(9), 3)
