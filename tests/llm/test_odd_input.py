"""Every stage of the pipeline, and so the operators below it, on odd rows, with columns whose names they use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASH = (
    "_gone", "_split", "_left", "_cut", "_own", "_taken", "_twice", "_hash", "_hashed", "_seen", "_place", "_bits", "_key", "_other", "_epoch",
    "gone", "found", "odd", "hashed", "key", "node", "m", "place", "bits", "c0", "size", "text_hash", "a.b", "x`y",
)
RESULTS = ("_lines", "lang_pred", "lang_score", "epoch", "taken")
WORDS = "der hund und die katze gehen heute nach hause und schlafen dort sehr lange".split()
LONG = "\n".join(" ".join(WORDS) + f" {i}" for i in range(3000))
ROWS = [
    (1, LONG, "de", "s"), (2, "Die Katze schläft.", "de", "s"), (2, "Die Katze schläft.", "de", "s"), (3, None, "de", None), (None, "Der Hund geht nach Hause.", None, None),
    (None, "Der Hund geht nach Hause.", None, None), (4, "", None, "t"), (5, " \n\t", "de", "t"), (6, "42 !?", "de", "t"), (7, LONG, "de", "t"), (8, "x" * 300_000, "de", "u"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return df.withColumns({c: F.lit(c) for c in CLASH})


#: doc_ids that stay, as often as they do.
WANT = {
    "language_id": [1, 2, 2, None, None, 7],
    "line_dedup": [1, 2, 2, 3, None, None, 4, 5, 6, 8, None],
    "simhash_dedup": [1, 2, None, 3, 6, 8],
    "decontamination": [1, 2, 2, 3, None, None, 4, 5, 6, 7, 8, None],
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, odd, name, stage):
    docs = odd.withColumns({c: F.lit(c) for c in RESULTS if name != "mixture" or c not in ("epoch", "taken")})
    if name == "language_id":
        docs = docs.where("doc_id <> 8 or doc_id is null")  # its one word of 300 000 letters is a test of its own
    out = stage(spark, docs, SF)
    assert out.columns == (docs.columns if name != "mixture" else [*docs.columns, "epoch", "taken"])
    rows = out.collect()
    assert all(r[c] == c for r in rows for c in CLASH)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
    order = lambda ids: sorted(ids, key=lambda d: (d is None, d or 0))
    if name in WANT:
        assert order(r.doc_id for r in rows) == order(WANT[name])
    else:
        assert {r.doc_id for r in rows} <= {1, 2, 6, 7, 8, None} and all(len(r.text.split()) == r.taken for r in rows)
    assert stage(spark, docs.limit(0), SF).count() == 0
