"""Each stage on its own input, against SQL or brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import decontaminate, langid, linededup, mixing
from docquarry.llm import simhash as simhash_module
from docquarry.llm.common import written
from docquarry.llm.simhash import bands, shingles, similar, simhash, simhash_dedup
from tests.llm.duck import got, rows

SF = "/root/testdata/sf0.001"
KINDS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]


def brute_groups(docs, similarity=0.8):
    """The first doc_id of each group."""
    sets = [(d, set(shingles(t).tolist())) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or len(x & y) >= similarity * len(x | y) > 0:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {find(d) for d, _ in docs}


def test_simhash_dedup(spark):
    rng = random.Random(1)
    docs = []
    for g in range(8):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([3, 12, 80, 400]))]
        for _ in range(7):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 25])):
                w[rng.randrange(len(w))] = "changed"
            docs.append((rng.randrange(10**6), " ".join(w)))
    docs += [(1, ""), (2, None), (3, " \n"), (4, "one"), (5, "ONE")]
    docs = list({d: (d, t) for d, t in docs}.values())
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, node string")
    want = brute_groups(docs)
    assert {r.doc_id for r in simhash_dedup(df).collect()} == want
    assert simhash_dedup(df).columns == df.columns
    odd = spark.createDataFrame([(None, "a b", "x")] * 3 + [(9, "A b", "x")] * 2, "doc_id long, text string, node string")
    assert [r.doc_id for r in simhash_dedup(odd).collect()] == [9]
    assert simhash_dedup(df.limit(0)).count() == 0


def test_shards_in_pieces(spark):
    from docquarry.llm.simhash import similar_groups

    rng = random.Random(2)
    base = [f"v{i}" for i in range(60)]
    docs = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(60)] = f"c{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_groups(docs)
    for piece in (300_000, 400):
        assert {r["first"].doc_id for r in similar_groups(df, piece=piece).collect()} == want


def test_unlearned_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    texts = [
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10))) for _ in range(60)),
        "это текст на русском языке который не был выучен и должен быть отвергнут",
        "tämä on suomenkielinen teksti jota ei ole opittu ja joka pitäisi hylätä kokonaan",
        "这是一段没有学过的中文文本应该被拒绝",
    ]
    odd = spark.createDataFrame(list(enumerate(texts, 10**6)), "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)  # without lang: not learned from
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, SF).collect()}
    assert not kept & set(range(10**6, 10**6 + len(texts)))
    assert kept == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}


def test_batches_to_python_are_small(spark, tmp_path, monkeypatch):
    """Long texts reach Python a few at a time, in the stages that run there."""

    def seen(df, at):
        def of(batches):
            import uuid

            for b in batches:
                at.joinpath(uuid.uuid4().hex).write_text(str(b.nbytes))
                yield b

        at.mkdir()
        return df.mapInArrow(of, df.schema)

    identified, described = langid.identified, simhash_module._described
    monkeypatch.setattr(langid, "identified", lambda docs, *a: identified(seen(docs, tmp_path / "language"), *a))
    monkeypatch.setattr(simhash_module, "_described", lambda docs: described(seen(docs, tmp_path / "near")))
    longest = 120_000
    docs = spark.range(0, 40, 1, 1).select(
        F.col("id").alias("doc_id"), F.rpad(F.concat(F.lit("der hund und die katze gehen heute nach hause "), F.col("id").cast("string")), longest, " und der hund").alias("text"),
        F.lit("de").alias("lang"), F.lit("s").alias("source"), F.lit(longest).cast("long").alias("n_chars"),
    )
    docs = written(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 40)).coalesce(1), "long")
    bound = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    kept = written(corpus_pipeline.language_id(spark, docs, SF), "kept")
    assert kept.count() == 80 and kept.columns == docs.columns
    assert corpus_pipeline.simhash_dedup(spark, kept, SF).count() == 40  # the words that differ are enough
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == bound
    for stage in ("language", "near"):
        sizes = [int(f.read_text()) for f in (tmp_path / stage).iterdir()]
        assert sum(sizes) > 79 * longest and max(sizes) < (1 << 21) + 2 * longest


def test_pairs_at_the_threshold():
    def pairs(shared, a, b, n):
        rng = np.random.default_rng(9)
        for _ in range(n):
            h = rng.integers(0, 1 << 63, a + b - shared, np.uint64)
            yield np.sort(h[:a]), np.sort(np.concatenate((h[:shared], h[a:])))

    assert all(set(bands(x)) & set(bands(y)) for x, y in pairs(40, 45, 45, 12_000))
    far = [(x, y) for x, y in pairs(4, 4, 5, 20_000) if ((simhash(x) ^ simhash(y)) & (2**64 - 1)).bit_count() > 24]
    assert far and all(similar([1, 2], [x, y], [False, False]) for x, y in far)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*(n for n, _ in KINDS)).collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language_id":
            assert {r.doc_id for r in out.collect()} == {b[0] for b in before if b[1] and any(c.isalpha() for c in b[1])}
        elif name == "line_dedup":
            want = rows(linededup.OP4_SQL, ["doc_id", "text"], documents=(KINDS, before))
            whole = {b[0]: b[1] for b in before}
            assert got(out, ["doc_id", "text"]) == [w for w in want if w[1].strip(" \t\n\r\x0b\x0c") or w[1] == whole[w[0]]]
            assert out.where(F.length("text") != F.col("n_chars")).isEmpty()
        elif name == "simhash_dedup":
            assert {r.doc_id for r in out.collect()} == brute_groups([b[:2] for b in before])
        elif name == "decontamination":
            item = [("item_id", pa.int64()), ("text", pa.string())]
            bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = rows(decontaminate.OP8_SQL, ["doc_id", "contaminated"], documents=(KINDS, before), benchmark=(item, bench))
            assert {r.doc_id for r in out.collect()} == {d for d, bad in want if not bad}
        else:
            want = rows(mixing.OP5_SQL, ["doc_id", "taken"], documents=(KINDS, before))
            assert got(out.groupBy("doc_id").agg(F.sum("taken").alias("taken")), ["doc_id", "taken"]) == [w for w in want if w[1] > 0]
            assert out.where(F.size(F.split(F.trim("text"), r"\s+")) != F.col("taken")).isEmpty()
        if name != "mixture":
            assert out.columns == docs.columns
        docs = out
        kept.append(out.count())
    assert kept[-1] > 0
    assert got(corpus_pipeline.run(spark, SF), ["doc_id", "epoch", "taken", "text"]) == got(docs, ["doc_id", "epoch", "taken", "text"])
