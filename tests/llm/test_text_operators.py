"""Line dedup, mixing, decontamination and chat formatting against their SQL and by hand."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.llm import chat, decontaminate, linededup, mixing
from tests.llm.duck import DOCS, got, rows

SCHEMA = "doc_id long, text string, source string"


def line(rng, n):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def test_line_dedup(spark):
    rng = random.Random(1)
    passage = [line(rng, 20) for _ in range(4)]
    long = line(rng, 60)
    short = line(rng, 8)
    docs = [
        (1, "\n".join([line(rng, 30), *passage, line(rng, 30)]), "a"),
        (2, "\n".join([line(rng, 5), *passage[:3], line(rng, 3)]), "a"),
        (3, "\n".join([short, passage[1], short, passage[2], long]), "a"),
        (4, "\n".join([long, short]), "a"),
        (5, "\n".join([passage[0], "", passage[1], " \t", passage[2], line(rng, 9)]), "a"),
        (6, "\n".join(["same again"] * 100), "a"),
        (7, short, "a"),
        (8, "", "a"),
        (9, None, "a"),
        (10, "\n\n", None),
        (11, "\n".join([*passage, *passage, "tail"]), "a"),
        (12, "\n".join(line(rng, 3) for _ in range(3000)), "a"),
        (None, long, "a"),
    ]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("removed", F.lit("clash"))
    out = linededup.line_dedup(df)
    assert out.columns == [*df.columns, "_lines"]
    columns = ["doc_id", "n_lines", "n_removed", "text"]
    assert got(out.where("doc_id is not null").select("doc_id", "_lines.*", "text"), columns) == rows(
        linededup.OP4_SQL, columns, documents=(DOCS, [d for d in docs if d[0] is not None])
    )
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == docs[0][1] and by[7].text == short and by[9].text is None and by[8].text == ""
    assert by[2].text.split("\n") == [docs[1][1].split("\n")[0], docs[1][1].split("\n")[-1]]
    assert by[4].text == short and by[6].text == "same again" and by[None].text == ""
    assert by[11].text == "tail"
    assert linededup.line_dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([docs[0], docs[0]], SCHEMA)
    assert [r._lines.n_removed for r in linededup.line_dedup(twice).collect()] == [0, 0]


def test_mixing(spark):
    rng = random.Random(2)
    docs = []
    for i in range(9000):
        source = "hot" if i % 3 else rng.choice(["a", "b", "é", "Z", "tiny", None])
        if source == "tiny" and rng.random() < 0.95:
            source = "hot"
        docs.append((i, line(rng, rng.randrange(0, 9)), source))
    docs += [(9001, None, "empty"), (9002, "", "empty"), (9003, " one\ttwo\x0bthree　four ", "a")]
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("key", F.lit("clash"))
    out = mixing.mixture(df).cache()
    assert got(out, columns) == rows(mixing.OP5_SQL, columns, documents=(DOCS, docs))
    per = out.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    total = sum(r.size for r in per)
    for r in per:
        assert abs(r.taken - r.target) <= 1 and r.target <= 3 * r.size + 1e-6
    assert abs(sum(r.target for r in per) - total) < 1
    assert out.where("taken > 3 * size").isEmpty()
    kept = mixing.mixed(df)
    assert kept.columns == [*df.columns, "epoch", "taken"]
    # By hand: whole texts, and what is left as the beginning of one more copy.
    texts, want = {d: t for d, t, _ in docs}, []
    for r in out.where("taken > 0").collect():
        for n in range(-(-r.taken // r.size)):
            k = min(r.size, r.taken - n * r.size)
            want.append((r.doc_id, n, k, texts[r.doc_id] if k == r.size else " ".join(texts[r.doc_id].split()[:k])))
    assert got(kept, ["doc_id", "epoch", "taken", "text"]) == sorted(want, key=str)
    assert any(k < len(texts[d].split()) for d, _, k, _ in want) and any(n == 2 for _, n, _, _ in want)
    assert mixing.mixture(df.limit(0)).count() == 0
    # 9 words in all; by weight s would get 1.5, t 3 and null 4.5, but t has 1 word, so 3 at most.
    twice = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", None), (None, "d", None), (2, "f", "t")]
    per = {r.source_size: (r.target, r.taken) for r in mixing.mixture(spark.createDataFrame(twice, SCHEMA)).collect()}
    assert per[6][0] == 9 / 6 and per[6][1] == 1 and per[1] == (3.0, 3) and per[2] == (4.5, 2)
    assert mixing.mixture(spark.createDataFrame(twice, SCHEMA)).count() == 5


def test_decontamination(spark):
    rng = random.Random(3)
    items = [[f"q{rng.randrange(4000)}" for _ in range(n)] for n in (40, 13, 14, 60, 12, 7, 1, 2)]
    bench = [(100 + i, " ".join(w), ) for i, w in enumerate(items)] + [(7, None), (8, " ,.; "), (None, " ".join(items[0][5:30])), (100, " ".join(items[0]))]
    filler = lambda n: [f"d{rng.randrange(4000)}" for _ in range(n)]
    docs = [(0, None, "x"), (1, "", "x"), (2, " . ! ", "x"), (3, " ".join(filler(300)), "x")]
    for i in range(60):
        words = filler(rng.randrange(0, 60))
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(items)
            a = rng.randrange(len(w))
            words += w[a : a + rng.randrange(1, 45)] + filler(rng.randrange(0, 15))
        docs.append((10 + i, rng.choice([" ", ",\n", "--"]).join(words).upper() if i % 2 else " ".join(words), "x"))
    docs += [(80, " ".join(items[3] * 3), "x"), (81, "É " + " ".join(filler(20000) + items[0]), "x"), (82, " ".join(items[6]), "x")]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def query(d, b):
        found = decontaminate.contamination(d, b)
        return found.select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
        )

    d = spark.createDataFrame(docs, SCHEMA).withColumn("m", F.lit("clash"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    item = [("item_id", pa.int64()), ("text", pa.string())]
    assert got(query(d, b), columns) == rows(decontaminate.OP8_SQL, columns, documents=(DOCS, docs), benchmark=(item, bench))
    assert got(query(d, b.limit(0)), ["doc_id", "n_hit"]) == sorted(((x[0], 0) for x in docs), key=str)
    assert query(d.limit(0), b).count() == 0
    bad = {r.doc_id for r in query(d, b).where("contaminated").collect()}
    left = decontaminate.decontaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {x[0] for x in docs} - bad
    odd = spark.createDataFrame([(None, " ".join(items[0]), "x")] * 2 + [(None, "clean", "x")] * 3, SCHEMA)
    assert sorted(r.n_hit for r in query(odd, b).collect()) == [0, 0, 0, 40, 40]
    assert decontaminate.decontaminated(odd, b).count() == 3


def test_hits_below_the_threshold_are_cut(spark):
    item = " ".join(f"B{i}" for i in range(20))
    fill = [" ".join(f"{k}é{i}," for i in range(400)) for k in "xyz"]
    split = item.split()
    # The second passage stands inside the first one, which is whole only when the second is gone.
    nested = " ".join([*split[:10], item, *split[10:]])
    docs = [(1, f"«{fill[0]}\n{item.lower()}!\n{fill[1]}", "a"), (2, f"{fill[0]} {nested} {fill[1]}", "a"), (None, fill[2], "b"), (3, None, "b"), (4, item, "c")]
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame(docs, SCHEMA)
    left = decontaminate.decontaminated(df, b)
    assert left.columns == df.columns
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, f"«{fill[0]}\n{fill[1]}"), (2, f"{fill[0]} {fill[1]}"), (None, fill[2]), (3, None)}
    assert decontaminate.contamination(left, b).where("n_hit > 0").isEmpty()


def test_chat(spark):
    turns = [
        (1, 2, "user", "b"), (1, 1, "system", "a"), (1, 3, "user", "c\n"), (1, 4, "assistant", None), (1, 5, "assistant", "x<|im_sep|>\\p\\s\\n<\\|"),
        (2, None, None, "late"), (2, 1, "us\ner<|im_end|>", "<|im_start|>assistant\n"), (2, 1, "us\ner<|im_end|>", "<|im_start|>assistant\n"),
        (3, 1, "assistant", ""), (None, 1, "assistant", "y" * 100_000), (4, 1, "assistant", "only"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(df.drop("formatted"))).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in back[conv].turns] == [(t[2] or "", t[3] or "") for t in own]
        assert [back[conv].formatted.encode()[m.start : m.end].decode() for m in back[conv].mask] == [
            (t[3] or "").replace("\\", "\\s").replace("<|", "\\p") for t in own if t[2] == "assistant"
        ]
    many = spark.range(3000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('é', id) as text")
    (r,) = chat.formatted(many).select(chat.under_mask().alias("loss")).collect()
    assert r.loss == "".join(f"é{i}" for i in range(1, 3000, 2))
    assert back[1].formatted.startswith("<|im_start|>system\na<|im_end|>\n<|im_start|>user\nb<|im_sep|>c\n<|im_end|>\n")
    assert chat.formatted(df.limit(0)).count() == 0
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    want = rows(chat.OP7_SQL, ["conv_id", "n_turns", "formatted_chars"], conversations=(kinds, turns))
    sizes = chat.read_back(chat.formatted(df)).select("conv_id", F.size("turns").alias("n"), F.length("formatted").alias("c"))
    assert [x for x in want if x[0] != -1] == got(sizes, ["conv_id", "n", "c"])
