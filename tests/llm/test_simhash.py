import random

import numpy as np
import xxhash

from docquarry.llm.common import components
from docquarry.llm.simhash import BKTree, fingerprint, links, near_duplicates


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    x = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return x - (1 << 64) if x >> 63 else x


def brute_components(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = np.array(sorted(fps), np.int64).view(np.uint64)
    for i, x in enumerate(u):
        near = np.bitwise_count(u[i + 1 :] ^ x) <= radius
        for y in u[i + 1 :][near]:
            a, b = find(int(np.int64(x.view(np.int64)))), find(int(y.view(np.int64)))
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def test_fingerprint():
    for text in (None, "", " \n\t", "one", "Two words", "a b c", "É a\x0bB c d e　f g", "x " * 500, "ÀÉ ẞ İ k ſ"):
        assert fingerprint(text) == brute_fingerprint(text), text


def test_tree():
    rng = random.Random(1)
    items = [rng.getrandbits(8) for _ in range(200)]
    tree = BKTree()
    for x in items:
        tree.add(x)
    for q in range(0, 256, 7):
        assert sorted(tree.within(q, 2)) == [i for i, x in enumerate(items) if (x ^ q).bit_count() <= 2]


def groups(pairs):
    out = {}
    for node, c in pairs:
        out.setdefault(c, set()).add(node)
    return {frozenset(x) for x in out.values() if len(x) > 1}


def test_links_at_every_level(spark):
    rng = random.Random(2)
    fps = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = groups(brute_components(fps).items())
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for shard in (512, 8, 3):
        found = components(links(df, 2, shard))
        assert groups((r.node, r.component) for r in found.collect()) == want, shard


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(2000, i) for i in range(2001, 2200)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(2000):
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert found == {x: root[x] for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    long = [rng.choice(words) for _ in range(2500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "c") for i in range(40)]
    near = list(long)
    near[1200] = "changed"
    rows += [(100, " ".join(long), "c"), (90, " ".join(near), "c"), (91, " ".join(long).upper(), "c"), (92, None, "c"), (80, "", "c"), (None, " ", None)]
    rows += [rows[3], rows[3], (None, "lonely text without an id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = near_duplicates(df).collect()
    fps = {brute_fingerprint(t) for _, t, _ in rows}
    comp, least = brute_components(fps), {}
    for d, t, _ in rows:
        c = comp[brute_fingerprint(t)]
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    want = sorted(((d, brute_fingerprint(t), least[comp[brute_fingerprint(t)]]) for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=str) == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from docquarry.llm.simhash import op1_simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    comp, least = brute_components(set(fps.values())), {}
    for d, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], d), d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect()}
    assert got == {d: (f"{f & (1 << 64) - 1:016x}", least[comp[f]]) for d, f in fps.items()}
