import numpy as np
import pytest

from docquarry.llm.embeddings import embedding_duplicates


def brute(rows, cosine=0.98):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    adj = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    adj[i].append(j)
                    adj[j].append(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in adj[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(adj[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    f = np.float32 if kind == "float" else np.float64
    rows = []

    def add(x, label):
        rows.append((len(rows), [float(v) for v in np.asarray(x, f)] if x is not None else None, label))

    for label in (0, 1, None):
        for _ in range(120):
            add(rng.normal(size=16), label)
        base = rng.normal(size=16)
        base /= np.linalg.norm(base)
        for _ in range(70):  # a dense group, and chains at the edge of it
            add(base + rng.normal(size=16) * rng.choice([0.005, 0.03]), label)
        for _ in range(9):
            add(base * 3, label)
    add(None, 0)
    add([0.0] * 16, 0)
    add([float("nan")] + [1.0] * 15, 0)
    add([float("inf")] + [1.0] * 15, 0)
    add([], 0)
    add([1.0] * 8, 0)
    add([1.0] * 8, 0)
    add([-0.0, 1.0], 1)
    add([0.0, 2.0], 1)
    rows.append((7, rows[7][1], rows[7][2]))
    rows.append((None, rows[8][1], rows[8][2]))
    rows.append((None, [None, 1.0], 1))
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, node string")
    want = brute(rows)
    for leaf, limit in ((256, 1024), (16, 1024), (16, 24)):
        got = sorted((tuple(r) for r in embedding_duplicates(df, leaf=leaf, limit=limit).collect()), key=str)
        assert got == want, (leaf, limit)
    assert embedding_duplicates(df.limit(0)).count() == 0
