"""Embedding near-duplicates through a forest of random-projection trees.

Each tree splits recursively along random directions; a vector near a split goes to both sides, so that close
vectors share a leaf of some tree with near certainty. Within leaves all vectors are compared in double
precision. Equal vectors are one node with a multiplicity. A link is counted in the first (tree, leaf) that
its ends share and nowhere else, as a number per node, and components are told by stars: no list of pairs is
made. The directions and the upper thresholds are fitted on a bounded sample; every vector is indexed.

Leaves are counted first, without vectors; each vector then goes to each of its leaves once, and too large a leaf is
compared in pairs of pieces. Tasks tell which leaves two vectors share from the forest itself, so rows don't carry it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import Scratch, components, small_broadcast, table, written

COSINE = 0.98
#: A tree misses 3 % of the links at depth 8, 5 % at 12, 9 % at 20 (measured at the threshold), so three miss under 0.1 %.
TREES = 3
#: Vectors in a leaf, about; leaves above LIMIT are compared in pieces.
LEAF, LIMIT = 256, 1024
#: Thresholds come from the medians of this many vectors at most, down to nodes that hold NODE of them.
SAMPLE, NODE = 8192, 32
#: Half the width of the overlap, in standard deviations of the projected distance of vectors at the threshold.
SPILL = 0.75


def _along(x: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Products of rows with a direction, the same for a row whatever the others are, unlike those of a matrix product."""
    return np.einsum("ij,j->i", x, direction)


class Forest:
    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, cosine: float = COSINE, seed: int = 7) -> None:
        """sample: unit vectors (n, dimensions)."""
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.depth, self.margin = depth, SPILL * np.sqrt(2 * (1 - cosine) / dims)
        self.directions = rng.normal(size=(trees, depth, dims))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        #: By tree and level: threshold of each node; below the sample's reach a node has its level's median.
        self.thresholds: list[list[np.ndarray]] = []
        for t in range(trees):
            code, levels = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                p = _along(sample, self.directions[t, level])
                middle = float(np.median(p)) if len(p) else 0.0
                nodes = 1 << level if (1 << level) * NODE <= len(sample) else 0
                own = np.full(nodes, middle)
                for node in range(nodes):
                    if (inside := code == node).sum() >= NODE:
                        own[node] = np.median(p[inside])
                levels.append(np.append(own, middle))
                code = 2 * code + (p > levels[-1][np.minimum(code, nodes)])
            self.thresholds.append(levels)

    def leaves(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per tree: rows and leaf codes, a row for each leaf of a vector."""
        for t, levels in enumerate(self.thresholds):
            row, code = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level, own in enumerate(levels):
                p = _along(x, self.directions[t, level])[row] - own[np.minimum(code, len(own) - 1)]
                left, right = p <= self.margin, p > -self.margin
                row, code = np.concatenate((row[left], row[right])), np.concatenate((2 * code[left], 2 * code[right] + 1))
            yield row, code


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shared_before(forest: Forest, x: np.ndarray, tree: int, leaf: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows of x share a leaf of an earlier tree, or an earlier leaf of this one."""
    some, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    out = np.zeros(len(i), bool)
    for t, (row, code) in enumerate(forest.leaves(x[some])):
        if t > tree:
            break
        if t == tree:
            row, code = row[code < leaf], code[code < leaf]
        if not len(code):
            continue
        _, code = np.unique(code, return_inverse=True)
        member = np.zeros((len(some), code.max() + 1), bool)
        member[row, code] = True
        for k in range(0, len(i), 1 << 14):
            part = slice(k, k + (1 << 14))
            out[part] |= (member[i[part]] & member[j[part]]).any(1)
    return out


def compared(x: np.ndarray, n: np.ndarray, side: np.ndarray, forest: Forest, tree: int, leaf: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Per vector: newly found links, weighted by multiplicities, and the place of its group's first member.

    With both sides present only links between them count.
    """
    x = _unit(x)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if side.any():
        near &= side[:, None] != side[None, :]
    links = np.zeros(len(x), np.int64)
    i, j = np.nonzero(np.triu(near))
    if len(i):
        new = ~_shared_before(forest, x, tree, leaf, i, j)
        np.add.at(links, i[new], n[j[new]])
        np.add.at(links, j[new], n[i[new]])
    root = np.arange(len(x))
    while len(i):
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if (new == root).all():
            break
        root = new[new]
    return links, root


def _raw(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims)


def _in_leaves(rows: DataFrame, dims: int, kind: str, cosine: float, forest) -> DataFrame:
    """(node, root, links) from rows(tree, label, code, i, j, node, n, side, vector), in which those of a leaf, or pair of pieces, follow each other."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)], 1)
            node, n, side = (b.column(c).to_numpy(zero_copy_only=False) for c in (5, 6, 7))
            vectors = _raw(b.column(8), kind, dims)
            ends = [*(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
            out, start = [], 0
            for end in ends if len(keys) else ():
                if (own := tuple(keys[start].tolist())) != key:
                    out.append(compare(key, held))
                    key, held = own, []
                held.append(tuple(c[start:end] for c in (node, n, side, vectors)))
                start = end
            yield batch(out)
        yield batch([compare(key, held)])

    def compare(key, held: list[tuple]) -> np.ndarray:
        none = np.zeros((3, 0), np.int64)
        if not held:
            return none
        node, n, side, x = (np.concatenate([h[c] for h in held]) for c in range(4))
        if len(node) < 2:
            return none
        links, root = compared(x.astype(np.float64), n, side, forest.value, key[0], key[2], cosine)
        some = np.nonzero((links > 0) | (root != np.arange(len(node))))[0]
        return np.stack((node[some], node[root[some]], links[some]))

    def batch(out: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([*out, np.zeros((3, 0), np.int64)], 1)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in every], ["node", "root", "links"])

    return rows.select("tree", "label", "code", "i", "j", "node", "n", "side", "vector").mapInArrow(of, "node long, root long, links long")


def _links(classes: DataFrame, dims: int, forest: Forest, kind: str, cosine: float, limit: int, tmp: Scratch) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def dealt(batches: Iterator[pa.RecordBatch], vectors: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                p = b.slice(at, 2048)
                raw = p.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(p.num_rows, dims)
                for t, (row, code) in enumerate(shared.value.leaves(_unit(raw.astype(np.float64)))):
                    take = pa.array(row)
                    columns = [pa.array(np.full(len(row), t, np.int32)), p.column(2).take(take), pa.array(code)]
                    names = ["tree", "label", "code"]
                    if vectors:
                        ends = pa.py_buffer((np.arange(len(row) + 1) * raw[0].nbytes).astype(np.int32))
                        columns += [p.column(0).take(take), p.column(1).take(take), pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(raw[row].tobytes())])]
                        names += ["node", "n", "vector"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    source, leaf = classes.select("node", "n", "label", "embedding"), ["tree", "label", "code"]
    narrow = source.mapInArrow(lambda bs: dealt(bs, False), "tree int, label long, code long")
    sizes = narrow.groupBy(leaf).agg(F.count("*").alias("size")).where(F.col("size") > limit)
    pieces = F.ceil(2 * F.col("size") / F.lit(limit)).cast("long")
    large = small_broadcast(tmp(sizes.select(*leaf, pieces.alias("pieces")), "leaves"))
    rows = source.mapInArrow(lambda bs: dealt(bs, True), "tree int, label long, code long, node long, n long, vector binary")
    rows = rows.join(large, leaf, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    # Each pair of pieces of a leaf is compared by itself.
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": F.col("own") > F.col("other")}).drop("own", "other", "pieces")
    key = [*leaf, "i", "j"]
    return _in_leaves(rows.repartition(*key).sortWithinPartitions(*key), dims, kind, cosine, shared)


def embedding_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, limit: int = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label).

    Rows of one label link at that cosine or above. A null label, and an embedding that is null, empty, zero or
    holds null or non-finite numbers, links with nothing: n_links 0, component_id the row's own vec_id. Vectors of
    different lengths don't link. Repeated rows are vectors of their own; a null vec_id takes part, is never kept, and
    its component_id is that of the others, if any. Other columns are ignored; an empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind, numbers = ("<f4", "float") if kind == "float" else ("<f8", "double")
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast(f"array<{numbers}>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    # + 0 makes -0.0 the other zero, which it equals.
    own = F.when(valid, F.xxhash64("label", F.transform("embedding", lambda x: x + F.lit(0).cast(numbers))))
    v = v.withColumn("node", own)
    classes = v.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("first")
    )
    tmp = Scratch()
    classes = tmp(classes, "vectors")
    sizes = classes.groupBy(F.size("embedding").alias("dims"), "label").count().groupBy("dims").agg(F.max("count").alias("most")).collect()
    found = None
    for dims, most in ((r.dims, r["most"]) for r in sizes):  # one for each length of vectors
        some = classes.where(F.size("embedding") == dims)
        sample = [r.embedding for r in some.orderBy("node").limit(SAMPLE).select("embedding").collect()]
        depth = max(0, int(np.ceil(np.log2(most / leaf))))
        forest = Forest(_unit(np.array(sample, np.float64)), depth, trees if depth else 1, cosine)
        part = _links(some, dims, forest, kind, cosine, limit, tmp)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = v.sparkSession.createDataFrame([], "node long, root long, links long")
    found = tmp(found, "links")
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = group.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    member = group.join(least, "component").select("node", "least")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "n", "first").join(counts, "node", "left").join(member, "node", "left")
    known = written(known.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("least")), "known")
    tmp.drop()
    out = v.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (
  SELECT *, len(x) AS dims FROM v WHERE label IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(x, lambda e: e <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.label = b.label AND a.dims = b.dims AND a.r <> b.r AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN comp ON comp.a = v.r LEFT JOIN n ON n.a = v.r
"""
