"""SimHash near-duplicates: 64-bit fingerprints, searched through BK-trees of bounded size.

A BK-tree keeps each fingerprint below its parent under their Hamming distance; a search follows only
edges within the radius. One tree of a whole corpus grows with it and can't be broadcast, so trees are
built per shard, inside the task that searches them: fingerprints that differ in at most two bits agree on
one of three bit blocks, and each block value is a shard. A shard above SHARD fingerprints is dealt anew by
the blocks of its other bits; what is still above is cut into pieces of SHARD, and each pair of pieces is
one tree and its queries. Equal fingerprints are one node, and a shard tells its links as a star, so
neither copies nor dense shards give pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import Scratch, components, fresh, joined_back, own, small_batches, table, text_hash, written

#: Largest BK-tree, in fingerprints.
SHARD = 512
RADIUS = 2
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles (XXH64, seed 42); without words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        h = np.array([hashed(whole[s:e], 42) for s, e in zip(first[at : at + STEP], last[at : at + STEP])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, fp long")


class BKTree:
    """Children are keyed by the integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.items.append(x)
        self.children.append({})
        if len(self.items) == 1:
            return
        at = 0
        while True:
            d = (self.items[at] ^ x).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.items) - 1
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """Places, in order of addition, of the items within the radius."""
        found, todo = [], [0] if self.items else []
        while todo:
            at = todo.pop()
            d = (self.items[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            for edge, below in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(below)
        return found


def linked(fps: list[int], side: list[bool], radius: int) -> list[tuple[int, int]]:
    """Star edges of the groups that links between the sides form; where all are of the first side, links within it."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree, place, mask = BKTree(), [], (1 << 64) - 1
    one = not any(side)
    for i in range(len(fps)):
        x = fps[i] & mask
        if one:
            for j in tree.within(x, radius):
                root[find(place[j])] = find(i)
        if not side[i]:
            tree.add(x)
            place.append(i)
    if not one:
        for i in range(len(fps)):
            if side[i]:
                for j in tree.within(fps[i] & mask, radius):
                    root[find(place[j])] = find(i)
    return [(fps[i], fps[r]) for i in range(len(fps)) if (r := find(i)) != i]


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    """Edges from rows(key, fp, side), each partition of which holds the rows of a key one after the other."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, side = None, [], []
        for b in batches:
            out = []
            for k, fp, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != key:
                    if len(fps) > 1:
                        out += linked(fps, side, radius)
                    key, fps, side = k, [], []
                fps.append(fp)
                side.append(s)
            yield edges(out)
        yield edges(linked(fps, side, radius) if len(fps) > 1 else [])

    def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
        found = list(dict.fromkeys(found))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.select("key", "fp", "side").mapInArrow(of, "a long, b long")


def _blocks(fp: Column, cuts: list[tuple[int, int]]) -> list[Column]:
    """Per block of (first bit, bits): a key that tells block and value."""
    return [
        F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)) * F.lit(16) + F.lit(i)
        for i, (at, bits) in enumerate(cuts)
    ]


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, tmp: Scratch | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of the links between the distinct fp within the radius (2 at most).

    The result reads tables of tmp, which are to be dropped after it.
    """
    tmp = tmp or Scratch()
    if radius > 2:
        raise ValueError("three blocks find a distance of 2 at most")
    first = [(0, 21), (21, 21), (42, 22)]

    def counted(rows: DataFrame) -> DataFrame:
        """With n, the rows of their key, where there are several; counted before they move, and joined to where a hot key may be split."""
        return tmp(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "blocks")

    def together(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("n") <= shard).withColumn("side", F.lit(False))
        return rows.repartition("key").sortWithinPartitions("key")

    keyed = counted(fps.select("fp", F.explode(F.array(*_blocks(F.col("fp"), first))).alias("key")))
    edges = _searched(together(keyed), radius)
    # Too many for one tree: the bits outside the agreed block are cut into three again.
    large = keyed.where(F.col("n") > shard)
    finer = None
    for i, (at, bits) in enumerate(first):
        fp = F.col("fp")
        low, high = fp.bitwiseAND(F.lit((1 << at) - 1)), F.shiftrightunsigned(fp, at + bits) if at + bits < 64 else F.lit(0)
        rest = low.bitwiseOR(F.shiftleft(high.cast("long"), at))
        sub = F.explode(F.array(*_blocks(rest, [(0, 14), (14, 14), (28, 64 - bits - 28)]))).alias("sub")
        part = large.where(F.col("key") % 16 == i).select("fp", "key", sub)
        finer = part if finer is None else finer.unionByName(part)
    finer = counted(finer.select("fp", F.struct("key", "sub").alias("key")))
    edges = edges.unionByName(_searched(together(finer), radius))
    # And what still agrees: pairs of pieces.
    pieces = finer.where(F.col("n") > shard).withColumn("pieces", F.ceil(F.col("n") / F.lit(shard)).cast("long"))
    pieces = pieces.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    pieces = pieces.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    pieces = pieces.select(
        "fp",
        F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("key"),
        (F.col("own") > F.col("other")).alias("side"),
    )
    pieces = pieces.repartition("key").sortWithinPartitions("key")
    return edges.unionByName(_searched(pieces, radius)).where("a <> b")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach. A null text has no words and so fingerprint 0,
    which links like any other; rows with a null doc_id take part, and their component_id is null only if
    no row of their component has an id. Repeated rows stay as often as they are given; other columns are
    ignored; an empty table gives an empty result.
    """
    tmp = Scratch()
    fps = written(fingerprints(docs, shingle), "fingerprints")
    nodes = tmp(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes.select("fp"), radius, shard, tmp))
    smallest = nodes.join(found, nodes.fp == found.node).groupBy("component").agg(F.min("first").alias("component_id"))
    member = tmp(found.join(smallest, "component").select(F.col("node").alias("fp"), "component_id"), "members")
    classes = nodes.join(member, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    classes = written(classes, "classes")
    tmp.drop()
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicates by similarity -----------------------------------------------------------------------
#
# At a Jaccard similarity of 0.8 fingerprints differ in some ten bits, which no few blocks survive. Shards are then
# the groups that equal bands of min-hashes connect, a superset of the sought groups; each shard's texts meet once, a BK-tree
# over their fingerprints leads each text to the others within REACH bits, and these pairs are verified on
# the shingles themselves unless they are connected already.

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
#: Bits; five standard deviations above the expected distance at SIMILARITY. Sets of fewer than FEW shingles differ in more: FAR.
REACH = 24
FEW, FAR = 20, 32
#: Shingles that one side of a comparison holds, about; larger shards are cut into pieces, all pairs of which are compared.
PIECE = 300_000


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles; fewer words are one shingle, none gives none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((hashed(whole[s:e], 42) for s, e in pairs), np.uint64, n))


def simhash(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), STEP):
        ones += np.unpackbits(h[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def bands(h: np.ndarray) -> list[int]:
    """A key for each band of min-hashes of a set of hashes."""
    import xxhash

    rng = np.random.default_rng(17)
    odd = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
    mask = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(least, ((h[at : at + 2048, None] ^ mask) * odd).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [int(np.int64(np.uint64(xxhash.xxh64_intdigest(row.tobytes(), i)).view(np.int64))) for i, row in enumerate(rows)]


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, shingles, bands): node is a hash of the set of shingles, shingles their number."""
    import xxhash

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            sets = [shingles(t.as_py()) for t in b.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), 1) if len(h) else 0 for h in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(h) if len(h) else [] for h in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(h) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), sizes, keys], ["doc_id", "text_hash", "node", "shingles", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, text_hash long, node long, shingles long, bands array<long>")


def similar(nodes: list[int], sets: list[np.ndarray], side: list[bool], similarity: float = SIMILARITY, reach: int = REACH) -> list[tuple[int, int]]:
    """Star edges of the groups that pairs of that Jaccard similarity form; with both sides present only pairs between them count."""
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    both = any(side) and not all(side)
    of = [frozenset(h.tolist()) for h in sets]
    tree, place = BKTree(), []
    prints = [simhash(h) for h in sets]
    for i in sorted(range(len(nodes)), key=lambda i: side[i]):
        if not both or side[i]:
            for at in tree.within(prints[i], reach if len(of[i]) >= FEW else max(reach, FAR)):
                j = place[at]
                a, b = len(of[i]), len(of[j])
                if find(i) == find(j) or min(a, b) < similarity * max(a, b):
                    continue
                n = len(of[i] & of[j])
                if n >= similarity * (a + b - n):
                    root[find(i)] = find(j)
        if not both or not side[i]:
            tree.add(prints[i])
            place.append(i)
    return [(nodes[i], nodes[r]) for i in range(len(nodes)) if (r := find(i)) != i]


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, piece: int = PIECE) -> DataFrame:
    """(doc_id, text_hash, node, first) for each row of docs(doc_id, text); first is the struct of the row of its group that comes first.

    Texts are linked at that Jaccard similarity of their sets of SHINGLE-word shingles, and equal sets always are, texts without words
    among them. Rows are ordered by doc_id (null last), then by a hash of the text.
    """
    tmp = Scratch()
    with small_batches(docs.sparkSession):
        rows = written(_described(docs), "described")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = tmp(rows.groupBy("node").agg(F.min(at).alias("first"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands")), "sets")
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    loose = keyed.join(least, "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    shards = tmp(components(loose), "shards").join(nodes.select("node", "first", "shingles"), "node")
    shards = tmp(shards, "sized")
    sized = shards.groupBy("component").agg(F.sum("shingles").alias("all"))
    members = shards.join(sized, "component").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "node", "component", "all")
    members = tmp(members, "members")
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    texts = joined_back(plain, members, "m").where("m is not null").select("m.node", "m.component", "m.all", "text")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("all") / F.lit(piece))).cast("long")
    texts = texts.withColumn("own", F.pmod(F.xxhash64("node"), pieces))
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    key = F.struct("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = texts.select(F.xxhash64(key).alias("key"), "node", (F.col("own") > F.col("other")).alias("side"), "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, side = None, [], [], []

        def done() -> pa.RecordBatch:
            found = similar(nodes, sets, side, similarity) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

        for b in batches:
            for k, node, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if k != key:
                    yield done()
                    key, nodes, sets, side = k, [], [], []
                if node not in nodes[-1:]:  # rows that were given twice follow each other
                    nodes.append(node)
                    sets.append(shingles(t.as_py()))
                    side.append(s)
        yield done()

    texts = texts.repartition("key").sortWithinPartitions("key", "node")
    with small_batches(docs.sparkSession):
        groups = tmp(components(texts.mapInArrow(of, "a long, b long")), "groups")
    first = nodes.join(groups, "node").groupBy("component").agg(F.min("first").alias("least"))
    joined = groups.join(first, "component").select("node", "least")
    classes = nodes.select("node", "first").join(joined, "node", "left").select("node", F.coalesce("least", "first").alias("first"))
    classes = written(classes, "classes")
    tmp.drop()
    return rows.select("doc_id", "text_hash", "node").join(classes, "node")


def simhash_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs less all rows of a group of similar texts but the one with the smallest doc_id (null last).

    All columns stay. Of rows that agree in doc_id and text one stays; texts without words, null ones too, are one group. An empty table
    gives an empty result.
    """
    groups = similar_groups(docs, similarity)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    odd = groups.groupBy("doc_id", "text_hash").agg(F.min(mine == F.col("first")).alias("stays"), F.count("*").alias("n"))
    odd = written(odd.where("not stays or n > 1"), "odd")
    name, hashed = fresh(docs, "odd", "hashed")
    rows = joined_back(docs, odd, name)
    once = rows.where(F.col(name).isNull()).select(*own(docs))
    # Only where a row was given more than once.
    again = rows.where(F.col(f"{name}.stays")).withColumn(hashed, F.col(f"{name}.text_hash")).dropDuplicates(["doc_id", hashed]).select(*own(docs))
    return once.unionByName(again)
