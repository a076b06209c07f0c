"""Toxic spans and document scores from a linear-chain conditional random field.

Only documents are labelled, so the labels of tokens are learned with the field. A token's features are its word or
beginning, its neighbours, its ending, its shape and hashed beginnings. The field gives each document the exact chance that none of its
tokens is toxic, and is fitted to the labels of documents: in clean ones no token is toxic, in toxic ones at least one is,
whichever the marginals given that say, anew in each round. The first round starts from words that toxic documents have
far more often than chance allows. Over the whole table the same chance is a text's score, calibrated on
documents that were held back, and tokens that are likely toxic are its spans.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import in_fold, table

TOKEN = re.compile(r"[^\W_]+")
#: Bounds of the sample: documents of each label, by the hash of their ids, and segments of SEGMENT tokens of all.
TRAIN_DOCS, TRAIN_SEGMENTS, SEGMENT = 2500, 40_000, 48
#: Units that may be taken for toxic by accident, as an expected number, and the least ratio of document shares.
ERROR, RATIO = 1.0, 6.0
#: Lengths of the beginnings of words that are units as well.
BEGINNINGS = (6, 5, 4)
CACHE = 200_000
#: Other words with a weight of their own; hashed endings of ENDING letters; shapes: length to 15, digits, letters beyond ASCII.
COMMON, ENDINGS, ENDING, SHAPES = 3000, 1024, 3, 64
#: Hashed beginnings of each length of BEGINNINGS.
STEMS = 4096
#: Log odds that a word of the lexicon begins with at most.
MOST = -1.0
#: Rounds and step of the fit; pull of weights towards where they began; chances that a toxic label, and a clean one, is wrong.
ROUNDS, RATE, PULL, WRONG_TOXIC, WRONG_CLEAN = 20, 0.5, 2.0, 0.02, 0.002
#: One of so many parts of the sample's documents is held back for calibration; a field of all would be surer than the one calibrated.
FOLDS = 4


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


@dataclass
class Model:
    units: dict[str, int]  # id 0: all others
    weights: np.ndarray  # emission of the toxic state less that of the clean one, by feature
    trans: np.ndarray  # log weights of steps, [from, to]
    start: float
    scale: tuple[float, float]  # of the document score's logit

    def words(self) -> "Words":
        return Words(self)


def marginals(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: float, pairs: bool = False):
    """Of each token of sequences that lie in e one after the other, P(toxic), and the log chance that it is clean after clean ones.

    The latter's sum over a sequence is the log chance that none is toxic. With pairs also, for each token but the first
    of its sequence, the chances of the steps to it, (4, tokens), from and to 00, 01, 10, 11.
    e: emission log ratios. Works on all sequences at once, position by position: f is the log ratio of forward
    weights, b that of backward ones.
    """
    n = len(e)
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    f, b = np.zeros(n), np.zeros(n)
    most = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(most), side="left")  # sequences longer than t
    f[begin[: active[0]] if most else []] = e[begin[: active[0]]] + start if most else 0
    (t00, t01), (t10, t11) = np.exp(trans)
    for t in range(1, most):
        at = begin[: active[t]] + t
        x = np.exp(np.clip(f[at - 1], -50, 50))
        f[at] = e[at] + np.log((t01 + t11 * x) / (t00 + t10 * x))
    last = begin + size - 1
    for t in range(1, most):
        at = last[: active[t]] - t
        x = np.exp(np.clip(b[at + 1] + e[at + 1], -50, 50))
        b[at] = np.log((t10 + t11 * x) / (t00 + t01 * x))
    p = 1 / (1 + np.exp(-np.clip(f + b, -50, 50)))
    first = begin[: active[0]] if most else []
    base = np.full(n, trans[0, 1] - trans[0, 0])
    base[first] = start
    clean = -np.logaddexp(0.0, base + e + b)
    if not pairs:
        return p, clean
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.nonzero(inner)[0]
    x, y = np.exp(np.clip(f[at - 1], -50, 50)), np.exp(np.clip(b[at] + e[at], -50, 50))
    w = np.stack([np.full(len(at), t00), t01 * y, x * t10, x * t11 * y])
    return p, clean, w / w.sum(0)


def _bounds(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    s = np.array(sizes, np.int64)
    return np.concatenate(([0], np.cumsum(s)[:-1])).astype(np.int64) if len(s) else s, s


def units_of(word: str) -> list[str]:
    """The word, and its beginnings, longest first, each with a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def lexicon(segments: list[tuple[int, int, list[str]]]) -> set[str]:
    """Toxic words and beginnings of words of (document, toxic, tokens): those that toxic documents have too often for chance.

    Documents count as often as their least contexts of a unit differ, so copies count once. By the Chernoff bound
    a unit passes if, of all units tried, at most ERROR would have its share of toxic documents by chance. A beginning
    of a single word says no more than the word and is left out.
    """
    contexts, clean, n = defaultdict(set), Counter(), [1, 1]
    for (_, toxic), parts in groupby(sorted(segments, key=lambda s: s[:2]), key=lambda s: s[:2]):
        n[toxic] += 1
        least: dict[str, tuple[str, str]] = {}
        for _, _, words in parts:
            for i, w in enumerate(words):
                near = (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                least[w] = min(near, least.get(w, near))
        for w, near in list(least.items()):
            for u in units_of(w)[1:]:
                least[u] = min(near, least.get(u, near))
        if toxic:
            for u, near in least.items():
                contexts[u].add(near)
        else:
            clean.update(least.keys())
    shared = Counter(b for u in contexts if not u.endswith("*") for b in units_of(u)[1:])
    p, out = n[1] / sum(n), set()
    enough = np.log(max(len(contexts), 1) / ERROR)
    for u, of in contexts.items():
        a, b = len(of), clean[u]
        q = a / (a + b)
        if u.endswith("*") and shared[u] < 2:
            continue
        if q > p and a / n[1] >= RATIO * (b + 0.5) / n[0]:
            bits = q * np.log(q / p) + ((1 - q) * np.log((1 - q) / (1 - p)) if b else 0)
            if (a + b) * bits >= enough:
                out.add(u)
    return out


class Features(dict):
    """Of tokens: unit, ending and shape. A token that isn't a unit has its longest beginning's, or 0. Keeps CACHE tokens."""

    def __init__(self, units: dict[str, int]) -> None:
        self.units, self.n = units, len(units) + 1
        self.base = np.cumsum([0, self.n, self.n, self.n, ENDINGS, SHAPES] + [STEMS] * len(BEGINNINGS))
        self.size = int(self.base[-1])
        self.width = 3 + len(BEGINNINGS)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = self.told(word)
        return found

    def told(self, word: str) -> tuple[int, ...]:
        unit = self.units.get(word) or next((self.units[u] for u in units_of(word)[1:] if u in self.units), 0)
        digits = not word.isalpha() and any(c.isdigit() for c in word)
        of = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (word[-ENDING:], *(word[:k] for k in BEGINNINGS))]
        return (unit, of[0] % ENDINGS, 4 * min(len(word), 15) + 2 * digits + (not word.isascii()), *(x % STEMS for x in of[1:]))

    def of(self, tokens: list[list[str]], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(features, tokens): places in the weights of unit, units before and after (0: none), ending, shape and beginnings."""
        n, get = int(sizes.sum()), self.__getitem__
        own = np.fromiter((x for words in tokens for w in words for x in get(w)), np.int32, self.width * n).reshape(n, self.width)
        out = np.zeros((self.width + 2, n), np.int32)
        out[0] = own[:, 0]
        out[1, 1:], out[2, :-1] = out[0, :-1], out[0, 1:]
        begin = starts[sizes > 0]
        out[1, begin] = 0
        out[2, begin + sizes[sizes > 0] - 1] = 0
        out[3:] = own[:, 1:].T
        return out + self.base[:-1, None].astype(np.int32)


class Words(dict):
    """Of tokens: unit, and the part of the emission that doesn't depend on neighbours. Keeps CACHE tokens."""

    def __init__(self, model: Model) -> None:
        self.features, self.model = Features(model.units), model
        self.weights = model.weights.tolist()
        self.own = [int(self.features.base[i]) for i in (0, *range(3, self.features.width + 2))]

    def __missing__(self, word: str) -> tuple[float, float]:
        at = self.features.told(word)
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = (float(at[0]), sum(self.weights[a + i] for a, i in zip(self.own, at)))
        return found

    def emissions(self, tokens: list[list[str]], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sums of the weights that Features.of() leads to."""
        n, get, f, w = int(sizes.sum()), self.__getitem__, self.features, self.model.weights
        own = np.fromiter(chain.from_iterable(map(get, chain.from_iterable(tokens))), float, 2 * n).reshape(n, 2)
        unit, e = own[:, 0].astype(np.int32), own[:, 1].copy()
        before, after = np.zeros(n, np.int32), np.zeros(n, np.int32)
        before[1:], after[:-1] = unit[:-1], unit[1:]
        begin = starts[sizes > 0]
        before[begin] = after[begin + sizes[sizes > 0] - 1] = 0
        e += w[f.base[1] : f.base[2]][before]
        e += w[f.base[2] : f.base[3]][after]
        return e


Segments = list[tuple[int, int, list[str]]]


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[starts + sizes] - total[starts]


def fitted(segments: Segments) -> Model:
    """The field without its calibration: the likelihood of the documents' labels, climbed by steps that curvature scales."""
    toxic = lexicon(segments)
    counts = Counter(w for _, _, words in segments for w in words)
    units = {w: i for i, w in enumerate(sorted(toxic) + sorted(w for w, _ in counts.most_common(COMMON) if w not in toxic), 1)}
    features = Features(units)
    model = Model(units, np.zeros(features.size), np.zeros((2, 2)), 0.0, (1.0, 0.0))
    segments = [s for s in segments if s[2]]
    if not toxic:
        model.weights[: features.n] = -20
        return model
    starts, sizes = _bounds([len(ws) for _, _, ws in segments])
    at = features.of([ws for _, _, ws in segments], starts, sizes)
    docs = {d: i for i, d in enumerate(dict.fromkeys(d for d, _, _ in segments))}
    doc = np.array([docs[d] for d, _, _ in segments])
    label = np.zeros(len(docs), bool)
    label[doc] = [y == 1 for _, y, _ in segments]
    of_token = np.repeat(doc, sizes)
    inner = np.ones(len(of_token), bool)
    inner[starts] = False
    size = features.size
    freq = sum(np.bincount(a, minlength=size) for a in at)
    # The first round's tokens: the words of the lexicon in toxic documents.
    first = label[of_token] & (at[0] > 0) & (at[0] <= len(toxic))
    seen = np.bincount(at[0][first], minlength=size)
    began = np.where(np.arange(size) < features.n, np.minimum(np.log((seen + 0.1) / (freq - seen + 0.5)), MOST), 0.0)
    w, trans, start = began.copy(), np.zeros((2, 2)), 0.0
    for _ in range(ROUNDS):
        p, clean, steps = marginals(sum(w[a] for a in at), starts, sizes, trans, start, pairs=True)
        none = np.exp(np.minimum(np.bincount(of_token, clean, len(docs)), 0.0))
        # How much the log likelihood of a document's label changes with the log chance that it has no toxic token.
        change = np.where(
            label, -(1 - WRONG_TOXIC) * none / (1 - none + WRONG_TOXIC * none), (1 - WRONG_CLEAN) * none / (none + WRONG_CLEAN * (1 - none))
        )
        c = change[of_token]
        grad = -sum(np.bincount(a, c * p, size) for a in at)
        curve = len(at) * sum(np.bincount(a, np.abs(c) * p * (1 - p), size) for a in at)
        w += RATE * (grad - PULL * (w - began)) / (curve + PULL)
        s = c[inner]
        moved = np.array([(s * (1 - steps[0])).sum(), *(-(s * steps[1:]).sum(1))]).reshape(2, 2)
        spread = (np.abs(s) * steps * (1 - steps)).sum(1).reshape(2, 2)
        trans = np.clip(trans + RATE * (moved - PULL * trans) / (2 * spread + PULL), -12, 12)
        p0, c0 = p[starts], c[starts]
        start += RATE * (-(c0 * p0).sum() - PULL * start) / ((np.abs(c0) * p0 * (1 - p0)).sum() + PULL)
    model.weights, model.trans, model.start = w, trans, float(start)
    return model


def chances(model: Model, words: Words, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of all tokens, where each list's begin and how many they are, and each list's log chance of no toxic token."""
    starts, sizes = _bounds([len(t) for t in tokens])
    p, clean = marginals(words.emissions(tokens, starts, sizes), starts, sizes, model.trans, model.start)
    return p, starts, sizes, _sums(clean, starts, sizes)


def logits(model: Model, segments: Segments) -> dict[int, tuple[float, int]]:
    """By document, the log odds that any of its tokens is toxic, and its label."""
    none: dict[int, float] = defaultdict(float)
    *_, logs = chances(model, model.words(), [ws for _, _, ws in segments])
    for (doc, _, _), x in zip(segments, logs):
        none[doc] += x
    return {doc: (logit(none[doc]), y) for doc, y, _ in segments}


def calibration(scored: list[tuple[float, int]], share: float) -> tuple[float, float]:
    """Factor and offset that make logits those of the labels; (1, 0) without any."""
    if not scored:
        return 1.0, 0.0
    x, y = np.array(scored, float).T
    # The sample's labels are weighted back to the share that they have.
    w = np.where(y > 0, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = w * (y - q)
        h = w * q * (1 - q) + 1e-6
        hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
        da, db = np.linalg.solve(hess, [(g * x).sum() - (a - 1), g.sum() - b])
        a, b = a + 0.5 * da, b + 0.5 * db
    return max(a, 0.05), b


def fit(segments: Segments, share: float = 0.5) -> Model:
    """The field of segments (document, toxic, tokens), but for documents that are held back, which calibrate it.

    share: of toxic ones among the labelled documents that the sample was drawn from. Without words that mark toxic
    documents, every text has the score `share`.
    """
    fold = [zlib.crc32(f"fold:{d}".encode()) % FOLDS for d, _, _ in segments]
    model = fitted([s for s, f in zip(segments, fold) if f])
    if not model.trans.any():
        model.scale = (0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        return model
    back = logits(model, [s for s, f in zip(segments, fold) if not f])
    model.scale = calibration(list(back.values()), share)
    return model


def logit(none: float) -> float:
    """Log odds that any token is toxic, from the log chance that none is."""
    none = min(none, -1e-9)
    return float(np.clip(np.log(-np.expm1(none)) - none, -20, 20))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, int, list[str]]], float]:
    """Segments of a bounded sample of labelled documents, and the share of toxic ones."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id")
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.col("_id").cast("string").cast("binary"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(order, "_id").limit(TRAIN_DOCS)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = tokens_of(text.as_py())
                out += [(doc, y, i, " ".join(words[i : i + SEGMENT])) for i in range(0, max(1, len(words)), SEGMENT)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["doc_id", "y", "at", "words"])

    cuts = rows.mapInArrow(cut, "doc_id long, y int, at long, words string")
    order = F.md5(F.concat_ws(":", "doc_id", "at").cast("binary"))
    got = cuts.orderBy(order, "doc_id", "at").limit(TRAIN_SEGMENTS).toArrow()
    # Equal words are one string in the driver's memory.
    words = ([sys.intern(w) for w in x.as_py().split(" ") if w] for x in got["words"])
    return list(zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), words)), n.get(1, 0) / max(1, sum(n.values()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans for each row of docs(doc_id, text); spans: start:end of likely toxic tokens, comma-joined.

    Null and empty texts have the score of a text without toxic tokens and no spans; rows with a null doc_id
    and repeated rows stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = m.words()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                p, starts, sizes, none = chances(m, words, [tokens_of(t) for t in texts])
                scores = [1 / (1 + np.exp(-(m.scale[0] * logit(x) + m.scale[1]))) for x in none]
                spans = [""] * len(texts)
                for i in np.unique(np.searchsorted(starts + sizes, np.nonzero(p >= 0.5)[0], side="right")):
                    bad = set((np.nonzero(p[starts[i] : starts[i] + sizes[i]] >= 0.5)[0]).tolist())
                    spans[i] = ",".join(f"{s}:{e}" for n, (s, e) in enumerate(offsets(texts[i])) if n in bad)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, score double, spans string")


def offsets(text: str) -> list[tuple[int, int]]:
    """Where each of tokens_of(text) is in text; lower-casing can lengthen a character."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in TOKEN.finditer(low)]
    back = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(back[m.start()], back[m.end() - 1] + 1) for m in TOKEN.finditer(low)] if len(back) == len(low) else [m.span() for m in TOKEN.finditer(text)]


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = fit(*sample(docs.where(~held_out), table(spark, sf_dir, "labels")))
    out = scored(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
