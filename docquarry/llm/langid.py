"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the
sum over all its segmentations into pieces, of any length, which a forward pass over its characters gives in logarithms; piece
probabilities are trained by expectation maximisation over all segmentations. A text's score is the product over
its words, so each distinct word is scored once in a task and kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import Scratch, in_fold, own, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The classifier is fitted on so many documents a language at most, taken by the hash of their ids,
#: and the most frequent distinct words of these.
TRAIN_DOCS, TRAIN_WORDS = 500, 20_000
ROUNDS, SMOOTHING = 4, 0.05
CACHE = 200_000
#: Characters whose lattice is held at once; a longer word is held alone.
BATCH = 1 << 14
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters; LETTERS alone also takes numerals such as ½ and ², which are cut out."""
    found = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return {p: i for i, p in enumerate(dict.fromkeys(p for p in pieces if not re.fullmatch(r"<.*>", p)))}


class Trie:
    """The pieces as a trie whose steps are looked up for many places at once."""

    def __init__(self, vocab: dict[str, int]) -> None:
        self.unknown = len(vocab)
        chars = {c: i for i, c in enumerate(sorted({c for p in vocab for c in p}), 1)}
        self.code = np.zeros(0x110000, np.int64)  # of characters; 0: in no piece
        self.code[[ord(c) for c in chars]] = list(chars.values())
        self.width = len(chars) + 1
        nodes, piece, steps = {"": 0}, [-1], {}
        for p, i in vocab.items():
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    steps[nodes[p[: n - 1]] * self.width + chars[p[n - 1]]] = nodes[p[:n]] = len(piece)
                    piece.append(-1)
            piece[nodes[p]] = i
        self.piece = np.array(piece)
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)

    def edges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, id) of all pieces in a sequence of code points, in which 0 separates words."""
        codes = self.code[chars]
        start = np.nonzero(chars)[0]
        node, found, depth = np.zeros(len(start), np.int64), [], 0
        while len(start):
            key = node * self.width + codes[np.minimum(start + depth, len(codes) - 1)]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = (self.keys[at] == key) & (codes[np.minimum(start + depth, len(codes) - 1)] > 0) & (start + depth < len(codes))
            node = np.where(on, self.next[at], 0)
            ids = np.where(on, self.piece[node], -1)
            if depth == 0:  # a character that is no piece itself is an unknown one
                ids = np.where(ids < 0, self.unknown, ids)
            here = ids >= 0
            depth += 1
            found.append((start[here], start[here] + depth, ids[here]))
            start, node = start[on], node[on]
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3))


class Lattice:
    """All segmentations of words, as edges between the places in them.

    Characters outside the vocabulary are single unknown pieces (id V).
    """

    def __init__(self, words: list[str], trie: Trie) -> None:
        sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
        self.last = self.first + sizes
        chars = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.src, self.dst, self.ids = trie.edges(chars)
        self.places = len(chars)
        place = np.arange(self.places) - np.repeat(self.first, sizes + 1)
        self.ahead = self._order(place[self.dst], self.dst)
        self.steps = place[self.src]

    @staticmethod
    def _order(step: np.ndarray, to: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By step: edges, where those into a place begin, and these places."""
        order = np.argsort((step - step.min(initial=0)) * (to.max(initial=0) + 1) + to, kind="stable")
        out = []
        for part in np.split(order, np.nonzero(np.diff(step[order]))[0] + 1) if len(order) else ():
            begin = np.concatenate(([0], np.nonzero(np.diff(to[part]))[0] + 1))
            out.append((part, begin, to[part][begin]))
        return out

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """logp: (V + 1, L). Log probabilities (places, L) of each beginning of each word."""
        a = np.zeros((self.places, logp.shape[1]))
        for edges, begin, to in self.ahead:
            a[to] = np.logaddexp.reduceat(a[self.src[edges]] + logp[self.ids[edges]], begin, axis=0)
        return a

    def total(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(logp)[self.last]

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations; logp: (V + 1, 1)."""
        a, b = self.forward(logp)[:, 0], np.zeros(self.places)
        for edges, begin, to in self._order(-self.steps, self.src):
            b[to] = np.logaddexp.reduceat(b[self.dst[edges]] + logp[self.ids[edges], 0], begin)
        word = np.repeat(np.arange(len(self.last)), self.last - self.first + 1)[self.src]
        share = np.exp(a[self.src] + logp[self.ids, 0] + b[self.dst] - a[self.last][word])
        return np.bincount(self.ids, share * counts[word], len(logp))


def batches_of(words: list[str]) -> Iterator[list[int]]:
    """Places of the words, by length, in batches of BATCH characters."""
    part, size = [], 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if part and size + len(words[i]) > BATCH:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(words[i])
    if part:
        yield part


def marked(words: list[str]) -> list[str]:
    """Each with its start marked, as in the vocabulary."""
    return ["▁" + w for w in words]


def fit(counts: dict[str, dict[str, int]], vocab: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (V + 1, L) from word counts by language; the last is that of an unknown piece."""
    langs, v, trie = sorted(counts), len(vocab), Trie(vocab)
    p = np.zeros((v + 1, len(langs)))
    for at, lang in enumerate(langs):
        words, n = marked(list(counts[lang])), np.array(list(counts[lang].values()), float)
        parts = [(Lattice([words[i] for i in part], trie), n[part]) for part in batches_of(words)]
        own_p = np.full((v + 1, 1), 1 / (v + 1))
        for _ in range(ROUNDS):
            e = sum((lattice.expected(np.log(own_p), k) for lattice, k in parts), np.full(v + 1, SMOOTHING))
            own_p[:, 0] = e / e.sum()
        p[:, at] = own_p[:, 0]
    return langs, p


def with_unknown(langs: list[str], p: np.ndarray) -> tuple[list[str], np.ndarray]:
    """langs and p with UNKNOWN as one more language, in which all pieces are equally likely.

    It is what training starts from, so a text that it explains better than any language has nothing of them.
    """
    return [*langs, UNKNOWN], np.hstack((p, np.full((len(p), 1), 1 / len(p))))


def trained(docs: DataFrame, vocab: dict[str, int], docs_each: int = TRAIN_DOCS, words_each: int = TRAIN_WORDS) -> tuple[list[str], np.ndarray]:
    """fit() on the rows of docs(doc_id, text, lang) whose lang and text aren't null, at most docs_each of a language.

    Rows that agree in doc_id and lang count as one, with one of their texts; null ids are one id. An empty table gives no languages.
    The sample is told by a threshold on the hash of ids, twice as many as sought, so no task gets all rows of a language; of words that tie at the
    bound none is taken.
    """
    tmp = Scratch()
    rows = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per = rows.groupBy("lang").agg(F.count("*").alias("n"))
    digest = F.md5(F.coalesce("doc_id", F.lit("")).cast("binary"))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    some = rows.join(F.broadcast(per), "lang").where(share * F.col("n") <= 2 * docs_each)  # per: a row a language
    some = some.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    by_hash = W.partitionBy("lang").orderBy(digest)
    chosen = some.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= docs_each)
    words = chosen.select("text", "lang").mapInArrow(_counted, "lang string, word string, n long")
    words = tmp(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    left, least = {}, {}
    for r in sorted(words.groupBy("lang", "n").count().collect(), key=lambda r: -r.n):  # a row for each frequency
        left[r.lang] = left.get(r.lang, words_each) - r["count"]
        if left[r.lang] >= 0:
            least[r.lang] = r.n
    bound = docs.sparkSession.createDataFrame(list(least.items()), "lang string, least long")
    counts: dict[str, dict[str, int]] = {}
    for r in words.join(F.broadcast(bound), "lang").where("n >= least").collect():  # words_each a language at most
        counts.setdefault(r.lang, {})[r.word] = r.n
    tmp.drop()
    return fit({lang: dict(sorted(of.items())) for lang, of in counts.items()}, vocab)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for b in batches:
        found: Counter = Counter()
        for text, lang in zip(b.column(0), b.column(1).to_pylist()):
            for w, n in Counter(words_of(text.as_py())).items():
                found[lang, w] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())],
            ["lang", "word", "n"],
        )


class Scorer:
    """Log probabilities of words under each language, kept for CACHE words."""

    def __init__(self, vocab: dict[str, int], p: np.ndarray) -> None:
        self.trie, self.logp = Trie(vocab), np.log(p)
        self.at: dict[str, int] = {}
        self.logs = np.zeros((CACHE, p.shape[1]))

    def _learn(self, new: list[str]) -> None:
        if len(self.at) + len(new) > CACHE:
            self.at.clear()
        if len(new) > len(self.logs):
            self.logs = np.zeros((len(new), self.logp.shape[1]))
        for part in batches_of(new):
            words = [new[i] for i in part]
            first = len(self.at)
            self.logs[first : first + len(words)] = Lattice(marked(words), self.trie).total(self.logp)
            self.at.update(zip(words, range(first, first + len(words))))

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word of one chunk, which may be any part of a text."""
        every = set(words)
        new = every.difference(self.at)
        self._learn(sorted(every if len(self.at) + len(new) > CACHE else new))
        rows = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return self.logs[rows]


def identified(docs: DataFrame, langs: list[str], vocab: dict[str, int], p: np.ndarray) -> DataFrame:
    """docs with lang_pred and lang_score, from column text alone.

    lang_pred is und, with score 0, if text is null or has no letter (or nothing was learned); else the
    likeliest language, equal ones in order, and its posterior over all of them. Rows and other columns stay; columns lang_pred and
    lang_score of docs are replaced. An empty table gives an empty result.
    """
    docs = docs.select(*own(docs, "lang_pred", "lang_score"))
    model = docs.sparkSession.sparkContext.broadcast((langs, vocab, p))
    text_at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vocab, p = model.value
        scorer = Scorer(vocab, p)
        for b in batches:
            column = b.column(text_at)
            sums, words, ends = np.zeros((len(column), len(langs))), [], []
            some = np.zeros(len(column), bool)

            def flush() -> None:
                if not words:
                    return
                logs = scorer.score(words)
                starts = np.array([0] + [e for _, e in ends[:-1]])
                np.add.at(sums, [i for i, _ in ends], np.add.reduceat(logs, starts))
                words.clear()
                ends.clear()

            if langs:
                for i in range(len(column)):
                    found = words_of(column[i].as_py())
                    some[i] = bool(found)
                    for at in range(0, len(found), CACHE // 2):
                        part = found[at : at + CACHE // 2]
                        if len(words) + len(part) > CACHE // 2:
                            flush()
                        words += part
                        ends.append((i, len(words)))
                flush()
            top = sums.argmax(1) if langs else np.zeros(len(column), int)
            posterior = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1) if langs else np.zeros(len(column))
            pred = [langs[t] if s else UNKNOWN for t, s in zip(top, some)]
            score = np.where(some, posterior, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "lang_score"])

    # Names that can't clash on the way; text is read as a string.
    names = [f"c{i}" for i in range(len(docs.columns))]
    fields = [T.StructField(n, T.StringType() if i == text_at else f.dataType) for i, (n, f) in enumerate(zip(names, docs.schema.fields))]
    plain = docs.toDF(*names).withColumn(names[text_at], F.col(names[text_at]).cast("string"))
    out = plain.mapInArrow(of, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))
    return out.toDF(*docs.columns, "lang_pred", "lang_score")


def op10_language_id(spark: SparkSession, sf_dir: str, vocab_path: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocab = vocabulary(vocab_path)
    held_out = in_fold(F.col("doc_id"), 3, 1)
    langs, p = trained(docs.where(~held_out), vocab)
    out = identified(docs.select("doc_id", "text"), langs, vocab, p)
    return out.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
