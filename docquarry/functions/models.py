"""Pluggable models - embedder, scorer, generator - and a deterministic default of each that needs no network.

A model is given as a factory that makes it once in each worker; the operators ship only the factory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[list[tuple[str, str]]], list[float]]
_WORD = re.compile(r"\w+")


def hashed_embedder(dimension: int = 64) -> Callable[[], Embed]:
    """Counts of hashed words with hashed signs, of length 1, or without signs where these cancel all out; a text without words is a zero vector."""

    def make() -> Embed:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), np.float32)
            for row, text in zip(out, texts):
                hashes = [zlib.crc32(w.encode()) for w in _WORD.findall((text or "").lower())]
                for h in hashes:
                    row[h % dimension] += 1 if h >> 31 else -1
                if hashes and not row.any():
                    for h in hashes:
                        row[h % dimension] += 1
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms > 0, norms, 1)

        return embed

    return make


def embedding(factory: Callable[[], Embed], batch: int = 32) -> Callable[[Column], Column]:
    """A function of a text Column that gives array<float>."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            texts = texts.tolist()
            rows = [model(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            vectors = [v for r in rows for v in np.asarray(r, np.float32)]
            if len(vectors) != len(texts):
                raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(texts)} texts")
            yield pd.Series(vectors)

    return embed


def overlap_scorer() -> Score:
    """Share of the question's distinct words that the text has, through a sigmoid; as normalised scores are."""

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for question, text in pairs:
            q = set(_WORD.findall((question or "").lower()))
            share = len(q & set(_WORD.findall((text or "").lower()))) / len(q) if q else 0.0
            out.append(1 / (1 + float(np.exp(-share))))
        return out

    return score


def scoring(factory: Callable[[], Score]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for questions, texts in batches:
            yield pd.Series(model(list(zip(questions, texts))), dtype="float64")

    return score


def extractive_generator() -> Callable[[str, str], Iterator[str]]:
    """Answers with the first cited block of the context, in pieces; an offline stand-in for a language model."""

    def generate(question: str, context: str) -> Iterator[str]:
        first = (context or "").split("\n\n")
        text = first[1] if len(first) > 1 else ""
        for i in range(0, len(text[:200]), 20):
            yield text[i : min(i + 20, 200)]
        yield " [1]" if text else "现有资料不足"

    return generate
