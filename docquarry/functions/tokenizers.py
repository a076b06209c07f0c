"""Tokenizers behind one interface: a function from a text Column to an array<string> Column."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.durable import slices

Tokenizer = Callable[[Column], Column]
WORDS = r"[\p{L}\p{N}]+"
#: Bytes of texts that the dictionary tokenizer cuts at once, besides a longer text; their terms are some twenty times that in Python.
CUT_BYTES = 1 << 18


def regex_tokenizer(pattern: str = WORDS, lower: bool = False) -> Tokenizer:
    """All matches of a pattern; stays in the JVM."""
    return lambda c: F.regexp_extract_all(F.lower(c) if lower else c, F.lit(pattern), F.lit(0))


def whitespace_tokenizer() -> Tokenizer:
    return regex_tokenizer(r"(?U)\S+")


def segment(text: str, terms: set[str], longest: int) -> list[str]:
    """Longest dictionary match from the left; else runs of letters and digits outside Chinese, and single characters."""
    out, i = [], 0
    plain = lambda ch: ch.isalnum() and not "㐀" <= ch <= "鿿"
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        size = next((k for k in range(min(longest, len(text) - i), 1, -1) if text[i : i + k] in terms), 1)
        if size == 1 and plain(text[i]):
            while i + size < len(text) and plain(text[i + size]):
                size += 1
        out.append(text[i : i + size])
        i += size
    return out


def dictionary_tokenizer(terms: list[str]) -> Tokenizer:
    """Segments Chinese by a dictionary of bounded size, which is shipped with the function."""
    known = {t.strip() for t in terms if t.strip()}
    longest = max(map(len, known), default=1)

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, CUT_BYTES):
                yield pa.array([None if t is None else segment(t, known, longest) for t in part.column(0).to_pylist()], pa.list_(pa.string()))

    return cut


def jieba_tokenizer(terms: list[str] = ()) -> Tokenizer:
    """An adapter for the jieba package, where it is installed."""
    if importlib.util.find_spec("jieba") is None:
        raise ModuleNotFoundError("jieba is not installed; use dictionary_tokenizer")
    terms = list(terms)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import jieba

        own = jieba.Tokenizer()
        for t in terms:
            own.add_word(t)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [w.strip() for w in own.cut(t) if w.strip()])

    return cut


def token_count(c: Column, tokenizer: Tokenizer) -> Column:
    return F.coalesce(F.size(tokenizer(c)), F.lit(0))
