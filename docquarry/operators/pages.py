"""Words or lines of a page brought together, and worked on some pages at a time in Arrow and numpy.

What reaches Python is cut into runs of one page before the shuffle, so that a page is a row or two there, not a row a word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows, about, that are worked on at once, besides a longer page.
ROWS = 50_000
#: What str.strip() takes, as utrim() does.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


class Pages:
    """Rows of whole pages: keys has a row a page; of each row its page's place there, and its columns."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        runs = pa.Table.from_batches(parts).combine_chunks()
        document, page, *lists = (c.chunk(0) for c in runs.columns)
        new = np.append(True, differs(document) | differs(page))
        starts = np.flatnonzero(new)
        self.keys = (document.take(pa.array(starts)), page.take(pa.array(starts)))
        self.at = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64))
        self.columns = dict(zip(runs.column_names[2:], (x.flatten() for x in lists)))

    def __getitem__(self, name: str) -> pa.Array:
        return self.columns[name]


def differs(c: pa.Array) -> np.ndarray:
    """Of each row but the first, whether it differs from the one before; null is like null."""
    a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
    out = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b), pc.not_equal(pc.is_valid(a), pc.is_valid(b)))
    return out.to_numpy(zero_copy_only=False).astype(bool)


#: Types that a double holds without loss.
_SMALL = ("double", "float", "int", "smallint", "tinyint")


def by_page(rows: DataFrame, columns: list[str], work: Callable[[Pages], pa.RecordBatch], schema: str, blank: bool = True) -> DataFrame:
    """What work gives for the pages of rows(document, page, *columns), each page whole; blank: whether rows without a text count.

    Numbers go to Python in one array a row, as each further column costs Spark a multiple of what is in it.
    """
    names = ["document", "page", *columns]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    arrow = {f.name: to_arrow_type(f.dataType) for f in rows.schema if f.name in names}
    small = [c for c in names if kind[c] in _SMALL]
    alone = [c for c in names if c not in small]
    packed = ", ".join([*(f"{c} {kind[c]}" for c in names[:2]), *(f"{c} array<{kind[c]}>" for c in columns)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(k) for k, n in enumerate(alone)}
            if small:
                value, valid = numbers(b.column(len(alone)).flatten())
                value, valid = value.reshape(b.num_rows, -1), valid.reshape(b.num_rows, -1)
                c |= {n: pa.array(value[:, k], mask=None if valid.all() else ~valid[:, k]).cast(arrow[n]) for k, n in enumerate(small)}
            b = pa.RecordBatch.from_arrays([c[n] for n in names], names)
            if not blank:
                b = b.filter(pc.fill_null(pc.not_equal(pc.utf8_trim(c["text"], characters=SPACE), ""), False))
            if b.num_rows:
                starts = np.flatnonzero(np.append(True, differs(b.column(0)) | differs(b.column(1))))
                ends = pa.array(np.append(starts, b.num_rows), pa.int32())
                first = [x.take(pa.array(starts)) for x in b.columns[:2]]
                yield pa.RecordBatch.from_arrays([*first, *(pa.ListArray.from_arrays(ends, x) for x in b.columns[2:])], names)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _whole(batches):
            yield work(pages)

    sent = [F.col(c) for c in alone] + ([F.array(*(F.col(c).cast("double") for c in small)).alias("_numbers")] if small else [])
    runs = rows.select(*sent).mapInArrow(pack, packed)
    return runs.repartition("document", "page").sortWithinPartitions("document", "page").mapInArrow(worked, schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[Pages]:
    """Whole pages out of runs that are sorted by page."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        sizes = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ROWS)))
            piece, at = b.slice(at, min(end, b.num_rows) - at), end
            new = np.append(True, differs(piece.column(0)) | differs(piece.column(1)))
            if held:
                new[0] = any(held[-1].column(k)[-1].as_py() != piece.column(k)[0].as_py() for k in (0, 1))
            if new.any():
                last = int(np.flatnonzero(new)[-1])
                if whole := [x for x in (*held, piece.slice(0, last)) if x.num_rows]:
                    yield Pages(whole)
                held = []
            else:
                last = 0
            held.append(piece.slice(last))
    if held:
        yield Pages(held)


def numbers(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, of nulls 0, and whether they are values."""
    return pc.fill_null(c, 0).to_numpy(zero_copy_only=False), pc.is_valid(c).to_numpy(zero_copy_only=False)


def order(whole: np.ndarray, columns: list[pa.Array], ties: list[pa.Array]) -> np.ndarray:
    """Places in order of whole, then of columns, then of ties; nulls first, NaN last, as Spark sorts. ties, which may be texts, rarely count."""
    keys = [whole]
    for c in columns:
        value, valid = numbers(c)
        keys += [value] if valid.all() else [valid, value]
    out = np.lexsort(keys[::-1])
    if not ties or not np.logical_and.reduce([_same(k[out]) for k in keys]).any():
        return out
    for c in ties:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            d = c.dictionary_encode()
            rank = np.empty(len(d.dictionary) + 1, np.int64)
            rank[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(len(d.dictionary))
            rank[-1] = -1
            keys.append(rank[pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False)])
        else:
            keys += numbers(c)[::-1]
    return np.lexsort(keys[::-1])


def _same(v: np.ndarray) -> np.ndarray:
    return (v[1:] == v[:-1]) | ((v[1:] != v[1:]) & (v[:-1] != v[:-1]))


def least(c: pa.Array, starts: np.ndarray) -> pa.Array:
    """Minima of the groups that begin at starts: without nulls, NaN above all."""
    value, valid = numbers(c)
    low = np.fmin.reduceat(np.where(valid, value, np.nan), starts)
    return pa.array(low, mask=~np.logical_or.reduceat(valid, starts)).cast(c.type)


def most(c: pa.Array, starts: np.ndarray) -> pa.Array:
    value, valid = numbers(c)
    high = np.fmax.reduceat(np.where(valid, value, np.nan), starts)
    high = np.where(np.logical_or.reduceat(valid & (value != value), starts), np.nan, high)
    return pa.array(high, mask=~np.logical_or.reduceat(valid, starts)).cast(c.type)


def _kinds(signs: pa.Array, kind: Callable[[str], int]) -> np.ndarray:
    d = signs.dictionary_encode()
    return np.array([kind(c) for c in d.dictionary.to_pylist()], np.int8)[d.indices.to_numpy(zero_copy_only=False)]


def _han(c: str) -> bool:
    return "㐀" <= c <= "䶿" or "一" <= c <= "鿿"


def by_script(c: str) -> int:
    return 1 if _han(c) else 2 if unicodedata.category(c) == "Nd" else 3 if c.isascii() and c.isalpha() else 0


def by_sign(c: str) -> int:
    return 1 if _han(c) else 2 if c in "，。；：、）】》〉" else 3 if c in "（【《〈" else 0


#: As text.needs_space() and text.needs_space_by_default() have it.
RULES = {
    "script": (by_script, lambda a, b: (a > 0) & (b > 0) & (a != b)),
    "default": (by_sign, lambda a, b: ~(((a == 1) & (b == 1)) | (b == 2) | (a == 3))),
}


def joined(words: pa.Array, starts: np.ndarray, rule: str) -> pa.Array:
    """The words of each group that begins at starts as one string, as text.join_words() does; empty and null ones don't count."""
    kind, spaced = RULES[rule]
    counts = pc.fill_null(pc.not_equal(words, ""), False).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(counts))[np.append(starts, len(words))]
    words = words.filter(pa.array(counts))
    space = np.zeros(len(words), bool)
    if len(words) > 1:
        a, b = _kinds(pc.utf8_slice_codeunits(words, -1), kind), _kinds(pc.utf8_slice_codeunits(words, 0, 1), kind)
        space[1:] = spaced(a[:-1], b[1:])
    space[ends[:-1][ends[:-1] < len(words)]] = False
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(space), " ", ""), words, "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), "")
