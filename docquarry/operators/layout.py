"""From positioned words to clean text: visual rows, headers, page numbers, split headings.

Words carry document, page, page_height, text, x0, y0, x1, y1, block_no, line_no, word_no. Rows of a page are
found from that page alone, which is a group of bounded size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docquarry.functions import text as T
from docquarry.operators.pages import SPACE, Pages, by_page, differs, joined, least, most, numbers, order

WORDS = "document string, page int, page_height double, text string, x0 double, y0 double, x1 double, y1 double, block_no int, line_no int, word_no int"
LINES = "document string, page int, line_seq int, text string, x0 double, y0 double, x1 double, y1 double"
#: Tolerances, page shares, reach and depth.
Y_TOLERANCE, HEADER_RATIO, FOOTER_RATIO, HEADING_REACH, HEADING_GAP, MAX_LEVEL = 3.0, 0.05, 0.90, 5, 25.0, 4


def _kind(words: DataFrame, *names: str) -> str:
    return ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in names)


def visual_lines(words: DataFrame, tolerance: float = Y_TOLERANCE) -> DataFrame:
    """Lines of each page: a word joins the current row while its y0 is near the mean y0 of that row so far."""

    def lines(p: Pages) -> pa.RecordBatch:
        y, valid = numbers(p["y0"])
        y = np.where(valid, y, np.nan).astype(float)
        alike = tolerance >= 0 and not np.isnan(y).any()  # then words of the same y0 share a row, in whatever order
        down = order(p.at, [p["y0"]], [] if alike else [p[c] for c in ("x0", "word_no", "text", "x1", "y1", "block_no", "line_no")])
        first = _row_starts(p.at[down], y[down], tolerance)
        row = np.empty(len(down), np.int64)
        row[down] = np.cumsum(first) - 1
        across = order(row, [p["x0"], p["word_no"]], [p["text"], p["block_no"], p["line_no"]])
        starts = np.flatnonzero(np.append(True, np.diff(row[across]) > 0))
        at, take = p.at[across[starts]], pa.array(across)
        c = {n: v.take(take) for n, v in p.columns.items()}
        seq = np.arange(len(starts)) - np.searchsorted(at, at)
        height = most(p["page_height"], np.searchsorted(p.at, np.arange(len(p.keys[0]))))
        begin = pa.array(starts)
        return pa.RecordBatch.from_arrays(
            [*(k.take(pa.array(at)) for k in p.keys), height.take(pa.array(at)), pa.array(seq, pa.int32()), joined(pc.utf8_trim(c["text"], characters=SPACE), starts, "script"),
             least(c["x0"], starts), least(c["y0"], starts), most(c["x1"], starts), most(c["y1"], starts), c["block_no"].take(begin), c["line_no"].take(begin)],
            ["document", "page", "page_height", "line_seq", "text", "x0", "y0", "x1", "y1", "block_no", "line_no"],
        )

    schema = f"{_kind(words, 'document', 'page', 'page_height')}, line_seq int, {_kind(words, 'text', 'x0', 'y0', 'x1', 'y1', 'block_no', 'line_no')}"
    return by_page(words, ["page_height", "text", "x0", "y0", "x1", "y1", "block_no", "line_no", "word_no"], lines, schema, blank=False)


def _row_starts(page: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether a row begins at each word, of words by page and y.

    A gap beyond the tolerance begins a row for sure, and words between two such gaps that all lie within it are one row. Only stretches that are wider, or
    too close to tell by more than rounding, are followed word by word.
    """
    gap = np.append(np.nan, np.diff(y))
    margin = 1e-6 * (1 + np.abs(y[np.isfinite(y)]).max(initial=0))
    first = ~(gap <= tolerance + margin)
    first[1:] |= page[1:] != page[:-1]
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(y))
    for k in np.flatnonzero(y[ends - 1] - y[starts] > tolerance - margin):
        total, n = y[starts[k]], 1
        for i in range(starts[k] + 1, ends[k]):
            if abs(y[i] - total / n) <= tolerance:
                total, n = total + y[i], n + 1
            else:
                first[i], total, n = True, y[i], 1
    return first


def without_headers(lines: DataFrame, ratio: float = HEADER_RATIO) -> DataFrame:
    """Less lines at the top of a page that are a standard's number."""
    return lines.where(~((F.col("y0") <= F.col("page_height") * ratio) & T.is_standard_line("text")))


def without_page_numbers(lines: DataFrame) -> DataFrame:
    return lines.where(~T.is_page_number("text"))


def without_footer_numbers(lines: DataFrame, ratio: float = FOOTER_RATIO) -> DataFrame:
    """The structured parser's rule: only digits, and only at the foot of the page."""
    return lines.where(~(T.utrim("text").rlike(r"(?U)^\d+$") & (F.col("y0") >= F.col("page_height") * ratio)))


def cleaned(lines: DataFrame) -> DataFrame:
    """Less standard numbers anywhere and blank lines; texts normalised."""
    kept = lines.where((T.utrim("text") != "") & ~T.is_standard_line("text")).withColumn("text", T.normalize("text"))
    return kept.where("text <> ''")


_FRAGMENT = re.compile(r"[A-Z]\.|\d+\.|[A-Z]")


def _prefix(last: str, fragments: list[str]) -> str | None:
    letters = [f[:-1] for f in fragments if re.fullmatch(r"[A-Z]\.", f)]
    if not letters:
        return None
    parts = [letters[0], *(f[:-1] for f in fragments if re.fullmatch(r"\d+\.", f))][:MAX_LEVEL]
    return ".".join(parts if len(parts) == MAX_LEVEL else [*parts, last])


def merge_headings(texts: list[str], y0: list[float]) -> list[tuple[int, list[int], str | None]]:
    """Of one page's lines: what to emit, as (place, places merged there, new text or null), in order.

    A numbered line takes the letter and number fragments around it as its prefix; a figure line takes the nearest
    line that starts with a digit as its number. Fragments that were emitted before stay.
    """
    used: set[int] = set()
    out = []
    for i, raw in enumerate(texts):
        if i in used:
            continue
        text, merged = raw.strip(), None
        near = [j for j in range(max(0, i - HEADING_REACH), min(len(texts), i + HEADING_REACH + 1)) if j != i and j not in used and abs(y0[j] - y0[i]) <= HEADING_GAP]
        numbered = re.match(r"(\d+)(.*)$", text)
        if numbered and numbered[2].strip():
            pieces = [j for j in near if _FRAGMENT.fullmatch(texts[j].strip())]
            prefix = _prefix(numbered[1], [texts[j].strip() for j in pieces])
            if prefix:
                merged = (i, sorted([i, *pieces]), f"{prefix} {numbered[2].strip()}")
        if merged is None and text.startswith("图"):
            digits = sorted((j for j in near if re.match(r"\d", texts[j].strip())), key=lambda j: abs(y0[j] - y0[i]))
            if digits and (m := re.match(r"(\d+)(.*)$", texts[digits[0]].strip())):
                merged = (i, sorted([i, digits[0]]), f"{text}{'' if text.endswith('.') else '.'}{m[1]} {m[2].strip()}".rstrip())
        if merged:
            used.update(merged[1])
        out.append(merged or (i, [i], None))
    return out


def recover_headings(lines: DataFrame) -> DataFrame:
    """Lines with the pieces of split headings put together, page by page.

    Only pages that hold a letter fragment or a figure line, without which nothing is put together, are gone through line by line.
    """
    cols = ["document", "page", "page_height", "line_seq", "text", "x0", "y0", "x1", "y1"]

    def pages(p: Pages) -> pa.RecordBatch:
        down = order(p.at, [p["line_seq"]], [])
        at, c = p.at[down], {n: v.take(pa.array(down)) for n, v in p.columns.items()}
        bare = pc.utf8_trim(c["text"], characters=SPACE)
        piece = pc.fill_null(pc.or_(pc.starts_with(bare, "图"), pc.match_substring_regex(bare, r"^[A-Z]\.$")), False).to_numpy(zero_copy_only=False)
        keep, merged = np.ones(len(at), bool), np.zeros(len(at), bool)
        if piece.any():
            c |= {n: c[n].to_pylist() for n in ("text", "x0", "y0", "x1", "y1")}
            out = {n: list(c[n]) for n in ("text", "x0", "y0", "x1", "y1")}
            for k in np.unique(at[piece]):
                begin, end = np.searchsorted(at, [k, k + 1])
                keep[begin:end] = False
                for i, places, text in merge_headings(c["text"][begin:end], c["y0"][begin:end]):
                    keep[begin + i], places = True, [begin + j for j in places]
                    if text is not None:
                        merged[begin + i], out["text"][begin + i] = True, text
                        for n, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max)):
                            out[n][begin + i] = f(c[n][j] for j in places)
            c |= {n: pa.array(v, p[n].type) for n, v in out.items()}
        take = pa.array(np.flatnonzero(keep))
        rows = [*(k.take(pa.array(at)) for k in p.keys), *(c[n] for n in cols[2:]), pa.array(merged)]
        return pa.RecordBatch.from_arrays([x.take(take) for x in rows], [*cols, "merged"])

    out = by_page(lines, cols[2:], pages, f"{_kind(lines, *cols)}, merged boolean")
    return out.withColumn("text", F.when(F.col("merged"), T.normalize("text")).otherwise(F.col("text"))).drop("merged")


def document_text(lines: DataFrame) -> DataFrame:
    """(document, text): lines in order of page and place."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "line_seq", "text")))
    return lines.where("text <> ''").groupBy("document").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def parse(words: DataFrame) -> DataFrame:
    """(document, text) from words: the main parser from end to end."""
    return document_text(cleaned(without_page_numbers(recover_headings(without_headers(visual_lines(words))))))


def page_text(pages: DataFrame) -> DataFrame:
    """(document, text) from (document, page, text): non-empty pages, each followed by a line end."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: F.concat(x["text"], F.lit("\n"))), "")
    return pages.where("text <> ''").groupBy("document").agg(joined.alias("text"))


# --- the structured parser ----------------------------------------------------------------------------------


def block_lines(words: DataFrame, tolerance: float = Y_TOLERANCE) -> DataFrame:
    """Lines by the words' own block and line numbers, ordered down and then across the page."""

    def lines(p: Pages) -> pa.RecordBatch:
        across = order(p.at, [p["block_no"], p["line_no"], p["x0"], p["word_no"]], [p["text"]])
        take = pa.array(across)
        c = {n: v.take(take) for n, v in p.columns.items()}
        at = p.at[across]
        new = np.append(True, at[1:] != at[:-1])
        new[1:] |= differs(c["block_no"]) | differs(c["line_no"])
        starts = np.flatnonzero(new)
        at, begin = at[starts], pa.array(starts)
        rows = {"page_height": most(c["page_height"], starts), "text": joined(c["text"], starts, "default")}
        rows |= {n: f(c[n], starts) for n, f in (("x0", least), ("y0", least), ("x1", most), ("y1", most))}
        rows |= {n: c[n].take(begin) for n in ("block_no", "line_no")}
        # rint rounds halves to even, which round() does not.
        y, valid = numbers(rows["y0"])
        band = pa.array(np.rint(y / tolerance), mask=~valid)
        down = order(at, [band, rows["x0"], rows["block_no"], rows["line_no"]], [])
        rows = {n: v.take(pa.array(down)) for n, v in rows.items()}
        seq = pa.array(np.arange(len(at)) - np.searchsorted(at, at), pa.int32())  # at stays as it is in this order
        names = ["page_height", "line_seq", "text", "x0", "y0", "x1", "y1", "block_no", "line_no"]
        rows |= {"line_seq": seq}
        return pa.RecordBatch.from_arrays([*(k.take(pa.array(at)) for k in p.keys), *(rows[n] for n in names)], ["document", "page", *names])

    schema = f"{_kind(words, 'document', 'page', 'page_height')}, line_seq int, {_kind(words, 'text', 'x0', 'y0', 'x1', 'y1', 'block_no', 'line_no')}"
    return by_page(words, ["page_height", "text", "x0", "y0", "x1", "y1", "block_no", "line_no", "word_no"], lines, schema)


#: Forms of heading numbers.
_NUMBER = {"main": r"\d+(?:\.\d+){0,2}", "appendix": r"[A-Z](?:\.\d+){0,2}", "figure": r"图\s*[A-Z](?:\.\d+){0,2}", "table": r"表\s*\d+(?:\.\d+){0,2}"}


def _incomplete(kind: str) -> str:
    return rf"(?U)^({_NUMBER[kind]})\.(.*)$"


def is_incomplete_heading(c: Column) -> Column:
    return T.utrim(c).rlike("(?U)^(?:" + "|".join(_NUMBER.values()) + r")\.")


def completed(c: Column, suffix: Column) -> Column:
    """An incomplete heading with its last number: a dot before it in text numbers, none in figures and tables; null if it would be too deep."""
    c, out = T.utrim(c), None
    for kind in ("main", "appendix", "figure", "table"):
        number, title = F.regexp_extract(c, _incomplete(kind), 1), T.utrim(F.regexp_extract(c, _incomplete(kind), 2))
        dot = "." if kind in ("main", "appendix") else ""
        new = F.concat(number, F.lit(dot), T.utrim(suffix), F.lit(" "), title)
        if not dot:
            new = F.regexp_replace(new, r"(?U)^([图表])\s*", "$1 ")
        deep = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 2
        test = c.rlike(_incomplete(kind)) & (deep <= MAX_LEVEL)
        out = F.when(test, new) if out is None else out.when(test, new)
    return out


def merge_split_numbers(lines: DataFrame, max_gap: float = 20.0) -> DataFrame:
    """A heading that ends before its last digit, and that digit on the next line of the page, as one line."""
    by_page = W.partitionBy("document", "page").orderBy("line_seq")
    ahead = F.lead(F.struct("text", "y0", "x1", "y1")).over(by_page)
    lines = lines.withColumn("_next", ahead)
    gap = F.col("_next.y0") - F.col("y1")
    single = T.utrim(F.col("_next.text")).rlike(r"(?U)^\d$")
    new = F.when(is_incomplete_heading(F.col("text")) & single & gap.between(0, max_gap), completed(F.col("text"), F.col("_next.text")))
    lines = lines.withColumn("_new", new)
    # A line that was taken is a lone digit, which never takes one itself.
    taken = F.lag(F.col("_new").isNotNull(), 1, False).over(by_page)
    lines = lines.withColumn("_taken", taken).where("not _taken")
    return lines.withColumns(
        {
            "text": F.coalesce("_new", "text"),
            "x1": F.when(F.col("_new").isNotNull(), F.greatest("x1", "_next.x1")).otherwise(F.col("x1")),
            "y1": F.when(F.col("_new").isNotNull(), F.col("_next.y1")).otherwise(F.col("y1")),
        }
    ).drop("_next", "_new", "_taken")


def heading(c: Column) -> Column:
    """struct<kind, number, title, level> of a heading line, else null: figures and tables first, then text numbers, then appendices."""
    c, out = T.collapse(c), None
    patterns = {
        "figure": r"(?U)^(图\s*[A-Z](?:\.\d+){1,3})\s*(.*)$",
        "table": r"(?U)^(表\s*\d+(?:\.\d+){0,3})\s*(.*)$",
        "main": r"(?U)^(\d+(?:\.\d+){0,3})\s*(.*)$",
        "appendix": r"(?U)^([A-Z](?:\.\d+){0,3})\s*(.*)$",
    }
    for kind, p in patterns.items():
        number, title = F.regexp_extract(c, p, 1), T.utrim(F.regexp_extract(c, p, 2))
        level = (F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).cast("int")
        test = c.rlike(p)
        if kind in ("main", "appendix"):
            test = test & ((title == "") | ((F.length(title) <= 100) & ~title.rlike("[。；]$")))
        value = F.struct(F.lit(kind).alias("kind"), number.alias("number"), title.alias("title"), level.alias("level"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def full_heading(h: Column) -> Column:
    return F.when(h["title"] == "", h["number"]).otherwise(F.concat(h["number"], F.lit(" "), h["title"]))


def blocks(lines: DataFrame) -> DataFrame:
    """document, block, page_start, page_end, chapter, section, heading_path, text from lines(document, page, line_seq, text).

    A heading closes the block before it; a text heading sets its level of the path and clears the deeper ones, a figure or
    table is the first line of the next block.
    """
    order = W.partitionBy("document").orderBy("page", "line_seq")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines.withColumn("h", heading(F.col("text"))).withColumn("seq", F.row_number().over(order))
    opens = F.col("h").isNotNull() & F.col("h.kind").isin("main", "appendix")
    rows = rows.withColumn("block", F.sum(F.col("h").isNotNull().cast("int")).over(so_far))
    last = {n: F.last(F.when(opens & (F.col("h.level") == n), F.struct("seq", full_heading(F.col("h")).alias("text"))), True).over(so_far) for n in range(1, MAX_LEVEL + 1)}
    rows = rows.withColumns({f"l{n}": c for n, c in last.items()})
    live = []
    for n in range(1, MAX_LEVEL + 1):
        # A level holds until a shallower heading came after it.
        cut = F.greatest(F.lit(0), F.lit(0), *(F.coalesce(F.col(f"l{m}.seq"), F.lit(0)) for m in range(1, n)))
        live.append(F.when(F.col(f"l{n}.seq") > cut, F.col(f"l{n}.text")))
    rows = rows.withColumn("heading_path", F.array_compact(F.array(*live))).withColumn("chapter", live[0])
    body = T.utrim(F.when(F.col("h").isNull(), F.col("text")).otherwise(full_heading(F.col("h"))))
    rows = rows.where(~opens).withColumn("body", body)
    ordered = F.sort_array(F.collect_list(F.struct("seq", "body", "page")))
    out = rows.groupBy("document", "block").agg(ordered.alias("ls"), F.first("heading_path").alias("heading_path"), F.first("chapter").alias("chapter"))
    text = F.array_join(F.transform(F.filter("ls", lambda x: x["body"] != ""), lambda x: x["body"]), "\n")
    out = out.select(
        "document", "block", F.col("ls")[0]["page"].alias("page_start"), F.element_at("ls", -1)["page"].alias("page_end"), "chapter",
        F.when(F.size("heading_path") > 0, F.element_at("heading_path", -1)).alias("section"), "heading_path", text.alias("text"),
    )
    return out.where("text <> ''")


def parse_structured(words: DataFrame, remove_header_footer: bool = True) -> DataFrame:
    """Blocks from words: the structured parser from end to end."""
    lines = merge_split_numbers(block_lines(words).repartition("document"))  # where blocks() needs them too
    if remove_header_footer:
        lines = without_headers(without_footer_numbers(lines.where(T.utrim("text") != "")))
    return blocks(lines)


def blocks_json(of: DataFrame) -> DataFrame:
    return of.select(F.to_json(F.struct("document", "page_start", "page_end", "chapter", "section", "heading_path", "text"), {"ignoreNullFields": "false"}).alias("json"))
