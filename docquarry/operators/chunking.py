"""Retrieval chunks: sections, paragraphs and sentences packed to a token budget, with overlap and heading context.

Packing feeds back what was emitted, so it is a fold over one chunk's text; each chunk is a row, and rows are
independent. Sections, paragraphs and token windows also exist as DataFrame operators.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from docquarry.durable import slices
from docquarry.functions import text as T

#: Fixed value.
STRATEGY = "hierarchical_recursive_v1"
#: Bytes of texts that are packed at once, besides a longer text; what becomes of them is some ten times that in Python.
PACK_BYTES = 1 << 18
_LINE_END = re.compile(T.LINE_ENDS)


@dataclass(frozen=True)
class Budget:
    """min_tokens is checked against the others and has no further effect."""

    max_tokens: int = 600
    min_tokens: int = 100
    overlap_tokens: int = 80
    terminators: str = "。！？；"

    def __post_init__(self) -> None:
        for name, least in (("max_tokens", 1), ("min_tokens", 0), ("overlap_tokens", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.min_tokens > self.max_tokens:
            raise ValueError("min_tokens must not exceed max_tokens")
        if self.overlap_tokens >= self.max_tokens:
            raise ValueError("overlap_tokens must be less than max_tokens")


class PieceTokenizer:
    """Single Chinese characters, runs of letters and digits, single other signs; white space goes with what follows it."""

    _piece = re.compile(r"\s*(?:[㐀-䶿一-鿿]|[^\W㐀-䶿一-鿿]+|\S)|\s+$")

    def encode(self, text: str) -> list:
        return self._piece.findall(text)

    def decode(self, tokens: list) -> str:
        return "".join(tokens)


class WordTokenizer(PieceTokenizer):
    """White-space-separated words."""

    def encode(self, text: str) -> list:
        return text.split()

    def decode(self, tokens: list) -> str:
        return " ".join(tokens)


class VocabularyTokenizer(PieceTokenizer):
    """A vocabulary file of the tokenizers library; special strings in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True

    def encode(self, text: str) -> list:
        return self.model.encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list) -> str:
        return self.model.decode(tokens, skip_special_tokens=True)


_LEVELS = [(n, re.compile(r"\d+" + r"\.\d+" * (n - 1) + r"\s+.+$")) for n in (4, 3, 2, 1)]
_APPENDIX = re.compile(r"附录\s*[A-Z](?:\s*[（(].*[）)])?$")


def level_of(line: str) -> int:
    return next((n for n, p in _LEVELS if p.match(line)), 1 if _APPENDIX.match(line) else 0)


def lines_of(text: str) -> list[str]:
    out = [x.strip() for x in _LINE_END.split(text)]
    return out[:-1] if _LINE_END.split(text)[-1] == "" else out


def sections_of(lines: list[str]) -> list[tuple[list[str], list[str]]]:
    """(headings in force, body lines) of each stretch that has a body."""
    stack: dict[int, str] = {}
    out: list[tuple[list[str], list[str]]] = []
    body: list[str] = []
    for line in [*lines, None]:
        level = level_of(line) if line else 0
        if line is not None and not level:
            body.append(line)
            continue
        if body:
            out.append(([stack[k] for k in sorted(stack)], body))
            body = []
        if level:
            stack = {k: v for k, v in stack.items() if k < level} | {level: line}
    return out


def paragraphs_of(body: list[str]) -> list[str]:
    """Runs of lines between blank ones, put together without a separator."""
    out = [""]
    for line in body:
        if line:
            out[-1] += line
        elif out[-1]:
            out.append("")
    return [p for p in out if p]


def sentences_of(text: str, terminators: str) -> list[str]:
    found = re.findall(f"(?s)[^{terminators}]*[{terminators}]|[^{terminators}]+", text)
    return [s for s in map(str.strip, found) if s]


class Packer:
    def __init__(self, budget: Budget, tokenizer) -> None:
        self.budget, self.tokenizer = budget, tokenizer

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text))

    def windows(self, text: str, size: int) -> list[str]:
        tokens, out, start = self.tokenizer.encode(text), [], 0
        while start < len(tokens):
            end = min(start + size, len(tokens))
            out.append(self.tokenizer.decode(tokens[start:end]).strip())
            if end == len(tokens):
                break
            start = max(end - self.budget.overlap_tokens, start + 1)
        return [p for p in out if p]

    def tail(self, units: list[str]) -> list[str]:
        """Whole units from the end while they fit the overlap."""
        first, left = len(units), self.budget.overlap_tokens
        while first and (left := left - self.count(units[first - 1])) >= 0:
            first -= 1
        return units[first:]

    def pack(self, units: list[str], room: int, room_after_overlap: int, glue: str, oversize: Callable[[str], list[str]]) -> list[str]:
        """Greedy packing; the room that counts right after an overlap is given apart, as it isn't the same for paragraphs."""
        out: list[str] = []
        now: list[str] = []
        used = 0
        for u in units:
            n = self.count(u)
            if n > room:
                if now:
                    out.append(glue.join(now))
                now, used = [], 0
                out += oversize(u)
            elif used + n <= room:
                now.append(u)
                used += n
            else:
                if now:
                    out.append(glue.join(now))
                now = self.tail(now)
                used = self.count(glue.join(now))
                if used + n <= room_after_overlap:
                    now.append(u)
                    used += n
                else:
                    out.append(u)
                    now, used = [], 0
        return out + ([glue.join(now)] if now else [])

    def pieces(self, body: list[str], room: int) -> list[str]:
        def long(paragraph: str) -> list[str]:
            return self.pack(sentences_of(paragraph, self.budget.terminators), room, room, "", lambda s: self.windows(s, room))

        return self.pack(paragraphs_of(body), room, self.budget.max_tokens, "\n", long)

    def chunks(self, source: dict) -> list[dict]:
        """Retrieval chunks of one structured chunk."""
        out: list[dict] = []
        found: list[tuple[list[str], str, int]] = []
        for headings, body in sections_of(lines_of(source["content"] or "")):
            room = self.budget.max_tokens - self.count(content_of(headings, ""))
            if room <= 0:
                raise ValueError(f"the headings of {source['chunk_id']} exceed max_tokens")
            found += [(headings, piece, room) for piece in self.pieces(body, room)]
        for i, (headings, piece, room) in enumerate(found, 1):
            content = content_of(headings, piece)
            n = self.count(content)
            name = f"{source['chunk_id']}_{i:03d}"
            if n <= self.budget.max_tokens:
                out.append(source | {"chunk_id": name, "content": content, "chunk_index": i, "token_count": n} | _place(source, headings))
                continue
            for j, part in enumerate(self.windows(content, room), 1):
                n = self.count(part)
                if n > self.budget.max_tokens:
                    raise ValueError(f"a piece of {source['chunk_id']} has {n} tokens")
                out.append(source | {"chunk_id": f"{name}_{j:02d}", "content": part, "chunk_index": None, "token_count": n})
        for c in out:
            c |= {"content_hash": hashlib.sha256(c["content"].encode()).hexdigest(), "chunk_strategy": STRATEGY}
        return out


def content_of(headings: list[str], body: str) -> str:
    return "\n\n".join(p for p in (*(h.strip() for h in headings), body.strip()) if p)


def _place(source: dict, headings: list[str]) -> dict:
    path = " > ".join(headings[:-1]) if len(headings) > 1 else None
    if not headings or not (level := level_of(headings[-1])):
        return {"parent_path": path}
    number = re.match(r"(\d+(?:\.\d+)*)\s+|(附录\s*[A-Z])", headings[-1])
    title = re.match(r"(?:\d+(?:\.\d+)*|附录\s*[A-Z])\s+(.+)$", headings[-1])
    out = {"parent_path": path, "level": level, "title": title[1] if title else headings[-1]}
    return out | ({"chapter": number[1] or number[2]} if number else {})


COLUMNS = {
    "chunk_pos": "long", "chunk_id": "string", "document_id": "string", "document": "string", "source": "string", "version": "string", "chapter": "string", "title": "string",
    "level": "int", "parent_path": "string", "content": "string", "content_hash": "string", "is_deleted": "boolean", "chunk_strategy": "string", "chunk_index": "int",
    "token_count": "int", "page_start": "int", "page_end": "int",
}
RECORD = ", ".join(f"{n} {t}" for n, t in COLUMNS.items())


def retrieval_chunks(chunks: DataFrame, budget: Budget = Budget(), tokenizer: Callable[[], object] = PieceTokenizer, on_error: str = "raise") -> DataFrame:
    """Retrieval chunks of structured chunks, with an error column.

    chunk_pos is the source's; (chunk_pos, piece) orders the result. With on_error="keep" a source that can't be packed gives one row
    with its error and no content instead of ending the job.
    """
    kinds = to_arrow_schema(_parse_datatype_string(f"{RECORD}, piece int, error string"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(budget, tokenizer())
        for b in (part for whole in batches for part in slices(whole, list(COLUMNS).index("content"), PACK_BYTES)):
            rows: list[dict] = []
            for source in b.to_pylist():
                try:
                    rows += [c | {"piece": i, "error": None} for i, c in enumerate(packer.chunks(source))]
                except ValueError as e:
                    if on_error == "raise":
                        raise
                    rows.append(source | {"content": None, "piece": 0, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    have = chunks.columns
    own = [F.col(c).cast(t) if c in have else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()]
    return chunks.select(own).mapInArrow(split, f"{RECORD}, piece int, error string")


def outcome(chunks: DataFrame) -> DataFrame:
    """How many documents succeeded and failed."""
    per = chunks.groupBy("document").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    return per.groupBy(F.when(F.col("failed"), "failed").otherwise("success").alias("status")).agg(F.count("*").alias("documents"))


def sections(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_no, headings, parent_path, lines): stretches of body lines under the headings in force."""
    rows = texts.select(key, F.posexplode(T.stripped_lines(text)).alias("pos", "line")).withColumn("level", T.heading_level("line"))
    so_far = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(so_far).cast("int"))
    rows = rows.withColumns({f"l{n}": F.last(F.when(F.col("level") == n, F.struct("pos", "line")), True).over(so_far) for n in range(1, 5)})
    live = []
    for n in range(1, 5):
        cut = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"l{m}.pos"), F.lit(-1)) for m in range(0 + 1, n)), F.lit(-1))
        live.append(F.when(F.col(f"l{n}.pos") > cut, F.col(f"l{n}.line")))
    rows = rows.withColumn("headings", F.array_compact(F.array(*live))).where("level = 0")
    out = rows.groupBy(key, "section_no").agg(F.first("headings").alias("headings"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    path = F.when(F.size("headings") > 1, F.array_join(F.slice("headings", 1, F.size("headings") - 1), " > "))
    return out.select(key, "section_no", "headings", path.alias("parent_path"), F.transform("ls", lambda x: x["line"]).alias("lines"))


def paragraphs(sections_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section_no, paragraph_no, text) of sections()."""
    rows = sections_.select(key, "section_no", F.posexplode("lines").alias("pos", "line"))
    blank = F.sum((F.col("line") == "").cast("int")).over(W.partitionBy(key, "section_no").orderBy("pos"))
    rows = rows.withColumn("run", blank).where("line <> ''")
    out = rows.groupBy(key, "section_no", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    number = F.row_number().over(W.partitionBy(key, "section_no").orderBy("run")).cast("int")
    return out.select(key, "section_no", number.alias("paragraph_no"), F.array_join(F.transform("ls", lambda x: x["line"]), "").alias("text"))


def token_windows(texts: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, window_no, start, tokens, content): overlapping windows over white-space tokens, in the JVM."""
    step = max(size - overlap, 1)
    rows = texts.select(key, F.regexp_extract_all(F.col(text), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)).alias("ts")).where(F.size("ts") > 0)
    # The last window is the first that reaches the end.
    last = F.greatest(F.lit(0), F.ceil((F.size("ts") - F.lit(size)) / F.lit(step))).cast("int")
    rows = rows.select(key, "ts", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    part = F.slice("ts", F.col("window_no") * step + 1, size)
    return rows.select(key, "window_no", (F.col("window_no") * step).cast("int").alias("start"), F.size(part).alias("tokens"), F.array_join(part, " ").alias("content"))


def with_token_count(chunks: DataFrame, count: Column) -> DataFrame:
    return chunks.withColumn("token_count", F.coalesce(F.col("token_count"), count.cast("int")))


def token_stats(chunks: DataFrame, count: str = "token_count") -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"), F.coalesce(F.min(count), F.lit(0)).alias("min_tokens"), F.coalesce(F.max(count), F.lit(0)).alias("max_tokens"), F.coalesce(F.avg(count), F.lit(0.0)).alias("mean_tokens")
    )


def audit(structured: DataFrame, retrieval: DataFrame, max_tokens: int = 600, model_tokens: int = 8192) -> DataFrame:
    """One row of counts and a verdict: FAILED if a retrieval chunk is over a limit or blank, WARNING if a structured one is over the model's."""
    first = structured.agg(F.count_if(F.col("token_count") > model_tokens).alias("structured_over_model"))
    blank = T.utrim(F.coalesce("content", F.lit(""))) == ""
    second = retrieval.agg(
        F.count_if(F.col("token_count") > max_tokens).alias("over_budget"), F.count_if(F.col("token_count") > model_tokens).alias("over_model"), F.count_if(blank).alias("blank")
    )
    both = first.crossJoin(second)  # of one row each
    bad = (F.col("over_budget") > 0) | (F.col("over_model") > 0) | (F.col("blank") > 0)
    return both.withColumn("verdict", F.when(bad, "FAILED").when(F.col("structured_over_model") > 0, "WARNING").otherwise("PASSED"))


def offenders(chunks: DataFrame, limit_tokens: int, shown: int = 20) -> DataFrame:
    return chunks.where(F.col("token_count") > limit_tokens).orderBy(F.desc("token_count"), "chunk_id").limit(shown)


def samples(retrieval: DataFrame, sources: int = 5, pieces: int = 3, preview: int = 300) -> DataFrame:
    """The first pieces of the first sources that have any, with the beginning of their texts."""
    first = retrieval.select("chunk_pos").distinct().orderBy("chunk_pos").limit(sources)
    rows = retrieval.join(F.broadcast(first), "chunk_pos")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("chunk_pos").orderBy("piece"))).where(F.col("n") <= pieces)
    return rows.select("chunk_pos", "chunk_id", "token_count", F.substring("content", 1, preview).alias("preview"))
