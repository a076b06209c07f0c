"""Secret scans: an Aho-Corasick pass over each text finds keywords, regular expressions are matched only where
one was found, and token formats that embed a checksum are validated by it.

Kinds, in order: assign (keyword, separator, value of MIN_VALUE characters or more), access (AKIA...), hex (long runs of
hex digits), and beyond these github and npm: tokens whose last six characters are the CRC-32 of the
thirty before, in base 62. Hex runs have no keyword; one scan for a character class finds them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import table

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX)
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]+)")
NPM = re.compile(rb"npm_([A-Za-z0-9]+)")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
_ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(payload: bytes) -> bytes:
    n = zlib.crc32(payload)
    return bytes(_DIGITS[n // 62**k % 62] for k in range(5, -1, -1))


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= MIN_VALUE
    if kind == "access":
        return len(m[0]) >= MIN_ACCESS
    return len(m[1]) == 36 and checksum(m[1][:30]) == m[1][30:]


def scan(text: str | None, keywords) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and kind as listed; matches of a kind don't overlap, leftmost first."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hits = sorted((end - size + 1, kind) for end, (kind, size) in keywords.iter(raw.lower().decode("latin-1")))
    spans, past = [], dict.fromkeys(KEYWORDS, 0)
    for start, kind in hits:
        # A match that fails its test still uses up what it covers.
        if start >= past[kind] and (m := _ANCHORED[kind].match(raw, start)):
            past[kind] = m.end()
            if _holds(kind, m):
                spans.append((start, kind, m.end()))
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(raw)]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    if spans and not raw.isascii():
        cuts = sorted({x for s, _, e in spans for x in (s, e)})
        at, last, n = {}, 0, 0
        for c in cuts:
            n += len(raw[last:c].decode("utf-8", "surrogatepass"))
            at[c], last = n, c
        spans = [(at[s], kind, at[e]) for s, kind, e in spans]
    return spans


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, kind, e in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs(doc_id, text).

    A null text is an empty one; rows with a null doc_id and repeated rows stay; other columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for b in batches:
            rows = [scan(t.as_py(), keywords) for t in b.column(1)]
            counts = [pa.array([sum(s[1] == k for s in r) for r in rows], pa.int64()) for k in BASE]
            base = [sha256(joined([s for s in r if s[1] in BASE]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(base, pa.string()), pa.array(map(joined, rows), pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT for c in string_split(g[1:30], '')]),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda p, q: xor(p >> 1, 3988292384::UBIGINT * (p & 1)))))"""
_CHECKED = f"""length(g) = 36 AND g[31:] = array_to_string([substr('{_DIGITS.decode()}', ({_CRC} // d % 62)::BIGINT + 1, 1) for d in [916132832, 14776336, 238328, 3844, 62, 1]::UBIGINT[]], '')"""
_SQL_KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 6"),
    ("access", "()(AKIA[A-Z0-9]+)", "length(g) >= 20"),
    ("hex", "()([0-9a-f]{24,})", "true"),
    ("github", "(gh[pousr]_)([A-Za-z0-9]+)", _CHECKED),
    ("npm", "(npm_)([A-Za-z0-9]+)", _CHECKED),
)
OP3_SQL = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents), k AS ("
    + " UNION ALL ".join(
        f"""SELECT r, '{kind}' AS kind, {i} AS k, m, s FROM (
  SELECT r, unnest(ms) AS m, unnest(gs) AS g, unnest([list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) for i in range(1, len(ms) + 1)]) AS s
  FROM (SELECT r, regexp_extract_all(text, '{re_}') AS ms, regexp_extract_all(text, '{re_}', 2) AS gs, regexp_split_to_array(text, '{re_}') AS ps FROM d)) WHERE {test}"""
        for i, (kind, re_, test) in enumerate(_SQL_KINDS)
    )
    + """),
j AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM (SELECT *, kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT AS span FROM k) GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
"""
)
