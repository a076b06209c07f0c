"""Scalar text functions as Column expressions, with Unicode-aware white space, digits and line ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character ranges, line ends and the form of a standard's number.
CJK = "一-鿿"
CJK_WIDE = "㐀-䶿一-鿿"
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
STANDARD = r"(?Ui)^GB(?:/T)?\s*\d+(?:\.\d+)*\s*[—-]\s*\d{4}$"
#: White space that Python's strip() takes and Java's (?U)\s leaves.
_SPACE = r"[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_col(c), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), rf"(?U){_SPACE}+", " "))


def split_lines(c: Column | str) -> Column:
    """Lines as an array; a final line end opens no further line, an empty text has none."""
    parts = F.split(_col(c), LINE_ENDS, -1)
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stripped_lines(c: Column | str) -> Column:
    return F.transform(split_lines(c), utrim)


def slug(c: Column | str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def version_of(c: Column | str) -> Column:
    """Four digits at the end, else empty."""
    return F.regexp_extract(_col(c), r"([0-9]{4})$", 1)


def level_of_number(c: Column | str) -> Column:
    """1 to 4 by the number of dotted parts, 1 for an appendix, else 0."""
    c = _col(c)
    dotted = F.when(c.rlike(r"^[0-9]+(\.[0-9]+){0,3}$"), F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1)
    return F.when(c.startswith("附录"), 1).otherwise(F.coalesce(dotted, F.lit(0))).cast("int")


def clean_title(c: Column | str) -> Column:
    """Without the leader dots of a table of contents."""
    return utrim(F.regexp_replace(F.regexp_replace(utrim(c), "[·•]+$", ""), r"\.+$", ""))


def safe_filename(c: Column | str) -> Column:
    return F.substring(utrim(F.regexp_replace(_col(c), r'[\\/:*?"<>|]', "_")), 1, 80)


def normalize(c: Column | str) -> Column:
    """Spaces between scripts: none inside Chinese, one between Chinese, digits and Latin letters."""
    steps = [
        (rf"([{CJK}])\s+([{CJK}])", "$1$2"),
        (rf"(?U)(\d)([{CJK}])", "$1 $2"),
        (rf"(?U)([{CJK}])(\d)", "$1 $2"),
        (rf"([A-Za-z])([{CJK}])", "$1 $2"),
        (rf"([{CJK}])([A-Za-z])", "$1 $2"),
        (r"(?U)(\d)([A-Za-z])", "$1 $2"),
        (r"(?U)([A-Za-z])(\d)", "$1 $2"),
        (rf"(?U)^((?:[A-Z]\.)?\d+(?:\.\d+){{0,3}})([{CJK}])", "$1 $2"),
        (rf"(?U)^(图[A-Z]?\d+(?:\.\d+)*)([{CJK}])", "$1 $2"),
        (r" {2,}", " "),
    ]
    # Nothing but white space changes in a text without Chinese and without a digit beside a Latin letter, as most are.
    some = rf"(?U)[{CJK}]|\d[A-Za-z]|[A-Za-z]\d"
    every = lambda x: F.trim(reduce(lambda y, s: F.regexp_replace(y, *s), steps, x))
    return F.transform(F.array(collapse(c)), lambda x: F.when(x.rlike(some), every(x)).otherwise(x))[0]


def _kind(c: Column) -> Column:
    return F.when(c.rlike(f"^[{CJK_WIDE}]$"), "c").when(c.rlike(r"(?U)^\d$"), "d").when(c.rlike("^[A-Za-z]$"), "l").otherwise("")


def needs_space(left: Column, right: Column) -> Column:
    """Whether a blank goes between two characters: only between different ones of Chinese, digit and Latin letter."""
    a, b = _kind(left), _kind(right)
    return (a != "") & (b != "") & (a != b)


def needs_space_by_default(left: Column, right: Column) -> Column:
    """The structured parser's rule: always, but not inside Chinese nor at Chinese punctuation."""
    han = f"^[{CJK_WIDE}]$"
    return ~((left.rlike(han) & right.rlike(han)) | right.rlike("^[，。；：、）】》〉]$") | left.rlike("^[（【《〈]$"))


def join_words(words: Column, rule=needs_space) -> Column:
    """An array of words as one string, with blanks where the rule wants them."""
    last, first = lambda x: F.substring(x, -1, 1), lambda x: F.substring(x, 1, 1)
    return F.aggregate(
        F.filter(words, lambda w: w != ""),
        F.lit(""),
        lambda text, w: F.when(text == "", w).when(rule(last(text), first(w)), F.concat(text, F.lit(" "), w)).otherwise(F.concat(text, w)),
    )


def is_standard_line(c: Column | str) -> Column:
    return utrim(c).rlike(STANDARD)


def is_page_number(c: Column | str) -> Column:
    """One to four digits, or 第 n 页."""
    return utrim(c).rlike(r"(?U)^(\d{1,4}|第\s*\d+\s*页)$")


def sentences(c: Column | str, terminators: str = "。！？；") -> Column:
    """Pieces that end with a terminator, stripped, empty ones dropped."""
    found = F.regexp_extract_all(_col(c), F.lit(f"(?s)[^{terminators}]*[{terminators}]|[^{terminators}]+"), F.lit(0))
    return F.filter(F.transform(found, utrim), lambda s: s != "")


def heading_level(c: Column | str) -> Column:
    """Of a line inside a chapter: 4 to 1 by its number, 1 for an appendix, 0 for anything else."""
    c = _col(c)
    out = F.when(c.rlike(r"(?U)^\d+\.\d+\.\d+\.\d+\s+.+$"), 4).when(c.rlike(r"(?U)^\d+\.\d+\.\d+\s+.+$"), 3)
    out = out.when(c.rlike(r"(?U)^\d+\.\d+\s+.+$"), 2).when(c.rlike(r"(?U)^\d+\s+.+$"), 1)
    return out.when(c.rlike(r"(?U)^附录\s*[A-Z](?:\s*[（(].*[）)])?$"), 1).otherwise(0)


def heading_number(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_col(c), r"(?U)^(\d+(?:\.\d+)*)\s+", 1), F.lit("")), F.regexp_extract(_col(c), r"(?U)^(附录\s*[A-Z])", 1))


def heading_title(c: Column | str) -> Column:
    c = _col(c)
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?U)^(?:\d+(?:\.\d+)*|附录\s*[A-Z])\s+(.+)$", 1), F.lit("")), c)


def chapter_title_kind(c: Column | str) -> Column:
    """level1, level2 or appendix for a line that opens a chapter, else null."""
    c = _col(c)
    number = F.coalesce(F.nullif(F.regexp_extract(c, r"(?U)^(\d+)\s+.+$", 1), F.lit("")), F.regexp_extract(c, rf"(?U)^(\d+)[{CJK}].*$", 1))
    short = F.length(F.regexp_replace(number, "^0+", "")).between(1, 2)
    kind = F.when((number != "") & short, "level1").when(c.rlike(rf"(?U)^\d+\.\d+(\s+.+|[{CJK}].*)$"), "level2")
    return kind.when(c.rlike(r"(?U)^附录\s+[A-Z]"), "appendix")
