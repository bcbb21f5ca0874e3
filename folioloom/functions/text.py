"""Text functions: Column in, Column out. Only Unicode normal forms, sequence ratio and CJK rejoining are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: White space as Python's str.strip and \s see it.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: Its characters, and those of them that may stand at the end of a line.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
AT_LINE_END = "".join(c for c in SPACES if c not in "\n\x1c\x1d\x1e\x1f\u2028\u2029")
#: What a normalised title has none of: quotes, brackets, and SPACE spelt out. Narrow characters by one bitmap; the wide ones are tried at wide ones alone.
TITLE_MARKS = (r"[<>\"'()\[\]\x09-\x0d\x1c-\x20\x85\xa0]+", r"(?![\x00-\xff])[《》“”‘’（）【】\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# Ligatures and typographic marks with their plain forms.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--",
    " ": " ", "​": "", "﻿": "",
}
# The code point ranges that count as CJK.
CJK_RANGES = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F),
    (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0x3000, 0x303F), (0xFF00, 0xFFEF),
)
CJK = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
_CJK_PY = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]")
# Weak endings of a title, tried in this order.
WEAK_ENDINGS = ("材料", "发言稿", "报告材料", "汇报材料", "汇报稿")
UNNAMED = "未命名"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends, as Python's strip."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp similarity; not symmetric, so the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _rejoined(text: str) -> str:
    """Without one white-space character between two CJK characters; matches don't overlap, as with one left-to-right pass."""

    def fix(m: re.Match) -> str:
        joined = _CJK_PY.match(m[1]) and _CJK_PY.match(m[2])
        return m[1] + m[2] if joined else m[0]

    return re.sub(r"(.)\s(.)", fix, text) if _CJK_PY.search(text) else text


@F.pandas_udf(StringType())
def rejoin_cjk(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else _rejoined(x))


#: Texts that a task of ``nfc_rejoined`` holds as Python strings at a time.
AT_ONCE = 128


@F.arrow_udf(StringType())
def nfc_rejoined(text: pa.Array) -> pa.Array:
    """NFC, and CJK characters rejoined; ASCII texts are so already."""

    def fixed(x: str | None) -> str | None:
        return x if x is None or x.isascii() else _rejoined(unicodedata.normalize("NFC", x))

    parts = [pa.array([fixed(x) for x in text.slice(k, AT_ONCE).to_pylist()], pa.string()) for k in range(0, len(text), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def dehyphenate(text: Column) -> Column:
    """Join words broken by a hyphen at a line end, unless the text has any CJK character."""
    joined = F.regexp_replace(text, r"(?U)([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")
    return F.when(F.contains(text, F.lit("-\n")) & ~has_cjk(text), joined).otherwise(text)


def ocr_fixes(text: Column) -> Column:
    # each pattern begins with the character it replaces, so that the surroundings are looked at only there
    for pattern, new in ((r"0(?<=[A-Z]0)(?=[A-Z])", "O"), (r"O(?<=\p{Nd}O)(?=\p{Nd})", "0"), (r"l(?<=\p{Nd}l)(?=\p{Nd})", "1"), (r"(?U)l(?<=\bl)\b", "1")):
        text = F.regexp_replace(text, pattern, new)
    return text


def expand_ligatures(text: Column) -> Column:
    for old, new in LIGATURES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def tidy_lines(text: Column) -> Column:
    """At most one blank line in a row, no white space at line ends, no line break at the end."""
    text = F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text)
    text = F.regexp_replace(text, r"\r\n?|[\x{85}\x{2028}\x{2029}]", "\n")
    text = F.regexp_replace(text, r"\n\z", "")
    lines = F.regexp_replace(text, r"(?m)[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}&&[^\n]]+$", "")
    return F.when(F.contains(text, F.lit("\n")), lines).otherwise(F.rtrim(text, F.lit(AT_LINE_END)))


def clean_text_native(text: Column) -> Column:
    """``clean_text`` without its two Python steps: for text in NFC without CJK characters."""
    return tidy_lines(dehyphenate(drop_controls(expand_ligatures(F.coalesce(text, F.lit(""))))))


def clean_text(text: Column, is_ocr: Column | None = None) -> Column:
    """Page cleaning: ligatures, control characters, NFC, hyphens at line ends, CJK spaces, OCR fixes, blank lines.

    CJK characters are rejoined before hyphens are, in one step with NFC: only texts with such characters have any to rejoin, and only those without
    have hyphens taken out.
    """
    text = dehyphenate(nfc_rejoined(drop_controls(expand_ligatures(F.coalesce(text, F.lit(""))))))
    if is_ocr is not None:
        text = F.when(is_ocr, ocr_fixes(text)).otherwise(text)
    return tidy_lines(text)


def char_count(text: Column) -> Column:
    return F.length(strip(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def is_empty_page(text: Column) -> Column:
    return char_count(text) < 5


def text_around(text: Column, keyword: str, window: int = 300) -> Column:
    """The first occurrence of a literal keyword in either case, with ``window`` characters at each side; else empty."""
    at = F.locate(keyword.lower(), F.lower(text))
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + len(keyword) + window - start)).otherwise(F.lit(""))


def keyword_starts(text: Column, keyword: str, most: int = 3) -> Column:
    """Start positions (from 1) of the first ``most`` occurrences, which may overlap."""
    low, word = F.lower(text), F.lit(keyword.lower())
    found, last = [], F.lit(0)
    for _ in range(most):
        hit = F.call_function("locate", word, low, last + 1)
        last = F.when(hit > 0, hit).otherwise(F.length(low) + 1)
        found.append(hit)
    return F.filter(F.array(*found), lambda i: i > 0)


def chunks(text: Column, size: int = 12_000, overlap: int = 500) -> Column:
    """Windows of ``size`` characters that start every ``size - overlap``."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / step).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def verify_snippet(snippet: Column, full: Column) -> Column:
    """The snippet if the text has it but for white space; else the surroundings of its middle half; else empty."""
    s, t = squeeze(snippet), squeeze(full)
    n = F.length(s)
    lo, hi = F.floor(n / 4), F.floor(n * 3 / 4)
    core = F.substring(s, (lo + 1).cast("int"), (hi - lo).cast("int"))
    at = F.instr(t, core)
    start = F.greatest(at - 60, F.lit(1))
    near = F.substring(t, start, at + F.length(core) + 60 - start)
    found = F.when(F.contains(t, s), snippet).when((core != "") & F.contains(t, core), near).otherwise(F.lit(""))
    return F.when(F.length(snippet) > 20, found).otherwise(snippet)


def normalise_code_native(code: Column) -> Column:
    """Upper case, letters and digits only; for text in NFKC."""
    return F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), r"[^\p{L}\p{N}]", "")


def normalise_code(code: Column) -> Column:
    return normalise_code_native(nfkc(code))


def normalise_title_native(title: Column) -> Column:
    """Without file ending, quotes, brackets, white space and weak endings; for text in NFKC.

    File endings, and weak endings once white space is gone, lie in the last characters alone, so only those are searched for them.
    """
    t = _at_end(F.coalesce(title, F.lit("")), 8, lambda x: F.regexp_replace(x, r"(?i)\.(pdf|docx?|xlsx)$", ""))
    t = F.replace(t, F.lit(" "), F.lit(""))
    for marks in TITLE_MARKS:
        t = F.regexp_replace(t, marks, "")
    t = F.btrim(t, F.lit(" .。"))

    def weak(x: Column) -> Column:
        for ending in WEAK_ENDINGS:
            x = F.regexp_replace(x, f"{ending}$", "")
        return x

    return _at_end(t, sum(map(len, WEAK_ENDINGS)), weak)


#: Single characters of TITLE_MARKS beyond ASCII that aren't white space, and the line ends before which a Java pattern's $ also matches.
_MARKS = "《》“”‘’（）【】"
#: White space and marks in ASCII.
_PLAIN_MARKS = b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f <>\"'()[]"
_ENDING = re.compile(r"\.(pdf|docx?|xlsx)(?=(\r\n|[\n\r\x85\u2028\u2029])?\Z)", re.ASCII | re.IGNORECASE)


def plain_title(title: str | None, fold: bool) -> str:
    """``normalise_title``, or ``normalise_title_native`` without ``fold``, of one string: for passes that are in Python anyhow."""
    t = unicodedata.normalize("NFKC", title or "") if fold else title or ""
    t = t[:-8] + _ENDING.sub("", t[-8:])
    t = t.encode("utf-8", "surrogatepass").translate(None, _PLAIN_MARKS).decode("utf-8", "surrogatepass")
    if not t.isascii():
        t = "".join(t.split())
        for mark in _MARKS:
            t = t.replace(mark, "")
    t = t.strip(" .。")
    for ending in WEAK_ENDINGS:
        t = t.removesuffix(ending)
    return t


def _at_end(text: Column, n: int, change: Callable[[Column], Column]) -> Column:
    """``change`` made to the last ``n`` characters; the text, an expression of some work, is bound once."""
    return F.transform(F.array(text), lambda t: F.concat(F.left(t, F.length(t) - n), change(F.substring(t, F.greatest(F.length(t) - n, F.lit(0)) + 1, F.lit(n)))))[0]


def normalise_title(title: Column) -> Column:
    return normalise_title_native(nfkc(title))


def normalise_header(header: Column) -> Column:
    """Lower case, punctuation runs to a space, other marks dropped, single-spaced."""
    t = F.lower(strip(F.coalesce(header, F.lit(""))))
    t = F.regexp_replace(t, "[\\s\\x{3000}\\x{a0}\\-_.()（）\\[\\]{}:：;；,，\"']+", " ")
    return squeeze(F.regexp_replace(t, r"[^\p{L}\p{N}_ ]+", ""))


def slug(name: Column) -> Column:
    """A key from a name: runs of other characters to ``_``; ``field`` if nothing is left."""
    t = F.regexp_replace(F.lower(strip(name)), r"[^\p{L}\p{N}\p{M}_]+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("field"))


def sanitize_filename_native(name: Column, most: int = 120) -> Column:
    """A safe file name; for text in NFKC."""
    t = squeeze(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"))
    t = F.replace(F.regexp_replace(t, "^[ .]+|[ .]+$", ""), F.lit(".."), F.lit("."))
    t = F.coalesce(F.nullif(t, F.lit("")), F.lit(UNNAMED))
    t = F.regexp_replace(F.left(t, F.lit(most)), "^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(UNNAMED))


def sanitize_filename(name: Column, most: int = 120) -> Column:
    return sanitize_filename_native(nfkc(name), most)


def strip_extension(name: Column) -> Column:
    """Base name without its last ending; a name that begins with its only dot has none."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=[^.])\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The last ending in lower case with its dot, or empty."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, "^.*/", ""), r"[^.](\.[^.]*)$", 1))


def title_from_filename(name: Column) -> Column:
    return strip(F.regexp_replace(strip_extension(name), r"^[\p{Nd}一二三四五六七八九十]+[、._\-\s]+", ""))


def code_from_filename(name: Column) -> Column:
    """The first run that begins with up to six letters and a digit; for text in NFKC."""
    found = F.regexp_extract(strip_extension(name), r"([A-Za-z]{0,6}\p{Nd}[\p{L}\p{N}_\-〔〕\[\]（）()号第]*)", 1)
    return F.nullif(found, F.lit(""))


def keyword_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[，,。；;：:\s]+"), lambda t: F.length(t) >= 2)


def keyword_score(left: Column, right: Column) -> Column:
    """0.6 times the share of the left side's tokens, two characters or longer, that the right side contains."""
    tokens = keyword_tokens(left)
    hits = F.size(F.filter(tokens, lambda t: F.contains(right, t)))
    return F.when(F.size(tokens) > 0, F.lit(0.60) * hits / F.size(tokens)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(F.array_union(a, b)))


def strip_markdown(text: Column) -> Column:
    """Without Markdown's emphasis, code and strike marks, headings, rules, bullets and numbers; then stripped.

    Lines end at \\n alone, digits and spaces are Unicode's, null gives the empty text.
    """
    text = F.coalesce(text, F.lit(""))
    # The marks and line openings that go.
    for mark in (r"\*\*", "__", r"\*", "_", "`", "~~"):
        text = F.regexp_replace(text, f"(?d){mark}(.+?){mark}", "$1")
    for pattern in (rf"^#{{1,6}}{SPACE}+", "^[-–—]{3,}$", rf"^[*+-]{SPACE}+", rf"^\p{{Nd}}+[.)]{SPACE}+"):
        text = F.regexp_replace(text, f"(?md){pattern}", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def has_table(text: Column) -> Column:
    """Three lines or more that begin and end with a bar."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & F.trim(x).endswith("|"))) >= 3


def any_keyword(text: Column, keywords: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(low, k))
