"""Typed coercion in two families: of extracted values, which searches, and of edits, which validates the whole text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Texts that mean true or false, in each family.
EXTRACT_TRUE = ("true", "yes", "是", "有", "同意", "1", "√", "✓", "对")
EXTRACT_FALSE = ("false", "no", "否", "无", "不", "不同意", "0", "×", "✗", "错")
EDIT_TRUE = ("true", "yes", "1", "是", "y", "是的", "t", "√", "✓", "有", "同意")
EDIT_FALSE = ("false", "no", "0", "否", "n", "不是", "f", "×", "✗", "无", "不同意")
CURRENCY = ("¥", "￥", "$", "€", "£", "₹", "元", "万元", "亿")
TYPES = ("text", "long_text", "integer", "decimal", "date", "boolean", "list")


def missing(raw: Column) -> Column:
    return raw.isNull() | raw.isin("", "null")


def _plain(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, "[,， ]", ""))


def to_int(raw: Column) -> Column:
    """The first whole number anywhere in the text; null where there is none or it exceeds 64 bits."""
    return F.nullif(F.regexp_extract(_plain(raw), r"[-+]?\p{Nd}+", 0), F.lit("")).try_cast("bigint")


def to_float(raw: Column) -> Column:
    """The first number anywhere, without separators and currency signs; units aren't scaled."""
    text = _plain(raw)
    for sign in CURRENCY:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return F.nullif(F.regexp_extract(text, r"[-+]?\d+\.?\d*", 0), F.lit("")).try_cast("double")


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """yyyy-mm-dd of a date that exists, else null."""
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(text.try_cast("date").isNotNull(), text)


# Names of months, of days, and words that may stand in a written date.
MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")
DAYS = "(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
FILLERS = "(?:at|on|and|ad|of|m|t|st|nd|rd|th)"


def written_date(raw: Column) -> Column:
    """yyyy-mm-dd of a written date with day, month and year, else null: ``12 March 2024``, ``Tue, Mar. 12th 24``, ``31/12/24 10:30``.

    A number of three digits or more, or over 31, is the year. Beside a month's name the other number is the day; of two short ones
    the day comes first, unless the name stands last. Without a name the month comes first, or the day where the first number can't be a
    month, or the year where it can only be that. Years of two digits are the nearest to this year. Any other word makes it null, as
    does a missing part, which some parsers take from today's date.
    """
    name = rf"\b({'|'.join(MONTHS)})\b"
    text = F.regexp_replace(F.lower(strip(raw)), r"\b\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[ap]m\b)?", " ")
    text = F.regexp_replace(text, r"(\d)(?:st|nd|rd|th)\b", "$1 ")
    text = F.regexp_replace(text, r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " ")

    def read(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, name, " "), rf"\b(?:{DAYS}|{FILLERS})\b", " ")
        before = F.regexp_extract(text, rf"^(.*?)\b(?:{'|'.join(MONTHS)})\b", 1)
        return F.struct(
            F.element_at(F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m[:3], k))), F.nullif(F.left(F.regexp_extract(text, name, 1), F.lit(3)), F.lit(""))).alias("month"),
            F.size(F.regexp_extract_all(text, F.lit(name), 1)).alias("names"), F.size(F.regexp_extract_all(before, F.lit(r"(\d+)"), 1)).alias("ahead"),
            bare.rlike(r"^[\d\s.,;/'-]*$").alias("fine"), F.regexp_extract_all(bare, F.lit(r"(\d+)"), 1).alias("digits"),
        )

    def judged(q: Column) -> Column:
        a, b, c = (F.get(q["digits"], F.lit(k)).try_cast("int") for k in range(3))
        size = lambda k: F.length(F.get(q["digits"], F.lit(k)))
        ymd = lambda y, m, d, k: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), size(k).alias("s"))
        year_first = (size(0) > 2) | (a > 31)
        named = F.when(year_first | (~((size(1) > 2) | (b > 31)) & (q["ahead"] == 2)), ymd(a, q["month"], b, 0)).otherwise(ymd(b, q["month"], a, 1))
        plain = F.when(year_first, ymd(a, b, c, 0)).when(a > 12, ymd(c, b, a, 2)).otherwise(ymd(c, a, b, 2))
        n = F.size(q["digits"])
        return F.when(q["fine"] & (q["names"] == 1) & (n == 2), named).when(q["fine"] & (q["names"] == 0) & (n == 3), plain)

    def dated(parts: Column) -> Column:
        now = F.year(F.current_date())
        near = parts["y"] + (now - now % 100)
        near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        year = F.when((parts["s"] <= 2) & (parts["y"] < 100), near).otherwise(parts["y"])
        return _ymd(F.lpad(year.cast("string"), 4, "0"), parts["m"].cast("string"), parts["d"].cast("string"))

    return _once(_once(_once(text, read), judged), dated)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_date(raw: Column) -> Column:
    """A date as text: yyyy-mm-dd as it is, else year first, else month first, else eight digits in a row, else ``written_date``; else null.

    Eight digits give month and day without leading zeros, as the reference does.
    """
    s = strip(raw)
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    first, last, run = r"(\d{4})[年/\-.](\d{1,2})[月/\-.](\d{1,2})日?", r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", r"(\d{4})(\d{2})(\d{2})"
    compact = _ymd(part(run, 1), part(run, 2), part(run, 3))
    short = F.concat_ws("-", part(run, 1).try_cast("int"), part(run, 2).try_cast("int"), part(run, 3).try_cast("int"))
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
        .when(s.rlike(first) & _ymd(part(first, 1), part(first, 2), part(first, 3)).isNotNull(), _ymd(part(first, 1), part(first, 2), part(first, 3)))
        .when(s.rlike(last) & _ymd(part(last, 3), part(last, 1), part(last, 2)).isNotNull(), _ymd(part(last, 3), part(last, 1), part(last, 2)))
        .when(s.rlike(run) & compact.isNotNull(), short)
        .otherwise(written_date(raw))
    )


def _bool(raw: Column, true: tuple[str, ...], false: tuple[str, ...]) -> Column:
    s = F.lower(strip(raw))
    return F.when(s.isin(*true), F.lit(True)).when(s.isin(*false), F.lit(False))


def to_bool(raw: Column) -> Column:
    return _bool(raw, EXTRACT_TRUE, EXTRACT_FALSE)


def to_list(raw: Column) -> Column:
    """A JSON array, else the parts between the first separator of ``；;，,`` line break ``、`` that occurs; blanks dropped."""
    split = F.array(strip(raw))
    for sep in reversed(("；", ";", "，", ",", "\n", "、")):
        parts = F.filter(F.transform(F.split(raw, sep), strip), lambda x: x != "")
        split = F.when(F.contains(raw, F.lit(sep)), parts).otherwise(split)
    parsed = F.when(strip(raw).startswith("["), F.from_json(raw, "array<string>"))
    return F.coalesce(F.transform(parsed, strip), split)


def coerced(raw: Column, kind: Column) -> dict[str, Column]:
    """Typed columns of a value (v_text, v_int, v_dec, v_date, v_bool, v_list) and ``type_invalid``."""
    there = ~missing(raw)
    made = {
        "v_text": F.when(there & kind.isin("text", "long_text"), strip(raw)),
        "v_int": F.when(there & (kind == "integer"), to_int(raw)),
        "v_dec": F.when(there & (kind == "decimal"), to_float(raw)),
        "v_date": F.when(there & (kind == "date"), to_date(raw)),
        "v_bool": F.when(there & (kind == "boolean"), to_bool(raw)),
        "v_list": F.when(there & (kind == "list"), to_list(raw)),
    }
    nothing = F.coalesce(made["v_text"], made["v_int"].cast("string"), made["v_dec"].cast("string"), made["v_date"], made["v_bool"].cast("string"), F.array_join(made["v_list"], "")).isNull()
    return made | {"type_invalid": there & nothing}


def edit_date(raw: Column) -> Column:
    """Best effort, never an error: day or month first, then year first, else the text itself."""
    s = strip(raw)
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    a, b = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", r"^(\d{4})\D+(\d{1,2})\D+(\d{1,2})"
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s)
        .when(s.rlike(a), F.concat_ws("-", part(a, 3), F.lpad(part(a, 1), 2, "0"), F.lpad(part(a, 2), 2, "0")))
        .when(s.rlike(b), F.concat_ws("-", part(b, 1), F.lpad(part(b, 2), 2, "0"), F.lpad(part(b, 3), 2, "0")))
        .otherwise(s)
    )


def edit_bool(raw: Column) -> Column:
    return _bool(raw, EDIT_TRUE, EDIT_FALSE)


def edit_valid(raw: Column, kind: Column) -> Column:
    """Whether an edited value fits its type; an empty one does."""
    number = F.regexp_replace(raw, "[,，]", "").try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e300)
    fits = F.when(kind == "integer", whole).when(kind == "decimal", number.isNotNull()).when(kind == "boolean", edit_bool(raw).isNotNull()).otherwise(F.lit(True))
    return raw.isNull() | (raw == "") | fits


def edit_list(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, "[,;\n，；]"), strip), lambda x: x != "")


def as_string_list(one: Column, many: Column) -> Column:
    """A list as it is, a scalar as a list of one, null as the empty list."""
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
