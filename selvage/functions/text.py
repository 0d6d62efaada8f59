"""Texts of sheets and forms: numbers, lengths, sizes, names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CM_PER_INCH = 2.54
# Names of letter sizes, small to large; words for a line that all sizes share.
LETTER_SIZES = ("XXXS", "XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL", "XXXXL")
SHARED = ("*", "vše", "uni")
SIZE_TOKEN = r"(?i)^(?:\d+(?:[.,]\d+)?|x{0,3}[sl]|m|\d?xl|x{1,4}l|uni)$"
#: White space as scripts on the web see it, with the no-break ones.
SPACE = r"[\s\u00a0\u202f\ufeff]"
LONGEST_SIZE = 12


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"^{SPACE}+|{SPACE}+$", "")


def to_unit(cm: Column | str, unit: str) -> Column:
    return _col(cm) / CM_PER_INCH if unit == "in" else _col(cm)


def from_unit(value: Column | str, unit: str) -> Column:
    return _col(value) * CM_PER_INCH if unit == "in" else _col(value)


def parse_decimal(text: Column | str) -> Column:
    """A number with a comma or a dot; NaN for anything else."""
    plain = F.regexp_replace(trim(text), r"^([^,]*),", "$1.")
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), F.expr("0D") + plain.try_cast("double")).otherwise(F.lit(float("nan")))


def parse_length(text: Column | str, unit: str) -> Column:
    """Centimetres of a typed length: decimals, fractions and mixed numbers; NaN if it is none."""
    s = trim(text)
    pattern = r"^(?:(\d+)[\s-]+)?(\d+)\s*/\s*(\d+)$"
    part = [F.regexp_extract(s, pattern, k).try_cast("double") for k in (1, 2, 3)]
    plain = F.regexp_replace(F.regexp_replace(s, SPACE, ""), r"^([^,]*),", "$1.")
    fraction = F.when(part[2] == 0, float("nan")).otherwise(F.coalesce(part[0], F.lit(0.0)) + part[1] / F.when(part[2] == 0, 1.0).otherwise(part[2]))
    value = F.when(s.rlike(pattern), fraction).when(plain.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), plain.try_cast("double")).otherwise(F.lit(float("nan")))
    return from_unit(value, unit)


_UNIT = r"(cm\b|inch(?:es)?(?!\p{L})|[\"”″]|in\.|in(?!\p{L})(?!\s+(?![x×]\s*\d)\p{L}))"
_LABEL = rf"(?i)(\d+(?:[.,]\d+)?)\s*{_UNIT}?(?:\s*[x×]\s*(\d+(?:[.,]\d+)?)\s*{_UNIT}?)?"


def label_cm(text: Column | str) -> Column:
    """Side in cm of a square's label ("5 cm", ``2" x 2"``, "1 inch"): the first number with a unit counts; null if its sides differ."""
    t = _col(text)
    parts = [F.regexp_extract_all(t, F.lit(_LABEL), F.lit(k)) for k in (1, 2, 3, 4)]
    rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "abcd")))
    hit = F.element_at(F.filter(F.transform(rows, lambda r: F.struct(
        r["a"].alias("a"), F.when(r["d"] != "", r["d"]).otherwise(r["b"]).alias("unit"), F.when(r["c"] != "", r["c"]).otherwise(r["a"]).alias("b"))), lambda r: r["unit"] != ""), 1)
    a, b = (F.replace(hit[c], F.lit(","), F.lit(".")).cast("double") for c in ("a", "b"))
    factor = F.when(F.lower(hit["unit"]).startswith("c"), 1.0).otherwise(CM_PER_INCH)
    return F.when(F.size(F.filter(F.transform(rows, lambda r: F.concat(r["b"], r["d"])), lambda u: u != "")) > 0, F.when(F.abs(a - b) < 0.01, a * factor))


def size_tokens(value: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_col(value), F.lit("")), "[,;]"), trim), lambda t: t != "")


def is_shared(token: Column) -> Column:
    return F.lower(token).isin(*SHARED)


def size_role(value: Column | str) -> Column:
    """``named`` if the value lists a size of its own, ``shared`` if only words for all sizes, else ``none``."""
    t = size_tokens(value)
    return F.when(F.exists(t, lambda x: ~is_shared(x)), "named").when(F.size(t) > 0, "shared").otherwise("none")


def named_sizes(value: Column | str) -> Column:
    return F.filter(size_tokens(value), lambda t: ~is_shared(t))


def assigned_sizes(value: Column | str, named: Column | str) -> Column:
    """Sizes that one assignment stands for: words for all sizes become every named size, or the single one."""
    named = _col(named)
    every = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("uni")))
    return F.array_distinct(F.flatten(F.transform(size_tokens(value), lambda t: F.when(is_shared(t), every).otherwise(F.array(t)))))


def toggle_size(value: Column | str, size: Column | str, order: Column | str) -> Column:
    """The named sizes with one added or taken away, in the given order; unknown ones last, as they came."""
    now, size, order = named_sizes(value), _col(size), _col(order)
    after = F.when(F.array_contains(now, size), F.filter(now, lambda s: s != size)).otherwise(F.concat(now, F.array(size)))
    ranked = F.transform(after, lambda s, i: F.struct(F.when(F.array_position(order, s) > 0, F.array_position(order, s)).otherwise(F.size(order) + 1).alias("r"), i.alias("i"), s.alias("s")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda x: x["s"]), ", ")


def parse_size_name(text: Column | str) -> Column:
    """One size name with single spaces; null if it is empty, too long, a list or a word for all sizes."""
    name = F.regexp_replace(trim(text), rf"{SPACE}+", " ")
    bad = (name == "") | (F.char_length(name) > LONGEST_SIZE) | name.rlike("[,;]") | (size_role(name) == "shared")
    return F.when(~bad, name)


def size_key(size: Column) -> Column:
    """Sorts numbers by value, then letter sizes, then the rest by text with numbers by value."""
    s = trim(size)
    upper = F.upper(s)
    many = F.concat(F.repeat(F.lit("X"), F.regexp_extract(upper, r"^(\d)X[SL]$", 1).try_cast("int")), F.substring(upper, -1, 1))
    letter = F.array_position(F.array(*map(F.lit, LETTER_SIZES)), F.when(upper.rlike(r"^\dX[SL]$"), many).otherwise(upper))
    number = s.rlike(r"^\d+(?:[.,]\d+)?$")
    natural = F.array_join(F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"\d+|\D+"), F.lit(0)), lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t, 12, "0")).otherwise(t)), "")
    return F.struct(
        F.when(number, 0).when(letter > 0, 1).otherwise(2).alias("kind"),
        F.when(number, F.replace(s, F.lit(","), F.lit(".")).try_cast("double")).when(letter > 0, letter.cast("double")).otherwise(0.0).alias("value"), natural.alias("text"))


def sort_sizes(sizes: Column | str) -> Column:
    keyed = F.transform(_col(sizes), lambda s, i: F.struct(size_key(s).alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def slug_text(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()
    return re.sub(r"[^a-z0-9]+", "-", bare).strip("-")[:60].rstrip("-")


@F.pandas_udf(T.StringType())
def slug(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else slug_text(t))


def unique_ids(base: str = "base", key: str | None = None, order: str = "pos") -> Column:
    """Ids with ``-2``, ``-3`` from the second row of a base on; bases that end like such a suffix have to be distinct beforehand."""
    from pyspark.sql import Window

    own = Window.partitionBy(*([key] if key else []), base).orderBy(order)
    n = F.row_number().over(own)
    return F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string")))


# Words at a file name's end that aren't part of a pattern's name.
NOISE = r"(?i)(?:[\s_–-]+(?:a[0-4]|us[\s_-]*letter|letter|legal|st[řr]ih|schnittmuster|pattern|ebook|projector|copy[\s_-]*shop|print[\s_-]*at[\s_-]*home|print|copyshop))+$"


def pattern_name(title: Column | str, file_name: Column | str, fallback: str = "Pattern") -> Column:
    """The title unless it is empty or a program's file name, else the file name, without trailing noise."""
    t = trim(F.coalesce(_col(title), F.lit("")))
    usable = (t != "") & ~t.rlike(r"(?i)\.(?:docx?|indd|ai|pdf|psd|cdr|svg)$") & ~t.rlike(r"(?i)^(?:untitled|bez názvu)$")
    plain = trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(file_name), r"(?i)\.pdf$", ""), "[_-]+", " "), r"\s+", " "))
    name = F.when(usable, t).otherwise(plain)
    rest = trim(F.regexp_replace(F.concat(F.lit(" "), name), NOISE, ""))
    return F.when(rest != "", rest).when(name != "", name).otherwise(fallback)


def text_centre(x: Column, y: Column, angle: Column, height: Column, text: Column) -> Column:
    """Rough centre of a printed text: half of its length at half its height for each letter, along its angle in radians."""
    half = F.char_length(text) * height * 0.25
    return F.array(x + F.cos(angle) * half, y + F.sin(angle) * half)


def table_like(labels: Column | str) -> Column:
    """Three labels or more, most of them sizes or numbers only."""
    labels = _col(labels)
    sizes = F.filter(labels, lambda t: F.forall(F.filter(F.split(t, r"[\s,;/–-]+"), lambda w: w != ""), lambda w: w.rlike(SIZE_TOKEN)))
    return (F.size(labels) >= 3) & (F.size(sizes) > F.size(labels) / 2)
