"""Text functions: Unicode classes, normal forms, names and small renderings."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a regex class body; narrower classes like \s miss some of it.
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A letter with letters and marks after it.
WORD = r"\p{L}[\p{L}\p{M}]*"
#: A word, a run of white space, or one other character.
TOKEN = rf"{WORD}|[{WS}]+|[\s\S]"


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), where value is worked out once, however often make uses it."""
    return F.transform(F.array(value), make)[0]


def is_letter(char: Column) -> Column:
    return char.rlike(r"^\p{L}$")


def is_mark(char: Column) -> Column:
    return char.rlike(r"^\p{M}$")


def continues_word(char: Column) -> Column:
    return char.rlike(r"^[\p{L}\p{M}]$")


def strip(text: Column) -> Column:
    """text without Unicode white space at either end."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normal_form(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD, by an Arrow UDF: Spark has no built-in."""

    @F.pandas_udf("string")
    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    other = text.rlike(r"[^\x00-\x7F]")  # ASCII is in every normal form: Python gets nulls for it
    return F.when(other, normalize(F.when(other, text))).otherwise(text)


def duplicate_form(text: Column) -> Column:
    """NFC with Unix newlines, runs of blanks and of newlines cut to one, stripped: equal for near-identical layouts."""
    out = unix_newlines(normal_form(text, "NFC"))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n+", "\n"))


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(duplicate_form(text), "UTF-8"), 256)


def raw_sha256(text: Column) -> Column:
    """Upper-case hex, of the text as it is."""
    return F.upper(F.sha2(F.encode(text, "UTF-8"), 256))


def plain_name(name: Column, gap: str) -> Column:
    """A file name in upper-case ASCII letters and digits, others replaced by gap, without marks and .PDF."""
    out = F.upper(F.regexp_replace(normal_form(name, "NFKD"), r"\p{M}", ""))
    out = F.regexp_replace(F.regexp_replace(out, r"\.PDF$", ""), "[^A-Z0-9]+", gap)
    return F.regexp_replace(out, rf"^(?:{gap})+|(?:{gap})+$", "")


def identifier(name: Column) -> Column:
    return plain_name(name, "_")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


# Edition and part markers, and words that don't tell works apart.
MARKERS = (r"\b\d+\s*(?:A|RA|TA|NA|VA)?\s*EDICION\b", r"\b\d+\s*ED\b", r"\bPARTE\s*\d+\b", r"\bPART\s*\d+\b", r"\bPART_\d+\b", r"\bPTE\s*\d+\b", r"\b\d+A\b", r"\b\d+VA\b", r"\b\d+RA\b", r"\b\d+TA\b", r"\b\d+NA\b")
STOP_WORDS = ("PDF", "ED", "EDICION", "EDICIÓN", "ILUSTRADA", "MEDICA")
# End of the fixed values.


def without_markers(name: Column) -> Column:
    for pattern in MARKERS:
        name = F.regexp_replace(name, f"(?i){pattern}", " ")
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def family_key(path: Column, words: int = 6) -> Column:
    """The first words of a file's name that tell its work from others."""
    found = F.filter(F.split(without_markers(plain_name(base_name(path), " ")), " "), lambda w: ~w.isin(*STOP_WORDS) & (w != ""))
    return F.array_join(F.slice(found, 1, words), " ")


def work_id(specialty: Column, sequence: Column, path: Column) -> Column:
    return F.format_string("%s_%03d_%s", F.upper(specialty), sequence, F.substring(identifier(base_name(path)), 1, 60))


def article_url(base: str, title: Column) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


# Name templates.
ARTICLE, DATASET, TEXT_FILE = "%s:%s", "%s_%s_%s_skip%d_count%d", "%04d_%s.txt"
# End of the fixed values.


def article_identifier(source: Column, page_id: Column) -> Column:
    return F.format_string(ARTICLE, source, page_id)


def dataset_name(source: Column, date: Column, segment: Column, skip: Column, count: Column) -> Column:
    return F.format_string(DATASET, source, date, segment, skip, count)


def text_file_name(order: Column, sha256: Column) -> Column:
    """The file of a text in an extraction: its order and the first 16 digits of its digest."""
    return F.format_string(TEXT_FILE, order, F.left(sha256, F.lit(16)))


def visible(text: Column, backslash: bool = False) -> Column:
    """Control white space as escapes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\")) if backslash else text
    for char, shown in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(char), F.lit(shown))
    return out


def spaced_hex(data: Column, width: int = 1) -> Column:
    """Upper-case hex in groups of `width` bytes."""
    return F.regexp_replace(F.hex(data), rf"(.{{{2 * width}}})(?!$)", "$1 ")


def elapsed(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def first_difference(left: Column, right: Column) -> Column:
    """index, left and right character where two texts first differ (a missing character is null); null if they don't."""
    # the longest equal beginning, by halves: `low` characters are equal, `high` are not
    start = F.struct(F.lit(0).alias("low"), (F.greatest(F.char_length(left), F.char_length(right))).alias("high"))

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        same = F.left(left, middle) == F.left(right, middle)
        return F.when(s["high"] - s["low"] <= 1, s).otherwise(F.struct(F.when(same, middle).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(middle).alias("high")))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, half)["high"]
    char = lambda s: F.nullif(F.substring(s, at, F.lit(1)), F.lit(""))
    return F.when(left != right, F.struct((at - 1).alias("index"), char(left).alias("left"), char(right).alias("right")))
