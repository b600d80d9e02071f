"""Markup to plain text: tables, comments, tags, templates, links and layout.

Parts that regular expressions can state are column functions; the nested grammar of templates and links is an Arrow UDF
around one scanner. No parity with any markup library's own rendering is claimed beyond the rules stated here.
"""

from __future__ import annotations

import html
import itertools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphmill.functions.text import WS

# Names that the rules treat alike.
REMOVED_TAGS = ("ref", "references", "gallery", "math", "source", "syntaxhighlight", "timeline", "imagemap", "score", "mapframe", "maplink")
AUXILIARY = (
    "rp", "refn", "harvnp", "harvtxt", "sfn", "sfnp", "sfnref", "listaref", "referencias", "control de autoridades", "commonscat", "commons category", "portal", "portal asociado",
    "otros usos", "otro uso", "redirige aquí", "redirige aqui", "distinguir", "desambiguación", "desambiguacion", "wikcionario", "wikisource", "wikiquote", "wikilibros", "wikiviajes",
)
LAST_VALUE = ("lang", "lang-es", "lang-en", "lang-la", "nombre original", "transl", "transliteration")
JOINED = ("ipa", "afi", "unidad", "convertir", "formatnum", "esd", "fecha", "fecha de inicio", "fecha de fin")
CENTURY = ("siglo", "siglo2")
DROPPED_PREFIXES = ("ficha", "infobox", "cita ", "cita_", "cite ", "cite_")
MEDIA_PREFIXES = ("archivo:", "file:", "imagen:", "image:", "categoría:", "categoria:", "category:")
PASSES = 5
# End of the fixed values.


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def without_tags(text: Column, tags: tuple[str, ...] = REMOVED_TAGS) -> Column:
    """text without these elements, closed or self-closing."""
    for tag in tags:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^<>]*/>|<{tag}\b[^<>]*>.*?</{tag}\s*>", "")
    return text


def postprocessed(text: Column) -> Column:
    """Left-over link brackets and quotes, bullets, headings and layout tidied; no blank lines."""
    for pattern, new in (
        (r"\r\n?", "\n"), (r"\[\[|\]\]", " "), (r"'{2,5}", ""), (rf"(?md)^[{WS}]*[*#:;]+[{WS}]*", ""), (rf"(?md)^[{WS}]*={{2,6}}[{WS}]*", ""),
        (rf"(?md)[{WS}]*={{2,6}}[{WS}]*$", ""), (r"[ \t]+", " "),
    ):
        text = F.regexp_replace(text, pattern, new)
    lines = F.transform(F.split(text, r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85  ]"), lambda x: F.regexp_replace(x, rf"^[{WS}]+|[{WS}]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def without_tables(text: str) -> str:
    """text with each outermost {| ... |} as a line end; as it was if they don't balance."""
    out, depth = [], 0
    for piece in re.findall(r"\{\||\|\}|[^{|]+|[\s\S]", text):
        if piece == "{|":
            depth += 1
        elif piece == "|}" and depth:
            depth -= 1
            out.append("\n" if not depth else "")
        elif not depth:
            out.append(piece)
    return text if depth else "".join(out)


def template_text(inside: str) -> str:
    """What a template (without its braces) leaves behind."""
    name, *parameters = inside.split("|")
    name = name.strip().lower()
    values = [v for v in ((p.split("=", 1)[-1]).strip() for p in parameters) if v]
    if name in AUXILIARY or name.startswith(DROPPED_PREFIXES):
        return ""
    if name in LAST_VALUE:
        return values[-1] if values else ""
    if name in CENTURY:
        return f"siglo {values[0]}" if values else ""
    if name in JOINED:
        return " ".join(values)
    return values[0] if len(values) == 1 else ""


def link_text(inside: str) -> str:
    """What a link (without its brackets) leaves behind: its label, else its title before any #."""
    title, bar, label = inside.partition("|")
    if title.strip().lower().startswith(MEDIA_PREFIXES):
        return ""
    return label.strip() if bar and label else title.split("#", 1)[0].strip()


def innermost(text: str, opening: str, closing: str, make, passes: int | None = None) -> str:
    """text with innermost pairs replaced, `passes` times or until there are none; each pass leaves fewer."""
    o, c = re.escape(opening), re.escape(closing)
    pattern = re.compile(rf"{o}((?:(?!{o}|{c})[\s\S])*){c}")
    for _ in itertools.count() if passes is None else range(passes):
        text, found = pattern.subn(lambda m: make(m[1]), text)
        if not found:
            break
    return text


def external_links(text: str) -> str:
    return re.sub(r"\[(?:https?:|ftp:)?//[^\s\]]+(?:\s+([^\]]*))?\]", lambda m: (m[1] or "").strip(), text)


def plain(text: str) -> str:
    """Templates, links and emphasis resolved, entities decoded."""
    text = innermost(text, "{{", "}}", template_text, PASSES)
    text = innermost(text, "[[", "]]", link_text)
    text = external_links(text)
    return html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", text))


@F.pandas_udf(StringType())
def _tables(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else without_tables(t))


def plain_or_same(text: str) -> str:
    """plain(), or the text as it was where that fails on it."""
    try:
        return plain(text)
    except (RecursionError, ValueError, re.error):
        return text


@F.pandas_udf(StringType())
def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else plain_or_same(t))


def tables_stripped(text: Column) -> Column:
    return _tables(text)


def templates_resolved(text: Column) -> Column:
    return _templates(text)


def links_resolved(text: Column) -> Column:
    """Wikilinks, then external links, by their labels."""
    return _links(text)


@F.pandas_udf(StringType())
def _templates(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else innermost(t, "{{", "}}", template_text, PASSES))


@F.pandas_udf(StringType())
def _links(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else external_links(innermost(t, "[[", "]]", link_text)))


def clean(text: Column) -> Column:
    """struct: original_characters, cleaned_characters, removed_characters, reduction_ratio and text."""
    tidy = postprocessed(_plain(without_tags(without_comments(_tables(text)))))
    before, after = F.char_length(text), F.char_length(tidy)
    removed = F.greatest(F.lit(0), before - after)
    ratio = F.when(before == 0, 0.0).otherwise(removed / before)
    return F.struct(before.alias("original_characters"), after.alias("cleaned_characters"), removed.alias("removed_characters"), ratio.alias("reduction_ratio"), tidy.alias("text"))
