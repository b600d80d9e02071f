"""Tokens of texts: words, white space and single characters, with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import TOKEN, WORD, WS, let


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_type(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{L}"), "WORD").when(token.rlike(rf"^[{WS}]"), "WHITESPACE").when(token != "", "CHARACTER")


def tokenize(docs: DataFrame, *keys: str, outer: bool = False) -> DataFrame:
    """A row a token: keys, pos (from 0), token, type. With outer, a text without tokens keeps a row of nulls."""
    each = (F.posexplode_outer if outer else F.posexplode)(token_array(F.col("text"))).alias("pos", "token")
    return docs.select(*keys, each).withColumn("type", token_type(F.col("token")))


def with_offsets(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """tokens with start and end (exclusive), in characters."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.char_length("token")).over(before)
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("token"))


def reconstruct(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def validation(text: Column) -> Column:
    """Null if a text's tokens cover it without gap and give it back, else what is wrong."""
    tokens = token_array(text)
    covered = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.char_length(t))
    return F.when(F.exists(tokens, lambda t: t == ""), "EMPTY_TOKEN").when(covered != F.char_length(text), "COVERAGE").when(reconstruct(tokens) != text, "RECONSTRUCTION")


def token_problem(text: Column, tokens: Column) -> Column:
    """Null if tokens (an array of token, start and end) are a text's tokens one after the other, else what is wrong first.

    EMPTY_TOKEN, GAP (it doesn't begin where the one before it ends), RANGE, CONTENT, COVERAGE (what is left of the text) or
    RECONSTRUCTION; null too for a null text. Time grows with the text: tokens are compared with it joined, not cut out of it
    one at a time. Where lengths fit and what comes before the first problem isn't the text's beginning, one of those tokens
    has another content.
    """
    none = F.lit(0)

    def problem(p: Column, n: Column, x: Column, i: Column) -> Column:
        there = F.least(x["end"], n) - F.least(x["start"], n)  # of the text
        return (
            F.when(F.coalesce(x["token"], F.lit("")) == "", "EMPTY_TOKEN").when(~x["start"].eqNullSafe(F.coalesce(F.get(p, i - 1)["end"], none)), "GAP").when(F.coalesce(x["end"], none) <= x["start"], "RANGE")
            .when(F.char_length(x["token"]) != there, "CONTENT").otherwise("")
        )

    def found(p: Column, n: Column, errors: Column, sound: Column) -> Column:
        """sound: how many tokens there are before the first problem."""
        at = F.coalesce(F.get(p, sound - 1)["end"], none)
        joined = F.array_join(F.transform(F.slice(p, F.lit(1), sound), lambda x: x["token"]), "")
        return let(joined, lambda j: F.when(j != F.left(text, at), "CONTENT").when(sound < F.size(p), F.get(errors, sound)).when(at != n, "COVERAGE").when(j != text, "RECONSTRUCTION"))

    before = lambda p, errors: let(F.array_position(F.transform(errors, lambda e: e != ""), True), lambda k: F.when(k > 0, k - 1).otherwise(F.size(p)).cast("int"))
    checked = lambda p, n: let(F.transform(p, lambda x, i: problem(p, n, x, i)), lambda errors: let(before(p, errors), lambda sound: found(p, n, errors, sound)))
    return F.when(text.isNotNull() & tokens.isNotNull(), let(tokens, lambda p: let(F.char_length(text), lambda n: checked(p, n))))


#: Numbers that are summed up in one go; what is left of a thousand times a thousand of them is short.
BLOCK, LEVELS = 32, 3


def summed(lengths: Column, start: Column, levels: int = LEVELS) -> Column:
    """Sums of an array up to each place, from start on; one more than there are numbers.

    Sums are appended to a copy, so they are made in blocks, from the sums of all blocks before: time grows with the array.
    """
    if levels == 0:
        return F.aggregate(lengths, F.array(start), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / BLOCK).cast("int"), F.lit(0))), lambda k: F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK)))
    totals = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    inside = lambda sums, b, k: let(summed(b, F.get(sums, k), 0), lambda s: F.slice(s, F.lit(1), F.size(b)))
    return let(each, lambda blocks: let(summed(totals(blocks), start, levels - 1), lambda sums: F.concat(F.flatten(F.transform(blocks, lambda b, k: inside(sums, b, k))), F.array(F.element_at(sums, -1)))))


def placed(text: Column) -> Column:
    """The tokens of a text as an array of token, start and end."""
    sums = lambda tokens: let(F.transform(tokens, F.char_length), lambda lengths: summed(lengths, F.lit(0)))
    rows = lambda tokens: let(sums(tokens), lambda s: F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.get(s, i).alias("start"), F.get(s, i + 1).alias("end"))))
    return F.when(text.isNotNull(), let(token_array(text), rows))


def words(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and word: every word in lower case."""
    return docs.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token")).select(*keys, F.lower("token").alias("word"))
