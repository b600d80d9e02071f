"""Queries over whole tables, one for each operator or group of operators; oracles.py has SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import codes, text
from glyphmill.operators import arrowcodec, codec, curation, dictionary, evaluate, tokens, wikitext
from glyphmill.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SIZE = 20000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf}/documents.parquet"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(spark: SparkSession, sf: str, size: int = SIZE) -> DataFrame:
    return dictionary.build(dictionary.histogram(docs(spark, sf)), size)


# Tokens


@query
def tokens_exploded(spark, sf):
    return tokens.tokenize(docs(spark, sf), "doc_id")


@query
def token_type_counts(spark, sf):
    return tokens.tokenize(docs(spark, sf), "lang").groupBy("lang", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("token")).alias("characters"))


@query
def token_offsets(spark, sf):
    return tokens.with_offsets(tokens.tokenize(docs(spark, sf).repartition("doc_id"), "doc_id")).select("doc_id", "pos", "start", "end")


@query
def token_reconstruct(spark, sf):
    rebuilt = tokens.reconstruct(tokens.token_array(F.col("text")))
    return docs(spark, sf).select("doc_id", F.sha2(rebuilt, 256).alias("rebuilt_sha256"), (rebuilt == F.col("text")).alias("same"))


@query
def token_validate(spark, sf):
    """Tokens of each document, some with a planted fault, checked against the text."""
    t, first = F.col("text"), lambda x, **new: F.struct(*[new.get(n, x[n]).alias(n) for n in ("token", "start", "end")])
    faults = (lambda x: x, lambda x: first(x, token=F.lit("")), lambda x: first(x, start=F.lit(1)), lambda x: first(x, end=F.lit(0)), lambda x: first(x, token=F.concat(x["token"], F.lit("x"))))
    fault = F.pmod("doc_id", F.lit(7))
    rows = docs(spark, sf).select("text", fault.alias("fault"), tokens.placed(t).alias("tokens"))
    on_first = lambda make: F.transform("tokens", lambda x, i: F.when(i == 0, make(x)).otherwise(x))
    changed = F.col("tokens")
    for k, make in enumerate(faults):
        changed = F.when(F.col("fault") == k, on_first(make)).otherwise(changed)
    changed = F.when(F.col("fault") == 5, F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0)))).otherwise(changed)
    return rows.select("fault", F.coalesce(tokens.token_problem(t, changed), F.lit("OK")).alias("outcome")).groupBy("fault", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def word_histogram(spark, sf):
    return dictionary.histogram(docs(spark, sf))


@query
def char_class_counts(spark, sf):
    """Each distinct character is classified once, after it is counted."""
    chars = docs(spark, sf).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("c")
    return chars.groupBy(text.is_letter(c).alias("letter"), text.is_mark(c).alias("mark"), text.continues_word(c).alias("continues")).agg(F.count(F.lit(1)).alias("characters"), F.sum("n").alias("n"))


# Dictionary


@query
def dict_topn_20000(spark, sf):
    return words(spark, sf)


@query
def dict_validate(spark, sf):
    """A dictionary and six that break a rule each."""
    whole = dictionary.held(words(spark, sf))
    odd = F.col("ranking").isin(6, 7)
    broken = {
        "whole": whole, "empty": whole.where("ranking = 0"), "blank": whole.withColumn("word", F.when(F.col("ranking") == 5, "").otherwise(F.col("word"))),
        "repeated_word": whole.withColumn("word", F.when(odd, "same").otherwise(F.col("word"))), "repeated_token": whole.withColumn("token", F.when(odd, 541).otherwise(F.col("token"))),
        "gap": whole.where("ranking <> 7"), "shifted": whole.withColumn("token", F.col("token") + 1),
    }
    out = [dictionary.validate(rows).select(F.lit(name).alias("variant"), "size", F.coalesce("error", F.lit("OK")).alias("outcome")) for name, rows in broken.items()]
    return reduce(DataFrame.unionByName, out)


@query
def dict_summary(spark, sf):
    return dictionary.size_status(words(spark, sf), SIZE)


@query
def dict_lookup_left(spark, sf):
    counts = dictionary.histogram(table(spark, sf, "conversations"))
    return dictionary.lookup(counts, words(spark, sf)).select("word", "n", "token")


@query
def dict_contains_semi(spark, sf):
    return dictionary.lookup(dictionary.histogram(table(spark, sf, "conversations")), words(spark, sf), "left_semi")


@query
def dict_missing_anti(spark, sf):
    return dictionary.lookup(dictionary.histogram(table(spark, sf, "conversations")), words(spark, sf), "left_anti")


@query
def dict_require(spark, sf):
    known = words(spark, sf).select("word")
    return dictionary.require(known, words(spark, sf)).select("word", "token")


@query
def dict_index_duplicates(spark, sf):
    """Words that dictionaries of documents and of conversations both have, with both tokens."""
    both = words(spark, sf).select("word", "token").union(dictionary.build(dictionary.histogram(table(spark, sf, "conversations")), SIZE).select("word", "token"))
    return both.groupBy("word").agg(F.count(F.lit(1)).alias("times"), F.min("token").alias("low"), F.max("token").alias("high")).where("times > 1")


@query
def coverage_self_by_size(spark, sf):
    return dictionary.coverage_by_size(dictionary.histogram(docs(spark, sf)))


@query
def coverage_cross_by_lang(spark, sf):
    return dictionary.covered(dictionary.histogram(docs(spark, sf), "lang"), words(spark, sf), "lang")


@query
def coverage_of_conversations(spark, sf):
    return dictionary.covered(dictionary.histogram(table(spark, sf, "conversations"), "role"), words(spark, sf), "role")


@query
def coverage_rollup(spark, sf):
    return dictionary.coverage_rollup(dictionary.histogram(docs(spark, sf), "source"), words(spark, sf), "source")


@query
def rank_token_bijection(spark, sf):
    rows = words(spark, sf)
    return rows.select("ranking", codes.rank_to_token(F.col("ranking")).alias("token"), codes.token_to_rank(F.col("token")).alias("back"), F.hex(codes.code_bytes(F.col("token"))).alias("bytes"), codes.bytes_code(codes.code_bytes(F.col("token"))).alias("code"))


@query
def code_space(spark, sf):
    rows = spark.range(65537).select(F.col("id").cast("int").alias("code"))
    return rows.groupBy(codes.code_class(F.col("code")).alias("class"), F.coalesce(codes.is_future_control(F.col("code")), F.lit(False)).alias("future")).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("low"), F.max("code").alias("high"))


# Representation and encoding


@query
def case_modifier_counts(spark, sf):
    rows = tokens.tokenize(docs(spark, sf), "lang").where("type = 'WORD'").groupBy("lang", "token").agg(F.count(F.lit(1)).alias("k"))
    return rows.groupBy("lang", codec.case_modifier(F.col("token")).alias("modifier")).agg(F.sum("k").alias("n"))


@query
def direct_code_counts(spark, sf):
    rows = tokens.tokenize(docs(spark, sf)).where("type = 'CHARACTER'").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("token", "n", codes.direct_code(F.col("token")).alias("code"))


@query
def representation_counts(spark, sf):
    return codec.coded(docs(spark, sf), words(spark, sf), "doc_id", "lang").where("token is not null").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("modifier") != "NONE").alias("modified"))


@query
def implicit_space_counts(spark, sf):
    return codec.coded(docs(spark, sf), words(spark, sf), "doc_id").where("kind = 'IMPLICIT_SPACE'").groupBy("implicit").agg(F.count(F.lit(1)).alias("n"))


@query
def encode_stats_per_doc(spark, sf):
    return codec.statistics(docs(spark, sf), words(spark, sf))


@query
def compression_by_lang(spark, sf):
    return codec.totals(codec.statistics(docs(spark, sf), words(spark, sf), "doc_id", "lang"), "lang")


@query
def compression_by_source(spark, sf):
    return codec.totals(codec.statistics(docs(spark, sf), words(spark, sf), "doc_id", "source"), "source")


@query
def compression_by_dict_size(spark, sf):
    """Totals for the five sizes. The dictionaries are the beginnings of one ranking; a size is one pass, as spaces depend on which words are in."""
    ranked = dictionary.held(words(spark, sf, max(dictionary.SIZES)))
    out = [codec.totals(codec.statistics(docs(spark, sf), ranked.where(F.col("ranking") <= size))).withColumn("dictionary_size", F.lit(size)) for size in dictionary.SIZES]
    return reduce(DataFrame.unionByName, out)


@query
def byte_identity_check(spark, sf):
    """What encoded sizes hold besides counted items: constant over dictionary sizes."""
    stats = codec.statistics(docs(spark, sf), words(spark, sf))
    counted = 2 * (F.col("lexical_items") + F.col("direct_items") + F.col("modifier_items") + F.col("explicit_single_spaces")) + 4 * F.col("literal_items") + F.col("literal_payload_bytes")
    return stats.agg(F.sum(F.col("encoded_bytes") - counted).alias("residual"), F.sum(F.col("lexical_items") + F.col("literal_items")).alias("words"), F.sum(F.col("implicit_spaces") + F.col("explicit_single_spaces")).alias("spaces"))


@query
def encode_hex_per_doc(spark, sf):
    return arrowcodec.encode(docs(spark, sf), words(spark, sf)).select("doc_id", F.octet_length("encoded").alias("bytes"), F.sha2(F.hex("encoded"), 256).alias("hex_sha256"))


@query
def encode_hex_native(spark, sf):
    """encode_hex_per_doc by the codec of DataFrame functions alone."""
    return codec.encode(docs(spark, sf), words(spark, sf)).select("doc_id", F.octet_length("encoded").alias("bytes"), F.sha2(F.hex("encoded"), 256).alias("hex_sha256"))


@query
def decode_roundtrip(spark, sf):
    known = dictionary.held(words(spark, sf))
    return arrowcodec.decode(arrowcodec.encode(docs(spark, sf), known), known).select("doc_id", "text")


@query
def decode_roundtrip_native(spark, sf):
    """decode_roundtrip by the codec of DataFrame functions alone."""
    known = dictionary.held(words(spark, sf))
    return codec.decode(codec.encode(docs(spark, sf), known), known).select("doc_id", "text")


@query
def decode_stats(spark, sf):
    known = dictionary.held(words(spark, sf))
    return arrowcodec.decode(arrowcodec.encode(docs(spark, sf), known), known).drop("text").withColumn("error", F.coalesce("error", F.lit("OK")))


# Tails that break a stream, with what the decoder says of them; an empty one breaks nothing.
TAILS = {
    "": "OK", "02": "ODD_LENGTH", "0001": "LITERAL_END_OUTSIDE", "0002": "DANGLING_MODIFIER", "000200020218": "CONSECUTIVE_MODIFIERS", "00020000410001": "LITERAL_AFTER_MODIFIER", "0002002E": "MODIFIER_ON_DIRECT",
    "0004": "RESERVED_CONTROL", "0100": "RESERVED_EXTENSION", "0081": "UNASSIGNED_DIRECT", "FFFF": "UNKNOWN_TOKEN", "000041": "UNTERMINATED_LITERAL", "00004100": "TRUNCATED_ESCAPE", "00000002": "BAD_ESCAPE", "0000FF0001": "INVALID_UTF8",
}


@query
def decode_errors(spark, sf):
    """Each document's stream with one of the tails, decoded."""
    known = dictionary.held(words(spark, sf))
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.pmod("doc_id", F.lit(len(TAILS))) + 1).cast("int"))
    broken = arrowcodec.encode(docs(spark, sf), known).withColumn("encoded", F.concat("encoded", F.unhex(tail)))
    return arrowcodec.decode(broken, known).select("doc_id", F.coalesce("error", F.lit("OK")).alias("outcome"), F.sha2("text", 256).alias("text_sha256"))


@query
def collision_pairs(spark, sf):
    """Streams of several texts: of the codec, and of one that loses case, over documents and their upper-case copies."""
    rows = docs(spark, sf).select("doc_id", "text")
    both = rows.union(rows.select(-F.col("doc_id") - 1, F.upper("text"))).toDF("doc_id", "text")
    lossy = both.select("doc_id", F.encode(F.lower("text"), "UTF-8").alias("encoded"))
    found = [evaluate.collisions(e, both).select(F.lit(name).alias("codec"), "texts", "documents") for name, e in (("own", codec.encode(both, dictionary.held(words(spark, sf)))), ("lossy", lossy))]
    return found[0].unionByName(found[1]).groupBy("codec", "texts", "documents").agg(F.count(F.lit(1)).alias("streams"))


@query
def first_difference(spark, sf):
    """Where a document first differs from itself with a character replaced, cut off or added."""
    n, t = F.char_length("text"), F.col("text")
    at = F.pmod(F.col("doc_id") * 7919, F.greatest(n, F.lit(1))).cast("int")
    replaced = F.concat(F.left(t, at), F.lit("\u00b6"), F.substr(t, at + 2))
    other = F.when(F.pmod("doc_id", F.lit(4)) == 0, replaced).when(F.pmod("doc_id", F.lit(4)) == 1, F.left(t, at)).when(F.pmod("doc_id", F.lit(4)) == 2, F.concat(t, F.lit("+"))).otherwise(t)
    rows = docs(spark, sf).withColumn("other", other)
    d = text.first_difference(F.col("text"), F.col("other"))
    return rows.where(F.col("text") != F.col("other")).select("doc_id", d["index"].alias("index"), d["left"].alias("left"), d["right"].alias("right"))


# Evaluation


@query
def benchmark_report(spark, sf):
    known = dictionary.held(words(spark, sf))
    rows = evaluate.round_trip(docs(spark, sf), known, "doc_id", "lang")
    return evaluate.report(rows, known, "documents", F.col("lang"), "lang").drop("lang")


@query
def benchmark_upsert(spark, sf):
    """A report over languages put in place of a report over the two largest and one that stays."""
    new = codec.totals(codec.statistics(docs(spark, sf), words(spark, sf), "doc_id", "lang"), "lang").select(F.lit("documents").alias("dictionary"), F.lit(SIZE).alias("dictionary_size"), F.col("lang").alias("dataset"), "documents", "encoded_bytes")
    old = docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).select(F.lit("documents").alias("dictionary"), F.explode(F.array(F.lit(SIZE), F.lit(65000))).alias("dictionary_size"), F.col("lang").alias("dataset"), "documents", F.lit(0).cast("long").alias("encoded_bytes"))
    return evaluate.upsert(old, new)


@query
def result_classifier(spark, sf):
    """Results by language and source, with planted errors, exceptions and wrong statistics."""
    planted = lambda n, k: F.count_if(F.pmod("doc_id", F.lit(n)) == k)
    rows = docs(spark, sf).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("evaluated"), planted(97, 0).alias("errors"), planted(89, 1).alias("exceptions"), planted(23, 2).alias("statistics_errors"))
    return rows.select("lang", "source", "evaluated", evaluate.classifier(F.col("evaluated") - F.col("errors"), F.col("evaluated"), F.col("exceptions"), F.col("statistics_errors")).alias("result"))


@query
def manifest_validate(spark, sf):
    rows = docs(spark, sf).select((F.col("doc_id") + 1).alias("selection_order"), F.col("doc_id").alias("page_id"), F.lit("2024-01-01").alias("snapshot_date"), F.col("lang").alias("segment"), F.lit(" ").alias("evaluation_role"))
    return curation.manifest_problems(rows)


@query
def top10_failures(spark, sf):
    """The first ten documents with duplicates, as a report shows failures."""
    rows = docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(copies, "digest").orderBy("doc_id").limit(10).select("doc_id", "copies")


# Curation


def files(spark, sf):
    rows = docs(spark, sf)
    return rows.select(F.format_string("%s/%s_%d.PDF", "source", "lang", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"), "lang", "doc_id")


@query
def sha_dedup_exact(spark, sf):
    return curation.deduplicate(files(spark, sf), "path", F.sha2("content", 256), "BINARY_DUPLICATE").select("path", "duplicate_of", "status")


@query
def normalized_text_dedup(spark, sf):
    rows = curation.dataset_manifest(files(spark, sf), "path", "content", F.decode("content", "UTF-8"))
    return rows.select("path", "status", "duplicate_of", "binary_sha256", "text_sha256")


@query
def duplicate_of(spark, sf):
    rows = curation.deduplicate(files(spark, sf), "path", F.sha2("content", 256), "BINARY_DUPLICATE")
    return rows.where("duplicate_of is not null").groupBy("duplicate_of").agg(F.count(F.lit(1)).alias("copies"))


@query
def digest_groups(spark, sf):
    rows = files(spark, sf).withColumn("digest", text.raw_sha256(F.decode("content", "UTF-8")))
    return curation.group_by_digest(rows, "digest", "path").select("digest", "copies", "path")


@query
def manifest_status_counts(spark, sf):
    return curation.status_counts(curation.dataset_manifest(files(spark, sf), "path", "content", F.decode("content", "UTF-8")))


def works(spark, sf):
    rows = docs(spark, sf)
    return rows.select("doc_id", F.format_string("x/%s %s %da ed parte %d.pdf", "lang", "source", F.pmod("doc_id", F.lit(7)) + 1, F.pmod("doc_id", F.lit(3))).alias("path"), F.when(F.col("n_chars") > 500, "EXTRACTED").otherwise("NO_TEXT").alias("status"), "lang")


@query
def family_groups_having(spark, sf):
    return curation.families(works(spark, sf), "path").select("family_key", "copies", "path")


@query
def selection_sequence(spark, sf):
    out = curation.selection(works(spark, sf), "doc_id", "path", F.lit("corpus"), excluded=(4, 6, 8, 46, 47))
    return out.select("candidate_order", "work_id", "path", "selected", "selection_reason", "notes")


@query
def numbered_with_gaps(spark, sf):
    """Candidates by an order that has ties and nulls: they are numbered from 1 without a gap, nulls last."""
    rows = docs(spark, sf).select("doc_id", F.when(F.pmod("doc_id", F.lit(10)) > 0, F.floor(F.col("n_chars") / 100)).alias("order"))
    out = curation.numbered(rows, "order")
    return out.groupBy("order").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("rows"))


@query
def name_templates(spark, sf):
    rows, n = docs(spark, sf), F.col("doc_id")
    title = F.concat_ws(" ", "lang", "source", F.col("doc_id").cast("string"))
    return rows.select(
        "doc_id", text.article_identifier(F.col("lang"), n).alias("identifier"), text.dataset_name(F.col("lang"), F.lit("20240101"), F.col("source"), n, n + 5).alias("dataset"),
        text.text_file_name(n, F.sha2("text", 256)).alias("file"), text.article_url("https://wiki.example/", title).alias("url"),
    )


@query
def work_identifiers(spark, sf):
    return works(spark, sf).select("doc_id", text.identifier(text.base_name(F.col("path"))).alias("identifier"), text.work_id(F.col("lang"), F.col("doc_id"), F.col("path")).alias("work_id"))


@query
def selection_resume_anti(spark, sf):
    return curation.pending(docs(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query
def exclusion_except(spark, sf):
    excluded = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return curation.invalid_exclusions(works(spark, sf), "doc_id", excluded)


@query
def skip_take_sample(spark, sf):
    return curation.skip_take(docs(spark, sf).select("doc_id", "n_chars"), 100, 50, "doc_id")


def articles(spark, sf):
    rows = docs(spark, sf)
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.when(F.pmod("doc_id", F.lit(11)) == 0, "1").otherwise("0").alias("ns"), (F.pmod("doc_id", F.lit(13)) == 0).alias("redirect"), F.when(F.pmod("doc_id", F.lit(17)) == 0, "").otherwise(F.col("text")).alias("wikitext"))


@query
def funnel_counts(spark, sf):
    return curation.funnel(curation.article_stage(articles(spark, sf)))


# Markup


def markup(spark, sf):
    """Each document's whole text in markup."""
    body = F.concat(F.lit("== "), "lang", F.lit(" ==\r\n* '''"), F.col("text"), F.lit("''' <!-- note -->\n{| a\n| b {| c |} |}\n  # tail<ref name=\"x\">y</ref> <math>z</math>   end  \n\n\n\n: last"))
    return docs(spark, sf).select("doc_id", body.alias("text"))


@query
def postprocess_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(wikitext.postprocessed(F.concat(F.lit("== H ==\n* "), "text")), 256).alias("text_sha256"))


@query
def comments_and_tags(spark, sf):
    return markup(spark, sf).select("doc_id", wikitext.without_tags(wikitext.without_comments(F.col("text"))).alias("text"))


@query
def clean_ratio(spark, sf):
    return markup(spark, sf).select("doc_id", wikitext.clean(F.col("text")).alias("c")).select("doc_id", "c.original_characters", "c.cleaned_characters", "c.removed_characters", F.sha2("c.text", 256).alias("text_sha256"))


@query
def table_strip(spark, sf):
    """Each text inside nested tables, after one that is not closed, or beside a stray end."""
    k, t = F.pmod("doc_id", F.lit(3)), F.col("text")
    body = F.when(k == 0, F.concat(F.lit("a{| "), t, F.lit(" {| "), "lang", F.lit(" |} |}b"))).when(k == 1, F.concat(F.lit("{| "), t)).otherwise(F.concat(t, F.lit(" |} z")))
    return docs(spark, sf).select("doc_id", F.sha2(wikitext.tables_stripped(body), 256).alias("text_sha256"))


#: Templates, and what each leaves behind.
TEMPLATES = {"lang|la|agri": "agri", "Siglo|XX": "siglo XX", "unidad|3|km": "3 km", "Ficha de x|a=b": "", "cita web|u": "", "sfn|a": "", "x|k=v": "v", "x|a|b": "", "x|{{lang|la|uno}}": "uno"}
#: Links, and what each leaves behind.
LINKS = {"[[A|b c]]": "b c", "[[A#s]]": "A", "[[File:x.png|thumb]]": "", "[http://a.b t u]": "t u", "[//a.b]": "", "[[a|[[b|c]]]]": "c", "[[1|[[2|[[3|[[4|[[5|[[6|[[7|x]]]]]]]]]]]]]]": "x"}


def planted(spark, sf, values):
    """Each whole text with one of the values after it."""
    value = F.element_at(F.array(*map(F.lit, values)), (F.pmod("doc_id", F.lit(len(values))) + 1).cast("int"))
    return docs(spark, sf).select("doc_id", F.concat(F.col("text"), F.lit(" "), value, F.lit(" end")).alias("text"))


@query
def template_rules(spark, sf):
    return planted(spark, sf, [f"{{{{{x}}}}}" for x in TEMPLATES]).select("doc_id", F.sha2(wikitext.templates_resolved(F.col("text")), 256).alias("text_sha256"))


@query
def link_rewrite(spark, sf):
    return planted(spark, sf, LINKS).select("doc_id", F.sha2(wikitext.links_resolved(F.col("text")), 256).alias("text_sha256"))


@query
def page_comments(spark, sf):
    cleaned = wikitext.without_comments(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.char_length("html").alias("characters"), F.char_length(cleaned).alias("kept"))


# Scalar renderings


@query
def renderings(spark, sf):
    """Renderings of whole texts, the long ones by digest."""
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", F.sha2(text.visible(t), 256).alias("visible_sha256"), F.sha2(text.spaced_hex(F.encode(t, "UTF-8")), 256).alias("hex_sha256"), text.elapsed(F.col("n_chars")).alias("elapsed"),
        F.char_length("text").alias("characters"), F.octet_length("text").alias("bytes"), F.round(text.percent(F.char_length("text"), F.octet_length("text")), 6).alias("share"),
    )


@query
def token_descriptions(spark, sf):
    rows = codec.represent(tokens.tokenize(docs(spark, sf), "doc_id"), words(spark, sf)).where("type = 'WORD'")
    return evaluate.described(rows).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


# Sources and sinks: written to the shared folder and read back


@query
def dictionary_file(spark, sf):
    at = writers.scratch(spark, "dictionary")
    writers.dictionary(words(spark, sf), at)
    return readers.dictionary(spark, at)


@query
def dump_file(spark, sf):
    """Documents as pages of an XML dump; texts in base64, as XML can't hold all characters."""
    at = writers.scratch(spark, "dump")
    writers.dump(articles(spark, sf).withColumns({"title": F.concat(F.lit("Page <"), "id", F.lit("> & \u00fc")), "wikitext": F.base64(F.encode("wikitext", "UTF-8"))}), at)
    return readers.dump(spark, at).select("id", "title", "ns", "redirect", F.sha2(F.unbase64("wikitext"), 256).alias("text_sha256"))


@query
def json_manifest_file(spark, sf):
    at = writers.scratch(spark, "manifest")
    rows = docs(spark, sf).select((F.col("doc_id") + 1).cast("int").alias("selection_order"), F.col("doc_id").cast("string").alias("page_id"), F.col("text").alias("title"), F.col("n_chars").cast("int").alias("cleaned_characters"), (F.col("n_chars") / 7).alias("reduction_ratio"))
    writers.json_manifest(rows, at)
    return readers.json_manifest(spark, at).select("selection_order", "page_id", F.sha2("title", 256).alias("title_sha256"), "cleaned_characters", F.round("reduction_ratio", 6).alias("reduction_ratio"), "segment")


def manifest(spark, sf):
    rows = curation.dataset_manifest(files(spark, sf), "path", "content", F.decode("content", "UTF-8"))
    return curation.manifest_rows(rows, F.lit("corpus"), "path", F.lit(0).cast("long")).withColumn("CandidateOrder", F.regexp_extract("RelativePath", r"_(\d+)\.PDF$", 1).cast("long"))


@query
def manifest_file(spark, sf):
    """The dedup manifest in its ten columns, through a CSV file."""
    at = writers.scratch(spark, "manifest")
    writers.csv(manifest(spark, sf).drop("CandidateOrder"), at)
    return readers.headed(spark, at)


@query
def extraction_manifest_file(spark, sf):
    """Rows of the manifest file that were extracted, in order of candidates."""
    at = writers.scratch(spark, "manifest")
    writers.csv(manifest(spark, sf), at)
    return readers.extraction_manifest(spark, at).select("CandidateOrder", "RelativePath", "TextSHA256")


@query
def selection_file(spark, sf):
    """The selection in its twelve columns, through a CSV file; those that are selected."""
    at = writers.scratch(spark, "selection")
    writers.csv(curation.selection_rows(manifest(spark, sf).withColumnRenamed("CandidateOrder", "place"), "place", excluded=(4, 6, 8, 46, 47)), at)
    return readers.selected(spark, at)


@query
def checkpoint_file(spark, sf):
    """A manifest of a run that was resumed: each document failed before it was extracted, and some rows are broken."""
    at = writers.scratch(spark, "checkpoint")
    rows = docs(spark, sf).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    rows = rows.orderBy("turn", "doc_id").select(F.when((F.col("turn") == 0) & (F.pmod("doc_id", F.lit(5)) == 0), "none").otherwise(F.col("doc_id").cast("string")).alias("CandidateOrder"), F.when(F.col("turn") == 0, "ERROR").otherwise("EXTRACTED").alias("ExtractionStatus"))
    writers.csv(rows.coalesce(1), at)
    return readers.checkpoint(spark, at)


@query
def text_files(spark, sf):
    """Whole files, with line ends as they are and as LF, and their bytes."""
    at = writers.scratch(spark, "texts")
    table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("\r\n\u00e9"), F.col("n_nationkey").cast("string"), F.lit("\rx")).alias("value")).write.partitionBy("n_nationkey").option("lineSep", "\n").text(at)
    key = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey")
    raw = readers.raw_texts(spark, at).select(key, "bytes", F.hex(F.encode("text", "UTF-8")).alias("raw"))
    return raw.join(readers.texts(spark, at).select(key, F.hex(F.encode("text", "UTF-8")).alias("lf")), "n_nationkey")


@query
def text_status(spark, sf):
    """Manifest rows held against files: some aren't there, some have another size."""
    listed = docs(spark, sf).select(F.format_string("t/%d.txt", "doc_id").alias("local_path"), (F.octet_length("text") + F.when(F.pmod("doc_id", F.lit(9)) == 1, 1).otherwise(0)).alias("size"), "doc_id")
    found = docs(spark, sf).where(F.pmod("doc_id", F.lit(11)) > 0).select(F.format_string("t/%d.txt", "doc_id").alias("path"), F.octet_length("text").alias("bytes"), "text")
    return readers.checked_texts(listed, found, "local_path", "size").select("doc_id", "status", F.sha2("text", 256).alias("text_sha256"))


@query
def file_manifest_check(spark, sf):
    """Manifests held against a listing: as it is, and with a missing file, a blank digest and an order that is there twice."""
    rows = files(spark, sf).select("doc_id", "path", F.sha2("content", 256).alias("sha"))
    n = docs(spark, sf).count()
    cases = {
        "whole": (rows, rows), "file": (rows, rows.where("doc_id <> 3")), "digest": (rows.withColumn("sha", F.when(F.col("doc_id") == 4, " ").otherwise(F.col("sha"))), rows),
        "order": (rows.withColumn("doc_id", F.when(F.col("doc_id") == 5, 6).otherwise(F.col("doc_id"))), rows), "count": (rows.where("doc_id <> 7"), rows),
    }
    out = [curation.file_problems(m, listing, "doc_id", "path", "sha", n).withColumn("variant", F.lit(name)) for name, (m, listing) in cases.items()]
    return reduce(DataFrame.unionByName, out)


@query
def stored_texts(spark, sf):
    at = writers.scratch(spark, "texts")
    writers.texts(docs(spark, sf), at, "doc_id")
    return spark.read.parquet(at).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query
def upsert_file(spark, sf):
    """A benchmark file with the rows of some languages replaced and the rest kept."""
    old, new = writers.scratch(spark, "results"), writers.scratch(spark, "results")
    rows = docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).select(F.lit("documents").alias("dictionary"), F.explode(F.array(F.lit(SIZE), F.lit(65000))).alias("dictionary_size"), F.col("lang").alias("dataset"), "documents")
    status = writers.upsert_csv(spark, rows, None, old)
    again = writers.upsert_csv(spark, rows.where((F.col("dictionary_size") == SIZE) & (F.col("dataset") > "en")).withColumn("documents", -F.col("documents")), old, new)
    return readers.headed(spark, new).withColumn("status", F.lit(f"{status} {again}"))
