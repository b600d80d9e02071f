"""DuckDB SQL for the results of queries.py, written against the rules and not the plans."""

from __future__ import annotations

from glyphmill.functions.codes import SINGLE_LETTERS, TYPOGRAPHY
from glyphmill.functions.text import TOKEN, WS
from glyphmill.operators.dictionary import SIZES

LETTERS = ", ".join(f"'{c}'" for c in SINGLE_LETTERS)
TYPES = r"case when regexp_matches(token, '^\p{L}') then 'WORD' when regexp_matches(token, '^[" + WS + r"]') then 'WHITESPACE' else 'CHARACTER' end"


def toks(table: str = "documents", keys: str = "doc_id, lang, source", name: str = "t") -> str:
    return f"{name}0 as (select {keys}, regexp_extract_all(text, '{TOKEN}') as a from {table}), {name} as (select *, {TYPES} as type from (select {keys}, unnest(a) as token, unnest(generate_series(0, len(a) - 1)) as pos from {name}0))"


def hist(table: str = "documents", keys: str = "", name: str = "h", tokens: str = "t") -> str:
    cols = f"{keys}, " if keys else ""
    return f"{name} as (select {cols}lower(token) as word, count(*) as n from {tokens} where type = 'WORD' and lower(token) not in ({LETTERS}) group by all)"


def top(size: int = 20000, name: str = "d", source: str = "h") -> str:
    return f"{name} as (select row_number() over (order by n desc, word) as ranking, word, n as frequency from (select * from {source} order by n desc, word limit {size})), {name}t as (select ranking, ranking + 535 as token, word, frequency from {name})"


BASE = f"with {toks()}, {hist()}, {top()}"
CONV = f"{BASE}, {toks('conversations', 'role', 'c')}, {hist(name='hc', tokens='c')}"
MODIFIER = "case when token = lower(token) then 'NONE' when token = upper(token) then 'UPPERCASE' when substr(token, 1, 1) = upper(substr(token, 1, 1)) and substr(token, 2) = lower(substr(token, 2)) then 'CAPITALIZED' else 'NONE' end"
POINTS = " ".join(f"when '{c}' then {k}" for k, c in TYPOGRAPHY.items())
DIRECT = f"case when unicode(token) < 128 or unicode(token) between 160 and 255 then unicode(token) else case token {POINTS} end end"
BLANKS = r"[ \t\n\r]"


def coded(d: str = "dt", name: str = "e") -> str:
    """Token rows with kind, code, mod, implicit and what they add, against dictionary d."""
    return rf"""
{name}1 as (select t.*, case when type = 'WORD' then {MODIFIER} else 'NONE' end as m from t),
{name}2 as (select *, case when type = 'WORD' then case when m = 'NONE' and token <> lower(token) then token else lower(token) end end as w from {name}1),
{name}3 as (select {name}2.*, {d}.token as lex, case m when 'UPPERCASE' then upper(w) when 'CAPITALIZED' then upper(substr(w, 1, 1)) || substr(w, 2) else w end = {name}2.token as back from {name}2 left join {d} on {d}.word = w),
{name}4 as (select *, type = 'WORD' and w in ({LETTERS}) and back as single, case when type = 'CHARACTER' then {DIRECT} end as dc from {name}3),
{name}5 as (select *, case when token = ' ' then 'IMPLICIT_SPACE' when type = 'WHITESPACE' then 'EXPLICIT_WHITESPACE' when single then 'DIRECT' when type = 'WORD' and lex is not null and back then 'LEXICAL'
   when dc is not null and dc not in (0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 15) then 'DIRECT' else 'LITERAL' end as kind from {name}4),
{name}6 as (select *, case when kind in ('LEXICAL', 'DIRECT') then m else 'NONE' end as mod, case kind when 'LEXICAL' then lex when 'DIRECT' then case when single then unicode(w) else dc end end as code, type = 'WORD' and kind in ('LEXICAL', 'DIRECT') as plain from {name}5),
{name}7 as (select *, kind = 'IMPLICIT_SPACE' and coalesce(lag(plain) over p, false) and coalesce(lead(plain) over p, false) as implicit from {name}6 window p as (partition by doc_id order by pos)),
{name} as (select *, octet_length(encode(token)) as bytes, length(regexp_replace(token, '[^ \t\n\r]', '', 'g')) as plains from {name}7)"""


SUMS = {
    "characters": "length(token)", "utf8_bytes": "bytes",
    "encoded_bytes": "case when kind in ('LEXICAL', 'DIRECT') then 2 + 2 * (mod <> 'NONE')::int when kind = 'LITERAL' then 4 + bytes + (unicode(token) = 0)::int when kind = 'IMPLICIT_SPACE' then 2 * (not implicit)::int else 2 * plains + 4 * (length(token) - plains) + bytes - plains end",
    "lexical_items": "(kind = 'LEXICAL')::int", "direct_items": "(kind = 'DIRECT')::int", "literal_items": "(kind = 'LITERAL')::int",
    "literal_payload_bytes": "case kind when 'LITERAL' then bytes when 'EXPLICIT_WHITESPACE' then bytes - plains else 0 end",
    "implicit_spaces": "implicit::int", "explicit_single_spaces": "(kind = 'IMPLICIT_SPACE' and not implicit)::int", "explicit_whitespace_items": "(kind = 'EXPLICIT_WHITESPACE')::int", "modifier_items": "(mod <> 'NONE')::int",
}
ALL = ", ".join(f"coalesce(sum({v}), 0)::bigint as {k}" for k, v in SUMS.items())
ENC = f"{BASE}, {coded()}"
REDUCED = "utf8_bytes - encoded_bytes as reduction_bytes, case when utf8_bytes = 0 then 0.0 else round(100.0 * (utf8_bytes - encoded_bytes)::double / utf8_bytes, 6) end as reduction_percentage"
STATS = f"{ENC}, s as (select d.doc_id, any_value(d.lang) as lang, any_value(d.source) as source, count(token) as tokens, {ALL} from documents d left join e on e.doc_id = d.doc_id group by d.doc_id)"
NAMES = ", ".join(SUMS)
TOTALS = "count(*) as documents, " + ", ".join(f"sum({k})::bigint as {k}" for k in SUMS)
HEX = r"""case when kind in ('LEXICAL', 'DIRECT') then case mod when 'CAPITALIZED' then '0002' when 'UPPERCASE' then '0003' else '' end || printf('%04X', code) when kind = 'LITERAL' then '0000' || hex(encode(token)) || '0001'
   when kind = 'IMPLICIT_SPACE' then case when implicit then '' else '0020' end
   else list_aggregate(list_transform(string_split(token, ''), lambda c: case when c in (' ', chr(9), chr(10), chr(13)) then printf('%04X', unicode(c)) else '0000' || hex(encode(c)) || '0001' end), 'string_agg', '') end"""
COVER = "sum(n)::bigint as total, coalesce(sum(n) filter (dt.token is not null), 0)::bigint as covered, (sum(n) - coalesce(sum(n) filter (dt.token is not null), 0))::bigint as outside, round(100.0 * coalesce(sum(n) filter (dt.token is not null), 0)::double / sum(n), 6) as coverage"
FILES = "f as (select source || '/' || lang || '_' || doc_id || '.PDF' as path, sha256(text) as sha, text from documents)"
NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')"
TWO = rf"""with {FILES}, g as (select *, first_value(path) over (partition by sha order by lower(path), path) as one from f),
n as (select *, first_value(path) over (partition by tsha order by lower(path), path) as two from (select *, sha256({NORMAL}) as tsha from g where one = path)),
m as (select path, case when two = path then 'EXTRACTED' else 'TEXT_DUPLICATE' end as status, case when two <> path then two end as duplicate_of, sha as binary_sha256, tsha as text_sha256, octet_length(encode(text)) as b from n
union all select path, 'BINARY_DUPLICATE', one, sha, null, null from g where one <> path)"""
WORKS = "w as (select doc_id, 'x/' || lang || ' ' || source || ' ' || (doc_id % 7 + 1) || 'a ed parte ' || (doc_id % 3) || '.pdf' as path, case when n_chars > 500 then 'EXTRACTED' else 'NO_TEXT' end as status, lang from documents)"
IDENT = "regexp_replace(regexp_replace(upper(regexp_replace(regexp_extract(path, '[^/]+$'), '(?i)\\.pdf$', '')), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
MARK = r"mk as (select doc_id, '== ' || lang || ' ==' || chr(13) || chr(10) || '* ''''''' || text || ''''''' <!-- note -->' || chr(10) || '{| a' || chr(10) || '| b {| c |} |}' || chr(10) || '  # tail<ref name=' || chr(34) || 'x' || chr(34) || '>y</ref> <math>z</math>   end  ' || chr(10) || chr(10) || chr(10) || chr(10) || ': last' as text from documents)"

#: What layout rules make of column x, as a chain of replacements.
TIDY = (
    (r"\r\n?", "chr(10)"), (r"\[\[|\]\]", "' '"), (r"''{2,5}", "''"), (rf"(?m)^[{WS}]*[*#:;]+[{WS}]*", "''"), (rf"(?m)^[{WS}]*={{2,6}}[{WS}]*", "''"),
    (rf"(?m)[{WS}]*={{2,6}}[{WS}]*$", "''"), (r"[ \t]+", "' '"),
)


def tidied(x: str) -> str:
    for pattern, new in TIDY:
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    lines = rf"string_split_regex({x}, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"array_to_string(list_filter(list_transform({lines}, lambda y: regexp_replace(y, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda y: y <> ''), chr(10))"


UNTAGGED = r"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '(?is)<ref\b[^<>]*>.*?</ref\s*>', '', 'g'), '(?is)<math\b[^<>]*>.*?</math\s*>', '', 'g')"
TABLE = "replace(text, '{| a' || chr(10) || '| b {| c |} |}', chr(10))"
PLAIN = f"regexp_replace({UNTAGGED.format(x=TABLE)}, '</?[A-Za-z][^<>]*>', '', 'g')"


def chosen(values: list[str]) -> str:
    """The value that a document has by its number."""
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[(doc_id % {len(values)}) + 1]"


# What is planted in queries.py, and what becomes of it, in the same order.
OUTCOMES = ["OK", "ODD_LENGTH", "LITERAL_END_OUTSIDE", "DANGLING_MODIFIER", "CONSECUTIVE_MODIFIERS", "LITERAL_AFTER_MODIFIER", "MODIFIER_ON_DIRECT", "RESERVED_CONTROL", "RESERVED_EXTENSION", "UNASSIGNED_DIRECT", "UNKNOWN_TOKEN", "UNTERMINATED_LITERAL", "TRUNCATED_ESCAPE", "BAD_ESCAPE", "INVALID_UTF8"]
TEMPLATE_TEXTS = ["agri", "siglo XX", "3 km", "", "", "", "v", "", "uno"]
LINK_TEXTS = ["b c", "A", "", "t u", "", "c", "x"]
MANIFEST = f"{TWO}, c as (select path as \"RelativePath\", 'corpus' as \"Specialty\", '0' as \"FileSizeBytes\", binary_sha256 as \"BinarySHA256\", case when status in ('EXTRACTED', 'TEXT_DUPLICATE') then length(f.text) else 0 end as \"ExtractedCharacters\", coalesce(b, 0) as \"ExtractedUTF8Bytes\", text_sha256 as \"TextSHA256\", status as \"ExtractionStatus\", duplicate_of as \"DuplicateOf\", null::varchar as \"ExtractionError\", regexp_extract(path, '_(\\d+)\\.PDF$', 1)::int as doc_id from m join f using (path))"

ORACLES: dict[str, str] = {
    "tokens_exploded": f"with {toks()} select doc_id, pos, token, type from t",
    "token_type_counts": f"with {toks()} select lang, type, count(*) as n, sum(length(token))::bigint as characters from t group by all",
    "token_offsets": f"with {toks()} select doc_id, pos, (sum(length(token)) over p - length(token))::bigint as start, (sum(length(token)) over p)::bigint as \"end\" from t window p as (partition by doc_id order by pos)",
    "token_reconstruct": "select doc_id, sha256(text) as rebuilt_sha256, true as same from documents",
    "token_validate": "select doc_id % 7 as fault, case when text is null or length(text) = 0 then case when text is not null then 'OK' else 'OK' end else case doc_id % 7 when 1 then 'EMPTY_TOKEN' when 2 then 'GAP' when 3 then 'RANGE' when 4 then 'CONTENT' when 5 then 'COVERAGE' else 'OK' end end as outcome, count(*) as n from documents group by all",
    "word_histogram": f"with {toks()}, {hist()} select word, n from h",
    "char_class_counts": r"with c as (select unnest(string_split(text, '')) as c from documents), k as (select c, count(*) as n from c group by c) select regexp_matches(c, '^\p{L}$') as letter, regexp_matches(c, '^\p{M}$') as mark, regexp_matches(c, '^[\p{L}\p{M}]$') as continues, count(*) as characters, sum(n)::bigint as n from k where c <> '' group by all",
    "dict_topn_20000": f"{BASE} select ranking, token, word, frequency from dt",
    "dict_validate": f"{BASE} select unnest(['whole', 'empty', 'blank', 'repeated_word', 'repeated_token', 'gap', 'shifted']) as variant, unnest([n, 0, n, n, n, n - 1, n]) as size, unnest(['OK', 'EMPTY', 'BLANK_FIELD', 'REPEATED_WORD', 'REPEATED_TOKEN', 'RANKS_NOT_CONSECUTIVE', 'TOKEN_NOT_RANK_PLUS_535']) as outcome from (select count(*) as n from dt)",
    "dict_summary": f"{BASE} select count(*) as size, min(token) as first_token, max(token) as last_token, 20000 as requested, 'OK' as status from dt",
    "dict_lookup_left": f"{CONV} select hc.word, hc.n, dt.token from hc left join dt using (word)",
    "dict_contains_semi": f"{CONV} select word, n from hc where word in (select word from dt)",
    "dict_missing_anti": f"{CONV} select word, n from hc where word not in (select word from dt)",
    "dict_require": f"{BASE} select word, token from dt",
    "dict_index_duplicates": f"{CONV}, {top(name='x', source='hc')}, b as (select word, token from dt union all select word, token from xt) select word, count(*) as times, min(token) as low, max(token) as high from b group by word having count(*) > 1",
    "coverage_self_by_size": f"with {toks()}, {hist()}, {top(65000)}, s as (select unnest([{', '.join(map(str, SIZES))}])::int as requested) select requested, count(*) as selected, min(token) as first_token, max(token) as last_token, sum(frequency)::bigint as covered, (select count(*) from h) as vocabulary, (select sum(n)::bigint from h) as total, ((select sum(n) from h) - sum(frequency))::bigint as outside, round(100.0 * sum(frequency)::double / (select sum(n) from h), 6) as coverage from s join dt on ranking <= requested group by requested",
    "coverage_cross_by_lang": f"{BASE}, {hist(keys='lang', name='hl')} select lang, {COVER} from hl left join dt using (word) group by lang",
    "coverage_of_conversations": f"{BASE}, {toks('conversations', 'role', 'c')}, {hist(keys='role', name='hr', tokens='c')} select role, {COVER} from hr left join dt using (word) group by role",
    "coverage_rollup": f"{BASE}, {hist(keys='source', name='hs')} select case when grouping(source) = 1 then 'completo' else source end as source, {COVER} from hs left join dt using (word) group by rollup (source)",
    "rank_token_bijection": f"{BASE} select ranking, token, ranking as back, printf('%04X', token) as bytes, token as code from dt",
    "code_space": "with c as (select unnest(generate_series(0, 65536)) as code) select case when code <= 15 then 'control' when code <= 255 then 'direct' when code <= 535 then 'reserved' when code <= 65535 then 'lexical' else 'invalid' end as class, code in (4, 5, 6, 7, 8, 11, 12, 14, 15) as future, count(*) as n, min(code) as low, max(code) as high from c group by all",
    "case_modifier_counts": f"with {toks()} select lang, {MODIFIER} as modifier, count(*) as n from t where type = 'WORD' group by all",
    "direct_code_counts": f"with {toks()} select token, count(*) as n, {DIRECT} as code from t where type = 'CHARACTER' group by token",
    "representation_counts": f"{ENC} select lang, kind, count(*) as n, count(*) filter (mod <> 'NONE') as modified from e group by all",
    "implicit_space_counts": f"{ENC} select implicit, count(*) as n from e where kind = 'IMPLICIT_SPACE' group by all",
    "encode_stats_per_doc": f"{STATS} select doc_id, tokens, {NAMES}, {REDUCED} from s",
    "compression_by_lang": f"{STATS}, q as (select lang, {TOTALS} from s group by lang) select *, {REDUCED} from q",
    "compression_by_source": f"{STATS}, q as (select source, {TOTALS} from s group by source) select *, {REDUCED} from q",
    "compression_by_dict_size": f"with {toks()}, {hist()}"
    + "".join(f", {top(n, f'd{n}')}, {coded(f'd{n}t', f'e{n}_')}, q{n} as (select {n} as dictionary_size, (select count(*) from documents) as documents, {ALL} from e{n}_)" for n in SIZES)
    + " select *, " + REDUCED + " from (" + " union all ".join(f"select * from q{n}" for n in SIZES) + ")",
    "byte_identity_check": f"{STATS} select sum(encoded_bytes - 2 * (lexical_items + direct_items + modifier_items + explicit_single_spaces) - 4 * literal_items - literal_payload_bytes)::bigint as residual, sum(lexical_items + literal_items)::bigint as words, sum(implicit_spaces + explicit_single_spaces)::bigint as spaces from s",
    "encode_hex_per_doc": f"{ENC}, x as (select doc_id, string_agg({HEX}, '' order by pos) as hex from e group by doc_id) select doc_id, (length(coalesce(hex, '')) // 2)::int as bytes, sha256(coalesce(hex, '')) as hex_sha256 from documents left join x using (doc_id)",
    "decode_roundtrip": "select doc_id, text from documents",
    "decode_stats": f"{STATS}, z as (select doc_id, coalesce(sum(case when token = ' ' then (not implicit)::int when type = 'WHITESPACE' then plains else 0 end), 0)::bigint as blanks, coalesce(sum(case when type = 'WHITESPACE' and token <> ' ' then length(token) - plains else 0 end), 0)::bigint as others from e group by doc_id) select s.doc_id, 'OK' as error, encoded_bytes, characters as decoded_characters, utf8_bytes as decoded_utf8_bytes, lexical_items, direct_items + coalesce(blanks, 0) as direct_items, literal_items + coalesce(others, 0) as literal_items, modifier_items, coalesce(blanks, 0) as explicit_whitespace_items, implicit_spaces as reconstructed_implicit_spaces from s left join z using (doc_id)",
    "collision_pairs": "with b as (select text from documents union all select upper(text) from documents), g as (select count(distinct text) as texts, count(*) as documents from b group by lower(text) having count(distinct text) > 1) select 'lossy' as codec, texts, documents, count(*) as streams from g group by all",
    "first_difference": r"with x as (select doc_id, text as a, ((doc_id * 7919) % greatest(length(text), 1))::int as p from documents), y as (select doc_id, a, case doc_id % 4 when 0 then substr(a, 1, p) || '¶' || substr(a, p + 2) when 1 then substr(a, 1, p) when 2 then a || '+' else a end as b from x), z as (select *, list_filter(generate_series(1, greatest(length(a), length(b))), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1] as i from y where a <> b) select doc_id, (i - 1)::int as index, nullif(substr(a, i, 1), '') as left, nullif(substr(b, i, 1), '') as right from z",
    "benchmark_report": f"{STATS}, q as (select lang, {TOTALS} from s group by lang), z as (select count(*)::int as dictionary_size, min(token) as first_token, max(token) as last_token from dt) select documents as documents_evaluated, documents as round_trip_correct, 0 as round_trip_errors, 0 as codec_exceptions, 0 as statistics_errors, {NAMES}, dictionary_size, first_token, last_token, 'documents' as dictionary, lang as dataset, utf8_bytes - encoded_bytes as difference_bytes, case when utf8_bytes = 0 then 0.0 else round(100.0 * (utf8_bytes - encoded_bytes)::double / utf8_bytes, 6) end as reduction_percentage, 100.0::double as round_trip_success_percentage, 'OK' as result from q cross join z",
    "benchmark_upsert": f"{STATS} select 'documents' as dictionary, 20000 as dictionary_size, lang as dataset, count(*) as documents, sum(encoded_bytes)::bigint as encoded_bytes from s group by lang union all select 'documents', 65000, lang, count(*), 0 from documents group by lang",
    "result_classifier": "select lang, source, count(*) as evaluated, case when count(*) filter (doc_id % 97 = 0) > 0 or count(*) filter (doc_id % 89 = 1) > 0 then 'CODEC_OR_ROUNDTRIP_ERROR' when count(*) filter (doc_id % 23 = 2) > 0 then 'STATISTICS_ERROR' else 'OK' end as result from documents group by all",
    "manifest_validate": "select count(*) as rows, min(doc_id) = 0 and max(doc_id) + 1 = count(*) and count(distinct doc_id) = count(*) as orders_ok, count(distinct doc_id) = count(*) as pages_ok, true as snapshot_date_ok, count(distinct lang) <= 1 as segment_ok, true as evaluation_role_ok from documents",
    "top10_failures": "select doc_id, count(*) over (partition by text) as copies from documents qualify count(*) over (partition by text) > 1 order by doc_id limit 10",
    "sha_dedup_exact": f"with {FILES}, g as (select *, first_value(path) over (partition by sha order by lower(path), path) as one from f) select path, case when one <> path then one end as duplicate_of, case when one <> path then 'BINARY_DUPLICATE' end as status from g",
    "normalized_text_dedup": f"{TWO} select path, status, duplicate_of, binary_sha256, text_sha256 from m",
    "duplicate_of": f"with {FILES}, g as (select *, first_value(path) over (partition by sha order by lower(path), path) as one from f) select one as duplicate_of, count(*) as copies from g where one <> path group by one",
    "digest_groups": f"with {FILES} select upper(sha) as digest, count(*) over (partition by sha) as copies, path from f qualify count(*) over (partition by sha) > 1",
    "manifest_status_counts": f"{TWO} select status, count(*) as files, coalesce(sum(b), 0)::bigint as utf8_bytes from m group by status",
    "family_groups_having": f"with {WORKS}, k as (select upper(lang) || ' ' || upper(documents.source) as family_key, path from w join documents using (doc_id, lang)) select family_key, count(*) over (partition by family_key) as copies, path from k qualify count(*) over (partition by family_key) > 1",
    "selection_sequence": f"with {WORKS}, s as (select *, row_number() over (order by doc_id)::int as k from w where status = 'EXTRACTED') select k as candidate_order, 'CORPUS_' || lpad(k::varchar, greatest(3, length(k::varchar))::int, '0') || '_' || substr({IDENT}, 1, 60) as work_id, path, case when k in (4, 6, 8, 46, 47) then 'NO' else 'YES' end as selected, case when k in (4, 6, 8, 46, 47) then 'SAME_WORK_ALTERNATIVE' else 'SELECTED' end as selection_reason, case when k in (4, 6, 8, 46, 47) then 'Excluded during work-level curation; another representation of the same or potentially duplicated intellectual work was retained.' else '' end as notes from s",
    "work_identifiers": f"with {WORKS} select doc_id, {IDENT} as identifier, upper(lang) || '_' || lpad(doc_id::varchar, greatest(3, length(doc_id::varchar))::int, '0') || '_' || substr({IDENT}, 1, 60) as work_id from w",
    "selection_resume_anti": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "exclusion_except": f"with {WORKS} select doc_id from labels where quality = 0 except select doc_id from w where status = 'EXTRACTED'",
    "skip_take_sample": "select doc_id, n_chars, row_number() over (order by doc_id)::int as selection_order from (select * from documents order by doc_id limit 50 offset 100)",
    "funnel_counts": "select case when doc_id % 11 = 0 then 'OTHER_NAMESPACE' when doc_id % 13 = 0 then 'REDIRECT' when doc_id % 17 = 0 then 'NO_WIKITEXT' else 'ACCEPTED' end as stage, count(*) as n from documents group by all",
    "comments_and_tags": f"with {MARK} select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)<ref\\b[^<>]*>.*?</ref\\s*>', '', 'g'), '(?is)<math\\b[^<>]*>.*?</math\\s*>', '', 'g') as text from mk",
    "page_comments": "select page_id, length(html) as characters, length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) as kept from pages",
    "token_descriptions": f"{ENC} select kind || ' ''' || token || '''' || case when code is not null then ' code=' || code else '' end || case when mod <> 'NONE' then ' ' || mod else '' end as line, count(*) as n from e where type = 'WORD' group by all",
    "renderings": r"select doc_id, sha256(replace(replace(replace(text, chr(9), '\t'), chr(13), '\r'), chr(10), '\n')) as visible_sha256, sha256(trim(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g'))) as hex_sha256, printf('%02d:%02d:%02d', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) as elapsed, length(text) as characters, octet_length(encode(text)) as bytes, round(100.0 * length(text)::double / octet_length(encode(text)), 6) as share from documents",
    "postprocess_text": f"select doc_id, sha256({tidied("'== H ==' || chr(10) || '* ' || text")}) as text_sha256 from documents",
    "clean_ratio": f"with {MARK}, p as (select doc_id, length(text) as n, {tidied(PLAIN)} as t from mk) select doc_id, n as original_characters, length(t) as cleaned_characters, greatest(0, n - length(t)) as removed_characters, sha256(t) as text_sha256 from p",
    "table_strip": "select doc_id, sha256(case doc_id % 3 when 0 then 'a' || chr(10) || 'b' when 1 then '{| ' || text else text || ' |} z' end) as text_sha256 from documents",
    "template_rules": f"select doc_id, sha256(text || ' ' || {chosen(TEMPLATE_TEXTS)} || ' end') as text_sha256 from documents",
    "link_rewrite": f"select doc_id, sha256(text || ' ' || {chosen(LINK_TEXTS)} || ' end') as text_sha256 from documents",
    "decode_errors": f"select doc_id, {chosen(OUTCOMES)} as outcome, case when doc_id % {len(OUTCOMES)} = 0 then sha256(text) end as text_sha256 from documents",
    "numbered_with_gaps": "with d as (select case when doc_id % 10 > 0 then n_chars // 100 end as o from documents), n as (select o, row_number() over (order by o nulls last) as k from d) select o as \"order\", min(k)::int as low, max(k)::int as high, count(*) as rows from n group by o",
    "name_templates": "select doc_id, lang || ':' || doc_id as identifier, lang || '_20240101_' || source || '_skip' || doc_id || '_count' || (doc_id + 5) as dataset, lpad(doc_id::varchar, greatest(4, length(doc_id::varchar))::int, '0') || '_' || substr(sha256(text), 1, 16) || '.txt' as file, 'https://wiki.example/' || replace(concat_ws(' ', lang, source, doc_id::varchar), ' ', '_') as url from documents",
    "dump_file": "select doc_id::varchar as id, 'Page <' || doc_id || '> & ü' as title, case when doc_id % 11 = 0 then '1' else '0' end as ns, doc_id % 13 = 0 as redirect, sha256(case when doc_id % 17 = 0 then '' else text end) as text_sha256 from documents",
    "json_manifest_file": "select (doc_id + 1)::int as selection_order, doc_id::varchar as page_id, sha256(text) as title_sha256, n_chars::int as cleaned_characters, round(n_chars::double / 7, 6) as reduction_ratio, null::varchar as segment from documents",
    "manifest_file": f"{MANIFEST} select * exclude (doc_id) replace (\"ExtractedCharacters\"::varchar as \"ExtractedCharacters\", \"ExtractedUTF8Bytes\"::varchar as \"ExtractedUTF8Bytes\") from c",
    "extraction_manifest_file": f"{MANIFEST} select doc_id as \"CandidateOrder\", \"RelativePath\", \"TextSHA256\" from c where \"ExtractionStatus\" = 'EXTRACTED'",
    "selection_file": f"{MANIFEST}, k as (select *, row_number() over (order by doc_id)::int as k from c where \"ExtractionStatus\" = 'EXTRACTED') select \"Specialty\", k as \"CandidateOrder\", 'CORPUS_' || lpad(k::varchar, greatest(3, length(k::varchar))::int, '0') || '_' || substr({IDENT.replace('path', chr(34) + 'RelativePath' + chr(34))}, 1, 60) as \"WorkID\", \"RelativePath\", '1' as \"WorkPart\", 'YES' as \"Selected\", 'SELECTED' as \"SelectionReason\", \"ExtractedCharacters\"::varchar as \"ExtractedCharacters\", \"ExtractedUTF8Bytes\"::varchar as \"ExtractedUTF8Bytes\", \"BinarySHA256\", \"TextSHA256\", null::varchar as \"Notes\" from k where k not in (4, 6, 8, 46, 47)",
    "checkpoint_file": "select doc_id::int as \"CandidateOrder\", 'EXTRACTED' as \"ExtractionStatus\" from documents",
    "text_files": "with t as (select n_nationkey::int as n_nationkey, encode(n_name || chr(13) || chr(10) || 'é' || n_nationkey || chr(13) || 'x' || chr(10)) as r, encode(n_name || chr(10) || 'é' || n_nationkey || chr(10) || 'x' || chr(10)) as l from nation) select n_nationkey, octet_length(r)::bigint as bytes, hex(r) as raw, hex(l) as lf from t",
    "text_status": "select doc_id, case when doc_id % 11 = 0 then 'FILE_NOT_FOUND' when doc_id % 9 = 1 then 'SIZE_DIFFERS' else 'OK' end as status, case when doc_id % 11 > 0 then sha256(text) end as text_sha256 from documents",
    "file_manifest_check": "select unnest(['whole', 'file', 'digest', 'order', 'count']) as variant, unnest([n, n, n, n, n - 1]) as rows, unnest([true, true, true, true, false]) as count_ok, unnest([true, true, false, true, true]) as digests_ok, unnest([true, false, true, true, true]) as files_ok, unnest([true, true, true, false, true]) as orders_ok from (select count(*) as n from documents)",
    "stored_texts": "select doc_id, sha256(text) as text_sha256 from documents",
    "upsert_file": "select 'documents' as dictionary, size::varchar as dictionary_size, lang as dataset, (case when size = 20000 and lang > 'en' then -1 else 1 end * count(*))::varchar as documents, 'INSERTED UPDATED' as status from documents, (select unnest([20000, 65000]) as size) group by lang, size",
}
ORACLES["encode_hex_native"] = ORACLES["encode_hex_per_doc"]
ORACLES["decode_roundtrip_native"] = ORACLES["decode_roundtrip"]
ORACLES["dictionary_file"] = f"{BASE} select ranking, token, word, frequency from dt"
