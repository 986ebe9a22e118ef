"""Queries over text functions, quality scorers and splitters."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import quality as Q
from murmur.functions import text as T
from murmur.plans.common import ITEMS, items, scalar, squeezed, table, wordlist
from murmur.plans.registry import query

SP = "[ \\t\\n\\r\\f]"
TRAIL = f"(?i){SP}*FOR{SP}+MORE{SP}+GO{SP}+TO{SP}+[A-Za-z]+[.\\w]*{SP}*"
MARK = f"(?i)FOR{SP}+MORE{SP}+GO{SP}+TO{SP}+[A-Za-z]+[.\\w]*"
r = lambda x, a, b: f"regexp_replace({x}, '{a}', '{b}', 'g')"
NOISY = "concat('|[', text, '] .. {x} ', chr(96), ' a^b')"
UP = "upper(replace(%s, 'ß', 'ss'))"

scalar("clean_text", T.clean_text, squeezed(r(r(r("translate(x, '|[]{}\\~`^', '')", "\\x{FFFD}", "''"), "[—–]", "-"), "\\.{2,}", ".")), NOISY)
scalar("clean_text_raw", T.clean_text_raw, squeezed("translate(x, '|[]{}\\~`^;', '')"), NOISY)
AFFIXED = "concat('Breaking  News - ', text, ' for more go to Example.com now')"
scalar("strip_affixes", T.strip_affixes, f"trim({r(f'trim({r("x", TRAIL, "")})', f'(?i)^BREAKING{SP}+NEWS{SP}*', '')})", AFFIXED)
scalar("strip_affixes_dash", T.strip_affixes_dash, f"trim({squeezed(r(r('x', TRAIL, ' '), f'(?i)^BREAKING{SP}+NEWS{SP}*-?{SP}*', ''))}, '- ')", AFFIXED)
scalar("strip_prefix_upper", T.strip_prefix_upper, f"trim({r('x', f'^BREAKING{SP}+NEWS{SP}+', '')})", "concat('BREAKING NEWS ', text)")
scalar("normalize_upper", T.normalize, UP % squeezed("x"))
scalar("vlm_norm", T.vlm_norm, squeezed(r(r(UP % "x", "[0-9]+", ""), "[^\\p{L}\\p{M}\\p{N}_\\s]", " ")))
scalar("digit_strip", T.digit_strip, squeezed(r("x", "[0-9,.]", " ")))
scalar("digit_strip_raw", lambda c: T.digit_strip(c, ""), r("x", "[0-9,.]", ""))
LINES = "list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT starts_with(l, '#'))"
scalar("asr_normalize", lambda c: T.asr_normalize(c, True), squeezed(r(f"lower(array_to_string(list_transform({LINES}, lambda l: regexp_replace(l, '^\\[[0-9:.]+ --> [0-9:.]+\\][ \\t]*', '')), ' '))", "[^\\p{L}\\p{M}\\p{N}_\\s'']+", " ")), "concat('# head', chr(10), '[00:00:01.000 --> 00:00:02.500] ', text)")
scalar("strip_timestamp", T.strip_timestamp, "regexp_replace(x, '^\\[[0-9:.]+ --> [0-9:.]+\\][ \\t]*', '')", "concat('[00:00:01.000 --> 00:00:02.500] ', text)")
scalar("load_chunk_text", lambda c: F.array_join(T.content_lines(c), " "), f"array_to_string({LINES}, ' ')", "concat('# head', chr(10), text)")
scalar("strip_think", T.strip_think, f"trim({r('x', '(?s)<think>.*?</think>', '')})", "concat('<think>', text, '</think> ', source, '<think>a</think> b')")
scalar("strip_fences", T.strip_fences, f"trim(regexp_replace(regexp_replace(trim(x), '^```[a-zA-Z]*[ \\t\\n\\r]*', ''), '[ \\t\\n\\r]*```$', ''))", "concat('```json', chr(10), text, chr(10), '```')")
scalar("word_prefix", T.word_prefix, f"CASE WHEN len({wordlist('x')}) >= 4 THEN array_to_string(({wordlist('x')})[1:6], ' ') END", base="items")
scalar("find_delimiter", lambda c: F.concat_ws("/", T.find_delimiter(c)["delimiter"], T.find_delimiter(c)["n"].cast("string")), """(SELECT d || '/' || n FROM (
  SELECT unnest([' - ', ' | ', ' • ', ' · ']) AS d, unnest([(length(x) - length(replace(x, ' - ', ''))) // 3, (length(x) - length(replace(x, ' | ', ''))) // 3, (length(x) - length(replace(x, ' • ', ''))) // 3, (length(x) - length(replace(x, ' · ', ''))) // 3]) AS n, unnest([0, 1, 2, 3]) AS p
) ORDER BY n DESC, p LIMIT 1)""")
scalar("significant_numbers", lambda c: F.array_join(F.array_sort(T.significant_numbers(c)), ","), "array_to_string(list_sort(list_transform(list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(x, '[0-9][0-9,]+'), lambda n: replace(n, ',', '')), lambda n: length(n) >= 3), lambda n: n::HUGEINT), lambda n: n NOT BETWEEN 1900 AND 2099)), lambda n: n::VARCHAR)), ',')", "concat(text, ' 72,292 in 2023 and ', n_chars)")
scalar("ideal_length_dist", T.ideal_distance, "abs(length(x) - 90) / 90", base="items")
scalar("quality_v6", lambda c: F.round(Q.quality_v6(c), 6), f"""round(CASE WHEN length(x) < 15 OR len({wordlist('x')}) = 0 OR length({r('x', '[^\\p{L}]', '')}) = 0 THEN 0.0 ELSE
  length({r('x', '[^\\p{Lu}]', '')}) / length({r('x', '[^\\p{L}]', '')}) * 0.4 + len(list_filter({wordlist('x')}, lambda w: length(w) >= 3 AND length({r('w', '[^\\p{L}]', '')}) / length(w) > 0.7)) / len({wordlist('x')}) * 0.4 + CASE WHEN length(x) < 30 THEN 0.5 WHEN length(x) > 200 THEN 0.6 ELSE 1.0 END * 0.2 END::DOUBLE, 6)""", base="items")


def _good_sql(x: str, vowels: int, run: int, longest: int) -> str:
    upper = lambda i: f"regexp_matches({x}[{i}], '[A-Z]')"
    switches = f"coalesce(list_sum(list_transform(range(1, length({x})), lambda i: ({upper('i')} <> {upper('(i + 1)')})::INT)), 0)"
    runs = f"len(list_filter(range(1, length({x}) - 3), lambda i: len(list_distinct(string_split(lower({x}[i:i + 4]), ''))) <= 2)) > 0"
    return f"NOT (length({x}) > {longest} OR (length({x}) >= {vowels} AND length({r(x, '[^aeiouAEIOU]', '')}) = 0) OR (length({x}) >= 4 AND {switches} > 2 AND {switches} >= length({x}) * 0.4) OR (length({x}) >= {run} AND {runs}))"


def scored_sql(vowels: int, run: int, longest: int, rel: str = ITEMS) -> str:
    return f"""(SELECT *, len(list_filter(s, lambda y: {_good_sql('y', vowels, run, longest)})) AS good, len(s) AS scored, length(regexp_replace(w[len(w)], '[^a-zA-Z]', '', 'g')) AS last, length(text) AS n
  FROM (SELECT *, list_filter(list_transform(w, lambda y: regexp_replace(y, '[^a-zA-Z]', '', 'g')), lambda y: y <> '') AS s FROM (SELECT *, {wordlist('text')} AS w FROM {rel})))"""


MERGE_Q = "(CASE WHEN n < 20 OR len(w) < 3 OR scored = 0 THEN 0.0 ELSE good / scored * 0.6 + CASE WHEN n < 40 THEN 0.3 WHEN n <= 120 THEN 1.0 ELSE greatest(0.5, 1.0 - (n - 120) / 200) END * 0.4 - CASE WHEN last BETWEEN 1 AND 2 OR text LIKE '%-' OR text LIKE '%,' THEN 0.05 ELSE 0.0 END END)::DOUBLE"
IMPROVE_Q = "(CASE WHEN n < 35 OR len(w) < 3 THEN 0.0 ELSE greatest(0.0, good / greatest(scored, 1) * 0.5 + CASE WHEN n < 40 THEN 0.3 WHEN n < 50 THEN 0.6 WHEN n <= 130 THEN 1.0 WHEN n <= 150 THEN 0.7 WHEN n <= 180 THEN 0.4 ELSE 0.2 END * 0.5 - CASE WHEN last <= 2 THEN 0.1 ELSE 0.0 END) END)::DOUBLE"


@query("quality_merge", f"SELECT doc_id, pos, round({MERGE_Q}, 6) AS v FROM {scored_sql(4, 5, 1000000)}")
def quality_merge(spark, d):
    return items(spark, d).select("doc_id", "pos", F.round(Q.quality_merge("text"), 6).alias("v"))


@query("quality_improve", f"SELECT doc_id, pos, round({IMPROVE_Q}, 6) AS v FROM {scored_sql(5, 6, 16)}")
def quality_improve(spark, d):
    return items(spark, d).select("doc_id", "pos", F.round(Q.quality_improve("text"), 6).alias("v"))


@query("partition_good_merged", f"SELECT doc_id, CASE WHEN n < 35 OR n > 200 OR round({IMPROVE_Q}, 9) < 0.5 THEN 'garbage' WHEN n BETWEEN 40 AND 140 THEN 'good' ELSE 'merged' END AS kind, count(*) AS n_items FROM {scored_sql(5, 6, 16)} GROUP BY 1, 2")
def partition_good_merged(spark, d):
    """Garbage is what scores under 0.5; scores are rounded to 9 places before, so that no engine's last bit decides."""
    n = F.length("text")
    kind = F.when((n < 35) | (n > 200) | (F.round(Q.quality_improve("text"), 9) < 0.5), "garbage").when(n.between(40, 140), "good").otherwise("merged")
    return items(spark, d).groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n_items"))


@query("filter_post_merge", f"SELECT doc_id, pos, text FROM {scored_sql(4, 5, 1000000)} WHERE n >= 40 AND round({MERGE_Q}, 9) >= 0.55 AND NOT regexp_matches(text, '(?i)^for more')")
def filter_post_merge(spark, d):
    return items(spark, d).where((F.length("text") >= 40) & (F.round(Q.quality_merge("text"), 9) >= 0.55) & ~F.regexp_like("text", F.lit("(?i)^for more"))).select("doc_id", "pos", "text")


V6 = f"round(CASE WHEN length(text) < 15 OR length({r('text', '[^\\p{L}]', '')}) = 0 THEN 0.0 ELSE length({r('text', '[^\\p{Lu}]', '')}) / length({r('text', '[^\\p{L}]', '')}) * 0.4 + len(list_filter({wordlist('text')}, lambda w: length(w) >= 3 AND length({r('w', '[^\\p{L}]', '')}) / length(w) > 0.7)) / len({wordlist('text')}) * 0.4 + CASE WHEN length(text) < 30 THEN 0.5 WHEN length(text) > 200 THEN 0.6 ELSE 1.0 END * 0.2 END::DOUBLE, 9)"


@query("filter_reasons", f"SELECT reason, count(*) AS n_items FROM (SELECT CASE WHEN length(text) < 20 THEN 'too_short' WHEN {V6} < 0.86 OR length(text) > 150 THEN 'garbage' ELSE 'kept' END AS reason FROM {ITEMS}) GROUP BY 1")
def filter_reasons(spark, d):
    n = F.length("text")
    reason = F.when(n < 20, "too_short").when((F.round(Q.quality_v6("text"), 9) < 0.86) | (n > 150), "garbage").otherwise("kept")
    return items(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n_items"))


@query("filter_length", f"SELECT doc_id, pos, text FROM {ITEMS} WHERE length(text) BETWEEN 30 AND 200")
def filter_length(spark, d):
    return items(spark, d).where(F.length("text").between(30, 200)).select("doc_id", "pos", "text")


@query("contains_filter", "SELECT doc_id, text FROM documents WHERE contains(lower(text), 'license')")
def contains_filter(spark, d):
    return table(spark, d, "documents").where(T.contains("text", "LICENSE")).select("doc_id", "text")


@query("char_classes", f"""SELECT doc_id, letters, upper, digits, spaces, length(text) - letters - digits - spaces AS others, round(CASE WHEN letters > 0 THEN upper / letters ELSE 0.0 END::DOUBLE, 9) AS upper_ratio FROM (
  SELECT doc_id, text, length({r('text', '[^\\p{L}\\p{M}]', '')})::INT AS letters, length({r('text', '[^\\p{Lu}]', '')})::INT AS upper, length({r('text', '[^0-9]', '')})::INT AS digits, length({r('text', f'[^ \\t\\n\\r\\f]', '')})::INT AS spaces FROM documents)""")
def char_classes(spark, d):
    x = table(spark, d, "documents").select("doc_id", T.char_classes("text").alias("c")).select("doc_id", "c.*")
    return x.withColumns({"upper_ratio": F.round("upper_ratio", 9), "others": F.col("others").cast("long")})


@query("text_lengths", f"SELECT doc_id, length(text)::BIGINT AS chars, len({wordlist('text')})::BIGINT AS words FROM documents")
def text_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.size(T.words("text")).cast("long").alias("words"))


def _exploded(name: str, given: str, parts, sql_parts: str) -> None:
    @query(name, f"SELECT doc_id, pos::BIGINT AS pos, part FROM (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, {sql_parts} AS p FROM (SELECT doc_id, {given} AS x FROM documents)))")
    def run(spark, d):
        return table(spark, d, "documents").select("doc_id", F.expr(given).alias("x")).select("doc_id", F.posexplode(parts(F.col("x"))).alias("pos", "part")).select("doc_id", F.col("pos").cast("long"), "part")


_exploded("split_literal", "text", lambda x: F.split(x, "\\Q, \\E"), "string_split(x, ', ')")
_exploded("scan_lines_nocomment", "concat('# head', chr(10), chr(10), text)", T.content_lines, LINES)
_exploded("split_regex_minlen", "replace(text, '. ', ' - ')", T.split_minlen, f"list_filter(list_transform(string_split_regex(x, '{SP}+-{SP}+'), lambda p: trim(p)), lambda p: length(p) >= 35)")
_exploded("split_cycles", "replace(text, '. ', ' for more  go to site.com ')", T.split_cycles, f"list_filter(list_transform(string_split_regex(x, '{MARK}'), lambda p: trim(p)), lambda p: length(p) > 100)")
STARTS_SQL = "|".join(T.STARTS).replace("'", "''")
_exploded("split_pattern_start", "replace(replace(text, '. ', ' Kuwait says '), chr(10), ' BREAKING NEWS ')", T.split_starts, f"list_filter(list_transform(list_filter(list_transform((string_split(regexp_replace({squeezed("translate(x, '|[]{}\\~`^;', '')")}, '(?i)({STARTS_SQL})', chr(1) || '\\1', 'g'), chr(1)))[2:], lambda p: trim(regexp_replace(trim(p), ' +\\S{{1,2}}$', ''))), lambda p: length(p) >= 20 AND NOT regexp_matches(p, '(?i)^for +more') AND NOT regexp_matches(p, '(?i)^breaking +news *$')), lambda p: trim(regexp_replace(p, '^BREAKING{SP}+NEWS{SP}+', ''))), lambda p: length(p) >= 20)")

# What models may answer, by row: fenced lists of mixed types, prose around an object, an object whose second list comes first in
# brackets, lines, raw text, a list cut short, nested lists, an empty list.


def _answers(g: str) -> str:
    """g: the flag with which the engine replaces all matches."""
    t = f"regexp_replace(text, '[^A-Za-z ]', ''{g})"
    return f"""CASE (conv_id + turn) % 8 WHEN 0 THEN concat('```json', chr(10), '["', role, '", 1, " b ", "", null, {{"x": "y"}}, "', {t}, '"]', chr(10), '```')
      WHEN 1 THEN concat('Result: {{"a": [1, " ', role, ' ", ""], "b": ["', {t}, '"]}} done') WHEN 2 THEN concat('{{"n": 3, "items": ["', {t}, '", "z"], "more": ["', role, '"]}}')
      WHEN 3 THEN concat('- "', {t}, '",', chr(10), '-- short', chr(10), '  ''', {t}, ''',  ') WHEN 4 THEN text WHEN 5 THEN concat('["cut off", "', {t})
      WHEN 6 THEN concat('Here: {{"a": {{"b": ["', role, '"]}}}}') ELSE concat('[] ', {t}) END"""


_STRINGS = "list_filter(list_transform(list_filter({}, lambda e: json_type(e) = 'VARCHAR'), lambda e: trim(e->>'$', ' ' || chr(9) || chr(10) || chr(13))), lambda e: e <> '')"
_BODY = "regexp_extract(x, '(?s)\\[.*\\]')"
_LIST = f"CASE WHEN {_BODY} <> '' AND json_valid({_BODY}) THEN {_STRINGS.format(f'''json_extract({_BODY}, '$[*]')''')} END"
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_LONG = f"""list_filter(list_transform(string_split_regex(x, '\\r\\n|[\\n\\r]'), lambda y: trim(trim(trim(trim(ltrim(trim(y, {_BLANK}), '-'), {_BLANK}), ','), '"'), '''')), lambda y: length(y) > 20)"""
_OBJECT = "regexp_extract(x, '(?s)\\{.*\\}')"
_FIRST = f"list_filter(list_transform(json_keys({_OBJECT}), lambda k: json_extract({_OBJECT}, '$.\"' || k || '\"')), lambda v: json_type(v) = 'ARRAY')[1]"
_IN_OBJECT = f"CASE WHEN {_OBJECT} <> '' AND json_valid({_OBJECT}) AND json_type({_OBJECT}) = 'OBJECT' AND {_FIRST} IS NOT NULL THEN {_STRINGS.format(f'''json_extract({_FIRST}, '$[*]')''')} END"


@query("json_array_extract", f"SELECT conv_id, turn, array_to_string(coalesce({_LIST}, {_LONG}), '/') AS v FROM (SELECT conv_id, turn, {_answers(", 'g'")} AS x FROM conversations)")
def json_array_extract(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_answers("")).alias("x")).select("conv_id", "turn", F.array_join(T.json_strings("x"), "/").alias("v"))


@query("json_object_fallback", f"SELECT conv_id, turn, array_to_string(coalesce({_LIST}, {_IN_OBJECT}, {_LONG}), '/') AS v FROM (SELECT conv_id, turn, trim(trim(regexp_replace({_answers(", 'g'")}, '```(?:json)?', '', 'g'), '`'), {_BLANK}) AS x FROM conversations)")
def json_object_fallback(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_answers("")).alias("x")).select("conv_id", "turn", F.array_join(T.json_strings_or_object("x"), "/").alias("v"))


def _heads(g: str) -> str:
    """Answers with headlines: fenced, in prose, as a bare list, of mixed kinds, cut short, with other confidences."""
    t = f"regexp_replace(text, '[^A-Za-z ]', ''{g})"
    return f"""CASE (conv_id + turn) % 6 WHEN 0 THEN concat('```json ', chr(10), '{{"headlines": ["', {t}, '", {{"text": " x ', turn, '", "confidence": " LOW"}}, {{"text": "y", "confidence": "?"}}, {{"confidence": "low"}}, "", 7, ["in"], {{"text": 5}}]}}', chr(10), '```')
      WHEN 1 THEN concat('[{{"headlines": ["', role, '"]}}]') WHEN 2 THEN concat('I see: {{"headlines": [{{"text": "', {t}, '"}}, "', role, '"]}} and no more') WHEN 3 THEN concat('{{"headlines": ["', role, '"')
      WHEN 4 THEN '{{"headlines": null}}' ELSE text END"""


_FENCED = "trim(regexp_replace(regexp_replace(trim(x, ' ' || chr(10)), '^```[a-zA-Z]*[ \\t\\n\\r]*', ''), '[ \\t\\n\\r]*```$', ''), ' ')"
_WHOLE = "CASE WHEN json_valid(x) THEN x WHEN json_valid(regexp_extract(x, '(?s)\\{.*\\}')) THEN regexp_extract(x, '(?s)\\{.*\\}') END"


@query("parse_headlines", f"""SELECT conv_id, turn, upper(trim(said)) AS text, CASE WHEN kind = 'VARCHAR' THEN 'medium' WHEN lower(trim(given)) IN ('high', 'medium', 'low') THEN lower(trim(given)) ELSE 'high' END AS confidence FROM (
    SELECT conv_id, turn, json_type(v) AS kind, CASE json_type(v) WHEN 'VARCHAR' THEN v->>'$' WHEN 'OBJECT' THEN v->>'$.text' END AS said, CASE json_type(v) WHEN 'OBJECT' THEN v->>'$.confidence' END AS given FROM (
      SELECT conv_id, turn, unnest(json_extract(o, '$.headlines[*]')) AS v FROM (SELECT conv_id, turn, {_WHOLE} AS o FROM (SELECT conv_id, turn, {_FENCED} AS x FROM (SELECT conv_id, turn, {_heads(", 'g'")} AS x FROM conversations))) WHERE json_type(o) = 'OBJECT')
  ) WHERE trim(said) <> ''""")
def parse_headlines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_heads("")).alias("x")).select("conv_id", "turn", F.inline(T.parse_headlines("x")))


@query("json_path_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_get(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("build_prompt", "SELECT conv_id, 'Roles:' || chr(10) || string_agg(n || '. ' || role, chr(10) ORDER BY turn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY conv_id")
def build_prompt(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["role"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(T.numbered(ordered, "Roles:").alias("prompt"))


@query("hierarchical_prompt", "SELECT role, bucket, 'Part ' || bucket || ':' || chr(10) || string_agg(n || '. ' || conv_id, chr(10) ORDER BY n) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY role, bucket ORDER BY conv_id, turn) AS n FROM (SELECT role, conv_id, turn, conv_id // 20 AS bucket FROM conversations)) GROUP BY role, bucket")
def hierarchical_prompt(spark, d):
    """Level one of a two-level summary: per role, batches of 20 conversations; each batch is one prompt."""
    rows = table(spark, d, "conversations").withColumn("bucket", F.floor(F.col("conv_id") / 20))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn"))), lambda x: x["conv_id"].cast("string"))
    return rows.groupBy("role", "bucket").agg(ordered.alias("o")).select("role", "bucket", F.concat(F.lit("Part "), F.col("bucket").cast("string"), F.lit(":\n"), F.array_join(F.transform("o", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")).alias("prompt"))


@query("classify_retryable", "SELECT conv_id, turn, regexp_matches(lower(x), '429|rate limit|rate_limit|too many|tpm limit|503|service unavailable|502|bad gateway|504|gateway timeout|timed out|timeout|connection reset|read timed out|temporarily unavailable|overloaded') AS v FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'HTTP 429 ' || role WHEN turn = 1 THEN 'Read Timed Out' ELSE text END AS x FROM conversations)")
def classify_retryable(spark, d):
    x = F.when(F.col("turn") == 0, F.concat(F.lit("HTTP 429 "), "role")).when(F.col("turn") == 1, "Read Timed Out").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.retryable(x).alias("v"))


# Error messages by row: a hint of seconds in several shapes, none, one of another name.
DELAYS = """CASE (conv_id + turn) % 5 WHEN 0 THEN concat('429 retry_delay { seconds: ', turn * 7 + conv_id, ' }') WHEN 1 THEN concat(role, ' retry_delay', chr(10), '{', chr(10), '  seconds:', turn, chr(10), '} retry_delay { seconds: 9 }')
  WHEN 2 THEN concat('retry_delay { minutes: ', turn, ' }') WHEN 3 THEN concat('retry_delay{seconds: 0', conv_id, '5', text) ELSE text END"""


@query("extract_retry_delay", f"SELECT conv_id, turn, coalesce(try_cast(regexp_extract(x, 'retry_delay\\s*\\{{\\s*seconds:\\s*(\\d+)', 1) AS DOUBLE), 0.0) AS v FROM (SELECT conv_id, turn, {DELAYS} AS x FROM conversations)")
def extract_retry_delay(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(DELAYS).alias("x")).select("conv_id", "turn", T.retry_delay("x").alias("v"))


@query("format_ids", "SELECT conv_id, turn, role || '_' || turn AS tile, printf('chunk_%03d', turn) AS chunk FROM conversations")
def format_ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("_", "role", F.col("turn").cast("string")).alias("tile"), F.format_string("chunk_%03d", "turn").alias("chunk"))


@query("fmt_srt", "SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS v FROM (SELECT event_id, CAST(round(value * 100 * 1000) AS BIGINT) AS ms FROM events)")
def fmt_srt(spark, d):
    return table(spark, d, "events").select("event_id", T.srt_time(F.col("value") * 100).alias("v"))


@query("fmt_duration", "SELECT event_id, printf('%dm %ds', s // 60, s % 60) AS v FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events)")
def fmt_duration(spark, d):
    return table(spark, d, "events").select("event_id", T.duration(F.col("value") * 100).alias("v"))


# Token counts and prices by row, some unknown.
TOKENS = {"tin": "nullif(l_quantity, 7)", "tout": "CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity * 2 END", "think": "CASE WHEN l_orderkey % 3 <> 0 THEN floor(l_extendedprice) END", "dear": "CASE WHEN p_size % 4 <> 0 THEN p_size * 3 END"}


@query("token_cost", f"""SELECT l_orderkey, l_linenumber, CASE WHEN tin IS NULL OR tout IS NULL THEN 0.0::DOUBLE WHEN think IS NULL OR dear IS NULL THEN tin / 1000000 * p_retailprice + tout / 1000000 * p_size ELSE tin / 1000000 * p_retailprice + tout / 1000000 * p_size + think / 1000000 * dear END AS usd
  FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in TOKENS.items())} FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def token_cost(spark, d):
    """Quantities as token counts, parts as the price list of models; some counts and the price of thinking are unknown."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").join(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("*", *(F.expr(v).alias(k) for k, v in TOKENS.items()))
    return rows.select("l_orderkey", "l_linenumber", T.token_cost("tin", "tout", "p_retailprice", "p_size", "think", "dear").alias("usd"))


@query("throttle", "SELECT p_partkey, 60.0 / greatest(1, p_size - 10) AS seconds FROM part")
def throttle(spark, d):
    return table(spark, d, "part").select("p_partkey", T.throttle(F.col("p_size") - 10).alias("seconds"))
