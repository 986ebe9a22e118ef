"""Text functions, Column to Column, built-ins only (whole-stage code, no Python on the executors).

White space is the ASCII set [ \\t\\n\\r\\f\\v] unless a function says otherwise; letters and case are Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Noise characters of recognised text; what ends an item and what begins a special one.
NOISE = "|[]{}\\~`^"
TRAILER = "(?i)[ \\t\\n\\r\\f]*FOR[ \\t\\n\\r\\f]+MORE[ \\t\\n\\r\\f]+GO[ \\t\\n\\r\\f]+TO[ \\t\\n\\r\\f]+[A-Za-z]+[.\\w]*[ \\t\\n\\r\\f]*"
CYCLE_MARK = "(?i)FOR[ \\t\\n\\r\\f]+MORE[ \\t\\n\\r\\f]+GO[ \\t\\n\\r\\f]+TO[ \\t\\n\\r\\f]+[A-Za-z]+[.\\w]*"
DELIMITERS = (" - ", " | ", " • ", " · ")
RETRYABLE = ("429", "rate limit", "rate_limit", "too many", "tpm limit", "503", "service unavailable", "502", "bad gateway", "504", "gateway timeout", "timed out", "timeout", "connection reset", "read timed out", "temporarily unavailable", "overloaded")
# What a headline starts with, in order.
STARTS = (
    r"IRAN(?:'?S)?\s+(?:REVOLUTIONARY|FOREIGN|ATOMIC|PARLIAMENT|MISSION|SAYS)",
    r"IRANIAN\s+(?:MEDIA|AUTHORITIES|PRESIDENT|FOREIGN|MISSILE)",
    r"U\.?S\.?\s+(?:FORCES|RESCUE)",
    r"TRUMP\s+(?:THREATENS|SAYS|TELLS)",
    r"PRESIDENT\s+TRUMP",
    r"ISRAELI\s+(?:AIR|MILITARY|FORCES|ARMY|ATTACKS?)",
    r"GAZA\s+HEALTH",
    r"HAMAS\s+SAYS",
    r"LEBANESE\s+(?:ARMY|HEALTH)",
    r"LEBANON'?S?\s+HEALTH",
    r"MEDICS?\s+SAY",
    r"EIGHT\s+OPEC",
    r"QATAR|QATARI",
    r"D\.?R\.?\s+CONGO",
    r"RESCUE\s+CHARITIES",
    r"ARTEMIS",
    r"MULTIPLE\s+INJURIES",
    r"TWO\s+PEOPLE\s+KILLED",
    r"SIX\s+PEOPLE\s+INJURED",
    r"MORE\s+THAN\s+(?:A\s+)?DOZEN",
    r"WORLD\s+HEALTH",
    r"KUWAIT",
    r"BAHRAIN",
    r"STATE\s+MEDIA",
    r"AT\s+LEAST\s+\w+\s+PEOPLE",
    r"BREAKING\s+NEWS",
    r"(?:CHINA|RUSSIA|INDIA|INDONESIA|POLAND|UKRAINE|SUDAN|SAUDI|UAE)(?:'?S)?\s+[A-Z]",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def squeeze(c) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(replace(col(c), "[ \\t\\n\\r\\f\\x0B]+", " "))


def clean_text(c) -> Column:
    """Recognition noise removed, dashes and dots normalised, white space collapsed."""
    x = F.translate(col(c), NOISE, "")
    return squeeze(replace(replace(replace(x, "�", "'"), "[—–]", "-"), "\\.{2,}", "."))


def clean_text_raw(c) -> Column:
    """Like clean_text, but semicolons go too and dashes and dots stay."""
    return squeeze(F.translate(col(c), NOISE + ";", ""))


def strip_affixes(c) -> Column:
    """Without call-to-action trailers and the prefix of urgent items."""
    return F.trim(replace(F.trim(replace(col(c), TRAILER, "")), "(?i)^BREAKING[ \\t\\n\\r\\f]+NEWS[ \\t\\n\\r\\f]*", ""))


def strip_affixes_dash(c) -> Column:
    x = replace(replace(col(c), TRAILER, " "), "(?i)^BREAKING[ \\t\\n\\r\\f]+NEWS[ \\t\\n\\r\\f]*-?[ \\t\\n\\r\\f]*", "")
    return F.btrim(squeeze(x), F.lit("- "))


def strip_prefix_upper(c) -> Column:
    """Case-sensitive: only a prefix in capitals followed by white space."""
    return F.trim(replace(col(c), "^BREAKING[ \\t\\n\\r\\f]+NEWS[ \\t\\n\\r\\f]+", ""))


#: Letters but ß whose capital form is several letters, and their capital where it must be one letter: often themselves.
SPREAD = "".join(c for c in map(chr, range(0xE0, 0x10000)) if len(c.upper()) > 1)
SPREAD_TO = "".join(c.title() if len(c.title()) == 1 else c for c in SPREAD)


def upper_each(c) -> Column:
    """Upper case letter by letter, as SQL engines give it: no letter becomes two, so that ß (here ẞ) does not meet the word ss."""
    x, odd = F.translate(col(c), "ß", "ẞ"), f"[{SPREAD}]"
    each = F.transform(F.split(x, ""), lambda t: F.when(t.rlike(odd), F.translate(t, SPREAD, SPREAD_TO)).otherwise(F.upper(t)))
    return F.when(x.rlike(odd), F.array_join(each, "")).otherwise(F.upper(x))


def normalize(c) -> Column:
    return F.upper(squeeze(c))


def vlm_norm(c) -> Column:
    """Upper case, digits removed, anything but letters, underscores and spaces to spaces, collapsed."""
    return squeeze(replace(replace(F.upper(col(c)), "[0-9]+", ""), "(?U)[^\\w\\s]", " "))


def digit_strip(c, by: str = " ") -> Column:
    x = replace(col(c), "[0-9,.]", by)
    return squeeze(x) if by else x


def strip_timestamp(c) -> Column:
    return replace(col(c), "^\\[[0-9:.]+ --> [0-9:.]+\\][ \\t]*", "")


def content_lines(c) -> Column:
    """The lines that are neither blank nor comments, trimmed."""
    return F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def asr_normalize(c, hypothesis: bool = False) -> Column:
    lines = content_lines(c)
    lines = F.transform(lines, strip_timestamp) if hypothesis else lines
    return squeeze(replace(F.lower(F.array_join(lines, " ")), "(?U)[^\\w\\s']+", " "))


def words(c) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda x: x != "")


def word_prefix(c, n: int = 6, least: int = 4) -> Column:
    w = words(c)
    return F.when(F.size(w) >= least, F.array_join(F.slice(w, 1, n), " "))


def count_of(c, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.floor((F.length(col(c)) - F.length(F.replace(col(c), F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def find_delimiter(c, candidates=DELIMITERS) -> Column:
    """struct(delimiter, n): the most frequent candidate, the first of equals; the first with 0 if none occurs."""
    counted = F.array(*(F.struct(count_of(c, d).alias("n"), F.lit(-i).alias("p"), F.lit(d).alias("delimiter")) for i, d in enumerate(candidates)))
    best = F.array_max(counted)
    return F.struct(best["delimiter"].alias("delimiter"), best["n"].alias("n"))


def split_minlen(c, pattern: str = "[ \\t\\n\\r\\f]+-[ \\t\\n\\r\\f]+", least: int = 35) -> Column:
    return F.filter(F.transform(F.split(col(c), pattern), lambda x: F.trim(x)), lambda x: F.length(x) >= least)


def split_cycles(c, more_than: int = 100) -> Column:
    return F.filter(F.transform(F.split(col(c), CYCLE_MARK), lambda x: F.trim(x)), lambda x: F.length(x) > more_than)


def split_starts(c, starts=STARTS, least: int = 20) -> Column:
    """Items from one headline start to the next: trailing scraps trimmed, promotions and bare prefixes dropped."""
    text = clean_text_raw(c)
    marked = replace(text, "(?i)(" + "|".join(starts) + ")", "\u0001$1")
    parts = F.split(marked, "\u0001")
    raw = F.slice(parts, F.lit(2), F.size(parts))
    cut = F.transform(raw, lambda x: F.trim(replace(F.trim(x), " +\\S{1,2}$", "")))
    cut = F.filter(cut, lambda x: (F.length(x) >= least) & ~F.regexp_like(x, F.lit("(?i)^for +more")) & ~F.regexp_like(x, F.lit("(?i)^breaking +news *$")))
    return F.filter(F.transform(cut, strip_prefix_upper), lambda x: F.length(x) >= least)


def significant_numbers(c) -> Column:
    """Numbers of three digits and more, commas removed, without years 1900 to 2099; distinct, as decimal strings of any length."""
    found = F.transform(F.regexp_extract_all(col(c), F.lit("[0-9][0-9,]+"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    big = F.filter(found, lambda x: F.length(x) >= 3)
    plain = F.transform(big, lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0")))
    return F.array_distinct(F.filter(plain, lambda x: ~((F.length(x) == 4) & x.between("1900", "2099"))))


def strip_think(c) -> Column:
    return F.trim(replace(col(c), "(?s)<think>.*?</think>", ""))


def strip_fences(c) -> Column:
    return F.trim(replace(replace(F.trim(col(c)), "^```[a-zA-Z]*[ \\t\\n\\r]*", ""), "[ \\t\\n\\r]*```$", ""))


def count_class(c, pattern: str) -> Column:
    return F.length(replace(col(c), f"(?U)[^{pattern}]", ""))


def char_classes(c) -> Column:
    """Letters, capitals, digits, white space, other characters, share of capitals among letters."""
    letters, upper, digits, space = count_class(c, "\\p{Alpha}"), count_class(c, "\\p{Lu}"), count_class(c, "0-9"), count_class(c, " \\t\\n\\r\\f")
    return F.struct(letters.alias("letters"), upper.alias("upper"), digits.alias("digits"), space.alias("spaces"), (F.length(col(c)) - letters - digits - space).alias("others"), F.when(letters > 0, upper / letters).otherwise(F.lit(0.0)).alias("upper_ratio"))


def contains(c, query: str) -> Column:
    return F.contains(F.lower(col(c)), F.lower(F.lit(query)))


def numbered(items: Column, header: str) -> Column:
    """A prompt: a header, then one numbered line for each item."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat_ws("\n", F.lit(header), F.array_join(lines, "\n"))


def retryable(c) -> Column:
    x = F.lower(F.coalesce(col(c), F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(s)) for s in RETRYABLE))


def retry_delay(c) -> Column:
    found = F.regexp_extract(col(c), "retry_delay[ \\t\\n]*\\{[ \\t\\n]*seconds:[ \\t\\n]*([0-9]+)", 1)
    return F.when(found != "", found.cast("double")).otherwise(F.lit(0.0))


def first_filled(*cs) -> Column:
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs))


def srt_time(seconds, mark: str = ",") -> Column:
    ms = F.round(col(seconds) * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def duration(seconds) -> Column:
    s = F.floor(col(seconds)).cast("long")
    return F.format_string("%dm %ds", F.floor(s / 60), s % 60)


def token_cost(tokens_in, tokens_out, price_in, price_out, tokens_thinking=None, price_thinking=None) -> Column:
    """Cost of a call by prices a million tokens: 0 where either count is unknown; thinking tokens count where both they and
    their price are known."""
    part = lambda t, p: col(t) / 1_000_000 * col(p)
    cost = part(tokens_in, price_in) + part(tokens_out, price_out)
    if tokens_thinking is not None and price_thinking is not None:
        cost = cost + F.coalesce(part(tokens_thinking, price_thinking), F.lit(0.0))
    return F.when(col(tokens_in).isNull() | col(tokens_out).isNull(), F.lit(0.0)).otherwise(cost)


def throttle(rpm) -> Column:
    return 60.0 / F.greatest(F.lit(1), col(rpm))


BLANKS = " \t\n\r\f\u000b"


def _strings(variants: Column) -> Column:
    """The strings among variants, trimmed, none empty."""
    found = F.transform(F.filter(variants, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.btrim(F.variant_get(v, "$", "string"), F.lit(BLANKS)))
    return F.filter(found, lambda x: x != "")


def parsed_json(c: Column) -> Column:
    """A text as JSON, null where it is none. The parser stops after one value; with a second one behind it, text that follows the
    first is an error or a third."""
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit(", 0]"))), "$", "array<variant>")
    return F.when(F.size(both) == 2, F.get(both, 0))


def _listed(c: Column) -> Column:
    """The strings of the first "[" to the last "]", null where that is no JSON list."""
    return _strings(F.try_variant_get(parsed_json(F.regexp_extract(c, "(?s)\\[.*\\]", 0)), "$", "array<variant>"))


def _long_lines(c: Column) -> Column:
    """Lines of over 20 characters without bullets, commas and quotes around them."""
    bare = lambda x: F.btrim(F.btrim(F.btrim(F.btrim(F.ltrim(F.btrim(x, F.lit(BLANKS)), F.lit("-")), F.lit(BLANKS)), F.lit(",")), F.lit('"')), F.lit("'"))
    return F.filter(F.transform(F.split(c, "\r\n|[\n\r]"), bare), lambda x: F.length(x) > 20)


def bare_answer(c) -> Column:
    """A model's answer without code fences, wherever they stand, and backticks around it."""
    return F.btrim(F.btrim(replace(col(c), "```(?:json)?", ""), F.lit("`")), F.lit(BLANKS))


def json_strings(c) -> Column:
    """The string elements of the first "[" to the last "]", trimmed, none empty; lines over 20 characters where that is no JSON list."""
    return F.coalesce(_listed(col(c)), _long_lines(col(c)))


def json_strings_or_object(c) -> Column:
    """Of a model's answer: the strings of its list; where it has none, of the first list in the object from the first "{" to the
    last "}"; else its long lines."""
    text = bare_answer(c)
    body = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    of = F.when(parsed_json(body).isNotNull(), F.from_json(body, "map<string,variant>"))
    lists = F.filter(F.transform(F.map_values(of), lambda v: F.try_variant_get(v, "$", "array<variant>")), lambda a: a.isNotNull())
    return F.coalesce(_listed(text), _strings(F.get(lists, 0)), _long_lines(text))


HEADLINES = "struct<headlines:array<struct<text:string,confidence:string>>>"


def parse_headlines(c) -> Column:
    """Items of {"headlines": [...]}, strings or {text, confidence}: upper-case text; confidence high, medium or low, medium by
    default for strings and high for objects. The object is the whole answer if that is JSON, and only otherwise what stands
    from the first "{" to the last "}"; none where either is something else. Items of other kinds and without text are left out."""
    text = strip_fences(c)
    inner = parsed_json(F.regexp_extract(text, "(?s)\\{.*\\}", 0))
    items = F.try_variant_get(F.coalesce(parsed_json(text), inner), "$.headlines", "array<variant>")

    def one(v: Column) -> Column:
        plain, thing = F.schema_of_variant(v) == "STRING", F.schema_of_variant(v).startswith("OBJECT")
        said = F.when(plain, F.try_variant_get(v, "$", "string")).when(thing, F.try_variant_get(v, "$.text", "string"))
        given = F.lower(F.btrim(F.try_variant_get(v, "$.confidence", "string"), F.lit(BLANKS)))
        confidence = F.when(plain, F.lit("medium")).when(given.isin("high", "medium", "low"), given).otherwise(F.lit("high"))
        return F.struct(F.upper(F.btrim(said, F.lit(BLANKS))).alias("text"), confidence.alias("confidence"))

    found = F.filter(F.transform(items, one), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    return F.coalesce(found, F.array().cast("array<struct<text:string,confidence:string>>"))


def common_letters(a, b) -> Column:
    """How many characters two texts have in common, repeats included, whatever their order: no less than their LCS."""
    letters = lambda c: F.array_sort(F.filter(F.split(col(c), ""), lambda x: x != ""))
    numbered = lambda g: F.get(F.transform(F.array(g), lambda x: F.transform(x, lambda w, i: F.concat(w, (i - F.array_position(x, w)).cast("string")))), F.lit(0))
    return F.size(F.array_intersect(numbered(letters(a)), numbered(letters(b))))


def ideal_distance(c, ideal: int = 90) -> Column:
    return F.abs(F.length(col(c)) - ideal) / ideal
