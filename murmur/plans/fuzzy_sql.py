"""The SQL side of the fuzzy queries: expressions over string columns, relations, recursive greedy passes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from murmur.plans.common import wordlist
from murmur.plans.text_queries import IMPROVE_Q, MERGE_Q, V6, scored_sql

SENTENCES = """(SELECT conv_id, turn, i, trim(t) AS text FROM (
  SELECT conv_id, turn, unnest(string_split_regex(text, '[.\\n]+')) AS t, generate_subscripts(string_split_regex(text, '[.\\n]+'), 1) - 1 AS i FROM conversations
) WHERE trim(t) <> '')"""
PAIRS = f"(SELECT * FROM (SELECT conv_id, turn, i, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, i) AS b FROM {SENTENCES}) WHERE b IS NOT NULL)"

FAR = 1_000_000


def _thresholds(steps: str, after: str) -> str:
    """Length of the LCS: steps are [code] lists; after(p) is where the step's value is next after position p, 0 if nowhere."""
    at = "coalesce(k_[l_ - 1], 0)"
    return f"""len(list_reduce(list_prepend([]::INT[], {steps}), lambda k_, x_: list_filter(list_transform(range(1, len(k_) + 2), lambda l_: least(coalesce(k_[l_], {FAR}), CASE WHEN {after.format(at=at)} > 0 THEN {at} + {after.format(at=at)} ELSE {FAR} END)::INT), lambda v_: v_ < {FAR})))"""


def bound(f, *values: str) -> str:
    """f of these values, computed once each where they are more than a column."""
    if all(re.fullmatch(r"[\w.]+", v) for v in values):
        return f(*values)
    fields = ", ".join(f"z{i}: {v}" for i, v in enumerate(values))
    name = f"b{len(fields)}_"  # a lambda inside another one needs a name of its own
    return f"list_transform([{{{fields}}}], lambda {name}: {f(*(f'{name}.z{i}' for i in range(len(values))))})[1]"


def lcs(a: str, b: str) -> str:
    steps = f"list_transform(string_split({a}, ''), lambda c_: [ord(c_)])"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE {_thresholds(steps, f'instr(substr({b}, {{at}}::INT + 1), chr(x_[1]))')} END)"


def lcs_list(a: str, b: str) -> str:
    steps = f"list_transform(range(1, len({a}) + 1), lambda j_: [j_::INT])"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE {_thresholds(steps, f'coalesce(list_position({b}[{{at}} + 1:], {a}[x_[1]]), 0)')} END)"


def ratio(a: str, b: str) -> str:
    return bound(_ratio, a, b)


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 100.0 ELSE 200.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})) END)"


def token_sort(x: str) -> str:
    return f"array_to_string(list_sort(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ')), ' ')"


def token_set(a: str, b: str) -> str:
    x, y = (f"list_distinct({wordlist(c)})" for c in (a, b))
    text = lambda z: f"array_to_string(list_sort({z}), ' ')"
    both, one, two = f"list_intersect({x}, {y})", f"list_filter({x}, lambda w: NOT list_contains({y}, w))", f"list_filter({y}, lambda w: NOT list_contains({x}, w))"
    parts = f"[{{s: {text(both)}, p: {text(one)}, q: {text(two)}, e: len({x}) = 0 OR len({y}) = 0}}]"
    glue = lambda z: f"trim(v.s || ' ' || v.{z})"
    return f"""list_transform({parts}, lambda v: CASE WHEN v.e THEN 0.0 WHEN v.s <> '' AND (v.p = '' OR v.q = '') THEN 100.0
      ELSE greatest({ratio('v.p', 'v.q')}, CASE WHEN v.s <> '' THEN greatest({ratio('v.s', glue('p'))}, {ratio('v.s', glue('q'))}, {ratio(glue('p'), glue('q'))}) ELSE 0.0 END) END)[1]"""


def partial(a: str, b: str) -> str:
    return bound(_partial, a, b)


def _partial(a: str, b: str) -> str:
    """The best ratio of the shorter string with windows of the longer one, windows cut at its ends included."""
    def windows(s: str, t: str) -> str:
        n, m = f"length({s})", f"length({t})"
        whole = f"list_transform(range(1, {m} - {n} + 2), lambda w: substr({t}, w::INT, {n}::INT))"
        cut = f"list_concat(list_transform(range(1, {n}), lambda w: substr({t}, 1, w::INT)), list_transform(range(1, {n}), lambda w: substr({t}, ({m} - w + 1)::INT)))"
        return f"list_max(list_transform(list_concat({whole}, {cut}), lambda u: {ratio(s, 'u')}))"

    return f"(CASE WHEN {a} = '' OR {b} = '' THEN CASE WHEN {a} = {b} THEN 100.0 ELSE 0.0 END WHEN length({a}) < length({b}) THEN {windows(a, b)} WHEN length({a}) > length({b}) THEN {windows(b, a)} ELSE greatest({windows(a, b)}, {windows(b, a)}) END)"


UNIT = 1_000_000


def edits(a: str, b: str) -> str:
    """Edit distance of two lists times UNIT, less the most hits of an alignment of that distance."""
    start = f"list_transform(range(0, len({b}) + 1), lambda j_: j_ * {UNIT})"
    base = f"list_transform(range(1, len({b}) + 2), lambda j_: least(k_[j_] + {UNIT}, CASE WHEN j_ = 1 THEN k_[1] + {UNIT} WHEN {a}[x_[1]] = {b}[j_ - 1] THEN k_[j_ - 1] - 1 ELSE k_[j_ - 1] + {UNIT} END) - j_ * {UNIT})"
    row = f"list_transform([{base}], lambda h_: list_transform(range(1, len({b}) + 2), lambda j_: list_min(h_[1:j_]) + j_ * {UNIT}))[1]"
    return f"list_reduce(list_prepend({start}, list_transform(range(1, len({a}) + 1), lambda j_: [j_])), lambda k_, x_: {row})[-1]"


def letter_edits(a: str, b: str) -> str:
    """Edit distance of two texts by characters: the engine's own counts bytes, so each pair's characters are numbered first (up
    to 126 of them, which one byte each can hold; more make an error)."""
    chars = lambda x: f"string_split({x}, '')"
    named = lambda x: f"array_to_string(list_transform({chars(x)}, lambda c: chr(list_position(v_.z, c)::INT)), '')"
    return f"list_transform([{{z: list_distinct(list_concat({chars(a)}, {chars(b)}))}}], lambda v_: CASE WHEN len(v_.z) > 126 THEN error('too many characters') ELSE levenshtein({named(a)}, {named(b)}) END)[1]"


_TOKEN = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
TOKENS = f"(SELECT conv_id, turn, i, {_TOKEN.format('a')} AS x, {_TOKEN.format('b')} AS y FROM {PAIRS})"


def rouge(n: int) -> str:
    grams = lambda t: f"list_transform(range(1, len({t}) - {n} + 2), lambda j: array_to_string({t}[j:j + {n - 1}], ' '))"
    return f"""SELECT conv_id, turn, i, round(CASE WHEN hits > 0 THEN 2 * hits / (nx + ny) ELSE 0.0 END, 9) AS v FROM (
      SELECT conv_id, turn, i, len(x) AS nx, len(y) AS ny, coalesce(list_sum(list_transform(list_intersect(list_distinct(x), list_distinct(y)), lambda g: least(len(list_filter(x, lambda h: h = g)), len(list_filter(y, lambda h: h = g))))), 0) AS hits FROM (
        SELECT conv_id, turn, i, {grams('x')} AS x, {grams('y')} AS y FROM {TOKENS}))"""


# Relations that both engines read: a label for each part, and items of streams with a number in them.
TEXT = """CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN translate(upper(p_name), 'AEIO', '4310')
  WHEN 2 THEN concat(split_part(upper(p_name), ' ', 2), ' ', split_part(upper(p_name), ' ', 1)) WHEN 3 THEN concat('BREAKING NEWS ', upper(p_name))
  WHEN 4 THEN substr(upper(p_name), 2) WHEN 5 THEN concat(upper(p_type), ' ', upper(p_brand)) ELSE concat(upper(p_name), ' ', upper(p_type)) END"""
LABEL = {"p_partkey": "p_partkey", "stream": "p_size", "slice": "p_type", "kind": "p_partkey % 7", "text": TEXT}
LABELS = f"(SELECT {', '.join(f'{v} AS {k}' for k, v in LABEL.items())} FROM part)"
ITEM = {"stream": "p_size", "pos": "CAST(p_partkey AS BIGINT)", "chunk": "CAST(floor(p_partkey / 100) AS INT)", "text": f"concat({TEXT}, CASE WHEN p_partkey % 3 = 0 THEN concat(' AT ', CAST(900 + p_partkey % 4 * 350 AS STRING)) WHEN p_partkey % 3 = 1 THEN ' OF THE DAY' ELSE concat(' AND ', upper(p_name), ' TOO') END)"}
ITEMS = f"(SELECT {', '.join(f'{v} AS {k}' for k, v in ITEM.items())} FROM part)"

GT = "(SELECT min(p_partkey)::BIGINT AS id, upper(p_name) AS text FROM part GROUP BY p_name UNION ALL SELECT n_nationkey + 1000000000, upper(n_name) FROM nation)"
EXT = f"(SELECT p_partkey::BIGINT AS id, text, slice FROM {LABELS})"
SCORES = f"""(SELECT g.id AS gid, e.id AS eid, e.slice, score FROM {GT} g JOIN (
  SELECT a, b, greatest({ratio('a', 'b')}, {ratio(token_sort('a'), token_sort('b'))}) AS score FROM (SELECT DISTINCT text AS a FROM {GT}) CROSS JOIN (SELECT DISTINCT text AS b FROM {EXT})
) ON g.text = a JOIN {EXT} e ON e.text = b)"""
BEST_L = f"(SELECT gid AS id, eid AS match_id, score FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, eid) AS r FROM {SCORES}) WHERE r = 1)"
BEST_R = f"(SELECT eid AS id, gid AS match_id, score FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY score DESC, gid) AS r FROM {SCORES}) WHERE r = 1)"


def prf(by: str = "") -> str:
    """Counts and rates at 60, 70 and 80; by slice where one is named."""
    own, comma = (f"{by}, ", f", {by}") if by else ("", "")
    return f"""WITH s AS MATERIALIZED (SELECT * FROM {SCORES}), g AS (SELECT {own}gid, max(score) AS score FROM s GROUP BY gid{comma}), e AS (SELECT {own}eid, max(score) AS score FROM s GROUP BY eid{comma}),
      t AS (SELECT unnest([60, 70, 80]) AS threshold), n AS (SELECT {own}count(*) AS n_ext, (SELECT count(*) FROM {GT}) AS n_gt FROM {EXT}{f' GROUP BY {by}' if by else ''}),
      c AS (SELECT n.*, threshold, (SELECT count(*) FROM g WHERE g.score >= t.threshold{f' AND g.{by} = n.{by}' if by else ''}) AS tp_gt, (SELECT count(*) FROM e WHERE e.score >= t.threshold{f' AND e.{by} = n.{by}' if by else ''}) AS tp_ext FROM n, t)
    SELECT {own}threshold::INT AS threshold, tp_gt, tp_ext, n_gt - tp_gt AS fn, n_ext - tp_ext AS fp, round(tp_ext / n_ext, 9) AS precision, round(tp_gt / n_gt, 9) AS recall,
      round(CASE WHEN tp_ext + tp_gt > 0 THEN 2 * (tp_ext / n_ext) * (tp_gt / n_gt) / (tp_ext / n_ext + tp_gt / n_gt) ELSE 0.0 END, 9) AS f1 FROM c"""


def rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


# The dup predicates, each by its own thresholds.
def _len_ratio(a: str, b: str) -> str:
    return f"least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b}))"


def _sorted(a: str, b: str) -> str:
    return ratio(token_sort(a), token_sort(b))


def _any(a: str, b: str, plain: float, by_words: float | None, length: float, part: float) -> str:
    more = f" OR {_sorted(a, b)} > {by_words}" if by_words else ""
    return f"CASE WHEN {ratio(a, b)} > {plain}{more} THEN true WHEN {_len_ratio(a, b)} > {length} THEN {partial(a, b)} > {part} ELSE false END"


def _numbers(x: str) -> str:
    return f"list_filter(list_transform(list_filter(list_transform(regexp_extract_all({x}, '[0-9][0-9,]+'), lambda n: replace(n, ',', '')), lambda n: length(n) >= 3), lambda n: n::HUGEINT), lambda n: n NOT BETWEEN 1900 AND 2099)"


def _apart(a: str, b: str) -> str:
    x, y = _numbers(a), _numbers(b)
    return f"(len({x}) > 0 AND len({y}) > 0 AND NOT list_has_any({x}, {y}))"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[0-9,.]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[0-9,.]', '', 'g')"


def _prefix(a: str, b: str, limit: float) -> str:
    head = lambda x: f"array_to_string({wordlist(x)}[1:6], ' ')"
    return f"(len({wordlist(a)}) >= 4 AND len({wordlist(b)}) >= 4 AND {ratio(head(a), head(b))} > {limit})"


def _improve(a: str, b: str) -> str:
    x, y = _plain(a), _plain(b)
    return f"CASE WHEN {_any(a, b, 50, 55, 0.35, 70)} THEN true WHEN length({x}) > 15 AND length({y}) > 15 AND {_any(x, y, 55, 60, 0.4, 75)} THEN true ELSE {_prefix(x, y, 65)} END"


def _chunks(a: str, b: str) -> str:
    x, y = _bare(a), _bare(b)
    return f"CASE WHEN {_any(a, b, 50, 55, 0.3, 70)} THEN true ELSE {ratio(x, y)} > 55 OR {_prefix(x, y, 65)} END"


SAME = {
    "v6": lambda a, b: f"CASE WHEN {_apart(a, b)} THEN false ELSE {_any(a, b, 60, 60, 0.5, 80)} END",
    "improve": _improve,
    "chunks": _chunks,
    "clean": lambda a, b: _any(f"lower({a})", f"lower({b})", 70, None, 0.5, 85),
    "longest": lambda a, b: _any(f"lower({a})", f"lower({b})", 70, None, 0.3, 85),
    "aggregate": lambda a, b: f"CASE WHEN {token_set(a, b)} >= 80 THEN true ELSE {partial(a, b)} >= 88 END",
}
_SCORED = {"v6": f"(SELECT *, {V6} AS quality FROM {ITEMS})", "improve": f"(SELECT *, round({IMPROVE_Q}, 9) AS quality FROM {scored_sql(5, 6, 16, ITEMS)})", "chunks": f"(SELECT *, round({MERGE_Q}, 9) AS quality FROM {scored_sql(4, 5, 1000000, ITEMS)})"}
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(upper(text), '[0-9]+', '', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_DIST = "abs(length(text) - 90) / 90"
_ORDER = {"v6": "quality DESC, pos", "improve": f"quality DESC, {_DIST}, pos", "chunks": "size DESC, length(text) DESC, pos", "clean": "pos", "longest": "length(text) DESC, text, pos", "aggregate": "length(text) DESC, text, pos"}
# Whether a new item (n) takes the place of the kept one (o).
_BETTER = {
    "v6": "length(n.text) > length(o.text) AND length(n.text) < 130 AND n.quality > 0.85",
    "improve": "n.quality > o.quality + 0.05 OR abs(n.quality - o.quality) < 0.05 AND abs(length(n.text) - 90) / 90 < abs(length(o.text) - 90) / 90 - 0.1",
    "chunks": "n.quality > o.quality + 0.03 OR abs(n.quality - o.quality) <= 0.03 AND length(n.text) > 1.15::DOUBLE * length(o.text) AND length(n.text) < 200",
}


def links(rule: str) -> str:
    """For each item the smallest position of its stream with the same text, and how many other items of its stream a predicate
    holds with; each pair of texts is judged once."""
    return f"""WITH c AS MATERIALIZED (SELECT stream, text, min(pos) AS class_id, count(*) AS n FROM {ITEMS} GROUP BY 1, 2),
      p AS MATERIALIZED (SELECT a.stream, a.text AS x, b.text AS y, a.n AS nx, b.n AS ny FROM c a JOIN c b ON a.stream = b.stream AND a.text < b.text),
      t AS MATERIALIZED (SELECT x, y FROM (SELECT DISTINCT x, y FROM p) WHERE {SAME[rule]('x', 'y')}),
      l AS (SELECT stream, text, sum(n)::BIGINT AS links FROM (SELECT stream, x AS text, ny AS n FROM p JOIN t USING (x, y) UNION ALL SELECT stream, y, nx FROM p JOIN t USING (x, y)) GROUP BY 1, 2)
    SELECT i.stream, pos, class_id, n - 1 + coalesce(links, 0) AS n_links FROM {ITEMS} i JOIN c ON c.stream = i.stream AND c.text = i.text LEFT JOIN l ON l.stream = c.stream AND l.text = c.text"""


def greedy(rule: str, counts: bool = False) -> str:
    """The greedy pass of each stream: items in order, each held against the kept ones, the first that is the same decides."""
    text = _NORM if rule == "aggregate" else "text"
    rel = f"(SELECT stream, pos, chunk, {text} AS text, {'quality' if rule in _SCORED else '0.0 AS quality'} FROM {_SCORED.get(rule, ITEMS)})"
    return f"""WITH RECURSIVE
      i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY {_ORDER[rule]}) AS r FROM (SELECT *, sum(length(text)) OVER (PARTITION BY stream, chunk) AS size FROM {rel})),
      t AS MATERIALIZED (SELECT a, b, {SAME[rule]('a', 'b')} AS same FROM (SELECT DISTINCT least(n.text, o.text) AS a, greatest(n.text, o.text) AS b FROM i n JOIN i o ON n.stream = o.stream AND o.r < n.r)),
      d AS MATERIALIZED (SELECT n.stream, n.r, list(o.r) AS same, list(o.r) FILTER (WHERE {_BETTER.get(rule, 'false')}) AS better FROM i n JOIN i o ON n.stream = o.stream AND n.r <> o.r JOIN t ON a = least(n.text, o.text) AND b = greatest(n.text, o.text) WHERE t.same GROUP BY ALL),
      g AS (SELECT DISTINCT stream, 0::BIGINT AS step, []::BIGINT[] AS kept, 0 AS dropped, 0 AS replaced FROM i
        UNION ALL SELECT stream, r, CASE WHEN hit IS NULL THEN list_append(kept, r) WHEN takes THEN list_transform(kept, lambda k: CASE WHEN k = hit THEN r ELSE k END) ELSE kept END, dropped + (hit IS NOT NULL AND NOT takes)::INT, replaced + (hit IS NOT NULL AND takes)::INT
        FROM (SELECT *, coalesce(list_contains(better, hit), false) AS takes FROM (SELECT g.stream, i.r, kept, dropped, replaced, better, list_filter(kept, lambda k: list_contains(same, k))[1] AS hit FROM g JOIN i ON i.stream = g.stream AND i.r = g.step + 1 LEFT JOIN d ON d.stream = i.stream AND d.r = i.r))),
      f AS (SELECT stream, dropped, replaced, unnest(kept) AS r, generate_subscripts(kept, 1) AS kept_pos FROM (SELECT *, max(step) OVER (PARTITION BY stream) AS last FROM g) WHERE step = last)
    """ + (
        "SELECT stream, count(*) AS kept, max(dropped)::BIGINT AS dropped, max(replaced)::BIGINT AS replaced FROM f GROUP BY stream"
        if counts else "SELECT f.stream, pos, text, kept_pos FROM f JOIN i USING (stream, r)"
    )


_WORDS = wordlist("text")
ARTIFACTS = f"""WITH i AS (SELECT stream, pos, text, {_WORDS} AS w, len({_WORDS}) // 2 AS mid FROM {ITEMS}),
  p AS (SELECT x.stream, x.pos, y.pos AS other, {ratio("array_to_string(x.w[1:x.mid], ' ')", "array_to_string(y.w[1:x.mid], ' ')")} > 65 AS head,
    {ratio("array_to_string(x.w[x.mid + 1:], ' ')", "array_to_string(y.w[greatest(len(y.w) - x.mid + 1, 1):], ' ')")} > 65 AS tail
    FROM i x JOIN i y ON x.stream = y.stream AND x.pos <> y.pos WHERE length(x.text) >= 30 AND len(x.w) >= 4)
  SELECT stream, pos, text FROM i JOIN (SELECT stream, pos FROM p GROUP BY stream, pos HAVING bool_or(head) AND bool_or(tail) AND bool_or(head AND NOT tail)) USING (stream, pos)"""
