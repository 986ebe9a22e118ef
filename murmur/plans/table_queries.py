"""Queries over windows, geometry, aggregates, runs and set operations.

Frames are events: a stream for each user, in the order of (ts, event_id). Windows are partitioned by the stream, so that
none runs in a single task. Runs are conversations: conv_id the run, role the model, turn the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmur.operators import dedup as D
from murmur.operators import frames as K
from murmur.operators import geometry as G
from murmur.operators import runs as R
from murmur.operators.rounds import folder, ranked
from murmur.functions import text as T
from murmur.plans.common import table
from murmur.plans.registry import query
from murmur.sources import pcm
from murmur.sources import readers as I
from murmur.sources import writers as O
from murmur.streaming import jobs as J

def _frames(spark, d):
    return K.positions(table(spark, d, "events"), "user_id", ("ts", "event_id"))


def _ranked(rows, by, *order):
    """The rank of each document in its group, by range partitions, so that no task holds a whole group."""
    return ranked(rows, [by], [F.col(c) if isinstance(c, str) else c for c in order], "r").select("doc_id", F.col("r").cast("int").alias("r"))


FRAMES = "(SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS pos FROM events)"
OPEN = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"

@query("sample_every_n", f"SELECT event_id, user_id, pos FROM {FRAMES} AS f WHERE pos % 5 = 0 AND value > 2")
def sample_every_n(spark, d):
    return K.every_nth(_frames(spark, d), 5, F.col("value") > 2).select("event_id", "user_id", "pos")


@query("assign_ids", f"SELECT event_id, user_id, pos + 1 AS id FROM {FRAMES} AS f")
def assign_ids(spark, d):
    return K.positions(table(spark, d, "events"), "user_id", ("ts", "event_id"), "id", 1).select("event_id", "user_id", "id")


@query("batch_ids", f"SELECT event_id, user_id, CAST(floor(pos / 15) AS BIGINT) AS batch FROM {FRAMES} AS f")
def batch_ids(spark, d):
    return _frames(spark, d).select("event_id", "user_id", K.batch(15).alias("batch"))


@query("confidence_filter", "SELECT event_id, event_type, value FROM events WHERE value / 10 > CASE event_type WHEN 'click' THEN 0.2 WHEN 'view' THEN 0.3 WHEN 'error' THEN 0.5 ELSE 0.3 END")
def confidence_filter(spark, d):
    x = K.over_floor(table(spark, d, "events"), "event_type", F.col("value") / 10, {"click": 0.2, "view": 0.3, "error": 0.5}, 0.3)
    return x.select("event_id", "event_type", "value")


@query("confidence_stats", "SELECT event_type, round(avg(value) * 100, 6) AS avg_conf, min(value) * 100 AS min_conf, max(value) * 100 AS max_conf, round(quantile_cont(value, 0.5) * 100, 6) AS median_conf FROM events GROUP BY event_type")
def confidence_stats(spark, d):
    x = K.percentages(table(spark, d, "events"), "event_type", "value")
    return x.withColumns({"avg_conf": F.round("avg_conf", 6), "median_conf": F.round("median_conf", 6)})


@query("bucket_min_max", f"SELECT user_id, CAST(floor(pos / 8) AS BIGINT) AS bucket, min(value) AS low, max(value) AS high FROM {FRAMES} AS f GROUP BY user_id, CAST(floor(pos / 8) AS BIGINT) HAVING count(*) = 8")
def bucket_min_max(spark, d):
    return K.bucket_min_max(_frames(spark, d), "user_id", "value", 8)


@query("fill_rate", "SELECT event_type, CAST(count(CASE WHEN value > 5 THEN 1 END) AS BIGINT) AS filled, count(*) AS total, count(CASE WHEN value > 5 THEN 1 END) / greatest(count(*), 1) AS rate FROM events GROUP BY event_type")
def fill_rate(spark, d):
    return K.fill_rate(table(spark, d, "events"), "event_type", F.col("value") > 5)


@query("first_write_wins", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) AS w WHERE r = 1")
def first_write_wins(spark, d):
    x = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return K.first_write_wins(x, ["user_id", "event_type"], ("ts", "event_id")).drop("ts")


@query("delta_stats", f"SELECT user_id, count(d) AS n, round(avg(d), 6) AS mean, min(d) AS low, max(d) AS high, round(quantile_cont(d, 0.5), 6) AS median FROM (SELECT user_id, value - lag(value) {OPEN} AS d FROM events) AS x GROUP BY user_id")
def delta_stats(spark, d):
    x = K.deltas(table(spark, d, "events"), "user_id", ("ts", "event_id"), "value")
    return x.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("even_sample", f"SELECT DISTINCT user_id, pos FROM (SELECT f.*, count(*) OVER (PARTITION BY user_id) AS n FROM {FRAMES} AS f) AS g JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11) AS k ON pos = CAST(floor(i * (n - 1) / 11) AS BIGINT)")
def even_sample(spark, d):
    return K.even_sample(_frames(spark, d), "user_id").select("user_id", "pos")


@query("running_eta", f"SELECT event_id, user_id, round(elapsed, 3) AS elapsed, round(elapsed / (pos + 1) * (n - pos - 1), 9) AS eta FROM (SELECT event_id, user_id, pos, CAST(sum(value::DECIMAL(18, 6)) OVER (PARTITION BY user_id ORDER BY pos) AS DOUBLE) AS elapsed, count(*) OVER (PARTITION BY user_id) AS n FROM {FRAMES} AS f) AS g")
def running_eta(spark, d):
    x = K.progress(_frames(spark, d).withColumn("spent", F.col("value").cast("decimal(18,6)")), "user_id", "spent")
    return x.select("event_id", "user_id", F.round("elapsed", 3).alias("elapsed"), F.round("eta", 9).alias("eta"))


@query("renumber_segments", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY chunk, ts, event_id) AS BIGINT) - 1 AS segment, secs + chunk * 3600 AS start_sec FROM (SELECT *, CAST(floor(event_id / 1000) AS BIGINT) AS chunk, event_id % 1000 AS secs FROM events) AS c")
def renumber_segments(spark, d):
    x = table(spark, d, "events").withColumns({"chunk": F.floor(F.col("event_id") / 1000), "secs": F.col("event_id") % 1000})
    return K.renumber(x, "user_id", "chunk", ("ts", "event_id"), "secs", 3600).select("event_id", "user_id", "segment", "start_sec")


@query("ordered_concat", "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text FROM events GROUP BY user_id")
def ordered_concat(spark, d):
    return K.ordered_text(table(spark, d, "events"), "user_id", ("ts", "event_id"), "event_type")


@query("chunk_15min", "SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS segments, round(sum(value), 4) AS total FROM events GROUP BY 1")
def chunk_15min(spark, d):
    return K.windows(table(spark, d, "events"), "ts", "15 minutes", total=F.round(F.sum("value"), 4))


@query("sliding_windows", "SELECT start, count(*) AS segments FROM (SELECT unnest([time_bucket(INTERVAL '15 minutes', ts), time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes']) AS start FROM events) GROUP BY 1")
def sliding_windows(spark, d):
    return K.windows(table(spark, d, "events"), "ts", "30 minutes", "15 minutes")


@query("chunk_ranges", "SELECT p_partkey, i::INT AS chunk, (i * 7)::INT AS start_pos, least((i + 1) * 7, p_size)::INT AS end_pos FROM (SELECT p_partkey, p_size, unnest(range(0, greatest(1, ceil(p_size / 7))::BIGINT)) AS i FROM part)")
def chunk_ranges(spark, d):
    return K.chunk_ranges(table(spark, d, "part"), "p_size", 7).select("p_partkey", "chunk", "start_pos", "end_pos")




@query("tile_starts", "SELECT p_partkey, unnest(CASE WHEN w <= 3000 THEN [0] ELSE list_sort(list_distinct(list_concat(list_filter(range(0, w, 2000), lambda s: s + 3000 <= w), [w - 3000]))) END)::INT AS tile FROM (SELECT p_partkey, (p_size * 400)::BIGINT AS w FROM part)")
def tile_starts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(G.tile_starts(F.col("p_size") * 400, 3000, 1000)).alias("tile"))


@query("overlap_center_band", """SELECT l_orderkey, l_linenumber, x, s AS slice FROM (SELECT l_orderkey, l_linenumber, x, w, unnest(starts) AS s, starts FROM (
  SELECT *, list_filter(range(0, greatest(w, 1), 1500), lambda v: v = 0 OR w - v >= 500) AS starts FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 37 % 20000)::BIGINT AS x, 20000::BIGINT AS w FROM lineitem)))
  WHERE x >= s AND x < s + 3000 AND (s = 0 OR x - s >= 750) AND (s = list_max(starts) OR x - s < 2250)""")
def overlap_center_band(spark, d):
    """Words at x on a strip 20,000 wide: the slices (3000 wide, every 1500, tail of 500 at least) whose centre band holds them."""
    words = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 37 % 20000).alias("x"))
    return G.center_band(words, "x", F.lit(20000).cast("long")).select("l_orderkey", "l_linenumber", "x", "slice")


@query("interval_overlap_join", "SELECT o_orderkey, p_partkey FROM (SELECT o_orderkey, o_custkey * 100 AS a, o_custkey * 100 + o_orderkey % 300 AS b FROM orders) JOIN (SELECT p_partkey, p_partkey * 90 AS s, p_partkey * 90 + 100 AS e FROM part) ON b > s AND a < e")
def interval_overlap_join(spark, d):
    left = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 100).alias("a"), (F.col("o_custkey") * 100 + F.col("o_orderkey") % 300).alias("b"))
    right = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 90).alias("s"), (F.col("p_partkey") * 90 + 100).alias("e"))
    return G.interval_join(left, right, ("a", "b"), ("s", "e"), 400).select("o_orderkey", "p_partkey")


@query("merge_ordered_tokens", "SELECT l_suppkey, string_agg(token, ' ' ORDER BY x, src, pos) AS text FROM (SELECT l_suppkey, l_partkey AS x, 0 AS src, l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS token FROM lineitem UNION ALL SELECT s_suppkey, s_nationkey * 100, 1, s_suppkey, '-' FROM supplier) GROUP BY 1")
def merge_ordered_tokens(spark, d):
    words = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("x"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("token"))
    marks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") * 100).cast("long").alias("x"), F.col("s_suppkey").alias("pos"), F.lit("-").alias("token"))
    return G.merge_tokens([words, marks], "l_suppkey").select("l_suppkey", "text")


SCROLL = f"(SELECT event_id, user_id, ts, CASE WHEN abs(d) < 0.3 THEN 0.0 ELSE coalesce(d, 0.0) END AS shift FROM (SELECT *, value - lag(value) {OPEN} AS d FROM events))"


@query("scroll_offsets", f"SELECT event_id, user_id, round(shift, 6) AS shift, round(sum(shift) {OPEN}, 4) AS cumulative FROM {SCROLL}")
def scroll_offsets(spark, d):
    return G.offsets(table(spark, d, "events"), "user_id", ("ts", "event_id"), "value", 0.3).select("event_id", "user_id", F.round("shift", 6).alias("shift"), F.round("cumulative", 4).alias("cumulative"))


@query("scroll_stats", f"SELECT user_id, round(sum(shift), 4) AS total, round(coalesce(avg(CASE WHEN shift <> 0 THEN shift END), 0), 6) AS mean_moved, count(CASE WHEN shift = 0 THEN 1 END) AS still, count(*) AS n FROM {SCROLL} GROUP BY user_id")
def scroll_stats(spark, d):
    x = G.offsets(table(spark, d, "events"), "user_id", ("ts", "event_id"), "value", 0.3)
    moved = F.when(F.col("shift") != 0, F.col("shift"))
    return x.groupBy("user_id").agg(F.round(F.sum("shift"), 4).alias("total"), F.round(F.coalesce(F.avg(moved), F.lit(0.0)), 6).alias("mean_moved"), F.count_if(F.col("shift") == 0).alias("still"), F.count("*").alias("n"))


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, upper(replace(text, 'ß', 'ss')) AS text FROM documents GROUP BY 2")
def dedup_exact(spark, d):
    return D.exact_upper(table(spark, d, "documents"), "text", "doc_id")


@query("distinct_ordered_union", "SELECT text, p.part AS part, p.pos AS pos FROM (SELECT text, min({'part': part, 'pos': pos}) AS p FROM (SELECT text, 0 AS part, doc_id AS pos FROM documents UNION ALL SELECT text, 1, item_id FROM benchmark) AS u GROUP BY text)")
def distinct_ordered_union(spark, d):
    """Each text once, at its first place: by table, then by position in it."""
    docs = table(spark, d, "documents").select("text", F.struct(F.lit(0).alias("part"), F.col("doc_id").alias("pos")).alias("p"))
    more = table(spark, d, "benchmark").select("text", F.struct(F.lit(1).alias("part"), F.col("item_id").alias("pos")).alias("p"))
    return docs.union(more).groupBy("text").agg(F.min("p").alias("p")).select("text", "p.part", "p.pos")


@query("union_all_tagged", "SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def union_all_tagged(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    return docs.union(table(spark, d, "benchmark").select(F.lit("benchmark"), "item_id", "text"))


@query("sort_longest", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, text, doc_id) AS INT) AS r FROM documents")
def sort_longest(spark, d):
    return _ranked(table(spark, d, "documents").select("doc_id", "source", "text"), "source", F.desc(F.length("text")), "text", "doc_id")


@query("sort_chunk_len", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY size DESC, length(text) DESC, doc_id) AS INT) AS r FROM (SELECT *, sum(length(text)) OVER (PARTITION BY source) AS size FROM documents) AS x")
def sort_chunk_len(spark, d):
    x = table(spark, d, "documents")
    sizes = x.groupBy("source").agg(F.sum(F.length("text")).alias("size")).withColumnRenamed("source", "s")
    x = x.join(sizes, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "lang", "size", F.length("text").alias("n"))
    return _ranked(x, "lang", F.desc("size"), F.desc("n"), "doc_id")


@query("sort_quality", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, 0) DESC, abs(length(text) - 90), pos) AS INT) AS r FROM (SELECT d.doc_id, d.source, d.text, l.quality, d.doc_id AS pos FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id) AS x")
def sort_quality(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    x = x.select("doc_id", "source", F.coalesce("quality", F.lit(0)).alias("quality"), F.abs(F.length("text") - 90).alias("off"))
    return _ranked(x, "source", F.desc("quality"), "off", "doc_id")


@query("chunk_sizes", "SELECT source, CAST(sum(length(text)) AS BIGINT) AS size, count(*) AS n FROM documents GROUP BY source")
def chunk_sizes(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).cast("long").alias("size"), F.count("*").alias("n"))


@query("adaptive_threshold", "SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) AS c WHERE n >= (SELECT greatest(10, CAST(floor(quantile_cont(n, 0.5) / 3) AS BIGINT)) FROM (SELECT count(*) AS n FROM documents GROUP BY source) AS m)")
def adaptive_threshold(spark, d):
    return K.above_share_of_median(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "n", 10, 1 / 3)



CYCLES = """(SELECT *, n = 0 OR n = total - 1 AS edge, CASE WHEN k < 10 THEN k / 10 WHEN k > 35 THEN 35 / k ELSE 1.0 END * CASE WHEN n = 0 OR n = total - 1 THEN 0.3 ELSE 1.0 END * CASE WHEN len < 500 THEN 0.2 WHEN len > 4000 THEN 3000 / len ELSE 1.0 END AS score FROM (
  SELECT doc_id, pos, text, length(text) AS len, (length(text) - length(replace(text, ', ', ''))) // 2 AS k, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM (
    SELECT doc_id, generate_subscripts(p, 1) AS pos, trim(unnest(p)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE length(text) > 100))"""


def _cycles(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).select("doc_id", "pos", F.trim("t").alias("text")).where(F.length("text") > 100)
    return G.scored_cycles(lines, "doc_id", ", ")


@query("best_cycle", f"SELECT doc_id, n::BIGINT AS cycle, round(score::DOUBLE, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC) AS r FROM {CYCLES}) WHERE r = 1")
def best_cycle(spark, d):
    return _cycles(spark, d).where("rank = 1").select("doc_id", "cycle", F.round("score", 6).alias("score"))


@query("topk_cycles", f"SELECT doc_id, r::INT AS rank, n::BIGINT AS cycle FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC) AS r FROM {CYCLES}) WHERE r <= 3")
def topk_cycles(spark, d):
    return _cycles(spark, d).where("rank <= 3").select("doc_id", "rank", "cycle")


RUN = "(SELECT conv_id, role, turn, CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 7 = 6 THEN CAST('NaN' AS DOUBLE) ELSE length(text) / 10.0 END AS m FROM conversations)"
CLEAN = "CASE WHEN isnan(m) THEN NULL ELSE m END"


def _runs(spark, d):
    x = table(spark, d, "conversations")
    return x.select("conv_id", "role", "turn", F.when(F.col("turn") % 5 == 4, None).when(F.col("turn") % 7 == 6, F.lit(float("nan"))).otherwise(F.length("text") / F.lit(10.0)).alias("m"))


@query("mean_std_runs", f"SELECT role, round(avg({CLEAN}), 6) AS mean, round(CASE WHEN count({CLEAN}) > 0 THEN coalesce(stddev_samp({CLEAN}), 0) END, 6) AS std, count({CLEAN}) AS n FROM {RUN} GROUP BY role")
def mean_std_runs(spark, d):
    """Without values, the mean and deviation are null here (NaN in reports)."""
    x = _runs(spark, d).groupBy("role").agg(*R.mean_std("m"))
    return x.select("role", F.round(F.nanvl("mean", F.lit(None)), 6).alias("mean"), F.round(F.nanvl("std", F.lit(None)), 6).alias("std"), "n")


@query("variance_report", f"SELECT conv_id, role, round(coalesce(avg({CLEAN}), 0), 6) AS mean, round(coalesce(stddev_samp({CLEAN}), 0), 6) AS std, count({CLEAN}) AS n, CASE WHEN count({CLEAN}) < 3 THEN 'n<3' END AS note FROM {RUN} GROUP BY conv_id, role")
def variance_report(spark, d):
    x = R.variance_report(_runs(spark, d), ["conv_id", "role"], "m")
    return x.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("two_level_rollup", f"SELECT role, round(avg(mean), 6) AS mean, count(*) AS n_runs FROM (SELECT role, conv_id, avg({CLEAN}) AS mean FROM {RUN} GROUP BY role, conv_id) GROUP BY role")
def two_level_rollup(spark, d):
    return R.two_level(_runs(spark, d), "role", "conv_id", "m").withColumn("mean", F.round("mean", 6))


@query("macro_mean", f"SELECT turn, round(avg({CLEAN}), 6) AS mean FROM {RUN} AS r WHERE role IN ('user', 'assistant') GROUP BY turn")
def macro_mean(spark, d):
    x = _runs(spark, d).where(F.col("role").isin("user", "assistant"))
    return x.groupBy("turn").agg(F.round(F.avg(R.present("m")), 6).alias("mean"))




@query("leaderboard", "SELECT conv_id, row_number() OVER (PARTITION BY n_turns ORDER BY chars DESC, conv_id)::INT AS rank, n_turns, chars FROM (SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id)")
def leaderboard(spark, d):
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).cast("long").alias("chars"))
    return R.leaderboard(x, "chars", ["n_turns"], ["conv_id"]).select("conv_id", "rank", "n_turns", "chars")


STATUS = "(SELECT conv_id, role, turn, text, CASE WHEN turn % 4 = 3 THEN 'error' ELSE 'success' END AS status, CASE turn % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'original' ELSE 'chunked' END AS label FROM conversations)"


def _status(spark, d):
    x = table(spark, d, "conversations")
    return x.withColumns({"status": F.when(F.col("turn") % 4 == 3, "error").otherwise("success"), "label": F.when(F.col("turn") % 3 == 0, "retry").when(F.col("turn") % 3 == 1, "original").otherwise("chunked")})


@query("status_counts", f"SELECT role, count(CASE WHEN status = 'success' THEN 1 END) AS ok, count(CASE WHEN status <> 'success' THEN 1 END) AS failed FROM {STATUS} AS s GROUP BY role")
def status_counts(spark, d):
    return R.status_counts(_status(spark, d), "role")


@query("filter_success", f"SELECT conv_id, turn, text FROM {STATUS} AS s WHERE status = 'success' AND trim(text) <> ''")
def filter_success(spark, d):
    return R.succeeded(_status(spark, d), "text").select("conv_id", "turn", "text")


@query("having_coverage", f"SELECT conv_id, count(*) AS n FROM {STATUS} AS s WHERE status = 'success' GROUP BY conv_id HAVING count(*) >= 4")
def having_coverage(spark, d):
    return R.covered(_status(spark, d), "conv_id", 4)




@query("merge_runs_latest_success", f"SELECT conv_id, role, turn, label, status FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY CASE WHEN status = 'success' THEN 1 ELSE 0 END DESC, label DESC, turn DESC) AS r FROM {STATUS}) WHERE r = 1")
def merge_runs_latest_success(spark, d):
    return R.latest_success(_status(spark, d), ["conv_id", "role"], precedence="label", tie="turn").select("conv_id", "role", "turn", "label", "status")


@query("anti_resume", f"SELECT conv_id, turn FROM {STATUS} WHERE status <> 'success'")
def anti_resume(spark, d):
    """Units of work without a successful record; failed ones are tried again."""
    units = table(spark, d, "conversations").select("conv_id", "turn")
    return R.unfinished(units, _status(spark, d).withColumn("error", F.when(F.col("status") == "error", "x")), ["conv_id", "turn"])


@query("cost_rollup", "SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS tokens, round(sum(l_extendedprice), 2) AS usd, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def cost_rollup(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_returnflag")
    return x.agg(F.sum("l_quantity").cast("long").alias("tokens"), F.round(F.sum("l_extendedprice"), 2).alias("usd"), F.count("*").alias("n"))


@query("left_join_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
def left_join_default(spark, d):
    return R.with_defaults(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": -1}).select("doc_id", "quality", "toxic")


@query("ordered_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ordered_lookup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("pivot_variants", "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'view' THEN 1 END) AS view_, count(CASE WHEN event_type = 'error' THEN 1 END) AS error FROM events GROUP BY user_id")
def pivot_variants(spark, d):
    return K.counts_by(table(spark, d, "events"), "user_id", "event_type", {"click": "click", "view": "view_", "error": "error"})


@query("sample_first_n", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) AS x WHERE r <= 60")
def sample_first_n(spark, d):
    return K.first_of_each(table(spark, d, "documents"), "source", ("doc_id",), 60).select("doc_id", "source")


@query("cross_fanout", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_fanout(spark, d):
    return table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(table(spark, d, "region").select("r_name")))


@query("semi_selected", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def semi_selected(spark, d):
    n = table(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("removal_guard", "SELECT d.doc_id FROM documents AS d CROSS JOIN (SELECT count(CASE WHEN quality = 1 THEN 1 END) AS kept, count(*) AS total FROM labels) AS g LEFT JOIN labels AS l ON d.doc_id = l.doc_id WHERE kept * 2 < total OR coalesce(l.quality, 1) = 1")
def removal_guard(spark, d):
    marks = table(spark, d, "labels")
    x = table(spark, d, "documents").join(marks.select("doc_id", "quality"), "doc_id", "left")
    return K.removal_guard(x, F.coalesce("quality", F.lit(1)) == 1, marks.select((F.col("quality") == 1).alias("kept"))).select("doc_id")




@query("zip_positional", "SELECT a.conv_id, a.n AS pos, a.text AS question, b.text AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS n FROM conversations WHERE role = 'user') AS a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS n FROM conversations WHERE role = 'assistant') AS b ON a.conv_id = b.conv_id AND a.n = b.n")
def zip_positional(spark, d):
    x = table(spark, d, "conversations")
    side = lambda role, name: x.where(F.col("role") == role).select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1).cast("long").alias("pos"), F.col("text").alias(name))
    return side("user", "question").join(side("assistant", "answer"), ["conv_id", "pos"])


def _folder(spark, name: str) -> str:
    """A new folder for files that a scan query writes first and then reads."""
    return folder(spark, f"scans/{name}")


def _lines(df, at: str, *by: str) -> str:
    """A JSON document for each row, in text files (one for each partition, or in folders by column)."""
    body = [c for c in df.columns if c not in by]
    out = df.select(*by, F.to_json(F.struct(*body)).alias("value")).write
    (out.partitionBy(*by) if by else out).text(at)
    return at


@query("scan_items", "SELECT doc_id AS id, trim(text) AS text FROM documents WHERE trim(text) <> ''")
def scan_items(spark, d):
    """Items written as JSON lines, then read by the item reader."""
    at = _lines(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _folder(spark, "items"))
    return I.read_items(spark, at, lines=True)


@query("scan_tiles_skip_errors", "SELECT event_id::VARCHAR AS tile, 'm' AS model_id, event_type AS text, 'high' AS confidence FROM events WHERE event_type <> 'error'")
def scan_tiles_skip_errors(spark, d):
    """Tile records of a headline each; those of errors carry an error, and broken lines lie between them."""
    x = table(spark, d, "events")
    heads = F.array(F.struct(F.col("event_type").alias("text"), F.lit("high").alias("confidence")))
    rows = x.select(F.col("event_id").cast("string").alias("tile"), F.lit("m").alias("model_id"), heads.alias("headlines"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    good = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    at = _folder(spark, "tiles")
    broken = rows.where("tile like '%7'").select(F.concat(F.lit('{"tile": "'), "tile", F.lit('", "headlines": [')).alias("value"))
    good.union(broken).write.text(at)
    return I.read_tiles(spark, at, lines=True)


@query("scan_nested_inline", "SELECT conv_id::VARCHAR AS audio_file, turn AS id, text FROM conversations")
def scan_nested_inline(spark, d):
    """A transcript for each conversation, its turns as segments."""
    x = table(spark, d, "conversations")
    segment = F.struct(F.col("turn").alias("id"), F.col("text"))
    docs = x.groupBy(F.col("conv_id").cast("string").alias("audio_file")).agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    return I.read_segments(spark, _lines(docs, _folder(spark, "transcripts")), lines=True).select("audio_file", "id", "text")


@query("scan_chunk_docs", "SELECT (doc_id // 50)::INT AS chunk, regexp_replace(string_agg(text, chr(10) ORDER BY doc_id), '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE doc_id // 50 % 6 <> 5 GROUP BY doc_id // 50")
def scan_chunk_docs(spark, d):
    """Whole texts in folders chunk_<n>, the texts of 50 documents in each, read by their pattern; every sixth file is blank."""
    at = _folder(spark, "chunks")
    x = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("k")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
    body = F.array_join(F.transform("docs", lambda t: t["text"]), "\n")
    x.select(F.concat(F.lit("chunk_"), "k").alias("folder"), F.when(F.col("k") % 6 == 5, " \n").otherwise(F.concat(F.lit(" "), body)).alias("value")).write.partitionBy("folder").text(at)
    return I.read_chunks(spark, f"{at}/folder=chunk_*").select("chunk", "text")


@query("scan_runs_precedence", f"SELECT label, conv_id::VARCHAR AS provider, role AS model_id, text AS summary, status FROM {STATUS} WHERE label <> 'chunked'")
def scan_runs_precedence(spark, d):
    """Run files under labelled folders, those of one label missing."""
    at = _folder(spark, "runs")
    x = _status(spark, d).where("label <> 'chunked'")
    result = F.struct(F.col("conv_id").cast("string").alias("provider"), F.col("role").alias("model_id"), F.col("text").alias("summary"), "status")
    _lines(x.groupBy("label", "conv_id").agg(F.collect_list(result).alias("results")).drop("conv_id"), at, "label")
    return I.read_runs(spark, [(k, f"{at}/label={k}") for k in ("retry", "chunked", "original")], lines=True).select("label", "provider", "model_id", "summary", "status")


@query("scan_words", "SELECT l_partkey::INT AS x, l_returnflag AS text, l_discount::DOUBLE AS confidence, 'ok' AS status FROM lineitem UNION ALL SELECT NULL, NULL, NULL, 'missing'")
def scan_words(spark, d):
    """Recognised words of one engine, and the status of a file that is not there."""
    at = _lines(table(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("x"), F.col("l_returnflag").alias("text"), F.col("l_discount").cast("double").alias("confidence")), _folder(spark, "words"))
    return I.read_words(spark, at, lines=True).union(I.read_words(spark, f"{at}-none", lines=True))


@query("discover_runs", "SELECT (doc_id // 40)::INT AS run, doc_id::VARCHAR AS name FROM documents WHERE doc_id // 40 % 3 <> 2")
def discover_runs(spark, d):
    """Folders run_<n>, each of 40 documents, that a listing finds; those with other names are left out."""
    at = _folder(spark, "found")
    k = F.floor(F.col("doc_id") / 40)
    x = table(spark, d, "documents").select(F.concat(F.when(k % 3 == 2, "run_x").otherwise("run_"), k).alias("r"), F.col("doc_id").cast("string").alias("value"))
    x.repartition("r").write.partitionBy("r").text(at)
    found = I.discover_runs(spark, at, "r=run_")
    return spark.read.text([p for _, p in found]).select(I.run_number("_metadata.file_path").alias("run"), F.col("value").alias("name"))


_TRACKS = "(SELECT event_type, p // 4000 AS piece, p % 4000 AS spot, CASE WHEN p // 4000 % 2 = 0 THEN (cents - 16384) / 32768 ELSE (cents + event_id % 30000) / 2 / 2147483648 END AS v FROM (SELECT event_type, event_id, CAST(round(value * 100) AS BIGINT) % 32768 AS cents, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS p FROM events))"


def _tracks(spark, d, **options):
    """The values of each kind of event as recordings of 4000 samples (16 bits, or two channels of 32), read in ranges of 256."""
    x = K.positions(table(spark, d, "events").select("event_type", "event_id", "ts", "value"), "event_type", ("ts", "event_id"))
    cents = F.round(F.col("value") * 100).cast("long") % 32768
    x = x.withColumns({"piece": F.floor(F.col("pos") / 4000), "cents": cents, "one": cents - 16384, "other": F.col("event_id") % 30000})
    x = x.withColumn("file", F.concat_ws("-", "event_type", "piece"))
    at = _folder(spark, "tracks")
    pcm.write_wav(x.where("piece % 2 = 0"), "file", "pos", ["one"], at, 2)
    pcm.write_wav(x.where("piece % 2 = 1"), "file", "pos", ["cents", "other"], at, 4)
    spark.dataSource.register(pcm.PcmSource)
    read = spark.read.format("pcm").option("range", 256).option("split", 20_000)
    for k, v in options.items():
        read = read.option(k, v)
    name = F.regexp_extract("path", "([^/]*)[.]wav$", 1)
    x = read.load(at).select(F.regexp_extract(name, "^(.*)-", 1).alias("event_type"), F.regexp_extract(name, "-([0-9]+)$", 1).cast("long").alias("piece"), "start", F.transform("samples", lambda v: v.cast("double")).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return x.select("event_type", "piece", "start", F.size("x").cast("long").alias("n"), total.alias("total"), F.array_min("x").alias("low"), F.array_max("x").alias("high"), F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"))


_HEARD = "SELECT event_type, piece, spot // 256 * 256 AS start, count(*) AS n, sum(v) AS total, min(v) AS low, max(v) AS high, arg_min(v, spot) AS first, arg_max(v, spot) AS last"


@query("scan_wav_ranges", f"{_HEARD} FROM {_TRACKS} GROUP BY event_type, piece, spot // 256")
def scan_wav_ranges(spark, d):
    """Every range of every recording."""
    return _tracks(spark, d)


@query("scan_wav_every_nth", f"{_HEARD} FROM {_TRACKS} WHERE spot // 256 % 5 = 0 GROUP BY event_type, piece, spot // 256")
def scan_wav_every_nth(spark, d):
    """Every fifth range; the source seeks past the others."""
    return _tracks(spark, d, every=5)


@query("first_filled", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, ''), nullif(source, ''), 'none') AS v FROM documents")
def first_filled(spark, d):
    x = table(spark, d, "documents").withColumn("a", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang")))
    return x.select("doc_id", T.first_filled("a", "source", F.lit("none")).alias("v"))


@query("box_floor", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_linenumber >= 5")
def box_floor(spark, d):
    x = table(spark, d, "lineitem").withColumns({"w": F.col("l_quantity"), "h": F.col("l_linenumber")})
    return K.large_boxes(x).select("l_orderkey", "l_linenumber")


@query("validate_requests", "SELECT o_orderkey, CASE WHEN b <= a THEN 'end_sec must be greater than start_sec' WHEN b - a > 1800 THEN 'segment too long' END AS error FROM (SELECT o_orderkey, o_custkey % 5000 AS a, o_orderkey % 5000 AS b FROM orders)")
def validate_requests(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5000).alias("start_sec"), (F.col("o_orderkey") % 5000).alias("end_sec"))
    return K.requests(x).select("o_orderkey", "error")


_E = "(SELECT vec_id, e, list_concat(e[vec_id % 5 + 1:], e[:vec_id % 5]) AS f FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"


@query("scroll_match", f"""SELECT vec_id, (10 - s)::INT AS shift, round(r, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, s) AS k FROM (
  SELECT vec_id, s, list_dot_product(t, v) / sqrt(list_dot_product(t, t) * list_dot_product(v, v)) AS r FROM (
    SELECT vec_id, s, list_transform(e[23:54], lambda z: z - list_avg(e[23:54])) AS t, list_transform(f[13 + s:44 + s], lambda z: z - list_avg(f[13 + s:44 + s])) AS v FROM (SELECT *, unnest(range(0, 11)) AS s FROM {_E})))) WHERE k = 1""")
def scroll_match(spark, d):
    """Strips of 64 values, each moved left by up to four places (the values that leave come in again)."""
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    k = (F.col("vec_id") % 5).cast("int")
    x = x.select("vec_id", "e", F.concat(F.slice("e", k + 1, F.size("e")), F.slice("e", F.lit(1), k)).alias("f"))
    m = x.select("vec_id", K.scroll_match("e", "f", F.lit(10), F.lit(0.5)).alias("m"))
    return m.select("vec_id", "m.shift", F.round("m.confidence", 6).alias("confidence"))


@query("stats_document", "SELECT user_id, count(*) AS frames, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY user_id")
def stats_document(spark, d):
    """Nested statistics of a stream, written as JSON documents and read again."""
    x = O.stats_documents(table(spark, d, "events"), "user_id", {"frames": F.count("*"), "value": {"mean": F.round(F.avg("value"), 6), "high": F.max("value")}})
    at = _folder(spark, "stats")
    x.write.text(at)
    back = spark.read.schema("user_id bigint, frames bigint, value struct<mean:double,high:double>").json(at)
    return back.select(F.col("user_id").cast(table(spark, d, "events").schema["user_id"].dataType).alias("user_id"), "frames", "value.mean", "value.high")


@query("results_by_variant", "SELECT role AS variant, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n, conv_id, turn, text FROM conversations")
def results_by_variant(spark, d):
    """Results in a folder for each variant, numbered in order, and read again."""
    x = table(spark, d, "conversations").select(F.col("role").alias("variant"), "conv_id", "turn", "text")
    at = _folder(spark, "variants")
    O.write_variants(x, "variant", ("conv_id", "turn"), at)
    return spark.read.schema("n long, conv_id long, turn long, text string, variant string").json(at).select("variant", "n", "conv_id", "turn", "text")


@query("latest_job_status", f"SELECT conv_id, turn, status FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {STATUS}) WHERE r = 1")
def latest_job_status(spark, d):
    """Statuses appended to a job table, a batch for each parity of the turn, and the latest of each job."""
    at = _folder(spark, "jobs")
    x = _status(spark, d).select(F.col("conv_id").cast("string").alias("job"), F.col("turn").cast("long").alias("updated_at"), "status")
    for k in (0, 1):
        J.append_status(x.where(F.col("updated_at") % 2 == k), at)
    kinds = table(spark, d, "conversations").schema
    return J.latest_status(spark, at).select(F.col("job").cast(kinds["conv_id"].dataType).alias("conv_id"), F.col("updated_at").cast(kinds["turn"].dataType).alias("turn"), "status")
