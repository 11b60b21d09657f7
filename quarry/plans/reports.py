"""Reports over the tables: a row of lineitem is a function, l_quantity its complexity, a part a module, its brand a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.operators import summaries as A

RISK = "CASE WHEN l_quantity <= 9 THEN 'low' WHEN l_quantity <= 19 THEN 'medium' ELSE 'high' END"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d):
    return _t(spark, d, "lineitem")


def risk_report(spark, d):
    """Risk and size of the functions of each module, worst ten modules of each return flag."""
    x = _lines(spark, d).withColumn("risk", S.risk(F.col("l_quantity"), 9, 19))
    m = A.summary(x, F.col("l_quantity"), F.col("risk"), ["l_returnflag", "l_suppkey"])
    return A.top_per_group(m, ["l_returnflag"], [F.desc("high_risk"), F.asc("l_suppkey")], 10)


def complexity_summary(spark, d):
    return A.summary(_lines(spark, d), F.col("l_quantity"), S.risk(F.col("l_quantity"), 9, 19))


def complexity_histogram(spark, d):
    return A.histogram(_lines(spark, d), S.bucket(F.col("l_quantity").cast("long"), [5, 10, 20, 30]))


def coupling_histogram(spark, d):
    return A.histogram(_t(spark, d, "part"), S.bucket(F.col("p_size"), [0, 5, 10, 20, 50]))


def directory_rollup(spark, d):
    x = _lines(spark, d).join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.summary(x, F.col("l_quantity"), S.risk(F.col("l_quantity"), 9, 19), ["p_brand"])


def module_rollup(spark, d):
    """Modules with functions that count ('N'), those without kept with zeros."""
    counts = F.col("l_returnflag") != "A"
    return _lines(spark, d).groupBy("l_suppkey").agg(F.count_if(counts).alias("functions"), F.coalesce(F.avg(F.when(counts, F.col("l_quantity"))), F.lit(0.0)).alias("mean_complexity"), F.coalesce(F.max(F.when(counts, F.col("l_quantity"))), F.lit(0.0)).alias("worst"))


def range_filter(spark, d):
    return A.in_range(_t(spark, d, "part"), F.col("p_size"), 10, 20, hide_zero=True).groupBy("p_brand").agg(F.count("*").alias("n"))


def top_classes(spark, d):
    return A.top(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), [F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")], 10)


def suggestions(spark, d):
    """Ten findings a category by severity, then price, then a global order."""
    x = _t(spark, d, "part").withColumn("severity", F.when(F.col("p_size") > 40, "error").when(F.col("p_size") > 25, "warning").otherwise("info"))
    x = x.withColumn("rank_of", S.ordinal(F.col("severity"), S.SEVERITIES))
    capped = A.top_per_group(x, ["p_brand"], [F.desc("rank_of"), F.desc("p_retailprice"), F.asc("p_partkey")], 10)
    return capped.select("p_brand", "rank", "p_partkey", "severity")


def severity_pivot(spark, d):
    x = _lines(spark, d).withColumn("risk", S.risk(F.col("l_quantity"), 9, 19))
    return x.groupBy("l_linestatus").pivot("risk", ["low", "medium", "high"]).count()


def unpivoted_report(spark, d):
    one = complexity_summary(spark, d).select(*[F.col(c).cast("double").alias(c) for c in ("total", "mean", "least", "most", "high_risk")])
    return A.unpivot(one, [], ["total", "mean", "least", "most", "high_risk"])


def best_match(spark, d):
    """The canonical line of each order: least flag, then greatest quantity, then least keys."""
    x = _lines(spark, d).select("l_orderkey", "l_returnflag", "l_quantity", "l_linenumber", "l_partkey", "l_suppkey")
    return A.best_match(x, ["l_orderkey"], [F.asc("l_returnflag"), F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])


def merged_findings(spark, d):
    """Spans of users' events of one type, by minute, that touch are one finding."""
    e = _t(spark, d, "events").select("user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("start")).withColumn("end", F.col("start") + F.pmod(F.col("user_id"), F.lit(600)))
    return A.merge_spans(e, ["user_id", "event_type"], "start", "end").select("user_id", "event_type", F.col("start").cast("long"), F.col("end").cast("long"), "merged")


def terminator_look_back(spark, d):
    """An error of the user in the five hours before, an hour being a line."""
    e = _t(spark, d, "events")
    line = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return e.select("event_id", A.look_back(["user_id"], line, F.col("event_type") == "error", 5).alias("after_terminator"))


def prefix_totals(spark, d):
    """Running sums of a user's values; any range is a difference of two of them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, d, "events").select("event_id", F.sum(F.lit(1)).over(w).alias("upto"), F.sum(F.floor("value").cast("long")).over(w).alias("lines"))


def module_quality(spark, d):
    a = _lines(spark, d).where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("complex"))
    b = _lines(spark, d).where("l_discount > 0.09").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("dead"))
    c = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1).cast("long").alias("known"))
    return A.quality_join([a, b, c], "key", {"complex": 0, "dead": 0, "known": 0})


def raw_metrics(spark, d):
    """Total, blank, comment and other lines of each page."""
    lines = F.split(F.col("html"), "\n")
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    return _t(spark, d, "pages").select("page_id", F.size(lines).cast("long").alias("total"), n(r"^\s*$").alias("blank"), n(r"^\s*#").alias("comment")).withColumn("code", F.col("total") - F.col("blank") - F.col("comment"))


def raw_totals(spark, d):
    x = raw_metrics(spark, d).agg(*[F.sum(c).alias(c) for c in ("total", "blank", "comment", "code")])
    return x.withColumn("comment_ratio", S.ratio(F.col("comment"), F.col("comment") + F.col("code")))


def distinct_ends(spark, d):
    """Fragments that take part in a pair: distinct over the union of both ends."""
    x = _t(spark, d, "orders").select(F.col("o_custkey").alias("k")).unionAll(_lines(spark, d).select("l_suppkey"))
    return x.agg(F.count_distinct("k").alias("fragments"))


def median_values(spark, d):
    return _t(spark, d, "part").groupBy("p_brand").agg(F.median("p_size").alias("median_size"), F.count("*").alias("n"))


def location_dedupe(spark, d):
    """One finding a place, of the highest severity, the first of ties."""
    x = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").withColumn("severity", F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 20, 1).otherwise(0))
    return A.best_match(x, ["l_orderkey", "l_linenumber"], [F.desc("severity"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")]).select("l_orderkey", "l_linenumber", "severity", "l_partkey")


def many_parameters(spark, d):
    return _lines(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("parameters")).where("parameters > 5")


def rule_merge(spark, d):
    """A user's rule replaces the base rule of the same key."""
    base = _t(spark, d, "nation").select("n_nationkey", F.lit("base").alias("origin"))
    user = _t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), F.lit("user").alias("origin")).distinct()
    return base.join(user, "n_nationkey", "left_anti").unionByName(user)


def allowed_dependencies(spark, d):
    """Dependencies less those on an exclusion list."""
    out = _t(spark, d, "part").where("p_type LIKE '%BRASS%' OR p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return _lines(spark, d).join(out, "l_partkey", "left_anti").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("dependencies"))


def path_filter(spark, d):
    """Include and exclude globs over page addresses."""
    p = F.regexp_replace("url", r"^[a-z]+://[^/]*/?", "")
    return _t(spark, d, "pages").select("page_id", p.rlike(S.glob_regex("**/*.html")).alias("included"), p.rlike(S.glob_regex("**/test*/**")).alias("excluded"), F.exists(F.split(p, "/"), lambda s: s.startswith(".")).alias("hidden"))


SUM = "count(*) AS total, avg(l_quantity) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, count(*) FILTER (WHERE l_quantity <= 9) AS low_risk, count(*) FILTER (WHERE l_quantity > 9 AND l_quantity <= 19) AS medium_risk, count(*) FILTER (WHERE l_quantity > 19) AS high_risk"
LINES = r"len(string_split(html, chr(10)))::BIGINT AS total, len([x for x in string_split(html, chr(10)) if regexp_matches(x, '^\s*$')])::BIGINT AS blank, len([x for x in string_split(html, chr(10)) if regexp_matches(x, '^\s*#')])::BIGINT AS comment"

QUERIES = {
    "risk_report": (risk_report, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY high_risk DESC, l_suppkey)::INT AS rank FROM (SELECT l_returnflag, l_suppkey, {SUM} FROM lineitem GROUP BY 1, 2)) WHERE rank <= 10"),
    "complexity_summary": (complexity_summary, f"SELECT {SUM} FROM lineitem"),
    "complexity_histogram": (complexity_histogram, "SELECT CASE WHEN trunc(l_quantity) <= 5 THEN '5' WHEN trunc(l_quantity) <= 10 THEN '6-10' WHEN trunc(l_quantity) <= 20 THEN '11-20' WHEN trunc(l_quantity) <= 30 THEN '21-30' ELSE '31+' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1"),
    "coupling_histogram": (coupling_histogram, "SELECT CASE WHEN p_size <= 0 THEN '0' WHEN p_size <= 5 THEN '1-5' WHEN p_size <= 10 THEN '6-10' WHEN p_size <= 20 THEN '11-20' WHEN p_size <= 50 THEN '21-50' ELSE '51+' END AS bucket, count(*) AS n FROM part GROUP BY 1"),
    "directory_rollup": (directory_rollup, f"SELECT p_brand, {SUM} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "module_rollup": (module_rollup, "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag <> 'A') AS functions, coalesce(avg(l_quantity) FILTER (WHERE l_returnflag <> 'A'), 0) AS mean_complexity, coalesce(max(l_quantity) FILTER (WHERE l_returnflag <> 'A'), 0) AS worst FROM lineitem GROUP BY 1"),
    "range_filter": (range_filter, "SELECT p_brand, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20 GROUP BY 1"),
    "top_classes": (top_classes, "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 10"),
    "suggestions": (suggestions, "SELECT p_brand, rank, p_partkey, severity FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY o DESC, p_retailprice DESC, p_partkey)::INT AS rank FROM (SELECT *, CASE WHEN p_size > 40 THEN 'error' WHEN p_size > 25 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN p_size > 40 THEN 2 WHEN p_size > 25 THEN 1 ELSE 0 END AS o FROM part)) WHERE rank <= 10"),
    "severity_pivot": (severity_pivot, f"SELECT l_linestatus, count(*) FILTER (WHERE {RISK} = 'low') AS low, count(*) FILTER (WHERE {RISK} = 'medium') AS medium, count(*) FILTER (WHERE {RISK} = 'high') AS high FROM lineitem GROUP BY 1"),
    "unpivoted_report": (unpivoted_report, "SELECT 'total' AS metric, count(*)::DOUBLE AS value FROM lineitem UNION ALL SELECT 'mean', avg(l_quantity) FROM lineitem UNION ALL SELECT 'least', min(l_quantity) FROM lineitem UNION ALL SELECT 'most', max(l_quantity) FROM lineitem UNION ALL SELECT 'high_risk', count(*)::DOUBLE FROM lineitem WHERE l_quantity > 19"),
    "best_match": (best_match, "SELECT l_orderkey, l_returnflag, l_quantity, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1"),
    "merged_findings": (merged_findings, "WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 60000000 AS s, epoch_us(ts) // 60000000 + user_id % 600 AS e FROM events), m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, event_type, min(s)::BIGINT AS start, max(e)::BIGINT AS \"end\", count(*) AS merged FROM i GROUP BY user_id, event_type, k"),
    "terminator_look_back": (terminator_look_back, "SELECT event_id, coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 3600000000 RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 1 AS after_terminator FROM events"),
    "prefix_totals": (prefix_totals, "SELECT event_id, count(*) OVER w AS upto, (sum(floor(value)::BIGINT) OVER w)::BIGINT AS lines FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "module_quality": (module_quality, "WITH a AS (SELECT l_suppkey AS key, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1), b AS (SELECT l_suppkey AS key, count(*) AS n FROM lineitem WHERE l_discount > 0.09 GROUP BY 1), c AS (SELECT s_suppkey AS key FROM supplier), k AS (SELECT key FROM a UNION SELECT key FROM b UNION SELECT key FROM c) SELECT k.key, coalesce(a.n, 0) AS complex, coalesce(b.n, 0) AS dead, (c.key IS NOT NULL)::BIGINT AS known FROM k LEFT JOIN a USING (key) LEFT JOIN b USING (key) LEFT JOIN c USING (key)"),
    "raw_metrics": (raw_metrics, f"SELECT *, total - blank - comment AS code FROM (SELECT page_id, {LINES} FROM pages)"),
    "raw_totals": (raw_totals, f"SELECT *, total - blank - comment AS code, CASE WHEN total - blank = 0 THEN 0 ELSE comment / (total - blank) END::DOUBLE AS comment_ratio FROM (SELECT sum(total)::BIGINT AS total, sum(blank)::BIGINT AS blank, sum(comment)::BIGINT AS comment FROM (SELECT {LINES} FROM pages))"),
    "distinct_ends": (distinct_ends, "SELECT count(DISTINCT k) AS fragments FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT l_suppkey FROM lineitem)"),
    "median_values": (median_values, "SELECT p_brand, median(p_size)::DOUBLE AS median_size, count(*) AS n FROM part GROUP BY 1"),
    "location_dedupe": (location_dedupe, "SELECT l_orderkey, l_linenumber, severity, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY severity DESC, l_partkey, l_suppkey, l_quantity) AS rn FROM (SELECT *, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS severity FROM lineitem)) WHERE rn = 1"),
    "many_parameters": (many_parameters, "SELECT l_orderkey, count(*) AS parameters FROM lineitem GROUP BY 1 HAVING count(*) > 5"),
    "rule_merge": (rule_merge, "WITH u AS (SELECT DISTINCT s_nationkey AS n_nationkey FROM supplier WHERE s_acctbal > 5000) SELECT n_nationkey, 'base' AS origin FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM u) UNION ALL SELECT n_nationkey, 'user' FROM u"),
    "allowed_dependencies": (allowed_dependencies, "SELECT l_suppkey, count(DISTINCT l_partkey) AS dependencies FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' OR p_size < 10) GROUP BY 1"),
    "path_filter": (path_filter, r"SELECT page_id, regexp_matches(p, '^(?:.*/)?[^/]*\.html$') AS included, regexp_matches(p, '^(?:.*/)?test[^/]*/.*$') AS excluded, len([s for s in string_split(p, '/') if starts_with(s, '.')]) > 0 AS hidden FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS p FROM pages)"),
}
