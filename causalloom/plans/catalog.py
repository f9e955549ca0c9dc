"""Named queries over the driver's tables, with the same queries in DuckDB SQL.

The tables stand in for the domain: services are event types, metrics are user_id modulo
6 (or 24 in version queries), versions are the time before and after 16 January. p values
come from orders by integer arithmetic, so that both engines see the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalloom.functions import names
from causalloom.functions.runtime import materialize, visible
from causalloom.operators import causality, clustering, diagnostics, distance, graphs, monitoring, series, versions
from causalloom.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STEP, DIGITS = "6 hours", 6


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    visible(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(F.col("event_type").alias("service"), F.concat(F.lit("m"), F.col("user_id") % 6).alias("metric"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


S = "SELECT event_type AS service, 'm' || (user_id % 6) AS metric, ts, value FROM events"
BINNED = f"WITH s AS ({S}), b AS (SELECT service, metric, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS bin, avg(value) AS value FROM s GROUP BY ALL)"
GRID = BINNED + """, span AS (SELECT service, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY service),
g AS (SELECT k.service, k.metric, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS bin FROM (SELECT DISTINCT service, metric FROM b) k JOIN span USING (service)),
j AS (SELECT g.service, g.metric, g.bin, b.value FROM g LEFT JOIN b USING (service, metric, bin))"""
FILLED = GRID + """, w AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN value IS NOT NULL THEN epoch_us(bin) END IGNORE NULLS) OVER a AS pt,
  first_value(value IGNORE NULLS) OVER z AS nv, first_value(CASE WHEN value IS NOT NULL THEN epoch_us(bin) END IGNORE NULLS) OVER z AS nt FROM j
  WINDOW a AS (PARTITION BY service, metric ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY service, metric ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT service, metric, bin, coalesce(value, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (epoch_us(bin) - pt) / (nt - pt) END) AS value FROM w)"""


def regular(spark: SparkSession, d: str) -> DataFrame:
    return series.interpolate(series.on_grid(series.resample_mean(samples(spark, d), STEP), STEP))


def r(c: str, name: str | None = None):
    return (F.round(c, DIGITS) + 0.0).alias(name or c)


# --- series -----------------------------------------------------------------


@query(S)
def samples_long(spark, d):
    return samples(spark, d)


@query("SELECT * FROM (" + S + ") WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def time_range_scan(spark, d):
    return series.time_range(samples(spark, d), "2024-01-05", "2024-01-12")


@query("SELECT * FROM (" + S + ") WHERE regexp_matches(service || '|' || metric, '^(click|view).*[135]$')")
def regex_filter(spark, d):
    named = samples(spark, d).withColumn("name", F.concat("service", F.lit("|"), "metric"))
    return series.matching(named, "^(click|view).*[135]$", "name").drop("name")


@query("SELECT o_orderkey AS id, o_orderstatus AS tag, o_totalprice AS price, NULL::DOUBLE AS balance FROM orders UNION ALL SELECT c_custkey, NULL, NULL, c_acctbal FROM customer")
def union_sources(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("tag"), F.col("o_totalprice").alias("price"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return series.union_sources(o, c)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'cpu-total' ELSE 'cpu0' END AS cpu FROM lineitem)
SELECT * FROM c WHERE cpu IS NULL OR cpu = 'cpu-total'""")
def null_or_total_filter(spark, d):
    n = F.col("l_linenumber") % 3
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 0, F.lit(None)).when(n == 1, "cpu-total").otherwise("cpu0").alias("cpu"))
    return series.null_or_total(rows)


@query(BINNED + " SELECT service, metric, bin, round(value, 6) + 0.0 AS value FROM b")
def resample_mean(spark, d):
    return series.resample_mean(samples(spark, d), STEP).select("service", "metric", "bin", r("value"))


@query(FILLED + " SELECT service, metric, bin, round(value, 6) + 0.0 AS value FROM f")
def interpolate_gaps(spark, d):
    return regular(spark, d).select("service", "metric", "bin", r("value"))


@query(GRID + """ SELECT service, metric, bin, round(coalesce(first_value(value IGNORE NULLS) OVER (PARTITION BY service, metric ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(value IGNORE NULLS) OVER (PARTITION BY service, metric ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS value FROM j""")
def fill_both(spark, d):
    return series.fill_both(series.on_grid(series.resample_mean(samples(spark, d), STEP), STEP)).select("service", "metric", "bin", r("value"))


# Counters, flat and ordinary series beside each other, so that every class occurs.
KINDS = """, x AS (SELECT service, metric, bin, value FROM f UNION ALL SELECT service, 'total_' || metric, bin, sum(abs(value)) OVER (PARTITION BY service, metric ORDER BY bin) FROM f
 UNION ALL SELECT service, 'flat_' || metric, bin, 1.0 FROM f)"""


def kinds(spark, d):
    from pyspark.sql import Window

    f = regular(spark, d)
    up = F.sum(F.abs("value")).over(Window.partitionBy("service", "metric").orderBy("bin"))
    return f.unionByName(f.select("service", F.concat(F.lit("total_"), "metric").alias("metric"), "bin", up.alias("value"))).unionByName(
        f.select("service", F.concat(F.lit("flat_"), "metric").alias("metric"), "bin", F.lit(1.0).alias("value")))


STEPS = KINDS + ", t AS (SELECT *, value - lag(value) OVER o AS step, row_number() OVER o AS rn FROM x WINDOW o AS (PARTITION BY service, metric ORDER BY bin)), k AS (SELECT service, metric, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, CASE WHEN count(*) FILTER (value IS NULL) > 0 THEN 'empty' WHEN min(value) = max(value) THEN 'constant' WHEN min(step) >= 0 THEN 'monotonic' ELSE 'other' END AS klass FROM t GROUP BY ALL)"


@query(FILLED + STEPS + " SELECT service, metric, n, nulls, klass FROM k")
def classify_series(spark, d):
    return series.classify(kinds(spark, d))


@query(FILLED + STEPS + " SELECT service, CASE WHEN klass = 'monotonic' THEN metric || '-diff' ELSE metric END AS metric, bin, round(CASE WHEN klass = 'monotonic' THEN step ELSE value END, 5) + 0.0 AS value FROM t JOIN k USING (service, metric) WHERE klass IN ('monotonic', 'other') AND rn > 1")
def series_diff(spark, d):
    return series.prepared(kinds(spark, d)).select("service", "metric", "bin", (F.round("value", 5) + 0.0).alias("value"))


@query(FILLED + " SELECT service, metric, bin, round(coalesce((value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0), 0), 6) + 0.0 AS z FROM f WINDOW p AS (PARTITION BY service, metric)")
def zscore_pop(spark, d):
    return series.zscore(regular(spark, d)).select("service", "metric", "bin", r("z"))


@query(FILLED + " SELECT service, metric, bin, round(coalesce((value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0), 0), 6) + 0.0 AS z FROM f WINDOW p AS (PARTITION BY service, metric)")
def zscore_sample(spark, d):
    return series.zscore(regular(spark, d), ddof=1).select("service", "metric", "bin", r("z"))


@query("WITH s AS (" + S + "), l AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS bin, avg(value) AS v FROM s WHERE service = 'click' GROUP BY ALL), q AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS bin, avg(value) AS v FROM s WHERE service = 'purchase' GROUP BY ALL) SELECT coalesce(l.bin, q.bin) AS bin, round(l.v, 6) + 0.0 AS left_value, round(q.v, 6) + 0.0 AS right_value FROM l FULL OUTER JOIN q ON l.bin = q.bin")
def align_two(spark, d):
    return series.align(samples(spark, d), "click", "purchase", "1 hour").select("bin", r("left_value"), r("right_value"))


@query(FILLED + STEPS + ", kept AS (SELECT service, count(*) AS kept_metrics FROM k WHERE klass IN ('monotonic', 'other') GROUP BY service) SELECT service, count(*)::BIGINT AS n_samples, count(DISTINCT metric)::BIGINT AS raw_metrics, max(kept_metrics)::BIGINT AS kept_metrics FROM s JOIN kept USING (service) GROUP BY service")
def metric_inventory(spark, d):
    return series.inventory(samples(spark, d), series.prepared(kinds(spark, d)))


# --- monitoring ---------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS n_total FROM orders GROUP BY 1")
def status_counts(spark, d):
    return monitoring.status_counts(_t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT c_nationkey, round(min(c_acctbal), 2) AS min, round(max(c_acctbal), 2) AS max, round(avg(c_acctbal), 4) AS avg, round(sum(c_acctbal), 2) AS sum, count(c_acctbal) AS count, round(sum(c_acctbal) / count(c_acctbal), 4) AS avg_time FROM customer GROUP BY 1")
def meter_stats(spark, d):
    m = monitoring.meter_stats(_t(spark, d, "customer"), "c_nationkey", "c_acctbal")
    return m.select("c_nationkey", F.round("min", 2).alias("min"), F.round("max", 2).alias("max"), F.round("avg", 4).alias("avg"), F.round("sum", 2).alias("sum"), "count", F.round("avg_time", 4).alias("avg_time"))


@query("SELECT event_type AS service, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2000-01-01') AS bin, round(quantile_cont(value, 0.9), 6) + 0.0 AS p, count(*) AS n FROM events GROUP BY ALL")
def p90_by_window(spark, d):
    return monitoring.percentile_by_window(samples(spark, d), "1 day").select("service", "bin", r("p"), "n")


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<li[ >]'))::BIGINT AS n_rows FROM pages")
def html_rows(spark, d):
    return monitoring.table_rows(_t(spark, d, "pages"))


# --- names --------------------------------------------------------------------

NAMED = "SELECT s_suppkey, lower(replace(replace(s_name, '#', '_'), ' ', '_')) || CASE WHEN s_suppkey % 3 = 0 THEN '_used-diff' WHEN s_suppkey % 3 = 1 THEN '_device_id' ELSE '_mq' END AS name FROM supplier"


def named(spark, d):
    end = F.when(F.col("s_suppkey") % 3 == 0, "_used-diff").when(F.col("s_suppkey") % 3 == 1, "_device_id").otherwise("_mq")
    return _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lower(F.translate("s_name", "# ", "__")), end).alias("name"))


@query(f"SELECT s_suppkey, name, regexp_replace(name, '-diff$', '') AS stripped, rtrim(name, '-dif') AS compat, CASE WHEN length(name) > 11 THEN left(name, 5) || '::' || right(name, 6) ELSE name END AS short FROM ({NAMED})")
def strip_names(spark, d):
    n = F.col("name")
    return named(spark, d).select("s_suppkey", "name", names.strip_diff(n).alias("stripped"), names.strip_diff(n, compat=True).alias("compat"), names.abbreviate(n).alias("short"))


@query(f"""SELECT s_suppkey, list_aggregate(list_transform(string_split(name, '_'), lambda w: CASE WHEN w IN ('mq', 'api', 'dhcp', 'ssh', 'l3') THEN upper(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), 'string_agg', ' ') AS label,
 replace(replace(replace(replace(replace(name, 'GET', ''), 'POST', ''), 'total', ''), '-', ''), '_', '') AS bare, 'svc|' || name AS qualified, left(name, 11) AS id11 FROM ({NAMED})""")
def name_labels(spark, d):
    n = F.col("name")
    return named(spark, d).select("s_suppkey", names.print_label(n).alias("label"), names.without_stop_words(n, F.lit("~")).alias("bare"), names.qualify(F.lit("svc"), n).alias("qualified"), names.short_container_id(n).alias("id11"))


NAME_PAIRS = "WITH n AS (SELECT DISTINCT p_type AS name FROM part), p AS (SELECT x.name AS a, y.name AS b, jaro_similarity(x.name, y.name) AS sim FROM n x JOIN n y ON x.name < y.name)"


def name_pairs(spark, d):
    n = _t(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    p = n.toDF("a").join(n.toDF("b"), F.col("a") < F.col("b"))
    return n, p.withColumn("sim", names.jaro(F.col("a"), F.col("b")))


@query(NAME_PAIRS + " SELECT a, b, round(sim, 6) + 0.0 AS sim FROM p")
def name_similarity(spark, d):
    return name_pairs(spark, d)[1].select("a", "b", r("sim"))


@query("WITH RECURSIVE n AS (SELECT DISTINCT p_type AS name FROM part), e AS (SELECT x.name AS a, y.name AS b FROM n x, n y WHERE x.name <> y.name AND 1 - jaro_similarity(x.name, y.name) <= 0.25), c AS (SELECT name, name AS label FROM n UNION SELECT e.b, c.label FROM c JOIN e ON c.name = e.a) SELECT name, min(label) AS label FROM c GROUP BY name")
def name_clusters(spark, d):
    n, p = name_pairs(spark, d)
    return clustering.name_clusters(p.select("a", "b", (1 - F.col("sim")).alias("d")), n, 0.25)


# --- distances ------------------------------------------------------------------

VEC = "WITH v AS (SELECT 's' || label AS service, 'v' || vec_id AS metric, list_transform(embedding, lambda x: x::DOUBLE) AS v, (vec_id % 3)::INT AS part FROM embeddings)"
PAIRS = VEC + """, p AS (SELECT x.service, x.metric AS a, y.metric AS b, x.v AS x, y.v AS y FROM v x JOIN v y ON x.service = y.service AND x.metric < y.metric),
c AS (SELECT service, a, b, s, list_sum(list_transform(range(greatest(1, 1 - s), least(64, 64 - s) + 1), lambda t: x[t + s] * y[t])) / (sqrt(list_sum(list_transform(x, lambda q: q * q))) * sqrt(list_sum(list_transform(y, lambda q: q * q)))) AS ncc FROM (SELECT *, unnest(range(-63, 64)) AS s FROM p)),
d AS (SELECT service, a, b, max(ncc) AS ncc, 1 - max(ncc) AS sbd, (-arg_max(s, ncc))::INT AS lag FROM c GROUP BY ALL)"""


def short_series(spark, d):
    """Ready-made series: a service per label; pairs are within a service."""
    e = _t(spark, d, "embeddings")
    return e.select(F.concat(F.lit("s"), "label").alias("service"), F.concat(F.lit("v"), "vec_id").alias("metric"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3).cast("int").alias("part"))


def measured_pairs(spark, d, column):
    return distance.pair_distances(short_series(spark, d), ["service"], columns=(column,))


@query(PAIRS + " SELECT service, a, b, round(ncc, 6) + 0.0 AS ncc FROM d")
def ncc_max(spark, d):
    return measured_pairs(spark, d, "ncc").select("service", "a", "b", r("ncc"))


@query(PAIRS + " SELECT service, a, b, round(sbd, 6) + 0.0 AS sbd FROM d")
def sbd_pairs(spark, d):
    return measured_pairs(spark, d, "sbd").select("service", "a", "b", r("sbd"))


@query(PAIRS + " SELECT service, a, b, lag FROM d")
def sbd_lag(spark, d):
    return measured_pairs(spark, d, "lag").select("service", "a", "b", "lag")


SIL = PAIRS + """, l AS (SELECT service, metric AS key, part AS cluster FROM v), m AS (SELECT service, a AS key, b AS other, sbd FROM d UNION ALL SELECT service, b, a, sbd FROM d),
k AS (SELECT m.service, m.key, x.cluster AS own, y.cluster, avg(sbd) AS dist FROM m JOIN l x ON m.service = x.service AND m.key = x.key JOIN l y ON m.service = y.service AND m.other = y.key GROUP BY ALL),
o AS (SELECT service, key, min(dist) FILTER (own = cluster) AS a, min(dist) FILTER (own <> cluster) AS b FROM k GROUP BY ALL),
n AS (SELECT service, count(*) AS n, count(DISTINCT cluster) AS k FROM l GROUP BY service)
SELECT n.service, n, k, round(CASE WHEN k < 2 OR k >= n THEN -1 ELSE (SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) FROM o WHERE o.service = n.service) END, 6) + 0.0 AS silhouette FROM n"""


@query(SIL)
def silhouette(spark, d):
    labels = short_series(spark, d).select("service", F.col("metric").alias("key"), F.col("part").alias("cluster"))
    return distance.series_silhouette(short_series(spark, d), labels, ["service"]).select("service", "n", "k", r("silhouette"))


REP = VEC + """, g AS (SELECT service, metric, part AS cluster, v FROM v), cen AS (SELECT service, cluster, list(m ORDER BY i) AS c FROM (SELECT service, cluster, i, avg(v[i]) AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM g) GROUP BY ALL) GROUP BY ALL),
c AS (SELECT service, cluster, metric, max(ncc) AS ncc FROM (SELECT g.service, g.cluster, metric, s, list_sum(list_transform(range(greatest(1, 1 - s), least(64, 64 - s) + 1), lambda t: c[t + s] * v[t])) / (sqrt(list_sum(list_transform(c, lambda q: q * q))) * sqrt(list_sum(list_transform(v, lambda q: q * q)))) AS ncc FROM (SELECT *, unnest(range(-63, 64)) AS s FROM g) g JOIN cen USING (service, cluster)) GROUP BY ALL)
SELECT service, cluster, metric AS representative, round(1 - ncc, 6) + 0.0 AS sbd FROM c QUALIFY row_number() OVER (PARTITION BY service, cluster ORDER BY 1 - ncc, metric) = 1"""


@query(REP)
def representatives(spark, d):
    g = short_series(spark, d).select("service", F.col("metric").alias("key"), F.col("part").alias("cluster"), "v")
    mean = g.select("service", "cluster", F.posexplode("v")).groupBy("service", "cluster", "pos").agg(F.avg("col").alias("m"))
    cen = mean.groupBy("service", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))
    return distance.representatives(g.join(cen, ["service", "cluster"]), ["service"]).select("service", "cluster", "representative", r("sbd"))


@query("WITH s AS (SELECT c_mktsegment AS service, 2 + (c_custkey % 5)::INT AS k, round(avg(c_acctbal) / 10000, 3) AS silhouette FROM customer GROUP BY ALL) SELECT service, coalesce(arg_max(k, (silhouette, -k)), 0)::INT AS preferred_k, max(silhouette) AS silhouette FROM s WHERE silhouette > -1 GROUP BY service")
def preferred_k(spark, d):
    s = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("service"), (2 + F.col("c_custkey") % 5).cast("int").alias("k")).agg(F.round(F.avg("c_acctbal") / 10000, 3).alias("silhouette"))
    return distance.preferred_k(s, ["service"])


def kshape_starts(spark, d):
    return clustering.start_labels(short_series(spark, d), list(range(2, 7)))


@query()
def kshape_assign(spark, d):
    return clustering.kshape(kshape_starts(spark, d)).select("service", "k", "metric", "cluster", r("silhouette"))


@query()
def centroid_lag(spark, d):
    rows = clustering.shapes(kshape_starts(spark, d)).join(short_series(spark, d).select("service", "metric", "v"), ["service", "metric"])
    return diagnostics.lag_to_centroid(rows).select("service", "k", "metric", "cluster", "lag", r("sbd"))


@query(VEC + """, p AS (SELECT service, metric, part * 2 AS cluster FROM v WHERE v[1] > 0), r AS (SELECT service, metric, dense_rank() OVER (PARTITION BY service ORDER BY cluster) - 1 AS s FROM p),
j AS (SELECT v.service, v.metric, s, max(s) OVER (PARTITION BY v.service) AS top FROM v LEFT JOIN r USING (service, metric)), l AS (SELECT service, metric, coalesce(s, top + 1, 0)::INT AS start FROM j)
SELECT service, metric, start, (max(start) OVER (PARTITION BY service) + 1)::INT AS k FROM l""")
def warm_start(spark, d):
    s = short_series(spark, d)
    return clustering.warm_start(s, s.where(F.get("v", F.lit(0)) > 0).select("service", "metric", (F.col("part") * 2).alias("cluster"))).select("service", "metric", "start", "k")


@query()
def gap_statistic(spark, d):
    return clustering.gap_statistic(short_series(spark, d), list(range(2, 7))).select("service", "k", r("gap"))


# --- causality --------------------------------------------------------------------

WIDE = BINNED.replace("WITH s AS", "WITH s AS") + ", h AS (SELECT service, bin, avg(value) AS value FROM b GROUP BY ALL), q AS (SELECT x.service AS p_service, y.service AS c_service, x.bin AS t, x.value AS cause, y.value AS effect FROM h x JOIN h y ON x.bin = y.bin AND x.service <> y.service)"


def service_steps(spark, d):
    b = series.resample_mean(samples(spark, d), STEP).groupBy("service", "bin").agg(F.avg("value").alias("value"))
    p = b.select(F.col("service").alias("p_service"), F.col("bin").alias("t"), F.col("value").alias("cause"))
    c = b.select(F.col("service").alias("c_service"), F.col("bin").alias("t"), F.col("value").alias("effect"))
    rows = p.join(c, "t").where(F.col("p_service") != F.col("c_service"))
    return rows.select("p_service", F.lit("m").alias("p_metric"), "c_service", F.lit("m").alias("c_metric"), "t", "cause", "effect")


@query(WIDE + """, l AS (SELECT *, lag(effect) OVER w AS y1, lag(cause) OVER w AS x1 FROM q WINDOW w AS (PARTITION BY p_service, c_service ORDER BY t)),
m AS (SELECT p_service, c_service, count(*) AS n, corr(effect, x1) AS yx, corr(effect, y1) AS yy, corr(x1, y1) AS xy FROM l WHERE y1 IS NOT NULL GROUP BY ALL), r AS (SELECT *, (yx - yy * xy) ** 2 / ((1 - yy ** 2) * (1 - xy ** 2)) AS r2 FROM m)
SELECT p_service, c_service, n, round(r2 / (1 - r2) * (n - 3), 4) + 0.0 AS f_stat FROM r""")
def granger_lag1(spark, d):
    return causality.granger_lag1(service_steps(spark, d)).select("p_service", "c_service", "n", (F.round("f_stat", 4) + 0.0).alias("f_stat"))


def tested(spark, d):
    v = series.vectors(series.prepared(kinds(spark, d)))
    calls = v.select("service").distinct().toDF("svc_x").join(v.select("service").distinct().toDF("svc_y"), F.col("svc_x") < F.col("svc_y"))
    return causality.granger(causality.series_pairs(v, calls))


@query()
def granger_p(spark, d):
    return tested(spark, d).select("p_service", "p_metric", "c_service", "c_metric", "lag", r("f_stat"), r("p_value"), "status")


P_TABLE = """WITH raw AS (SELECT o_orderkey, 's' || (o_custkey % 7) || '|m' || (o_orderkey % 5) AS perpetrator, 's' || ((o_custkey // 7) % 7) || '|m' || ((o_orderkey // 5) % 5) AS consequence,
 ((o_orderkey * 37 + o_custkey * 17) % 1000) / 1000.0::DOUBLE AS p_for_lag_1, ((o_orderkey * 41 + o_custkey * 17) % 1000) / 1000.0::DOUBLE AS p_for_lag_2, ((o_orderkey * 43 + o_custkey * 17) % 1000) / 1000.0::DOUBLE AS p_for_lag_3,
 ((o_orderkey * 47 + o_custkey * 17) % 1000) / 1000.0::DOUBLE AS p_for_lag_4, ((o_orderkey * 53 + o_custkey * 17) % 1000) / 1000.0::DOUBLE AS p_for_lag_5 FROM orders),
c AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY perpetrator, consequence ORDER BY o_orderkey) = 1)"""
SIGNIFICANCE = 0.15


def p_table(spark, d):
    o, k, c = _t(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    seventh, fifth = F.floor(c / 7), F.floor(k / 5)
    p = [(((k * x + c * 17) % 1000) / F.lit(1000.0)).alias(f"p_for_lag_{i + 1}") for i, x in enumerate((37, 41, 43, 47, 53))]
    rows = o.select("o_orderkey", F.concat(F.lit("s"), c % 7, F.lit("|m"), k % 5).alias("perpetrator"), F.concat(F.lit("s"), seventh % 7, F.lit("|m"), fifth % 5).alias("consequence"), *p)
    return graphs.distinct_pairs(rows, "o_orderkey")


CLASSIFIED = P_TABLE + """, s AS (SELECT least(perpetrator, consequence) AS a, greatest(perpetrator, consequence) AS b, perpetrator < consequence AS fw, unnest([1, 2, 3, 4, 5]) AS lag, unnest([p_for_lag_1, p_for_lag_2, p_for_lag_3, p_for_lag_4, p_for_lag_5]) AS p FROM c WHERE perpetrator <> consequence),
k AS (SELECT a, b, lag, coalesce(min(p) FILTER (fw) < 0.15, false) AS f, coalesce(min(p) FILTER (NOT fw) < 0.15, false) AS r FROM s GROUP BY ALL),
e AS (SELECT a, b, lag, CASE WHEN f AND r THEN 'bidir' WHEN f THEN 'forward' ELSE 'back' END AS direction FROM k WHERE f OR r)"""


def classified(spark, d):
    return graphs.classify_edges(p_table(spark, d), SIGNIFICANCE)


@query(CLASSIFIED + " SELECT a, b, lag::INT AS lag, direction FROM e")
def edge_classify(spark, d):
    return classified(spark, d)


EDGES = CLASSIFIED + """, aa AS (SELECT a, b, list(lag) AS every FROM e GROUP BY ALL), g AS (SELECT a, b, direction, list(lag ORDER BY lag) AS lags FROM e WHERE direction <> 'bidir' GROUP BY ALL),
edges AS (SELECT CASE WHEN direction = 'forward' THEN a ELSE b END AS perpetrator, CASE WHEN direction = 'forward' THEN b ELSE a END AS consequence, lags, len(list_filter(every, lambda x: x >= lags[1]))::INT AS multiplicity FROM g JOIN aa USING (a, b))"""


@query(EDGES + " SELECT perpetrator, consequence, list_aggregate(list_transform(lags, lambda x: x::VARCHAR), 'string_agg', ',') AS lags, multiplicity FROM edges")
def edge_lags(spark, d):
    return graphs.edges(classified(spark, d)).select("perpetrator", "consequence", F.array_join(F.col("lags").cast("array<string>"), ",").alias("lags"), "multiplicity")


@query(EDGES + " SELECT split_part(perpetrator, '|', 1) AS p_service, split_part(consequence, '|', 1) AS c_service, count(*) AS edges, sum(len(lags))::BIGINT AS lags, sum(multiplicity)::BIGINT AS physical_edges FROM edges GROUP BY ALL")
def service_rollup(spark, d):
    return graphs.service_rollup(graphs.edges(classified(spark, d)))


@query(CLASSIFIED + " SELECT count(*) AS edges, count(*) FILTER (direction = 'forward') AS forward, count(*) FILTER (direction = 'back') AS back, count(*) FILTER (direction = 'bidir') AS bidir, (SELECT count(DISTINCT s) FROM (SELECT split_part(a, '|', 1) AS s FROM e UNION ALL SELECT split_part(b, '|', 1) FROM e)) AS services FROM e")
def graph_stats(spark, d):
    return graphs.graph_stats(classified(spark, d))


@query(P_TABLE + ", m AS (SELECT least(perpetrator, consequence) AS a, greatest(perpetrator, consequence) AS b, min(p_for_lag_1) AS p1, min(p_for_lag_2) AS p2, min(p_for_lag_3) AS p3, min(p_for_lag_4) AS p4 FROM c GROUP BY ALL), l AS (SELECT unnest([1, 2, 3, 4]) AS lag, unnest([p1, p2, p3, p4]) AS p FROM m), h AS (SELECT lag::INT AS lag, least(floor(p * 20), 19)::INT AS bin, count(*) AS n FROM l GROUP BY ALL) SELECT lag, bin, n, round(n * 20 / sum(n) OVER (PARTITION BY lag), 6) + 0.0 AS density FROM h")
def pvalue_hist(spark, d):
    return graphs.pvalue_histogram(p_table(spark, d)).select("lag", "bin", "n", r("density"))


@query(P_TABLE + ", x AS (SELECT perpetrator, consequence, split_part(perpetrator, '|', 1) AS p_service, split_part(perpetrator, '|', 2) AS p_metric, split_part(consequence, '|', 1) AS c_service, split_part(consequence, '|', 2) AS c_metric FROM c) SELECT perpetrator, consequence FROM x WHERE p_service NOT IN ('s0', 's3') AND c_service NOT IN ('s0', 's3') AND p_metric <> 'm4' AND c_metric <> 'm4' AND p_service <> 's5' AND c_service <> 's5'")
def edge_filters(spark, d):
    rows = graphs.split_names(p_table(spark, d))
    clustered = rows.select(F.col("p_service").alias("service")).union(rows.select("c_service")).distinct().withColumn("preferred_k", F.when(F.col("service") == "s5", 0).otherwise(2))
    return graphs.filter_edges(rows, ["s0", "s3"], ["m4"], clustered).select("perpetrator", "consequence")


# --- graphs -----------------------------------------------------------------------


@query("WITH l AS (SELECT DISTINCT 'svc' || (l_suppkey % 9) AS container, CASE WHEN l_linenumber % 2 = 0 THEN 'RX' ELSE 'TX' END AS direction, (8000 + l_partkey % 12)::INT AS port FROM lineitem), p AS (SELECT (8000 + n_nationkey % 10)::INT AS port, lower(n_name) AS service FROM nation) SELECT DISTINCT CASE WHEN direction = 'TX' THEN container ELSE service END AS src, CASE WHEN direction = 'TX' THEN service ELSE container END AS dst FROM l JOIN p USING (port)")
def callgraph_edges(spark, d):
    side = F.when(F.col("l_linenumber") % 2 == 0, "<").otherwise(">")
    lines = _t(spark, d, "lineitem").select(F.concat(F.lit("0 1 svc"), F.col("l_suppkey") % 9, F.lit(" "), side, F.lit(" 4 host:"), (8000 + F.col("l_partkey") % 12).cast("int"), F.lit("/v2")).alias("value")).distinct()
    ports = _t(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit(":"), (8000 + F.col("n_nationkey") % 10).cast("string"), F.lit(",x")).alias("value"))
    return graphs.call_edges(readers.parse_captures(lines), readers.parse_ports(ports))


TRADE = "WITH t AS (SELECT s_nationkey AS s, c_nationkey AS t, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def trade(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("t"))
    s = _t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("s"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return rows.groupBy("s", "t").agg(F.count("*").alias("n"))


@query(TRADE + ", e AS (SELECT 'n' || s AS src, 'n' || t AS dst FROM (SELECT *, avg(n) OVER () AS mean FROM t) WHERE n > mean) SELECT DISTINCT least(src, dst) AS svc_x, greatest(src, dst) AS svc_y FROM e WHERE src <> dst AND src <> 'n3' AND dst <> 'n3'")
def callgraph_pairs(spark, d):
    t = trade(spark, d)
    mean = t.agg(F.avg("n")).first()[0]
    lines = t.where(F.col("n") > mean).select(F.concat(F.lit('    "n'), "s", F.lit('" -> "n'), "t", F.lit('"')).alias("value"))
    e = readers.parse_dot(lines)
    known = e.select(F.col("src").alias("service")).union(e.select("dst")).distinct().where("service <> 'n3'")
    return graphs.call_pairs(e, known)


def _ranks(rounds: int = 8) -> str:
    sql = TRADE + ", w AS (SELECT s, t, n::DOUBLE / sum(n) OVER (PARTITION BY s) AS w FROM t), nodes AS (SELECT s AS i FROM w UNION SELECT t FROM w), c AS (SELECT count(*) AS n FROM nodes), dead AS (SELECT i FROM nodes WHERE i NOT IN (SELECT s FROM w)), r0 AS (SELECT i, CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM nodes)"
    for k in range(rounds):
        scale = "1.0" if k == 0 else f"(SELECT sum(r) FROM r{k})"
        sql += f", r{k + 1} AS (SELECT i, 0.85 * coalesce((SELECT sum(w * r / {scale}) FROM w JOIN r{k} ON w.s = r{k}.i WHERE w.t = nodes.i), 0) + (SELECT 0.85 * coalesce(sum(r), 0) FROM r{k} WHERE i IN (SELECT i FROM dead)) / (SELECT n FROM c) + 0.15 / (SELECT n FROM c) AS r FROM nodes)"
    return sql + f" SELECT i::VARCHAR AS node, round(r, 8) + 0.0 AS rank FROM r{rounds}"


@query(_ranks())
def pagerank_trade(spark, d):
    from pyspark.sql import Window

    w = trade(spark, d).withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("s")))
    arcs = w.select(F.col("s").cast("string").alias("src"), F.col("t").cast("string").alias("dst"), "w")
    return graphs.pagerank(arcs, start="0", iterations=8).select("node", (F.round("rank", 8) + 0.0).alias("rank"))


# --- versions -----------------------------------------------------------------------

CL = """WITH m AS (SELECT DISTINCT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'nf' ELSE 'f' END AS version, event_type AS service, (user_id % 24)::INT AS u FROM events),
x AS (SELECT version, service, 'm' || u AS metric, CASE WHEN version = 'nf' THEN u % 4 ELSE (u + u // 16) % 4 END::INT AS cluster FROM m WHERE NOT (version = 'f' AND u IN (3, 7, 11)) AND NOT (version = 'nf' AND u IN (5, 13))),
cl AS (SELECT version, service, cluster, min(metric) AS representative, list(metric ORDER BY metric) AS metrics FROM x GROUP BY ALL)"""


def clusters(spark, d):
    e = _t(spark, d, "events")
    m = e.select(F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "nf").otherwise("f").alias("version"), F.col("event_type").alias("service"), (F.col("user_id") % 24).cast("int").alias("u")).distinct()
    x = m.where(~((F.col("version") == "f") & F.col("u").isin(3, 7, 11)) & ~((F.col("version") == "nf") & F.col("u").isin(5, 13)))
    c = F.when(F.col("version") == "nf", F.col("u") % 4).otherwise((F.col("u") + F.floor(F.col("u") / 16)) % 4).cast("int")
    x = x.select("version", "service", F.concat(F.lit("m"), "u").alias("metric"), c.alias("cluster"))
    return x.groupBy("version", "service", "cluster").agg(F.min("metric").alias("representative"), F.array_sort(F.collect_list("metric")).alias("metrics"))


DIFF = CL + """, here AS (SELECT DISTINCT service FROM x WHERE version = 'f'), both_ AS (SELECT service, metric, bool_or(version = 'f') AS f, bool_or(version = 'nf') AS nf FROM x GROUP BY ALL),
diff AS (SELECT service, metric, CASE WHEN f AND nf THEN 'unchanged' WHEN f THEN 'new' ELSE 'discarded' END AS change FROM both_ JOIN here USING (service))"""
MATCH = DIFF + """, sc AS (SELECT a.version, a.service, a.cluster, b.cluster AS best, b.representative AS best_representative, len(list_intersect(a.metrics, b.metrics))::DOUBLE / len(b.metrics) AS score FROM cl a JOIN cl b ON a.service = b.service AND a.version <> b.version),
top AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY version, service, cluster ORDER BY score DESC, best) = 1),
mt AS (SELECT cl.version, cl.service, cl.cluster, cl.representative, best, best_representative, coalesce(score, 0) AS score FROM cl LEFT JOIN top USING (version, service, cluster)),
lost AS (SELECT mt.service, mt.best AS cluster, list(DISTINCT d.metric ORDER BY d.metric) AS discarded FROM mt JOIN x ON x.version = 'nf' AND x.service = mt.service AND x.cluster = mt.cluster JOIN diff d ON d.service = x.service AND d.metric = x.metric AND d.change = 'discarded' WHERE mt.version = 'nf' AND best IS NOT NULL GROUP BY ALL),
nov AS (SELECT c.service, c.cluster, c.representative, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'unchanged') AS unchanged, coalesce(max(len(discarded)), 0)::BIGINT AS discarded, (count(*) FILTER (change = 'new') + coalesce(max(len(discarded)), 0))::BIGINT AS novelty FROM cl c JOIN x ON x.version = 'f' AND c.version = 'f' AND x.service = c.service AND x.cluster = c.cluster JOIN diff d ON d.service = x.service AND d.metric = x.metric LEFT JOIN lost l ON l.service = c.service AND l.cluster = c.cluster GROUP BY c.service, c.cluster, c.representative)"""


@query(CL + " SELECT a.service, a.cluster AS f_cluster, b.cluster AS nf_cluster, round(len(list_intersect(a.metrics, b.metrics))::DOUBLE / len(list_distinct(list_concat(a.metrics, b.metrics))), 6) + 0.0 AS jaccard FROM cl a JOIN cl b ON a.service = b.service AND a.version = 'f' AND b.version = 'nf'")
def jaccard(spark, d):
    c = clusters(spark, d)
    a = c.where("version = 'f'").select("service", F.col("cluster").alias("f_cluster"), F.col("metrics").alias("x"))
    b = c.where("version = 'nf'").select("service", F.col("cluster").alias("nf_cluster"), F.col("metrics").alias("y"))
    return a.join(b, "service").select("service", "f_cluster", "nf_cluster", (F.round(versions.jaccard(F.col("x"), F.col("y")), 6) + 0.0).alias("jaccard"))


@query(DIFF + " SELECT service, metric, change FROM diff")
def metric_diff(spark, d):
    return versions.metric_diff(clusters(spark, d))


@query(MATCH + " SELECT service, cluster, representative, best, best_representative, round(score, 6) + 0.0 AS score FROM mt WHERE version = 'f'")
def cluster_match(spark, d):
    return versions.cluster_match(clusters(spark, d)).select("service", "cluster", "representative", "best", "best_representative", r("score"))


@query(MATCH + " SELECT service, cluster, list_aggregate(discarded, 'string_agg', ',') AS discarded FROM lost")
def cluster_discarded(spark, d):
    return versions.cluster_discarded(clusters(spark, d)).select("service", "cluster", F.array_join("discarded", ",").alias("discarded"))


@query(MATCH + " SELECT service, cluster, representative, new, unchanged, discarded, novelty FROM nov")
def cluster_novelty(spark, d):
    return versions.cluster_novelty(clusters(spark, d))


@query(MATCH + ", h AS (SELECT CASE WHEN new > 0 AND discarded > 0 THEN 'New and discarded' WHEN new > 0 THEN 'New' WHEN discarded > 0 THEN 'Discarded' ELSE 'Unchanged' END AS category FROM nov UNION ALL SELECT 'Changed' FROM nov WHERE novelty > 0 UNION ALL SELECT 'Total' FROM nov) SELECT category, count(*) AS clusters FROM h GROUP BY category")
def novelty_hist(spark, d):
    return versions.novelty_histogram(versions.cluster_novelty(clusters(spark, d)))


ED = MATCH + """, rp AS (SELECT version, service, representative, cluster FROM cl),
eg AS (SELECT a.version, a.service AS p_service, a.representative AS p_metric, b.service AS c_service, b.representative AS c_metric, CASE WHEN a.version = 'f' AND (a.cluster + b.cluster) % 3 = 0 THEN [1, 3] ELSE [1] END AS lags FROM rp a JOIN rp b ON a.version = b.version AND a.service < b.service AND (a.cluster * 3 + b.cluster * 5 + length(a.service) + CASE WHEN a.version = 'f' THEN 1 ELSE 0 END) % 4 < 2),
en AS (SELECT mt.service, mt.representative AS metric, mt.best_representative AS tt, mt.score, novelty FROM mt JOIN nov USING (service, cluster) WHERE mt.version = 'f'),
fo AS (SELECT e.*, p.score AS ps, c.score AS cs, p.tt AS pt, c.tt AS ct, o.lags AS old FROM eg e JOIN en p ON e.p_service = p.service AND e.p_metric = p.metric JOIN en c ON e.c_service = c.service AND e.c_metric = c.metric LEFT JOIN eg o ON o.version = 'nf' AND o.p_service = e.p_service AND o.p_metric = p.tt AND o.c_service = e.c_service AND o.c_metric = c.tt WHERE e.version = 'f' AND p.novelty >= 1 AND c.novelty >= 1),
ju AS (SELECT *, CASE WHEN old IS NULL THEN 'new' WHEN old <> lags THEN 'lag-change' ELSE 'unchanged' END AS change FROM fo, (SELECT unnest([0.01, 0.5, 0.6, 0.7])::DOUBLE AS threshold) WHERE ps >= threshold),
bk AS (SELECT mt.service, mt.representative AS metric, mt.best_representative AS tt, mt.score, novelty FROM mt JOIN nov ON nov.service = mt.service AND nov.representative = mt.best_representative WHERE mt.version = 'nf'),
go AS (SELECT e.*, p.score AS ps, c.score AS cs FROM eg e JOIN bk p ON e.p_service = p.service AND e.p_metric = p.metric JOIN bk c ON e.c_service = c.service AND e.c_metric = c.metric WHERE e.version = 'nf' AND p.novelty >= 1 AND c.novelty >= 1 AND NOT EXISTS (SELECT 1 FROM eg o WHERE o.version = 'f' AND o.p_service = e.p_service AND o.p_metric = p.tt AND o.c_service = e.c_service AND o.c_metric = c.tt)),
df AS (SELECT 'novelty' AS basis, threshold, p_service, p_metric, c_service, c_metric, change FROM ju UNION ALL SELECT 'similarity', threshold, p_service, p_metric, c_service, c_metric, change FROM ju WHERE cs >= threshold AND pt IS NOT NULL AND ct IS NOT NULL
 UNION ALL SELECT 'similarity', threshold, p_service, p_metric, c_service, c_metric, 'discarded' FROM go, (SELECT unnest([0.01, 0.5, 0.6, 0.7])::DOUBLE AS threshold) WHERE ps >= threshold AND cs >= threshold)"""


def version_edges(c: DataFrame) -> DataFrame:
    a = c.select("version", F.col("service").alias("p_service"), F.col("representative").alias("p_metric"), F.col("cluster").alias("pc"))
    b = c.select("version", F.col("service").alias("c_service"), F.col("representative").alias("c_metric"), F.col("cluster").alias("cc"))
    f = F.col("version") == "f"
    pick = (F.col("pc") * 3 + F.col("cc") * 5 + F.length("p_service") + F.when(f, 1).otherwise(0)) % 4 < 2
    lags = F.when(f & ((F.col("pc") + F.col("cc")) % 3 == 0), F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))
    return a.join(b, "version").where((F.col("p_service") < F.col("c_service")) & pick).select("version", "p_service", "p_metric", "c_service", "c_metric", lags.alias("lags"))


def edge_changes(spark, d):
    c = materialize(clusters(spark, d), "version-clusters")
    return versions.edge_diff(version_edges(c), c)


@query(ED + " SELECT basis, threshold, p_service, p_metric, c_service, c_metric, change FROM df")
def edge_diff(spark, d):
    return edge_changes(spark, d)


@query(ED + " SELECT basis, threshold, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'discarded') AS discarded, count(*) FILTER (change = 'lag-change') AS lag_change, count(*) FILTER (change = 'unchanged') AS unchanged FROM df GROUP BY ALL")
def edge_diff_counts(spark, d):
    return versions.edge_diff_counts(edge_changes(spark, d))


@query(ED + ", tc AS (SELECT DISTINCT threshold, CASE WHEN change = 'discarded' THEN 'nf' ELSE 'f' END AS version, unnest([p_service, c_service]) AS service, unnest([p_metric, c_metric]) AS representative FROM df WHERE basis = 'similarity' AND change <> 'unchanged') SELECT threshold, count(DISTINCT service) AS services, count(*) AS clusters, sum(len(metrics))::BIGINT AS metrics FROM tc JOIN cl USING (version, service, representative) GROUP BY threshold")
def reduction_stats(spark, d):
    return versions.reduction_stats(edge_changes(spark, d), clusters(spark, d))


@query(DIFF + ", s AS (SELECT service, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'discarded') AS discarded, count(*) FILTER (change = 'unchanged') AS unchanged FROM diff GROUP BY service) SELECT *, new + discarded AS score, row_number() OVER (ORDER BY new + discarded DESC, service)::INT AS place FROM s")
def rca_rank(spark, d):
    return versions.rank_services(versions.metric_diff(clusters(spark, d)))


@query(ED + """ SELECT DISTINCT '"' || p_service || '" -> "' || c_service || '" [color=' || CASE change WHEN 'new' THEN 'green,style=solid' WHEN 'discarded' THEN 'red,style=dashed' ELSE 'blue,style=dotted' END || '];' AS value FROM df WHERE change <> 'unchanged' AND basis = 'similarity' AND threshold = 0.01""")
def edge_diff_dot(spark, d):
    return writers.edge_diff_dot(edge_changes(spark, d).where("basis = 'similarity' and threshold = 0.01")).select("value")


# --- diagnostics -----------------------------------------------------------------------


@query(FILLED + """, m AS (SELECT service, metric, count(value)::DOUBLE AS n, avg(value) AS mu FROM f GROUP BY ALL), c AS (SELECT service, metric, n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM f JOIN m USING (service, metric) GROUP BY ALL),
mo AS (SELECT *, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 AS b2 FROM c),
a1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt FROM mo),
a2 AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS a FROM a1),
a3 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS de, sqrt(2 / (w2 - 1)) AS al, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS pa FROM a2),
a4 AS (SELECT *, de * ln(y / al + sqrt((y / al) ** 2 + 1)) AS z1, (1 - 2 / (9 * a) - sign(pa) * abs(pa) ** (1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM a3)
SELECT service, metric, n::BIGINT AS n, round(z1 * z1 + z2 * z2, 4) + 0.0 AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 4) + 0.0 AS p_value FROM a4""")
def normality_k2(spark, d):
    n = diagnostics.normality(regular(spark, d))
    return n.select("service", "metric", "n", (F.round("k2", 4) + 0.0).alias("k2"), (F.round("p_value", 4) + 0.0).alias("p_value"))


@query()
def shapiro_wilk(spark, d):
    return diagnostics.shapiro(series.vectors(regular(spark, d))).select("service", "metric", r("w"), r("p_value"))


@query()
def adf_test(spark, d):
    return diagnostics.adf(series.vectors(series.prepared(kinds(spark, d)))).select("service", "metric", "regression", r("statistic"), r("p_value"))


@query()
def adf_histogram(spark, d):
    return diagnostics.adf_bins(diagnostics.adf(series.vectors(regular(spark, d))))


# --- text formats ----------------------------------------------------------------------


@query("SELECT c_custkey, 'customer c_acctbal=\"' || c_acctbal::VARCHAR || '\",c_nationkey=\"' || c_nationkey::VARCHAR || '\"' AS line FROM customer WHERE c_acctbal = round(c_acctbal) OR true")
def influx_lines(spark, d):
    c = _t(spark, d, "customer")
    m = F.create_map(F.lit("c_acctbal"), F.col("c_acctbal").cast("string"), F.lit("c_nationkey"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", writers.point_line(F.lit("customer"), m).alias("line"))


@query("SELECT 'customer' AS measurement, 'c_nationkey' AS key, c_nationkey::VARCHAR AS text, c_nationkey::DOUBLE AS number FROM customer UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment, NULL FROM customer")
def influx_parse(spark, d):
    c = _t(spark, d, "customer")
    m = F.create_map(F.lit("c_mktsegment"), F.col("c_mktsegment"), F.lit("c_nationkey"), F.col("c_nationkey").cast("string"))
    return readers.parse_points(c.select(writers.point_line(F.lit("customer"), m).alias("value")))


# --- further operators --------------------------------------------------------------------


@query("SELECT vec_id, k::INT AS k, list_aggregate(list_transform(range(1, len(embedding) + 1), lambda i: (CASE WHEN i - k BETWEEN 1 AND len(embedding) THEN round(embedding[i - k]::DOUBLE, 4) ELSE 0 END)::DECIMAL(9, 4)::VARCHAR), 'string_agg', ',') AS rolled FROM (SELECT vec_id, embedding, unnest([-3, 2, 65]) AS k FROM embeddings)")
def zero_pad_roll(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.explode(F.array(F.lit(-3), F.lit(2), F.lit(65))).alias("k"))
    rolled = F.transform(distance.shifted(F.col("x"), F.col("k")), lambda v: F.round(v, 4).cast("decimal(9,4)").cast("string"))
    return e.select("vec_id", "k", F.array_join(rolled, ",").alias("rolled"))


SCORES = "s AS (SELECT c_mktsegment AS service, 2 + (c_custkey % 6)::INT AS k, round(avg(c_acctbal) / 10000, 3) AS silhouette FROM customer GROUP BY ALL)"


def segment_scores(spark, d):
    return _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("service"), (2 + F.col("c_custkey") % 6).cast("int").alias("k")).agg(F.round(F.avg("c_acctbal") / 10000, 3).alias("silhouette"))


@query(f"WITH {SCORES} SELECT service, k::VARCHAR AS index, silhouette AS value FROM s UNION ALL SELECT service, 'best', arg_max(k, (silhouette, -k))::DOUBLE FROM s GROUP BY service")
def index_table(spark, d):
    return distance.index_table(segment_scores(spark, d), ["service"])


@query(f"WITH {SCORES}, p AS (SELECT service, arg_max(k, (silhouette, -k)) AS pk FROM s GROUP BY service), f AS (SELECT c_mktsegment AS service, (8 + count(*) % 9)::INT AS n FROM customer GROUP BY ALL) SELECT service, unnest(range(8, least(n, 15)))::INT AS k FROM p JOIN f USING (service) WHERE pk IN (5, 6, 7) AND least(n, 15) - 1 >= 8")
def larger_ks(spark, d):
    fields = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("service")).agg((8 + F.count("*") % 9).cast("int").alias("n_fields"))
    return distance.larger_ks(distance.preferred_k(segment_scores(spark, d), ["service"]), fields, (5, 6, 7))


@query(CL + """, c AS (SELECT * FROM cl WHERE version = 'f'), p AS (SELECT service, cluster AS old, representative AS was, metrics AS had FROM cl WHERE version = 'nf'),
j AS (SELECT c.service, c.cluster, c.representative, old, was, (was = representative) OR (list_contains(metrics, was) AND list_contains(had, representative)) AS fits FROM c LEFT JOIN p USING (service)),
k AS (SELECT service, cluster, representative, arg_min(was, old) FILTER (fits) AS w FROM j GROUP BY ALL) SELECT service, cluster, coalesce(w, representative) AS representative, w IS NOT NULL AS kept FROM k""")
def hand_over(spark, d):
    c = clusters(spark, d).withColumnRenamed("metrics", "members")
    return clustering.hand_over(c.where("version = 'f'").drop("version"), c.where("version = 'nf'").drop("version"))


@query("SELECT page_id, CASE WHEN contains(url, ':') THEN regexp_extract(url, '^[^:]*:([^/]*)', 1) END AS port, 'nova_' || replace(split_part(url, '/', 3), '.', '_') || '_avg' AS meter FROM pages")
def url_parts(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", names.port_of(F.col("url")).alias("port"), names.meter_name("nova", F.get(F.split("url", "/"), F.lit(2)), "avg").alias("meter"))


@query("SELECT s_suppkey, 'metric ' || lower(replace(s_name, '#', '_')) || ' int32 ' || s_nationkey AS line, 'status ' || CASE WHEN s_acctbal >= 0 THEN 'okay' ELSE 'error negative' END AS status FROM supplier")
def status_lines(spark, d):
    s = _t(spark, d, "supplier")
    ok = F.col("s_acctbal") >= 0
    return s.select("s_suppkey", writers.metric_line(F.lower(F.replace("s_name", F.lit("#"), F.lit("_"))), F.lit("int32"), F.col("s_nationkey")).alias("line"), writers.status_line(ok, F.when(ok, "").otherwise("negative")).alias("status"))


@query(CL + " SELECT service, cluster, CASE WHEN length(representative) > 11 THEN left(representative, 5) || '::' || right(representative, 6) ELSE representative END || ':' || chr(10) || CASE WHEN len(metrics) <= 3 THEN list_aggregate(metrics, 'string_agg', ', ') WHEN len(metrics) <= 6 THEN list_aggregate(metrics[1:3], 'string_agg', ', ') || chr(10) || list_aggregate(metrics[4:6], 'string_agg', ', ') ELSE list_aggregate(metrics[1:3], 'string_agg', ', ') || chr(10) || list_aggregate(metrics[4:6], 'string_agg', ', ') || chr(10) || list_aggregate(metrics[7:9], 'string_agg', ', ') END AS cell FROM cl WHERE version = 'f'")
def metric_table(spark, d):
    return writers.metric_table(clusters(spark, d).where("version = 'f'"))


CELLS = "' ' || chr(9) || 'export ' || upper(event_type) || '=\"' || user_id || '\"' || chr(9)"


@query(f"SELECT event_id, trim({CELLS}, ' ' || chr(9)) AS trimmed, upper(event_type) AS key, user_id::VARCHAR AS value, round(value * 1000, 3) + 0.0 AS ms, date_trunc('second', ts) AS at FROM events")
def parsed_cells(spark, d):
    e = _t(spark, d, "events")
    line = names.trim_blank(F.concat(F.lit(" \texport "), F.upper("event_type"), F.lit('="'), F.col("user_id").cast("string"), F.lit('"\t')))
    kv = names.key_value(line)
    at = names.parse_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return e.select("event_id", line.alias("trimmed"), kv["key"].alias("key"), kv["value"].alias("value"), (names.elapsed_ms(F.col("value")) + 0.0).alias("ms"), at.alias("at"))


@query("SELECT 'lines' AS service, l_shipdate::TIMESTAMP AS ts, unnest(['l_quantity', 'l_tax']) AS metric, unnest([l_quantity::DOUBLE, l_tax::DOUBLE]) AS value FROM lineitem")
def field_projection(spark, d):
    return series.wide_to_long(_t(spark, d, "lineitem"), "lines", ["l_quantity", "l_tax"], "l_shipdate").select("service", "ts", "metric", "value")


@query(FILLED + KINDS + " SELECT service, metric, count(value) AS n, round(var_samp(value), 6) + 0.0 AS variance FROM x GROUP BY ALL HAVING count(value) > 0 AND var_samp(value) <> 0")
def informative_series(spark, d):
    return diagnostics.informative(kinds(spark, d)).select("service", "metric", "n", r("variance"))


@query(P_TABLE + ", x AS (SELECT *, split_part(perpetrator, '|', 1) AS ps, split_part(consequence, '|', 1) AS cs FROM c) SELECT perpetrator, consequence FROM x WHERE ps IN ('s1', 's4') OR cs IN ('s1', 's4')")
def included_services(spark, d):
    return graphs.filter_edges(graphs.split_names(p_table(spark, d)), included=["s1_api", "s4"]).select("perpetrator", "consequence")


ARCS = """WITH a AS (SELECT l_orderkey * 8 + l_linenumber AS line, 'p' || (l_partkey % 50) AS src, l_quantity::DOUBLE AS w, 's' || (l_suppkey % 40) AS dst FROM lineitem)"""


def arc_lines(spark, d):
    li = _t(spark, d, "lineitem")
    value = F.concat(F.lit("p"), F.col("l_partkey") % 50, F.lit(" => "), F.col("l_quantity").cast("string"), F.lit(" =>  s"), F.col("l_suppkey") % 40, F.lit("\t"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), value.alias("value"))


@query(ARCS + " SELECT src, dst, arg_min(w, (line, w)) AS w FROM a GROUP BY ALL")
def first_arcs(spark, d):
    return graphs.distinct_arcs(readers.parse_arcs(arc_lines(spark, d)))


@query(ARCS + " SELECT node, min(seen) AS seen FROM (SELECT src AS node, line * 2 AS seen FROM a UNION ALL SELECT dst, line * 2 + 1 FROM a) GROUP BY node")
def nodes_first_seen(spark, d):
    return graphs.first_seen(readers.parse_arcs(arc_lines(spark, d)))


@query("WITH m AS (SELECT max(greatest(l_partkey, l_suppkey)) AS m FROM lineitem) SELECT unnest(range(0, m + 1))::VARCHAR AS node FROM m")
def numbered_nodes(spark, d):
    li = _t(spark, d, "lineitem")
    return graphs.numeric_nodes(li.select(F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst")))


NAMED = "CASE n_regionkey WHEN 0 THEN 'nova_' WHEN 1 THEN 'neutron_' WHEN 2 THEN 'glance_' ELSE 'keystone_' END || n_nationkey"


@query(f"""WITH s AS (SELECT {NAMED} AS service, n_nationkey AS k FROM nation UNION ALL SELECT 'rabbitmq', NULL), e AS (SELECT DISTINCT a.service AS src, b.service AS dst FROM customer JOIN s a ON a.k = c_nationkey JOIN s b ON b.k = c_custkey % 25),
p AS (SELECT src, dst FROM e WHERE src <> dst UNION ALL SELECT service, 'rabbitmq' FROM s WHERE split_part(service, '_', 1) IN ('nova', 'neutron', 'glance')) SELECT DISTINCT least(src, dst) AS svc_x, greatest(src, dst) AS svc_y FROM p""")
def queue_pairs(spark, d):
    n = F.col("n_regionkey")
    known = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.when(n == 0, "nova_").when(n == 1, "neutron_").when(n == 2, "glance_").otherwise("keystone_"), "n_nationkey").alias("service"))
    calls = _t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("i"), (F.col("c_custkey") % 25).cast("long").alias("j")).distinct()
    calls = calls.join(known.select(F.col("k").alias("i"), F.col("service").alias("src")), "i").join(known.select(F.col("k").alias("j"), F.col("service").alias("dst")), "j")
    services = known.select("service").union(spark.range(1).select(F.lit(graphs.QUEUE)))
    return graphs.call_pairs(calls.select("src", "dst"), services, queue=graphs.QUEUE)


@query("SELECT DISTINCT '\"' || 'n' || c_nationkey || '\" -> \"m' || c_mktsegment || '\"' AS value FROM customer")
def callgraph_dot(spark, d):
    e = _t(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("m"), "c_mktsegment").alias("dst")).distinct()
    return writers.dot_lines(e)


@query("""WITH g AS (SELECT s_nationkey, 'disk' AS resource, s_suppkey * 1.5 AS total, (s_suppkey % 7)::DOUBLE AS used FROM supplier UNION ALL SELECT s_nationkey, 'memory', s_suppkey * 0.5, (s_suppkey % 5)::DOUBLE FROM supplier)
SELECT s_nationkey, resource, sum(total)::DOUBLE AS total, sum(used) AS used, (sum(total) - sum(used))::DOUBLE AS free FROM g GROUP BY ALL""")
def hypervisor_gauges(spark, d):
    k = F.col("s_suppkey")
    hosts = _t(spark, d, "supplier").select("s_nationkey", k.alias("total_disk"), k.alias("total_memory"), (k % 7).alias("used_disk"), (k % 5).alias("used_memory"))
    return monitoring.hypervisor_gauges(hosts, "s_nationkey", {"disk": 1.5, "memory": 0.5})


@query("""SELECT s_suppkey, 'status okay' || chr(10) || 'metric heat_api_local_status uint32 ' || (s_acctbal >= 0)::INT || CASE WHEN s_acctbal >= 0 THEN chr(10) || 'metric heat_api_local_response_time double ' || (s_suppkey % 1000) || '.000 ms' ELSE '' END AS lines FROM supplier""")
def endpoint_checks(spark, d):
    lines = monitoring.endpoint_lines(F.lit("heat_api_local"), F.col("s_acctbal") >= 0, (F.col("s_suppkey") % 1000) / 1000)
    return _t(spark, d, "supplier").select("s_suppkey", F.array_join(lines, "\n").alias("lines"))


@query(CL + """, n AS (SELECT version, service, count(*) AS kept, count(*) + 2 AS raw FROM x GROUP BY ALL) SELECT service, '| ' || service || ' | ' || string_agg(version || ': ' || kept || ' of ' || raw, ', ' ORDER BY version) || ' |' AS value FROM n GROUP BY service""")
def grouped_report(spark, d):
    c = clusters(spark, d).groupBy(F.col("version").alias("measurement_name"), "service").agg(F.sum(F.size("metrics")).alias("kept_metrics"))
    return writers.grouped_report(c.withColumn("raw_metrics", F.col("kept_metrics") + 2))


@query(CL + """, p AS (SELECT service, cluster, '* ' || cluster || ': ' || list_aggregate(metrics, 'string_agg', ', ') AS line FROM cl WHERE version = 'f') SELECT service, 4::INT AS k, '## ' || service || ', k = 4' || chr(10) || string_agg(line, chr(10) ORDER BY cluster) AS value FROM p GROUP BY service""")
def cluster_pages(spark, d):
    c = clusters(spark, d).where("version = 'f'").select("service", F.lit(4).alias("k"), F.explode("metrics").alias("metric"), "cluster")
    return writers.cluster_pages(c)


@query("SELECT n_nationkey || ' & ' || n_name || ' ' || chr(92) || chr(92) AS value FROM nation")
def latex_rows(spark, d):
    return writers.latex_rows(_t(spark, d, "nation").select("n_nationkey", "n_name"))


@query("WITH b AS (SELECT o_orderpriority AS regression, round((o_orderkey % 97) / 97.0 / 0.05) AS bin, count(*) AS n FROM orders GROUP BY ALL) SELECT regression, bin::INT AS bin, least(n, 10) AS n FROM b")
def sampled_bins(spark, d):
    tests = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("regression"), ((F.col("o_orderkey") % 97) / 97).alias("p_value"), F.lit("orders").alias("service"), F.col("o_orderkey").cast("string").alias("metric"))
    return diagnostics.sampled_per_bin(tests).groupBy("regression", F.round(F.col("bin") * 20).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS service, ts, 0::INT AS source, value FROM events UNION ALL SELECT 'orders', o_orderdate::TIMESTAMP, 1, o_totalprice::DOUBLE FROM orders")
def merged_by_time(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("service"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    o = _t(spark, d, "orders").select(F.lit("orders").alias("service"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").cast("double").alias("value"))
    return series.merged(e, o)


@query(f"""WITH {SCORES}, p AS (SELECT service, arg_max(k, (silhouette, -k)) AS pk FROM s GROUP BY service HAVING service <> 'MACHINERY'), m AS (SELECT DISTINCT c_mktsegment AS service, 'm' || c_nationkey AS metric FROM customer)
SELECT service, metric FROM m LEFT JOIN p USING (service) WHERE pk IS NULL OR metric = 'm' || pk""")
def reduced_frame(spark, d):
    scores = segment_scores(spark, d)
    preferred = distance.preferred_k(scores, ["service"]).where("service <> 'MACHINERY'")
    reps = scores.select("service", "k", F.concat(F.lit("m"), "k").alias("representative"))
    rows = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("service"), F.concat(F.lit("m"), "c_nationkey").alias("metric")).distinct()
    return distance.reduced(rows, reps, preferred).select("service", "metric")
