"""Queries of panels and sequences: slices, coverage, cohorts, summaries by period, pivots and nested histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import graph, panel, quality, sequence
from weftline.operators.quantiles import group_medians
from weftline.plans.catalogue import CHANGE, FEATURES, PANEL, SHARES, STATE, SUPPLY_SQL, _PERSIST, feature_panel, long_panel, query, rounded, states, states_with_margin, supply_pairs
from weftline.tables import table


@query(f"WITH sp AS (SELECT DISTINCT l_suppkey AS x, l_partkey AS p FROM lineitem) SELECT x, y, round(distance, 6) AS distance FROM ({SUPPLY_SQL}) WHERE x IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND y IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def both_endpoints(s, d):
    """Pairs of suppliers of which both have a positive balance."""
    ids = table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    pairs = supply_pairs(s, d)
    return rounded(graph.within(pairs, ids, "x", "y"))


@query(f"WITH {PANEL} SELECT entity, category, round(value, 6) AS value FROM panel WHERE period = (SELECT max(period) FROM panel)")
def latest_slice(s, d):
    return rounded(panel.latest_slice(long_panel(s, d))).select("entity", "category", "value")


@query(f"WITH {FEATURES} SELECT entity, period, s_promo, c_small FROM (SELECT entity, period, round(s_promo, 6) AS s_promo, round(c_small, 2) AS c_small FROM feat) WHERE s_promo >= 0.15 AND c_small >= 50000")
def threshold_filter(s, d):
    f = feature_panel(s, d).select("entity", "period", F.round("s_promo", 6).alias("s_promo"), F.round("c_small", 2).alias("c_small"))
    return f.where("s_promo >= 0.15 and c_small >= 50000")


@query("WITH g AS (SELECT c_nationkey AS setting, round(avg(c_acctbal), 6) AS score, count(*) AS n FROM customer GROUP BY 1) SELECT setting, score, n FROM g WHERE score >= (SELECT max(score) FROM g) - 500 ORDER BY n, setting DESC LIMIT 1")
def near_best_pick(s, d):
    """Of the nations within 500 of the best mean balance the one with the fewest customers, the last on ties."""
    g = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("setting")).agg(F.round(F.avg("c_acctbal"), 6).alias("score"), F.count("*").alias("n"))
    return panel.near_best(g, "score", F.asc("n"), F.desc("setting"), slack=500)


@query("WITH g AS (SELECT c_nationkey AS setting, round(avg(c_acctbal), 6) AS score, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT * FROM g WHERE setting = 7), e AS (SELECT g.* FROM g, b WHERE g.setting <> 7 AND g.n >= b.n - 5 AND g.score >= b.score - 1000) SELECT * FROM e WHERE score >= (SELECT max(score) FROM e) - 500 ORDER BY n, setting DESC LIMIT 1")
def near_best_reaching(s, d):
    """The same among nations with at most 5 customers fewer and 1000 less mean balance than nation 7."""
    g = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("setting")).agg(F.round(F.avg("c_acctbal"), 6).alias("score"), F.count("*").alias("n"))
    eligible = panel.reaching(g, F.col("setting") == 7, {"n": 5, "score": 1000})
    return panel.near_best(eligible, "score", F.asc("n"), F.desc("setting"), slack=500)


@query(f"WITH {CHANGE} SELECT entity, period FROM ch WHERE label = 'click' AND changed AND previous = 'view'")
def visible_entities(s, d):
    """Users of one state that has just changed from another."""
    c = sequence.changes(states(s, d), "entity", "period", "label")
    return c.where((F.col("label") == "click") & F.col("changed") & (F.col("previous") == "view")).select("entity", "period")


@query(f"WITH {FEATURES} SELECT entity, period, " + ", ".join(f"round({c}, 6) AS {c}" for c in SHARES if c != "s_promo") + " FROM feat")
def feature_subset(s, d):
    keep = panel.missing_names(SHARES, "s_promo")
    return rounded(feature_panel(s, d).select("entity", "period", *keep))


@query(f"WITH {FEATURES} SELECT round(min(r), 6) AS low, round(median(r), 6) AS mid, round(max(r), 6) AS high FROM (SELECT (c_economy + c_large + c_promo) / total AS r FROM feat)")
def ratio_distribution(s, d):
    return rounded(panel.total_ratio(feature_panel(s, d), ["c_economy", "c_large", "c_promo"], "total"))


_MEANS = ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}, CAST(count({c}) AS BIGINT) AS n_{c}" for c in ("l_discount", "l_tax"))


@query(f"WITH x AS (SELECT l_returnflag, CASE WHEN l_orderkey % 5 > 0 THEN l_discount END AS l_discount, CASE WHEN l_orderkey % 7 > 0 THEN l_tax END AS l_tax FROM lineitem) SELECT l_returnflag, {_MEANS} FROM x GROUP BY 1")
def grouped_means(s, d):
    """Means, extremes and counts of what is a number, of columns with nulls and NaN."""
    k = F.col("l_orderkey")
    x = table(s, d, "lineitem").select("l_returnflag", F.when(k % 5 > 0, F.col("l_discount")).alias("l_discount"), F.when(k % 7 > 0, F.col("l_tax")).otherwise(float("nan")).alias("l_tax"))
    return rounded(panel.means(x, ["l_returnflag"], ["l_discount", "l_tax"]))


@query(f"WITH {STATE} SELECT period, round(avg(CAST(label = 'view' AS INT)), 6) AS agreement FROM st GROUP BY period")
def agreement_share(s, d):
    return rounded(quality.agreement(states(s, d).withColumn("other", F.lit("view")), "label", "other", ("period",)))


@query("WITH n AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW' GROUP BY ALL), g AS (SELECT y, p, coalesce(n, 0) AS n FROM (SELECT DISTINCT y FROM n) CROSS JOIN (SELECT DISTINCT p FROM n) LEFT JOIN n USING (y, p)) SELECT round(min(n / t), 6) AS least_share FROM (SELECT n, sum(n) OVER (PARTITION BY y) AS t FROM g)")
def least_label_share(s, d):
    o = table(s, d, "orders").where("o_orderstatus <> 'F' or o_orderpriority <> '5-LOW'").select(F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("label"))
    return rounded(quality.least_share(o))


@query(f"WITH {PANEL}, e AS (SELECT s_suppkey AS entity, count(DISTINCT period) AS n FROM supplier LEFT JOIN panel ON entity = s_suppkey GROUP BY 1), p AS (SELECT CASE WHEN n = (SELECT count(DISTINCT period) FROM panel) AND entity % 4 > 0 THEN 'in model' WHEN n < (SELECT count(DISTINCT period) FROM panel) THEN 'incomplete series' ELSE 'complete, not in model' END AS part FROM e) SELECT part, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1")
def coverage_split(s, d):
    """Suppliers in a model that lacks every fourth, those with gaps, and the rest."""
    p = long_panel(s, d)
    ids = table(s, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return panel.coverage_split(ids, p, panel.complete(p).where("entity % 4 > 0"))


@query("WITH g AS (SELECT c_nationkey AS setting, avg(c_acctbal) AS score FROM customer GROUP BY 1) SELECT CAST(count(*) FILTER (WHERE score > 4500) AS BIGINT) AS better, arg_max(setting, score) AS best, arg_min(setting, score) AS worst FROM g")
def beating_baseline(s, d):
    g = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("setting")).agg(F.avg("c_acctbal").alias("score"))
    return g.agg(F.count_if(F.col("score") > 4500).alias("better"), F.max_by("setting", "score").alias("best"), F.min_by("setting", "score").alias("worst"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS type, CAST(count(*) AS BIGINT) AS n, round(median(o_totalprice), 6) AS target FROM orders GROUP BY ALL")
def median_target(s, d):
    rows = table(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("target"))
    return rounded(rows.groupBy("year", "type").agg(F.count("*").alias("n")).join(group_medians(rows, ["year", "type"], ["target"]), ["year", "type"]))


@query(f"WITH {STATE}, x AS (SELECT entity, count(DISTINCT label) AS n FROM st GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS entities, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS unchanged FROM x")
def unchanged_entities(s, d):
    return sequence.unchanged(states(s, d), "entity", "label")


@query(f"WITH {STATE}, f AS (SELECT entity, arg_min(label, period) AS cohort FROM st GROUP BY 1) SELECT cohort, period, CAST(count(*) AS BIGINT) AS n, round(median(margin), 6) AS median FROM st JOIN f USING (entity) GROUP BY ALL")
def cohort_medians(s, d):
    return rounded(sequence.cohort_medians(states_with_margin(s, d), "entity", "period", "label", "margin"))


@query(f"WITH {STATE}, e AS (SELECT entity, min(label) = max(label) AS same, arg_max(margin, period) > arg_min(margin, period) AS more FROM st GROUP BY 1) SELECT count(*) AS n, CAST(count(*) FILTER (WHERE same) AS BIGINT) AS unchanged, CAST(count(*) FILTER (WHERE more) AS BIGINT) AS growing FROM e")
def unchanged_and_growing(s, d):
    """Users, those of one state all along, and those whose margin grew from their first day to their last."""
    return sequence.unchanged_and_growing(states_with_margin(s, d), "entity", "period", "label", "margin")


@query("WITH " + _PERSIST.replace("{n}", "2") + " SELECT from_label, to_label, CAST(count(*) AS BIGINT) AS n FROM pt GROUP BY ALL")
def direction_counts(s, d):
    return sequence.direction_counts(sequence.persistent_transitions(states(s, d), "entity", "period", "label", 2))


@query(f"WITH {CHANGE} SELECT entity, period, previous AS from_label, label AS to_label FROM ch WHERE changed")
def all_changes(s, d):
    return sequence.all_changes(states(s, d), "entity", "period", "label")


@query(f"WITH {CHANGE} SELECT entity, period, label, CAST(row_number() OVER (PARTITION BY entity, changes ORDER BY period) AS INT) AS run_length FROM isl")
def run_as_of(s, d):
    return sequence.run_as_of(states(s, d), "entity", "period", "label")


@query(f"WITH {CHANGE} SELECT period, label, CAST(count(*) AS BIGINT) AS n, coalesce(string_agg(CAST(entity AS VARCHAR), ',' ORDER BY entity) FILTER (WHERE changed), '') AS changed_ids FROM ch GROUP BY ALL")
def monthly_summary(s, d):
    m = sequence.monthly_summary(states(s, d), "entity", "period", "label")
    return m.select("period", "label", "n", F.array_join("changed_ids", ",").alias("changed_ids"))


@query(f"WITH {CHANGE} SELECT period, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(changed AS INT)), 6) AS changed_share FROM ch WHERE previous IS NOT NULL GROUP BY 1")
def adjacent_periods(s, d):
    return rounded(sequence.adjacent_changes(states(s, d), "entity", "period", "label"))


_ARI = """cn AS (SELECT period, previous AS a, label AS b, count(*) AS n FROM ch WHERE previous IS NOT NULL GROUP BY ALL),
ra AS (SELECT period, sum(x * (x - 1) / 2) AS ra FROM (SELECT period, a, sum(n) AS x FROM cn GROUP BY ALL) GROUP BY 1), rb AS (SELECT period, sum(x * (x - 1) / 2) AS rb FROM (SELECT period, b, sum(n) AS x FROM cn GROUP BY ALL) GROUP BY 1),
t AS (SELECT period, sum(n * (n - 1) / 2) AS idx, sum(n) AS m FROM cn GROUP BY 1)"""


@query(f"WITH {CHANGE}, {_ARI}, v AS (SELECT period, idx, ra, rb, CASE WHEN m > 1 THEN ra * rb / (m * (m - 1) / 2) END AS e FROM t JOIN ra USING (period) JOIN rb USING (period)) SELECT period, round(coalesce(CASE WHEN (ra + rb) / 2 - e <> 0 THEN (idx - e) / ((ra + rb) / 2 - e) END, 1), 6) AS ari FROM v")
def adjacent_ari(s, d):
    """Each day's states against those that the same users had before."""
    return rounded(quality.adjacent_ari(states(s, d), "entity", "period", "label"))


@query(f"WITH {PANEL}, t AS (SELECT entity, period, sum(value) AS v, row_number() OVER (PARTITION BY entity ORDER BY period) - 1 AS pos FROM panel GROUP BY entity, period) SELECT entity, CAST(pos // 12 AS INT) AS year, round(avg(v), 6) AS mean FROM t GROUP BY ALL")
def yearly_means(s, d):
    """Means of each twelve values of a supplier's list of monthly totals."""
    t = long_panel(s, d).groupBy("entity", "period").agg(F.sum("value").alias("v"))
    return rounded(sequence.yearly_means(sequence.trajectories(t, "entity", "period", "v").withColumnRenamed("labels", "values"), "entity", "values"))


@query("WITH x AS (SELECT c_mktsegment AS type, c_nationkey AS id, round(avg(c_acctbal), 6) AS margin, count(*) AS n FROM customer GROUP BY ALL) SELECT type, id, margin, n FROM x WHERE n >= 1 QUALIFY row_number() OVER (PARTITION BY type ORDER BY margin DESC, n DESC, id) = 1")
def best_per_type(s, d):
    """The row with the greatest margin of each of the five types, all of which must be there."""
    from weftline.operators import contracts

    x = table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("type"), F.col("c_nationkey").alias("id")).agg(F.round(F.avg("c_acctbal"), 6).alias("margin"), F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy(F.desc("margin"), F.desc("n"), "id")
    best = x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return contracts.complete(best, ["type"], rows=1, groups=5)


@query(f"WITH {PANEL} SELECT entity, CAST(count(DISTINCT period) AS BIGINT) AS periods FROM panel GROUP BY 1 ORDER BY periods DESC, entity")
def coverage_list(s, d):
    return long_panel(s, d).groupBy("entity").agg(F.count_distinct("period").alias("periods")).orderBy(F.desc("periods"), "entity")


@query(f"WITH {STATE} SELECT entity, label FROM st WHERE period = (SELECT max(period) FROM st) ORDER BY entity LIMIT 3")
def first_examples(s, d):
    return panel.latest_slice(states(s, d)).select("entity", "label").orderBy("entity").limit(3)


_YEARS = (1995, 1996)


@query("WITH x AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL) SELECT entity, " + ", ".join(f"max({c}) FILTER (WHERE y = {y}) AS {c}_{y}" for c in ("n", "price") for y in _YEARS) + " FROM x GROUP BY entity")
def year_pivot(s, d):
    """Two values a year in columns named for both."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y"), "o_totalprice").where(F.col("y").isin(*_YEARS))
    x = o.groupBy("entity", "y").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"))
    return panel.pivot_years(x, "entity", "y", ["n", "price"], list(_YEARS))


@query("WITH m AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, o_orderstatus AS label, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY o_custkey, year(o_orderdate), o_orderstatus QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY count(*) DESC, o_orderstatus) = 1) SELECT entity, max(label) FILTER (WHERE y = 1995) AS label_1995, max(label) FILTER (WHERE y = 1996) AS label_1996 FROM m GROUP BY 1")
def label_by_year(s, d):
    """The majority label of each entity and year, a column a year."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("label")).where(F.col("y").isin(*_YEARS))
    return panel.pivot_years(sequence.majority(o, ["entity", "y"], "label"), "entity", "y", ["label"], list(_YEARS))


@query(f"WITH {FEATURES} SELECT entity, string_agg(period, ',' ORDER BY period) AS periods, string_agg(printf('%.3f', s_promo), ',' ORDER BY period) AS promo FROM feat GROUP BY entity")
def nested_history(s, d):
    """Each supplier's periods and shares as lists in one struct."""
    h = panel.histories(feature_panel(s, d).select("entity", "period", "s_promo"), "entity", "period", ["s_promo"])
    text = F.transform("history.s_promo", lambda v: F.format_string("%.3f", v))
    return h.select("entity", F.array_join("history.period", ",").alias("periods"), F.array_join(text, ",").alias("promo"))
