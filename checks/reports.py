"""Joins, counts, pivots, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.tables import (
    AIRINGS_SQL, EVENT_AIRINGS_SQL, LABELLED_SQL, PARTIES, PARTY_CELLS_SQL, airings, event_airings, labelled, table,
)
from spotlake.operators.aggregates import (
    count_with_nonnull, group_count, histogram, last_value, merge_latest, top_groups, within_top_groups,
)
from spotlake.operators import sketches as S
from spotlake.operators.joins import join_spots
from spotlake.operators.quantiles import box_plot, exact_quantiles, outliers
from spotlake.plans import reports as R
from spotlake.sources.scratch import materialise, scratch_path


@query("topk_group_category_pivot", f"""
    WITH {AIRINGS_SQL},
    best AS (SELECT estado FROM airings GROUP BY estado ORDER BY count(*) DESC, estado LIMIT 10)
    SELECT estado, {PARTY_CELLS_SQL} FROM airings WHERE estado IN (SELECT estado FROM best) GROUP BY estado""")
def _topk(spark, d):
    return R.top_states_by_party(airings(spark, d), "estado", 10, PARTIES)


@query("top_groups", f"""
    WITH {AIRINGS_SQL} SELECT estado, count(*) AS n FROM airings GROUP BY estado ORDER BY n DESC, estado LIMIT 10""")
def _top_groups(spark, d):
    return top_groups(airings(spark, d).counts(["estado"]), "estado", 10)


@query("top_group_rows", f"""
    WITH {AIRINGS_SQL},
    best AS (SELECT estado FROM airings GROUP BY estado ORDER BY count(*) DESC, estado LIMIT 10)
    SELECT estado, partido, count(*) AS n FROM airings WHERE estado IN (SELECT estado FROM best) GROUP BY estado, partido""")
def _top_rows(spark, d):
    counts = materialise(airings(spark, d).counts(["estado"]), "counts")
    return within_top_groups(counts, "estado", 10)


@query("group_pivot_by_total", f"WITH {AIRINGS_SQL} SELECT estado, {PARTY_CELLS_SQL} FROM airings GROUP BY estado")
def _by_total(spark, d):
    return R.states_by_party(airings(spark, d), "estado", PARTIES)


@query("medium_category_pivot", f"WITH {AIRINGS_SQL} SELECT medio, {PARTY_CELLS_SQL} FROM airings GROUP BY medio")
def _medium(spark, d):
    return R.media_by_party(airings(spark, d), "medio", PARTIES)


@query("group_count_two_keys",
       f"WITH {AIRINGS_SQL} SELECT estado, partido, count(*) AS n FROM airings GROUP BY estado, partido")
def _two_keys(spark, d):
    return airings(spark, d).counts(["estado"])


@query("group_share", f"""
    WITH {AIRINGS_SQL}, c AS (SELECT partido, count(*) AS n FROM airings GROUP BY partido)
    SELECT partido, n, round(100.0 * n / sum(n) OVER (), 1) AS share_pct FROM c""")
def _share(spark, d):
    return R.party_share(airings(spark, d))


@query("count_by_date", f"""
    WITH {EVENT_AIRINGS_SQL} SELECT strftime(ts, '%Y-%m-%d') AS fecha, count(*) AS n FROM airings GROUP BY fecha""")
def _per_date(spark, d):
    a = event_airings(spark, d).with_column("fecha", F.to_date("ts"))
    return R.airings_per_date(a, "fecha").withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd"))


@query("count_by_hour", f"""
    WITH {EVENT_AIRINGS_SQL} SELECT CAST(hour(ts) AS INTEGER) AS "HORA", count(*) AS n FROM airings GROUP BY 1""")
def _per_hour(spark, d):
    return R.airings_per_hour(event_airings(spark, d), F.hour("ts"))


@query("count_by_month_hour", f"""
    WITH {EVENT_AIRINGS_SQL}
    SELECT CAST(month(ts) AS INTEGER) AS "MES", CAST(hour(ts) AS INTEGER) AS "HORA", count(*) AS n
    FROM airings GROUP BY 1, 2""")
def _per_month_hour(spark, d):
    return R.airings_per_month_hour(event_airings(spark, d), F.month("ts"), F.hour("ts"))


@query("month_line", f"""
    WITH {EVENT_AIRINGS_SQL}
    SELECT CAST(month(ts) AS INTEGER) AS "MES", CAST(hour(ts) AS INTEGER) AS "HORA", count(*) AS n
    FROM airings WHERE month(ts) = 1 GROUP BY 1, 2""")
def _month_line(spark, d):
    return R.month_line(R.airings_per_month_hour(event_airings(spark, d), F.month("ts"), F.hour("ts")), 1)


@query("count_nonnull_order", f"""
    WITH {LABELLED_SQL}
    SELECT source, quality, count(*) AS n, count(quality) AS n_nonnull FROM labelled GROUP BY source, quality""")
def _nonnull(spark, d):
    return count_with_nonnull(labelled(spark, d), ["source", "quality"], "quality")


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def _rows(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("in_list_filter", """
    SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY event_type""")
def _in_list(spark, d):
    events = table(spark, d, "events")
    return group_count(events.where(F.col("event_type").isin("view", "click", "error")), ["event_type"])


@query("histogram20", """
    WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    f AS (
        SELECT least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS INTEGER), 19) AS bin, count(*) AS n
        FROM events, b GROUP BY 1
    )
    SELECT CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * ((hi - lo) / 20), 6) AS lower,
        round(lo + (r.bin + 1) * ((hi - lo) / 20), 6) AS upper, coalesce(f.n, 0) AS n
    FROM range(20) AS r(bin) LEFT JOIN f ON r.bin = f.bin, b""")
def _histogram(spark, d):
    return histogram(table(spark, d, "events"), "value", 20).withColumns(
        {"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


_BOX_SQL = """
    q AS (
        SELECT {group}, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
            quantile_cont(x, 0.75) AS q3
        FROM v GROUP BY {group}
    )"""

_BOX_OUT = """
    SELECT v.{group}, any_value(q.n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
        round(any_value(q3), 6) AS q3,
        round(least(min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), any_value(q1)), 6)
            AS whisker_low,
        round(greatest(max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), any_value(q3)), 6)
            AS whisker_high,
        count(*) FILTER (WHERE NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM v JOIN q ON v.{group} = q.{group} GROUP BY v.{group}"""

BOX_COLUMNS = ["q1", "median", "q3", "whisker_low", "whisker_high"]


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("boxplot_by_group", f"""
    WITH v AS (SELECT event_type, value AS x FROM events WHERE event_type IN ('view', 'click', 'error')),
    {_BOX_SQL.format(group='event_type')} {_BOX_OUT.format(group='event_type')}""")
def _box(spark, d):
    events = table(spark, d, "events").select("event_type", "value")
    return rounded(R.score_box_plot(events, "event_type", "value", ["view", "click", "error"]), BOX_COLUMNS)


@query("merged_boxplot", """
    SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, true AS near FROM events GROUP BY event_type""")
def _merged_box(spark, d):
    """Quantile sketches per type and day, stored by two loads and merged; quartiles within the rank error of the sketch."""
    events = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    middle = F.col("day") < "2024-01-15"
    first = S.quantile_sketches(events.where(middle), ["event_type", "day"], "value")
    store = S.SketchStore(spark, scratch_path(spark, "sketches"), first.schema)
    store.add("early", first)
    store.add("late", S.quantile_sketches(events.where(~middle), ["event_type", "day"], "value"))
    merged = materialise(S.merged_quantiles(store.rows(), ["event_type"], [0.25, 0.5, 0.75]), "merged")
    beside = events.join(merged, "event_type")
    places = [F.avg((F.col("value") < F.col(f"q{i}")).cast("int")) <= p + S.KLL_RANK_ERROR for i, p in enumerate((0.25, 0.5, 0.75))]
    places += [F.avg((F.col("value") <= F.col(f"q{i}")).cast("int")) >= p - S.KLL_RANK_ERROR for i, p in enumerate((0.25, 0.5, 0.75))]
    near = places[0]
    for place in places[1:]:
        near = near & place
    return beside.groupBy("event_type").agg(
        F.first("n").alias("n"), F.round(F.first("low"), 6).alias("low"), F.round(F.first("high"), 6).alias("high"), near.alias("near"))


@query("boxplot_all_states", f"""
    WITH v AS (
        SELECT n_name, l_extendedprice AS x FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    ),
    {_BOX_SQL.format(group='n_name')} {_BOX_OUT.format(group='n_name')}""")
def _box_states(spark, d):
    from checks.tables import located

    rows = located(spark, d, "lineitem", "supplier", "l_suppkey", "s_suppkey", "s_nationkey")
    return rounded(box_plot(rows.select("n_name", "l_extendedprice"), "n_name", "l_extendedprice"), BOX_COLUMNS)


@query("exact_quantiles", """
    SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS q0,
        round(quantile_cont(l_extendedprice, 0.5), 6) AS q1, round(quantile_cont(l_extendedprice, 0.99), 6) AS q2
    FROM lineitem GROUP BY l_returnflag""")
def _quantiles(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(exact_quantiles(rows, "l_returnflag", "l_extendedprice", [0.1, 0.5, 0.99]), ["q0", "q1", "q2"])


@query("outlier_rows", f"""
    WITH v AS (SELECT event_id, event_type, value AS x FROM events), {_BOX_SQL.format(group='event_type')}
    SELECT event_id, v.event_type, x AS value FROM v JOIN q ON v.event_type = q.event_type
    WHERE NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def _outliers(spark, d):
    return outliers(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value")


@query("inner_join_spots", """
    SELECT l_orderkey, l_linenumber, l_partkey AS titulo, p_type AS partido, p_brand AS nombre
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _join(spark, d):
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    spots = table(spark, d, "part").select(
        F.col("p_partkey").alias("titulo"), F.col("p_type").alias("partido"), F.col("p_brand").alias("nombre"))
    return join_spots(facts, spots, "l_partkey").drop("l_partkey")


@query("last_value_index",
       "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _last(spark, d):
    return last_value(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("state_merge", """
    WITH fresh AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id)
    SELECT coalesce(f.user_id, c.c_custkey) AS key, coalesce(f.event_type, c.c_mktsegment) AS value
    FROM customer c FULL JOIN fresh f ON c.c_custkey = f.user_id""")
def _merge(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    new = last_value(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select(
        F.col("user_id").alias("key"), F.col("event_type").alias("value"))
    return merge_latest(old, new, "key", "value")
