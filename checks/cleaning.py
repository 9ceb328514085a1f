"""Report cleaning: dates, reconciliation, unions, profiles, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.tables import FAMILIES_SQL, LABELLED_SQL, excedentes, labelled, requerimientos, table
from spotlake import schemas
from spotlake.functions import dates as D
from spotlake.functions import names as N
from spotlake.operators.columns import as_text, drop_columns, first_of_each_name, rename_columns, string_columns
from spotlake.operators.joins import (
    append_all, append_new, cross_duplicates, lookup_enrich, pending, remove_cross_duplicates,
)
from spotlake.operators.profile import (
    distinct_profile, drop_sparse_columns, duplicate_rows, key_sets, nested_key_sets, null_profile,
)
from spotlake.operators.sketches import SketchStore, column_sketches, distinct_error, merged_profile
from spotlake.operators.sets import outer_union, sort_nulls_last, union_files
from spotlake.plans import cleaning as C
from spotlake.plans.catalogue import pending_audio
from spotlake.sources.scratch import scratch_path

KEYS = (schemas.EXCEDENTES_KEYS, schemas.REQUERIMIENTOS_KEYS)

_SAME = "e.estado IS NOT DISTINCT FROM r.estado AND e.fecha = r.fecha AND e.hora = r.hora"
_MATCH = "e.estado = r.estado AND e.fecha = r.fecha AND e.hora = r.hora"


def families(spark, d):
    return C.combine_excedentes(excedentes(spark, d)), C.combine_requerimientos(requerimientos(spark, d))


@query("cross_dup_count", f"""
    WITH {FAMILIES_SQL},
    e AS (SELECT estado, fecha, hora, count(*) AS n FROM exc GROUP BY ALL),
    r AS (SELECT estado, fecha, hora, count(*) AS n FROM req GROUP BY ALL)
    SELECT CAST(sum(e.n * r.n) AS BIGINT) AS pairs, CAST(sum(e.n) AS BIGINT) AS first_rows,
        CAST(sum(r.n) AS BIGINT) AS second_rows
    FROM e JOIN r ON {_SAME}""")
def _cross_count(spark, d):
    counts = cross_duplicates(*families(spark, d), *KEYS)
    return counts.select(*[F.col(c).cast("bigint").alias(c) for c in counts.columns])


@query("cross_dup_remove", f"""
    WITH {FAMILIES_SQL}
    SELECT no, estado, fecha, hora FROM req r WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE {_MATCH})""")
def _cross_remove(spark, d):
    kept = remove_cross_duplicates(*families(spark, d), *KEYS)
    return kept.toDF("no", "estado", "organo", "fecha", "hora", "folio", "actor").select("no", "estado", "fecha", "hora")


@query("reconcile_summary", f"""
    WITH {FAMILIES_SQL},
    e AS (SELECT estado, fecha, hora, count(*) AS n FROM exc GROUP BY ALL),
    r AS (SELECT estado, fecha, hora, count(*) AS n FROM req GROUP BY ALL),
    x AS (SELECT sum(e.n * r.n) AS pairs, sum(r.n) AS second_rows FROM e JOIN r ON {_SAME}),
    ed AS (SELECT count(*) - 1 AS extra FROM exc GROUP BY estado, material, actor, fecha, hora),
    rd AS (SELECT count(*) - 1 AS extra FROM req GROUP BY estado, organo, fecha, hora, material, actor)
    SELECT 'first_rows' AS metric, (SELECT count(*) FROM exc) AS value
    UNION ALL SELECT 'second_rows', (SELECT count(*) FROM req)
    UNION ALL SELECT 'first_duplicates', CAST((SELECT sum(extra) FROM ed) AS BIGINT)
    UNION ALL SELECT 'second_duplicates', CAST((SELECT sum(extra) FROM rd) AS BIGINT)
    UNION ALL SELECT 'cross_pairs', CAST((SELECT pairs FROM x) AS BIGINT)
    UNION ALL SELECT 'second_rows_matched', CAST((SELECT second_rows FROM x) AS BIGINT)""")
def _summary(spark, d):
    summary = C.reconciliation(excedentes(spark, d), requerimientos(spark, d), exclude=["No."])
    return summary.withColumn("value", F.col("value").cast("bigint"))


@query("clean_reports", f"""
    WITH {FAMILIES_SQL}
    SELECT no, estado, fecha, hora, material, actor, 'EXCEDENTE' AS calificacion, NULL AS organo FROM exc
    UNION ALL
    SELECT no, estado, fecha, nullif(hora, 'S/D'), material, actor, NULL, organo
    FROM req r WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE {_MATCH})""")
def _clean(spark, d):
    unified = C.clean_reports(excedentes(spark, d), requerimientos(spark, d))
    return unified.toDF("no", "estado", "material", "actor", "fecha", "hora", "calificacion", "organo")


@query("transmissions_table", f"""
    WITH {FAMILIES_SQL},
    u AS (
        SELECT no, fecha || ' ' || hora AS aired FROM exc
        UNION ALL
        SELECT no, fecha || ' ' || nullif(hora, 'S/D')
        FROM req r WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE {_MATCH})
    )
    SELECT no, strftime(try_strptime(aired, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M') AS aired FROM u""")
def _transmissions(spark, d):
    done = C.as_transmissions(C.clean_reports(excedentes(spark, d), requerimientos(spark, d)))
    return done.select(F.col("No").alias("no"), F.date_format("Timestamp", "yyyy-MM-dd HH:mm").alias("aired"))


@query("outer_union", f"""
    WITH {FAMILIES_SQL} SELECT no, estado, material, actor, fecha, hora, NULL AS organo FROM exc
    UNION ALL SELECT no, estado, material, actor, fecha, hora, organo FROM req""")
def _outer_union(spark, d):
    exc, req = families(spark, d)
    both = outer_union(exc, rename_columns(req, schemas.REQUERIMIENTOS_TO_EXCEDENTES)).drop("CALIFICACIÓN")
    return both.toDF("no", "estado", "material", "actor", "fecha", "hora", "organo")


@query("rename_union", """
    SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier""")
def _rename_union(spark, d):
    customers = rename_columns(table(spark, d, "customer"), {
        "c_custkey": "key", "c_name": "name", "c_nationkey": "nation", "c_mktsegment": "segment"})
    suppliers = rename_columns(table(spark, d, "supplier"), {
        "s_suppkey": "key", "s_name": "name", "s_nationkey": "nation"})
    return outer_union(drop_columns(customers, ["c_acctbal"]), drop_columns(suppliers, ["s_acctbal", "absent"]))


@query("union_files", """
    SELECT c_name AS name, c_acctbal AS balance, NULL AS brand FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT p_name, NULL, p_brand FROM part""")
def _union_files(spark, d):
    return union_files([
        table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")),
        table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")),
    ])


@query("prefix_suffix_filter",
       "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND (ends_with(url, '.html') OR ends_with(url, '#top'))")
def _affixes(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", "url").where(
        url.startswith("https://") & (url.endswith(".html") | url.endswith("#top")))


@query("null_filter", f"WITH {LABELLED_SQL} SELECT doc_id, lang FROM labelled WHERE quality IS NULL")
def _null_filter(spark, d):
    return labelled(spark, d).where(F.col("quality").isNull()).select("doc_id", "lang")


@query("text_keys", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem")
def _text_keys(spark, d):
    return as_text(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("first_of_each_name", "SELECT o_orderkey, o_orderstatus AS status FROM orders")
def _first_names(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("status"))
    return first_of_each_name(orders)


@query("dup_rows", """
    SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
    FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)""")
def _dup_rows(spark, d):
    return duplicate_rows(table(spark, d, "documents"), exclude=["doc_id"])


_PROFILED = ["text", "lang", "source", "quality", "toxic"]


@query("null_profile", f"WITH {LABELLED_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS null_pct
        FROM labelled""" for c in _PROFILED))
def _null_profile(spark, d):
    return null_profile(labelled(spark, d)).withColumn("null_pct", F.round("null_pct", 6))


@query("distinct_profile", f"WITH {LABELLED_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct
        FROM labelled""" for c in _PROFILED))
def _distinct_profile(spark, d):
    return distinct_profile(labelled(spark, d))


@query("merged_profile", f"WITH {LABELLED_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS null_pct,
        true AS near FROM labelled""" for c in _PROFILED))
def _merged_profile(spark, d):
    """Sketches of two loads, stored and merged; distinct counts within three standard errors of the exact ones."""
    rows = labelled(spark, d)
    first = column_sketches(rows.where("lang = 'en'"))
    store = SketchStore(spark, scratch_path(spark, "sketches"), first.schema)
    store.add("english", first)
    store.add("others", column_sketches(rows.where("lang IS DISTINCT FROM 'en'")))
    exact = distinct_profile(rows).withColumnRenamed("n_distinct", "exact")
    allowed = F.greatest(F.lit(1.0), F.col("exact") * distinct_error())
    return merged_profile(store.rows()).join(exact, "column").select(
        "column", "n_rows", F.round("null_pct", 6).alias("null_pct"), (F.abs(F.col("n_distinct") - F.col("exact")) <= allowed).alias("near"))


@query("drop_sparse_columns", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _drop_sparse(spark, d):
    return drop_sparse_columns(labelled(spark, d), 30.0)


@query("columns_by_type", "SELECT p_name, p_brand, p_type FROM part")
def _by_type(spark, d):
    parts = table(spark, d, "part")
    return parts.select(*string_columns(parts))


@query("date_dimension", """
    WITH b AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders),
    days AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM b)
    SELECT strftime(d, '%Y-%m-%d') AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
        CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
        CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, strftime(d, '%Y-%m-%d') AS date_key
    FROM days""")
def _dates(spark, d):
    dim = D.date_dimension_for(table(spark, d, "orders"), "o_orderdate")
    return dim.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("date", "date_key")})


def texts_of_dates(spark, d):
    """Order dates in the notations reports use, one part unreadable, and times of day."""
    when, kind, status = F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when((kind == "5-LOW") & (status == "O"), F.date_format(when, "d MMM yyyy"))
        .when((kind == "5-LOW") & (status == "P"), F.date_format(when, "MMMM d, yyyy"))
        .when(kind == "5-LOW", F.lit("S/D"))
        .when((kind == "2-HIGH") & (status == "O"), F.lower(F.date_format(when, "dd-MMM-yyyy")))
        .when((kind == "4-NOT SPECIFIED") & (status == "P"), F.date_format(when, "yyyyMMdd"))
        .when(kind == "2-HIGH", F.date_format(when, "yyyy-MM-dd'T07:00:00'"))
        .when(kind == "3-MEDIUM", F.date_format(when, "dd-MM-yyyy"))
        .when(kind == "4-NOT SPECIFIED", F.date_format(when, "' 'yyyy/MM/dd' '"))
        .when(status == "F", F.date_format(when, "yyyy-MM-dd"))
        .when(status == "P", F.date_format(when, "dd/MM/yy"))
        .otherwise(F.date_format(when, "dd/MM/yyyy")).alias("fecha"),
        F.when((status == "O") & (kind == "2-HIGH"), F.lit("070000")).when((status == "O") & (kind == "3-MEDIUM"), F.lit("12:05 am"))
        .when((status == "O") & (kind == "5-LOW"), F.lit("07:00 PM")).when((status == "O") & (kind == "4-NOT SPECIFIED"), F.lit("25:61:00"))
        .when(status != "P", F.lit("07:08:09"))
        .otherwise(F.lit("1900-01-01 23:59")).alias("hora"),
    )


_TEXTS_SQL = """
    t AS (
        SELECT o_orderkey, o_orderdate AS d,
            CASE o_orderpriority
                WHEN '5-LOW' THEN CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%-d %b %Y')
                    WHEN 'P' THEN strftime(o_orderdate, '%B %-d, %Y') ELSE 'S/D' END
                WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'O' THEN lower(strftime(o_orderdate, '%d-%b-%Y'))
                    ELSE strftime(o_orderdate, '%Y-%m-%dT07:00:00') END
                WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d-%m-%Y')
                WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%Y%m%d')
                    ELSE strftime(o_orderdate, ' %Y/%m/%d ') END
                ELSE CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'P' THEN strftime(o_orderdate, '%d/%m/%y')
                    ELSE strftime(o_orderdate, '%d/%m/%Y') END END AS fecha,
            CASE o_orderstatus WHEN 'F' THEN '07:08:09' WHEN 'P' THEN '1900-01-01 23:59'
                ELSE CASE o_orderpriority WHEN '1-URGENT' THEN '07:08:09' WHEN '2-HIGH' THEN '070000' WHEN '3-MEDIUM' THEN '12:05 am'
                    WHEN '5-LOW' THEN '07:00 PM' ELSE '25:61:00' END END AS hora,
            -- Day and month can be taken for each other.
            o_orderpriority = '3-MEDIUM' OR (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS open
        FROM orders
    )"""


@query("parse_timestamp", f"""
    WITH {_TEXTS_SQL} SELECT o_orderkey,
        strftime(try_strptime(fecha || ' ' || hora, '%d/%m/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS aired FROM t""")
def _parse_ts(spark, d):
    return texts_of_dates(spark, d).select(
        "o_orderkey", F.date_format(D.airing_timestamp("fecha", "hora"), "yyyy-MM-dd HH:mm:ss").alias("aired"))


@query("parse_mixed_dates", f"""
    WITH {_TEXTS_SQL} SELECT o_orderkey, CASE WHEN fecha <> 'S/D' THEN strftime(d, '%Y-%m-%d') END AS day_first,
        CASE WHEN fecha = 'S/D' THEN NULL WHEN open AND day(d) <= 12 THEN strftime(d, '%Y-%d-%m')
            ELSE strftime(d, '%Y-%m-%d') END AS month_first
    FROM t""")
def _parse_mixed(spark, d):
    iso = "yyyy-MM-dd"
    return texts_of_dates(spark, d).select(
        "o_orderkey", F.date_format(D.mixed_date("fecha"), iso).alias("day_first"),
        F.date_format(D.mixed_date("fecha", day_first=False), iso).alias("month_first"))


@query("standardize_datetime", f"""
    WITH {_TEXTS_SQL} SELECT o_orderkey, CASE WHEN fecha <> 'S/D' THEN strftime(d, '%Y-%m-%d') END AS fecha,
        CASE hora WHEN '07:08:09' THEN hora WHEN '1900-01-01 23:59' THEN '23:59:00' WHEN '070000' THEN '07:00:00'
            WHEN '12:05 am' THEN '00:05:00' WHEN '07:00 PM' THEN '19:00:00' END AS hora,
        CASE hora WHEN '07:08:09' THEN 7 WHEN '1900-01-01 23:59' THEN 23 WHEN '070000' THEN 7 WHEN '12:05 am' THEN 0 WHEN '07:00 PM' THEN 19 END AS h
    FROM t""")
def _standardize(spark, d):
    rows = texts_of_dates(spark, d).withColumn("h", D.clock_hour("hora"))
    return D.standardize_datetime(rows, "fecha", "hora")


@query("strict_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS fecha FROM orders")
def _strict(spark, d):
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"))
    return text.select("o_orderkey", F.date_format(D.strict_date("t"), "dd/MM/yyyy").alias("fecha"))


@query("sorted_nulls_last", f"WITH {LABELLED_SQL} SELECT doc_id, lang, quality, source FROM labelled")
def _sorted(spark, d):
    return sort_nulls_last(labelled(spark, d).select("doc_id", "lang", "quality", "source"), ["quality", "lang"], ["doc_id"])


@query("lookup_enrich", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _lookup(spark, d):
    return lookup_enrich(
        table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("pending_work", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _pending(spark, d):
    return pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("append_new", """
    SELECT doc_id, quality, NULL AS lang FROM labels
    UNION ALL SELECT doc_id, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _append_new(spark, d):
    return append_new(
        table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query("append_all", """
    SELECT doc_id, quality, NULL AS lang FROM labels UNION ALL SELECT doc_id, NULL, lang FROM documents""")
def _append_all(spark, d):
    return append_all(
        table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "lang"))


@query("pending_audio", """
    SELECT 'audios/' || source || '/T' || doc_id || '.mp3' AS path FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang IN ('fr', 'es')""")
def _pending_audio(spark, d):
    """Files that are not in the index, of the identifiers asked for."""
    def path(df):
        return df.select(F.concat(F.lit("audios/"), "source", F.lit("/T"), "doc_id", F.lit(".mp3")).alias("path"))

    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    index = path(lookup_enrich(docs, table(spark, d, "labels").select("doc_id"), "doc_id"))
    wanted = docs.where(F.col("lang").isin("fr", "es")).select(F.concat(F.lit("T"), "doc_id").alias("id"))
    return pending_audio(path(docs), index, wanted)


@query("path_parts", r"""
    WITH p AS (SELECT page_id, url, split_part(url, '/', -1) AS name FROM pages)
    SELECT page_id, name, regexp_extract(name, '[^.](\.[^.]*)$', 1) AS extension,
        regexp_replace(name, '([^.])\.[^.]*$', '\1') AS stem, split_part(name, '.', 1) AS id,
        regexp_extract(url, '^[^/]*/(.*)/[^/]*$', 1) AS folder
    FROM p""")
def _paths(spark, d):
    return table(spark, d, "pages").select(
        "page_id", N.file_name("url").alias("name"), N.file_extension("url").alias("extension"),
        N.file_stem("url").alias("stem"), N.file_id("url").alias("id"), N.inner_directory("url").alias("folder"))


@query("audio_paths", r"""
    SELECT page_id, 'audios/' || regexp_extract(url, '^[^/]*/(.*)/[^/]*$', 1) || '/' ||
        regexp_replace(split_part(url, '/', -1), '([^.])\.[^.]*$', '\1') || '.mp3' AS audio
    FROM pages""")
def _audio(spark, d):
    return table(spark, d, "pages").select("page_id", N.audio_path("url").alias("audio"))


@query("key_split", """
    SELECT l_orderkey, l_linenumber, s_name || '_x_' || l_linestatus AS key,
        s_name || '_x' AS actor, l_linestatus AS medium
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus <> 'O'""")
def _key_split(spark, d):
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    rows = lookup_enrich(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus"), suppliers, "l_suppkey")
    keyed = rows.select("l_orderkey", "l_linenumber", F.concat("s_name", F.lit("_x_"), "l_linestatus").alias("key"))
    return keyed.where(N.medium_of("key") != "O").select(
        "*", N.actor_of("key").alias("actor"), N.medium_of("key").alias("medium"))


@query("extract_period", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%d_%m_%Y') END AS starts,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate + INTERVAL 6 DAY, '%d_%m_%Y') END AS ends,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Excedentes_' || strftime(o_orderdate, '%d_%m_%Y') || '_' ||
            strftime(o_orderdate + INTERVAL 6 DAY, '%d_%m_%Y') || '.csv' END AS name,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate + INTERVAL 6 DAY, '%Y-%m-%d') END AS parsed_end
    FROM orders""")
def _period(spark, d):
    until = F.date_add(F.to_date("o_orderdate"), 6)
    text = F.when(F.col("o_orderstatus") == "P", F.lit("Periodo: sin datos")).otherwise(F.concat(
        F.lit("Periodo: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" al "), F.date_format(until, "dd/MM/yyyy")))
    named = table(spark, d, "orders").select("o_orderkey", text.alias("t")).select(
        "o_orderkey", N.period_bound("t", 1).alias("starts"), N.period_bound("t", 2).alias("ends"),
        N.period_file_name("Excedentes", "t").alias("name"))
    return named.withColumn("parsed_end", F.date_format(N.file_period("name", 2), "yyyy-MM-dd"))


@query("keyset_check", """
    SELECT list_aggregate(list_sort(json_keys(props)), 'string_agg', ',') AS keys, count(*) AS n
    FROM events GROUP BY 1""")
def _key_sets(spark, d):
    return key_sets(table(spark, d, "events"), "props")


@query("nested_keysets", """
    SELECT '`u.id`,event,event.id,' || CASE WHEN event_type = 'view' THEN '' ELSE 'event.kind,' END || 'items,items[],items[].v,'
        || CASE WHEN value > 100 THEN 'items[].w,' ELSE '' END || 'props,props.k' AS paths, count(*) AS n
    FROM events GROUP BY 1""")
def _nested_key_sets(spark, d):
    """Nested records from events; some lack a key at some depth, and one key holds a dot."""
    v = F.col("value")
    record = F.struct(
        F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind")).alias("event"),
        F.array(F.struct(v.alias("v"), F.lit(None).cast("double").alias("w")), F.struct(v.alias("v"), F.when(v > 100, v).alias("w"))).alias("items"),
        F.from_json("props", "k int").alias("props"), F.col("user_id").alias("u.id"))
    return nested_key_sets(table(spark, d, "events").select(F.to_json(record).alias("record")), "record")
