"""Sources, sinks, state tables and streams, each fed with whole given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import query
from checks.tables import excedentes, table
from spotlake import schemas
from spotlake.operators.aggregates import last_value, merge_latest
from spotlake.operators.columns import LOAD_TIME, with_load_time
from spotlake.plans.cleaning import ReportFolder
from spotlake.plans.jobs import analysis_job, cleaning_job
from spotlake.sources import readers, writers
from spotlake.sources.changes import FollowedFolder
from spotlake.sources.scratch import scratch_path
from spotlake.streaming.loader import StreamTarget, load_folder, read_table_stream
from spotlake.streaming.upsert import UpsertTarget, upsert_folder

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("csv_roundtrip", _CUSTOMER)
def _csv(spark, d):
    customers, path = table(spark, d, "customer"), scratch_path(spark, "csv")
    writers.write_csv(customers, path)
    return readers.read_report(spark, path, customers.schema)


@query("csv_by_position", "SELECT CAST(o_orderkey AS VARCHAR) AS no, o_orderpriority AS estado, o_orderstatus AS cevem FROM orders")
def _csv_position(spark, d):
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), path)
    return readers.read_transmissions(spark, path).select(
        F.col("No").alias("no"), F.col("ESTADO").alias("estado"), F.col("CEVEM").alias("cevem"))


@query("json_spots", """
    SELECT CAST(d.doc_id AS VARCHAR) AS titulo, d.lang AS partido, d.text AS transcripcion, l.quality = 1 AS cautelar
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _json(spark, d):
    path = scratch_path(spark, "json")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("titulo"), F.col("lang").alias("partido"),
        F.col("text").alias("transcripcion"), (F.col("quality") == 1).alias("cautelar"))
    writers.append_json(rows, path)
    return readers.read_spots(spark, path).select("titulo", "partido", "transcripcion", "cautelar")


@query("json_append_new", "SELECT c_custkey AS key, c_name AS name FROM customer")
def _json_append(spark, d):
    path = scratch_path(spark, "json")
    customers = table(spark, d, "customer")
    columns = [F.col("c_custkey").alias("key"), F.col("c_name").alias("name")]
    rows = customers.select(*columns)
    writers.append_new_json(customers.where(F.col("c_mktsegment") == "BUILDING").select(*columns), path, "key")
    writers.append_new_json(rows, path, "key")
    return spark.read.schema(rows.schema).json(path)


@query("append_indexed", """
    SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer""")
def _append_indexed(spark, d):
    """Three appends, the second and third repeating stored customers: only new ones are written."""
    path = scratch_path(spark, "json")
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    for segments in (["BUILDING", "MACHINERY"], ["MACHINERY", "AUTOMOBILE"], None):
        writers.append_indexed_json(customers.where(F.col("segment").isin(segments)) if segments else customers, path, "key")
    return spark.read.schema(customers.schema).json(path)


@query("skip_preamble", """
    SELECT CAST(o_orderkey AS VARCHAR) AS no, nullif(n_name, 'NATION_7') AS estado, strftime(o_orderdate, '%Y-%m-%d') AS fecha,
        o_orderpriority || ', "x"' AS material
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _preamble(spark, d):
    """Every part file gets title lines and a header above its rows."""
    path, skip = scratch_path(spark, "reports"), schemas.EXCEDENTES_PREAMBLE
    rows = excedentes(spark, d).select("`No.`", "ESTADO", "FECHA TRANSMISIÓN", F.concat("MATERIAL", F.lit(', "x"')).alias("MATERIAL"))
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"escapeQuotes": "true"})
    title = [f"Reporte {i}" for i in range(skip)] + [",".join(rows.columns)]

    def with_title(batches):
        import pandas as pd

        yield pd.DataFrame({"value": title})
        yield from batches

    rows.select(line.alias("value")).mapInPandas(with_title, "value string").write.text(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in rows.columns])
    return readers.read_report_with_preamble(spark, path, schema, skip).toDF("no", "estado", "fecha", "material")


@query("quoted_line_breaks", """
    SELECT CAST(doc_id AS VARCHAR) AS no, lang AS estado, text AS material, source AS actor FROM documents""")
def _quoted(spark, d):
    """Whole texts, most of several lines, as quoted fields of report files with title lines and a header."""
    path, skip = scratch_path(spark, "reports"), schemas.REQUERIMIENTOS_PREAMBLE
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("no"), F.col("lang").alias("estado"),
                                               F.col("text").alias("material"), F.col("source").alias("actor"))
    line = F.to_csv(F.struct(*rows.columns), {"escapeQuotes": "true"})
    title = [f'Reporte "{i}' for i in range(skip)] + [",".join(rows.columns)]

    def with_title(batches):
        import pandas as pd

        yield pd.DataFrame({"value": title})
        yield from batches

    rows.select(line.alias("value")).mapInPandas(with_title, "value string").write.text(path)
    return readers.read_report_with_preamble(spark, path, rows.schema, skip)


@query("family_folder", """
    SELECT 'exc' AS family, CAST(o_orderkey AS VARCHAR) AS no, o_orderstatus AS estado FROM orders
    UNION ALL SELECT 'req', CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer""")
def _folder(spark, d):
    """Two report families in one folder, told apart by file name."""
    base = scratch_path(spark, "reports")
    exc = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("No."), F.col("o_orderstatus").alias("ESTADO"))
    req = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("No."), F.col("c_mktsegment").alias("Entidad"))
    for df, prefix, schema in ((exc, "Excedentes_", schemas.EXCEDENTES), (req, "Requerimientos_", schemas.REQUERIMIENTOS)):
        filled = df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast("string").alias(f.name)
                             for f in schema.fields])
        writers.write_csv(filled, f"{base}/{prefix}1.csv")
    found_exc, found_req = ReportFolder(base).read(spark)
    return found_exc.select(F.lit("exc").alias("family"), F.col("`No.`").alias("no"), F.col("ESTADO").alias("estado")).unionAll(
        found_req.select(F.lit("req"), F.col("`No.`"), F.col("Entidad")))


@query("converted_reports", """
    SELECT CAST(o_orderkey AS VARCHAR) AS no, 'excedentes' AS family FROM orders
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'requerimientos' FROM customer""")
def _converted(spark, d):
    path = scratch_path(spark, "parquet")
    writers.convert_reports(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("no")), path, "excedentes")
    writers.convert_reports(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("no")), path, "requerimientos")
    return spark.read.schema("no string, family string").parquet(path)


@query("table_roundtrip", "SELECT o_orderkey, o_orderpriority AS \"order priority\", o_orderstatus FROM orders")
def _table(spark, d):
    name = f"orders_{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("order priority"), "o_orderstatus")
    writers.write_external_table(rows, name, scratch_path(spark, name), partition_by=["o_orderstatus"])
    return spark.sql(f"SELECT * FROM {name}")


@query("table_overwrite", "SELECT l_orderkey, l_quantity FROM lineitem")
def _overwrite(spark, d):
    """A catalogue table replaced by one with other columns."""
    name = f"lines_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    writers.overwrite_table(table(spark, d, "orders").select("o_orderkey"), name, path)
    writers.overwrite_table(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), name, path)
    return spark.table(name)


@query("versioned_rewrite", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def _rewrite(spark, d):
    """A table replaced by a result computed from itself."""
    base = scratch_path(spark, "pairs")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    writers.write_version(rows, base)
    writers.write_version(writers.read_version(spark, base, rows.schema).distinct(), base)
    return writers.read_version(spark, base, rows.schema)


@query("state_table", """
    WITH fresh AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id)
    SELECT coalesce(f.user_id, c.c_custkey) AS key, coalesce(f.v, c.c_acctbal) AS value
    FROM customer c FULL JOIN fresh f ON c.c_custkey = f.user_id""")
def _state(spark, d):
    """A key/value state that is loaded, updated and saved twice."""
    base, schema = scratch_path(spark, "state"), T.StructType.fromDDL("key bigint, value double")
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    second = last_value(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"]).select(
        F.col("user_id").alias("key"), "value")
    for update in (first, second):
        writers.save_state(merge_latest(writers.load_state(spark, base, schema), update, "key", "value"), base)
    return writers.load_state(spark, base, schema)


@query("media_listing", "SELECT DISTINCT lang, source FROM documents")
def _media(spark, d):
    """Folders of a two-level media tree, from the listing of its files."""
    path = scratch_path(spark, "media")
    table(spark, d, "documents").select("lang", "source", "text").write.partitionBy("lang", "source").text(path)
    files = readers.list_media(spark, path, ".txt")
    return files.select(F.regexp_extract("path", r"lang=([^/]*)/", 1).alias("lang"),
                        F.regexp_extract("path", r"source=([^/]*)/", 1).alias("source")).distinct()


@query("load_time", "SELECT count(*) AS n, 1 AS n_times FROM orders")
def _load_time(spark, d):
    stamped = with_load_time(table(spark, d, "orders").select("o_orderkey"))
    return stamped.agg(F.count(F.lit(1)).alias("n"),
                       F.count_distinct("Silver_Loadedtimestamp").cast("int").alias("n_times"))


_EVENTS = """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props, true AS loaded FROM events"""


def _target(spark, d, mode):
    schema = table(spark, d, "events").schema
    return schema, StreamTarget(spark, scratch_path(spark, "stream"), schema, mode)


def _events(loaded):
    """All columns of events, and whether the row has a load time that is not in the future."""
    return loaded.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value", "props",
        (F.col(LOAD_TIME) <= F.current_timestamp()).alias("loaded"))


@query("stream_incremental", _EVENTS)
def _stream(spark, d):
    """Loaded twice: the second load finds nothing new. Read back from the catalogue."""
    schema, target = _target(spark, d, "append")
    for _ in range(2):
        load_folder(spark, d, schema, target, glob="events.parquet", max_files=1)
    name = f"events_{uuid.uuid4().hex}"
    target.register(name)
    return _events(spark.sql(f"SELECT * FROM {name}"))


@query("stream_overwrite", _EVENTS)
def _stream_overwrite(spark, d):
    schema, target = _target(spark, d, "overwrite")
    return _events(load_folder(spark, d, schema, target, glob="events.parquet"))


@query("analysis_job", """
    SELECT l_returnflag AS flag, p_type AS partido, count(*) AS n, sum(l_quantity) AS quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def _analysis(spark, d):
    """lineitem as the airings table, part as spots: profiled, written, streamed, read with SQL and joined."""
    airings = table(spark, d, "lineitem").withColumn("No", F.concat_ws("-", "l_orderkey", "l_linenumber")).withColumn(
        "sparse", F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")))
    name = uuid.uuid4().hex
    done = analysis_job(spark, airings, table(spark, d, "part").withColumnRenamed("p_partkey", "titulo"),
                        scratch_path(spark, "analysis"), f"source_{name}", f"airings_{name}", airing_key="l_partkey")
    kept = done.airings.columns
    assert "No" not in kept and "sparse" not in kept and LOAD_TIME in kept
    return done.airings.groupBy(F.col("l_returnflag").alias("flag"), F.col("p_type").alias("partido")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("missing_families", """
    SELECT 'both' AS folder, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_req FROM orders
    UNION ALL SELECT 'one', count(*), 0 FROM orders
    UNION ALL SELECT 'none', 0, 0""")
def _missing_families(spark, d):
    """Folders with both report families, with one, and with none: an absent family is an empty table."""
    orders = table(spark, d, "orders")
    found = []
    for name, families in (("both", ["Excedentes_", "Requerimientos_"]), ("one", ["Excedentes_"]), ("none", [])):
        base = scratch_path(spark, "reports")
        writers.write_csv(orders.select("o_orderkey"), f"{base}/Otros.csv")
        for prefix in families:
            schema = schemas.EXCEDENTES if prefix == "Excedentes_" else schemas.REQUERIMIENTOS
            rows = orders if prefix == "Excedentes_" else orders.where("o_orderstatus <> 'F'")
            writers.write_csv(rows.select(*[F.col("o_orderkey").cast("string").alias(f.name) if f.name == "No." else
                                            F.lit(None).cast("string").alias(f.name) for f in schema.fields]), f"{base}/{prefix}1.csv")
        exc, req = ReportFolder(base).read(spark)
        counted = exc.agg(F.count(F.lit(1)).alias("n")).crossJoin(req.agg(F.count(F.lit(1)).alias("n_req")))
        found.append(counted.select(F.lit(name).alias("folder"), "n", "n_req"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("cleaning_job", """
    SELECT 'EXC' || o_orderkey AS no, strftime(o_orderdate, '%Y-%m-%d') AS fecha, '07:00:00' AS hora, o_orderstatus AS estado FROM orders
    UNION ALL
    SELECT 'REQ' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), '08:00:00', o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def _cleaning_job(spark, d):
    """orders as files of both families; Requerimientos of status F repeat an Excedente."""
    base, target = scratch_path(spark, "reports"), scratch_path(spark, "cleaned")
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    exc = orders.select(F.concat(F.lit("EXC"), key).alias("No."), F.col("o_orderstatus").alias("ESTADO"),
                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("FECHA TRANSMISIÓN"), F.lit("07:00:00").alias("HORA TRANSMISIÓN"))
    same = F.col("o_orderstatus") == "F"
    req = orders.select(F.concat(F.lit("REQ"), key).alias("No."), F.col("o_orderstatus").alias("Entidad"),
                        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Fecha de transmisión del material"),
                        F.when(same, "07:00:00").otherwise("08:00:00").alias("Hora transmisión"))
    for df, prefix, schema in ((exc, "Excedentes_", schemas.EXCEDENTES), (req, "Requerimientos_", schemas.REQUERIMIENTOS)):
        filled = df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast("string").alias(f.name)
                             for f in schema.fields])
        writers.write_csv(filled, f"{base}/{prefix}1.csv")
    cleaning_job(spark, ReportFolder(base), target)
    done = spark.read.option("header", True).csv(target)
    return done.select(F.col("`No.`").alias("no"), F.col("FECHA TRANSMISIÓN").alias("fecha"), F.col("HORA TRANSMISIÓN").alias("hora"),
                       F.col("ESTADO").alias("estado"))


@query("stream_latest", """
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
    FROM events GROUP BY user_id""")
def _stream_latest(spark, d):
    """The same events loaded by two full reloads; the latest row of each user."""
    schema, target = _target(spark, d, "append")
    for _ in range(2):
        stream = read_table_stream(spark, d, schema, glob="events.parquet")
        target.load(stream, full_reload=True).awaitTermination()
    return target.latest(["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("stream_upsert", """
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
        arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id""")
def _stream_upsert(spark, d):
    """Events in several files, in no order of time, merged file by file; then the first files once more by another load."""
    events, folder = table(spark, d, "events"), scratch_path(spark, "events")
    events.repartition(4, "event_type", "event_id").write.parquet(folder)
    target = UpsertTarget(spark, scratch_path(spark, "upsert"), events.schema, ["user_id"], ["ts", "event_id"], buckets=16)
    upsert_folder(target, folder, max_files=1)
    events.where(F.col("event_type") == "view").write.mode("append").parquet(folder)
    return upsert_folder(target, folder).select("user_id", "event_id", "event_type", "value")


@query("stream_changes", """
    SELECT event_id, user_id, event_type, CASE WHEN event_type = 'view' THEN value + 1 ELSE value END AS value
    FROM events WHERE event_type <> 'error'""")
def _stream_changes(spark, d):
    """A folder with a file a type; then one is rewritten in place, one removed, one added, and the table follows."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    folder, draft = scratch_path(spark, "events"), scratch_path(spark, "draft")
    target = FollowedFolder(spark, folder, scratch_path(spark, "followed"), events.schema)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def put(rows, name):
        """Files under names of their own, replacing what is there."""
        rows.write.mode("overwrite").parquet(f"{draft}/{name}")
        fs = paths(folder).getFileSystem(conf)
        for i, part in enumerate(sorted(s.getPath().toString() for s in fs.globStatus(paths(f"{draft}/{name}/part-*")))):
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, paths(part), fs, paths(f"{folder}/{name}-{i}.parquet"), False, True, conf)

    kinds = ["view", "error", "click", "signup"]
    for kind in kinds:
        put(events.where(F.col("event_type") == kind), kind)
    assert set(target.load()) == {"added"}
    put(events.where("event_type = 'view'").withColumn("value", F.col("value") + 1), "view")
    put(events.where("event_type = 'click'"), "click")
    put(events.where(~F.col("event_type").isin(kinds)), "others")
    fs = paths(folder).getFileSystem(conf)
    for gone in fs.globStatus(paths(f"{folder}/error-*.parquet")):
        fs.delete(gone.getPath(), False)
    assert {"added", "changed", "removed"} <= set(target.load())
    return target.table()
