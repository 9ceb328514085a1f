"""The given tables in the roles the library works on, in Spark and in SQL.

lineitem plays the airings (state from the supplier's nation, material from the
part), part the spots, orders and lineitem the two report families, documents
the transcripts, events airings with a time of day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.plans.reports import Airings


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def located(spark: SparkSession, folder: str, fact: str, party_table: str, fact_key: str, party_key: str, nation_key: str) -> DataFrame:
    """Fact rows with the nation name of the customer or supplier they point to."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias(nation_key), "n_name")
    facts = table(spark, folder, fact).withColumnRenamed(fact_key, party_key)
    return facts.join(table(spark, folder, party_table), party_key).join(nation, nation_key)


def airings(spark: SparkSession, folder: str) -> Airings:
    """lineitem as airings, part as spots; the part type is the party."""
    facts = located(spark, folder, "lineitem", "supplier", "l_suppkey", "s_suppkey", "s_nationkey").select(
        F.col("l_partkey").alias("MATERIAL"), F.col("n_name").alias("estado"), F.col("l_returnflag").alias("medio"))
    spots = table(spark, folder, "part").select(F.col("p_partkey").alias("titulo"), F.col("p_type").alias("partido"))
    return Airings(facts, spots)


def event_airings(spark: SparkSession, folder: str) -> Airings:
    """events as airings, customer as spots."""
    facts = table(spark, folder, "events").select(F.col("user_id").alias("MATERIAL"), "ts")
    spots = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("titulo"), F.col("c_mktsegment").alias("partido"))
    return Airings(facts, spots)


PARTIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

AIRINGS_SQL = """
    airings AS (
        SELECT n_name AS estado, l_returnflag AS medio, p_type AS partido
        FROM lineitem
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        JOIN part ON l_partkey = p_partkey
    )"""

PARTY_CELLS_SQL = ", ".join(f"""nullif(count(*) FILTER (WHERE partido = '{p}'), 0) AS "{p}\"""" for p in PARTIES)

EVENT_AIRINGS_SQL = "airings AS (SELECT e.ts, c.c_mktsegment AS partido FROM events e JOIN customer c ON e.user_id = c.c_custkey)"

# A nation without a name gives the families NULL keys.
UNNAMED = "NATION_7"


def excedentes(spark: SparkSession, folder: str) -> DataFrame:
    """orders as Excedentes report rows, ISO dates."""
    rows = located(spark, folder, "orders", "customer", "o_custkey", "c_custkey", "c_nationkey")
    clock = F.when(F.col("o_orderstatus") == "F", "07:00:00").when(F.col("o_orderstatus") == "O", "08:15:00").otherwise("09:30:00")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("No."),
        F.nullif("n_name", F.lit(UNNAMED)).alias("ESTADO"),
        F.col("o_orderpriority").alias("MATERIAL"),
        F.col("c_mktsegment").alias("ACTOR"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("FECHA TRANSMISIÓN"),
        clock.alias("HORA TRANSMISIÓN"),
        F.lit("EXCEDENTE").alias("CALIFICACIÓN"),
    )


def requerimientos(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as Requerimientos report rows, day-first dates, some unreadable times."""
    rows = located(spark, folder, "lineitem", "supplier", "l_suppkey", "s_suppkey", "s_nationkey")
    clock = (
        F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "S/D")
        .when(F.col("l_linestatus") == "F", "07:00:00").otherwise("08:15:00")
    )
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("No."),
        F.nullif("n_name", F.lit(UNNAMED)).alias("Entidad"),
        F.col("l_returnflag").alias("Organo"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("Fecha de transmisión del material"),
        clock.alias("Hora transmisión"),
        F.col("l_linestatus").alias("Folio"),
        F.col("s_name").alias("Actor"),
    )


FAMILIES_SQL = f"""
    exc AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS no, nullif(n_name, '{UNNAMED}') AS estado,
            o_orderpriority AS material, c_mktsegment AS actor, strftime(o_orderdate, '%Y-%m-%d') AS fecha,
            CASE o_orderstatus WHEN 'F' THEN '07:00:00' WHEN 'O' THEN '08:15:00' ELSE '09:30:00' END AS hora
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    ),
    req AS (
        SELECT l_orderkey || '-' || l_linenumber AS no, nullif(n_name, '{UNNAMED}') AS estado,
            l_returnflag AS organo, strftime(l_shipdate, '%Y-%m-%d') AS fecha,
            CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'S/D'
                 WHEN l_linestatus = 'F' THEN '07:00:00' ELSE '08:15:00' END AS hora,
            l_linestatus AS material, s_name AS actor
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    )"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """documents with their label, which many lack."""
    labels = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return table(spark, folder, "documents").join(labels, "doc_id", "left")


LABELLED_SQL = """
    labelled AS (
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
            CAST(l.quality AS VARCHAR) AS quality, CAST(l.toxic AS VARCHAR) AS toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    )"""


# The default English stop words of the classifier, as Spark ships them.
ENGLISH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
    he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
    weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot
    could here's how's let's ought that's there's what's when's where's who's why's would
""".split()


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
