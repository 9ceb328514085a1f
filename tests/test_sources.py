from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake import schemas
from spotlake.operators import columns as C
from spotlake.operators import sets as S
from spotlake.plans.cleaning import ReportFolder, as_transmissions, clean_folder, reconciliation, sort_report
from spotlake.plans import reports as R
from spotlake.sources import readers, writers
from spotlake.sources.scratch import materialise, scratch_path
from spotlake.streaming.loader import StreamTarget, load_folder, read_table_stream

EXC_HEADER = ",".join(schemas.EXCEDENTES_COLUMNS)
REQ_HEADER = ",".join(schemas.REQUERIMIENTOS_COLUMNS)


def exc_line(no, state, day, time, material="RV00001-23", actor="PAN"):
    return (f'{no},{state},18-X,99.9,XH,XH-99.9,{material},TITLE  ,PP,{actor},{day},{time},EXCEDENTE,'
            f'"Radio, S.A.",RADIO,S/D,FM  ,RADIO')


def req_line(no, state, day, time, folio="RV00002-23", actor="MORENA"):
    return f"{no},{state},DATERT,\"Grupo, S.A.\",XH-99.9,4116,{day},{time},{folio},TITLE,{actor},Sí,OF_{no}"


EXC = [exc_line(1, "TABASCO", "2023-11-15", "07:00:00"), exc_line(2, "TABASCO", "2023-11-05", "08:00:00"),
       exc_line(3, "TABASCO", "2023-11-05", "08:00:00")]
REQ = [req_line(1, "TABASCO", "15/11/2023", "07:00:00"), req_line(2, "TABASCO", "05/11/2023", "08:00:00"),
       req_line(3, "TABASCO", "11/05/2023", "08:00:00"), req_line(4, "", "15/11/2023", "07:00:00", actor=""),
       req_line(5, "CHIAPAS", "no date", "25:00:00")]


def write_folder(path, preamble=False):
    def text(header, lines, skip):
        top = [f"Reporte {i}" for i in range(skip)] if preamble else []
        return "\n".join([*top, header, *lines]) + "\n"

    (path / "Excedentes_15_11_2023_21_11_2023.csv").write_text(text(EXC_HEADER, EXC[:1], 8), encoding="utf-8")
    (path / "Excedentes_05_11_2023_14_11_2023.csv").write_text(text(EXC_HEADER, EXC[1:], 8), encoding="utf-8")
    (path / "Requerimientos_05_11_2023_21_11_2023.csv").write_text(text(REQ_HEADER, REQ, 11), encoding="utf-8")
    (path / "Otros.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("preamble", [False, True])
def test_clean_folder(spark, tmp_path, preamble):
    folder = ReportFolder(write_folder(tmp_path, preamble), preamble)
    done = clean_folder(spark, folder)
    assert done.columns == [*schemas.TRANSMISSIONS_COLUMNS, "Timestamp"]
    got = {(r.No, r.ESTADO, r.FECHA_TRANSMISION, r.HORA_TRANSMISION, r.MATERIAL, r.Grupo) for r in done.collect()}
    assert done.count() == 6
    assert got == {
        ("1", "TABASCO", "2023-11-15", "07:00:00", "RV00001-23", None),
        ("2", "TABASCO", "2023-11-05", "08:00:00", "RV00001-23", None),
        ("3", "TABASCO", "2023-11-05", "08:00:00", "RV00001-23", None),
        ("3", "TABASCO", "2023-05-11", "08:00:00", "RV00002-23", "Grupo, S.A."),
        ("4", None, "2023-11-15", "07:00:00", "RV00002-23", "Grupo, S.A."),
        ("5", "CHIAPAS", None, None, "RV00002-23", "Grupo, S.A."),
    }
    times = {r.No: str(r.Timestamp) for r in done.where("CEVEM is not null").collect()}
    assert times["1"] == "2023-11-15 07:00:00"


def test_month_first_reading_is_an_option(spark, tmp_path):
    folder = ReportFolder(write_folder(tmp_path))
    done = clean_folder(spark, folder, day_first=False)
    kept = {(r.No, r.FECHA_TRANSMISION) for r in done.where("Organo is not null").collect()}
    assert ("3", "2023-11-05") not in kept and ("2", "2023-05-11") in kept


def test_reconciliation(spark, tmp_path):
    exc, req = ReportFolder(write_folder(tmp_path)).read(spark)
    got = {r.metric: r.value for r in reconciliation(exc, req, exclude=["No."]).collect()}
    assert got == {"first_rows": 3, "second_rows": 5, "first_duplicates": 1, "second_duplicates": 0,
                   "cross_pairs": 3, "second_rows_matched": 2}


def test_missing_family_is_empty(spark, tmp_path):
    path = tmp_path / "only"
    path.mkdir()
    (path / "Excedentes_1.csv").write_text(EXC_HEADER + "\n" + EXC[0] + "\n", encoding="utf-8")
    exc, req = ReportFolder(str(path)).read(spark)
    assert exc.count() == 1 and req.count() == 0 and req.columns == schemas.REQUERIMIENTOS_COLUMNS
    assert clean_folder(spark, ReportFolder(str(path))).count() == 1
    sourced = readers.read_family(spark, str(path), "Excedentes_", schemas.EXCEDENTES, source_column="source")
    assert sourced.first()["source"] == "Excedentes_1.csv"


def test_a_missing_family_is_told(spark, tmp_path):
    (tmp_path / "Excedentes_1.csv").write_text(EXC_HEADER + "\n" + EXC[0] + "\n", encoding="utf-8")
    assert ReportFolder(str(tmp_path)).missing(spark) == ["Requerimientos_"]
    with pytest.warns(UserWarning, match="Requerimientos_"):
        assert ReportFolder(str(tmp_path)).read(spark)[1].count() == 0
    with pytest.raises(FileNotFoundError, match="Requerimientos_"):
        clean_folder(spark, ReportFolder(str(tmp_path), both="error"))
    assert ReportFolder(str(tmp_path), both="silent").read(spark)[0].count() == 1


def test_sorted_report(spark, tmp_path):
    exc, _ = ReportFolder(write_folder(tmp_path)).read(spark)
    got = sort_report(exc, ["FECHA TRANSMISIÓN", "HORA TRANSMISIÓN"])
    assert [r["No."] for r in got.collect()] == ["2", "3", "1"]


def test_preamble_in_split_files(spark, tmp_path):
    """Files cut into many splits, a preamble with blank and repeated lines, other files in the same task."""
    for name, rows in (("a", 3000), ("b", 1), ("c", 0), ("d", 500)):
        body = [f"{name}{i},x" for i in range(rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["t", "", "t", "k,v", *body]) + "\n", encoding="utf-8")
    schema = T.StructType.fromDDL("k string, v string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        df = readers.read_report_with_preamble(spark, str(tmp_path), schema, 3)
        assert df.rdd.getNumPartitions() > 4
        counts = {r.f: r["count"] for r in df.groupBy(F.substring("k", 1, 1).alias("f")).count().collect()}
        assert counts == {"a": 3000, "b": 1, "d": 500}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_unexpected_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t\nk,w\n1,2\n", encoding="utf-8")
    schema = T.StructType.fromDDL("k string, v string")
    with pytest.raises(Exception, match="unexpected header"):
        readers.read_report_with_preamble(spark, str(tmp_path), schema, 1).collect()
    with pytest.raises(Exception):
        readers.read_report(spark, str(tmp_path), schema).collect()


def test_spots_json(spark, tmp_path):
    array = '[{"titulo":"RV1","cautelar":false,"ruta":"text","partido":"PAN"},{"titulo":"RV2","transcripcion":"hola"}]'
    (tmp_path / "data.json").write_text(array, encoding="utf-8")
    got = readers.read_spots(spark, str(tmp_path / "data.json")).orderBy("titulo").collect()
    assert [(r.titulo, r.cautelar, r.ruta, r.partido, r.transcripcion) for r in got] == [
        ("RV1", False, None, "PAN", None), ("RV2", None, None, None, "hola")]
    (tmp_path / "pretty.json").write_text('[\n {\n "titulo": "RV3"\n }\n]', encoding="utf-8")
    assert readers.read_spots(spark, str(tmp_path / "pretty.json"), pretty=True).first().titulo == "RV3"


def test_transmissions_by_position(spark, tmp_path):
    (tmp_path / "t.csv").write_text("other,names,here\n1,TABASCO,x\n", encoding="utf-8")
    row = readers.read_transmissions(spark, str(tmp_path / "t.csv")).first()
    assert (row["No"], row["ESTADO"], row["CEVEM"], row["MEDIO"]) == ("1", "TABASCO", "x", None)


def test_media_listing_reads_no_content(spark, tmp_path):
    for name in ("x/a.mp3", "x/b.mp4", "y/c.mp3"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    listing = readers.list_media(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 2)[1:], r.length) for r in listing.collect()) == [(["x", "a.mp3"], 5), (["y", "c.mp3"], 5)]
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString()


def test_state_and_versions(spark, tmp_path):
    base, schema = str(tmp_path / "index"), schemas.TRANSCRIPTION_INDEX
    assert writers.load_state(spark, base, schema).count() == 0
    writers.save_state(spark.createDataFrame([("a", "x")], schema), base)
    grown = writers.load_state(spark, base, schema).unionByName(spark.createDataFrame([("b", "y")], schema))
    writers.save_state(grown, base)
    assert writers.versions(spark, base) == [0, 1]
    assert writers.load_state(spark, base, schema).count() == 2
    (tmp_path / "index" / "v=2").mkdir()
    assert writers.load_state(spark, base, schema).count() == 2


def test_json_append(spark, tmp_path):
    path = str(tmp_path / "records")
    first = spark.createDataFrame([("RV1", "a")], "titulo string, t string")
    more = spark.createDataFrame([("RV1", "b"), ("RV2", "c")], "titulo string, t string")
    writers.append_new_json(first, path, "titulo")
    writers.append_new_json(more, path, "titulo")
    assert sorted(tuple(r) for r in spark.read.schema(first.schema).json(path).collect()) == [("RV1", "a"), ("RV2", "c")]
    writers.append_json(more, path)
    assert spark.read.json(path).count() == 4


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, `Fecha de desahogo` string")
    writers.write_external_table(df, "t_external", str(tmp_path / "t"))
    assert spark.table("t_external").columns == df.columns
    writers.write_external_table(df, "t_parts", str(tmp_path / "p"), partition_by=["k"])
    assert spark.table("t_parts").where("k = 2").count() == 1
    writers.overwrite_table(df, "t_managed")
    writers.overwrite_table(df.select(F.lit(1.5).alias("other")), "t_managed")
    assert spark.table("t_managed").columns == ["other"]
    assert readers.table_if_present(spark, "t_managed", df.schema).count() == 2
    assert readers.table_if_present(spark, "t_none", df.schema).count() == 0
    for t in ("t_external", "t_parts", "t_managed"):
        spark.sql(f"DROP TABLE {t}")


def test_converted_reports(spark, tmp_path):
    df = spark.createDataFrame([("1",)], "no string")
    writers.convert_reports(df, str(tmp_path / "r"), "excedentes")
    writers.convert_reports(df, str(tmp_path / "r"), "requerimientos")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("1", "excedentes"), ("1", "requerimientos")}


def test_materialise_is_new_each_time(spark):
    df = spark.range(3)
    assert materialise(df, "x").count() == 3
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", "b")], "`No.` int, Emisora string, `x y` string")
    assert C.rename_columns(df, {"Emisora": "EMISORA", "absent": "z"}).columns == ["No.", "EMISORA", "x y"]
    assert C.drop_columns(df, ["x y", "CALIFICACIÓN"]).columns == ["No.", "Emisora"]
    assert C.string_columns(df) == ["Emisora", "x y"]
    assert dict(C.as_text(df, ["No."]).dtypes)["No."] == "string"
    assert C.with_load_time(df).columns[-1] == "Silver_Loadedtimestamp"
    twice = df.select("Emisora", F.lit("second").alias("EMISORA"), F.lit(1).alias("n"), F.lit(2).alias("n"))
    assert [tuple(r) for r in C.first_of_each_name(twice).collect()] == [("a", 1)]


def test_unions_and_sort(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(1, "x", 5)], "k int, a string, b int")
    assert [tuple(r) for r in S.outer_union(a, b).orderBy("b").collect()] == [(1, "x", None), (1, "x", 5)]
    assert S.union_files([a, a, a]).count() == 3
    df = spark.createDataFrame([(None, 1), ("b", None), ("b", 2), ("a", 3)], "d string, t int")
    assert [tuple(r) for r in S.sort_nulls_last(df, ["d", "t"]).collect()] == [("a", 3), ("b", 2), ("b", None), (None, 1)]


def test_reports_over_airings(spark):
    airings = spark.createDataFrame(
        [("RV1", "X", "2023-11-05", "07:00:00", "RADIO"), ("RV1", "X", "2023-11-05", "07:30:00", "RADIO"),
         ("RV2", "Y", "2023-12-05", "23:00:00", "TELEVISIÓN"), ("RV9", "Y", "2023-12-05", "23:00:00", "RADIO")],
        "MATERIAL string, ESTADO string, fecha string, hora string, MEDIO2 string")
    spots = spark.createDataFrame([("RV1", "PAN"), ("RV2", "MC")], "titulo string, partido string")
    a = R.Airings(airings, spots)

    def table(df):
        return [tuple(r) for r in df.collect()]

    from spotlake.functions.dates import clock_hour

    assert sorted(table(R.party_share(a))) == [("MC", 1, 33.3), ("PAN", 2, 66.7)]
    assert table(R.airings_per_date(a, "fecha")) == [("2023-11-05", 2), ("2023-12-05", 1)]
    assert table(R.airings_per_hour(a, clock_hour("hora"))) == [(7, 2), (23, 1)]
    both = R.airings_per_month_hour(a, F.month(F.to_date("fecha")), clock_hour("hora"))
    assert table(both) == [(11, 7, 2), (12, 23, 1)]
    assert table(R.month_line(both, 12)) == [(12, 23, 1)]
    assert table(R.states_by_party(a, "ESTADO")) == [("X", None, 2), ("Y", 1, None)]
    assert table(R.top_states_by_party(a, "ESTADO", k=1, parties=["PAN"])) == [("X", 2)]
    assert table(R.media_by_party(a, "MEDIO2")) == [("RADIO", None, 2), ("TELEVISIÓN", 1, None)]
    scores = spark.createDataFrame([("RV1", 0.5), ("RV2", -0.5)], "titulo string, compound double")
    weighted = R.weighted_scores(a, scores, "compound")
    assert sorted(table(weighted)) == [("MC", -0.5), ("PAN", 0.5), ("PAN", 0.5)]
    assert [r.n for r in R.score_histogram(weighted, "compound").orderBy("bin").collect()][::19] == [1, 2]
    assert [r.partido for r in R.score_box_plot(weighted, "partido", "compound", ["PAN"]).collect()] == ["PAN"]


def batch(spark, path, rows):
    spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_stream_over_growing_folder(spark, tmp_path, mode):
    source = str(tmp_path / "source")
    batch(spark, source, [(1, 1, "a"), (2, 1, "b")])
    batch(spark, source, [(1, 2, "c")])
    schema = spark.read.parquet(source).schema
    target = StreamTarget(spark, str(tmp_path / "target"), schema, mode)
    assert target.table().count() == 0
    assert load_folder(spark, source, schema, target, max_files=1).count() == (3 if mode == "append" else 1)
    assert load_folder(spark, source, schema, target).count() == (3 if mode == "append" else 1)
    batch(spark, source, [(2, 0, "late")])
    assert load_folder(spark, source, schema, target).count() == (4 if mode == "append" else 1)
    assert load_folder(spark, source, schema, target, full_reload=True).count() == 4
    assert target.runs() == [0, 1]


def test_stream_latest_and_replay(spark, tmp_path):
    source = str(tmp_path / "source")
    batch(spark, source, [(1, 1, "a"), (1, 3, "b"), (2, 1, "c")])
    schema = spark.read.parquet(source).schema
    target = StreamTarget(spark, str(tmp_path / "target"), schema)
    load_folder(spark, source, schema, target)
    batch(spark, source, [(1, 2, "correction")])
    load_folder(spark, source, schema, target)
    assert sorted(tuple(r) for r in target.latest(["k"], ["t"]).drop("Silver_Loadedtimestamp").collect()) == [(1, 2, "correction"), (2, 1, "c")]
    # The same batch delivered again replaces its own folder.
    rerun = read_table_stream(spark, source, schema)
    again = StreamTarget(spark, str(tmp_path / "other"), schema)
    again.load(rerun).awaitTermination()
    assert again.table().count() == 4
    stored = spark.read.parquet(f"{again.base}/run=0/data")
    assert stored.where("Silver_Loadedtimestamp is null").count() == 0


def test_as_transmissions_fills_absent_columns(spark):
    df = spark.createDataFrame([("1", "X")], "`No.` string, ESTADO string").withColumns(
        {"FECHA TRANSMISIÓN": F.lit("2023-11-05"), "HORA TRANSMISIÓN": F.lit("01:02:03")})
    row = as_transmissions(df).first()
    assert row["No"] == "1" and row["Fecha de desahogo"] is None and str(row["Timestamp"]) == "2023-11-05 01:02:03"
