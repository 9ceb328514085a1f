"""Row keys: unique, the same on every read, and made for any table."""

from __future__ import annotations

from spotlake.llm.common import numbered


def test_row_keys(spark, tmp_path):
    rows = [(None, "a", "x"), (None, "a", "x"), (1, None, "y"), (1, "b", "z")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for table in (read, read.where("doc_id IS NULL OR doc_id = 1"), df):
        keyed, name = numbered(table)
        assert name not in table.columns and keyed.columns == [*table.columns, name]
        assert keyed.select(name).distinct().count() == len(rows)
        assert keyed.join(keyed.select(name), name).count() == len(rows)
    first, name = numbered(read)
    again, _ = numbered(spark.read.parquet(str(tmp_path / "t")))
    assert first.join(again.select(name), name, "left_anti").count() == 0


def test_row_keys_of_other_plans(spark, tmp_path):
    """Rows of an explode, a join, a union, a file read twice and a sample have keys of their own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i % 5, f"t{i}", {"a": 1}) for i in range(200)], "doc_id long, text string, m map<string,int>")
    path = str(tmp_path / "t")
    df.repartition(3).write.parquet(path)
    read = spark.read.parquet(path)
    two = spark.createDataFrame([(1,), (2,)], "x int")
    file = spark.read.parquet(path).inputFiles()[0]
    tables = {
        "explode": read.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))),
        "join": read.join(two, F.lit(True)), "union": read.unionByName(read), "twice": spark.read.parquet(path, path),
        "files": spark.read.parquet(file, file), "sample": read.sample(True, 2.0, 1), "aliased": read.alias("a").where("doc_id < 4").select("a.*"),
    }
    for what, t in tables.items():
        keyed, name = numbered(t)
        assert keyed.select(name).distinct().count() == keyed.count() == t.count(), what


def test_repeated_ids_are_dealt_with_alike_in_every_run(spark, tmp_path):
    """Equal texts under one id, told apart by another column alone: whatever the partitioning, the same one stays."""
    from spotlake.llm import exact_dedup

    rows = [(1, "a", f"s{i}") for i in range(30)] + [(2, "a", "x"), (2, "a", "y"), (None, "b", "z")]
    kept = set()
    for parts in (1, 4, 9):
        path = str(tmp_path / str(parts))
        spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts).write.parquet(path)
        keyed, name = numbered(spark.read.parquet(path))
        result = exact_dedup.exact_duplicates(keyed, row_col=name).where("kept").select("row")
        stay = keyed.join(result, keyed[name] == result["row"], "left_semi")
        kept.add(tuple(sorted((r["doc_id"] is None, r["doc_id"], r["source"]) for r in stay.select("doc_id", "source").collect())))
    assert len(kept) == 1 and len(next(iter(kept))) == 2
