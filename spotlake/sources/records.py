"""Records that lie across lines and splits: quoted line breaks, long preambles, one large JSON array.

Files are split as usual and no task holds more of a file than a split. A scan is written once with
the place of every piece, because a second scan could be split in another way. What a piece means
depends on all before it (inside quotes or not, how deep in brackets), so each split is summed up, the
sums of a file's splits are added in order, and every piece gets the state at its own start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from spotlake.operators.sizing import estimate
from spotlake.shipping import ship
from spotlake.sources.scratch import materialise

ship(__name__)

MAX_LINES = 10_000
READ_BYTES = 32 << 20


def _ahead() -> WindowSpec:
    """The pieces of a split before the current one."""
    return Window.partitionBy("file", "start").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)


def _splits_ahead() -> WindowSpec:
    """The splits of a file before the current one."""
    return Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)


def _pieces(text: DataFrame, *derived: Column) -> DataFrame:
    """`file`, `start` of the split, `line` (numbers rise by one along a split), `value` and derived columns, to be written once."""
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), "value", *derived)


def _without_escapes(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("\\")), F.regexp_replace(value, r"(?s)\\.", "")).otherwise(value)


def _count_of(value: Column, characters: str) -> Column:
    return F.length(value) - F.length(F.translate(value, characters, ""))


def logical_lines(spark: SparkSession, path: str | list[str], skip: int = 0, max_lines: int = MAX_LINES) -> DataFrame:
    """`file`, `is_header`, `value`: the records of delimited text files below their first `skip` lines.

    A record goes on while a quote is open; its lines are joined by a line feed.
    Quotes in the skipped lines do not count, nor do quotes after a backslash. The
    first record below them is the header. The skipped lines may fill many splits. A record
    of more than `max_lines` lines is an error, as its quote is most likely never
    closed. Only lines of splits that hold a skipped line or part of a quoted line
    break are moved.
    """
    odd = (_count_of(_without_escapes(F.col("value")), '"') % 2).alias("odd")
    lines = materialise(_pieces(spark.read.text(path), odd), "lines")
    splits = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("odd").alias("n_odd"), F.min("line").alias("first"))
    splits = materialise(splits.withColumn("before", F.coalesce(F.sum("n").over(_splits_ahead()), F.lit(0))), "splits")
    number = F.col("before") + F.col("line") - F.col("first")
    # Odd quotes of the skipped lines are taken off again.
    skipped = lines.where("odd = 1").join(splits.where(F.col("before") < skip), ["file", "start"]).where(number < skip).groupBy(
        "file", "start").agg(F.count(F.lit(1)).alias("n_skipped"))
    splits = splits.join(skipped, ["file", "start"], "left").withColumn("n_odd", F.col("n_odd") - F.coalesce("n_skipped", F.lit(0))).withColumn(
        "odd_before", F.coalesce(F.sum("n_odd").over(_splits_ahead()), F.lit(0)))
    plain = (F.col("before") > skip) & (F.col("n_odd") == 0) & (F.col("odd_before") % 2 == 0)
    splits = materialise(splits.select("file", "start", "first", "before", "odd_before", plain.alias("plain")), "counted-splits")

    whole = lines.join(splits.where("plain"), ["file", "start"], "left_semi").select("file", F.lit(False).alias("is_header"), "value")
    rest = lines.join(splits.where("NOT plain"), ["file", "start"]).withColumn("number", number).where(F.col("number") >= skip)
    rest = rest.withColumn("odd_before", F.col("odd_before") + F.coalesce(F.sum("odd").over(_ahead()), F.lit(0)))
    rest = materialise(rest.select(
        "file", "number", "value", (F.col("odd_before") / 2).cast("long").alias("record"),
        ((F.col("odd_before") % 2 == 0) & (F.col("odd") == 0)).alias("alone")), "lines-in-doubt")
    broken = rest.where("NOT alone")
    # Odd lines open and close records in turn, so half their number tells the records of a file apart.
    endless = broken.groupBy("file", "record").count().where(F.col("count") > max_lines).first()
    if endless:
        raise ValueError(f"a quote in {endless['file']} is not closed within {max_lines} lines")
    joined = broken.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("number", "value"))).alias("lines")).select(
        "file", (F.col("lines")[0]["number"] == skip).alias("is_header"), F.array_join("lines.value", "\n").alias("value"))
    return whole.unionByName(rest.where("alone").select("file", (F.col("number") == skip).alias("is_header"), "value")).unionByName(joined)


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`file`, `part` (rises along the file), `value`: the objects of files that hold one JSON array of objects each.

    The array may be on one line or on many. Files are cut at closing braces; a brace
    ends an element if it is outside of strings and the depth after it is one. A
    file whose brackets do not close is an error. Elements that are not objects are not found.
    """
    text = spark.read.text(path, lineSep="}")
    clean = F.split(_without_escapes(F.col("value")), '"')

    def depth_of(outside: int) -> Column:
        """Net brackets in the segments between quotes that lie outside of strings, if every other one does."""
        segments = F.array_join(F.filter(clean, lambda s, i: i % 2 == outside), "")
        return (_count_of(segments, "{[") - _count_of(segments, "}]")).cast("long")

    pieces = _pieces(text, (F.size(clean) - 1).cast("long").alias("quotes"), depth_of(0).alias("d0"), depth_of(1).alias("d1"))
    sums = "file string, start long, line long, value string, odd_after long, after0 long, after1 long"
    state = materialise(pieces.mapInArrow(_running_depths, sums), "depths")
    splits = state.groupBy("file", "start").agg(F.max_by(F.struct("odd_after", "after0", "after1"), "line").alias("last"))
    splits = splits.withColumn("begins", F.coalesce(F.sum("last.odd_after").over(_splits_ahead()) % 2, F.lit(0)))
    gain = F.when(F.col("begins") == 0, F.col("last.after0")).otherwise(F.col("last.after1"))
    splits = splits.withColumn("gain", gain).withColumn("depth", F.coalesce(F.sum("gain").over(_splits_ahead()), F.lit(0)))
    splits = materialise(splits.select("file", "start", "begins", "gain", "depth"), "split-depths")
    # The last piece of a file has no brace of its own; counting one leaves depth minus one.
    open_ = splits.groupBy("file").agg(F.sum("gain").alias("depth"), F.sum("begins").alias("n")).where("depth <> -1").first()
    if open_:
        raise ValueError(f"{open_['file']} does not hold one complete array")

    depth = F.col("depth") + F.when(F.col("begins") == 0, F.col("after0")).otherwise(F.col("after1"))
    ends = (depth == 1) & (F.col("odd_after") == F.col("begins"))
    # One small row per split; the pieces stay in their order.
    placed = state.join(F.broadcast(splits), ["file", "start"]).select("file", "start", "line", "value", ends.alias("ends"))
    # Splits of a few bytes are read together: a task per split costs more than its work.
    placed = placed.coalesce(max(spark.sparkContext.defaultParallelism, estimate(state) // READ_BYTES))
    joined = materialise(placed.mapInArrow(_joined_pieces, "file string, start long, line long, value string, ends boolean, whole boolean"), "elements")
    # A run begins and ends inside an element; only these rows are moved.
    cut = joined.where("NOT whole")
    ahead = Window.partitionBy("file").orderBy("start", "line").rowsBetween(Window.unboundedPreceding, -1)
    numbers = cut.select("file", "start", "line", F.coalesce(F.sum(F.col("ends").cast("long")).over(ahead), F.lit(0)).alias("element"))
    groups = cut.join(numbers, ["file", "start", "line"]).groupBy("file", "element").agg(
        F.array_sort(F.collect_list(F.struct("start", "line", "value", "ends"))).alias("pieces"))
    last = F.element_at("pieces", -1)
    mended = groups.where(last["ends"]).select(
        "file", last["start"].alias("start"), last["line"].alias("line"), F.array_join("pieces.value", "}").alias("value"))
    every = joined.where("whole").select("file", "start", "line", "value").unionByName(mended)
    return every.select(
        "file", F.struct("start", "line").alias("part"),
        F.regexp_replace(F.concat("value", F.lit("}")), r"^[\s\x{FEFF}]*[\[,]\s*", "").alias("value"))


def _running_depths(batches):
    """Pieces in the order of their scan with the sums of their split up to each."""
    at, odd, depths = None, 0, [0, 0]
    for batch in batches:
        files, starts = batch.column(0), batch.column(1).to_numpy()
        quotes, d = batch.column(4).to_numpy(), (batch.column(5).to_numpy(), batch.column(6).to_numpy())
        out = [np.empty(len(starts), np.int64) for _ in range(3)]
        for a, b, key in _runs(files, starts):
            if key != at:
                at, odd, depths = key, 0, [0, 0]
            after = (odd + np.cumsum(quotes[a:b])) % 2
            before = np.concatenate([[odd], after[:-1]])
            out[0][a:b], odd = after, int(after[-1])
            for begin in (0, 1):
                change = np.where(before == begin, d[0][a:b], d[1][a:b]) - (after == begin)
                out[1 + begin][a:b] = depths[begin] + np.cumsum(change)
                depths[begin] = int(out[1 + begin][b - 1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], *map(pa.array, out)], ["file", "start", "line", "value", "odd_after", "after0", "after1"])


def _joined_pieces(batches):
    """Pieces that follow each other as one row per element, under the place of its last piece; `whole` if its first piece is among them."""
    at, held, whole = None, [], False
    for batch in batches:
        files, starts, lines = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        values, ends = batch.column(3), batch.column(4).to_numpy(zero_copy_only=False)
        rows = []
        for a, b, key in _runs(files, starts, lines):
            if at is None or (*key, int(lines[a])) != (*at[:2], at[2] + 1):
                if held:
                    rows.append((*at, "}".join(held), False, False))
                held, whole = [], False
            texts = values.slice(a, b - a).to_pylist()
            begin = 0
            for end in (np.flatnonzero(ends[a:b]) + 1).tolist():
                rows.append((*key, int(lines[a + end - 1]), "}".join(held + texts[begin:end]), True, whole))
                held, whole, begin = [], True, end
            held += texts[begin:]
            at = (*key, int(lines[b - 1]))
        if rows:
            yield _element_rows(rows)
    if held:
        yield _element_rows([(*at, "}".join(held), False, False)])


def _element_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "start", "line", "value", "ends", "whole"])


def _runs(files: pa.Array, starts: np.ndarray, lines: np.ndarray | None = None):
    """(first row, row after the last, (file, start)) of rows in one split, with numbers that rise by one if given."""
    if not len(starts):
        return
    names = files.dictionary_encode()
    breaks = (np.diff(names.indices.to_numpy()) != 0) | (np.diff(starts) != 0)
    if lines is not None:
        breaks |= np.diff(lines) != 1
    bounds = [0, *(np.flatnonzero(breaks) + 1).tolist(), len(starts)]
    for a, b in zip(bounds, bounds[1:]):
        yield a, b, (files[a].as_py(), int(starts[a]))
