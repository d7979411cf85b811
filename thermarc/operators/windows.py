"""Sequence helpers: global numbering, the row before, islands, trailing windows.

Streams (the rows of some keys, in order) may be long and few, so none is one task. What looks at the row before, or carries a value on, works in
cells of CELL_DAYS days of a stream; a table with a row for each cell carries the ends of cells on. What looks at a number of rows numbers the
rows first, and works in cells of rows that also get the rows next to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, ts: str, order: list[str], out: str = "row_no", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds the 1-based place of each row in the order (ts, *order), of the whole table or of its stream of `keys`.

    Rows are numbered within their day and the days before are added, so no task sees the whole table or stream.
    Without keys the table of days is broadcast: a row for each day of the data.
    """
    day = F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_day", day)
    days = rows.groupBy(*keys, "_day").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = rows.withColumn("_in_day", F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(ts, *order)))
    return rows.join(days if keys else F.broadcast(days), [*keys, "_day"]).withColumn(out, F.col("_before") + F.col("_in_day")).drop("_day", "_before", "_in_day")


#: Days of a cell, and rows of a cell of numbered rows.
CELL_DAYS = 7
CELL_ROWS = 4096
_FIRST = -1_000_000  # the cell of rows without a time: the first


def time_cell(ts: str) -> Column:
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return F.coalesce(F.floor(days / CELL_DAYS), F.lit(_FIRST)).cast("long")


def _in_cells(df: DataFrame, keys: list[str], ts: str, cell: Column | None = None) -> DataFrame:
    """Adds _stream (the keys as one value, null keys too) and _cell."""
    return df.withColumns({"_stream": F.struct(*keys) if keys else F.lit(0), "_cell": time_cell(ts) if cell is None else cell})


def _carried_on(cells: DataFrame, end: str, skip_nulls: bool) -> DataFrame:
    """(_stream, _cell, _carry): what the cells before leave. A row for each cell."""
    before = Window.partitionBy("_stream").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("_stream", "_cell", (F.last(end, ignorenulls=True).over(before) if skip_nulls else F.last(end).over(before)).alias("_carry"))


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], skip_nulls: bool = False, cell: Column | None = None) -> DataFrame:
    """Adds prev_<column>: the value in the row before of the stream; null for the first. With skip_nulls, of each column the last
    value before the row that isn't null. order begins with a time, or `cell` says which rows are looked at together, in the same order."""
    if skip_nulls:
        w = Window.partitionBy("_stream", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = _in_cells(df, keys, order[0], cell).withColumns({f"prev_{c}": F.last(c, ignorenulls=True).over(w) for c in columns})
        end = F.struct(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
        before = Window.partitionBy("_stream").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy("_stream", "_cell").agg(end.alias("_end"))
        ends = ends.select("_stream", "_cell", *[F.last(F.col("_end")[c], ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns])
        rows = rows.join(ends, ["_stream", "_cell"], "left")
        return rows.withColumns({f"prev_{c}": F.coalesce(f"prev_{c}", f"_carry_{c}") for c in columns}).drop("_stream", "_cell", *[f"_carry_{c}" for c in columns])
    held, w = F.struct(*columns), Window.partitionBy("_stream", "_cell").orderBy(*order)
    rows = _in_cells(df, keys, order[0], cell).withColumn("_before", F.lag(held).over(w))
    ends = rows.groupBy("_stream", "_cell").agg(F.max_by(held, F.struct(*order)).alias("_end"))
    rows = rows.join(_carried_on(ends, "_end", False), ["_stream", "_cell"], "left")
    return rows.withColumn("_before", F.coalesce("_before", "_carry")).withColumns({f"prev_{c}": F.col("_before")[c] for c in columns}).drop("_before", "_carry", "_stream", "_cell")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the last value of the stream that isn't null, up to and with the row. order begins with a time."""
    w = Window.partitionBy("_stream", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _in_cells(df, keys, order[0]).withColumn("_value", value)
    ends = rows.groupBy("_stream", "_cell").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    rows = rows.withColumn(out, F.last("_value", ignorenulls=True).over(w)).join(_carried_on(ends, "_end", True), ["_stream", "_cell"], "left")
    return rows.withColumn(out, F.coalesce(out, "_carry")).drop("_carry", "_value", "_stream", "_cell")


def islands(df: DataFrame, keys: list[str], order: list[str], watch: list[str], changed: Column, out: str = "island") -> DataFrame:
    """Tells runs of rows apart: a row for which `changed` (over the columns and prev_<watched column>) holds or is null opens one. The
    run's name is the order's values at its first row, so `order` must tell the rows of a stream apart."""
    rows = with_previous(df, keys, order, watch)
    opens = F.when(F.coalesce(changed, F.lit(True)), F.struct(*order))
    return carried(rows, keys, order, opens, out).drop(*[f"prev_{c}" for c in watch])


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], before: int = 0, after: int = 0, place: str = "_t") -> tuple[DataFrame, Window]:
    """Rows numbered in their stream and dealt to cells of rows; a cell also gets the `before` rows ahead of it and the `after` rows behind it.

    Windows go over the second value; rows at home in their cell (_home) see all their neighbours. order begins with a time."""
    size = max(CELL_ROWS, 4 * (before + after))
    rows = numbered(df.withColumn("_stream", F.struct(*keys)), order[0], order[1:], place, ("_stream",))
    t = F.col(place) - 1
    home, reach = F.floor(t / size), F.sequence(F.floor(F.greatest(t - after, F.lit(0)) / size), F.floor((t + before) / size))
    rows = rows.withColumn("_cell", F.explode(reach)).withColumn("_home", F.col("_cell") == home)
    return rows, Window.partitionBy("_stream", "_cell").orderBy(place)


def at_home(rows: DataFrame, *drop: str) -> DataFrame:
    return rows.where("_home").drop("_home", "_cell", "_stream", *drop)


def long_rows(df: DataFrame, names: list[str], fields: dict[str, str], key: str = "column_name") -> DataFrame:
    """One row of aggregates 'name__field' as a row for each name."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias(key), *[F.col(f"`{n}__{f}`").cast(t).alias(f) for f, t in fields.items()]) for n in names])))
