"""CSV files as rows, read by as many tasks as a file has splits.

A cell in quotes may hold line breaks, so where a row begins depends on all
quotes before it. Yet a line knows but two ways to begin, inside or outside a
quoted cell, and what it does to either is a map of two states. Tasks follow
both ways through their split and give every line a row number for each; one
small record per split (both exits, both numbers of rows) passes a window, which
tells the true entry of every split. Rows of a single line never move; only the
lines of rows that are broken over several are grouped, by the row's number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How cells are written; the pattern below knows the same signs.
CELLS = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
# A line that begins outside of quotes and ends inside: whole cells, then an open one.
_OPEN = r'"[^"]*+(?:""[^"]*+)*+'
_ENDS_INSIDE = re.compile(rf'(?:(?:{_OPEN}"[^,]*+|[^",][^,]*+|),)*+{_OPEN}')

_SPLIT = ("__listed", "__file", "__split")
# Per line and way of entering its split: begins inside, ends inside, number of its row in the split.
_WAYS = ("out", "in")
_FOLLOWED = "__listed int, __file string, __split bigint, __id bigint, value string, " + ", ".join(
    f"{way}_from boolean, {way}_to boolean, {way}_row bigint" for way in _WAYS
)


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both ways through every split; its lines come in order, one split after another."""
    place, inside, row = None, [False, True], [-1, -1]
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for *at, line in zip(*[batch[c] for c in _SPLIT], batch["value"]):
            if at != place:
                place, inside, row = at, [False, True], [-1, -1]
                if at[2] == 0:
                    line = line.removeprefix("\ufeff")
            for way in (0, 1):
                begins = inside[way]
                if not begins and line:  # an empty line outside of quotes is no row
                    row[way] += 1
                if '"' in line:
                    # A line inside a cell is one whose cell was opened just before it.
                    inside[way] = bool(_ENDS_INSIDE.fullmatch('"' + line if begins else line))
                for column, value in zip(columns[3 * way :], (begins, inside[way], row[way])):
                    column.append(value)
        names = [f"{way}_{what}" for way in _WAYS for what in ("from", "to", "row")]
        yield batch.assign(**dict(zip(names, columns)))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    scans = [
        spark.read.option("lineSep", "\n").text(path).select(
            F.lit(i).alias("__listed"),
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__split"),
            F.monotonically_increasing_id().alias("__id"),
            F.regexp_replace("value", r"\r\z", "").alias("value"),
        )
        for i, path in enumerate(paths)
    ]
    return reduce(lambda a, b: a.union(b), scans).mapInPandas(_followed, _FOLLOWED)


def _entries(lines: DataFrame) -> DataFrame:
    """Per split: whether it begins inside quotes, the rows before it, and those of its file."""
    last = [F.max_by(f"{way}_to", "__id").cast("int").alias(f"{way}_to") for way in _WAYS]
    rows = [(F.max(f"{way}_row") + 1).alias(f"{way}_rows") for way in _WAYS]
    splits = lines.groupBy(*_SPLIT).agg(*last, *rows)
    of_file = Window.partitionBy("__listed", "__file").orderBy("__split")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    # A split turns the state round, leaves it, or fixes it. The state is the last
    # fixed one, turned by all splits since; ``anchor`` takes the turns before it off.
    turns = F.sum(F.when((F.col("out_to") == 1) & (F.col("in_to") == 0), 1).otherwise(0))
    splits = splits.withColumns({"turned": turns.over(of_file), "before": F.coalesce(turns.over(earlier), F.lit(0))})
    anchor = F.when(F.col("out_to") == F.col("in_to"), (F.col("out_to") + F.col("turned")) % 2)
    state = F.coalesce(F.last(anchor, ignorenulls=True).over(earlier), F.lit(0)) + F.col("before")
    splits = splits.withColumn("__inside", state % 2 == 1)
    splits = splits.withColumn("rows", F.when(F.col("__inside"), F.col("in_rows")).otherwise(F.col("out_rows")))
    splits = splits.withColumn("__in_file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    header = F.when((F.col("__in_file") == 0) & (F.col("rows") > 0), 1).otherwise(0)
    everywhere = Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    kept = F.coalesce(F.sum(F.col("rows") - F.col("header")).over(everywhere), F.lit(0))
    return splits.withColumn("header", header).select(
        *_SPLIT, "__inside", "__in_file", (kept - F.col("header")).alias("__start")
    )


def read_rows(
    spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None, name: str = "row_idx"
) -> DataFrame:
    """The rows of CSV files with a header each, and their positions over all files in the order listed.

    Cells follow Spark's own parser, with quotes doubled inside quotes; all
    columns are text unless a schema is given. Rows end at line feeds, with or
    without a carriage return, and both read as a line feed inside a cell. Empty
    lines are skipped. A row with too few or too many cells fails the job. A
    quoted cell that is never closed reaches to the end of its file.
    """
    reader = spark.read.options(header=True, multiLine=True, **CELLS)
    if schema is None:
        schema = reader.csv(paths[0]).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lines = _lines(spark, paths)
    placed = lines.join(_entries(lines), list(_SPLIT))

    def true(what: str):
        return F.when(F.col("__inside"), F.col(f"in_{what}")).otherwise(F.col(f"out_{what}"))

    placed = placed.select(
        "__split", "__id", "value",
        true("from").alias("from"), true("to").alias("to"),
        (F.col("__start") + true("row")).alias(name),
        (F.col("__in_file") + true("row")).alias("in_file"),
    ).where("in_file > 0")  # row 0 of a file is its header
    # A caller's filter may be evaluated before these ones: it must not parse half a row or a header.
    alone = F.expr("in_file > 0 and not from and not to and value <> ''")
    single = placed.where(alone).select(name, F.when(alone, F.col("value")).alias("value"))
    pieces = F.sort_array(F.collect_list(F.struct("__split", "__id", "value")))
    broken = placed.where("from or to").groupBy(name).agg(
        F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value")
    )
    names = ["`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in schema]
    cells = F.from_csv(F.col("value"), ", ".join(names), CELLS)
    return single.union(broken).select(cells.alias("cells"), name).select("cells.*", name)
