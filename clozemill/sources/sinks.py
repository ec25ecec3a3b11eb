"""Tables as JSON lines, CSV and Markdown folders, written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill import fixed_values as fv
from clozemill.operators.runs import report_cells

BOM = "\ufeff"
# Cells are written as they are, blanks at their ends included.
_CELLS = {
    "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_jsonl(df: DataFrame, path: str) -> None:
    """One UTF-8 object per line; null fields keep their key."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_record(df: DataFrame, path: str) -> None:
    """A small table, such as one row of scores, as a folder of JSON lines; all rows are kept."""
    write_jsonl(df, path)


def write_csv(df: DataFrame, path: str, bom: bool = True, single_file: bool = False) -> None:
    """CSV with a header in every file, marked as UTF-8 for spreadsheets.

    ``single_file`` is for small sheets only: it writes through one task. See
    ``write_one_csv`` for a single file of any size.
    """
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).options(**_CELLS).csv(path)


def csv_lines(
    df: DataFrame, order: tuple[str, ...], cells: tuple[str, ...] | None = None, bom: bool = True
) -> DataFrame:
    """The lines of one CSV file: is_row (false for the header), the ``order`` columns, value.

    ``cells`` are the columns to write, all but the order ones if not given. A
    line may hold line breaks within quotes.
    """
    names = list(cells) if cells else [c for c in df.columns if c not in order]
    if not names:
        raise ValueError("A CSV file needs a column beside those of its order")

    def line(cells: list[Column]) -> Column:
        def rendered(*each: Column) -> Column:
            return F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(each)]), _CELLS)

        if len(cells) > 1:
            return rendered(*cells)
        # Alone, an empty cell would be an empty line, which readers skip.
        text = F.regexp_replace(rendered(*cells, F.lit("x")), r",x\z", "")
        return F.when(text == "", '""').otherwise(text)

    mark = BOM if bom else ""
    titles = line([F.lit(n) for n in names])
    header = df.sparkSession.range(1).select(
        F.lit(False).alias("is_row"),
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order],
        F.concat(F.lit(mark), titles).alias("value"),
    )
    rows = df.select(F.lit(True).alias("is_row"), *order, line([F.col(f"`{n}`") for n in names]).alias("value"))
    return header.union(rows)


def write_one_csv(
    df: DataFrame, path: str, order: tuple[str, ...], cells: tuple[str, ...] | None = None, bom: bool = True
) -> None:
    """One CSV file in parts: read in name order, their bytes are those of a file written by one task.

    Tasks render and sort ranges of the ``order`` columns; the first part begins
    with the header. Rows of equal place may change places.
    """
    lines = csv_lines(df, order, cells, bom).orderBy("is_row", *order)
    lines.select("value").write.mode("overwrite").text(path)


def markdown_lines(summary: DataFrame) -> DataFrame:
    """The report as lines: group_pos, pos, value. The header comes first."""
    columns = list(fv.REPORT_COLUMNS)
    spark = summary.sparkSession
    header = spark.createDataFrame(
        [
            (-1, 0, "| " + " | ".join(columns) + " |"),
            (-1, 1, "| " + " | ".join(["---"] * len(columns)) + " |"),
        ],
        "group_pos int, pos int, value string",
    )
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))
    body = report_cells(summary).select("group_pos", "pos", line.alias("value"))
    return header.union(body)


def write_markdown(summary: DataFrame, path: str) -> None:
    """The report in manifest order; the parts of the folder read in name order."""
    markdown_lines(summary).orderBy("group_pos", "pos").select("value").write.mode(
        "overwrite"
    ).text(path)
