"""Running totals and dense numbering without a single-task window.

A window over a whole table, or over one huge key, is one task. Here the order
column is cut into chunks of 2**width values: chunks are pre-aggregated, a
window over the small chunk table carries totals across chunks, and a second
window finishes the work inside each chunk. Both depend on the data only, not
on partition ids, so a recomputed task gives the same numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"
# Rows per chunk when the order column is dense and unique.
DENSE_WIDTH = 16
# For 64-bit hashes: 2**20 chunks whatever the number of rows.
HASH_WIDTH = 44

_FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}


def with_running(
    df: DataFrame,
    order: str,
    columns: dict[str, tuple[str, Column]],
    by: tuple[str, ...] = (),
    inclusive: bool = True,
    width: int = DENSE_WIDTH,
    then_by: tuple[str, ...] = (),
) -> DataFrame:
    """Adds running sums, minima or maxima in the order of a bigint column.

    ``columns`` maps a new name to ("sum" | "min" | "max", expression). The
    ``by`` columns group as in groupBy, nulls together; a null ``order`` is an
    error. Without ``inclusive`` the current row is left out.
    """
    missing = F.raise_error(F.lit(f"Rows without {order} have no place"))
    place = F.when(F.col(order).isNull(), missing.cast("bigint")).otherwise(F.col(order).cast("bigint"))
    rows = df.withColumn(_CHUNK, F.shiftright(place, width))
    parts = rows.groupBy(*by, _CHUNK).agg(
        *[_FUNCTIONS[f](e).alias(f"__part_{name}") for name, (f, e) in columns.items()]
    )
    earlier = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *[F.col(c).alias(f"__of_{c}") for c in (*by, _CHUNK)],
        *[
            _FUNCTIONS[f](f"__part_{name}").over(earlier).alias(f"__carry_{name}")
            for name, (f, _) in columns.items()
        ],
    )
    inside = (
        Window.partitionBy(*by, _CHUNK)
        .orderBy(order, *then_by)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*by, _CHUNK)]
    return rows.join(carried, reduce(lambda a, b: a & b, same)).select(
        *df.columns,
        *[
            _COMBINE[f](F.col(f"__carry_{name}"), _FUNCTIONS[f](e).over(inside)).alias(name)
            for name, (f, e) in columns.items()
        ],
    )


def with_dense_index(
    df: DataFrame,
    order: str,
    name: str,
    by: tuple[str, ...] = (),
    width: int = DENSE_WIDTH,
    then_by: tuple[str, ...] = (),
) -> DataFrame:
    """Adds 0, 1, 2, … in the order of a bigint column."""
    counted = {name: ("sum", F.lit(1).cast("bigint"))}
    return with_running(df, order, counted, by, inclusive=False, width=width, then_by=then_by)

