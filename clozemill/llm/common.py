"""Small helpers of the training-data operators."""

from __future__ import annotations

import re
import sys
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A task-side function: Arrow columns in, one list or Arrow array per output out.
Compute = Callable[..., list]


def append_columns(
    df: DataFrame, needs: list[str], outputs: str, start: Callable[[], Compute], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Adds columns computed in Python, batch by batch, without a shuffle.

    ``outputs`` is a DDL schema. ``start`` runs once per task and returns the
    function that maps the ``needs`` columns of a batch to the new columns.
    An input column named like an output is replaced, as withColumn does; one
    named in ``drop`` is read, if it is needed, and not returned.
    """
    added = T.StructType.fromDDL(outputs)
    taken = {f.name.lower() for f in added} | {n.lower() for n in drop}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    places = {f.name: i for i, f in enumerate(kept)}
    more = [n for n in needs if n not in places]
    places |= {n: len(kept) + i for i, n in enumerate(more)}
    wanted = [places[n] for n in needs]
    width = len(kept)
    sent = df.select(
        *[F.col(f"`{f.name}`") for f in kept],
        *[F.col(f"`{n}`").alias(f"__need_{i}") for i, n in enumerate(more)],
    )
    schema = T.StructType([*kept, *added.fields])
    types = [pa_type(f.dataType) for f in added]
    names = [f.name for f in schema]

    def run(batches):
        compute = start()
        for batch in batches:
            columns = batch.columns
            new = compute(*[columns[i] for i in wanted])
            arrays = [
                x if isinstance(x, pa.Array) else pa.array(x, t)
                for x, t in zip(new, types, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*columns[:width], *arrays], names=names)

    return sent.mapInArrow(run, schema)


def per_worker(key: object, make: Callable[[], object]):
    """One object per worker process and key.

    Modules may be shipped to workers by value, for each task anew, so their own
    globals do not last from task to task.
    """
    kept = sys.__dict__.setdefault("_clozemill_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: that of spark.checkpoint.dir.

    Where none is named, a session whose executors run in this process may use a
    folder of this machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage with checkpoint(), in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this library's own, wherever it is stored."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def one_label(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label as a mean between 0 and 1), one row per labelled document."""
    named = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label"))
    return named.dropna().groupBy("doc_id").agg(F.avg("label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, root) per linked node.

    Alternates the two star operations on the edge list until nothing changes:
    every node's larger neighbours move to its smallest one, then its smaller
    ones. root is the smallest node of the component. Sums and minima are taken
    before rows are shuffled, and joins can split a hot node.
    """
    edges = links.select(
        F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    ).where("lo < hi")
    edges = saved(edges.distinct())
    seen = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("m").alias("lo"), F.col("v").alias("hi"))
            .distinct()
        )
        to = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(to, "hi")
            .select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .where("lo < hi")
            .union(to.select(F.col("m").alias("lo"), "hi"))
            .distinct()
        )
        edges = saved(small)
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    roots = edges.select("lo").distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        roots.select("lo", "lo")
    )
