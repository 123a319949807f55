"""What the training-data operators share: worker setup, the shared folder and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.sources.store import shared_folder, ship


def prepare(spark: SparkSession, batch_rows: int = 512) -> None:
    """Bound Arrow batches and let Python workers import this package.

    Documents are long, so the default of 10,000 rows a batch could need gigabytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder that the session names in spark.checkpoint.dir and goes when the driver
    ends; a folder of this machine is used only where that setting is unset, as in tests.
    """
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # what was written needs no shuffle files
    old = spark.conf.get(flag, "false")
    spark.conf.set(flag, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(flag, old)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made from the given ones."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) pairs of longs: rows (node, root), root the least node.

    Every round each node hooks on to its least neighbour (min() is combined map-side, so nodes of
    very high degree are cheap), follows its parent's parent twice, and the graph shrinks to the
    edges between what is left; a round leaves a fraction of the nodes. Tables between rounds are
    written to the shared folder. Rows with a null end are ignored; no edges give no rows.
    """
    live = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = settle(live.distinct(), "edges")
    labels = None
    for _ in range(max_rounds):
        ends = live.union(live.select("b", "a"))
        parent = settle(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        up = parent.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        for _ in range(2):
            parent = parent.join(up, parent.up == up._n).select("node", F.col("_u").alias("up"))
        parent = settle(parent, "parents")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("root"))
        else:
            labels = settle(labels.join(parent, labels.root == parent.node, "left").select(labels.node, F.coalesce("up", "root").alias("root")), "labels")
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("ra")), parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        moved = live.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        live = settle(moved.distinct(), "edges")
        if live.isEmpty():
            return labels
    raise RuntimeError("connected components did not settle")
