"""Shared pieces of the operators: table access, staging, graph components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import checkpoint_root


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():  # already running from a shipped archive
        return
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs the step being written, never the
    steps before it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_in_buckets(df: DataFrame, label: str, buckets: int, column: str) -> DataFrame:
    """Like ``stage``, in so many buckets by ``column``: grouping by it needs no shuffle of these rows."""
    path = scratch_path(df.sparkSession, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    (df.write.format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(buckets, column).saveAsTable(name))
    return df.sparkSession.table(name)


def with_text(rows: DataFrame, names: list[str], text: Column) -> DataFrame:
    """The columns ``names`` of the struct ``row``, with another text; n_chars follows it where there is one."""
    rows = rows.select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


BROADCAST_ROWS = 1_000_000  # rows of a few longs: some tens of MB in each executor


def broadcast_if_small(staged: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of a few longs a row, marked for broadcast if its counted rows are few.

    Beyond the bound it is left as it is and joined by shuffle.
    """
    return F.broadcast(staged) if staged.count() <= rows else staged


def map_text(df: DataFrame, columns: list[str], schema: str,
             fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]) -> DataFrame:
    """``fn`` over the Arrow batches of the named columns (extra columns are not read)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from ([out] if isinstance(out, pa.RecordBatch) else out)

    ship_package(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def connected_components(links: DataFrame, label: str = "components", split_hubs: bool = False) -> DataFrame:
    """(node, component) of an undirected graph given as links (a, b) of longs.

    component is the smallest node reachable. Alternating large-star and
    small-star steps; every round is a few joins and aggregates on the cluster,
    written to the shared folder, and only its row count and checksum reach
    the driver. Nodes without a link to another node do not appear. With
    ``split_hubs`` the smallest neighbours are written before they are joined
    with the links, so that Spark can split a node that holds many of the links.
    """
    settled = (lambda df: stage(df, f"{label}-low")) if split_hubs else (lambda df: df)
    links = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), label)
    before = None
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = settled(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        links = stage(small, label)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
