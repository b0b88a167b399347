"""Helpers shared by the training-data operators: shared-folder tables, split
counts derived from the data, Arrow batch access and distributed components."""
from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsight.session import ensure_checkpoint_dir, join_path

#: Bytes of Arrow data handed to a Python worker at once: bounds its memory
#: however long the texts are (one text is never split over batches).
BATCH_BYTES = 8 << 20

#: A-Z to a-z and nothing else, as the contracts ask (str.lower changes more).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Word class of the contracts; equals bytes.split() without arguments.
WORD_RE = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> str:
    """Bound Arrow batches for this session; return the shared work folder."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ensure_checkpoint_dir(spark)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return join_path(ensure_checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more: Spark
    deletes them when the driver's JVM collects the plans, which it may not do by
    itself before the disks fill up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(rows: int, per_part: int) -> int:
    """Partition or bucket count from a measured row count."""
    return max(1, -(-int(rows) // per_part))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_key(c: Column) -> Column:
    """An id as a string that is never null, for plain equality joins and groups."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def texts_of(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def groups_of(texts: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of together about `size` bytes, with the first one's index."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n > size or i == len(texts) - 1:
            yield a, texts[a:i + 1]
            a, n = i + 1, 0


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow for a function from one record batch to one or more batches
    (or None)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node of
    its component.  Alternating large-star / small-star rounds, each written to
    the shared folder; rows per round never exceed the number of edges, and a
    hub only meets joins whose other side has one row per node (AQE splits the
    skewed side).  Self-loops and nulls are ignored; no edges give no rows."""
    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("u"), F.col("v")).unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        to_low = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return to_low.unionAll(low.select("u", F.col("m").alias("v")))

    e = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                    .where("u is not null and v is not null and u <> v").distinct(), "edges")
    last = None
    while True:
        e = materialise(small_star(large_star(e)).where("u <> v").distinct(), "stars")
        # a fixed point of both steps keeps the edge set; its size and an
        # order-free checksum stand for it
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            break
        last = state
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
