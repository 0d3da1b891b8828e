"""Spark helpers shared by the operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels
from gradewell.session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back: a lineage
    cut that survives lost executors. Every call takes a new folder."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``store`` that no later plan reads, by Hadoop's FileSystem."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder (the folder is set on first use)."""
    scratch_path(df.sparkSession, "")
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id, k: int):
    """crc32(doc_id as text) mod k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


FILTER_BITS = 28  # of the largest bitmap, 32 MB


class Bitmap:
    """Which 64-bit keys may be in a set, by their low bits, from rows (place of a word, word of 64 bits)."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray):
        self.mask = np.uint64((1 << bits) - 1)
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[at] = words

    def __call__(self, key: np.ndarray) -> np.ndarray:
        k = key & self.mask
        return (self.words[k >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1) > 0


def bitmap(keys: DataFrame, rows: int) -> Bitmap:
    """A bitmap of the column "key" (well mixed longs) of ``rows`` rows: 16 bits a row and 32 MB at most; beyond
    that it lets more through. It never leaves a key out."""
    bits = min(FILTER_BITS, max(16, (16 * rows).bit_length()))
    place = F.col("key").bitwiseAND((1 << bits) - 1)
    got = (keys.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("b"))
           .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    return Bitmap(bits, got["w"].to_numpy(), got["b"].to_numpy().view(np.uint64))


LOCAL_EDGES = 1 << 20  # edges that one task joins (about 16 MB); more go by rounds over all tasks


def _united(batches):
    """(node, component) of the edges (u, v) that one task reads."""
    rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["u", "v"])])
    u, v = (rows.column(k).to_numpy() for k in ("u", "v"))
    node, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = kernels.least_labels(len(node), at[:len(u)], at[len(u):])
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list as (node, component), component
    being the smallest node. Up to LOCAL_EDGES distinct edges are joined by one task; beyond that,
    alternating large-star and small-star rounds go over all tasks; each round
    aggregates minima (map-side combined) and joins them back, so a hub's neighbours
    are never gathered. Nulls and self loops are ignored; no edges give no rows."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    if e.count() <= LOCAL_EDGES:
        return cut(e.coalesce(1).mapInArrow(_united, "node long, component long"))
    last = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
             .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        e = cut(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
