"""Centroid clustering by a bisector tournament (operator 11).

Vectors of ``dim`` finite components become integers floor(scale * x). Lloyd's rounds run on
exact integers: assign every vector to its nearest centroid, ties to the smaller number, then
move every non-empty centroid to the floor of its vectors' mean.

* Tournament: for two centroids i < j the nearer one follows from the sign of
  normal . x - threshold with normal = 2 (c_j - c_i) and threshold = |c_j|^2 - |c_i|^2; zero
  favours i. Normals and thresholds of all pairs are worked out once a round. A vector's
  winner so far meets the next centroid, so k - 1 tests leave the nearest; only its distance is
  then worked out, exactly.
* A test runs in doubles where the largest component proves that no sum passes 2^53, in 64-bit
  integers where it proves that none passes 2^62, and in Python's integers otherwise.
* A task adds up its vectors and emits k * (dim + 1) sums, as limbs of 40 bits, so that any
  size is exact; Spark adds them and at most k * (dim + 1) sums reach the driver.

Defined cases: a vector that is null, of another length, or holds a null, NaN or infinity is
left out; fewer vectors than ``k`` give as many centroids; no vectors give no rows; repeated rows
each count and each get a result row; a null vec_id hashes as empty text; among start vectors of
the same hash the components, as text, decide; sums and distances beyond 2^63 - 1 are given as
that number (the clusters stay exact); further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm.common import store

CLUSTERS, DIM, SCALE, ROUNDS = 16, 64, 64, 3
LIMB = 40
DOUBLE, LONG = 1 << 53, 1 << 62
MOST = (1 << 63) - 1
ROWS = 4096  # vectors of one vectorised step


def _finite(vectors: DataFrame, dim: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    usable = (F.size(x) == dim) & F.forall(x, lambda v: F.abs(v) < F.lit(float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of rows: 64-bit integers, or Python's where these don't hold them."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if not len(y) or np.abs(y).max() < LONG:
        return y.astype(np.int64)
    return np.array([[(n := v.as_integer_ratio())[0] * scale // n[1] for v in row] for row in x.tolist()], object)


def _components(batch, dim: int, scale: int):
    """(first row, integer rows) of a batch, some rows at a time; huge ones apart."""
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for a in range(0, len(x), ROWS):
        yield a, whole(x[a:a + ROWS], scale)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, object).reshape(len(centroids), -1)
        k, dim = c.shape
        norm = [int((row * row).sum()) for row in c]
        self.dim, self.size = dim, max([abs(v) for row in centroids for v in row], default=0)
        self.centroids = c
        self.normal = 2 * (c[None, :, :] - c[:, None, :])  # [i, j]: from i to j
        self.threshold = np.array([[norm[j] - norm[i] for j in range(k)] for i in range(k)], object)
        self._as: dict = {}

    def kind(self, x: np.ndarray):
        """The cheapest numbers that hold every sum of a test of x and every distance."""
        if x.dtype == object:
            return object
        m = max(self.size, int(np.abs(x).max(initial=0)))
        most = 6 * self.dim * m * m  # |normal . x| + |threshold|, and more than any distance
        return np.float64 if most < DOUBLE else np.int64 if most < LONG else object

    def typed(self, kind):
        if kind not in self._as:
            self._as[kind] = [v.astype(kind) for v in (self.centroids, self.normal, self.threshold)]
        return self._as[kind]

    def nearest(self, x: np.ndarray):
        """(number of the nearest centroid, squared distance) of each row."""
        kind = self.kind(x)
        c, normal, threshold = self.typed(kind)
        x = x.astype(kind)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(c)):
            sign = (x * normal[best, j]).sum(axis=1) - threshold[best, j]
            best = np.where(sign > 0, j, best)
        gap = x - c[best]
        return best, (gap * gap).sum(axis=1)


def _limbs(value: int):
    sign, value, i = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield i, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        i += 1


def _sums(model: Bisectors, dim: int, scale: int):
    def run(batches):
        k = len(model.centroids)
        count, total, huge = np.zeros(k, np.int64), np.zeros((k, dim), object), np.zeros((k, dim), object)
        for b in batches:
            for _, x in _components(b, dim, scale):
                best, _ = model.nearest(x)
                count += np.bincount(best, minlength=k)
                safe = x.dtype != object and int(np.abs(x).max(initial=0)) < LONG // ROWS
                for c in np.unique(best):
                    part = x[best == c]
                    total[c] += (part if safe else part.astype(object)).sum(axis=0).astype(object)
        rows = [(c, dim, 0, int(count[c])) for c in range(k) if count[c]]
        rows += [(c, d, i, v) for c in range(k) for d in range(dim) for i, v in _limbs(int(total[c, d]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 4, SUM_TYPES)], SUM_NAMES)
    return run


SUM_NAMES, SUM_TYPES = ["cluster", "d", "limb", "v"], [pa.int32(), pa.int32(), pa.int32(), pa.int64()]


def _assign(model: Bisectors, dim: int, scale: int):
    def run(batches):
        for b in batches:
            found = [model.nearest(x) for _, x in _components(b, dim, scale)]
            cluster = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            gap = [min(int(v), MOST) for f in found for v in f[1].tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(gap, pa.int64())],
                                             ["vec_id", "cluster", "distance"])
    return run


def start(vectors: DataFrame, k: int, dim: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of "seed:vec_id", as integers."""
    def run(batches):
        for b in batches:
            text = [",".join(map(str, row)) for _, x in _components(b, dim, scale) for row in x.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(text, pa.string())], ["h", "x"])
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    least = vectors.withColumn("h", h)
    border = [r["h"] for r in least.select("h").orderBy("h").limit(k).collect()]
    if not border:
        return []
    # rows that share the last hash are all looked at; of each hash k rows at most
    rows = (least.where(F.col("h") <= border[-1]).select("h", "embedding").mapInArrow(run, "h string, x string")
            .orderBy("h", "x").limit(k).collect())
    return [[int(v) for v in r["x"].split(",")] for r in rows]


def moved(centroids: list[list[int]], sums) -> list[list[int]]:
    """Centroids at the floored means; sums: rows (cluster, d, limb, v), d = dim for the count."""
    dim = len(centroids[0])
    total: dict = {}
    for r in sums:
        at = (r["cluster"], r["d"])
        total[at] = total.get(at, 0) + (int(r["v"]) << (LIMB * r["limb"]))
    return [[total.get((c, d), 0) // n for d in range(dim)] if (n := total.get((c, dim), 0)) else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = CLUSTERS, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of every usable vector."""
    spark = vectors.sparkSession
    own = _finite(vectors, dim)
    centroids = start(own, k, dim, scale, seed)
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return own.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"),
            ("centroid", "string")))).limit(0)
    for _ in range(rounds):
        sums = (own.select("embedding").mapInArrow(_sums(Bisectors(centroids), dim, scale), "cluster int, d int, limb int, v long")
                .groupBy("cluster", "d", "limb").agg(F.sum("v").alias("v")).collect())
        centroids = moved(centroids, sums)
    found = store(own.mapInArrow(_assign(Bisectors(centroids), dim, scale), schema), "clusters")
    inertia = {r["cluster"]: int(r["v"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("v")).collect()}
    total = min(sum(inertia.values()), MOST)
    text = [",".join(map(str, c)) for c in centroids]
    each = spark.createDataFrame([(c, min(v, MOST), total, hashlib.sha256(text[c].encode()).hexdigest(), text[c]) for c, v in inertia.items()],
                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid string")
    return (found.join(F.broadcast(each), "cluster")  # k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"))


def op11_bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def oracle(k: int = CLUSTERS, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS, seed: int = 1) -> str:
    """DuckDB SQL for the query's rows; it holds components below 2^53."""
    parts = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS xs
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
comp AS MATERIALIZED (SELECT r, unnest(range({dim})) AS d, unnest(xs) AS x FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(range({dim})) AS d, unnest(xs) AS x FROM (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), array_to_string(xs, ',')) - 1 AS c, xs FROM kept) WHERE c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
  SELECT r, c, sum((comp.x - c{i}.x) * (comp.x - c{i}.x)) AS dist FROM comp JOIN c{i} USING (d) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM comp JOIN a{i} USING (r) GROUP BY c, d),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, d, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS HUGEINT) END AS x FROM c{i} LEFT JOIN m{i} USING (c, d))""")
    last = rounds
    return f"""WITH {','.join(parts)},
name AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{last} USING (r) JOIN name USING (c)"""
