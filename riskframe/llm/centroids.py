"""Clustering around integer centroids, with Ptolemaic lower bounds in place of most distances.

Vectors become integers, so every sum, mean and distance is exact and no result depends on the order of work. Pivots
are a few vectors, taken in pairs that lie far apart; each vector's distances to them are computed once and stored
beside it. For a pair (p, q), Ptolemy's inequality bounds the distance of a vector x from a centroid c:

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q)

Per vector the centroid with the lowest bound is measured first; only centroids whose bound, rounded down by more than
the error of its floating-point terms, is not above that distance are measured too. Measured distances are exact
integers, so the bounds save work and never change an answer.

One pass per round gives sums per centroid and task: centroids x components rows, added up by Spark. Only centroids,
of fixed number and size, reach the driver. Nothing is dealt out by cluster, so no cluster is too large for a task.

Defined results: vectors that are NULL, of another length, or hold a NULL, NaN or infinity take no part; a NULL vec_id
is kept, but starts a centroid only after all others; seeds of equal hash are ordered by their components; rows with
equal vec_id or equal vectors are rows of their own; fewer vectors than centroids make as many centroids as vectors;
an empty table gives an empty result. A component beyond 2**27 after scaling raises ArithmeticError, since squared
distances would leave 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.session import materialize

SIZE = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
PAIRS = 6
PIVOT_SAMPLE = 256  # vectors, the first ones by hash, among which pivots are looked for
LIMIT = 1 << 27
ROWS = 4096


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """vec_id and v (components as integers) of the vectors that take part."""
    x = F.col("x").cast("array<double>")
    whole = (F.size("x") == size) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("x")).where(whole)
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT))))
    rows = rows.select("vec_id", scaled.alias("v"))
    fits = F.forall("v", lambda c: F.abs(c) <= LIMIT)
    return rows.select("vec_id", F.when(fits, F.col("v")).otherwise(F.raise_error("a component is too large")).alias("v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `a` from those of `b`."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def far_pairs(sample: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """Row numbers of pivot pairs: from a spread set of pivots (each far from those before it), the farthest pairs."""
    if len(sample) < 2:
        return np.zeros((0, 2), np.int64)
    chosen = [0]
    nearest = squared(sample, sample[:1])[:, 0]
    while len(chosen) < min(len(sample), pairs + 2):
        far = int(nearest.argmax())
        if not nearest[far]:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, squared(sample, sample[far : far + 1])[:, 0])
    between = squared(sample[chosen], sample[chosen])
    found = [(-int(between[i, j]), i, j) for i in range(len(chosen)) for j in range(i) if between[i, j]]
    return np.array([(chosen[i], chosen[j]) for _, i, j in sorted(found)[:pairs]], np.int64).reshape(-1, 2)


@dataclass(frozen=True)
class Pivots:
    """Vectors of the pivots, the pairs as numbers of them, and each pair's distance."""

    vectors: np.ndarray
    pairs: np.ndarray
    apart: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, pairs: int = PAIRS) -> Pivots:
        found = far_pairs(sample, pairs)
        used = np.unique(found)
        numbered = np.searchsorted(used, found)
        vectors = sample[used]
        apart = np.sqrt(((vectors[numbered[:, 0]] - vectors[numbered[:, 1]]) ** 2).sum(axis=1).astype(float))
        return Pivots(vectors, numbered, apart)

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(v, self.vectors).astype(float))

    def lower_bounds(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Bounds of all distances, by the distances of vectors `x` and centroids `c` from the pivots; never too high.

        Square roots, products and the quotient each err by at most 2**-53 of their value, so the difference errs by
        less than 2**-49 of the two products' sum.
        """
        best = np.zeros((len(x), len(c)))
        for (p, q), apart in zip(self.pairs.tolist(), self.apart.tolist()):
            one, two = x[:, p : p + 1] * c[:, q], x[:, q : q + 1] * c[:, p]
            np.maximum(best, (np.abs(one - two) - (one + two) * 2.0**-48) / apart * (1 - 2.0**-48), out=best)
        return best


def nearest(v: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller one on ties), its squared distance, and how many were measured."""
    rows = np.arange(len(v))
    bounds = pivots.lower_bounds(cached, pivots.distances(centroids))
    first = bounds.argmin(axis=1)
    distances = np.full(bounds.shape, np.iinfo(np.int64).max)
    distances[rows, first] = ((v - centroids[first]) ** 2).sum(axis=1)
    # a squared integer distance can be below the best only if the bound's square is; half a unit covers its rounding
    open_ = bounds**2 * (1 - 2.0**-48) - 0.5 <= distances[rows, first][:, None]
    open_[rows, first] = False
    row, column = np.nonzero(open_)
    distances[row, column] = ((v[row] - centroids[column]) ** 2).sum(axis=1)
    best = distances.argmin(axis=1)
    return best, distances[rows, best], len(v) + len(row)


def matrix(column: pa.Array, size: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), size)


def parts(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


@dataclass(frozen=True)
class Clusters:
    """Stored vectors with their pivot distances, the pivots, and the centroids after the last round."""

    rows: DataFrame
    pivots: Pivots
    centroids: np.ndarray

    def assigned(self) -> DataFrame:
        """vec_id, cluster, distance of every vector. A narrow pass."""
        pivots, centroids = self.pivots, self.centroids

        def run(batches):
            for part in parts(batches):
                v = matrix(part.column(1), centroids.shape[1])
                found, distance, _ = nearest(v, matrix(part.column(2), len(pivots.vectors), float), centroids, pivots)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

        kind = self.rows.schema["vec_id"].dataType
        schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return self.rows.select("vec_id", "v", "near").mapInArrow(run, schema)

    def moved(self) -> Clusters:
        """The next round: every centroid with vectors becomes the floor of their mean."""
        pivots, centroids = self.pivots, self.centroids

        def run(batches):
            sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
            for part in parts(batches):
                v = matrix(part.column(0), centroids.shape[1])
                found = nearest(v, matrix(part.column(1), len(pivots.vectors), float), centroids, pivots)[0]
                for k in np.unique(found).tolist():
                    sums[k] += v[found == k].sum(axis=0)
                counts += np.bincount(found, minlength=len(centroids))
            for k in np.flatnonzero(counts).tolist():
                columns = [[k] * len(sums[k]), range(len(sums[k])), [str(s) for s in sums[k]], [int(counts[k])] * len(sums[k])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["k", "at", "total", "n"])

        sums = self.rows.select("v", "near").mapInArrow(run, "k int, at int, total string, n bigint")
        exact = sums.groupBy("k", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        after = centroids.copy()
        for row in exact.collect():  # centroids x components
            after[row["k"], row["at"]] = int(row["total"]) // row["n"]
        return Clusters(self.rows, pivots, after)


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    size: int = SIZE,
    scale: int = SCALE,
    pairs: int = PAIRS,
) -> Clusters:
    """The centroids after `rounds` rounds. They start as the `k` vectors with the smallest sha256 of `seed:vec_id`."""
    kept = materialize(integer_vectors(vectors, id_col, vector_col, size, scale))
    spread = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select("v", spread.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(max(k, PIVOT_SAMPLE)).collect()
    sample = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    pivots = Pivots.of(sample, pairs)

    def measure(batches):
        for part in parts(batches):
            near = pivots.distances(matrix(part.column(1), size))
            ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], [*part.schema.names, "near"])

    rows = materialize(kept.mapInArrow(measure, T.StructType([*kept.schema.fields, T.StructField("near", T.ArrayType(T.DoubleType()))])))
    state = Clusters(rows, pivots, sample[:k])
    for _ in range(rounds if len(sample) else 0):
        state = state.moved()
    return state


def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    state = cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = materialize(state.assigned())
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [
        (c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(state.centroids.tolist())
    ]
    names = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """The rounds, written out: assign every vector, then move the centroids."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT)))"
    out = []
    for k in range(ROUNDS + 1):
        out.append(
            f"a{k} AS (SELECT rid, min_by(c, d * {CENTROIDS} + c) AS c, min(d) AS d FROM "
            f"(SELECT v.rid, c.c, {distance} AS d FROM v, c{k} c) GROUP BY rid)"
        )
        if k < ROUNDS:
            out.append(
                f"m{k} AS (SELECT c, list(CAST(m AS BIGINT) ORDER BY i) AS x FROM (SELECT a.c, u.i, "
                f"(sum(CAST(v.x[u.i] AS HUGEINT)) - ((sum(CAST(v.x[u.i] AS HUGEINT)) % count(*)) + count(*)) % count(*)) // count(*) AS m "
                f"FROM a{k} a JOIN v USING (rid), (SELECT unnest(range(1, {SIZE + 1})) AS i) u GROUP BY a.c, u.i) GROUP BY c), "
                f"c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (c))"
            )
    return ",\n".join(out)


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS INTEGER) AS c, x
  FROM v QUALIFY c < {CENTROIDS}
),
{_rounds_sql()}
SELECT v.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (rid) JOIN c{ROUNDS} z ON z.c = a.c
"""
