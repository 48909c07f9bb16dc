"""Hard negatives by a multiway hyperplane tree whose split points know the distances of their siblings' rows.

Vectors become integers; a score is an integer inner product. One more component brings all rows to the same length, so
that a score s of an anchor q stands for the distance sqrt(|q|^2 + R^2 - 2 s), and windows of scores become annuli.

The tree: every node has a few split points; a row belongs to the split point nearest to it, and each split point
stores, for every child of its node, the smallest and largest distance of the child's rows from it. Split points come
from a bounded sample (`SAMPLE` rows, the first by hash); the ranges and the leaves come from all rows. A search walks
down the tree with the annulus of a window: with d the distance of a split point and [lo, hi] its range of a child, the
child's rows lie between max(lo - d, d - hi, 0) and d + hi; a child is left out if any split point puts that outside the
annulus. Bounds are widened by more than the error of the distances. Leaves that remain are searched exactly.

1. Positives: the fifth best score of an anchor's label in the sample bounds its window from below.
2. Negatives: each positive's window of scores, raised by the fifth best fitting score in the sample.

Leaves are cut into blocks of at most `BLOCK_ROWS` rows, so a leaf of equal vectors is spread over tasks; each block
keeps the best `n` rows per anchor and window before anything is shuffled. The driver holds the tree and the sample,
whose size is bounded by parameters whatever the table.

Defined results: rows with a NULL id, label or vector, or a NULL, NaN or infinite component take no part; a shorter
vector counts as zero in the components it lacks; rows with equal ids are rows of their own (an anchor's own row alone
is no positive of it); ties go by smaller id; a negative positive score admits nothing, since its window is empty; an
empty table, or one without anchors, gives an empty result. Extra columns are ignored. Inner products beyond 2**45
raise ArithmeticError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import materialize

SCALE = 256
POSITIVES = NEGATIVES = 5
LEAST_PERCENT = 80
EVERY = 100
SAMPLE = 8192
FAN_OUT = 12
LEAF_ROWS = 1024  # rows that a leaf is planned for
BLOCK_ROWS = 65_536
ANCHOR_ROWS = 512
PRODUCT_LIMIT = 1 << 45


def integer_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int, label: Column | None) -> DataFrame:
    """uid, vec_id, label and v (components as integers) of the rows that take part. `label` replaces the label."""
    x = F.col("x").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("x"))
    whole = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
    big = float(1 << 40)
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-big)), F.lit(big))))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.coalesce(label, F.col("label")).alias("label") if label is not None else "label", scaled.alias("v"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as floats (whole numbers, exact), filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = values
    return out


def narrow_kind(largest: int) -> str:
    """The shortest integers that hold the components."""
    return next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if largest < 1 << bits)


def as_binary(v: np.ndarray, kind: str) -> pa.Array:
    """Each row's components as bytes of short integers, which is what is shuffled."""
    data = np.ascontiguousarray(v.astype(kind))
    offsets = np.arange(len(v) + 1, dtype=np.int32) * np.int32(data.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


@dataclass
class Node:
    """An inner node has split points and children; a leaf has its number."""

    leaf: int = -1
    number: int = -1
    points: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    lo: np.ndarray | None = None  # by split point and child
    hi: np.ndarray | None = None


class Tree:
    """Split points of the sample, and after `ranged` the distance ranges of all rows."""

    def __init__(self, sample: np.ndarray, radius2: float, leaves: int, fan_out: int = FAN_OUT):
        self.radius2 = radius2
        self.slack = 1e-6 * max(1.0, radius2) ** 0.5
        self.nodes: list[Node] = []
        self.leaves = 0
        self.root = self._grow(self.lift(sample), max(1, len(sample) // max(1, leaves)), fan_out)

    def lift(self, v: np.ndarray) -> np.ndarray:
        """Rows with the component that brings them all to the same length."""
        rest = np.sqrt(np.maximum(self.radius2 - (v**2).sum(axis=1), 0.0))
        return np.concatenate([v, rest[:, None]], axis=1)

    def distances(self, v: np.ndarray, points: np.ndarray) -> np.ndarray:
        square = (v**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * (v @ points.T)
        return np.sqrt(np.maximum(square, 0.0))

    def _grow(self, rows: np.ndarray, most: int, fan_out: int) -> Node:
        node = Node()
        if len(rows) > most:
            chosen = [0]
            near = self.distances(rows, rows[:1])[:, 0]
            while len(chosen) < fan_out:
                far = int(near.argmax())
                if near[far] <= self.slack:
                    break
                chosen.append(far)
                near = np.minimum(near, self.distances(rows, rows[far : far + 1])[:, 0])
            if len(chosen) > 1:
                node.points = rows[chosen]
                node.number = len(self.nodes)
                self.nodes.append(node)
                side = self.distances(rows, node.points).argmin(axis=1)
                node.children = [self._grow(rows[side == k], most, fan_out) for k in range(len(chosen))]
                return node
        node.leaf = self.leaves
        self.leaves += 1
        return node

    def place(self, v: np.ndarray, seen: Callable[[Node, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """Leaf of each row. `seen` is told each node's rows: their distances from its split points, and their child."""
        out = np.zeros(len(v), np.int32)
        lifted = self.lift(v)
        work = [(self.root, np.arange(len(v)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if node.points is None:
                out[rows] = node.leaf
                continue
            d = self.distances(lifted[rows], node.points)
            side = d.argmin(axis=1)
            if seen:
                seen(node, d, side)
            work += [(child, rows[side == k]) for k, child in enumerate(node.children)]
        return out

    def ranged(self, rows: list[tuple[int, int, int, float, float]]) -> None:
        for node in self.nodes:
            k = len(node.children)
            node.lo, node.hi = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for number, child, point, lo, hi in rows:
            self.nodes[number].lo[point, child], self.nodes[number].hi[point, child] = lo, hi

    def visit(self, v: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, anchors) to search: anchors (rows of `v`) for which a score in any of [least, most] may be there.

        `least` and `most` hold one row per anchor and one column per window; an empty window has least > most.
        """
        square = (v**2).sum(axis=1)[:, None] + self.radius2
        outer = np.sqrt(np.maximum(square - 2 * least, 0.0)) + self.slack
        inner = np.sqrt(np.maximum(square - 2 * most, 0.0)) - self.slack
        outer = np.where(least > most, -1.0, outer)
        query = np.concatenate([v, np.zeros((len(v), 1))], axis=1)
        found, work = [], [(self.root, np.flatnonzero((least <= most).any(axis=1)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if node.points is None:
                found.append((node.leaf, rows))
                continue
            d = self.distances(query[rows], node.points)
            for k, child in enumerate(node.children):
                if not np.isfinite(node.lo[0, k]):
                    continue  # no row of the table lies there
                nearest = np.maximum(node.lo[:, k] - d, d - node.hi[:, k]).max(axis=1)
                farthest = (d + node.hi[:, k]).min(axis=1)
                meets = (nearest[:, None] <= outer[rows] + self.slack) & (farthest[:, None] >= inner[rows] - self.slack)
                work.append((child, rows[meets.any(axis=1)]))
        return found


def best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the n highest entries of each row, the smaller column on ties; lowest-value entries are none."""
    width = scores.shape[1]
    none = np.iinfo(np.int64).min
    keys = np.where(scores == none, none, scores * width + (width - 1 - np.arange(width)))
    at = np.argpartition(keys, width - n, axis=1)[:, width - n :] if width > n else np.tile(np.arange(width), (len(keys), 1))
    row = np.repeat(np.arange(len(keys)), at.shape[1])
    taken = scores[row, at.ravel()] != none
    return row[taken], at.ravel()[taken]


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks (leaf, chunk, n, uids, ids, labels, vectors) of at most `most` rows of a leaf's chunk, as bytes.

    Rows of one (leaf, chunk) lie in one partition, sorted by id, and are read as a stream.
    """
    placed = rows.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "vec_id")
    extra = [c for c in rows.columns if c not in ("uid", "vec_id", "label", "v", "leaf", "chunk")]

    def run(batches):
        held, key = [], None

        def flush():
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                columns = [[key[0]], [key[1]], [t.num_rows]]
                columns += [[t.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("uid", "vec_id", "label")]
                columns += [[b"".join(t.column("v").to_pylist())]]
                columns += [[t.column(c).combine_chunks().flatten().to_numpy().tobytes()] for c in extra]  # lists of one length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("leaf", "chunk")], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    here = (int(keys[a, 0]), int(keys[a, 1]))
                    space = most - sum(h.num_rows for h in held) if here == key else 0
                    if not space:
                        yield from flush()
                        key, space = here, most
                    held.append(batch.slice(a, min(space, b - a)))
                    a += held[-1].num_rows
        yield from flush()

    names = ["uids", "ids", "labels", "vectors", *extra]
    target = pa.schema([("leaf", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in names)])
    return placed.mapInArrow(run, "leaf int, chunk int, n int, " + ", ".join(f"{c} binary" for c in names))


@dataclass(frozen=True)
class Index:
    """The rows in blocks by leaf, the tree, the sample, and how many chunks each leaf has."""

    rows: DataFrame
    blocks: DataFrame
    tree: Tree
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]  # uids, labels, vectors
    chunks: np.ndarray
    size: int
    kind: str  # of the components in bytes

    def search(self, anchors: DataFrame, n: int, same: bool) -> DataFrame:
        """uid, anchor_id, slot, other_id, score: per anchor and window the best `n` rows of the (or another) label.

        `anchors` has uid, vec_id, label, v, least and most: lists of whole numbers, one for each window (slot).
        """
        spark = anchors.sparkSession
        shared = spark.sparkContext.broadcast((self.tree, self.sample, self.chunks))
        size, kind = self.size, self.kind

        def route(batches):
            tree, (uids, labels, vectors), chunks = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, ANCHOR_ROWS):
                    part = batch.slice(start, ANCHOR_ROWS)
                    column = lambda c: part.column(part.schema.get_field_index(c))
                    v = matrix(column("v"), size)
                    width = int(column("least").value_lengths()[0].as_py())
                    least, most = (matrix(column(c), width) for c in ("least", "most"))
                    least = raised(v, column("uid").to_numpy(), column("label").to_numpy(), least, most, uids, labels, vectors, n, same)
                    limits = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * width), pa.array(least.ravel().astype(np.int64)))
                    part = part.set_column(part.schema.get_field_index("least"), "least", limits)
                    part = part.set_column(part.schema.get_field_index("v"), "v", as_binary(v, kind))
                    for leaf, rows in tree.visit(v, least, most):
                        some = part.take(pa.array(rows))
                        for chunk in range(int(chunks[leaf])):
                            place = [pa.array(np.full(len(rows), x, np.int32)) for x in (leaf, chunk)]
                            yield pa.RecordBatch.from_arrays([*some.columns, *place], [*some.schema.names, "leaf", "chunk"])

        named = "uid bigint, vec_id bigint, label bigint, v binary, least array<bigint>, most array<bigint>, leaf int, chunk int"
        visits = anchors.select("uid", "vec_id", "label", "v", "least", "most").mapInArrow(route, named)
        asked = packed(visits, ANCHOR_ROWS).select("leaf", "chunk", *(F.col(c).alias(f"q_{c}") for c in ("n", "uids", "ids", "labels", "vectors", "least", "most")))
        met = self.blocks.join(asked, ["leaf", "chunk"])

        def compare(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}
                    yield from compared(row, n, same, size, kind)

        found = met.mapInArrow(compare, "uid bigint, anchor_id bigint, slot int, other_uid bigint, other_id bigint, score bigint")
        order = Window.partitionBy("uid", "slot").orderBy(F.col("score").desc(), "other_id", "other_uid")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def raised(v, uid, label, least, most, uids, labels, vectors, n, same) -> np.ndarray:
    """`least` raised to the n-th best score in the sample that the window admits; all better rows are still inside."""
    scores = v @ vectors.T
    admitted = (labels == label[:, None]) == same
    admitted &= uids != uid[:, None]
    out = least.copy()
    if scores.shape[1] >= n:
        for w in range(least.shape[1]):
            fit = np.where(admitted & (scores >= least[:, w : w + 1]) & (scores <= most[:, w : w + 1]), scores, -np.inf)
            out[:, w] = np.maximum(out[:, w], np.partition(fit, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n])
    return out


def compared(row: dict, n: int, same: bool, size: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The best rows of one block of rows for each of one block of anchors and each window."""
    whole = lambda c: np.frombuffer(row[c], np.int64)
    uids, ids, labels = whole("uids"), whole("ids"), whole("labels")
    q_uids, q_ids, q_labels = whole("q_uids"), whole("q_ids"), whole("q_labels")
    v, q = (np.frombuffer(row[c], kind).reshape(-1, size).astype(float) for c in ("vectors", "q_vectors"))
    least, most = whole("q_least").reshape(len(q), -1), whole("q_most").reshape(len(q), -1)
    none = np.iinfo(np.int64).min
    step = max(1, (1 << 20) // len(v))
    for start in range(0, len(q), step):
        part = slice(start, start + step)
        scores = (q[part] @ v.T).astype(np.int64)
        fits = ((labels == q_labels[part, None]) == same) & (uids != q_uids[part, None])
        for slot in range(least.shape[1]):
            inside = fits & (scores >= least[part, slot, None]) & (scores <= most[part, slot, None])
            if not inside.any():
                continue
            at, other = best(np.where(inside, scores, none), n)
            columns = [q_uids[part][at], q_ids[part][at], np.full(len(at), slot, np.int32), uids[other], ids[other], scores[at, other]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "anchor_id", "slot", "other_uid", "other_id", "score"])


def build(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = SCALE,
    label: Column | None = None,
    sample_rows: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    fan_out: int = FAN_OUT,
) -> Index:
    """Index of all rows. `label` is an expression over vec_id and label that replaces the label."""
    rows = materialize(integer_rows(vectors, id_col, label_col, vector_col, scale, label))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.max(norm).alias("norm"), F.max(largest).alias("largest")).first()
    size, radius2 = max(1, facts["size"] or 0), facts["norm"] or 0.0
    if radius2 > PRODUCT_LIMIT:
        raise ArithmeticError("inner products are too large for exact scores")
    drawn = rows.select("uid", "label", "v").orderBy(F.xxhash64("uid"), "uid").limit(sample_rows).toArrow().combine_chunks()
    v = matrix(drawn.column("v").combine_chunks(), size) if drawn.num_rows else np.zeros((0, size))
    sample = (drawn.column("uid").to_numpy(), drawn.column("label").to_numpy(), v)
    tree = Tree(v, radius2, min(sample_rows // 8, -(-facts["n"] // leaf_rows)), fan_out)
    kind = narrow_kind(facts["largest"] or 0)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def measure(batches):
        tree = shared.value
        lo = {n.number: np.full((len(n.children),) * 2, np.inf) for n in tree.nodes}
        hi = {n.number: np.full((len(n.children),) * 2, -np.inf) for n in tree.nodes}
        counts = np.zeros(tree.leaves, np.int64)

        def seen(node, d, side):
            for k in np.unique(side).tolist():
                lo[node.number][:, k] = np.minimum(lo[node.number][:, k], d[side == k].min(axis=0))
                hi[node.number][:, k] = np.maximum(hi[node.number][:, k], d[side == k].max(axis=0))

        for batch in batches:
            counts += np.bincount(tree.place(matrix(batch.column(0), size), seen), minlength=tree.leaves)
        told = [(0, leaf, 0, 0.0, 0.0, int(n)) for leaf, n in enumerate(counts.tolist()) if n]
        for number in lo:
            told += [(1 + number, c, p, lo[number][p, c], hi[number][p, c], 0) for p, c in zip(*np.nonzero(np.isfinite(lo[number])))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        columns = list(zip(*told)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["node", "child", "point", "lo", "hi", "n"])

    ranges = rows.select("v").mapInArrow(measure, "node int, child int, point int, lo double, hi double, n bigint")
    known = ranges.groupBy("node", "child", "point").agg(F.min("lo"), F.max("hi"), F.sum("n")).collect()  # nodes x fan-out squared
    tree.ranged([(r[0] - 1, r[1], r[2], r[3], r[4]) for r in known if r[0]])
    chunks = np.ones(tree.leaves, np.int64)
    for r in known:
        if not r[0]:
            chunks[r[1]] = -(-r[5] // block_rows)

    def settle(batches):
        tree = shared.value
        for batch in batches:
            v = matrix(batch.column(3), size)
            leaf = tree.place(v)
            # the place in a hash order spreads equal vectors over the leaf's chunks
            chunk = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[leaf]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], as_binary(v, kind), pa.array(leaf), pa.array(chunk.astype(np.int32))], [*batch.schema.names, "leaf", "chunk"])

    placed = rows.mapInArrow(settle, "uid bigint, vec_id bigint, label bigint, v binary, leaf int, chunk int")
    return Index(rows, materialize(packed(placed, block_rows)), tree, sample, chunks, size, kind)


def mine(
    index: Index,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows with an id divisible by `every`."""
    anchors = index.rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    whole = float(2 * PRODUCT_LIMIT)
    bounds = {"least": F.array(F.lit(-whole).cast("long")), "most": F.array(F.lit(whole).cast("long"))}
    near = materialize(index.search(anchors.withColumns(bounds), positives, same=True))
    # per anchor at most `positives` windows, the first ones first; missing ones are empty
    window = F.struct("place", F.col("score").alias("top"))
    windows = near.groupBy("uid").agg(F.array_sort(F.collect_list(window)).alias("w"))
    top = lambda k: F.coalesce(F.get("w", F.lit(k)).getField("top"), F.lit(-1).cast("long"))
    least = lambda k: F.floor((top(k) * least_percent + 99) / 100).cast("long")
    asked = anchors.join(windows, "uid").select(
        "uid", "vec_id", "label", "v",
        F.array(*[F.when(top(k) < 0, F.lit(0).cast("long")).otherwise(least(k)) for k in range(positives)]).alias("least"),
        F.array(*[top(k) for k in range(positives)]).alias("most"),
    )
    found = index.search(asked, negatives, same=False)
    chosen = near.select("uid", (F.col("place") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(chosen, ["uid", "slot"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(build(spark.read.parquet(f"{sf}/embeddings.parquet"), label=moved))


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
), s AS MATERIALIZED (
  SELECT a.uid, a.vec_id AS anchor_id, a.label AS own, o.uid AS other, o.vec_id, o.label,
    CAST(coalesce(list_sum(list_transform(list_zip(a.x, o.x), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v o ON a.uid <> o.uid WHERE a.vec_id % {EVERY} = 0
), p AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) AS k
  FROM s WHERE own = label QUALIFY k <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.uid, p.k ORDER BY s.score DESC, s.vec_id, s.other) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.uid = s.uid AND s.own <> s.label
  AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
