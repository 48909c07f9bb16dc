"""N-gram Jaccard join: prefix filtering under several global token orders, then exact verification.

A text is its set of five-word shingles (64-bit hashes; a clash would have to fall inside one pair of texts to
matter). Two sets with Jaccard >= t share a token among the first |x| - ceil(t|x|) + 1 of both, whatever total order
the tokens are put in. Candidates have to pass that filter under three orders:

1. Frequency order, rarest first. Frequencies come from a fixed-size count sketch that never counts too low. The
   prefixes are joined by token, with the length filter and the filter on the token's position in both sets.
2., 3. Two independent hash orders: the pairs' prefixes must meet in each of them.

Survivors are verified on their whole texts. Work on groups of copies stays linear:

- Equal sets are one class, found by a 128-bit fingerprint with map-side aggregation; only classes are joined.
- Links inside a known component need no search. First a few classes of each token's bucket, those nearest to the
  middle of a group of copies, are compared with all others of it, components are built, and only pairs across components are looked at after that: first for a few
  classes outside the bucket's largest component, then for all that is left. Every pair of classes is thus
  either verified, or ruled out by a filter, or already connected: the components are exact.
- Buckets are proven short by the sketch, or counted with map-side aggregation and joined (a join that Spark can
  split when it is skewed).

Defined results: a text with fewer than five words is one shingle; NULL, empty and word-less texts have no shingle
and stay alone; rows with equal doc_id are rows of their own, and each gets the component of its text; a NULL doc_id
takes part, but never names a component unless no other id is in it. Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.arrow import SLICE_BYTES, add_columns, as_bytes, narrow, slices
from riskframe.llm.graph import components
from riskframe.llm.hashing import mix, shingle_sets
from riskframe.session import materialize

U = np.uint64
THRESHOLD = 80  # per cent
SKETCH_BITS = 20
SKETCH_BLOCK = 4096
ORDERS = (11, 12)  # seeds of the hash orders
BUCKET_ROWS = 4096
FIRST_PIVOTS, MORE_PIVOTS = 2, 8
SMALL_ROWS = 400_000  # rows of 24 bytes that may be broadcast: under 10 MB


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def token_sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Upper bounds of token frequencies: counts of shingles by the first bits of their hash.

    Each task adds up its whole partition and gives its sums once per block of counters; the blocks are added up by
    tasks that read them as a stream. Only the final counters, of fixed size, come to the driver.
    """
    size = 1 << bits

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for s in shingle_sets(as_bytes(part, "text"), distinct=False):
                    if len(s) > 1 << 16:
                        total += np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=size)
                    else:
                        np.add.at(total, (s >> U(64 - bits)).astype(np.int64), 1)
        if total.any():
            blocks = [total[k : k + SKETCH_BLOCK].tobytes() for k in range(0, size, SKETCH_BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks)], ["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(b.as_py(), np.int64)
                total[k] = total[k] + values if k in total else values.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "counts"]
        )

    schema = "block int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    sketch = np.zeros(size, np.int64)
    for row in sums.collect():
        sketch[row["block"] * SKETCH_BLOCK : (row["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(row["counts"], np.int64)
    return sketch


def profiles(docs: DataFrame, sketch: np.ndarray, threshold: int, bits: int = SKETCH_BITS) -> DataFrame:
    """Per row its set's size, fingerprint (c1, c2), prefix in frequency order, and where its frequent tokens begin."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    bound = max(BUCKET_ROWS, 4 * int(sketch.mean()))

    def start():
        counts = shared.value

        def run(part):
            n, c1, c2, tokens, sizes, cold = [], [], [], [], [], []
            for s in shingle_sets(as_bytes(part, "text")):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    c1.append(mix(s, 3).sum(dtype=U).view(np.int64))
                    c2.append(mix(s, 4).sum(dtype=U).view(np.int64))
                keep = prefix_length(len(s), threshold) if len(s) else 0
                often = counts[(s >> U(64 - bits)).astype(np.int64)]
                if keep < len(s):
                    # ties stay in the order of the tokens, which is the same everywhere
                    order = np.lexsort((s, often))[:keep]
                    s, often = s[order], often[order]
                tokens.append(s.view(np.int64))
                sizes.append(len(s))
                cold.append(int(np.searchsorted(often, bound)))
            flat = np.concatenate([np.zeros(0, np.int64), *tokens])
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            return [n, c1, c2, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), cold]

        return run

    fields = [("n", T.LongType()), ("c1", T.LongType()), ("c2", T.LongType()), ("tokens", T.ArrayType(T.LongType())), ("cold", T.IntegerType())]
    return add_columns(docs.withColumn("content", F.xxhash64("text")), "text", fields, start, SLICE_BYTES, drop=("text",))


def buckets(classes: DataFrame) -> DataFrame:
    """(token, node, n, pos) of all prefix tokens that two classes or more share."""
    posts = classes.select("node", "n", "cold", F.posexplode("tokens").alias("pos", "token"))
    cold = posts.where("pos < cold").select("token", "node", "n", "pos")
    cold = cold.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("rows > 1").drop("rows")
    hot = posts.where("pos >= cold").select("token", "node", "n", "pos")
    shared = hot.groupBy("token").count().where("count > 1").select("token")
    return cold.unionByName(hot.join(shared, "token"))


def pairs_of(ours: DataFrame, theirs: DataFrame, threshold: int, across: bool) -> DataFrame:
    """Candidate pairs of `ours` and `theirs` that share a token, pass the length and the position filter."""
    left = ours.select("token", *(F.col(c).alias(f"{c}_a") for c in ours.columns if c != "token"))
    right = theirs.select("token", *(F.col(c).alias(f"{c}_b") for c in theirs.columns if c != "token"))
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    # overlap >= t/(1+t) (|a|+|b|); from the first common token on, no more than the shorter rest can be common
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    meets = (left["token"] == right["token"]) & (F.col("node_a") != F.col("node_b"))
    meets &= (least * 100 >= most * threshold) & (room * (100 + threshold) >= (F.col("n_a") + F.col("n_b")) * threshold)
    if across:
        meets &= F.col("comp_a") != F.col("comp_b")
    found = left.join(right, meets)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def small(df: DataFrame) -> DataFrame:
    """A stored table of short rows, broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def representatives(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """(node, text, o1, o2): one text of each class in the pairs, and its prefixes in the two hash orders."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    keys = classes.select("node", F.col("rep.content").alias("content"), F.col("rep.doc_id").alias("rep_id"))
    keys = small(materialize(keys.join(wanted, "node", "left_semi")))
    rows = docs.withColumn("content", F.xxhash64("text"))
    found = rows.join(keys, (rows["content"] == keys["content"]) & rows["doc_id"].eqNullSafe(keys["rep_id"]))
    found = found.select("node", "text").dropDuplicates(["node"])

    def start():
        def run(part):
            out = []
            sets = shingle_sets(as_bytes(part, "text"))
            for seed in ORDERS:
                lists = []
                for s in sets:
                    keep = prefix_length(len(s), threshold)
                    lists.append(s[np.argsort(mix(s, seed), kind="stable")[:keep]].view(np.int64))
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *lists]))))
            return out

        return run

    order = T.ArrayType(T.LongType())
    return materialize(add_columns(found, "text", [("o1", order), ("o2", order)], start, SLICE_BYTES))


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs that pass the two hash orders and link in fact."""
    if pairs.isEmpty():
        return pairs
    reps = representatives(docs, classes, pairs, threshold)
    a = reps.select(F.col("node").alias("a"), F.col("o1").alias("a1"), F.col("o2").alias("a2"))
    b = reps.select(F.col("node").alias("b"), F.col("o1").alias("b1"), F.col("o2").alias("b2"))
    meets = F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2")
    left = pairs.join(a, "a").join(b, "b").where(meets).select("a", "b")
    texts = left.join(reps.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        reps.select(F.col("node").alias("b"), F.col("text").alias("text")), "b"
    )

    def start():
        def run(part):
            first = shingle_sets(as_bytes(part, "text_a"))
            # rows come sorted by b from the join, so many second texts repeat
            seconds = as_bytes(part, "text")
            new = [k for k in range(len(seconds)) if not k or seconds[k] != seconds[k - 1]]
            sets = dict(zip(new, shingle_sets([seconds[k] for k in new])))
            out, y = [], None
            for k, x in enumerate(first):
                y = sets.get(k, y)
                # place of each token of x in y, without sorting both again
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                out.append(100 * common >= threshold * (len(x) + len(y) - common))
            return [out]

        return run

    checked = add_columns(texts, "text", [("link", T.BooleanType())], start, SLICE_BYTES, drop=("text", "text_a"))
    return checked.where("link").select("a", "b")


def first_by_bucket(rows: DataFrame, n: int) -> DataFrame:
    """The n classes of each bucket with the fewest tokens of their own before the shared one.

    In a group of edited copies those are the texts nearest to the original: most of the others link to them.
    """
    order = Window.partitionBy("token").orderBy("pos", F.xxhash64("node"), "node")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def outside(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets of several components, with comp and whether a row is outside its bucket's largest component."""
    known = rows.join(labels.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left")
    known = known.select("token", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"))
    sizes = known.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    largest = sizes.groupBy("token").agg(
        F.max_by("comp", F.struct("rows", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps")
    )
    return known.join(largest.where("comps > 1").drop("comps"), "token").withColumn("out", F.col("comp") != F.col("largest")).drop("largest")


def link_classes(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile rows, classes, components of classes). `docs` has doc_id and text only."""
    sketch = token_sketch(docs)
    profile = materialize(profiles(docs, sketch, threshold))
    grouped = profile.where("n > 0").groupBy("n", "c1", "c2").agg(
        F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("rows"),
        F.min(F.struct("doc_id", "content")).alias("rep"), F.first("tokens").alias("tokens"), F.first("cold").alias("cold"),
    )
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()))
    rows = materialize(buckets(classes))
    tested = materialize(pairs_of(first_by_bucket(rows, FIRST_PIVOTS), rows, threshold, across=False))
    comps = components(linked(docs, classes, tested, threshold))
    for pivots in (MORE_PIVOTS, None):
        left = materialize(outside(rows, comps))
        ours = left.where("out")
        ours = first_by_bucket(ours, pivots) if pivots else ours
        pairs = pairs_of(ours.drop("out"), left.drop("out"), threshold, across=True)
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
        # what is connected is known by one link per class to its component's first
        known = comps.select(F.col("comp").alias("a"), F.col("node").alias("b"))
        comps = components(known.unionByName(linked(docs, classes, pairs, threshold)))
        tested = tested.unionByName(pairs)
    return profile, classes, comps


def grouped_rows(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, content, n and, for rows of components with several rows, comp and component_id."""
    profile, classes, comps = link_classes(docs, threshold)
    named = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = named.groupBy("comp").agg(F.min("smallest").alias("component_id"), F.sum("rows").alias("size"))
    # only classes of such components need a look-up; all other rows are their own component
    told = named.join(first.where("size > 1"), "comp").select("n", "c1", "c2", "comp", "component_id")
    return profile.select("doc_id", "content", "n", "c1", "c2").join(told, ["n", "c1", "c2"], "left").drop("c1", "c2")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    out = grouped_rows(narrow(docs, id_col, text_col), threshold)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the one with the smallest id.

    In a group, ids come before NULL; of rows with equal id the one with the smallest content hash stays, and of rows
    equal in both, one.
    """
    columns = docs.columns
    members = materialize(grouped_rows(narrow(docs, id_col, text_col), threshold).where("comp IS NOT NULL"))
    key = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "content")
    first = members.groupBy("comp").agg(F.min(key).alias("first"))
    told = members.join(first, "comp").withColumn("stays", key == F.col("first"))
    gone = small(materialize(told.where("not stays").select(F.col("doc_id").alias("__i"), F.col("content").alias("__c")).distinct()))
    twice = materialize(told.where("stays").groupBy(F.col("doc_id").alias("__i"), F.col("content").alias("__c")).count().where("count > 1"))
    rows = docs.withColumns({"__id": F.col(f"`{id_col}`"), "__content": F.xxhash64(F.col(f"`{text_col}`"))})
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__content") == F.col("__c"))
    kept = rows.join(gone, same, "left_anti")
    if not twice.isEmpty():
        twice = small(twice)
        one = kept.join(twice, same, "left_semi").dropDuplicates(["__id", "__content"])
        kept = kept.join(twice, same, "left_anti").unionByName(one)
    return kept.select([F.col(f"`{c}`") for c in columns])


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k : k + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
  HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id, n.n
"""
