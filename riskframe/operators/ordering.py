"""Exact order statistics and running totals that never sort a whole table in one task.

A row count decides: below `SINGLE_TASK_ROWS` a plain window is used, its input has a proven size. Above it, values of
any sortable type are cut into parts at sampled values, and every part that is still above the bound is cut again, so
that no window ever holds more rows than the bound, however large the table. Totals of the parts before a part are
running totals over the parts, taken in the same way. Keys are looked up by narrowing all wanted ranks together. Samples
only choose where to cut: results do not depend on them, nor on which side of the bound a table is.

NULLs sort last everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.session import materialize

SINGLE_TASK_ROWS = 1_000_000
MAX_BUCKETS = 64  # parts that a part is cut into at once
PIVOT_ROWS = 20_000  # sampled keys that the driver looks at in a round
_PART = "__part"


@dataclass(frozen=True)
class OrderProfile:
    """Number of non-null values, and the rows that one task may hold."""

    rows: int
    limit: int

    @property
    def small(self) -> bool:
        return self.rows <= self.limit


def order_profile(df: DataFrame, value: str, single_task_rows: int | None = None) -> OrderProfile:
    return OrderProfile(df.where(F.col(value).isNotNull()).count(), single_task_rows or SINGLE_TASK_ROWS)


def ordered_parts(df: DataFrame, order: str, by: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """`df` with `__part` (a path of numbers), and the part sizes. Paths sort as the values of `order` do.

    No part of a group `by` has more than `limit` rows (at least 8). `order` must be distinct and non-null within `by`.
    """
    limit = max(8, limit)
    keys = [*by, _PART]
    rows = materialize(df.withColumn(_PART, F.array().cast("array<int>")))
    turn = 0
    while True:
        turn += 1
        sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")))
        large = sizes.where(F.col("__rows") > limit)
        if large.isEmpty():
            return rows, sizes
        named = [F.col(k).alias(f"__k_{k}") for k in keys]
        same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        hashed = F.pmod(F.xxhash64(order, F.lit(turn)), F.lit(1 << 30))
        drawn = rows.join(large.select(*named, "__rows"), same).where(hashed * F.col("__rows") < float(4 * MAX_BUCKETS << 30))
        picked = F.array_sort(F.collect_set(order))  # about 4 x MAX_BUCKETS values, or all of a part with fewer
        # no more parts than needed, so that there are always far fewer parts than rows
        pieces = F.least(F.lit(float(MAX_BUCKETS)), F.ceil(F.col("__rows") * 2.0 / limit))
        step = F.greatest(F.lit(1), F.ceil(F.size("__v") / pieces).cast("int"))
        # the first one is no cut, so that both sides of the others have rows
        at = F.sequence(F.least(F.lit(1) + step, F.size("__v")), F.size("__v"), step)
        cuts = drawn.groupBy(*[f"__k_{k}" for k in keys]).agg(picked.alias("__v"), F.max("__rows").alias("__rows")).where(F.size("__v") > 1)
        cuts = materialize(cuts.withColumn("__cuts", F.transform(at, lambda k: F.get("__v", k - 1))).drop("__v", "__rows"))
        below = F.size(F.filter("__cuts", lambda c: c <= F.col(order)))
        path = F.when(F.col("__cuts").isNull(), F.col(_PART)).otherwise(F.concat(_PART, F.array(below)))
        rows = materialize(rows.join(cuts, same, "left").select(*[c for c in rows.columns if c != _PART], path.alias(_PART)))


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    profile: OrderProfile | None = None,
) -> DataFrame:
    """Adds `cum_<c>` (this row and all before it) and `total_<c>` for each column of `sums`.

    `order` must be distinct and non-null within `by`. `profile` may be that of the rows that `df` was counted from.
    """
    profile = profile or order_profile(df, order)
    direction: Column = F.col(order).desc() if descending else F.col(order).asc()
    if not profile.small:
        # what counts is the largest group that a window would hold
        df = materialize(df)
        largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        profile = OrderProfile(largest or 0, profile.limit)
    if profile.small:
        whole = W.partitionBy(*by)
        upto = whole.orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select(
            "*",
            *[F.sum(c).over(upto).alias(f"cum_{c}") for c in sums],
            *[F.sum(c).over(whole).alias(f"total_{c}") for c in sums],
        )

    rows, _ = ordered_parts(df, order, by, profile.limit)
    keys = [*by, _PART]
    per_part = materialize(rows.groupBy(*keys).agg(*[F.sum(c).alias(f"__b_{c}") for c in sums]))
    names = [f"__b_{c}" for c in sums]
    # the parts are counted like rows, under another name for their paths
    at = "__path"
    ended = running_totals(per_part.withColumnRenamed(_PART, at), at, names, by, descending, OrderProfile(per_part.count(), profile.limit))
    offsets = ended.withColumnRenamed(at, _PART).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[(F.col(f"cum___b_{c}") - F.col(f"__b_{c}")).alias(f"__o_{c}") for c in sums],
        *[F.col(f"total___b_{c}").alias(f"total_{c}") for c in sums],
    )
    local = W.partitionBy(*keys).orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.select("*", *[F.sum(c).over(local).alias(f"__l_{c}") for c in sums])
    joined = inside.join(offsets, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return joined.select(
        *df.columns,
        *[(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    name: str = "q",
    single_task_rows: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of `value` per `by`, as an array column in the order of `probs`."""
    data = df.where(F.col(value).isNotNull())
    profile = order_profile(data, value, single_task_rows)
    if profile.small:
        wanted = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias(name)
        return data.groupBy(*by).agg(wanted)

    distinct = data.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(distinct, value, ["n"], by, profile=profile)
    position = F.col("p") * (F.col("total_n") - 1)
    covers = lambda rank: (rank >= F.col("cum_n") - F.col("n")) & (rank < F.col("cum_n"))
    points = (
        ranked.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p"))
        .withColumn("pos", position)
        .where(covers(F.floor("pos")) | covers(F.ceil("pos")))
        .groupBy(*by, "i")
        .agg(
            F.max(F.when(covers(F.floor("pos")), F.col(value).cast("double"))).alias("lo"),
            F.max(F.when(covers(F.ceil("pos")), F.col(value).cast("double"))).alias("hi"),
            F.max("pos").alias("pos"),
        )
        .withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos")))
    )
    packed = F.array_sort(F.collect_list(F.struct("i", "q")))  # len(probs) items
    return points.groupBy(*by).agg(packed.getField("q").alias(name))


def sort_key(keys: Sequence[str]) -> Column:
    """A struct that sorts as the tuple of `keys` does, NULLs last."""
    parts = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(parts)])


def literal_key(schema: T.StructType, keys: Sequence[str], values: Sequence) -> Column:
    parts = [c for k, v in zip(keys, values) for c in (F.lit(v is None), F.lit(v).cast(schema[k].dataType))]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(parts)])


@dataclass(frozen=True)
class _Span:
    """Keys strictly between two known ones (None: no bound), how many rows those are, and the rank of the first."""

    low: tuple | None
    high: tuple | None
    rows: int
    first: int


def kth_keys(
    df: DataFrame, keys: Sequence[str], ks: Sequence[int], rows: int | None = None, single_task_rows: int | None = None
) -> list[tuple]:
    """The 0-based k-th smallest tuples of `keys` (any sortable types, NULLs last), one per k.

    `rows` is the number of rows of `df` where the caller knows it. Rows are neither sorted nor shuffled above the bound:
    a round samples keys and counts, for all k in one pass, the rows below, at and between the two sampled keys around
    each k, until few enough are left between. The number of rounds does not depend on how many k there are.
    """
    limit, keys, wanted = single_task_rows or SINGLE_TASK_ROWS, list(keys), sorted(set(ks))
    if not wanted:
        return []
    data = df.select(*keys)
    total = data.count() if rows is None else rows
    if total > limit:
        data = materialize(data)  # several rounds read the keys
    key, order = sort_key(keys), [F.col(c).asc_nulls_last() for c in keys]

    def inside(span: _Span) -> Column:
        test = F.lit(True)
        if span.low is not None:
            test &= key > literal_key(data.schema, keys, span.low)
        if span.high is not None:
            test &= key < literal_key(data.schema, keys, span.high)
        return test

    def by_span(spans: list[_Span], tests: list[Column]) -> DataFrame:
        """Rows with the number `__span` of each span that they are in and whose test they pass."""
        marks = [F.when(inside(s) & t, F.lit(i)) for i, (s, t) in enumerate(zip(spans, tests))]
        return data.select("*", F.explode(F.array_compact(F.array(*marks))).alias("__span"))

    found: dict[int, tuple] = {}
    spans = {k: _Span(None, None, total, 0) for k in wanted}
    turn = 0
    while open_ := {k: s for k, s in spans.items() if s.rows > limit}:
        turn += 1
        apart = list(dict.fromkeys(open_.values()))
        chance = F.rand(turn)
        drawn = by_span(apart, [chance < max(16, PIVOT_ROWS // len(apart)) / s.rows for s in apart]).orderBy("__span", *order)
        samples: list[list[tuple]] = [[] for _ in apart]
        for r in drawn.collect():  # about PIVOT_ROWS keys
            samples[r["__span"]].append(tuple(r[c] for c in keys))
        around = {}
        for k, s in open_.items():
            sample = samples[apart.index(s)]
            if sample:
                at, spread = (k - s.first) / s.rows * len(sample), 2 * math.sqrt(len(sample)) + 1
                around[k] = sample[max(0, int(at - spread))], sample[min(len(sample) - 1, int(at + spread))]
        counts = []
        for k, (a, b) in around.items():
            at_a, at_b = (key == literal_key(data.schema, keys, v) for v in (a, b))
            tests = (inside(_Span(spans[k].low, a, 0, 0)), at_a, inside(_Span(a, b, 0, 0)), at_b)
            counts += [F.count(F.when(t, 1)) for t in tests]
        told = data.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first() if counts else ()
        for j, (k, (a, b)) in enumerate(around.items()):
            s, first = spans[k], spans[k].first
            below, at_a, middle, at_b = told[4 * j : 4 * j + 4]
            if a == b:
                middle = at_b = 0
            rest = s.rows - below - at_a - middle - at_b
            for size, exact, low, high in ((below, None, s.low, a), (at_a, a, a, a), (middle, None, a, b), (at_b, b, b, b), (rest, None, b, s.high)):
                if k < first + size:
                    break
                first += size
            if exact is not None:
                found[k] = exact
                del spans[k]
            else:
                spans[k] = _Span(low, high, size, first)
    if spans:
        left = list(dict.fromkeys(spans.values()))
        placed = by_span(left, [F.lit(True)] * len(left)).withColumn("__place", F.row_number().over(W.partitionBy("__span").orderBy(*order)) - 1)
        hit = F.lit(False)
        for k, s in spans.items():
            hit |= (F.col("__span") == left.index(s)) & (F.col("__place") == k - s.first)
        for r in placed.where(hit).collect():  # one row per k
            found[left[r["__span"]].first + r["__place"]] = tuple(r[c] for c in keys)
    return [found[k] for k in ks]


def before_key(df: DataFrame, keys: Sequence[str], cut: tuple) -> Column:
    """True where the tuple of `keys` sorts before `cut`, NULLs last."""
    return sort_key(keys) < literal_key(df.schema, keys, cut)


def dense_codes(
    distinct: DataFrame, group: str, value: str, name: str, single_task_rows: int | None = None
) -> DataFrame:
    """0-based position of `value` (any sortable type) within `group`; rows must be distinct."""
    profile = order_profile(distinct, value, single_task_rows)
    placed = running_totals(distinct.withColumn("__one", F.lit(1)), value, ["__one"], [group], profile=profile)
    return placed.select(*distinct.columns, (F.col("cum___one") - 1).cast("int").alias(name))
