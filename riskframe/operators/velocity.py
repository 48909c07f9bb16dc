"""Point-in-time velocity features: count, sum and mean of an entity's amounts in `[t - window, t)`.

Three exact methods:

`sliding`  the plain range frame. Re-aggregates each frame, so its cost grows with rows per window.
`prefix`   difference of two growing frames, linear in the rows. All rows of an entity meet in one task.
`chunked`  for hot entities: rows are first summed per (entity, second), then each entity is cut into time
           chunks of the longest window, every chunk also receiving the previous one as history. A task
           holds at most two chunks of distinct seconds, whatever the number of rows. The result is
           joined back on (entity, second).

`auto` measures the largest entity with one narrow aggregation and picks prefix or chunked per entity.
NULL entities form one group, as any other value. Rows of the same second do not see each other. Rows without a time
see nothing and are seen by nothing; amounts that are NaN or infinite count as missing. All methods give the same
values: amounts are summed as decimals of `AMOUNT_DIGITS` places, never as doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from riskframe.schema import AMOUNT, ID, TIME, present, require

# Default entities and windows (label -> seconds).
ENTITY_COLS = ["card1", "addr1", "P_emaildomain"]
VELOCITY_WINDOWS = {"1h": 3_600, "24h": 86_400, "7d": 604_800}

HOT_ENTITY_ROWS = 2_000_000
AMOUNT_DIGITS = 6
METHODS = ("auto", "prefix", "sliding", "chunked")


def expected_feature_names(
    entity_cols: Sequence[str] = ENTITY_COLS, windows: Mapping[str, int] = VELOCITY_WINDOWS
) -> list[str]:
    return [f"vel_{e}_{w}_{stat}" for e in entity_cols for w in windows for stat in ("count", "sum", "mean_amt")]


def compute_velocity_features(
    df: DataFrame,
    entity_cols: Sequence[str] = ENTITY_COLS,
    windows: Mapping[str, int] = VELOCITY_WINDOWS,
    method: str = "auto",
    history: DataFrame | None = None,
    within: Sequence[str] = (),
    amount_scale: int | None = None,
    hot_entity_rows: int = HOT_ENTITY_ROWS,
    join_on: str | None = None,
    narrow: bool = False,
) -> DataFrame:
    """Adds `vel_<entity>_<window>_{count,sum,mean_amt}` to every row of `df`.

    history       earlier rows that may be seen but are not returned
    within        extra grouping columns, e.g. `split`, that history must not cross
    amount_scale  number of decimals the amounts have; sums are then taken over 64-bit integers, which is faster
                  than the decimals of the default and as exact if no amount has more places
    join_on       an id: features are then computed from the few columns they need, all entities in one exchange and
                  sort, and joined back once, so a table of hundreds of columns is shuffled once, by that id. Rows that
                  share an id are told apart by their time and entities
    narrow        32-bit outputs
    """
    require(df, [TIME, AMOUNT], "velocity")
    made_before = set(expected_feature_names(entity_cols, windows))
    df = df.drop(*[c for c in df.columns if c in made_before])
    if method not in METHODS:
        raise ValueError(f"unknown method '{method}', choose one of {METHODS}")
    entities = present(df, entity_cols, "velocity")
    if join_on is not None:
        require(df, [join_on], "velocity")
        return _joined_back(df, entities, windows, method, history, within, amount_scale, hot_entity_rows, join_on, narrow)
    past = None
    if history is not None:
        past = history.select(*[c for c in dict.fromkeys([TIME, AMOUNT, *within, *entities])])
    chosen = _choose(df, past, entities, within, method, hot_entity_rows)
    out = df
    for entity in entities:
        keys = [*within, entity]
        if chosen[entity] == "chunked":
            out = _chunked(out, df, past, keys, entity, windows, amount_scale)
        else:
            out = _in_place(out, past, keys, entity, windows, amount_scale, chosen[entity] == "sliding")
        out = out.withColumns(_means([entity], windows))
    return _last(out, entities, windows, narrow)


def _means(entities: Sequence[str], windows: Mapping[str, int]) -> dict[str, Column]:
    means = {}
    for entity in entities:
        for label in windows:
            count, total = F.col(f"vel_{entity}_{label}_count"), F.col(f"vel_{entity}_{label}_sum")
            means[f"vel_{entity}_{label}_mean_amt"] = F.when(count > 0, total / count).otherwise(F.lit(0.0))
    return means


def _last(out: DataFrame, entities: Sequence[str], windows: Mapping[str, int], narrow: bool) -> DataFrame:
    """The features behind the other columns, in their declared order."""
    added = expected_feature_names(entities, windows)
    kept = [c for c in out.columns if c not in added]
    return out.select(*kept, *[F.col(c).cast("float") if narrow else F.col(c) for c in added])


def _joined_back(
    df: DataFrame,
    entities: list[str],
    windows: Mapping[str, int],
    method: str,
    history: DataFrame | None,
    within: Sequence[str],
    scale: int | None,
    limit: int,
    join_on: str,
    narrow: bool,
) -> DataFrame:
    """Features depend on time and entities alone, so rows equal in `__k` have equal ones.

    `__k` is a struct: it is never NULL as a whole, and NULL fields are equal in grouping and in the join, which share
    one partitioning.
    """
    parts = list(dict.fromkeys([join_on, TIME, *within, *entities]))
    keyed = df.withColumn("__k", F.struct(*parts))
    slim = keyed.select("__k", *dict.fromkeys([TIME, AMOUNT, *within, *entities]))
    past = None if history is None else history.select(*slim.columns[1:])
    chosen = _choose(slim, past, entities, within, method, limit)
    out = keyed
    together = [e for e in entities if chosen[e] != "chunked"]
    if together:
        out = out.join(_together(slim, past, together, within, windows, scale, method == "sliding"), "__k", "left")
    for entity in entities:
        if chosen[entity] == "chunked":
            names = [f"vel_{entity}_{label}_{stat}" for label in windows for stat in ("count", "sum")]
            hot = _chunked(slim, slim, past, [*within, entity], entity, windows, scale)
            out = out.join(hot.groupBy("__k").agg(*[F.max(c).alias(c) for c in names]), "__k", "left")
    return _last(out.withColumns(_means(entities, windows)).drop("__k"), entities, windows, narrow)


def _together(
    slim: DataFrame,
    past: DataFrame | None,
    entities: list[str],
    within: Sequence[str],
    windows: Mapping[str, int],
    scale: int | None,
    sliding: bool,
) -> DataFrame:
    """`__k` with counts and sums of all entities: one row per (row, entity), one exchange and sort for all of them."""

    def text(name: str) -> Column:
        zero_signed = slim.schema[name].dataType.typeName() in ("float", "double")
        return (F.col(name) + F.lit(0.0) if zero_signed else F.col(name)).cast("string")

    def unpivot(rows: DataFrame, key: Column) -> DataFrame:
        kinds = [F.struct(F.lit(i).alias("__kind"), text(e).alias("__value")) for i, e in enumerate(entities)]
        return rows.select(key.alias("__k"), TIME, _amount(scale).alias("__s"), *within, F.inline(F.array(*kinds)))

    long = unpivot(slim, F.col("__k"))
    if past is not None:
        long = long.unionByName(unpivot(past, F.lit(None).cast(slim.schema["__k"].dataType)))
    keys = [*within, "__kind", "__value"]
    stats, picks = [], []
    for label, width in windows.items():
        count, total = _stats(keys, lambda w: F.count("__s").over(w), width, sliding, scale)
        stats += [count.alias(f"__{label}_count"), total.alias(f"__{label}_sum")]
    for i, entity in enumerate(entities):
        for label in windows:
            for stat in ("count", "sum"):
                picks.append(F.max(F.when(F.col("__kind") == i, F.col(f"__{label}_{stat}"))).alias(f"vel_{entity}_{label}_{stat}"))
    return long.select("__k", "__kind", *stats).where("__k IS NOT NULL").groupBy("__k").agg(*picks)


def _choose(
    df: DataFrame, past: DataFrame | None, entities: list[str], within: Sequence[str], method: str, limit: int
) -> dict[str, str]:
    if method != "auto":
        return dict.fromkeys(entities, method)
    if not entities:
        return {}
    # one scan for all entities: counts per (within, entity) by grouping sets, then the largest of each set
    rows = df.select(*dict.fromkeys([*within, *entities]))
    if past is not None:
        rows = rows.unionByName(past.select(*rows.columns))
    counts = rows.groupingSets([[*within, e] for e in entities], *rows.columns).agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n")
    )
    largest = {r["set"]: r["n"] for r in counts.groupBy("set").agg(F.max("n").alias("n")).collect()}
    last = len(rows.columns) - 1
    full = (1 << (last + 1)) - 1
    bits = {c: 1 << (last - i) for i, c in enumerate(rows.columns)}
    size = {e: largest.get(full - sum(bits[c] for c in {*within, e}), 0) for e in entities}
    return {e: "chunked" if size[e] > limit else "prefix" for e in entities}


def _amount(scale: int | None) -> Column:
    """Amounts as summed: decimals, or whole units of the last decimal; NULL for what is no finite number."""
    value = F.col(AMOUNT).cast("double")
    if scale is None:
        return value.try_cast(f"decimal(28,{AMOUNT_DIGITS})")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return F.round(finite * (10**scale)).cast("long")


def _stats(
    keys: list[str], counted: Callable[[WindowSpec], Column], width: int, sliding: bool, scale: int | None
) -> tuple[Column, Column]:
    """Count and sum of `__s` over `[t - width, t)`; `counted` is the aggregate that counts amounts.

    Where the count is positive the growing sum is not NULL, so only the older part needs a default.
    """
    ordered, summed = W.partitionBy(*keys).orderBy(TIME), F.sum("__s")
    if sliding:
        frame = ordered.rangeBetween(-width, -1)
        count, total = counted(frame), summed.over(frame)
    else:
        now = ordered.rangeBetween(W.unboundedPreceding, -1)
        old = ordered.rangeBetween(W.unboundedPreceding, -width - 1)
        count = counted(now) - counted(old)
        total = summed.over(now) - F.coalesce(summed.over(old), F.lit(0))
    timed = F.col(TIME).isNotNull()
    total = F.when(timed & (count > 0), total).otherwise(F.lit(0))
    count = F.when(timed, count).otherwise(F.lit(0))
    return count, (total.cast("double") if scale is None else total / float(10**scale))


def _in_place(
    df: DataFrame,
    past: DataFrame | None,
    keys: list[str],
    entity: str,
    windows: Mapping[str, int],
    scale: int | None,
    sliding: bool,
) -> DataFrame:
    rows = df
    if past is not None:
        seen = past.withColumn("__own", F.lit(False))
        rows = df.withColumn("__own", F.lit(True)).unionByName(seen, allowMissingColumns=True)
    rows = rows.withColumn("__s", _amount(scale))
    added = []
    for label, width in windows.items():
        count, total = _stats(keys, lambda w: F.count("__s").over(w), width, sliding, scale)
        added += [count.alias(f"vel_{entity}_{label}_count"), total.alias(f"vel_{entity}_{label}_sum")]
    kept = [c for c in rows.columns if c != "__s"]
    out = rows.select(*kept, *added)
    return out if past is None else out.where("__own").drop("__own")


def _chunked(
    df: DataFrame,
    source: DataFrame,
    past: DataFrame | None,
    keys: list[str],
    entity: str,
    windows: Mapping[str, int],
    scale: int | None,
) -> DataFrame:
    """Joins the features to `df`. They are taken from `source`, the input before other entities were added."""
    needed = list(dict.fromkeys([*keys, TIME, AMOUNT]))
    rows = source.select(*needed)
    df = df.drop(*[f"vel_{entity}_{label}_{stat}" for label in windows for stat in ("count", "sum")])
    if past is not None:
        rows = rows.unionByName(past.select(*needed))
    seconds = rows.where(F.col(TIME).isNotNull()).groupBy(*keys, TIME).agg(F.count(_amount(scale)).alias("__n"), F.sum(_amount(scale)).alias("__s"))
    chunk = max(windows.values())
    placed = seconds.withColumn("__late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "__chunk", F.floor(F.col(TIME) / chunk) + F.col("__late")
    )
    added = []
    for label, width in windows.items():
        count, total = _stats([*keys, "__chunk"], lambda w: F.coalesce(F.sum("__n").over(w), F.lit(0)), width, False, scale)
        added += [count.alias(f"vel_{entity}_{label}_count"), total.alias(f"vel_{entity}_{label}_sum")]
    names = [f"vel_{entity}_{label}_{stat}" for label in windows for stat in ("count", "sum")]
    features = (
        placed.select(*keys, TIME, "__late", *added)
        .where("__late = 0")
        .select(*[F.col(c).alias(f"__r_{c}") for c in [*keys, TIME]], *names)
    )
    matches = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys] + [F.col(TIME) == F.col(f"__r_{TIME}")]
    joined = df.join(features, matches, "left").drop(*[f"__r_{c}" for c in [*keys, TIME]])
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
