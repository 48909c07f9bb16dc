"""Leakage-safe encoders: fitted on the training rows only, applied to any rows by a lookup join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.operators.joins import Lookup, lookup_join
from riskframe.schema import AMOUNT, nan_to_null, present, require
from riskframe.session import materialize

# Default encoder columns.
AMOUNT_ENTITIES = ["card1", "addr1", "P_emaildomain"]
ADDRESS_ENTITY = "card1"
ADDRESS_COLS = ["addr1", "addr2"]


@dataclass(frozen=True)
class AmountEncoders:
    """Per-entity mean and sample deviation of the amount, and the global pair for unseen entities."""

    tables: dict[str, Lookup]
    global_mean: float
    global_std: float

    def keys(self) -> list[str]:
        return [f"{e}_{s}" for e in self.tables for s in ("mean", "std")] + ["_global_mean", "_global_std"]

    def __contains__(self, key: str) -> bool:
        return key in self.keys()

    def save(self, path: str) -> None:
        for entity, lookup in self.tables.items():
            lookup.table.write.mode("overwrite").parquet(f"{path}/{entity}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, entities: Sequence[str], mean: float, std: float) -> AmountEncoders:
        stored = {e: spark.read.parquet(f"{path}/{e}") for e in entities}
        return cls({e: Lookup(t, (e,), t.count(), "n") for e, t in stored.items()}, mean, std)


def amount_statistics(train: DataFrame, entity_cols: Sequence[str]) -> DataFrame:
    """One pass over the training rows for all entities and the global pair, by grouping sets.

    `level` is the entity's name, or NULL for the global row; the NULL entity itself is dropped.
    """
    amount = F.col(AMOUNT).cast("double")
    # grouping_id has one bit per column, set where the column is aggregated away
    full = (1 << len(entity_cols)) - 1
    code = F.grouping_id()
    stats = train.groupingSets([[e] for e in entity_cols] + [[]], *entity_cols).agg(
        code.alias("code"),
        F.count(amount).alias("n"),
        F.avg(amount).alias("mean"),
        F.stddev_samp(amount).alias("std"),
    )
    level: Column = F.lit(None).cast("string")
    keep = F.col("code") == full
    for i, entity in enumerate(entity_cols):
        here = F.col("code") == full - (1 << (len(entity_cols) - 1 - i))
        level = F.when(here, entity).otherwise(level)
        keep = keep | (here & F.col(entity).isNotNull())
    return stats.where(keep).select(level.alias("level"), *entity_cols, "n", "mean", "std")


def entity_statistics(stats: DataFrame, entity: str) -> DataFrame:
    """The (entity, n, mean, std) rows of one entity; a single observation has deviation 0."""
    return stats.where(F.col("level") == entity).select(
        entity, "n", F.col("mean").alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std")
    )


def fit_amount_encoders(train: DataFrame, entity_cols: Sequence[str] = AMOUNT_ENTITIES) -> AmountEncoders:
    require(train, [AMOUNT], "fit_amount_encoders")
    entities = present(train, entity_cols, "fit_amount_encoders")
    train = nan_to_null(train.select(AMOUNT, *entities))
    if entities:
        stats = materialize(amount_statistics(train.select(AMOUNT, *entities), entities))
        sizes = {r["level"]: r["count"] for r in stats.groupBy("level").count().collect()}  # one row per entity
        overall = stats.where(F.col("level").isNull()).first()
    else:
        stats, sizes = None, {}
        overall = train.agg(F.avg(AMOUNT).alias("mean"), F.stddev_samp(AMOUNT).alias("std")).first()
    tables = {e: Lookup(entity_statistics(stats, e), (e,), sizes.get(e, 0), "n") for e in entities}
    return AmountEncoders(tables, overall["mean"], overall["std"])


def compute_spend_spike_features(
    df: DataFrame, encoders: AmountEncoders, entity_cols: Sequence[str] = AMOUNT_ENTITIES, narrow: bool = False
) -> DataFrame:
    """Adds `amt_to_<e>_mean_ratio` and `amt_zscore_<e>`; unseen entities use the global pair."""
    require(df, [AMOUNT], "spend_spike")
    amount = F.col(AMOUNT).cast("double")
    fallback = {"mean": F.lit(encoders.global_mean).cast("double"), "std": F.lit(encoders.global_std).cast("double")}
    out = df
    for entity in present(df, entity_cols, "spend_spike"):
        if entity in encoders.tables:
            wanted = {"__mean": F.col("mean"), "__std": F.col("std")}
            out = lookup_join(out, encoders.tables[entity], wanted)
        else:
            out = out.withColumns({"__mean": F.lit(None).cast("double"), "__std": F.lit(None).cast("double")})
        mean = F.coalesce("__mean", fallback["mean"])
        std = F.coalesce("__std", fallback["std"])
        ratio, score = C.mean_ratio(amount, mean), C.zscore(amount, mean, std)
        if narrow:
            ratio, score = ratio.cast("float"), score.cast("float")
        out = out.withColumns({f"amt_to_{entity}_mean_ratio": ratio, f"amt_zscore_{entity}": score})
        out = out.drop("__mean", "__std")
    return out


@dataclass(frozen=True)
class AddressEncoders:
    """Per-entity mode and distinct count of each address column, in one lookup table."""

    table: Lookup | None
    entity_col: str
    addr_cols: tuple[str, ...] = field(default=())

    def keys(self) -> list[str]:
        return [f"{self.entity_col}_{a}_{s}" for a in self.addr_cols for s in ("mode", "n_unique")]

    def __contains__(self, key: str) -> bool:
        return key in self.keys()


def address_statistics(train: DataFrame, entity_col: str, addr_cols: Sequence[str]) -> DataFrame:
    """Mode (ties: smallest) and distinct count per entity, nulls ignored.

    Two levels: first counts per (entity, address), which combines before the shuffle, then one small
    struct per entity. No task ever holds all the rows or all the values of an entity.
    """
    typed = {a: train.schema[a].dataType for a in addr_cols}

    def only(index: int, name: str) -> Column:
        own = [F.col(a) if a == name else F.lit(None).cast(typed[a]) for a in addr_cols]
        return F.struct(F.lit(index).alias("which"), *[v.alias(f"v{i}") for i, v in enumerate(own)])

    long = train.where(F.col(entity_col).isNotNull()).select(
        entity_col, F.inline(F.array(*[only(i, a) for i, a in enumerate(addr_cols)]))
    )
    values = [f"v{i}" for i in range(len(addr_cols))]
    counted = long.groupBy(entity_col, "which", *values).agg(F.count(F.lit(1)).alias("n"))
    aggs = [F.sum(F.when(F.col("which") == 0, F.col("n"))).alias("n")]
    for i, addr in enumerate(addr_cols):
        value = F.col(f"v{i}")
        best = F.min(F.when(value.isNotNull(), F.struct((-F.col("n")).alias("rank"), value.alias("value"))))
        aggs += [best.getField("value").alias(f"{addr}_mode"), F.count(value).alias(f"{addr}_n_unique")]
    return counted.groupBy(entity_col).agg(*aggs)


def fit_address_encoders(
    train: DataFrame, entity_col: str = ADDRESS_ENTITY, addr_cols: Sequence[str] = ADDRESS_COLS
) -> AddressEncoders:
    if not present(train, [entity_col], "fit_address_encoders"):
        return AddressEncoders(None, entity_col)
    cols = present(train, addr_cols, "fit_address_encoders")
    if not cols:
        return AddressEncoders(None, entity_col)
    return AddressEncoders(
        Lookup.build(address_statistics(train, entity_col, cols), [entity_col], "n"), entity_col, tuple(cols)
    )


def compute_address_features(
    df: DataFrame,
    encoders: AddressEncoders,
    entity_col: str = ADDRESS_ENTITY,
    addr_cols: Sequence[str] = ADDRESS_COLS,
) -> DataFrame:
    """Adds `<entity>_<addr>_is_mode` and `<entity>_<addr>_n_unique`.

    A missing address or unseen entity is never the mode. Unseen entities count 1 distinct address, known
    entities without any address count 0.
    """
    if not present(df, [entity_col], "address") or encoders.table is None:
        return df
    cols = [a for a in addr_cols if a in encoders.addr_cols]
    wanted = {f"__{s}_{a}": F.col(f"{a}_{s}") for a in cols for s in ("mode", "n_unique")}
    joined = lookup_join(df, encoders.table, wanted)
    added = {}
    for addr in cols:
        same = C.both_equal(F.col(addr), F.col(f"__mode_{addr}")) if addr in df.columns else F.lit(0)
        added[f"{entity_col}_{addr}_is_mode"] = same
        added[f"{entity_col}_{addr}_n_unique"] = F.coalesce(f"__n_unique_{addr}", F.lit(1)).cast("int")
    return joined.withColumns(added).drop(*wanted)
