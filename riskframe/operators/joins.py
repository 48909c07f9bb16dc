"""Table joins and the size-checked lookup join used by all encoders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.schema import ID, require
from riskframe.session import materialize

BROADCAST_ROWS = 500_000
HOT_SHARE = 1_000  # a key is hot when it holds more than 1/1000 of the rows: at most 1000 such keys exist
TRACKED = 1 << 15  # keys that the summary of the probe side tracks at most
SALTS = 64
BROADCAST_BYTES = 64 << 20
VALUE_BYTES = 16  # of a value whose width is not measured


def merge_tables(transactions: DataFrame, identity: DataFrame, on: str = ID) -> DataFrame:
    """Left join: every transaction is kept, identity columns are NULL where absent."""
    require(transactions, [on], "merge_tables")
    require(identity, [on], "merge_tables")
    return transactions.join(identity, on, "left")


def enrichment_rate(transactions: DataFrame, identity: DataFrame, on: str = ID) -> DataFrame:
    """One row: identity rows whose key exists among the transactions, and their share of all transactions."""
    matched = identity.select(on).join(transactions.select(on), on, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    total = transactions.agg(F.count(F.lit(1)).alias("n_transactions"))
    return total.select(
        matched.scalar().alias("n_with_identity"),
        "n_transactions",
    ).withColumn("join_rate", F.col("n_with_identity") / F.nullif(F.col("n_transactions"), F.lit(0)))


@dataclass(frozen=True)
class Lookup:
    """A fitted table with one row per key. `rows` is its counted size, `weight` names its row-count column."""

    table: DataFrame
    keys: tuple[str, ...]
    rows: int
    weight: str | None = None
    text_bytes: int = 0  # measured total of its text columns

    def fits(self, limit: int) -> bool:
        """Whether it may be broadcast: few rows, and few bytes."""
        return self.rows <= limit and self.rows * len(self.table.columns) * VALUE_BYTES + self.text_bytes <= BROADCAST_BYTES

    @classmethod
    def build(cls, table: DataFrame, keys: Sequence[str], weight: str | None = None) -> Lookup:
        stored = materialize(table)
        texts = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in stored.schema.fields if f.dataType.typeName() == "string"]
        rows, *sizes = stored.agg(F.count(F.lit(1)), *texts).first()
        return cls(stored, tuple(keys), rows, weight, sum(sizes))

    def select(self, *columns: str | Column) -> Lookup:
        return replace(self, table=self.table.select(*columns))


def lookup_join(
    df: DataFrame, lookup: Lookup, values: Mapping[str, Column], spread_by: str = ID, broadcast_rows: int | None = None
) -> DataFrame:
    """Left-join `values` (output name -> expression over the lookup) to `df` by the lookup's keys.

    A counted-small lookup is broadcast. A larger one is shuffled; rows of keys that are hot in `df` and of NULL keys are
    spread over `SALTS` tasks by a hash of `spread_by` (of all columns where that one is absent), and only the lookup rows
    of hot keys are repeated to match. A stream has no counted keys and is joined without salts.
    """
    keys = list(lookup.keys)
    right_names = [f"__r_{k}" for k in keys]
    right = lookup.table.select(
        *[F.col(k).alias(r) for k, r in zip(keys, right_names)], *[expr.alias(name) for name, expr in values.items()]
    )
    on = [F.col(k) == F.col(r) for k, r in zip(keys, right_names)]
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    if lookup.fits(limit):
        return df.join(F.broadcast(right), on, "left").drop(*right_names)
    if df.isStreaming:
        return df.join(right, on, "left").drop(*right_names)

    # both sides in the types of the lookup's keys, so that equal keys have equal hashes
    types = [right.schema[r].dataType for r in right_names]
    code = F.xxhash64(*[F.col(k).cast(t) for k, t in zip(keys, types)])
    hot = F.lit(hot_codes(df.select(code.alias("__code"))) or [0]).cast("array<bigint>")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    told_by = [spread_by] if spread_by in df.columns else [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    spread = F.pmod(F.xxhash64(*told_by), F.lit(SALTS)).cast("int")
    left = df.withColumn("__s_l", F.when(missing | F.array_contains(hot, code), spread).otherwise(F.lit(0)))
    salts = F.when(F.array_contains(hot, F.xxhash64(*right_names)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = right.withColumn("__s_r", F.explode(salts))
    return left.join(salted, [*on, F.col("__s_l") == F.col("__s_r")], "left").drop("__s_l", "__s_r", *right_names)


def hot_codes(codes: DataFrame) -> list[int]:
    """Hashes that hold more than 1/HOT_SHARE of the rows of the one column `__code`; at most about HOT_SHARE of them.

    A mergeable summary of bounded size per task, so its cost does not depend on the number of keys. Its counts are off
    by a share of the rows below 1/TRACKED or so, which can only spread a key more or less than needed.
    """
    row = codes.agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(__code, {HOT_SHARE}, {TRACKED})").alias("top")
    ).first()
    return [r["item"] for r in row["top"] or [] if r["count"] * HOT_SHARE > row["n"]]
