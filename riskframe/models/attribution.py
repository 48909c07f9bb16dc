"""Per-row contributions of the linear model, and permutation importance of any scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.models.forest import INPUTS, Forest, average_precisions, matrix
from riskframe.models.trees import TreeScorer
from riskframe.operators.coding import Scaler
from riskframe.operators.metrics.ranking import average_precision, ranked_long
from riskframe.operators.ordering import SINGLE_TASK_ROWS
from riskframe.schema import ID, LABEL
from riskframe.session import materialize


def linear_contributions(
    df: DataFrame, scaler: Scaler, weights: Mapping[str, float], top_k: int = 3, keep: Sequence[str] = (ID,)
) -> DataFrame:
    """(keep.., rank, feature, contribution): the `top_k` largest |weight x standardised value| of each row.

    Sorting happens inside the row, so nothing is shuffled. Ties go to the alphabetically first feature.
    """
    items: list[Column] = []
    for name, value in zip(scaler.features, scaler.columns()):
        contribution = F.lit(float(weights[name])) * value
        items.append(
            F.struct((-F.abs(contribution)).alias("size"), F.lit(name).alias("feature"), contribution.alias("c"))
        )
    ranked = F.slice(F.array_sort(F.array(*items)), 1, top_k)
    rows = df.select(*keep, F.posexplode(ranked).alias("rank", "item"))
    return rows.select(
        *keep, (F.col("rank") + 1).alias("rank"), F.col("item.feature").alias("feature"), F.col("item.c").alias("contribution")
    )


def permuted_columns(
    df: DataFrame, columns: Sequence[str], id_col: str = ID, seed: int = 42, group_rows: int = SINGLE_TASK_ROWS, groups: int | None = None
) -> DataFrame:
    """Adds `perm_<c>`: each column moved by one place in a random order of the rows, the last row's to the first's.

    The order is that of a hash of the id, whatever the number of rows. It is cut into groups of a bounded expected size,
    so no task holds the table; the last row of a group takes the first of the next, so the groups leave no trace.
    """
    groups = max(1, groups or -(-df.count() // group_rows))
    at = F.xxhash64(F.col(id_col), F.lit(seed), F.lit(1))
    place = F.floor((at.cast("double") / 2.0**64 + 0.5) * groups)
    dealt = df.withColumns({"__at": at, "__group": F.least(place, F.lit(groups - 1))})
    values = F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(columns)])
    heads = dealt.groupBy("__group").agg(F.min_by(values, F.struct("__at", id_col)).alias("head"))
    by_group = W.orderBy("__group")
    after = F.coalesce(F.lead("head").over(by_group), F.first("head").over(by_group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    dealt = dealt.join(F.broadcast(heads.select("__group", after.alias("__after"))), "__group")
    order = W.partitionBy("__group").orderBy("__at", id_col)
    at_end = F.lead(F.lit(1)).over(order).isNull()
    moved = [
        F.when(at_end, F.col(f"__after.v{k}")).otherwise(F.lead(c).over(order)).alias(f"perm_{c}") for k, c in enumerate(columns)
    ]
    return dealt.select(*df.columns, *moved)


def permutation_importance(
    df: DataFrame,
    columns: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    label: str = LABEL,
    id_col: str = ID,
    seed: int = 42,
    groups: int | None = None,
) -> DataFrame:
    """(feature, pr_auc, drop): loss of PR-AUC when one column is permuted.

    `score` maps rows to a DataFrame with the label and `score`. All rescored copies are ranked together.
    """
    base = "__base"
    shuffled = materialize(permuted_columns(df, columns, id_col, seed, groups=groups))
    tagged = lambda rows, name: score(rows).select(
        F.lit(name).alias("model"), F.col("score"), F.col(label).cast("long").alias("y")
    )
    runs = tagged(df, base)
    for c in columns:
        runs = runs.unionByName(tagged(shuffled.withColumn(c, F.col(f"perm_{c}")), c))
    values = average_precision(ranked_long(runs))
    reference = values.where(F.col("model") == base).select("pr_auc").scalar()
    return values.where(F.col("model") != base).select(
        F.col("model").alias("feature"), "pr_auc", (reference - F.col("pr_auc")).alias("drop")
    )


def permuted_scores(
    forest: Forest, x: np.ndarray, other: np.ndarray, names: Sequence[str], base: str
) -> Iterator[tuple[str, np.ndarray]]:
    """(name, probabilities) of the rows as they are, named `base`, and with each input taken from `other`.

    Trees that do not split by the input are not followed again. `x` is written to and restored.
    """
    parts, users = forest.parts(x), forest.users()
    unmoved = forest.combined(parts)
    yield base, unmoved
    for k, name in enumerate(names):
        if k not in users:
            yield name, unmoved
            continue
        held, moved = x[:, k].copy(), parts.copy()
        x[:, k] = other[:, k]
        moved[:, users[k]] = forest.parts(x, users[k])
        yield name, forest.combined(moved)
        x[:, k] = held


def forest_importance(
    df: DataFrame, scorer: TreeScorer, label: str = LABEL, id_col: str = ID, seed: int = 42, groups: int | None = None
) -> DataFrame:
    """`permutation_importance` of the inputs of a tree scorer, in one pass over the rows.

    Each row carries its inputs twice, as they are and permuted; a task holds the trees as arrays, exchanges one input at
    a time, follows only the trees that split by it and adds up equal scores before they are shuffled.
    """
    columns, base = scorer.feature_names_, "__base"
    names = [f"i{k}" for k in range(len(columns))]
    inputs = scorer._inputs(df, [id_col, label])
    rows = inputs.select(id_col, label, *[F.col(INPUTS)[k].alias(c) for k, c in enumerate(names)])
    moved = permuted_columns(rows, names, id_col, seed, groups=groups)
    both = moved.select(label, F.array(*names).alias(INPUTS), F.array(*[f"perm_{c}" for c in names]).alias("__moved"))
    shared = df.sparkSession.sparkContext.broadcast(scorer._fitted())

    def scores(x, batch):
        return permuted_scores(shared.value, x.copy(), matrix(batch.column(2)), columns, base)

    values = materialize(average_precisions(both, label, scores, "string"))
    reference = values.where(F.col("model") == base).select("pr_auc").scalar()
    return values.where(F.col("model") != base).select(
        F.col("model").alias("feature"), "pr_auc", (reference - F.col("pr_auc")).alias("drop")
    )
