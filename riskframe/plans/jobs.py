"""The batch jobs, each from stored tables to stored tables: ingest, features, training, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from riskframe.models.bayes import BayesConfig, BayesLogit
from riskframe.models.trees import TrainerConfig, TreeScorer
from riskframe.operators.split import SplitConfig, time_aware_split
from riskframe.plans.evaluation import FraudEvaluator, score_both
from riskframe.plans.features import FeaturePipeline, PipelineConfig
from riskframe.schema import ID, LABEL
from riskframe.session import materialize
from riskframe.sources.tables import load_and_merge, load_feature_splits, load_splits, save_splits

Splits = tuple[DataFrame, DataFrame, DataFrame]


def ingest(
    spark: SparkSession,
    txn_path: str,
    identity_path: str,
    out_dir: str,
    config: SplitConfig = SplitConfig(),
    narrow: bool = False,
) -> dict[str, str]:
    """CSV tables to merged, time-split Parquet. The merged table is written once before it is split."""
    merged = materialize(load_and_merge(spark, txn_path, identity_path, narrow))
    return save_splits(*time_aware_split(merged, config), out_dir)


def build_feature_splits(
    spark: SparkSession, raw_dir: str, out_dir: str, config: PipelineConfig | None = None, plan_dir: str | None = None
) -> dict[str, str]:
    """Raw splits to enriched splits; the fitted plan is kept where `plan_dir` says."""
    plan = FeaturePipeline(config)
    enriched = plan.fit_transform_splits(*load_splits(spark, raw_dir))
    if plan_dir is not None:
        plan.save(spark, plan_dir)
    return save_splits(*enriched, out_dir)


def feature_splits(
    spark: SparkSession, feature_dir: str, raw_dir: str, config: PipelineConfig | None = None
) -> Splits:
    """Stored enriched splits, or the raw ones run through the plan."""
    return load_feature_splits(spark, feature_dir, raw_dir, FeaturePipeline(config).fit_transform_splits)


def train_trees(
    spark: SparkSession,
    splits: Splits,
    out_dir: str,
    config: TrainerConfig | None = None,
    label: str = LABEL,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Search, final fit, artefacts under `out_dir`; returns the metrics of the test split."""
    train, val, test = splits
    scorer = TreeScorer(config).fit(train, val, label, drop)
    scorer.save(spark, out_dir)
    return scorer.evaluate(test, label)


def train_bayes(
    spark: SparkSession, splits: Splits, out_dir: str, config: BayesConfig | None = None, label: str = LABEL
) -> DataFrame:
    """Posterior fit and artefacts under `out_dir`; returns the coefficient summary."""
    model = BayesLogit(config).fit(splits[0], label)
    model.save(spark, out_dir)
    return model.get_coefficient_summary(spark)


def evaluate(
    spark: SparkSession,
    test: DataFrame,
    trees_dir: str,
    bayes_dir: str,
    report_path: str,
    keep: Sequence[str] = (ID,),
    label: str = LABEL,
) -> DataFrame:
    """Scores the test split with both stored models and writes the report."""
    scored = score_both(test, TreeScorer.load(spark, trees_dir), BayesLogit.load(spark, bayes_dir), keep, label)
    return FraudEvaluator(scored).run(report_path)
