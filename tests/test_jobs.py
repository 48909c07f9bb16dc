import pytest
from conftest import SF, same

from riskframe import fixtures
from riskframe.models.bayes import BayesConfig
from riskframe.models.trees import TrainerConfig
from riskframe.plans import jobs
from riskframe.plans.features import FeaturePipeline
from riskframe.sources import sinks


def test_from_csv_to_report(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    sinks.write_csv(fixtures.txn(spark, SF), at("txn"))
    sinks.write_csv(fixtures.identity(spark, SF), at("identity"))
    jobs.ingest(spark, at("txn"), at("identity"), at("raw"), narrow=True)
    jobs.build_feature_splits(spark, at("raw"), at("features"), plan_dir=at("plan"))
    splits = jobs.feature_splits(spark, at("features"), at("raw"))
    assert len([c for c in splits[2].columns if c.startswith("vel_")]) == 27

    quick = TrainerConfig(n_trials=1, n_estimators=2, max_depth_cap=3)
    metrics = jobs.train_trees(spark, splits, at("trees"), quick).first()
    assert 0 <= metrics["pr_auc"] <= 1
    summary = jobs.train_bayes(spark, splits, at("bayes"), BayesConfig(n_sample_max=500, min_fraud_in_sample=10))
    assert summary.count() == 16
    report = jobs.evaluate(spark, splits[2], at("trees"), at("bayes"), at("report")).first()
    assert report["evaluation_metadata"]["test_rows"] == splits[2].count()

    plan = FeaturePipeline.load(spark, at("plan"))
    raw = jobs.load_splits(spark, at("raw"))[2]
    names = ["TransactionID", "amt_zscore_card1", "card1_addr1_is_mode", "vel_card1_7d_count", "amt_to_addr1_mean_ratio"]
    same(plan.transform(raw).select(*names), splits[2].select(*names), "TransactionID")
    with pytest.raises(RuntimeError):
        FeaturePipeline().save(spark, at("none"))
