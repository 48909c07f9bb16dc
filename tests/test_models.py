import numpy as np
import pytest
from conftest import SF, rows, same
from pyspark.sql import functions as F

from riskframe import fixtures
from riskframe.models import attribution, bayes, pca, trees
from riskframe.operators import coding
from riskframe.plans.catalog import BAYES_INPUTS, TREE_INPUTS, model_rows, part
from riskframe.plans.evaluation import EvaluatorConfig, FraudEvaluator, score_both


@pytest.fixture(scope="module")
def data(spark):
    return model_rows(spark, SF, [*TREE_INPUTS, *BAYES_INPUTS])


@pytest.fixture(scope="module")
def logit(data):
    return bayes.BayesLogit(bayes.BayesConfig(features=list(BAYES_INPUTS), n_sample_max=None)).fit(data)


@pytest.fixture(scope="module")
def scorer(data):
    rows_ = data.select("TransactionID", "isFraud", "split", *TREE_INPUTS)
    fitted = trees.TreeScorer(trees.TrainerConfig(n_estimators=4, n_trials=2, max_depth_cap=4))
    fitted.train_final(part(rows_, "train"), part(rows_, "val"), params=trees.TreeParams(max_depth=3, max_iter=4))
    return fitted


def test_newton_sums_match_numpy(spark, data, logit):
    """Gradient of the log-posterior vanishes at the fitted mode."""
    local = data.select("isFraud", *BAYES_INPUTS).toPandas().fillna(0.0)
    x = local[BAYES_INPUTS].to_numpy(float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    x = np.hstack([np.ones((len(x), 1)), x])
    y = local["isFraud"].to_numpy(float)
    scaled = logit.scaler_.transform(data, keep=["isFraud"])
    fit = bayes.posterior_mode(scaled, BAYES_INPUTS, "isFraud", logit.config)
    theta, curvature = fit.mode, fit.curvature
    assert fit.gradient_norm < 1e-4 and logit.gradient_norm_ < 1e-4
    p = 1 / (1 + np.exp(-x @ theta))
    precision = np.array([0.25] + [1.0] * len(BAYES_INPUTS))
    assert np.abs(x.T @ (y - p) - precision * theta).max() < 1e-4
    assert curvature == pytest.approx(((x * x).T @ (p * (1 - p))) + precision, rel=1e-6)
    sd = np.array([r["sd"] for r in rows(logit.get_coefficient_summary(spark), "feature") if r["feature"] == "intercept"])
    assert sd[0] == pytest.approx(1 / np.sqrt(curvature[0]), rel=0.1)


def test_block_sums_equal_the_declared_sums(data, logit):
    scaled = logit.scaler_.transform(data, keep=["isFraud"])
    theta = np.linspace(-1, 1, len(BAYES_INPUTS) + 1)
    sums = bayes.newton_blocks(scaled, BAYES_INPUTS, theta)
    gradient, curvature = sums.gradient, sums.curvature
    row = bayes.newton_sums(scaled, BAYES_INPUTS, theta.tolist()).first()
    assert gradient == pytest.approx([row[f"g{i}"] for i in range(len(theta))])
    assert curvature[1, 3] == pytest.approx(row["h1_3"]) and curvature[3, 1] == pytest.approx(row["h1_3"])


def test_text_features_are_coded_by_the_fitted_rows(spark, txn, tmp_path):
    model = bayes.BayesLogit(bayes.BayesConfig(features=["TransactionAmt", "ProductCD"], n_sample_max=None)).fit(txn)
    model.save(spark, str(tmp_path))
    new = txn.limit(50).withColumn("ProductCD", F.when(F.col("TransactionID") % 2 == 0, F.col("ProductCD")))
    out = model.predict(new, keep=["TransactionID", "ProductCD"])
    assert out.count() == 50 and sorted(map(str, out.select("TransactionID", "ProductCD").collect())) == sorted(
        map(str, new.select("TransactionID", "ProductCD").collect())
    )
    same(bayes.BayesLogit.load(spark, str(tmp_path)).predict(new), model.predict(new), "TransactionID")


def test_a_step_that_overshoots_is_halved(spark):
    """Newton's full step from zero lowers the log-posterior here."""
    df = spark.range(4000).selectExpr("CAST(id % 2000 = 0 AS INT) AS isFraud", "CAST(IF(id % 400 = 0, 60, 0) AS DOUBLE) AS x")
    fit = bayes.posterior_mode(df, ["x"], "isFraud", bayes.BayesConfig(prior_beta_sigma=50.0, prior_alpha_sigma=50.0))
    assert fit.gradient_norm < 1e-4


def test_both_posterior_paths_agree(spark, data, logit):
    """Array expressions and NumPy blocks over the same draws."""
    size = 40
    logit.config.n_prediction_samples = size
    blocks = logit.predict(data, label_col=None)
    chosen = np.random.default_rng(logit.config.random_seed).choice(len(logit.alpha_), size=size, replace=False)
    draws = [(logit.alpha_[i], logit.beta_[i].tolist()) for i in chosen]
    exact = bayes.summarise_draws(data, logit.scaler_.columns(), bayes.draw_column(draws), ["TransactionID"], size)
    same(blocks, exact, "TransactionID", tolerance=1e-3)
    logit.config.n_prediction_samples = 500


def test_intervals_are_ordered(data, logit):
    out = logit.predict(data)
    assert out.where("hdi_lower > mean_proba OR hdi_upper < mean_proba OR uncertainty < 0").count() == 0
    assert out.columns == ["TransactionID", "true_label", "mean_proba", "uncertainty", "hdi_lower", "hdi_upper"]


def test_unfitted_models_raise(spark, data):
    with pytest.raises(RuntimeError):
        bayes.BayesLogit().predict(data)
    with pytest.raises(RuntimeError):
        trees.TreeScorer().predict_proba(data)
    with pytest.raises(RuntimeError):
        trees.TreeScorer().train_final(data, data)
    with pytest.raises(ValueError):
        bayes.BayesLogit().fit(spark.range(3).withColumn("isFraud", F.lit(0)))


def test_search_keeps_the_best_trial(data):
    rows_ = data.select("TransactionID", "isFraud", "split", "TransactionAmt", "hour_of_day")
    search = trees.TreeScorer(trees.TrainerConfig(n_estimators=2, n_trials=2, max_depth_cap=4))
    table = rows(search.tune(part(rows_, "train"), part(rows_, "val")), "trial")
    assert len(table) == 2
    best = max(table, key=lambda t: t["pr_auc"])
    assert search.best_params_.step_size == best["step_size"]


def test_save_and_load(spark, data, scorer, logit, tmp_path):
    scorer.save(spark, str(tmp_path / "trees"))
    logit.save(spark, str(tmp_path / "bayes"))
    again = trees.TreeScorer.load(spark, str(tmp_path / "trees"))
    same(again.predict_proba(data), scorer.predict_proba(data), "TransactionID")
    assert again.best_params_ == scorer.best_params_
    same(bayes.BayesLogit.load(spark, str(tmp_path / "bayes")).predict(data), logit.predict(data), "TransactionID")


def test_unseen_categories_share_one_score(data, scorer):
    """Values that the training rows do not hold are one category, whatever they are."""
    odd = lambda v: scorer.predict_proba(data.withColumn("ProductCD", F.lit(v)))
    same(odd("never seen"), odd("nor this"), "TransactionID")
    place = scorer.feature_names_.index("ProductCD")
    codes = scorer._inputs(data.withColumn("ProductCD", F.lit("never seen")), ["TransactionID"]).select(F.col("__x")[place].alias("c")).distinct().collect()
    assert [r["c"] for r in codes] == [data.where("split = 'train'").select("ProductCD").distinct().count()]


def test_full_report(spark, data, scorer, logit, tmp_path):
    scored = score_both(part(data, "test"), scorer, logit)
    row = FraudEvaluator(scored).run(str(tmp_path / "report")).first()
    assert row["evaluation_metadata"]["test_rows"] == part(data, "test").count()
    assert {m["model"] for m in row["models"]} == {"trees", "bayes"}
    assert len(row["fn_recovery"]["table"]) == 6
    stored = spark.read.json(str(tmp_path / "report")).first()
    assert stored["disagreement_analysis"]["n_disagreements"] == row["disagreement_analysis"]["n_disagreements"]


def test_settings_of_the_evaluator_are_read(spark, txn):
    made = fixtures.scored(spark, SF)
    low = FraudEvaluator(made, EvaluatorConfig(decision_threshold=0.1)).analyze_disagreement().first()
    high = FraudEvaluator(made, EvaluatorConfig(decision_threshold=0.5)).analyze_disagreement().first()
    assert low["accuracy_a"] != high["accuracy_a"]
    queue = FraudEvaluator(made).analyze_fn_recovery()[1].first()
    assert queue["fn_recovery_pct"] == round(queue["fn_recovery_pct"], 2)


def test_importances(spark, scorer):
    table = rows(scorer.get_feature_importance(spark), "rank")
    assert sum(r["importance_pct"] for r in table) == pytest.approx(100.0, abs=0.1)


def test_contributions_add_up(spark, txn):
    names = ["TransactionAmt", "addr1", "addr2"]
    scaler = coding.Scaler.fit(txn, names)
    weights = dict(zip(names, (0.8, -0.3, 0.45)))
    parts = attribution.linear_contributions(txn, scaler, weights, top_k=3)
    total = parts.groupBy("TransactionID").agg(F.sum("contribution").alias("t"))
    linear = scaler.transform(txn, keep=["TransactionID"]).select(
        "TransactionID", sum(F.col(n) * w for n, w in weights.items()).alias("t")
    )
    same(total, linear, "TransactionID")


@pytest.mark.parametrize("group_rows", [10**6, 100])
def test_permutation_keeps_the_values(txn, group_rows):
    moved = attribution.permuted_columns(txn, ["TransactionAmt"], group_rows=group_rows)
    assert moved.count() == txn.count()
    sums = moved.agg(F.sum("TransactionAmt"), F.sum("perm_TransactionAmt")).first()
    assert sums[0] == pytest.approx(sums[1])
    assert moved.where("TransactionAmt = perm_TransactionAmt").count() < 0.2 * txn.count()


def test_useless_feature_has_no_importance(data, scorer):
    score = lambda df: scorer.predict_proba(df, keep=["isFraud"])
    rows_ = data.withColumn("noise", F.rand(1))
    table = attribution.permutation_importance(rows_, ["noise"], score)
    assert table.first()["drop"] == pytest.approx(0.0)


def test_pca_explains_a_line(spark):
    df = spark.range(200).select(
        F.col("id").alias("TransactionID"), F.lit(0).alias("isFraud"),
        F.col("id").cast("double").alias("V1"), (F.col("id") * 2.0).alias("V2"),
        F.when(F.col("id") % 50 != 0, F.col("id") * -1.0).alias("V3"),
    )
    result = pca.pca_block(df)
    assert result.explained[0] > 0.95 and result.projected.count() == 200


def test_fixture_identity_is_a_quarter(spark):
    assert fixtures.identity(spark, SF).count() * 4 == fixtures.txn(spark, SF).count()
