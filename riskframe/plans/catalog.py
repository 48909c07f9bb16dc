"""Registered queries: one callable per operator, each over whole tables of the given folder.

Float results are rounded to `DIGITS` decimals here, never in the operators themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import fixtures as fx
from riskframe.functions import columns as C
from riskframe.models import attribution, bayes, pca, trees
from riskframe.operators import blocks, coding, encoders, joins, profile, sampling, split, velocity
from riskframe.operators.metrics import calibration, ranking, report, uncertainty
from riskframe.plans.evaluation import EvaluatorConfig, FraudEvaluator, report_lines, score_both
from riskframe.plans.features import FeaturePipeline, PipelineConfig
from riskframe.session import materialize, new_folder
from riskframe.sources import narrowing, sinks, tables
from riskframe.streaming import jobs, state

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 9
MODELS = {"trees": "score_a", "bayes": "score_b"}
CENTS = 2  # decimals of the test amounts


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floats to a fixed number of decimals, so that two engines can be compared.

    Velocity columns are exact (integer sums, one division) and stay as they are.
    """
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and not f.name.startswith("vel_")
    ]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in floats}) if floats else df


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return joins.merge_tables(fx.txn(spark, sf), fx.identity(spark, sf))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return split.assign_split(fx.txn(spark, sf))


def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(spark, sf).where("split = 'train'").drop("split")


# --- sources and sinks -------------------------------------------------------------------------------


def s1_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    # as written from a table with gaps: whole numbers carry a decimal
    gappy = fx.txn(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("card1", "addr1", "addr2")})
    sinks.write_csv(gappy, f"{folder}/transactions")
    sinks.write_csv(fx.identity(spark, sf), f"{folder}/identity")
    both = tables.load_and_merge(spark, f"{folder}/transactions", f"{folder}/identity")
    return rounded(both)


def s3_split_sink(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "splits")
    rows = tagged(spark, sf)
    parts = [rows.where(F.col("split") == name).drop("split") for name in split.SPLITS]
    tables.save_splits(*parts, folder)
    loaded = tables.load_splits(spark, folder)
    out = None
    for name, part in zip(split.SPLITS, loaded):
        part = part.select(F.lit(name).alias("split"), "TransactionID", "TransactionDT", "TransactionAmt")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def s7_report_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{new_folder(spark, 'report')}/metrics"
    sinks.write_report(report.metrics_matrix(fx.scored(spark, sf), MODELS, rounded=False), path)
    return rounded(sinks.read_report(spark, path).select("model", "pr_auc", "roc_auc", "brier_score"))


def s8_artefact_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{new_folder(spark, 'artefact')}/importance"
    sinks.write_artefact(w11_importance_rank(spark, sf), path)
    return spark.read.csv(path, header=True, schema="ProductCD string, total double, rank int, importance_pct double")


def s9_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(narrowing.narrowing_plan(merged(spark, sf)))


# --- projections and filters -------------------------------------------------------------------------


def p1_exclude_columns(spark: SparkSession, sf: str) -> DataFrame:
    return coding.split_xy(merged(spark, sf))[0]


def p4_align_schema(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["TransactionAmt", "card1", "addr1", "V1", "id_02"]
    return coding.align_columns(merged(spark, sf), wanted, keep=["TransactionID"])


def p7_mask_filters(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.scored(spark, sf)
    routed = uncertainty.route_decisions(rows)
    apart = F.abs(F.col("score_a") - F.col("score_b")) > uncertainty.DISAGREEMENT
    return routed.groupBy("y").agg(
        F.count(F.lit(1)).alias("n_class"),
        F.sum((F.col("decision") == "review").cast("long")).alias("n_queue"),
        F.sum(apart.cast("long")).alias("n_apart"),
    )


# --- joins -------------------------------------------------------------------------------------------


def j1_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf)


def j2_enrichment_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.enrichment_rate(fx.txn(spark, sf), fx.identity(spark, sf)))


def j3_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    fitted = encoders.fit_amount_encoders(train_rows(spark, sf), ["card1"])
    got = joins.lookup_join(
        fx.txn(spark, sf), fitted.tables["card1"], {"card1_mean": F.col("mean"), "card1_std": F.col("std")}
    )
    out = got.select(
        "TransactionID",
        F.coalesce("card1_mean", F.lit(fitted.global_mean)).alias("card1_mean"),
        F.coalesce("card1_std", F.lit(fitted.global_std)).alias("card1_std"),
    )
    return rounded(out)


# --- aggregations ------------------------------------------------------------------------------------


def a1_split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(split.split_summary(tagged(spark, sf)))


def a2_entity_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    stats = encoders.amount_statistics(fx.txn(spark, sf), ["addr1"])
    return rounded(encoders.entity_statistics(stats, "addr1"))


def a3_global_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    stats = encoders.amount_statistics(train_rows(spark, sf), ["card1"])
    return rounded(stats.where("level IS NULL").select("n", "mean", "std"))


def a4_entity_mode(spark: SparkSession, sf: str) -> DataFrame:
    stats = encoders.address_statistics(fx.txn(spark, sf), "card1", ["addr1", "addr2"])
    return stats.select("card1", "addr1_mode", "addr2_mode")


def a5_entity_distinct(spark: SparkSession, sf: str) -> DataFrame:
    stats = encoders.address_statistics(fx.txn(spark, sf), "card1", ["addr1", "addr2"])
    return stats.select("card1", "addr1_n_unique", "addr2_n_unique")


def a6_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.class_balance(fx.txn(spark, sf)))


def a7_null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.null_profile(merged(spark, sf)))


def a7_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_counts(merged(spark, sf))


def a8_family_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.family_null_profile(merged(spark, sf)))


def a9_missingness_label(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.missingness_vs_label(merged(spark, sf)))


def a10_time_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.time_buckets(fx.txn(spark, sf)))


def a11_hour_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.hour_profile(fx.txn(spark, sf)))


def a11_peak_hour(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.peak_hour(fx.txn(spark, sf)))


def a12_day_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.day_profile(fx.txn(spark, sf)))


def a13_class_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.class_amounts(fx.txn(spark, sf)), 6)


def a14_log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.log_histogram(fx.txn(spark, sf)))


def a15_box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.box_stats(fx.txn_orders(spark, sf), clip_at=200_000.0), 6)


def a16_identity_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.identity_coverage(merged(spark, sf)))


def a17_describe_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.describe_by_class(fx.scored(spark, sf), "score_b"))


def a18_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.dataset_summary(merged(spark, sf)))


# --- windows -----------------------------------------------------------------------------------------


def _velocity(spark: SparkSession, sf: str, entity: str, stat: str, **options) -> DataFrame:
    out = velocity.compute_velocity_features(fx.txn(spark, sf), [entity], amount_scale=CENTS, **options)
    return out.select("TransactionID", *[c for c in out.columns if c.startswith("vel_") and c.endswith(stat)])


def w1_rolling_count(spark: SparkSession, sf: str) -> DataFrame:
    return _velocity(spark, sf, "card1", "_count")


def w2_rolling_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _velocity(spark, sf, "card1", "_sum")


def w3_rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _velocity(spark, sf, "card1", "_mean_amt")


def w4_velocity_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = velocity.compute_velocity_features(fx.txn(spark, sf), amount_scale=CENTS)
    return out.select("TransactionID", *velocity.expected_feature_names())


def w4_velocity_default(spark: SparkSession, sf: str) -> DataFrame:
    """Default settings on amounts with three decimals: sums are exact without being told the scale."""
    rows = fx.txn(spark, sf).withColumn("TransactionAmt", (F.col("TransactionID") * 7919 % 1000003) / 1000.0)
    out = velocity.compute_velocity_features(rows, ["card1", "addr1"])
    return out.select("TransactionID", *velocity.expected_feature_names(["card1", "addr1"]))


def w4_velocity_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Day-resolution times: many rows share a second and must not see each other."""
    entities = ["card1", "addr1", "addr2"]
    out = velocity.compute_velocity_features(fx.txn_orders(spark, sf), entities, amount_scale=CENTS)
    return out.select("TransactionID", *velocity.expected_feature_names(entities))


def w4_velocity_bulk(spark: SparkSession, sf: str) -> DataFrame:
    """The largest table; one entity holds a third of the rows, another has as many values as suppliers."""
    entities = ["card1", "addr1", "addr2"]
    out = velocity.compute_velocity_features(fx.txn_lineitem(spark, sf), entities, amount_scale=CENTS)
    return out.select("TransactionID", *velocity.expected_feature_names(entities))


def w6_null_entity(spark: SparkSession, sf: str) -> DataFrame:
    out = velocity.compute_velocity_features(fx.txn(spark, sf), ["addr1"], amount_scale=CENTS)
    nulls = out.where("addr1 IS NULL")
    return nulls.select("TransactionID", *velocity.expected_feature_names(["addr1"]))


def w7_score_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranked_scores(fx.scored(spark, sf), MODELS)


def w8_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    buckets = profile.time_buckets(fx.txn(spark, sf))
    return rounded(profile.centred_moving_average(buckets).select("bin", "fraud_rate_ma"))


def w9_empirical_cdf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(uncertainty.empirical_cdf(fx.scored(spark, sf)))


def w10_bin_step(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.median_bin_step(profile.time_buckets(fx.txn(spark, sf))))


def w11_importance_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks product codes by spend; the operator is the one used for feature importances."""
    spend = fx.txn(spark, sf).groupBy("ProductCD").agg(F.round(F.sum("TransactionAmt"), 2).alias("total"))
    return profile.rank_by(spend, "ProductCD", "total", 50)


def wx1_velocity_history(spark: SparkSession, sf: str) -> DataFrame:
    """Validation and test rows see the training rows before them."""
    rows = tagged(spark, sf)
    past, later = rows.where("split = 'train'"), rows.where("split <> 'train'")
    out = velocity.compute_velocity_features(later, ["card1"], history=past, amount_scale=CENTS)
    return out.select("TransactionID", *velocity.expected_feature_names(["card1"]))


def wx2_velocity_chunked(spark: SparkSession, sf: str) -> DataFrame:
    out = velocity.compute_velocity_features(fx.txn(spark, sf), method="chunked", amount_scale=CENTS)
    return out.select("TransactionID", *velocity.expected_feature_names())


# --- order, samples, sets ----------------------------------------------------------------------------


def o1_chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.assign_split(fx.txn_orders(spark, sf)).select("TransactionID", "TransactionDT", "split")


def o2_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A split by id instead of time overlaps; the violations are reported."""
    by_id = fx.txn_orders(spark, sf).withColumn(
        "split",
        F.when(F.col("TransactionID") % 3 == 0, "train").when(F.col("TransactionID") % 3 == 1, "val").otherwise("test"),
    )
    return split.overlap_violations(by_id)


def o3_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.top_n(profile.null_profile(merged(spark, sf)), "null_pct", 5, tie="column"))


def o4_sort_absolute(spark: SparkSession, sf: str) -> DataFrame:
    gaps = profile.missingness_vs_label(merged(spark, sf)).select("column", "delta")
    return rounded(profile.top_n(rounded(gaps), "delta", 3, absolute=True, tie="column"))


def o5_exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_exact(fx.txn(spark, sf), 500).select("TransactionID", "isFraud")


def o6_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(fx.txn(spark, sf), 1_000, 100).select("TransactionID", "isFraud")


def u1_union_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.txn(spark, sf).select("TransactionID", "TransactionAmt", "isFraud")
    return rows.where("isFraud = 1").unionByName(rows.where("isFraud = 0"))


# --- scalar functions --------------------------------------------------------------------------------


def _scalar(**columns) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = {name: make() for name, make in columns.items()}
        return rounded(fx.txn(spark, sf).select("TransactionID", *[c.alias(n) for n, c in made.items()]))

    return run


def _dt():
    return F.col("TransactionDT")


def _amt():
    return F.col("TransactionAmt")


def _block(block: Callable[[DataFrame], DataFrame], *names: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(block(merged(spark, sf)).select("TransactionID", *names))

    return run


def _spike(*names: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        fitted = encoders.fit_amount_encoders(train_rows(spark, sf))
        return rounded(
            encoders.compute_spend_spike_features(fx.txn(spark, sf), fitted).select("TransactionID", *names), 6
        )

    return run


def _address(*names: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        fitted = encoders.fit_address_encoders(train_rows(spark, sf))
        return encoders.compute_address_features(fx.txn(spark, sf), fitted).select("TransactionID", *names)

    return run


ENTITIES = encoders.AMOUNT_ENTITIES
RATIOS = [f"amt_to_{e}_mean_ratio" for e in ENTITIES]
ZSCORES = [f"amt_zscore_{e}" for e in ENTITIES]
MODES = [f"card1_{a}_is_mode" for a in encoders.ADDRESS_COLS]
UNIQUES = [f"card1_{a}_n_unique" for a in encoders.ADDRESS_COLS]
TEMPORAL = ["hour_of_day", "day_of_week", "day_of_dataset", "is_night", "is_weekend"]
AMOUNTS = ["log1p_amt", "amt_cents", "is_round_amount"]
EMAILS = [
    "email_match", "p_email_tld", "r_email_tld", "email_tld_match",
    "p_email_is_free", "r_email_is_free", "both_free_email",
]
PRESENCE = ["has_identity", "identity_completeness"]


# --- encoders and the feature plan -------------------------------------------------------------------


def e1_fit_amount(spark: SparkSession, sf: str) -> DataFrame:
    fitted = encoders.fit_amount_encoders(train_rows(spark, sf))
    out = None
    for entity, lookup in fitted.tables.items():
        part = lookup.table.select(
            F.lit(entity).alias("entity"), F.col(entity).cast("string").alias("value"), "n", "mean", "std"
        )
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def e3_fit_address(spark: SparkSession, sf: str) -> DataFrame:
    return encoders.fit_address_encoders(train_rows(spark, sf)).table.table


CODED = ["ProductCD", "P_emaildomain", "R_emaildomain"]


def e5_fit_labels(spark: SparkSession, sf: str) -> DataFrame:
    fitted = coding.fit_label_encoders(train_rows(spark, sf), columns=CODED)
    return fitted.stacked().select("column", "value", "code")


def e6_apply_labels(spark: SparkSession, sf: str) -> DataFrame:
    fitted = coding.fit_label_encoders(train_rows(spark, sf), columns=CODED)
    return coding.apply_codes(fx.txn(spark, sf), fitted).select("TransactionID", *CODED)


def e7_category_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.txn(spark, sf)
    table = coding.category_table(rows, CODED, null_class=None)
    lookups = {
        c: joins.Lookup.build(table.where(F.col("column") == c).select("value", "code", "n"), ["value"], "n")
        for c in CODED
    }
    coded = coding.apply_codes(rows, coding.LabelEncoders(lookups), null_class=None, unseen=-1)
    return coded.select("TransactionID", *CODED)


SCALED = ["TransactionAmt", "addr1", "addr2"]


def e8_standard_scaler(spark: SparkSession, sf: str) -> DataFrame:
    scaler = coding.Scaler.fit(train_rows(spark, sf), SCALED)
    return rounded(scaler.transform(fx.txn(spark, sf), keep=["TransactionID"]), 6)


def e8_scaler_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(coding.scaler_statistics(train_rows(spark, sf), SCALED), 6)


def e9_behavioral_block(spark: SparkSession, sf: str) -> DataFrame:
    fitted = encoders.fit_amount_encoders(train_rows(spark, sf))
    out = blocks.compute_behavioral_features(fx.txn(spark, sf), fitted)
    return rounded(out.select("TransactionID", *TEMPORAL, *AMOUNTS, *RATIOS, *ZSCORES), 6)


def e10_identity_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = merged(spark, sf)
    fitted = encoders.fit_address_encoders(train_rows(spark, sf))
    out = blocks.compute_identity_features(rows, fitted)
    return rounded(out.select("TransactionID", *EMAILS, *MODES, *UNIQUES, *PRESENCE))


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rows with `split` and the 54 features; velocity stays inside each split.

    The split and the encoders need no identity column, so they are taken before the join.
    """
    rows = tagged(spark, sf)
    plan = FeaturePipeline(PipelineConfig(amount_scale=CENTS, velocity_within=["split"]))
    return plan.fit(rows.where("split = 'train'")).transform(joins.merge_tables(rows, fx.identity(spark, sf)))


FEATURES = [*velocity.expected_feature_names(), *TEMPORAL, *AMOUNTS, *RATIOS, *ZSCORES, *EMAILS, *MODES, *UNIQUES, *PRESENCE]


def e11_all_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(feature_rows(spark, sf).select("TransactionID", "split", *FEATURES), 6)


def e13_median_impute(spark: SparkSession, sf: str) -> DataFrame:
    rows = merged(spark, sf)
    return rounded(coding.impute_median(rows, ["id_01", "id_02", "addr1"]).select("TransactionID", "id_01", "id_02", "addr1"))


# --- evaluation --------------------------------------------------------------------------------------


def _ranked(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(fn(ranking.ranked_scores(fx.scored(spark, sf), MODELS)))


def _scored(fn: Callable[[DataFrame], DataFrame], digits: int = DIGITS) -> Query:
    return lambda spark, sf: rounded(fn(fx.scored(spark, sf)), digits)


def v21_drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.drift(split.assign_split(fx.scored(spark, sf)), "score_a"))


def v1_pr_auc_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A real label: text length as a score for toxicity."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    labelled = fx.table(spark, sf, "labels").join(docs, "doc_id")
    scored = labelled.select(F.col("toxic").alias("y"), (F.col("n_chars") / 100000.0).alias("length"))
    return rounded(ranking.average_precision(ranking.ranked_scores(scored, ["length"])))


# --- models ------------------------------------------------------------------------------------------


def model_inputs(spark: SparkSession, sf: str, columns: Sequence[str]) -> DataFrame:
    """Id, label, `split` and the named features of all rows."""
    rows = tagged(spark, sf)
    wants_velocity = any(c.startswith("vel_") for c in columns)
    config = PipelineConfig(run_velocity=wants_velocity, amount_scale=CENTS)
    plan = FeaturePipeline(config).fit(rows.where("split = 'train'"))
    made = plan.transform(joins.merge_tables(rows, fx.identity(spark, sf)))
    return made.select(*dict.fromkeys(["TransactionID", "isFraud", "split", *columns]))


def model_rows(spark: SparkSession, sf: str, columns: Sequence[str]) -> DataFrame:
    """`model_inputs` written once for the several fits."""
    return materialize(model_inputs(spark, sf, columns))


def part(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("split") == name).drop("split")


TREES = trees.TrainerConfig()
TREE_INPUTS = list(dict.fromkeys(["TransactionAmt", "ProductCD", *FEATURES]))


_trained: dict[tuple[str, str, str], str] = {}  # what a session has stored for a table folder


def stored_once(spark: SparkSession, sf: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of something that several queries read; `write` fills it at the first call of a session."""
    key = spark.sparkContext.applicationId, sf, name
    if key not in _trained:
        folder = new_folder(spark, name)
        write(folder)
        _trained[key] = folder
    return _trained[key]


def trained_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Model inputs of all rows."""
    made = lambda path: model_inputs(spark, sf, [*TREE_INPUTS, *BAYES_INPUTS]).write.parquet(path)
    return spark.read.parquet(stored_once(spark, sf, "rows", made))


def trained_trees(spark: SparkSession, sf: str) -> trees.TreeScorer:
    """The whole training (the search, then the fit of its best point), run once in a session."""

    def make(path: str) -> None:
        rows = trained_rows(spark, sf).select("TransactionID", "isFraud", "split", *TREE_INPUTS)
        scorer = trees.TreeScorer(TREES)
        scorer.tune(part(rows, "train"), part(rows, "val"))
        scorer.train_best().save(spark, path)

    return trees.TreeScorer.load(spark, stored_once(spark, sf, "trees", make))


def trained_bayes(spark: SparkSession, sf: str) -> bayes.BayesLogit:
    made = lambda path: fitted_bayes(trained_rows(spark, sf)).save(spark, path)
    return bayes.BayesLogit.load(spark, stored_once(spark, sf, "bayes", made))


def m2_tree_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trained_trees(spark, sf).evaluate(part(trained_rows(spark, sf), "test")))


def m3_random_search(spark: SparkSession, sf: str) -> DataFrame:
    return trained_trees(spark, sf).trials(spark)


def m4_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trained_trees(spark, sf).predict_proba(trained_rows(spark, sf), keep=["TransactionID", "isFraud"]))


def m5_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trained_trees(spark, sf).get_feature_importance(spark))


BAYES_INPUTS = list(bayes.BAYESIAN_FEATURES)


def fitted_bayes(rows: DataFrame) -> bayes.BayesLogit:
    config = bayes.BayesConfig(features=list(BAYES_INPUTS), n_sample_max=None)
    return bayes.BayesLogit(config).fit(part(rows, "train"))


def m7_posterior_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trained_bayes(spark, sf).get_coefficient_summary(spark), 6)


STEP_AT = (-3.0, 0.5, -0.2)  # a point of the parameter space


def m7_newton_step(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient and curvature sums of one step over all rows."""
    rows = fx.txn(spark, sf).select(
        "isFraud", F.log1p("TransactionAmt").alias("x1"), C.is_night(C.hour_of_day(_dt())).cast("double").alias("x2")
    )
    return rounded(bayes.newton_sums(rows, ["x1", "x2"], STEP_AT), 5)


def m7_posterior_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted point itself: mode and curvature of the posterior over all rows, and whether its gradient vanishes."""
    rows = fx.txn(spark, sf).select(
        "isFraud", (F.log1p("TransactionAmt") - 3.0).alias("x1"), C.is_night(C.hour_of_day(_dt())).cast("double").alias("x2")
    )
    fit = bayes.posterior_mode(materialize(rows), ["x1", "x2"], "isFraud", bayes.BayesConfig())
    lines = [(n, float(m), float(h), bool(fit.gradient_norm < 1e-6 * fit.curvature.min())) for n, m, h in zip(("intercept", "x1", "x2"), fit.mode, fit.curvature)]
    return rounded(spark.createDataFrame(lines, "feature string, mode double, curvature double, at_optimum boolean"), 6)


# Three posterior draws (intercept, weight of log1p_amt).
DRAWS = [(-3.0, [0.5]), (-2.9, [0.4]), (-3.1, [0.6])]


def j5_posterior_draws(spark: SparkSession, sf: str) -> DataFrame:
    xs = [F.log1p("TransactionAmt")]
    return rounded(bayes.explode_draws(fx.txn(spark, sf), xs, bayes.draw_column(DRAWS), ["TransactionID"]))


def m8_posterior_predictive(spark: SparkSession, sf: str) -> DataFrame:
    xs = [F.log1p("TransactionAmt")]
    rows = bayes.summarise_draws(fx.txn(spark, sf), xs, bayes.draw_column(DRAWS), ["TransactionID"], len(DRAWS))
    return rounded(rows)


def m8_posterior_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trained_bayes(spark, sf).predict(trained_rows(spark, sf)), 6)


def m9_coefficient_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One draw per card: the summary operator over a table that grows with the data."""
    draws = fx.txn(spark, sf).groupBy(F.col("card1").alias("draw_id")).agg(
        (F.avg(F.log1p("TransactionAmt")) - 3.0).alias("alpha"),
        F.array(
            F.avg(F.col("TransactionAmt") / 100.0) - 0.5, F.avg(F.col("isFraud").cast("double"))
        ).alias("beta"),
    )
    return rounded(bayes.coefficient_summary(draws, ["amount", "label"]), 6)


WEIGHTS = {"TransactionAmt": 0.8, "addr1": -0.3, "addr2": 0.45}


def m10_linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    scaler = coding.Scaler.fit(train_rows(spark, sf), SCALED)
    return rounded(attribution.linear_contributions(fx.txn(spark, sf), scaler, WEIGHTS, top_k=2), 6)


def m11_permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    scorer = trained_trees(spark, sf)
    return rounded(attribution.forest_importance(part(trained_rows(spark, sf), "test"), scorer))


def m12_pca(spark: SparkSession, sf: str) -> DataFrame:
    """The embedding dimensions stand in for the vendor block."""
    table = fx.table(spark, sf, "embeddings")
    width = len(table.select("embedding").first()[0])
    block = [F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(width)]
    rows = table.select(F.col("vec_id").alias("TransactionID"), F.col("label").alias("isFraud"), *block)
    result = pca.pca_block(rows)
    shares = {f"explained{i + 1}": F.lit(v) for i, v in enumerate(result.explained)}
    return rounded(result.projected.withColumns(shares), 6)


def m12_pca_check(spark: SparkSession, sf: str) -> DataFrame:
    """One row per input: it is projected, and the components' variances are the explained ones, in falling order."""
    rows = m12_pca(spark, sf)
    spread = rows.agg(F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2"), F.max("explained1").alias("e1"), F.max("explained2").alias("e2"))
    fits = spread.select(
        ((F.abs(F.col("v1") / F.col("v2") - F.col("e1") / F.col("e2")) < 1e-3) & (F.col("e1") >= F.col("e2")) & (F.col("e1") + F.col("e2") <= 1)).alias("fits")
    )
    return rows.select("TransactionID", (F.col("pc1").isNotNull() & ~F.isnan("pc1")).alias("projected"), fits.scalar().alias("variances_fit"))


def m8_posterior_check(spark: SparkSession, sf: str) -> DataFrame:
    """One row per input: its mean lies in its interval, and that in [0, 1]."""
    rows = m8_posterior_scores(spark, sf)
    inside = (F.col("hdi_lower") <= F.col("mean_proba")) & (F.col("mean_proba") <= F.col("hdi_upper"))
    return rows.select("TransactionID", (inside & (F.col("hdi_lower") >= 0) & (F.col("hdi_upper") <= 1)).alias("ordered"))


def m13_persistence_check(spark: SparkSession, sf: str) -> DataFrame:
    """One row per test row: both loaded models give the score of the saved one."""
    rows = m13_persistence(spark, sf)
    return rows.select("TransactionID", (F.col("score_a") == F.col("again_a")).alias("same_a"), (F.col("score_b") == F.col("again_b")).alias("same_b"))


def m13_persistence(spark: SparkSession, sf: str) -> DataFrame:
    """Both models saved and loaded; scores of the loaded models next to those of the originals."""
    folder = new_folder(spark, "models")
    scorer, logit = trained_trees(spark, sf), trained_bayes(spark, sf)
    scorer.save(spark, f"{folder}/trees")
    logit.save(spark, f"{folder}/bayes")
    tests = part(trained_rows(spark, sf), "test")
    before = score_both(tests, scorer, logit)
    after = score_both(
        tests, trees.TreeScorer.load(spark, f"{folder}/trees"), bayes.BayesLogit.load(spark, f"{folder}/bayes")
    )
    again = after.select("TransactionID", F.col("score_a").alias("again_a"), F.col("score_b").alias("again_b"))
    return rounded(before.join(again, "TransactionID").select("TransactionID", "score_a", "again_a", "score_b", "again_b"))


def v19_full_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    tests = part(trained_rows(spark, sf), "test")
    path = f"{new_folder(spark, 'evaluation')}/report"
    FraudEvaluator.of_models(tests, trained_trees(spark, sf), trained_bayes(spark, sf)).run(path)
    return sinks.read_report(spark, path).drop("elapsed_s")


def v19_evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report of two given scores over all transactions, one line per figure."""
    config = EvaluatorConfig(decision_threshold=0.4, disagreement_threshold=0.25)
    return report_lines(FraudEvaluator(fx.scored(spark, sf), config).run())


# --- streams -----------------------------------------------------------------------------------------


def _drain(query) -> None:
    query.awaitTermination()


def t1_stream_features(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "stream")
    fitted = FeaturePipeline(PipelineConfig(run_velocity=False)).fit(train_rows(spark, sf))
    stream = fx.txn(spark, sf, jobs.read_table_stream(spark, sf, "events"))
    _drain(jobs.write_stream(jobs.row_features(stream, fitted), f"{folder}/out", f"{folder}/state"))
    out = spark.read.parquet(f"{folder}/out")
    return rounded(out.select("TransactionID", *TEMPORAL, *AMOUNTS, *RATIOS, *ZSCORES, *EMAILS, *MODES, *UNIQUES), 6)


STREAM_PARTS = 4


def t2_stream_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """The events arrive in four parts in order of time; windows reach across parts through keyed state."""
    folder = new_folder(spark, "stream")
    events = fx.table(spark, sf, "events")
    rows = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    low, high = events.agg(F.min(rows), F.max(rows)).first()
    quarter = F.least(F.floor((rows - low) * STREAM_PARTS / max(1, high - low)), F.lit(STREAM_PARTS - 1))
    for k in range(STREAM_PARTS):
        # what arrived since the last run; the state carries the earlier parts over
        events.where(quarter == k).write.mode("append").parquet(f"{folder}/in")
        stream = fx.txn(spark, sf, spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
        made = state.velocity_state(stream, ["card1"], amount_scale=CENTS)
        _drain(jobs.write_stream(made, f"{folder}/out", f"{folder}/state"))
    return state.wide_velocity(spark.read.parquet(f"{folder}/out"), ["card1"])


def t3_label_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """The last window stays open on the stream until the watermark passes it; the batch part closes it."""
    folder = new_folder(spark, "stream")

    def hourly(events: DataFrame) -> DataFrame:
        is_error = (F.col("event_type") == "error").cast("int")
        rows = events.select(F.col("ts").cast("timestamp").alias("at"), is_error.alias("isFraud"))
        return jobs.label_rate_monitor(rows, "at")

    _drain(jobs.write_stream(hourly(jobs.read_table_stream(spark, sf, "events")), f"{folder}/out", f"{folder}/state"))
    closed = spark.read.parquet(f"{folder}/out")
    last = hourly(fx.table(spark, sf, "events"))
    still_open = last.where(F.col("window_start") == last.agg(F.max("window_start")).scalar()).join(closed, "window_start", "left_anti")
    return rounded(closed.unionByName(still_open).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


def queries() -> dict[str, Query]:
    v = uncertainty
    return {
        "s1_csv_scan": s1_csv_scan,
        "s3_split_sink": s3_split_sink,
        "s7_report_sink": s7_report_sink,
        "s8_artefact_sink": s8_artefact_sink,
        "s9_narrowing": s9_narrowing,
        "p1_exclude_columns": p1_exclude_columns,
        "p4_align_schema": p4_align_schema,
        "p7_mask_filters": p7_mask_filters,
        "j1_merge": j1_merge,
        "j2_enrichment_rate": j2_enrichment_rate,
        "j3_lookup_join": j3_lookup_join,
        "a1_split_summary": a1_split_summary,
        "a2_entity_mean_std": a2_entity_mean_std,
        "a3_global_mean_std": a3_global_mean_std,
        "a4_entity_mode": a4_entity_mode,
        "a5_entity_distinct": a5_entity_distinct,
        "a6_class_balance": a6_class_balance,
        "a7_null_profile": a7_null_profile,
        "a7_null_counts": a7_null_counts,
        "a8_family_nulls": a8_family_nulls,
        "a9_missingness_label": a9_missingness_label,
        "a10_time_buckets": a10_time_buckets,
        "a11_hour_profile": a11_hour_profile,
        "a11_peak_hour": a11_peak_hour,
        "a12_day_profile": a12_day_profile,
        "a13_class_amounts": a13_class_amounts,
        "a14_log_histogram": a14_log_histogram,
        "a15_box_stats": a15_box_stats,
        "a16_identity_coverage": a16_identity_coverage,
        "a17_describe_scores": a17_describe_scores,
        "a18_dataset_summary": a18_dataset_summary,
        "w1_rolling_count": w1_rolling_count,
        "w2_rolling_sum": w2_rolling_sum,
        "w3_rolling_mean": w3_rolling_mean,
        "w4_velocity_grid": w4_velocity_grid,
        "w4_velocity_ties": w4_velocity_ties,
        "w4_velocity_default": w4_velocity_default,
        "w4_velocity_bulk": w4_velocity_bulk,
        "w6_null_entity": w6_null_entity,
        "w7_score_prefix": w7_score_prefix,
        "w8_moving_average": w8_moving_average,
        "w9_empirical_cdf": w9_empirical_cdf,
        "w10_bin_step": w10_bin_step,
        "w11_importance_rank": w11_importance_rank,
        "wx1_velocity_history": wx1_velocity_history,
        "wx2_velocity_chunked": wx2_velocity_chunked,
        "o1_chronological_split": o1_chronological_split,
        "o2_overlap": o2_overlap,
        "o3_top_n": o3_top_n,
        "o4_sort_absolute": o4_sort_absolute,
        "o5_exact_sample": o5_exact_sample,
        "o6_stratified_sample": o6_stratified_sample,
        "u1_union_all": u1_union_all,
        "f1_hour_of_day": _scalar(hour_of_day=lambda: C.hour_of_day(_dt())),
        "f2_day_of_week": _scalar(day_of_week=lambda: C.day_of_week(_dt())),
        "f3_day_of_dataset": _scalar(day_of_dataset=lambda: C.day_of_dataset(_dt())),
        "f4_is_night": _scalar(is_night=lambda: C.is_night(C.hour_of_day(_dt()))),
        "f5_is_weekend": _scalar(is_weekend=lambda: C.is_weekend(C.day_of_week(_dt()))),
        "f6_week_index": _scalar(week=lambda: C.week_index(_dt())),
        "f7_log1p_amt": _scalar(log1p_amt=lambda: F.log1p(_amt())),
        "f8_amt_cents": _scalar(amt_cents=lambda: C.amount_cents(_amt())),
        "f9_is_round_amount": _scalar(is_round_amount=lambda: C.is_round_amount(_amt())),
        "f10_mean_ratio": _spike(*RATIOS),
        "f11_zscore": _spike(*ZSCORES),
        "f12_email_match": _block(blocks.compute_email_features, "email_match"),
        "f13_email_tld": _block(blocks.compute_email_features, "p_email_tld", "r_email_tld"),
        "f14_email_tld_match": _block(blocks.compute_email_features, "email_tld_match"),
        "f15_free_email": _block(
            blocks.compute_email_features, "p_email_is_free", "r_email_is_free", "both_free_email"
        ),
        "f16_identity_presence": _block(blocks.compute_identity_presence_features, *PRESENCE),
        "f17_addr_is_mode": _address(*MODES),
        "f18_addr_n_unique": _address(*UNIQUES),
        "f19_sigmoid": _scalar(p=lambda: C.sigmoid(-3.0 + 0.5 * F.log1p(_amt()))),
        "f21_clip": _scalar(clipped=lambda: C.clip(_amt(), 5.0, 50.0)),
        "e1_fit_amount": e1_fit_amount,
        "e2_spend_spike": _spike(*RATIOS, *ZSCORES),
        "e3_fit_address": e3_fit_address,
        "e4_address_features": _address(*MODES, *UNIQUES),
        "e5_fit_labels": e5_fit_labels,
        "e6_apply_labels": e6_apply_labels,
        "e7_category_codes": e7_category_codes,
        "e8_standard_scaler": e8_standard_scaler,
        "e8_scaler_statistics": e8_scaler_statistics,
        "e9_behavioral_block": e9_behavioral_block,
        "e10_identity_block": e10_identity_block,
        "e11_all_features": e11_all_features,
        "e13_median_impute": e13_median_impute,
        "v1_pr_auc": _ranked(ranking.average_precision),
        "v1_pr_auc_documents": v1_pr_auc_documents,
        "v2_roc_auc": _ranked(ranking.roc_auc),
        "v3_pr_curve": _ranked(ranking.pr_curve),
        "v3_roc_curve": _ranked(ranking.roc_curve),
        "v4_optimal_threshold": _ranked(ranking.optimal_threshold),
        "v5_ks": _scored(lambda d: ranking.ks_statistic(ranking.score_table(ranking.long_scores(d, MODELS)))),
        "v6_threshold_metrics": _scored(lambda d: ranking.threshold_metrics(d, MODELS)),
        "v7_brier": _scored(lambda d: calibration.brier_score(d, MODELS)),
        "v8_ece": _scored(lambda d: calibration.ece_from_scores(ranking.score_table(ranking.long_scores(d, MODELS)))),
        "v9_metrics_matrix": _scored(lambda d: report.metrics_matrix(d, MODELS, rounded=False)),
        "v10_calibration_curve": _scored(lambda d: calibration.calibration_curve(d, MODELS)),
        "v11_uncertainty_summary": _scored(v.uncertainty_summary),
        "v12_fn_recovery": _scored(v.fn_recovery),
        "v13_fn_summary": _scored(v.fn_summary),
        "v14_disagreement": _scored(v.disagreement),
        "v15_width_histogram": _scored(v.width_histogram),
        "v16_agreement_grid": _scored(v.agreement_grid),
        "v17_recovery_gain": _scored(lambda d: v.recovery_gain(v.fn_recovery(d))),
        "v18_routing": _scored(lambda d: v.route_decisions(d).select("TransactionID", "decision")),
        "v21_drift": v21_drift,
        "v22_cost_exposure": _scored(v.cost_exposure, 4),
        "m1_class_weight": lambda spark, sf: rounded(
            profile.class_balance(train_rows(spark, sf)).select("scale_pos_weight")
        ),
        "m2_tree_fit": m2_tree_fit,
        "m3_random_search": m3_random_search,
        "m4_tree_scores": m4_tree_scores,
        "m5_feature_importance": m5_feature_importance,
        "m6_short_metrics": _scored(lambda d: report.short_metrics(d, MODELS, rounded=False)),
        "m7_posterior_fit": m7_posterior_fit,
        "m7_newton_step": m7_newton_step,
        "m7_posterior_mode": m7_posterior_mode,
        "j5_posterior_draws": j5_posterior_draws,
        "m8_posterior_predictive": m8_posterior_predictive,
        "m8_posterior_scores": m8_posterior_scores,
        "m9_coefficient_summary": m9_coefficient_summary,
        "m10_linear_attribution": m10_linear_attribution,
        "m11_permutation_importance": m11_permutation_importance,
        "m12_pca": m12_pca,
        "m13_persistence": m13_persistence,
        "m8_posterior_check": m8_posterior_check,
        "m12_pca_check": m12_pca_check,
        "m13_persistence_check": m13_persistence_check,
        "v19_full_evaluation": v19_full_evaluation,
        "v19_evaluation_report": v19_evaluation_report,
        "t1_stream_features": t1_stream_features,
        "t2_stream_velocity": t2_stream_velocity,
        "t3_label_monitor": t3_label_monitor,
    }
