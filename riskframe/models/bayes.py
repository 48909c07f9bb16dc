"""Bayesian logistic regression: Newton steps as Spark aggregations, Gaussian mean-field posterior.

Each step is one aggregation that returns the gradient and the p x p curvature; only those sums reach the
driver. `newton_sums` states a step in built-in expressions; `newton_blocks` takes the same sums per task
with NumPy, which measured four times faster at 15 features (152 sums per row). At the mode, mean-field variational inference on the Gaussian approximation gives variance
1 / H_jj per coefficient. Scoring evaluates all posterior draws per row, either in Arrow batches with NumPy
or as built-in array expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import direction, excludes_zero, sigmoid
from riskframe.operators.coding import LabelEncoders, Scaler, apply_codes, fit_label_encoders
from riskframe.operators.ordering import exact_quantiles
from riskframe.operators.sampling import stratified_sample
from riskframe.schema import ID, LABEL, present
from riskframe.session import materialize
from riskframe.sources.sinks import write_artefact

# The default features, and the tails of the 94 % interval.
BAYESIAN_FEATURES = [
    "vel_card1_1h_count", "vel_card1_24h_count", "vel_card1_7d_count", "vel_card1_1h_sum", "vel_addr1_24h_count",
    "log1p_amt", "amt_to_card1_mean_ratio", "amt_zscore_card1", "hour_of_day", "is_night", "is_weekend",
    "email_match", "has_identity", "card1_addr1_is_mode", "identity_completeness",
]
TAILS = (0.03, 0.97)
PREDICTION_ROWS = 4_096  # rows per NumPy block: with 500 draws a block takes 16 MB


@dataclass
class BayesConfig:
    """`n_sample_max=None` fits on every row; otherwise a stratified sample of that size is used."""

    features: list[str] = field(default_factory=lambda: list(BAYESIAN_FEATURES))
    n_sample_max: int | None = 50_000
    min_fraud_in_sample: int = 2_000
    max_steps: int = 30
    tolerance: float = 1e-6
    n_posterior_samples: int = 2_000
    n_prediction_samples: int = 500
    prior_beta_sigma: float = 1.0
    prior_alpha_sigma: float = 2.0
    random_seed: int = 42
    model_name: str = "bayes_logit"


def newton_sums(df: DataFrame, features: Sequence[str], theta: Sequence[float], label: str = LABEL) -> DataFrame:
    """One row (g0.., h0_0..): gradient and curvature sums of the log-likelihood at `theta` (intercept first).

    `p` and `w` are computed once per row; the sums combine map-side, so a step shuffles one row per task.
    """
    linear: Column = F.lit(float(theta[0]))
    for name, weight in zip(features, theta[1:]):
        linear = linear + F.lit(float(weight)) * F.col(name)
    names = ["__one", *features]
    rows = (
        df.select(F.col(label).cast("double").alias("__y"), F.lit(1.0).alias("__one"), *features, linear.alias("__z"))
        .withColumn("__p", sigmoid(F.col("__z")))
        .withColumn("__w", F.col("__p") * (1.0 - F.col("__p")))
        .withColumn("__e", F.col("__y") - F.col("__p"))
    )
    sums = [F.sum(F.col("__e") * F.col(a)).alias(f"g{i}") for i, a in enumerate(names)]
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            sums.append(F.sum(F.col("__w") * F.col(a) * F.col(names[j])).alias(f"h{i}_{j}"))
    return rows.agg(*sums)


@dataclass(frozen=True)
class Sums:
    """Log-likelihood with its gradient and curvature at one point."""

    value: float
    gradient: np.ndarray
    curvature: np.ndarray


def newton_blocks(df: DataFrame, features: Sequence[str], theta: np.ndarray, label: str = LABEL) -> Sums:
    """The sums of `newton_sums` as arrays, with the log-likelihood. Each task returns one block to be added up."""
    names, size = list(features), len(theta)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value, gradient, curvature = 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(float)])
            y, z = batch[label].to_numpy(float), x @ theta
            p = 1.0 / (1.0 + np.exp(-z))
            value += float((y * z - np.logaddexp(0.0, z)).sum())
            gradient += x.T @ (y - p)
            curvature += (x * (p * (1.0 - p))[:, None]).T @ x
        yield pd.DataFrame({"v": [np.concatenate([[value], gradient, curvature.ravel()])]})

    blocks = df.select(label, *names).mapInPandas(block, "v array<double>")
    sums = blocks.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(1 + size + size * size)
    for row in sums.collect():  # 1 + size + size^2 rows
        flat[row["i"]] = row["v"]
    return Sums(float(flat[0]), flat[1 : size + 1], flat[size + 1 :].reshape(size, size))


@dataclass(frozen=True)
class Mode:
    """The posterior mode, the diagonal of the curvature there, and the largest entry of the gradient there."""

    mode: np.ndarray
    curvature: np.ndarray
    gradient_norm: float


def posterior_mode(df: DataFrame, features: Sequence[str], label: str, config: BayesConfig) -> Mode:
    """Damped Newton from zero with a line search: a step that lowers the log-posterior is halved.

    One pass per point gives value, gradient and curvature, so a step that is kept costs no pass of its own.
    """
    size = len(features) + 1
    precision = np.full(size, 1.0 / config.prior_beta_sigma**2)
    precision[0] = 1.0 / config.prior_alpha_sigma**2

    def at(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = newton_blocks(df, features, point, label)
        value = sums.value - 0.5 * float(precision @ point**2)
        return value, sums.gradient - precision * point, sums.curvature + np.diag(precision)

    theta = np.zeros(size)
    value, gradient, hessian = at(theta)
    for _ in range(config.max_steps):
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        found = at(theta + step)
        # sums of floats in another order differ in their last digits
        while found[0] < value - 1e-9 * (1.0 + abs(value)) and np.abs(step).max() >= config.tolerance:
            step = step / 2
            found = at(theta + step)
        theta = theta + step
        value, gradient, hessian = found
        if np.abs(step).max() < config.tolerance:
            break
    return Mode(theta, np.diag(hessian), float(np.abs(gradient).max()))


def draw_column(draws: Sequence[tuple[float, Sequence[float]]]) -> Column:
    """Posterior draws as a constant array column; its size is the configured number of draws."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("draw_id"),
                F.lit(float(a)).alias("alpha"),
                F.array(*[F.lit(float(b)) for b in beta]).alias("beta"),
            )
            for i, (a, beta) in enumerate(draws)
        ]
    )


def _probability(draw: Column, xs: Sequence[Column]) -> Column:
    linear = draw["alpha"]
    for j, x in enumerate(xs):
        linear = linear + draw["beta"][j] * x
    return sigmoid(linear)


def explode_draws(df: DataFrame, xs: Sequence[Column], draws: Column, keep: Sequence[str]) -> DataFrame:
    """Every row under every draw: (keep.., draw_id, p). Draws are a constant array, so nothing is joined."""
    rows = df.select(*keep, *[x.alias(f"__x{j}") for j, x in enumerate(xs)], F.explode(draws).alias("d"))
    inputs = [F.col(f"__x{j}") for j in range(len(xs))]
    return rows.select(*keep, F.col("d.draw_id").alias("draw_id"), _probability(F.col("d"), inputs).alias("p"))


def summarise_draws(df: DataFrame, xs: Sequence[Column], draws: Column, keep: Sequence[str], n_draws: int) -> DataFrame:
    """Posterior predictive per row with built-in array functions: no shuffle and no Python."""
    ps = df.select(*keep, *[x.alias(f"__x{j}") for j, x in enumerate(xs)])
    inputs = [F.col(f"__x{j}") for j in range(len(xs))]
    ps = ps.select(*keep, F.array_sort(F.transform(draws, lambda d: _probability(d, inputs))).alias("ps"))
    add = lambda total, v: total + v
    mean = F.aggregate("ps", F.lit(0.0), add) / n_draws
    out = ps.withColumn("mean_proba", mean)
    spread = F.aggregate(
        "ps", F.lit(0.0), lambda t, v: t + (v - F.col("mean_proba")) * (v - F.col("mean_proba"))
    )

    def tail(q: float) -> Column:
        position = q * (n_draws - 1)
        low = int(position)
        high = min(low + 1, n_draws - 1)
        return F.col("ps")[low] + (F.col("ps")[high] - F.col("ps")[low]) * (position - low)

    return out.select(
        *keep,
        "mean_proba",
        F.sqrt(spread / n_draws).alias("uncertainty"),
        tail(TAILS[0]).alias("hdi_lower"),
        tail(TAILS[1]).alias("hdi_upper"),
    )


def coefficient_summary(draws: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sd, equal-tailed 94 % interval, sign and significance per coefficient.

    `draws` has (draw_id, alpha, beta array); beta follows the order of `features`.
    """
    names = F.array(F.lit("intercept"), *[F.lit(f) for f in features])
    long = draws.select(F.posexplode(F.concat(F.array("alpha"), F.col("beta"))).alias("i", "v"))
    long = long.select(names[F.col("i")].alias("feature"), "v")
    moments = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    tails = exact_quantiles(long, "v", TAILS, by=["feature"])
    table = moments.join(tails, "feature").select(
        "feature", "mean", "sd", F.col("q")[0].alias("interval_low"), F.col("q")[1].alias("interval_high")
    )
    return table.select(
        "*",
        excludes_zero(F.col("interval_low"), F.col("interval_high")).alias("significant"),
        direction(F.col("mean")).alias("direction"),
    ).orderBy(F.abs("mean").desc())


def interval(p: np.ndarray) -> list[np.ndarray]:
    """The quantiles `TAILS` of each row of `p`, as `np.percentile` gives them; NaN for a row that holds one.

    One sort of all rows takes a tenth of the time of its selection row by row.
    """
    ordered = np.sort(p, axis=1)  # NaN last
    ends, lost = [], np.isnan(ordered[:, -1])
    for q in TAILS:
        position = q * (p.shape[1] - 1)
        at = int(position)
        low, high, share = ordered[:, at], ordered[:, min(at + 1, p.shape[1] - 1)], np.float64(position - at)
        between = low + (high - low) * share if share < 0.5 else high - (high - low) * (1 - share)
        ends.append(np.where(lost, np.nan, between))
    return ends


class BayesLogit:
    """fit / predict / get_coefficient_summary / save / load."""

    def __init__(self, config: BayesConfig | None = None) -> None:
        self.config = config or BayesConfig()
        self.feature_names_: list[str] = []
        self.scaler_: Scaler | None = None
        self.alpha_: np.ndarray | None = None  # (draws,)
        self.beta_: np.ndarray | None = None  # (draws, features)
        self.codes_: LabelEncoders | None = None  # of text features
        self.gradient_norm_: float | None = None  # largest entry of the gradient of the log-posterior at the mode

    def fit(self, df: DataFrame, label_col: str = LABEL, id_col: str = ID) -> BayesLogit:
        cfg = self.config
        features = present(df, cfg.features, "bayes")
        if not features:
            raise ValueError("none of the requested features is in the DataFrame, add them first")
        rows = df.select(*dict.fromkeys([id_col, label_col, *features]))
        if cfg.n_sample_max is not None:
            rows = stratified_sample(rows, cfg.n_sample_max, cfg.min_fraud_in_sample, label_col, id_col, cfg.random_seed)
        texts = [c for c in features if isinstance(rows.schema[c].dataType, T.StringType)]
        self.codes_ = fit_label_encoders(rows, label_col, columns=texts) if texts else None
        rows = materialize(self._coded(rows).drop(id_col))
        self.feature_names_ = features
        self.scaler_ = Scaler.fit(rows, features)
        scaled = self.scaler_.transform(rows, keep=[label_col])
        fit = posterior_mode(scaled, features, label_col, cfg)
        self.gradient_norm_ = fit.gradient_norm
        rng = np.random.default_rng(cfg.random_seed)
        draws = fit.mode + rng.standard_normal((cfg.n_posterior_samples, len(fit.mode))) / np.sqrt(fit.curvature)
        self.alpha_, self.beta_ = draws[:, 0], draws[:, 1:]
        return self

    def _coded(self, df: DataFrame) -> DataFrame:
        """Text features as the codes of the fitted rows."""
        return df if self.codes_ is None else apply_codes(df, self.codes_)

    def _fitted(self) -> tuple[Scaler, np.ndarray, np.ndarray]:
        if self.scaler_ is None or self.alpha_ is None or self.beta_ is None:
            raise RuntimeError("the model is not fitted, call fit() first")
        return self.scaler_, self.alpha_, self.beta_

    def predict(self, df: DataFrame, keep: Sequence[str] = (ID,), label_col: str | None = LABEL) -> DataFrame:
        """`keep` columns plus mean_proba, uncertainty, hdi_lower, hdi_upper and, if present, true_label."""
        scaler, alpha, beta = self._fitted()
        size = min(self.config.n_prediction_samples, len(alpha))
        chosen = np.random.default_rng(self.config.random_seed).choice(len(alpha), size=size, replace=False)
        a, b = alpha[chosen].astype(np.float32), beta[chosen].astype(np.float32)
        names = list(scaler.features)
        kept = list(keep)
        rows = df
        if label_col and label_col in df.columns:
            rows = rows.withColumn("true_label", F.col(label_col).cast("int"))
            kept.append("true_label")
        if self.codes_ is not None:
            # kept columns stay as they are, also those that are coded as inputs
            rows = self._coded(rows.withColumns({f"__k_{c}": F.col(c) for c in kept}))
            rows = rows.select(*[F.col(f"__k_{c}").alias(c) for c in kept], *[c.alias(f"__x_{f}") for c, f in zip(scaler.columns(), names)])
        else:
            rows = rows.select(*kept, *[c.alias(f"__x_{f}") for c, f in zip(scaler.columns(), names)])
        xs = [f"__x_{f}" for f in names]
        added = ["mean_proba", "uncertainty", "hdi_lower", "hdi_upper"]
        schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in added])

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), PREDICTION_ROWS):
                    part = batch.iloc[start : start + PREDICTION_ROWS]
                    x = part[xs].to_numpy(np.float32)
                    p = 1.0 / (1.0 + np.exp(-(x @ b.T + a)))  # (rows, draws)
                    low, high = interval(p)
                    out = part[kept].copy()
                    out["mean_proba"] = p.mean(axis=1).astype(np.float64)
                    out["uncertainty"] = p.std(axis=1).astype(np.float64)
                    out["hdi_lower"], out["hdi_upper"] = low.astype(np.float64), high.astype(np.float64)
                    yield out

        return rows.mapInPandas(score, schema)

    def draws(self, spark: SparkSession) -> DataFrame:
        """(draw_id, alpha, beta): as many rows as configured posterior samples."""
        _, alpha, beta = self._fitted()
        rows = [(i, float(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(alpha, beta))]
        return spark.createDataFrame(rows, "draw_id int, alpha double, beta array<double>")

    def get_coefficient_summary(self, spark: SparkSession) -> DataFrame:
        return coefficient_summary(self.draws(spark), self.feature_names_)

    def save(self, spark: SparkSession, path: str) -> None:
        scaler, _, _ = self._fitted()
        self.draws(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/draws")
        meta = {"config": asdict(self.config), "scaler": asdict(scaler), "features": self.feature_names_, "gradient_norm": self.gradient_norm_}
        if self.codes_ is not None:
            self.codes_.stacked().write.mode("overwrite").parquet(f"{path}/codes")
            meta["texts"] = list(self.codes_.tables)
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta"
        )
        write_artefact(self.get_coefficient_summary(spark), f"{path}/coefficient_summary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BayesLogit:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        model = cls(BayesConfig(**meta["config"]))
        model.feature_names_ = meta["features"]
        model.gradient_norm_ = meta.get("gradient_norm")
        if "texts" in meta:
            model.codes_ = LabelEncoders.of_stacked(spark.read.parquet(f"{path}/codes"), meta["texts"])
        model.scaler_ = Scaler(**{k: tuple(v) for k, v in meta["scaler"].items()})
        rows = spark.read.parquet(f"{path}/draws").orderBy("draw_id").collect()  # configured number of draws
        model.alpha_ = np.array([r["alpha"] for r in rows])
        model.beta_ = np.array([r["beta"] for r in rows])
        return model
