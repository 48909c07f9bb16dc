"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are the hash bins of its distinct words (weighted so that each text's words together have one fixed length), one
bin for each structure statistic (how long, how repetitive, how many signs, capitals, digits, lines ...) and one for
the metadata column n_chars. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

whose last term, all pairwise interactions, takes linear time by the sum-of-squares identity: per text three sums over
its features, made by segment for a whole slice of texts at once.

The machine is fitted by Spark's FMClassifier, on at most about `fit_rows` labelled rows (a documented bound: the rows
with the lowest hash of their id; their labels are then few enough to broadcast, so no text is shuffled for it).
Scoring is one narrow pass.

Defined results: NULL and empty texts are scored from their statistics alone; a NULL n_chars has a bin of its own;
rows with NULL doc_id are never held out and never learned from; several labels of one id count by their majority,
ties as 1; without any label every score is 0.5, with one class only it is near that class. Extra columns pass
through; one named like an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.arrow import add_columns, as_bytes
from riskframe.llm.hashing import text_words
from riskframe.llm.language import held_out

WORD_BITS = 13
RANK = 8
FIT_ROWS = 12_000
FIT_ROUNDS = 60
STEP = 0.03
PENALTY = 0.01
#: Length of a text's word part: below 1, so that the few statistics are learned before the many words.
WORD_WEIGHT = 0.3
CUT = 0.3
#: Bins of each statistic.
LEVELS = 16

STATISTICS = ("words", "word_length", "distinct", "top_word", "echo", "signs", "capitals", "digits", "lines", "high", "n_chars")

_byte = np.arange(256)
_upper = (_byte >= 0x41) & (_byte <= 0x5A)
_lower = (_byte >= 0x61) & (_byte <= 0x7A)
_digit = (_byte >= 0x30) & (_byte <= 0x39)
_high = _byte >= 0x80
_space = np.isin(_byte, [0x20, *range(0x09, 0x0E)])
_sign = ~(_upper | _lower | _digit | _high | _space)
#: Class of each byte: white space, small, capital, digit, beyond ASCII, sign.
KIND = (_lower * 1 + _upper * 2 + _digit * 3 + _high * 4 + _sign * 5).astype(np.uint8)


@dataclass
class Features:
    """Sparse rows: text k has the entries from firsts[k] to firsts[k + 1]."""

    index: np.ndarray
    value: np.ndarray
    firsts: np.ndarray


def dimensions(bits: int = WORD_BITS) -> int:
    return (1 << bits) + len(STATISTICS) * LEVELS


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Level of a share: 0 for none, then finer for small shares."""
    ratio = x / np.maximum(of, 1)
    level = np.where(x > 0, 1 + np.floor(np.sqrt(np.clip(ratio, 0, 1)) * (LEVELS - 2)), 0)
    return level.astype(np.int64)


def _scale(x: np.ndarray, base: float) -> np.ndarray:
    return np.clip(np.floor(np.log1p(x) / np.log(base)), 0, LEVELS - 1).astype(np.int64)


def features(texts: list[bytes], n_chars: np.ndarray, bits: int = WORD_BITS) -> Features:
    """Features of a slice of texts; n_chars below 0 stands for NULL."""
    words, firsts = text_words([t.lower() for t in texts])
    rows = len(texts)
    n = np.diff(firsts)
    row = np.repeat(np.arange(rows), n)
    bins = (words >> np.uint64(64 - bits)).astype(np.int64)
    keys, times = np.unique((row << bits) | bins, return_counts=True)
    of, bin_ = keys >> bits, keys & ((1 << bits) - 1)
    distinct = np.bincount(of, minlength=rows)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, of, times)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    echo = np.bincount(row[same], minlength=rows)
    kinds = np.zeros((rows, 6), np.int64)
    lines = np.zeros(rows, np.int64)
    for k, t in enumerate(texts):
        kinds[k] = np.bincount(KIND[np.frombuffer(t, np.uint8)], minlength=6)
        lines[k] = t.count(b"\n")
    size = kinds.sum(1)
    letters = kinds[:, 1] + kinds[:, 2]
    levels = np.stack([
        _scale(n, 2.0),
        np.clip((size - kinds[:, 0]) // np.maximum(n, 1), 0, LEVELS - 1),
        _share(distinct, n),
        _share(top, n),
        _share(echo, n),
        _share(kinds[:, 5], size - kinds[:, 0]),
        _share(kinds[:, 2], letters),
        _share(kinds[:, 3], size),
        _share(lines, n),
        _share(kinds[:, 4], size),
        np.where(n_chars < 0, 0, 1 + np.minimum(_scale(np.maximum(n_chars, 0), 2.5), LEVELS - 2)),
    ], axis=1)
    count = levels.shape[1]
    fixed = (1 << bits) + np.arange(count) * LEVELS + levels
    # entries of a text: its words, then its statistics
    ends = np.cumsum(distinct + count)
    begins = ends - distinct - count
    index = np.empty(int(ends[-1]) if rows else 0, np.int64)
    value = np.ones(len(index))
    place = begins[of] + np.arange(len(of)) - np.concatenate([[0], np.cumsum(distinct)])[of]
    index[place] = bin_
    value[place] = WORD_WEIGHT / np.sqrt(distinct[of])
    index[(begins + distinct)[:, None] + np.arange(count)] = fixed
    return Features(index, value, np.concatenate([[0], ends]))


@dataclass
class Machine:
    """A fitted factorisation machine; its size depends on the settings only."""

    intercept: float
    linear: np.ndarray
    factors: np.ndarray
    bits: int = WORD_BITS

    def scores(self, x: Features) -> np.ndarray:
        rows = len(x.firsts) - 1
        if not rows:
            return np.zeros(0)
        at = x.firsts[:-1]
        total = self.intercept + np.add.reduceat(self.linear[x.index] * x.value, at)
        for v in self.factors.T:
            weighted = v[x.index] * x.value
            total += 0.5 * (np.add.reduceat(weighted, at) ** 2 - np.add.reduceat(weighted**2, at))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def constant(chance: float, bits: int = WORD_BITS) -> Machine:
    chance = min(max(chance, 0.001), 0.999)
    d = dimensions(bits)
    return Machine(float(np.log(chance / (1 - chance))), np.zeros(d), np.zeros((d, 1)), bits)


def _metadata(part: pa.RecordBatch, name: str | None) -> np.ndarray:
    if name is None:
        return np.full(part.num_rows, -1, np.int64)
    column = part.column(part.schema.get_field_index(name)).cast(pa.int64())
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    size_col: str | None = "n_chars",
    fit_rows: int = FIT_ROWS,
    rank: int = RANK,
    rounds: int = FIT_ROUNDS,
    bits: int = WORD_BITS,
    seed: int = 7,
) -> Machine:
    """Fit on the labelled rows of `docs` given (leave held-out labels out of `labels`)."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("label"))
    n = known.count()
    if not n:
        return constant(0.5, bits)
    part = min(1.0, fit_rows / n)
    sample = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(part * (1 << 30)))
    chances = sample.agg(F.avg("label"), F.count("label")).first()
    if not chances[1] or chances[0] in (0.0, 1.0):
        return constant(0.5 if not chances[1] else chances[0], bits)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        (F.col(f"`{size_col}`").cast("long") if size_col else F.lit(None).cast("long")).alias("chars"),
    ).join(F.broadcast(sample), "id")

    def start():
        def run(batch):
            x = features(as_bytes(batch, "text"), _metadata(batch, "chars"), bits)
            ends = pa.array(x.firsts.astype(np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(x.index.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x.value))]

        return run

    lists = [("index", T.ArrayType(T.IntegerType())), ("value", T.ArrayType(T.DoubleType()))]
    size = dimensions(bits)
    vector = F.udf(lambda index, value: SparseVector(size, sorted(zip(index, value))), VectorUDT())
    training = add_columns(rows, "text", lists, start, drop=("text", "chars"))
    training = training.select("label", vector("index", "value").alias("features")).repartition(spark.sparkContext.defaultParallelism)
    model = FMClassifier(factorSize=rank, maxIter=rounds, stepSize=STEP, regParam=PENALTY, initStd=0.02, solver="adamW", seed=seed).fit(training)
    return Machine(float(model.intercept), model.linear.toArray(), model.factors.toArray(), bits)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", size_col: str | None = "n_chars", cut: float = CUT) -> DataFrame:
    """`docs` with score and predicted (1 if score >= cut). A narrow pass; the machine is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def start():
        m = shared.value
        return lambda part: [m.scores(features(as_bytes(part, text_col), _metadata(part, size_col), m.bits))]

    out = add_columns(docs, text_col, [("score", T.DoubleType())], start, drop=("predicted",))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    machine = fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return score(docs, machine).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
