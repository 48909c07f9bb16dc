"""Language identification as a mixture: which languages, in which proportions, does a text hold?

Each letter gives one n-gram: itself with its two neighbours, white space and signs counting as a word's edge. N-grams
fall into a fixed number of bins by hash, and a language is the smoothed distribution of its bins over all training
texts. For a text, expectation-maximisation over its bin counts estimates the proportions of all learned languages;
then languages are taken in the order of their proportion as long as the likelihood of the re-estimated smaller
mixture, less a penalty per language that grows with the logarithm of the number of letters, improves. The largest
proportion of the chosen set names the text.

Learning is one pass: every task adds up its counts, Spark adds them by language and bin, and a table of
languages x bins (at most `max_languages`, checked) reaches the driver.

Defined results: NULL texts and texts without a letter are `und` with score 0 and no proportions; rows with NULL
doc_id are never held out and never learned from; a NULL lang is not learned from; without any training row every text
is `und`; ties go to the first language in name order; repeated rows are each predicted. Extra columns pass through;
one named like an output is replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.arrow import add_columns, as_texts, narrow, slices

BITS = 15
SMOOTHING = 0.5
PENALTY = 3.0
ROUNDS = 12
MAX_LANGUAGES = 512
SLICE = 1 << 19
FEW_LETTERS = 20
UNKNOWN = "und"


@functools.cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def gram_bins(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the n-gram at every letter of the lower-cased texts, and each text's first letter (plus the end)."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le"), "<u4")
    letters = letter_table()[codes]
    plain = np.where(letters, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letters)
    with np.errstate(over="ignore"):
        h = (plain[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (plain[at] * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) + plain[at + 1] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    firsts = np.searchsorted(at, 1 + np.cumsum([0, *(len(t) + 1 for t in low)]))
    return (h >> np.uint64(64 - bits)).astype(np.int32), firsts


class Languages:
    """The learned distributions, and the inference for one text."""

    def __init__(self, names: list[str], counts: np.ndarray, bits: int = BITS):
        order = np.argsort(names, kind="stable")
        self.names = [names[k] for k in order]
        self.bits = bits
        total = counts[order].astype(float) + SMOOTHING
        # bins x languages: a text's rows lie together
        self.p = np.ascontiguousarray((total / total.sum(1, keepdims=True)).T) if len(order) else np.zeros((1 << bits, 0))

    @staticmethod
    def _em(like: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
        n = counts.sum()
        for _ in range(rounds):
            new = share * (like.T @ (counts / (like @ share))) / n
            if np.abs(new - share).max() < 1e-4:
                return new
            share = new
        return share

    def infer(self, bins: np.ndarray, penalty: float = PENALTY) -> tuple[list[tuple[str, float]], float]:
        """Chosen languages with proportions, largest first, and the mean log-likelihood of an n-gram."""
        k = len(self.names)
        if not k or not len(bins):
            return [], 0.0
        if len(bins) < 4096:
            found, counts = np.unique(bins, return_counts=True)
        else:
            every = np.bincount(bins, minlength=1 << self.bits)
            found = np.flatnonzero(every)
            counts = every[found]
        like = self.p[found]
        share = self._em(like, counts, np.full(k, 1 / k), ROUNDS)
        order = np.argsort(-share, kind="stable")
        cost = penalty * np.log(len(bins) + 1)
        best = None
        for size in range(1, k + 1):
            chosen = order[:size]
            part = like[:, chosen]
            now = share[chosen] + 1e-9
            mixed = self._em(part, counts, now / now.sum(), ROUNDS) if size > 1 else np.ones(1)
            fit = float(counts @ np.log(part @ mixed))
            if best and fit - cost * size <= best[0]:
                break
            best = fit - cost * size, chosen, mixed, fit / len(bins)
        _, chosen, mixed, mean = best
        down = np.argsort(-mixed, kind="stable")
        return [(self.names[chosen[j]], float(mixed[j])) for j in down], mean


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(False))


def learn(
    rows: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, max_languages: int = MAX_LANGUAGES
) -> Languages:
    """Distributions of all languages of all rows given."""
    slim = rows.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang IS NOT NULL")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                bins, firsts = gram_bins(as_texts(part, "text"), bits)
                for lang, a, b in zip(part.column(0).to_pylist(), firsts[:-1], firsts[1:]):
                    if lang not in totals:
                        if len(totals) == max_languages:
                            raise ValueError(f"more than {max_languages} languages: is {lang_col!r} a language column?")
                        totals[lang] = np.zeros(1 << bits, np.int64)
                    np.add.at(totals[lang], bins[a:b], 1)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * max(1, len(at))), pa.array(at if len(at) else [0], pa.int32()), pa.array(total[at] if len(at) else [0], pa.int64())],
                ["lang", "bin", "n"],
            )

    sums = slim.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    wide = sums.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("all")).limit(max_languages + 1).toArrow()
    if wide.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages: is {lang_col!r} a language column?")
    counts = np.zeros((wide.num_rows, 1 << bits), np.int64)
    for k, pairs in enumerate(wide.column("all")):
        flat = pairs.values
        counts[k, flat.field("bin").to_numpy()] = flat.field("n").to_numpy()
    return Languages(wide.column("lang").to_pylist(), counts, bits)


def predict(docs: DataFrame, model: Languages, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """`docs` with lang_pred, score (proportion of that language), langs and shares (the chosen set), and accepted.

    accepted is false for `und`, and for texts of twenty letters or more whose n-grams are less likely under their best
    mixture than if all bins were equally likely: no learned language explains them better than noise.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [
        ("lang_pred", T.StringType()),
        ("score", T.DoubleType()),
        ("langs", T.ArrayType(T.StringType())),
        ("shares", T.ArrayType(T.DoubleType())),
        ("accepted", T.BooleanType()),
    ]

    def start():
        languages = shared.value
        noise = -np.log(1 << languages.bits)

        def run(part):
            bins, firsts = gram_bins(as_texts(part, text_col), languages.bits)
            out = [[] for _ in fields]
            for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
                chosen, mean = languages.infer(bins[a:b], penalty)
                row = (
                    chosen[0][0] if chosen else UNKNOWN,
                    min(1.0, max(0.0, chosen[0][1])) if chosen else 0.0,
                    [c for c, _ in chosen],
                    [s for _, s in chosen],
                    bool(chosen) and (b - a < FEW_LETTERS or mean > noise),
                )
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return run

    return add_columns(docs, text_col, fields, start, SLICE)


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    training = rows.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    found = predict(narrow(rows), learn(training))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "langs", "shares", "accepted")
