"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

1. language: texts that hold no learned language go (no letters, or n-grams no likelier than noise).
2. near_duplicates: of each group of texts linked by a Jaccard similarity of 0.8 or more on five-word shingles, the row
   with the smallest doc_id stays.
3. benchmark: texts that hold a benchmark passage go.
4. personal_data: spans of personal data are replaced by their kind in brackets; all rows stay.
5. bpe: texts are encoded; the last stage gives doc_id, ids and their digests.

Every stage works on all rows of its predecessor. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.bpe import encode_texts
from riskframe.llm.decontaminate import remove_contaminated
from riskframe.llm.jaccard_join import keep_one
from riskframe.llm.language import learn, predict
from riskframe.llm.pii import redact
from riskframe.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return predict(docs, model).where("accepted").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="document")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs.select("doc_id", "text"), ids=True).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("bpe", bpe),
]

#: Language mixtures and BPE have no SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
