"""Principal components of the vendor block: median imputation, scaling, MLlib PCA."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.coding import Scaler, impute_median, median_table
from riskframe.operators.sampling import sample_exact
from riskframe.schema import ID, LABEL, vendor_columns


@dataclass(frozen=True)
class BlockPCA:
    model: PCAModel
    projected: DataFrame
    explained: list[float]


def pca_block(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    components: int = 2,
    sample_rows: int | None = None,
    id_col: str = ID,
    keep: Sequence[str] = (ID, LABEL),
) -> BlockPCA:
    """Components of all rows; `projected` has `keep` and pc1..pcK of every row, `explained` the variance shares.

    MLlib sums one p x p matrix per task. `sample_rows` fits on that many rows instead; all rows are still projected.
    """
    names = list(columns or vendor_columns(df.columns))
    rows = df.select(*dict.fromkeys([*([] if sample_rows is None else [id_col]), *keep, *names]))
    sample = rows if sample_rows is None else sample_exact(rows, sample_rows, id_col)
    medians = median_table(sample, names)
    scaler = Scaler.fit(impute_median(sample, names, medians), names)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    vectors = lambda part: assembler.transform(scaler.transform(impute_median(part, names, medians), keep=list(keep)))
    model = PCA(k=components, inputCol="features", outputCol="pc").fit(vectors(sample))
    parts = model.transform(vectors(rows)).withColumn("pc", vector_to_array("pc"))
    projected = parts.select(*keep, *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(components)])
    return BlockPCA(model, projected, [float(v) for v in model.explainedVariance])
