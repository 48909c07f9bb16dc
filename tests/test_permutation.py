import pytest
from pyspark.sql import functions as F

from riskframe.models import attribution


@pytest.mark.parametrize("n", [1, 30, 2000])
def test_the_permutation_does_not_depend_on_the_groups(spark, n):
    rows = spark.range(n).select(F.col("id").alias("TransactionID"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("x"))
    one, many, few_rows = (
        {r["TransactionID"]: r["perm_x"] for r in attribution.permuted_columns(rows, ["x"], **how).collect()}
        for how in ({"groups": 1}, {"groups": 64}, {"group_rows": 100})
    )
    assert one == many == few_rows and len(one) == n
    assert sorted(map(str, one.values())) == sorted(str(k if k % 7 else None) for k in range(n))
