"""Column names, the declared schema of the two input tables and column checks."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

logger = logging.getLogger(__name__)

ID = "TransactionID"
TIME = "TransactionDT"
AMOUNT = "TransactionAmt"
LABEL = "isFraud"

# Input column names and types.
CORE_TYPES: dict[str, T.DataType] = {
    "TransactionID": T.LongType(),
    "TransactionDT": T.LongType(),
    "TransactionAmt": T.DoubleType(),
    "isFraud": T.IntegerType(),
    "ProductCD": T.StringType(),
    "card1": T.LongType(),
    "card2": T.LongType(),
    "card3": T.LongType(),
    "card4": T.StringType(),
    "card5": T.LongType(),
    "card6": T.StringType(),
    "addr1": T.LongType(),
    "addr2": T.LongType(),
    "dist1": T.DoubleType(),
    "dist2": T.DoubleType(),
    "P_emaildomain": T.StringType(),
    "R_emaildomain": T.StringType(),
    "DeviceType": T.StringType(),
    "DeviceInfo": T.StringType(),
}
IDENTITY_PREFIXES = ("id_", "DeviceType", "DeviceInfo")
# Numbers of the id columns that hold numbers; the others hold text.
NUMERIC_ID_COLUMNS = frozenset([*range(1, 12), 13, 14, *range(17, 23), 24, 25, 26, 32])


def column_type(name: str) -> T.DataType:
    """Type of a column by its name: core columns, then the anonymous numbered families."""
    if name in CORE_TYPES:
        return CORE_TYPES[name]
    if name.startswith("id_") and name[3:].isdigit():
        return T.DoubleType() if int(name[3:]) in NUMERIC_ID_COLUMNS else T.StringType()
    if name[:1] in ("V", "C", "D") and name[1:].isdigit():
        return T.DoubleType()
    return T.StringType()


def identity_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c.startswith(IDENTITY_PREFIXES)]


def vendor_columns(columns: Iterable[str]) -> list[str]:
    """The anonymous `V1 .. Vn` block."""
    return [c for c in columns if c[:1] == "V" and c[1:].isdigit()]


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN of float columns counts as missing everywhere: it becomes NULL. Other columns stay as they are."""
    chosen = None if columns is None else set(columns)
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (chosen is None or f.name in chosen)
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def require(df: DataFrame, columns: Sequence[str], owner: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{owner}: required columns missing from DataFrame: {missing}")


def present(df: DataFrame, columns: Sequence[str], owner: str) -> list[str]:
    """Optional columns that exist; the others are reported and skipped."""
    for name in columns:
        if name not in df.columns:
            logger.warning("%s: column '%s' is not in the DataFrame, skipped", owner, name)
    return [c for c in columns if c in df.columns]
