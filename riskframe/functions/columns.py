"""Row-wise feature expressions. Each function returns a Column; nothing here touches a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY, WEEK = 3_600, 86_400, 604_800

# First token of the domains of free mail providers.
FREE_EMAIL_PROVIDERS = (
    "gmail", "yahoo", "hotmail", "outlook", "aol", "icloud",
    "live", "msn", "protonmail", "ymail", "mail", "gmx",
    "zoho", "inbox", "yandex", "qq", "163", "126",
)
NIGHT = (0, 5)
WEEKEND = (5, 6)
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
RATIO_FLOOR = 1e-6
ZSCORE_LIMIT = 5.0


def hour_of_day(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / HOUR), F.lit(24)).cast("int")


def day_of_week(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / DAY), F.lit(7)).cast("int")


def day_of_dataset(seconds: Column) -> Column:
    return F.floor(seconds / DAY).cast("int")


def week_index(seconds: Column) -> Column:
    return F.floor(seconds / WEEK).cast("int")


def is_night(hour: Column) -> Column:
    return hour.between(*NIGHT).cast("int")


def is_weekend(day: Column) -> Column:
    return day.isin(*WEEKEND).cast("int")


def day_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), day + 1)


def amount_cents(amount: Column) -> Column:
    """Fractional part to two digits, half to even; may reach 1.00."""
    return F.bround(F.pmod(amount, F.lit(1.0)), 2)


def is_round_amount(amount: Column) -> Column:
    return (F.pmod(amount, F.lit(10.0)) == 0).cast("int")


def mean_ratio(amount: Column, mean: Column) -> Column:
    return amount / F.greatest(mean, F.lit(RATIO_FLOOR))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds a value; NULL stays NULL (least and greatest alone would skip it)."""
    bounded = value
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    return F.when(value.isNotNull(), bounded)


def zscore(amount: Column, mean: Column, std: Column) -> Column:
    """Deviation in units of std, clipped; NULL only where the amount is. `mean` and `std` are never NULL."""
    score = (amount - mean) / F.greatest(std, F.lit(RATIO_FLOOR))
    bounded = F.greatest(F.least(score, F.lit(ZSCORE_LIMIT)), F.lit(-ZSCORE_LIMIT))
    return F.when(amount.isNotNull(), bounded)


def email_token(domain: Column) -> Column:
    """Lower-cased first label of a mail domain; NULL becomes `unknown`."""
    return F.coalesce(F.split_part(F.lower(domain), F.lit("."), F.lit(1)), F.lit("unknown"))


def is_free_email(token: Column) -> Column:
    return token.isin(*FREE_EMAIL_PROVIDERS).cast("int")


def both_equal(left: Column, right: Column) -> Column:
    """1 where both sides are present and equal, else 0."""
    return F.coalesce(left == right, F.lit(False)).cast("int")


def filled_share(columns: Sequence[Column]) -> Column:
    """Share of the given columns that are not NULL."""
    filled = columns[0].isNotNull().cast("int")
    for column in columns[1:]:
        filled = filled + column.isNotNull().cast("int")
    return filled / float(len(columns))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def direction(weight: Column) -> Column:
    return F.when(weight > 0, "increases fraud risk").otherwise("decreases fraud risk")


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)
