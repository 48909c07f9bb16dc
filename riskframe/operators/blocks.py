"""Feature blocks: each adds a fixed set of columns to a transaction DataFrame and keeps all others."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.operators.encoders import (
    ADDRESS_COLS,
    ADDRESS_ENTITY,
    AMOUNT_ENTITIES,
    AddressEncoders,
    AmountEncoders,
    compute_address_features,
    compute_spend_spike_features,
    fit_address_encoders,
    fit_amount_encoders,
)
from riskframe.schema import AMOUNT, TIME, identity_columns, require

logger = logging.getLogger(__name__)


def compute_temporal_features(df: DataFrame, narrow: bool = False) -> DataFrame:
    require(df, [TIME], "temporal")
    seconds = F.col(TIME)
    hour, day = C.hour_of_day(seconds), C.day_of_week(seconds)
    added = {
        "hour_of_day": hour,
        "day_of_week": day,
        "day_of_dataset": C.day_of_dataset(seconds),
        "is_night": C.is_night(hour),
        "is_weekend": C.is_weekend(day),
    }
    if narrow:
        added = {k: v.cast("short" if k == "day_of_dataset" else "byte") for k, v in added.items()}
    return df.withColumns(added)


def compute_amount_features(df: DataFrame, narrow: bool = False) -> DataFrame:
    require(df, [AMOUNT], "amount")
    amount = F.col(AMOUNT).cast("double")
    added = {
        "log1p_amt": F.log1p(amount),
        "amt_cents": C.amount_cents(amount),
        "is_round_amount": C.is_round_amount(amount),
    }
    if narrow:
        added = {k: v.cast("byte" if k.startswith("is_") else "float") for k, v in added.items()}
    return df.withColumns(added)


def compute_behavioral_features(
    df: DataFrame,
    encoders: AmountEncoders | None = None,
    entity_cols: Sequence[str] = AMOUNT_ENTITIES,
    narrow: bool = False,
) -> DataFrame:
    """Temporal, amount and spend-spike features. Without encoders they are fitted on `df` (train only)."""
    if encoders is None:
        encoders = fit_amount_encoders(df, entity_cols)
    out = compute_amount_features(compute_temporal_features(df, narrow), narrow)
    return compute_spend_spike_features(out, encoders, entity_cols, narrow)


def compute_email_features(df: DataFrame) -> DataFrame:
    """Mismatch flags between purchaser and recipient mail domains. An absent column acts as all NULL."""
    domain = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    sender, receiver = domain("P_emaildomain"), domain("R_emaildomain")
    p_token, r_token = C.email_token(sender), C.email_token(receiver)
    p_free, r_free = C.is_free_email(p_token), C.is_free_email(r_token)
    return df.withColumns(
        {
            "email_match": C.both_equal(F.lower(sender), F.lower(receiver)),
            "p_email_tld": p_token,
            "r_email_tld": r_token,
            "email_tld_match": (p_token == r_token).cast("int"),
            "p_email_is_free": p_free,
            "r_email_is_free": r_free,
            "both_free_email": (p_free * r_free).cast("int"),
        }
    )


def compute_identity_presence_features(df: DataFrame) -> DataFrame:
    cols = identity_columns(df.columns)
    if not cols:
        logger.warning("identity presence: no identity columns found")
        return df.withColumns({"has_identity": F.lit(0), "identity_completeness": F.lit(0.0)})
    share = C.filled_share([F.col(c) for c in cols])
    return df.withColumns({"has_identity": (share > 0).cast("int"), "identity_completeness": share})


def compute_identity_features(
    df: DataFrame,
    address_encoders: AddressEncoders | None = None,
    entity_col: str = ADDRESS_ENTITY,
    addr_cols: Sequence[str] = ADDRESS_COLS,
    narrow: bool = False,
) -> DataFrame:
    """Mail, address-consistency and identity-presence features; `narrow` stores numbers in 32 bits at most."""
    if address_encoders is None:
        address_encoders = fit_address_encoders(df, entity_col, addr_cols)
    out = compute_address_features(compute_email_features(df), address_encoders, entity_col, addr_cols)
    out = compute_identity_presence_features(out)
    if not narrow:
        return out
    smaller = {"bigint": "int", "double": "float"}
    made = [c for c in out.columns if c not in df.columns]
    types = dict(out.dtypes)
    return out.withColumns({c: F.col(c).cast(smaller[types[c]]) for c in made if types[c] in smaller})
