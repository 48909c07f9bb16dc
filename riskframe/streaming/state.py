"""Streaming velocity on keyed state: totals per second of an entity's last window, dropped by event time.

A row goes to the key (entity column, bucket of entities, chunk) of its own time chunk, of the longest window's length, and
as history to that of the next chunk. So a key's window is always inside its own state, and a hot entity is spread over
chunks. The state of a key holds the entities' names and one (place, count, sum) per entity and distinct second that a row
to come can still see; a timer removes it when the watermark passes the chunk's end, after which no row of the chunk can
arrive. Entities share keys by a hash, since each key costs a call and a state of its own: the number of calls does not
grow with the entities, and a call works on all rows of its bucket at once. Names, not hashes, tell them apart.

Rows later than the watermark at the start of the batch before are dropped (with both copies), as Spark's stateful
operators do; that bound is the newest time of the batches before it less `lateness`. A row sees what has
arrived in its own or an earlier micro-batch; what has been written is not amended. Replayed in order, the result is
that of the batch operator, exactly: sums are taken over whole units of the amount's last decimal.

Defined results: NULL entities are one group; NULL, NaN and infinite amounts count as missing; a row without a time sees
nothing and is seen by nothing; rows of the same second do not see each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import DAY
from riskframe.operators.velocity import ENTITY_COLS, VELOCITY_WINDOWS
from riskframe.schema import AMOUNT, ID, TIME, present, require

STATE = "names array<string>, seconds binary"
#: Keys per entity column and chunk. A bucket's rows of one chunk and of the one before must fit into a task.
BUCKETS = 256
#: Added to the seconds for the watermark alone, which begins at the epoch and would drop times before it.
SHIFT = 1 << 32


def _packed(names: Sequence[str | None], table: np.ndarray, span: int) -> tuple[list[str | None], bytes]:
    """Only names that still have rows are kept, renumbered."""
    used, code = np.unique(table[:, 0] // span, return_inverse=True)
    table = np.column_stack([code * span + table[:, 0] % span, table[:, 1:]])
    return [names[k] for k in used], table.astype("<i8").tobytes()


def _unpacked(state) -> tuple[list[str | None], np.ndarray]:
    """Names, and rows (place, count, sum) sorted by place: the name's number x span + the second within the span."""
    if not state.exists:
        return [], np.zeros((0, 3), np.int64)
    names, seconds = state.get
    return list(names), np.frombuffer(seconds, "<i8").reshape(-1, 3)


def _codes(values: pd.Series, places: dict[str | None, int]) -> np.ndarray:
    """Number of each row's entity; new ones are added to `places`. NULL is an entity like any other."""
    codes, found = pd.factorize(values, use_na_sentinel=False)
    return np.array([places.setdefault(None if pd.isna(v) else v, len(places)) for v in found], np.int64)[codes]


def merged(tables: Sequence[np.ndarray]) -> np.ndarray:
    """One row per place, sorted."""
    rows = np.concatenate(tables)
    found, at = np.unique(rows[:, 0], return_inverse=True)
    out = np.zeros((len(found), 3), np.int64)
    out[:, 0] = found
    np.add.at(out[:, 1:], at, rows[:, 1:])
    return out


def seen(table: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum over `[t - width, t)` for each place; the span of an entity is wider than any window before its rows."""
    totals = np.zeros((len(table) + 1, 2), np.int64)
    np.cumsum(table[:, 1:], axis=0, out=totals[1:])
    first, last = (np.searchsorted(table[:, 0], t) for t in (at - width, at))
    return tuple((totals[last] - totals[first]).T)


def velocity_state(
    stream: DataFrame,
    entity_cols: Sequence[str] = ENTITY_COLS,
    windows: Mapping[str, int] = VELOCITY_WINDOWS,
    lateness: int = DAY,
    amount_scale: int = 2,
    id_col: str = ID,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(id, entity, and per window count_<w>, sum_<w>) of each row of a stream and each entity column.

    `wide_velocity` turns the stored result into the columns of the batch operator. Append mode only.
    """
    require(stream, [id_col, TIME, AMOUNT], "velocity")
    entities = present(stream, entity_cols, "velocity")
    longest, labels, widths = max(windows.values()), list(windows), list(windows.values())
    amount = F.col(AMOUNT).cast("double")
    units = F.when(~F.isnan(amount) & (F.abs(amount) < float("inf")), F.round(amount * 10**amount_scale).cast("long"))
    kinds = F.array(*[F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("value")) for e in entities])
    rows = stream.select(F.col(id_col), F.col(TIME).cast("long").alias("t"), units.alias("units"), F.inline(kinds))
    timed = rows.where("t IS NOT NULL").withColumn("at", F.timestamp_seconds(F.col("t") + SHIFT)).withWatermark("at", f"{lateness} seconds")
    dealt = timed.withColumn("history", F.explode(F.array(F.lit(0), F.lit(1))))
    dealt = dealt.withColumn("chunk", F.floor(F.col("t") / longest) + F.col("history"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    span = 3 * longest
    id_type = rows.schema[id_col].dataType
    numbers = [T.StructField(f"{stat}_{w}", T.LongType()) for w in labels for stat in ("count", "units")]
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("entity", T.StringType()), *numbers])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, table = _unpacked(state)
        places, tables, own = {v: k for k, v in enumerate(names)}, [table], []
        # rows are of this chunk and the one before, so a window begins within the span too
        origin = (int(key[2]) - 2) * longest
        for f in frames:
            at = _codes(f["value"], places) * span + (f["t"].to_numpy(np.int64) - origin)
            counted = f["units"].notna().to_numpy()
            if counted.any():
                tables.append(merged([np.stack([at[counted], np.ones(counted.sum(), np.int64), f["units"][counted].to_numpy(np.int64)], axis=1)]))
            mine = (f["history"] == 0).to_numpy()
            own.append((f.loc[mine, id_col], at[mine]))
        table = merged(tables)
        watermark = state.getCurrentWatermarkMs()
        # rows of later batches are not older than this watermark
        limit = watermark // 1000 - SHIFT - longest
        state.update(_packed(list(places), table[table[:, 0] % span + origin >= limit], span))
        state.setTimeoutTimestamp(max(((int(key[2]) + 1) * longest + SHIFT) * 1000, watermark + 1))
        for ids, at in own:
            if len(ids):
                out = {id_col: ids, "entity": key[0]}
                for label, width in zip(labels, widths):
                    out[f"count_{label}"], out[f"units_{label}"] = seen(table, at, width)
                yield pd.DataFrame(out)

    made = dealt.groupBy("entity", "bucket", "chunk").applyInPandasWithState(update, schema, STATE, "append", "EventTimeTimeout")
    nothing = rows.where("t IS NULL").select(id_col, "entity", *[F.lit(0).cast("long").alias(f.name) for f in numbers])
    both = made.unionByName(nothing)
    sums = [F.col(f"units_{w}") / float(10**amount_scale) for w in labels]
    return both.select(id_col, "entity", *[F.col(f"count_{w}") for w in labels], *[s.alias(f"sum_{w}") for s, w in zip(sums, labels)])


def wide_velocity(
    stored: DataFrame, entity_cols: Sequence[str] = ENTITY_COLS, windows: Mapping[str, int] = VELOCITY_WINDOWS, id_col: str = ID
) -> DataFrame:
    """One row per id with the batch operator's columns `vel_<entity>_<window>_{count,sum,mean_amt}`."""
    made = []
    for e in entity_cols:
        for w in windows:
            count, total = (F.max(F.when(F.col("entity") == e, F.col(f"{stat}_{w}"))) for stat in ("count", "sum"))
            made += [count.alias(f"vel_{e}_{w}_count"), total.alias(f"vel_{e}_{w}_sum")]
            made.append(F.when(count > 0, total / count).otherwise(F.lit(0.0)).alias(f"vel_{e}_{w}_mean_amt"))
    return stored.groupBy(id_col).agg(*made)
