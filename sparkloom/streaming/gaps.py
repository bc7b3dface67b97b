"""Gap classes on a stream: the last time of each key is kept as state.

An extension of :func:`sparkloom.operators.ordered.time_gaps` for records that
arrive over time. Rows of one key are ordered by time inside a micro-batch; a
row that is earlier than the key's last one is late and gets no gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.ordered import classify_gaps


def stream_gaps(stream: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """(key, tie, ts, gap_us, gap_class) for each row of a stream, append mode."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.select(key, tie, F.col(ts).cast("timestamp").alias(ts))

    def gaps(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values([ts, tie])
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else pd.NaT
        times = pdf[ts].dt.tz_localize(None) if pdf[ts].dt.tz is not None else pdf[ts]
        before = times.shift(1)
        before.iloc[0] = last
        gap = (times - before) // pd.Timedelta(microseconds=1)
        pdf["gap_us"] = gap.where(gap >= 0).astype("Int64")
        newest = times.max() if pd.isna(last) else max(last, times.max())
        state.update((newest.value // 1000,))
        yield pdf

    out = rows.groupBy(key).applyInPandasWithState(
        gaps,
        f"{key} {kinds[key]}, {tie} {kinds[tie]}, {ts} timestamp, gap_us long",
        "last_us long",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return classify_gaps(out)
