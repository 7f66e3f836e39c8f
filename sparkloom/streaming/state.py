"""Stateful stream operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(events: DataFrame, key: str, order: str, seq: str, value: str) -> DataFrame:
    """(key, seq, value, before) of the events whose value differs from that of
    the event before, by key; the first of a key is no change. The state is the
    last value of each key."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([order, seq])
        before = rows[value].shift()
        if state.exists:
            before.iloc[0] = state.get[0]
        state.update((rows[value].iloc[-1],))
        moved = before.notna() & (before != rows[value])
        yield pd.DataFrame({key: k[0], seq: rows[seq][moved], value: rows[value][moved], "before": before[moved]})

    return events.groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, {seq} {kinds[seq]}, {value} {kinds[value]}, before {kinds[value]}", f"last {kinds[value]}",
        "append", GroupStateTimeout.NoTimeout,
    )
