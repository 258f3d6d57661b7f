"""The life cycle of import records over a stream of status events (an extension: the batch fold is in
``lonja.operators.tracker``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lonja.functions.rules import STATUSES, TERMINAL

_NEXT = dict(zip(STATUSES[:-2], STATUSES[1:-1]))


def follow(events: DataFrame, key: str = "record", target: str = "target", order: str = "seq") -> DataFrame:
    """(record, status, accepted, rejected) of the records that a micro-batch touches, after its events in order.

    State of a record is its status and two counts; events that are not allowed change the count only. Events must reach
    a record in order across micro-batches; within one they are sorted."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, accepted, rejected = state.get if state.exists else ("ordered", 0, 0)
        rows = pd.concat(list(frames)).sort_values([order, target])
        for wanted in rows[target]:
            if status not in TERMINAL and wanted in ("cancelled", _NEXT.get(status)):
                status, accepted = wanted, accepted + 1
            else:
                rejected += 1
        state.update((status, accepted, rejected))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "accepted": [accepted], "rejected": [rejected]})

    kind = events.schema[key].dataType.simpleString()
    fields = "status string, accepted long, rejected long"
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {fields}", fields, "update", "NoTimeout")
