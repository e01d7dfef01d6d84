"""Ref updates as a stream: the state of each (repo_id, name) is its current value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hashgrove.operators.refs import STATE, ZERO, next_reason


def apply_stream(commands: DataFrame) -> DataFrame:
    """Outcomes of a stream of commands (repo_id, name, pos, old_oid, new_oid); in a micro-batch they are taken by pos."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("pos")
        reasons, after = [], []
        for old, new in zip(rows.old_oid, rows.new_oid):
            reason = next_reason(held, old, new)
            held = held if reason else None if new == ZERO else new
            reasons.append(reason)
            after.append(held)
        if held is None:
            state.remove() if state.exists else None
        else:
            state.update((held,))
        yield pd.DataFrame({"repo_id": key[0], "name": key[1], "pos": rows.pos.to_numpy(), "reason": reasons, "held": after})

    return commands.groupBy("repo_id", "name").applyInPandasWithState(run, STATE, "held string", "append", GroupStateTimeout.NoTimeout)
