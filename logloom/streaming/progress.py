"""Progress of rollouts over a stream of turns, with state kept for each rollout.

The state is the best potential so far and the facts already covered, so a turn
that is replayed earns nothing a second time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "rollout string, turn int, new_progress double, new_facts int"
STATE = "best double, last_turn int, facts array<string>"


def _update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best, last, facts = state.get if state.exists else (0.0, -1, [])
    seen = set(facts or [])
    rows = pd.concat(list(frames)).sort_values("turn")
    out = []
    for turn, potential, observed in zip(rows["turn"], rows["potential"], rows["facts"], strict=True):
        if turn <= last:
            continue
        fresh = set(observed if observed is not None else []) - seen
        seen |= fresh
        gained = max(float(potential) - best, 0.0)
        best, last = max(best, float(potential)), int(turn)
        out.append((key[0], last, gained, len(fresh)))
    state.update((best, last, sorted(seen)))
    yield pd.DataFrame(out, columns=["rollout", "turn", "new_progress", "new_facts"])


def rollout_progress(turns: DataFrame) -> DataFrame:
    """``rollout, turn, new_progress, new_facts`` for a stream of ``rollout, turn, potential, facts``."""
    return turns.groupBy("rollout").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
