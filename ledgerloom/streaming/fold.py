"""The graph fold as a stateful stream: a session's graph is its state, turns are its input."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import Fold

OUT = "session string, turn long, nodes long, edges long, conflicts long"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, expected, waiting = state.get if state.exists else (None, 0, "[]")
    graph = Fold(held)
    pending = {int(t): (e, k) for t, e, k in json.loads(waiting)}
    for frame in frames:
        for r in frame.itertuples(index=False):
            if int(r.turn) >= expected:
                pending.setdefault(int(r.turn), (r.entities, r.links))
    while expected in pending:
        entities, links = pending.pop(expected)
        graph.turn(str(key[0]), expected, json.loads(entities), [tuple(x) for x in json.loads(links)])
        expected += 1
    state.update((graph.state(), expected, json.dumps([[t, *x] for t, x in sorted(pending.items())])))
    yield pd.DataFrame([(str(key[0]), expected - 1, len(graph.nodes), len(graph.edges), len(graph.conflicts))], columns=["session", "turn", "nodes", "edges", "conflicts"])


def fold_stream(turns: DataFrame) -> DataFrame:
    """Graph sizes of each session that a micro-batch touched, after its last turn that could be folded (-1: none yet).

    Turns number from 0 without gaps. One that comes early waits in the state for those before it, so the graph is that of the
    batch fold however turns arrive; one that comes again is passed over.
    """
    return turns.groupBy("session").applyInPandasWithState(_update, OUT, "state string, expected long, waiting string", "update", GroupStateTimeout.NoTimeout)
