"""A cache in front of a costly call, as a stateful stream: each miss is called for once, answers are kept until they expire.

Events are rows (key, kind, id, payload, tokens, ts) of two kinds: a ``request``, and the ``answer`` to a call, which comes back through the same stream. For a request
the outcome is ``hit`` with the stored payload at no cost, ``call`` if it is the first to miss, or ``wait`` if a call is under way. Calls and waits carry a version; the
``answer`` row, with the tokens of the call, carries the same one, and waiting requests are answered by a join on key and version. So the state of a
key is one answer, whatever the number of those that wait for it.

State survives restarts with the stream's checkpoint. It expires by event time; a call that is not answered within ``patience`` is
made again by the next request.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "key string, version bigint, outcome string, id string, payload string, tokens bigint, ts timestamp"
#: Version of the last call, whether it is open, its answer, and when answer or patience end, in milliseconds.
STATE = "version bigint, open boolean, payload string, until bigint"


def answered_once(events: DataFrame, ttl: timedelta, patience: timedelta = timedelta(minutes=10), late: str = "10 minutes") -> DataFrame:
    """Outcomes of requests and answers; events of a key are taken in order of their time within each batch of rows."""
    keep, wait = int(ttl.total_seconds() * 1000), int(patience.total_seconds() * 1000)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, open_, payload, until = state.get if state.exists else (0, False, None, 0)
        for batch in batches:
            out = []
            for row in batch.sort_values("ts", kind="stable").itertuples(index=False):
                now = row.ts.value // 1_000_000
                if row.kind == "answer":
                    open_, payload, until = False, row.payload, now + keep
                    out.append((group[0], version, "answer", row.id, row.payload, row.tokens, row.ts))
                elif not open_ and payload is not None and now < until:
                    out.append((group[0], version, "hit", row.id, payload, 0, row.ts))
                elif open_ and now < until:
                    out.append((group[0], version, "wait", row.id, None, 0, row.ts))
                else:
                    version, open_, payload, until = version + 1, True, None, now + wait
                    out.append((group[0], version, "call", row.id, None, 0, row.ts))
            yield pd.DataFrame(out, columns=["key", "version", "outcome", "id", "payload", "tokens", "ts"])
        state.update((version, open_, payload, until))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)
