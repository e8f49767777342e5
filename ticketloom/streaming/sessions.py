"""Chat sessions: as a batch rollup and as keyed state on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_rollup(turns: DataFrame, session: str = "conv_id") -> DataFrame:
    """(session, turns, user_turns, last_turn, transcript): messages in the order of their turns.

    A session is gathered into one row, as its transcript is one value; sessions are as long as people talk.
    """
    m = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    x = turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"), m.alias("_m"))
    line = F.transform("_m", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return x.select(session, "turns", "user_turns", "last_turn", F.array_join(line, "\n").alias("transcript"))


SESSION_OUT = "session_id string, messages long, last_role string, min_cluster_size int, epsilon double"
SESSION_STATE = "messages long, last_role string, min_cluster_size int, epsilon double"


def track_sessions(messages: DataFrame, idle_ms: int = 3_600_000, order: str | None = None) -> DataFrame:
    """messages (session_id, role, content, min_size, epsilon; the last two from functions.intents.parameter): running
    state of each session. Messages of one batch count in the order of the column `order`, if it is named; a session's
    messages of one batch are gathered for that. After idle_ms without a message the state is dropped;
    such timeouts need batches without data, so run it with a processing-time trigger."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        n, role, size, eps = state.get if state.exists else (0, "", None, None)
        for f in [pd.concat(list(frames)).sort_values(order, kind="stable")] if order else frames:
            n += len(f)
            if len(f):
                role = f.role.iloc[-1]
                size = next((int(x) for x in reversed(f.min_size.tolist()) if x == x and x), size)
                eps = next((float(x) for x in reversed(f.epsilon.tolist()) if x == x and x), eps)
        state.update((n, role, size, eps))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [key[0]], "messages": [n], "last_role": [role], "min_cluster_size": pd.array([size], dtype="Int32"), "epsilon": pd.array([eps], dtype="Float64")})

    return messages.groupBy("session_id").applyInPandasWithState(step, SESSION_OUT, SESSION_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
