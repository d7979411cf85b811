"""The control chart over a stream of residuals: state is one number for each (turbine, target)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thermarc.cluster import ship

OUT = "turbine_id string, target string, timestamp timestamp, t long, ewma double, state int"


def stream_ewma(stream: DataFrame, limits: dict[str, float], lam: float = 0.2) -> DataFrame:
    """EWMA and state of each arriving row, in the order of time within a micro-batch. limits: target -> upper limit (a few)."""
    ship(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, t = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(frames)).sort_values("timestamp")
        x = pd.concat([pd.Series([z]), rows["normalized_residual"].fillna(0.0)], ignore_index=True)
        ewma = x.ewm(alpha=lam, adjust=False).mean().to_numpy()[1:]  # from the state on: z_t = lam x_t + (1 - lam) z_(t-1)
        state.update((float(ewma[-1]), t + len(ewma)))
        up = limits.get(key[1], float("inf"))
        side = (ewma > up).astype("int32") - (ewma < -up).astype("int32")
        yield pd.DataFrame({"turbine_id": key[0], "target": key[1], "timestamp": rows["timestamp"].values, "t": range(t + 1, t + 1 + len(ewma)), "ewma": ewma, "state": side})

    return stream.groupBy("turbine_id", "target").applyInPandasWithState(step, OUT, "z double, t long", "append", GroupStateTimeout.NoTimeout)
