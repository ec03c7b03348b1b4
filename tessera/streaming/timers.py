"""Streams with state of several kinds and timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.streaming.windows import BUCKETS, bucket

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

GIVEN_UP = "user_id long, click_id long, given_up long"


def processor(patience_ms: int) -> StatefulProcessor:
    """The class is made here so that it travels by value: the process that reads its state's schema has no packages of ours."""

    class Abandoned(StatefulProcessor):
        """Gives out each click that no purchase of its user follows within the patience, for all users of a bucket at once.

        Open clicks and recent purchases are kept, since a click may arrive after its purchase, as
        one value of packed numbers. A timer stands at the end of the patience of a bucket's first open
        click; when the watermark has come to it, every purchase that could matter is there, so all clicks
        whose patience has ended by the watermark are settled, and the next timer is set. What is given out
        does not depend on how the stream is cut into batches. Purchases that no open or later click can see are
        dropped then.
        """

        def init(self, handle) -> None:
            self.handle = handle
            self.rows = handle.getValueState("rows", "clicks binary, purchases binary")

        def _held(self) -> tuple[np.ndarray, np.ndarray]:
            """(user, event, at) of each click and purchase."""
            if not self.rows.exists():
                return np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)
            return tuple(np.frombuffer(bytes(x), np.int64).reshape(-1, 3) for x in self.rows.get())

        def _keep(self, clicks: np.ndarray, bought: np.ndarray) -> None:
            if len(clicks) or len(bought):
                self.rows.update((clicks.tobytes(), bought.tobytes()))
            elif self.rows.exists():
                self.rows.clear()

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat(list(rows))  # of one bucket and one batch
            new = frame[["user_id", "event_id", "at"]].to_numpy(np.int64)
            is_click = (frame["event_type"] == "click").to_numpy()
            clicks, bought = self._held()
            self._keep(np.concatenate([clicks, new[is_click]]), np.concatenate([bought, new[~is_click]]))
            if is_click.any():
                self.handle.registerTimer(int(self._due(new[is_click, 2]).min()))
            else:  # there has to be some timer that drops purchases
                self.handle.registerTimer(int(self._due(new[:, 2]).max()))
            return iter(())

        def _due(self, at: np.ndarray) -> np.ndarray:
            """Timers are in milliseconds, times in microseconds; the first millisecond at which the patience is over."""
            return -(-at // 1000) + patience_ms

        def _followed(self, clicks: np.ndarray, bought: np.ndarray) -> np.ndarray:
            """Which clicks have a purchase of their user within the patience: the next one in the order of user, time and kind."""
            rows, buys = np.concatenate([clicks, bought]), np.arange(len(clicks) + len(bought)) >= len(clicks)
            order = np.lexsort((buys, rows[:, 2], rows[:, 0]))
            place = np.where(buys[order], np.arange(len(order)), len(order))
            after = np.minimum.accumulate(place[::-1])[::-1]
            found = np.flatnonzero(after < len(order))
            one, other = rows[order[found]], rows[order[after[found]]]
            out = np.zeros(len(order), bool)
            out[order[found]] = (one[:, 0] == other[:, 0]) & (other[:, 2] <= one[:, 2] + patience_ms * 1000)
            return out[: len(clicks)]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
            clicks, bought = self._held()
            over = self._due(clicks[:, 2]) <= now
            due, open_, seen = clicks[over], clicks[~over], bought[self._due(bought[:, 2]) > now]
            nobody = key[0] < 0  # the bucket of events without a user, which follow nothing
            out = due if nobody else due[~self._followed(due, bought)]
            if len(due) or len(seen) < len(bought):
                self._keep(open_, seen)
            if len(open_):
                self.handle.registerTimer(int(self._due(open_[:, 2]).min()))
            elif len(seen):
                self.handle.registerTimer(int(self._due(seen[:, 2]).max()))
            if len(out):
                users = pd.array([None] * len(out) if nobody else out[:, 0], "Int64")
                yield pd.DataFrame({"user_id": users, "click_id": out[:, 1], "given_up": out[:, 2] + patience_ms * 1000})

        def close(self) -> None:
            pass

    return Abandoned()


def abandoned(events: DataFrame, patience: str = "6 hours", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, click_id, given_up): clicks that were not followed by a purchase, given up at a time in microseconds.

    Users are dealt over buckets, whose number must not change over a stream's life: a task calls Python once for
    a bucket and batch, not for a user. The state is kept in RocksDB, which is set for the session if it is not.
    """
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    number, unit = patience.split()
    patience_ms = int(number) * {"minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}[unit]
    timed = events.where("event_type IN ('click', 'purchase')").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.where("ts IS NOT NULL").select(
        bucket("user_id", buckets).alias("bucket"), F.coalesce(F.col("user_id").cast("long"), F.lit(0).cast("long")).alias("user_id"), "event_id", "event_type", "ts", F.unix_micros("ts").alias("at")
    )
    return rows.groupBy("bucket").transformWithStateInPandas(processor(patience_ms), GIVEN_UP, "append", "eventTime")
