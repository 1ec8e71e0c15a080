"""Live bar updates: finality, per-dataset order, and the merge of a snapshot with buffered events.

Late data is an error here, so no watermark is set and nothing is dropped: an update that goes back in time fails the
query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.timebar import TimeBar
from barloom.operators.quality import valid_update

GRACE_MS = 5000


def finality(start_ms: Column, received_ms: Column, timeframe: str) -> Column:
    """forming before the bar's end, provisional in the grace after it, then final. Stateless."""
    end = TimeBar.parse(timeframe).next_col(start_ms)
    return F.when(received_ms < end, "forming").when(received_ms < end + GRACE_MS, "provisional").otherwise("final")


def checked(updates: DataFrame) -> DataFrame:
    """Updates as they are; an invalid one raises when its row is read."""
    ok = F.when(valid_update(), True).otherwise(F.raise_error(F.concat(F.lit("invalid update of "), F.col("symbol"))).cast("boolean"))
    return updates.withColumn("ok", ok).where("ok").drop("ok")


def normalized(updates: DataFrame, timeframe: str) -> DataFrame:
    """Checked updates with their finality. No revision is dropped."""
    return checked(updates).withColumn("finality", finality(F.unix_millis("timestamp"), F.unix_millis("received"), timeframe))


def backward_steps(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Batch form of the order check: updates whose bar lies before the one that came before."""
    w = Window.partitionBy(*keys).orderBy("seq")
    ms = F.unix_millis("timestamp")
    return updates.withColumn("before", F.lag(ms).over(w)).where(F.col("before") > ms)


def ordered(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The stream as it is, failing once a dataset's bars go back; equal starts are revisions and pass.

    State is one moment per dataset. Rows of a micro-batch are taken in the order of `seq`.
    """
    columns = updates.columns

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        last = state.get[0] if state.exists else None
        for at in rows["timestamp"].map(lambda t: int(t.timestamp() * 1000)):
            if last is not None and at < last:
                raise ValueError(f"{key}: a bar of {at} came after {last}")
            last = at
        state.update((last,))
        yield rows[columns]

    return updates.groupBy(*keys).applyInPandasWithState(check, updates.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def bootstrap(snapshot: DataFrame, buffered: DataFrame, keys: list[str]) -> DataFrame:
    """Recent closed bars and the buffered events as one list: a live value wins, the last of several; ascending."""
    both = snapshot.withColumn("live", F.lit(0)).unionByName(buffered.withColumn("live", F.lit(1)))
    w = Window.partitionBy(*keys, "timestamp").orderBy(F.desc("live"), F.desc("seq"))
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "live").orderBy(*keys, "timestamp")
