"""Debounced publication: a document's diagnostics once its edits have been quiet for a while, by timers in keyed state.

Each request arms its document's timer anew, whether it comes in the same micro-batch or a later one, and only the greatest epoch is remembered; when the timer
runs out the epoch is due, once. State is one row a document and outlives restarts with the stream's checkpoint. What is due is computed only if its epoch is
still the current one, and published only if it still is when the result is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.plans.fixpoint import cut
from glossa.streaming.workspace import publishable

#: How long a document must be quiet before its diagnostics are published, and the workspace before code lenses are refreshed. Fixed values.
DIAGNOSTICS_MS, LENSES_MS = 150, 75
STATE = "epoch long, fired long"


def debounced(requests: DataFrame, quiet_ms: int = DIAGNOSTICS_MS) -> DataFrame:
    """doc, epoch of a stream of requests (doc, epoch), each document's last epoch once nothing has come for quiet_ms.

    Requests of an epoch that is known already, or without one, arm nothing. A request without a document belongs to the document null.
    """

    def timed(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        epoch, fired = state.get if state.exists else (-1, -1)
        if state.hasTimedOut:
            if epoch > fired:
                state.update((epoch, epoch))
                yield pd.DataFrame({"doc": [key[0]], "epoch": [epoch]})
            return
        newest = max((int(e) for rows in batches for e in rows["epoch"].dropna()), default=-1)
        if newest > epoch:
            state.update((newest, fired))
            state.setTimeoutDuration(quiet_ms)
        elif epoch > fired:  # the timer that runs would be lost
            state.update((epoch, fired))
            state.setTimeoutDuration(quiet_ms)

    return requests.select("doc", "epoch").groupBy("doc").applyInPandasWithState(timed, "doc string, epoch long", STATE, "append", "ProcessingTimeTimeout")


def debounced_lenses(requests: DataFrame, quiet_ms: int = LENSES_MS) -> DataFrame:
    """The same with one timer for the whole workspace: requests (epoch)."""
    return debounced(requests.select(F.lit("workspace").alias("doc"), "epoch"), quiet_ms)


class Publisher:
    """What a micro-batch does with epochs that are due: infer(due: doc, epoch) gives results (doc, epoch, ...), publish(results) hands them on.

    current() gives the documents' epochs (doc, epoch) as they are now; it is asked before inference and again after.
    """

    def __init__(self, current: Callable[[], DataFrame], infer: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame], None]):
        self.current, self.infer, self.publish = current, infer, publish

    def __call__(self, batch: DataFrame, number: int) -> None:
        wanted = cut(publishable(batch, self.current()))
        if wanted.isEmpty():
            return
        results = cut(self.infer(wanted))
        self.publish(publishable(results, self.current()))


def run(due: DataFrame, publisher: Publisher, checkpoint: str, every_ms: int = 50):
    """The streaming query of a debounced stream. Timers run out at the next micro-batch, and there is one every every_ms."""
    return due.writeStream.foreachBatch(publisher).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{every_ms} milliseconds").start()
