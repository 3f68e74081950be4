"""Scans that go on where they stopped: what was asked, answered, or failed, by key.

Attempts arrive as files; a stream takes what is new, and keeps a state for each key in its
checkpoint: pending while every attempt has come back empty, done with the first answer. A
restart reads neither files nor attempts again. Results are upserted into a versioned table,
so that a batch that is run again after a crash changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridia.sources.versions import VersionedTable

STATE = "done boolean, attempts long, answer double"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Attempts in order of their number: those before the first answer count, and it."""
    done, attempts, answer = state.get if state.exists else (False, 0, None)
    if not done:
        empty, first = [], None
        for p in parts:
            told = p[p["answer"].notna()]
            if len(told):
                k = told["attempt"].idxmin()
                if first is None or told["attempt"][k] < first[0]:
                    first = int(told["attempt"][k]), float(told["answer"][k])
            empty.append(p.loc[p["answer"].isna(), "attempt"].to_numpy())
        attempts += sum(int((e < first[0]).sum()) if first else len(e) for e in empty)
        if first:
            done, attempts, answer = True, attempts + 1, first[1]
        state.update((done, attempts, answer))
        yield pd.DataFrame({"key": [key[0]], "done": [done], "attempts": [attempts], "answer": [answer]})


def scan(spark: SparkSession, arrivals: str, table: VersionedTable, checkpoint: str) -> None:
    """Takes in all files (key long, attempt long, answer double or null) that have arrived
    since the last call with this checkpoint, and upserts key, done, attempts, answer."""
    stream = spark.readStream.schema("key long, attempt long, answer double").parquet(arrivals)
    states = stream.groupBy("key").applyInPandasWithState(_advance, f"key long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)

    def sink(batch: DataFrame, _: int) -> None:
        table.upsert(batch, "key")

    states.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pending(table: VersionedTable) -> DataFrame:
    """Keys that no attempt has answered yet: what is to be asked again."""
    return table.read().where(~F.col("done")).select("key", "attempts")
