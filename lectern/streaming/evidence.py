"""The evidence log as streams: appends, reads by dwell time, encounters once a day, the status machine, tail windows, live counts.

The log has no rule for late rows of its own; here a watermark says how late an event may come, and later ones are dropped.
Within a micro-batch a key's events are taken in the order of (at, event_id).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.evidence import AUTO_KNOWN, DWELL_MS, WINDOW_STOPS
from lectern.operators.lexis import KNOWN
from lectern.shipping import ship

SCHEMA = "event_id long, user_id long, at timestamp, trigger string, k int, division int, words long"
LATE = "2 days"


def read_log(spark: SparkSession, folder: str, files: int = 10) -> DataFrame:
    """Appended Parquet files as a stream."""
    ship(spark)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def append(events: DataFrame, folder: str, checkpoint: str):
    """Appends a stream to the log; the sink commits each batch once."""
    return events.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)


def reads(events: DataFrame, dwell_ms: int = DWELL_MS, late: str = LATE) -> DataFrame:
    """(user_id, event_id, at) of openings that a reader stayed with for ``dwell_ms`` before the next, for append mode.

    The state is a reader's last opening, with an event-time timer: what nothing follows counts once the watermark is that
    far behind it.
    """
    names = ["user_id", "event_id", "at"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(state.get)] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], i, pd.Timestamp(ms, unit="ms")) for ms, i in held], columns=names)
            return
        for pdf in batches:
            held += [(int(a.timestamp() * 1000), int(i)) for a, i in pdf[["at", "event_id"]].itertuples(index=False, name=None)]
        held.sort()
        done = [a for a, b in zip(held[:-1], held[1:], strict=True) if b[0] - a[0] >= dwell_ms]
        last = held[-1]
        if last[0] + dwell_ms > state.getCurrentWatermarkMs():
            state.update(last)
            state.setTimeoutTimestamp(last[0] + dwell_ms)
        else:
            done.append(last)
            state.remove()
        yield pd.DataFrame([(key[0], i, pd.Timestamp(ms, unit="ms")) for ms, i in done], columns=names)

    e = events.where("trigger = 'encounter'").withWatermark("at", late).groupBy("user_id")
    return e.applyInPandasWithState(step, "user_id long, event_id long, at timestamp", "ms long, event_id long", "append", GroupStateTimeout.EventTimeTimeout)


def encounters(events: DataFrame, late: str = LATE) -> DataFrame:
    """Encounters, the first of a lexeme, division and day; state is dropped as the watermark passes."""
    e = events.where("trigger = 'encounter'").withColumn("day", F.to_date("at")).withWatermark("at", late)
    return e.dropDuplicatesWithinWatermark(["user_id", "k", "division", "day"])


def live_counts(events: DataFrame) -> DataFrame:
    """(user_id, trigger, n, last_at), for update mode."""
    return events.groupBy("user_id", "trigger").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))


def advance(state: dict, events: list[tuple], auto_known: int) -> dict:
    """The status machine over (at, event_id, trigger, division) in order; the batch fold gives the same."""
    s = dict(state) if state else {"status": "new", "encounters": 0, "lookups": 0, "days": 0, "last_lookup": None, "met": []}
    met = {tuple(x) for x in s["met"]}
    for at, _, trigger, division in sorted(events):
        if trigger == "lookup":
            s["lookups"] += 1
            s["last_lookup"] = max(filter(None, (s["last_lookup"], at.isoformat())))
            s["status"] = {"known": "recognizing", "mastered": "recognizing", "new": "seen"}.get(s["status"], s["status"])
        elif (division, str(at.date())) not in met:
            s["days"] += str(at.date()) not in {day for _, day in met}
            met.add((division, str(at.date())))
            s["encounters"] += 1
            if auto_known > 0 and s["encounters"] >= auto_known and s["status"] not in KNOWN:
                s["status"] = "known"
    return s | {"met": sorted(met)}


def statuses(events: DataFrame, auto_known: int = AUTO_KNOWN, late: str = LATE) -> DataFrame:
    """(user_id, k, status, encounters, lookups, days, last_lookup) after each batch, for update mode.

    days counts the different days of encounters. The state of a lexeme is its row and the (division, day) pairs of the days that late events can still reach.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in pdf[["at", "event_id", "trigger", "division"]].itertuples(index=False, name=None)]
        s = advance(json.loads(state.get[0]) if state.exists else {}, rows, auto_known)
        days = sorted({d for _, d in s["met"]})[-int(late.split()[0]) - 2 :]
        s["met"] = [m for m in s["met"] if m[1] in days]
        state.update((json.dumps(s),))
        looked = pd.Timestamp(s["last_lookup"]) if s["last_lookup"] else pd.NaT
        yield pd.DataFrame([(*key, s["status"], s["encounters"], s["lookups"], s["days"], looked)], columns=["user_id", "k", "status", "encounters", "lookups", "days", "last_lookup"])

    e = events.withWatermark("at", late).groupBy("user_id", "k")
    return e.applyInPandasWithState(step, "user_id long, k int, status string, encounters int, lookups int, days int, last_lookup timestamp", "state string", "update", GroupStateTimeout.NoTimeout)


def tail_windows(events: DataFrame, n: int = WINDOW_STOPS, late: str = LATE) -> DataFrame:
    """(user_id, stops, words, from_at) of a reader's last n reads after each batch; the state is n rows at most."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            held += [[a.isoformat(), int(i), int(w)] for a, i, w in pdf[["at", "event_id", "words"]].itertuples(index=False, name=None)]
        held = sorted(held)[-n:]
        state.update((json.dumps(held),))
        yield pd.DataFrame([(key[0], len(held), sum(w for _, _, w in held), pd.Timestamp(held[0][0]))], columns=["user_id", "stops", "words", "from_at"])

    e = events.where("trigger = 'encounter'").withWatermark("at", late).groupBy("user_id")
    return e.applyInPandasWithState(step, "user_id long, stops int, words long, from_at timestamp", "state string", "update", GroupStateTimeout.NoTimeout)
