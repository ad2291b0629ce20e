"""Folds of the append-only evidence log: progress, familiarity, path, readiness, the status machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.lexis import KNOWN, familiarity

#: Thresholds of readiness.
WINDOW_STOPS, MIN_WINDOW, MIN_STOPS, MIN_SIGNALS = 30, 5, 10, 3
LOOKUPS, RESCUES, REPORTED, REPORTS = 4.0, 5.0, 0.8, 3
RETENTION_DAYS, RETAINED, RETENTION_LEMMAS = 7, 0.85, 30
DECODE_WINDOW, DECODE_RIGHT = 10, 8
#: Milliseconds that a page must be open to count as read.
DWELL_MS = 5000
AUTO_KNOWN = 6
STATUS_RANK = {"new": 0, "seen": 1, "recognizing": 2, "known": 3, "mastered": 4, "ignored": 5}


def seen_stops(reads: DataFrame) -> DataFrame:
    """(user_id, k): the distinct stops that a reader has seen."""
    return reads.select("user_id", "k").distinct()


def unit_of_stop(units: DataFrame) -> DataFrame:
    """(k, unit) of (unit, pos, stops array); the last unit wins where a stop repeats."""
    return units.select("unit", "pos", F.explode("stops").alias("k")).groupBy("k").agg(F.max_by("unit", "pos").alias("unit"))


def latest(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of the last event of each key."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def unit_progress(reads: DataFrame, done: DataFrame, units: DataFrame) -> DataFrame:
    """(user_id, unit, seen, finished_at): stops of a unit that were seen, and when it was first marked done.

    units is (unit, stops); a stop listed twice in a unit counts twice, as units list what there is to read.
    """
    listed = units.select("unit", F.explode("stops").alias("k"))
    seen = seen_stops(reads).join(listed, "k").groupBy("user_id", "unit").agg(F.count(F.lit(1)).alias("seen"))
    finished = done.groupBy("user_id", "unit").agg(F.min("at").alias("finished_at"))
    return seen.join(finished, ["user_id", "unit"], "full").select("user_id", "unit", F.coalesce("seen", F.lit(0).cast("long")).alias("seen"), "finished_at")


def path_state(progress: DataFrame, units: DataFrame) -> DataFrame:
    """(user_id, unit, pos, stage, words, state): done, next (the first unfinished one after the last finished), started or later."""
    users = progress.select("user_id").distinct()
    path = units.groupBy().agg(F.collect_list(F.struct("unit", "pos", "stage", "words")).alias("path"))  # one ladder, a row
    grid = users.join(path).select("user_id", F.inline("path"))
    g = grid.join(progress, ["user_id", "unit"], "left")
    done = F.col("finished_at").isNotNull()
    w = Window.partitionBy("user_id")
    g = g.withColumn("last_done", F.coalesce(F.max(F.when(done, F.col("pos"))).over(w), F.lit(-1)))
    g = g.withColumn("next_pos", F.min(F.when(~done & (F.col("pos") > F.col("last_done")), F.col("pos"))).over(w))
    state = F.when(done, "done").when(F.col("pos") == F.col("next_pos"), "next").when(F.col("seen") > 0, "started").otherwise("later")
    return g.select("user_id", "unit", "pos", "stage", "words", state.alias("state"))


def word_rows(events: DataFrame) -> DataFrame:
    """(user_id, k, encounters, days, lookups, first_seen, last_seen, last_lookup): reads count once a lexeme and day."""
    read, look = F.col("type") == "view", F.col("type") == "click"
    return events.where(read | look).groupBy("user_id", "k").agg(
        F.countDistinct(F.when(read, F.to_date("at"))).alias("encounters"), F.countDistinct(F.to_date("at")).alias("days"),
        F.count_if(look).alias("lookups"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max(F.when(look, F.col("at"))).alias("last_lookup"),
    )


def familiarity_counts(words: DataFrame, status: Column) -> DataFrame:
    """(user_id, class, n) with all four classes of every reader."""
    c = familiarity(status, F.col("encounters"), F.col("days"), F.col("lookups"), F.col("last_seen"), F.col("last_lookup"))
    per = words.select("user_id", c.alias("class")).groupBy("user_id").agg(*(F.count_if(F.col("class") == x).alias(x) for x in ("known", "likely-familiar", "met", "new")))
    return per.unpivot("user_id", ["known", "likely-familiar", "met", "new"], "class", "n")


def last_window(reads: DataFrame, n: int = WINDOW_STOPS) -> DataFrame:
    """A reader's last n reads in log order."""
    w = Window.partitionBy("user_id").orderBy(F.col("at").desc(), F.col("event_id").desc())
    return reads.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def window_rates(reads: DataFrame, lookups: DataFrame, rescues: DataFrame, n: int = WINDOW_STOPS) -> DataFrame:
    """(user_id, stops, words, from_at, lookups, rescues): lookups in the window's stops, and rescues, since its first read."""
    win = last_window(reads, n)
    head = win.groupBy("user_id").agg(F.count(F.lit(1)).alias("stops"), F.sum("words").alias("words"), F.min("at").alias("from_at"))
    keys = win.select("user_id", "k").distinct()
    looked = lookups.join(head.select("user_id", "from_at"), "user_id").where("at >= from_at").join(keys, ["user_id", "k"], "left_semi")
    looked = looked.groupBy("user_id").agg(F.count(F.lit(1)).alias("lookups"))
    rescued = rescues.join(head.select("user_id", "from_at"), "user_id").where("at >= from_at").groupBy("user_id").agg(F.count(F.lit(1)).alias("rescues"))
    out = head.join(looked, "user_id", "left").join(rescued, "user_id", "left")
    return out.select("user_id", "stops", "words", "from_at", F.coalesce("lookups", F.lit(0)).alias("lookups"), F.coalesce("rescues", F.lit(0)).alias("rescues"))


def retention(words: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """(user_id, cohort, clean): words first met over a span ago and read again within it, and those of them not looked up."""
    since = now - F.make_dt_interval(F.lit(days))
    cohort = words.where((F.col("first_seen") <= since) & (F.col("last_seen") >= since) & (F.col("encounters") > 0))
    clean = F.col("last_lookup").isNull() | (F.col("last_lookup") < since)
    return cohort.groupBy("user_id").agg(F.count(F.lit(1)).alias("cohort"), F.count_if(clean).alias("clean"))


def verdict(signals: list[Column], stops_seen: Column) -> Column:
    """insufficient-data, ready-to-advance (all signals that say something are met) or stay; a signal is met, not met or null."""
    there = sum((s.isNotNull().cast("int") for s in signals), F.lit(0))
    met = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    enough = (stops_seen >= MIN_STOPS) & (there >= MIN_SIGNALS)
    return F.when(~enough, "insufficient-data").when(met == there, "ready-to-advance").otherwise("stay")


def hint_streak(answers: DataFrame) -> DataFrame:
    """(user_id, streak, hint): right answers without the hint since the last other one; the hint goes after three."""
    good = F.col("correct") & ~F.col("hinted")
    bad = answers.groupBy("user_id").agg(F.max(F.when(~good, F.struct("at", "event_id"))).alias("bad"))
    after = answers.join(bad, "user_id").where(F.col("bad").isNull() | (F.struct("at", "event_id") > F.col("bad")))
    n = after.groupBy("user_id").agg(F.count(F.lit(1)).alias("streak"))
    out = bad.join(n, "user_id", "left").select("user_id", F.coalesce("streak", F.lit(0)).alias("streak"))
    return out.withColumn("hint", F.col("streak") < 3)


def dwelled(events: DataFrame, dwell_ms: int = DWELL_MS) -> DataFrame:
    """Openings (user_id, at, event_id, ...) that a reader stayed with for ``dwell_ms`` before the next; a last one counts."""
    nxt = F.lead("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    stayed = nxt.isNull() | (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) >= dwell_ms * 1000)
    return events.withColumn("__stayed", stayed).where("__stayed").drop("__stayed")


def last_answers(answers: DataFrame, n: int = DECODE_WINDOW) -> DataFrame:
    """(user_id, answers, good): the last n answers, and those right without the hint."""
    last = last_window(answers, n)
    return last.groupBy("user_id").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("correct") & ~F.col("hinted")).alias("good"))


def merge_log(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Live rows, and stored ones whose type and time no live row of the reader has; one row a type and time."""
    key = ["user_id", "type", "at"]
    more = stored.join(live.select(*key).distinct(), key, "left_anti")
    w = Window.partitionBy(*key).orderBy("event_id")
    return live.unionByName(more).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def upsert_status(current: DataFrame, imported: DataFrame) -> DataFrame:
    """(user_id, k, status, changed): the higher status of a key wins; changed where the import raised or added it."""
    rank = F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv))
    both = current.select("user_id", "k", F.struct(rank[F.col("status")].alias("r"), "status").alias("old")).join(
        imported.groupBy("user_id", "k").agg(F.max(F.struct(rank[F.col("status")].alias("r"), "status")).alias("new")), ["user_id", "k"], "full"
    )
    raised = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.r") > F.col("old.r")))
    return both.select("user_id", "k", F.when(raised, F.col("new.status")).otherwise(F.col("old.status")).alias("status"), raised.alias("changed"))


def step(status: Column, encounters: Column, lookups: Column, trigger: Column, fresh: Column, auto_known: int = AUTO_KNOWN) -> tuple[Column, Column, Column]:
    """One transition of the status machine: (status, encounters, lookups) after a "lookup" or an "encounter".

    A lookup makes a word seen, and a known or mastered one recognizing. A fresh encounter (the first of its division and
    day) counts; at ``auto_known`` of them an open word becomes known, never if that is 0. Ignored words stay.
    """
    look, meet = trigger == "lookup", (trigger == "encounter") & fresh
    n = encounters + meet.cast("int")
    up = meet & (F.lit(auto_known) > 0) & (n >= auto_known) & ~status.isin(*KNOWN)
    after = F.when(look & status.isin("known", "mastered"), "recognizing").when(look & (status == "new"), "seen").when(up, "known").otherwise(status)
    return after, n, lookups + look.cast("int")


def fold_status(events: DataFrame, auto_known: int = AUTO_KNOWN) -> DataFrame:
    """(user_id, k, status, encounters, lookups) of (user_id, k, at, event_id, trigger, division): the machine run in order.

    One row's history is folded at a time; encounters repeated within a division and day don't count.
    """
    first = Window.partitionBy("user_id", "k", "trigger", "division", F.to_date("at")).orderBy("at", "event_id")
    e = events.withColumn("fresh", F.row_number().over(first) == 1)
    log = e.groupBy("user_id", "k").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "trigger", "fresh"))).alias("log"))
    start = F.struct(F.lit("new").alias("status"), F.lit(0).alias("encounters"), F.lit(0).alias("lookups"))

    def go(acc, x):
        status, n, looked = step(acc["status"], acc["encounters"], acc["lookups"], x["trigger"], x["fresh"], auto_known)
        return F.struct(status.alias("status"), n.alias("encounters"), looked.alias("lookups"))

    return log.select("user_id", "k", F.aggregate("log", start, go).alias("s")).select("user_id", "k", "s.*")
