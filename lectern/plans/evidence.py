"""Queries over the evidence log. Views are reads of a stop (and encounters of a lexeme), clicks lookups, errors rescues,
purchases finished units and drill answers, signups reports; value is words, k the stop or lexeme. Ten stops are a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evidence as ev
from lectern.sources import sql
from lectern.sources.tables import evidence

QUERIES, SQL = {}, {}
E = sql.EVIDENCE


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


def typed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return evidence(spark, sf_dir).where(F.col("type") == kind)


def units(spark: SparkSession) -> DataFrame:
    """Ten units of ten stops; two a stage."""
    u = spark.range(10).select(F.col("id").cast("int").alias("pos"))
    stage = F.element_at(F.array(*map(F.lit, ["I", "II", "III", "IV", "V"])), (F.floor(F.col("pos") / 2) + 1).cast("int"))
    return u.select(F.concat(F.lit("u"), F.col("pos").cast("string")).alias("unit"), "pos", F.sequence(F.col("pos") * 10, F.col("pos") * 10 + 9).alias("stops"), stage.alias("stage"), (F.col("pos") * 100 + 100).cast("long").alias("words"))


_UNIT = "'u' || (k // 10)"


@query(f"WITH {E} SELECT user_id, count(DISTINCT k) AS stops FROM ev WHERE type = 'view' GROUP BY user_id")
def seen_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.seen_stops(typed(spark, sf_dir, "view")).groupBy("user_id").agg(F.count(F.lit(1)).alias("stops"))


_PROGRESS = f"""{E}, s AS (SELECT user_id, {_UNIT} AS unit, count(DISTINCT k) AS seen FROM ev WHERE type = 'view' GROUP BY 1, 2),
    d AS (SELECT user_id, {_UNIT} AS unit, min(t) AS finished_at FROM ev WHERE type = 'purchase' GROUP BY 1, 2),
    p AS (SELECT coalesce(s.user_id, d.user_id) AS user_id, coalesce(s.unit, d.unit) AS unit, coalesce(seen, 0) AS seen, finished_at
          FROM s FULL JOIN d ON s.user_id = d.user_id AND s.unit = d.unit)"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark)
    done = typed(spark, sf_dir, "purchase").join(ev.unit_of_stop(u), "k").select("user_id", "unit", "at")
    return ev.unit_progress(typed(spark, sf_dir, "view"), done, u.select("unit", "stops"))


@query(f"WITH {_PROGRESS} SELECT user_id, unit, seen, finished_at FROM p")
def unit_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress(spark, sf_dir)


_PATH = f"""{_PROGRESS}, u AS (SELECT 'u' || i AS unit, i AS pos, ['I', 'II', 'III', 'IV', 'V'][i // 2 + 1] AS stage, i * 100 + 100 AS words FROM range(10) r(i)),
    g AS (SELECT us.user_id, u.*, seen, finished_at FROM (SELECT DISTINCT user_id FROM p) us CROSS JOIN u LEFT JOIN p ON p.user_id = us.user_id AND p.unit = u.unit),
    l AS (SELECT *, coalesce(max(pos) FILTER (finished_at IS NOT NULL) OVER (PARTITION BY user_id), -1) AS last_done FROM g),
    n AS (SELECT *, min(pos) FILTER (finished_at IS NULL AND pos > last_done) OVER (PARTITION BY user_id) AS next_pos FROM l),
    path AS (SELECT user_id, unit, pos, stage, words, CASE WHEN finished_at IS NOT NULL THEN 'done' WHEN pos = next_pos THEN 'next' WHEN seen > 0 THEN 'started' ELSE 'later' END AS state FROM n)"""


@query(f"WITH {_PATH} SELECT user_id, unit, pos::INT AS pos, stage, words::BIGINT AS words, state FROM path")
def path_next_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.path_state(progress(spark, sf_dir), units(spark))


@query(f"WITH {_PATH} SELECT user_id, stage, count(*) AS units, count(*) FILTER (state = 'done') AS done, sum(words)::BIGINT AS words FROM path GROUP BY user_id, stage")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.path_state(progress(spark, sf_dir), units(spark))
    return p.groupBy("user_id", "stage").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("state") == "done").alias("done"), F.sum("words").alias("words"))


@query(f"WITH {E} SELECT user_id, {_UNIT} AS unit, arg_max(value, (t, event_id)) AS value FROM ev WHERE type = 'signup' GROUP BY 1, 2")
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = typed(spark, sf_dir, "signup").join(ev.unit_of_stop(units(spark)), "k")
    return ev.latest(e, ["user_id", "unit"], "value", ["at", "event_id"])


_RATES = f"""{E}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS nth FROM ev WHERE type = 'view') WHERE nth <= 30),
    h AS (SELECT user_id, count(*) AS stops, sum(ceil(value)::BIGINT)::BIGINT AS words, min(t) AS from_at FROM w GROUP BY user_id),
    lk AS (SELECT e.user_id, count(*) AS n FROM ev e JOIN h ON h.user_id = e.user_id AND e.t >= h.from_at WHERE e.type = 'click' AND (e.user_id, e.k) IN (SELECT user_id, k FROM w) GROUP BY 1),
    rs AS (SELECT e.user_id, count(*) AS n FROM ev e JOIN h ON h.user_id = e.user_id AND e.t >= h.from_at WHERE e.type = 'error' GROUP BY 1),
    rates AS (SELECT h.*, coalesce(lk.n, 0) AS lookups, coalesce(rs.n, 0) AS rescues FROM h LEFT JOIN lk USING (user_id) LEFT JOIN rs USING (user_id))"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = typed(spark, sf_dir, "view").withColumn("words", F.ceil("value").cast("long"))
    return ev.window_rates(reads, typed(spark, sf_dir, "click"), typed(spark, sf_dir, "error"))


@query(f"WITH {_RATES} SELECT * FROM rates")
def last_n_window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir)


_WORDS = f"""{E}, words AS (SELECT user_id, k, count(DISTINCT t::DATE) FILTER (type = 'view') AS encounters, count(DISTINCT t::DATE) AS days, count(*) FILTER (type = 'click') AS lookups,
    min(t) AS first_seen, max(t) AS last_seen, max(t) FILTER (type = 'click') AS last_lookup FROM ev WHERE type IN ('view', 'click') GROUP BY user_id, k)"""
_CLASS = """CASE WHEN k % 17 = 0 THEN 'known' WHEN encounters >= 4 AND days >= 2 AND (last_lookup IS NULL OR last_seen - last_lookup >= INTERVAL 36 HOUR) THEN 'likely-familiar'
    WHEN encounters > 0 OR lookups > 0 THEN 'met' ELSE 'new' END"""


@query(f"""WITH {_WORDS}, c AS (SELECT user_id, {_CLASS} AS class FROM words), k AS (SELECT unnest(['known', 'likely-familiar', 'met', 'new']) AS class)
    SELECT u.user_id, k.class, count(c.class) AS n FROM (SELECT DISTINCT user_id FROM words) u CROSS JOIN k LEFT JOIN c ON c.user_id = u.user_id AND c.class = k.class GROUP BY 1, 2""")
def familiarity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexemes whose number 17 divides stand for those marked known."""
    return ev.familiarity_counts(ev.word_rows(evidence(spark, sf_dir)), F.when(F.col("k") % 17 == 0, "known"))


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).agg(F.max("at").alias("now"))  # one row


_RETENTION = f"""{_WORDS}, nw AS (SELECT max(t) - INTERVAL 7 DAY AS since FROM ev),
    ret AS (SELECT user_id, count(*) AS cohort, count(*) FILTER (last_lookup IS NULL OR last_lookup < since) AS clean FROM words, nw
            WHERE first_seen <= since AND last_seen >= since AND encounters > 0 GROUP BY user_id)"""


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ev.word_rows(evidence(spark, sf_dir)).join(now(spark, sf_dir))
    return ev.retention(w, F.col("now"))


@query(f"WITH {_RETENTION} SELECT user_id, cohort, clean, clean / cohort AS share FROM ret")
def retention_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(spark, sf_dir).withColumn("share", F.col("clean") / F.col("cohort"))


@query(f"""WITH {_RATES}, {_RETENTION[len(E) + 2:]},
    seen AS (SELECT user_id, count(DISTINCT k) AS seen FROM ev WHERE type = 'view' GROUP BY 1),
    lr AS (SELECT user_id, {_UNIT} AS unit, arg_max(value, (t, event_id)) AS value FROM ev WHERE type = 'signup' GROUP BY 1, 2),
    rp AS (SELECT user_id, count(*) AS reports, count(*) FILTER (value >= 20) AS good FROM lr GROUP BY 1),
    sg AS (SELECT rates.user_id, seen.seen, CASE WHEN stops >= 5 AND words > 0 THEN lookups / words * 100 <= 4 END AS a, CASE WHEN stops >= 5 AND words > 0 THEN rescues / stops * 100 <= 5 END AS b,
           CASE WHEN reports >= 3 THEN good / reports >= 0.8 END AS c, CASE WHEN cohort >= 3 THEN clean / cohort >= 0.85 END AS d
           FROM rates JOIN seen USING (user_id) LEFT JOIN rp USING (user_id) LEFT JOIN ret USING (user_id)),
    n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT AS have,
          coalesce(a, false)::INT + coalesce(b, false)::INT + coalesce(c, false)::INT + coalesce(d, false)::INT AS met FROM sg)
    SELECT user_id, a AS lookup_rate, b AS rescue_rate, c AS reported, d AS retention,
           CASE WHEN seen < 10 OR have < 3 THEN 'insufficient-data' WHEN met = have THEN 'ready-to-advance' ELSE 'stay' END AS verdict FROM n""")
def readiness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four signals; a report of 20 or more says most was understood. The cohort asked for is 3, as readers here are brief."""
    reports = latest_report(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.col("value") >= 20).alias("good"))
    seen = seen_stops(spark, sf_dir).withColumnRenamed("stops", "seen")
    j = rates(spark, sf_dir).join(seen, "user_id").join(reports, "user_id", "left").join(retained(spark, sf_dir), "user_id", "left")
    there = (F.col("stops") >= ev.MIN_WINDOW) & (F.col("words") > 0)
    signals = {
        "lookup_rate": F.when(there, F.col("lookups") / F.col("words") * 100 <= ev.LOOKUPS),
        "rescue_rate": F.when(there, F.col("rescues") / F.col("stops") * 100 <= ev.RESCUES),
        "reported": F.when(F.col("reports") >= ev.REPORTS, F.col("good") / F.col("reports") >= ev.REPORTED),
        "retention": F.when(F.col("cohort") >= 3, F.col("clean") / F.col("cohort") >= ev.RETAINED),
    }
    return j.select("user_id", *(s.alias(n) for n, s in signals.items()), ev.verdict(list(signals.values()), F.col("seen")).alias("verdict"))


_ANSWERS = f"{E}, ans AS (SELECT user_id, t, event_id, value >= 30 AS correct, k % 5 = 0 AS hinted FROM ev WHERE type = 'purchase')"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir, "purchase").select("user_id", "at", "event_id", (F.col("value") >= 30).alias("correct"), (F.col("k") % 5 == 0).alias("hinted"))


@query(f"""WITH {_ANSWERS}, b AS (SELECT user_id, max((t, event_id)) FILTER (NOT (correct AND NOT hinted)) AS bad FROM ans GROUP BY user_id)
    SELECT b.user_id, count(ans.event_id) AS streak, count(ans.event_id) < 3 AS hint FROM b LEFT JOIN ans ON ans.user_id = b.user_id AND (b.bad IS NULL OR (ans.t, ans.event_id) > b.bad) GROUP BY b.user_id""")
def hint_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.hint_streak(answers(spark, sf_dir))


@query(f"""WITH {_ANSWERS} SELECT user_id, count(*) AS answers, count(*) FILTER (correct AND NOT hinted) AS good
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS n FROM ans) WHERE n <= 10 GROUP BY user_id""")
def decode_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.last_answers(answers(spark, sf_dir))


@query(f"WITH {E} SELECT user_id, k, t::DATE AS day, min(event_id) AS event_id FROM ev WHERE type = 'view' GROUP BY ALL")
def encounter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir, "view").groupBy("user_id", "k", F.to_date("at").alias("day")).agg(F.min("event_id").alias("event_id"))


@query(f"""WITH {E}, live AS (SELECT * FROM ev WHERE value >= 20), st AS (SELECT * FROM ev WHERE value < 40),
    a AS (SELECT * FROM live UNION ALL SELECT * FROM st WHERE (user_id, type, t) NOT IN (SELECT (user_id, type, t) FROM live))
    SELECT user_id, type, t AS "at", min(event_id) AS event_id FROM a GROUP BY 1, 2, 3""")
def hydration_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    return ev.merge_log(e.where("value < 40"), e.where("value >= 20")).select("user_id", "type", "at", "event_id")


_STATUS = "CASE WHEN value < 10 THEN 'new' WHEN value < 30 THEN 'seen' WHEN value < 60 THEN 'known' ELSE 'mastered' END"
_RANK = "CASE {} WHEN 'new' THEN 0 WHEN 'seen' THEN 1 WHEN 'known' THEN 3 ELSE 4 END"


@query(f"""WITH {E}, x AS (SELECT user_id, k, type, {_STATUS} AS s FROM ev), c AS (SELECT user_id, k, max({_RANK.format('s')}) AS r FROM x WHERE type = 'view' GROUP BY 1, 2),
    i AS (SELECT user_id, k, max({_RANK.format('s')}) AS r FROM x WHERE type = 'click' GROUP BY 1, 2),
    b AS (SELECT coalesce(c.user_id, i.user_id) AS user_id, coalesce(c.k, i.k) AS k, c.r AS o, i.r AS n FROM c FULL JOIN i ON c.user_id = i.user_id AND c.k = i.k)
    SELECT user_id, k, CASE greatest(coalesce(o, -1), coalesce(n, -1)) WHEN 0 THEN 'new' WHEN 1 THEN 'seen' WHEN 3 THEN 'known' ELSE 'mastered' END AS status,
           n IS NOT NULL AND (o IS NULL OR n > o) AS changed FROM b""")
def status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    s = F.when(v < 10, "new").when(v < 30, "seen").when(v < 60, "known").otherwise("mastered")
    rank = F.create_map(*(F.lit(x) for kv in ev.STATUS_RANK.items() for x in kv))
    e = evidence(spark, sf_dir).withColumn("status", s)
    current = e.where("type = 'view'").groupBy("user_id", "k").agg(F.max_by("status", rank[F.col("status")]).alias("status"))
    return ev.upsert_status(current, e.where("type = 'click'").select("user_id", "k", "status"))


@query(f"""WITH {E}, o AS (SELECT user_id, event_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM ev WHERE type = 'view')
    SELECT user_id, event_id FROM o WHERE nxt IS NULL OR nxt - t >= INTERVAL 3 HOUR""")
def dwelled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that nothing follows within three hours; events here are far apart."""
    views = evidence(spark, sf_dir).where("type = 'view'")
    return ev.dwelled(views, 3 * 3_600_000).select("user_id", "event_id")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir).where(F.col("type").isin("view", "click"))
    return e.select("user_id", "k", "at", "event_id", F.when(F.col("type") == "click", "lookup").otherwise("encounter").alias("trigger"), F.floor("value").cast("int").alias("division"))


@query(f"""WITH RECURSIVE {E}, x AS (SELECT user_id, k, t, event_id, type, row_number() OVER (PARTITION BY user_id, k ORDER BY t, event_id) AS n,
      row_number() OVER (PARTITION BY user_id, k, type, floor(value), t::DATE ORDER BY t, event_id) = 1 AS fresh FROM ev WHERE type IN ('view', 'click')),
    m AS (SELECT user_id, k, 0::BIGINT AS n, 'new' AS status, 0 AS encounters, 0 AS lookups FROM (SELECT DISTINCT user_id, k FROM x)
      UNION ALL SELECT m.user_id, m.k, x.n, CASE WHEN x.type = 'click' AND status IN ('known', 'mastered') THEN 'recognizing' WHEN x.type = 'click' AND status = 'new' THEN 'seen'
        WHEN x.type = 'view' AND fresh AND encounters + 1 >= 2 AND status NOT IN ('known', 'mastered', 'ignored') THEN 'known' ELSE status END,
        encounters + (x.type = 'view' AND fresh)::INT, lookups + (x.type = 'click')::INT FROM m JOIN x ON x.user_id = m.user_id AND x.k = m.k AND x.n = m.n + 1)
    SELECT user_id, k, arg_max(status, n) AS status, arg_max(encounters, n) AS encounters, arg_max(lookups, n) AS lookups FROM m GROUP BY 1, 2""")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words become known at two encounters here, as readers meet them rarely."""
    return ev.fold_status(triggers(spark, sf_dir), auto_known=2)


@query(f"""WITH {E} SELECT type, CASE WHEN value < 20 THEN 'new' WHEN value < 50 THEN 'seen' ELSE 'known' END AS status, count(*) AS n FROM ev GROUP BY 1, 2""")
def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("value") < 20, "new").when(F.col("value") < 50, "seen").otherwise("known")
    return evidence(spark, sf_dir).groupBy("type", s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E} SELECT r.event_id, count(c.event_id) AS clicks FROM ev r LEFT JOIN ev c ON c.type = 'click' AND c.user_id = r.user_id AND c.t >= r.t AND c.t < r.t + INTERVAL 36 HOUR
    WHERE r.type = 'error' GROUP BY r.event_id""")
def lookup_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups within 36 hours of a rescue, by day buckets: an equi-join on reader and day, then the exact range."""
    day = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 129_600_000_000).cast("long")
    r = typed(spark, sf_dir, "error").select("user_id", F.col("event_id").alias("rid"), F.col("at").alias("from_at"))
    c = typed(spark, sf_dir, "click").select("user_id", F.col("event_id").alias("cid"), "at", day(F.col("at")).alias("bucket"))
    wide = r.withColumn("bucket", F.explode(F.array(day(F.col("from_at")), day(F.col("from_at")) + 1)))
    hit = wide.join(c, ["user_id", "bucket"]).where((F.col("at") >= F.col("from_at")) & (F.col("at") < F.col("from_at") + F.expr("INTERVAL 36 HOURS")))
    n = hit.groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    return r.join(n, "rid", "left").select(F.col("rid").alias("event_id"), F.coalesce("n", F.lit(0)).alias("clicks"))
