"""Event queries: events as asks and requests, labels as feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..sources import sinks
from ..streaming import events as S
from ..streaming import quota
from .base import query, table

#: The gate's outcome that stands for each kind of event.
STATUS = {"view": "answerable", "click": "needs_time_context", "signup": "needs_clarification", "error": "weak_evidence", "purchase": "out_of_scope"}
TODAY = "2024-01-30"
ASKS = f"""asks AS (SELECT event_id AS id, ts AS time, CAST(ts AS DATE) AS day, user_id, CASE WHEN user_id % 2 = 0 THEN 'website' ELSE 'widget' END AS app,
  CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} END AS status, regexp_extract(props, '([0-9]+)', 1) AS k,
  'file' || CAST(user_id % 37 AS VARCHAR) || '.md' AS file, 'question ' || CAST(event_id AS VARCHAR) AS question FROM events)"""


def asks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("time"), F.to_date("ts").alias("day"), "user_id", F.when(F.col("user_id") % 2 == 0, "website").otherwise("widget").alias("app"), status.alias("status"),
        F.array(F.concat(F.lit("concept-"), F.coalesce(k, F.lit(""))), F.concat(F.lit("kind-"), F.col("event_type"))).alias("concepts"), F.array(F.concat(F.lit("file"), F.col("user_id") % 37, F.lit(".md"))).alias("files"), F.concat(F.lit("question "), F.col("event_id")).alias("question"),
    )


@query(f"WITH {ASKS} SELECT status, CASE status WHEN 'answerable' THEN 'answered' WHEN 'needs_time_context' THEN 'answered, with the course term' WHEN 'needs_clarification' THEN 'too broad (asked to narrow it)' WHEN 'weak_evidence' THEN 'not in the notes' ELSE 'outside the course' END AS label, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS percent FROM asks GROUP BY status")
def insights_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return E.outcomes(asks(spark, sf))


@query(f"WITH {ASKS} SELECT 'app' AS kind, app AS value, count(*) AS n FROM asks GROUP BY ALL UNION ALL SELECT 'day', CAST(day AS VARCHAR), count(*) FROM asks GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM asks GROUP BY ALL")
def insights_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return E.grouped(asks(spark, sf), ["app", "day", "status"])


@query(f"WITH {ASKS}, c AS (SELECT id, 'concept-' || k AS concept FROM asks UNION ALL SELECT event_id, 'kind-' || event_type FROM events) SELECT concept, count(*) AS n FROM c GROUP BY concept ORDER BY n DESC, min(id), concept LIMIT 10")
def insights_top_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return E.top_concepts(asks(spark, sf), 10)


@query(f"WITH {ASKS} SELECT file, count(*) AS n FROM asks WHERE status = 'answerable' GROUP BY file ORDER BY n DESC, min(id) LIMIT 5")
def insights_top_files(spark: SparkSession, sf: str) -> DataFrame:
    return E.first_files(asks(spark, sf), "answerable", 5)


@query(f"WITH {ASKS} SELECT id, question FROM asks WHERE status = 'weak_evidence' ORDER BY id DESC LIMIT 8")
def insights_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return E.gaps(asks(spark, sf), 8).select("id", "question")


@query(f"WITH {ASKS} SELECT day, count(*) AS n FROM asks WHERE day >= DATE '{TODAY}' - 6 GROUP BY day")
def recent_days(spark: SparkSession, sf: str) -> DataFrame:
    return E.recent(asks(spark, sf), F.lit(TODAY).cast("date"), 7).groupBy("day").agg(F.count("*").alias("n"))


LIMITED = f"""{ASKS}, num AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY time, id) AS INTEGER) AS nth, CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 7 = 0 THEN 5 ELSE 3 END AS lim FROM asks)"""


@query(f"WITH {LIMITED} SELECT id, user_id, day, nth, lim IS NULL OR nth <= lim AS accepted, CASE WHEN lim IS NULL THEN -1 ELSE greatest(lim - nth, 0) END AS remaining FROM num")
def daily_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas of three a day, five for some users, none for others."""
    limit = F.when(F.col("user_id") % 11 == 0, F.lit(None)).when(F.col("user_id") % 7 == 0, 5).otherwise(3)
    return E.limited(asks(spark, sf), "user_id", "day", ["time", "id"], limit).select("id", "user_id", "day", "nth", "accepted", "remaining")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    email = F.when(F.col("user_id") % 13 == 0, F.concat(F.lit("address:"), F.col("user_id"))).otherwise(F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.org")))
    return sinks.usage(asks(spark, sf).select(email.alias("email"), "day"))


USAGE = f"""{ASKS}, usage AS (SELECT CASE WHEN user_id % 13 = 0 THEN 'address:' || CAST(user_id AS VARCHAR) ELSE 'u' || CAST(user_id AS VARCHAR) || '@example.org' END AS email, day, CAST(count(*) AS INTEGER) AS questions FROM asks GROUP BY ALL),
roster AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email, c_name AS name FROM customer)"""


def roster(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@example.org")).alias("email"), F.col("c_name").alias("name"))


@query(f"WITH {USAGE} SELECT * FROM usage")
def usage_table(spark: SparkSession, sf: str) -> DataFrame:
    return usage(spark, sf)


@query(f"WITH {USAGE} SELECT r.email, name, CAST(coalesce(sum(questions), 0) AS BIGINT) AS questions FROM roster r LEFT JOIN usage u ON u.email = r.email GROUP BY ALL")
def students_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.students(roster(spark, sf), usage(spark, sf))


@query(f"WITH {USAGE} SELECT email, CAST(sum(questions) AS BIGINT) AS questions FROM usage WHERE email NOT LIKE 'address:%' AND email NOT IN (SELECT email FROM roster) GROUP BY email")
def unknown_users(spark: SparkSession, sf: str) -> DataFrame:
    return E.unknown_users(roster(spark, sf), usage(spark, sf))


@query(f"WITH {USAGE}, few AS (SELECT 'u' || CAST(s_suppkey AS VARCHAR) || '@example.org' AS email FROM supplier) SELECT email, CAST(sum(questions) AS BIGINT) AS questions FROM usage u WHERE NOT starts_with(email, 'address:') AND NOT EXISTS (SELECT 1 FROM few f WHERE f.email = u.email) GROUP BY email")
def unlisted_users(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the suppliers as the roster, which leaves many users out; ``unknown_users`` has a roster of all customers, who are all users."""
    few = table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey"), F.lit("@example.org")).alias("email"), F.col("s_name").alias("name"))
    return E.unknown_users(few, usage(spark, sf))


@query("SELECT source AS page, count(*) FILTER (quality = 1) AS up, count(*) FILTER (quality = 0) AS down FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def feedback_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return E.feedback_report(rows.select(F.col("source").alias("page"), F.when(F.col("quality") == 1, "up").when(F.col("quality") == 0, "down").alias("rating")))


@query(f"WITH {ASKS} SELECT id, day, file, status, row_number() OVER (ORDER BY id DESC) - 1 AS place FROM asks WHERE status IN ('answerable', 'weak_evidence') AND day >= DATE '{TODAY}' - 6")
def feedback_newest(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of the last seven days, the newest first."""
    rows = asks(spark, sf).filter("status IN ('answerable', 'weak_evidence')").select("id", "day", F.element_at("files", 1).alias("file"), "status")
    return E.newest(rows, F.lit(TODAY).cast("date"))


@query(f"WITH {ASKS} SELECT id, user_id AS sender, day FROM asks WHERE status IN ('answerable', 'weak_evidence') QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY time, id) <= 2")
def feedback_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most two ratings for a sender and day; other statuses are no rating."""
    rating = F.when(F.col("status") == "answerable", "up").when(F.col("status") == "weak_evidence", "down").otherwise("none")
    rows = asks(spark, sf).select("id", "time", "day", F.col("user_id").alias("sender"), rating.alias("rating"), "question")
    return sinks.accepted_feedback(rows, 2).select("id", "sender", "day")


@query(f"WITH {ASKS} SELECT id, app, status, question AS question, 2 AS n_concepts FROM asks")
def ask_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = sinks.ask_rows(asks(spark, sf), True)
    return rows.join(asks(spark, sf).select("id", "question"), "question").select("id", "app", "status", "question", F.size("concepts").alias("n_concepts"))


@query(f"WITH {ASKS}, f AS (SELECT DISTINCT file FROM asks), t AS (SELECT 'file' || CAST(doc_id % 40 AS VARCHAR) || '.md' AS file, source AS topic, lang AS chapter FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) = 1) SELECT file, topic, chapter FROM f LEFT JOIN t USING (file)")
def chapters_of_files(spark: SparkSession, sf: str) -> DataFrame:
    topics = table(spark, sf, "documents").select(F.concat(F.lit("file"), F.col("doc_id") % 40, F.lit(".md")).alias("file"), F.col("source").alias("topic"), F.col("lang").alias("chapter"), F.col("doc_id").alias("pos"))
    return E.chapter_of_files(asks(spark, sf).select(F.element_at("files", 1).alias("file")).distinct(), topics)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Day windows over the event stream, all that is there now."""
    return S.drained(S.daily_counts(S.source(spark, f"{sf}/events.parquet")), "complete")


@query("SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS nth, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS accepted FROM events")
def stream_daily_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The daily quota with state and timers, over the event stream."""
    return S.drained(quota.capped(S.source(spark, f"{sf}/events.parquet"), 3), "append", quota.PROVIDER)


@query(f"WITH {ASKS}, d AS (SELECT DISTINCT user_id, day FROM asks), g AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d) SELECT user_id, count(*) AS longest FROM g GROUP BY user_id, run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC) = 1")
def longest_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """The longest run of days on which each user asks."""
    days = asks(spark, sf).select("user_id", "day").distinct()
    run = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("run", run).groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


