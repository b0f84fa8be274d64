"""Problems 2 and 3: incremental processing and sessions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators import incremental, sessions
from threadmill.session import checkpoint_dir, cut_lineage
from threadmill.sources.tables import blank, reader


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    t = reader(spark, root)
    return incremental.pending_messages(t("message_arrivals"), t("stage_runs"), t("messages"))


def p2_gaps(spark: SparkSession, root: str) -> DataFrame:
    """The batch ranges that no good run of a stage covers."""
    t = reader(spark, root)
    arrivals = t("message_arrivals")
    available = arrivals.agg(F.min("batch_no").cast("bigint").alias("first"), F.max("batch_no").cast("bigint").alias("last"))
    done = incremental.union_of_ranges(incremental.good_ranges(t("stage_runs")), "stage", "low", "high")
    return incremental.gaps(t("stage_runs").select("stage").distinct(), available, done)


def p2_resumed(spark: SparkSession, root: str) -> DataFrame:
    """What the ledger lets three runs of ``embed`` process, the first of which dies after writing its rows: no message is left out or comes twice.

    The runs that the log calls good are committed beforehand; then half of the
    batches are there, and all of them in the end.
    """
    t = reader(spark, root)
    arrivals = t("message_arrivals")
    changes = incremental.newest_changes(arrivals, ["id", "chat_jid"], "batch_no", "arrival_no", "text_digest")
    present = t("messages").where(~blank(F.col("text_content"))).select("id", "chat_jid").distinct()
    due = cut_lineage(changes.join(present, ["id", "chat_jid"]))
    good = [(r["low"], r["high"]) for r in incremental.good_ranges(t("stage_runs")).where("stage = 'embed'").collect()]  # the log is short
    bounds = arrivals.agg(F.min("batch_no").alias("first"), F.max("batch_no").alias("last")).first()
    available = [(bounds["first"], bounds["last"])] if bounds["first"] is not None else []
    half = [(low, (low + high) // 2) for low, high in available]

    def work(spans: list[incremental.Interval]) -> DataFrame:
        batches = spark.createDataFrame([(int(a), int(b)) for a, b in spans], "low bigint, high bigint")
        return due.join(F.broadcast(batches), F.col("change_batch").between(F.col("low"), F.col("high"))).select("id", "chat_jid")

    class Dying(incremental.IntervalLedger):
        def _publish(self, number, commit):
            raise InterruptedError("the power went")

    where = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    ledger = incremental.IntervalLedger(spark, where, "embed")
    ledger.run(good, lambda _: due.limit(0).select("id", "chat_jid"))
    try:
        Dying(spark, where, "embed").run(half, work)
    except InterruptedError:
        pass
    ledger.run(half, work)
    ledger.run(available, work)
    found = ledger.output()
    return found if found is not None else due.limit(0).select("id", "chat_jid")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return sessions.chat_sessions(reader(spark, root)("messages")).drop("duration_us")


def p3_durations(spark: SparkSession, root: str) -> DataFrame:
    """Sessions, messages and seconds of activity per chat."""
    found = sessions.chat_sessions(reader(spark, root)("messages"))
    return found.groupBy("chat_jid").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("n_messages").alias("n_messages"),
        F.sum("duration_us").alias("active_us"),
        F.max("duration_us").alias("longest_us"),
    )


_GOOD = """last_status AS (
  SELECT stage, run_no, arg_max(status, (logged_at, status <> 'started', status)) AS status,
         max(from_batch) AS from_batch, max(to_batch) AS to_batch
  FROM stage_runs GROUP BY stage, run_no),
good AS (SELECT * FROM last_status WHERE status = 'ok')"""

_SESSIONS = """m AS (SELECT DISTINCT id, chat_jid, epoch_us(timestamp) AS us FROM messages WHERE timestamp IS NOT NULL),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY chat_jid ORDER BY us, id) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM m),
s AS (SELECT *, sum(opens) OVER (PARTITION BY chat_jid ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS session FROM f),
g AS (SELECT chat_jid, min(us) AS start_us, max(us) AS end_us, count(*) AS n_messages FROM s GROUP BY chat_jid, session)"""

QUERIES = {"p2_found": p2_found, "p2_gaps": p2_gaps, "p2_resumed": p2_resumed, "p3_found": p3_found, "p3_durations": p3_durations}

ORACLES = {
    "p2_found": f"""WITH {_GOOD},
c AS (SELECT id, chat_jid, batch_no, coalesce(text_digest, '') AS d,
        lag(coalesce(text_digest, '')) OVER (PARTITION BY id, chat_jid ORDER BY batch_no, arrival_no) AS before
      FROM message_arrivals),
n AS (SELECT id, chat_jid, max(batch_no) AS batch_no FROM c WHERE before IS NULL OR before <> d GROUP BY id, chat_jid),
m AS (SELECT id, chat_jid, bool_or(coalesce(is_group, false)) AS is_group FROM messages
      WHERE text_content IS NOT NULL AND trim(text_content) <> '' GROUP BY id, chat_jid)
SELECT s.stage, n.id, n.chat_jid
FROM n JOIN m ON n.id = m.id AND n.chat_jid = m.chat_jid
JOIN (SELECT DISTINCT stage FROM stage_runs) s ON s.stage <> 'extract' OR m.is_group
WHERE NOT EXISTS (SELECT 1 FROM good WHERE good.stage = s.stage AND n.batch_no BETWEEN good.from_batch AND good.to_batch)""",
    "p2_gaps": f"""WITH {_GOOD},
b AS (SELECT s.stage, r.batch FROM (SELECT DISTINCT stage FROM stage_runs) s,
      (SELECT unnest(generate_series((SELECT min(batch_no) FROM message_arrivals), (SELECT max(batch_no) FROM message_arrivals))) AS batch) r
      WHERE NOT EXISTS (SELECT 1 FROM good WHERE good.stage = s.stage AND r.batch BETWEEN good.from_batch AND good.to_batch)),
i AS (SELECT stage, batch, batch - row_number() OVER (PARTITION BY stage ORDER BY batch) AS island FROM b)
SELECT stage, CAST(min(batch) AS BIGINT) AS low, CAST(max(batch) AS BIGINT) AS high FROM i GROUP BY stage, island""",
    "p3_found": f"WITH {_SESSIONS} SELECT chat_jid, start_us, end_us, n_messages FROM g",
    "p3_durations": f"""WITH {_SESSIONS}
SELECT chat_jid, count(*) AS n_sessions, CAST(sum(n_messages) AS BIGINT) AS n_messages,
       CAST(sum(end_us - start_us) AS BIGINT) AS active_us, max(end_us - start_us) AS longest_us
FROM g GROUP BY chat_jid""",
}
ORACLES["p2_resumed"] = f"SELECT id, chat_jid FROM ({ORACLES['p2_found']}) WHERE stage = 'embed'"
