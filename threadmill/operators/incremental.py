"""Processing only new or changed records.

The state of a stage is a set of disjoint intervals of sequence numbers that
good runs have covered.  The next run takes the available ranges, subtracts the
processed intervals and works on the gaps; that includes numbers left behind by
failed runs and late commits in the middle of the range, which a single high
watermark would skip.  Output and merged intervals are committed together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.sources.tables import blank

Interval = tuple[int, int]


def merge_intervals(spans: Iterable[Interval]) -> list[Interval]:
    """Disjoint closed integer intervals, ascending; touching ones are joined."""
    merged: list[Interval] = []
    for low, high in sorted(spans):
        if low > high:
            continue
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def subtract_intervals(available: Iterable[Interval], processed: Iterable[Interval]) -> list[Interval]:
    """The parts of ``available`` that ``processed`` does not cover."""
    gaps: list[Interval] = []
    done = merge_intervals(processed)
    for low, high in merge_intervals(available):
        at = low
        for a, b in done:
            if b < at or a > high:
                continue
            if a > at:
                gaps.append((at, a - 1))
            at = b + 1
        if at <= high:
            gaps.append((at, high))
    return gaps


def union_of_ranges(ranges: DataFrame, by: str, low: str, high: str) -> DataFrame:
    """Disjoint intervals ``by, low, high`` of overlapping or touching integer
    ranges.  Rows with a null bound or with low > high hold no number."""
    reach = F.max(high).over(Window.partitionBy(by).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_new").over(Window.partitionBy(by).orderBy(low, high).rowsBetween(Window.unboundedPreceding, 0))
    return (
        ranges.where(F.col(low) <= F.col(high))
        .withColumn("_new", F.coalesce(F.col(low) > reach + 1, F.lit(True)).cast("int"))
        .withColumn("_island", island)
        .groupBy(by, "_island")
        .agg(F.min(low).alias(low), F.max(high).alias(high))
        .drop("_island")
    )


def good_ranges(runs: DataFrame) -> DataFrame:
    """``stage, low, high`` of the runs whose last logged status is ``ok``.

    At one instant a final status counts as later than ``started``.
    """
    order = F.struct("logged_at", (F.col("status") != "started").alias("final"), "status")
    return (
        runs.groupBy("stage", "run_no")
        .agg(F.max_by("status", order).alias("last"), F.max_by(F.struct("from_batch", "to_batch"), order).alias("span"))
        .where(F.col("last") == "ok")
        .select("stage", F.col("span.from_batch").cast("bigint").alias("low"), F.col("span.to_batch").cast("bigint").alias("high"))
    )


def gaps(stages: DataFrame, available: DataFrame, processed: DataFrame) -> DataFrame:
    """``stage, low, high``: available minus processed, for every stage.

    ``stages`` has ``stage``; ``available`` has one row ``first, last``;
    ``processed`` holds disjoint intervals ``stage, low, high``.  Each processed
    interval closes a gap and opens the next one behind it.
    """
    bounds = stages.crossJoin(F.broadcast(available)).where(F.col("first").isNotNull())
    fences = bounds.select("stage", (F.col("first") - 1).alias("low"), (F.col("first") - 1).alias("high"), "last").unionByName(
        processed.join(bounds, "stage").select("stage", "low", "high", "last")
    )
    following = F.lead("low").over(Window.partitionBy("stage").orderBy("low", "high"))
    return (
        fences.withColumn("_next", F.coalesce(following - 1, F.col("last")))
        .select("stage", (F.col("high") + 1).alias("low"), F.least("_next", "last").alias("high"))
        .where(F.col("low") <= F.col("high"))
    )


def newest_changes(arrivals: DataFrame, key: list[str], batch: str, order: str, digest: str) -> DataFrame:
    """``key..., change_batch``: the batch of the newest change of every record.

    A delivery is a change if it is the first of its key or its digest differs
    from the one before, by (batch, order).  Deliveries of one (key, batch) are
    first folded to their first and last digest and whether they all agree;
    that combines before the shuffle, so a key delivered without end costs one
    row a batch.  A null digest is a value of its own.
    """
    plain = arrivals.select(*key, F.col(batch).alias("_batch"), F.col(order).alias("_order"), F.coalesce(digest, F.lit("\0null")).alias("_digest"))
    folded = plain.groupBy(*key, "_batch").agg(
        F.min(F.struct("_order", "_digest")).getField("_digest").alias("_first"),
        F.max(F.struct("_order", "_digest")).getField("_digest").alias("_last"),
        (F.min("_digest") != F.max("_digest")).alias("_mixed"),
    )
    before = F.lag("_last").over(Window.partitionBy(*key).orderBy("_batch"))
    changed = F.col("_mixed") | before.isNull() | (before != F.col("_first"))
    return folded.withColumn("_changed", changed).where("_changed").groupBy(*key).agg(F.max("_batch").alias("change_batch"))


def pending_messages(arrivals: DataFrame, runs: DataFrame, messages: DataFrame, group_only: Iterable[str] = ("extract",)) -> DataFrame:
    """``stage, id, chat_jid``: what the next run of each stage has to process.

    The newest change of the message must lie in a gap of the stage and its
    present text must not be blank; stages in ``group_only`` take group
    messages only (a null ``is_group`` is no group).  An empty log gives no
    stage and so no row.
    """
    changes = newest_changes(arrivals, ["id", "chat_jid"], "batch_no", "arrival_no", "text_digest")
    available = arrivals.agg(F.min("batch_no").cast("bigint").alias("first"), F.max("batch_no").cast("bigint").alias("last"))
    stages = runs.select("stage").distinct()
    todo = gaps(stages, available, union_of_ranges(good_ranges(runs), "stage", "low", "high"))
    present = messages.where(~blank(F.col("text_content"))).select("id", "chat_jid", F.coalesce("is_group", F.lit(False)).alias("_group"))
    # the log of runs bounds the number of gaps, so they go to every executor
    due = changes.join(F.broadcast(todo), F.col("change_batch").between(F.col("low"), F.col("high"))).select("stage", "id", "chat_jid")
    due = due.groupBy("id", "chat_jid").agg(F.collect_set("stage").alias("_stages"))
    found = due.join(present.groupBy("id", "chat_jid").agg(F.max("_group").alias("_group")), ["id", "chat_jid"])
    return found.select(F.explode("_stages").alias("stage"), "id", "chat_jid", "_group").where(~F.col("stage").isin(*group_only) | F.col("_group")).drop("_group")


class IntervalLedger:
    """Processed intervals of a stage, committed together with its output.

    Each run writes its rows into a folder of its own and then publishes one
    commit file that names its number, its folder, the intervals it covered and
    the merged intervals of all runs up to it.  The file is written whole under
    another name and then renamed, which fails if the number is taken: a run
    that dies at any point leaves no rows and no interval, and of two runs that
    race one commits.  What died is ignored; ``clear`` deletes it.  A next run
    reads the last commit only; ``output`` takes the folders of all.
    """

    def __init__(self, spark: SparkSession, root: str, stage: str):
        self.spark, self.root, self.stage = spark, root.rstrip("/"), stage
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._home = f"{self.root}/{stage}"
        self._commits = f"{self._home}/_commits"

    def _numbers(self) -> list[int]:
        """Numbers of the published commits; a name not yet renamed is none."""
        at = self._path(self._commits)
        if not self._fs.exists(at):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(at))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _commit(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self._commits}/{number:06d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        return [self._commit(n) for n in self._numbers()]

    def processed(self) -> list[Interval]:
        numbers = self._numbers()
        return [tuple(span) for span in self._commit(numbers[-1])["processed"]] if numbers else []

    def plan(self, available: Iterable[Interval]) -> list[Interval]:
        return subtract_intervals(available, self.processed())

    def run(self, available: Iterable[Interval], work: Callable[[list[Interval]], DataFrame]) -> list[Interval]:
        """Processes the gaps and commits them; returns the intervals covered.

        Raises ``FileExistsError`` where another run committed in between; the
        gaps are then planned anew by the next call.
        """
        numbers = self._numbers()
        before = [tuple(span) for span in self._commit(numbers[-1])["processed"]] if numbers else []
        todo = subtract_intervals(available, before)
        if not todo:
            return []
        number = numbers[-1] + 1 if numbers else 1
        folder = f"{self._home}/run-{number:06d}-{uuid.uuid4().hex[:8]}"
        work(todo).write.parquet(folder)
        self._publish(number, {"number": number, "folder": folder, "intervals": todo, "processed": merge_intervals([*before, *todo])})
        return todo

    def _publish(self, number: int, commit: dict) -> None:
        target = self._path(f"{self._commits}/{number:06d}.json")
        draft = self._path(f"{self._commits}/_draft-{number:06d}-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(self._commits))
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(commit).encode()))
        finally:
            stream.close()
        # the context's rename refuses a name that is there, on every file system that Hadoop knows
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), rename)
        except Exception as failed:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise FileExistsError(f"run {number} of {self.stage} is committed already") from failed
            raise

    def clear(self) -> list[str]:
        """Deletes the drafts and run folders that no commit names; call it while no run is at work."""
        kept = {c["folder"].rsplit("/", 1)[-1] for c in self.commits()}
        gone = []
        for at, left in ((self._home, lambda n: n.startswith("run-") and n not in kept), (self._commits, lambda n: n.startswith("_draft-"))):
            if self._fs.exists(self._path(at)):
                for status in self._fs.listStatus(self._path(at)):
                    if left(status.getPath().getName()):
                        self._fs.delete(status.getPath(), True)
                        gone.append(status.getPath().getName())
        return gone

    def output(self) -> DataFrame | None:
        """The rows of all committed runs; None before the first."""
        folders = [c["folder"] for c in self.commits()]
        return self.spark.read.parquet(*folders) if folders else None
