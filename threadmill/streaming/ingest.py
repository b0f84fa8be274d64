"""Streaming ingest: events to messages and contacts, idempotent by key.

Late events are always taken: there is no watermark on ingest, so nothing is
dropped for being old, and no state grows with the stream either, since each
micro-batch is checked against the stored keys.  The store is cut by a hash of
the key, and a micro-batch reads the keys of the cuts that it touches only.  A
batch that is replayed after a failure writes the same folder again.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from threadmill.functions.columns import sent_parts
from threadmill.operators.upsert import last_wins, new_rows

#: An event: its kind, and what the kinds carry.
EVENT = T.StructType(
    [
        T.StructField("event_type", T.StringType()),  # history, message, contact, progress
        T.StructField("id", T.StringType()),
        T.StructField("chat_jid", T.StringType()),
        T.StructField("sender_jid", T.StringType()),
        T.StructField("is_from_me", T.BooleanType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("push_name", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

#: Variants of a payload in the order in which they are tried.
PAYLOAD = ("conversation", "extended", "image", "video", "audio", "document", "sticker", "location", "contact", "reaction")


def decoded(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``msg_type, text_content, media_type`` from a JSON payload.

    The first variant present decides; a location's text is ``lat,lon`` with six
    decimals; a payload without a known variant is ``other``.
    """
    part = lambda name, leaf: F.get_json_object(payload, f"$.{name}.{leaf}")
    there = {v: F.get_json_object(payload, f"$.{v}").isNotNull() for v in PAYLOAD}
    kind = {"conversation": "text", "extended": "text"}
    text = {
        "conversation": F.get_json_object(payload, "$.conversation"),
        "extended": part("extended", "text"),
        "image": part("image", "caption"),
        "video": part("video", "caption"),
        "document": F.coalesce(part("document", "caption"), part("document", "title")),
        "location": F.concat_ws(",", F.format_string("%.6f", part("location", "lat").cast("double")), F.format_string("%.6f", part("location", "lon").cast("double"))),
        "contact": part("contact", "name"),
        "reaction": part("reaction", "text"),
    }
    kinds = texts = mimes = None
    for v in PAYLOAD:
        value = text.get(v, F.lit(None).cast("string"))
        mime = part(v, "mime") if v in ("image", "video", "audio", "document", "sticker") else F.lit(None).cast("string")
        kinds = F.when(there[v], kind.get(v, v)) if kinds is None else kinds.when(there[v], kind.get(v, v))
        texts = F.when(there[v], value) if texts is None else texts.when(there[v], value)
        mimes = F.when(there[v], mime) if mimes is None else mimes.when(there[v], mime)
    return events.withColumn("msg_type", kinds.otherwise("other")).withColumn("text_content", texts).withColumn("media_type", mimes)


def as_messages(events: DataFrame) -> DataFrame:
    """Message events as rows of the store; events without id, chat or time cannot be read and are skipped."""
    whole = events.where(F.col("event_type").isin("history", "message") & F.col("id").isNotNull() & F.col("chat_jid").isNotNull() & F.col("timestamp").isNotNull())
    rows = decoded(whole).withColumn("is_group", F.col("chat_jid").endswith("@g.us")).withColumn("is_from_me", F.coalesce("is_from_me", F.lit(False)))
    for name, part in sent_parts(F.col("timestamp")).items():
        rows = rows.withColumn(name, part)
    return rows.select("id", "chat_jid", "sender_jid", "is_from_me", "is_group", "timestamp", "msg_type", "text_content", "media_type", "push_name", "sent_date", "sent_hour", "sent_dow")


def as_contacts(events: DataFrame) -> DataFrame:
    named = events.where((F.col("event_type") == "contact") & F.col("chat_jid").isNotNull())
    return named.select(F.col("chat_jid").alias("jid"), "push_name", F.coalesce("seq", F.lit(0)).alias("seq"))


@dataclass
class Counters(StreamingQueryListener):
    """What a running ingest has seen so far; closes once, when the stream ends."""

    rows: int = 0
    batches: int = 0
    done: bool = False
    on_done: list[Callable[[], None]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__()

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.close()

    def close(self) -> None:
        if not self.done:
            self.done = True
            for call in self.on_done:
                call()


class Completion:
    """When a history that arrives in pieces counts as complete.

    It is complete after ``initial`` seconds without any piece, ``between``
    seconds without a further one, or ``settle`` seconds after the last one
    that reported a progress of 100 or more.  Once complete it stays so.
    """

    def __init__(self, initial: float = 30.0, between: float = 600.0, settle: float = 20.0, clock: Callable[[], float] = time.monotonic):
        self._between, self._settle, self._clock = between, settle, clock
        self._lock = threading.Lock()
        self._due = clock() + initial
        self._done = False

    def saw(self, progress: int | None) -> None:
        """A piece of history with its progress (None: not told)."""
        with self._lock:
            self._due = self._clock() + (self._settle if progress is not None and progress >= 100 else self._between)

    @property
    def done(self) -> bool:
        with self._lock:
            self._done = self._done or self._clock() >= self._due
            return self._done


#: Into how many cuts the keys of the store are divided.
CUTS = 64


class Store:
    """Messages and contacts as folders of parquet: one a micro-batch, cut by a hash of the key."""

    def __init__(self, spark: SparkSession, root: str, cuts: int = CUTS):
        self.spark, self.root, self.cuts = spark, root.rstrip("/"), cuts

    def _cut(self) -> F.Column:
        return F.pmod(F.xxhash64("id", "chat_jid"), F.lit(self.cuts)).cast("int").alias("cut")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def messages(self, below: int | None = None) -> DataFrame:
        """Stored messages, those of batches before ``below`` if given."""
        plain = as_messages(self.spark.createDataFrame([], EVENT)).schema
        stored = self._read("messages", T.StructType([*plain.fields, T.StructField("batch", T.LongType()), T.StructField("cut", T.IntegerType())]))
        return stored if below is None else stored.where(F.col("batch") < below)

    def contacts(self) -> DataFrame:
        """The last row of a jid wins."""
        plain = as_contacts(self.spark.createDataFrame([], EVENT)).schema
        rows = self._read("contacts", T.StructType([*plain.fields, T.StructField("batch", T.LongType())]))
        return last_wins(rows, ["jid"], F.struct("batch", "seq"), ["push_name"])

    def write(self, events: DataFrame, batch: int) -> None:
        """One micro-batch: new keys only; written again, it replaces itself."""
        fresh = as_messages(events).withColumn("cut", self._cut())
        touched = [r["cut"] for r in fresh.select("cut").distinct().collect()]  # at most ``cuts``
        stored = self.messages(below=batch).where(F.col("cut").isin(*touched)) if touched else self.messages(below=batch).limit(0)
        new = new_rows(stored.select("id", "chat_jid"), fresh, ["id", "chat_jid"])
        new.write.mode("overwrite").partitionBy("cut").parquet(f"{self.root}/messages/batch={batch}")
        as_contacts(events).write.mode("overwrite").parquet(f"{self.root}/contacts/batch={batch}")

    def high_water(self):
        """The newest message time; for display, never for filtering."""
        return self.messages().agg(F.max("timestamp")).first()[0]


def ingest(events: DataFrame, store: Store, checkpoint: str, live: bool = False, completion: Completion | None = None, every: str = "5 seconds") -> StreamingQuery:
    """Starts the stream: what is there, then stop, or ``live`` until it is stopped.

    ``completion`` is told of every micro-batch that holds history or progress.
    """

    def take(batch: DataFrame, number: int) -> None:
        # read by two writes and the look at progress
        batch.persist()
        try:
            store.write(batch, number)
            if completion is not None:
                seen = batch.where(F.col("event_type").isin("history", "progress")).agg(F.count(F.lit(1)).alias("n"), F.max("progress").alias("progress")).first()
                if seen["n"]:
                    completion.saw(seen["progress"])
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if live else writer.trigger(availableNow=True)).start()


def ingest_history(events: DataFrame, store: Store, checkpoint: str, completion: Completion | None = None, every: str = "5 seconds", poll: float = 1.0) -> None:
    """Ingests until the history counts as complete, then stops; a failure of the stream is raised."""
    completion = completion or Completion()
    running = ingest(events, store, checkpoint, live=True, completion=completion, every=every)
    try:
        while not completion.done:
            if running.awaitTermination(poll):
                return
        running.processAllAvailable()
    finally:
        running.stop()
