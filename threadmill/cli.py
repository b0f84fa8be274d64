"""Command line: reports, search, statistics and registered queries over a folder of parquet tables."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from threadmill import queries_core
from threadmill.operators import filters
from threadmill.plans import graph, reports, retrieval, store
from threadmill.sources.tables import SCHEMAS, reader

REPORTS = ("summary", "unanswered", "stale", "response-time", "top-contacts", "heatmap", "search", "all")


def report(spark: SparkSession, root: str, name: str, term: str = "", as_of_us: int | None = None) -> dict[str, DataFrame]:
    """The named reports; ``all`` gives four of them."""
    t = reader(spark, root)
    now = as_of_us if as_of_us is not None else time.time_ns() // 1000
    messages = store.messages(t("messages"), "text_content", "sent_dow", "sent_hour", names=True)
    made = {
        "summary": lambda: reports.summary(messages),
        "unanswered": lambda: reports.unanswered(messages, now),
        "stale": lambda: reports.stale(messages, now),
        "response-time": lambda: reports.response_time(messages, store.contacts(t("contacts"))),
        "top-contacts": lambda: reports.top_contacts(messages),
        "heatmap": lambda: reports.heatmap(messages),
        "search": lambda: reports.search_text(messages, term),
    }
    return reports.all_reports(messages, now) if name == "all" else {name: made[name]()}


def stats(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the stored tables, and of the graph's relations."""
    t = reader(spark, root)
    parts = queries_core.graph_parts(spark, root)
    return reports.table_counts({n: t(n) for n in SCHEMAS}).unionByName(graph.graph_counts({label: parts[relation] for labels in graph.GRAPH.values() for label, relation in labels.items()}))


def search(spark: SparkSession, root: str, query: str, depth: str, keywords: Sequence[str], chat: str | None, after: str | None, before: str | None) -> DataFrame:
    """Words only, as no embedder is at hand here: people and messages as lines of JSON."""
    t = reader(spark, root)
    contacts = store.contacts(t("contacts"))
    chats = filters.resolve_chats(contacts, chat) if chat else None
    messages = store.messages(t("messages"), "text_content", "timestamp", names=True).withColumnRenamed("timestamp", "time")
    if chats is not None:
        messages = messages.join(chats.withColumnRenamed("jid", "chat_jid"), "chat_jid", "left_semi")
    wanted = filters.SearchFilter(keywords=tuple(keywords), after=after, before=before)
    found = retrieval.run_search(query, None, messages, contacts, queries_core.graph_parts(spark, root), retrieval.TextIndex.build(messages), depth, wanted)
    return retrieval.as_json(found["results"], found["people"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="threadmill", description=__doc__)
    top.add_argument("root", help="folder that holds messages.parquet and the other tables")
    kinds = top.add_subparsers(dest="command", required=True)
    one = kinds.add_parser("report")
    one.add_argument("name", choices=REPORTS)
    one.add_argument("--term", default="")
    one.add_argument("--as-of-us", type=int)
    kinds.add_parser("stats")
    one = kinds.add_parser("search")
    one.add_argument("query")
    one.add_argument("--depth", choices=tuple(retrieval.DEPTHS), default="balanced")
    one.add_argument("--keyword", action="append", default=[])
    one.add_argument("--chat")
    one.add_argument("--after")
    one.add_argument("--before")
    one = kinds.add_parser("query")
    one.add_argument("name")
    return top


def run(spark: SparkSession, arguments: Sequence[str]) -> list[str]:
    """The lines that a command prints: one JSON object a row."""
    given = parser().parse_args(arguments)
    if given.command == "report":
        frames = report(spark, given.root, given.name, given.term, given.as_of_us)
    elif given.command == "stats":
        frames = {"stats": stats(spark, given.root)}
    elif given.command == "search":
        found = search(spark, given.root, given.query, given.depth, given.keyword, given.chat, given.after, given.before)
        return [row["line"] for row in found.collect()]  # at most 40
    else:
        frames = {given.name: queries_core.QUERIES[given.name](spark, given.root)}
    lines = []
    for name, frame in frames.items():
        lines += [json.dumps({"from": name, **row.asDict(recursive=True)}, default=str, ensure_ascii=False) for row in frame.limit(1_000).collect()]
    return lines


def main() -> None:
    import sys

    from threadmill.session import build_session

    for line in run(build_session(), sys.argv[1:]):
        print(line)
