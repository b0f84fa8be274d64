import json

import pytest

from threadmill import cli

ROOT = "/root/testdata/sf0.001"


def test_reports_and_statistics(spark):
    lines = [json.loads(line) for line in cli.run(spark, [ROOT, "report", "all", "--as-of-us", "1780272000000000"])]
    assert {line["from"] for line in lines} <= {"summary", "unanswered", "stale", "top_contacts"} and "summary" in {line["from"] for line in lines}
    counted = {line["table_name"]: line["n_rows"] for line in map(json.loads, cli.run(spark, [ROOT, "stats"]))}
    assert counted["messages"] > counted["contacts"] > 0 and "MemberOf" in counted
    with pytest.raises(SystemExit):
        cli.run(spark, [ROOT, "report", "nothing"])


def test_search_by_words(spark):
    lines = [json.loads(line) for line in cli.run(spark, [ROOT, "search", "gates", "--after", "2020-01-01"])]
    told = [line for line in lines if line["kind"] == "message"]
    assert told and all("gate" in line["text"].lower() for line in told[:1])
    assert cli.run(spark, [ROOT, "search", "zyxgfd", "--depth", "fast"]) == []
