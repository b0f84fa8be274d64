import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from threadmill.llm.mixing import close_gap, exchange, mixture, mixture_faults, mixture_report, plan_mixture, rake


def test_rake_meets_both_marginals():
    tokens = np.array([10.0, 20, 30, 40])
    rows, cols = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    f = rake(tokens, [(cols, np.array([35.0, 65.0])), (rows, np.array([50.0, 50.0]))], np.full(4, 99.0))
    assert np.allclose(np.bincount(rows, f * tokens), [50, 50]) and np.allclose(np.bincount(cols, f * tokens), [35, 65])


def test_caps_hold_and_the_source_makes_up_for_them():
    tokens, rows, cols = np.array([1.0, 100, 50]), np.array([0, 0, 1]), np.array([0, 1, 1])
    f = rake(tokens, [(cols, np.array([80.0, 20.0])), (rows, np.array([60.0, 40.0]))], np.array([2.0, 2, 2]))
    assert f.max() <= 2 and np.allclose(np.bincount(rows, f * tokens), [60, 40])


def test_total_is_the_largest_feasible():
    cells = pd.DataFrame({"source": ["a", "b"], "lang": "en", "form": "prose", "tokens": [100, 1000]})
    targets = pd.DataFrame({"source": ["a", "b", "gone"], "target_share": [0.4, 0.4, 0.2], "max_repeats": [3, 1, 5]})
    plan = plan_mixture(cells, targets)
    assert np.allclose(plan["factor"], [3.0, 0.3])


def test_gap_closing():
    assert close_gap(10, {7: 2, 3: 1, 1: 5}, {}) == {7: 1, 3: 1}
    assert close_gap(-8, {}, {5: 1, 3: 1, 2: 1}) == {5: -1, 3: -1}


def test_mixture_reaches_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(1, 400)), rng.choice(["en", "EN", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    rows += [(9000, None, "en", "a"), (9001, "", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.25, 4), ("d", 0.05, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture(docs, targets)
    got = mixed.collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got} == {r[0] for r in rows}
    cap = {"a": 1, "b": 2, "c": 4, None: 0}
    assert all(0 <= r["uses"] <= cap[r["source"]] for r in got)
    report = {r["source"]: r for r in mixture_report(mixed, targets).collect()}
    for source, share in (("a", 0.3), ("b", 0.4), ("c", 0.25)):
        assert abs(report[source]["reached_share"] - share / 0.95) < 0.01
    assert report["d"]["reached_share"] == 0
    assert mixture(docs.limit(0), targets).count() == 0
    assert mixture(docs, targets.limit(0)).agg(F.sum("uses")).first()[0] == 0


def test_sources_of_long_documents_close_their_gap(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randint(600, 900)), "en", "long") for i in range(60)] + [(100 + i, " ".join(["word"] * rng.randint(1, 60)), "en", "short") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("long", 0.55, 1), ("short", 0.45, 2)], "source string, target_share double, max_repeats int")
    mixed = mixture(docs, targets)
    told = mixture_faults(mixed, targets, docs).first()
    assert (told["twice"], told["over_cap"], told["below_none"], told["lost"]) == (0, 0, 0, 0)
    report = {r["source"]: r for r in mixture_report(mixed, targets).collect()}
    # within one document, and nothing shorter than the gap was left unused
    assert abs(report["long"]["reached_share"] - 0.55) < 0.02


def test_exchanged_uses_come_as_near_as_whole_documents_can():
    assert exchange(-1194, 110, {50: 2, 60: 1}, {1304: 1}) == {1304: -1, 50: 1, 60: 1}
    assert exchange(20, 120, {70: 2}, {50: 2}) == {50: -1, 70: 1}
    assert exchange(3, 100, {90: 1}, {97: 1}) == {}


def test_the_total_is_one_that_whole_documents_make(spark):
    rows = [(i, " ".join(["word"] * n), "en", source) for i, (n, source) in enumerate([(164, "long"), (164, "long"), (76, "long"), (40, "short"), (1, "short"), (1, "short")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("long", 0.6, 1), ("short", 0.3, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture(docs, targets)
    assert {r["source"]: r["used_tokens"] for r in mixture_report(mixed, targets).collect()} == {"long": 240, "short": 120, "gone": 0}
    assert tuple(mixture_faults(mixed, targets, docs).first()) == (0, 0, 0, 0, True)
    unused = mixed.withColumn("uses", F.lit(0))
    assert not mixture_faults(unused, targets, docs).first()["shares_met"]
    assert mixture_faults(mixed.limit(0), targets, docs.limit(0)).first()["shares_met"]
