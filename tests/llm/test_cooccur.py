import itertools
import random

from threadmill.llm.cooccur import associations, collapsed_baskets, item_pairs


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for m in range(400):
        rows += [(f"m{m}", v) for v in rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 4))]
        if m % 20 == 0:
            rows += [(f"m{m}", "P"), (f"m{m}", "Q"), (f"m{m}", "Q")]
    rows += [(None, "a"), ("m1", None)]
    real = {(m, v) for m, v in rows if m and v}
    of = {}
    for m, v in real:
        of.setdefault(v, set()).add(m)
    n = len({m for m, _ in real})
    want = {(a, b, len(of[a] & of[b])) for a, b in itertools.combinations(sorted(of), 2) if len(of[a] & of[b]) >= 3 and len(of[a] & of[b]) * n >= 2.0 * len(of[a]) * len(of[b])}
    df = spark.createDataFrame(rows, "m string, v string")
    found = associations(df, "m", "v", 3, 2.0).collect()
    assert {(r["value_a"], r["value_b"], r["n_ab"]) for r in found} == want
    assert all(r["lift"] >= 2 for r in found)
    assert associations(df.limit(0), "m", "v").count() == 0


def test_equal_baskets_are_counted_once(spark):
    df = spark.createDataFrame([(m, v) for m in range(50) for v in "ab"], "m int, v string")
    assert [(r["items"], r["weight"]) for r in collapsed_baskets(df, "m", "v").collect()] == [(["a", "b"], 50)]


def test_a_large_basket_gives_the_same_pairs_in_parts(spark):
    baskets = [([f"v{i:02d}" for i in range(17)], 3), (["v03", "v09"], 2), (["v01"], 5)]
    df = spark.createDataFrame(baskets, "items array<string>, weight bigint")
    want = {(a, b): 3 + 2 * ((a, b) == ("v03", "v09")) for a, b in itertools.combinations(baskets[0][0], 2)}
    for large in (256, 4, 1):
        assert {(r["value_a"], r["value_b"]): r["n_ab"] for r in item_pairs(df, large).collect()} == want
