import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm.packing import fill_report, pack, packing_faults, plan_patterns


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_patterns_use_every_item_once_and_fit(histogram):
    used = Counter()
    for times, pattern in plan_patterns(histogram, 64):
        assert times > 0 and sum(length * n for length, n in pattern.items()) <= 64
        for length, n in pattern.items():
            used[length] += n * times
    assert used == Counter(histogram)


def test_two_tighter_items_replace_the_smallest():
    # greedy gives 60 + 3; the gap of 7 behind 3 takes 4 + 3 instead
    plan = plan_patterns({60: 1, 4: 1, 3: 1, 2: 1}, 64)
    assert Counter({60: 1, 4: 1}) in [Counter(p) for _, p in plan]
    plan = plan_patterns({50: 1, 9: 1, 8: 1, 6: 1}, 64)
    assert Counter(plan[0][1]) == Counter({50: 1, 8: 1, 6: 1})


def test_pack_covers_all_and_leaves_little(spark):
    rng = random.Random(2)
    rows = [(i, int(min(20_000, rng.lognormvariate(5.2, 1.1)))) for i in range(3000)] + [(9000, 0), (9001, None), (9002, 5000), (9002, 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    found = pack(df, "doc_id", "n_tokens", 2048, shard_items=700)
    got = found.collect()
    load = Counter()
    for r in got:
        if r["size"]:
            load[r["container_no"]] += r["size"]
        else:
            assert r["container_no"] is None
    assert max(load.values()) <= 2048
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["size"]
    want = Counter()
    for i, n in rows:
        want[i] += n or 0
    assert total == want
    split = Counter(r["doc_id"] for r in got)
    sizes = dict(rows)
    assert all(n == 1 or (sizes[i] or 0) > 2048 for i, n in split.items())
    report = fill_report(found).first()
    assert report["containers"] <= report["least_containers"] * 1.02 + 1
    assert pack(df.limit(0), "doc_id", "n_tokens").count() == 0


def test_faults_are_told(spark):
    documents = spark.createDataFrame([(1, 30), (2, 80), (3, 250), (4, 0)], "doc_id bigint, n_tokens bigint")
    packed = pack(documents, "doc_id", "n_tokens", 100)
    assert packing_faults(packed, documents, 100).first().asDict() == {"placed": 3, "split_needlessly": 0, "torn": 0, "over_full": 0, "tight": True, "lost": 0}
    bad = spark.createDataFrame([(1, 0, 0, 0, 30), (2, 0, 0, 0, 50), (2, 1, 0, 50, 30), (3, 0, 1, 0, 100)], "doc_id bigint, piece_no int, container_no bigint, start bigint, size int")
    told = packing_faults(bad, documents, 100).first()
    assert (told["over_full"], told["split_needlessly"], told["lost"]) == (1, 1, 1)
