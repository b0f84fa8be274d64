import difflib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadmill.functions.stemming import stem, terms

from threadmill.operators import filters, intervals, upsert
from threadmill.plans import entities, graph, reports, retrieval

M = intervals.MINUTE


def test_replies_bounds_and_buckets(spark):
    day = intervals.DAY
    rows = [("c", 0, False), ("c", 0, False), ("c", 10, True), ("d", 0, False), ("d", day, True), ("e", 5, False), ("e", day + 4, True), ("f", day - 5, False), ("f", day + 5, True), ("g", 7, False), ("g", 7, True)]
    found = {tuple(r) for r in intervals.replies(spark.createDataFrame(rows, "chat_jid string, us bigint, mine boolean")).collect()}
    assert found == {("c", 0, 10), ("e", 5, day + 4), ("f", day - 5, day + 5)}


def test_exchanges_count_the_lower_one_first(spark):
    rows = [("g", "a", 0), ("g", "b", 5 * M), ("g", "b", 5 * M + 1), ("g", "a", 5 * M + 2), ("g", "b", 5 * M + 2), ("h", "b", 0)]
    got = [tuple(r) for r in intervals.exchanges(spark.createDataFrame(rows, "chat_jid string, sender string, us bigint")).collect()]
    assert got == [("a", "b", "g", 2, 0, 5 * M + 2)]


def test_context_is_strict_before_and_bounded(spark):
    rows = [("c", str(i), i * 10 * M, f"t{i}") for i in range(8)] + [("c", "9", 30 * M, "same")]
    got = {r["id"]: (r["before"], r["after"]) for r in intervals.context_texts(spark.createDataFrame(rows, "chat_jid string, id string, us bigint, text string")).collect()}
    assert got["3"] == ("t0\nt1\nt2", "same\nt4\nt5") and got["0"] == ("", "t1\nt2\nt3") and got["7"] == ("t4\nt5\nt6", "")


@pytest.mark.parametrize("text,open_", [("👍", False), ("thanks!", False), ("ok, will do", False), ("Noted 👍", False), ("no", False), ("where is it?", True), ("thanks for that, when do we meet", True), (None, False)])
def test_closing_phrases(spark, text, open_):
    assert bool(spark.createDataFrame([(text,)], "t string").select(reports.needs_answer(F.col("t"))).first()[0]) is open_


def test_upserts(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert {tuple(r) for r in upsert.first_wins(rows, ["k"], F.col("seq"), ["v"]).collect()} == {("a", "x"), ("b", "z")}
    assert {tuple(r) for r in upsert.last_wins(rows, ["k"], F.col("seq"), ["v"]).collect()} == {("a", "y"), ("b", "z")}
    target = spark.createDataFrame([("a", "old"), ("c", "keep")], "k string, v string")
    assert {r["k"] for r in upsert.new_rows(target, rows.select("k", "v"), ["k"]).collect()} == {"b"}
    changed = upsert.updated(target, spark.createDataFrame([("a", None)], "k string, v string"), ["k"], "v")
    assert {tuple(r) for r in changed.select("k", "v").collect()} == {("a", None), ("c", "keep")}


def test_chat_resolver(spark):
    contacts = spark.createDataFrame([("1@s", "Ann", None, None, False), ("g@g", None, None, "Anns group", True)], "jid string, push_name string, full_name string, group_name string, is_group boolean")
    assert {r["jid"] for r in filters.resolve_chats(contacts, "ann").collect()} == {"1@s", "g@g"}
    assert filters.resolve_chats(contacts, "") is None
    assert [r["jid"] for r in filters.resolve_chats(contacts, "x@y").collect()] == ["x@y"]
    with pytest.raises(ValueError):
        filters.resolve_chats(contacts, "nobody")


def test_rank_sums_to_one_and_spares_the_unreachable(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0), ("b", "a", 1.0), ("x", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 2.0), ("gone", 5.0)], "node string, weight double")
    got = {r["node"]: r["score"] for r in graph.personalized_rank(edges, seeds, steps=100, tolerance=1e-12).collect()}
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-9) and got["x"] == 0 and got["a"] > got["b"] > got["c"] > 0
    assert graph.personalized_rank(edges, seeds.where("node = 'gone'")).count() == 0


def test_flow_paths(spark):
    edges = spark.createDataFrame([("a", "m", 1.0), ("m", "b", 1.0), ("a", "n", 1.0), ("n", "b", 1.0), ("b", "z", 1.0)], "src string, dst string, weight double")
    got = [(r["source"], r["target"], r["path"], r["hops"]) for r in graph.flow_paths(edges, ["a", "b", "nobody"]).collect()]
    assert got == [("a", "b", ["a", "m", "b"], 2)]


def test_every_node_that_passes_enough_sends(spark):
    rows = [("a", f"m{i:03}", 1.0) for i in range(600)] + [(f"m{i:03}", "z", 1.0) for i in range(600)]
    held = graph.resource_flow(spark.createDataFrame(rows, "src string, dst string, weight double"), spark.createDataFrame([("a",)], "node string"))
    assert held.where("node = 'z'").first()["resource"] == pytest.approx(0.49)


def _random_graph(spark):
    draw = random.Random(5)
    people = [f"p{i:02}" for i in range(40)]
    direct = spark.createDataFrame([(draw.choice(people[:30]), draw.choice(people), 1 + i % 3) for i in range(40)], "sender string, receiver string, message_count bigint").groupBy("sender", "receiver").agg(F.sum("message_count").alias("message_count"))
    talked = spark.createDataFrame([("p01", "p02", 4), ("p03", "p39", 1)], "person1 string, person2 string, exchange_count bigint")
    members = spark.createDataFrame(sorted({(draw.choice(people), f"g{draw.randrange(9)}") for _ in range(25)}), "person string, group_jid string")
    mentioned = spark.createDataFrame(sorted({(draw.choice(people), "org", f"e{draw.randrange(7)}") for _ in range(25)}), "person string, entity_type string, entity_value string")
    return direct, talked, members, mentioned


def test_flow_paths_through_hubs_are_those_of_their_pairs(spark):
    direct, talked, members, mentioned = _random_graph(spark)
    seeds = ["p01", "p07", "p20", "p33", "p39", "nobody"]
    made = graph.flow_paths(graph.weighted_digraph(direct, talked, members, mentioned), seeds).collect()
    got = graph.flow_paths(graph.talk_edges(direct, talked), seeds, hubs=graph.hubs_of(members, mentioned)).collect()
    assert made and [r[:3] + (round(r["score"], 9), r["hops"]) for r in got] == [r[:3] + (round(r["score"], 9), r["hops"]) for r in made]
    assert max(r["hops"] for r in got) > 1


def test_weighted_digraph_by_blocks_and_by_joins(spark):
    direct, talked, members, mentioned = _random_graph(spark)
    weights = {}
    for a, b, w in [(r[0], r[1], 3.0 * r[2]) for r in direct.collect()] + [(x, y, 5.0 * r[2]) for r in talked.collect() for x, y in (r[:2], r[1::-1])]:
        weights[a, b] = weights.get((a, b), 0) + w
    for rows, w in ((members.collect(), 1.0), (mentioned.collect(), 2.0)):
        for one in rows:
            for two in rows:
                if one[0] != two[0] and one[1:] == two[1:]:
                    weights[one[0], two[0]] = weights.get((one[0], two[0]), 0) + w
    for block, dense in ((2_048, 20_000), (7, 0), (7, 20_000)):
        got = [tuple(r) for r in graph.weighted_digraph(direct, talked, members, mentioned, block, dense).collect()]
        assert len(got) == len(weights) and {(a, b): w for a, b, w in got} == weights


def test_sums_of_small_and_large_lists():
    rows, columns = pa.array([[0, 2], [1], [3, 1, 0]], pa.list_(pa.int32())), pa.array([[1], [0, 2], [2, 1]], pa.list_(pa.int32()))
    wanted = np.zeros((4, 3))
    for r, c, w in zip(rows.to_pylist(), columns.to_pylist(), (1.0, 2.0, 4.0)):
        wanted[np.ix_(r, c)] += w
    for small, most in ((4_096, 4_000_000), (0, 1), (2, 3), (9, 1)):
        sums = np.zeros((4, 3))
        graph._add_products(sums, np.array([1.0, 2.0, 4.0]), rows, columns, small, most)
        assert (sums == wanted).all()


@pytest.mark.parametrize("one_task", [500_000, 6])
def test_communities_are_connected_and_better_than_one(spark, one_task):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "pqr" for i in range(5) for j in range(i + 1, 5)] + [("p0", "q0", 0.5), ("q1", "r1", 0.5), ("s", "s", 9.0)]
    edges = spark.createDataFrame(pairs, "src string, dst string, weight double")
    member = graph.communities(edges, one_task=one_task).cache()
    groups = {}
    for r in member.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[f"{g}{i}" for i in range(5)] for g in "pqr"]
    assert set(groups) == {"p0", "q0", "r0"}
    assert graph.modularity(edges.where("src <> dst"), member).first()[0] > 0.6
    assert graph.communities(edges.where("src = dst")).count() == 0
    people = spark.createDataFrame([("p1",), ("q3",), ("nobody",)], "source_id string")
    stored = {r["source_id"]: r["community_id"] for r in graph.store_communities(people, member).collect()}
    assert stored == {"p1": 0, "q3": 1, "nobody": -1}


def test_communities_of_a_random_graph_are_connected(spark):
    rng = random.Random(3)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a != b}
    edges = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", float(rng.randrange(1, 5))) for a, b in pairs], "src string, dst string, weight double")
    for one_task in (500_000, 40):
        found = {r["node"]: r["community"] for r in graph.communities(edges, one_task=one_task).collect()}
        assert set(found) == {f"{v:02d}" for pair in pairs for v in pair}
        for community in set(found.values()):
            inside = {n for n, c in found.items() if c == community}
            reached, stack = {community}, [community]
            while stack:
                node = stack.pop()
                for a, b in pairs:
                    for x, y in ((f"{a:02d}", f"{b:02d}"), (f"{b:02d}", f"{a:02d}")):
                        if x == node and y in inside and y not in reached:
                            reached.add(y)
                            stack.append(y)
            assert reached == inside


def test_rank_over_hubs_is_the_rank_over_all_their_pairs(spark):
    edges = spark.createDataFrame([("a", "b", 3.0), ("b", "a", 1.0), ("x", "b", 2.0), ("c", "lost", 1.0)], "src string, dst string, weight double")
    hubs = [("a", "g", 1.0), ("b", "g", 1.0), ("c", "g", 1.0), ("c", "e", 2.0), ("d", "e", 2.0), ("alone", "h", 1.0)]
    held = spark.createDataFrame(hubs, "node string, hub string, weight double")
    pairs = [(p, q, w) for p, g, w in hubs for q, h, _ in hubs if g == h and p != q]
    whole = edges.unionByName(spark.createDataFrame(pairs, "src string, dst string, weight double"))
    seeds = spark.createDataFrame([("a", 2.0), ("d", 1.0)], "node string, weight double")
    got = [{r["node"]: r["score"] for r in graph.personalized_rank(e, seeds, steps=60, tolerance=1e-12, hubs=h, one_task=n).collect()} for e, h in ((edges, held), (whole, None)) for n in (10**6, 0)]
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(math.isclose(other[k], got[0][k], abs_tol=1e-9) for k in other)
    assert "alone" not in got[0] and math.isclose(sum(got[0].values()), 1, abs_tol=1e-9)


def test_pairs_within_a_hub_do_not_depend_on_its_parts(spark):
    rows = spark.createDataFrame([("g", f"p{i}") for i in range(12)] + [("h", "p1")], "group_jid string, person string")
    want = {(f"p{i}", f"p{j}") for i in range(12) for j in range(12) if i != j}
    for share in (2_000, 3):
        got = [(r["a"], r["b"]) for r in graph.pairs_within(rows, ["group_jid"], "person", "a", "b", share).collect()]
        assert len(got) == len(want) and set(got) == want


def test_fusion_ignores_score_scale(spark):
    one = spark.createDataFrame([("a", "c", 0, None), ("b", "c", 1, None)], "id string, chat_jid string, rank int, similarity double")
    two = spark.createDataFrame([("b", "c", 0, 0.9)], "id string, chat_jid string, rank int, similarity double")
    got = {r["id"]: (r["rrf_score"], r["similarity"]) for r in retrieval.fuse([one, two]).collect()}
    assert got["b"] == (pytest.approx(1 / 61 + 1 / 62), 0.9) and got["a"] == (pytest.approx(1 / 61), 0.0)


def _greedy(values, ratio=0.85):
    """The merging rule told as a loop: against every canonical value so far, in order."""
    plan, canonical = {}, []
    for value, count in sorted(values, key=lambda vc: (-vc[1], vc[0])):
        low = value.lower()
        for other, seen in canonical:
            base = other.lower()
            if low == base:
                plan[value] = other
            elif min(len(low), len(base)) > 3 and (low in base or base in low):
                longer, shorter = (other, value) if len(value) < len(other) else (value, other)
                plan[value] = longer if count < seen else shorter
            elif min(len(low), len(base)) > 5 and difflib.SequenceMatcher(None, low, base).ratio() > ratio:
                plan[value] = other
            else:
                continue
            break
        else:
            canonical.append((value, count))
    return {k: v for k, v in plan.items() if k != v}


def _plan(spark, values, kind="org"):
    rows = [(f"m{i}", kind, v, "c") for i, (v, n) in enumerate((v, k) for v, n in values for k in range(n))]
    return {r["old"]: r["new"] for r in entities.merged(spark.createDataFrame(rows, "message_id string, entity_type string, entity_value string, chat_jid string")).collect()}


def test_merge_plan_cases(spark):
    assert _plan(spark, [("Acme Labs", 9), ("acme labs", 3)]) == {"acme labs": "Acme Labs"}
    assert _plan(spark, [("Kubernetes", 9), ("Kubernetis", 2), ("abc", 5), ("abcd", 4)]) == {"Kubernetis": "Kubernetes"}
    assert _plan(spark, [("The Foundry", 9), ("Foundry", 3)]) == {"Foundry": "The Foundry"}
    assert _plan(spark, [("Foundry", 9), ("The Foundry", 3)]) == {}
    assert _plan(spark, [("Foundry", 3), ("The Foundry", 3)]) == {"The Foundry": "Foundry"}
    assert _plan(spark, [("one", 1)]) == {} and _plan(spark, []) == {}


def test_merge_plan_is_the_greedy_one(spark):
    rng = random.Random(5)
    stems = ["north gate", "gate", "harbour labs", "harbor labs", "labs", "kettle", "kettles", "the kettle works", "orchid", "orchids society", "copper kite", "kopper kite", "river", "riverside club"]
    values = {}
    for _ in range(260):
        text = rng.choice(stems)
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("aeimrst ") + text[at + rng.randrange(2) :]
        if rng.random() < 0.3:
            text = text + " " + rng.choice(["inc", "two", "west", "xyz"])
        values[text.title() if rng.random() < 0.3 else text] = rng.randrange(2, 7)
    assert _plan(spark, list(values.items())) == _greedy(list(values.items()))


def test_normaliser(spark):
    rows = [("m", "c", "person", v) for v in ("@ann", "Monday", "k8s", "CC", "42", "x", " Claude ")] + [("m", "c", "url", "https://a.example")]
    got = {tuple(r) for r in entities.normalised(spark.createDataFrame(rows, "message_id string, chat_jid string, entity_type string, entity_value string")).select("entity_type", "entity_value").collect()}
    assert got == {("person", "Kubernetes"), ("tech", "Claude"), ("url", "https://a.example")}


def test_tagger_and_patterns(spark):
    df = spark.createDataFrame([("m", "c", "see https://a.example/x). mail a@b.example @ops @x"), ("n", "c", None)], "id string, chat_jid string, text_content string")
    got = {(r["entity_type"], r["entity_value"]) for r in entities.by_pattern(df).collect()}
    assert got == {("url", "https://a.example/x"), ("url", "a@b.example"), ("person", "@b.example"), ("person", "@ops")}
    tagged = entities.by_tagger(df, lambda texts: [[("org", "Acme"), ("org", "Acme")] for _ in texts]).collect()
    assert [tuple(r) for r in tagged] == [("m", "c", "org", "Acme")]


def test_the_rank_reaches_distant_nodes(spark, monkeypatch):
    from threadmill import queries_core

    links = [(i, i + 1, 1.0 + i) for i in range(9)] + [(i, 0, 0.5) for i in range(1, 9)]
    parts = {
        "talk": spark.createDataFrame([(str(a), str(b), w) for a, b, w in links], "src string, dst string, weight double"),
        "hubs": spark.createDataFrame([], "node string, hub string, weight double"),
        "member_of": spark.createDataFrame([("0", "g"), ("0", "h"), ("1", "g")], "person string, group_jid string"),
    }
    monkeypatch.setattr(queries_core, "graph_parts", lambda spark, root: parts)
    got = {int(r["node"]): r["score"] for r in queries_core.QUERIES["g14_personalized_rank"](spark, "").collect()}
    move, p = np.zeros((10, 10)), np.array([2 / 3, 1 / 3] + [0.0] * 8)
    for a, b, w in links:
        move[b, a] = w
    move[:, :9] /= move[:, :9].sum(axis=0)
    move[:, 9] = p  # no way out of the last node
    want = np.linalg.solve(np.eye(10) - 0.85 * move, 0.15 * p)
    assert all(math.isclose(got[i], want[i], abs_tol=1e-6) for i in range(10)) and got[9] > 0.01


def test_search_terms_and_stems():
    assert terms("Meetings were RUNNING at the café") == ["meet", "run", "cafe"]
    assert terms("Встреча: meeting!", True) == ["встреча", "meet"] and terms("Встреча: meeting!") == ["meet"]
    assert terms(None) == [] and terms(" ") == []
    told = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "hoping": "hope", "relational": "relat", "electricity": "electr", "agreed": "agre", "controlling": "control", "skis": "ski", "gently": "gentl", "news": "news", "knightly": "knight", "consistency": "consist"}
    assert {w: stem(w) for w in told} == told


def test_words_are_found_by_their_stem(spark):
    texts = [("a", "c", "Meetings were running late"), ("b", "c", "nothing of the sort"), ("d", "c", None), ("e", "c", "")]
    index = retrieval.TextIndex.build(spark.createDataFrame(texts, "id string, chat_jid string, text_content string"))
    assert [r["id"] for r in index.search("the meeting run", 5).collect()] == ["a"]
    assert index.search("the", 5).count() == 0


def test_similarity_by_matrix_product(spark):
    rows = [("a", "c", [1.0, 0.0]), ("a", "c", [0.0, 2.0]), ("b", "c", [-1.0, 0.0]), ("n", "c", [0.0, 0.0]), ("x", "c", [float("nan"), 1.0]), ("g", "c", [None, 1.0]), ("o", "c", [1.0]), ("z", "c", None)]
    got = {r["id"]: r["similarity"] for r in retrieval.similar(spark.createDataFrame(rows, "id string, chat_jid string, embedding array<float>"), [[0.0, 1.0], [0.0, 0.0]], 9).collect()}
    assert got == {"a": pytest.approx(1.0), "b": pytest.approx(0.0)}


def test_embedder_runs_by_batches(spark):
    rows = [(str(i), "c", "x" * i) for i in range(5)] + [("n", "c", None)]
    made = retrieval.embedded(spark.createDataFrame(rows, "id string, chat_jid string, embedding_text string"), lambda texts: [[len(t), 1] for t in texts], batch=2, limit=3)
    assert {r["id"]: list(r["embedding"]) for r in made.collect()} == {str(i): [min(i, 3), 1.0] for i in range(1, 5)}


def _search(spark, text, seen, depth="balanced"):
    messages = spark.createDataFrame(
        [("1", "g", "ann", 0, False, True, "north gate at nine", "Ann", [1.0, 0.0]), ("2", "g", "bob", 60_000_000, False, True, "see you there", "Bob", [0.9, 0.1]), ("3", "bob", "bob", 120_000_000, False, False, "gates!", "Bob", [0.0, 1.0])],
        "id string, chat_jid string, sender string, us bigint, mine boolean, grouped boolean, text_content string, push_name string, embedding array<float>",
    )
    contacts = spark.createDataFrame([("ann", "Ann", None, None, None, False), ("bob", "Bob", None, None, None, False), ("g", None, None, None, "Group", True)], "jid string, push_name string, full_name string, business_name string, group_name string, is_group boolean")
    people = graph.persons(contacts)
    member, direct, talked = graph.member_of(messages, people), graph.messaged(messages, people), graph.conversed(messages, people)
    said = graph.mentions(messages, spark.createDataFrame([], "message_id string, chat_jid string, entity_type string, entity_value string"), people)
    edges = {"persons": people, "groups": graph.groups(contacts, messages), "messaged": direct, "member_of": member, "conversed": talked, "mentions": said, "talk": graph.talk_edges(direct, talked), "hubs": graph.hubs_of(member, said), "digraph": graph.weighted_digraph(direct, talked, member, said)}

    def embed(texts):
        seen.append(texts)
        return [[1.0, 0.0]] * len(texts)

    return retrieval.run_search(text, embed, messages, contacts, edges, retrieval.TextIndex.build(messages), depth, expand=lambda q, n: [f"{q}{i}" for i in range(n)]), edges


def test_search_expands_embeds_and_falls_back(spark):
    seen = []
    found, edges = _search(spark, "gate", seen)
    assert seen == [["gate", "gate0", "gate1", "gate2", "gate3"]]
    ranked = [r["id"] for r in found["results"].orderBy("rank").collect()]
    assert ranked[0] == "1" and set(ranked) == {"1", "2", "3"}
    assert {r["sender"] for r in found["people"].collect()} == {"ann", "bob"}
    told = {(r["part"]) for r in retrieval.insights(found["people"], edges["conversed"], edges["groups"], "ann").collect()}
    assert "relationship" in told and "connection" in told
    lone, _ = _search(spark, "qqq", [], "fast")
    assert [round(r["rrf_score"], 6) for r in lone["results"].orderBy("rank").collect()] == [round(r["similarity"], 6) for r in lone["results"].orderBy("rank").collect()]


def _sixty(spark):
    """Sixty persons of one group, each with a message that holds the word; the digraph is not among the edges."""
    who = [f"p{i:02}" for i in range(60)]
    messages = spark.createDataFrame([(f"m{i:02}", "g", p, i * 600_000_000, False, True, "gate", p, [1.0, i / 60]) for i, p in enumerate(who)], "id string, chat_jid string, sender string, us bigint, mine boolean, grouped boolean, text_content string, push_name string, embedding array<float>")
    contacts = spark.createDataFrame([(p, p, None, None, None, False) for p in who], "jid string, push_name string, full_name string, business_name string, group_name string, is_group boolean")
    people = graph.persons(contacts)
    member, direct, talked = graph.member_of(messages, people), graph.messaged(messages, people), graph.conversed(messages, people)
    said = graph.mentions(messages, spark.createDataFrame([], "message_id string, chat_jid string, entity_type string, entity_value string"), people)
    edges = {"persons": people, "groups": graph.groups(contacts, messages), "messaged": direct, "member_of": member, "conversed": talked, "mentions": said, "talk": graph.talk_edges(direct, talked), "hubs": graph.hubs_of(member, said)}
    return retrieval.run_search("gate", lambda texts: [[1.0, 0.0]] * len(texts), messages, contacts, edges, retrieval.TextIndex.build(messages), "deep", expand=lambda q, n: [f"{q}{i}" for i in range(n)])


def test_search_ranks_everyone_and_makes_no_digraph(spark):
    found = _sixty(spark)
    assert found["people"].where("max_ppr > 0").count() == 60
    assert found["paths"].count() == 20


def test_fast_search_leaves_the_graph_alone(spark, monkeypatch):
    from threadmill import queries_core

    def refuse(df):
        raise AssertionError("a relation of the graph was made")

    monkeypatch.setattr(queries_core, "cut_lineage", refuse)
    assert queries_core.QUERIES["r4_vectors_alone"](spark, "/root/testdata/sf0.001").count() == 30
