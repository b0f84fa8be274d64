"""Mixing sources to target weights of tokens.

Iterative proportional fitting rakes the token weights of the cells (source,
language, form) to three marginals: the target shares of the sources, and the
corpus's own shares of languages and of text forms, so that reweighting the
sources shifts those as little as the caps allow.  The factor of a cell is the
expected number of uses of each of its documents and never exceeds the cap of
its source.  Documents are then drawn by systematic sampling with these
calibrated probabilities, in shards, ordered by length, which leaves each source
within about one document of its target; a last round adds or drops uses of
documents no longer than that gap to close it.

Documents are used whole.  Where they are long for the total, uses are exchanged
until a source's tokens come as near to its share as its documents can, and the
total is lowered to the largest one at which all sources come near enough.

The tables carry no topics; the form of a text (prose, list, chat lines) stands
in for the third marginal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.tokens import VOCABULARY, token_count
from threadmill.session import cut_lineage

#: About as many documents of a cell share a shard when uses are drawn.
SHARD_DOCS = 500_000
#: A source meets its share if its tokens miss it by no more than this part of the total.
MISS = 0.0005
#: Sums of documents are told apart up to so many in number; wider ranges are thinned.
_SUMS = 1 << 18


def text_form(text) -> F.Column:
    """``list``, ``chat`` or ``prose`` by the labels at the starts of lines."""
    lists = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:[-*•]|[0-9]{1,3}[.)])[ \t]"), F.lit(0)))
    chats = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:\[[0-9]{1,2}[.:][0-9]{2}\]|\p{L}[\p{L} .'-]{0,30}:[ \t])"), F.lit(0)))
    lines = F.size(F.split(text, "\n"))
    return F.when(lists * 2 >= lines, "list").when(chats * 2 >= lines, "chat").otherwise("prose")


def rake(tokens: np.ndarray, axes: list[tuple[np.ndarray, np.ndarray]], caps: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Factors per cell, capped, whose weighted tokens meet the marginals.

    ``axes`` holds (level of each cell, target of each level) with the hard
    marginal last.  A cell at its cap stays there; the other cells of the level
    make up for it.  The hard marginal is met exactly wherever the caps of a
    level's cells allow it.
    """
    factor = np.where(tokens > 0, np.minimum(1.0, caps), 0.0)
    for _ in range(rounds):
        before = factor.copy()
        for level, target in axes:
            for _ in range(len(target) + 32):
                weight = np.bincount(level, factor * tokens, minlength=len(target))
                fixed = np.bincount(level, np.where(factor >= caps, factor * tokens, 0), minlength=len(target))
                free = weight - fixed
                scale = np.where(free > 0, np.maximum(target - fixed, 0) / np.where(free > 0, free, 1), 1.0)
                # a level that is too heavy is scaled down whole, capped cells too
                heavy = fixed > target
                scale_all = np.where(heavy & (weight > 0), target / np.where(weight > 0, weight, 1), 1.0)
                stepped = np.where(heavy[level], factor * scale_all[level], np.where(factor >= caps, factor, factor * scale[level]))
                stepped = np.minimum(stepped, caps)
                moved = np.abs(stepped - factor).max(initial=0)
                factor = stepped
                if moved < tolerance:
                    break
        if np.abs(factor - before).max(initial=0) < tolerance:
            break
    return factor


def plan_mixture(cells: pd.DataFrame, targets: pd.DataFrame, total: float | None = None) -> pd.DataFrame:
    """Expected uses per cell and the tokens wanted from its source.

    ``cells`` has ``source, lang, form, tokens``; ``targets`` has ``source,
    target_share, max_repeats``.  Without ``total`` it is the largest one at
    which every source with tokens reaches its share within its cap; with a
    larger one, sources at their cap stay below their shares.  Shares of
    sources without tokens are spread over the others in proportion.
    """
    wanted = targets.dropna(subset=["source"]).groupby("source", as_index=False).agg({"target_share": "sum", "max_repeats": "max"})
    cells = cells.merge(wanted, on="source", how="inner")
    cells = cells[(cells["tokens"] > 0) & (cells["target_share"] > 0) & (cells["max_repeats"] > 0)].reset_index(drop=True)
    if cells.empty:
        return cells.assign(factor=pd.Series(dtype="float64"), wanted=pd.Series(dtype="float64"))
    tokens = cells["tokens"].to_numpy(float)
    source, names = pd.factorize(cells["source"])
    per_source = cells.groupby("source")[["target_share", "max_repeats"]].first().loc[names]
    share = (per_source["target_share"] / per_source["target_share"].sum()).to_numpy()
    most = np.bincount(source, tokens) * per_source["max_repeats"].to_numpy()
    if total is None:
        total = float(np.min(most / share))
    axes = []
    for column in ("form", "lang"):
        level, _ = pd.factorize(cells[column])
        axes.append((level, np.bincount(level, tokens) / tokens.sum() * total))
    axes.append((source, share * total))
    factor = rake(tokens, axes, cells["max_repeats"].to_numpy(float))
    return cells.assign(factor=factor, wanted=np.minimum(share * total, most)[source])


def close_gap(gap: float, addable: dict[int, int], droppable: dict[int, int]) -> dict[int, int]:
    """Single uses to add (positive) or drop (negative) per length, longest first."""
    chosen: dict[int, int] = {}
    pool, sign, left = (addable, 1, gap) if gap >= 0 else (droppable, -1, -gap)
    for length in sorted(pool, reverse=True):
        n = int(min(pool[length], left // length))
        if n:
            chosen[length] = sign * n
            left -= n * length
    return chosen


class Sums:
    """The sums between ``low`` and ``high``, 0 among them, that uses of whole documents make, and of which.

    ``rooms`` holds (length, how often it may be taken); lengths to be dropped are negative and come first.
    """

    def __init__(self, rooms: list[tuple[int, int]], low: int, high: int):
        self.low, self.spacing = low, 1 + (high - low) // _SUMS
        self.items = []
        for length, room in rooms:
            room, uses = min(int(room), (high - low) // abs(length)), 1
            while room > 0:
                self.items.append((length, min(uses, room)))
                room, uses = room - uses, 2 * uses
        size = (high - low) // self.spacing + 1
        total, self.last, self.came = np.zeros(size, np.int64), np.full(size, -2), np.zeros(size, np.int64)
        self.last[-low // self.spacing] = -1
        for i, (length, uses) in enumerate(self.items):
            at = np.flatnonzero(self.last > -2)
            if len(at) == size:
                break
            made = total[at] + length * uses
            at, made = at[(low <= made) & (made <= high)], made[(low <= made) & (made <= high)]
            to, first = np.unique((made - low) // self.spacing, return_index=True)
            first, to = first[self.last[to] == -2], to[self.last[to] == -2]
            total[to], self.came[to], self.last[to] = made[first], at[first], i
        self.made = total[self.last > -2]

    def nearest(self, wanted: float) -> dict[int, int]:
        """Uses per length, signed as given to add or drop, that come nearest to ``wanted``."""
        chosen: dict[int, int] = {}
        at = (int(self.made[np.abs(self.made - wanted).argmin()]) - self.low) // self.spacing
        while self.last[at] >= 0:
            length, uses = self.items[self.last[at]]
            chosen[abs(length)] = chosen.get(abs(length), 0) + (uses if length > 0 else -uses)
            at = self.came[at]
        return {length: n for length, n in chosen.items() if n}


def exchange(gap: float, wanted: float, addable: dict[int, int], droppable: dict[int, int]) -> dict[int, int]:
    """Uses to add and to drop per length that leave as little of the gap as whole documents can."""
    rooms = [(-n, droppable[n]) for n in sorted(droppable, reverse=True)] + [(n, addable[n]) for n in sorted(addable, reverse=True)]
    held = int(np.ceil(max(wanted - gap, 0)))  # nothing below 0 is left, and twice the wanted is no nearer than nothing
    return Sums([(n, room) for n, room in rooms if room > 0], -held, max(0, int(np.ceil(gap + wanted)))).nearest(gap)


def whole_total(total: float, shares: dict[str, float], lengths: pd.DataFrame, miss: float = MISS) -> float:
    """The largest total, up to ``total``, of which whole documents can make each source's share; ``total`` if there is none.

    ``lengths`` has ``source, n_tokens, room``, room being the uses that all documents of that length allow.
    """
    held = {source: list(zip(own["n_tokens"].astype(int), own["room"].astype(int))) for source, own in lengths.sort_values("n_tokens").groupby("source")}
    sums: dict[str, np.ndarray] = {}
    most = total
    while total >= 1:
        lower = total
        for source, share in shares.items():
            if share <= miss or sum(n * room for n, room in held.get(source, []) if n <= 2 * miss * total) >= share * total:
                continue  # steps of that length hit the span that counts as met
            if source not in sums:
                sums[source] = np.sort(Sums(held.get(source, []), 0, int((share + miss) * most) + 1).made)
            best = sums[source][np.searchsorted(sums[source], (share + miss) * total, side="right") - 1]
            if best < (share - miss) * total:
                lower = min(lower, best / (share - miss))
        if lower == total:
            return total
        total = lower
    return most


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: float | None = None, seed: int = 7, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``doc_id, source, n_tokens, uses`` for every document.

    Documents without a source, or of a source without a target, are used 0
    times; so are empty ones, which add no tokens.  Languages are compared in
    lower case, a missing language is one of its own.
    """
    counted = documents.select(
        "doc_id",
        "source",
        F.lower(F.coalesce("lang", F.lit("?"))).alias("lang"),
        F.when(F.col("text").isNull(), "prose").otherwise(text_form(F.col("text"))).alias("form"),
        token_count("text", vocabulary).alias("n_tokens"),
    )
    counted = cut_lineage(counted)
    # cells are bounded by sources x languages x forms, not by documents
    cells = counted.where("source is not null and n_tokens > 0").groupBy("source", "lang", "form").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    cells, wishes = cells.toPandas(), targets.select("source", "target_share", "max_repeats").toPandas()
    planned = plan_mixture(cells, wishes, total)
    spark = counted.sparkSession
    if total is None and len(planned):
        best = _whole_total(counted, planned)
        planned = plan_mixture(cells, wishes, best) if best is not None else planned
    shards = -(-planned.groupby("source")["docs"].transform("sum") // shard_docs) if len(planned) else pd.Series(dtype="int64")
    planned = planned.assign(shards=shards)
    factors = spark.createDataFrame(
        planned[["source", "lang", "form", "factor", "shards", "max_repeats"]], "source string, lang string, form string, factor double, shards bigint, max_repeats int"
    )
    drawn = counted.join(F.broadcast(factors), ["source", "lang", "form"], "left").withColumn("factor", F.when(F.col("n_tokens") > 0, F.coalesce("factor", F.lit(0.0))).otherwise(0.0))
    drawn = drawn.withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.when(F.col("factor") > 0, F.col("shards")).otherwise(F.lit(997))))
    drawn = drawn.withColumn("_drawn", F.col("factor") > 0)
    shard = Window.partitionBy("source", "_drawn", "_shard").orderBy("n_tokens", "doc_id")
    # one random start a shard; the running sum of the factors passes an integer as often as the document is used
    start = F.pmod(F.xxhash64("source", "_shard", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    reached = start + F.sum("factor").over(shard.rowsBetween(Window.unboundedPreceding, 0))
    uses = F.greatest(F.floor(reached) - F.floor(reached - F.col("factor")), F.lit(0))
    cap = F.when(F.col("factor") > 0, F.coalesce("max_repeats", F.lit(0))).otherwise(0).cast("bigint")
    drawn = cut_lineage(drawn.select("doc_id", "source", "n_tokens", cap.alias("_cap"), F.least(uses, cap).alias("uses")))

    got = {r["source"]: r["got"] for r in drawn.where("_cap > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("got")).collect()}
    wanted = planned.groupby("source")["wanted"].first().to_dict()
    gaps = {source: want - got.get(source, 0) for source, want in wanted.items()}
    # a longer document would overshoot; so there are at most as many lengths as the gaps have tokens, about one document a source
    pools = _rooms(drawn, {source: int(abs(gap)) for source, gap in gaps.items()})
    changes = {source: close_gap(gap, *pools[source]) for source, gap in gaps.items()}
    # what is left counts only where documents are long for the total
    left = {source: abs(gap - sum(length * n for length, n in changes[source].items())) for source, gap in gaps.items()}
    wide = [source for source in left if left[source] > 0.2 * MISS * sum(wanted.values())]
    if wide:
        pools = _rooms(drawn, {source: int(2 * wanted[source]) for source in wide}, used=True)
        changes |= {source: exchange(gaps[source], wanted[source], *pools[source]) for source in wide}
    changes = [(source, int(length), int(n)) for source in changes for length, n in changes[source].items()]
    closing = spark.createDataFrame(changes, "source string, n_tokens bigint, _change bigint")
    adds = F.col("_change") > 0
    room = F.least(F.when(adds, F.col("_cap") - F.col("uses")).otherwise(F.col("uses")), F.abs("_change"))
    marked = drawn.where("_cap > 0").join(F.broadcast(closing), ["source", "n_tokens"]).withColumn("_room", room).where("_room > 0")
    turns = marked.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), "_room")))
    # the window sees the documents of the few lengths that change, the least used first to add and the most used to drop, and keeps the first of each
    order = Window.partitionBy("source", "n_tokens").orderBy(F.col("_turn") + F.when(adds, F.col("uses")).otherwise(-F.col("uses")), F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    most = int(max([abs(n) for _, _, n in changes], default=0))
    picked = turns.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).where(F.col("_nth") <= F.abs("_change"))
    picked = picked.select("doc_id", F.signum("_change").cast("bigint").alias("_step")).groupBy("doc_id").agg(F.sum("_step").alias("_step"))
    return drawn.join(picked, "doc_id", "left").select("doc_id", "source", "n_tokens", (F.col("uses") + F.coalesce("_step", F.lit(0))).alias("uses"))


def _whole_total(counted: DataFrame, planned: pd.DataFrame) -> float | None:
    """The total that whole documents can make, if it is another one than planned."""
    of_source = planned.groupby("source")[["wanted", "max_repeats"]].first()
    total = float(of_source["wanted"].sum())
    caps = counted.sparkSession.createDataFrame([(source, float(w), int(m)) for source, w, m in of_source.itertuples()], "source string, _wanted double, _cap bigint")
    # longer documents than a share can't be used for it; mostly short ones alone suffice, and no lengths are gathered
    fit = counted.join(F.broadcast(caps), "source").where((F.col("n_tokens") > 0) & (F.col("n_tokens") <= F.col("_wanted") + F.lit(MISS * total)))
    fine = F.sum(F.when(F.col("n_tokens") <= F.lit(2 * MISS * total), F.col("n_tokens") * F.col("_cap")).otherwise(0))
    fine = {r["source"] for r in fit.groupBy("source").agg(fine.alias("fine"), F.first("_wanted").alias("wanted")).where("fine >= wanted").collect()}
    if fine >= set(of_source.index):
        return None
    lengths = fit.groupBy("source", F.col("n_tokens")).agg(F.sum("_cap").alias("room")).toPandas()
    best = whole_total(total, (of_source["wanted"] / total).to_dict(), lengths)
    return best if best < total else None


def _rooms(drawn: DataFrame, most: dict[str, int], used: bool = False) -> dict[str, tuple[dict[int, int], dict[int, int]]]:
    """Per source the uses that can be added and dropped by length, of documents no longer than given; with ``used`` those in use whatever their length."""
    reach = drawn.sparkSession.createDataFrame(list(most.items()), "source string, _most bigint")
    able = F.col("n_tokens").between(1, F.col("_most")) | F.lit(used) & (F.col("uses") > 0)
    pools = drawn.where("_cap > 0 and n_tokens > 0").join(F.broadcast(reach), "source").where(able).groupBy("source", "n_tokens")
    pools = pools.agg(F.sum(F.col("_cap") - F.col("uses")).alias("addable"), F.sum("uses").alias("droppable")).toPandas()
    return {source: tuple(dict(zip(own["n_tokens"], own[c])) for c in ("addable", "droppable")) for source in most for own in [pools[pools["source"] == source]]}


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Reached share of tokens per source, next to its target; sources without documents have 0."""
    sums = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"),
        F.sum("n_tokens").alias("held_tokens"),
        F.max("uses").alias("most_uses"),
    )
    total = sums.agg(F.sum("used_tokens").alias("total"))
    return (
        targets.join(F.broadcast(sums), "source", "left")
        .crossJoin(F.broadcast(total))
        .select(
            "source",
            "target_share",
            F.try_divide(F.coalesce("used_tokens", F.lit(0)), F.col("total")).alias("reached_share"),
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            F.coalesce("held_tokens", F.lit(0)).alias("held_tokens"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            "max_repeats",
        )
    )


def mixture_faults(mixed: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of what must be none: documents lost or listed twice, uses over the cap of a source, uses without a target; and whether all shares are met within one in a thousand of the total, those of sources without tokens being spread over the others."""
    caps = targets.groupBy("source").agg(F.max("max_repeats").alias("cap"))
    told = mixed.join(F.broadcast(caps), "source", "left")
    report = mixture_report(mixed, targets).where("held_tokens > 0")
    share = F.col("target_share") / F.sum("target_share").over(Window.partitionBy())  # a row a source
    missed = F.abs(F.col("reached_share") - share)
    counts = told.agg(
        (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("twice"),
        F.count_if(F.col("uses") > F.coalesce("cap", F.lit(0))).alias("over_cap"),
        F.count_if(F.col("uses") < 0).alias("below_none"),
        F.count(F.lit(1)).alias("listed"),
    )
    met = report.select(F.coalesce(missed <= 0.001, F.lit(False)).alias("met")).agg(F.coalesce(F.bool_and("met"), F.lit(True)).alias("shares_met"))
    return counts.crossJoin(documents.agg(F.count(F.lit(1)).alias("given"))).crossJoin(met).select("twice", "over_cap", "below_none", (F.col("given") - F.col("listed")).alias("lost"), "shares_met")
