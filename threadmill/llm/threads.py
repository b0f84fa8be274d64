"""Rebuilding conversations from message rows.

The parent of a message is the message before it in its chat if that came no
more than ``gap`` earlier.  Inside one time bucket of a chat the parents form
bursts, which one sort contracts to single nodes; the pointers left lead from
the first burst of a bucket to the last one of the bucket before.  Iterative
pointer jumping over those nodes gives every burst its root and the number of
turns ahead of it, in a logarithm of the longest chain, so a chat that never
rests costs a few joins and not one huge task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadmill.operators import sessions
from threadmill.session import cut_lineage
from threadmill.sources.tables import blank, micros

OWNER = "155599999999@s.whatsapp.net"


def bare_jid(column) -> F.Column:
    """A person's jid without its device number."""
    return F.regexp_replace(column, ":[0-9]+@", "@")


def resolve_threads(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Pointer jumping over ``node, parent, weight``: ``node, root, ahead, state``.

    ``root`` is the farthest ancestor and ``ahead`` the weight of all strict
    ancestors.  ``state`` is ``orphan`` for nodes whose root names a parent
    that does not exist, ``cycle`` (root null) for nodes on or below a ring of
    parents, else ``ok``.  A null parent marks a root, null nodes are left
    out, repeated rows of a node count once and the smallest parent is taken.
    """
    unique = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"), F.max("weight").alias("weight"))
    known = unique.select(F.col("node").alias("p"), F.col("weight").alias("p_weight"))
    linked = unique.join(known, F.col("parent") == F.col("p"), "left")
    lost = F.col("parent").isNotNull() & F.col("p").isNull()
    jump = cut_lineage(
        linked.select(
            "node",
            F.coalesce("p", "node").alias("at"),
            F.when(F.col("p") == F.col("node"), 0).otherwise(F.coalesce("p_weight", F.lit(0))).cast("bigint").alias("ahead"),
            F.col("p").isNull().alias("top"),
            lost.alias("lost"),
        )
    )
    # a chain of n nodes is resolved after log2(n) jumps; what still moves then is a ring
    rounds = min(max_rounds, max(1, jump.count()).bit_length() + 1)
    for _ in range(rounds):
        if jump.where(~F.col("top")).isEmpty():
            break
        done = jump.where("top")
        step = jump.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("ahead").alias("more"), F.col("top").alias("next_top"), F.col("lost").alias("next_lost"))
        moved = (
            jump.where(~F.col("top"))
            .join(step, "at")
            .select(
                "node",
                F.col("next").alias("at"),
                F.when(F.col("next_top"), F.col("ahead") + F.when(F.col("next") == F.col("at"), 0).otherwise(F.col("more"))).otherwise(F.col("ahead") + F.col("more")).alias("ahead"),
                F.col("next_top").alias("top"),
                F.col("next_lost").alias("lost"),
            )
        )
        jump = cut_lineage(done.unionByName(moved))
    return jump.select(
        "node",
        F.when(F.col("top"), F.col("at")).alias("root"),
        F.when(F.col("top"), F.col("ahead")).alias("ahead"),
        F.when(~F.col("top"), "cycle").when(F.col("lost"), "orphan").otherwise("ok").alias("state"),
    )


def conversations(messages: DataFrame, owner: str = OWNER, gap_us: int = sessions.GAP_US, bucket_us: int = sessions.BUCKET_US) -> DataFrame:
    """Turns of the sound conversations: ``chat_jid, start_us, pos, id, turn_role``.

    A conversation is dropped if any of its messages (blank ones included) has
    no sender, a null or contradictory ``is_from_me``, or, in a direct chat, a
    sender who is neither the owner nor the chat; or if its non-blank messages
    come from fewer than two senders.  A null ``is_group`` is taken from the
    form of the chat's jid.  Messages without a time belong to no conversation.
    """
    sender = bare_jid(F.col("sender_jid"))
    is_owner = sender == F.lit(owner)
    group = F.coalesce("is_group", F.col("chat_jid").endswith("@g.us"), F.lit(False))
    broken = (
        blank(F.col("sender_jid"))
        | F.coalesce(F.col("is_from_me") != is_owner, F.lit(True))
        | (~group & F.coalesce(~is_owner & (sender != bare_jid(F.col("chat_jid"))), F.lit(True)))
    )
    events = sessions.distinct_events(
        messages,
        "chat_jid",
        "id",
        micros(F.col("timestamp")),
        {
            "_broken": broken,
            "_said": (~blank(F.col("text_content"))).cast("int"),
            "_sender": F.when(~blank(F.col("text_content")), sender),
            "_mine": F.coalesce("is_from_me", F.lit(False)),
        },
        bucket_us,
    )
    ordered = Window.partitionBy("_key", "_bucket").orderBy("_us", "_id")
    turns = sessions.with_pieces(events, gap_us).withColumn("_nth", F.sum("_said").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = turns.groupBy("_key", "_bucket", "_piece").agg(
        F.min("_us").alias("_start"),
        F.max("_us").alias("_end"),
        F.min(F.col("_nth") - F.col("_said")).alias("_base"),
        F.sum("_said").alias("_said"),
        F.max("_broken").alias("_broken"),
        F.min("_sender").alias("_low"),
        F.max("_sender").alias("_high"),
    )
    of_bucket = Window.partitionBy("_key", "_bucket")
    pieces = cut_lineage(pieces.withColumn("_last", F.col("_piece") == F.max("_piece").over(of_bucket)))

    tails = pieces.where("_last").select(F.col("_key").alias("_tail_key"), (F.col("_bucket") + 1).alias("_tail_bucket"), F.col("_start").alias("_tail_start"), F.col("_end").alias("_tail_end"))
    heads = pieces.where((F.col("_piece") == 1) & (F.col("_start") - F.col("_bucket") * bucket_us <= gap_us))
    links = heads.join(tails, F.col("_key").eqNullSafe(F.col("_tail_key")) & (F.col("_bucket") == F.col("_tail_bucket")) & (F.col("_start") - F.col("_tail_end") <= gap_us)).select(
        "_key", "_start", "_tail_start"
    )
    node = F.struct(F.col("_key"), F.col("_start"))
    parents = cut_lineage(links.select(node.alias("node"), F.struct("_key", F.col("_tail_start").alias("_start")).alias("parent")))
    members = parents.select("node").unionByName(parents.select(F.col("parent").alias("node"))).distinct()
    nodes = (
        pieces.select(node.alias("node"), F.col("_said").alias("weight"))
        .join(members, "node", "left_semi")
        .join(parents, "node", "left")
    )
    threads = resolve_threads(nodes).select(F.col("node._key").alias("_key"), F.col("node._start").alias("_start"), F.col("root._start").alias("_root"), "ahead")
    placed = pieces.join(threads.withColumnRenamed("_key", "_k").withColumnRenamed("_start", "_s"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_start") == F.col("_s")), "left").select(
        "_key", "_bucket", "_piece", "_base", "_said", "_broken", "_low", "_high", F.coalesce("_root", "_start").alias("start_us"), F.coalesce("ahead", F.lit(0)).alias("_ahead")
    )
    # bounded: a conversation has at most two bursts a bucket here
    whole = Window.partitionBy("_key", "start_us")
    sound = (
        placed.withColumn("_keep", ~F.max("_broken").over(whole) & (F.min("_low").over(whole) != F.max("_high").over(whole)))
        .where("_keep")
        .where(F.col("_said") > 0)
        .select(F.col("_key").alias("_k"), F.col("_bucket").alias("_b"), F.col("_piece").alias("_p"), "start_us", (F.col("_ahead") - F.col("_base")).alias("_shift"))
    )
    kept = turns.where(F.col("_said") > 0).join(sound, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")) & (F.col("_piece") == F.col("_p")))
    return kept.select(
        F.col("_key").alias("chat_jid"),
        "start_us",
        (F.col("_nth") + F.col("_shift")).alias("pos"),
        F.col("_id").alias("id"),
        F.when(F.col("_mine"), "owner").otherwise("other").alias("turn_role"),
    )
