"""Rebuilding conversations from message rows.

Parent pointers are resolved by pointer jumping: every unresolved message
replaces its pointer by its target's pointer, twice a round, so a chain of
length n takes log3(n) rounds.  Only unresolved messages jump in a round, so rounds shrink; each
round's result is written, which cuts the lineage.
Rows left when a round resolves nothing sit on or behind a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.current import latest_by
from ..storage import settle

#: Whitespace of every script, and characters of no width.
INVISIBLE = "[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]+"


def current_messages(messages: DataFrame) -> DataFrame:
    """Narrow current, undeleted rows: id, author_id, bot, reply_to_id, thread_id, position, speaks.

    ``speaks`` tells content that isn't null, blank or invisible; the content
    itself isn't carried along.
    """
    blank = F.regexp_replace(F.col("content"), INVISIBLE, "") == ""
    m = messages.where(F.col("id").isNotNull()).select(
        "id",
        "ingested_at",
        "author_id",
        F.coalesce("author_is_bot", F.lit(False)).alias("bot"),
        "reply_to_id",
        "thread_id",
        F.col("position").cast("int").alias("position"),
        F.coalesce(~blank, F.lit(False)).alias("speaks"),
        F.col("deleted_at").isNotNull().alias("gone"),
    )
    keep = ["author_id", "bot", "reply_to_id", "thread_id", "position", "speaks", "gone"]
    return latest_by(m, ["id"], ["ingested_at", *keep], keep).where(~F.col("gone")).drop("gone")


def resolve_roots(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Root of every reply outside threads: id, root (null: none), depth, state.

    ``nodes`` has id (unique), reply_to_id, thread_id.  state is reply (root
    found), orphan (the chain meets a missing message or a thread) or cycle.
    Messages without reply_to_id or with a thread_id aren't in the result.
    """
    slim = nodes.select(F.col("id").alias("t_id"), F.col("reply_to_id").alias("t_next"), F.col("thread_id").isNotNull().alias("t_thread"))
    replies = nodes.where(F.col("thread_id").isNull() & F.col("reply_to_id").isNotNull()).select("id", F.col("reply_to_id").alias("ptr"))
    state = (
        F.when(F.col("t_id").isNull() | F.col("t_thread"), "orphan").when(F.col("ptr") == F.col("id"), "cycle").when(F.col("t_next").isNull(), "reply")
    )
    first = replies.join(slim, F.col("ptr") == F.col("t_id"), "left")
    work = settle(first.select("id", "ptr", state.alias("state"), F.lit(1).cast("long").alias("depth")), "roots")
    done, left = [work.where(F.col("state").isNotNull())], work.where(F.col("state").isNull())
    n = left.count()
    for _ in range(max_rounds):  # 3^64 is beyond any chain: it is cycles that end the loop
        if not n:
            break
        known = left
        for d in done:
            known = known.unionByName(d)
        # Every pointer of an unresolved row leads to a reply, so the join is inner and either side may be broadcast once its size is known.
        known = known.select(F.col("id").alias("w_id"), F.col("ptr").alias("w_ptr"), F.col("state").alias("w_state"), F.col("depth").alias("w_depth"))
        # Two jumps a round: threefold distance for one write.
        step = left.join(known, F.col("ptr") == F.col("w_id")).select("id", F.col("w_ptr").alias("ptr"), F.col("w_state").alias("state"), (F.col("depth") + F.col("w_depth")).alias("depth"))
        again = F.when(step["state"].isNull(), step["ptr"]) == F.col("w_id")
        step = step.join(known, again, "left")
        jumped = F.col("w_id").isNotNull()
        work = settle(step.select("id", F.when(jumped, F.col("w_ptr")).otherwise(F.col("ptr")).alias("ptr"), F.when(jumped, F.col("w_state")).otherwise(F.col("state")).alias("state"), (F.col("depth") + F.when(jumped, F.col("w_depth")).otherwise(0)).alias("depth")), "roots")
        before, left = n, work.where(F.col("state").isNull())
        n = left.count()
        done.append(work.where(F.col("state").isNotNull()))
        if n == before:
            break
    done.append(left.withColumn("state", F.lit("cycle")))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    found = F.col("state") == "reply"
    return every.select("id", F.when(found, F.col("ptr")).alias("root"), F.when(found, F.col("depth")).alias("depth"), "state")


def placed_messages(messages: DataFrame) -> DataFrame:
    """Current messages with the conversation they belong to (null: none), depth and state.

    state: thread, root, reply, orphan or cycle.
    """
    cur = settle(current_messages(messages), "current")
    roots = resolve_roots(cur)
    r = roots.select(F.col("id").alias("r_id"), "root", "depth", "state")
    thread, root = F.col("thread_id").isNotNull(), F.col("thread_id").isNull() & F.col("reply_to_id").isNull()
    replies = cur.where(~thread & ~root).join(r, F.col("id") == F.col("r_id")).select(*cur.columns, F.col("root").alias("conversation_id"), "depth", "state")
    rest = cur.where(thread | root).select(
        *cur.columns,
        F.coalesce("thread_id", "id").alias("conversation_id"),
        F.when(root, F.lit(0)).cast("long").alias("depth"),
        F.when(thread, F.lit("thread")).otherwise(F.lit("root")).alias("state"),
    )
    # A thread's reply can be broken although its conversation is known.
    return rest.unionByName(replies)


def conversations(messages: DataFrame) -> DataFrame:
    """Kept conversations in order: conversation_id, message_id, turn, speaker_role.

    Messages are the current undeleted rows.  Kept are conversations of two or
    more messages whose positions are exactly 0 to n-1, in which nobody replies
    to a missing message or to itself, and in which two or more authors wrote
    visible content.  Rows without an id are ignored; null positions, null
    authors (they don't count as authors) and empty tables are allowed.
    Repeated rows count once.  Aggregates only (combined map-side): no
    conversation is ever gathered in one task.
    """
    placed = settle(placed_messages(messages), "placed")
    # Replies inside threads whose target is missing; the other replies' targets were met on the way to their root.
    inside = placed.where(F.col("thread_id").isNotNull() & F.col("reply_to_id").isNotNull()).select("conversation_id", F.col("id").alias("b_id"), "reply_to_id")
    there = placed.select(F.col("id").alias("t_id"))
    broken = inside.where(F.col("b_id") == F.col("reply_to_id")).select("conversation_id").unionByName(
        inside.join(there, F.col("reply_to_id") == F.col("t_id"), "left_anti").select("conversation_id")
    )
    rows = placed.where(F.col("conversation_id").isNotNull()).select("conversation_id", "position", F.when(F.col("speaks"), F.col("author_id")).alias("speaker"), "author_id", F.lit(False).alias("broken"))
    marks = broken.select("conversation_id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("long").alias("speaker"), F.lit(None).cast("long").alias("author_id"), F.lit(True).alias("broken"))
    by_place = rows.unionByName(marks).groupBy("conversation_id", "position").agg(
        F.count("*").alias("n"), F.min("speaker").alias("lo"), F.max("speaker").alias("hi"), F.max("broken").alias("broken"), F.max("author_id").alias("author")
    )
    whole = by_place.groupBy("conversation_id").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.min("position").alias("first"), F.max("position").alias("last"), F.count("position").alias("places"), F.count("*").alias("groups"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("broken").alias("broken"), F.max(F.when(F.col("position") == 0, F.col("author"))).alias("opener"),
    )
    kept = whole.where(
        ~F.col("broken") & (F.col("n") >= 2) & (F.col("most") == 1) & (F.col("places") == F.col("groups")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("lo") != F.col("hi"))
    ).select(F.col("conversation_id").alias("kept_id"), "opener")
    role = F.when(F.col("bot"), "bot").when(F.col("author_id") == F.col("opener"), "opener").otherwise("replier")
    return placed.join(kept, F.col("conversation_id") == F.col("kept_id")).select("conversation_id", F.col("id").alias("message_id"), F.col("position").cast("long").alias("turn"), role.alias("speaker_role"))


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """Every path from a root to a leaf outside threads, in order: leaf_id, conversation_id, step, message_id.

    A leaf is a message with a root that no other message of its conversation
    replies to; step counts from 0 at the root.  Ancestors are found by binary
    lifting over the reply pointers: a place n steps up is reached in as many
    joins as n has bits, whatever the depth.  Broken chains and cycles have no
    path; a root that nobody answered is a path of one.  Empty tables give no row.
    """
    placed = settle(placed_messages(messages), "placed")
    nodes = placed.where(F.col("thread_id").isNull() & F.col("conversation_id").isNotNull()).select("id", "conversation_id", "depth", "reply_to_id")
    parents = nodes.where(F.col("depth") > 0).select(F.col("id").alias("u_id"), F.col("reply_to_id").alias("up"))
    leaves = nodes.join(parents.select(F.col("up").alias("p_id")).distinct(), F.col("id") == F.col("p_id"), "left_anti")
    deepest = leaves.agg(F.max("depth").alias("d")).first()["d"] or 0
    rows = leaves.select(F.col("id").alias("leaf_id"), "conversation_id", F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("back"), "depth", F.col("id").alias("at"))
    lift = settle(parents, "lift")
    for bit in range(int(deepest).bit_length()):
        j = rows.join(lift, (F.col("at") == F.col("u_id")) & (F.expr(f"(back >> {bit}) & 1") == 1), "left")
        rows = settle(j.select("leaf_id", "conversation_id", "back", "depth", F.coalesce("up", "at").alias("at")), "paths")
        further = lift.select(F.col("u_id").alias("w_id"), F.col("up").alias("w_up"))
        lift = settle(lift.join(further, F.col("up") == F.col("w_id")).select("u_id", F.col("w_up").alias("up")), "lift")
    return rows.select("leaf_id", "conversation_id", (F.col("depth") - F.col("back")).alias("step"), F.col("at").alias("message_id"))
