"""Operators of the core against plain versions, with dirty and empty input."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadmill.functions import facts as FA
from threadmill.functions import stats
from threadmill.functions import text as T
from threadmill.operators import classify as C
from threadmill.operators import claims as K
from threadmill.operators import grouping as G
from threadmill.operators import order as O
from threadmill.operators import relational as R
from threadmill.operators import search as S
from threadmill.operators import similar
from threadmill.operators.changes import apply_changes
from threadmill.operators.current import latest_by
from threadmill.operators.ledger import DONE, PENDING, PLAN, Ledger, Runs, RunUnfinished, StaleLease, accepted, due_records, run_leased, take_in
from threadmill.operators.sessions import sessionize
from threadmill.plans import text_queries
from threadmill.sources import archive
from threadmill.storage import scratch, settle
from threadmill.streaming import pipeline

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


# ---- sessions

EVENTS = "channel long, thread long, id long, ts timestamp_ntz, n int, slot string"


def plain_sessions(rows, gap):
    out, by = [], {}
    for c, t, i, ts, *_ in rows:
        if ts is not None and i is not None:
            by.setdefault((c, t), []).append((ts, i))
    for k, es in by.items():
        es.sort()
        cur = []
        for e in es:
            if cur and (e[0] - cur[-1][0]).total_seconds() > gap:
                out.append((*k, cur[0][1], cur[-1][1], len(cur)))
                cur = []
            cur.append(e)
        out.append((*k, cur[0][1], cur[-1][1], len(cur)))
    return sorted(out, key=repr)


def run_sessions(spark, rows, gap):
    s = sessionize(spark.createDataFrame(rows, EVENTS), ["channel", "thread"], "id", "ts", gap)
    return sorted([(r.channel, r.thread, r.first_id, r.last_id, r.n_events) for r in s.collect()], key=repr)


def test_sessions_boundary(spark):
    rows = [(1, None, 1, at(0), 1, "x"), (1, None, 2, at(30), 1, "x"), (1, None, 3, at(60) + timedelta(microseconds=1), 1, "x"), (1, 7, 4, at(5), 1, "x"), (1, None, 5, None, 1, "x")]
    assert run_sessions(spark, rows, 1800) == [(1, 7, 4, 4, 1), (1, None, 1, 2, 2), (1, None, 3, 3, 1)]


def test_sessions_random(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):  # one channel holds a third, many ties, times before 1970 too
        c = rng.choice([1, 1, 1, 2, 3, None])
        ts = at(rng.choice([rng.randrange(0, 90) * 10, rng.randrange(-40_000_000, 40_000), rng.randrange(0, 600)]))
        rows.append((c, rng.choice([None, 5]), i, ts if rng.random() > 0.02 else None, 0, None))
    assert run_sessions(spark, rows, 1800) == plain_sessions(rows, 1800)


def test_sessions_empty(spark):
    assert run_sessions(spark, [], 1800) == []


# ---- change feed

FEED = "change_seq long, message_id long, channel_id long, op string, revision int, content string, created_at timestamp_ntz, edited_at timestamp_ntz, deleted_at timestamp_ntz, winner string"


def test_changes(spark):
    rows = [
        (1, 10, 1, "insert", 0, "a", at(0), None, None, "w"),
        (1, 10, 1, "insert", 0, "a", at(0), None, None, "w"),
        (5, 10, 1, "update", 2, "c", at(0), at(9), None, "w"),
        (3, 10, 1, "update", 1, "b", at(0), at(5), None, "w"),
        (4, 10, 1, "delete", None, None, None, None, at(7), None),  # before the winner: alive
        (6, 11, 1, "insert", 0, "x", at(0), None, None, "w"),
        (7, 11, 1, "delete", None, None, None, None, at(1), None),  # later: gone
        (8, 12, 1, "delete", None, None, None, None, at(1), None),  # no insert
        (9, 13, 1, "update", 3, None, at(0), at(1), None, None),  # insert missing, content never set
        (10, 14, 1, "update", 1, "p", at(0), at(2), None, None),
        (11, 14, 1, "update", 1, "q", at(0), at(2), None, None),  # revision twice: the higher seq wins
        (12, 15, 1, "insert", None, "n", None, None, None, None),  # no times: alive
        (13, 15, 1, "delete", None, None, None, None, at(1), None),
        (14, None, 1, "insert", 0, "z", at(0), None, None, None),
        (15, 16, 1, "insert", 0, "z", at(3), None, None, None),
        (16, 16, 1, "delete", None, None, None, None, at(3), None),  # at the same time: alive
        (17, 17, 1, "odd", 0, "z", at(3), None, None, None),
    ]
    out = apply_changes(spark.createDataFrame(rows, FEED), ("content",)).collect()
    assert sorted((r.message_id, r.revision, r.change_seq, r.content) for r in out if r.message_id != 15) == [(10, 2, 5, "c"), (13, 3, 9, None), (14, 1, 11, "q"), (16, 0, 15, "z")]
    assert [r.change_seq for r in out if r.message_id == 15] == [12]
    assert apply_changes(spark.createDataFrame([], FEED)).collect() == []


def test_latest_by_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 5, "c"), (None, 1, "d"), (None, 2, "e")], "k long, o long, v string")
    assert sorted(((r.k, r.v) for r in latest_by(df, ["k"], ["o"]).collect()), key=repr) == [(1, "c"), (None, "e")]


# ---- ledger


@pytest.fixture
def ledger(spark):
    now = [100.0]
    return Ledger(spark, scratch(spark, "ledger"), lambda: now[0]), now


def test_ledger_states(ledger):
    l, now = ledger
    l.enqueue([1, 2])
    l.enqueue([1, 2])
    a = l.lease("a", 10)
    assert [x.item for x in a] == [1, 2] and l.lease("b", 10) == []
    l.complete(a[0])
    now[0] += 11  # a's lease of item 2 has expired
    assert l.state(1)[0] == DONE and l.state(2)[0] == PENDING
    (b,) = l.lease("b", 10)
    assert b.item == 2 and b.token > a[1].token
    with pytest.raises(StaleLease):
        l.complete(a[1])
    l.complete(b)
    assert l.done() == [(1, a[0].token), (2, b.token)]


def test_ledger_survives_a_broken_run(spark, ledger):
    l, now = ledger
    work = spark.range(40).select(F.col("id").alias("message_id"), F.pmod("id", F.lit(4)).cast("int").alias("b"))
    l.enqueue(range(4))
    dead = l.lease("first", 10, limit=2)  # writes half of its rows, then dies
    work.where("b = 0 AND message_id < 20").drop("b").write.parquet(f"{l.output(dead[0])}")
    assert run_leased(l, work, "b", "second") == 2
    now[0] += 11
    assert run_leased(l, work, "b", "third") == 2
    for x in dead:
        with pytest.raises(StaleLease):
            l.complete(x)
    assert sorted(r.message_id for r in accepted(l, "message_id long").collect()) == list(range(40))
    assert run_leased(l, work, "b", "fourth") == 0


SOURCE = "id long, channel_id long, thread_id long, edited_at timestamp_ntz, is_system boolean, delivered_at timestamp_ntz, place string"


def test_due_records(spark):
    source = spark.createDataFrame(
        [
            (5, 1, None, None, False, at(0), ""),  # below the checkpoint, unknown: skipped on purpose
            (15, 1, None, None, False, at(0), ""),  # above it: new
            (15, 1, None, None, False, at(0), ""),
            (16, 1, None, None, True, at(0), ""),  # system
            (17, 1, 3, None, False, at(0), ""),  # thread without row: never fetched
            (4, 2, None, None, False, at(0), ""),  # only null checkpoints: never fetched
            (6, 1, None, at(9), False, at(0), ""),  # stored, newer edit
            (6, 1, None, at(1), False, at(5), ""),
            (7, 1, None, None, False, at(0), ""),  # stored, same
            (8, 1, None, at(3), False, at(0), ""),  # stored row was edited at 3: same
            (None, 1, None, None, False, at(0), ""),
            (20, None, None, None, None, None, None),
        ],
        SOURCE,
    )
    channels = spark.createDataFrame([(1, 3), (1, 10), (2, None)], "id long, last_backfilled_message_id long")
    stored = spark.createDataFrame([(6, at(0), at(2), 1), (6, at(9), at(3), 1), (7, at(0), None, 1), (8, at(0), at(3), 1)], "id long, ingested_at timestamp_ntz, edited_at timestamp_ntz, mark int")
    assert sorted(r.message_id for r in due_records(source, channels, stored).collect()) == [4, 6, 15, 17, 20]
    assert sorted(r.message_id for r in take_in(source, channels, stored, scratch(spark, "t")).collect()) == [4, 6, 15, 17, 20]
    assert take_in(source.limit(0), channels.limit(0), stored.limit(0), scratch(spark, "t")).collect() == []


def plain_due(source, marks, stored):
    newest, out = {}, set()
    for i, c, e in source:
        if i not in newest or (e is not None and (newest[i][1] is None or e > newest[i][1])):
            newest[i] = (c, e)
    for i, (c, e) in newest.items():
        new = i not in stored and (marks.get(c) is None or i > marks[c])
        edited = i in stored and e is not None and (stored[i] is None or e > stored[i])
        if new or edited:
            out.add(i)
    return out


def test_three_runs_with_a_crash_late_rows_and_a_stale_writer(spark):
    now, path = [0.0], scratch(spark, "runs")
    source, marks, stored = [(i, 1, None) for i in range(1, 21)], {1: 5}, {3: None, 4: at(1)}
    source += [(3, 1, at(2)), (4, 1, at(1))]

    def frames():
        s = spark.createDataFrame([(i, c, None, e, False, at(0), "") for i, c, e in source], SOURCE)
        return s, spark.createDataFrame(list(marks.items()), "id long, last_backfilled_message_id long"), spark.createDataFrame([(i, at(0), e, 1) for i, e in stored.items()], "id long, ingested_at timestamp_ntz, edited_at timestamp_ntz, mark int")

    def go(owner="a"):
        return {r.message_id for r in take_in(*frames(), path, buckets=4, owner=owner, clock=lambda: now[0], lease_seconds=100).collect()}

    runs = Runs(spark, path, 4, lambda: now[0])
    # Run 1: the worker that makes the snapshot and one item dies between writing and completing.
    want1 = plain_due(source, marks, stored)
    l = runs.ledger(1)
    l.enqueue([PLAN])
    (dead_plan,) = l.lease("dead", 100, only=[PLAN])
    spark.createDataFrame([(999, None, 1, 0)], "message_id long, edited_at timestamp_ntz, place long, bucket int").write.partitionBy("bucket").parquet(l.output(dead_plan))
    with pytest.raises(RunUnfinished):
        go("b")  # the lease still runs
    now[0] += 101
    l.enqueue(range(4))
    (dead_item,) = l.lease("dead", 100, only=[2])
    with pytest.raises(RunUnfinished):
        go("b")  # everything but the dead one's item
    with pytest.raises(StaleLease):
        l.complete(dead_plan)
    source += [(i, 1, None) for i in range(30, 33)]  # late rows: not this run's
    now[0] += 101
    assert go("c") == want1 == {3, *range(6, 21)}
    with pytest.raises(StaleLease):
        l.complete(dead_item)
    spark.createDataFrame([(998, None, 1)], "message_id long, edited_at timestamp_ntz, place long").write.mode("append").parquet(l.output(dead_item))  # the stale writer writes all the same
    assert {r.message_id for r in runs.rows(1).collect()} == want1
    # Run 2 begins although nobody told the tables of run 1 yet: nothing comes twice, a later edit of a taken id does.
    source += [(7, 1, at(9))]
    assert go() == {7, 30, 31, 32}
    # Run 3, with the tables brought up to date.
    marks = {r.id: r.last_backfilled_message_id for r in runs.advanced(frames()[1]).collect()}
    assert marks == {1: 32}
    for run in (1, 2):
        stored.update({r.message_id: r.edited_at for r in runs.rows(run).collect()})
    source += [(40, 1, None), (25, 1, None), (50, 2, None), (3, 1, at(5))]
    assert go() == plain_due(source, marks, stored) == {40, 50, 3}  # 25 lies below the checkpoint
    stored.update({r.message_id: r.edited_at for r in runs.rows(3).collect()})
    assert go() == set() and go() == set()  # a rerun changes nothing
    every = [r.message_id for run in runs.known() for r in runs.rows(run).collect()]
    assert sorted(every) == sorted([*want1, 7, 30, 31, 32, 40, 50, 3]) and runs.finished(5)


def test_ledger_entries_are_exclusive(spark, ledger):
    from concurrent.futures import ThreadPoolExecutor

    l, _ = ledger
    l.enqueue([1])
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: l._append(1, 2, {"state": "leased", "owner": str(i), "until": 1e9}), range(40)))
    assert sum(won) == 1
    with pytest.raises(ValueError):
        Ledger(spark, "ftp://somewhere/x")


# ---- grouping


def plain_groups(ms, gap, fold, small, most, overlap=2):
    """Groups by the book, one channel after the other: threads, reply components, quiet gaps, folding, splitting."""
    out = []
    for c in sorted({m["channel_id"] for m in ms}):
        rows = sorted((m for m in ms if m["channel_id"] == c), key=lambda m: (m["us"], m["id"]))
        label = {m["id"]: ("t", m["thread_id"]) if m["thread_id"] is not None else ("r", m["id"]) for m in rows}
        pool = [m for m in rows if m["thread_id"] is None]
        ids = {m["id"] for m in pool}
        changed = True
        while changed:  # labels flow along replies until nothing moves
            changed = False
            for m in pool:
                if m["reply_to_id"] in ids:
                    low = min(label[m["id"]], label[m["reply_to_id"]])
                    if {label[m["id"]], label[m["reply_to_id"]]} != {low}:
                        label[m["id"]] = label[m["reply_to_id"]] = low
                        changed = True
        sizes = pd.Series([label[m["id"]] for m in rows]).value_counts()
        n, last = 0, None
        for m in pool:
            if sizes[label[m["id"]]] == 1:
                n += last is not None and m["us"] - last > gap
                last = m["us"]
                label[m["id"]] = ("q", n)
        line = []  # [kind, messages] in order of the first message
        for m in rows:
            held = next((g for g in line if g[0] == label[m["id"]]), None)
            held[1].append(m) if held else line.append([label[m["id"]], [m]])
        done = []
        while line:
            kind, mine = line.pop(0)
            best = None
            if fold is not None and len(mine) <= small and kind[0] != "t":
                for side, other in ((0, done[-1] if done else None), (1, line[0] if line else None)):
                    if other is None or len(other[1]) <= small or len(other[1]) + len(mine) > most:
                        continue
                    away = mine[0]["us"] - max(m["us"] for m in other[1]) if side == 0 else other[1][0]["us"] - max(m["us"] for m in mine)
                    a, b = {m["id"] for m in mine}, {m["id"] for m in other[1]}
                    kin = any(m["reply_to_id"] in b for m in mine) or any(m["reply_to_id"] in a for m in other[1])
                    if away <= fold and (kin or other[0][0] != "t"):
                        best = min(filter(None, [best, (not kin, max(away, 0), side, other)]), key=lambda x: x[:3])
            if best:
                best[3][1].extend(mine)
                best[3][1].sort(key=lambda m: (m["us"], m["id"]))
            else:
                done.append([kind, mine])
        for _, g in done:
            before = []
            while g:
                cut = len(g) if len(g) <= most else max(range(1, most + 1), key=lambda i: (g[i]["us"] - g[i - 1]["us"], i))
                part, g = g[:cut], g[cut:]
                out += [(c, m["id"], part[0]["id"], i, False) for i, m in enumerate(part)]
                out += [(c, m["id"], part[0]["id"], i - len(before), True) for i, m in enumerate(before)]
                before = part[-overlap:]
    return sorted(out)


@pytest.mark.parametrize("seed, fold, small, most, chunk", [(1, 120, 1, 12, 50_000), (2, 120, 1, 4, 7), (3, 400, 2, 9, 5), (4, 30, 1, 3, 50_000), (5, 2000, 1, 5, 11), (6, 90, 3, 6, 3), (7, 60, 1, 2, 50_000)])
def test_final_groups_random(spark, monkeypatch, seed, fold, small, most, chunk):
    monkeypatch.setattr(O, "CHUNK_ROWS", chunk)
    rng = random.Random(seed)
    ms = []
    for i in range(1, 320):
        ms.append({"id": i, "channel_id": rng.choice([1, 1, 2, 3]), "us": int(rng.randrange(0, 6000) * 60e6), "author_id": rng.randrange(4), "reply_to_id": rng.choice([None, None, None, 999, rng.randrange(1, i + 1), i + 1]), "thread_id": rng.choice([None] * 6 + [1001, 1002 + i % 40])})
    df = spark.createDataFrame([tuple(m.values()) for m in ms], "id long, channel_id long, us long, author_id long, reply_to_id long, thread_id long")
    keys = G.exchange_keys(df, int(30 * 60e6))
    got = sorted(tuple(r) for r in G.final_groups(df, keys, int(fold * 60e6), small, most, 2).collect())
    assert got == plain_groups(ms, 30 * 60e6, fold * 60e6, small, most)
    own = [r for r in got if not r[4]]
    assert sorted(r[1] for r in own) == [m["id"] for m in ms]  # every message in exactly one group
    assert pd.Series([r[2] for r in own]).value_counts().max() <= most


def test_groups_of_one_large_channel(spark):
    """One group of 3,000 messages, cut across blocks; equal gaps: the latest counts."""
    rng = random.Random(3)
    us, rows = 0, []
    for i in range(3000):
        us += rng.choice([1, 1, 2, 5])
        rows.append((0, us, i))
    got = {r.id: (r.part, r.position) for r in G.split(spark.createDataFrame(rows, "key int, us long, id long"), 50, 0, rows=64).collect()}
    want, rest = {}, rows
    while rest:
        cut = len(rest) if len(rest) <= 50 else max(range(1, 51), key=lambda i: (rest[i][1] - rest[i - 1][1], i))
        want |= {r[2]: (rest[0][2], n) for n, r in enumerate(rest[:cut])}
        rest = rest[cut:]
    assert got == want


def test_long_groups_are_hashed_in_parts(spark, monkeypatch):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    monkeypatch.setattr(G, "HASH_ROWS", 4)
    df = spark.createDataFrame([("a", 3, 1), ("a", 2, 9), ("a", 2, 5), *(("b", i, i) for i in range(6))], "key string, us long, id long")
    got = {r["key"]: (r.n, r.content_hash) for r in G.content_hash(df, "key").collect()}
    assert got == {"a": (3, sha("5,9,1")), "b": (6, sha(sha("0,1,2,3") + "," + sha("4,5")))}


def test_reply_cycles(spark):
    df = spark.createDataFrame([(1, 1, 3), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 1, 5), (6, 1, 4), (7, 2, 1)], "id long, channel_id long, reply_to_id long")
    assert {r.id: r.root for r in G.reply_components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1, 7: 7}


def test_remap_majority(spark):
    old = spark.createDataFrame([(1, i) for i in range(4)] + [(2, i) for i in range(10, 14)] + [(3, 20)], "group_id long, id long")
    new = spark.createDataFrame([(7, 0), (7, 1), (8, 2), (8, 3), (9, 10), (9, 11), (9, 12), (6, 13), (5, 20)], "group_id long, id long")
    assert {r.old_id: (r.kind, r.new_id) for r in G.remap(old, new).collect()} == {1: ("ambiguous", None), 2: ("split", 9), 3: ("one_to_one", 5)}


# ---- scores


def test_auc_and_thresholds(spark):
    frame = lambda rows: spark.createDataFrame(rows, "score double, label boolean")
    assert C.auc(frame([(0.5, True), (0.5, False)])).first().auc == 0.5
    assert C.auc(frame([(0.5, True)])).first().auc is None
    assert C.auc(frame([])).first().auc is None
    assert C.tune_high(frame([(0.4, False), (0.9, False)]), 0.9).first().t_high == 1.01
    assert C.tune_high(frame([(0.4, True), (0.9, True), (0.1, False)]), 0.9).first().t_high == 0.4


def test_logistic_is_plain_descent():
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 3)), rng.integers(0, 2, 30).astype(float)
    w, b = np.zeros(3), 0.0
    for _ in range(50):
        g, gb = np.zeros(3), 0.0
        for xi, yi in zip(x, y):
            e = 1 / (1 + np.exp(-(xi @ w + b))) - yi
            g, gb = g + e * xi, gb + e
        w, b = w - 0.1 * (g / 30 + w / 30), b - 0.1 * gb / 30
    got = C.fit_logistic(x, y, 50)
    assert np.allclose(got[0], w) and abs(got[1] - b) < 1e-9


def test_logistic_over_a_table_takes_every_row(spark):
    import numpy as np

    # Rows that a share of the table by hash would hardly hold decide the fit.
    d = spark.range(24_000).select(((F.col("id") % 7) - 3.0).alias("z0"), ((F.col("id") % 11) - 5.0).alias("z1"), ((F.col("id") % 13) + (F.col("id") % 7) > 11).alias("label"))
    d = d.unionByName(spark.range(900).select(F.lit(9.0).alias("z0"), (F.col("id") / 100).alias("z1"), F.lit(False).alias("label")))
    rows = d.collect()
    w, b = C.fit_logistic(np.array([(r.z0, r.z1) for r in rows]), np.array([r.label for r in rows], float), 12)
    for held in (0, 10_000):
        got = C.fit_logistic_rows(d.unionByName(d.limit(3).withColumn("label", F.lit(None).cast("boolean"))), ["z0", "z1"], 12, held=held)
        assert np.allclose(got[0], w, atol=1e-12) and abs(got[1] - b) < 1e-12
    assert C.fit_logistic_rows(d.limit(0), ["z0", "z1"]) is None


def test_out_of_fold_scores_can_be_joined(spark):
    rng = random.Random(3)
    docs = [(i, sorted({f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 9))})) for i in range(400)]
    labels = [(i, "w7" in t or rng.random() < 0.3) for i, t in docs if i % 3]
    d = settle(spark.createDataFrame(docs, "id long, tokens array<string>"), "docs")
    x, y = (settle(spark.createDataFrame(r, "id long, label boolean"), "labels") for r in (labels, [(i, not v) for i, v in labels[::2]]))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = C.out_of_fold_bayes(d, x).join(C.out_of_fold_bayes(d, y).withColumnRenamed("p", "q"), "id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(got) == 400
    fold = {r.id: r.fold for r in d.select("id", stats.fold(F.col("id"), 2).alias("fold")).collect()}
    for name, known in (("p", x), ("q", y)):
        for k in range(2):
            rest = known.join(d, "id").where(stats.fold(F.col("id"), 2) != k)
            want = C.fisher_scores(d, C.token_probability(C.nb_counts(rest), C.class_totals(rest)))
            want = {r.id: r.p for r in want.collect()}
            assert all(abs(r[name] - want[r.id]) < 1e-9 for r in got if fold[r.id] == k)


def test_wilson_without_rows(spark):
    lo, _ = stats.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(lo).first()[0] is None


def test_as_of_ties(spark):
    p = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    v = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c")], "k long, s long, no long, v string")
    assert sorted(map(tuple, R.as_of(p, v, ["k"], "t", "s", "v", "no").collect()), key=repr) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


# ---- statements


def facts_in(spark, text, models=None):
    df = spark.createDataFrame([(text,)], "t string")
    return {(f.kind, f.value) for f in df.select(FA.facts_of(FA.tokens(F.col("t"), models), models).alias("f")).first().f}


@pytest.mark.parametrize(
    "text, want",
    [
        ("It has two GB of RAM", {("quantity", "2 gb")}),
        ("1,024 MB, 2.50GHz, one gig and 007 kb", {("quantity", "1024 mb"), ("quantity", "2.5 ghz"), ("quantity", "1 gb"), ("quantity", "7 kb")}),
        ("an r10k in 1996, not 1812", {("cpu", "r10000"), ("year", "1996"), ("number", "1812")}),
        ("see `a.conf` and \u201cold boot rom\u201d, v 6.5.22m", {("file", "a.conf"), ("quote", "old boot rom"), ("version", "6.5.22")}),
        ("part 030-0087-003 costs 4k", {("part", "030-0087-003"), ("number", "4000")}),
        ("two of them, three more, four boards", {("number", "4")}),
        ("my o200 and <@123> user-ab12 said 10-20", {("model", "origin 200"), ("number", "10"), ("number", "20")}),
        ("the Lorzan 100 has 3 fans", {("model", "lorzan 100"), ("number", "3")}),
        ("", set()),
    ],
)
def test_facts(spark, text, want):
    assert facts_in(spark, text, r"\blorzan [0-9]{3}\b") == want


def test_fact_verdicts(spark):
    rows = [
        (1, "It has 512 MB", "mine has 512 megabytes"),
        (2, "It has 256 MB", "mine has 512 megabytes"),
        (3, "It works", ""),
        (4, "version 6.5 boots", "version 6.5.22 boots"),
        (5, "version 6.5.22 boots", "version 6.5 boots"),
        (6, "seven sockets", "sockets 7 and 8"),
        (7, "The yellow bicycle costs 20", "it was 20"),
        (8, "edit `x.ini`", "in x.ini somewhere edit"),
        (9, None, None),
        (10, "works nicely", "works nicely indeed"),
    ]
    got = {r.id: r.verdict for r in K.check_facts(spark.createDataFrame(rows, "id long, statement string, source string")).collect()}
    assert got == {1: "supported", 2: "unsupported_fact", 3: "low_overlap", 4: "supported", 5: "unsupported_fact", 6: "supported", 7: "low_overlap", 8: "supported", 9: "uncheckable", 10: "uncheckable"}


def test_canonical_and_merge(spark):
    forms = {"SGI O2®": "o2", "ＳＧＩ  Indy": "indy", "IRIX 6.5.22": "irix6.5.22", "SGI": "sgi", "$PATH_x": "pathx", "a. b": "ab", "": ""}
    d = K.compatible(spark.createDataFrame([(t,) for t in forms] + [(None,)], "t string"), "t")
    assert {r.tag: r.key for r in d.select("tag", K.canonical(F.col("form")).alias("key")).collect()} == forms
    tags = spark.createDataFrame([("Octanes",), ("Octane",), ("octane",), ("the Octane machine",), ("the Octanes",), (None,), ("",)], "t string")
    assert {r.key: r.target for r in K.merge_map(tags, "t").collect()} == {"octanes": "octane", "theoctanemachine": "octane", "theoctanes": "octane"}
    assert K.merge_map(tags.limit(0), "t").collect() == []


def test_near_duplicates_random(spark):
    rng = random.Random(2)
    sets = {i: frozenset(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 8))) for i in range(150)}
    sets |= {200 + i: sets[i % 9] for i in range(60)}  # copies
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(999, None)], "id long, items array<string>")
    got = {r.id: r for r in similar.near_duplicates(df, 0.6).collect()}
    sim = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.6 - 1e-12
    cls = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for i in sets:
            for j in sets:
                if sim(sets[i], sets[j]) and cls[j] < cls[i]:
                    cls[i], moved = cls[j], True
    assert {i: got[i].class_id for i in sets} == cls and got[999].class_id == 999
    for i in list(sets)[::7]:
        assert got[i].n_links == sum(sim(sets[i], sets[j]) and sets[i] != sets[j] for j in sets if j != i)


def test_links_write_no_candidates(spark, monkeypatch):
    # 400 texts that all share three words and are otherwise different: 79,800 candidates, 2 links.
    sets = {i: {"x", "y", "z", *(f"w{i}_{j}" for j in range(3)), f"v{i % 5}"} for i in range(400)}
    sets |= {401: {"x", "y", "z", "w7_0", "w7_1", "w7_2"}, 402: {"x", "y", "w8_0", "w8_1", "w8_2", "v3", "q"}}
    wide = []
    monkeypatch.setattr(similar, "settle", lambda df, what: (lambda d: (wide.append((what, d.count())), d)[1])(settle(df, what)))
    _, links = similar.similar_links(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<string>"), 0.6)
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    assert {(r.a, r.b) for r in links.collect()} == want and {(7, 401), (8, 402)} <= want
    assert links.count() == len(want)
    assert max(n for _, n in wide) <= len(sets)  # neither candidates nor a row per item


def test_leaders_along_a_chain(spark):
    n = spark.createDataFrame([(i,) for i in range(1, 30)], "node long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(3, 28), (2, 28), (20, 21)], "a long, b long")
    got = {r.node: r.lead for r in K.elect(n, chain).collect()}
    assert got == {**{i: i if i % 2 else i - 1 for i in range(1, 22)}, **{i: i for i in range(22, 30)}, 28: 3}
    assert {r.node for r in K.elect(n, chain.limit(0)).collect()} == set(range(1, 30))


def test_greedy_groups_random(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, sorted({f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 5))})) for i in range(120)]
    got = {(r.topic, r.claim): r.lead for r in K.group_claims(spark.createDataFrame(rows, "topic string, claim long, words array<string>"), 0.5).collect()}
    want = {}
    for t in "ab":
        leads = []
        for _, i, w in sorted(r for r in rows if r[0] == t):
            w = set(w)
            hit = next((k for k, lw in leads if w and lw and len(w & lw) / len(w | lw) >= 0.5), None)
            if hit is None:
                leads.append((i, w))
            want[t, i] = i if hit is None else hit
    assert got == want


def test_text_functions(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(T.word_tokens, "Été ça, l'a/b c++! x." + "y" * 50) == ["été", "ça", "l'a/b", "c++"]
    assert one(T.registrable_word, "https://www.foo.co.uk/x") == "foo" and one(T.registrable_word, "http://a.bar.example/") == "bar"
    assert one(T.snippet, "a" * 300).endswith("...") and len(one(T.snippet, "a" * 300)) == 200
    assert one(T.word_tokens, None) is None and one(T.word_tokens, "") == []


# ---- sources and streams


def test_read_export(spark, tmp_path):
    doc = {
        "guild": {"id": "1", "name": "g"}, "channel": {"id": "2", "type": "GuildPublicThread", "categoryId": "9", "name": "c"},
        "messages": [
            {"id": "3", "type": "Reply", "timestamp": "2023-08-01T12:00:00.0000000+00:00", "content": "hi", "author": {"id": "4", "name": "n", "nickname": "nick", "isBot": False}, "reactions": [{"emoji": {"name": "x"}, "count": 0}, {"emoji": {"name": "y"}, "count": 2}], "reference": {"messageId": "7"}},
            {"id": "5", "type": "ChannelPinnedMessage", "timestamp": "2023-08-01T12:00:00+00:00", "content": "", "author": {"id": "4", "name": "n", "isBot": False}, "reactions": []},
        ],
    }
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text(json.dumps(doc))
    a, b = archive.read_export(spark, str(tmp_path)).orderBy("id").collect()
    assert (a.author_name, a.is_system, a.reply_to_id, a.kind, a.parent_id, len(a.reactions)) == ("nick", False, 7, "thread", 9, 1)
    assert b.is_system and b.author_name == "n"
    (tmp_path / "a/y.json").write_text('{"guild": {')
    with pytest.raises(Exception):
        archive.read_export(spark, str(tmp_path)).collect()


def test_stream_dead_letters_and_repeat(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1}\n{"id": "x"}\nnot json\n')
    schema = spark.createDataFrame([], "id long").schema
    go = lambda: pipeline.write_batches(pipeline.read_files(spark, str(src), schema, "json"), str(tmp_path / "out"), str(tmp_path / "mark"), str(tmp_path / "dead")).awaitTermination()
    read = lambda p: spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / p)).collect()
    go()
    assert [r.id for r in read("out")] == [1] and len(read("dead")) == 2
    go()  # nothing new: nothing changes
    (src / "2.json").write_text('{"id": 2}\n')
    go()
    assert sorted(r.id for r in read("out")) == [1, 2]


def test_late_rows_are_caught_up(spark):
    a = spark.createDataFrame([(1,), (None,), (2,)], "id long")
    assert [r.id for r in pipeline.catch_up(a, spark.createDataFrame([(1,), (None,)], "id long"), "id").collect()] == [2]


def test_snapshot_refuses_to_overwrite(spark, tmp_path):
    archive.snapshot(spark.range(3), str(tmp_path / "s"))
    with pytest.raises(Exception):
        archive.snapshot(spark.range(3), str(tmp_path / "s"))


@pytest.mark.parametrize("rows", [1, 7, 50_000])
def test_channel_context_crosses_days_and_chunks(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "CHUNK_ROWS", rows)
    rng = random.Random(rows)
    day = 86_400_000_000
    data = [(i, rng.choice([1, 1, 1, 2, 3, None]), i * day // 3 + rng.randrange(day), rng.choice(["hit", "no", "no", None])) for i in sorted(rng.sample(range(2000), 200))]
    data += [(5000, 4, day - 1, "no"), (5001, 4, day + 1, "hit"), (5002, 5, day, "hit"), (10**18, 4, 9 * day, "no")]
    df = spark.createDataFrame(data, "id long, channel_id long, us long, content string").repartition(5)
    got = sorted(tuple(r) for r in S.channel_context(df, F.col("content") == "hit", 2).collect())
    want = []
    for c in range(1, 6):
        ids = [r[0] for r in data if r[1] == c]
        want += [(h[0], ids[n], n - ids.index(h[0])) for h in data if h[1] == c and h[3] == "hit" for n in range(len(ids)) if abs(n - ids.index(h[0])) <= 2]
    assert got == sorted(want) and (5001, 5000, -1) in got and (5001, 10**18, 1) in got
    assert S.channel_context(df.limit(0), F.col("content") == "hit", 2).collect() == []


def test_letters_of_any_number(spark):
    def plain(n):
        return (plain(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    some = [*range(800), 26**2 + 26**3, 18277, 18278, 475253, 475254, 2**31 - 1]
    df = spark.createDataFrame([(n,) for n in some], "n int").select("n", T.letters(F.col("n")).alias("x"))
    got = {r["n"]: r["x"] for r in df.collect()}
    assert got == {n: plain(n) for n in some} and got[701] == "ZZ" and got[702] == "AAA" and len(set(got.values())) == len(set(some))


def test_pseudonyms_of_a_crowded_exchange(spark, monkeypatch):
    df = spark.createDataFrame([(1, 10_000 + p % 1500, p) for p in range(3000)], "xid long, author_id long, position long")
    monkeypatch.setattr(text_queries, "exchange_messages", lambda *_: df)
    got = {r.author_id: r.member for r in text_queries.pseudonyms(spark, "").collect()}
    assert len(got) == len(set(got.values())) == 1500 and got[10_699] == "ZX" and got[10_702] == "AAA"
