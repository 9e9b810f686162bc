"""Windows in chunks, publication, features, queues and recipes against plain versions, with nulls, ties and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.functions import text as T
from threadmill.operators import claims as K
from threadmill.operators import classify as C
from threadmill.operators import grouping as G
from threadmill.operators import lexicon as L
from threadmill.operators import order as O
from threadmill.operators import publish as P
from threadmill.operators import relational as R
from threadmill.operators import search as S
from threadmill.operators import stores as ST
from threadmill.operators.vectors import best_match


@pytest.mark.parametrize("rows", [1, 6, 50_000])
def test_numbers_and_marks_across_chunks(spark, monkeypatch, rows):
    monkeypatch.setattr(O, "CHUNK_ROWS", rows)
    rng = random.Random(rows)
    data = [(rng.choice(["a", "a", "b", None]), rng.randrange(60) * 10**6, i, rng.random() < 0.1) for i in range(150)]
    n = O.numbered(spark.createDataFrame(data, "k string, at long, id long, mark boolean"), ["k"], ["at", "id"])
    got = {r.id: (r.no, r.last, r.here) for r in O.carried(O.carried(n, ["k"], F.col("mark"), "last"), ["k"], F.col("mark"), "here", here=True).collect()}
    for k in ("a", "b", None):
        last = None
        for no, (_, _, i, mark) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: r[1:3])):
            here = no if mark else last
            assert got[i] == (no, last, here)
            last = here
    assert O.numbered(n.drop("no").limit(0), ["k"], ["at", "id"]).collect() == []


def test_prefix_sums(spark):
    rng = random.Random(1)
    data = {(rng.choice("xy"), float(rng.randrange(500))): rng.randrange(9) for _ in range(400)}
    df = spark.createDataFrame([(k, v, c) for (k, v), c in data.items()], "k string, v double, c long")
    for down in (False, True):
        for r in O.prefix_sums(df, ["k"], "v", ["c"], down, parts=16).collect():
            assert r.c_upto == sum(c for (k, v), c in data.items() if k == r.k and (v >= r.v if down else v <= r.v))
    assert O.prefix_sums(df.limit(0), ["k"], "v", ["c"]).collect() == []


def test_as_of_random(spark, monkeypatch):
    monkeypatch.setattr(O, "CHUNK_ROWS", 9)
    rng = random.Random(2)
    ps = [(i, rng.choice([1, 1, 2, None]), rng.choice([rng.randrange(100), None])) for i in range(80)]
    vs = [(rng.choice([1, 2, None]), rng.randrange(100), i, f"v{i}") for i in range(40)]
    out = R.as_of(spark.createDataFrame(ps, "id long, k long, t long"), spark.createDataFrame(vs, "k long, s long, no long, v string"), ["k"], "t", "s", "v", "no").collect()
    want = {i: max(((s, n, v) for kk, s, n, v in vs if kk == k and t is not None and s <= t), default=(0, 0, None))[2] for i, k, t in ps}
    assert {r.id: r.v for r in out} == want and len(out) == len(ps)


def test_halves(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7), (None, 1), (None, 2)], "k string, id long")
    assert sorted((r.k or "", r.id, r.half) for r in R.halves(df, "k", "id").collect()) == [("", 1, 1), ("", 2, 2), *(("a", i, 1 if i < 3 else 2) for i in range(5)), ("b", 7, 1)]


def test_token_windows(spark):
    df = spark.createDataFrame([(1, 0, "a" * 8), (1, 1, "b" * 30), (1, 2, "c" * 4), (2, 0, ""), (3, 0, "x" * 16), (3, 1, "y")], "xid long, position long, content string")
    got = sorted((r.xid, r.window_no, r.n, r.tokens) for r in S.token_windows(df, 4).collect())  # 16 characters a window
    assert got == [(1, 0, 1, 2), (1, 1, 1, 4), (1, 2, 1, 4), (1, 3, 1, 1), (2, 0, 1, 0), (3, 0, 1, 4), (3, 1, 1, 1)]


def test_best_match(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), rng.normal(size=5).tolist()) for i in range(90)] + [(200, 9, [1.0] * 5), (201, 0, None), (202, 1, [0.0] * 5), (203, 2, rng.normal(size=5).tolist()), (204, 2, None)]
    rows.append((300, rows[30][1], rows[30][2]))
    df = spark.createDataFrame(rows, "id long, `group` int, v array<double>").repartition(4)
    got = {r.id: (r.nearest, round(r.similarity, 6)) for r in best_match(df.where("id % 10 = 0"), df, block=3).collect()}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, g, v in rows if v}
    group = {i: g for i, g, _ in rows}
    want = {}
    for i in unit:
        if i % 10 == 0 and (others := sorted(((-round(float(unit[i] @ unit[j]), 9), j) for j in unit if j != i and group[j] == group[i]))):
            want[i] = (others[0][1], round(-others[0][0], 6))
    assert got == want and got[30] == (300, 1.0) and 200 not in got
    assert best_match(df.limit(0), df).collect() == []


def test_claim_problems(spark):
    claims = spark.createDataFrame(
        [(1, 7, 1, " \n", [10]), (2, 7, 1, "fine", None), (3, 7, 1, "fine", []), (4, 7, 1, "fine", [10, 99]), (5, 7, 5, "fine", [10]), (6, 7, 1, "so BO+B said", [10]), (7, 7, 1, "bo+by said", [10]), (8, 8, 1, "fine", [20]), (9, 7, 2, "fine", [10, 11]), (10, 7, 1, None, [10])],
        "claim long, xid long, speaker long, statement string, refs array<bigint>",
    )
    messages = spark.createDataFrame([(7, 10, 1), (7, 11, 2), (8, 20, 3)], "xid long, id long, author_id long")
    names = spark.createDataFrame([(7, "Bo+b"), (7, None), (8, "fine")], "xid long, name string")
    got = {r.claim: r.problem for r in P.validate(claims, messages, names).collect()}
    assert got == {1: "empty statement", 2: "no refs", 3: "no refs", 4: "unknown ref", 5: "unknown speaker", 6: "name leak", 7: None, 8: "unknown speaker", 9: None, 10: "empty statement"}


def test_publication(spark):
    rows = [("wrong", "supported"), ("good", "low_overlap"), (None, "supported"), (None, None), ("odd", "uncheckable")]
    df = spark.createDataFrame(rows, "review string, verdict string")
    pick = lambda allowed: [r[0] for r in df.select(P.publishable(F.col("review"), F.col("verdict"), allowed)).collect()]
    assert pick(("supported", "uncheckable")) == [False, True, True, False, True] and pick(None) == [False, True, True, True, True]
    claims = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 8, "a")], "claim long, xid long, statement string")
    out, lost = P.corrected(claims, spark.createDataFrame([(7, "a", "A"), (7, "b", None), (9, "a", "x")], "xid long, statement string, replace string"))
    assert sorted((r.claim, r.statement, r.dropped) for r in out.collect()) == [(1, "A", False), (2, "b", True), (3, "a", False)]
    assert [(r.xid, r.statement) for r in lost.collect()] == [(9, "a")]
    c = spark.createDataFrame([(1, "live", None, "new", None), (2, "live", None, "new", 1), (3, "trial", None, "new", 2), (4, "live", None, "known", None), (5, "live", 9, "new", 2)], "claim long, mode string, retracted_at long, novelty string, supersedes long")
    assert [r.claim for r in P.live(c).collect()] == [2]


def test_names_are_replaced(spark):
    m = spark.createDataFrame([(1, 10, "Ann Lee said hi, @ann! Annabel and LEE too (lee.x)"), (1, 11, None), (2, 12, "ann lee"), (1, 13, "user ann-lee, a.b*c! a.bxc")], "xid long, id long, content string")
    who = spark.createDataFrame([(1, 5, "user-aaaa", "Ann Lee"), (1, 6, "user-bbbb", "a.b*c"), (1, 7, "user-cccc", None), (1, 8, "user-dddd", "Ann")], "xid long, author_id long, pseudonym string, name string")
    got = {r.id: (r.text, r.n_names) for r in P.redact_names(m, who).collect()}
    assert got[10] == ("user-aaaa said hi, user-aaaa! Annabel and user-aaaa too (user-aaaa.x)", 4)
    assert got[11] == ("", 0) and got[12] == ("ann lee", 0) and got[13] == ("user user-aaaa-user-aaaa, user-bbbb! a.bxc", 3)


def test_size_matched(spark):
    have = spark.createDataFrame([(i, "s") for i in range(30)] + [(100 + i, "m") for i in range(3)] + [(200, "x")], "id long, b string")
    want = spark.createDataFrame([("s",)] * 5 + [("m",)] * 4 + [("l",)], "b string")
    got = [(r.id, r.b) for r in P.size_matched(have, want, "b", [F.col("id")], 10).collect()]
    assert sorted(got) == [(0, "s"), (1, "s"), (2, "s"), (3, "s"), (4, "s"), (5, "s"), (6, "s"), (100, "m"), (101, "m"), (102, "m")]
    assert P.size_matched(have, want.limit(0), "b", [F.col("id")], 10).collect() == []


def test_lexicon_hits(spark):
    m = spark.createDataFrame([(1, "Compilers compile, see https://www.linker.co.uk/x Lorzan 100"), (2, "glass glas"), (3, None), (4, "")], "id long, content string")
    lex = spark.createDataFrame([("compiler",), ("linker",), ("glas",), ("glass",)], "term string")
    got = {r.id: r.hits for r in L.message_hits(m, lex, {"machine": "lorzan [0-9]+"}).collect()}
    assert got == {1: ["compiler", "linker", "gaz:machine"], 2: ["glas", "glass"], 3: [], 4: []}
    assert {r.id: r.hits for r in L.message_hits(m, lex.limit(0), {}).collect()} == {i: [] for i in (1, 2, 3, 4)}


def test_rules_are_checked():
    rules, version = L.load_rules({"a": ("x+", 0.2)})
    assert rules == {"a": ("x+", 0.2)} and version != L.load_rules({"a": ("x+", 0.3)})[1] and len(version) == 12
    with pytest.raises(ValueError, match="no name.*weight 7.*b: "):
        L.load_rules({"no name": ("x", 0.1), "a": ("x", 7), "b": ("(", 0.1)})


def test_context_features(spark):
    em = spark.createDataFrame(
        [(1, 0, 10, 5, None, "what is it? ", 1), (1, 1, 11, 7, 10, "a router 1.2", 1), (1, 2, 12, 5, 11, "thanks", 1), (2, 0, 20, 5, 12, "later", 2)],
        "xid long, position long, id long, author_id long, reply_to_id long, content string, channel_id long",
    )
    c = L.context_tokens(em, spark.createDataFrame([(7,), (7,)], "author_id long"))
    got = {r.id: set(r.context) for r in c.collect()}
    assert got[10] == {"POS_first", "EXSIZE_3-5"}  # the next author opted out
    assert got[11] == {"POS_early", "EXSIZE_3-5", "CTX_is_reply", "CTX_prev_ends_question", *(f"{s}_{w}" for s, ws in (("PREV", ("what", "is", "it")), ("REPLYTO", ("what", "is", "it")), ("NEXT", ("thanks",))) for w in ws)}
    assert got[12] == {"POS_last", "EXSIZE_3-5", "CTX_is_reply"} and got[20] == {"POS_first", "EXSIZE_1-2", "CTX_is_reply", "REPLYTO_thanks"}
    f = {r.id: r for r in L.message_features(em, c).collect()}
    assert "CHAN_1" in f[11].plain and "MLEN_1-20" in f[11].plain and not any(x.startswith(("PREV_", "CTX_")) for x in f[11].plain)
    assert set(f[11].context) - set(f[11].structural) == {x for x in got[11] if x.startswith(("PREV_", "REPLYTO_", "NEXT_"))}
    with pytest.raises(ValueError):
        L.feature_set(F.col("x"), "other")


def test_exchange_parents(spark):
    parts = spark.createDataFrame([(10, 10, 0, False), (11, 10, 1, False), (20, 20, 0, False), (11, 20, -1, True), (30, 30, 0, False), (40, 40, 0, False), (50, 50, 0, False), (60, 60, 0, False)], "id long, part long, position long, is_context boolean")
    m = spark.createDataFrame([(10, 1, None, None), (11, 2, None, None), (20, 3, 40, None), (30, 4, 11, 9), (40, 5, None, 9), (50, 6, 50, None), (60, 7, 999, 9)], "id long, us long, reply_to_id long, thread_id long")
    assert {r.part: r.parent for r in G.parents(parts, m).collect()} == {20: 10, 30: 10, 40: 30, 60: 40}
    assert G.parents(parts.limit(0), m).collect() == []


def test_recipes_gaps_and_slices(spark):
    assert G.recipe_versions([{"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}, {"a": 1}]) == [1, 1, 2, 3]
    old, new = spark.createDataFrame([(1, 100)], "channel_id long, gap_s long"), spark.createDataFrame([(1, 7.9), (2, 8.9)], "channel_id long, gap_s double")
    assert sorted(map(tuple, G.frozen_gaps(old, new).collect())) == [(1, 100), (2, 8)]
    slices = spark.createDataFrame([("s", 0, 5), ("s", 1, 6), ("s", 2, 7), ("s", 3, 8), ("t", 0, 7)], "slice string, no long, group_id long")
    moved = spark.createDataFrame([(5, 50), (6, None), (7, 70), (8, 50)], "old_id long, new_id long")
    assert sorted(map(tuple, G.carry_slices(slices, moved, "r2").collect())) == [("s@r2", 0, 50), ("s@r2", 1, 70), ("t@r2", 0, 70)]
    members = spark.createDataFrame([(1, 1, 1, None), (1, 2, 1, None), (2, 3, 1, None), (9, 1, 0, 1)], "group_id long, id long, version int, superseded_by int")
    out = G.apply_recipe(members, spark.createDataFrame([(7, 1), (8, 2)], "group_id long, id long"), spark.createDataFrame([(2,)], "id long"), 2)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in out.collect()) == [(1, 1, 1, 2), (1, 2, 1, 2), (2, 3, 1, -1), (7, 1, 2, -1), (8, 2, 2, -1), (9, 1, 0, 1)]


def test_decision_metrics(spark):
    frame = lambda rows: spark.createDataFrame(rows, "score double, label boolean")
    s = C.summarize(frame([(0.9, True), (0.8, True), (0.7, False), (0.4, True), (0.1, False)])).first()
    assert (s.best_threshold, s.floor_threshold, s.negative_recall) == (0.4, 0.4, 0.5) and abs(s.f1 - 6 / 7) < 1e-9
    one = C.summarize(frame([(0.9, True)])).first()
    assert (one.n_pos, one.n_neg, one.best_threshold, one.f1) == (1, 0, None, 0.0) and C.summarize(frame([])).first().n_pos == 0
    assert C.irrelevant_threshold(frame([(float(i), True) for i in range(20)]), 0.95).first().threshold == 1.0
    assert C.irrelevant_threshold(frame([(1.0, False)]), 0.95).collect() == []
    assert [tuple(r) for r in C.discard_pile(frame([(0.6, True), (0.8, False)]), (0.5, 0.7)).collect()] == [(0.5, 1.0, 1.0), (0.7, 0.0, 1.0)]
    items = spark.createDataFrame([(0.1, False, True), (0.5, False, False), (0.9, True, True)], "overlap double, has_missing boolean, bad boolean")
    assert (r := C.tune_check(items, [0.0, 0.2, 0.6]).first()).threshold == 0.2 and r.caught == 2 and r.f1 == 1.0


def test_attribution(spark):
    rows = ["According to nobody", "accordingly to plan", "X, which a member confirmed", "a user of the old box with a very long tail that goes on said so", "Someone plans to", "members said", "The author", None]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in rows], "t string").select(T.attributed(F.col("t")), T.person_subject(F.col("t"))).collect()]
    assert got == [(True, False), (False, False), (True, False), (False, True), (True, True), (False, False), (False, True), (None, None)]


def test_parents_and_kinds(spark):
    n = spark.createDataFrame([("irix 6.5", 5), ("irix 6", 9), ("irix", 50), ("IRIX", 60), ("o2 case", 3), ("o2", 2), ("r10000", 4), ("R", 7), ("alone", 1), ("big", 1)], "name string, size long")
    p = K.parents(n, "name", "size")
    assert {r.name: r.parent for r in p.collect()} == {"irix 6.5": "irix 6", "irix 6": "IRIX", "r10000": "R"}
    d = n.select("name", F.when(F.col("name") == "alone", "a disk").otherwise(F.lit(None)).alias("description"))
    hand = spark.createDataFrame([("IRIX", "os")], "name string, kind string")
    got = {r.name: r.kind for r in K.assign_kinds(d, p, hand, [("part", "disk")], [("cpu", "^r[0-9]")]).collect()}
    assert got == {"irix 6.5": "os", "irix 6": "os", "irix": "other", "IRIX": "os", "o2 case": "other", "o2": "other", "r10000": "cpu", "R": "other", "alone": "part", "big": "other"}
    assert K.assign_kinds(d.limit(0), p, hand, [], []).collect() == []


def test_annotations_are_only_appended(spark):
    schema = "subject long, scorer string, version string, derived boolean, recipe string, score double, label string, at long"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    one = (1, "a", "v1", True, "{}", 0.5, None, 1)
    store = ST.append_annotations(frame(), frame(one, (1, "human", None, False, None, None, "x", 1), (1, "human", None, False, None, None, "x", 1)))
    assert store.count() == 3
    for bad in ((2, "a", "v1", True, None, 0.5, None, 1), one):
        with pytest.raises(ST.Conflict):
            ST.append_annotations(store, frame(bad))
    with pytest.raises(ST.Conflict):
        ST.append_annotations(frame(), frame(one, one))
    store = ST.append_annotations(store, frame((1, "a", "v2", True, "{}", 0.9, None, 2)))
    act = spark.createDataFrame([("a", "v2", 5, 1), ("a", "v1", 5, 2)], "scorer string, version string, at long, no long")
    assert [(r.subject, r.version, r.score) for r in ST.active_scores(store, act).collect()] == [(1, "v1", 0.5)]
    assert [r.subject for r in ST.stale_subjects(spark.createDataFrame([(1,), (2,)], "subject long"), store, "a", "v1").collect()] == [2]


def test_labels_of_runs(spark):
    runs = spark.createDataFrame([(1, 10, False), (2, 20, False), (3, 30, True), (4, 40, None), (5, 50, False)], "run long, xid long, failed boolean")
    claims = spark.createDataFrame([(1, "known"), (1, "partial"), (2, "known"), (3, "unknown"), (4, "known"), (4, None)], "run long, novelty string")
    assert {r.run: (r.label, r.reason) for r in ST.labels_of_runs(runs, claims).collect()} == {1: ("relevant", None), 2: ("irrelevant", None), 3: (None, "failed run"), 4: (None, "unprobed claims"), 5: ("irrelevant", None)}
