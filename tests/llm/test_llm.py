"""Operators for training data against plain versions, with dirty and empty input."""

import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from verify import oracle, rows_of

from threadmill.llm import leaks, packing, pii, subjects, terms, threads, vectors
from threadmill.llm.bits import FILTER_BITS, term_filter
from threadmill.llm.pii_table import labelled_rows
from threadmill.llm.queries import llm
from threadmill.llm.tokens import token_counts

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(llm.queries))
def test_query(spark, name):
    got = llm.queries[name](spark, SF)
    rows = [tuple(r.values()) for r in got.toArrow().to_pylist()]
    if name not in llm.oracles:
        assert len(rows) > 0 and (len(set(rows)) == len(rows) or not name.endswith("_found"))
        return
    c = oracle(SF).execute(llm.oracles[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, rows) == rows_of(names, c.fetchall())


# ---- conversations

MESSAGES = "id long, author_id long, author_is_bot boolean, content string, reply_to_id long, thread_id long, position int, deleted_at timestamp_ntz, ingested_at timestamp_ntz, t_id string, root long, state int"


def row(i, author, content, reply=None, thread=None, pos=None, deleted=None, bot=False, ingested=0):
    return (i, author, bot, content, reply, thread, pos, deleted, T0 + timedelta(minutes=ingested), "clash", 1, 2)


def plain_conversations(rows):
    cur = {}
    for r in rows:
        if r[0] is not None and (r[0] not in cur or r[8] > cur[r[0]][8]):
            cur[r[0]] = r
    cur = {i: r for i, r in cur.items() if r[7] is None}
    place = {}
    for i, r in cur.items():
        if r[5] is not None:
            place[i] = r[5]
            continue
        seen, at = set(), i
        while True:
            if at not in cur or at in seen or cur[at][5] is not None:
                break
            seen.add(at)
            if cur[at][4] is None:
                place[i] = at
                break
            at = cur[at][4]
    by = {}
    for i, c in place.items():
        by.setdefault(c, []).append(cur[i])
    out = []
    for c, ms in by.items():
        if len(ms) < 2 or sorted((m[6] if m[6] is not None else -9) for m in ms) != list(range(len(ms))):
            continue
        if any(m[4] is not None and (m[4] == m[0] or m[4] not in cur) for m in ms):
            continue
        if len({m[1] for m in ms if m[1] is not None and m[3] and m[3].replace("​", "").strip()}) < 2:
            continue
        opener = next(m[1] for m in ms if m[6] == 0)
        out += [(c, m[0], m[6], "bot" if m[2] else "opener" if m[1] == opener else "replier") for m in ms]
    return sorted(out)


def run_conversations(spark, rows):
    return sorted(map(tuple, threads.conversations(spark.createDataFrame(rows, MESSAGES)).collect()))


def test_conversation_cases(spark):
    rows = [
        row(1, 1, "a", pos=0), row(2, 2, "b", 1, pos=1), row(3, 1, "c", 2, pos=2, bot=True),  # kept
        row(10, 1, "a", pos=0), row(11, 1, "b", 10, pos=1),  # one author
        row(20, 1, "a", pos=0), row(21, 2, " ​\n", 20, pos=1),  # the other wrote nothing visible
        row(30, 1, "a", pos=0), row(31, 2, "b", 30, pos=2),  # a position is missing
        row(40, 1, "a", pos=0), row(41, 2, "b", 40, pos=1), row(41, 2, "b", 40, pos=1), row(42, 2, "b", 40, pos=2, deleted=T0),  # repeated row, deleted row
        row(50, 1, "a", 51, pos=0), row(51, 2, "b", 50, pos=1), row(52, 3, "c", 51, pos=2),  # cycle and what hangs on it
        row(60, 1, "a", thread=60, pos=0), row(61, 2, "b", 999, thread=60, pos=1),  # broken thread
        row(70, 1, "a", thread=70, pos=0), row(71, 2, "b", 70, thread=70, pos=1), row(72, 2, "b", 71, pos=2),  # a chain into a thread reaches none
        row(80, 1, "a", 80, pos=0), row(81, 2, "b", 80, pos=1),  # replies to itself
        row(90, 1, "old", 1, pos=0, ingested=0), row(90, 1, "new", pos=0, ingested=5), row(91, None, "x", 90, pos=1), row(92, 3, "y", 90, pos=2),  # the latest row counts; null author
        row(None, 1, "a", pos=0), row(100, 1, None, pos=None),
    ]
    got = run_conversations(spark, rows)
    assert got == plain_conversations(rows)
    assert {g[0] for g in got} == {1, 40, 70, 90}
    assert run_conversations(spark, []) == []


def test_conversations_random(spark):
    rng = random.Random(8)
    rows = []
    at = 1
    for _ in range(60):  # chains of up to 40, some broken, one deep
        n = rng.choice([2, 3, 5, 40])
        ids = list(range(at, at + n))
        at += n + 1
        for k, i in enumerate(ids):
            parent = None if k == 0 else rng.choice([ids[k - 1], ids[k - 1], ids[0], ids[rng.randrange(k)]])
            if rng.random() < 0.005:
                parent = rng.choice([10**9, i, ids[-1]])
            rows.append(row(i, rng.randrange(3), rng.choice(["x", "x", "x", None, ""]), parent, pos=k if rng.random() > 0.005 else None, bot=rng.random() < 0.1))
    rng.shuffle(rows)
    got = run_conversations(spark, rows)
    assert got == plain_conversations(rows) and len(got) > 50


def test_paths(spark):
    rng = random.Random(4)
    rows, parent = [], {}
    for i in range(1, 220):  # trees, a long chain, a cycle, an orphan, a thread
        parent[i] = None if i % 25 == 1 and i < 180 else i - 1 if i < 60 or i >= 180 else rng.randrange(i - 1 - (i - 2) % 25, i)
    parent |= {300: 301, 301: 300, 302: 300, 303: 999, 304: None}
    rows = [row(i, 1, "x", p) for i, p in parent.items()] + [row(400, 1, "x", thread=400), row(401, 1, "x", 400, thread=400), row(402, 1, "x", 401)]
    want = set()
    inner = {p for i, p in parent.items() if p is not None}
    for i in parent:
        chain, at = [], i
        while at in parent and at not in chain:
            chain.append(at)
            at = parent[at]
        if i not in inner and at is None:
            want |= {(i, chain[-1], n, m) for n, m in enumerate(reversed(chain))}
    got = threads.root_to_leaf_paths(spark.createDataFrame(rows, MESSAGES)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(r.step for r in got) > 30
    assert threads.root_to_leaf_paths(spark.createDataFrame([], MESSAGES)).collect() == []


# ---- terms


def test_terms(spark):
    rows = [(i, "Big ", 1, 0) for i in range(30)] + [(1, "big", 2, 1), (1, "big", 2, 1), (2, " rare", None, 3), (3, None, 1, 1), (4, " \t", 1, 1), (5, "zero", 0, None), (6, "mid", 1, 0), (7, "MID", 1, 0), (8, "mid", 1, 0), (None, "mid", 5, 0)]
    df = spark.createDataFrame(rows, "exchange_id long, term string, tech int, off int")
    got = {r.term: (r.tech, r.off, r.n_exchanges, r.band) for r in terms.term_totals(df, 3, 0.2).collect()}
    assert got == {"big": (32, 1, 30, "common"), "rare": (0, 3, 1, "rare"), "mid": (8, 0, 3, None)}
    assert terms.marked_terms(df.limit(0)).collect() == []


# ---- vectors


def plain_nearest(vs, k):
    ids = sorted(vs)
    m = np.array([vs[i] for i in ids], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-round(s[a, b], 9), ids[b]))
        out[i] = [ids[b] for b in order[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    vs = {i: rng.normal(size=16).round(2) for i in range(300)}
    for i in range(100):  # a third are copies of one vector
        vs[1000 + i] = vs[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vs.items()], "id long, v array<float>")
    got: dict = {}
    for r in vectors.nearest(df, 3, 20, 64, 7).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.other_id)
    assert got == plain_nearest(vs, 3)


def test_stripes_and_slots(spark):
    assert [vectors.stripes(n, 6, 6144, 32_768) for n in (0, 10, 50_000, 10**6, 10**7)] == [1, 1, 7, 31, 306]
    keys = vectors.even_keys(spark, 300)
    at = {r.p for r in spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(300)).alias("p")).collect()}
    assert at == set(range(300))


def test_unusable_vectors(spark):
    rows = [(1, "r2", [1.0, 0.0]), (1, "r2", [1.0, 0.0]), (2, "r2", [0.9, 0.1]), (3, "r1", [1.0, 0.0]), (4, "r2", None), (5, "r2", [0.0, 0.0]), (6, "r2", []), (7, "r2", [float("nan"), 1.0]), (8, "r2", [None, 1.0]), (9, "r2", [1.0, 2.0, 3.0]), (None, "r2", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "e long, revision string, vec array<float>")
    c = vectors.comparable(df, "e", "vec", "r2")
    assert sorted(r.id for r in c.collect()) == [1, 2, 9]
    assert [tuple(r) for r in vectors.similar_pairs(c).collect()] == [(1, 2)]
    assert vectors.similar_pairs(c.limit(0)).collect() == []


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(1)
    u = vectors.unit_rows(rng.normal(size=(200, 32)))
    q, s, e = vectors.quantised(u)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    bound = e[:, None] + e[None, :] * (1 + e[:, None])
    assert (np.abs(approx - u @ u.T) <= bound + 1e-12).all()


# ---- personal information

MARKED = re.compile(r"\[\[(email|phone|id_number|address|name):(.*?)\]\](?!\])")


def marked_lines(name):
    """Texts of a hand-written file with the spans that are marked in it."""
    out = []
    for line in (Path(__file__).parent / name).read_text().splitlines():
        text, spans, at = "", [], 0
        for m in MARKED.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.trained(), pii.Names(["Milo Deligan", "corostam7334", "Selul-hol8875"]))


@pytest.mark.parametrize("file, least, exact", [("pii_held_out.txt", 0.9, 0.9), ("pii_fresh.txt", 0.85, 0.6)])
def test_pii_of_hand_written_lines(tagger, file, least, exact):
    """Lines that share no sentence with the training rows: recall and precision of each kind.

    The first file was looked at while the tagger was made; the second was
    written afterwards, but in view when the last training mix was chosen, and
    is full of places and firms of two capital words.
    """
    want, hit, found = Counter(), Counter(), Counter()
    rows = marked_lines(file)
    for (_, spans), got in zip(rows, tagger.finds([t for t, _ in rows])):
        a, b = {k for *_, k in spans}, {k for *_, k in got}
        want.update(a)
        hit.update(a & b)
        found.update(b)
    for k in pii.KINDS:
        assert hit[k] >= least * want[k] and hit[k] >= (exact if k == "name" else 0.9) * found[k], (k, want[k], hit[k], found[k])


def test_pii_nothing_is_left_of_a_number(tagger):
    """Redaction of the lines leaves no digit group of what is marked, where the kind was found at all."""
    rows = marked_lines("pii_held_out.txt")
    left = total = 0
    for (text, spans), got in zip(rows, tagger.finds([t for t, _ in rows])):
        for a, b, k in spans:
            if k in ("email", "phone", "id_number") and any(x == k for *_, x in got):
                total += 1
                left += not any(x <= a and b <= y for x, y, _ in got)
    assert total > 50 and left <= 1


def test_pii_held_out_rows(tagger):
    hit = miss = false = 0
    rows = labelled_rows(300, 77)
    for (text, spans, known), got in zip(rows, tagger.finds([r[0] for r in rows])):
        want = {k for a, b, k in spans if (a, b) not in known}
        found = {k for _, _, k in got}
        hit, miss = hit + len(want & found), miss + len(want - found)
        false += len(found - {k for _, _, k in spans})
    assert hit / (hit + miss) > 0.9 and false / (hit + false) < 0.1


def test_pii_texts(tagger, spark):
    kinds = lambda t: {k for _, _, k in tagger.finds([t])[0]}
    assert kinds("please mail anna.lund@vikmail.example today") == {"email"}
    assert kinds("thx COROSTAM7334! works") == {"name"} and kinds("@Milo Deligan any news?") == {"name"}
    assert kinds("root@osyor:~# reboot") == set() and kinds("Good morning everyone.") == set()
    long = "The lens from Fenwick works better once the track is sealed. " * 400 + "write to anna.lund@vikmail.example"
    (f,) = tagger.finds([long])[0]
    assert f[2] == "email" and long[f[0] : f[1]] == "anna.lund@vikmail.example"
    assert tagger.finds([None, "", "\u200b", "🙂"]) == [[], [], [], []]
    df = spark.createDataFrame([(1, "ring 415-555-0132 after six", 5), (2, None, 6), (3, "", 7)], "id long, content string, kinds int")
    out = {r.message_id: (r.kinds, r.redacted) for r in pii.find(df, spark.createDataFrame([], "name string")).collect()}
    assert out == {1: (["phone"], "ring [PHONE] after six"), 2: ([], None), 3: ([], "")}


def test_pii_author_names_by_join(spark):
    """Long and short author names, words known only from authors that no text mentions; the same as with all names in memory."""
    texts = ["thx a.b_c-d99!", "ask tova about it", "ask tova grendal about it", "i met tova grendal and bex selund", "Tova", "x-y.z_1-2_3-4 wrote", "ask Grendal Selund", "", None, "thx ANA works", "did max say so?", "maximal banana.", "well - fine"]
    df = spark.createDataFrame([*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts))], "id long, content string")
    names = ["a.b_c-d99", "x-y.z_1-2_3-4", "Tova Holm", "Bex Arvik", "Nils Selund", "x9", "Ana", "Max", "-", None]
    known = spark.createDataFrame([(n,) for n in names], "name string")
    rows = pii.find(df, known).collect()
    got = {r.message_id: (r.kinds, r.redacted) for r in rows}
    assert len(rows) == 2 * len(texts) and all(got[i] == got[100 + i] for i in range(len(texts)))
    small = pii.Tagger(pii.trained(), pii.Names([n for n in names if n]))
    assert [got[i][0] for i in range(len(texts))] == [sorted({k for *_, k in f}) for f in small.finds(texts)]
    assert got[0][1] == "thx [NAME]!" and got[5][1] == "[NAME] wrote" and got[9][0] == got[10][0] == ["name"]
    assert "ANA" not in got[9][1] and "max" not in got[10][1] and got[11] == ([], "maximal banana.") and got[12] == ([], "well - fine")
    keys = {(k.kind, k.key) for r in pii.mentioned(df, known, "content").collect() for k in r["keys"]}
    want = {("name", " ".join(pii.low_tokens(n))) for n in ("a.b_c-d99", "x-y.z_1-2_3-4", "Ana", "Max")}
    assert keys == want | {("given", "tova"), ("given", "bex"), ("family", "selund")}


# ---- containers


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        h = {rng.randrange(1, 30): rng.randrange(1, 9) for _ in range(7)}
        ls = sorted(h)

        def best(i, m):
            if i == len(ls):
                return 0
            if m == 0:
                return float("inf")
            return min(sum((ls[j] - x) * h[x] for x in ls[i : j + 1]) + best(j + 1, m - 1) for j in range(i, len(ls)))

        b = packing.boundaries(h, 3)
        assert sum((min(y for y in b if y >= x) - x) * h[x] for x in ls) == best(0, 3)
    assert packing.boundaries({}, 3) == []


def test_batches_stay_inside_their_bucket(spark):
    rng = random.Random(3)
    items = [(i, rng.randrange(1, 300)) for i in range(800)]
    out = packing.pack(spark.createDataFrame(items, "id long, n_tokens long"), 256, 12, 100, mixed=False).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.container_id, []).append(r)
    for rows in by.values():
        b = rows[0].bucket
        assert {r.bucket for r in rows} == {b} and len(rows) * b <= 256
        assert sorted(r.start for r in rows) == [b * n for n in range(len(rows))]
    n = Counter(r.bucket for r in out)
    assert len(by) == sum(-(-c // (256 // b)) for b, c in n.items()) and sum(r.n_tokens for r in out) == sum(n for _, n in items)


def test_every_document_is_packed_once(spark):
    """p8_containers and p8_assignment say the same, and every token is in one container."""
    if not Path(SF).exists():
        pytest.skip("no test tables")
    a, c = llm.queries["p8_assignment"](spark, SF).toPandas(), llm.queries["p8_containers"](spark, SF).toPandas().set_index("container_id")
    counts = token_counts(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert a.groupby("doc_id").n_tokens.sum().sort_index().tolist() == counts.groupby("id").n_tokens.sum().sort_index().tolist()
    used = a.dropna(subset=["container_id"]).groupby("container_id").n_tokens.agg(["size", "sum"])
    assert used["size"].to_dict() == c.n_pieces.to_dict() and used["sum"].to_dict() == c.n_tokens.to_dict() and used["sum"].max() <= 2048
    assert (c.room == 2048 - c.n_tokens).all() and set(a[a.piece > 0].doc_id) == set(counts[counts.n_tokens > 2048].id)


def test_pack(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, None, rng.randrange(1, 120), 30, 30, 30, rng.randrange(1, 700)])) for i in range(1500)] + [(5, 40), (7, 256)]
    out = packing.pack(spark.createDataFrame(items, "id long, n_tokens long"), 256, 20, 100).collect()
    assert sum(r.n_tokens for r in out) == sum(n or 0 for _, n in items)
    inside: dict = {}
    for r in out:
        if r.n_tokens:
            inside.setdefault(r.container_id, []).append((r.start, r.start + r.n_tokens))
        else:
            assert r.container_id is None
    for spans in inside.values():
        spans.sort()
        assert spans[-1][1] <= 256 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sum(r.n_tokens for r in out) / (256 * len(inside)) > 0.9
    split = {r.id for r in out if r.piece > 0}
    assert split == {i for i, n in items if n and n > 256}
    assert packing.pack(spark.createDataFrame([], "id long, n_tokens long")).collect() == []


def test_pack_documents(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "a b " * 5000, "x")], "doc_id long, text string, n_tokens string")
    out = packing.pack_documents(df).collect()
    assert sorted({r.doc_id for r in out}) == [1, 2, 3, 4] and sum(r.n_tokens for r in out if r.doc_id == 4) > 4096


# ---- leaks


def plain_leak(a, b):
    for off in range(-len(b), len(a)):
        eq = [0 <= off + k < len(a) and a[off + k] == b[k] for k in range(len(b))]
        for i in range(len(b)):
            for j in range(i + 14, len(b) + 1):
                wrong = (j - i) - sum(eq[i:j])
                if not wrong or j - i >= 24 and wrong * 8 <= j - i:
                    return True
    return False


def test_leaks_random(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    passages = {i: [rng.choice(vocab) for _ in range(rng.randrange(10, 60))] for i in range(12)}
    docs = {}
    for d in range(120):
        p = list(passages[rng.randrange(12)])
        a = rng.randrange(0, max(1, len(p) - 10))
        part = p[a : a + rng.choice([10, 13, 14, 24, 30, 60])]
        for k in range(len(part)):
            if rng.random() < rng.choice([0, 0.1, 0.15]):
                part[k] = "zzz"
        docs[d] = [rng.choice(vocab) for _ in range(20)] + part + [rng.choice(vocab) for _ in range(20)]
    items = spark.createDataFrame([(i, "Read this.\n" + " ".join(p)) for i, p in passages.items()], "item_id long, text string")
    texts = spark.createDataFrame([(d, " ".join(w), 1) for d, w in docs.items()], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(texts, items).collect()}
    assert got == {(d, i) for d, w in docs.items() for i, p in passages.items() if plain_leak(w, p)}
    assert got


def test_leak_disguises(spark):
    p = [f"word{i}" for i in range(16)]
    plain = " ".join(p)
    item = spark.createDataFrame([(1, "Answer from the notes below only. " + plain + "."), (2, None), (3, "")], "item_id long, text string")
    texts = [
        plain.upper(), "“" + plain + "”", ", ".join(p), " — ".join(p), "\n> ".join(p), "<b>" + "</b> <b>".join(p) + "</b>", "wo​rd0 " + plain[6:], "\n".join(f"[09:0{i % 10}] bob3: {w}" for i, w in enumerate(p)), "**" + plain + "**",
        " ".join(p[:13]), "Answer from the notes below only.", " ".join(reversed(p)), None, "", "x " * 30000 + plain,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in leaks.leaks(docs, item).collect()) == [*range(9), 14]
    assert leaks.leaks(docs.limit(0), item).collect() == [] and leaks.leaks(docs, item.limit(0)).collect() == []
    cleaned = {r.doc_id: (r.action, r.text) for r in leaks.remove_leaks(docs, item).collect()}
    assert cleaned[0] == ("dropped", None) and cleaned[9] == ("kept", texts[9]) and cleaned[12] == ("kept", None)
    assert cleaned[14][0] == "cut" and "word3" not in cleaned[14][1] and len(cleaned[14][1]) >= 60000


def test_leaks_behind_long_markup_and_instructions(spark):
    p = [f"word{i}" for i in range(30)]
    items = spark.createDataFrame([(3, "Question 3. Read the text below and answer.\n" + " ".join(p))], "item_id long, text string")
    texts = [f'<a href="https://x.example/{"q" * 900}">'.join(["", *(w + " " for w in p)]), "".join(f"[{w}](https://x.example/{'q' * 900}) " for w in p), " ".join(p[:13]) + " read the text below and answer", "question 3 read the text below and answer " + " ".join(p[:7])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in leaks.leaks(docs, items).collect()) == [0, 1]


def test_blocks_of_items_make_no_difference(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(40)] for _ in range(9)]
    docs = spark.createDataFrame([(d, " ".join([*rng.choices(vocab, k=9), *passages[d % 9][: rng.choice([10, 20, 40])], "und", *passages[(d + 1) % 9][5:25]])) for d in range(40)] + [(40, None), (41, ""), (None, " ".join(passages[0]))], "doc_id long, text string")
    items = spark.createDataFrame([(i, "Read this.\n" + " ".join(w)) for i, w in enumerate(passages)], "item_id long, text string")
    both = []
    for n in (2_000_000, 90):
        monkeypatch.setattr(leaks, "BLOCK_WORDS", n)
        both.append((sorted(map(str, leaks.leaks(docs, items).collect())), sorted(map(str, leaks.remove_leaks(docs, items).collect()))))
    assert both[0] == both[1] and len(both[0][0]) > 40 and len(both[0][1]) == 43


def test_every_stretch_of_an_item_is_cut(spark):
    p = [f"word{i}" for i in range(40)]
    own = lambda n, x: [f"{x}{i}" for i in range(n)]
    item = spark.createDataFrame([(1, "Read this.\n" + " ".join(p))], "item_id long, text string")
    texts = [
        own(60, "a") + p[:20] + own(5, "b") + p[:16] + own(60, "c"),  # one item twice
        own(60, "a") + p[:14] + own(12, "b") + p[26:] + own(60, "c"),  # two runs of one alignment
        p[:20] + own(20, "a") + p[:20],  # each copy holds a third of the words, both hold more than half
    ]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.action, r.text, r.n_items) for r in leaks.remove_leaks(docs, item).collect()}
    for d, w in enumerate(texts[:2]):
        assert got[d] == ("cut", got[d][1], 1) and "word" not in got[d][1]
        assert [x for x in w if x[0] != "w" and x not in got[d][1].split()] == []
    assert got[2] == ("dropped", None, 1)
    assert sorted(r.doc_id for r in leaks.leaks(docs, item).collect()) == [0, 1, 2]  # the report keeps one row per item


def test_stretches_random():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randrange(10, 90)
        equal, at = np.zeros(n, bool), 0
        while at < n:
            k = rng.randrange(1, 30)
            equal[at : at + k], at = True, at + k + rng.randrange(1, 8)
        inside = np.zeros(n, bool)
        for f, t in leaks.stretches(equal):
            inside[f:t] = True
        want = np.zeros(n, bool)
        for i in range(n):
            for j in range(i + 14, n + 1):
                wrong = (j - i) - equal[i:j].sum()
                if not wrong or j - i >= 24 and wrong * 8 <= j - i:
                    want[i:j] = True
        assert (inside & equal == want & equal).all() and not (inside & ~want).any()


# ---- subjects


def test_latent_model_learns_accuracies():
    rng = random.Random(3)
    n, k = 6000, 4
    truth = [rng.choice([0, 1, 2, 3, 4]) for _ in range(n)]
    acc, vote = [0.95, 0.8, 0.6, 0.5, 0.4], []
    for y in truth:
        vote.append(tuple(-1 if rng.random() < (0.3 if y < k else 0.95 if j < 2 else 0.5) else y if y < k and rng.random() < acc[j] else rng.randrange(k) for j in range(5)))
    patterns = sorted({subjects.pattern_of(v) for v in vote})
    counts = Counter(map(subjects.pattern_of, vote))
    topic, off = subjects.latent_model(np.array(patterns), np.array([counts[p] for p in patterns], float), k)
    at, right = {p: i for i, p in enumerate(patterns)}, 0
    for v, y in zip(vote, truth):
        i = at[subjects.pattern_of(v)]
        g = int(topic[i, :5].argmax())
        best = v[subjects.pattern_of(v).index(g)] if topic[i, g] > max(off[i], topic[i, 5]) else k
        right += best == y
    assert right / n > 0.8 and np.allclose(topic.sum(axis=1) + off, 1)


def test_patterns_are_bounded():
    every = {subjects.pattern_of([rng % 7**j // 7 ** (j - 1) - 1 for j in range(1, 6)]) for rng in range(7**5)}
    assert len(every) == 203 and subjects.pattern_of((4, -1, 9, 4, 9)) == (0, -1, 1, 0, 1)


PARTS = {"software": ["The compiler broke.", "A linker error again.", "The debugger and the kernel disagree."], "law": ["The court gave its verdict.", "A tribunal heard the plaintiff.", "The contract has a liability."]}
ABOUT = "subject string, about string"
LABELS = "doc_id long, subject string, labeled_by string"


def labelled_documents(spark):
    rng = random.Random(9)
    docs, want = [], set()
    for d in range(300):
        s = rng.choice(["software", "law"])
        docs.append((d, " ".join(rng.choice(PARTS[s]) for _ in range(5)) + " Good morning everyone.", "src", None))
        want.add((d, s))
    small = " Good morning everyone." * 9
    docs += [(900, small, None, None), (901, None, None, None), (902, "", "src", None), (903, PARTS["law"][0] + small, "src", None), (904, "Good day. " * 20000, None, None)]
    labels = [(d, s, "human") for d, s in sorted(want) if d < 40] + [(40, "law", "human"), (40, "software", "rule"), (None, "law", "rule"), (1, "other", "rule"), (5000, "law", "rule")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, subject string"), labels, want


def test_subjects(spark):
    df, labels, want = labelled_documents(spark)
    about = spark.createDataFrame([("software", "programs, debugging"), ("law", "courts"), (None, None)], ABOUT)
    found = spark.createDataFrame(labels, LABELS)
    got = {(r.doc_id, r.subject) for r in subjects.assign(df, about, found).collect()}
    assert len(got ^ want) <= 3 and not any(d >= 900 for d, _ in got)
    assert subjects.assign(df.limit(0), about, found.limit(0)).collect() == []
    assert subjects.assign(df, about.limit(0), found).collect() == []
    # Other names give the same documents.
    other = {"software": "law", "law": "zzz"}
    renamed = subjects.assign(df, about.replace({"law": "zzz", "software": "law"}, subset=["subject"]), spark.createDataFrame([(d, other.get(s, s), b) for d, s, b in labels], LABELS))
    assert {(r.doc_id, r.subject) for r in renamed.collect()} == {(d, other[s]) for d, s in got}


def test_what_subjects_are_about_is_enough_to_begin(spark):
    df, _, want = labelled_documents(spark)
    about = spark.createDataFrame([("a", "compilers, kernels and linkers"), ("b", "courts, contracts, tribunals")], ABOUT)
    got = {(r.doc_id, {"a": "software", "b": "law"}[r.subject]) for r in subjects.assign(df, about, spark.createDataFrame([], LABELS)).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_learned_lexicon_has_no_bound(spark):
    """More than 60,000 terms that are more frequent than a rare subject's own: that subject's documents are still found."""
    word = lambda n: "q" + "".join(chr(97 + n // 26**k % 26) for k in range(4))
    common = [". ".join(("Recipe " if i % 2 else "Then ") + " ".join(word(60 * i + j) for j in range(60)) for i in range(a, a + 50)) for a in range(0, 550, 50)]
    docs = [(i, x + ".", None, None) for i, x in enumerate(common * 30)]
    docs += [(1000 + i, "The goalkeeper zorvik quastel. A referee zorvik quastel. The marathon zorvik quastel.", None, None) for i in range(8)]
    docs += [(2000, "Now zorvik quastel. Then zorvik quastel. So zorvik quastel.", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, subject string").repartition(8)
    about = spark.createDataFrame([("food", "recipe"), ("sport", "goalkeeper, referee, marathon")], ABOUT)
    got = {(r.doc_id, r.subject) for r in subjects.assign(df, about, spark.createDataFrame([], LABELS)).collect()}
    assert {(d, "sport") for d in [*range(1000, 1008), 2000]} <= got


def test_lexicon_filter_lets_all_terms_pass(spark):
    found = ["", "a", "épée", "lötstelle", "two words", *(f"t{i}" for i in range(3000))]
    bits = term_filter(spark.createDataFrame([(t,) for t in found], "term string").repartition(3))
    place = [zlib.crc32(t.encode()) % FILTER_BITS for t in found]
    assert all(bits[h >> 3] >> (h & 7) & 1 for h in place) and np.unpackbits(bits).sum() == len(set(place))
