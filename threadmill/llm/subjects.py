"""Subject areas of documents from weak labelling functions.

Five labelling functions vote on every sentence or abstain: a lexicon made from
what the subjects are said to be about and from the labelled documents, a
lexicon learned from the whole corpus, the section that the sentence stands in,
the document's address (its source), and labels given to the document by people
or rules.  A latent model learns from the counts of vote patterns how accurate
each function is and how often it abstains, with and without a subject; its
posterior says what each pattern means.  A document has a subject if at least a
fifth of its sentences are about it.  Names of subjects mean nothing to any
function: subjects with other names get the same documents.

Texts are read whole, three times: for term counts, for the learned terms that
each holds, and for votes.  The learned lexicon has no bound: it stays a table
that the texts' terms are joined with.  What reaches the driver is bounded: the
terms of the label sample, a bitmap of fixed size, and the vote patterns.  A
pattern says which functions abstain and which agree, not on what, so there are
at most 203 of them whatever the number of subjects.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle, spread
from .bits import FILTER_BITS, term_filter

#: Label rows used (the bound of what the driver holds).
MAX_LABELS = 20_000
#: Subjects at most (a column of counts each; votes are coded in one long); more are an error, none is left out.
MAX_SUBJECTS = 200
#: Least smoothed share of a term's top subject among the labelled documents.
TAUGHT = 0.65
#: Least smoothed share of its top subject that makes a term part of the learned lexicon.
PURITY = 0.75
SHARE = 0.2

_PREFIX = re.compile(r"(?m)^[ \t]*\[\d\d?:\d\d(?::\d\d)?\] [^\s:]{1,60}: ")
_HEADING = re.compile(r"(?m)^[ \t]*#{1,6} .*$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”'’)]*\s+(?=[^\sa-zà-ÿ])|\n+")
_SECTION = re.compile(r"\n[ \t]*\n")
_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
#: Function words (fixed values) that no pair of words is made of.
_LINK = frozenset("a an and as at but by each every for from had if in is it its my no not of on one or our so than that the this to until was were with your aus das der die dort ist mal mit nach nicht noch und war wir wurde au avec ce de des du est et il la le les ne pour que un une al con del el en es las los para por se un una y".split())


def sentences(text: str) -> list[list[str]]:
    """Sentences of each section of a text, without headings and speaker marks."""
    text = _HEADING.sub("\n\n", _PREFIX.sub("", text))
    found = []
    for block in _SECTION.split(text):
        s = [x for x in _SENTENCE.split(block) if x and _WORD.search(x)]
        if s:
            found.append(s)
    return found


def terms(sentence: str) -> set[str]:
    """Lower-case words of a sentence and pairs of neighbouring words that aren't function words."""
    w = _WORD.findall(sentence.lower().replace("’", "'").replace("\u200b", ""))
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]) if a not in _LINK and b not in _LINK)}


def about_lexicon(abouts: Sequence[str]) -> dict[str, tuple[int, float]]:
    """Words (with and without an s at the end) of what each subject is about -> (subject, weight); words of several are left out."""
    owner: dict[str, set[int]] = defaultdict(set)
    for i, about in enumerate(abouts):
        for w in _WORD.findall(about.lower()):
            if len(w) > 3 and w not in _LINK:
                for form in (w, w.rstrip("s"), w.rstrip("s") + "s"):
                    owner[form].add(i)
    return {w: (next(iter(s)), 1.0) for w, s in owner.items() if len(s) == 1}


def weighted_vote(hits: set[str], lexicon: dict[str, tuple[int, float]]) -> int | None:
    """The subject with the greatest weight of a sentence's terms; none if another comes close."""
    if not hits:
        return None
    c: dict[int, float] = defaultdict(float)
    for t in sorted(hits):
        s, w = lexicon[t]
        c[s] += w
    ranked = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    return None if len(ranked) > 1 and ranked[1][1] > 0.9 * ranked[0][1] else ranked[0][0]


def majority(votes: Sequence[int | None], least: float = 0.6, at_least: int = 2) -> int | None:
    c = Counter(v for v in votes if v is not None)
    if not c:
        return None
    s, n = c.most_common(1)[0]
    return s if n >= at_least and n >= least * sum(c.values()) else None


def pattern_of(votes: Sequence[int]) -> tuple[int, ...]:
    """Which functions abstain (-1) and which agree (same number, in order of appearance)."""
    seen: dict[int, int] = {}
    return tuple(-1 if v < 0 else seen.setdefault(v, len(seen)) for v in votes)


def latent_model(patterns: np.ndarray, counts: np.ndarray, k: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern the posterior of each of its groups of agreeing functions (pattern, group), and that of no subject.

    Each function has an accuracy and a rate of voting, for sentences with a
    subject and without; all are learned by expectation-maximisation.  The k
    subjects are alike beforehand and errors fall on any, so what functions
    vote for matters only as far as they agree; the last column of the first
    result is all subjects that nobody voted for.
    """
    n, m = patterns.shape
    votes = patterns >= 0
    groups = m + 1
    acc = np.array([0.9, 0.9, 0.75, 0.5, 0.7])[:m]
    rate = np.stack([np.where(votes, counts[:, None], 0).sum(0) / counts.sum()] * 2)  # with a subject, without
    rate[0] = np.clip(rate[0] * 1.3, 0.02, 0.98)
    rate[1, :2] *= 0.2  # lexicons rarely speak where there's no subject
    rate = np.clip(rate, 1e-4, 1 - 1e-4)
    none = 0.3
    n_groups = patterns.max(axis=1) + 1
    size = np.zeros((n, groups))  # how many subjects a column stands for
    size[:, :m] = np.arange(m)[None, :] < n_groups[:, None]
    size[:, m] = np.maximum(k - n_groups, 0)
    topic = off = None
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            log = np.log(size * (1 - none) / k)
        away = np.full(n, math.log(none))
        for j in range(m):
            v = votes[:, j]
            hit = np.zeros((n, groups), bool)
            hit[v, patterns[v, j]] = True
            log += np.where(v[:, None], np.log(rate[0, j]) + np.where(hit, np.log(acc[j]), np.log((1 - acc[j]) / (k - 1))), np.log(1 - rate[0, j]))
            away += np.where(v, np.log(rate[1, j] / k), np.log(1 - rate[1, j]))
        top = np.maximum(log.max(axis=1), away)
        topic, off = np.exp(log - top[:, None]), np.exp(away - top)
        total = topic.sum(axis=1) + off
        topic, off = topic / total[:, None], off / total
        w, w_off = topic * counts[:, None], off * counts
        none = float(np.clip(w_off.sum() / counts.sum(), 1e-4, 0.9999))
        topical = w.sum()
        for j in range(m):
            v = votes[:, j]
            right = w[v, patterns[v, j]].sum()
            spoke = w[v].sum()
            acc[j] = np.clip((right + 2) / (spoke + 3), 0.2, 0.995)
            rate[0, j] = np.clip(spoke / max(topical, 1), 1e-4, 1 - 1e-4)
            rate[1, j] = np.clip(w_off[v].sum() / max(w_off.sum(), 1), 1e-4, 0.999)
    return topic, off


def _label_votes(labels: DataFrame, names: list[str]) -> DataFrame:
    """The label of every document that has just one: doc_id, label."""
    place = F.array_position(F.array(*(F.lit(n) for n in names)), F.lower(F.trim("subject"))).cast("int") - 1
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("l_id"), place.alias("s")).where("s >= 0")
    return known.groupBy("l_id").agg(F.min("s").alias("label"), F.max("s").alias("other")).where("label = other").select("l_id", "label")


def _labelled_terms(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[int, float]]:
    """Terms of documents with one label that hardly occur under others -> (subject, weight) (a bounded sample of labels)."""
    sample = labels.orderBy(F.xxhash64("l_id")).limit(MAX_LABELS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c: dict[tuple[str, int], int] = defaultdict(int)
            for t, s in zip(f["text"], f["label"]):
                for x in set().union(*(terms(y) for b in sentences(t) for y in b)):
                    c[x, s] += 1
            if c:
                yield pd.DataFrame([(x, s, n) for (x, s), n in c.items()], columns=["term", "s", "n"])

    counts = docs.join(sample, docs.doc_id == sample.l_id).select("text", "label").where("text IS NOT NULL").mapInPandas(run, "term string, s int, n long")
    by = counts.groupBy("term", "s").agg(F.sum("n").alias("n")).groupBy("term").agg(F.max(F.struct("n", "s")).alias("top"), F.sum("n").alias("all"))
    good = by.where((F.col("top.n") >= 2) & ((F.col("top.n") + 0.3) / (F.col("all") + 1.5) >= TAUGHT))
    return {r["term"]: (r["s"], math.log(1 + r["n"])) for r in good.select("term", "top.s", "top.n").collect()}


def _learned(docs: DataFrame, first: dict[str, tuple[int, float]], k: int) -> tuple[DataFrame, DataFrame]:
    """The lexicon learned from all documents (term, s, share), and how often each source's sentences are about each subject."""
    held = docs.sparkSession.sparkContext.broadcast(first)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = held.value
        known = frozenset(lexicon)
        c = [Counter() for _ in range(k + 1)]
        where: Counter[tuple[str, int]] = Counter()

        def flush() -> Iterator[pd.DataFrame]:
            for y, one in enumerate(c):
                if one:
                    yield pd.DataFrame({"kind": ["term"] * len(one), "term": list(one.keys()), "y": [y] * len(one), "n": list(one.values())})
                    one.clear()
            if where:
                yield pd.DataFrame({"kind": ["source"] * len(where), "term": [a for a, _ in where], "y": [b for _, b in where], "n": list(where.values())})
                where.clear()

        for f in frames:
            for text, source in zip(f["text"], f["source"]):
                if not text:
                    continue
                found = [terms(s) for b in sentences(text) for s in b]
                hits = [x & known for x in found]
                votes = [weighted_vote(h, lexicon) for h in hits]
                main = majority(votes)
                silent = not any(hits)
                for x, h, v in zip(found, hits, votes):
                    y = v if v is not None else main if main is not None and not h else k if silent else None
                    if y is None:
                        continue
                    c[y].update(x)
                    if source is not None:
                        where[source, y] += 1
            if sum(map(len, c)) > 400_000:
                yield from flush()
        yield from flush()

    partial = spread(docs, "doc_id").select("text", "source").mapInPandas(run, "kind string, term string, y int, n long")
    total = partial.groupBy("kind", "term").agg(*(F.coalesce(F.sum(F.when(F.col("y") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(k + 1)))
    total = settle(total.where(F.greatest(*(F.col(f"n{i}") for i in range(k))) >= 4), "terms")
    every = sum((F.col(f"n{i}") for i in range(1, k + 1)), F.col("n0"))
    top = F.greatest(*(F.struct(F.col(f"n{i}").alias("n"), F.lit(i).alias("s")) for i in range(k)))
    best = total.withColumn("every", every).withColumn("top", top).select("kind", "term", "every", F.col("top.n").alias("n"), F.col("top.s").alias("s"))
    share = (F.col("n") + 0.3) / (F.col("every") + 1.5)
    lexicon = settle(best.where((F.col("kind") == "term") & (share >= PURITY)).select("term", "s", share.alias("share")), "lexicon")
    address = best.where((F.col("kind") == "source") & (F.col("every") >= 50) & (F.col("n") >= 0.5 * F.col("every"))).select(F.col("term").alias("a_source"), F.col("s").alias("address"))
    return lexicon, address


def _held_terms(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The learned terms that each text holds: h_text (hash of the text), wide (array of term, s, share).

    Texts of one hash share a row, which then holds the terms of both.
    """
    held = docs.sparkSession.sparkContext.broadcast(term_filter(lexicon).tobytes())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for f in frames:
            keys, found = [], []
            for key, text in zip(f["h_text"], f["text"]):
                for t in set().union(*(terms(s) for b in sentences(text) for s in b)):
                    h = zlib.crc32(t.encode()) % FILTER_BITS
                    if bits[h >> 3] >> (h & 7) & 1:
                        keys.append(key)
                        found.append(t)
            if keys:
                yield pd.DataFrame({"h_text": keys, "term": found})

    said = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("h_text"), "text")
    said = said.mapInPandas(run, "h_text long, term string")
    return said.join(lexicon, "term").groupBy("h_text").agg(F.collect_set(F.struct("term", "s", "share")).alias("wide"))


def subject_shares(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """How many sentences of every document are about each subject: doc_id, subject, n_about, n_sentences, share.

    Rows only for subjects with at least one sentence.  Null and empty texts
    have no sentences and give no row; null and odd languages and null sources
    are allowed (the source then abstains); labels of unknown subjects or
    documents are ignored, repeated ones count once, a document with different
    labels gets no label vote.  Without subjects, documents or labels the
    result is empty, empty, or made from the other functions.
    """
    spark = documents.sparkSession
    pairs = sorted({(r["about"] or "", r["subject"].strip().lower()) for r in subjects.select("subject", "about").where("subject IS NOT NULL").limit(MAX_SUBJECTS + 1).collect()})
    names = [p[1] for p in pairs]
    k = len(names)
    if k > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    empty = "doc_id long, subject string, n_about long, n_sentences long, share double"
    if k < 2:
        return spark.createDataFrame([], empty)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    label = settle(_label_votes(labels, names), "labels")
    taught = about_lexicon([p[0] for p in pairs])
    taught.update(_labelled_terms(docs, label))  # what documents show counts more than what is said
    learned, address = _learned(docs, taught, k)
    held = spark.sparkContext.broadcast(taught)
    base = k + 1

    def weight(term: str, share: float) -> float:
        return math.log(share * k / (1 - share + 0.02)) * (0.5 if " " in term else 1.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = held.value
        known = frozenset(lexicon)
        for f in frames:
            out = []
            for doc, text, where, lab, *learned in zip(f["doc_id"], f["text"], f["address"], f["label"], f["term"], f["s"], f["share"]):
                if not text:
                    continue
                where = -1 if where != where or where is None else int(where)
                lab = -1 if lab != lab or lab is None else int(lab)
                wide = {} if learned[0] is None else {t: (int(s), weight(t, share)) for t, s, share in zip(*learned)}
                widely = wide.keys()
                c: Counter[tuple[int, ...]] = Counter()
                n = 0
                blocks = [[(weighted_vote(t & known, lexicon), weighted_vote(t & widely, wide)) for t in map(terms, b)] for b in sentences(text)]
                for votes in blocks:
                    seconds = Counter(b for _, b in votes if b is not None)
                    for a, b in votes:
                        n += 1
                        around = seconds.copy()
                        if b is not None:
                            around[b] -= 1
                        total = sum(around.values())
                        s, m = max(around.items(), key=lambda z: (z[1], -z[0])) if total else (-1, 0)
                        section = s if m >= 2 and m >= 0.6 * total else -1
                        c[-1 if a is None else a, -1 if b is None else b, section, where, lab] += 1
                codes, kinds = [], []
                for votes in c:
                    code = kind = 0
                    for v, g in zip(votes, pattern_of(votes)):
                        code, kind = code * base + v + 1, kind * 8 + g + 1
                    codes.append(code)
                    kinds.append(kind)
                out.append((doc, n, codes, kinds, list(c.values())))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "n", "codes", "kinds", "counts"])

    docs = spread(docs, "doc_id")
    wide = _held_terms(docs, learned)
    joined = docs.withColumn("key", F.xxhash64("text")).join(wide, F.col("key") == F.col("h_text"), "left").join(label, docs.doc_id == label.l_id, "left").join(address, F.col("source") == F.col("a_source"), "left")
    votes = joined.select("doc_id", "text", "address", "label", "wide.term", "wide.s", "wide.share").mapInPandas(run, "doc_id long, n long, codes array<bigint>, kinds array<int>, counts array<int>")
    each = settle(votes, "votes").select("doc_id", "n", F.explode(F.arrays_zip("codes", "kinds", "counts")).alias("z")).select("doc_id", "n", F.col("z.codes").alias("code"), F.col("z.kinds").alias("kind"), F.col("z.counts").alias("c"))
    seen = each.groupBy("kind").agg(F.sum("c").alias("c")).orderBy("kind").collect()  # at most 203 rows
    if not seen:
        return spark.createDataFrame([], empty)
    kinds = np.array([r["kind"] for r in seen], np.int64)
    patterns = np.stack([kinds // 8**j % 8 - 1 for j in range(4, -1, -1)], axis=1)
    topic, off = latent_model(patterns, np.array([r["c"] for r in seen], float), k)
    # The function whose vote stands for the best group; none where no subject or one that nobody voted for is likelier.
    means = []
    for kind, p, t, o in zip(kinds.tolist(), patterns.tolist(), topic, off):
        g = int(t[:5].argmax())
        if t[g] > max(o, t[5]):
            means.append((kind, base ** (4 - p.index(g))))
    means = spark.createDataFrame(means or [(-1, 1)], "kind int, unit long")
    subject = F.element_at(F.array(*(F.lit(x) for x in names)), F.expr(f"(code div unit) % {base}").cast("int"))
    about = each.join(F.broadcast(means), "kind").groupBy("doc_id", subject.alias("subject")).agg(F.sum("c").alias("n_about"), F.max("n").alias("n_sentences"))
    return about.withColumn("share", F.col("n_about") / F.col("n_sentences"))


def assign(documents: DataFrame, subjects: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents with the subjects that at least ``share`` of their sentences are about: doc_id, subject."""
    return subject_shares(documents, subjects, labels).where(F.col("share") >= share).select("doc_id", "subject")
