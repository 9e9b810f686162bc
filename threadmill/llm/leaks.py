"""Evaluation passages inside a training corpus.

The passages' word 5-grams (normalised) are a hash set that every task gets;
evaluation tables are small, and larger ones are worked off in blocks of
bounded size.  Each document is read once: its words become numbers (words of
no passage share one), all its 5-gram windows are looked up at once, and every
hit names an alignment of the document with a passage, which is then verified
word by word.  A window of 24 words with one in eight replaced holds a run of
at least six equal words (21 equal words in at most four runs), and any longer
window does too, so 5-gram seeds miss nothing.  No shuffle is needed.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle, spread

GRAM = 5
EXACT, FUZZY, ONE_IN = 14, 24, 8
#: Words of passages that one pass may hold (about 16 bytes each in every task).
BLOCK_WORDS = 2_000_000

_INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)[^<>]*>|&(?:\w{1,32}|#\d{1,7});")
_BLOCK = {"br", "p", "div", "li", "ul", "ol", "td", "tr", "th", "table", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
_GAP = re.compile(r"[‐-―/]|\]\([^()\s]*\)|(?m:^[ \t>*-]*\[\d\d?:\d\d(?::\d\d)?\] [^\s:]+: )")
_PUNCT = re.compile(r"[\W_]+")
_ENDS = re.compile(r"(?<=[.!?:])\s+")


def _mark(m: re.Match) -> str:
    n = len(m.group())
    if m.group(1):
        return (" " if m.group(1).lower() in _BLOCK else "\0") * n
    c = html.unescape(m.group())
    return c + "\0" * (n - 1) if len(c) == 1 and c.isalnum() else " " * n


def masked(text: str) -> str:
    """The text with markup, speaker marks and invisible characters masked, every place kept."""
    text = _INVISIBLE.sub("\0", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(_mark, text)
    return _GAP.sub(lambda m: " " * len(m.group()), text)


_seen: dict[str, str] = {}


def norm(token: str) -> str:
    """A token without case, punctuation and what isn't letter or digit."""
    w = _seen.get(token)
    if w is None:
        w = _PUNCT.sub("", unicodedata.normalize("NFKC", token.replace("\0", "")).casefold())
        if len(_seen) > 500_000:
            _seen.clear()
        _seen[token] = w
    return w


def words(text: str) -> list[str]:
    return [w for t in masked(text).split() if (w := norm(t))]


def spans(text: str) -> list[tuple[int, int]]:
    """Where in the text each of ``words`` stands."""
    return [m.span() for m in re.finditer(r"\S+", masked(text)) if norm(m.group())]


def passage(text: str) -> list[str]:
    """Words of an evaluation item without its instruction: its first line, or its first sentence if it is one line."""
    text = text.strip()
    parts = text.split("\n", 1) if "\n" in text else _ENDS.split(text, maxsplit=1)
    return words(parts[1]) if len(parts) > 1 else words(text)


class Passages:
    """What a scan needs of a block of items; sent to every task once."""

    def __init__(self, items: list[tuple[int, str]]):
        found = [(i, w) for i, t in items if (w := passage(t))]
        vocabulary = sorted({x for _, w in found for x in w})
        self.number = {w: n + 1 for n, w in enumerate(vocabulary)}
        self.ids = [i for i, _ in found]
        self.words = [np.array([self.number[x] for x in w], np.int64) for _, w in found]
        gram, item, place = [], [], []
        for n, w in enumerate(self.words):
            g = codes(w)
            gram.append(g)
            item.append(np.full(len(g), n))
            place.append(np.arange(len(g)))
        gram, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, item, place))
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order].astype(np.uint64), item[order], place[order]


def codes(w: np.ndarray) -> np.ndarray:
    """A hash of every window of GRAM numbers."""
    n = len(w) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n].astype(np.uint64)
    return h


def _windows(equal: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of what leaked in an alignment: runs of equal words, and from each place the longest leaked stretch.

    Leaked is a run of EXACT equal words, or a stretch of FUZZY or more of
    which no more than one in ONE_IN differs.
    """
    n = len(equal)
    if n < EXACT:
        return
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= EXACT:
            yield int(a), int(b)
    if n >= FUZZY:
        # wrong*8 - length is at most 0 between two places whose running values don't rise.
        run = np.concatenate([[0], np.cumsum(ONE_IN * ~equal - 1)])
        reach = np.maximum.accumulate(-run[::-1])[::-1]  # largest -run from here on
        for a in np.flatnonzero(reach[FUZZY:] >= -run[: n - FUZZY + 1]):
            yield int(a), int(np.flatnonzero(run[a + FUZZY :] <= run[a])[-1]) + int(a) + FUZZY


def leaked(equal: np.ndarray) -> tuple[int, int]:
    """(from, to) of the longest leaked stretch of an alignment; (0, 0) if none is."""
    return max(_windows(equal), key=lambda x: x[1] - x[0], default=(0, 0))


def stretches(equal: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of every leaked stretch of an alignment, joined where they overlap.

    All but the longest count from their first to their last equal word: what
    lies outside of these isn't the passage's.
    """
    found = list(_windows(equal))
    if not found:
        return []
    inside = np.zeros(len(equal), np.int8)
    f, t = max(found, key=lambda x: x[1] - x[0])
    inside[f:t] = 1
    at = np.flatnonzero(equal)
    for a, b in found:
        inside[at[np.searchsorted(at, a)] : at[np.searchsorted(at, b) - 1] + 1] = 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def scan(text: str | None, p: Passages, every: bool = False, said: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(item_id, first word, end word) of every item that leaked into a text: its longest stretch, or ``every`` one of every alignment.  ``said``: the text's words if they are known."""
    if not text:
        return []
    number = p.number
    w = np.array([number.get(x, 0) for x in (words(text) if said is None else said)], np.int64)
    g = codes(w)
    if not len(g) or not len(p.gram):
        return []
    lo, hi = np.searchsorted(p.gram, g, "left"), np.searchsorted(p.gram, g, "right")
    at = np.flatnonzero(hi > lo)
    found: dict[int, list[tuple[int, int]]] = {}
    tried = set()
    for k in at:
        for e in range(lo[k], hi[k]):
            n, off = int(p.item[e]), int(k - p.place[e])
            if (n, off) in tried:
                continue
            tried.add((n, off))
            q = p.words[n]
            a, b = max(0, -off), min(len(q), len(w) - off)
            equal = q[a:b] == w[off + a : off + b]
            for f, t in stretches(equal) if every else [leaked(equal)]:
                if t > f:
                    found.setdefault(n, []).append((off + a + f, off + a + t))
    if not every:
        found = {n: [max(x, key=lambda z: z[1] - z[0])] for n, x in found.items()}
    return [(p.ids[n], f, t) for n, x in sorted(found.items()) for f, t in x]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Passages]:
    """The evaluation items in blocks of at most BLOCK_WORDS words (one longer item makes its own)."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).dropDuplicates().orderBy(id_col).toLocalIterator():
        n = len(r[1]) // 4
        if block and size + n > BLOCK_WORDS:
            yield Passages(block)
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield Passages(block)


def _stretches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, every: bool) -> DataFrame:
    """key, item_id, first_word, end_word of every hit in ``docs`` (key, text).

    One block of items is in memory at a time.  Where there are several, texts
    are turned into words once, and each block's hits are written before the
    next block is sent.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["key"]
    schema = f"key {kind}, item_id long, first_word long, end_word long"
    columns = ["key", "item_id", "first_word", "end_word"]

    def hits(block: Broadcast, known: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(d, *hit) for d, t in zip(f["key"], f["text"]) for hit in scan(t, block.value, every, t.split(" ") if known else None)]
                yield pd.DataFrame(rows, columns=columns)

        return run

    def said(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "text": [" ".join(words(t)) for t in f["text"]]})

    blocks = _blocks(items, id_col, text_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.mapInPandas(hits(spark.sparkContext.broadcast(first), False), schema)
    plain, found = settle(docs.mapInPandas(said, f"key {kind}, text string"), "words"), None
    for block in itertools.chain([first, second], blocks):
        held = spark.sparkContext.broadcast(block)
        one = settle(plain.mapInPandas(hits(held, True), schema), "leaks")
        held.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which item leaked into which document: doc_id, item_id, first_word, end_word.

    A document holds an item if it holds 14 consecutive words of its passage,
    or 24 or more of which no more than one in eight is replaced.  Case,
    punctuation, markup, quote marks, line breaks and invisible characters make
    no difference; the item's instruction doesn't count.  One row per document
    row and item.  Null and empty texts and items hold nothing; a null doc_id
    stays null; empty tables give no row; texts are read whole.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return _stretches(spread(docs, "key"), items, item_id, item_text, False).withColumnRenamed("key", "doc_id")


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words."""
    at, out, end = spans(text), [], 0
    merged: list[list[int]] = []
    for f, t in sorted(ranges):
        if merged and f <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], t)
        else:
            merged.append([f, t])
    for f, t in merged:
        out.append(text[end : at[f][0]])
        end = at[t - 1][1]
    return "".join([*out, text[end:]])


def remove_leaks(documents: DataFrame, items: DataFrame, most: float = 0.5) -> DataFrame:
    """All documents without leaked spans: doc_id, action (kept, cut, dropped), text, n_items.

    Every leaked stretch counts, also several of one item.  A document more than ``most`` of whose words leaked is dropped (its text
    becomes null); from others the leaked words are cut.
    """
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("sha")), "doc_id")
    # Equal texts are read once; what leaked into one text is bounded by its own length.
    texts = docs.where("text IS NOT NULL").select(F.col("sha").alias("key"), "text")
    found = _stretches(texts, items, "item_id", "text", True)
    hits = found.groupBy(F.col("key").alias("h_sha")).agg(F.collect_set(F.struct("item_id", "first_word", "end_word")).alias("hits"))

    def one(text: str | None, hits) -> tuple[str, str | None, int]:
        if hits is None or not len(hits):
            return "kept", text, 0
        ranges = sorted({(int(h["first_word"]), int(h["end_word"])) for h in hits})
        n_items = len({h["item_id"] for h in hits})
        inside = np.zeros(len(words(text)), bool)
        for f, t in ranges:
            inside[f:t] = True
        if inside.mean() > most:
            return "dropped", None, n_items
        return "cut", cut(text, ranges), n_items

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(t, h) for t, h in zip(f["text"], f["hits"])]
            yield pd.DataFrame({"doc_id": f["doc_id"], "action": [x[0] for x in got], "text": [x[1] for x in got], "n_items": [x[2] for x in got]})

    j = docs.join(hits, F.col("sha") == F.col("h_sha"), "left").select("doc_id", "text", "hits")
    return j.mapInPandas(run, "doc_id long, action string, text string, n_items long")
