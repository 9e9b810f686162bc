"""Personal information in free text: found, typed, replaced by placeholders.

A linear-chain CRF over word-shape features, trained from the small labelled
table of ``pii_table``, labels the tokens of whole texts; Viterbi runs over
batches in numpy.  Author names of the archive enter as flags of the places
they cover.  An exact check follows: a find must have its kind's form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle, spread
from .bits import FILTER_BITS, term_filter
from .crf import Crf
from .pii_table import COUNTED, FAMILY, FIRM, GEO, GIVEN, IDS, KINDS, SUFFIX, TITLES, WORD, labelled_rows

#: Tokens that are decoded as one sequence; longer texts are cut at these places into pieces that are read one by one.
PIECE = 400
#: What is taken off the score of "nothing": finds are checked exactly afterwards, so the decoder may rather propose one too many.
LEAN = 1.0

_TOKEN = re.compile(r"[^\W\d_]+|\d+|_|[^\w\s]")
LABELS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
_TITLES = frozenset(TITLES)


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Keys of the tokens (with a blank where one stood before), and where they begin and end."""
    keys, lo, hi = [], [], []
    end = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        keys.append(" " + m.group() if a > end or not keys else m.group())
        lo.append(a)
        hi.append(b)
        end = b
    return keys, lo, hi


def shape(w: str) -> str:
    if w[0].isdigit():
        return f"d{min(len(w), 9)}"
    if not w[0].isalpha():
        return "p"
    if len(w) == 1:
        return "X" if w.isupper() else "x"
    return "XX" if w.isupper() else "Xx" if w[0].isupper() else "xx"


#: Marks at the end of a token's key: the word is a given or a family name of some author.
GIVEN_MARK, FAMILY_MARK = "\1", "\2"


class Features:
    """Features of a token key; ``given`` and ``family``: words known from everywhere, besides those that a key marks."""

    def __init__(self, given: frozenset[str], family: frozenset[str]):
        self.given, self.family = given, family

    def __call__(self, key: str) -> list[str]:
        w = key.strip(" " + GIVEN_MARK + FAMILY_MARK)
        low = w.lower()
        f = ["1", "s=" + shape(w), "b" if key[0] == " " else "nb"]
        if not w[0].isalnum():
            return [*f, "w=" + w]
        f.append("w=" + low)
        if w[0].isalpha():
            f += ["2=" + low[-2:], "4=" + low[-4:], "3=" + low[-3:]]
            if low in self.given or GIVEN_MARK in key:
                f.append("given")
            if low in self.family or FAMILY_MARK in key:
                f.append("family")
            if low in _TITLES:
                f.append("title")
            if low in WORD:
                f.append("digitword")
        else:
            f.append("z" if w[0] == "0" else "nz")
        return f


def person(name: str) -> tuple[str, str] | None:
    """Given and family name of a full name, in lower case."""
    parts = name.split()
    if 2 <= len(parts) <= 3 and all(p.isalpha() and len(p) > 1 for p in parts):
        return parts[0].lower(), parts[-1].lower()
    return None


def low_tokens(text: str) -> list[str]:
    return [k.strip().lower() for k in tokens(text)[0]]


def name_keys(name: str) -> set[tuple[str, str]]:
    """(kind, key) of an author name: the whole name's tokens, and the given and family word of a full name."""
    t = low_tokens(name)
    # A lone sign would match everywhere and names nobody.
    out = {("name", " ".join(t))} if t and (len(t) > 1 or t[0].isalnum()) else set()
    if whole := person(name):
        out |= {("given", whole[0]), ("family", whole[1])}
    return out


class Known:
    """What one text mentions of the author names: their keys by first token, and given and family words."""

    def __init__(self, keys: Iterable[tuple[str, str]] = ()):
        self.by_first: dict[str, list[list[str]]] = {}
        words: dict[str, set[str]] = {"given": set(), "family": set()}
        for kind, key in keys:
            if kind == "name":
                t = key.split(" ")
                self.by_first.setdefault(t[0], []).append(t)
            else:
                words[kind].add(key)
        for x in self.by_first.values():
            x.sort(key=len, reverse=True)
        self.given, self.family = words["given"], words["family"]

    def flags(self, keys: list[str]) -> list[int]:
        """1 where a known name begins, 2 where it goes on, else 0."""
        out = [0] * len(keys)
        if not self.by_first:
            return out
        i = 0
        while i < len(keys):
            for t in self.by_first.get(keys[i].strip().lower(), ()):
                n = len(t)
                if i + n <= len(keys) and all(keys[i + k].strip().lower() == t[k] for k in range(1, n)):
                    nxt = keys[i + n] if i + n < len(keys) else " "
                    if not (nxt[0].isalnum() and t[-1][0].isalnum()):
                        out[i : i + n] = [1] + [2] * (n - 1)
                        i += n - 1
                        break
            i += 1
        return out

    def marked(self, keys: list[str]) -> list[str]:
        if not self.given and not self.family:
            return keys
        mark = lambda w: (GIVEN_MARK if w in self.given else "") + (FAMILY_MARK if w in self.family else "")
        return [k + mark(k.strip().lower()) for k in keys]


class Names:
    """A small set of author names held in memory."""

    def __init__(self, names: Iterable[str]):
        self.words: dict[str, set[tuple[str, str]]] = {}
        self.names: set[str] = set()
        for n in names:
            for kind, key in name_keys(n):
                self.names.add(key) if kind == "name" else self.words.setdefault(key, set()).add((kind, key))
        self.first = {n.split(" ")[0] for n in self.names}
        self.sizes = sorted({n.count(" ") + 1 for n in self.names})

    def known(self, text: str) -> Known:
        t = low_tokens(text)
        found = {x for w in t for x in self.words.get(w, ())}
        for i, w in enumerate(t):
            if w in self.first:
                found |= {("name", g) for n in self.sizes if (g := " ".join(t[i : i + n])) in self.names}
        return Known(found)


def capitals(keys: list[str], flags: list[int]) -> list[int]:
    """``flags`` with 3 (4: goes on) where capital words follow each other, and 5 (6) where a comma stands between two."""
    out = list(flags)
    big = [k.strip() for k in keys]
    big = [w[0].isupper() and w.isalpha() for w in big]
    for i in range(len(keys) - 1):
        if not big[i]:
            continue
        j, kind = i + 1, 3
        if keys[j] == "." and (len(keys[i].strip()) == 1 or keys[i].strip().lower() in _TITLES):
            j += 1
        elif keys[j] == ",":
            j, kind = j + 1, 5
        if j < len(keys) and big[j] and keys[j][0] == " ":
            for at in range(i, j + 1):
                if out[at] not in (1, 2):
                    out[at] = kind if at == i and out[at] == 0 else kind + 1
    return out


@lru_cache(maxsize=2)
def trained(seed: int = 11, rows: int = 16000) -> Crf:
    """The tagger, trained once per process (half a minute)."""
    table = labelled_rows(rows, seed)
    # A part of the lists only, so that names nobody listed are learned too.
    of = Features(frozenset(g.lower() for i, g in enumerate(GIVEN) if i % 3 == 0), frozenset(f.lower() for i, f in enumerate(FAMILY) if i % 3 == 0))
    keys, flags, gold = [], [], []
    for text, spans, known in table:
        k, lo, hi = tokens(text)
        y, f = [0] * len(k), [0] * len(k)
        for a, b, kind in spans:
            inside = [i for i in range(len(k)) if lo[i] >= a and hi[i] <= b]
            for n, i in enumerate(inside):
                y[i] = LABELS.index(f"{'I' if n else 'B'}-{kind}")
        for a, b in known:
            inside = [i for i in range(len(k)) if lo[i] >= a and hi[i] <= b]
            for n, i in enumerate(inside):
                f[i] = 2 if n else 1
        keys.append(k)
        flags.append(capitals(k, f))
        gold.append(y)
    count = Counter(x for s in keys for k in s for x in of(k))
    least = lambda x: 3 if x.startswith("w=") else 2
    crf = Crf(LABELS, {x: i for i, x in enumerate(sorted(x for x, n in count.items() if n >= least(x)))}, of, 7)
    crf.train(keys, flags, gold)
    return crf


_AT, _DOT = r"(?:@|\s@\s|\s*[\[({]at[\])}]\s*|\s+at\s+)", r"(?:\.|\s*[\[({]dot[\])}]\s*|\s+dot\s+)"
_EMAIL = re.compile(rf"[\w+\-]+(?:{_DOT}[\w+\-]+)*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)+", re.I)
_MARKED = re.compile(rf"[\w+\-]+(?:{_DOT}[\w+\-]+)*(?:@|\s@\s|\s*[\[({{]at[\])}}]\s*)[\w\-]+(?:{_DOT}[\w\-]+)+", re.I)
_SOCIAL = re.compile(r"\d{3}-\d{2}-\d{4}")
_NO_NUMBER = re.compile(r"\d{4}-\d{2}-\d{2}(?!\d).*|\d{1,3}(?:\.\d{1,3}){3}|\d{1,2}[./]\d{1,2}[./]\d{4}")
#: What names an identity number, right before it.
_CUES = re.compile(rf"(?:{'|'.join(re.escape(c) for k in IDS for c in k.split('|'))})(?:\s*(?:no\.?|nr\.?|number|is|n°|[#:=,(]))*\s*$", re.I)
#: What counts things, right before a number.
_COUNTS = re.compile(rf"\b(?:{'|'.join(COUNTED)}|dated|channel|pages?)s?\b(?:\s*(?:no\.?|nr\.?|number|id|#|:))*\s*$", re.I)
#: A number in groups of three, three and four, parted by points or hyphens, is a telephone number whatever stands before it.
_DIALLED = re.compile(r"(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}")
#: The forms of an address: number and street, street and number, kinds of streets that stand before the name, compounds, boxes, and a postal code.
_KIND = "|".join(sorted({w.strip(".") for w in SUFFIX}, key=len, reverse=True))
_ADDRESS = [
    re.compile(rf"\d+(?:[a-z]|-\d+)?,?\s+(?:(?:[^\W\d_]{{1,3}}\.|[^\W\d][\w'’-]*)\s+){{1,4}}(?:(?:{_KIND.title()}|{_KIND.upper()})\b|(?i:{_KIND})\b,?\s\w)"),
    re.compile(rf"\b[^\W\da-z][\w'’-]+\s+(?:{_KIND})\.?\s+\d+"),
    re.compile(r"\d+\w?,?(?:\s+(?:bis|ter),?)?\s+(?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours|route)\s", re.I),
    re.compile(r"\b(?:calle|avenida|plaza|paseo|avda\.?|carrer|via|viale|corso|piazza|rua|c/)\s.{2,40}?\d", re.I),
    re.compile(r"(?:straße|strasse|str\.?|weg|gasse|platz|allee|ring|damm|ufer|straat|laan)\s+\d", re.I),
    re.compile(r"\b(?:Am|Im|An de[rn]|Auf de[rm]|Zu[rm]|In de[rn]|Unter den|Alte[rs]?)\s[^\W\da-z].{2,30}?\d"),
    re.compile(r"\b(?:box|postfach|bp|apartado|apdo\.?)\s+\d", re.I),
    re.compile(r"[^\W\da-z]\w+.*(?:\b\d{5}\b|\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b)"),
]
#: Words that no name begins with or ends in.
_NO_NAME = frozenset((
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august october november december the a an and or but by on in at of to if is are was were it no not yes my your our their his her this that these those with from for as we they you what why who how when where while "
    "der die das und oder aber ist war ein eine im am zu mit von aus für nicht le la les à un une et ou mais est dans avec pour sur el los las y o pero es en con por without back thanks see keine kein ohne seit nach bei erst sans après depuis sin desde san santa los las saint lake mount port north south east west great honestly because maybe sometimes once any some most every both half keep good new old"
).split())
_NOBODY = frozenset(w.lower() for w in [*GEO, *FIRM])
_PARTICLES = frozenset("von van de del la der den bin al da dos das di du le el ibn ter ten y e zu und jr sr".split())


def tidy(kind: str, text: str, a: int, b: int) -> tuple[str, int, int]:
    """A find's kind and bounds so that nothing of an address or a number is left over and nothing else is taken."""
    if kind == "email":
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.+-"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in "_.-"):
            b += 1
        m = _EMAIL.search(text, a, b)
        return (kind, *(m.span() if m else (a, a)))
    if kind in ("phone", "id_number"):
        while a and (text[a - 1].isalnum() or text[a - 1] in "+(" or text[a - 1] == "-" and a > 1 and text[a - 2].isalnum()):
            a -= 1
        while True:  # what hangs on without a blank, and groups of digits of a telephone number
            if b < len(text) and (text[b].isalnum() or text[b] in "-./" and b + 1 < len(text) and text[b + 1].isalnum()):
                b += 1
            elif kind == "phone" and (m := re.compile(r" \d{2,4}(?![\w])").match(text, b)) and " " in text[a:b] and sum(c.isdigit() for c in text[a : m.end()]) <= 12:
                b = m.end()
            else:
                break
        if any(c.isdigit() for c in text[a:b]):
            b -= len(text[a:b]) - len(re.sub(r"(?: [^\W\d]|[\s.,;:\-()/])+$", "", text[a:b])) if kind == "phone" else len(text[a:b]) - len(text[a:b].rstrip(" .,;:-/"))
        one = text[a:b]
        if one[:1] != "+" and not _DIALLED.fullmatch(one) and _CUES.search(text, max(0, a - 60), a):
            return "id_number", a, b
        if _NO_NUMBER.fullmatch(one) or one[:1] != "+" and _COUNTS.search(text, max(0, a - 40), a):
            return kind, a, a
        return ("phone" if one[:1] == "+" or _DIALLED.fullmatch(one) else "id_number" if _SOCIAL.fullmatch(one) else kind), a, b
    if kind == "name":
        at = a
        while at and (text[at - 1].isalnum() or text[at - 1] in "_.+-"):
            at -= 1
        if (m := _MARKED.match(text, at)) and m.end() > a:
            return "email", *m.span()
        if m := next((m for m in re.finditer(r"([^\W\d_]{4,})[.!?]\s", text[a:b]) if m[1].lower() not in _TITLES), None):
            b = a + m.end(1)
        return kind, a, b - (len(text[a:b]) - len(text[a:b].rstrip(" ,;:-")))
    return kind, a, b - (len(text[a:b]) - len(text[a:b].rstrip(" ,;:-")))


def valid(kind: str, text: str, known: bool, people: frozenset[str] = frozenset()) -> bool:
    """The exact check of a find."""
    digits = sum(c.isdigit() for c in text)
    if not text:
        return False
    if kind == "email":
        return bool(text)
    if kind == "phone":
        return not re.search(r"\.\s", text) and 7 <= digits <= 15 or sum(w in WORD for w in re.findall(r"[a-z]+", text.lower())) >= 6
    if kind == "id_number":
        return digits >= (5 if any(c.isalpha() for c in text) else 6) and len(text) <= 30
    words = re.findall(r"[^\W\d_]+", text)
    if kind == "address":
        return digits >= 1 and len(text) <= 120 and any(f.search(text) for f in _ADDRESS)
    if known:
        return True
    low = [w.lower() for w in words]
    if re.search(r"\s[-–/]\s|[\n\d:;!?]", text):
        return False
    if len(words) < 2 or not any(len(w) > 2 for w in words) or low[0] in _NO_NAME and not re.match(r"[^\W\d_]\.", text) or low[-1] in _NO_NAME:
        return False
    if low[-1] in _NOBODY and not any(w in _TITLES for w in low):
        return False
    if text == text.lower():  # plain words are a name only if one is known from a name
        return any(w in people or w in _TITLES for w in low)
    # In mixed case every word but particles begins with a capital.
    return all(w[0].isupper() or w.lower() in _PARTICLES or w.lower() in _TITLES or w in ("s", "med", "h", "c") or not (w[0].isupper() or w[0].islower()) for w in words)


class Tagger:
    """Finds in batches of texts; made once per task."""

    def __init__(self, crf: Crf, names: Names | None = None, batch: int = 1024):
        self.crf, self.names, self.batch = crf, names, batch
        self.given = frozenset(g.lower() for g in GIVEN)
        self.crf.of = Features(self.given, frozenset(f.lower() for f in FAMILY))
        self.number: dict[str, int] = {}
        self.table = np.zeros((4096, len(tuple(crf.w[0])), len(crf.labels)), np.float32)

    def _number(self, key: str) -> int:
        n = self.number.get(key)
        if n is None:
            if len(self.number) >= 300_000:
                self.number.clear()
            n = self.number[key] = len(self.number)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n] = self.crf.reach(key)
        return n

    def finds(self, texts: list[str | None], known: list[Known | None] | None = None) -> list[list[tuple[int, int, str]]]:
        """(from, to, kind) of what each text holds; nothing for null and empty texts.

        ``known``: what each text mentions of the author names (else looked up in ``names``).
        """
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        todo, people = [], []
        for n, t in enumerate(texts):
            k = (known[n] if known is not None else self.names.known(t) if t and self.names else None) or Known()
            people.append(self.given | k.given | k.family if k.given or k.family else self.given)
            if not t:
                continue
            keys, lo, hi = tokens(t)
            flags = capitals(keys, k.flags(keys))
            keys = k.marked(keys)
            for a in range(0, len(keys), PIECE):
                b = min(a + PIECE, len(keys))
                # A piece begins and ends with up to 20 tokens that its neighbours read too, and counts only what begins in its own part.
                x, y = max(0, a - 20), min(len(keys), b + 20)
                todo.append((n, keys[x:y], flags[x:y], lo[x:y], hi[x:y], a - x, b - x))
        todo.sort(key=lambda z: len(z[1]))
        for at in range(0, len(todo), self.batch):
            part = todo[at : at + self.batch]
            length = np.array([len(p[1]) for p in part])
            ids, fl = np.full((len(part), length.max()), -1), np.zeros((len(part), length.max()), np.int8)
            for i, p in enumerate(part):
                ids[i, : length[i]] = [self._number(k) for k in p[1]]
                fl[i, : length[i]] = p[2]
            e = self.crf.emissions(self.table, ids, fl)
            e[:, :, 0] -= LEAN
            best = self.crf.decode(e, length)
            for i in np.flatnonzero(best.any(axis=1) | (fl == 1).any(axis=1)):
                n, _, flags, lo, hi, a, b = part[i]
                text = texts[n]
                for f, e, kind in spans_of(best[i, : length[i]], flags):
                    if not a <= f < b:
                        continue
                    kind, x, y = tidy(kind, text, lo[f], hi[e - 1])
                    if valid(kind, text[x:y], any(z in (1, 2) for z in flags[f:e]), people[n]):
                        out[n].append((x, y, kind))
        return [sorted(x) for x in out]


def spans_of(labels: np.ndarray, flags: list[int]) -> list[tuple[int, int, str]]:
    """Runs of one kind; a known author's name that no other kind covers is a name."""
    out, i, n = [], 0, len(labels)
    while i < n:
        y = int(labels[i])
        if y:
            k = (y - 1) // 2
            j = i + 1
            while j < n and int(labels[j]) == 2 * k + 2:
                j += 1
            out.append((i, j, KINDS[k]))
            i = j
        elif flags[i] == 1:
            j = i + 1
            while j < n and flags[j] == 2:
                j += 1
            if not any(labels[i:j]):
                out.append((i, j, "name"))
            i = j
        else:
            i += 1
    return out


def author_names(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Distinct author names of tables given as (table, name column, id column)."""
    every = None
    for t, c, _ in tables:
        n = t.select(F.trim(F.col(c)).alias("name")).where(F.length("name") > 0).groupBy("name").agg(F.lit(1).alias("one")).select("name")
        every = n if every is None else every.unionByName(n)
    return every.distinct()


def mentioned(messages: DataFrame, known: DataFrame, text_col: str) -> DataFrame:
    """What each text mentions of the author names: h_text (hash of the text), keys (array of kind, key).

    Names become keys (whole names, and the given and family words of full
    ones).  A bitmap of the keys' hashes, of fixed size whatever their number,
    goes to the tasks; what passes it of a text's words and runs of words is
    joined with the keys, so the result is the same at every size.  Texts
    of one hash share a row, which then holds what either mentions.
    """
    spark = messages.sparkSession

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = {(kind, key, key.split(" ")[0], key.count(" ") + 1) for n in f["name"] for kind, key in name_keys(n)}
            if rows:
                yield pd.DataFrame(sorted(rows), columns=["kind", "key", "first", "n"])

    every = settle(known.where("name IS NOT NULL").mapInPandas(keys, "kind string, key string, first string, n int").distinct(), "names")
    # Lengths are few, as no name is longer than the longest; the bitmap holds whole keys and first words.
    sizes = sorted(r["n"] for r in every.where("n > 1").select("n").distinct().collect())
    held = spark.sparkContext.broadcast(term_filter(every.select(F.explode(F.array("key", F.concat(F.lit("^"), "first"))).alias("term"))).tobytes())

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        seen: dict[str, tuple[bool, bool]] = {}

        def passes(term: str) -> bool:
            h = zlib.crc32(term.encode()) % FILTER_BITS
            return bool(bits[h >> 3] >> (h & 7) & 1)

        for f in frames:
            at, found = [], []
            for h, t in dict(zip(f["h"], f["t"])).items():
                k = low_tokens(t)
                got = set()
                for i, w in enumerate(k):
                    s = seen.get(w)
                    if s is None:
                        if len(seen) > 500_000:
                            seen.clear()
                        s = seen[w] = (passes(w), passes("^" + w))
                    if s[0]:
                        got.add(w)
                    if s[1]:
                        for n in sizes:
                            if i + n > len(k):
                                break
                            if passes(g := " ".join(k[i : i + n])):
                                got.add(g)
                at += [h] * len(got)
                found += got
            if at:
                yield pd.DataFrame({"h_text": at, "gram": found})

    text = F.col(text_col)
    said = messages.where(text.isNotNull() & (text != "")).select(F.xxhash64(text).alias("h"), text.alias("t"))
    said = said.mapInPandas(grams, "h_text long, gram string").distinct()
    j = said.join(every.select("kind", "key"), F.col("gram") == F.col("key"))
    return j.groupBy("h_text").agg(F.collect_set(F.struct("kind", "key")).alias("keys"))


def find(messages: DataFrame, known: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """What every text holds and the text with placeholders: message_id, kinds (array), n_finds, redacted.

    One row per row of ``messages``.  Null texts stay null; empty ones stay
    empty; texts are read whole.  ``known`` holds the author names (name); an
    empty table is allowed.  Placeholders are [EMAIL], [PHONE], [ID_NUMBER],
    [ADDRESS] and [NAME].
    """
    slim = spread(messages.select(F.col(id_col).cast("long").alias("message_id"), F.col(text_col).alias("t")), "message_id")
    held = messages.sparkSession.sparkContext.broadcast(trained())
    names = mentioned(slim, known, "t")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(held.value)
        for f in frames:
            codes, unique = pd.factorize(f["t"])  # chat repeats itself
            texts = list(unique)
            keys: list[Known | None] = [None] * len(texts)
            for c, kind, key in zip(codes, f["kind"], f["key"]):
                if c >= 0 and kind is not None and keys[c] is None:
                    keys[c] = Known(zip(kind, key))
            found = tagger.finds(texts, keys)
            red = []
            for t, spans in zip(texts, found):
                end, out = 0, []
                for a, b, k in spans:
                    if a >= end:
                        out += [t[end:a], f"[{k.upper()}]"]
                        end = b
                    elif b > end:  # two finds overlap: what the second has more goes too
                        end = b
                red.append("".join([*out, t[end:]]) if out else t)
            kinds = [sorted({k for _, _, k in s}) for s in found]
            yield pd.DataFrame(
                {
                    "message_id": f["message_id"],
                    "kinds": [kinds[c] if c >= 0 else [] for c in codes],
                    "n_finds": [len(found[c]) if c >= 0 else 0 for c in codes],
                    "redacted": [red[c] if c >= 0 else None for c in codes],
                }
            )

    j = slim.join(names, F.xxhash64("t") == F.col("h_text"), "left").select("message_id", "t", "keys.kind", "keys.key")
    return j.mapInPandas(run, "message_id long, kinds array<string>, n_finds int, redacted string")
