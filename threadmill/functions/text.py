"""Tokenizers and string scalars, as Catalyst expressions.

Word classes are written out ([\\p{L}\\p{N}_]) so that every engine that knows
Unicode categories gives the same tokens.  All functions give null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't count as content of a claim.
STOPWORDS = (
    "a an the and or but if so of to in on at by for with from as is are was were be been it its this that these those "
    "i we you he she they them their his her what who which about up out get has have had"
).split()
#: Labels under which names are registered one level deeper.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")

WORDCHAR = r"\p{L}\p{N}_"
BLANKS = " \t\n\r"


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Distinct lower-case words: may hold ' . / + - inside, no trailing punctuation, at most 40 characters."""
    found = all_matches(F.lower(c), f"[{WORDCHAR}/][{WORDCHAR}'./+-]*")
    bare = F.transform(found, lambda t: F.regexp_replace(t, "[.,!?;:)'\"-]+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: (t != "") & (F.length(t) <= 40)))


def mining_words(c: Column) -> Column:
    """Lower-case ASCII words of three or more characters, with repetitions."""
    return all_matches(F.lower(c), "[a-z][a-z0-9+#-]{2,}")


def claim_tokens(c: Column) -> Column:
    """Distinct ASCII letter-digit runs in lower case that aren't stop words."""
    return F.array_distinct(F.filter(all_matches(F.lower(c), "[a-z0-9]+"), lambda t: ~t.isin(STOPWORDS)))


def registrable_word(url: Column) -> Column:
    """The registered name in a URL's host: foo of https://www.foo.co.uk/x."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#:]*)", 1), r"(^|\.)www\.", "$1")
    parts = F.split(host, r"\.")
    n = F.size(parts)
    deep = (n >= 3) & F.element_at(parts, -2).isin(*SECOND_LEVEL)
    return F.when(deep, F.element_at(parts, -3)).when(n >= 2, F.element_at(parts, -2)).otherwise(F.element_at(parts, 1))


def urls(c: Column) -> Column:
    return all_matches(c, r"https?://[^\s<>()]+")


def stem(t: Column) -> Column:
    """A word without its first fitting ending of ing, ed, es, s if three letters remain."""
    out = t
    for suffix in ("s", "es", "ed", "ing"):
        out = F.when(t.endswith(suffix) & (F.length(t) - len(suffix) >= 3), t.substr(F.lit(1), F.length(t) - len(suffix))).otherwise(out)
    return out


def has_text(c: Column) -> Column:
    """More than blanks, tabs and line breaks."""
    return F.coalesce(F.regexp_replace(c, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "") != "", F.lit(False))


def snippet(c: Column, limit: int = 200) -> Column:
    """White space collapsed; longer texts are cut and marked."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def permalink(guild: Column, channel: Column, message: Column, base: str = "https://chat.example/channels") -> Column:
    return F.concat_ws("/", F.lit(base), guild.cast("string"), channel.cast("string"), message.cast("string"))


def scrubbed(c: Column, host_pattern: str) -> Column:
    """Links to the given hosts (a regular expression) replaced by a mark."""
    return F.regexp_replace(c, rf"(?i)https?://(?:[a-z0-9-]+\.)*(?:{host_pattern})/\S*", "[link removed]")


def long_ids(c: Column) -> Column:
    """Numbers of 17 to 19 digits that stand alone."""
    return all_matches(c, r"(?<![\p{L}\p{N}_.])\d{17,19}(?![\p{L}\p{N}_.])")


def match_terms(query: Column) -> Column:
    """Search terms of a query: blanks split, trailing - . / _ dropped, once each, in order."""
    parts = F.transform(F.split(F.trim(F.lower(query)), r"\s+"), lambda t: F.regexp_replace(t, r"[-./_]+$", ""))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def pseudonym(user_id: Column, salt: str, width: int = 4) -> Column:
    """A name made from a salted hash of the user's id."""
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat(F.lit(salt + ":"), user_id.cast("string")), 256), 1, width))


def letters(n: Column, places: int = 7) -> Column:
    """0, 1, ... 25, 26 as A, B, ... Z, AA, ... ZZ, AAA (up to seven letters: more than an int holds)."""
    one = F.chr((F.pmod(n, F.lit(26)) + 65).cast("long"))
    return one if places == 1 else F.when(n < 26, one).otherwise(F.concat(letters(F.floor(n / 26) - 1, places - 1), one))


def prompt_tokens(c: Column) -> Column:
    """A rough token count: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def signals(c: Column, reply_to: Column) -> Column:
    """Structural signals of a message as an array of names."""
    named = [
        (c.rlike(r"(?i)https?://"), "SIG_url"),
        (c.rlike(r"\p{Nd}"), "SIG_digits"),
        (c.contains("`"), "SIG_code"),
        (c.contains("?"), "SIG_question"),
        (reply_to.isNotNull(), "SIG_reply"),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in named)))


def fact_shapes(c: Column) -> Column:
    """What kinds of checkable facts a text seems to hold, as an array of names."""
    named = [
        (c.rlike(r"(?i)https?://"), "FACT_url"),
        (c.rlike(r"(^|[^0-9.])\d+(\.\d+)+"), "FACT_version"),
        (c.rlike(r"(^|[^0-9])\d{3}-\d{4}-\d{3}"), "FACT_partnumber"),
        (c.rlike(r"(^|\s)/[a-zA-Z0-9._-]+/[a-zA-Z0-9._/-]+"), "FACT_path"),
        (c.contains("`"), "FACT_code"),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in named)))


#: Who can be a claim's source, and what they do as such.
PERSONS = ("community member", "a member", "one member", "another member", "a user", "one user", "a poster", "the poster", "the author", "someone", "somebody", "a contributor", "a maintainer", "a participant", "a commenter")
SPEECH = (
    "reported", "reports", "said", "says", "stated", "states", "noted", "notes", "observed", "observes", "mentioned", "mentions", "claimed", "claims", "explained", "explains", "confirmed", "confirms", "asked", "asks", "wondered",
    "speculated", "suggested", "recalled", "described", "describes", "plans to", "intends to", "hopes to",
)
#: The nouns of PERSONS, which may begin a statement with or without an article.
NOUNS = tuple(dict.fromkeys(p.removeprefix("a ").removeprefix("one ").removeprefix("another ").removeprefix("the ") for p in PERSONS))


def person_subject(c: Column) -> Column:
    """Does a statement begin with a person?"""
    return c.rlike(r"(?i)^\s*(?:a|an|the|one|another)?\s*(?:" + "|".join(NOUNS) + r")\b")


def attributed(c: Column) -> Column:
    """Does a statement name a person as its source: what they do follows within 40 characters?"""
    low = F.lower(c)
    near = [rf"(?s)(?:{'|'.join(PERSONS)}).{{0,{40 - n}}}(?:{'|'.join(v for v in SPEECH if len(v) == n)})" for n in sorted({len(v) for v in SPEECH})]
    hit = low.rlike(r"\baccording to\b")
    for p in near:
        hit = hit | low.rlike(p)
    return hit
