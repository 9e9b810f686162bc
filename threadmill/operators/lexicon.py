"""Lexicon hits, rule names and message features.

A lexicon is a table of terms and a gazetteer a mapping of names to patterns;
both are parameters.  Lexicons are joined, never held in an expression, so they
may be of any size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import bucket
from .relational import position_bucket

#: Sizes of messages (characters) and exchanges (messages), as upper bounds and names.
MESSAGE_SIZES = [(20, "MLEN_1-20"), (80, "MLEN_21-80"), (300, "MLEN_81-300")]
EXCHANGE_SIZES = [(2, "EXSIZE_1-2"), (5, "EXSIZE_3-5"), (15, "EXSIZE_6-15")]
NEIGHBOUR_WORDS = 30


def load_rules(rules: Mapping[str, tuple[str, float]]) -> tuple[dict[str, tuple[str, float]], str]:
    """Rules (name -> pattern, weight) checked, with the version that their content makes.

    A name must be an identifier, a pattern must compile, and a weight must lie
    between -1 and 1; all faults are reported at once.
    """
    faults = []
    for name, (pattern, weight) in rules.items():
        if not name.isidentifier():
            faults.append(f"{name!r} is no name")
        if not isinstance(weight, (int, float)) or isinstance(weight, bool) or not -1 <= weight <= 1:
            faults.append(f"{name}: weight {weight!r}")
        try:
            re.compile(pattern)
        except re.error as e:
            faults.append(f"{name}: {e}")
    if faults:
        raise ValueError("; ".join(faults))
    text = json.dumps({k: list(v) for k, v in rules.items()}, sort_keys=True)
    return dict(rules), hashlib.sha256(text.encode()).hexdigest()[:12]


def lexicon_tokens(c: Column) -> Column:
    """Words in order, with repetitions; a link counts as its registered name."""
    url = r"https?://[^\s<>()]+"
    found = T.all_matches(F.translate(F.lower(c), "’", "'"), rf"{url}|[{T.WORDCHAR}/][{T.WORDCHAR}'./+-]*")
    words = F.transform(found, lambda t: F.when(t.rlike("^https?://"), T.registrable_word(t)).otherwise(F.regexp_replace(t, "[.,!?;:)'\"-]+$", "")))
    return F.filter(words, lambda t: (F.length(t) <= 40) & t.rlike(r"[\p{L}\p{N}]"))


def message_hits(messages: DataFrame, lexicon: DataFrame, gazetteer: Mapping[str, str]) -> DataFrame:
    """What each message holds of a lexicon: id, hits (sorted terms, then gaz:name of each pattern in its raw text).

    ``messages``: id, content; ``lexicon``: term (distinct).  A word ending in
    s that is no term counts as its singular if that is one.  Every message
    has a row; null and empty texts have no hits.
    """
    t = messages.select("id", F.explode(F.array_distinct(lexicon_tokens(F.col("content")))).alias("word"))
    terms = lexicon.select(F.col("term").alias("word"))
    whole = t.join(terms, "word", "left_semi")
    rest = t.where(F.col("word").endswith("s")).join(terms, "word", "left_anti")
    single = rest.select("id", F.expr("left(word, length(word) - 1)").alias("word")).join(terms, "word", "left_semi").select("id", "word")
    found = whole.select("id", "word").unionByName(single).groupBy("id").agg(F.sort_array(F.collect_set("word")).alias("found"))
    named = F.array_compact(F.array(*(F.when(F.col("content").rlike(f"(?i){p}"), F.lit(f"gaz:{n}")) for n, p in gazetteer.items()))) if gazetteer else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    return messages.select("id", F.coalesce(named, none).alias("named")).join(found, "id", "left").select("id", F.concat(F.coalesce("found", none), "named").alias("hits"))


def lexicon_scores(hits: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Share of an exchange's messages with hits: key, share, hits, messages.  ``keys``: id, key."""
    j = keys.join(hits.select("id", F.size("hits").alias("n")), "id")
    g = j.groupBy(key).agg(F.count_if(F.col("n") > 0).alias("with_hits"), F.sum("n").cast("long").alias("hits"), F.count("*").alias("messages"))
    return g.select(key, (F.col("with_hits") / F.col("messages")).alias("share"), "hits", "messages")


def rule_names(messages: DataFrame, reasons: DataFrame, text: Mapping[str, str], share: Mapping[str, str], short: int = 30) -> DataFrame:
    """Names of the rules that hold for each exchange: xid, names (sorted).

    ``reasons``: xid, reasons (blank-separated names of the score).  ``text``:
    patterns of which any message holds one; ``share``: patterns that more than
    half of the messages match; besides bot_author (more than half by bots)
    and very_short (fewer than ``short`` characters).
    """
    c = F.col("content")
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    g = messages.groupBy("xid").agg(
        F.count("*").alias("n"), F.count_if("bot").alias("bots"), (F.sum(F.length(c)) + F.count("*") - 1).alias("chars"),
        *(F.max(c.rlike(f"(?i){p}")).alias(f"t_{n}") for n, p in text.items()), *(F.count_if(trimmed.rlike(f"(?i){p}")).alias(f"s_{n}") for n, p in share.items()),
    )
    tests = [*((F.col(f"t_{n}"), n) for n in text), *((F.col(f"s_{n}") / F.col("n") > 0.5, n) for n in share), (F.col("bots") / F.col("n") > 0.5, "bot_author"), (F.col("chars") < short, "very_short")]
    names = F.array_compact(F.array(*(F.when(test, F.lit(f"gaz_{n}")) for test, n in tests)))
    scored = F.filter(F.split(F.coalesce("reasons", F.lit("")), " "), lambda x: x != "")
    return g.join(reasons, "xid", "left").select("xid", F.sort_array(F.array_distinct(F.concat(names, scored))).alias("names"))


def context_tokens(messages: DataFrame, opted_out: DataFrame) -> DataFrame:
    """What surrounds each message of an exchange, as tokens: id, context.

    POS_ and EXSIZE_ buckets, CTX_ flags, and of the message before, the one
    after and the one replied to (PREV_, NEXT_, REPLYTO_; that one also from
    other exchanges) the first words in alphabetical order and the shapes of
    their facts.  Neighbours whose author opted out (``opted_out``: author_id)
    contribute nothing.
    """
    gone = opted_out.select(F.col("author_id").alias("g_author"), F.lit(True).alias("gone")).distinct()
    words = F.slice(F.sort_array(T.word_tokens(F.col("content"))), 1, NEIGHBOUR_WORDS)
    m = messages.join(gone, F.col("author_id") == F.col("g_author"), "left").select("xid", "position", "id", "author_id", "reply_to_id", "content", F.coalesce("gone", F.lit(False)).alias("gone"))
    seen = F.when(~F.col("gone"), F.struct(words.alias("words"), T.fact_shapes(F.col("content")).alias("facts"), F.col("author_id").alias("author"), F.col("content").rlike(r"\?\s*$").alias("asks")))
    m = m.withColumn("seen", seen)
    w = Window.partitionBy("xid").orderBy("position")
    m = m.withColumn("n", F.count("*").over(Window.partitionBy("xid"))).withColumn("prev", F.lag("seen").over(w)).withColumn("next", F.lead("seen").over(w))
    target = m.select(F.col("id").alias("t_id"), F.col("seen").alias("target"))
    j = m.join(target, F.col("reply_to_id") == F.col("t_id"), "left")
    none = F.array().cast("array<string>")

    def named(c: str, space: str) -> Column:
        one = F.concat(F.transform(F.col(f"{c}.words"), lambda x: F.concat(F.lit(space + "_"), x)), F.transform(F.col(f"{c}.facts"), lambda x: F.concat(F.lit(space + "_"), x)))
        return F.coalesce(one, none)

    flags = F.array_compact(
        F.array(
            F.when(F.col("reply_to_id").isNotNull(), "CTX_is_reply"), F.when(F.col("prev.asks"), "CTX_prev_ends_question"), F.when(F.col("prev.author") == F.col("author_id"), "CTX_same_author_prev"),
            position_bucket(F.col("position"), F.col("n")), bucket(F.col("n"), EXCHANGE_SIZES, "EXSIZE_16+"),
        )
    )
    return j.select("id", F.array_distinct(F.concat(flags, named("prev", "PREV"), named("next", "NEXT"), named("target", "REPLYTO"))).alias("context"))


def feature_set(context: Column, name: str) -> Column:
    """The context tokens of a feature set: plain (none), structural (no neighbour's words) or context (all)."""
    if name == "plain":
        return F.array().cast("array<string>")
    if name == "structural":
        return F.filter(context, lambda x: x.rlike("^(POS_|EXSIZE_|CTX_)") | x.contains("_FACT_"))
    if name == "context":
        return context
    raise ValueError(f"no feature set {name!r}")


def message_features(messages: DataFrame, context: DataFrame, sets: Sequence[str] = ("plain", "structural", "context")) -> DataFrame:
    """Features of every message for each feature set: id and a sorted array named after each set.

    Words, SIG_ signals, CHAN_, MLEN_, and the set's context tokens.
    """
    own = F.concat(T.word_tokens(F.col("content")), T.signals(F.col("content"), F.col("reply_to_id")), F.array(F.concat(F.lit("CHAN_"), F.col("channel_id").cast("string")), bucket(F.length("content"), MESSAGE_SIZES, "MLEN_301+")))
    j = messages.select("id", own.alias("own")).join(context, "id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    return j.select("id", *(F.sort_array(F.array_distinct(F.concat("own", feature_set(F.col("context"), s)))).alias(s) for s in sets))
