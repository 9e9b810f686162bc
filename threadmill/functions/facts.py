"""Checkable facts of a text, as Catalyst expressions.

A text is cut into tokens once.  What a token says follows from its own form
and the token after it: a number before a unit is a quantity, a word of digits
and points a version, and so on.  Facts are structs of kind and value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_matches

#: Unit spellings and the unit they count as.
UNITS = {
    "mhz": "mhz", "megahertz": "mhz", "ghz": "ghz", "khz": "khz", "kb": "kb", "kib": "kb", "kilobyte": "kb", "kilobytes": "kb", "mb": "mb", "mib": "mb", "meg": "mb", "megs": "mb", "megabyte": "mb", "megabytes": "mb",
    "gb": "gb", "gib": "gb", "gig": "gb", "gigs": "gb", "gigabyte": "gb", "gigabytes": "gb", "tb": "tb", "terabyte": "tb", "terabytes": "tb", "byte": "bytes", "bytes": "bytes", "kw": "kw", "kilowatt": "kw", "kilowatts": "kw", "watts": "w", "volts": "v", "rpm": "rpm", "mips": "mips",
}
#: Number words, and words after which they don't count anything.
NUMBERS = dict(zip("two three four five six seven eight nine ten eleven twelve".split(), range(2, 13)))
VAGUE = ("of", "more", "other", "thing")

#: Quoted code, quotes, mentions, pseudonyms, part numbers, numbers with thousands commas, words, other signs.
TOKEN = r'`[^`\n]{2,80}`|"[^"\n]{3,80}"|<[@#][!&]?[0-9]+>|user-[0-9a-f]+\b|[0-9]{3}-[0-9]{4}-[0-9]{3}\b|[0-9]{1,3}(?:,[0-9]{3})+\b|[\p{L}\p{N}_]+(?:[.\x27][\p{L}\p{N}_]+)*|[^\s]'


def _look_up(table: dict[str, object], key: Column) -> Column:
    """The value of a small fixed table; null for other keys."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, str(v)))), key)


def plain(c: Column) -> Column:
    """Lower case with straight quotes."""
    return F.translate(F.lower(c), "“”’", "\"\"'")


def tokens(c: Column, models: str | None = None) -> Column:
    """Tokens of a text in which numbers have one form: commas, k, number words and short names are written out.

    ``models``: a pattern of names of several words that are one token.
    """
    found = all_matches(plain(c), (f"(?:{models})|" if models else "") + TOKEN)

    def one(t: Column, i: Column) -> Column:
        after = F.get(found, i + 1)
        return (
            F.when(t.rlike("^[0-9]{1,3}(,[0-9]{3})+$"), F.replace(t, F.lit(","), F.lit("")))
            .when(t.isin(*NUMBERS) & ~F.coalesce(after.isin(*VAGUE), F.lit(False)), _look_up(NUMBERS, t))
            .when((t == "one") & after.isin(*UNITS), "1")
            .when(t.rlike("^[0-9]{1,15}k$"), (F.regexp_extract(t, "[0-9]+", 0).cast("long") * 1000).cast("string"))
            .when(t.rlike("^r[0-9]{1,2}k$"), F.concat(F.lit("r"), (F.regexp_extract(t, "[0-9]+", 0).cast("int") * 1000).cast("string")))
            .when(t.rlike("^o[0-9]{3,4}$"), F.concat(F.lit("origin "), F.substring(t, 2, 9)))
            .otherwise(t)
        )

    return F.transform(found, one)


def _amount(number: Column) -> Column:
    """A decimal without zeros that say nothing."""
    n = F.regexp_replace(number, r"^0+(?=[0-9])", "")
    return F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n)


def facts_of(toks: Column, models: str | None = None) -> Column:
    """Distinct facts of ``tokens``: file, quote, part, model, quantity, version, cpu, year, number."""
    number = "^[0-9]+(\\.[0-9]+)?$"

    def one(t: Column, i: Column) -> Column:
        fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        unit = _look_up(UNITS, F.get(toks, i + 1))
        joined = _look_up(UNITS, F.regexp_extract(t, "^[0-9]+(?:\\.[0-9]+)?([a-z]+)$", 1))
        is_model = t.rlike(f"^(?:{models})$") | t.rlike("^origin [0-9]{3,4}$") if models else t.rlike("^origin [0-9]{3,4}$")
        inner = t.substr(F.lit(2), F.length(t) - 2)
        return (
            F.when(t.startswith("`") & (F.length(t) > 1), fact("file", inner))
            .when(t.startswith('"') & (F.length(t) > 1), fact("quote", inner))
            .when(t.rlike("^[0-9]{3}-[0-9]{4}-[0-9]{3}$"), fact("part", t))
            .when(is_model, fact("model", F.regexp_replace(t, "\\s+", " ")))
            .when(t.rlike(number) & unit.isNotNull(), fact("quantity", F.concat(_amount(t), F.lit(" "), unit)))
            .when(joined.isNotNull(), fact("quantity", F.concat(_amount(F.regexp_extract(t, "^[0-9.]+", 0)), F.lit(" "), joined)))
            .when(t.rlike("^[0-9]+(\\.[0-9]+)+[mf]?$"), fact("version", F.regexp_replace(t, "[mf]$", "")))
            .when(t.rlike("^r[0-9]{3,5}$"), fact("cpu", t))
            .when(t.rlike("^(19[6-9][0-9]|20[0-2][0-9])$"), fact("year", t))
            .when(t.rlike("^[0-9]+$"), fact("number", t))
        )

    return F.array_distinct(F.array_compact(F.transform(toks, one)))


def missing(mine: Column, source: Column, source_tokens: Column, known: Column) -> Column:
    """Those of the facts ``mine`` that a source doesn't bear out.

    Files and quotes must stand in the source, numbers among its digits,
    versions equal or begin one of its versions, models one begin the other;
    all others must be among its facts.
    """
    digits = F.flatten(F.transform(source_tokens, lambda t: all_matches(t, "[0-9]+")))
    text = plain(source)

    def borne(f: Column) -> Column:
        same = lambda test: F.exists(known, lambda k: (k["kind"] == f["kind"]) & test(k["value"]))
        return (
            F.when(f["kind"].isin("file", "quote"), F.contains(text, f["value"]))
            .when(f["kind"] == "number", F.array_contains(digits, f["value"]))
            .when(f["kind"] == "version", same(lambda v: (v == f["value"]) | F.startswith(v, F.concat(f["value"], F.lit(".")))))
            .when(f["kind"] == "model", same(lambda v: F.startswith(v, f["value"]) | F.startswith(f["value"], v)))
            .otherwise(same(lambda v: v == f["value"]))
        )

    return F.filter(mine, lambda f: ~F.coalesce(borne(f), F.lit(False)))
