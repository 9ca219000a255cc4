"""Text expressions: normal forms, phrases, token overlap, prompt lists, embedded JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column, sep: str = " ") -> Column:
    """Lower case; every run of other characters than a-z and 0-9 becomes one separator; ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", sep), F.lit(sep)) if sep != " " else F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return normalize(c, "_")


def humanize(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[_\\-\\s]+", " "))


def before_last(c: Column, sep: str = "/") -> Column:
    """What stands before the last separator; all of it without one."""
    at = F.length(c) - F.length(F.substring_index(c, sep, -1)) - len(sep)
    return F.when(F.contains(c, F.lit(sep)), F.substring(c, F.lit(1), at)).otherwise(c)


def without_prefix(c: Column, prefix: Column) -> Column:
    """``c`` without ``prefix`` if it begins with it."""
    return F.when(c.startswith(prefix), F.substring(c, F.length(prefix) + 1, F.length(c))).otherwise(c)


def token_subset(a: Column, b: Column) -> Column:
    """Whether normalized phrase ``a`` names ``b``: its tokens are all in b, or b's (at least two) are all in a."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    within = lambda p, q: F.size(F.array_except(p, q)) == 0
    return (a != "") & (b != "") & (within(x, y) | ((F.size(y) >= 2) & within(y, x)))


def inventory_prompt(label: Column, domain: Column, names: Column, aliases: Column, most: int = 3) -> Column:
    """Request for missing parts of an object, with its inventory line by line; ``aliases``: an array for each name."""
    line = lambda n, a: F.concat(F.lit("- "), n, F.lit(": "), F.array_join(F.slice(a, 1, most), ", "))
    lines = F.array_join(F.zip_with(names, aliases, line), "\n")
    known = F.when(F.coalesce(F.size(names), F.lit(0)) > 0, lines).otherwise("- none")
    return F.format_string("Object: %s (%s)\nKnown parts:\n%s\nName the visible physical parts that are missing.", label, domain, known)


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-token containment of one normalized text in another; an empty phrase is in nothing."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: t != "")


def token_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def phrase_score(a: Column, b: Column) -> Column:
    """Lexical match of two normalized phrases: 1 if equal, .88 / .86 if one holds the other, else token Jaccard."""
    return (
        F.when(a == b, 1.0)
        .when(contains_phrase(a, b), 0.88)
        .when(contains_phrase(b, a), 0.86)
        .otherwise(token_jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))))
    )


def prompt_items(c: Column) -> Column:
    """Array of (label, phrases) from lines such as ``label = a | b``; separators are line ends, commas and semicolons."""
    parts = F.filter(F.transform(F.split(c, "[\\n,;，；]+"), lambda x: F.trim(x)), lambda p: p != "")

    def item(p: Column) -> Column:
        sides = F.split(p, "\\s*=\\s*", 2)
        phrases = F.filter(F.transform(F.split(F.element_at(sides, -1), "\\|"), lambda x: F.trim(x)), lambda x: x != "")
        return F.struct(slug(F.element_at(sides, 1)).alias("label"), F.array_distinct(phrases).alias("phrases"))

    return F.filter(F.transform(parts, item), lambda i: i["label"] != "")


def shingles(c: Column, n: int, hashed: bool = False) -> Column:
    """Distinct n-token shingles of a normalized text, or 64-bit hashes of them; none if it has fewer tokens."""
    one = (lambda *t: F.xxhash64(*t)) if hashed else (lambda *t: F.concat_ws(" ", *t))
    none = F.array().cast("array<bigint>" if hashed else "array<string>")

    def all_of(t: Column) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n))
        return F.array_distinct(F.coalesce(F.transform(at, lambda i: one(*(F.get(t, i + k) for k in range(n)))), none))

    # bound by a lambda, so that the tokens are made once and not at every position
    return F.element_at(F.transform(F.array(tokens(c)), all_of), 1)


def first_json_object(text: Column) -> Column:
    """The first JSON object that starts at some ``{`` of a free text, as JSON; null if there is none."""

    def decode(s: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(x: str | None) -> str | None:
            at = x.find("{") if x else -1
            while at >= 0:
                try:
                    return json.dumps(decoder.raw_decode(x, at)[0], sort_keys=True)
                except ValueError:
                    at = x.find("{", at + 1)
            return None

        return s.map(one)

    return F.pandas_udf(decode, "string")(text)
