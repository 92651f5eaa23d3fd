"""Scripts, normal forms, tokens and sound skeletons of names, as Column functions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx

SPACES = r"\u0009-\u000D    -     　﻿"
MARKS = "-'’`ʿʼ"


def remembered(make: Callable[..., Column]) -> Callable[..., Column]:
    """``make`` of names and numbers, whose large expressions are put together once for each of these."""

    @functools.cache
    def made(jvm: int, *args: str | int) -> Column:
        return make(*args)

    @functools.wraps(make)
    def one(*args: str | int) -> Column:
        return made(id(SparkContext._gateway), *args)

    return one


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def detect_script(text: Column) -> Column:
    """arabic, hebrew or latin; Arabic letters decide before Hebrew ones; null gives null."""
    ascii_ = F.length(text) == F.octet_length(text)
    return F.when(ascii_, "latin").when(text.rlike(r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"), "arabic").when(text.rlike(r"[֐-׿יִ-ﭏ]"), "hebrew").when(text.isNotNull(), "latin")


def normalize_token(token: Column) -> Column:
    """Optional marks, accents, case and punctuation removed; hyphens and apostrophes stay."""
    fold = {c: base for base, group in lx.LATIN_FOLD.items() for c in group}
    latin = F.translate(F.replace(F.lower(token), F.lit("š"), F.lit("sh")), "".join(fold), "".join(fold.values()))
    script = detect_script(token)
    bare = F.when(script == "arabic", F.regexp_replace(token, lx.ARABIC_MARKS, "")).when(script == "hebrew", F.regexp_replace(token, lx.HEBREW_MARKS, "")).otherwise(latin)
    full = trimmed(without(bare, ".,;:_\"“”()[]"))
    plain = F.btrim(without(F.lower(token), ".,;:_\"()[]"), F.lit("\t\n\v\f\r "))  # of ASCII alone, most tokens of most texts
    return F.when(F.length(token) == F.octet_length(token), plain).otherwise(full)


def tokenize(name: Column) -> Column:
    """The parts of a name between white space and Arabic commas; null gives no parts."""
    return F.filter(F.split(F.coalesce(name, F.lit("")), f"[{SPACES}\\u060C\\u061B]+"), lambda x: x != "")


def known_name(token: Column, spellings: dict[str, str] | None = None) -> Column:
    """The common name that a token spells, or null; ``spellings`` maps normal forms to names, the lexicon's by default."""
    return F.try_element_at(lx.map_of(spellings or lx.known_spellings()), without(normalize_token(token), MARKS + " "))


def known_label(name: Column) -> Column:
    """How a common name is shown."""
    return F.initcap(name)


def first_vowel(token: Column) -> Column:
    """The group of a Latin token's first vowel: a, i or u; else null."""
    vowel = F.translate(F.regexp_extract(normalize_token(token), "[aeiou]", 0), "eo", "iu")
    return F.when((detect_script(token) == "latin") & (vowel != ""), vowel)


def skeleton(token: Column) -> Column:
    """struct<full, cons, weak>: sound classes, the consonants among them, and which of those are uncertain.

    Letter groups are read before letters, runs of a class are one, vowels drop, and w or y count only at the start.
    """

    def plain(x: Column) -> Column:
        hebrew, latin = without(F.translate(x.text, "'’", lx.GERESH * 2), "-`ʿʼ"), F.translate(x.text, MARKS, "'" * len(MARKS))
        return F.when(x.script == "hebrew", hebrew).when(x.script == "latin", latin).otherwise(without(x.text, MARKS))

    text = let(F.struct(detect_script(token).alias("script"), normalize_token(token).alias("text")), plain)
    groups = "|".join(lx.LATIN_PAIRS) + "|[" + "".join(lx.HEBREW_GERESH) + "]" + lx.GERESH + "|."
    units = F.regexp_extract_all(text, F.lit(groups), F.lit(0))
    classes = lx.map_of(lx.unit_classes())

    def classed(us: Column) -> Column:
        last = F.size(us) - 1
        return F.transform(us, lambda u, i: F.struct(F.try_element_at(classes, u).alias("c"), ((u == "ch") | ((i == last) & u.isin("h", "ה"))).alias("w")))

    none = F.array().cast("array<struct<c:string,w:boolean>>")

    def collapse(acc: Column, x: Column) -> Column:
        end = F.try_element_at(acc, F.lit(-1))
        merged = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x.c.alias("c"), (x.w | end.w).alias("w"))))
        return F.when(end.c == x.c, merged).otherwise(F.concat(acc, F.array(x)))

    runs = F.aggregate(F.filter(let(units, classed), lambda x: x.c.isNotNull()), none, collapse)

    def reduced(r: Column) -> Column:
        cons = F.filter(r, lambda x, i: (x.c != "A") & (~x.c.isin("W", "Y") | (i == 0)))
        return F.struct(F.array_join(F.transform(r, lambda x: x.c), "").alias("full"), F.array_join(F.transform(cons, lambda x: x.c), "").alias("cons"), F.transform(cons, lambda x: x.w).alias("weak"))

    return let(runs, reduced)
