"""Addresses: the words that name a place, and the check of two of them by sound, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import row
from .distance import skeleton_distance
from .particles import name_tokens
from .text import SPACES, let, normalize_token, skeleton, without

# Words for kinds of streets and parts of buildings.
STREET_WORDS = ("st", "str", "street", "rd", "road", "ave", "avenue", "blvd", "boulevard", "apt", "flat", "floor", "po", "box", "רחוב", "רח", "שדרות", "شارع", "ش")


def bare(address: Column) -> Column:
    """The address without ASCII digits, commas and semicolons, which has the same locality; empty for null."""
    return F.regexp_replace(F.coalesce(address, F.lit("")), "[,،؛;]|[0-9]+", " ")


def locality(address: Column) -> Column:
    """The address without ASCII digits, commas, semicolons and street words; empty for null."""
    words = F.split(bare(address), f"[{SPACES}]+")

    def place(w: Column) -> Column:
        return let(without(normalize_token(w), "-'’."), lambda n: (n != "") & ~n.isin(*STREET_WORDS))

    return F.array_join(F.filter(words, place), " ")


def address_percent(a: Column, b: Column) -> Column:
    """How alike two localities sound, 0 to 100; two without a consonant are alike."""
    sound = lambda x: skeleton(F.array_join(name_tokens(x).tokens, ""))

    def score(s: Column) -> Column:
        longest = F.greatest(F.length(s.a.cons), F.length(s.b.cons), F.lit(1))
        far = skeleton_distance(s.a.cons, s.b.cons, s.a.weak, s.b.weak).cost / F.lit(4.0)
        part = F.when(s.a.cons == s.b.cons, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - far / longest))
        return F.floor(part * 100 + 0.5).cast("int")

    return let(F.struct(sound(a).alias("a"), sound(b).alias("b")), score)


def check_address(a: Column, b: Column) -> Column:
    """Alike from 80, to be looked at from 50; never a cap. A side without a locality is not compared."""

    def banded(p: Column) -> Column:
        f = "address"
        return F.when(p >= 80, row(f, "ok", ["ADDR-1"])).when(p >= 50, row(f, "warn", ["ADDR-1"])).otherwise(row(f, "info", ["ADDR-1"]))

    def of(x: Column) -> Column:
        return F.when((x.a == "") | (x.b == ""), row("address", "info", ["MISS-1"])).otherwise(let(address_percent(x.a, x.b), banded))

    return let(F.struct(locality(a).alias("a"), locality(b).alias("b")), of)
