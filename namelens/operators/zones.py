"""A record's travel zone held against its own printed fields, its name included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import mrz
from ..functions.capture import ALPHA_2
from ..functions.checks import REFER, blank, row, sex_of
from ..functions.text import remembered
from ..sources.shared import written
from .names import name_scores

CHECKS = "array<struct<field:string,status:string,rules:array<string>,cap:string>>"
ALPHA_3 = {two: three for three, two in ALPHA_2.items() if len(two) == 2}


def zone_rows(zone: Column, record, name_score: Column, side: str) -> Column:
    """Check rows of a parsed ``zone``; ``record`` gives the record's column of a field name. Null zone: no rows."""
    found = lambda field, ok, rule: F.when(ok, row(f"{field} {side}", "ok", [rule])).otherwise(row(f"{field} {side}", "bad", [rule], REFER))
    single = F.filter(zone.checks, lambda c: c.field != "composite")
    whole = F.filter(zone.checks, lambda c: c.field == "composite")
    strip = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    f = zone.fields
    both = [
        (strip(f.documentNumber), strip(record("docNumber"))),
        (f.dob, record("dob")),
        (f.expiry, record("expiry")),
        (sex_of(f.sex), sex_of(record("sex"))),
        (strip(f.nationality), F.try_element_at(lx.map_of(ALPHA_3), record("country"))),
    ]
    given = lambda c: F.when(~blank(c), c)
    agree = F.array_compact(F.array(*[given(z) == given(p) for z, p in both]))
    printed = F.when(F.size(agree) > 0, found("zone against print", ~F.array_contains(agree, False), "MRZ-3"))
    name = f"zone name {side}"
    named = F.when(name_score >= 85, row(name, "ok", ["MRZ-3"])).when(name_score >= 60, row(name, "warn", ["MRZ-3"])).when(name_score.isNotNull(), row(name, "bad", ["MRZ-3"], REFER))
    digits = found("zone digits", F.forall(single, lambda c: c.valid), "MRZ-1")
    composite = found("zone composite", F.forall(whole, lambda c: c.valid), "MRZ-2")
    unread = F.array(row(f"zone {side}", "warn", ["MRZ-4"], REFER))
    rows = F.array_compact(F.array(digits, composite, printed, named))
    return F.when(zone.isNull(), F.array().cast(CHECKS)).when(~zone.ok, unread.cast(CHECKS)).otherwise(rows.cast(CHECKS))


zone_of = remembered(lambda column, year: mrz.parse(F.col(column), year))


def with_zones(records: DataFrame, today: str, suffix: str = "") -> DataFrame:
    """``records`` with their parsed zone as ``__zone`` and the name in it as ``__latin``, null if either name is missing."""
    parsed = records.withColumn(f"__zone{suffix}", zone_of(f"mrz{suffix}", int(today[:4])))
    full = F.col(f"__zone{suffix}.fields.name.full")
    return parsed.withColumn(f"__latin{suffix}", F.when(~blank(F.col(f"fullName{suffix}")) & (full != ""), full))


def scored_names(rows: DataFrame, pairs: list[tuple[str, str, str]], shown: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with a struct of a score for each (first, second, out); all distinct pairs of names are scored at once.

    Token pairs are sought for those whose ``out`` is in ``shown``.
    """
    both = [rows.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(out in shown).alias("shown")) for a, b, out in pairs]
    every = reduce(DataFrame.union, both).where("a is not null or b is not null")
    told = ["score", *(["pairs"] if shown else []), F.concat("rules_a", "rules_b").alias("rules"), "aggregated"]
    scores = written(name_scores(every, rows="shown" if shown else False).select("a", "b", F.struct(*told).alias("found")), "scores")
    for a, b, out in pairs:
        one = scores.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("found").alias(out))
        rows = rows.join(one, F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b")), "left").drop("__a", "__b")
    return rows


def add_zone_checks(records: DataFrame, today: str, suffix: str = "", side: str = "", out: str = "zone_checks", names: bool = True) -> DataFrame:
    """``records`` with the check rows of their column ``mrz``; every field's column ends in ``suffix``.

    Names are scored once for each distinct pair of a zone's name and a printed one. A record without a zone has no
    rows, one whose zone can't be read has MRZ-4 alone, and one without a printed name has no name row. Without
    ``names`` no name is scored and there are no name rows.
    """
    scored, score = written(with_zones(records, today, suffix), "zones"), F.lit(None).cast("int")
    if names:
        scored = scored_names(scored, [(f"__latin{suffix}", f"fullName{suffix}", "__name")])
        score = F.when(F.col(f"__latin{suffix}").isNotNull(), F.col("__name.score"))
    return scored.withColumn(out, zone_rows(F.col(f"__zone{suffix}"), lambda field: F.col(f"{field}{suffix}"), score, side)).select(*records.columns, out)
