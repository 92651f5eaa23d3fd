"""Comparing two identity records: a name score, field checks that can only lower the verdict, and the rules cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as ck
from ..functions.address import bare, check_address, locality
from ..functions.text import remembered
from ..sources.shared import written
from .names import name_row
from .zones import scored_names, with_zones, zone_rows

VERDICTS = ("NO_MATCH", "REFER", "MATCH")
CHECK = "struct<field:string,status:string,rules:array<string>,cap:string>"


def thresholds(match: float | None = 85, refer: float | None = 60) -> tuple[float, float]:
    """Both thresholds; what isn't a number takes the default, and ``refer`` stays below ``match`` but not below 0."""
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    match, refer = match if number(match) else 85, refer if number(refer) else 60
    return match, refer if refer < match else max(0, match - 1)


def verdict_reason(provisional: Column, verdict: Column, score: Column, match: float, refer: float) -> Column:
    """One sentence on how the score meets the thresholds and one on what follows."""
    shown = lambda v: F.when(v == "NO_MATCH", "no match").when(v == "REFER", "review").otherwise("match")
    where = F.when(provisional == "MATCH", f"reaches {match:g}, from which names match.").when(provisional == "REFER", f"lies from {refer:g} up but below {match:g}.").otherwise(f"is below {refer:g}.")
    same = F.when(verdict == "MATCH", "No check speaks against one person.").when(verdict == "REFER", "Someone should look at the documents.").otherwise("The records are taken for two persons.")
    lowered = F.concat(F.lit("A check lowered the verdict from "), shown(provisional), F.lit(" to "), shown(verdict), F.lit("."))
    return F.concat(F.lit("The name score of "), score.cast("string"), F.lit(" "), where, F.lit(" "), F.when(verdict == provisional, same).otherwise(lowered))


address_row = remembered(lambda a, b: check_address(F.col(a), F.col(b)).cast(CHECK))


def with_locality(rows: DataFrame, address: str, out: str) -> DataFrame:
    """``rows`` with the locality of an address, sought once for all addresses that differ in numbers only."""
    told = rows.withColumn("__bare", bare(F.col(address)))
    found = written(told.select("__bare").distinct().withColumn(out, locality(F.col("__bare"))), "localities")
    return told.join(found, "__bare").drop("__bare")


def with_address_check(pairs: DataFrame, out: str) -> DataFrame:
    """``pairs`` with the check of address_a and address_b; each distinct pair of localities is compared once.

    Localities are sought once for all addresses that differ in numbers only. ``pairs`` are written, as they are read twice.
    """
    told = written(pairs.withColumn("__bare_a", bare(F.col("address_a"))).withColumn("__bare_b", bare(F.col("address_b"))), "addresses")
    both = written(told.select("__bare_a", "__bare_b").distinct(), "address-pairs")
    located = with_locality(with_locality(both, "__bare_a", "__at_a"), "__bare_b", "__at_b")
    checked = located.select("__at_a", "__at_b").distinct().withColumn(out, address_row("__at_a", "__at_b"))
    checked = written(located.join(checked, ["__at_a", "__at_b"]).drop("__at_a", "__at_b"), "address-checks")
    return told.join(checked, ["__bare_a", "__bare_b"]).drop("__bare_a", "__bare_b")


def compare(pairs: DataFrame, today: str, match: int = 85, refer: int = 60, rows: bool = True) -> DataFrame:
    """One row for each pair of records whose fields end in _a and _b, keyed by ``query_id``.

    Beside verdict and checks it holds the rows of the name comparison, the rules that rewrote the names' tokens, whether the
    score is a mean of several rows, the day and the thresholds. A check row has the records' values, its status and what that
    is called, its rules, why it came about, and its cap.

    ``address``, ``mrz`` (a travel zone) and ``provenance`` (a map of fields to states) are checked where both sides
    have the column. A check's cap lowers the verdict to REFER at most; every capped check is a hard stop, and CAP-1 is cited if one
    lowered the verdict. ``today`` is required: no clock is read. Without ``rows`` the names' token pairs aren't sought, and there
    is no column ``name_pairs``.
    """
    match, refer = thresholds(match, refer)
    c = F.col
    has = lambda field: {f"{field}_a", f"{field}_b"} <= set(pairs.columns)
    none = F.array().cast(f"array<{CHECK}>")
    sides = "ab" if has("mrz") else ""
    pairs = with_address_check(pairs, "__address") if has("address") else pairs
    shown = rows
    rows = written(with_zones(with_zones(pairs, today, "_a"), today, "_b"), "zones") if sides else pairs
    rows = scored_names(rows, [("fullName_a", "fullName_b", "__names"), *[(f"__latin_{s}", f"fullName_{s}", f"__name_{s}") for s in sides]], ("__names",) if shown else ())
    missing = F.array(name_row(F.lit(""), F.lit(""), F.lit(""), F.lit(None).cast("int"), F.array(F.lit("MISS-1")), F.array().cast("array<string>")))
    rows = rows.withColumn("name_score", F.coalesce("__names.score", F.lit(0)))
    rows = rows.withColumn("name_pairs", F.coalesce("__names.pairs", missing)) if shown else rows
    rows = rows.withColumn("name_rules", F.coalesce("__names.rules", F.array().cast("array<string>"))).withColumn("aggregated", F.coalesce("__names.aggregated", F.lit(False)))
    for side in "ab":
        score = F.when(c(f"__latin_{side}").isNotNull(), c(f"__name_{side}.score")) if sides else None
        found_rows = zone_rows(c(f"__zone_{side}"), lambda field, s=side: c(f"{field}_{s}"), score, side) if sides else none
        rows = rows.withColumn(f"__zone_rows_{side}", found_rows)
    found = [
        ck.check_dob(c("dob_a"), c("dob_b")),
        ck.check_expiry(c("expiry_a"), c("expiry_b"), c("docType_a"), c("docType_b"), today),
        ck.check_doc_number(c("docNumber_a"), c("docNumber_b"), c("docType_a"), c("docType_b"), c("country_a"), c("country_b")),
        ck.validate_doc_number(c("docNumber_a"), c("docType_a"), c("country_a"), "a"),
        ck.validate_doc_number(c("docNumber_b"), c("docType_b"), c("country_b"), "b"),
    ]
    after = [
        ck.check_sex(c("sex_a"), c("sex_b")),
        ck.check_type(c("docType_a"), c("docType_b")),
        ck.check_country(c("country_a"), c("country_b")),
        *([c("__address")] if has("address") else []),
    ]
    listed = lambda checks: F.array_compact(F.array(*[x.cast(CHECK) for x in checks]))
    read = [ck.check_provenance(c(f"provenance_{s}"), s).cast(f"array<{CHECK}>") for s in "ab"] if has("provenance") else []
    rows = rows.withColumn("checks", F.concat(listed(found), c("__zone_rows_a"), c("__zone_rows_b"), listed(after), *read))
    values = {f: (c(f"{f}_a"), c(f"{f}_b")) for f in ("dob", "expiry", "docNumber", "sex", "docType", "country", *(["address"] if has("address") else []))}
    values |= {"docNumber a": (c("docNumber_a"), F.lit("")), "docNumber b": (F.lit(""), c("docNumber_b"))}
    rows = rows.withColumn("checks", ck.full_rows(c("checks"), values))
    provisional = F.when(c("name_score") >= match, 2).when(c("name_score") >= refer, 1).otherwise(0)
    stops = F.transform(F.filter("checks", lambda x: x.cap.isNotNull()), lambda x: F.struct(x.field.alias("field"), x.rules.alias("rules")))
    rows = rows.withColumn("provisional", provisional).withColumn("hard_stops", stops)
    final = F.when(F.size("hard_stops") > 0, F.least(c("provisional"), F.lit(1))).otherwise(c("provisional"))
    name = lambda v: F.element_at(F.array(*map(F.lit, VERDICTS)), v + 1)
    capped = final < c("provisional")
    return rows.select("query_id", F.lit(today).alias("evaluated_on"), F.struct(F.lit(match).alias("match"), F.lit(refer).alias("refer")).alias("thresholds"), "name_score", *(["name_pairs"] if shown else []), "name_rules", "aggregated", "checks", "hard_stops", name(c("provisional")).alias("provisional_verdict"), name(final).alias("verdict"), capped.alias("capped"), F.when(capped, "CAP-1").alias("cap_rule"), verdict_reason(name(c("provisional")), name(final), c("name_score"), match, refer).alias("verdict_reason"))
