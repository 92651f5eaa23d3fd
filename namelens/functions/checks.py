"""Checks of single fields of two identity records, as Column functions. Each gives struct<field, status, rules, cap>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFER = "REFER"
#: By a check's rules and status: how its outcome is called, and why it came about. {a} and {b} are the records' values.
OUTCOMES = {
    ("DATE-1", "bad"): ("not a date", "{a} and {b} can't be compared, as one of them isn't a day of the calendar."),
    ("MISS-1", "info"): ("missing", "At least one record has no value to compare."),
    ("DOB-1,DOB-4", "info"): ("equal, first of January", "Both records have {a}, a day that often stands for an unknown one."),
    ("DOB-1", "ok"): ("equal", "Both records have {a}."),
    ("DOB-SWAP", "warn"): ("day and month swapped", "{a} and {b} are one date if day and month change places."),
    ("DOB-2", "warn"): ("same year", "{a} and {b} have only the year in common."),
    ("DOB-3", "bad"): ("different", "{a} and {b} are of different years."),
    ("EXP-1", "bad"): ("expired", "Of {a} and {b}, at least one lies before the day of evaluation."),
    ("EXP-4", "info"): ("different kinds", "{a} and {b} differ, which two kinds of documents may."),
    ("EXP-2", "warn"): ("different", "{a} and {b} differ on documents of one kind."),
    ("EXP-3", "info"): ("one date", "Only one record says when its document expires."),
    ("EXP-3", "ok"): ("equal", "Both documents are valid until {a}."),
    ("NUM-1", "ok"): ("equal", "Both records have the number {a}."),
    ("NUM-1,NUM-4", "ok"): ("one identity number", "Both documents carry the person's identity number {a}."),
    ("NUM-2,NUM-4", "warn"): ("two identity numbers", "Both documents carry an identity number, but {a} isn't {b}."),
    ("NUM-3", "info"): ("different kinds", "{a} and {b} are numbers of two kinds of documents."),
    ("NUM-2", "warn"): ("different", "{a} and {b} differ on documents of one kind."),
    ("ID-CHK", "ok"): ("check digit right", "The check digit of {a}{b} is right."),
    ("ID-CHK", "bad"): ("check digit wrong", "The check digit of {a}{b} is wrong."),
    ("ID-CHK,FMT-1", "warn"): ("not nine digits", "{a}{b} hasn't the nine digits of an identity number."),
    ("FMT-1", "warn"): ("unusual form", "{a}{b} hasn't the form of a passport number."),
    ("MRZ-4", "warn"): ("unreadable", "The travel zone can't be read."),
    ("MRZ-1", "ok"): ("digits right", "All check digits of the zone's fields are right."),
    ("MRZ-1", "bad"): ("digits wrong", "A check digit of a zone's field is wrong."),
    ("MRZ-2", "ok"): ("whole zone right", "The digit over the whole zone is right."),
    ("MRZ-2", "bad"): ("whole zone wrong", "The digit over the whole zone is wrong."),
    ("MRZ-3", "ok"): ("as printed", "The zone agrees with what is printed."),
    ("MRZ-3", "warn"): ("much as printed", "The zone's name is much like the printed one."),
    ("MRZ-3", "bad"): ("not as printed", "The zone differs from what is printed."),
    ("SEX-1", "ok"): ("equal", "Both records say {a}."),
    ("SEX-1", "bad"): ("different", "One record says {a}, the other {b}."),
    ("TYPE-1", "ok"): ("one kind", "Both documents are of the kind {a}."),
    ("TYPE-1", "info"): ("two kinds", "The documents are of the kinds {a} and {b}."),
    ("CTRY-1", "ok"): ("one country", "Both documents are from {a}."),
    ("CTRY-1", "warn"): ("two countries", "The documents are from {a} and {b}."),
    ("ADDR-1", "ok"): ("one place", "The places of {a} and {b} sound alike."),
    ("ADDR-1", "warn"): ("perhaps one place", "The places of {a} and {b} sound somewhat alike."),
    ("ADDR-1", "info"): ("two places", "The places of {a} and {b} don't sound alike."),
    ("OCR-2", "ok"): ("read and verified", "Values read by machine were verified by check digits."),
    ("OCR-1", "warn"): ("read, unconfirmed", "Values read by machine haven't been confirmed."),
}
FULL = "array<struct<field:string,a:string,b:string,status:string,label:string,rules:array<string>,reason:string,cap:string>>"


def full_rows(checks: Column, values: dict[str, tuple[Column, Column]]) -> Column:
    """Check rows with the records' values, how the outcome is called and why it came about; ``values`` by field."""
    outcomes = F.create_map(*[x for (rules, status), told in OUTCOMES.items() for x in (F.lit(f"{rules} {status}"), F.array(*map(F.lit, told)))])
    held = F.create_map(*[x for field, (a, b) in values.items() for x in (F.lit(field), F.array(*[F.coalesce(c, F.lit("")) for c in (a, b)]))])

    def whole(c: Column) -> Column:
        told, said = F.try_element_at(outcomes, F.concat_ws(" ", F.array_join(c.rules, ","), c.status)), F.try_element_at(held, c.field)
        a, b = (F.coalesce(F.get(said, F.lit(k)), F.lit("")) for k in (0, 1))
        reason = F.replace(F.replace(F.get(told, F.lit(1)), F.lit("{a}"), a), F.lit("{b}"), b)
        return F.struct(c.field.alias("field"), a.alias("a"), b.alias("b"), c.status.alias("status"), F.get(told, F.lit(0)).alias("label"), c.rules.alias("rules"), reason.alias("reason"), c.cap.alias("cap"))

    return F.transform(checks, whole).cast(FULL)



def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def iso_date(c: Column) -> Column:
    """The date as it stands if it is a calendar date in the form YYYY-MM-DD, else null."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), c)


def bad_date(c: Column) -> Column:
    return ~blank(c) & iso_date(c).isNull()


def row(field: str, status: str, rules: list[str], cap: str | None = None) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(status).alias("status"), F.array(*map(F.lit, rules)).alias("rules"), F.lit(cap).cast("string").alias("cap"))


def check_dob(a: Column, b: Column) -> Column:
    swapped = F.concat(F.substring(b, 1, 5), F.substring(b, 9, 2), F.lit("-"), F.substring(b, 6, 2))
    f = "dob"
    return (
        F.when(bad_date(a) | bad_date(b), row(f, "bad", ["DATE-1"], REFER))
        .when(blank(a) | blank(b), row(f, "info", ["MISS-1"], REFER))
        .when((a == b) & (F.substring(a, 6, 5) == "01-01"), row(f, "info", ["DOB-1", "DOB-4"]))
        .when(a == b, row(f, "ok", ["DOB-1"]))
        .when(a == swapped, row(f, "warn", ["DOB-SWAP"], REFER))
        .when(F.substring(a, 1, 4) == F.substring(b, 1, 4), row(f, "warn", ["DOB-2"], REFER))
        .otherwise(row(f, "bad", ["DOB-3"], REFER))
    )


def check_expiry(a: Column, b: Column, type_a: Column, type_b: Column, today: str) -> Column:
    f, other = "expiry", F.coalesce(type_a, F.lit("")) != F.coalesce(type_b, F.lit(""))
    past = lambda c: F.coalesce(~blank(c) & (c < today), F.lit(False))
    return (
        F.when(bad_date(a) | bad_date(b), row(f, "bad", ["DATE-1"], REFER))
        .when(blank(a) & blank(b), row(f, "info", ["MISS-1"]))
        .when(past(a) | past(b), row(f, "bad", ["EXP-1"], REFER))
        .when(~blank(a) & ~blank(b) & (a != b) & other, row(f, "info", ["EXP-4"]))
        .when(~blank(a) & ~blank(b) & (a != b), row(f, "warn", ["EXP-2"], REFER))
        .when(blank(a) | blank(b), row(f, "info", ["EXP-3"]))
        .otherwise(row(f, "ok", ["EXP-3"]))
    )


def israeli_id_valid(number: Column) -> Column:
    """Whether nine digits have the right check digit; null if there aren't nine."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    doubled = lambda k: F.substring(digits, k, F.lit(1)).cast("int") * (F.lit(2) - k % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda s, k: s + F.when(doubled(k) > 9, doubled(k) - 9).otherwise(doubled(k)))
    return F.when(F.length(digits) == 9, total % 10 == 0)


def israeli_scheme(country: Column, kind: Column) -> Column:
    return (F.upper(F.trim(country)) == "IL") & kind.isin("national_id", "drivers_license")


def check_doc_number(a: Column, b: Column, type_a: Column, type_b: Column, country_a: Column, country_b: Column) -> Column:
    clean = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    f, x, y = "docNumber", clean(a), clean(b)
    differ = F.coalesce(type_a, F.lit("")) != F.coalesce(type_b, F.lit(""))
    shared = F.coalesce(differ & israeli_scheme(country_a, type_a) & israeli_scheme(country_b, type_b), F.lit(False))
    return (
        F.when((x == "") | (y == ""), row(f, "info", ["MISS-1"], REFER))
        .when((x == y) & shared, row(f, "ok", ["NUM-1", "NUM-4"]))
        .when(x == y, row(f, "ok", ["NUM-1"]))
        .when(shared, row(f, "warn", ["NUM-2", "NUM-4"], REFER))
        .when(differ, row(f, "info", ["NUM-3"]))
        .otherwise(row(f, "warn", ["NUM-2"], REFER))
    )


def validate_doc_number(number: Column, kind: Column, country: Column, side: str) -> Column:
    """A row for a number that has a form to hold it against, else null."""
    f, valid = f"docNumber {side}", israeli_id_valid(number)
    passport = F.upper(F.regexp_replace(number, r"\s", "")).rlike("^[A-Z0-9]{6,9}$")
    return (
        F.when(blank(number), None)
        .when(israeli_scheme(country, kind) & valid.isNull(), row(f, "warn", ["ID-CHK", "FMT-1"], REFER))
        .when(israeli_scheme(country, kind) & valid, row(f, "ok", ["ID-CHK"]))
        .when(israeli_scheme(country, kind), row(f, "bad", ["ID-CHK"], REFER))
        .when((kind == "passport") & ~passport, row(f, "warn", ["FMT-1"], REFER))
    )


def sex_of(c: Column) -> Column:
    first = F.substring(F.upper(F.trim(c)), 1, 1)
    return F.when(first.isin("M", "F"), first)


def check_sex(a: Column, b: Column) -> Column:
    return F.when(sex_of(a).isNull() | sex_of(b).isNull(), None).when(sex_of(a) == sex_of(b), row("sex", "ok", ["SEX-1"])).otherwise(row("sex", "bad", ["SEX-1"], REFER))


def check_type(a: Column, b: Column) -> Column:
    return F.when(blank(a) | blank(b), None).when(a == b, row("docType", "ok", ["TYPE-1"])).otherwise(row("docType", "info", ["TYPE-1"]))


def check_country(a: Column, b: Column) -> Column:
    code = lambda c: F.upper(F.trim(c))
    return F.when(blank(a) | blank(b), None).when(code(a) == code(b), row("country", "ok", ["CTRY-1"])).otherwise(row("country", "warn", ["CTRY-1"]))


def check_provenance(provenance: Column, side: str) -> Column:
    """Rows for the fields that were read by machine: validated ones agree, unconfirmed ones refer."""
    said = F.coalesce(F.map_values(provenance), F.array().cast("array<string>"))
    ok = F.when(F.array_contains(said, "mrz-validated"), row(f"provenance {side}", "ok", ["OCR-2"]))
    warn = F.when(F.array_contains(said, "ocr-unconfirmed"), row(f"provenance {side}", "warn", ["OCR-1"], REFER))
    return F.array_compact(F.array(ok, warn))
