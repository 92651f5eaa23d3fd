"""Machine-readable zones of travel documents: check digits, parsing and building, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: SQL text for the value of each ASCII character by its code, null if it has none.
VALUES = "array(" + ", ".join("0" if c == "<" else str(ALPHABET.index(c)) if c in ALPHABET else "null" for c in map(chr, range(128))) + ")"
# Start (from 0) and length of each field by line; a digit field holds its own check digit.
TD3 = {"documentCode": (0, 0, 2), "issuingState": (0, 2, 3), "name": (0, 5, 39), "documentNumber": (1, 0, 9), "nationality": (1, 10, 3), "dob": (1, 13, 6), "sex": (1, 20, 1), "expiry": (1, 21, 6), "personalNumber": (1, 28, 14)}
TD1 = {"documentCode": (0, 0, 2), "issuingState": (0, 2, 3), "name": (2, 0, 30), "documentNumber": (0, 5, 9), "nationality": (1, 15, 3), "dob": (1, 0, 6), "sex": (1, 7, 1), "expiry": (1, 8, 6), "personalNumber": (0, 15, 15)}
TD3_CHECKS = {"documentNumber": ([(1, 0, 9)], (1, 9)), "dob": ([(1, 13, 6)], (1, 19)), "expiry": ([(1, 21, 6)], (1, 27)), "personalNumber": ([(1, 28, 14)], (1, 42)), "composite": ([(1, 0, 10), (1, 13, 7), (1, 21, 22)], (1, 43))}
TD1_CHECKS = {"documentNumber": ([(0, 5, 9)], (0, 14)), "dob": ([(1, 0, 6)], (1, 6)), "expiry": ([(1, 8, 6)], (1, 14)), "composite": ([(0, 5, 25), (1, 0, 7), (1, 8, 7), (1, 18, 11)], (1, 29))}


def check_digit(text: Column) -> Column:
    """Weighted sum modulo 10 as text; null if a character has no value."""

    def of(t: Column) -> Column:
        value = lambda c: F.get(F.expr(VALUES), F.ascii(c))
        weight = lambda k: F.element_at(F.array(F.lit(1), F.lit(7), F.lit(3)), k % 3 + 1)
        total = F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda s, k: s + value(F.substring(t, k, F.lit(1))) * weight(k))
        return F.when(F.length(t) > 0, (total % 10).cast("string")).otherwise(F.lit("0"))

    return let(text, of)


def zone_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.upper(F.coalesce(text, F.lit(""))), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)\s+", "")), lambda x: x != "")


def iso_from(yymmdd: Column, year: int | None) -> Column:
    """YYYY-MM-DD if six digits with a month and day in range; ``year``: a later birth year is of the century before."""
    full = F.lit(2000) + F.substring(yymmdd, 1, 2).cast("int")
    full = F.when(full > year, full - 100).otherwise(full) if year is not None else full
    month, day = F.substring(yymmdd, 3, 2), F.substring(yymmdd, 5, 2)
    good = yymmdd.rlike("^[0-9]{6}$") & month.between("01", "12") & day.between("01", "31")
    return F.when(good, F.concat_ws("-", full.cast("string"), month, day))


def name_of(field: Column) -> Column:
    """struct<surname, givenNames, full> of a name field."""
    def parts(x: Column) -> Column:
        two = F.split(F.regexp_replace(x, "<+$", ""), "<<", 2)
        clean = lambda c: F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "<", " "), " +", " "))
        surname, given = clean(F.get(two, F.lit(0))), clean(F.get(two, F.lit(1)))
        return F.struct(surname.alias("surname"), given.alias("givenNames"), F.trim(F.concat_ws(" ", given, surname)).alias("full"))

    return let(field, parts)


def parse(text: Column, today_year: int) -> Column:
    """struct<ok, format, fields, checks, all_valid>; null for a blank zone, ok false for one that has no known form."""
    def of(lines: Column, layout: dict, checks: dict, form: str) -> Column:
        cut = lambda line, start, n: F.substring(F.get(lines, F.lit(line)), start + 1, n)
        plain = lambda f: F.translate(cut(*layout[f]), "<", "")
        fields = F.struct(*[plain(f).alias(f) for f in ("documentCode", "issuingState", "documentNumber", "nationality", "sex", "personalNumber")], iso_from(cut(*layout["dob"]), today_year).alias("dob"), iso_from(cut(*layout["expiry"]), None).alias("expiry"), name_of(cut(*layout["name"])).alias("name"))
        rows = []
        for field, (runs, (line, at)) in checks.items():
            value, stated = F.concat(*[cut(*r) for r in runs]), cut(line, at, 1)
            known = F.struct(F.lit(field).alias("field"), value.alias("value"), stated.alias("stated"), check_digit(value).alias("computed"))
            rows.append(let(known, lambda r: F.struct(r.field.alias("field"), r.value.alias("value"), r.stated.alias("stated"), r.computed.alias("computed"), F.coalesce(r.stated == r.computed, F.lit(False)).alias("valid"))))
        return let(F.array(*rows), lambda found: F.struct(F.lit(True).alias("ok"), F.lit(form).alias("format"), fields.alias("fields"), found.alias("checks"), F.forall(found, lambda c: c.valid).alias("all_valid")))

    def choose(lines: Column) -> Column:
        td3, td1 = of(lines, TD3, TD3_CHECKS, "TD3"), of(lines, TD1, TD1_CHECKS, "TD1")
        sized = lambda n, k: (F.size(lines) == n) & F.forall(lines, lambda x: F.length(x) == k)
        form = F.when(sized(2, 36), "TD2").otherwise(F.lit(None).cast("string"))
        none = F.struct(F.lit(False).alias("ok"), form.alias("format"), F.lit(None).alias("fields"), F.array().cast("array<struct<field:string,value:string,stated:string,computed:string,valid:boolean>>").alias("checks"), F.lit(False).alias("all_valid"))
        return F.when(F.size(lines) == 0, None).when(sized(2, 44), td3).when(sized(3, 30), td1).otherwise(none)

    return let(zone_lines(text), choose)


def fit(value: Column, length: int) -> Column:
    return F.rpad(F.substring(F.translate(F.upper(value), " -", "<<"), 1, length), length, "<")


def with_digit(value: Column) -> Column:
    return let(value, lambda v: F.concat(v, check_digit(v)))


def build_td1(code: Column, state: Column, surname: Column, given: Column, number: Column, nationality: Column, dob: Column, sex: Column, expiry: Column, first_optional: Column, second_optional: Column) -> Column:
    """Three lines of 30 with valid digits; dates as YYMMDD. Long fields are cut."""
    num, born, until = (with_digit(fit(c, n)) for c, n in ((number, 9), (dob, 6), (expiry, 6)))
    own, more = fit(first_optional, 15), fit(second_optional, 11)

    def lines(x: Column) -> Column:
        second = F.concat(x.born, fit(sex, 1), x.until, fit(nationality, 3), x.more)
        return F.concat(fit(code, 2), fit(state, 3), x.num, x.own, F.lit("\n"), second, check_digit(F.concat(x.num, x.own, x.born, x.until, x.more)), F.lit("\n"), fit(F.concat(surname, F.lit("<<"), given), 30))

    return let(F.struct(num.alias("num"), born.alias("born"), until.alias("until"), own.alias("own"), more.alias("more")), lines)


def build_td3(code: Column, state: Column, surname: Column, given: Column, number: Column, nationality: Column, dob: Column, sex: Column, expiry: Column, personal: Column) -> Column:
    """Two lines of 44 with valid digits; dates as YYMMDD. Long fields are cut."""
    first = F.concat(fit(code, 2), fit(state, 3), fit(F.concat(surname, F.lit("<<"), given), 39))
    num, born, until, own = (with_digit(fit(c, n)) for c, n in ((number, 9), (dob, 6), (expiry, 6), (personal, 14)))

    def lines(x: Column) -> Column:
        second = F.concat(x.num, fit(nationality, 3), x.born, fit(sex, 1), x.until, x.own)
        return F.concat(first, F.lit("\n"), second, check_digit(F.concat(x.num, x.born, x.until, x.own)))

    return let(F.struct(num.alias("num"), born.alias("born"), until.alias("until"), own.alias("own")), lines)
