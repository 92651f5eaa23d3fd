"""Persons and watchlist entries derived from the tables customer and supplier, whose own names carry no script."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import mrz
from ..functions.capture import MONTHS as MONTH_NUMBERS
from ..operators.zones import ALPHA_3
from ..sources.shared import small_parts, written

#: Invented names in three scripts.
NAMES = (
    "Mohammad Abdullah Al-Farsi", "محمد عبد الله الفارسي", "Muhammed Abdallah Elfarsi", "Samira Haddad", "سميرة حداد", "Karim Nasser Shadid",
    "Kareem Shadeed", "יוסף חליל", "Youssef Khaleel", "Omar bin Tariq Al-Qasim", "עומר קאסם", "Fatima Ali Al-Masri", "فاطمة علي المصري",
    "Walid Mansour", "وليد منصور", "Abd al-Rahman Kamal", "עבד אלרחמן כמאל", "Jonathan Smith", "Rachid Cherif", "رشيد شريف", "Mahmoud Ash-Sharif",
    "Layla Umm Salim", "Zainab Sayed", "زينب السيد", "Ibrahim Chalil", "Peter Novák", "José Núñez", "Ahmad Nasser", "חיים ברוך", "Abu Bakr Dandachi",
)
#: The same names spelled otherwise.
OTHERS = (
    "محمد عبد الله الفارسي", "Mohamed Abdallah Elfarsi", "מוחמד עבדאללה אלפארסי", "سميرة حداد", "Samirah Hadad", "Kareem Nasir Shadeed",
    "كريم شديد", "Yousef Khalil", "يوسف خليل", "Umar Tarek Qasim", "عمر قاسم", "فاطمة علي المصري", "Fatma Aly Elmasry",
    "Waleed Mansur", "Walid Mansoor", "עבד אלרחמן כמאל", "Abdulrahman Kamel", "Jonathon Smyth", "Rashid Sherif", "Rasheed Sharif", "محمود الشريف",
    "ليلى أم سالم", "زينب السيد", "Zaynab Elsayed", "ח׳ליל אבראהים", "Patar Novak", "Jose Nunez", "أَحْمَد ناصر", "Chaim Baruch", "ابو بكر دندشي",
)
#: The same names as a travel zone has them: family names and given names.
ZONE_FAMILY = ("ALFARSI", "ALFARSI", "ELFARSI", "HADDAD", "HADDAD", "SHADID", "SHADEED", "KHALIL", "KHALEEL", "ALQASIM", "QASEM", "ALMASRI", "ALMASRI", "MANSOUR", "MANSOUR", "KAMAL", "KAMAL", "SMITH", "CHERIF", "SHARIF", "ASHSHARIF", "UMM SALIM", "SAYED", "ELSAYED", "CHALIL", "NOVAK", "NUNEZ", "NASSER", "BARUCH", "DANDACHI")
ZONE_GIVEN = ("MOHAMMAD ABDULLAH", "MOHAMMAD ABDULLAH", "MUHAMMED ABDALLAH", "SAMIRA", "SAMIRA", "KARIM NASSER", "KAREEM", "YOUSEF", "YOUSSEF", "OMAR TARIQ", "OMAR", "FATIMA ALI", "FATIMA ALI", "WALID", "WALID", "ABDALRAHMAN", "ABDALRAHMAN", "JONATHAN", "RACHID", "RASHID", "MAHMOUD", "LAYLA", "ZAINAB", "ZAINAB", "IBRAHIM", "PETER", "JOSE", "AHMAD", "CHAIM", "ABU BAKR")
#: Syllables of invented family names, each in two Latin spellings, in Arabic and in Hebrew script.
SYLLABLES = (
    ("ba", "da", "fa", "gha", "kha", "ja", "ka", "la", "ma", "na", "ra", "sa", "ta", "za", "sha", "wa"),
    ("pa", "da", "pha", "gha", "ha", "ga", "qa", "la", "ma", "na", "ra", "tsa", "ta", "dha", "cha", "wa"),
    ("با", "دا", "فا", "غا", "خا", "جا", "كا", "لا", "ما", "نا", "را", "سا", "تا", "زا", "شا", "وا"),
    ("בא", "דא", "פא", "ר׳א", "חא", "גא", "קא", "לא", "מא", "נא", "רא", "סא", "טא", "זא", "שא", "וא"),
)
COUNTRIES = ("SY", "EG", "JO", "IL", "US", "FR", "IR")
STREETS = ("King St.", "شارع الملك", "Road", "Flat B")
CITIES = ("Haifa", "عمّان", "Nazareth", "Aleppo", "חיפה")
SURNAMES = ("AL FARSI", "HADDAD", "SHADID", "KHALIL", "MANSOUR")
GIVEN = ("MOHAMMAD", "SAMIRA", "KARIM NASSER", "YOUSSEF", "WALID")
MONTHS = tuple(MONTH_NUMBERS)
EVENTS = {"signup": "proposal", "error": "clear", "purchase": "confirm", "view": "edit", "click": "restore"}
RISK = (("SY", "high", ["list A", "list B"]), ("IR", "high", ["list A"]), ("EG", "medium", []))


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def date_of(n: Column) -> Column:
    """A date between 1950 and 1999, as text."""
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws("-", (1950 + n % 50).cast("string"), part(1 + n % 12), part(1 + n % 28))


def listed(values: tuple[str, ...], at: str, array: str = "element_at(array({}), cast({} as int))") -> str:
    """SQL text for one of ``values`` by a number from 1."""
    return array.format(", ".join("'" + v.replace("'", "''") + "'" for v in values), at)


def family_name(key: str, style: int, array: str = "element_at(array({}), cast({} as int))", div: str = "div") -> str:
    """SQL text for the family name of the person with a key: a syllable for each of its digits to base 16.

    With ``array`` and ``div`` of another engine it is that engine's text.
    """
    digit = lambda p: listed(SYLLABLES[style], f"({key} {div} {16**p}) % 16 + 1", array)
    parts = "concat(" + ", ".join([f"case when {key} >= {16**p} then {digit(p)} else '' end" for p in range(7, 0, -1)] + [digit(0)]) + ")"
    return parts if style >= 2 else f"concat(upper(substring({parts}, 1, 1)), substring({parts}, 2))"


def script_style(name: str, latin: int) -> int:
    return latin if name[0] < "\u0590" else 3 if name[0] < "\u0600" else 2


def name_text(key: str, names: tuple[str, ...], latin: int, array: str = "element_at(array({}), cast({} as int))", div: str = "div") -> str:
    """SQL text for the full name of the person with a key: one of ``names`` and a family name in its script."""
    by = {}
    for k, n in enumerate(names):
        by.setdefault(script_style(n, latin), []).append(str(k))
    family = " ".join(f"when {key} * 7 % {len(names)} in ({', '.join(ks)}) then {family_name(key, style, array, div)}" for style, ks in by.items())
    # Names with one of the same first parts all share block keys; most persons have an invented one that grows with the keys.
    own = f"concat({family_name(f'({key} * 31 + 4096)', latin, array, div)}, ' ', {family_name(f'({key} * 17 + 256)', latin, array, div)})"
    return f"case when {key} % 300 < 30 or {key} < 300 then concat({listed(names, f'{key} * 7 % {len(names)} + 1', array)}, ' ', case {family} end) else {own} end"


def number_of(k: Column) -> Column:
    return F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, fullName, dob, sex, nationality, docType, docNumber, expiry, country), dealt to all cores by key.

    The table is a file of few bytes for its rows, which Spark reads in one task; what is derived from a row is most of the work.
    """
    return persons_of(dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey"))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in two parts for each core, by their number, which adaptive execution leaves as it is, however few bytes keys have."""
    small_parts(rows.sparkSession)
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def screened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Persons and watchlist as tables, since screening reads both several times and their names are long expressions."""
    return written(persons(spark, sf_dir), "persons"), written(watchlist(spark, sf_dir), "watchlist")


def persons_of(customers: DataFrame) -> DataFrame:
    """As many names as persons, but for those without one or with a blank; some numbers aren't well formed."""
    k = F.col("c_custkey")
    c = customers.select("c_custkey")
    kind = pick(("passport", "national_id", "drivers_license"), k)
    name = F.when(k % 97 == 5, None).when(k % 97 == 6, " ").otherwise(F.expr(name_text("c_custkey", NAMES, 0)))
    return c.select(k.alias("query_id"), name.alias("fullName"), F.when(k % 11 != 0, date_of(k)).alias("dob"), pick(("M", "F", ""), k).alias("sex"), pick(COUNTRIES, k).alias("nationality"), kind.alias("docType"), F.when(k % 53 == 7, "12-X").otherwise(number_of(k)).alias("docNumber"), F.concat((2020 + k % 15).cast("string"), F.lit("-06-30")).alias("expiry"), pick(COUNTRIES, k).alias("country"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, id, source, type, program, name, aliases, dob, sex, nationality): every fifth person in another spelling.

    Some are listed under another name and have theirs as an alias.
    """
    k, n = F.col("s_suppkey"), F.col("s_suppkey") * 5
    s = dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey")
    own, other = F.expr(name_text("(s_suppkey * 5)", NAMES, 0)), F.expr(name_text("(s_suppkey * 5)", OTHERS, 1))
    hidden = k % 8 == 3
    aliases = F.array_compact(F.array(F.when(hidden, other), F.when(k % 3 == 0, own), F.when(k % 7 == 1, pick(NAMES, n + 2))))
    kind = F.when(k % 13 == 0, None).when(k % 12 == 0, "PEP").when(k % 4 == 0, "pep").otherwise("sanction")
    dob = F.when(k % 2 == 0, date_of(n)).when(k % 3 == 0, date_of(k * 3))
    return s.select(k.alias("idx"), F.concat(F.lit("E-"), k.cast("string")).alias("id"), F.lit("derived").alias("source"), kind.alias("type"), F.concat(F.lit("P"), (k % 5).cast("string")).alias("program"), F.when(hidden, pick(NAMES, k * 11)).otherwise(other).alias("name"), aliases.alias("aliases"), dob.alias("dob"), pick(("M", "F", ""), n + F.when(k % 4 == 1, 1).otherwise(0)).alias("sex"), F.when(k % 5 != 0, pick(COUNTRIES, n)).alias("nationality"))


def residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with an address."""
    k = F.col("query_id")
    return persons(spark, sf_dir).withColumn("address", F.concat((k % 90 + 1).cast("string"), F.lit(" "), pick(STREETS, k), F.lit(", "), pick(CITIES, k * 3)))


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with an address and a travel zone; in some the zone's number isn't the printed one."""
    k, p = F.col("query_id"), residents(spark, sf_dir)
    born = date_of(k)
    yymmdd = F.concat(F.substring(born, 3, 2), F.substring(born, 6, 2), F.substring(born, 9, 2))
    number = number_of(k + F.when(k % 10 == 3, 1).otherwise(0))
    land = F.coalesce(F.try_element_at(lx.map_of(ALPHA_3), F.col("country")), F.lit("UTO"))
    zone = mrz.build_td3(F.lit("P<"), F.lit("UTO"), F.concat(pick(ZONE_FAMILY, k * 7), F.lit(" "), F.upper(F.expr(family_name("query_id", 0)))), pick(ZONE_GIVEN, k * 7), number, land, yymmdd, F.col("sex"), F.concat(F.substring("expiry", 3, 2), F.lit("0630")), F.lit(""))
    return written(p.withColumn("zone", zone), "passports")


def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with an address and a column ``mrz``: in some a digit of the zone is wrong, or there is none."""
    k = F.col("query_id")
    wrong = F.concat(F.substring("zone", 1, 88), ((F.substring("zone", 89, 1).cast("int") + 1) % 10).cast("string"))
    mixed = F.when(k % 13 == 0, None).when(k % 10 == 9, "no zone here").when(k % 10 == 7, wrong).otherwise(F.col("zone"))
    return zoned(spark, sf_dir).withColumn("mrz", mixed).drop("zone")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, zone_text, page_text): passports as a recogniser might read them, letters for digits and filler lost."""
    p, k = zoned(spark, sf_dir), F.col("query_id")
    first, second = F.substring_index("zone", "\n", 1), F.substring_index("zone", "\n", -1)
    blurred = F.concat(F.rtrim(F.translate(first, "<", " ")), F.repeat(F.lit("K"), F.length(first) - F.length(F.rtrim(F.translate(first, "<", " ")))))
    blurred = F.regexp_replace(blurred, " ", "«")
    misread = F.concat(F.substring(second, 1, 13), F.translate(F.substring(second, 14, 6), "0158", "OISB"), F.substring(second, 20, 99))
    born, month = date_of(k), F.element_at(F.array(*map(F.lit, MONTHS)), (1 + k % 12).cast("int"))
    page = F.concat(F.lit("Born "), (1 + k % 28).cast("string"), F.lit(" "), month, F.lit(" "), F.substring(born, 1, 4), F.lit(" expires 30/06/"), F.substring("expiry", 3, 2), F.lit(" no. "), F.col("docNumber"))
    return p.select("query_id", F.concat(F.lit("utopia\n"), blurred, F.lit("\r\n"), misread, F.lit("\n")).alias("zone_text"), page.alias("page_text"))


def field_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, side, field, seq, event, value, validated) derived from the table events."""
    k, user = F.col("event_id"), F.col("user_id")
    kind = F.element_at(lx.map_of(EVENTS), F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(user.alias("record_id"), F.when(k % 2 == 0, "a").otherwise("b").alias("side"), pick(("dob", "fullName", "sex"), k).alias("field"), k.alias("seq"), kind.alias("event"), pick(("x", "y"), F.floor(k / 2)).alias("value"), (k % 5 < 2).alias("validated"))


#: How far on the person is with whom one is compared: numbers that share no factor with a field's period, and 30, which pairs
#: names that are equal but for their last parts.
STEPS = (30, 1, 7, 11, 13)


def placed(p: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """``p`` with the ``place`` of each query_id from 0 and their number ``total``; only the stretches' counts are summed in one order."""
    rows = p.withColumn("__stretch", F.floor(F.col("query_id") / stretch))
    counts = rows.groupBy("__stretch").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__stretch", before.alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("total"))
    own = F.row_number().over(Window.partitionBy("__stretch").orderBy("query_id"))
    return rows.join(counts, "__stretch").withColumn("place", F.col("__before") + own - 1).drop("__stretch", "__before")


def beside(p: DataFrame) -> DataFrame:
    """Each person beside one further on, by a step that the key picks; past the last one it goes on with the first.

    Columns of the first end in _a, of the second in _b.
    """
    k, found = F.col("query_id"), written(placed(p), "placed")
    step = F.element_at(F.array(*map(F.lit, STEPS)), (F.floor(k / 2) % len(STEPS) + 1).cast("int"))
    a = found.select("query_id", ((F.col("place") + step) % F.col("total")).alias("other"), *[F.col(c).alias(f"{c}_a") for c in p.columns[1:]])
    b = found.select(F.col("place").alias("other"), *[F.col(c).alias(f"{c}_b") for c in p.columns[1:]])
    return a.join(b, "other").drop("other")


def addressed(rows: DataFrame) -> DataFrame:
    """Pairs of ``beside`` in which some addresses of the second are the first's or shorter, if they have addresses."""
    if "address_b" not in rows.columns:
        return rows
    k, c = F.col("query_id"), F.col
    return rows.withColumn("address_b", F.when(k % 6 == 0, c("address_a")).when(k % 6 == 1, F.lit("7 Road")).when(k % 6 == 2, F.concat(F.lit("5, "), pick(CITIES, k * 3))).otherwise(c("address_b")))


def record_pairs(spark: SparkSession, sf_dir: str, source: Callable[[SparkSession, str], DataFrame] = persons) -> DataFrame:
    """Pairs of ``beside``. In every third the second has the first's name in another spelling, and in every sixth all it has.

    In some others a field of the second is the first's, a slip of it, malformed or missing.
    """
    k, c = F.col("query_id"), F.col
    rows = addressed(beside(source(spark, sf_dir)))
    clean = k % 6 == 0
    slip = lambda *cases: reduce(lambda w, case: w.when(*case), cases[1:], F.when(*cases[0]))
    year = F.substring("dob_a", 1, 4)
    first = F.concat(year, F.lit("-01-01"))
    swapped = F.concat(year, F.lit("-"), F.substring("dob_a", 9, 2), F.lit("-"), F.substring("dob_a", 6, 2))
    planted = {
        "fullName_b": slip((k % 97 == 5, c("fullName_b")), (k % 3 == 0, F.expr(name_text("query_id", OTHERS, 1)))).otherwise(c("fullName_b")),
        "dob_a": slip((~clean & (k % 8 == 3), first)).otherwise(c("dob_a")),
        "dob_b": slip((clean | (k % 8 == 0), c("dob_a")), (k % 8 == 1, swapped), (k % 8 == 2, F.concat(year, F.lit("-12-31"))), (k % 8 == 3, first), (k % 8 == 4, F.concat(year, F.lit("-02-30")))).otherwise(c("dob_b")),
        "expiry_a": slip((~clean & (k % 18 == 1), None)).otherwise(c("expiry_a")),
        "expiry_b": slip((clean | (k % 9 == 0), c("expiry_a")), (k % 9 == 1, None), (k % 9 == 2, F.lit("2030-13-01"))).otherwise(c("expiry_b")),
        "docNumber_b": slip((clean | (k % 7 == 0), c("docNumber_a")), (k % 7 == 1, F.when(k % 14 == 1, None).otherwise(""))).otherwise(c("docNumber_b")),
        "docType_b": slip((clean | (k % 4 == 1), c("docType_a"))).otherwise(c("docType_b")),
        "sex_b": slip((clean, c("sex_a"))).otherwise(c("sex_b")),
        "country_a": slip((~clean & (k % 4 == 0), F.lit("IL"))).otherwise(c("country_a")),
        "country_b": slip((clean, c("country_a")), (k % 4 == 0, F.lit("IL"))).otherwise(c("country_b")),
    }
    if "mrz_b" in rows.columns:
        planted["mrz_b"] = slip((clean, c("mrz_a"))).otherwise(c("mrz_b"))
        state = lambda *xs: F.create_map(*map(F.lit, xs))
        planted["provenance_a"] = slip((k % 5 == 0, state("dob", "mrz-validated")), (k % 5 == 1, state("dob", "ocr-unconfirmed")), (k % 5 == 2, state("dob", "confirmed")))
        planted["provenance_b"] = slip((k % 7 == 2, state("sex", "mrz-validated", "dob", "ocr-unconfirmed")))
    return rows.withColumns(planted)
