"""Seven published pairs of records with their known results, a published list, and known spellings."""

import pytest
from pyspark.sql import functions as F

from namelens import lexicon
from namelens.functions import mrz
from namelens.functions.notes import document_label, edit_notes, screening_note
from namelens.functions.text import known_label, known_name
from namelens.operators.compare import compare, thresholds
from namelens.operators.names import name_scores
from namelens.operators.provenance import provenance_maps, provenance_states
from namelens.operators.screening import block_keys, blocking_report, build_block_index, candidate_counts, dispositions, posting_bitmaps, screen, sweep
from namelens.sources import watchlist as wl

TODAY = "2026-07-21"
FIELDS = ["fullName", "dob", "sex", "docType", "docNumber", "expiry", "country", "address", "mrz"]
ID_ZONE = "I<ISR3102567891<<<<<<<<<<<<<<<\n9403073M3105146ISR<<<<<<<<<<<6\nALSAYED<<MOHAMMAD<AHMAD<<<<<<<"


def zone(state: str, surname: str) -> str:
    return f"P<{state}{surname}<<MOHAMMAD<AHMAD".ljust(44, "<") + f"\nM1234567<0{state}9403073M2908225<<<<<<<<<<<<<<06"


# The published cases.
LATIN = ("Mohammad Ahmad Al-Sayed", "1994-03-07", "M", "national_id", "310256789", "2031-05-14", "IL", "Umm al-Fahm", None)
ARABIC = ("محمد أحمد السيد", "1994-03-07", "M", "national_id", "310256789", "2031-05-14", "IL", "أم الفحم", None)
HEBREW = ("מוחמד אחמד אלסייד", "1994-03-07", "M", "national_id", "310256789", "2031-05-14", "IL", "אום אל-פחם", None)
PASSPORT = ("M1234567", "2029-08-22")
CASES = {
    "clean": (LATIN[:7] + ("12 Ha'Atzmaut St, Haifa", ID_ZONE), LATIN[:7] + ("12 Haatzmaut Street, Haifa", None)),
    "translit": (("محمد أحمد السيد", "1994-03-07", "M", "passport", *PASSPORT, "JO", "عمان، الأردن", zone("JOR", "ELSAYED")), ("Muhammed Elsayed", "1994-03-07", "M", "passport", *PASSPORT, "JO", "Amman, Jordan", None)),
    "dobswap": (HEBREW[:8] + (ID_ZONE,), LATIN[:1] + ("1994-07-03",) + LATIN[2:]),
    "arabhebrew": (ARABIC, HEBREW),
    "crossdoc": (ARABIC[:3] + ("passport", *PASSPORT, "IL", "أم الفحم", zone("ISR", "ALSAYED")), LATIN),
    "siblings": (("Samir Hassan", "1996-09-12", "M", "national_id", "204938278", "2030-04-18", "IL", "Nazareth", None), ("Samira Hassan", "1996-09-12", "F", "passport", "M8842317", "2029-11-02", "IL", "Nazareth", None)),
    "different": ((LATIN[0], "1994-03-07", "M", "passport", *PASSPORT, "JO", "Amman, Jordan", zone("JOR", "ALSAYED")), ("Mahmoud Ahmad Al-Sharif", "1991-11-22", "M", "passport", "K7781234", "2024-02-10", "JO", "Irbid, Jordan", None)),
}


def test_published_cases(spark):
    schema = "query_id long, " + ", ".join(f"{f}_{s} string" for s in "ab" for f in FIELDS)
    rows = spark.createDataFrame([(k, *a, *b) for k, (a, b) in enumerate(CASES.values())], schema)
    got = dict(zip(CASES, sorted(compare(rows, TODAY).collect(), key=lambda r: r.query_id), strict=True))
    verdicts = {k: r.verdict for k, r in got.items()}
    assert verdicts == {"clean": "MATCH", "translit": "MATCH", "dobswap": "REFER", "arabhebrew": "MATCH", "crossdoc": "MATCH", "siblings": verdicts["siblings"], "different": "NO_MATCH"}
    scores = {k: r.name_score for k, r in got.items()}
    assert scores["clean"] == scores["arabhebrew"] == scores["crossdoc"] == 100 and scores["translit"] >= 85 and scores["different"] <= 60
    stops = {k: [s.rules for s in r.hard_stops] for k, r in got.items()}
    assert ["DOB-SWAP"] in stops["dobswap"] and ["SEX-1"] in stops["siblings"] and verdicts["siblings"] != "MATCH"
    address = {k: next(c.status for c in r.checks if c.field == "address") for k, r in got.items()}
    assert address["arabhebrew"] == "ok"
    assert [c.rules for c in got["crossdoc"].checks if c.field == "docNumber"] == [["NUM-3"]]
    assert got["clean"].verdict_reason == "The name score of 100 reaches 85, from which names match. No check speaks against one person."
    assert got["dobswap"].verdict_reason.endswith("A check lowered the verdict from match to review.")


def test_thresholds():
    assert thresholds(None, "x") == (85, 60) and thresholds(50, 70) == (50, 49) and thresholds(0, 0) == (0, 0) and thresholds(90.5, True) == (90.5, 60)


def test_every_known_spelling(spark):
    spellings = lexicon.known_spellings()
    assert len(lexicon.KNOWN) == 39 and sum(len(s.split()) for s in lexicon.KNOWN.values()) == len(spellings) == 322
    odd = {"mohammmad": None, "mahmod": None, "fatmah": None, "nor": None, "Mahmud": "mahmoud", "O-mar": "omar", "": None}
    rows = spark.createDataFrame([(s,) for s in [*spellings, *odd]], "t string").select("t", known_name(F.col("t")).alias("k"), known_label(known_name(F.col("t"))).alias("label")).collect()
    assert {r.t: r.k for r in rows} == spellings | odd and {r.label for r in rows if r.t == "Mahmud"} == {"Mahmoud"}
    scores = {(r.a, r.b): r.score for r in name_scores(spark.createDataFrame([("Mahmud Haddad", "Muhammad Haddad"), ("Mahmud Haddad", "Mahmoud Haddad"), ("Nor Haddad", "Nour Haddad")], "a string, b string")).collect()}
    assert scores["Mahmud Haddad", "Muhammad Haddad"] < 60 and scores["Mahmud Haddad", "Mahmoud Haddad"] == 100


# Some of the published list.
LIST = [
    ("SYN-001", "sanction", "محمد عبدالله الفارسي", ["Mohammad Abdullah Al-Farsi", "Muhammad Abdallah Elfarisi", "מוחמד עבדאללה אלפארסי"], "1975-06-20", "M", "SY"),
    ("SYN-001B", "sanction", "محمد عبدالله الفارسي", ["Mohammad Abdullah Al-Farsi", "Mohammed A. Alfarsi"], None, None, None),
    ("SYN-005", "sanction", "فاطمة علي المصري", ["Fatima Ali Al-Masri", "Fatimah Aly Elmasry"], "1988-07-09", "F", "EG"),
    ("SYN-010", "sanction", "طارق منير العلي", ["Tarek Munir Al-Ali", "Tariq Muneer Elali"], "1980-08-08", "M", "SA"),
    ("SYN-101", "pep", "عبدالرحمن كمال الوزير", ["Abdulrahman Kamal Al-Wazir", "Abd al-Rahman Kamal Elwazir"], "1963-05-05", "M", "JO"),
    ("SYN-201", "sanction", "Victor Petrov", ["Viktor Petrov"], "1974-06-01", "M", "RU"),
    ("SYN-203", "sanction", "משה בן־דוד", ["Moshe Ben-David", "Moshe Bendavid"], "1965-09-19", "M", "IL"),
    ("SYN-211", "sanction", "Boris Volkov", ["Karim Shadid", "كريم شديد"], "1976-10-10", "M", "RU"),
]
PEOPLE = ["Mohammad Abdullah Al-Farsi", "Fatima Ali Al-Masri", "Karim Shadid", "محمد عبدالله الفارسي", "Tarek Munir Al-Ali", "Boris Volkov", None, ""]
ENTRY = "idx long, id string, source string, type string, program string, name string, aliases array<string>, dob string, sex string, nationality string"


def entries(spark, rows=LIST):
    return spark.createDataFrame([(k, r[0], "s", r[1], "p", *r[2:]) for k, r in enumerate(rows)], ENTRY)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(k, n, "1975-06-20", "M", "SY") for k, n in enumerate(PEOPLE)], "query_id long, fullName string, dob string, sex string, nationality string")


def test_blocking_finds_what_all_pairs_find(spark, people):
    listed = entries(spark)
    found = {how: sorted(screen(people, listed, blocking=how).collect(), key=str) for how in ("reference", "wide", "exhaustive")}
    assert found["reference"] == found["exhaustive"] == found["wide"]
    assert sorted(screen(people, listed, index=build_block_index(listed)).collect(), key=str) == found["reference"]
    first = [(r.entry_id, r.classification, r.rules) for r in sorted(found["reference"], key=lambda r: r["rank"]) if r.query_id == 0]
    assert first[0] == ("SYN-001", "STRONG", ["SCR-1", "SCR-2"]) and first[1][0] == "SYN-001B" and first[1][1] == "POTENTIAL"
    assert any("SCR-5" in r.rules and r.entry_id == "SYN-211" for r in found["reference"] if r.query_id == 2)
    told = {r.query_id: (r.disposition, r.reason) for r in dispositions(people, screen(people, listed)).collect()}
    assert told[0] == ("POTENTIAL_MATCH", "2 hits from 75: 1 corroborated, 1 potential") and told[6] == ("NO_MATCH", "no name or alias reached 75")
    assert told[4][1].endswith("; look at each before dismissing it")


def test_blocking_reduces_a_large_list(spark, people):
    filler = [(f"BIG-{k}", "sanction", f"Random Filler {k}", [], None, None, None) for k in range(5000)]
    listed = entries(spark, LIST + filler)
    index = build_block_index(listed)
    counts = {r.query_id: r.candidates for r in candidate_counts(people, posting_bitmaps(index)).collect()}
    assert 2 <= counts[0] < len(LIST + filler) / 20 and counts[6] == counts[7] == 0 and len(counts) == len(PEOPLE)
    keys = {}
    for r in index.collect():
        keys.setdefault(r.block_key, set()).add(r.idx)
    asked = spark.createDataFrame([(k, n) for k, n in enumerate(PEOPLE) if n], "query_id long, n string").select("query_id", F.explode(block_keys(F.col("n"))).alias("key"))
    want = {}
    for r in asked.collect():
        want.setdefault(r.query_id, set()).update(keys.get(r.key, ()))
    assert {k: len(v) for k, v in want.items()} == {k: n for k, n in counts.items() if k in want}
    assert max(r.bucket for r in posting_bitmaps(index.withColumn("idx", F.col("idx") + 100_000)).collect()) > 3


def test_csv_ingest(spark, tmp_path):
    rows = 'id,schema,name,aliases,birth_date,countries,sanctions,dataset\n1,Person,"Doe, ""J""\nX",A; B ;;A,1970-01-02;1971,sy;eg,S1;S2,d\n1,Person,Late,,,,,d\n2,Company,No,,,,,d\n3,, Kim ,' + ";".join(f"n{k}" for k in range(20)) + ",1970,,,d\n\n,Person,Blank one,,,,,d\n,Person,Blank two,,,,,d\n"
    (tmp_path / "s.csv").write_text(rows)
    (tmp_path / "p.csv").write_text("id,schema,name,aliases,birth_date,countries,sanctions,dataset\n3,Person,Kim,,,,,p\n4,Person,Lee,,,us,,p\n")
    loaded = wl.load_watchlist(spark, str(tmp_path / "s.csv"), str(tmp_path / "p.csv"))
    got = loaded.orderBy("idx").collect()
    assert [(r.idx, r.id, r.name, r.type, r.program, r.dob, r.nationality) for r in got] == [(0, "1", 'Doe, "J"\nX', "sanction", "S1", "1970-01-02", "SY"), (1, "3", "Kim", "sanction", "d", None, None), (2, "", "Blank one", "sanction", "d", None, None), (3, "4", "Lee", "pep", "p", None, "US")]
    assert got[0].aliases == ["A", "B", "A"] and len(got[1].aliases) == 12
    assert max(len(r.aliases) for r in wl.load_watchlist(spark, str(tmp_path / "s.csv"), most_aliases=None).collect()) == 20
    wl.write_entries(loaded, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    assert wl.chosen(loaded.limit(0), entries(spark)).count() == len(LIST)


def test_zones_of_three_lines(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    made = mrz.build_td1(*lit("I<", "ISR", "ALSAYED", "MOHAMMAD AHMAD", "310256789", "ISR", "940307", "M", "310514", "", ""))
    bad = F.regexp_replace(made, "940307", "940308")
    row = spark.range(1).select(made.alias("made"), mrz.parse(made, 2026).alias("m"), mrz.parse(bad, 2026).alias("b"), mrz.parse(F.lit("A" * 36 + "\n" + "B" * 36), 2026).alias("two")).first()
    assert row.made == ID_ZONE and row.m.all_valid and row.m.format == "TD1" and row.m.fields.name.full == "MOHAMMAD AHMAD ALSAYED"
    assert [c.field for c in row.b.checks if not c.valid] == ["dob", "composite"] and (row.two.ok, row.two.format) == (False, "TD2")


def test_notes_and_labels(spark):
    hits = F.array(F.struct(F.lit(1).alias("rank"), F.lit("Kim").alias("matched_name"), F.lit(90).alias("name_score"), F.lit("STRONG").alias("classification"), F.array(F.lit("SCR-1")).alias("rules")))
    row = spark.range(1).select(
        screening_note(F.lit("Kim"), F.lit("POTENTIAL_MATCH"), hits, F.lit("high"), TODAY, 75).alias("note"),
        edit_notes(F.array(*map(F.lit, "abcde"))).alias("five"), edit_notes(F.array(F.lit("a"))).alias("one"),
        document_label(F.lit("drivers_license")).alias("known"), document_label(F.lit("badge")).alias("other"), document_label(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert "1. Kim, 90 of 100, STRONG [SCR-1]" in row.note and "CRISK-1" in row.note and max(map(len, row.note.split("\n"))) <= 76
    assert (row.five, row.one, row.known, row.other, row.none) == ("a, b, c, d, …", "a", "Driver's licence", "badge", "")


def test_provenance_in_verdicts(spark):
    schema = "query_id long, " + ", ".join(f"{f}_{s} string" for s in "ab" for f in FIELDS[:-1]) + ", provenance_a map<string,string>, provenance_b map<string,string>"
    rows = [(k, *LATIN[:8], *LATIN[:8], {"dob": "mrz-validated"}, other) for k, other in enumerate([None, {"dob": "ocr-unconfirmed"}, {"dob": "confirmed"}])]
    got = {r.query_id: r for r in compare(spark.createDataFrame(rows, schema), TODAY).collect()}
    assert [got[k].verdict for k in range(3)] == ["MATCH", "REFER", "MATCH"]
    assert [[c.rules[0] for c in got[k].checks if c.rules[0].startswith("OCR")] for k in range(3)] == [["OCR-2"], ["OCR-2", "OCR-1"], ["OCR-2"]]


def test_provenance_maps(spark):
    rows = [(1, "a", "dob", 1, "proposal", "x", True), (1, "a", "sex", 1, "proposal", "M", False), (1, "a", "fullName", 1, "edit", "K", None), (1, "b", "dob", 1, "proposal", "x", True), (1, "b", "dob", 2, "edit", "y", None)]
    states = provenance_states(spark.createDataFrame(rows, "record_id long, side string, field string, seq long, event string, value string, validated boolean"))
    assert {(r.record_id, r.side): r.provenance for r in provenance_maps(states).collect()} == {(1, "a"): {"dob": "mrz-validated", "sex": "ocr-unconfirmed"}}
