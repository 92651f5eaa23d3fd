"""Golden cases of the matching library, and its queries against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from namelens.functions import checks as ck
from namelens.functions import mrz
from namelens.functions.address import check_address, locality
from namelens.functions.capture import captured
from namelens.functions.notes import wrap, write_notes
from namelens.functions.particles import name_tokens
from namelens.functions.text import skeleton
from namelens.operators.compare import compare
from namelens.operators.names import name_scores
from namelens.operators.provenance import provenance_states
from namelens.operators.screening import screen
from namelens.plans import queries as q
from namelens.plans import registry
from namelens.streaming.screening import advance, provenance_stream

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part documents events".split()


def test_skeletons(spark):
    want = {"محمد": "MHMD", "מוחמד": "MHMD", "Mohammad": "MHMD", "سيد": "SD", "Sayed": "SD", "Yousef": "YSF", "يوسف": "YSF", "Walid": "WLD", "إبراهيم": "BRHM", "Ebrahim": "BRHM", "مصطفى": "MSTF", "عمر": "MR", "ר׳אנם": "GNM", "غانم": "GNM"}
    rows = spark.createDataFrame([(w,) for w in want], "t string").select("t", skeleton(F.col("t")).cons.alias("c")).collect()
    assert {r.t: r.c for r in rows} == want


def test_particles(spark):
    want = {"Al-Sayed": ["sayed"], "السيد": ["سيد"], "Ash-Sharif": ["sharif"], "Mohammad Assayed": ["mohammad", "sayed"], "Mohammad Ali": ["mohammad", "ali"], "عبد الرحمن": ["عبدالرحمن"], "Abd al-Rahman": ["abdalrahman"], "Mohammad bin Ahmad": ["mohammad", "ahmad"], "": []}
    rows = spark.createDataFrame([(w,) for w in want], "n string").select("n", name_tokens(F.col("n")).tokens.alias("t")).collect()
    assert {r.n: r.t for r in rows} == want


def test_name_scores(spark):
    want = {("محمد أحمد السيد", "Muhammed Elsayed"): 96, ("Mohammad Al-Sayed", "Mohammad Al-Sharif"): 59, ("Mohammad Al-Sayed", "Mahmoud Al-Sayed"): 50, ("Mohammad Ali", "Ali Mohammad"): 100, ("Mohammad Ahmad Al-Sayed", "Mahmoud Ahmad Al-Sharif"): 27, ("Salem", "Islam"): 78, ("", "x"): 0, ("سيد", "Sayed"): 100}
    rows = name_scores(spark.createDataFrame(list(want), "a string, b string")).collect()
    assert {(r.a, r.b): r.score for r in rows} == want


def test_checks_and_zones(spark):
    zone = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    row = spark.range(1).select(
        mrz.parse(F.lit(zone), 2026).alias("m"), mrz.parse(F.lit("prose"), 2026).alias("p"), mrz.parse(F.lit(" "), 2026).alias("e"),
        *[ck.israeli_id_valid(F.lit(x)).alias(f"i{k}") for k, x in enumerate(("310256789", "310256788", "12345"))],
        ck.check_dob(F.lit("1994-03-07"), F.lit("1994-07-03")).alias("swap"), ck.check_dob(F.lit("2001-02-29"), F.lit("2000-02-29")).alias("bad"),
    ).first()
    assert (row.m.all_valid, row.m.fields.documentNumber, row.m.fields.dob, row.m.fields.name.full) == (True, "L898902C3", "1974-08-12", "ANNA MARIA ERIKSSON")
    assert (row.p.ok, row.e, row.i0, row.i1, row.i2) == (False, None, True, False, None)
    assert (row.swap.rules, row.bad.rules) == (["DOB-SWAP"], ["DATE-1"])


def test_screening(spark):
    entries = spark.createDataFrame([(0, "E1", "s", "sanction", "P", "Mohammad Abdullah Al-Farsi", [], "1975-06-20", "M", "SY"), (1, "E2", "s", "pep", "P", "Carl Unrelated", ["Mohammed Abdallah Alfarsi"], None, None, None), (2, "E3", "s", "sanction", "P", "Jon Doe", [], None, None, None)], "idx long, id string, source string, type string, program string, name string, aliases array<string>, dob string, sex string, nationality string")
    people = spark.createDataFrame([(7, "Mohammad Abdullah Al-Farsi", "1975-06-20", "M", "SY"), (8, "Jonathan Smith", None, None, None)], "query_id long, fullName string, dob string, sex string, nationality string")
    found = screen(people, entries).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.entry_id, r.classification, r.rules) for r in found] == [(7, 1, "E1", "STRONG", ["SCR-1", "SCR-2"]), (7, 2, "E2", "POTENTIAL", ["SCR-1", "SCR-5", "SCR-6"])]


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = q.QUERIES[name](spark, SF)
    cur = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


def test_capture_and_addresses(spark):
    zone = "noise\nP<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<KKKKKKKKK\nL898902C36UTO74O8122F12O4159ZE184226B<<<<<10\n"
    row = spark.range(1).select(
        captured(F.lit(zone), F.lit(None).cast("string"), 2026).alias("c"), captured(F.lit(""), F.lit("Born 7 MAR 94, until 2031"), 2026).alias("v"),
        locality(F.lit("12 King Street, Amman")).alias("l"), check_address(F.lit("شارع 5، عمان"), F.lit("Amman")).alias("same"), check_address(F.lit("Road 3"), F.lit("Amman")).alias("none"),
    ).first()
    got = {p.field: (p.value, p.validated) for p in row.c.proposals}
    assert (got["dob"], got["expiry"], got["docNumber"], got["fullName"]) == (("1974-08-12", True), ("2012-04-15", True), ("L898902C3", True), ("ANNA MARIA ERIKSSON", False))
    assert [(c["line"], c["pos"], c["from"], c["to"]) for c in row.c.zone.corrections] == [(2, 16, "O", "0"), (2, 24, "O", "0")]
    assert [(p.field, p.value, p.source) for p in row.v.proposals] == [("dob", "1994-03-07", "visual")]
    assert (row.l, row.same.status, row.none.rules) == ("King Amman", "ok", ["MISS-1"])


def test_verdicts_with_zones(spark):
    """Zones that agree, one held against a swapped birth date, one missing beside another name, and one that can't be read."""
    zone = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    fields = ["fullName", "dob", "expiry", "docNumber", "docType", "country", "sex", "mrz"]
    own = dict(zip(fields, ("Anna Maria Eriksson", "1974-08-12", "2012-04-15", "L898902C3", "passport", "UT", "F", zone), strict=True))
    cases = [(own, own), (own | {"dob": "1974-12-08"}, own), (own, own | {"fullName": "Jonathan Smith", "mrz": None}), (own, own | {"mrz": "prose"})]
    schema = "query_id long, " + ", ".join(f"{f}_{s} string" for s in "ab" for f in fields)
    pairs = spark.createDataFrame([(k, *[a[f] for f in fields], *[b[f] for f in fields]) for k, (a, b) in enumerate(cases)], schema)
    got = {r.query_id: r for r in compare(pairs, "2010-01-01").collect()}
    assert [(got[k].provisional_verdict, got[k].verdict, got[k].cap_rule) for k in range(4)] == [("MATCH", "MATCH", None), ("MATCH", "REFER", "CAP-1"), ("NO_MATCH", "NO_MATCH", None), ("MATCH", "REFER", "CAP-1")]
    assert [[s.rules for s in got[k].hard_stops] for k in range(4)] == [[], [["DOB-SWAP"], ["MRZ-3"]], [], [["MRZ-4"]]]
    zones = [(c.rules[0], c.status) for c in got[0].checks if c.rules[0].startswith("MRZ")]
    assert zones == [("MRZ-1", "ok"), ("MRZ-2", "ok"), ("MRZ-3", "ok"), ("MRZ-3", "ok")] * 2


def test_wrapped_notes(spark):
    text = "one two three  four"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(wrap(F.col("t"), width=9, hang=1).alias("w")).collect()
    assert [r.w for r in rows] == ["one two\n three\n four", "", ""]


EVENTS = "record_id long, side string, field string, seq long, event string, value string, validated boolean"


def test_field_states(spark):
    """The batch form equals the fold of single events, whatever their order; unknown events and null values do nothing."""
    random.seed(5)
    kinds = ["proposal", "edit", "clear", "confirm", "restore", "other"]
    rows = [(k % 60, "a", "dob", k, random.choice(kinds), random.choice(["x", "y", None]), random.random() < 0.4) for k in range(420)]
    want = {}
    for r in rows:
        want[r[0]] = advance(want.get(r[0], ("typed", "", None, False)), *r[4:])
    got = provenance_states(spark.createDataFrame(rows, EVENTS)).collect()
    assert {r.record_id: (r.state, r.value) for r in got} == {k: v[:2] for k, v in want.items()}
    assert provenance_states(spark.createDataFrame([], EVENTS)).count() == 0


def test_field_states_of_a_stream(spark, tmp_path):
    rows = [(1, "a", "dob", 1, "proposal", "x", False), (1, "a", "dob", 2, "confirm", None, None), (2, "b", "sex", 1, "edit", "M", None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    stream = provenance_stream(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.record_id, r.field, r.state, r.value) for r in spark.table("states").collect()} == {(1, "dob", "confirmed", "x"), (2, "sex", "typed", "M")}


def test_streamed_hits_equal_batch(spark):
    streamed = q.streamed_hits(spark, SF)
    want = q.screen_hits(spark, SF).select(streamed.columns)
    assert sorted(streamed.collect()) == sorted(want.collect())


def test_notes_are_narrow_and_written_as_text(spark, tmp_path):
    notes = q.case_notes(spark, SF).cache()
    texts = [r.note for r in notes.collect()]
    assert max(len(line) for t in texts for line in t.split("\n")) <= 76
    assert {t.split("\n")[0] for t in texts} == {f"Identity comparison: {v}" for v in ("MATCH", "REVIEW", "NO MATCH")}
    write_notes(notes, str(tmp_path / "notes"), folders=4)
    lines = [r.value for r in spark.read.text(str(tmp_path / "notes")).collect()]
    assert sorted("\n".join(lines).split("\n")) == sorted("\n".join(t + "\n" for t in texts).split("\n"))


def test_registry(spark):
    assert sum(map(len, registry.RULES.values())) == 56
    unknown = registry.cited(spark.createDataFrame([(["SCR-1", "NOPE"],)], "rules array<string>")).where("about is null").collect()
    assert [r.rule for r in unknown] == ["NOPE"]
    audited = {r.rule: (r.n, r.standing) for r in registry.audit(spark.createDataFrame([(["SCR-1", "NOPE", "SCR-1"],)], "rules array<string>")).collect()}
    assert len(audited) == 57 and (audited["SCR-1"], audited["NOPE"], audited["CAP-1"]) == ((2, "cited"), (1, "unregistered"), (0, "never cited"))


def test_every_rule_is_cited(spark):
    assert [r.rule for r in q.rules_cited(spark, "/root/testdata/sf0.01").where("standing != 'cited'").collect()] == []
