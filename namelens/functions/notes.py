"""Plain-text notes of results, no wider than a width, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicon import map_of
from .checks import sex_of
from .text import let

WIDTH = 76


def wrap(text: Column, indent: str = "", width: int = WIDTH, hang: int = 0) -> Column:
    """Words filled into lines; lines after the first are indented by ``hang`` more. A longer word has its own line."""
    more = indent + " " * hang
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def put(acc: Column, w: Column) -> Column:
        margin = F.when(F.size(acc.done) == 0, len(indent)).otherwise(len(more))
        longer = F.concat(acc.line, F.lit(" "), w)
        begun = F.struct(acc.done.alias("done"), w.alias("line"))
        broken = F.struct(F.concat(acc.done, F.array(acc.line)).alias("done"), w.alias("line"))
        return F.when(acc.line == "", begun).when(margin + F.length(longer) > width, broken).otherwise(F.struct(acc.done.alias("done"), longer.alias("line")))

    def lines(f: Column) -> Column:
        every = F.when(f.line == "", f.done).otherwise(F.concat(f.done, F.array(f.line)))
        return F.array_join(F.transform(every, lambda x, i: F.concat(F.when(i == 0, indent).otherwise(more), x)), "\n")

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return let(F.aggregate(words, state, put), lines)


def edit_notes(notes: Column) -> Column:
    """The first four edits of a distance, and a sign that there are more."""
    return F.concat(F.array_join(F.slice(notes, 1, 4), ", "), F.when(F.size(notes) > 4, ", …").otherwise(""))


# How kinds of documents are shown.
DOCUMENTS = {"passport": "Passport", "national_id": "National ID", "residence_permit": "Residence permit", "drivers_license": "Driver's licence"}


def document_label(kind: Column) -> Column:
    """The shown form of a kind of document; another kind stands as it is, null is empty."""
    return F.coalesce(F.try_element_at(map_of(DOCUMENTS), kind), kind, F.lit(""))


def section(title: str, *lines: Column) -> Column:
    return F.concat_ws("\n", F.lit(title), F.lit("-" * 60), *lines)


#: By the first rule of a row of two names: why it scores as it does. {a} and {b} are the tokens, {e} the edits between them.
PAIR_REASONS = {
    "LEX-1": "{a} and {b} spell one common name.",
    "LEX-2": "{a} and {b} spell two common names.",
    "SKEL-1": "{a} and {b} have the same sounds.",
    "SKEL-2": "{a} and {b} sound alike but for {e}.",
    "SKEL-3": "{a} and {b} don't sound alike.",
    "TOK-1": "{a}{b} is a middle part of one name only.",
    "TOK-2": "{a}{b} is a first or last part of one name only.",
    "MISS-1": "There is nothing to compare.",
}
# How the states of machine-read fields are told.
STATES = {"mrz-validated": "read by machine and verified by check digits", "ocr-unconfirmed": "read by machine and not confirmed", "confirmed": "read by machine and confirmed by a person"}


def pair_reason(p: Column) -> Column:
    """Why a row of a name comparison scores as it does."""
    told = F.coalesce(F.try_element_at(map_of(PAIR_REASONS), F.get(p.rules, F.lit(0))), F.lit(""))
    filled = F.replace(F.replace(F.replace(told, F.lit("{a}"), p.a), F.lit("{b}"), p.b), F.lit("{e}"), edit_notes(p.notes))
    return F.concat(filled, F.when(F.array_contains(p.rules, "VOW-1"), " Their first vowels differ.").otherwise(""), F.when(F.array_contains(p.rules, "ORD-1"), " They stand at different places.").otherwise(""))


def record_text(side: str) -> Column:
    """A record in one line: its name and those of its other fields that it has. Its columns end in ``_a`` or ``_b``."""
    c = lambda field: F.col(f"{field}_{side}")
    given = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v))
    return F.concat_ws(", ", F.coalesce(F.nullif(F.trim(c("fullName")), F.lit("")), F.lit("(no name)")), given("born ", c("dob")), given("sex ", sex_of(c("sex"))), given("", document_label(c("docType"))), given("no. ", c("docNumber")), given("", c("country")))


def provenance_lines(side: str) -> Column:
    """A line for each state of a record's machine-read fields; null without such fields. From ``provenance_a`` or ``_b``."""
    held = F.col(f"provenance_{side}")
    fields = lambda state: F.array_sort(F.map_keys(F.map_filter(held, lambda k, v: v == state)))
    lines = [F.when(F.size(fields(s)) > 0, wrap(F.concat(F.lit(f"{side.upper()}: "), F.array_join(fields(s), ", "), F.lit(f" {told}")), indent="  ", hang=2)) for s, told in STATES.items()]
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def case_note(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, note): the note of each comparison in ``results`` of the record pairs in ``pairs``.

    It has the finding, both records, where machine-read values came from, what rewrote the names, every row of the name
    comparison and every check with its rules and reason, and what capped the verdict.
    """
    c, none = F.col, F.lit(None).cast("string")
    has = {"provenance_a", "provenance_b"} <= set(pairs.columns)
    fields = [f"{f}_{s}" for s in "ab" for f in ("fullName", "dob", "sex", "docType", "docNumber", "country", *(["provenance"] if has else []))]
    both = results.join(pairs.select("query_id", *fields), "query_id")
    word = F.when(c("verdict") == "MATCH", "MATCH").when(c("verdict") == "REFER", "REVIEW").otherwise("NO MATCH")
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    head = F.concat_ws("\n", F.concat(F.lit("Identity comparison: "), word), F.lit("=" * 60), F.concat(F.lit("Evaluated on "), c("evaluated_on"), F.lit("; match from "), number(c("thresholds.match")), F.lit(", review from "), number(c("thresholds.refer"))), F.concat(F.lit("Name score "), c("name_score").cast("string"), F.lit(" of 100")))
    who = [wrap(F.concat(F.lit(f"{s.upper()}: "), record_text(s)), hang=3) for s in "ab"]
    read = F.nullif(F.concat_ws("\n", *[provenance_lines(s) for s in "ab"]), F.lit("")) if has else none
    rules = lambda r: F.concat(F.lit("["), F.array_join(r, " "), F.lit("]"))
    score = lambda p: F.when(p.score.isNotNull(), F.concat(F.lit(", "), p.score.cast("string"))).otherwise("")
    row = lambda p: F.concat(wrap(F.concat(F.coalesce(F.nullif(p.a, F.lit("")), F.lit("-")), F.lit(" with "), F.coalesce(F.nullif(p.b, F.lit("")), F.lit("-")), F.when(p.role != "", F.concat(F.lit(" ("), p.role, score(p), F.lit(")"))).otherwise("")), indent="  ", hang=2), F.lit("\n"), wrap(F.concat(rules(p.rules), F.lit(" "), pair_reason(p)), indent="     "))
    names = F.array_join(F.transform("name_pairs", row), "\n")
    told = F.transform("checks", lambda k: F.concat(F.lit("  "), k.field, F.lit(": "), k.label, F.lit("\n"), wrap(F.concat(rules(k.rules), F.lit(" "), k.reason), indent="     ")))
    stops = F.array_join(F.transform("hard_stops", lambda k: F.concat(F.lit("  "), k.field, F.lit(" "), rules(k.rules))), "\n")
    capped = F.when(c("capped"), section("What lowered the verdict [CAP-1]", stops)).otherwise("No check lowered the verdict")
    optional = lambda title, body: F.when(body.isNotNull(), section(title, body))
    rewritten = F.when(F.size("name_rules") > 0, F.concat(F.lit("  "), rules(F.array_distinct("name_rules"))))
    note = F.concat_ws("\n\n", head, section("Finding", wrap(c("verdict_reason"))), section("Records", *who), optional("Machine-read values", read), optional("Rewritten names", rewritten), section("Names", F.concat(F.when(c("aggregated"), "  [AGG-1] given and family names weigh more than middle ones\n").otherwise(""), names)), section("Checks", F.array_join(told, "\n")), capped)
    return both.select("query_id", note.alias("note"))


def write_notes(notes: DataFrame, path: str, folders: int = 256) -> None:
    """Each note as text below ``path``, in a folder ``part=`` by a hash of its query_id; a blank line parts two notes."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(folders))
    notes.select(F.concat("note", F.lit("\n")).alias("value"), part.alias("part")).write.partitionBy("part").text(path)


def screening_note(name: Column, disposition: Column, hits: Column, risk: Column, today: str, hit: int) -> Column:
    """A screening's note. ``hits``: array of struct<rank, matched_name, name_score, classification, rules>."""
    head = F.concat_ws("\n", F.concat(F.lit("Watchlist screening: "), F.translate(disposition, "_", " ")), F.lit("=" * 60), F.lit(f"Evaluated on {today}; hits from {hit}"), wrap(F.concat(F.lit("Person: "), F.coalesce(name, F.lit("(no name)"))), hang=8))
    told = F.transform(hits, lambda h: wrap(F.concat(h["rank"].cast("string"), F.lit(". "), h.matched_name, F.lit(", "), h.name_score.cast("string"), F.lit(" of 100, "), h.classification, F.lit(" ["), F.array_join(h.rules, " "), F.lit("]")), indent="  ", hang=3))
    body = F.when(F.size(hits) > 0, F.array_join(told, "\n")).otherwise("  none [SCR-4]")
    return F.concat_ws("\n\n", head, section("Hits", body), F.when(risk.isNotNull(), F.concat(F.lit("Risk of the person's country: "), risk, F.lit(" [CRISK-1]"))))
