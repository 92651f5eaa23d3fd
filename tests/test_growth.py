"""What keeps queries from growing in the driver, in one task or by calls as tables grow."""

import random

from pyspark.sql import functions as F

from namelens.functions import mrz
from namelens.functions.address import check_address, locality
from namelens.operators import compare as cmp
from namelens.operators.names import name_scores
from namelens.operators.provenance import provenance_states
from namelens.operators.zones import add_zone_checks
from namelens.plans import people
from namelens.sources.shared import written
from namelens.streaming import screening as streams

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(str(r) for r in df.collect())


def test_written_tables_are_taken_for_as_large_as_they_are(spark):
    own, other = (written(spark.range(400_000).withColumn(c, F.repeat(F.lit("x"), 200)), "large") for c in "ab")
    assert "Broadcast" not in own.join(other, "id")._jdf.queryExecution().executedPlan().toString()


def test_zones_without_names_are_those_with_names_but_for_name_rows(spark):
    p = written(people.passports(spark, SF).limit(60), "few")
    with_names, without = (add_zone_checks(p, "2026-01-01", names=n).select("query_id", F.explode("zone_checks").alias("r")) for n in (True, False))
    assert rows_of(without) == rows_of(with_names.where("trim(r.field) != 'zone name'"))
    assert with_names.count() > without.count() > 60


def test_token_pairs_are_sought_only_where_shown(spark):
    rows = [("Omar Khalil", "Umar Chalil", True), ("Omar Khalil", "Umar Chalil", False), ("Omar", "Samira", False), (None, "x", False)]
    df = spark.createDataFrame(rows, "a string, b string, told boolean")
    some, every = ({(r.a, r.b): r for r in name_scores(df, rows=rows_).collect()} for rows_ in ("told", True))
    assert some[rows[0][:2]] == every[rows[0][:2]] and len(some[rows[0][:2]].pairs) == 2
    assert some["Omar", "Samira"].pairs is None and len(every["Omar", "Samira"].pairs) == 1
    assert {k: r.score for k, r in some.items()} == {k: r.score for k, r in every.items()}


def test_verdicts_without_token_pairs(spark):
    pairs = written(people.record_pairs(spark, SF).limit(30), "pairs")
    whole = cmp.compare(pairs, "2026-01-01")
    assert rows_of(cmp.compare(pairs, "2026-01-01", rows=False)) == rows_of(whole.drop("name_pairs"))


def test_fields_of_many_records_share_a_state(spark, tmp_path):
    """Blocks of records, ids beyond 2**53 beside null ones, and late events give the states of the batch form."""
    rng, kinds = random.Random(4), ["proposal", "edit", "clear", "confirm", "restore"]
    ids = [0, 1, 255, 256, 700, -3, 2**60 + 1, 2**60 + 2, None]
    rows = [(rng.choice(ids), rng.choice("ab"), rng.choice(["dob", "sex", None]), k, rng.choice(kinds), rng.choice(["x", "y", None]), rng.random() < 0.4, 1_700_000_000 + 60 * k) for k in range(600)]
    late = sorted(rows, key=lambda r: r[3] + rng.randrange(60))
    columns = "record_id long, side string, field string, seq long, event string, value string, validated boolean"
    timed = lambda part: spark.createDataFrame(part, f"{columns}, secs long").withColumn("at", F.timestamp_seconds("secs")).drop("secs")
    for k in range(0, 600, 200):
        timed(late[k : k + 200]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{columns}, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = streams.late_provenance_stream(stream, "2 hours")
    assert "block" in kept._jdf.queryExecution().analyzed().toString()
    streams.latest_states(kept, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("record_id", "side", "field").agg(F.max_by(F.struct("state", "value"), "batch").alias("s"))
    got = {(r.record_id, r.side, r.field): tuple(r.s) for r in last.collect()}
    assert got == {(r.record_id, r.side, r.field): (r.state, r.value) for r in provenance_states(timed(rows)).collect()}


def test_few_bytes_of_keys_are_dealt_in_parts_that_stay(spark):
    assert people.dealt(spark.range(1000), "id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_addresses_alone_equal_those_of_passports(spark):
    own = people.residents(spark, SF)
    assert "FileScan" in own._jdf.queryExecution().executedPlan().toString() and "zone" not in own.columns
    assert rows_of(own) == rows_of(people.zoned(spark, SF).drop("zone"))


def test_check_digits_of_any_character(spark):
    values = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")} | {"<": 0}
    texts = [chr(k) * 2 + "7A<" for k in range(1, 300)] + ["", "\U0001d400", "L898902C3", None]
    want = lambda t: None if any(c not in values for c in t or "") else str(sum(values[c] * (7, 3, 1)[i % 3] for i, c in enumerate(t or "")) % 10)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mrz.check_digit(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == {t: want(t) for t in texts}


def test_localities_are_sought_once_for_addresses_that_differ_in_numbers(spark, monkeypatch):
    rows = {}

    def noted(df, label):
        rows[label] = (out := written(df, label)).count()
        return out

    monkeypatch.setattr(cmp, "written", noted)
    cities = ("King St., Haifa", "Road, عمّان", "Flat B; Nazareth", None, "", "7")
    known = [(k, c and f"{k} {c}") for k, c in enumerate(cities * 20)]
    df = spark.createDataFrame(known, "query_id long, address string")
    got = cmp.with_locality(df, "address", "locality")
    assert rows_of(got) == rows_of(df.withColumn("locality", locality(F.col("address"))))
    assert rows["localities"] == 5  # no address and an empty one are the same; a number is not, as it leaves a blank
    pairs = df.withColumnRenamed("address", "address_a").withColumn("address_b", F.when(F.col("query_id") % 7 > 1, F.lit("4 King St Haifa")))
    want = pairs.withColumn("r", check_address(F.col("address_a"), F.col("address_b")).cast(cmp.CHECK))
    assert rows_of(cmp.with_address_check(pairs, "r").select(want.columns)) == rows_of(want)
    assert rows["address-pairs"] == 10
