"""What is derived from small files is dealt to cores, and plans stay small."""

from pyspark.sql import functions as F

from namelens import lexicon as lx
from namelens.functions.text import known_name
from namelens.operators import screening
from namelens.plans import people

SF = "/root/testdata/sf0.1"


def test_rows_of_a_small_file_are_dealt_out(spark):
    for derived, plain in ((people.persons(spark, SF), people.persons_of(spark.read.parquet(f"{SF}/customer.parquet"))),):
        parts = derived.select("query_id", F.spark_partition_id().alias("part")).groupBy("part").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 0.8 * sum(r["count"] for r in parts)
        assert derived.exceptAll(plain).count() == 0 and derived.count() == plain.count()


def test_screened_tables_have_no_long_plans(spark):
    for table in people.screened(spark, "/root/testdata/sf0.001"):
        assert len(table._jdf.queryExecution().analyzed().toString()) < 2000


def test_fixed_maps_are_single_nodes(spark):
    told = {"a": "x, y=z", "'": "q", "׳": "r"}
    df = spark.createDataFrame([(k,) for k in (*told, "none", None)], "k string")
    assert [r.v for r in df.select(F.try_element_at(lx.map_of(told), "k").alias("v")).collect()] == [*told.values(), None, None]
    plan = df.select(known_name(F.col("k")).alias("n"))._jdf.queryExecution()
    assert plan.analyzed().toString().count("muhammad") < 20 and "str_to_map" not in plan.optimizedPlan().toString()


def test_hits_without_token_pairs(spark):
    tables = [spark.createDataFrame([(0, name, [], "1970-01-02", "M", None)], f"{key} long, {column} string, aliases array<string>, dob string, sex string, nationality string") for key, column, name in (("query_id", "fullName", "Karim Shadid"), ("idx", "name", "Kareem Shadeed"))]
    people, entries = tables[0].drop("aliases"), tables[1].withColumns({c: F.lit("x") for c in ("id", "source", "type", "program")})
    bare = screening.screen(people, entries, rows=False)
    assert "pairs" not in bare.columns and bare.collect() == screening.screen(people, entries).drop("pairs").collect() != []
