"""Which persons the queries derive and compare."""

from namelens.plans import people


def test_pairs_differ_and_leave_no_one_out(spark):
    """Also where keys have gaps."""
    source = lambda spark, sf_dir: people.persons_of(spark.range(1, 2334).where("id % 7 != 3").toDF("c_custkey"))
    p = people.record_pairs(spark, "", source).cache()
    assert p.count() == p.select("query_id").distinct().count() == 2000
    assert p.select("fullName_a").distinct().count() > 1950 and p.select("fullName_a", "fullName_b").distinct().count() > 1950
    for differs in ("sex_a != sex_b and sex_a != '' and sex_b != ''", "docType_a != docType_b", "docType_a = docType_b", "expiry_a != expiry_b", "expiry_a = expiry_b", "fullName_a is null", "fullName_b is null", "docNumber_a = '12-X'"):
        assert p.where(differs).count() > 0, differs
    assert p.where("fullName_a = fullName_b").count() < 100


def test_places_count_rows_of_any_keys(spark):
    keys = [5, 7, 70_000, 70_001, 999_999_999, 0]
    got = {r.query_id: (r.place, r.total) for r in people.placed(spark.createDataFrame([(k,) for k in keys], "query_id long"), 1000).collect()}
    assert got == {k: (n, 6) for n, k in enumerate(sorted(keys))}
