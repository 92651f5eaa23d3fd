"""Every rule that a result can cite, as a table, and the rules that results do cite held against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

# The ids of all rules by what they are about.
RULES = {
    "normal form": ("NORM-1", "ART-1", "ART-2", "JOIN-1", "PAT-1"),
    "token": ("LEX-1", "LEX-2", "SKEL-1", "SKEL-2", "SKEL-3", "CLS-1", "CLS-2", "LAT-1", "WEAK-1", "HEB-1", "HEB-2", "VOW-1"),
    "alignment": ("ORD-1", "TOK-1", "TOK-2"),
    "field": ("DOB-1", "DOB-SWAP", "DOB-2", "DOB-3", "DOB-4", "DATE-1", "EXP-1", "EXP-2", "EXP-3", "EXP-4", "ID-CHK", "FMT-1", "NUM-1", "NUM-2", "NUM-3", "NUM-4", "TYPE-1", "CTRY-1", "SEX-1", "ADDR-1", "MISS-1"),
    "travel zone": ("MRZ-1", "MRZ-2", "MRZ-3", "MRZ-4"),
    "provenance": ("OCR-1", "OCR-2"),
    "verdict": ("AGG-1", "CAP-1"),
    "screening": ("SCR-1", "SCR-2", "SCR-3", "SCR-4", "SCR-5", "SCR-6", "CRISK-1"),
}


def registry(spark: SparkSession) -> DataFrame:
    """(rule, about)."""
    return spark.createDataFrame([(r, about) for about, rules in RULES.items() for r in rules], "rule string, about string")


def cited(*rules: DataFrame) -> DataFrame:
    """(rule, about, n) for all rules in the first column, arrays of ids, of each frame; ``about`` is null if unknown."""
    spark = rules[0].sparkSession
    every = None
    for df in rules:
        one = df.select(F.explode(df.columns[0]).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
        every = one if every is None else every.union(one)
    return every.groupBy("rule").agg(F.sum("n").alias("n")).join(F.broadcast(registry(spark)), "rule", "left").select("rule", "about", "n")


def audit(*rules: DataFrame) -> DataFrame:
    """(rule, about, n, standing): every registered rule and every cited one, each held against the other.

    A rule is cited, never cited, or unregistered. Citations are counted before they meet the registry.
    """
    found = written(cited(*rules), "cited")
    known = registry(found.sparkSession)
    strange = found.where("about is null").withColumn("standing", F.lit("unregistered"))
    silent = known.join(found, "rule", "left_anti").select("rule", "about", F.lit(0).cast("long").alias("n"), F.lit("never cited").alias("standing"))
    return found.where("about is not null").withColumn("standing", F.lit("cited")).unionByName(strange).unionByName(silent)
