"""Groups of documents whose texts are equal but for white space, however many copies a text has.

Copies are combined in three stages, each of which groups by the whole content and not by its digest alone: within a task,
before anything is shuffled; among the tasks of one salt; and among the salts. Only digests that stand in more than a
fixed share of all rows are salted, so at most ``SHARES`` contents with as many rows as there are salts reach the last stage,
and every other content is shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A digest in more than one of so many rows is salted, and what is known of it is broadcast: at most so many digests.
SHARES = 4096
#: Deleted before texts are compared.
BLANK = r"[\x20\x09-\x0D]+"


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def copies(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: Callable[[Column], Column] = sha256, shares: int = SHARES) -> DataFrame:
    """(``key``, keep_id, group_size, kept, digest) for each row of ``docs``.

    Of equal texts the row with the longest original text stays, then the smallest key, a null key last; rows that agree in
    both are repeated rows, of which one stays. A null text counts as empty, and all empty texts are one group. Columns
    besides these two are left alone; an empty table gives an empty table. ``digest`` gives binary and only says where
    contents meet: texts whose digests agree by chance are told apart by content.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.length(whole).alias("n_chars"), F.regexp_replace(whole, BLANK, "").alias("content"))
    rows = rows.select("id", "n_chars", digest(F.col("content")).alias("digest"), "content")
    place = [(-F.col("n_chars")).alias("longer"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")]
    thin = written(rows.select("id", "n_chars", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    counts = written(thin.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*place, "row")).alias("first")), "digest-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = F.broadcast(counts.where(F.col("n") * shares >= total + shares).select("digest", F.lit(True).alias("often")))
    salts = max(1, math.isqrt(docs.rdd.getNumPartitions()))

    salt = F.when(F.col("often"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    salted = rows.join(often, "digest", "left").select("digest", "content", *[c for c in ("id", "n_chars", "often")], salt.alias("salt"))
    merged = salted.groupBy("digest", "often", "salt", "content").agg(F.min(F.struct(*place)).alias("best"), F.count("*").alias("n"))
    merged = written(merged.select("digest", "often", F.when(F.col("often"), F.col("content")).alias("content"), "best", "n"), "salt-winners")
    seldom = merged.where("often is null").select("digest", "best", "n")
    hot = merged.where("often").groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n")).select("digest", "best", "n")
    winners = written(seldom.withColumn("often", F.lit(False)).union(hot.withColumn("often", F.lit(True))), "winners")

    alone, shared = winners, None
    if winners.count() != distinct:
        shared = winners.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest")
        alone = winners.join(shared, "digest", "left_anti")
    answers = alone.join(counts.select("digest", F.col("first.row").alias("first_row")), "digest")
    answers = written(answers.select("digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), "first_row", "often"), "answers")
    of_often = F.broadcast(answers.where("often").drop("often"))
    told = thin.join(of_often, "digest").unionByName(thin.join(of_often.select("digest"), "digest", "left_anti").join(answers.where("not often").drop("often"), "digest"))
    found = told.select("id", "keep_id", "group_size", (F.col("row") == F.col("first_row")).alias("kept"), "digest")
    if shared is not None:
        found = found.unionByName(by_content(rows.join(shared, "digest", "left_semi"), place))
    return found.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("digest"))


def by_content(rows: DataFrame, place: list[Column]) -> DataFrame:
    """The same for rows whose digests agree though their contents don't."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shared-digests")
    first = rows.groupBy("digest", "content").agg(F.min(F.struct(*place, "row")).alias("first"), F.count("*").alias("group_size"))
    return rows.join(first, ["digest", "content"]).select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")
