"""A corpus pipeline: each stage works on all that the one before it kept, written as Parquet in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.llm import langid, mixing, packing, set_join, toxicity
from namelens.llm.common import written

#: Mean log probability of a letter below which a text is of no known language.
LEAST_FIT = -6.0
#: Words of a shingle, bits of 64 in which fingerprints of near copies may differ, and the similarity of shingle sets from
#: which texts are near copies too.
WORDS, RADIUS, SIMILARITY = 5, 2, 0.8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half; the labels of ``sf_dir`` teach the model.

    Null and empty texts stay, as nothing in them is toxic. Repeated rows and rows with a null id are scored like any
    other, and all columns stay; an empty table gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, score_out="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names.

    Those without a letter go (null and empty texts too), and those whose letters none of these languages explains: a
    letter has a mean log probability of -2 in a text of its language, seldom under -4.5, and under -7 in others. A close
    call between two languages keeps a document. Rows with a null ``lang`` are judged by their text; if all are null, only
    texts without a letter go. Repeated rows and null ids are judged like any other, and all columns stay.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs, model, lang_out="__lang", score_out="__score", fit_out="__fit")
    known = f"__lang != '{langid.UNDETERMINED}' and __fit >= {LEAST_FIT}"
    return found.where("__fit is not null" if model.languages == [langid.UNDETERMINED] else known).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of several rows with that id, the least.

    A group is connected by fingerprints of five-word shingles that differ in two bits at most, and by shingle sets that
    are alike by 0.8 or more; no such link is missed. Rows without an id go if another row has their fingerprint's group; else all of them stay.
    Null and empty texts are one group. All columns stay; an empty table gives an empty table.
    """
    found = written(set_join.all_near_duplicates(docs, words=WORDS, radius=RADIUS, similarity=SIMILARITY), "groups")
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in docs.columns if c != "doc_id"]
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("row"))
    kept = kept.select(*["doc_id" if c == "doc_id" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    if not found.where("component_id is null").limit(1).count():
        return kept
    return kept.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them, repeats included; nulls, ties and empty tables as in ``mixed_documents``."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; nulls, repeated rows and empty tables as in ``pack``."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("simhash_dedup", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, language models and tokenizers can't be expressed in DuckDB's SQL; tests hold each stage
#: against brute force on small tables.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the table ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
