"""The training-data operators as queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, html_text, langid, merkle, mixing, packing, pivot_dedup, runs, simhash, token_counts, toxicity, warc_zip
from .common import crc_of


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_of("doc_id") % 4 == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = crc_of("doc_id") % 5 == 0
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", crc_of("doc_id").alias("h"))
    return runs.digests(runs.with_runs(docs, key="h", rewrite=runs.looped), "doc_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(crc_of("doc_id") % 3 == 0, merkle.leaf(*told, lower))
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), merkle.leaf(*told, F.col("text")).alias("leaf"), altered.alias("altered"))
    found = merkle.manifest(leaves.withColumn("altered", F.coalesce("altered", "leaf")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("digest", "text_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_embedding_dedup, op3_token_counts, op4_nearest_neighbours, op5_toxicity, op6_html_text, op7_packing, op8_mixing, op9_warc, op10_simhash_dedup, op11_periodic_runs, op12_merkle_manifest, op13_exact_dedup, pipeline)
}

_leaf = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_up = "list_transform(range(0, len(hs), 8), lambda k: sha256(array_to_string(hs[k + 1:k + 8], '')))"

ORACLE_SQL = {
    "op2_embedding_dedup": """
        with recursive v as (select row_number() over () as r, vec_id, cast(embedding as double[]) as e from embeddings),
        fit as (select *, len(e) as n from v where vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x != 0)) > 0),
        ok as (select * from fit where n = (select n from fit group by n order by count(*) desc, n limit 1)),
        links as (select a.r as a, b.r as b from ok a join ok b on a.r != b.r and list_cosine_similarity(a.e, b.e) >= 0.95),
        reach as (select r, vec_id as least from ok union select b, least from reach join links on a = r)
        select vec_id, coalesce(n, 0) as n_links, coalesce(component, vec_id) as component_id, coalesce(vec_id = coalesce(component, vec_id), false) as kept
        from v left join (select a as r, count(*) as n from links group by a) using (r) left join (select r, min(least) as component from reach group by r) using (r)
    """,
    "op8_mixing": """
        with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size, md5('1:' || coalesce(cast(doc_id as varchar), '')) as draw from documents),
        s1 as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
        s2 as (select *, ([5, 2, 1])[place % 3 + 1] as weight, cast(sum(source_size) over () as bigint) as total, 3 * source_size as top from s1),
        s3 as (select *, cast(total - coalesce(sum(top) over (order by top / weight, place rows between unbounded preceding and 1 preceding), 0) as bigint)
            / cast(sum(weight) over (order by top / weight, place rows between current row and unbounded following) as bigint) as level from s2),
        s4 as (select *, max(case when level <= top / weight then level end) over () as final from s3),
        t as (select source, place, source_size, case when final is null then cast(top as double) else least(cast(top as double), final * weight) end as target,
            greatest(1, least(64, total // 4096)) as block, cast(greatest(1, ceil(source_size / 400000)) as bigint) as n_shards, total from s4),
        won as (select place, count(*) as quota from (select place, target, row_number() over (order by target / (2 * s + 1) desc, place) as r, seats
            from (select *, cast(round(total / block) as bigint) as seats from t), lateral (select unnest(range(seats)) as s)) where r <= seats and target > 0 group by place),
        p as (select d.doc_id, d.size, d.draw, t.place, cast(('0x' || draw[1:8]) as bigint) % n_shards as shard, source_size, target, block, coalesce(quota, 0) as quota
            from d join t on d.source is not distinct from t.source left join won on won.place = t.place),
        h as (select place, shard, cast(sum(size) as bigint) as shard_size, any_value(quota) as seats, any_value(block) as block from p group by place, shard),
        hw as (select place, shard, count(*) as quota from (select place, shard, shard_size, seats, row_number() over (partition by place order by shard_size / (2 * s + 1) desc, shard) as r
            from h, lateral (select unnest(range(seats)) as s)) where r <= seats and shard_size > 0 group by place, shard),
        w as (select h.*, least(coalesce(quota, 0) * block, 3 * shard_size) as words from h left join hw using (place, shard)),
        x as (select *, if(shard_size > 0, words // shard_size, 0) as whole, if(shard_size > 0, words % shard_size, 0) as rest from w),
        b as (select place, shard, block, rest, b, least(block, shard_size - b * block) as n from x, lateral (select unnest(range((shard_size - 1) // block + 1)) as b) where rest > 0),
        c as (select *, least(n, rest - coalesce(sum(n) over (partition by place, shard order by md5('1:' || place || ':' || shard || ':' || b), b rows between unbounded preceding and 1 preceding), 0)) as part from b),
        l as (select *, coalesce(sum(size) over (partition by place, shard order by draw, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as start, row_number() over () as id from p),
        o as (select l.id, sum(greatest(0, least(start + size, b * c.block + part) - greatest(start, b * c.block))) as more
            from l join c on l.place = c.place and l.shard = c.shard and c.part > 0 and b * c.block < start + size and b * c.block + part > start where size > 0 group by l.id)
        select doc_id, size, source_size, target, cast(whole * size + coalesce(more, 0) as bigint) as taken from l join x using (place, shard) left join o using (id)
    """,
    "op9_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
        d as (select page_id, octet_length(body) as n, sha1(body) as sha from p),
        f as (select sha, max(page_id) as first from d where n >= 1000 group by sha)
        select d.page_id, cast(n as bigint) as payload_bytes, d.sha as payload_digest,
               case when d.page_id < f.first or d.page_id is null and f.first is not null then 'revisit' else 'response' end as record_type,
               case when d.page_id < f.first or d.page_id is null then f.first end as refers_to
        from d left join f on d.sha = f.sha and d.n >= 1000
    """,
    "op12_merkle_manifest": f"""
        with recursive bits as (select b, list_reduce(range(8), lambda c, k: if(c % 2 = 1, xor(c // 2, 3988292384), c // 2), cast(b as bigint)) as v from range(256) t(b)), crcs as (select list(v order by b) as crc from bits),
        d as (select doc_id, lang, {_leaf('text')} as leaf, {_leaf(_lower)} as lowered,
            xor(list_reduce(list_transform(range(1, length(coalesce(cast(doc_id as varchar), '')) + 1), lambda k: ascii(cast(doc_id as varchar)[k])), lambda c, x: xor(c // 256, crc[cast(xor(c, x) % 256 as bigint) + 1]), cast(4294967295 as bigint)), 4294967295) as h from documents, crcs),
        r as (select *, if(h % 3 = 0, lowered, leaf) as altered, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, row_number() over () as id from d),
        lists as (select lang, 0 as l, list(leaf order by i) as hs from r group by lang),
        levels as (select * from lists union all select lang, l + 1, {_up} from levels where len(hs) > 1),
        tops as (select lang, hs[1] as subroot, row_number() over (order by lang nulls first) - 1 as i from levels where len(hs) = 1),
        over_ as (select 0 as l, list(subroot order by i) as hs from tops union all select l + 1, {_up} from over_ where len(hs) > 1),
        nodes as (select lang, l, unnest(hs) as h, generate_subscripts(hs, 1) - 1 as k from levels where len(hs) > 1),
        runs as (select lang, l, k // 8 as up, list(h order by k) as hs from nodes group by lang, l, up),
        over_nodes as (select l, unnest(hs) as h, generate_subscripts(hs, 1) - 1 as k from over_ where len(hs) > 1),
        over_runs as (select l, k // 8 as up, list(h order by k) as hs from over_nodes group by l, up),
        steps as (select id, r.lang, l, hs, (i // cast(pow(8, l) as bigint)) % 8 as slot from r join runs on r.lang is not distinct from runs.lang and up = i // cast(pow(8, l + 1) as bigint)
            union all select id, r.lang, l + 100, hs, (tops.i // cast(pow(8, l) as bigint)) % 8 from r join tops on r.lang is not distinct from tops.lang join over_runs on up = tops.i // cast(pow(8, l + 1) as bigint)),
        sides as (select id, list({{'a': array_to_string(hs[1:slot], ''), 'z': array_to_string(hs[slot + 2:8], '')}} order by l) as s from steps group by id),
        found as (select doc_id, leaf, subroot, (select hs[1] from over_ where len(hs) = 1) as root, sha256(coalesce(array_to_string(list_transform(s, lambda x: x.a || x.z), ''), '')) as proof_sha256,
            coalesce(list_reduce(s, lambda h, x: sha256(x.a || h || x.z), altered), altered) as folded_root from r join tops on r.lang is not distinct from tops.lang left join sides using (id))
        select *, folded_root = root as verified from found
    """,
    "op13_exact_dedup": """
        with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as plain from documents),
        g as (select *, first_value(doc_id) over (partition by plain order by n desc, doc_id nulls last) as keep_id, count(*) over (partition by plain) as group_size, row_number() over (partition by plain order by n desc, doc_id nulls last) as place from d)
        select doc_id, keep_id, group_size, place = 1 as kept, sha256(plain) as text_sha256 from g
    """,
}
