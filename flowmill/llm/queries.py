"""The operators over their whole tables, with the digests that are returned, and SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from flowmill.llm import compaction, decontaminate, embed_dedup, merkle, mixing, packing, pii, separator_scan, simhash, token_store, topk, toxicity, whitening
from flowmill.llm.common import documents, fresh, shared_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Arrivals that op4 appends before it compacts, and the size of its files. Production files are larger.
ARRIVALS = 8


def op1_mix_sources(spark, sf_dir):
    mix = mixing.plan_mix(documents(spark, sf_dir))
    return mix.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_topk_search(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


def op4_compaction(spark, sf_dir):
    docs = documents(spark, sf_dir)
    store = compaction.ShardStore(spark, shared_path(spark, "shards"))
    (arrival,) = fresh(docs.columns, "arrival")
    store.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), by=arrival)
    version = store.compact()
    store.vacuum(0)  # nobody else knows of this store
    return store.read(version).select("doc_id", F.lit(version).cast("long").alias("version"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), BYTES, end_id=0)


def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = toxicity.score_texts(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_personal_data(spark, sf_dir):
    return pii.find_personal(documents(spark, sf_dir))


def op8_token_store(spark, sf_dir):
    where = shared_path(spark, "store")
    token_store.write_store(documents(spark, sf_dir), where, WORDS, end_id=2)
    return token_store.read_store(spark, where).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_simhash_dedup(spark, sf_dir):
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_separator_scan(spark, sf_dir):
    where = shared_path(spark, "flat")
    separator_scan.write_flat(documents(spark, sf_dir), where, WORDS)
    return separator_scan.count_tokens(spark, where)


def op11_embedding_whitening(spark, sf_dir):
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))  # the column is a long: beyond its range, null


def op12_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_merkle_manifest(spark, sf_dir):
    """Tampering, in documents whose decimal id's CRC 7 divides, adds 1 to n_chars."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    ways = merkle.verify(documents(spark, sf_dir), changed={"n_chars": F.col("n_chars") + F.when(tampered, 1).otherwise(0)})
    return ways.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_embedding_dedup, op3_topk_search, op4_compaction, op5_best_fit_packing, op6_toxicity, op7_personal_data, op8_token_store, op9_simhash_dedup, op10_separator_scan, op11_embedding_whitening, op12_benchmark_decontamination, op13_merkle_manifest)}

_COIN = "cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / 4503599627370496.0"

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LEAF = "sha256(" + " || ".join("case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || cast({0} as varchar) end".format(c) for c in ("doc_id", "source", "lang", "({n})", "text")) + ")"
_CRC = "xor(4294967295, list_reduce([cast(4294967295 as bigint)] || list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"

SQL = {
    "op1_mix_sources": f"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
o as (select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
r as (select *, row_number() over (order by 3.0 * source_size / weight, source is null, source) as k from o),
p as (select *, sum(3 * source_size) over (order by k) - 3 * source_size as full_before, sum(weight) over (order by k desc) as weight_from,
      (select sum(source_size) from s) as total from r),
f as (select min(k) as k from p where not cast(weight as double) * cast(total - full_before as double) / cast(weight_from as double) > 3 * source_size),
l as (select total - full_before as rest, weight_from from p where k = (select k from f)),
t as (select source, cast(source_size as bigint) as source_size, case when cast(weight as double) * cast(rest as double) / cast(weight_from as double) > 3 * source_size
      then cast(3 * source_size as double) else cast(weight as double) * cast(rest as double) / cast(weight_from as double) end as target from o, l),
m as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(size * least(3, floor(rate) + case when {_COIN} < rate - floor(rate) then 1 else 0 end) as bigint) as taken from m""",
    "op3_topk_search": """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""",
    "op4_compaction": "select doc_id, cast(2 as bigint) as version, md5(coalesce(text, '')) as text_md5 from documents",
    "op12_benchmark_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
k as (select item, w, least(10, len(w)) as k from i where len(w) > 0),
iw as (select distinct item, k, array_to_string(w[a:a + k - 1], ' ') as g from (select item, w, k, unnest(range(1, len(w) - k + 2)) as a from k)),
dw as (select doc_id, a, k, array_to_string(w[a:a + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as a from d, (select distinct k from k) where len(w) >= k)),
m as (select doc_id, a, k, item from dw join iw using (k, g)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(a, a + k)) as p from m) group by doc_id),
x as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join x using (doc_id)""",
    "op13_merkle_manifest": f"""
with recursive d as (select doc_id, lang, {_LEAF.format(n="n_chars")} as leaf, {_LEAF.format(n=f"case when {_CRC} % 7 = 0 then n_chars + 1 else n_chars end")} as found from documents),
lv as (select lang, 0 as lvl, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, leaf as h, count(*) over (partition by lang) as n, doc_id, found from d
 union all select lang, lvl + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2, null, null from lv where n > 1 group by lang, lvl, idx // 2, n),
tv as (select 0 as lvl, row_number() over (order by lang nulls first) - 1 as idx, h, count(*) over () as n, lang, h as subroot from lv where n = 1
 union all select lvl + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2, null, null from tv where n > 1 group by lvl, idx // 2, n),
up as (select doc_id, lang, lvl, idx, h as leaf, found as folded, '' as sibs, n from lv where lvl = 0
 union all select u.doc_id, u.lang, u.lvl + 1, u.idx // 2, u.leaf, sha256(case when u.idx % 2 = 0 then u.folded || coalesce(s.h, '') else s.h || u.folded end), u.sibs || coalesce(s.h, ''), (u.n + 1) // 2
 from up u left join lv s on s.lang is not distinct from u.lang and s.lvl = u.lvl and s.idx = xor(u.idx, 1) where u.n > 1),
top as (select u.doc_id, u.leaf, t.subroot, 0 as lvl, t.idx, u.folded, u.sibs, t.n from up u join tv t on t.lvl = 0 and t.lang is not distinct from u.lang where u.n = 1
 union all select u.doc_id, u.leaf, u.subroot, u.lvl + 1, u.idx // 2, sha256(case when u.idx % 2 = 0 then u.folded || coalesce(s.h, '') else s.h || u.folded end), u.sibs || coalesce(s.h, ''), (u.n + 1) // 2
 from top u left join tv s on s.lvl = u.lvl and s.idx = xor(u.idx, 1) where u.n > 1)
select doc_id, leaf, subroot, (select h from tv where n = 1) as root, sha256(sibs) as proof_sha256, folded as folded_root, folded = (select h from tv where n = 1) as verified from top where n = 1""",
}
