"""Queries over datasets, findings (view C), records (view K) and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.operators import assess as a
from flowmill.operators import dataset as ds
from flowmill.operators import records as rc
from flowmill.operators import rules as ru

from flowmill.plans.views import C, K, P, evidence, findings, packets, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# datasets


@query("select doc_id, lang, source, quality, toxic from documents join labels using(doc_id)")
def features_labels_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return ds.labels_join(docs, table(spark, d, "labels"), "doc_id")


@query("select doc_id, 'no ground truth' reason from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'no features' from labels where doc_id not in (select doc_id from documents)")
def features_labels_rejected(spark, d):
    return ds.labels_rejected(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


_H = "(('0x'||substr(sha256('42'||chr(0)||user_id::varchar),1,8))::bigint::double*4294967296.0+('0x'||substr(sha256('42'||chr(0)||user_id::varchar),9,8))::bigint::double)/18446744073709551616.0"
_SPLIT = f"sx as (select *, case when {_H} < 0.7 then 'train' when {_H} < 0.7+0.15 then 'validation' else 'test' end split from events)"


def _split(spark, d):
    return table(spark, d, "events").withColumn("split", ds.grouped_split("user_id", "42", {"train": 0.7, "validation": 0.15, "test": 0.15}))


@query(f"with {_SPLIT} select distinct user_id, split from sx")
def grouped_split(spark, d):
    return _split(spark, d).select("user_id", "split").distinct()


@query(f"with {_SPLIT} select split, event_type, count(*) \"rows\", count(distinct user_id) \"groups\" from sx group by 1,2")
def dataset_summary(spark, d):
    return ds.dataset_summary(_split(spark, d), "split", "event_type", "user_id")


@query("select user_id, string_agg(distinct event_type, ',' order by event_type) splits, count(distinct event_type) n from events group by 1 having count(distinct event_type)>1")
def split_integrity(spark, d):
    return ds.split_integrity(table(spark, d, "events"), "user_id", "event_type")


@query(f"with {_SPLIT}, g as (select split, count(*) \"rows\", count(distinct event_type) classes, count(distinct user_id) \"groups\" from sx group by 1) select *, concat_ws('; ', case when classes<2 then 'fewer than two classes' end, case when \"groups\"<2 then 'fewer than two groups' end) problems, concat_ws('; ', case when \"rows\"<20 then 'few rows' end) shortages from g")
def dataset_audit(spark, d):
    return ds.dataset_audit(_split(spark, d), "split", "event_type", "user_id")


@query("select 'p_brand' field, p_brand as value, count(*) n from part group by 2 union all select 'p_type', p_type, count(*) from part group by 2 union all select 'p_size', p_size::varchar, count(*) from part group by 2")
def manifest_counts(spark, d):
    return ds.value_counts(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("select sum(('0x'||substr(sha256(o_custkey::varchar||'|'||o_orderkey::varchar||'|'||o_orderpriority||'|'||o_orderstatus),1,15))::hugeint)::varchar digest, count(*) \"rows\" from orders")
def dataset_fingerprint(spark, d):
    return ds.fingerprint(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("select doc_id, text, n_chars, lang, concat_ws('; ', case when trim(source)='' then 'source is empty' end, case when lang not in ('en','de','fr') then 'lang is not allowed' end, case when n_chars is null then 'n_chars is not finite' end) violations from documents")
def row_contract(spark, d):
    x = table(spark, d, "documents")
    return ds.row_contract(x, ["source"], ["n_chars"], {"lang": ["en", "de", "fr"]}).select("doc_id", "text", "n_chars", "lang", "violations")


@query("select event_id, user_id, event_type, case when event_id=min(event_id) over (partition by user_id, event_type) then 'accepted' else 'duplicate' end verdict from events")
def dedup_first_wins(spark, d):
    x = table(spark, d, "events").select("event_id", "user_id", "event_type").withColumn("k", F.concat_ws("|", "user_id", "event_type"))
    return ds.first_wins(x, "k", "event_id").drop("k")


@query("with h as (select doc_id, source, sha256(text) content_sha256, doc_id > min(doc_id) over (partition by sha256(text)) refused from documents) select doc_id, source, content_sha256, refused, case when not refused then count(*) filter (not refused) over (partition by source order by doc_id) end as version from h")
def content_dedup_version(spark, d):
    return ds.content_versions(table(spark, d, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text").drop("text")


@query("""with x as (select case o_orderstatus when 'F' then 'train' when 'O' then 'test' else 'validation' end split, case o_orderstatus when 'P' then 'only ' else '' end||o_orderpriority label, o_custkey key, case when o_orderkey%1000=7 then 'nan'::double else o_totalprice::double end v from orders),
c as (select * from (select split, label, count(*) n from x group by 1,2)), t as (select * from c where split='train'), s as (select (select coalesce(sum(n),0) from t) tr, (select coalesce(sum(n),0) from c where split='validation') va, (select coalesce(sum(n),0) from c where split='test') te, (select count(*) from t) k, (select string_agg(distinct label, ', ' order by label) from c where label not in (select label from t)) unseen, (select string_agg(label, ', ' order by label) from t where n<2) thin, (select count(distinct key) from x where split='train') g, exists(select 1 from x group by key having count(distinct split)>1) shared, exists(select 1 from x where not isfinite(v)) odd)
select 'problem' kind, 'a feature value is not finite' reason from s where odd union all select 'problem', 'the train split is empty' from s where tr=0 union all select 'problem', 'the validation split is empty' from s where va=0 union all select 'problem', 'the test split is empty' from s where te=0 union all select 'problem', 'fewer than two training classes' from s where k<2
union all select 'problem', 'classes never seen in training: '||unseen from s where unseen is not null union all select 'problem', 'groups in several splits' from s where shared union all select 'shortage', 'few training rows' from s where tr<8 union all select 'shortage', 'few validation or test rows' from s where va<4 or te<4 union all select 'shortage', 'a single training group' from s where g<2 union all select 'shortage', 'classes with few training rows: '||thin from s where thin is not null""")
def dataset_audit_findings(spark, d):
    v = F.when(F.col("o_orderkey") % 1000 == 7, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double"))
    status = F.col("o_orderstatus")
    split = F.when(status == "F", "train").when(status == "O", "test").otherwise("validation")
    x = table(spark, d, "orders").select(split.alias("split"), F.concat(F.when(status == "P", "only ").otherwise(""), "o_orderpriority").alias("label"), F.col("o_custkey").alias("key"), v.alias("v"))
    return ds.audit_findings(x, "split", "label", "key", ("v",))


@query("""select doc_id, case when doc_id is null then 'no experiment_id' when n_chars<50 then 'no capture path' when coalesce(toxic,1)<>0 then 'not valid: '||coalesce(case when doc_id%3=0 then lang end,'capture was not validated')||case when doc_id%2=0 then ': '||source||'; '||lang else '' end when quality=0 then 'dry run' when doc_id%7=0 then 'capture file is missing' end reason from documents left join labels using(doc_id)""")
def manifest_verdict(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang").join(table(spark, d, "labels").select("doc_id", "toxic", "quality"), "doc_id", "left")
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    runs = x.select("doc_id", F.col("doc_id").alias("experiment_id"), F.when(F.col("n_chars") >= 50, F.col("source")).alias("pcap_path"), (F.col("toxic") == 0).alias("valid_capture"), F.when(third, F.col("lang")).alias("error_code"), F.when(even, F.array("source", "lang")).alias("reasons"), (F.col("quality") == 0).alias("dry_run"), (F.col("doc_id") % 7 != 0).alias("file_found"))
    return ds.manifest_verdict(runs).select("doc_id", "reason")


@query("select unnest(['p_brand has several values','p_size has several values','every p_brand has several p_size','every p_size has several p_brand']) as name, unnest([(select count(distinct p_brand)>1 from part),(select count(distinct p_size)>1 from part),(select min(n)>1 from (select count(distinct p_size) n from part group by p_brand)),(select min(n)>1 from (select count(distinct p_brand) n from part group by p_size))]) holds")
def coverage_checks(spark, d):
    return ds.coverage_checks(table(spark, d, "part"), "p_brand", "p_size")


@query("select p_brand, count(distinct p_type) n_types, count(distinct p_size) n_sizes, count(distinct p_type)<2 confounded from part group by 1")
def confounding_check(spark, d):
    return ds.confounded(table(spark, d, "part"), "p_brand", "p_type", "p_size").withColumnsRenamed({"n_p_type": "n_types", "n_p_size": "n_sizes"})


_CIPHERS = ("aes128gcm", "aes256gcm", "aes128cbc", "aes256cbc")
_DESIGN = """g as (select case when p_size%2=0 then 'tunnel' else 'transport' end mode, ['aes128gcm','aes256gcm','aes128cbc','aes256cbc'][p_partkey%4+1] encryption, case when p_partkey%4>=2 or p_partkey%97=0 then 'hmac_sha256' else 'none' end integrity, p_size%7 dh_group, p_size%3=0 pfs, case when p_size%5=0 then 6 else 4 end ip_version, p_brand traffic from part)"""


@query(f"""with {_DESIGN}, a as (select *, contains(encryption,'gcm') aead, starts_with(integrity,'hmac') h from g), o as (select bool_or(mode='tunnel') mode_tunnel, bool_or(mode='transport') mode_transport, bool_or(starts_with(encryption,'aes128')) enc_aes128, bool_or(starts_with(encryption,'aes256')) enc_aes256, bool_or(aead) enc_gcm, bool_or(not aead) enc_cbc_hmac, bool_or(aead) and not bool_or(aead and h) aead_without_separate_hmac, bool_or(not aead) and not bool_or(not aead and not h) cbc_requires_hmac, count(distinct dh_group)>=3 dh_groups, bool_or(pfs) pfs_enabled, bool_or(not pfs) pfs_disabled, bool_or(ip_version=4) ipv4, bool_or(ip_version=6) ipv6,
bool_or(traffic='Brand#1') "traffic_Brand#1", coalesce(bool_or(traffic='absent'),false) traffic_absent, count(distinct encryption)=4 all_encryption_algorithms, count(distinct mode||aead)=4 mode_cipher_cross,
(select bool_or(x) from (select count(distinct pfs)>1 x from g group by mode,encryption,integrity,dh_group,ip_version,traffic)) pfs_isolated, (select bool_and(x) from (select count(distinct traffic)>1 x from g group by mode,encryption,integrity,dh_group,ip_version,pfs)) config_traffic_cross, (select bool_and(x) from (select count(distinct (mode,encryption,integrity,dh_group,ip_version,pfs))>1 x from g group by traffic)) traffic_config_cross from a)
select * from (unpivot o on * into name key value passed)""")
def design_coverage(spark, d):
    cipher = F.get(F.array(*map(F.lit, _CIPHERS)), (F.col("p_partkey") % 4).cast("int"))
    g = table(spark, d, "part").select(F.expr("case when p_size%2=0 then 'tunnel' else 'transport' end mode"), cipher.alias("encryption"), F.expr("case when p_partkey%4>=2 or p_partkey%97=0 then 'hmac_sha256' else 'none' end integrity"), F.expr("p_size%7 dh_group"), F.expr("p_size%3=0 pfs"), F.expr("case when p_size%5=0 then 6 else 4 end ip_version"), F.col("p_brand").alias("traffic"))
    return ds.design_coverage(g, ["Brand#1", "absent"], list(_CIPHERS))


@query("select p_brand, p_type, min(case when p_size>25 then p_partkey end) with_key, min(case when p_size<=25 then p_partkey end) without_key from part group by 1,2 having count(*) filter (p_size>25)>0 and count(*) filter (p_size<=25)>0")
def isolated_pairs(spark, d):
    x = table(spark, d, "part").withColumn("large", F.col("p_size") > 25)
    return ds.isolated_pairs(x, ["p_brand", "p_type"], "large", "p_partkey")


@query("select p_partkey, r::int as \"repeat\", p_partkey::varchar||'-'||lpad(r::varchar,3,'0') session_id from part, range(1,6) t(r) where r<=1+p_size%5")
def plan_expand(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.lit(1) + F.col("p_size") % 5).alias("n"))
    return ds.plan_expand(x, "p_partkey", "n").drop("n")


@query("""select p_partkey, substr(sha256('{"p_brand":"'||p_brand||'","p_size":"'||p_size::varchar||'","p_type":"'||p_type||'"}'),1,16) fingerprint from part""")
def config_fingerprint(spark, d):
    return table(spark, d, "part").select("p_partkey", ds.config_fingerprint(["p_brand", "p_type", "p_size"]).alias("fingerprint"))


@query("select p_partkey, concat_ws('; ', case when p_size%2=0 and p_size%3=0 then 'an AEAD cipher takes no integrity' end, case when p_size%2=1 and p_size%3<>0 then 'the cipher needs integrity' end, case when p_size%5=0 and p_size%7<>0 then 'PFS needs a group' end, case when p_size%5<>0 and p_size%7=0 then 'a group without PFS' end) problems from part")
def config_validity(spark, d):
    s = F.col("p_size")
    x = table(spark, d, "part").select("p_partkey", F.when(s % 2 == 0, "AES_GCM_16").otherwise("AES_CBC").alias("encryption"), F.when(s % 3 == 0, "SHA2").alias("integrity"), (s % 5 == 0).alias("pfs"), F.when(s % 7 == 0, 14).alias("child_group"))
    return x.select("p_partkey", ds.config_validity().alias("problems"))


@query("select doc_id, case when doc_id%11=0 then 'missing' when doc_id%7=0 then 'unhashed' when doc_id%5=0 then 'mismatched' else 'matched' end state from documents")
def hash_verify(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text")
    m = x.select("doc_id", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, "0").otherwise(F.sha2("text", 256)).alias("sha256"))
    return ds.hash_verify(m, x.where("doc_id % 11 <> 0").withColumnRenamed("text", "content"), "doc_id")


@query("select vec_id, label from embeddings where label not in (7,8,9)")
def heldout_class_partition(spark, d):
    return ds.known_class_rows(table(spark, d, "embeddings").select("vec_id", "label"), "label", [7, 8, 9])


@query("select p_partkey, p_brand, case when p_brand in (select p_brand from part where p_size=1) then 'held_out' else 'train' end partition from part")
def heldout_config_partition(spark, d):
    x = table(spark, d, "part")
    return ds.held_out_rows(x.select("p_partkey", "p_brand"), x.where("p_size = 1"), "p_brand")


@query("select label as class from embeddings union select toxic from labels")
def class_union(spark, d):
    return ds.all_values(table(spark, d, "embeddings").select(F.col("label").alias("class")), table(spark, d, "labels").select("toxic"))


@query("select source from documents where lang='en' intersect select source from documents where lang='de'")
def partition_overlap(spark, d):
    x = table(spark, d, "documents")
    return ds.shared_values(x.where("lang = 'en'"), x.where("lang = 'de'"), "source")


@query("select label as class from embeddings except select quality from labels")
def unseen_classes(spark, d):
    return ds.missing_values(table(spark, d, "embeddings").select(F.col("label").alias("class")), table(spark, d, "labels").select("quality"))


_ML = "('0x'||substr(sha256('42'||chr(0)||vec_id::varchar),1,8))::bigint::double/4294967296.0"


@query(f"with s as (select label, case when {_ML}<0.7 then 'train' when {_ML}<0.85 then 'validation' else 'test' end split from embeddings), m as (select arg_min(label, {{'n':-n,'l':label}}) majority from (select label, count(*) n from s where split='train' group by 1)) select split, majority, round(avg((label=majority)::int::double),6) accuracy, count(*) n from s, m group by 1,2")
def majority_baseline(spark, d):
    from flowmill.operators.evaluate import majority_baseline as of

    h = F.conv(F.substring(F.sha2(F.concat(F.lit("42\0"), F.col("vec_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return of(table(spark, d, "embeddings").select("label", F.when(h < 0.7, "train").when(h < 0.85, "validation").otherwise("test").alias("split")))


@query("with t as (select event_type as name, row_number() over (order by event_type) as rank, round(avg(value),2) score from events group by 1) select arg_min(name, {'r':rank,'n':name}) chosen from t where score >= (select max(score) from t)-0.5")
def select_candidate(spark, d):
    from pyspark.sql import Window

    from flowmill.operators.evaluate import select_candidate as of

    t = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 2).alias("score"))
    return of(t.withColumn("rank", F.row_number().over(Window.orderBy("name"))), 0.5)


@query("select label as class, count(*) n, count(*)>=20 sigmoid_ok, count(*)>=100 isotonic_ok from embeddings group by 1")
def calibration_feasibility(spark, d):
    from flowmill.operators.training import calibration_feasibility as of

    return of(table(spark, d, "embeddings"), "label")


@query("select o_orderpriority, arg_max(o_orderkey, {'d':o_orderdate,'k':o_orderkey}) model from orders where o_orderstatus='F' group by 1")
def latest_model(spark, d):
    from flowmill.operators.training import latest_model as of

    return of(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", "o_orderdate", "o_orderstatus", "F")


@query("select vec_id, embedding[1]::double f0, embedding[2]::double f1, embedding[4]::double f3 from embeddings")
def feature_set_select(spark, d):
    x = table(spark, d, "embeddings")
    wide = x.select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(f"f{k}") for k in range(6)))
    from flowmill.operators.training import feature_columns

    return wide.select("vec_id", *feature_columns(wide, ["f0", "f1", "f2", "f3", "f9"], shortcuts=("f2",)))


# registries and tiers


@query("select c_custkey, c_nationkey, coalesce(case c_nationkey when 1 then 'ENCR_DES_IV64' when 2 then 'ENCR_DES' when 3 then 'ENCR_3DES' when 12 then 'ENCR_AES_CBC' when 18 then 'ENCR_AES_GCM_16' when 19 then 'ENCR_AES_GCM_12' when 20 then 'ENCR_AES_GCM_8' when 28 then 'ENCR_CHACHA20_POLY1305' end, 'ENCR_'||c_nationkey) name from customer")
def registry_lookup(spark, d):
    ids = {1: "ENCR_DES_IV64", 2: "ENCR_DES", 3: "ENCR_3DES", 12: "ENCR_AES_CBC", 18: "ENCR_AES_GCM_16", 19: "ENCR_AES_GCM_12", 20: "ENCR_AES_GCM_8", 28: "ENCR_CHACHA20_POLY1305"}
    return a.registry_names(table(spark, d, "customer").select("c_custkey", "c_nationkey"), a.dimension(spark, ids, "c_nationkey", "name"), "c_nationkey", "name", "ENCR_")


_SPELT = ("AES-256-GCM", "aes_128_cbc", "3DES", " null ", "ENCR_CHACHA20_POLY1305", "serpent")


@query(f"select p_partkey, case p_partkey%6 when 0 then 'ENCR_AES_GCM_16' when 1 then 'ENCR_AES_CBC' when 2 then 'ENCR_3DES' when 3 then 'ENCR_NULL' when 4 then 'ENCR_CHACHA20_POLY1305' else 'SERPENT' end cipher, case p_size when 1 then 'MODP_768' when 2 then 'MODP_1024' when 5 then 'MODP_1536' when 14 then 'MODP_2048' when 15 then 'MODP_3072' when 16 then 'MODP_4096' when 17 then 'MODP_6144' when 18 then 'MODP_8192' when 19 then 'ECP_256' when 20 then 'ECP_384' when 21 then 'ECP_521' when 31 then 'CURVE25519' else 'DH_GROUP_'||p_size end dh_group, upper(trim(p_brand)) other from part")
def fold_names(spark, d):
    spelt = F.get(F.array(*map(F.lit, _SPELT)), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", ru.wire_name(spelt, "encryption").alias("cipher"), ru.wire_name(F.col("p_size").cast("string"), "group").alias("dh_group"), ru.wire_name(F.col("p_brand"), "prf").alias("other"))


_TIER = "case p_size%4 when 0 then 'RECOMMENDED' when 1 then 'ACCEPTABLE' when 2 then 'DEPRECATED' else 'FORBIDDEN' end"


@query(f"with x as (select p_brand, p_type n, {_TIER} t from part), y as (select *, case t when 'FORBIDDEN' then 4 when 'DEPRECATED' then 3 when 'ACCEPTABLE' then 1 else 0 end r from x) select p_brand, arg_max(n, {{'r':r,'n':n}}) worst, arg_max(t, {{'r':r,'n':n}}) tier from y group by 1")
def tier_worst(spark, d):
    return a.worst_tier(table(spark, d, "part").select("p_brand", F.col("p_type").alias("n"), F.expr(_TIER).alias("t")), "p_brand", "n", "t")


@query("with x as (select o_orderkey, case when o_orderkey%13=0 then null else round(o_totalprice)::bigint-2000 end s from orders) select o_orderkey, case when s is null then 'UNKNOWN' when s<=0 then 'FORBIDDEN' when s<=28800 then 'RECOMMENDED' when s<=86400 then 'ACCEPTABLE' when s<=604800 then 'DEPRECATED' else 'FORBIDDEN' end ike, case when s is null then 'UNKNOWN' when s<=0 then 'FORBIDDEN' when s<=1800 then 'RECOMMENDED' when s<=3600 then 'ACCEPTABLE' when s<=86400 then 'DEPRECATED' else 'FORBIDDEN' end child from x")
def lifetime_tier(spark, d):
    x = table(spark, d, "orders").selectExpr("o_orderkey", "case when o_orderkey%13=0 then null else cast(round(o_totalprice) as bigint)-2000 end s")
    return x.select("o_orderkey", a.lifetime_tier("s", a.IKE_LIFETIME).alias("ike"), a.lifetime_tier("s", a.CHILD_LIFETIME).alias("child"))


# findings

_PR = C + ", pr as (select *, round(base * case status when 'FAIL' then 1.0::DOUBLE when 'WARNING' then 0.4::DOUBLE else 0.0::DOUBLE end * (case evidence_status when 'OBSERVED' then 1.0::DOUBLE when 'CONFIGURED' then 0.85::DOUBLE when 'INFERRED' then 0.5::DOUBLE else 0.0::DOUBLE end * case when evidence_status='INFERRED' then greatest(0.0,least(1.0,confidence)) else 1.0::DOUBLE end),2) points from c)"
_ST = _PR + ", w as (select *, first_value(rule_id) over z win, first_value(status) over z property_status from pr window z as (partition by capture_id, property_key order by case status when 'FAIL' then 3 when 'WARNING' then 2 when 'PASS' then 1 else 0 end desc, ordinal)), st as (select capture_id, rule_id, ordinal, category, property_key, case when win<>rule_id then 'PASS' else status end status, evidence_status, base, confidence, case when win<>rule_id then 0.0 else points end points, property_status, case when win<>rule_id then win end suppressed_by from w)"
_CS = _ST + ", cg as (select capture_id, category, round(sum(points),2) raw, count(*) filter (status='FAIL') fails, count(*) filter (status='WARNING') warnings, count(*) filter (status='NOT_VERIFIABLE') unverified, round(avg(case evidence_status when 'OBSERVED' then 1.0::DOUBLE when 'CONFIGURED' then 0.75::DOUBLE when 'INFERRED' then 0.5::DOUBLE else 0.0::DOUBLE end),4) coverage, case category when 'CRYPTOGRAPHY' then 28.0::DOUBLE when 'KEY_EXCHANGE' then 24.0::DOUBLE when 'SA_SECURITY' then 14.0::DOUBLE when 'METADATA_PRIVACY' then 10.0::DOUBLE else 12.0::DOUBLE end cap from st group by 1,2), cs as (select * exclude(cap), round(least(raw,cap),2) deducted, round(cap-round(least(raw,cap),2),2) score from cg)"
_BAND = "case when {0}>=85 then 'LOW' when {0}>=70 then 'MODERATE' when {0}>=50 then 'HIGH' else 'CRITICAL' end"
_SS = _CS + f", s0 as (select capture_id, round(greatest(0.0,100.0-sum(deducted)),2) security_score from cs group by 1), s1 as (select *, {_BAND.format('security_score')} risk_level, round_even(security_score,0)::int rounded_score from s0), ss as (select *, {_BAND.format('rounded_score')} rounded_level from s1)"


def _settled(spark, d):
    return a.settle(a.collapse(a.price(findings(spark, d))))


@query(f"with {_PR} select * from pr")
def price_findings(spark, d):
    return a.price(findings(spark, d))


@query(f"""with {P}, x as (select capture_id, count(*) filter (proto='ESP') esp, count(*) filter (proto='IKE') ike, count(distinct spi_int) filter (proto='ESP') spis from p group by 1)
select capture_id, 'OWN-1' rule_id, 1::int as ordinal, 'SA_SECURITY' category, 'few_associations' property_key, case when spis<3 then 'FAIL' when spis<8 then 'WARNING' else 'PASS' end status, 'OBSERVED' evidence_status, case when spis<3 then 9.0::double when spis<8 then 4.0::double else 0.0::double end base, 1.0::double confidence from x
union all select capture_id, 'OWN-2', 2::int, 'CONFIGURATION', 'signups', case when ike*5>esp then 'WARNING' else 'PASS' end, 'INFERRED', case when ike*5>esp then 2.0::double else 0.0::double end, 0.5::double from x where ike>0""")
def custom_rules(spark, d):
    x = packets(spark, d).groupBy("capture_id").agg(F.count_if(F.col("proto") == "ESP").alias("esp"), F.count_if(F.col("proto") == "IKE").alias("ike"), F.count_distinct(F.when(F.col("proto") == "ESP", F.col("spi_int"))).alias("spis"))
    few = F.when(F.col("spis") < 3, "FAIL").when(F.col("spis") < 8, "WARNING").otherwise("PASS")
    many = F.when(F.col("ike") * 5 > F.col("esp"), "WARNING").otherwise("PASS")
    own = [ru.Rule("OWN-1", "SA_SECURITY", "few_associations", {"FAIL": 9.0, "WARNING": 4.0}, few, F.lit("OBSERVED")), ru.Rule("OWN-2", "CONFIGURATION", "signups", {"WARNING": 2.0}, many, F.lit("INFERRED"), F.col("ike") > 0, F.lit(0.5))]
    return ru.caller_verdicts(x, own)


@query(f"with {_PR}, x as (select pr.* replace (points-0.25*k as points, ordinal*3+k::int as ordinal), case when category='METADATA_PRIVACY' then 'spi-'||k end dedup_key from pr, range(0,3) r(k)) select * exclude(n) from (select *, row_number() over (partition by capture_id, rule_id, dedup_key order by points desc, ordinal) n from x) where n=1")
def collapse_findings(spark, d):
    """Three findings of each rule, those of metadata on subjects of their own."""
    k = F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    x = a.price(findings(spark, d)).select("*", k).withColumns({"points": F.col("points") - 0.25 * F.col("k"), "ordinal": F.col("ordinal") * 3 + F.col("k"), "dedup_key": F.when(F.col("category") == "METADATA_PRIVACY", F.concat(F.lit("spi-"), "k"))})
    return a.collapse(x.drop("k"))


@query(f"with {_ST} select * from st")
def settle_properties(spark, d):
    return _settled(spark, d)


@query(f"with {_CS} select * from cs")
def category_scores(spark, d):
    return a.category_scores(_settled(spark, d))


@query(f"with {_SS} select * from ss")
def security_score(spark, d):
    return a.security_score(_settled(spark, d))


@query(f"with {_ST} select capture_id, rule_id, category, property_key, status verdict, property_status, evidence_status, base, points, suppressed_by from st")
def rule_ledger(spark, d):
    return a.ledger(_settled(spark, d))


@query(f"with {C} select capture_id, count(*) filter (evidence_status='OBSERVED') observed, count(*) filter (evidence_status='CONFIGURED') configured, count(*) filter (evidence_status='INFERRED') inferred, count(*) filter (evidence_status='NOT_VERIFIABLE') not_verifiable from c group by 1")
def evidence_tally(spark, d):
    return a.evidence_tally(findings(spark, d))


_SEV = "case when status='FAIL' and base>=20 then 'CRITICAL' when status='FAIL' then 'HIGH' when status='WARNING' and base>=6 then 'MEDIUM' when status='WARNING' then 'LOW' else 'INFO' end"
_RANK = "case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"


def _titled(spark, d):
    return _settled(spark, d).withColumns({"severity": F.expr(_SEV), "title": F.col("property_key")})


@query(f"with {_ST}, x as (select *, {_SEV} severity, property_key title from st) select *, row_number() over (partition by capture_id order by case status when 'FAIL' then 3 when 'WARNING' then 2 when 'PASS' then 1 else 0 end desc, {_RANK} desc, title, rule_id)::int as position from x")
def findings_ordered(spark, d):
    return a.worst_first(_titled(spark, d))


_ADVICE = {"CRYPTO-001": "use strong ciphers", "KEYX-003": "turn on PFS", "KEYX-004": "turn on PFS", "SA-003": "avoid UDP encapsulation", "META-002": "pad traffic", "META-003": "pad traffic"}
_ADV = "case rule_id when 'CRYPTO-001' then 'use strong ciphers' when 'KEYX-003' then 'turn on PFS' when 'KEYX-004' then 'turn on PFS' when 'SA-003' then 'avoid UDP encapsulation' else 'pad traffic' end"


@query(f"with {_ST}, y as (select *, {_SEV} severity from st where status in ('FAIL','WARNING')), z as (select *, {_RANK} sr from y), x as (select capture_id, {_ADV} advice, max(points) points, max(sr) sr, arg_max(severity, sr) severity, arg_max(rule_id, {{'s':sr,'p':points,'o':-ordinal}}) lead_rule, string_agg(distinct rule_id, ',' order by rule_id) \"rules\" from z group by 1,2) select * exclude(sr), row_number() over (partition by capture_id order by sr desc, points desc, advice)::int priority from x")
def recommendations(spark, d):
    return a.recommendations(_titled(spark, d), _ADVICE)


_TV = ", ".join(f"('{i}','{l}','{m}',{str(u).lower()},'{r}')" for i, _, l, m, rules, u in a.THREATS for r in rules)
_LV = "case {0} when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end"
_TM = _ST + f", tr as (select * from (values {_TV}) v(threat_id, likelihood, impact, unverified, rule_id)), tm as (select capture_id, threat_id, likelihood, impact, string_agg(distinct rule_id, ',' order by rule_id) \"rules\", arg_min(evidence_status, case evidence_status when 'OBSERVED' then 0 when 'CONFIGURED' then 1 when 'INFERRED' then 2 else 3 end) evidence, round(sum(points),2) points, case {_LV.format('likelihood')} + {_LV.format('impact')} when 6 then 'CRITICAL' when 5 then 'HIGH' when 4 then 'MODERATE' else 'LOW' end risk from st join tr using(rule_id) where case when unverified then status='NOT_VERIFIABLE' else status in ('FAIL','WARNING') end group by capture_id, threat_id, likelihood, impact)"


@query(f"with {_TM} select * from tm")
def threat_matrix(spark, d):
    return a.threat_matrix(_settled(spark, d), a.catalogue(spark))


@query(f"with {_TM} select capture_id, case max(case risk when 'CRITICAL' then 3 when 'HIGH' then 2 when 'MODERATE' then 1 else 0 end) when 3 then 'CRITICAL' when 2 then 'HIGH' when 1 then 'MODERATE' else 'LOW' end worst_risk from tm group by 1")
def worst_risk(spark, d):
    return a.worst_risk(a.threat_matrix(_settled(spark, d), a.catalogue(spark)), "capture_id", "risk")


@query(f"with {C} select capture_id, case min(case evidence_status when 'OBSERVED' then 0 when 'CONFIGURED' then 1 when 'INFERRED' then 2 else 3 end) when 0 then 'OBSERVED' when 1 then 'CONFIGURED' when 2 then 'INFERRED' else 'NOT_VERIFIABLE' end evidence from c group by 1")
def strongest_evidence(spark, d):
    return findings(spark, d).groupBy("capture_id").agg(a.strongest("evidence_status").alias("evidence"))


@query(f"with {_SS} select capture_id, security_score, risk_level, n_findings, fails from ss join (select capture_id, count(*) n_findings, count(*) filter (status='FAIL') fails from st group by 1) using(capture_id)")
def assessment(spark, d):
    s = _settled(spark, d)
    return a.security_score(s).join(s.groupBy("capture_id").agg(F.count("*").alias("n_findings"), F.count_if(F.col("status") == "FAIL").alias("fails")), "capture_id").select("capture_id", "security_score", "risk_level", "n_findings", "fails")


@query("select o_orderkey, coalesce(case when o_orderkey%3=0 then o_orderpriority end, case when o_orderkey%2=0 then o_orderstatus end) as value, case when o_orderkey%3=0 then 'OBSERVED' when o_orderkey%2=0 then 'CONFIGURED' else 'NOT_VERIFIABLE' end evidence_status from orders")
def resolve_evidence(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("seen"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("set"))
    return a.resolve_evidence(x, "o_orderkey", "seen", "set")


@query(f"with {P}, g as (select capture_id, list(distinct spi_int) filter (src='A' and length>100) l, list(distinct spi_int) filter (src='A' and length<=100) r from p group by 1), x as (select capture_id, list_sort(list_filter(coalesce(l,[]), lambda e: not list_contains(coalesce(r,[]), e))) e from g) select capture_id, array_to_string(e, ',') extra, len(e) n from x")
def offered_minus_effective(spark, d):
    return a.set_difference(packets(spark, d), "capture_id", "spi_int", F.expr("src = 'A' and length > 100"), F.expr("src = 'A' and length <= 100"))


@query("with g as (select c_custkey k, max(case when c_custkey%5<>0 then c_mktsegment end) configured, list(distinct o_orderpriority) filter (o_orderpriority is not null) o from customer left join orders on o_custkey=c_custkey group by 1) select k, configured, case when configured is null or o is null then 'NOT_VERIFIABLE' when list_contains(o, configured) then 'PASS' else 'WARNING' end status from g")
def config_drift(spark, d):
    x = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("configured"), "o_orderpriority")
    return a.drift(x, "k", "configured", "o_orderpriority")


@query("with g as (select conv_id, bool_or(turn=0 and length(text)<40) lacks, bool_and(length(text)>=40) al, bool_or(length(text)>=40) so from conversations group by 1) select conv_id, case when lacks then 'failed' when al then 'ok' when not so then 'failed' else 'partial' end status from g")
def stage_rollup(spark, d):
    x = table(spark, d, "conversations").select("conv_id", F.when(F.length("text") >= 40, "ok").otherwise("bad").alias("status"), (F.col("turn") == 0).alias("required"))
    return a.stage_rollup(x, "conv_id")


# records


@query(f"with {K} select o_orderkey, case when declared is not distinct from \"external\" then 'matched' when declared is null or \"external\" is null then 'unconfirmed' else 'conflicting' end result from k")
def amount_compare(spark, d):
    return evidence(spark, d).select("o_orderkey", rc.compare_amounts("declared", "external").alias("result"))


_CMP = "case when {0} is not distinct from {1} then 'matched' when {0} is null or {1} is null then 'unconfirmed' else 'conflicting' end"
_RC = K + f", rf as (select o_orderkey, 'declared vs extracted' pair, {_CMP.format('declared', 'extracted')} result from k union all select o_orderkey, 'extracted vs external', {_CMP.format('extracted', chr(34) + 'external' + chr(34))} from k)"
_RF = _RC + """, w as (select o_orderkey, o_custkey, "external", max(result) filter (pair='declared vs extracted') r1, max(result) filter (pair='extracted vs external') r2 from rf join k using(o_orderkey) group by all),
ff as (select o_orderkey, unnest([case r1 when 'conflicting' then 'amount_mismatch_declared_vs_extracted' when 'unconfirmed' then 'amount_unconfirmed' end, case when r2='conflicting' then 'amount_mismatch_extracted_vs_external' when "external" is null then 'external_evidence_unavailable' end,
case when o_custkey%20=0 then 'ifsc_mismatch' end, case when o_custkey%50=0 then 'ifsc_invalid_format' end]) finding_type from w), fs as (select *, case when finding_type like 'amount_mismatch%' or finding_type='ifsc_invalid_format' then 'high' else 'medium' end severity from ff where finding_type is not null)"""
_PAIRS = [("declared", "extracted"), ("extracted", "external")]


@query(f"with {_RC} select * from rf")
def reconcile_sources(spark, d):
    return rc.reconcile(evidence(spark, d), "o_orderkey", _PAIRS)


def _sources(spark, d):
    return evidence(spark, d).withColumns({"external_available": F.col("external").isNotNull(), "code_conflicts": F.col("o_custkey") % 20 == 0, "code_format_ok": F.col("o_custkey") % 50 != 0})


@query(f"with {_RF} select * from fs")
def reconcile_findings(spark, d):
    return rc.reconcile_findings(_sources(spark, d), "o_orderkey")


@query(f"with {_RF}, g as (select o_orderkey, bool_or(severity='high') h, count(*) n from fs group by 1) select o_orderkey, case when h then 'conflicting' when n>0 then 'requires_human_review' else 'matched' end status, coalesce(n,0) findings from k left join g using(o_orderkey)")
def reconcile_status(spark, d):
    x = _sources(spark, d)
    return rc.reconcile_status(x, rc.reconcile_findings(x, "o_orderkey"), "o_orderkey")


_DOCS = """dx as (select doc_id, doc_id%(select greatest(1, count(*)//2) from customer) instrument, doc_id%5 version, text||chr(10)||case when doc_id%9<>0 then 'Principal AMOUNT: '||case when doc_id%7=0 then '1,000.00' when doc_id%4=0 then (n_chars/100.0)::decimal(20,2)::varchar else '~' end||' ' else 'without sum' end||case when doc_id%11=0 then chr(10)||'amount:'||chr(10)||'Amount paid: 12.5: 3' else '' end page from documents),
cx as (select c_custkey, round(c_acctbal*100)::bigint cents, n_name, c_nationkey from customer left join nation on n_nationkey=c_nationkey)"""
_RD = _DOCS + """, last as (select instrument, arg_max(doc_id, {'v':version,'d':doc_id}) doc_id from dx group by 1), pg as (select doc_id, replace(page, '~', (cents/100.0)::decimal(20,2)::varchar) page from dx join cx on c_custkey=instrument),
ln as (select doc_id, unnest(string_split(page, chr(10))) t, generate_subscripts(string_split(page, chr(10)),1) line from pg join last using(doc_id)),
am as (select doc_id, arg_max(trim(substr(t, strpos(t,':')+1), ' '), line) extracted from ln where contains(t,':') and contains(lower(t),'amount') group by 1),
jn as (select c_custkey instrument, doc_id as document, extracted, cents::decimal(38,6)/100 dec, case when regexp_matches(extracted, '^[+-]?[0-9]+([.][0-9]*)?$') then extracted::decimal(38,6) end ext, case when c_custkey%3<>0 then (cents+case when c_custkey%6=1 then 1 else 0 end)::decimal(38,6)/100 end oth, c_custkey%13=0 mism, c_custkey%17=0 badform from cx left join last on instrument=c_custkey left join am using(doc_id)),
cm as (select *, case when ext is null then 'unconfirmed' when dec=ext then 'matched' else 'conflicting' end r1, case when ext is null and oth is null then 'matched' when ext is null or oth is null then 'unconfirmed' when ext=oth then 'matched' else 'conflicting' end r2 from jn)"""


@query(f"""with {_RD} select instrument, document, extracted, r1 declared_vs_extracted, r2 extracted_vs_external, concat_ws(',', case r1 when 'conflicting' then 'amount_mismatch_declared_vs_extracted' when 'unconfirmed' then 'amount_unconfirmed' end, case when r2='conflicting' then 'amount_mismatch_extracted_vs_external' when oth is null then 'external_evidence_unavailable' end, case when mism and not badform then 'ifsc_mismatch' end, case when badform then 'ifsc_invalid_format' end) findings,
case when r1='conflicting' or r2='conflicting' or badform then 'conflicting' when r1='unconfirmed' or oth is null or mism and not badform then 'requires_human_review' else 'matched' end status from cm""")
def reconcile_documents(spark, d):
    """Customers as instruments: their balance is declared, documents of several versions name amounts in their text, two of three
    have external evidence, a nation's key is the code that names it."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", cents.alias("cents"), "n_name", "c_nationkey")
    money = lambda x: F.format_string("%s.%s", F.floor(x / 100), F.lpad((x % 100).cast("string"), 2, "0"))
    shown = F.concat(F.when(F.col("cents") < 0, "-").otherwise(""), money(F.abs("cents")))
    bank = F.when(F.col("c_custkey") % 13 == 0, "other").otherwise(F.concat(F.lit(" "), F.lower("n_name")))
    code = F.when(F.col("c_custkey") % 17 == 0, F.lit("?")).otherwise(F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")))
    declared = c.select(F.col("c_custkey").alias("instrument"), shown.alias("amount"), bank.alias("bank"), F.lit("").alias("branch"), code.alias("code"))
    docs = table(spark, d, "documents").crossJoin(table(spark, d, "customer").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("m")))
    docs = docs.withColumn("instrument", F.col("doc_id") % F.col("m")).join(c, F.col("instrument") == F.col("c_custkey"))
    k = lambda n: F.col("doc_id") % n == 0
    said = F.when(k(7), "1,000.00").when(k(4), money(F.col("n_chars"))).otherwise(shown)
    line = F.when(~k(9), F.concat(F.lit("Principal AMOUNT: "), said, F.lit(" "))).otherwise("without sum")
    page = F.concat("text", F.lit("\n"), line, F.when(k(11), "\namount:\nAmount paid: 12.5: 3").otherwise(""))
    documents = docs.select(F.col("doc_id").alias("document"), "instrument", F.struct((F.col("doc_id") % 5).alias("v"), "doc_id").alias("version"), page.alias("text"))
    outside = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("instrument"), ((F.col("cents") + F.when(F.col("c_custkey") % 6 == 1, 1).otherwise(0)).cast("decimal(20,0)") / 100).alias("amount"))
    codes = table(spark, d, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.col("n_name").alias("bank"), F.lit("x").alias("branch"))
    out = rc.reconcile_documents(declared, documents, outside, codes, {"amount": ("amount", False)}, "^N[0-9]{2}$")
    return out.withColumn("findings", F.array_join("findings.finding_type", ","))


@query("select s_suppkey, s_nationkey, n_name, regexp_matches(s_nationkey::varchar, '^[0-9]{2}$') format_ok, n_name is not null known, coalesce(lower(trim(n_name))=lower(trim(case when s_suppkey%2=0 then ' '||lower(n_name) else 'X' end)), false) name_matches from supplier left join nation on s_nationkey=n_nationkey")
def code_lookup(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(n.withColumnRenamed("n_name", "x")), "s_nationkey", "left")
    s = s.withColumn("expected", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), F.lower("x"))).otherwise("X"))
    return rc.code_lookup(s, n, "s_nationkey", "^[0-9]{2}$", "n_name", "expected").select("s_suppkey", "s_nationkey", "n_name", "format_ok", "known", "name_matches")


_RULES = [("R1", 1, "{}", 100, None), ("R1", 2, '{"segment":"BUILDING"}', 5000000, '{"private_leased_property":true,"private_leased_property_percent":25}'), ("R2", 1, '{"priority":"1-URGENT"}', None, '{"private_leased_property":true,"private_leased_property_percent":40}'), ("R3", 1, "{}", None, '{"private_leased_property":false,"private_leased_property_percent":90}')]


@query(f"""with {K}, x as (select o_orderkey, extracted amount, case when o_orderkey%17<>0 then declared end required, case when o_custkey%2=0 then 'Private' else 'Public' end category, c_mktsegment segment, o_orderpriority priority from k join customer on c_custkey=o_custkey),
r as (select * from (values ('R1',2,'BUILDING',null,5000000,25.0::DOUBLE),('R2',1,null,'1-URGENT',null,40.0),('R3',1,null,null,null,null)) v(rule_id, version, cs, cp, own, pct)),
y as (select o_orderkey, rule_id, version, amount, coalesce(own, required)::double * case when category='Private' and pct is not null then 1-pct/100 else 1 end required from x join r on (cs is null or cs=segment) and (cp is null or cp=priority)),
z as (select *, case when required is null then 'rule has no amount' when amount is null then 'amount not declared' when amount>=required then 'meets' else 'below' end reason from y)
select o_orderkey, rule_id, version::int as version, required, reason, case when reason='meets' then 'PASS' else 'FAIL' end result from z""")
def policy_eval(spark, d):
    category = F.when(F.col("o_custkey") % 2 == 0, "Private").otherwise("Public")
    x = evidence(spark, d).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    x = x.select("o_orderkey", F.col("extracted").alias("amount"), F.when(F.col("o_orderkey") % 17 != 0, F.col("declared")).alias("required"), category.alias("category"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"))
    rules = spark.createDataFrame(_RULES, "rule_id string, version int, condition string, required long, adjustments string")
    return rc.evaluate_policies(x, rules).select("o_orderkey", "rule_id", "version", "required", "reason", "result")


_PAGES = "pg as (select doc_id, text||chr(10)||'Bank name: '||source||' : '||lang||chr(10)||'no mark in this ifsc line'||chr(10)||'IFSC:  ab'||doc_id||' '||chr(10)||'BANK:' page from documents)"
_EF = _PAGES + ", ln as (select doc_id, unnest(string_split(page, chr(10))) t, generate_subscripts(string_split(page, chr(10)),1)-1 line from pg), lv as (select *, lower(t) l, trim(substr(t, strpos(t,':')+1), ' ') v from ln where contains(t,':')), ef as (select doc_id, line::int as line, 'bank_name' field, v as value, v normalized from lv where contains(l,'bank') union all select doc_id, line::int, 'ifsc', v, upper(v) from lv where contains(l,'ifsc'))"
_FIELDS = {"bank_name": ("bank", False), "ifsc": ("ifsc", True)}


def _pages(spark, d):
    page = F.expr("concat(text, '\\nBank name: ', source, ' : ', lang, '\\nno mark in this ifsc line\\nIFSC:  ab', doc_id, ' \\nBANK:')")
    return table(spark, d, "documents").select("doc_id", page.alias("page"))


@query(f"with {_EF} select * from ef")
def extract_fields(spark, d):
    return rc.extract_fields(_pages(spark, d), "doc_id", "page", _FIELDS)


@query(f"with {_EF} select doc_id, arg_max(value, line) filter (field='bank_name') bank_name, arg_max(value, line) filter (field='ifsc') ifsc from ef group by 1")
def fields_pivot(spark, d):
    return rc.fields_pivot(rc.extract_fields(_pages(spark, d), "doc_id", "page", _FIELDS), "doc_id", list(_FIELDS))


@query("select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc)=1")
def latest_per_key(spark, d):
    return rc.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


_HIST = "select o_orderkey, o_orderstatus, o_totalprice from orders"


@query("select o_orderkey, case when o_orderkey%10=0 then 'R' else o_orderstatus end o_orderstatus, case when o_orderkey%10=0 then o_totalprice+1 else o_totalprice end o_totalprice from orders")
def history_upsert_latest(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    some = x.where("o_orderkey % 10 = 0")
    new = some.withColumn("o_orderstatus", F.lit("Q")).union(some.selectExpr("o_orderkey", "'R'", "o_totalprice + 1"))
    return rc.upsert_latest(x, new, "o_orderkey", "o_totalprice")


@query(_HIST + " where o_orderkey%4<>0")
def history_delete(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rc.delete_keys(x, x.where("o_orderkey % 4 = 0"), "o_orderkey")


@query(_HIST + " where o_orderstatus='F' order by o_totalprice desc, o_orderkey limit 500")
def history_list(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rc.history_list(x, {"o_orderstatus": "F", "o_orderkey": None}, "o_totalprice", "o_orderkey", 900)


@query(_HIST + " where o_orderkey = (select max(o_orderkey) from orders)")
def history_point(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rc.history_point(x, "o_orderkey", x.agg(F.max("o_orderkey").alias("o_orderkey")))


@query("select o_orderstatus, count(*) n from orders group by 1")
def history_count(spark, d):
    return rc.history_count(table(spark, d, "orders"), "o_orderstatus")


@query(f"with {_SS} select capture_id, security_score, risk_level, concat_ws(', ', 'score '||rounded_score, risk_level, case when fails>0 then fails||' failed' end) summary from ss join (select capture_id, count(*) filter (status='FAIL') fails from st group by 1) using(capture_id)")
def history_project(spark, d):
    s = _settled(spark, d)
    x = a.security_score(s).join(s.groupBy("capture_id").agg(F.count_if(F.col("status") == "FAIL").alias("fails")), "capture_id")
    text = F.concat_ws(", ", F.concat(F.lit("score "), F.col("rounded_score").cast("string")), "risk_level", F.when(F.col("fails") > 0, F.concat(F.col("fails").cast("string"), F.lit(" failed"))))
    return x.select("capture_id", "security_score", "risk_level", text.alias("summary"))


@query("select p_partkey, p_name from part where p_size>10 order by p_partkey limit 20 offset 40")
def paged_list(spark, d):
    return rc.page(table(spark, d, "part").where("p_size > 10").select("p_partkey", "p_name"), "p_partkey", 40, 20)
