"""Queries over decoded bytes, models and streams."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmill.operators import decode as dc
from flowmill.operators import runs
from flowmill.operators import training as tr
from flowmill.operators.boosting import BoostedModel, Tree
from flowmill.operators.dataset import grouped_split
from flowmill.functions.shared import shared_folder
from flowmill.operators.flows import flow_summary
from flowmill.operators.models import new_store
from flowmill.sources import captures as src
from flowmill.sources import ranges as rg
from flowmill.streaming import flows as sf
from flowmill.plans.views import FLOWS, P, packets, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _h(column: str, digits: int) -> str:
    return f"lpad(hex({column}), {digits}, '0')"


#: An SA payload with one ESP proposal of a 128-bit AES-CBC cipher and group 14, in hexadecimal.
_SA = "00000020" + "0000001c" + "01030002" + "0300000c" + "0100000c" + "800e0080" + "00000008" + "0400000e"


def _frames(spark, d):
    """P as Ethernet frames: every third one tagged; ESP plain or in UDP 4500, IKE in UDP 500."""
    p = packets(spark, d)
    esp = f"concat({_h('spi_int + 256', 8)}, {_h('seq', 8)}, '00000000')"
    sa = f"'{_SA}'"
    ike = f"concat({_h('frame_index + 1', 16)}, '0000000000000000', '21', '20', '22', '08', '00000000', {_h(str(28 + len(_SA) // 2), 8)}, {sa})"
    body = f"case when proto = 'IKE' then concat('01f401f4', {_h(str(8 + 28 + len(_SA) // 2), 4)}, '0000', {ike}) when udp_encapsulated then concat('11941194', {_h('8 + 12', 4)}, '0000', {esp}) else {esp} end"
    ip = f"concat('4500', {_h('20 + length(body) div 2', 4)}, '0000000040', case when proto = 'IKE' or udp_encapsulated then '11' else '32' end, '0000', case src when 'A' then '0a0a0a01' else '0a0a0a02' end, case src when 'A' then '0a0a0a02' else '0a0a0a01' end, body)"
    link = "concat(repeat('00', 12), case when frame_index % 3 = 0 then '81000001' else '' end, '0800')"
    x = p.withColumn("body", F.expr(body)).withColumn("l3", F.expr(ip))
    x = x.select("capture_id", "frame_index", "ts_s", F.lit(1).alias("linktype"), F.expr(f"unhex(concat({link}, l3))").alias("frame"))
    return _written(spark, x)


def _written(spark, x):
    """x as a table, as frames of capture files would be: its columns are read, not computed anew for each use."""
    where = shared_folder(spark)
    x.write.parquet(where)
    return spark.read.schema(x.schema).parquet(where)


@query(f"with {P} select frame_index, 2048::int ethertype, case when proto='IKE' then {20 + 8 + 28 + len(_SA) // 2} when udp_encapsulated then 40 else 32 end::int packet_bytes from p")
def hdr_link_strip(spark, d):
    return dc.strip_link(_frames(spark, d)).select("frame_index", "ethertype", F.length("packet").alias("packet_bytes"))


def _ip(spark, d):
    return _written(spark, dc.decode_ip(dc.strip_link(_frames(spark, d))).drop("frame", "packet"))


@query(f"with {P} select frame_index, 4::int ip_version, case when proto='IKE' or udp_encapsulated then 17 else 50 end::int protocol, case src when 'A' then '10.10.10.1' else '10.10.10.2' end src, case src when 'A' then '10.10.10.2' else '10.10.10.1' end dst from p")
def hdr_ip_decode(spark, d):
    return _ip(spark, d).select("frame_index", "ip_version", "protocol", "src", "dst")


@query(f"with {P} select frame_index, 6::int ip_version, case when user_id%3=1 then 17 else 50 end::int protocol, case when user_id%2=0 then 'fd00:1010::1' else '2001:db8:0:1::a00' end src, 'fe80::'||case when event_id%65536=0 then '' else lower(to_hex(event_id%65536)) end dst, 12+case when user_id%3=1 then 8 else 0 end::int payload_bytes from (select user_id, event_id, event_id frame_index from events)")
def hdr_ip6_decode(spark, d):
    """Events as IPv6 over cooked captures: two of three behind a routing and a fragment header, ESP plain or in UDP."""
    e = table(spark, d, "events").select("event_id", "user_id")
    esp = f"concat({_h('user_id', 8)}, {_h('event_id', 8)}, '00000000')"
    inner = f"case when user_id % 3 = 1 then concat('11941194', '00140000', {esp}) else {esp} end"
    kind = "case when user_id % 3 = 1 then '11' else '32' end"
    chain = f"case when user_id % 3 = 0 then {kind} else '2b' end", f"case when user_id % 3 = 0 then '' else concat('2c00000000000000', {kind}, '00000000000000') end"
    source = "case when user_id % 2 = 0 then 'fd001010000000000000000000000001' else '20010db8000000010000000000000a00' end"
    ip = f"concat('60000000', {_h('length(body) div 2', 4)}, {chain[0]}, '40', {source}, 'fe80', repeat('0', 24), {_h('event_id % 65536', 4)}, body)"
    x = e.withColumn("body", F.expr(f"concat({chain[1]}, {inner})")).withColumn("l3", F.expr(ip))
    x = x.select(F.col("event_id").alias("frame_index"), F.lit(dc.SLL).alias("linktype"), F.expr("unhex(concat(repeat('00', 14), '86dd', l3))").alias("frame"))
    rows = dc.decode_ip(dc.strip_link(_written(spark, x)))
    return rows.select("frame_index", "ip_version", "protocol", "src", "dst", F.length("payload").alias("payload_bytes"))


@query(f"with {P} select frame_index, proto kind, proto='ESP' and udp_encapsulated udp_encapsulated from p")
def hdr_classify(spark, d):
    return dc.classify(_ip(spark, d)).select("frame_index", "kind", "udp_encapsulated")


@query(f"with {P} select frame_index, spi_int+256 spi, seq sequence_number from p where proto='ESP'")
def hdr_esp_decode(spark, d):
    return dc.decode_esp(dc.classify(_ip(spark, d))).where("kind = 'ESP'").select("frame_index", "spi", "sequence_number")


@query(f"with {P} select frame_index, 1::int proposal, 3::int protocol_id, t.t::int transform_type, t.i::int transform_id, t.k::int key_bits from p, (select unnest([{{'t':1,'i':12,'k':128}},{{'t':4,'i':14,'k':null}}]) t) where proto='IKE'")
def ike_explode(spark, d):
    return dc.explode_ike(dc.classify(_ip(spark, d)).select("frame_index", "kind", "body")).drop("kind")


@query(f"with {P} select capture_id, case when bool_or(proto='IKE') then '14' else '' end \"groups\", case when bool_or(proto='IKE') then 'OBSERVED' else 'NOT_VERIFIABLE' end status from p group by 1")
def pfs_verdict(spark, d):
    x = dc.classify(_ip(spark, d))
    return dc.pfs_verdict(dc.explode_ike(x.select("capture_id", "kind", "body")), x.where("kind = 'ESP'").select("capture_id"))


@query(f"with {P} select capture_id, '' ike_groups, '14' child_groups from p where proto='IKE' group by 1")
def dh_groups_by_scope(spark, d):
    return dc.dh_groups(dc.explode_ike(dc.classify(_ip(spark, d)).select("capture_id", "kind", "body")))


def _build(key, pdf):
    """A capture file, of either byte order, with a cut tail."""
    pdf = pdf.sort_values("frame_index")
    order = "<" if len(pdf) % 2 else ">"
    head = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    parts = [struct.pack(order + "4I", int(t), int(t % 1 * 1e6), len(f), len(f)) + f for t, f in zip(pdf.ts_s, map(bytes, pdf.frame))]
    content = b"".join([head, *parts, b"cut"])
    return pd.DataFrame([(f"{key[0]}/{key[1]}", len(content), content)], columns=["path", "length", "content"])


#: A capture file holds frames of so many frame numbers at most, some 15 MB.
FILE_FRAMES = 100_000


@query(f"with {P} select capture_id path, (row_number() over (partition by capture_id order by frame_index)-1)::bigint frame_index, case when proto='IKE' then {20 + 8 + 28 + len(_SA) // 2} when udp_encapsulated then 40 else 32 end + 14 + case when frame_index%3=0 then 4 else 0 end::bigint incl_len, 1::int linktype from p")
def src_capture_frames(spark, d):
    frames = _frames(spark, d).withColumn("part", F.floor(F.col("frame_index") / FILE_FRAMES))
    files = frames.groupBy("capture_id", "part").applyInPandas(_build, "path string, length long, content binary")
    sizes = frames.groupBy("capture_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("capture_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.concat_ws("/", "capture_id", "part").alias("path"), "capture_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return src.frames(files).join(first, "path").select(F.col("capture_id").alias("path"), (F.col("frame_index") + F.col("first")).alias("frame_index"), "incl_len", "linktype")


@query(SQL["src_capture_frames"])
def src_capture_ranges(spark, d):
    """The same captures as files in the shared folder, read by ranges of 16 KB."""
    where = shared_folder(spark)
    local = where.removeprefix("file://")

    def put(batches):
        from pyarrow import fs

        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                system, at = fs.FileSystem.from_uri(local)
                system.create_dir(at, recursive=True)
                with system.open_output_stream(f"{at}/{path.replace('/', '_')}.pcap") as f:
                    f.write(content)
            yield pdf[["path"]]

    frames = _frames(spark, d).withColumn("part", F.floor(F.col("frame_index") / FILE_FRAMES))
    files = frames.groupBy("capture_id", "part").applyInPandas(_build, "path string, length long, content binary")
    files.mapInPandas(put, "path string").count()
    rows = rg.frames_by_range(spark, f"{where}/*.pcap", 16 << 10)
    name = F.regexp_extract("path", "([^/_]+)_([0-9]+)[.]pcap$", 1)
    rows = rows.select(name.alias("capture"), F.regexp_extract("path", "_([0-9]+)[.]pcap$", 1).cast("long").alias("part"), "frame_index", "incl_len", "linktype")
    rows = _written(spark, rows)
    sizes = rows.groupBy("capture", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("capture").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col("capture").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    x = rows.join(first, (F.col("capture") == F.col("c")) & (F.col("part") == F.col("p")))
    return x.select(F.col("capture").alias("path"), (F.col("frame_index") + F.col("first")).alias("frame_index"), "incl_len", "linktype")


@query("select doc_id, lang, source, n_chars from documents")
def dataset_jsonl_roundtrip(spark, d):
    where = shared_folder(spark)
    src.write_jsonl(table(spark, d, "documents"), where, ["doc_id", "lang", "source", "n_chars"])
    return src.read_jsonl(spark, where, "doc_id long, lang string, source string, n_chars long").where("_corrupt is null").drop("_corrupt")


@query("""with s as (select user_id%30 run, count(*) packets, count(*) filter (event_type='signup') ike, count(*) filter (event_type='error' and user_id%4=0) esp, count(*) filter (event_type<>'click') ipv4 from events group by 1),
l as (select user_id%30 run, count(*) filter (event_type='signup' and user_id%3=0) ike, count(*) filter (event_type='error') esp from events where user_id%30%7<>0 group by 1),
x as (select run, greatest(packets, coalesce(l.ike,0), coalesce(l.esp,0)) packets, s.ike si, s.esp se, coalesce(l.ike,0) li, coalesce(l.esp,0) le, l.run is null nolog, ipv4 from s left join l using(run)),
y as (select *, packets<60 or si+li=0 or se+le=0 or ipv4=0 bad, not nolog and ((si>0)<>(li>0) or (se>0)<>(le>0)) differ from x)
select run, packets, case when bad then 'INVALID' when differ then 'UNVERIFIED' else 'VALID' end verdict, concat_ws('; ', case when packets<60 then 'too few packets' end, case when si+li=0 then 'no IKE' end, case when se+le=0 then 'no ESP' end, case when ipv4=0 then 'no IPv4' end, case when differ and not bad then 'sources disagree about IKE or ESP' end, case when nolog and not bad then 'no log' end) reasons from y""")
def capture_verdict(spark, d):
    e = table(spark, d, "events").withColumn("run", F.col("user_id") % 30)
    is_, n = (lambda k: F.col("event_type") == k), F.count_if
    scanned = e.groupBy("run").agg(F.count("*").alias("packets"), n(is_("signup")).alias("ike"), n(is_("error") & (F.col("user_id") % 4 == 0)).alias("esp"), n(F.col("event_type") != "click").alias("ipv4"), F.lit(0).alias("ipv6"))
    counts = e.where("run % 7 <> 0").groupBy("run").agg(n(is_("signup") & (F.col("user_id") % 3 == 0)).alias("isakmp"), n(is_("error")).alias("esp")).unpivot("run", ["isakmp", "esp"], "proto", "n")
    lines = counts.select("run", F.format_string("  %s   frames:%d bytes:1", "proto", "n").alias("line"))
    return runs.capture_verdict(scanned, runs.log_counts(lines, "run"), "run", 60, ip_version=4)


@query("select user_id run, event_type proto, max(cast(floor(value) as bigint)) logged from events group by 1,2")
def log_protocol_counts(spark, d):
    e = table(spark, d, "events")
    return runs.log_counts(e.select(F.col("user_id").alias("run"), F.concat(F.lit("   "), F.col("event_type"), F.lit("   frames:"), F.floor("value").cast("long"), F.lit(" bytes:7")).alias("line")), "run")


@query("""with g as (select user_id, bool_or(event_type='signup') a, bool_or(event_type='purchase') b, max(case when event_id%3=0 then event_type end) c, max(case when event_id%5=0 then event_type end) d, bool_or(event_type='view') e, bool_or(event_type='click') f, bool_or(event_type='error' and event_id%11=0) failed from events group by 1),
x as (select user_id, a ike_sa_verified, b child_sa_verified, coalesce(c,'')<>'' xfrm_state_verified, coalesce(d,'')<>'' xfrm_policy_verified, e and b protected_payload_verified, f esp_verified, failed from g),
y as (select *, concat_ws(',', case when not ike_sa_verified then 'ike_sa_verified' end, case when not child_sa_verified then 'child_sa_verified' end, case when not xfrm_state_verified then 'xfrm_state_verified' end, case when not xfrm_policy_verified then 'xfrm_policy_verified' end, case when not protected_payload_verified then 'protected_payload_verified' end, case when not esp_verified then 'esp_verified' end) unmet from x)
select * exclude(failed), case when failed then 'FAILED' when unmet='' then 'FINALIZED' else 'INCOMPLETE' end state from y""")
def gate_status(spark, d):
    has = lambda k: F.bool_or(F.col("event_type") == k)
    some = lambda n: F.max(F.when(F.col("event_id") % n == 0, F.col("event_type")))
    g = table(spark, d, "events").groupBy("user_id").agg(has("signup").alias("ike_established"), has("purchase").alias("child_installed"), some(3).alias("xfrm_state"), some(5).alias("xfrm_policy"), has("view").alias("protected_payload"), has("click").alias("esp_observed"), F.bool_or((F.col("event_type") == "error") & (F.col("event_id") % 11 == 0)).alias("failed"))
    return runs.gate_state(g, "user_id")


@query(f"""with gs as ({SQL["gate_status"]}), x as (select user_id, bool_or(event_id%13=0) blocked, case when user_id%3<>0 then count(*) filter (event_type='click')>1 end esp from events group by 1)
select user_id, case when state='FAILED' then 'INVALID' when blocked then 'BLOCKED' when unmet='' and coalesce(esp,false) then 'VALID' else 'INCOMPLETE' end status,
case when state='FAILED' then null when unmet='' and esp is null then 'all gates but no capture' when esp_verified and not esp then 'no ESP in the capture' end refused from gs join x using(user_id)""")
def run_status(spark, d):
    g = gate_status(spark, d)
    click = F.count_if(F.col("event_type") == "click") > 1
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("_u")).agg(F.bool_or(F.col("event_id") % 13 == 0).alias("blocked"), click.alias("c"))
    x = x.withColumn("esp_in_capture", F.when(F.col("_u") % 3 != 0, F.col("c")))
    return runs.run_status(g.join(x, F.col("user_id") == F.col("_u")), "user_id")


@query("select event_id, case when event_id%2=0 then event_type when event_id%3=0 then 'inner' when event_id%5=0 then 'deep' end encryption, (props->>'$.k')::bigint dh_group, case event_id%4 when 0 then true when 1 then false when 2 then true end replay_protection, case when event_id%7<>0 then user_id*60 end ike_lifetime from events")
def config_flatten(spark, d):
    """Configurations that hold a field at the top, in identity or in ipsec, under either of its names; the top comes first."""
    e, has = table(spark, d, "events"), lambda n, v: F.when(F.col("event_id") % n == 0, v)
    k = F.get_json_object("props", "$.k").cast("long")
    window = F.get(F.array(F.lit("on"), F.lit("false"), F.lit("1"), F.lit("maybe")), (F.col("event_id") % 4).cast("int"))
    identity = F.struct(has(3, F.lit("inner")).alias("encryption"), F.when(F.col("event_id") % 2 == 1, k).alias("ike_dh_group"))
    ipsec = F.struct(has(5, F.lit("deep")).alias("encryption"), F.lit("9").alias("dh_group"), F.when(F.col("event_id") % 7 != 0, F.col("user_id") * 60).alias("ike_lifetime_s"))
    doc = F.to_json(F.struct(has(2, F.col("event_type")).alias("encryption"), F.when(F.col("event_id") % 2 == 0, k).alias("dh_group"), window.alias("replay_window"), identity.alias("identity"), ipsec.alias("ipsec")))
    fields = {"encryption": "string", "dh_group": ("long", ("dh_group", "ike_dh_group")), "replay_protection": ("boolean", ("replay_protection", "replay_window")), "ike_lifetime": ("long", ("ike_sa_lifetime_s", "ike_lifetime_s"))}
    return runs.config_values(e.select("event_id", doc.alias("config")), "event_id", "config", fields).drop("_given")


@query("select conv_id, string_agg(text, '|' order by turn) filter (role='user') user_texts, count(*) filter (role<>'user') others from conversations where text is not null group by 1")
def proposal_flatten(spark, d):
    g = runs.by_kind(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", {"user": "user"})
    return g.select("conv_id", F.when(F.size("user") > 0, F.array_join("user", "|")).alias("user_texts"), "others")


@query("select conv_id, count(*) stages, count(*) filter (length(text)>=40) usable, min(turn) first_turn from conversations group by 1")
def bundle_summary(spark, d):
    stages = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("component"), F.when(F.length("text") >= 40, "ok").otherwise("bad").alias("status"))
    back = runs.document_stages(runs.stage_documents(stages, "conv_id", "turn"), "conv_id", "turn")
    return back.groupBy("conv_id").agg(F.count("*").alias("stages"), F.count_if(F.col("status") == "ok").alias("usable"), F.min("turn").alias("first_turn"))


@query("select case when n_chars>=20 then doc_id end doc_id, case when n_chars<20 then 'broken' when source is null then 'no source' end reason from documents")
def manifest_scan(spark, d):
    """Documents as files of JSON, one to a line, those of short texts cut short; the files are scanned again."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    where = shared_folder(spark)
    docs.select(F.when(F.col("n_chars") < 20, "{broken").otherwise(F.to_json(F.struct("doc_id", "source", "n_chars")))).write.text(where)
    return runs.scan_documents(spark, where, "doc_id long, source string, n_chars long", ("source",), lines=True).select("doc_id", "reason")


@query(f"with {P}, {FLOWS} select * from fl")
def stream_flow_summary(spark, d):
    return sf.stream_flow_summary(_stream(spark, d), shared_folder(spark))


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return e.selectExpr("date_format(ts,'yyyy-MM-dd') capture_id", "event_id frame_index", "case when event_type='signup' then 'IKE' else 'ESP' end proto", "user_id%8 spi_int", "case when user_id%2=0 then 'A' else 'B' end src", "cast(floor(value) as bigint)+64 length", "cast(get_json_object(props,'$.k') as bigint) seq", "event_type='error' udp_encapsulated")


@query(f"with {P} select capture_id, spi_int, coalesce(sum(case when s>1 then s-1 end),0)::bigint gaps, count(*) filter (s<0) steps_back, count(seq)-count(distinct seq) repeats, count(*) packets from (select *, seq-lag(seq) over (partition by capture_id, spi_int order by frame_index) s from p where proto='ESP') group by 1,2")
def stream_sequence_health(spark, d):
    return sf.stream_sequence_health(_stream(spark, d), shared_folder(spark))


#: Arrival: events come in batches of ten days, every 40th with the next batch.
_ARRIVAL = "cast(floor((day(ts)-1)/10.0) + case when event_id%40=0 then 1 else 0 end as int)"


@query(f"""with a as (select strftime(ts,'%Y-%m') capture_id, ts, cast(floor(value) as bigint)+64 as length, {_ARRIVAL} b from events where ts is not null), m as (select b, max(ts) t from a group by 1),
k as (select a.*, time_bucket(interval '1 hour', ts) as start, (select max(t) from m where m.b<a.b) - interval '1 day' mark from a), c as (select *, mark is null or start + interval '1 hour' > mark as intime from k)
select capture_id, strftime(start, '%Y-%m-%d %H:%M') as start, count(*) filter (intime) packets, coalesce(sum(length) filter (intime),0)::bigint bytes, count(*) filter (not intime) late from c where start + interval '1 hour' <= (select max(ts) from a) - interval '1 day' group by 1,2""")
def stream_closed_windows(spark, d):
    """Hours of events, some of which come too late. What has arrived is read again after each arrival, from where the stream had
    ended; each time the watermark moves on to what came before."""
    landing, where = shared_folder(spark), shared_folder(spark)
    e = table(spark, d, "events").where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr("date_format(ts,'yyyy-MM') capture_id", "ts", "cast(floor(value) as bigint)+64 length", f"{_ARRIVAL} b")
    out = None
    for b in [r[0] for r in e.select("b").distinct().orderBy("b").collect()]:
        e.where(F.col("b") == b).drop("b").write.mode("append").parquet(landing)
        out = sf.closed_windows(spark.readStream.schema(e.drop("b").schema).parquet(landing), where, "1 day", "1 hour")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


# models: all rows and components of embeddings, split by their id

_F = [f"f{k}" for k in range(64)]


def _rows(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label"), *(F.get("embedding", F.lit(k)).cast("double").alias(f) for k, f in enumerate(_F)))
    return e.withColumn("split", grouped_split("vec_id", "42", {"train": 0.7, "validation": 0.15, "test": 0.15}))


def _models():
    return tr.candidates()


def _logistic():
    return tr.candidates()["logistic"][1]


@query()
def train_candidates(spark, d):
    rows = _written(spark, _rows(spark, d))
    return tr.compare(rows, _F, "vec_id", _models())


@query()
def ablation(spark, d):
    return tr.ablation(_rows(spark, d).persist(), {"all": _F, "first": _F[:32], "last": _F[32:]}, "vec_id", _logistic())


@query()
def importance_groups(spark, d):
    return tr.importances(tr.fit(_rows(spark, d), _F, _models()["forest"][1]), _F, {f: "first" if k < 32 else "last" for k, f in enumerate(_F)})


@query()
def score_batch(spark, d):
    rows = _rows(spark, d)
    return tr.score(tr.fit(rows, _F, _logistic()), rows, "vec_id")


@query()
def calibrate(spark, d):
    rows = _rows(spark, d).persist()
    return tr.calibrate(tr.score(tr.fit(rows, _F, _logistic()), rows, "vec_id").persist(), "vec_id", 10)


@query()
def heldout_class(spark, d):
    return tr.heldout_class(_rows(spark, d).persist(), _F, "vec_id", 9, _logistic(), [0.1, 0.15, 0.2, 0.3])


@query()
def heldout_config(spark, d):
    return tr.heldout_config(_rows(spark, d).persist(), _F, "vec_id", F.col("vec_id") % 5 == 0, _logistic())


@query()
def mitigation_experiment(spark, d):
    return tr.mitigation(_rows(spark, d).persist(), _F, "vec_id", _logistic(), lambda r: r.withColumns({f: F.round(F.col(f), 0) for f in _F}))


#: A model of two trees for each of three classes: the feature and edge of each tree's only split, and what its leaves add.
_STUMPS = [[(0, 0.0, -0.75, 0.5), (1, 0.1, 0.25, -0.5), (2, -0.1, 0.125, 0.75)], [(3, 0.0, -0.25, 1.0), (4, 0.05, 0.5, -1.0), (5, 0.0, -0.375, 0.25)]]
_START = [0.25, -0.5, 0.0]


def _stumps() -> PipelineModel:
    edges = [np.array(sorted({e for r in _STUMPS for f, e, *_ in r if f == k})) for k in range(6)]
    leaf = lambda f, e, a, b: Tree(np.array([f, 0, 0]), np.array([0, 0, 0]), np.array([1, 0, 0]), np.array([0.0, a, b]), np.array([1.0, 0.0, 0.0]))
    trees = [[leaf(*t) for t in r] for r in _STUMPS]
    return PipelineModel([VectorAssembler(inputCols=_F[:6], outputCol="features"), BoostedModel([0, 1, 2], edges, np.array(_START), trees)])


_MARGINS = [" + ".join([f"{_START[c]}::double", *(f"case when embedding[{r[c][0] + 1}]::double > {r[c][1]} then {r[c][3]} else {r[c][2]} end::double" for r in _STUMPS)]) for c in range(3)]
_SCORED = ", ".join(f"{m} m{c}" for c, m in enumerate(_MARGINS))


@query(f"""with m as (select vec_id, label truth, {_SCORED} from embeddings), e as (select *, greatest(m0,m1,m2) top, exp(m0-greatest(m0,m1,m2)) e0, exp(m1-greatest(m0,m1,m2)) e1, exp(m2-greatest(m0,m1,m2)) e2 from m)
select vec_id, truth, case top when m0 then 0 when m1 then 1 else 2 end::int predicted, round(1/(e0+e1+e2),6) confidence, round(e0/(e0+e1+e2),6) p0, round(e1/(e0+e1+e2),6) p1, round(e2/(e0+e1+e2),6) p2 from e""")
def score_stored(spark, d):
    """All embeddings scored by the newest model of a store that can be used: one of two that were kept for the schema asked for;
    a newer one is of another schema."""
    rows, store = _rows(spark, d), new_store(spark)
    card = {"model_id": "stumps", "feature_schema": "f/1", "classes": [0, 1, 2], "algorithm": "boosted", "trained_at": "2024-01-02T00:00:00Z"}
    other = tr.fit(rows, _F[:6], tr.candidates(depth=2)["tree"][1])
    store.save("a", other, {**card, "model_id": "tree", "trained_at": "2024-01-01T00:00:00Z"}, _F)
    store.save("b", _stumps(), card, _F)
    store.save("c", other, {**card, "feature_schema": "f/2", "trained_at": "2024-01-03T00:00:00Z"}, _F)
    p = lambda k: F.get("probabilities", F.lit(k)).alias(f"p{k}")
    return store.score_latest(rows, "vec_id", "f/1").select("vec_id", "truth", "predicted", "confidence", p(0), p(1), p(2))


@query("""with x as (select * from (values ('m0',0,2,'f/1'),('m1',1,1,'f/1'),('m2',2,0,'f/2')) v(directory, k, age, feature_schema)),
r as (select x.*, label from x join embeddings on label is not null and vec_id%3=k), c as (select directory, any_value(feature_schema) feature_schema, string_agg(distinct label::varchar, ',' order by label::varchar) classes, count(*) "rows", any_value(age) age from r group by 1)
select directory, feature_schema, classes, "rows", strftime((select max(ts) from events) - to_days(age), '%Y-%m-%dT%H:%M:%SZ') trained_at, case when feature_schema<>'f/1' then 'other feature schema' when directory='m1' then 'no pipeline' end problem, directory='m0' selected from c""")
def model_cards(spark, d):
    """Cards of models for three parts of the embeddings: one that can be used, one whose pipeline is lost, one of another schema;
    a fourth pipeline has no card and is not found."""
    rows, store = _rows(spark, d).where("label is not null"), new_store(spark)
    last = table(spark, d, "events").agg(F.max("ts").alias("t"))
    parts = rows.groupBy((F.col("vec_id") % 3).cast("int").alias("k")).agg(F.sort_array(F.collect_set(F.col("label").cast("string"))).alias("classes"), F.count("*").alias("n")).crossJoin(last)
    made = F.date_format(F.expr("t - make_dt_interval(2 - k)"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("made")
    for r in parts.select("k", "classes", "n", made).orderBy("k").collect():
        card = {"model_id": "m", "feature_schema": "f/2" if r.k == 2 else "f/1", "classes": r.classes, "trained_at": r.made, "dataset": {"rows": str(r.n)}}
        if r.k == 1:
            store.card("m1", {**card, "feature_names": _F[:6]})
        else:
            store.save(f"m{r.k}", _stumps(), card, _F)
    _stumps().save(f"{store.where}/m9/pipeline")
    cards, best = store.cards("f/1"), store.status("f/1").select("selected")
    out = cards.join(best, F.col("directory") == F.col("selected"), "left")
    return out.select("directory", "feature_schema", F.array_join("classes", ",").alias("classes"), F.col("dataset")["rows"].cast("long").alias("rows"), "trained_at", "problem", F.col("selected").isNotNull().alias("selected"))
