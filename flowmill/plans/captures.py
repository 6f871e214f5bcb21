"""Queries over packets (view P) and over the probability table (view T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.columns import rounded
from flowmill.operators import evaluate as ev
from flowmill.operators import flows as fl
from flowmill.operators.training import Padding
from flowmill.plans.views import FLOWS, HEALTH, TOP, P, T, packets, scores, t_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {P} select capture_id, count(*) packets, sum(length)::bigint captured_bytes, count(*) ipv4_packets, 0::bigint ipv6_packets, count(*) filter (proto='ESP') esp_packets, 0::bigint ah_packets, count(*) filter (proto='IKE') ike_packets, 0::bigint icmp_packets, 0::bigint truncated_frames from p group by 1")
def capture_counters(spark, d):
    return fl.capture_counters(packets(spark, d))


@query(f"with {P}, {FLOWS} select * from fl")
def flow_summary(spark, d):
    return fl.flow_summary(packets(spark, d))


@query(f"with {P}, {HEALTH} select * from sh")
def flow_sequence_health(spark, d):
    return fl.sequence_health(packets(spark, d))


_A = "a as (select capture_id, count(*)::double n, sum(length)::double b, greatest(arg_max(ts_s,frame_index)-arg_min(ts_s,frame_index),0.0) d, count(*) filter (proto='ESP')::double esp, count(*) filter (proto='IKE')::double ike from p group by 1)"
_CAP = "n capture_packets, b capture_bytes, round(d,6) capture_duration_s, round(coalesce(n/nullif(d,0),0),6) packet_rate_pps, round(coalesce(b/nullif(d,0),0),6) byte_rate_bps, round(b/n,6) avg_packet_len, round(esp/n,6) esp_packet_share, round(ike/n,6) ike_packet_share, 0.0::double icmp_packet_share, 0.0::double ipv6_packet_share, 0.0::double truncated_packet_share"
_V = "v as (select capture_id, count(*)::double vn, sum(length)::double vb, min(length)::double lo, max(length)::double hi, stddev_pop(length) sd, count(distinct spi_int)::double f from p where proto='ESP' group by 1), vt as (select capture_id, max(packets)::double top from fl group by 1)"
_VOL = "vn esp_packets, vb esp_bytes, f esp_flow_count, round(vb/vn,6) esp_avg_len, lo esp_len_min, hi esp_len_max, round(sd,6) esp_len_std, round(vn/f,6) esp_avg_packets_per_flow, round(vb/f,6) esp_avg_bytes_per_flow, round(top/vn,6) esp_largest_flow_share"
_D = "ini as (select capture_id, arg_min(src,frame_index) s from p where proto='ESP' group by 1), dr as (select capture_id, count(*) filter (src=s)::double fp, count(*) filter (src<>s)::double bp, coalesce(sum(length) filter (src=s),0)::double fb, coalesce(sum(length) filter (src<>s),0)::double bb from p join ini using(capture_id) where proto='ESP' group by 1)"
_DIR = "fp esp_fwd_packets, bp esp_bwd_packets, fb esp_fwd_bytes, bb esp_bwd_bytes, round(fp/(fp+bp),6) esp_fwd_packet_share, round(fb/(fb+bb),6) esp_fwd_byte_share"
_T = "tm as (select capture_id, coalesce(avg(iat),0) m, coalesce(stddev_pop(iat),0) sd2, coalesce(max(iat),0) mx, greatest(arg_max(ts_s,frame_index)-arg_min(ts_s,frame_index),0.0) sp from (select *, ts_s-lag(ts_s) over (partition by capture_id order by frame_index) iat from p where proto='ESP') group by 1)"
_TIM = "round(m,6) esp_iat_mean_s, round(sd2,6) esp_iat_std_s, round(mx,6) esp_iat_max_s, round(sp,6) esp_span_s"
_H = "hh as (select capture_id, sum(sequence_gaps)::double g, sum(sequence_replays)::double r, count(*) filter (not sequence_monotonic)::double nm, count(*)::double hf from sh group by 1), hu as (select capture_id, count(*) filter (proto='ESP')::double hn, count(*) filter (proto='ESP' and udp_encapsulated)::double u, count(*) filter (proto='IKE')::double k, count(*) filter (proto='IKE' and length%4<>0)::double x from p group by 1)"
_HEA = "g esp_seq_gap_total, r esp_seq_replay_total, round(nm/hf,6) esp_nonmonotonic_flow_share, round(u/hn,6) esp_udp_encap_share, k ike_packet_count, x ike_exchange_count"


def _parsed(spark, d):
    """P with a mark on IKE packets that were understood: those whose length four does not divide."""
    return packets(spark, d).withColumn("ike_parsed", F.col("length") % 4 != 0)


@query(f"with {P}, {_A} select capture_id, {_CAP} from a")
def features_capture(spark, d):
    return rounded(fl.features_capture(packets(spark, d)), *fl.FAMILIES["capture"])


@query(f"with {P}, {FLOWS}, {_V} select capture_id, {_VOL} from v join vt using(capture_id)")
def features_volume(spark, d):
    return rounded(fl.features_volume(packets(spark, d)), *fl.FAMILIES["volume"])


@query(f"with {P}, {_D} select capture_id, {_DIR} from dr")
def features_direction(spark, d):
    return rounded(fl.features_direction(packets(spark, d)), *fl.FAMILIES["direction"])


@query(f"with {P}, {_T} select capture_id, {_TIM} from tm")
def features_timing(spark, d):
    return rounded(fl.features_timing(packets(spark, d)), *fl.FAMILIES["timing"])


@query(f"with {P}, {HEALTH}, {_H} select capture_id, {_HEA} from hh join hu using(capture_id)")
def features_health(spark, d):
    return rounded(fl.features_health(_parsed(spark, d)), *fl.FAMILIES["health"])


@query(f"with {P}, {FLOWS}, {HEALTH}, {_A}, {_V}, {_D}, {_T}, {_H} select capture_id, {_CAP}, {_VOL}, {_DIR}, {_TIM}, {_HEA} from a join v using(capture_id) join vt using(capture_id) join dr using(capture_id) join tm using(capture_id) join hh using(capture_id) join hu using(capture_id)")
def features_all(spark, d):
    return rounded(fl.features_all(_parsed(spark, d)), *fl.FEATURES)


@query(f"with {P}, {FLOWS}, {HEALTH} select capture_id, count(*) flows, sum(packets)::bigint esp_packets, sum(bytes_total)::bigint esp_bytes, max(packets) largest_flow_packets, sum(sequence_gaps)::bigint gaps, sum(sequence_replays)::bigint replays, bool_and(sequence_monotonic) monotonic, bool_or(udp_encapsulated) udp_encapsulated from fl join sh using(capture_id, spi_int) group by 1")
def metadata_summary(spark, d):
    return fl.metadata_summary(packets(spark, d))


_PAD = "greatest(floor({0}), ceil(floor({0})/64)*64.0)"


@query(f"with {P}, {FLOWS}, {_A}, {_V} select capture_id, {', '.join(_PAD.format(e) + ' ' + n for e, n in (('vb', 'esp_bytes'), ('round(vb/vn,6)', 'esp_avg_len'), ('lo', 'esp_len_min'), ('hi', 'esp_len_max'), ('round(b/n,6)', 'avg_packet_len')))} from a join v using(capture_id)")
def pad_sizes(spark, d):
    x = rounded(fl.features_all(packets(spark, d)), *fl.FEATURES).select("capture_id", *fl.SIZES)
    return fl.pad_sizes(x, 64)


@query(f"with {P}, {_V.split(', vt as')[0]}, x as (select round(vb/vn,6) b, {_PAD.format('round(vb/vn,6)')} a from v) select round(avg(b),6) mean_before, round(avg(a),6) mean_after, round(100*(avg(a)-avg(b))/avg(b),6) overhead_percent from x")
def pad_overhead(spark, d):
    x = rounded(fl.features_volume(packets(spark, d)), "esp_avg_len").select("capture_id", "esp_avg_len")
    return Padding(64).overhead(x)


def _predictions(spark, d):
    """A prediction for two of three captures, by the day of the month; every fifth day's model is not known."""
    x = packets(spark, d).select("capture_id").distinct().withColumn("dd", F.substring("capture_id", 9, 2).cast("int")).where("dd % 3 <> 0")
    return x.select("capture_id", (F.col("dd") % 10 / 10).alias("confidence"), F.when(F.col("dd") % 5 != 0, F.lit("m")).alias("model_id"), F.lit("1").alias("model_version"), F.lit("s").alias("feature_schema"))


_OBS = """ob as (select capture_id, observation, exposure, case exposure when 'none' then 1 when 'low' then 2 when 'medium' then 3 when 'high' then 4 end points from (select capture_id, u.o observation, u.e exposure from (
select capture_id, unnest([{'o':'endpoint-identity','e':case when flows>0 then 'high' else 'unknown' end},{'o':'sa-identifiers','e':case when flows>0 then 'medium' else 'unknown' end},{'o':'negotiation-disclosure','e':case when ike>0 then 'medium' else 'unknown' end},
{'o':'volume-profile','e':case when flows>1 then 'medium' when flows=1 then 'low' else 'unknown' end},{'o':'cleartext-context','e':case when 100.0*(n-esp)/n>=25 then 'high' when n>esp then 'medium' else 'none' end},{'o':'class-inference','e':case when dd%3=0 then 'unknown' when (dd%10)/10.0>=0.8 then 'high' else 'medium' end}]) u
from (select capture_id, substr(capture_id,9,2)::int dd, count(*) n, count(*) filter (proto='ESP') esp, count(*) filter (proto='IKE') ike, count(distinct spi_int) filter (proto='ESP') flows from p group by 1))))"""


@query(f"with {P}, {_OBS} select * from ob")
def exposure_observations(spark, d):
    return fl.exposure_observations(packets(spark, d), predictions=_predictions(spark, d))


@query(f"with {P}, {_OBS}, s as (select capture_id, round(100.0*coalesce(sum(points),0)/(4*count(points)),0)::int privacy_risk, round(100.0*count(points)/count(*),0)::int coverage_percent, arg_min(observation, {{'p':-points,'o':observation}}) filter (points is not null) top_observation from ob group by 1) select *, case when privacy_risk<25 then 'low' when privacy_risk<50 then 'moderate' when privacy_risk<75 then 'elevated' else 'high' end band from s")
def exposure_score(spark, d):
    return fl.exposure_score(fl.exposure_observations(packets(spark, d), predictions=_predictions(spark, d)))


@query(f"with {P}, {FLOWS}, x as (select capture_id, count(*) f, sum(packets) n, count(src) e, bool_or(udp_encapsulated) u from fl group by 1), y as (select capture_id, concat_ws(',', case when f>1 then 'association_split' end, case when n>=20 then 'volume' end, case when e>0 then 'peer_addresses' end, case when u then 'nat_binding' end, case when n>0 then 'payload_sizes' end, case when n>1 then 'timing' end) dimensions, substr(capture_id,9,2)::int dd from x), z as (select *, dd%3<>0 and dd%5<>0 ok, case when dd%3<>0 and dd%5<>0 then (dd%10)/10.0::double end cf from y) select capture_id, ok ml_available, cf ml_confidence, case when cf>=0.8 then 'HIGH' when cf>=0.6 then 'MODERATE' when cf is not null then 'LOW' when len(string_split(dimensions,','))>=4 then 'MODERATE' else 'LOW' end inference_risk, dimensions, len(string_split(dimensions,',')) n_dimensions, case when len(string_split(dimensions,','))>=4 then 'HIGH' when len(string_split(dimensions,','))>=2 then 'MODERATE' else 'LOW' end band from z")
def fingerprintability(spark, d):
    return fl.fingerprintability(packets(spark, d), predictions=_predictions(spark, d))


@query(f"with {T}, {TOP} select * from tl")
def top_label(spark, d):
    return ev.top_label(scores(spark, d))


_RK = "rk as (select row_id, any_value(truth) truth, max(class) filter (k=1) top1, max(p) filter (k=1) p1, max(class) filter (k=2) top2, max(p) filter (k=2) p2, round(max(p) filter (k=1)-max(p) filter (k=2),6) margin from (select *, row_number() over (partition by row_id order by p desc, class) k from t) group by 1)"
_EN = "en as (select row_id, round(-sum(case when p>0 then p*log2(p) else 0 end),6) entropy from t group by 1)"


@query(f"with {T}, {_RK} select * from rk")
def ranked_alternatives(spark, d):
    return ev.ranked(scores(spark, d))


@query(f"with {T}, {_EN} select * from en")
def entropy_bits(spark, d):
    return ev.entropy_bits(scores(spark, d))


def _conf(t: str, n: str) -> str:
    return f"""b{n} as (select round(avg(s),6) brier from (select sum((p-(class=truth)::int)*(p-(class=truth)::int)) s from {t} group by row_id)), l{n} as (select round(avg(-ln(greatest(p,1e-15))),6) log_loss from {t} where class=truth),
tl{n} as (select row_id, any_value(truth) truth, arg_max(class, {{'p':p,'k':class}}) predicted, max(p) confidence from {t} group by 1),
rc{n} as (select least(floor(confidence*10),9)::int bin, count(*) n, round(avg(confidence),6) mean_confidence, round(avg((predicted=truth)::int::double),6) accuracy from tl{n} group by 1), e{n} as (select round(sum(n*abs(mean_confidence-accuracy))/sum(n),6) ece from rc{n}),
m{n} as (select round(avg(h),6) mean_entropy from (select round(-sum(case when p>0 then p*log2(p) else 0 end),6) h from {t} group by row_id))"""


@query(f"with {T}, {_conf('t', '')} select * from b")
def brier(spark, d):
    return ev.brier(scores(spark, d))


@query(f"with {T}, {_conf('t', '')} select * from l")
def log_loss(spark, d):
    return ev.log_loss(scores(spark, d))


@query(f"with {T}, {_conf('t', '')} select * from rc")
def reliability_curve(spark, d):
    return ev.reliability_curve(scores(spark, d))


@query(f"with {T}, {_conf('t', '')} select * from e")
def ece(spark, d):
    return ev.ece(scores(spark, d))


@query(f"""with {T}, {t_sql('t2', 2)}, {_conf('t', '1')}, {_conf('t2', '2')}, x as (select unnest([{{'m':'brier','b':b1.brier,'a':b2.brier}},{{'m':'log_loss','b':l1.log_loss,'a':l2.log_loss}},{{'m':'ece','b':e1.ece,'a':e2.ece}},{{'m':'mean_entropy','b':m1.mean_entropy,'a':m2.mean_entropy}}]) u from b1,b2,l1,l2,e1,e2,m1,m2)
select u.m measure, u.b before, u.a "after", round(u.a-u.b,6) delta from x""")
def calibration_compare(spark, d):
    return ev.calibration_compare(scores(spark, d), scores(spark, d, sharpen=True))


_CM = "cl as (select truth c from tl union select predicted from tl), cm as (select a.c truth, b.c predicted, coalesce(n,0) n from cl a cross join cl b left join (select truth, predicted, count(*) n from tl group by 1,2) x on x.truth=a.c and x.predicted=b.c)"
_PC = 'pc as (select c as class, tp/nullif(called,0) p0, tp/nullif(support,0) r0, support from (select c, (select sum(n) from cm where truth=c and predicted=c)::double tp, (select sum(n) from cm where predicted=c)::double called, (select sum(n) from cm where truth=c)::bigint support from cl)), pm as (select class, round(coalesce(p0,0),6) "precision", round(coalesce(r0,0),6) recall, round(coalesce(2*p0*r0/nullif(p0+r0,0),0),6) f1, support from pc)'


def _labels(spark, d):
    return ev.top_label(scores(spark, d)).select("row_id", "truth", "predicted", "confidence")


@query(f"with {T}, {TOP}, {_CM} select * from cm")
def confusion_matrix(spark, d):
    return ev.confusion_matrix(_labels(spark, d))


@query(f"with {T}, {TOP}, {_CM}, {_PC} select * from pm")
def per_class_metrics(spark, d):
    return ev.per_class_metrics(_labels(spark, d))


@query(f"""with {T}, {TOP}, {_CM}, {_PC} select round(avg(coalesce(p0,0)),6) macro_precision, round(avg(coalesce(r0,0)),6) macro_recall, round(avg(coalesce(2*p0*r0/nullif(p0+r0,0),0)),6) macro_f1, (select round(avg((truth=predicted)::int::double),6) from tl) accuracy, (select count(*) from tl) "rows" from pc""")
def macro_metrics(spark, d):
    return ev.macro_metrics(_labels(spark, d))


_OW = "ow as (select row_id, truth, top1 predicted, p1 confidence, concat_ws(',', case when p1<0.16 then 'low_confidence' end, case when margin<0.01 then 'small_margin' end, case when entropy>3.2 then 'high_entropy' end) reasons from rk join en using(row_id)), od as (select *, case when reasons='' then 'KNOWN' else 'UNKNOWN' end decision from ow)"
_RATES = "round(count(*) filter (a)/count(*)::double,6) coverage, round(coalesce(count(*) filter (k and a)/nullif(count(*) filter (k),0)::double,0),6) known_acceptance, round(1-coalesce(count(*) filter (k and a)/nullif(count(*) filter (k),0)::double,0),6) false_rejection, round(coalesce(count(*) filter (k and a and h)/nullif(count(*) filter (k and a),0)::double,0),6) accuracy_when_accepted, round(count(*) filter (not k and not a)/nullif(count(*) filter (not k),0)::double,6) unknown_rejection"
def _known():
    return F.col("truth") < 8


@query(f"with {T}, {_RK}, {_EN}, {_OW} select * from od")
def open_world_decide(spark, d):
    return ev.open_world_decide(scores(spark, d))


@query(f"with {T}, {_RK}, {_EN}, {_OW}, x as (select decision='KNOWN' a, truth<8 k, truth=predicted h from od) select {_RATES} from x")
def open_world_metrics(spark, d):
    return ev.open_world_metrics(ev.open_world_decide(scores(spark, d)), _known())


_TH = [0.1, 0.14, 0.16, 0.18, 0.2, 0.25, 0.3]
_SW = f"sw as (select threshold, {_RATES} from (select threshold, confidence>=threshold a, truth<8 k, truth=predicted h from tl, (select unnest({_TH}::double[]) threshold)) group by 1)"


@query(f"with {T}, {TOP}, {_SW} select * from sw")
def threshold_sweep(spark, d):
    return ev.threshold_sweep(_labels(spark, d), _TH, _known())


@query(f"with {T}, {TOP}, {_SW} select arg_max(threshold, {{'a':coalesce(accuracy_when_accepted,-1),'b':coalesce(known_acceptance,-1),'c':-threshold}}) threshold from sw")
def threshold_choice(spark, d):
    return ev.threshold_choice(ev.threshold_sweep(_labels(spark, d), _TH, _known()))


@query(f"with {T}, {_RK} select row_id, top1 predicted, case when row_id%3=0 and truth is not null then 'carries an answer' end refused, round(-log2(p1),4) surprise_bits, margin, row_id%3<>0 or truth is null complete from rk")
def prediction_contract(spark, d):
    x = ev.ranked(scores(spark, d)).select("row_id", F.col("top1").alias("predicted"), F.col("p1").alias("confidence"), "p2", "margin", F.lit("m1").alias("model_id"), F.when(F.col("row_id") % 3 == 0, F.col("truth")).alias("label"))
    return ev.prediction_contract(x)
