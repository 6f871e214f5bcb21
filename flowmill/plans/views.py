"""The views over the driver tables that queries run on, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: events as packets; a day is a capture."""
    return table(spark, sf_dir, "events").selectExpr(
        "date_format(ts,'yyyy-MM-dd') capture_id", "event_id frame_index", "unix_micros(cast(ts as timestamp))/1e6D ts_s", "case when event_type='signup' then 'IKE' else 'ESP' end proto",
        "user_id%8 spi_int", "case when user_id%2=0 then 'A' else 'B' end src", "cast(floor(value) as bigint)+64 length", "cast(get_json_object(props,'$.k') as bigint) seq", "event_type='error' udp_encapsulated",
    )


P = """p as (select strftime(ts,'%Y-%m-%d') capture_id, event_id frame_index, epoch_us(ts)/1e6::DOUBLE ts_s, case when event_type='signup' then 'IKE' else 'ESP' end proto,
user_id%8 spi_int, case when user_id%2=0 then 'A' else 'B' end src, cast(floor(value) as bigint)+64 as length, (props->>'$.k')::BIGINT seq, event_type='error' udp_encapsulated from events)"""
FLOWS = "fl as (select capture_id, spi_int, count(*) packets, sum(length)::bigint bytes_total, arg_min(src, frame_index) src, min(frame_index) first_frame, max(frame_index) last_frame, bool_or(udp_encapsulated) udp_encapsulated from p where proto='ESP' group by 1,2)"
HEALTH = """sh as (select capture_id, spi_int, coalesce(sum(case when step>1 then step-1 end),0)::bigint sequence_gaps, (count(seq)-count(distinct seq))::bigint sequence_replays, count(*) filter (step<0)=0 sequence_monotonic
from (select *, seq-lag(seq) over (partition by capture_id, spi_int order by frame_index) step from p where proto='ESP') group by 1,2)"""


def scores(spark: SparkSession, sf_dir: str, sharpen: bool = False) -> DataFrame:
    """T: a probability table over classes 0..9 from the first ten components of each embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("truth"), F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double"))).alias("a"))
    if sharpen:
        e = e.withColumn("a", F.transform("a", lambda x: x * x))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    return e.select("row_id", "truth", F.posexplode("a").alias("class", "v"), total.alias("t")).select("row_id", "truth", "class", F.round(F.col("v") / F.col("t"), 6).alias("p"))


def t_sql(name: str = "t", power: int = 1) -> str:
    v = "abs(embedding[k+1]::DOUBLE)" + " * abs(embedding[k+1]::DOUBLE)" * (power - 1)
    total = " + ".join(f"(abs(embedding[{k}]::DOUBLE)" + f" * abs(embedding[{k}]::DOUBLE)" * (power - 1) + ")" for k in range(1, 11))
    return f"{name} as (select vec_id row_id, label truth, k::int as class, round(({v}) / (0.0::DOUBLE + {total}), 6) p from embeddings, range(0,10) r(k))"


T = t_sql()
TOP = "tl as (select row_id, any_value(truth) truth, arg_max(class, {'p':p,'k':class}) predicted, max(p) confidence from t group by 1)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K: an amount in hundredths for each order from three sources."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("cast(round(o_totalprice*100) as bigint)").alias("declared"), "o_custkey", "o_orderpriority", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.expr("sum(cast(round(l_extendedprice*100) as bigint))").alias("extracted"))
    ext = F.when(F.col("o_orderkey") % 3 == 0, F.col("declared") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return o.withColumn("external", ext).join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


K = """k as (select o_orderkey, cast(round(o_totalprice*100) as bigint) declared, case when o_orderkey%3=0 then cast(round(o_totalprice*100) as bigint)+case when o_orderkey%7=0 then 1 else 0 end end as "external", extracted, o_custkey, o_orderpriority, o_orderstatus
from orders left join (select l_orderkey, sum(cast(round(l_extendedprice*100) as bigint))::bigint extracted from lineitem group by 1) on o_orderkey=l_orderkey)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: six findings for each capture of P."""
    p = packets(spark, sf_dir).groupBy("capture_id").agg(F.count_if(F.col("proto") == "ESP").alias("esp"), F.bool_or("udp_encapsulated").alias("udp"), F.count_distinct("spi_int").alias("spis"))
    p = p.withColumn("dd", F.substring("capture_id", 9, 2).cast("int"))
    return p.selectExpr("capture_id", """stack(6,
 'CRYPTO-001', 1, 'CRYPTOGRAPHY', 'ike_encryption', case dd%4 when 0 then 'PASS' when 1 then 'FAIL' when 2 then 'WARNING' else 'NOT_VERIFIABLE' end, case dd%3 when 0 then 'OBSERVED' when 1 then 'CONFIGURED' else 'NOT_VERIFIABLE' end, case when dd%2=0 then 20D else 12D end, 1D,
 'KEYX-003', 2, 'KEY_EXCHANGE', 'pfs', case when dd%2=0 then 'PASS' else 'FAIL' end, 'CONFIGURED', 20D, 1D,
 'KEYX-004', 3, 'KEY_EXCHANGE', 'pfs', case when dd%3=0 then 'FAIL' else 'WARNING' end, 'CONFIGURED', 20D, 1D,
 'SA-003', 4, 'SA_SECURITY', 'encapsulation', case when udp then 'WARNING' else 'PASS' end, 'OBSERVED', 2D, 1D,
 'META-002', 5, 'METADATA_PRIVACY', 'volume_exposure', case when esp>=250 then 'WARNING' else 'NOT_VERIFIABLE' end, case when esp>=250 then 'OBSERVED' else 'NOT_VERIFIABLE' end, 3D, 1D,
 'META-003', 6, 'METADATA_PRIVACY', 'class_inference', 'WARNING', 'INFERRED', 6D, spis/10D) as (rule_id, ordinal, category, property_key, status, evidence_status, base, confidence)""")


C = P + """, cx as (select capture_id, count(*) filter (proto='ESP') esp, bool_or(udp_encapsulated) udp, count(distinct spi_int) spis, substr(capture_id,9,2)::int dd from p group by 1),
c as (select capture_id, 'CRYPTO-001' rule_id, 1 ordinal, 'CRYPTOGRAPHY' category, 'ike_encryption' property_key, case dd%4 when 0 then 'PASS' when 1 then 'FAIL' when 2 then 'WARNING' else 'NOT_VERIFIABLE' end status, case dd%3 when 0 then 'OBSERVED' when 1 then 'CONFIGURED' else 'NOT_VERIFIABLE' end evidence_status, case when dd%2=0 then 20.0::DOUBLE else 12.0::DOUBLE end base, 1.0::DOUBLE confidence from cx
union all select capture_id, 'KEYX-003', 2, 'KEY_EXCHANGE', 'pfs', case when dd%2=0 then 'PASS' else 'FAIL' end, 'CONFIGURED', 20.0, 1.0 from cx
union all select capture_id, 'KEYX-004', 3, 'KEY_EXCHANGE', 'pfs', case when dd%3=0 then 'FAIL' else 'WARNING' end, 'CONFIGURED', 20.0, 1.0 from cx
union all select capture_id, 'SA-003', 4, 'SA_SECURITY', 'encapsulation', case when udp then 'WARNING' else 'PASS' end, 'OBSERVED', 2.0, 1.0 from cx
union all select capture_id, 'META-002', 5, 'METADATA_PRIVACY', 'volume_exposure', case when esp>=250 then 'WARNING' else 'NOT_VERIFIABLE' end, case when esp>=250 then 'OBSERVED' else 'NOT_VERIFIABLE' end, 3.0, 1.0 from cx
union all select capture_id, 'META-003', 6, 'METADATA_PRIVACY', 'class_inference', 'WARNING', 'INFERRED', 6.0, spis/10.0::DOUBLE from cx)"""
