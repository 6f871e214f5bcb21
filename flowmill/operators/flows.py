"""Flow summaries, sequence health and the feature vector of packet captures.

packets: capture_id, frame_index, ts_s, proto ('ESP', 'IKE', 'AH', 'ICMP' or other), spi_int, src, length, seq,
udp_encapsulated; and where known dst, ip_version, truncated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.columns import ratio

def _esp() -> F.Column:
    return F.col("proto") == "ESP"


#: Feature columns in the order of the contract: fixed values.
FEATURES = (
    "capture_packets", "capture_bytes", "capture_duration_s", "packet_rate_pps", "byte_rate_bps", "avg_packet_len", "esp_packet_share", "ike_packet_share", "icmp_packet_share", "ipv6_packet_share", "truncated_packet_share",
    "esp_packets", "esp_bytes", "esp_flow_count", "esp_avg_len", "esp_len_min", "esp_len_max", "esp_len_std", "esp_avg_packets_per_flow", "esp_avg_bytes_per_flow", "esp_largest_flow_share",
    "esp_fwd_packets", "esp_bwd_packets", "esp_fwd_bytes", "esp_bwd_bytes", "esp_fwd_packet_share", "esp_fwd_byte_share",
    "esp_iat_mean_s", "esp_iat_std_s", "esp_iat_max_s", "esp_span_s",
    "esp_seq_gap_total", "esp_seq_replay_total", "esp_nonmonotonic_flow_share", "esp_udp_encap_share", "ike_packet_count", "ike_exchange_count",
)
FAMILIES = {"capture": FEATURES[:11], "volume": FEATURES[11:21], "direction": FEATURES[21:27], "timing": FEATURES[27:31], "health": FEATURES[31:]}


def _flag(packets: DataFrame, name: str, default) -> F.Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in packets.columns else F.lit(default)


def capture_counters(packets: DataFrame) -> DataFrame:
    """Packets and bytes of each capture, by protocol and IP version."""
    version = _flag(packets, "ip_version", 4)
    n = lambda cond: F.count_if(cond)
    return packets.groupBy("capture_id").agg(
        F.count("*").alias("packets"), F.sum("length").alias("captured_bytes"), n(version == 4).alias("ipv4_packets"), n(version == 6).alias("ipv6_packets"),
        n(_esp()).alias("esp_packets"), n(F.col("proto") == "AH").alias("ah_packets"), n(F.col("proto") == "IKE").alias("ike_packets"), n(F.col("proto") == "ICMP").alias("icmp_packets"), n(_flag(packets, "truncated", False)).alias("truncated_frames"),
    )


def flow_summary(packets: DataFrame) -> DataFrame:
    """One row per capture and SPI of ESP: packets, bytes, first and last frame, first source, encapsulation."""
    return packets.where(_esp()).groupBy("capture_id", "spi_int").agg(
        F.count("*").alias("packets"), F.sum("length").alias("bytes_total"), F.min_by("src", "frame_index").alias("src"),
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.bool_or("udp_encapsulated").alias("udp_encapsulated"),
    )


#: Frame numbers of a range: a long flow or capture is sorted in so many at a time.
RANGE = 1 << 16


def _ranges(packets: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """The steps of value between neighbours in frame order, summed up by ranges of frame numbers, so that no task sorts a
    whole key: keys, part, n (rows), first and last (value at either end), and of the steps that are known inside the
    range: steps (count), mean, square (sum of squared distances from the mean), top, back (below 0), gap (what those
    above 1 exceed it by). Rows that share a frame number are in the order of their values, nulls first."""
    w = Window.partitionBy(*keys, "_part").orderBy("frame_index", value)
    rows = packets.select(*keys, "frame_index", value, F.floor(F.col("frame_index") / RANGE).alias("_part"))
    step = F.col("_step")
    place = F.struct("frame_index", F.col(value).alias("v"))
    return rows.withColumn("_step", F.col(value) - F.lag(value).over(w)).groupBy(*keys, "_part").agg(
        F.count("*").alias("n"), F.min(place)["v"].alias("first"), F.max(place)["v"].alias("last"), F.count(step).alias("steps"), F.avg(step).alias("mean"),
        (F.var_pop(step) * F.count(step)).alias("square"), F.max(step).alias("top"), F.count_if(step < 0).alias("back"), F.coalesce(F.sum(F.when(step > 1, step - 1)), F.lit(0)).alias("gap"),
    )


def _between(ranges: DataFrame, keys: tuple[str, ...], order: str = "_part") -> DataFrame:
    """ranges with across: the step from the range before."""
    return ranges.withColumn("across", F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy(order)))


def joined_health(ranges: DataFrame, keys: tuple[str, ...], order: str = "_part") -> DataFrame:
    """Gaps and steps back of each key, from its ranges in order."""
    across = F.col("across")
    return _between(ranges, keys, order).groupBy(*keys).agg(
        (F.sum("gap") + F.coalesce(F.sum(F.when(across > 1, across - 1)), F.lit(0))).alias("sequence_gaps"), (F.sum("back") + F.count_if(across < 0)).alias("steps_back"), F.sum("n").alias("packets")
    )


def sequence_ranges(packets: DataFrame) -> DataFrame:
    """The ranges of each ESP flow, for joined_health."""
    return _ranges(packets.where(_esp()), ("capture_id", "spi_int"), "seq").select("capture_id", "spi_int", "_part", "n", "first", "last", "gap", "back")


def sequence_health(packets: DataFrame) -> DataFrame:
    """Per flow in frame order: numbers missed between neighbours, repeats of a number, and whether none goes back.
    Gaps count from the number seen last, so a step back makes later gaps count again. A null number has no step to
    either side and repeats nothing. A large flow is spread over ranges of frames and over its numbers."""
    keys = ("capture_id", "spi_int")
    steps = joined_health(sequence_ranges(packets), keys)
    numbers = packets.where(_esp()).groupBy(*keys, "seq").agg(F.count("seq").alias("_n")).groupBy(*keys)
    again = numbers.agg(F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).alias("sequence_replays")).select(*(F.col(k).alias(f"_{k}") for k in keys), "sequence_replays")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return steps.join(again, same).select(*keys, "sequence_gaps", "sequence_replays", (F.col("steps_back") == 0).alias("sequence_monotonic"))


def _zeros(df: DataFrame, names) -> DataFrame:
    return df.select("capture_id", *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names))


def _sums(packets: DataFrame) -> DataFrame:
    """Packets summed by flow and sender: one pass over them, from which all features follow but those of order."""
    esp, ike, size = _esp(), F.col("proto") == "IKE", F.col("length")
    n, place = F.count_if, F.struct("frame_index", "ts_s")
    version = _flag(packets, "ip_version", 4)
    return packets.groupBy("capture_id", esp.alias("esp"), F.when(esp, F.col("spi_int")).alias("spi"), F.when(esp, F.col("src")).alias("src")).agg(
        F.count("*").alias("n"), F.sum(size).alias("b"), F.sum((size * size).cast("decimal(38,0)")).alias("q"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.min("frame_index").alias("f"), F.min(place).alias("begin"), F.max(place).alias("end"),
        n("udp_encapsulated").alias("udp"), n(ike).alias("ike"), n(ike & _flag(packets, "ike_parsed", True)).alias("parsed"), n(F.col("proto") == "ICMP").alias("icmp"), n(version == 6).alias("v6"), n(_flag(packets, "truncated", False)).alias("cut"),
    )


def _capture_values(packets: DataFrame) -> DataFrame:
    """A row for each capture with the features that need no order. The sums by flow and sender are summed again by flow and
    by sender at once; forward is the direction of the sender with the smallest first frame. The deviation is taken
    from whole numbers, which cancel exactly."""
    esp = F.col("esp")
    # grouping: 1 by flow (sender left out), 2 by sender
    sides = _sums(packets).groupingSets([["capture_id", "esp", "spi"], ["capture_id", "esp", "src"]], "capture_id", "esp", "spi", "src").agg(
        F.grouping_id().alias("g"), *(F.sum(c).alias(c) for c in ("n", "b", "q", "udp", "ike", "parsed", "icmp", "v6", "cut")), *(F.min(c).alias(c) for c in ("lo", "f", "begin")), *(F.max(c).alias(c) for c in ("hi", "end"))
    )
    flow, sender = F.col("g") == 1, F.col("g") == 2
    every = {c: F.sum(F.when(flow, F.col(c))).alias(c) for c in ("n", "b", "ike", "parsed", "icmp", "v6", "cut")}
    own = {f"e{c}": F.coalesce(F.sum(F.when(flow & esp, F.col(c))), F.lit(0)).alias(f"e{c}") for c in ("n", "b", "q", "udp")}
    agg = sides.groupBy("capture_id").agg(
        *every.values(), *own.values(), F.count_if(flow & esp).alias("flows"), F.min(F.when(flow & esp, F.col("lo"))).alias("lo"), F.max(F.when(flow & esp, F.col("hi"))).alias("hi"), F.max(F.when(flow & esp, F.col("n"))).alias("top"),
        F.min(F.when(flow, F.col("begin")))["ts_s"].alias("begin"), F.max(F.when(flow, F.col("end")))["ts_s"].alias("end"), F.min(F.when(sender & esp, F.struct("f", "n", "b"))).alias("x"),
    )
    d = F.greatest(F.col("end") - F.col("begin"), F.lit(0.0))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    std = ratio(F.sqrt((whole("eq") * whole("en") - whole("eb") * whole("eb")).cast("double")), "en")
    values = {
        "capture": [F.col("n"), F.col("b"), d, ratio("n", d), ratio("b", d), ratio("b", "n"), ratio("en", "n"), *(ratio(c, "n") for c in ("ike", "icmp", "v6", "cut"))],
        "volume": [F.col("en"), F.col("eb"), F.col("flows"), ratio("eb", "en"), F.col("lo"), F.col("hi"), std, ratio("en", "flows"), ratio("eb", "flows"), ratio("top", "en")],
        "direction": [F.col("x.n"), F.col("en") - F.col("x.n"), F.col("x.b"), F.col("eb") - F.col("x.b"), ratio("x.n", "en"), ratio("x.b", "eb")],
        "health": [ratio("eudp", "en"), F.col("ike"), F.col("parsed")],
    }
    named = [v.alias(n) for k, vs in values.items() for v, n in zip(vs, FAMILIES[k][-len(vs) :])]
    return agg.select("capture_id", *named)


def _timing_values(packets: DataFrame) -> DataFrame:
    """Captures with ESP: mean, deviation and maximum of the times between their packets, and their span."""
    ranges = _between(_ranges(packets.where(_esp()), ("capture_id",), "ts_s"), ("capture_id",))
    w = Window.partitionBy("capture_id")
    inner = F.coalesce(F.col("mean") * F.col("steps"), F.lit(0.0))
    known = F.col("steps") + F.col("across").isNotNull().cast("int")
    rows = ranges.withColumns({"_all": F.sum(known).over(w), "_mean": ratio(F.sum(inner + F.coalesce("across", F.lit(0.0))).over(w), F.sum(known).over(w))})
    far = lambda x: F.coalesce((F.col(x) - F.col("_mean")) * (F.col(x) - F.col("_mean")), F.lit(0.0))
    square = F.coalesce("square", F.lit(0.0)) + F.col("steps") * far("mean") + far("across")
    agg = rows.groupBy("capture_id").agg(
        F.max("_mean").alias("mean"), F.sqrt(ratio(F.sum(square), F.max("_all"))).alias("std"), F.greatest(F.max("top"), F.max("across")).alias("max"), F.greatest(F.max_by("last", "_part") - F.min_by("first", "_part"), F.lit(0.0)).alias("span")
    )
    return agg.select("capture_id", *(F.col(c).alias(n) for c, n in zip(("mean", "std", "max", "span"), FAMILIES["timing"])))


def _health_values(packets: DataFrame) -> DataFrame:
    """Captures with ESP: gaps and repeats of their flows, and the share of flows that go back."""
    g = sequence_health(packets).groupBy("capture_id").agg(F.sum("sequence_gaps").alias("gaps"), F.sum("sequence_replays").alias("again"), ratio(F.count_if(~F.col("sequence_monotonic")), F.count("*")).alias("back"))
    return g.select("capture_id", *(F.col(c).alias(n) for c, n in zip(("gaps", "again", "back"), FAMILIES["health"])))


def features_capture(packets: DataFrame) -> DataFrame:
    return _zeros(_capture_values(packets), FAMILIES["capture"])


def features_volume(packets: DataFrame) -> DataFrame:
    """By flow first, then by capture: a capture's packets are never gathered."""
    return _zeros(_capture_values(packets), FAMILIES["volume"])


def features_direction(packets: DataFrame) -> DataFrame:
    """Forward is the direction of the capture's first ESP sender."""
    return _zeros(_capture_values(packets), FAMILIES["direction"])


def features_timing(packets: DataFrame) -> DataFrame:
    """Times between ESP packets in frame order, by ranges of frames that are then joined end to end."""
    return _zeros(packets.select("capture_id").distinct().join(_timing_values(packets), "capture_id", "left"), FAMILIES["timing"])


def features_health(packets: DataFrame) -> DataFrame:
    """Exchanges are the IKE packets whose message was understood: ike_parsed, where packets has it."""
    return _zeros(_capture_values(packets).join(_health_values(packets), "capture_id", "left"), FAMILIES["health"])


def features_all(packets: DataFrame) -> DataFrame:
    """The 37 features of each capture, in the order of FEATURES; 0, never null, where a side is empty. Packets are read
    for the sums, for the times and for the flows' numbers; what is joined is a row for each capture. Packets without a
    capture are left out of times and numbers."""
    out = _capture_values(packets).join(_timing_values(packets), "capture_id", "left").join(_health_values(packets), "capture_id", "left")
    return _zeros(out, FEATURES)


def metadata_summary(packets: DataFrame) -> DataFrame:
    """What an observer counts in each capture without breaking anything."""
    flows = flow_summary(packets).join(sequence_health(packets), ["capture_id", "spi_int"])
    return flows.groupBy("capture_id").agg(
        F.count("*").alias("flows"), F.sum("packets").alias("esp_packets"), F.sum("bytes_total").alias("esp_bytes"), F.max("packets").alias("largest_flow_packets"),
        F.sum("sequence_gaps").alias("gaps"), F.sum("sequence_replays").alias("replays"), F.bool_and("sequence_monotonic").alias("monotonic"), F.bool_or("udp_encapsulated").alias("udp_encapsulated"),
    )


#: Confidence of a prediction from which it is a high exposure, and from which it is reported: fixed values.
CONFIDENT, REPORTED = 0.8, 0.6
#: Sizes that padding changes.
SIZES = ("esp_bytes", "esp_avg_len", "esp_len_min", "esp_len_max", "avg_packet_len")


def pad_sizes(features: DataFrame, target: int, bucket: bool = True, sizes=SIZES) -> DataFrame:
    """Each size cut to a whole number and raised to the next multiple of target (bucket) or to target; never smaller. A
    negative size is an error; null stays null."""
    def pad(c):
        whole = F.when(c < 0, F.raise_error(F.lit("a size is negative"))).otherwise(F.floor(c).cast("double"))
        return F.greatest(whole, F.ceil(whole / target) * F.lit(float(target)) if bucket else F.lit(float(target)))

    return features.withColumns({c: pad(F.col(c)) for c in sizes if c in features.columns})


def pad_overhead(before: DataFrame, after: DataFrame, column: str = "esp_avg_len") -> DataFrame:
    """Mean sizes before and after, and what padding adds, in percent."""
    a, b = (df.agg(F.avg(column).alias(n)) for df, n in ((before, "mean_before"), (after, "mean_after")))
    return a.crossJoin(b).select(F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"), F.round(100 * ratio(F.col("mean_after") - F.col("mean_before"), "mean_before"), 6).alias("overhead_percent"))


def exposure_observations(packets: DataFrame, min_share: float = 25.0, predictions: DataFrame | None = None) -> DataFrame:
    """Six observations per capture with their exposure (none, low, medium, high, unknown) and points of 4. predictions
    (capture_id, confidence; a row for each capture at most) tell how well its traffic can be classified; without one
    that is unknown, and a null confidence counts as 0."""
    own = capture_counters(packets)
    flows = flow_summary(packets).groupBy("capture_id").agg(F.count("*").alias("flows"), F.count("src").alias("ends"))
    x = own.join(flows, "capture_id", "left").withColumn("flows", F.coalesce("flows", F.lit(0)))
    inferred = F.lit("unknown")
    if predictions is not None:
        x = x.join(predictions.select(F.col("capture_id").alias("_capture"), "confidence"), F.col("capture_id") == F.col("_capture"), "left")
        inferred = F.when(F.col("_capture").isNull(), "unknown").when(F.col("confidence") >= CONFIDENT, "high").otherwise("medium")
    outside = F.greatest(F.col("packets") - F.col("esp_packets") - F.col("ah_packets"), F.lit(0))
    levels = {
        "endpoint-identity": F.when(F.coalesce("ends", F.lit(0)) > 0, "high").otherwise("unknown"),
        "sa-identifiers": F.when(F.col("flows") > 0, "medium").otherwise("unknown"),
        "negotiation-disclosure": F.when(F.col("ike_packets") > 0, "medium").otherwise("unknown"),
        "volume-profile": F.when(F.col("flows") > 1, "medium").when(F.col("flows") == 1, "low").otherwise("unknown"),
        "cleartext-context": F.when(ratio(outside, "packets") * 100 >= min_share, "high").when(outside > 0, "medium").otherwise("none"),
        "class-inference": inferred,
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("observation"), v.alias("exposure")) for k, v in levels.items())))
    points = F.when(F.col("exposure") == "none", 1).when(F.col("exposure") == "low", 2).when(F.col("exposure") == "medium", 3).when(F.col("exposure") == "high", 4)
    return x.select("capture_id", rows.alias("o")).select("capture_id", "o.*").withColumn("points", points)


def exposure_score(observations: DataFrame) -> DataFrame:
    """Points in percent of the most that the evaluated observations could earn, coverage, band (fixed values), and the best
    one."""
    agg = observations.groupBy("capture_id").agg(F.coalesce(F.sum("points"), F.lit(0)).alias("earned"), F.count("points").alias("evaluated"), F.count("*").alias("all"), F.min_by("observation", F.when(F.col("points").isNotNull(), F.struct(-F.col("points"), F.col("observation")))).alias("top_observation"))
    risk = F.round(100 * ratio("earned", 4 * F.col("evaluated")), 0).cast("int")
    out = agg.select("capture_id", risk.alias("privacy_risk"), F.round(100 * ratio("evaluated", "all"), 0).cast("int").alias("coverage_percent"), "top_observation")
    return out.withColumn("band", F.when(F.col("privacy_risk") < 25, "low").when(F.col("privacy_risk") < 50, "moderate").when(F.col("privacy_risk") < 75, "elevated").otherwise("high"))


def fingerprintability(packets: DataFrame, volume: int = 20, predictions: DataFrame | None = None) -> DataFrame:
    """Dimensions that an observer can measure in each capture with ESP, how many, their band, and the risk that metadata
    tell what the traffic is. predictions: capture_id, confidence, model_id, model_version, feature_schema, a row for
    each capture at most. A prediction counts if all of it is known; then its confidence decides, else the dimensions."""
    end = F.col("src").isNotNull() & (F.col("dst").isNotNull() if "dst" in packets.columns else F.lit(True))
    by = packets.where(_esp()).groupBy("capture_id", "spi_int").agg(F.count("*").alias("n"), F.bool_or(end).alias("ends"), F.bool_or("udp_encapsulated").alias("udp"))
    flows = by.groupBy("capture_id").agg(F.count("*").alias("flows"), F.sum("n").alias("n"), F.bool_or("ends").alias("ends"), F.bool_or("udp").alias("udp"))
    checks = (("association_split", F.col("flows") > 1), ("volume", F.col("n") >= volume), ("peer_addresses", F.col("ends")), ("nat_binding", F.col("udp")), ("payload_sizes", F.col("n") > 0), ("timing", F.col("n") > 1))
    seen = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks)))
    known = F.lit(False)
    if predictions is not None:
        parts = ("confidence", "model_id", "model_version", "feature_schema")
        flows = flows.join(predictions.select(F.col("capture_id").alias("_capture"), *parts), F.col("capture_id") == F.col("_capture"), "left")
        for c in parts:
            known = (known if c != "confidence" else F.lit(True)) & F.col(c).isNotNull()
    size = F.size(seen).cast("long")
    sure = F.when(known, F.col("confidence")) if predictions is not None else F.lit(None).cast("double")
    risk = F.when(sure >= CONFIDENT, "HIGH").when(sure >= REPORTED, "MODERATE").when(sure.isNotNull(), "LOW").when(size >= 4, "MODERATE").otherwise("LOW")
    out = flows.select("capture_id", F.concat_ws(",", seen).alias("dimensions"), size.alias("n_dimensions"), risk.alias("inference_risk"), known.alias("ml_available"), sure.alias("ml_confidence"))
    return out.withColumn("band", F.when(F.col("n_dimensions") >= 4, "HIGH").when(F.col("n_dimensions") >= 2, "MODERATE").when(F.col("n_dimensions") > 0, "LOW").otherwise("not_assessed"))
