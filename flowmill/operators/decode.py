"""Packet headers by column expressions; IKE messages by an Arrow function; and packets from frames.

Frames: frame (binary), linktype, with any other columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ETHERNET, RAW, NULL, SLL, SLL2 = 1, 101, 0, 113, 276
#: IPv6 extension headers that are followed, and how many at most: fixed values.
FOLLOWED, EXTENSIONS = (0, 43, 44, 60, 135, 139, 140), 8
#: Address families of a loopback header that mean IP: fixed values.
FAMILIES = (2, 10, 24, 28, 30)


def number(column: str, at: str | int, n: int) -> F.Column:
    """n bytes from position at (from 1) as an unsigned number; null if the bytes are not there."""
    part = f"substring({column}, cast({at} as int), {n})"
    return F.expr(f"case when length({part}) = {n} then cast(conv(hex({part}), 16, 10) as bigint) end")


def strip_link(frames: DataFrame) -> DataFrame:
    """frames with ethertype and packet, the IP packet behind the link header; one VLAN tag is skipped. packet is null where
    the header is cut or names something else than IP, and where frame is null. A loopback header counts by its family.
    Of an unknown link type, a frame that begins like an IP packet is one; else 14 bytes are skipped, if there are."""
    n, at = F.length("frame"), lambda k: F.substring("frame", k, n)
    outer = number("frame", 13, 2)
    tagged = outer.isin(0x8100, 0x88A8) & (n >= 18)
    link = F.col("linktype")
    family = F.substring("frame", 1, 4).isin(*(bytearray(f.to_bytes(4, "little")) for f in FAMILIES))
    first = F.shiftright(number("frame", 1, 1).cast("int"), 4)
    packet = F.when(link == RAW, at(1)).when(link == SLL2, F.when(n >= 20, at(21))).when(link == SLL, F.when(n >= 16, at(17))).when(link == NULL, F.when(family, at(5)))
    packet = packet.when(link == ETHERNET, F.when(tagged, at(19)).when(n >= 14, at(15)))
    packet = packet.otherwise(F.when(first.isin(4, 6) | (n < 14), F.col("frame")).otherwise(at(15)))
    named = F.when(link == ETHERNET, F.when(tagged, number("frame", 17, 2)).otherwise(outer)).when(link == SLL, number("frame", 15, 2)).when(link == SLL2, number("frame", 1, 2))
    out = frames.withColumn("ethertype", named.cast("int")).withColumn("packet", packet)
    version = F.shiftright(number("packet", 1, 1).cast("int"), 4)
    kind = F.coalesce("ethertype", F.when(version == 4, 0x0800).when(version == 6, 0x86DD))
    ip = ~link.isin(ETHERNET, SLL, SLL2) | F.col("ethertype").isin(0x0800, 0x86DD)
    return out.withColumn("packet", F.when(F.coalesce(ip, F.lit(True)), F.col("packet"))).withColumn("ethertype", kind)


def _v4(at: int) -> F.Column:
    byte = lambda k: F.conv(F.hex(F.substring("packet", at + k, 1)), 16, 10)
    return F.concat_ws(".", *map(byte, range(4)))


def _v6(at: int) -> F.Column:
    """Eight groups with the first of the longest runs of zeros left out; IPv4 behind ::ffff: in dots. The text is bound to a
    lambda's variable: each pattern names it twice, and as an expression it would be repeated in the code every time."""
    groups = F.regexp_replace(F.lower(F.hex(F.substring("packet", at, 16))), "(.{4})(?=.)", "$1:")
    groups = F.regexp_replace(groups, "(^|:)0{1,3}", "$1")

    def short(text):
        out = F
        for run in range(8, 1, -1):
            zeros = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$"
            out = out.when(text.rlike(zeros), F.regexp_replace(text, zeros, "$1::$2"))
        return out.otherwise(text)

    mapped = F.hex(F.substring("packet", at, 12)) == "0" * 20 + "F" * 4
    return F.when(mapped, F.concat(F.lit("::ffff:"), _v4(at + 12))).otherwise(F.transform(F.array(groups), short)[0])


def decode_ip(packets: DataFrame) -> DataFrame:
    """packets (packet) with ip_version, protocol, src, dst and payload; all null where packet is null, cut within its header
    or of another version, which its first digit says. An IPv4 length that does not exceed the header, and an IPv6 length
    of 0, mean all that was captured; other lengths are cut to it. Of IPv6 extension headers EXTENSIONS are followed; a
    chain that runs past the captured bytes makes the packet unknown."""
    # one fold over the steps: written out step by step, each would repeat the expressions of the one before
    byte = "cast(conv(hex(substring(packet, cast({0} as int), 1)), 16, 10) as bigint)"
    step = "named_struct('next', {0}, 'at', {1})"
    size = f"case when x.next = 44 then 8 else ({byte.format('x.at + 1')} + 1) * 8 end"
    more = f"x.next in {FOLLOWED}"
    fold = f"aggregate(sequence(1, {EXTENSIONS}), {step.format(byte.format(7), '41L')}, (x, _) -> case when {more} and length(packet) < x.at + 1 then {step.format('-1L', 'x.at')} when {more} then {step.format(byte.format('x.at'), f'x.at + {size}')} else x end)"
    version = F.shiftright(number("packet", 1, 1).cast("int"), 4)
    n, ihl = F.length("packet"), number("packet", 1, 1).bitwiseAND(15) * 4
    out = packets.withColumn("_chain", F.when((version == 6) & (n >= 40), F.expr(fold)))
    six = F.coalesce(F.col("_chain.next") >= 0, F.lit(False)) & (n >= F.col("_chain.at") - 1)
    four = (version == 4) & (n >= 20) & (n >= ihl)
    total, length = number("packet", 3, 2), number("packet", 5, 2)
    begin = F.when(four, ihl + 1).otherwise(F.col("_chain.at"))
    end = F.when(four, F.when(total > ihl, F.least(total, n)).otherwise(n)).otherwise(F.when(length > 0, F.least(length + 40, n)).otherwise(n))
    known = F.coalesce(four | six, F.lit(False))
    return out.withColumns({
        "ip_version": F.when(known, F.when(four, 4).otherwise(6)), "protocol": F.when(known, F.when(four, number("packet", 10, 1)).otherwise(F.col("_chain.next"))).cast("int"),
        "src": F.when(known, F.when(four, _v4(13)).otherwise(_v6(9))), "dst": F.when(known, F.when(four, _v4(17)).otherwise(_v6(25))),
        "payload": F.when(known, F.substring("packet", begin.cast("int"), F.greatest(end - begin + 1, F.lit(0)).cast("int"))),
    }).drop("_chain")


def classify(packets: DataFrame) -> DataFrame:
    """packets (protocol, payload) with kind, udp_encapsulated, marked (a zero marker on port 4500) and body: ESP and AH by protocol; UDP from or to port 500 is
    IKE; else of port 4500 IKE after a zero marker, and ESP if 12 bytes follow. Everything else, with cut headers and
    nulls, is OTHER."""
    p = F.col("protocol")
    port = lambda n: F.coalesce((number("payload", 1, 2) == n) | (number("payload", 3, 2) == n), F.lit(False))
    udp = F.coalesce((p == 17) & (F.length("payload") >= 8), F.lit(False))
    nat = udp & ~port(500) & port(4500)
    marked = F.coalesce(number("payload", 9, 4) == 0, F.lit(False))
    kind = F.when(p == 50, "ESP").when(p == 51, "AH").when(p.isin(1, 58), "ICMP").when(udp & port(500), "IKE").when(nat & marked, "IKE").when(nat & (F.length("payload") >= 20), "ESP").otherwise("OTHER")
    body = F.when(nat & marked, F.expr("substring(payload, 13)")).when(udp, F.expr("substring(payload, 9)")).otherwise(F.col("payload"))
    return packets.withColumns({"kind": kind, "udp_encapsulated": nat & (kind == "ESP"), "marked": nat & marked, "body": body})


def decode_esp(packets: DataFrame) -> DataFrame:
    """packets (kind, body) with spi and sequence_number; null if there are fewer than 8 bytes."""
    enough = (F.col("kind") == "ESP") & (F.length("body") >= 8)
    return packets.withColumns({"spi": F.when(enough, number("body", 1, 4)), "sequence_number": F.when(enough, number("body", 5, 4))})


#: One IKE message.
EXCHANGE = """struct<version:int,exchange_type:int,exchange:string,initiator:boolean,response:boolean,message_id:long,initiator_spi:string,responder_spi:string,payloads:array<int>,encrypted:boolean,
 proposals:array<struct<number:int,protocol:int,spi:string,transforms:array<struct<type:int,id:int,key_bits:int>>>>>"""
# Exchange types of version 2 by number from 34, payload types, bytes of the header, and how many parts are read.
EXCHANGES = ("IKE_SA_INIT", "IKE_AUTH", "CREATE_CHILD_SA", "INFORMATIONAL", "IKE_SESSION_RESUMPTION", "GSA_AUTH", "GSA_REGISTRATION", "GSA_REKEY")
FIRST_EXCHANGE, SA, ENCRYPTED, HEADER = 34, 33, 46, 28
PAYLOADS, PROPOSALS, TRANSFORMS = 32, 32, 64
#: A transform's attribute that is its key's length.
KEY_LENGTH = b"\x80\x0e"


def _parts(data: bytes, head: int, most: int):
    """Neighbouring parts of data, whose second pair of bytes is their length: each part, or its head alone where the length
    is wrong, which ends them."""
    at = 0
    while at + head <= len(data) and most:
        size, most = int.from_bytes(data[at + 2 : at + 4]), most - 1
        whole = head <= size <= len(data) - at
        yield data[at : at + (size if whole else head)], whole
        if not whole:
            return
        at += size


def _transforms(data: bytes) -> list[dict]:
    """A transform whose length is wrong counts as one of 8 bytes, and the next is read behind it."""
    out = []
    while len(data) >= 8 and len(out) < TRANSFORMS:
        size = max(int.from_bytes(data[2:4]), 8)
        key = int.from_bytes(data[10:12]) if size >= 12 and data[8:10] == KEY_LENGTH and len(data) >= 12 else None
        out.append({"type": data[4], "id": int.from_bytes(data[6:8]), "key_bits": key})
        data = data[size:]
    return out


def _proposals(data: bytes) -> list[dict]:
    out = []
    for part, whole in _parts(data, 8, PROPOSALS):
        begin = 8 + part[6]
        if not whole or begin > len(part):
            break
        out.append({"number": part[4], "protocol": part[5], "spi": part[8:begin].hex(), "transforms": _transforms(part[begin:])})
    return out


def exchange_of(message: bytes | None) -> dict | None:
    """What an IKE message says in clear, in the form of EXCHANGE; None if it is no message: shorter than a header, of another
    version than 1 and 2, of version 2 with an exchange type that does not exist, or without a responder where only the
    first exchange has none. A length in the header that can't be right means all bytes. The chain of payloads ends at one
    that is cut, which still counts as a payload; a cut proposal ends the proposals of its payload."""
    if message is None or len(message) < HEADER:
        return None
    version, kind, flags = message[17] >> 4, message[18], message[19]
    if version == 2:
        if not 0 <= kind - FIRST_EXCHANGE < len(EXCHANGES) or (kind > FIRST_EXCHANGE and not any(message[8:16])):
            return None
        name = EXCHANGES[kind - FIRST_EXCHANGE]
    elif version == 1:
        name = f"IKEV1_EXCHANGE_{kind}"
    else:
        return None
    stated = int.from_bytes(message[24:28])
    body = message[HEADER:stated] if HEADER <= stated <= len(message) else message[HEADER:]
    payloads, proposals, following = [], [], message[16]
    for part, whole in _parts(body, 4, PAYLOADS):
        if not following:
            break
        payloads.append(following)
        if following == SA and whole:
            proposals += _proposals(part[4:])
        following = part[0]
    return {
        "version": version, "exchange_type": kind, "exchange": name, "initiator": bool(flags & 8), "response": bool(flags & 32), "message_id": int.from_bytes(message[20:24]),
        "initiator_spi": message[:8].hex(), "responder_spi": message[8:16].hex(), "payloads": payloads, "encrypted": ENCRYPTED in payloads, "proposals": proposals,
    }


def ike_exchanges(packets: DataFrame) -> DataFrame:
    """packets (kind, body, and marked where known) with ike: what the IKE message says in clear (EXCHANGE); null for other
    packets and for bytes that are no message. Behind a zero marker the message is looked for after the marker, then, as
    the marker may be an initiator's empty number, with it."""

    @F.pandas_udf(EXCHANGE)
    def parse(bodies: pd.Series, marked: pd.Series) -> pd.DataFrame:
        found = []
        for body, mark in zip(bodies, marked):
            one = exchange_of(None if body is None else bytes(body))
            found.append(one if one or not mark or body is None else exchange_of(bytes(4) + bytes(body)))
        names = list(found[0] or {}) if found and found[0] else ["version", "exchange_type", "exchange", "initiator", "response", "message_id", "initiator_spi", "responder_spi", "payloads", "encrypted", "proposals"]
        return pd.DataFrame([[f[n] for n in names] if f else [None] * len(names) for f in found], columns=names, dtype=object)

    marked = F.coalesce(F.col("marked"), F.lit(False)) if "marked" in packets.columns else F.lit(False)
    own = F.when(F.col("kind") == "IKE", F.col("body"))
    return packets.withColumn("ike", parse(own, marked)).withColumn("ike", F.when(F.col("ike.version").isNotNull(), F.col("ike")))


def explode_ike(packets: DataFrame) -> DataFrame:
    """packets (kind, body) of IKE, a row for each transform of each proposal; one row with nulls where there is none."""
    rest = [c for c in packets.columns if c not in ("body", "marked")]
    p = ike_exchanges(packets.where("kind = 'IKE'")).select(*rest, F.explode_outer("ike.proposals").alias("p"))
    return p.select(*rest, F.col("p.number").alias("proposal"), F.col("p.protocol").alias("protocol_id"), F.explode_outer("p.transforms").alias("t")).select(*rest, "proposal", "protocol_id", F.col("t.type").alias("transform_type"), F.col("t.id").alias("transform_id"), "t.key_bits")


def packets_of(frames: DataFrame) -> DataFrame:
    """frames (capture_id, frame_index, ts, linktype, frame, and incl_len and orig_len where known) as the packets that flows,
    features and facts are computed from: capture_id, frame_index, ts_s, proto, spi_int, seq, src, dst, length, ip_version,
    udp_encapsulated, truncated, ike_parsed and ike. A row for each frame, whatever is in it; nothing is shuffled.

    An ESP packet cut within its first 8 bytes has no flow and is OTHER. Lengths are those of the captured frames."""
    x = decode_esp(classify(decode_ip(strip_link(frames))))
    size = F.length("frame").cast("long")
    cut = F.coalesce(F.col("incl_len") < F.col("orig_len"), F.lit(False)) if {"incl_len", "orig_len"} <= set(frames.columns) else F.lit(False)
    proto = F.when((F.col("kind") == "ESP") & F.col("spi").isNull(), "OTHER").otherwise(F.col("kind"))
    x = ike_exchanges(x).select(
        "capture_id", "frame_index", F.col("ts").alias("ts_s"), proto.alias("proto"), F.col("spi").alias("spi_int"), F.col("sequence_number").alias("seq"), "src", "dst",
        F.coalesce(size, F.lit(0).cast("long")).alias("length"), "ip_version", (F.coalesce("udp_encapsulated", F.lit(False))).alias("udp_encapsulated"), cut.alias("truncated"), "ike",
    )
    return x.withColumn("ike_parsed", F.col("ike").isNotNull())


def dh_groups(transforms: DataFrame) -> DataFrame:
    """Per capture with IKE: the DH groups offered for the IKE association and for child ones (ESP and AH), ascending."""
    of = lambda *protocols: F.array_join(F.array_sort(F.collect_set(F.when(F.col("protocol_id").isin(*protocols) & (F.col("transform_type") == 4), F.col("transform_id")))), ",")
    return transforms.groupBy("capture_id").agg(of(1).alias("ike_groups"), of(2, 3).alias("child_groups"))


def pfs_verdict(transforms: DataFrame, flows: DataFrame) -> DataFrame:
    """Per capture: DH groups of ESP and AH proposals, and what they say about PFS."""
    child = F.col("protocol_id").isin(2, 3)
    g = transforms.groupBy("capture_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(child & (F.col("transform_type") == 4), F.col("transform_id")))), ",").alias("groups"), F.coalesce(F.bool_or(child), F.lit(False)).alias("offered"))
    x = g.join(flows.select("capture_id").distinct().withColumn("esp", F.lit(True)), "capture_id", "full")
    status = F.when(F.coalesce("groups", F.lit("")) != "", "OBSERVED").when(F.col("offered"), "DISABLED").otherwise("NOT_VERIFIABLE")
    return x.select("capture_id", F.coalesce("groups", F.lit("")).alias("groups"), status.alias("status"))
