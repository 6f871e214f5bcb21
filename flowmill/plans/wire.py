"""Queries from captured bytes to verdicts: events as raw IP frames of captures (a day and a quarter of the users each), whose
IKE messages, configurations and predictions vary by capture. The SQL works on events, never on bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.columns import rounded
from flowmill.functions.shared import shared_folder
from flowmill.operators import assess as a
from flowmill.operators import decode as dc
from flowmill.operators import facts as fa
from flowmill.operators import flows as fl
from flowmill.operators import history as hi
from flowmill.operators import rules as ru
from flowmill.plans import captures
from flowmill.plans.rows import _SEV, _SS, _ST, _TM
from flowmill.plans.views import C, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _pick(values, at: str) -> str:
    """values[at] as SQL that Spark and DuckDB both know; at is from 0."""
    shown = ["null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"case {at} " + " ".join(f"when {k} then {v}" for k, v in enumerate(shown)) + " end"


# What events become, in SQL that both know. q is a number of the capture, e one of the event.
_E, _TURN = "event_id", "(case when q % 3 = 0 then (event_id % 8) - (event_id % 4) else 0 end)"
_WIRE = {
    "proto": "case when event_type = 'signup' and q % 7 <> 3 then 'IKE' when event_type = 'signup' then 'OTHER' when q % 11 = 5 then 'ICMP' when q % 13 = 2 and event_id % 40 <> 0 then 'OTHER' else 'ESP' end",
    "sound": "event_id % 5 <> 0",
    "version": "case when q % 6 = 1 or (q % 6 = 2 and event_id % 2 = 0) then 1 else 2 end",
}
_KIND = "case when version = 1 and event_id % 3 = 0 then 5 when version = 1 then 2 when event_id % 3 <> 0 or q % 4 = 0 then 34 when q % 4 = 2 then 36 else 35 end"
_SECOND = "case when version = 1 and q % 4 < 2 then 5 when version = 1 and q % 4 = 2 then 46 when version = 2 and kind = 35 then (case when q % 4 = 3 then 46 else 39 end) when version = 2 and kind = 36 and q % 8 >= 4 then 46 else 0 end"
_SAID = "not (version = 2 and kind = 35)"
_PROTOCOL = "case when event_id % 4 < 2 then 1 when q % 5 = 0 then 2 else 3 end"
_IDS = {
    1: ((18, 19, 20, 28, 12, 3, 2, 11, 99), f"(q + {_TURN}) % 9"), 2: ((5, 6, 7, 2, 1, 77), f"(q + {_TURN}) % 6"),
    3: ((12, 13, 14, 2, 1, 0, 55), f"(q + {_TURN}) % 7"), 4: ((19, 14, 5, 2, 1, 31, 22), f"(q + {_TURN}) % 7"),
}
_HELD = {1: "true", 2: "true", 3: "q % 10 <> 6", 4: "protocol = 1 or q % 9 <> 4"}
_CONFIGURED = {
    "encryption": ("string", _pick(("aes256gcm16", "3DES", "AES128-CBC", "weird"), "q % 4"), _pick(("ENCR_AES_GCM_16", "ENCR_3DES", "ENCR_AES_CBC", "WEIRD"), "q % 4")),
    "integrity": ("string", _pick(("hmac_sha256", "hmac_md5", "sha1", None, "none"), "q % 5"), _pick(("AUTH_HMAC_SHA2_256_128", "AUTH_HMAC_MD5_96", "AUTH_HMAC_SHA1_96", None, "NONE"), "q % 5")),
    "prf": ("string", _pick(("prfsha256", "md5", None, "aes_xcbc"), "q % 4"), _pick(("PRF_HMAC_SHA2_256", "PRF_HMAC_MD5", None, "PRF_AES128_XCBC"), "q % 4")),
    "dh_group": ("string", _pick(("14", "2", "ecp256", None, "1", "99"), "q % 6"), _pick(("MODP_2048", "MODP_1024", "ECP_256", None, "MODP_768", "DH_GROUP_99"), "q % 6")),
    "pfs": ("string", _pick(("on", "false", None, "yes", "off"), "q % 5"), "case q % 5 when 0 then true when 1 then false when 3 then true when 4 then false end"),
    "child_group": ("string", _pick(("19", None, "modp1024"), "q % 7 % 3"), _pick(("ECP_256", None, "MODP_1024"), "q % 7 % 3")),
    "ike_version": ("int", _pick((2, 1, None), "q % 8 % 3"), _pick((2, 1, None), "q % 8 % 3")),
    "replay_protection": ("string", _pick(("true", "0", None, "on"), "q % 4"), "case q % 4 when 0 then true when 1 then false when 3 then true end"),
    "ike_lifetime": ("long", "case when q % 7 <> 0 then q * 9000 end", "case when q % 7 <> 0 then q * 9000 end"),
    "child_lifetime": ("long", "q * 700 - 2100", "q * 700 - 2100"),
}
_SURE, _MODEL, _DECIDED = "(q % 10) / 10.0D", "case when q % 5 <> 4 then 'm' else '' end", "case when q % 6 = 5 then 'UNKNOWN' else 'KNOWN' end"


def _events(spark, d):
    """Events with their capture, its number q, and what each becomes."""
    e = table(spark, d, "events").selectExpr(
        "event_id", "event_type", "user_id", "ts", "value", "props", "concat(date_format(ts,'yyyy-MM-dd'), '/', user_id % 4) capture_id", "cast(day(ts) * 4 + user_id % 4 as int) q"
    )
    e = e.selectExpr("*", *(f"{v} {k}" for k, v in _WIRE.items())).selectExpr("*", f"{_KIND} kind", f"{_PROTOCOL} protocol")
    return e.selectExpr("*", f"{_SECOND} second", f"{_SAID} said")


def _h(column: str, digits: int) -> str:
    return f"lpad(hex({column}), {digits}, '0')"


def _frames(spark, d):
    """Raw IP frames, filled up to the length of the event's packet in view P; unsound messages have an exchange type that does
    not exist. Written, as frames of capture files would be."""
    item = lambda n: f"case when {_HELD[n]} then concat('0000000c', '{n:02x}00', {_h(_pick(*_IDS[n]), 4)}, '800e0080') else '' end"
    x = _events(spark, d).selectExpr("*", f"concat({item(1)}, {item(2)}, {item(3)}, {item(4)}) items")
    x = x.selectExpr("*", f"case when said then concat({_h('second', 2)}, '00', {_h('12 + length(items) div 2', 4)}, '0000', {_h('8 + length(items) div 2', 4)}, '01', {_h('protocol', 2)}, '00', {_h('length(items) div 24', 2)}, items) else '' end sa")
    x = x.selectExpr("*", "case when second > 0 then '0000000801020304' else '' end more")
    total = "28 + length(sa) div 2 + length(more) div 2"
    first = "case when said then '21' else lpad(hex(second), 2, '0') end"
    spis = f"{_h('event_id + 1', 16)}, case when version = 2 and kind = 34 then repeat('0', 16) else repeat('2', 16) end"
    ike = f"concat({spis}, {first}, case version when 1 then '10' else '20' end, case when sound then {_h('kind', 2)} else case version when 1 then {_h('kind', 2)} else 'b1' end end, '08', {_h('event_id', 8)}, {_h(total, 8)}, sa, more)"
    esp = f"concat({_h('user_id % 8 + case when q % 5 = 1 then 3735928559 else 286331153 end - case when q % 5 = 1 then 0 else user_id % 8 * (q % 2) end', 8)}, {_h('cast(get_json_object(props, chr(36) || chr(46) || chr(107)) as bigint)', 8)}, '00000000')"
    inner = f"""case when proto = 'IKE' then concat('01f401f4', {_h(f'8 + {total}', 4)}, '0000', {ike}) when proto = 'ESP' and event_type = 'error' then concat('11941194', {_h('20', 4)}, '0000', {esp})
 when proto = 'ESP' then {esp} when proto = 'ICMP' then '0800000000000000' else '00350035000c000000000000' end"""
    number = "case when proto = 'IKE' or proto = 'OTHER' or (proto = 'ESP' and event_type = 'error') then '11' when proto = 'ESP' then '32' else '01' end"
    x = x.selectExpr("*", f"{inner} inner").selectExpr("*", f"concat('4500', {_h('20 + length(inner) div 2', 4)}, '0000000040', {number}, '0000', case when user_id % 2 = 0 then '0a0a0a010a0a0a02' else '0a0a0a020a0a0a01' end, inner) ip")
    size = "greatest(cast(floor(value) as bigint) + 64, length(ip) div 2)"
    x = x.selectExpr("capture_id", "event_id frame_index", "unix_micros(cast(ts as timestamp)) / 1e6D ts", f"{dc.RAW} linktype", f"unhex(rpad(ip, cast(2 * {size} as int), '0')) frame", f"{size} incl_len", f"{size} + case when event_id % 9 = 0 then 1 else 0 end orig_len")
    return _kept(spark, x)


def _kept(spark, x):
    where = shared_folder(spark)
    x.write.parquet(where)
    return spark.read.schema(x.schema).parquet(where)


def _packets(spark, d):
    return _kept(spark, dc.packets_of(_frames(spark, d)))


# The same in DuckDB: w is a row for each event, as packets_of gives it.
_LEN = "28 + case when said then 12 + 12 * (2 + (case when q % 10 <> 6 then 1 else 0 end) + (case when protocol = 1 or q % 9 <> 4 then 1 else 0 end)) else 0 end + case when second > 0 then 8 else 0 end"
_DUCK = lambda s: s.replace("D)", ")").replace(".0D", ".0")
W = f"""w0 as (select event_id, event_type, user_id, ts, value, props, strftime(ts,'%Y-%m-%d') || '/' || user_id % 4 capture_id, (day(ts) * 4 + user_id % 4)::int q from events),
w1 as (select *, {', '.join(f'{v} {k}' for k, v in _WIRE.items())} from w0), w2 as (select *, {_KIND} kind, {_PROTOCOL} protocol from w1), w3 as (select *, {_SECOND} "second", {_SAID} said from w2),
we as (select *, event_id frame_index, epoch_us(ts)/1e6::DOUBLE ts_s, proto = 'IKE' and (sound or version = 1) parsed, case when user_id % 2 = 0 then '10.10.10.1' else '10.10.10.2' end src,
 case when proto = 'ESP' then user_id % 8 + case when q % 5 = 1 then 3735928559 else 286331153 - user_id % 8 * (q % 2) end end spi_int, case when proto = 'ESP' then (props->>'$.k')::BIGINT end seq,
 greatest(cast(floor(value) as bigint) + 64, case proto when 'IKE' then 28 + {_LEN} when 'ESP' then case when event_type = 'error' then 40 else 32 end when 'ICMP' then 28 else 32 end)::bigint as length, proto = 'ESP' and event_type = 'error' udp_encapsulated from w3)"""
#: W under the names of view P, for the SQL of the features.
_AS_P = W + ", p as (select capture_id, frame_index, ts_s, proto, spi_int, src, length, seq, udp_encapsulated, parsed, event_id % 9 = 0 cut from we)"


@query(f"""with {W} select frame_index, version, case when version = 1 then 'IKEV1_EXCHANGE_' || kind when kind = 34 then 'IKE_SA_INIT' when kind = 35 then 'IKE_AUTH' else 'CREATE_CHILD_SA' end exchange, event_id message_id,
concat_ws(',', case when said then 33 end, case when "second" > 0 then "second" end) payloads, "second" = 46 encrypted, case when said then 1 else 0 end::int proposals, case when said then 2 + (q % 10 <> 6)::int + (protocol = 1 or q % 9 <> 4)::int else 0 end::int transforms from we where parsed""")
def ike_exchanges(spark, d):
    """IKE messages of all captures that can be read; others, with an exchange type that does not exist, are left out."""
    x = _packets(spark, d).where("ike_parsed")
    sizes = F.aggregate("ike.proposals", F.lit(0), lambda n, p: n + F.size(p["transforms"]))
    return x.select("frame_index", "ike.version", "ike.exchange", "ike.message_id", F.array_join("ike.payloads", ",").alias("payloads"), "ike.encrypted", F.size("ike.proposals").alias("proposals"), sizes.alias("transforms"))


_HEALTH = captures.HEALTH
_FEATURES = captures.SQL["features_all"]
_X = f"{captures._A}, {captures._V}, {captures._D}, {captures._T}, {captures._H}"
_SHARES = "coalesce(count(*) filter (proto='ICMP')/count(*)::double, 0) icmp, count(*) filter (cut)/count(*)::double cut, count(*) filter (parsed)::double parsed"


def _features_sql() -> str:
    zero = lambda names: ", ".join(f"coalesce({n}, 0)::double {n}" for n in names)
    cap = captures._CAP.replace("0.0::double icmp_packet_share", "round(icmp,6) icmp_packet_share").replace("0.0::double truncated_packet_share", "round(cut,6) truncated_packet_share")
    own = f"a2 as (select capture_id, {_SHARES} from p group by 1), f1 as (select capture_id, {cap} from a join a2 using(capture_id)), f2 as (select capture_id, {captures._VOL} from v join vt using(capture_id)), f3 as (select capture_id, {captures._DIR} from dr), f4 as (select capture_id, {captures._TIM} from tm)"
    health = "hu2 as (select capture_id, parsed x, k, u, hn from hu join a2 using(capture_id)), f5 as (select capture_id, g esp_seq_gap_total, r esp_seq_replay_total, round(nm/hf,6) esp_nonmonotonic_flow_share from hh), f6 as (select capture_id, round(coalesce(u/nullif(hn,0),0),6) esp_udp_encap_share, k ike_packet_count, x ike_exchange_count from hu2)"
    return f"with {_AS_P}, {captures.FLOWS}, {_HEALTH}, {_X}, {own}, {health} select capture_id, {zero(fl.FEATURES)} from f1 left join f2 using(capture_id) left join f3 using(capture_id) left join f4 using(capture_id) left join f5 using(capture_id) left join f6 using(capture_id)"


@query(_features_sql())
def features_from_frames(spark, d):
    """The 37 features from captured bytes in one plan: link, IP, UDP, ESP and IKE decoding, then sums."""
    return rounded(fl.features_all(_packets(spark, d)), *fl.FEATURES)


def _documents(spark, d):
    """Configurations of two of three captures: flat, or under identity and ipsec with other names; a value at the top wins."""
    x = _events(spark, d).select("capture_id", "q").distinct().where("q % 3 <> 1").selectExpr("capture_id", "q", *(f"cast({spark_sql} as {kind}) `{c}`" for c, (kind, spark_sql, _) in _CONFIGURED.items()))
    names = {c: keys for c, (_, keys) in fa.CONFIG.items()}
    block = lambda which, at: F.struct(*(F.col(c).alias(names[c][min(at, len(names[c]) - 1)]) for c in which))
    every = list(_CONFIGURED)
    flat = F.to_json(block(every, 0))
    false = F.struct(*(F.lit("des").alias(c) if c == "encryption" else F.col(c).alias(names[c][-1]) for c in every[:4]))
    nested = F.to_json(F.struct(F.col("encryption"), false.alias("identity"), block(every[4:], 1).alias("ipsec")))
    return x.select("capture_id", F.when(F.col("q") % 2 == 0, flat).otherwise(nested).alias("document"))


def _predictions(spark, d):
    x = _events(spark, d).select("capture_id", "q").distinct().where("q % 4 <> 1")
    return x.selectExpr("capture_id", f"{_SURE} confidence", f"{_MODEL} model_id", "'1' model_version", "'s' feature_schema", f"{_DECIDED} decision")


def _facts(spark, d):
    return fa.assemble_facts(_packets(spark, d), fa.configured(_documents(spark, d)), _predictions(spark, d))


def _rows(table: dict) -> str:
    return ", ".join(f"({k}, '{v}')" if isinstance(k, int) else f"('{k}', '{v}')" for k, v in table.items())


_TIERS = _rows(ru.ENCRYPTION | ru.INTEGRITY | ru.PRF | ru.GROUPS)
_NAMED = " union all ".join(
    f"select capture_id, protocol, '{kind}' kind, coalesce(name, '{unknown}' || id) name from (select capture_id, protocol, {_pick(*_IDS[n])} id from we where parsed and said and ({_HELD[n]})) left join (values {_rows(registry)}) r(no, name) on no = id"
    for kind, (n, registry, unknown) in fa.TRANSFORMS.items()
)
_KEYS = (("ike_encryption", "ike", "encryption", "encryption"), ("child_encryption", "child", "encryption", "encryption"), ("ike_integrity", "ike", "integrity", "integrity"), ("child_integrity", "child", "integrity", "integrity"), ("ike_prf", "ike", "prf", "prf"), ("ike_dh_group", "ike", "groups", "dh_group"), ("child_dh_group", "child", "groups", "child_group"))
_LIFE = "case when {0} is null then 'UNKNOWN' when {0} <= 0 then 'FORBIDDEN' when {0} <= {1} then 'RECOMMENDED' when {0} <= {2} then 'ACCEPTABLE' when {0} <= {3} then 'DEPRECATED' else 'FORBIDDEN' end"


def _verdict_sql() -> str:
    """RV: the rules over the facts, each as the catalogue words it."""
    keys = ", ".join(f"('{k}', '{s}', '{kind}', '{c}')" for k, s, kind, c in _KEYS)
    stated = " union all ".join(f"select capture_id, '{c}' field, {c} name from cf where {c} is not null" for c in ("encryption", "integrity", "prf", "dh_group", "child_group"))
    row = lambda s, e, t="null", c="1.0": f"{{{{'s': ({s})::varchar, 'e': ({e})::varchar, 't': ({t})::varchar, 'c': ({c})::double}}}}".replace("{{", "{").replace("}}", "}")
    unseen = row("'NOT_VERIFIABLE'", "'NOT_VERIFIABLE'")
    say = lambda cond, yes: f"case when {cond} then {yes} else {unseen} end"
    obs = "'OBSERVED'"
    strong = lambda k: f"(select {row('status', 'evidence', 'weak')} from st0 where st0.capture_id = z.capture_id and st0.key = '{k}')"
    ciphers = lambda k: f"(select {row('''case when bare then 'FAIL' when n > 0 then 'PASS' else 'NOT_VERIFIABLE' end''', '''case when n > 0 then 'OBSERVED' else 'NOT_VERIFIABLE' end''')} from st0 where st0.capture_id = z.capture_id and st0.key = '{k}')"
    sound = lambda s: f"case when (select n from st0 where st0.capture_id = z.capture_id and st0.key = '{s}_integrity') > 0 then {strong(f'{s}_integrity')} else {ciphers(f'{s}_encryption')} end"
    seen = "pfs_status in ('OBSERVED','DISABLED')"
    holds = "case pfs_status when 'OBSERVED' then true when 'DISABLED' then false else pfs end"
    fresh = say(f"({holds}) is not null", row(f"case when {holds} then 'PASS' else 'FAIL' end", f"case when {seen} then 'OBSERVED' else 'CONFIGURED' end"))
    claim = f"case when pfs is null then {unseen} when not ({seen}) then {row(chr(39) + 'PASS' + chr(39), chr(39) + 'CONFIGURED' + chr(39))} else " + row("case when pfs and pfs_status='DISABLED' then 'FAIL' when not pfs and pfs_status='OBSERVED' then 'WARNING' else 'PASS' end", obs) + " end"

    def life(field, ceilings):
        t = _LIFE.format(field, *ceilings)
        return row(f"case {t} when 'UNKNOWN' then 'NOT_VERIFIABLE' when 'DEPRECATED' then 'WARNING' when 'FORBIDDEN' then 'FAIL' else 'PASS' end", f"case {t} when 'UNKNOWN' then 'NOT_VERIFIABLE' else 'CONFIGURED' end", f"case when {t} in ('DEPRECATED','FORBIDDEN') then {t} end")

    spoken = "coalesce(wire_version, ike_version)"
    version = say(f"{spoken} is not null", row(f"case when {spoken} <> 1 then 'PASS' when exposed then 'FAIL' when versions > 1 then 'WARNING' else 'FAIL' end", "case when wire_version is not null then 'OBSERVED' else 'CONFIGURED' end"))
    cover = f"case when esp > 0 then {row(chr(39) + 'PASS' + chr(39), obs)} when ike > 0 then {row(chr(39) + 'FAIL' + chr(39), obs)} else {unseen} end"
    bad = lambda c: say("flows > 0", row(f"case when {c} then 'WARNING' else 'PASS' end", obs))
    order = row("case when esp < 20 then 'NOT_VERIFIABLE' when gaps > 0 or replays > 0 or disordered > 0 then 'WARNING' else 'PASS' end", "case when esp > 0 then 'OBSERVED' else 'NOT_VERIFIABLE' end")
    window = say("replay_protection is not null", row("case when replay_protection then 'PASS' else 'FAIL' end", "'CONFIGURED'"))
    guess = f"case when confidence is null or not complete then {unseen} when unknown then {row("'NOT_VERIFIABLE'", "'INFERRED'")} else {row("'WARNING'", "'INFERRED'", "null", "confidence")} end"
    said = {
        "CRYPTO-001": strong("ike_encryption"), "CRYPTO-002": sound("ike"), "CRYPTO-003": strong("ike_prf"), "CRYPTO-004": strong("child_encryption"), "CRYPTO-005": sound("child"), "KEYX-001": strong("ike_dh_group"), "KEYX-002": strong("child_dh_group"),
        "KEYX-003": fresh, "KEYX-004": claim, "KEYX-005": life("ike_lifetime", a.IKE_LIFETIME), "KEYX-006": life("child_lifetime", a.CHILD_LIFETIME), "KEYX-007": say("plain", row("'WARNING'", obs)), "KEYX-008": version,
        "SA-001": cover, "SA-002": bad("pinned"), "SA-003": bad("encapsulated > 0"), "REPLAY-001": order, "REPLAY-002": window, "REPLAY-003": unseen, "REPLAY-004": unseen,
        "CONFIG-001": say("given", row("'PASS'", "'CONFIGURED'")), "CONFIG-002": say("proposals > 0", row("'PASS'", obs)), "CONFIG-003": say("given", row("case when apart then 'WARNING' else 'PASS' end", obs)),
        "META-001": say("esp > 0", row("'WARNING'", obs)), "META-002": row("case when esp < 20 then 'NOT_VERIFIABLE' else 'WARNING' end", obs), "META-003": guess,
    }
    pairs = " union all ".join(f"select capture_id, '{r}' rule_id, {k}::int as ordinal, '{c}' category, '{p}' property_key, {said[r]} v, {pts.get('FAIL', 0.0)} f, {pts.get('WARNING', 0.0)} g from z" for k, (r, c, p, pts) in enumerate(ru.RULES, 1))
    configured = ", ".join(f"case when q % 3 <> 1 then {duck} end {c}" for c, (_, _, duck) in _CONFIGURED.items())
    drift = " or ".join(f"coalesce((select count(*) > 0 and not coalesce(bool_or(name = z0.{c}), false) from off o where o.capture_id = z0.capture_id and o.kind = '{kind}'{extra}) and z0.{c} is not null, false)" for c, kind, extra in (("encryption", "encryption", ""), ("integrity", "integrity", ""), ("prf", "prf", " and o.scope = 'ike'"), ("dh_group", "groups", "")))
    return f"""{_AS_P}, {captures.FLOWS}, {captures.HEALTH}, cap as (select distinct capture_id, q from we),
cf as (select capture_id, q, q % 3 <> 1 given, {configured} from cap),
off as (select distinct capture_id, case when protocol = 1 then 'ike' else 'child' end scope, kind, name from ({_NAMED})),
msg as (select capture_id, count(distinct version) versions, max(version) wire_version, count(*) filter (said) proposals, bool_or(kind not in (34, 2) and said and "second" <> 46) selectable, bool_or(said and protocol in (2, 3)) child,
 bool_or((kind = 35 or (version = 1 and kind = 5)) and "second" <> 46) plain, bool_or(version = 1 and "second" = 5) exposed from we where parsed group by 1),
pf as (select m.capture_id, case when exists (select 1 from off o where o.capture_id = m.capture_id and o.scope = 'child' and o.kind = 'groups') then 'OBSERVED' when child then 'DISABLED' else 'NOT_VERIFIABLE' end pfs_status from msg m),
cnt as (select capture_id, count(*) filter (parsed) ike, count(*) filter (proto = 'ESP') esp from we group by 1),
flo as (select capture_id, count(*) flows, bool_or(lower(lpad(to_hex(spi_int), 8, '0')) in {ru.DEGENERATE}) pinned, count(*) filter (udp_encapsulated) encapsulated, sum(sequence_gaps) gaps, sum(sequence_replays) replays, count(*) filter (not sequence_monotonic) disordered from fl join sh using(capture_id, spi_int) group by 1),
eff0 as (select cap.capture_id, k.key, k.field, o.name from cap cross join (values {keys}) k(key, scope, kind, field) left join off o on o.capture_id = cap.capture_id and o.scope = k.scope and o.kind = k.kind),
eff as (select e.capture_id, e.key, coalesce(e.name, s.name) name, case when e.name is not null then 'OBSERVED' when s.name is not null then 'CONFIGURED' else 'NOT_VERIFIABLE' end evidence from eff0 e left join ({stated}) s on s.capture_id = e.capture_id and s.field = e.field),
tier as (select e.*, coalesce(t.tier, 'UNKNOWN') tier from eff e left join (values {_TIERS}) t(wire, tier) on t.wire = e.name),
best as (select capture_id, key, count(name) n, any_value(evidence) evidence, arg_max(tier, {{'r': case tier when 'FORBIDDEN' then 4 when 'DEPRECATED' then 3 when 'UNKNOWN' then 2 when 'ACCEPTABLE' then 1 else 0 end, 'n': name}}) filter (name is not null) tier, bool_or(name not in {(*ru.AEAD, 'ENCR_NULL')}) bare from tier group by 1, 2),
st0 as (select b.*, case when b.tier is null or b.tier = 'UNKNOWN' then 'NOT_VERIFIABLE' when b.tier in ('FORBIDDEN','DEPRECATED') and (n <= 1 or coalesce(selectable, false)) then 'FAIL' when b.tier in ('FORBIDDEN','DEPRECATED') then 'WARNING' else 'PASS' end status, case when b.tier in ('FORBIDDEN','DEPRECATED') then b.tier end weak from best b left join msg using(capture_id)),
z0 as (select cf.* exclude(q), versions, wire_version, coalesce(proposals, 0) proposals, coalesce(plain, false) plain, coalesce(exposed, false) exposed, coalesce(pfs_status, 'NOT_VERIFIABLE') pfs_status, ike, esp, coalesce(flows, 0) flows, coalesce(pinned, false) pinned, coalesce(encapsulated, 0) encapsulated,
 coalesce(gaps, 0) gaps, coalesce(replays, 0) replays, coalesce(disordered, 0) disordered, case when q % 4 <> 1 then {_DUCK(_SURE)}::double end confidence, q % 5 <> 4 complete, q % 6 = 5 unknown from cf left join msg using(capture_id) left join pf using(capture_id) left join cnt using(capture_id) left join flo using(capture_id)),
z as (select *, {drift} apart from z0), rv as ({pairs}),
c as (select capture_id, rule_id, ordinal, category, property_key, v.s status, v.e evidence_status, (case when v.t = 'FORBIDDEN' then 20.0 when v.t = 'DEPRECATED' then 12.0 when v.s = 'FAIL' then f when v.s = 'WARNING' then g else 0.0 end)::double base, v.c confidence from rv)"""


RC = _verdict_sql()


@query(f"with {RC} select * from c")
def rule_catalogue(spark, d):
    """The verdicts of all 26 rules on each capture, from its bytes, its configuration and its prediction."""
    return ru.rule_verdicts(_facts(spark, d))


def _settled(spark, d):
    return _kept(spark, fa.settled_findings(_facts(spark, d)))


def _over(text: str) -> str:
    """SQL over view C, over these verdicts instead."""
    return text.replace(C, RC, 1)


@query(f"with {_over(_ST)} select * from st")
def rule_findings(spark, d):
    """Those verdicts, priced and settled."""
    return fa.settled_findings(_facts(spark, d))


@query(f"with {_over(_TM)} select * from tm")
def threat_catalogue(spark, d):
    """All 20 threats against the findings of all 26 rules."""
    return a.threat_matrix(_settled(spark, d), a.catalogue(spark))


_MEND = {rule: f"mend {key}" for rule, _, key, _ in ru.RULES}
_OPEN = """ex0 as (select capture_id, count(*) n, count(*) filter (proto = 'ESP') esp, count(*) filter (proto = 'IKE') ike, count(distinct spi_int) filter (proto = 'ESP') fl0 from p group by 1),
ex1 as (select capture_id, unnest([case when fl0 > 0 then 4 end, case when fl0 > 0 then 3 end, case when ike > 0 then 3 end, case when fl0 > 1 then 3 when fl0 = 1 then 2 end, case when 100.0 * (n - esp) / n >= 25 then 4 when n > esp then 3 else 1 end, null]) points from ex0),
ex as (select capture_id, round(100.0 * coalesce(sum(points), 0) / (4 * count(points)), 0)::int privacy_risk from ex1 group by 1)"""
_COVER = "case evidence_status when 'OBSERVED' then 1.0::DOUBLE when 'CONFIGURED' then 0.75::DOUBLE when 'INFERRED' then 0.5::DOUBLE else 0.0::DOUBLE end"
_RANKED = "case sev when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"


@query(f"""with {_over(_TM)}, {_SS[len(_ST):].removeprefix(', ')}, {_OPEN},
fi as (select capture_id, round(avg({_COVER}), 4) evidence_coverage, count(*) filter (evidence_status = 'OBSERVED') observed, string_agg(rule_id || '=' || status || '/' || round(points * 100)::bigint, ',' order by ordinal) findings from st group by 1),
ca as (select capture_id, string_agg(category || '=' || round(deducted * 100)::bigint, ',' order by category) categories from cs group by 1), th as (select capture_id, string_agg(threat_id || '=' || risk || ':' || evidence, ',' order by threat_id) threats from tm group by 1),
ad0 as (select *, {_SEV} sev, 'mend ' || property_key advice from st where status in ('FAIL', 'WARNING')), ad1 as (select capture_id, advice, max({_RANKED}) r, max(points) pts, string_agg(distinct rule_id, '+' order by rule_id) who from ad0 group by 1, 2),
ad as (select capture_id, string_agg(advice || '=' || who, ',' order by r desc, pts desc, advice) advice from ad1 group by 1)
select capture_id, rounded_score security_score, 100 - rounded_score risk_score, rounded_level risk_level, evidence_coverage, observed, findings, categories, coalesce(threats, '') threats, coalesce(advice, '') advice, privacy_risk
from ss join fi using(capture_id) join ca using(capture_id) join ex using(capture_id) left join th using(capture_id) left join ad using(capture_id)""")
def whole_assessment(spark, d):
    """The assessment of each capture from its bytes; its nested parts as text."""
    packets = _packets(spark, d)
    facts = fa.assemble_facts(packets, fa.configured(_documents(spark, d)), _predictions(spark, d))
    exposure = fl.exposure_score(fl.exposure_observations(packets))
    x = fa.assess_captures(_kept(spark, fa.settled_findings(facts)), a.catalogue(spark), _MEND, F.expr(_SEV), exposure)
    cents = lambda c: F.round(c * 100).cast("long").cast("string")
    text = lambda name, of: F.coalesce(F.array_join(F.transform(name, of), ","), F.lit("")).alias(name)
    return x.select(
        "capture_id", "security_score", "risk_score", "risk_level", "evidence_coverage", F.col("evidence.observed").alias("observed"), text("findings", lambda f: F.concat(f["rule_id"], F.lit("="), f["status"], F.lit("/"), cents(f["points"]))),
        text("categories", lambda c: F.concat(c["category"], F.lit("="), cents(c["deducted"]))), text("threats", lambda t: F.concat(t["threat_id"], F.lit("="), t["risk"], F.lit(":"), t["evidence"])),
        text("recommendations", lambda r: F.concat(r["advice"], F.lit("="), F.replace(r["rules"], F.lit(","), F.lit("+")))).alias("advice"), "exposure.privacy_risk",
    )


# the stored history: orders as bundle documents

_BUNDLE = {
    "source_mode": "o_orderpriority", "display_filename": "concat('c', o_custkey, '.pcap')", "capture_size": "cast(floor(o_totalprice) as bigint)", "capture_hash": "case when o_orderkey % 5 <> 0 then md5(cast(o_orderkey as varchar(20))) end",
    "traffic_prediction": "case when o_custkey % 3 <> 0 then o_orderpriority end", "traffic_confidence": "case when o_custkey % 3 <> 0 then (o_orderkey % 100) / 128.0D end", "security_score": "case when o_custkey % 4 <> 0 then (o_orderkey % 101) / 1.0D end",
    "risk_band": "case when o_custkey % 4 <> 0 then o_orderstatus end", "privacy_band": "case when o_custkey % 5 <> 0 then cast(o_custkey % 100 as varchar(20)) end",
}


def _bundles(spark, d):
    x = table(spark, d, "orders").selectExpr("*", *(f"{v} {k}" for k, v in _BUNDLE.items()))
    protocol = F.struct((F.col("o_custkey") % 2 == 0).alias("ipsec_detected"), (F.col("o_custkey") % 3).alias("ike_version"), (F.col("o_orderkey") % 4).alias("esp_packets"), F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")).alias("esp_flows"))
    doc = F.struct(
        F.concat(F.lit("a"), "o_orderkey").alias("analysis_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit("b/1").alias("schema_version"), F.col("o_orderstatus").alias("status"), protocol.alias("protocol"),
        F.struct(F.col("source_mode").alias("kind"), F.col("display_filename").alias("filename"), F.col("capture_size").alias("size_bytes"), F.col("capture_hash").alias("sha256")).alias("source"),
        F.struct(F.col("traffic_prediction").alias("predicted_class"), F.col("traffic_confidence").alias("confidence")).alias("traffic"), F.struct("security_score", F.col("risk_band").alias("risk_level")).alias("security"), F.struct(F.col("privacy_band").alias("privacy_risk")).alias("privacy"),
    )
    return x.select("o_orderkey", F.to_json(doc).alias("document"))


def _history(spark, d):
    """All bundles put, one in ten replaced by a later state (twice, which changes nothing), one in seven deleted."""
    h = hi.new_history(spark, 16)
    x = _kept(spark, _bundles(spark, d))
    h.put(hi.history_rows(x))
    later = hi.history_rows(x.where("o_orderkey % 10 = 0")).withColumns({"created_at": F.lit("2100-01-01T00:00:00Z"), "analysis_state": F.lit("again")})
    for _ in range(2):
        h.put(later)
    h.delete(x.where("o_orderkey % 7 = 0").select(F.concat(F.lit("a"), "o_orderkey").alias("analysis_id")))
    return h


_HISTORY = f"""hr as (select 'a' || o_orderkey analysis_id, case when o_orderkey % 10 = 0 then '2100-01-01T00:00:00Z' else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end created_at, {', '.join(f"{_DUCK(v).replace('.0D', '.0')} {k}" for k, v in _BUNDLE.items())},
 'b/1' bundle_schema, null::varchar bundle_path, concat_ws(', ', case when o_custkey % 2 = 0 then 'IPsec' end, case when o_custkey % 3 > 0 then 'IKEv' || o_custkey % 3 end, case when o_orderkey % 4 > 0 then (o_orderkey % 4) || ' ESP' end, (o_orderkey % 3 + 1) || ' flow(s)') protocol_summary,
 case when o_orderkey % 10 = 0 then 'again' else o_orderstatus end analysis_state from orders where o_orderkey % 7 <> 0)"""


@query(f"with {_HISTORY} select * replace (traffic_confidence::double as traffic_confidence, security_score::double as security_score) from hr")
def history_table(spark, d):
    return _history(spark, d).rows()


@query(f"with {_HISTORY} select analysis_id, created_at, analysis_state from hr where source_mode = '1-URGENT' and analysis_state = 'again' order by created_at desc, analysis_id desc limit 500")
def history_page(spark, d):
    """The newest analyses of one source and state; a limit above 500 counts as 500."""
    return _history(spark, d).listed(900, source_mode="1-URGENT", analysis_state="again", risk_band=None).select("analysis_id", "created_at", "analysis_state")
