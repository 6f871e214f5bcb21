"""The rule catalogue: 26 verdicts for each capture, as column expressions over one row of facts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.columns import folded
from flowmill.operators.assess import CHILD_LIFETIME, IKE_LIFETIME, TIER_RANK, lifetime_tier, lookup

# Tiers of wire names.
ENCRYPTION = {
    "ENCR_AES_GCM_16": "RECOMMENDED", "ENCR_AES_GCM_12": "ACCEPTABLE", "ENCR_AES_GCM_8": "DEPRECATED", "ENCR_CHACHA20_POLY1305": "RECOMMENDED", "ENCR_AES_CBC": "ACCEPTABLE",
    "ENCR_3DES": "DEPRECATED", "ENCR_DES": "FORBIDDEN", "ENCR_DES_IV64": "FORBIDDEN", "ENCR_NULL": "FORBIDDEN",
}
AEAD = ("ENCR_AES_GCM_16", "ENCR_AES_GCM_12", "ENCR_AES_GCM_8", "ENCR_CHACHA20_POLY1305")
INTEGRITY = {
    "AUTH_HMAC_SHA2_256_128": "RECOMMENDED", "AUTH_HMAC_SHA2_384_192": "RECOMMENDED", "AUTH_HMAC_SHA2_512_256": "RECOMMENDED", "AUTH_HMAC_SHA1_96": "DEPRECATED", "AUTH_HMAC_MD5_96": "FORBIDDEN", "NONE": "FORBIDDEN",
}
PRF = {
    "PRF_HMAC_SHA2_256": "RECOMMENDED", "PRF_HMAC_SHA2_384": "RECOMMENDED", "PRF_HMAC_SHA2_512": "RECOMMENDED", "PRF_AES128_XCBC": "ACCEPTABLE", "PRF_AES128_CMAC": "ACCEPTABLE", "PRF_HMAC_SHA1": "DEPRECATED", "PRF_HMAC_MD5": "FORBIDDEN",
}
GROUPS = {
    "CURVE25519": "RECOMMENDED", "ECP_256": "RECOMMENDED", "ECP_384": "RECOMMENDED", "ECP_521": "RECOMMENDED", "MODP_2048": "ACCEPTABLE", "MODP_3072": "RECOMMENDED", "MODP_4096": "RECOMMENDED",
    "MODP_6144": "RECOMMENDED", "MODP_8192": "RECOMMENDED", "MODP_1536": "DEPRECATED", "MODP_1024": "FORBIDDEN", "MODP_768": "FORBIDDEN",
}
# Other spellings of wire names, and the numbers of groups.
ENCRYPTION_ALIASES = {
    "aes128_gcm": "ENCR_AES_GCM_16", "aes192_gcm": "ENCR_AES_GCM_16", "aes256_gcm": "ENCR_AES_GCM_16", "aes128gcm16": "ENCR_AES_GCM_16", "aes192gcm16": "ENCR_AES_GCM_16", "aes256gcm16": "ENCR_AES_GCM_16", "aes_gcm": "ENCR_AES_GCM_16",
    "aes128_gcm12": "ENCR_AES_GCM_12", "aes256_gcm12": "ENCR_AES_GCM_12", "aes128_gcm8": "ENCR_AES_GCM_8", "aes256_gcm8": "ENCR_AES_GCM_8",
    "aes128_cbc": "ENCR_AES_CBC", "aes192_cbc": "ENCR_AES_CBC", "aes256_cbc": "ENCR_AES_CBC", "aes128": "ENCR_AES_CBC", "aes256": "ENCR_AES_CBC", "aes_cbc": "ENCR_AES_CBC",
    "chacha20poly1305": "ENCR_CHACHA20_POLY1305", "3des": "ENCR_3DES", "3des_cbc": "ENCR_3DES", "des3": "ENCR_3DES", "des": "ENCR_DES", "null": "ENCR_NULL",
}
INTEGRITY_ALIASES = {
    "hmac_sha256": "AUTH_HMAC_SHA2_256_128", "sha256": "AUTH_HMAC_SHA2_256_128", "hmac_sha384": "AUTH_HMAC_SHA2_384_192", "sha384": "AUTH_HMAC_SHA2_384_192", "hmac_sha512": "AUTH_HMAC_SHA2_512_256", "sha512": "AUTH_HMAC_SHA2_512_256",
    "hmac_sha1": "AUTH_HMAC_SHA1_96", "hmac_sha_1_96": "AUTH_HMAC_SHA1_96", "sha1": "AUTH_HMAC_SHA1_96", "hmac_md5": "AUTH_HMAC_MD5_96", "md5": "AUTH_HMAC_MD5_96", "none": "NONE", "null": "NONE",
}
PRF_ALIASES = {
    "prfsha256": "PRF_HMAC_SHA2_256", "prf_hmac_sha2_256": "PRF_HMAC_SHA2_256", "sha256": "PRF_HMAC_SHA2_256", "prfsha384": "PRF_HMAC_SHA2_384", "sha384": "PRF_HMAC_SHA2_384", "prfsha512": "PRF_HMAC_SHA2_512", "sha512": "PRF_HMAC_SHA2_512",
    "prfsha1": "PRF_HMAC_SHA1", "sha1": "PRF_HMAC_SHA1", "prfmd5": "PRF_HMAC_MD5", "md5": "PRF_HMAC_MD5", "aes_xcbc": "PRF_AES128_XCBC", "aes_cmac": "PRF_AES128_CMAC",
}
GROUP_ALIASES = {
    "modp768": "MODP_768", "modp1024": "MODP_1024", "modp1536": "MODP_1536", "modp2048": "MODP_2048", "modp3072": "MODP_3072", "modp4096": "MODP_4096", "modp6144": "MODP_6144", "modp8192": "MODP_8192",
    "ecp256": "ECP_256", "nistp256": "ECP_256", "ecp384": "ECP_384", "nistp384": "ECP_384", "ecp521": "ECP_521", "nistp521": "ECP_521", "curve25519": "CURVE25519", "x25519": "CURVE25519",
}
GROUP_NUMBERS = {
    1: "MODP_768", 2: "MODP_1024", 5: "MODP_1536", 14: "MODP_2048", 15: "MODP_3072", 16: "MODP_4096", 17: "MODP_6144", 18: "MODP_8192", 19: "ECP_256", 20: "ECP_384", 21: "ECP_521", 31: "CURVE25519",
}
# Points, rules with their categories, properties and points, and what rules look for.
TIER_POINTS = {"FORBIDDEN": 20.0, "DEPRECATED": 12.0}
STANDARD, GAP, EXPOSURE, NOTHING = {"FAIL": 14.0, "WARNING": 5.0}, {"FAIL": 20.0, "WARNING": 6.0}, {"FAIL": 8.0, "WARNING": 3.0}, {}
RULES = (
    ("CRYPTO-001", "CRYPTOGRAPHY", "ike_encryption", STANDARD),
    ("CRYPTO-002", "CRYPTOGRAPHY", "ike_integrity", GAP),
    ("CRYPTO-003", "CRYPTOGRAPHY", "ike_prf", STANDARD),
    ("CRYPTO-004", "CRYPTOGRAPHY", "child_encryption", STANDARD),
    ("CRYPTO-005", "CRYPTOGRAPHY", "child_integrity", GAP),
    ("KEYX-001", "KEY_EXCHANGE", "ike_dh_group", STANDARD),
    ("KEYX-002", "KEY_EXCHANGE", "child_dh_group", STANDARD),
    ("KEYX-003", "KEY_EXCHANGE", "pfs", GAP),
    ("KEYX-004", "KEY_EXCHANGE", "pfs", GAP),
    ("KEYX-005", "KEY_EXCHANGE", "ike_lifetime", STANDARD),
    ("KEYX-006", "KEY_EXCHANGE", "child_lifetime", STANDARD),
    ("KEYX-007", "KEY_EXCHANGE", "authentication", GAP),
    ("KEYX-008", "KEY_EXCHANGE", "ike_version", {"FAIL": 14.0, "WARNING": 8.0}),
    ("SA-001", "SA_SECURITY", "protection_coverage", {"FAIL": 14.0, "WARNING": 5.0}),
    ("SA-002", "SA_SECURITY", "spi_entropy", {"FAIL": 8.0, "WARNING": 6.0}),
    ("SA-003", "SA_SECURITY", "encapsulation", {"WARNING": 2.0}),
    ("REPLAY-001", "REPLAY_PROTECTION", "sender_sequence", {"WARNING": 6.0}),
    ("REPLAY-002", "REPLAY_PROTECTION", "replay_window", {"FAIL": 12.0, "WARNING": 4.0}),
    ("REPLAY-003", "REPLAY_PROTECTION", "sequence_space", NOTHING),
    ("REPLAY-004", "REPLAY_PROTECTION", "receiver_policy", NOTHING),
    ("CONFIG-001", "CONFIGURATION", "config_provenance", NOTHING),
    ("CONFIG-002", "CONFIGURATION", "downgrade_surface", {"WARNING": 6.0}),
    ("CONFIG-003", "CONFIGURATION", "config_agreement", {"WARNING": 6.0}),
    ("META-001", "METADATA_PRIVACY", "association_visibility", EXPOSURE),
    ("META-002", "METADATA_PRIVACY", "volume_exposure", EXPOSURE),
    ("META-003", "METADATA_PRIVACY", "class_inference", {"FAIL": 10.0, "WARNING": 6.0}),
)
DEGENERATE = ("00000000", "ffffffff", "11111111", "22222222", "aaaaaaaa", "cccccccc")
AUTHENTICATING = ("IKE_AUTH", "IKEV1_EXCHANGE_3", "IKEV1_EXCHANGE_5", "IKEV1_EXCHANGE_6")
IDENTITY_V1, ENOUGH = 5, 20
#: One row of facts: what was observed, then what a configuration states (config), then what a model says (predicted).
FACTS = """capture_id string, ike_encryption array<string>, ike_integrity array<string>, ike_prf array<string>, ike_groups array<string>,
 child_encryption array<string>, child_integrity array<string>, child_groups array<string>, proposals long, selection_observable boolean, pfs_status string,
 exchanges array<struct<exchange: string, version: int, payloads: array<int>, encrypted: boolean>>, ike_versions array<int>, ike_packets long, esp_packets long,
 spis array<string>, flows long, encapsulated long, gaps long, replays long, disordered long,
 config struct<encryption: string, integrity: string, prf: string, dh_group: string, pfs: boolean, child_group: string, ike_version: int, replay_protection: boolean, ike_lifetime: long, child_lifetime: long>,
 predicted struct<confidence: double, complete: boolean, unknown: boolean>"""

#: Wire names and their other spellings, by kind of algorithm.
SPELLINGS = {"encryption": (ENCRYPTION, ENCRYPTION_ALIASES), "integrity": (INTEGRITY, INTEGRITY_ALIASES), "prf": (PRF, PRF_ALIASES), "group": (GROUPS, GROUP_ALIASES | {f"group{n}": name for n, name in GROUP_NUMBERS.items()})}


def wire_name(name, kind: str) -> Column:
    """The wire name of an algorithm however it is written: without case and signs, by its aliases, a group also by its
    number. A name that none of them has comes in upper case, an unknown number as DH_GROUP_n; null and blank give an
    empty string."""
    wire, aliases = SPELLINGS[kind]
    known = {"".join(c for c in k.lower() if c.isalnum()): v for k, v in (aliases | {w: w for w in wire}).items()}
    text = F.trim(name)
    found = F.coalesce(lookup(folded(text), known), F.upper(text), F.lit(""))
    if kind == "group":
        number = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
        found = F.when(number.isNotNull(), F.coalesce(lookup(number, GROUP_NUMBERS), F.concat(F.lit("DH_GROUP_"), text))).otherwise(found)
    return found


_UNSEEN = ("NOT_VERIFIABLE", "NOT_VERIFIABLE")


def _verdict(status, evidence, tier=None, confidence=None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    sure = F.lit(1.0) if confidence is None else confidence
    return F.struct(as_col(status).alias("status"), as_col(evidence).alias("evidence_status"), as_col(tier).alias("tier"), sure.alias("confidence"))


def _listed(name: str) -> Column:
    return F.coalesce(F.array_distinct(F.filter(name, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def _effective(observed: str, stated: str) -> tuple[Column, Column]:
    """Names in effect, and how they are known: what was seen, else what is configured."""
    seen, said = _listed(observed), F.col(f"config.{stated}")
    names = F.when(F.size(seen) > 0, seen).when(said.isNotNull(), F.array(said)).otherwise(F.array().cast("array<string>"))
    return names, F.when(F.size(seen) > 0, "OBSERVED").when(said.isNotNull(), "CONFIGURED").otherwise("NOT_VERIFIABLE")


def _tier(name: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), name), F.lit("UNKNOWN"))


def _strength(names: Column, evidence: Column, table: dict[str, str]) -> Column:
    """The weakest of the names decides. A weak one fails if nothing else could have been chosen or the choice was seen,
    and warns if it was only offered; a name without a tier is not judged."""
    ranked = F.transform(names, lambda n: F.struct(lookup(_tier(n, table), TIER_RANK, 2).alias("rank"), n.alias("name"), _tier(n, table).alias("tier")))
    tier = F.array_max(ranked)["tier"]
    sole = (F.size(names) <= 1) | F.coalesce("selection_observable", F.lit(False))
    weak = tier.isin(*TIER_POINTS)
    status = F.when(tier.isNull() | (tier == "UNKNOWN"), "NOT_VERIFIABLE").when(weak & sole, "FAIL").when(weak, "WARNING").otherwise("PASS")
    return _verdict(status, evidence, F.when(weak, tier))


def _integrity(names: Column, evidence: Column, ciphers: Column) -> Column:
    """Without integrity names the ciphers decide: those that authenticate need none, others but the null cipher do."""
    alone = lambda c: ~c.isin(*AEAD, "ENCR_NULL")
    implied = F.when(F.size(ciphers) == 0, _verdict(*_UNSEEN)).when(F.exists(ciphers, alone), _verdict("FAIL", "OBSERVED")).otherwise(_verdict("PASS", "OBSERVED"))
    return F.when(F.size(names) > 0, _strength(names, evidence, INTEGRITY)).otherwise(implied)


def _lifetime(field: str, ceilings: tuple[int, int, int]) -> Column:
    tier = lifetime_tier(field, ceilings)
    status = F.when(tier == "UNKNOWN", "NOT_VERIFIABLE").when(tier == "DEPRECATED", "WARNING").when(tier == "FORBIDDEN", "FAIL").otherwise("PASS")
    return _verdict(status, F.when(tier == "UNKNOWN", "NOT_VERIFIABLE").otherwise("CONFIGURED"), F.when(tier.isin(*TIER_POINTS), tier))


def _key_exchange() -> list[Column]:
    pfs, said = F.col("pfs_status"), F.col("config.pfs")
    seen = pfs.isin("OBSERVED", "DISABLED")
    holds = F.when(pfs == "OBSERVED", True).when(pfs == "DISABLED", False).otherwise(said)
    fresh = F.when(holds.isNull(), _verdict(*_UNSEEN)).otherwise(_verdict(F.when(holds, "PASS").otherwise("FAIL"), F.when(seen, "OBSERVED").otherwise("CONFIGURED")))
    claim = F.when(said.isNull(), _verdict(*_UNSEEN)).when(~F.coalesce(seen, F.lit(False)), _verdict("PASS", "CONFIGURED"))
    claim = claim.otherwise(_verdict(F.when(said & (pfs == "DISABLED"), "FAIL").when(~said & (pfs == "OBSERVED"), "WARNING").otherwise("PASS"), "OBSERVED"))
    plain = F.exists("exchanges", lambda e: e["exchange"].isin(*AUTHENTICATING) & ~e["encrypted"])
    proof = F.when(plain, _verdict("WARNING", "OBSERVED")).otherwise(_verdict(*_UNSEEN))
    wire = F.try_element_at("ike_versions", F.lit(-1))
    version = F.coalesce(wire, F.col("config.ike_version"))
    exposed = F.coalesce(F.exists("exchanges", lambda e: (e["version"] == 1) & F.array_contains(e["payloads"], IDENTITY_V1) & ~e["encrypted"]), F.lit(False))
    old = F.when(exposed, "FAIL").when(F.size("ike_versions") > 1, "WARNING").otherwise("FAIL")
    spoken = F.when(version.isNull(), _verdict(*_UNSEEN)).otherwise(_verdict(F.when(version != 1, "PASS").otherwise(old), F.when(wire.isNotNull(), "OBSERVED").otherwise("CONFIGURED")))
    return [fresh, claim, _lifetime("config.ike_lifetime", IKE_LIFETIME), _lifetime("config.child_lifetime", CHILD_LIFETIME), proof, spoken]


def _traffic() -> list[Column]:
    esp, ike = F.coalesce("esp_packets", F.lit(0)), F.coalesce("ike_packets", F.lit(0))
    cover = F.when(esp > 0, _verdict("PASS", "OBSERVED")).when(ike > 0, _verdict("FAIL", "OBSERVED")).otherwise(_verdict(*_UNSEEN))
    flows = F.coalesce("flows", F.lit(0)) > 0
    pinned = F.coalesce(F.exists("spis", lambda s: F.lower(s).isin(*DEGENERATE)), F.lit(False))

    def of_flows(bad: Column) -> Column:
        return F.when(flows, _verdict(F.when(bad, "WARNING").otherwise("PASS"), "OBSERVED")).otherwise(_verdict(*_UNSEEN))

    seen = F.when(esp > 0, "OBSERVED").otherwise("NOT_VERIFIABLE")
    broken = (F.coalesce("replays", F.lit(0)) > 0) | (F.coalesce("gaps", F.lit(0)) > 0) | (F.coalesce("disordered", F.lit(0)) > 0)
    order = _verdict(F.when(esp < ENOUGH, "NOT_VERIFIABLE").when(broken, "WARNING").otherwise("PASS"), seen)
    window = F.col("config.replay_protection")
    replay = F.when(window.isNull(), _verdict(*_UNSEEN)).otherwise(_verdict(F.when(window, "PASS").otherwise("FAIL"), "CONFIGURED"))
    return [cover, of_flows(pinned), of_flows(F.coalesce("encapsulated", F.lit(0)) > 0), order, replay, _verdict(*_UNSEEN), _verdict(*_UNSEEN)]


def _configuration(used: list[Column]) -> list[Column]:
    given = F.col("config").isNotNull()
    source = F.when(given, _verdict("PASS", "CONFIGURED")).otherwise(_verdict(*_UNSEEN))
    kinds = (("encryption", ["ike_encryption", "child_encryption"]), ("integrity", ["ike_integrity", "child_integrity"]), ("prf", ["ike_prf"]), ("dh_group", ["ike_groups", "child_groups"]))
    seen = {stated: F.array_distinct(F.concat(*map(_listed, names))) for stated, names in kinds}
    spare = F.array_except(F.concat(*seen.values()), F.flatten(F.array(*used)))
    weak = F.exists(spare, lambda n: _tier(n, ENCRYPTION | INTEGRITY | PRF | GROUPS).isin(*TIER_POINTS))
    surface = F.when(F.coalesce("proposals", F.lit(0)) > 0, _verdict(F.when(weak, "WARNING").otherwise("PASS"), "OBSERVED")).otherwise(_verdict(*_UNSEEN))
    apart = F.lit(False)
    for stated, names in seen.items():
        apart = apart | F.coalesce((F.size(names) > 0) & ~F.array_contains(names, F.col(f"config.{stated}")), F.lit(False))
    return [source, surface, F.when(given, _verdict(F.when(apart, "WARNING").otherwise("PASS"), "OBSERVED")).otherwise(_verdict(*_UNSEEN))]


def _privacy() -> list[Column]:
    esp, p = F.coalesce("esp_packets", F.lit(0)), F.col("predicted")
    visible = F.when(esp > 0, _verdict("WARNING", "OBSERVED")).otherwise(_verdict(*_UNSEEN))
    volume = _verdict(F.when(esp < ENOUGH, "NOT_VERIFIABLE").otherwise("WARNING"), "OBSERVED")
    refused = p.isNull() | ~F.coalesce(p["complete"], F.lit(False))
    guess = F.when(refused, _verdict(*_UNSEEN)).when(F.coalesce(p["unknown"], F.lit(False)), _verdict("NOT_VERIFIABLE", "INFERRED"))
    return [visible, volume, guess.otherwise(_verdict("WARNING", "INFERRED", None, F.coalesce(p["confidence"], F.lit(0.0))))]


def rule_verdicts(facts: DataFrame) -> DataFrame:
    """facts: the columns of FACTS, one row for each capture; algorithm names are wire names (fold others first). 26 rows
    for each capture: capture_id, rule_id, ordinal, category, property_key, status, evidence_status, base, confidence,
    as price() takes them; base is that of the tier for weak algorithms and lifetimes, else the rule's.

    Null lists and counts count as empty and 0, a null config or prediction as not supplied. An offer that was not seen
    to be chosen warns. No shuffle, no Python: a row of facts becomes its verdicts where it lies."""
    ike_enc, child_enc = _effective("ike_encryption", "encryption"), _effective("child_encryption", "encryption")
    ike_int, child_int = _effective("ike_integrity", "integrity"), _effective("child_integrity", "integrity")
    prf, ike_dh, child_dh = _effective("ike_prf", "prf"), _effective("ike_groups", "dh_group"), _effective("child_groups", "child_group")
    crypto = [_strength(*ike_enc, ENCRYPTION), _integrity(*ike_int, ike_enc[0]), _strength(*prf, PRF), _strength(*child_enc, ENCRYPTION), _integrity(*child_int, child_enc[0])]
    groups = [_strength(*ike_dh, GROUPS), _strength(*child_dh, GROUPS)]
    used = [x[0] for x in (ike_enc, child_enc, ike_int, child_int, prf, ike_dh, child_dh)]
    verdicts = [*crypto, *groups, *_key_exchange(), *_traffic(), *_configuration(used), *_privacy()]
    rows = []
    for k, ((rule, category, key, points), v) in enumerate(zip(RULES, verdicts, strict=True), 1):
        rows.append(F.struct(F.lit(rule).alias("rule_id"), F.lit(k).alias("ordinal"), F.lit(category).alias("category"), F.lit(key).alias("property_key"), v.alias("v"), F.lit(points.get("FAIL", 0.0)).alias("f"), F.lit(points.get("WARNING", 0.0)).alias("w")))
    out = facts.select("capture_id", F.inline(F.array(*rows)))
    base = F.coalesce(lookup("v.tier", TIER_POINTS, None), F.when(F.col("v.status") == "FAIL", F.col("f")).when(F.col("v.status") == "WARNING", F.col("w")).otherwise(0.0))
    return out.select("capture_id", "rule_id", "ordinal", "category", "property_key", "v.status", "v.evidence_status", base.alias("base"), "v.confidence")


class Rule(NamedTuple):
    """A caller's rule: status and evidence are columns over a row of facts (PASS, FAIL, WARNING or NOT_VERIFIABLE; a grade of
    evidence), points what a FAIL and a WARNING cost, applies whether a capture is judged at all."""

    rule_id: str
    category: str
    property_key: str
    points: dict
    status: Column
    evidence: Column
    applies: Column | None = None
    confidence: Column | None = None


def caller_verdicts(facts: DataFrame, rules: list[Rule], first: int = 1) -> DataFrame:
    """A row for each capture and rule that applies to it, in the form of rule_verdicts, numbered from first in the order of
    rules. A null status can't be verified, a null condition does not apply. Rules are columns, so facts are read once
    and nothing is shuffled. No rules give no rows."""
    rows = []
    for k, r in enumerate(rules, first):
        status = F.coalesce(r.status, F.lit("NOT_VERIFIABLE"))
        base = F.when(status == "FAIL", r.points.get("FAIL", 0.0)).when(status == "WARNING", r.points.get("WARNING", 0.0)).otherwise(0.0)
        named = {"rule_id": F.lit(r.rule_id), "ordinal": F.lit(k), "category": F.lit(r.category), "property_key": F.lit(r.property_key), "status": status, "evidence_status": F.coalesce(r.evidence, F.lit("NOT_VERIFIABLE")), "base": base.cast("double"), "confidence": (F.lit(1.0) if r.confidence is None else r.confidence).cast("double")}
        row = F.struct(*(v.alias(n) for n, v in named.items()))
        rows.append(row if r.applies is None else F.when(r.applies, row))
    kind = "array<struct<rule_id:string,ordinal:int,category:string,property_key:string,status:string,evidence_status:string,base:double,confidence:double>>"
    return facts.select("capture_id", F.inline(F.array_compact(F.array(*rows)).cast(kind)))
