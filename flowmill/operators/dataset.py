"""Labelled datasets: joins, splits, contracts, audits, duplicates and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.columns import first_reason, reasons
from flowmill.functions.shared import shared_folder


def labels_join(features: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Rows with their truth."""
    return features.join(truth, key)


def labels_rejected(features: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Rows without truth and truth without rows, each with its reason."""
    a = features.join(truth, key, "left_anti").select(key, F.lit("no ground truth").alias("reason"))
    return a.union(truth.join(features, key, "left_anti").select(key, F.lit("no features").alias("reason")))


def grouped_split(keys, seed: str, fractions: dict[str, float]) -> F.Column:
    """The split of a key: the first 64 bits of SHA-256 of "seed NUL key", as a fraction, against the fractions' running
    sums. Equal keys always fall together."""
    h = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(keys).cast("string")), 256)
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double")
    x = (half(1) * 4294967296.0 + half(9)) / 18446744073709551616.0
    total, run, out = sum(fractions.values()), 0.0, None
    names = list(fractions)
    for name in names[:-1]:
        run += fractions[name] / total
        out = F.when(x < run, name) if out is None else out.when(x < run, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def row_contract(rows: DataFrame, required: list[str], numeric: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """rows with violations: text columns that are empty, values outside a vocabulary, numbers that are not finite."""
    checks = [(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"{c} is empty") for c in required]
    checks += [(~F.coalesce(F.col(c).isin(v), F.lit(False)), f"{c} is not allowed") for c, v in allowed.items()]
    checks += [(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), f"{c} is not finite") for c in numeric]
    return rows.withColumn("violations", F.concat_ws("; ", reasons(*checks)))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with verdict: the first row of a key is accepted, the others are duplicates; rows without a key are left out. Rows
    meet the first ones by key and order together, so those of a hot key spread over all tasks."""
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    out = rows.where(F.col(key).isNotNull()).join(first, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_first")), "left")
    return out.withColumn("verdict", F.when(F.col("_first").isNotNull(), "accepted").otherwise("duplicate")).drop("_key", "_first")


def numbered(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """key, order and the row's number within its key in the order of order, from 1. order has no ties within a key; a null key
    is a key like others.

    Rows are parted by ranges of (key, order), so a key of many rows has many ranges and no task gets all of it. The
    ranges are written, as another run could draw others; a row's number is its number in its range, plus the rows of
    its key in the ranges before, of which there are as many counts as ranges and keys."""
    spark, where = rows.sparkSession, shared_folder(rows.sparkSession)
    ranges = rows.select(key, order).repartitionByRange(key, order).withColumn("_part", F.spark_partition_id())
    ranges.write.parquet(where)
    ranges = spark.read.schema(ranges.schema).parquet(where)
    counts = ranges.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_p", "_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", key).orderBy(order))
    out = ranges.withColumn("_own", own).join(counts, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return out.select(key, order, (F.col("_before") + F.col("_own")).alias(name))


def content_versions(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """rows with content hash, whether they are refused, and their version number within the key. A row is refused if a row
    before it, of whatever key, has the same content; refused rows take no version (null). Null contents are never
    refused. order has no ties and no nulls.

    The rows that are kept are found and numbered by key, order and hash alone; whole rows move once, to be joined with
    their numbers by order, which no two rows share."""
    sha = "content_sha256"
    out = rows.withColumn(sha, F.sha2(F.col(content), 256))
    slim = out.select(key, order, sha)
    first = slim.where(F.col(sha).isNotNull()).groupBy(sha).agg(F.min_by(F.struct(key, order), order).alias("r")).select("r.*")
    kept = numbered(first.unionByName(slim.where(F.col(sha).isNull()).select(key, order)), key, order, "version")
    out = out.join(kept.select(F.col(order).alias("_order"), "version"), F.col(order) == F.col("_order"), "left").drop("_order")
    return out.select(*rows.columns, sha, F.col("version").isNull().alias("refused"), "version")


def manifest_verdict(runs: DataFrame) -> DataFrame:
    """runs with reason: the first that keeps a run out of the manifest, or null. runs: experiment_id, pcap_path,
    valid_capture, error_code, reasons (array of texts), dry_run, file_found. Nulls count as empty or false; validity
    comes before the file, since a missing file is part of an invalid run."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    code = F.when(text("error_code") == "", "capture was not validated").otherwise(text("error_code"))
    invalid = F.concat(F.lit("not valid: "), code, F.when(F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0, F.concat(F.lit(": "), F.array_join("reasons", "; "))).otherwise(""))
    why = F.when(text("experiment_id") == "", "no experiment_id").when(text("pcap_path") == "", "no capture path").when(~yes("valid_capture"), invalid).when(yes("dry_run"), "dry run").when(~yes("file_found"), "capture file is missing")
    return runs.withColumn("reason", why)


def dataset_summary(rows: DataFrame, split: str, label: str, key: str) -> DataFrame:
    return rows.groupBy(split, label).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("groups"))


def split_integrity(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n")).where("n > 1")


def value_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """How often each value of each field occurs, in one pass."""
    kv = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields)))
    return rows.select(kv.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """A digest of all rows that does not depend on their order: the sum of 60 bits of each row's hash, and the count."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(rows.columns)))
    return rows.agg(F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"), F.count("*").alias("rows"))


def dataset_audit(rows: DataFrame, split: str, label: str, key: str, min_rows: int = 20) -> DataFrame:
    """Per split: rows, classes, groups; problems are hard, shortages soft."""
    agg = rows.groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(label).alias("classes"), F.count_distinct(key).alias("groups"))
    hard = reasons((F.col("classes") < 2, "fewer than two classes"), (F.col("groups") < 2, "fewer than two groups"))
    return agg.withColumn("problems", F.concat_ws("; ", hard)).withColumn("shortages", F.concat_ws("; ", reasons((F.col("rows") < min_rows, "few rows"))))


#: Rows that training, its classes and the other splits need for rates to mean something: fixed values.
TRAIN_ROWS, CLASS_ROWS, OTHER_ROWS = 8, 2, 4


def audit_findings(rows: DataFrame, split: str, label: str, key: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """What is wrong with a dataset for training: kind (problem: it can't be trained on; shortage: its measures say little)
    and reason; no rows if all is well. Splits are train, validation and test; numbers are columns that must be finite;
    null labels are no class, null keys no group. All of it comes from counts by split and label, and by group."""
    finite = F.lit(True)
    for c in numbers:
        x = F.col(c).cast("double")
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    by = rows.groupBy(F.col(split).alias("s"), F.col(label).cast("string").alias("c")).agg(F.count("*").alias("n"), F.count_if(~finite).alias("odd"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("s") == name, F.col("n"))), F.lit(0)).alias(name)
    classes = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("c"))))
    train = F.col("s") == "train"
    a = by.agg(of("train"), of("validation"), of("test"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"), classes(train).alias("seen"), classes(F.lit(True)).alias("every"), classes(train & (F.col("n") < CLASS_ROWS)).alias("thin"))
    groups = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.bool_or(F.col(split) == "train").alias("t"), (F.count_distinct(split) > 1).alias("m"))
    b = groups.agg(F.count_if("t").alias("groups"), F.coalesce(F.bool_or("m"), F.lit(False)).alias("shared"))
    few, unseen = F.array_join("thin", ", "), F.array_except("every", "seen")
    found = (
        (F.col("odd") > 0, "problem", F.lit("a feature value is not finite")), *((F.col(s) == 0, "problem", F.lit(f"the {s} split is empty")) for s in ("train", "validation", "test")), (F.size("seen") < 2, "problem", F.lit("fewer than two training classes")),
        (F.size(unseen) > 0, "problem", F.concat(F.lit("classes never seen in training: "), F.array_join(unseen, ", "))), (F.col("shared"), "problem", F.lit("groups in several splits")), (F.col("train") < TRAIN_ROWS, "shortage", F.lit("few training rows")),
        ((F.col("validation") < OTHER_ROWS) | (F.col("test") < OTHER_ROWS), "shortage", F.lit("few validation or test rows")), (F.col("groups") < 2, "shortage", F.lit("a single training group")), (few != "", "shortage", F.concat(F.lit("classes with few training rows: "), few)),
    )
    each = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(kind).alias("kind"), text.alias("reason"))) for bad, kind, text in found)))
    return a.crossJoin(b).select(F.explode(each).alias("r")).select("r.*")


def coverage_checks(configs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per check of a design: enough values of either factor, and no factor that decides the other."""
    x = configs.agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"))
    by_a = configs.groupBy(a).agg(F.count_distinct(b).alias("n")).agg(F.min("n").alias("least_b"))
    by_b = configs.groupBy(b).agg(F.count_distinct(a).alias("n")).agg(F.min("n").alias("least_a"))
    checks = {f"{a} has several values": F.col("n_a") > 1, f"{b} has several values": F.col("n_b") > 1, f"every {a} has several {b}": F.col("least_b") > 1, f"every {b} has several {a}": F.col("least_a") > 1}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("holds")) for k, v in checks.items())))
    return x.crossJoin(by_a).crossJoin(by_b).select(rows.alias("r")).select("r.name", "r.holds")


def design_coverage(configs: DataFrame, classes: list[str], ciphers: list[str]) -> DataFrame:
    """key and passed for each demand on a design of experiments. configs: mode (tunnel, transport), encryption, integrity,
    dh_group, pfs, ip_version, traffic. classes of traffic and ciphers must all occur. AEAD ciphers (GCM in their names)
    take no HMAC, others need one. Configurations and traffic must each meet several of the other. Nulls count as
    lacking; a table without rows passes nothing."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    cipher, hmac = F.coalesce("encryption", F.lit("")), F.coalesce(F.col("integrity").startswith("hmac"), F.lit(False))
    aead, pfs = cipher.contains("gcm"), F.coalesce("pfs", F.lit(False))
    cross = lambda m, a: has((F.col("mode") == m) & (aead if a else ~aead))
    checks = {
        "mode_tunnel": has(F.col("mode") == "tunnel"), "mode_transport": has(F.col("mode") == "transport"), "enc_aes128": has(cipher.startswith("aes128")), "enc_aes256": has(cipher.startswith("aes256")), "enc_gcm": has(aead), "enc_cbc_hmac": has(~aead),
        "aead_without_separate_hmac": has(aead) & ~has(aead & hmac), "cbc_requires_hmac": has(~aead) & ~has(~aead & ~hmac), "dh_groups": F.count_distinct("dh_group") >= 3, "pfs_enabled": has(pfs), "pfs_disabled": has(~pfs), "ipv4": has(F.col("ip_version") == 4), "ipv6": has(F.col("ip_version") == 6),
        **{f"traffic_{c}": has(F.col("traffic") == c) for c in classes}, "all_encryption_algorithms": F.count_distinct(F.when(cipher.isin(*ciphers), cipher)) == len(set(ciphers)),
        "mode_cipher_cross": cross("tunnel", True) & cross("tunnel", False) & cross("transport", True) & cross("transport", False),
    }
    one = configs.agg(*(v.alias(k) for k, v in checks.items()))
    parts = ("mode", "encryption", "integrity", "dh_group", "ip_version")
    pairs = configs.groupBy(*parts, "traffic").agg((has(pfs) & has(~pfs)).alias("x")).agg(has(F.col("x")).alias("pfs_isolated"))
    several = lambda keys, what: configs.groupBy(*keys).agg((F.count_distinct(what) > 1).alias("x")).agg(F.coalesce(F.bool_and("x"), F.lit(False)))
    whole = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*parts, "pfs")))
    out = one.crossJoin(pairs).crossJoin(several((*parts, "pfs"), "traffic").toDF("config_traffic_cross")).crossJoin(several(("traffic",), whole).toDF("traffic_config_cross"))
    rows = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("passed")) for c in out.columns))
    return out.select(F.explode(rows).alias("r")).select("r.*")


def isolated_pairs(configs: DataFrame, identity: list[str], flag: str, key: str) -> DataFrame:
    """Pairs of configurations equal but for a flag: the smallest key on either side of each identity."""
    g = configs.groupBy(*identity).agg(F.min(F.when(F.col(flag), F.col(key))).alias("with_key"), F.min(F.when(~F.col(flag), F.col(key))).alias("without_key"))
    return g.where("with_key is not null and without_key is not null")


def plan_expand(configs: DataFrame, key: str, repeats: str) -> DataFrame:
    """A row for each repeat of each configuration, with a session id made of both."""
    r = configs.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int"))))
    return r.withColumn("session_id", F.concat_ws("-", F.col(key).cast("string"), F.lpad(F.col("repeat").cast("string"), 3, "0")))


def config_fingerprint(columns: list[str]) -> F.Column:
    """16 digits of SHA-256 of the columns as JSON with sorted keys."""
    parts = [F.concat(F.lit(f'"{c}":"'), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit('"')) for c in sorted(columns)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 16)


def config_validity() -> F.Column:
    """Reasons against a pair of transforms, columns: encryption, integrity, pfs, child_group."""
    aead = F.col("encryption").contains("GCM") | F.col("encryption").contains("CHACHA")
    return F.concat_ws("; ", reasons((aead & F.col("integrity").isNotNull(), "an AEAD cipher takes no integrity"), (~aead & F.col("integrity").isNull(), "the cipher needs integrity"), (F.col("pfs") & F.col("child_group").isNull(), "PFS needs a group"), (~F.col("pfs") & F.col("child_group").isNotNull(), "a group without PFS")))


def hash_verify(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """manifest (key, sha256) against files (key, content): matched, mismatched, missing or unhashed."""
    own = files.select(key, F.sha2("content", 256).alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "unhashed").when(F.col("sha256") == F.col("actual"), "matched").otherwise("mismatched")
    return manifest.join(own, key, "left").select(key, state.alias("state"))


def held_out_rows(rows: DataFrame, held: DataFrame, key: str, mark: str = "partition") -> DataFrame:
    """rows with partition: held_out where held has their key, else train. held is read without repeats; null keys train."""
    keys = held.select(F.col(key).alias("_held")).distinct()
    return rows.join(keys, F.col(key) == F.col("_held"), "left").withColumn(mark, F.when(F.col("_held").isNotNull(), "held_out").otherwise("train")).drop("_held")


def known_class_rows(rows: DataFrame, label: str, held: list) -> DataFrame:
    """rows whose class is none of held, a short list; rows without a class stay."""
    return rows.where(F.col(label).isNull() | ~F.col(label).isin(held))


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that both sides have: what splits must not share."""
    return a.select(column).intersect(b.select(column))


def all_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of either one-column table, each once, under the name of the first."""
    return a.union(b).distinct()


def missing_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of the one-column table a that b lacks, each once."""
    return a.subtract(b)


def confounded(configs: DataFrame, a: str, *others: str) -> DataFrame:
    """For each value of a, how many values of each other factor it meets, and whether the first of them is only one."""
    counts = [F.count_distinct(c).alias(f"n_{c}") for c in others]
    return configs.groupBy(a).agg(*counts).withColumn("confounded", F.col(f"n_{others[0]}") < 2)
