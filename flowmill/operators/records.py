"""Reconciliation of records from several sources, policies, extracted fields and the history table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_amounts(a: str, b: str) -> F.Column:
    """matched (also where both are missing), unconfirmed where one is, else conflicting."""
    return F.when(F.col(a).eqNullSafe(F.col(b)), "matched").when(F.col(a).isNull() | F.col(b).isNull(), "unconfirmed").otherwise("conflicting")


def reconcile(rows: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """A comparison for each row and pair of sources."""
    f = F.explode(F.array(*(F.struct(F.lit(f"{a} vs {b}").alias("pair"), compare_amounts(a, b).alias("result")) for a, b in pairs)))
    return rows.select(key, f.alias("f")).select(key, "f.*")


def _findings(first: F.Column, second: F.Column, available: F.Column, conflict: F.Column, form: F.Column) -> F.Column:
    """The findings of one row, in fixed order: from both comparisons, whether there is external evidence, whether the code
    names something else and whether it has a code's form."""
    found = (
        F.when(first == "conflicting", F.struct(F.lit("amount_mismatch_declared_vs_extracted"), F.lit("high"))).when(first == "unconfirmed", F.struct(F.lit("amount_unconfirmed"), F.lit("medium"))),
        F.when(second == "conflicting", F.struct(F.lit("amount_mismatch_extracted_vs_external"), F.lit("high"))).when(~available, F.struct(F.lit("external_evidence_unavailable"), F.lit("medium"))),
        F.when(conflict, F.struct(F.lit("ifsc_mismatch"), F.lit("medium"))),
        F.when(~form, F.struct(F.lit("ifsc_invalid_format"), F.lit("high"))),
    )
    return F.array_compact(F.array(*(f.cast("struct<finding_type:string,severity:string>") for f in found)))


def reconcile_findings(rows: DataFrame, key: str) -> DataFrame:
    """rows: declared, extracted, external (amounts), external_available, code_format_ok, code_conflicts (booleans). A row
    for each finding: key, finding_type, severity. An amount that two sources disagree on weighs high; one that the
    document lacks or the declaration, a missing external source and a code that names something else weigh medium."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = _findings(compare_amounts("declared", "extracted"), compare_amounts("extracted", "external"), on("external_available"), on("code_conflicts"), on("code_format_ok"))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")


def reconcile_status(rows: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Each row's state from its findings: conflicting if one weighs high, requires_human_review if there is another, matched
    if there is none; and how many there are."""
    g = findings.groupBy(F.col(key).alias("_key")).agg(F.bool_or(F.col("severity") == "high").alias("_high"), F.count("*").alias("_n"))
    out = rows.join(g, F.col(key) == F.col("_key"), "left")
    state = F.when(F.col("_high"), "conflicting").when(F.col("_n") > 0, "requires_human_review").otherwise("matched")
    return out.select(key, state.alias("status"), F.coalesce("_n", F.lit(0)).alias("findings"))


#: An amount as text, as it is read: digits with a point or an exponent, without signs of a currency or of thousands.
AMOUNT = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def amount_of(text) -> F.Column:
    """An amount from text, null where it is none or does not fit 38 digits with 6 after the point."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(AMOUNT), F.trim(text).try_cast("decimal(38,6)"))


def reconcile_documents(declared: DataFrame, documents: DataFrame, external: DataFrame, codes: DataFrame, fields: dict[str, tuple[str, bool]], pattern: str) -> DataFrame:
    """The reconciliation of all instruments from the pages of their documents, in one plan.

    declared: instrument, amount, bank, branch, code (texts). documents: document, instrument, version (without ties
    within an instrument), text. external: instrument, amount, one row each; an instrument without a row has no external
    evidence. codes: code, bank, branch, one row each. fields: as extract_fields takes them; "amount" is compared. pattern:
    the form of a code.

    Of an instrument's documents the last version counts alone, and of several lines of a field in it the last one. A row
    for each instrument: instrument, document, extracted (amount, as text), declared_vs_extracted, extracted_vs_external,
    findings (finding_type and severity, in fixed order), status. Amounts that are no numbers count as missing. A code
    conflicts where its bank or branch is known, declared and another (case and outer blanks aside). Which document is
    the last is found from ids alone, and no other document's text is moved or read for fields."""
    last = documents.groupBy("instrument").agg(F.max_by("document", "version").alias("document"))
    pages = documents.select("document", "text").join(last.select(F.col("document").alias("_d")), F.col("document") == F.col("_d"), "left_semi")
    named = extract_fields(pages, "document", "text", fields).where(F.col("field") == "amount")
    read = named.groupBy("document").agg(F.max_by("normalized", "line").alias("extracted"))
    own = last.select(F.col("instrument").alias("_i"), F.col("document")).join(read.withColumnRenamed("document", "_d"), F.col("document") == F.col("_d"), "left").drop("_d")
    outside = external.select(F.col("instrument").alias("_e"), F.col("amount").cast("string").alias("_external"))
    known = codes.select(F.col("code").alias("_c"), F.col("bank").alias("_bank"), F.col("branch").alias("_branch"))
    x = declared.join(own, F.col("instrument") == F.col("_i"), "left").join(outside, F.col("instrument") == F.col("_e"), "left").join(known, F.col("code") == F.col("_c"), "left")
    other = lambda a, b: F.coalesce((F.trim(a) != "") & (F.lower(b) != F.lower(F.trim(a))), F.lit(False))
    x = x.select("instrument", "document", "extracted", amount_of(F.col("amount").cast("string")).alias("_declared"), amount_of("extracted").alias("_extracted"), amount_of("_external").alias("_outside"),
        F.col("_e").isNotNull().alias("_available"), F.coalesce(F.col("code").rlike(pattern), F.lit(False)).alias("_form"), (other("bank", "_bank") | other("branch", "_branch")).alias("_conflict"))
    x = x.withColumns({"declared_vs_extracted": compare_amounts("_declared", "_extracted"), "extracted_vs_external": compare_amounts("_extracted", "_outside")})
    f = _findings(F.col("declared_vs_extracted"), F.col("extracted_vs_external"), F.col("_available"), F.col("_conflict"), F.col("_form"))
    state = F.when(F.exists("findings", lambda y: y["severity"] == "high"), "conflicting").when(F.size("findings") > 0, "requires_human_review").otherwise("matched")
    return x.withColumn("findings", f).select("instrument", "document", "extracted", "declared_vs_extracted", "extracted_vs_external", "findings", state.alias("status"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: its columns travel as the payload of one maximum, so a key is never sorted."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *rest), F.col(order)).alias("r")).select(key, "r.*")


def code_lookup(rows: DataFrame, reference: DataFrame, code: str, pattern: str, name: str, expected: str) -> DataFrame:
    """rows with format_ok, known and name_matches (names compared without case and outer spaces)."""
    out = rows.join(reference, code, "left")
    same = F.lower(F.trim(F.col(name))) == F.lower(F.trim(F.col(expected)))
    return out.withColumns({"format_ok": F.col(code).cast("string").rlike(pattern), "known": F.col(name).isNotNull(), "name_matches": F.coalesce(same, F.lit(False))})


def evaluate_policies(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows: amount, required (what the obligation asks for), category, segment, priority. rules: rule_id, version, condition
    (JSON with segment and priority, either may be missing), required (null: the row's), adjustments (JSON with
    private_leased_property and private_leased_property_percent).

    Each row against the current version of each rule that applies to it. For private rows the percentage is taken off
    what is required. A rule without an amount fails, and so does a row without one. rules are a short table; Spark
    chooses how to join them."""
    part = F.struct("version", "condition", F.col("required").alias("rule_required"), "adjustments")
    current = rules.groupBy("rule_id").agg(F.max_by(part, "version").alias("r")).select("rule_id", "r.*")
    get = lambda c, k: F.get_json_object(c, f"$.{k}")
    current = current.select("rule_id", "version", "rule_required", get("condition", "segment").alias("c_segment"), get("condition", "priority").alias("c_priority"), F.when(get("adjustments", "private_leased_property") == "true", F.coalesce(get("adjustments", "private_leased_property_percent").cast("double"), F.lit(0.0))).alias("percent"))
    on = (F.col("c_segment").isNull() | (F.col("c_segment") == F.col("segment"))) & (F.col("c_priority").isNull() | (F.col("c_priority") == F.col("priority")))
    need = F.coalesce("rule_required", "required").cast("double")
    need = F.when((F.col("category") == "Private") & F.col("percent").isNotNull(), need * (1 - F.col("percent") / 100)).otherwise(need)
    why = F.when(need.isNull(), "rule has no amount").when(F.col("amount").isNull(), "amount not declared").when(F.col("amount") >= need, "meets").otherwise("below")
    out = rows.join(current, on).withColumns({"reason": why, "required": need})
    return out.withColumn("result", F.when(F.col("reason") == "meets", "PASS").otherwise("FAIL"))


def extract_fields(docs: DataFrame, key: str, text: str, fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """fields: name to a mark and whether its values are put in capitals. For each line that has a colon and the mark, in
    whatever case: key, line, field, value (what follows the first colon, without outer blanks; it may be empty) and
    normalized. A line may give several fields."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "_t")).where(F.contains("_t", F.lit(":")))
    value = F.trim(F.expr("substring(_t, instr(_t, ':') + 1)"))
    each = (F.when(F.contains(F.lower("_t"), F.lit(mark.lower())), F.struct(F.lit(n).alias("field"), value.alias("value"), (F.upper(value) if capitals else value).alias("normalized"))) for n, (mark, capitals) in fields.items())
    return lines.select(key, "line", F.explode(F.array_compact(F.array(*each))).alias("_f")).select(key, "line", "_f.*")


def fields_pivot(fields: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A column for each field; of several lines the last one's value."""
    return fields.groupBy(key).agg(*(F.max_by(F.when(F.col("field") == n, F.col("value")), F.when(F.col("field") == n, F.col("line"))).alias(n) for n in names))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new in place of those with the same key. Of new rows that share a key the one with the highest
    order counts; rows of new without a key are left out."""
    newest = latest(new.where(F.col(key).isNotNull()), key, order).select(*old.columns)
    return old.join(newest.select(key), key, "left_anti").select(*old.columns).unionByName(newest)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def history_list(rows: DataFrame, filters: dict[str, object], order: str, key: str, limit: int) -> DataFrame:
    """Newest first, ties by key; equality filters; the limit is held to 1..500."""
    for c, v in filters.items():
        rows = rows.where(F.col(c) == F.lit(v)) if v is not None else rows
    return rows.orderBy(F.desc(order), key).limit(max(1, min(500, limit)))


def history_point(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of one key: value is a literal, or a one-row column of another table's aggregate."""
    if isinstance(value, DataFrame):
        return rows.join(value, key)
    return rows.where(F.col(key) == F.lit(value))


def history_count(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A page of rows in the order of a column without repeats; offset and limit are 0 at least."""
    return rows.orderBy(order).offset(max(0, offset)).limit(max(0, limit))
