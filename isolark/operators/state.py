"""Project-state operators: upserts, status events, imports, validation, removals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isolark.functions import identifiers as I, taxonomy as T
from isolark.operators.collection import first_wins, last_wins
from isolark.operators.ordered import previous_value

# Keys of the state tables and whether the first or the last row of a key stays.
STATE_KEYS = {
    "sequences": (["id"], "first"),
    "taxonomy": (["id", "dataset"], "last"),
    "taxonomy_alt": (["id", "ref_db"], "last"),
    "distances": (["id", "dataset"], "last"),
    "classification_evidence": (["sequence_id", "ref_db"], "last"),
    "colours": (["id"], "last"),
    "seq_aliases": (["canonical_id"], "last"),
    "sequencing_metadata": (["id"], "last"),
    "dataset_roles": (["dataset"], "last"),
    "assessment_snapshots": (["snapshot_id", "sequence_id"], "last"),
    "selection_rounds": (["round_id"], "last"),
    "selection_round_members": (["round_id", "sequence_id"], "last"),
    "project_runs": (["run_id"], "last"),
    "sequence_provenance": (["sequence_id"], "last"),
    "isolate_status": (["sequence_id"], "last"),
    "genome_records": (["genome_id"], "last"),
}
# States a new proposal must not overwrite.
PROTECTED_STATES = (
    "SAB_APPROVED", "DNA_EXTRACTION_PENDING", "DNA_EXTRACTION_FAILED", "LIBRARY_PENDING", "SEQUENCED", "GENOME_QC_FAILED", "GENOME_QC_PASSED", "WITHDRAWN",
)
APPROVING_WORDS = ("approved", "approve", "accepted", "accept", "pass", "yes")
REJECTING_WORDS = ("rejected", "reject", "failed", "fail", "no")


def upsert(current: DataFrame, incoming: DataFrame, table: str, keep_columns: list[str] | None = None) -> DataFrame:
    """Next version of a state table; ``keep_columns`` survive a last-wins replacement."""
    keys, rule = STATE_KEYS[table]
    both = current.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    merged = first_wins(both, keys, ["_v"]) if rule == "first" else last_wins(both, keys, ["_v"])
    merged = merged.drop("_v")
    if keep_columns:
        old = current.select(*keys, *[F.col(c).alias("_old_" + c) for c in keep_columns])
        merged = merged.join(old, keys, "left")
        merged = merged.withColumns({c: F.coalesce("_old_" + c, c) for c in keep_columns}).drop(*["_old_" + c for c in keep_columns])
    return merged.select(*current.columns)


def id_conflicts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids whose sequence differs from the stored one once case and whitespace are ignored."""
    norm = lambda c: F.md5(I.ascii_upper(F.regexp_replace(c, r"\s+", "")))
    old = current.select("id", norm("sequence").alias("stored"))
    new = incoming.select("id", norm("sequence").alias("submitted"))
    return new.join(old, "id").filter("stored <> submitted")


def status_import(updates: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transitions of known isolates, and the rejected rows with their reason."""
    parsed = updates.withColumn("status", I.state_name("word"))
    marked = parsed.join(known.select("id").withColumn("_known", F.lit(True)), "id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown id").when(F.col("status").isNull(), "unknown status")
    marked = marked.withColumn("reason", reason)
    accepted = marked.filter("reason is null").select("id", "line", "ts", "status", "detail")
    events = previous_value(accepted, "id", ["ts", "line"], "status", "old_status")
    changed = ~F.col("old_status").eqNullSafe(F.col("status"))
    return events.filter(changed | (F.col("detail") != "")), marked.filter("reason is not null").select("line", "id", "word", "reason")


def current_status(updates: DataFrame) -> DataFrame:
    valid = updates.select("id", "ts", "line", I.state_name("word").alias("status")).filter("status is not null")
    return valid.groupBy("id").agg(F.max_by("status", F.struct("ts", "line")).alias("status"))


def proposal_transition(proposals: DataFrame, status: DataFrame) -> DataFrame:
    """Proposed isolates whose present state is not protected."""
    held = status.filter(F.col("status").isin(*PROTECTED_STATES)).select("id")
    return proposals.join(held, "id", "left_anti").withColumn("status", F.lit("PROPOSED"))


def latest_assessment(snapshots: DataFrame, roles: DataFrame, owners: DataFrame, schema: str) -> DataFrame:
    """Latest readable snapshot row per sequence.

    Rows written for a candidate dataset count only for sequences of that
    dataset; imports and other datasets always count.
    """
    candidate = roles.filter("role = 'candidate'").select("dataset", F.lit(True).alias("_candidate"))
    owned = owners.select(F.col("id").alias("sequence_id"), F.col("dataset").alias("_owner"))
    rows = snapshots.join(candidate, "dataset", "left").join(owned, "sequence_id", "left")
    rows = rows.filter(F.col("_candidate").isNull() | F.col("_owner").eqNullSafe(F.col("dataset")))
    rows = rows.withColumn("a", F.from_json("payload", schema, {"mode": "PERMISSIVE"})).filter(F.to_json("a") != "{}")
    best = rows.groupBy("sequence_id").agg(F.max_by(F.struct("snapshot_id", "dataset", "a"), F.struct("created_at", "entry")).alias("b"))
    return best.select("sequence_id", "b.snapshot_id", "b.dataset", "b.a.*")


def decision_changes(snapshots: DataFrame, schema: str) -> DataFrame:
    """Differences between the two newest snapshots, one row per sequence in either."""
    stamps = snapshots.groupBy("snapshot_id").agg(F.max(F.struct("created_at", "entry")).alias("t"))
    newest = stamps.orderBy(F.desc("t")).limit(2).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "snapshot_id")), asc=False), lambda s: s["snapshot_id"])).scalar()
    parsed = last_wins(snapshots.select("snapshot_id", "sequence_id", "created_at", "entry", "payload"), ["snapshot_id", "sequence_id"], ["created_at", "entry"])
    parsed = parsed.withColumn("a", F.from_json("payload", schema)).withColumn("pair", newest)

    def side(index: int, tag: str) -> DataFrame:
        chosen = parsed.filter(F.col("snapshot_id") == F.try_element_at("pair", F.lit(index)))
        return chosen.select("sequence_id", F.lit(True).alias("_in_" + tag), *[F.col("a." + c).alias(f"{tag}_{c}") for c in ("decision", "gap", "role")])

    both = side(2, "previous").join(side(1, "current"), "sequence_id", "full_outer")
    shown = lambda tag, c: F.coalesce(F.col(f"{tag}_{c}").cast("string"), F.lit("NA"))
    decision = lambda tag: F.coalesce(F.col(f"{tag}_decision"), F.when(F.col("_in_" + tag), "NA").otherwise("NOT_ASSESSED"))
    change = lambda label, c: F.when(shown("previous", c) != shown("current", c), F.concat(F.lit(label + ": "), shown("previous", c), F.lit(" -> "), shown("current", c)))
    why = F.concat_ws("; ", change("set role", "role"), change("pangenome gap", "gap"))
    return both.select(
        "sequence_id", decision("previous").alias("previous_decision"), decision("current").alias("current_decision"),
        (decision("previous") != decision("current")).alias("decision_changed"),
        F.when(why == "", "recalculation did not change tracked evidence").otherwise(why).alias("change_reason"),
    )


def ledger_validation(rows: DataFrame, sequences: DataFrame, expected_partner: str | None = None) -> DataFrame:
    """Issue rows of a submitted partner ledger against the submitted sequences."""
    named = rows.filter(F.trim("sequence_id") != "")
    signature = F.concat_ws("\x1f", F.lower("partner"), F.lower("genome"), F.lower("selection"))
    named = named.withColumn("signature", signature)
    first = named.groupBy("sequence_id").agg(F.min_by(F.struct("line", "signature"), "line").alias("f"))
    joined = named.join(first, "sequence_id")
    extra = joined.filter(F.col("line") != F.col("f.line")).select(
        "line", "sequence_id", F.when(F.col("signature") == F.col("f.signature"), "DUPLICATE_METADATA_ID").otherwise("CONFLICTING_METADATA_ID").alias("code")
    )
    owner = joined.filter(F.col("line") == F.col("f.line"))
    known_word = lambda c: I.tolerant_bool(c).isNotNull()
    mismatch = F.lit(False) if expected_partner is None else (F.col("partner") != "") & (F.lower("partner") != expected_partner.lower())
    codes = F.array_compact(
        F.array(
            F.when(F.col("partner") == "", "MISSING_PARTNER_ID"),
            F.when(F.col("genome") == "", "MISSING_GENOME_STATUS").when(~known_word("genome"), "INVALID_GENOME_STATUS"),
            F.when((F.col("selection") != "") & ~known_word("selection"), "INVALID_SELECTION_STATUS"),
            F.when(mismatch, "PARTNER_ID_MISMATCH"),
        )
    )
    rules = owner.select("line", "sequence_id", F.explode(codes).alias("code"))
    missing = sequences.select(F.col("id").alias("sequence_id")).join(owner, "sequence_id", "left_anti")
    missing = missing.select(F.lit(None).cast("long").alias("line"), "sequence_id", F.lit("MISSING_PARTNER_METADATA_ROW").alias("code"))
    return extra.unionByName(rules).unionByName(missing).withColumn("severity", F.lit("ERROR"))


def genome_import(rows: DataFrame, known: DataFrame, min_completeness: float = 90.0, max_contamination: float = 5.0) -> DataFrame:
    """Accept or reject reported genomes; automatic QC only for plain SEQUENCED rows with metrics."""
    has = lambda c: F.trim(c) != ""
    rows = rows.join(known.select(F.col("id").alias("sequence_id"), F.lit(True).alias("_known")), "sequence_id", "left")
    word = F.when(has("status"), F.col("status")).otherwise("SEQUENCED")
    rows = rows.withColumns(
        {
            "state": I.state_name(word),
            "_comp": I.tolerant_double("completeness"),
            "_cont": I.tolerant_double("contamination"),
            "_explicit": I.tolerant_bool("qc_pass", outcomes=True),
        }
    )
    metrics = F.col("_comp").isNotNull() & F.col("_cont").isNotNull()
    passes = F.coalesce((F.col("_comp") >= min_completeness) & (F.col("_cont") <= max_contamination), F.lit(False))
    auto = F.col("_explicit").isNull() & (F.col("state") == "SEQUENCED") & metrics
    final = F.when(auto, F.when(passes, "GENOME_QC_PASSED").otherwise("GENOME_QC_FAILED")).otherwise(F.col("state"))
    passed = F.when(auto, passes).otherwise(F.coalesce("_explicit", F.col("state") == "GENOME_QC_PASSED"))
    rows = rows.withColumns({"genome_status": final, "genome_qc_pass": passed})
    reason = (
        F.when(~has("sequence_id"), "missing sequence_id")
        .when(F.col("_known").isNull(), "unknown sequence_id")
        .when(~has("genome_id"), "missing genome_id")
        .when(F.col("state").isNull(), "unknown status")
        .when(~F.col("state").isin("SEQUENCED", "GENOME_QC_FAILED", "GENOME_QC_PASSED"), "status not allowed")
        .when((F.col("genome_status") == "GENOME_QC_FAILED") & F.col("genome_qc_pass"), "status conflicts with qc flag")
        .when((F.col("genome_status") == "GENOME_QC_PASSED") & ~F.col("genome_qc_pass"), "status conflicts with qc flag")
        .when(F.col("genome_qc_pass") & metrics & ~passes, "qc pass conflicts with metrics")
    )
    return rows.select(
        "line", "sequence_id", "genome_id", F.when(reason.isNull(), "IMPORTED").otherwise("REJECTED").alias("result"), reason.alias("reason"),
        F.when(reason.isNull(), F.col("genome_status")).alias("genome_status"), F.when(reason.isNull(), F.col("genome_qc_pass")).alias("genome_qc_pass"),
        "ani_cluster", "genome_taxonomy",
    )


def genome_feedback(imported: DataFrame, marker_taxonomy: DataFrame) -> DataFrame:
    """Distinct (species, isolate, ANI cluster) of QC-passed genomes, one row each."""
    good = imported.filter("genome_qc_pass").join(marker_taxonomy.select(F.col("id").alias("sequence_id"), "taxonomy"), "sequence_id", "left")
    species = T.species_name(F.when(F.trim("genome_taxonomy") != "", F.col("genome_taxonomy")).otherwise(F.col("taxonomy")))
    cluster = F.nullif(F.col("ani_cluster"), F.lit(""))
    keyed = good.select(T.norm_taxon(species).alias("species_key"), "sequence_id", cluster.alias("ani_cluster"))
    return keyed.filter("species_key is not null").distinct()


def removal_plan(requests: DataFrame, sequences: DataFrame, roles: DataFrame, metadata: DataFrame, genomes: DataFrame,
                 allow_baseline: bool = False, allow_genomes: bool = False) -> DataFrame:
    """Outcome of each removal request, in request order."""
    asked = requests.withColumn("requested_id", F.trim("requested_id"))
    counted = genomes.groupBy(F.col("sequence_id").alias("requested_id")).agg(F.count(F.lit(1)).alias("genome_records"))
    found = sequences.select(F.col("id").alias("requested_id"), "dataset").join(roles.select("dataset", "role"), "dataset", "left")
    found = found.join(metadata.select(F.col("id").alias("requested_id"), "available"), "requested_id", "left")
    rows = asked.join(found.withColumn("_found", F.lit(True)), "requested_id", "left").join(counted, "requested_id", "left")
    first = asked.groupBy("requested_id").agg(F.min("line").alias("_first"))
    rows = rows.join(first, "requested_id")
    n_genomes = F.coalesce("genome_records", F.lit(0))
    status = (
        F.when(F.col("requested_id") == "", "INVALID_REQUEST")
        .when(F.col("_found").isNull(), "NOT_FOUND")
        .when(F.col("line") != F.col("_first"), "DUPLICATE_REQUEST")
        .when(F.lit(not allow_baseline) & (F.col("role") == "baseline"), "BLOCKED_BASELINE")
        .when(F.lit(not allow_genomes) & (F.coalesce("available", F.lit(False)) | (n_genomes > 0)), "BLOCKED_GENOME_RECORD")
        .otherwise("READY")
    )
    return rows.select("line", "requested_id", status.alias("status"), n_genomes.alias("genome_records"))


def apply_removals(tables: dict[str, tuple[DataFrame, str]], plan: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All-or-nothing removal: pruned tables plus tombstones with deleted-row counts."""
    refused = plan.filter(~F.col("status").isin("READY"))
    if not refused.isEmpty():
        raise ValueError("removal plan holds requests that are not READY; nothing was removed")
    ids = plan.select(F.col("requested_id").alias("id"))
    pruned, counts = {}, None
    for name, (df, key) in tables.items():
        pruned[name] = df.join(ids.withColumnRenamed("id", key), key, "left_anti").select(*df.columns)
        gone = df.join(ids.withColumnRenamed("id", key), key, "left_semi").select(F.col(key).alias("id"), F.lit(name).alias("table"))
        counts = gone if counts is None else counts.unionByName(gone)
    per_table = counts.groupBy("id", "table").agg(F.count(F.lit(1)).alias("n"))
    tomb = per_table.groupBy("id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n"))))).alias("deleted"))
    return pruned, ids.join(tomb, "id", "left")


def marker_flag(isolates: DataFrame, qc: DataFrame, reviews: DataFrame) -> DataFrame:
    """Marker-quality flag per isolate from QC class and manual review; none means unverified."""
    word = F.lower(F.trim("decision"))
    review = F.when(word.isin(*APPROVING_WORDS), "APPROVED").when(word.isin(*REJECTING_WORDS), "REJECTED").otherwise("NOT_REVIEWED")
    rows = isolates.select("id").join(qc.select(F.col("sequence_id").alias("id"), "qc_class"), "id", "left")
    rows = rows.join(reviews.select(F.col("sequence_id").alias("id"), review.alias("review")), "id", "left")
    review = F.coalesce("review", F.lit("NOT_REVIEWED"))
    flag = (
        F.when(F.col("qc_class").isNull(), "MARKER_QC_UNVERIFIED")
        .when((F.col("qc_class") == "FAIL_QC") | (review == "REJECTED"), "MARKER_QC_FAILED")
        .when(F.col("qc_class") == "PASS_HIGH_CONFIDENCE", "")
        .when(review == "APPROVED", "MARKER_QC_REVIEW_APPROVED")
        .otherwise("MARKER_QC_REVIEW_REQUIRED")
    )
    return rows.select("id", "qc_class", review.alias("review"), flag.alias("flag"))


# The flag of each chimera call; a call that isn't listed was not made.
CHIMERA_FLAGS = {"PASS": "", "CHIMERA": "CHIMERA_DETECTED", "INDETERMINATE": "CHIMERA_INDETERMINATE", "SKIPPED": "CHIMERA_CHECK_SKIPPED"}


def provenance_flags(assessed: DataFrame, marker: DataFrame, chimeras: DataFrame) -> DataFrame:
    """``assessed`` (id, placement_flags, ...) with marker and chimera provenance, whose flags are appended once each.

    ``marker`` is what :func:`marker_flag` gives, ``chimeras`` has id, call and
    score. Without marker provenance the quality is unverified, without a chimera
    call the check counts as not run.
    """
    found = marker.select("id", F.col("qc_class").alias("marker_qc_class"), F.col("review").alias("marker_manual_review_status"), F.col("flag").alias("_marker"))
    called = chimeras.select("id", F.upper(F.trim("call")).alias("_call"), F.col("score").alias("chimera_score"))
    rows = assessed.join(found, "id", "left").join(called, "id", "left")
    flags = F.create_map(*[F.lit(x) for pair in CHIMERA_FLAGS.items() for x in pair])
    call = F.coalesce("_call", F.lit("NOT_RUN"))
    marker_said, chimera_said = F.coalesce("_marker", F.lit("MARKER_QC_UNVERIFIED")), F.coalesce(F.try_element_at(flags, call), F.lit("CHIMERA_NOT_RUN"))
    held = F.filter(F.split(F.coalesce("placement_flags", F.lit("")), ";"), lambda f: f != "")
    more = F.array_except(F.filter(F.array(marker_said, chimera_said), lambda f: f != ""), held)
    return rows.select(
        *[c for c in assessed.columns if c != "placement_flags"], F.array_join(F.concat(held, more), ";").alias("placement_flags"),
        F.coalesce("marker_qc_class", F.lit("QUALITY_UNVERIFIED")).alias("marker_qc_class"), F.coalesce("marker_manual_review_status", F.lit("NOT_REVIEWED")).alias("marker_manual_review_status"),
        F.when(marker_said == "", "MARKER_QC_PASSED").otherwise(marker_said).alias("marker_qc_flag"), call.alias("chimera_call"), "chimera_score",
    )


def supplier_reconcile(rows: DataFrame, files: DataFrame, forward_primer: str = "", reverse_primer: str = "") -> DataFrame:
    """Match supplier reads to files: none, one or several; the first claim of a file wins."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    indexed = files.select("path", "embedded_primer", I.supplier_key(name("path")).alias("file_key"))
    by_key = indexed.groupBy("file_key").agg(F.count(F.lit(1)).alias("n_files"), F.min(F.struct("path", "embedded_primer")).alias("f"))
    keyed = rows.withColumn("file_key", I.supplier_key("supplier_id")).join(by_key, "file_key", "left")
    claims = keyed.filter((F.col("n_files") == 1) & (F.col("sequence_id") != "")).groupBy("file_key").agg(F.min("line").alias("_claim"))
    keyed = keyed.join(claims, "file_key", "left")
    stated = I.direction_name("direction")
    by_primer = F.when(F.endswith(F.upper("primer"), F.lit("R")), "reverse").when(F.endswith(F.upper("primer"), F.lit("F")), "forward")
    direction = F.coalesce(stated, F.when(F.col("primer") != "", by_primer))
    configured = F.when(direction == "forward", F.lit(forward_primer)).when(direction == "reverse", F.lit(reverse_primer)).otherwise(F.lit(""))
    source = (
        F.when(F.col("primer") != "", "supplied_by_metadata")
        .when(F.col("f.embedded_primer") != "", "embedded_in_abif")
        .when(configured != "", "configured_for_batch")
        .otherwise("unresolved")
    )
    primer = (
        F.when(F.col("primer") != "", F.col("primer")).when(F.col("f.embedded_primer") != "", F.col("f.embedded_primer")).when(configured != "", configured).otherwise("unknown")
    )
    problem = (
        F.when(F.col("sequence_id") == "", "MISSING_SEQUENCE_ID")
        .when(F.col("n_files").isNull(), "READ_FILE_NOT_FOUND")
        .when(F.col("n_files") > 1, "AMBIGUOUS_READ_FILE")
        .when(F.col("line") != F.col("_claim"), "READ_FILE_MULTIPLE_ASSIGNMENTS")
    )
    clash = (F.endswith(F.upper(primer), F.lit("R")) & (direction == "forward")) | (F.endswith(F.upper(primer), F.lit("F")) & (direction == "reverse"))
    issues = F.array_compact(
        F.array(
            problem,
            F.when((F.col("sequence_id") != "") & direction.isNull(), "MISSING_DIRECTION"),
            F.when(problem.isNull() & (source == "unresolved"), "UNRESOLVED_PRIMER"),
            F.when(problem.isNull() & clash, "PRIMER_DIRECTION_CONFLICT"),
        )
    )
    return keyed.select(
        "line", "sequence_id", "supplier_id", F.when(problem.isNull(), F.col("f.path")).alias("path"), direction.alias("direction"),
        F.when(problem.isNull(), primer).alias("primer"), F.when(problem.isNull(), source).alias("primer_assignment"), F.array_join(issues, ";").alias("issues"),
    )


def intake_status(reconciled: DataFrame) -> DataFrame:
    """Batch verdict: FAIL on any error, REVIEW_REQUIRED on unresolved primers, else PASS."""
    codes = F.filter(F.split("issues", ";"), lambda c: (c != "") & (c != "UNRESOLVED_PRIMER"))
    agg = reconciled.agg(
        F.coalesce(F.sum(F.size(codes)), F.lit(0)).alias("errors"),
        F.count_if(F.col("primer_assignment") == "unresolved").alias("unresolved_primers"),
        F.count("path").alias("mapped_reads"),
        F.countDistinct(F.when(F.col("sequence_id") != "", F.col("sequence_id"))).alias("isolates"),
    )
    verdict = F.when(F.col("errors") > 0, "FAIL").when(F.col("unresolved_primers") > 0, "REVIEW_REQUIRED").otherwise("PASS")
    return agg.withColumn("status", verdict)
