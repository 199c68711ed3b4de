"""Selection decisions with their evidence labels and reasons, and their report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Order of decisions and of set roles in reports.
DECISION_ORDER = (
    "PRIORITISE - SET PRIMARY", "RESERVE - SET BACKUP", "STRONG CANDIDATE", "SECONDARY - STRAIN DIVERSITY", "SECONDARY CANDIDATE", "REVIEW - PANGENOME BOUNDARY",
    "REVIEW BEFORE SELECTION", "LOWER PRIORITY - TARGET MET", "LOWER PRIORITY - LIMITED ADDED VALUE", "EXCLUDE - BASELINE REDUNDANT",
    "ALREADY SELECTED - GENOME PENDING", "ALREADY SEQUENCED",
)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _pct(c: str) -> Column:
    return F.format_string("%.2f%%", F.col(c))


def decision_table(rows: DataFrame) -> DataFrame:
    """Decision, evidence labels and reason per assessed row.

    Needs evidence ``quality``, set ``role``, flags ``available`` / ``selected``,
    ``gap``, ``committed``, target rank and name, rarity, the three nearest
    identities with ``*_pool`` booleans, and ``project_matches_ge_97``.
    """
    base, project, reference = F.col("nearest_identity"), F.col("project_nearest_identity"), F.col("reference_nearest_identity")
    near = F.col("project_matches_ge_97")
    cultured = (
        F.when(~F.col("baseline_pool") | base.isNull(), "UNKNOWN - no cultured baseline")
        .when(base < 97.0, "LARGE - no match >=97%")
        .when(base < 98.65, "MODERATE - nearest 97-98.65%")
        .otherwise("SMALL - close match >=98.65%")
    )
    coverage = (
        F.when(~F.col("project_pool"), "UNKNOWN - no project collection")
        .when(near == 0, "UNCOVERED - 0 neighbours >=97%")
        .when(near <= 3, _text("SPARSE - ", near.cast("string"), " neighbour(s) >=97%"))
        .when(near <= 10, _text("MODERATE - ", near.cast("string"), " neighbours >=97%"))
        .otherwise(_text("DENSE - ", near.cast("string"), " neighbours >=97%"))
    )
    context = (
        F.when(~F.col("reference_pool") | reference.isNull(), "UNKNOWN - no external reference comparison")
        .when(reference < 94.5, "HIGH DIVERGENCE - <94.5%")
        .when(reference < 98.65, "MODERATE DIVERGENCE - 94.5-98.65%")
        .otherwise("CLOSE REFERENCE - >=98.65%")
    )
    gap, committed = F.col("gap"), F.col("committed")
    genomes = (
        F.when(F.col("available"), "CURRENT ISOLATE ALREADY SEQUENCED")
        .when(F.col("selected"), "CURRENT ISOLATE SELECTED - GENOME PENDING")
        .when(gap <= 0, _text("TARGET MET - ", committed.cast("string"), "/9 assessment-species genomes"))
        .otherwise(_text("PANGENOME GAP - ", committed.cast("string"), "/9 assessment-species genomes committed; ", gap.cast("string"), " required"))
    )
    labelled = rows.withColumns({"cultured_gap": cultured, "project_coverage": coverage, "reference_context": context, "genome_coverage": genomes})
    strong = F.coalesce(F.col("target_rank").isin("species", "genus", "family"), F.lit(False))
    ordered = F.coalesce(F.col("target_rank") == "order", F.lit(False))
    rare = F.upper("rarity_strength").isin("HIGH", "MODERATE")
    pending = ~F.col("available") & F.col("selected")
    positive = F.array_compact(
        F.array(
            F.when(strong, _text("target match (", F.col("target_taxon"), ")")).when(ordered, _text("order-level target context (", F.col("target_taxon"), ")")),
            F.when(rare, "diversity metadata supports an underrepresented isolate"),
            F.when(F.col("baseline_pool") & (base < 97.0), _text("no close cultured isolate (", _pct("nearest_identity"), ")")),
            F.when(F.col("project_pool") & (project < 97.0), _text("no close project isolate (", _pct("project_nearest_identity"), ")")),
            F.when(F.col("reference_pool") & (reference < 98.65), _text("divergent from external reference (", _pct("reference_nearest_identity"), ")")),
            F.when(gap > 0, _text(gap.cast("string"), " genome(s) still required for pangenome target")),
        )
    )
    caution = F.array_compact(
        F.array(
            F.when(F.col("available"), "current isolate already has a genome available").when(pending, "current isolate is already selected; genome pending"),
            F.when(F.col("quality") != "HIGH", _text(F.lower("quality"), " marker evidence")),
            F.when(F.col("role") == "BASELINE_REDUNDANT", "near-identical to a cultured baseline marker at high query coverage"),
            F.when(F.col("role") == "PANGENOME_BOUNDARY_REVIEW", _text("not admitted to the baseline-pangenome extension (", F.col("extension_status"), ")")),
            F.when(gap == 0, "assessment-species pangenome target already met"),
            F.when(F.startswith("project_coverage", F.lit("DENSE")), "dense prior project neighbourhood"),
            F.when(F.startswith("cultured_gap", F.lit("SMALL")), "close cultured-baseline match"),
            F.when(F.startswith("cultured_gap", F.lit("UNKNOWN")) & F.startswith("project_coverage", F.lit("UNKNOWN")), "baseline and prior-project comparisons unavailable"),
        )
    )
    labelled = labelled.withColumns({"_pos": positive, "_neg": caution})
    role = F.col("role")
    decision = (
        F.when(F.col("available"), "ALREADY SEQUENCED")
        .when(F.col("selected"), "ALREADY SELECTED - GENOME PENDING")
        .when(F.col("quality") == "LOW", "REVIEW BEFORE SELECTION")
        .when(role == "BASELINE_REDUNDANT", "EXCLUDE - BASELINE REDUNDANT")
        .when(role == "PANGENOME_BOUNDARY_REVIEW", "REVIEW - PANGENOME BOUNDARY")
        .when(role == "PRIMARY", "PRIORITISE - SET PRIMARY")
        .when(role == "BACKUP", "RESERVE - SET BACKUP")
        .when(role == "DIVERSITY_CANDIDATE", "SECONDARY - STRAIN DIVERSITY")
        .when(gap == 0, "LOWER PRIORITY - TARGET MET")
        .when(role == "ALTERNATE", "SECONDARY CANDIDATE")
        .when(strong | (F.size("_pos") >= 2), "STRONG CANDIDATE")
        .when(F.size("_pos") > 0, "SECONDARY CANDIDATE")
        .when(F.startswith("cultured_gap", F.lit("SMALL")) & F.rlike("project_coverage", F.lit("^(MODERATE|DENSE)")), "LOWER PRIORITY - LIMITED ADDED VALUE")
        .when(F.startswith("cultured_gap", F.lit("UNKNOWN")) & F.startswith("project_coverage", F.lit("UNKNOWN")), "REVIEW BEFORE SELECTION")
        .otherwise("SECONDARY CANDIDATE")
    )
    reasons = F.concat(F.slice("_pos", 1, 3), F.slice("_neg", 1, 2))
    text = F.when(F.size(reasons) == 0, "no strong novelty or redundancy signal").otherwise(F.array_join(reasons, "; "))
    return labelled.withColumns({"decision": decision, "decision_reason": text}).drop("_pos", "_neg")


def report_order(decided: DataFrame) -> DataFrame:
    """Rows in report order: decision, then larger gap, higher novelty, id."""
    position = F.create_map(*[F.lit(x) for i, d in enumerate(DECISION_ORDER) for x in (d, i)])
    return decided.orderBy(F.try_element_at(position, F.col("decision")), F.desc("gap"), F.desc("novelty_score"), "id")
