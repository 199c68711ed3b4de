"""Scores, classes and decision labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from isolark.functions.taxonomy import NULL_WORDS, col

# Thresholds of the published decision rules (percent).
NOVEL_BELOW = 97.0
REDUNDANT = (99.8, 95.0)
EXTENSION = (98.65, 95.0)
GENOME_TARGET = 9
PANEL_SIZE = 9

# Placement flags that block selection outright.
BLOCKING_FLAGS = (
    "NO_REFERENCE_HIT",
    "NO_CLASSIFICATION",
    "CHIMERA",
    "CHIMERA_CONFIRMED",
    "CHIMERA_DETECTED",
    "CHIMERA_INDETERMINATE",
    "CHIMERA_CHECK_SKIPPED",
    "CHIMERA_NOT_RUN",
    "VERY_SHORT",
    "HIGH_N_CONTENT",
    "MARKER_QC_FAILED",
    "MARKER_QC_REVIEW_REQUIRED",
    "MARKER_QC_UNVERIFIED",
)
SOFT_FLAGS = ("LOW_CLASSIFICATION", "LOW_CONFIDENCE", "DISAGREEMENT", "CONFLICT")


def novelty_score(identity, ge99, ge97, ge95) -> Column:
    """0-100: distance to the nearest hit plus thinness of the neighbourhood."""
    identity, ge99, ge97, ge95 = map(col, (identity, ge99, ge97, ge95))
    distance = F.least(F.lit(60.0), F.greatest(F.lit(0.0), (100.0 - identity) * 3.0))
    density = (
        F.when(ge99 <= 1, 20.0).when(ge99 <= 5, 10.0).otherwise(0.0)
        + F.when(ge97 <= 3, 15.0).when(ge97 <= 10, 7.5).otherwise(0.0)
        + F.when(ge95 <= 10, 5.0).otherwise(0.0)
    )
    return F.round(F.least(F.lit(100.0), distance + density), 2)


def sequencing_priority(identity, ge99, ge97) -> Column:
    identity, ge99, ge97 = map(col, (identity, ge99, ge97))
    high = (identity < 97.0) & (ge99 <= 1) & (ge97 <= 3)
    medium = (identity < 98.5) & (ge99 <= 2) & (ge97 <= 10)
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def crowding(ge99, ge97) -> Column:
    ge99, ge97 = col(ge99), col(ge97)
    return (
        F.when((ge99 <= 1) & (ge97 <= 1), "isolated").when(ge97 <= 3, "sparse").when(ge97 <= 10, "moderate").otherwise("crowded")
    )


def _reaches(identity: Column, coverage: Column, limits: tuple[float, float]) -> Column:
    return F.coalesce((identity >= limits[0]) & (coverage >= limits[1]), F.lit(False))


def evidence_class(prio_id, prio_cov, prio_pool, sec_id, sec_cov, sec_pool, any_pool) -> Column:
    """Eight-label cultured-baseline class; ``*_pool`` say whether a pool was searched."""
    prio_id, prio_cov, prio_pool, sec_id, sec_cov, sec_pool, any_pool = map(
        col, (prio_id, prio_cov, prio_pool, sec_id, sec_cov, sec_pool, any_pool)
    )
    redundant = (prio_pool & _reaches(prio_id, prio_cov, REDUNDANT)) | (sec_pool & _reaches(sec_id, sec_cov, REDUNDANT))
    prio_covered = prio_pool & _reaches(prio_id, prio_cov, EXTENSION)
    sec_covered = sec_pool & _reaches(sec_id, sec_cov, EXTENSION)
    return (
        F.when(~(prio_pool | sec_pool | any_pool), "NO CULTURED BASELINE AVAILABLE")
        .when(redundant, "CULTURED BASELINE REDUNDANT")
        .when(prio_covered, "PRIORITY COVERED")
        .when(sec_covered & prio_pool, "PRIORITY GAP / SECONDARY COVERED")
        .when(sec_covered, "SECONDARY COVERED / PRIORITY NOT ASSESSED")
        .when(prio_pool & sec_pool, "NOVEL TO BOTH BASELINES")
        .when(prio_pool, "NOVEL TO PRIORITY / SECONDARY NOT ASSESSED")
        .when(sec_pool, "NOVEL TO SECONDARY / PRIORITY NOT ASSESSED")
        .otherwise("NO CULTURED BASELINE AVAILABLE")
    )


def evidence_rank(label, identity=None, coverage=None) -> Column:
    """0 (redundant) .. 4 (novel to every baseline).

    Without a label the nearest baseline hit decides when it is given, else 1.
    """
    label = F.upper(F.trim(col(label)))
    ranked = (
        F.when(label == "NOVEL TO BOTH BASELINES", 4)
        .when(
            label.isin(
                "NOVEL TO PRIORITY / SECONDARY NOT ASSESSED",
                "NOVEL TO SECONDARY / PRIORITY NOT ASSESSED",
                "PRIORITY GAP / SECONDARY COVERED",
            ),
            3,
        )
        .when(label.isin("PRIORITY COVERED", "SECONDARY COVERED / PRIORITY NOT ASSESSED"), 2)
        .when(label == "NO CULTURED BASELINE AVAILABLE", 1)
        .when(label == "CULTURED BASELINE REDUNDANT", 0)
    )
    if identity is not None:
        ranked = ranked.when(_reaches(col(identity), col(coverage), REDUNDANT), 0).when(col(identity) < EXTENSION[0], 4)
    return ranked.otherwise(1)


def flag_list(flags) -> Column:
    """``;``-separated flags as an upper-cased array without blanks."""
    parts = F.transform(F.split(F.upper(F.coalesce(col(flags), F.lit(""))), ";"), lambda f: F.trim(f))
    return F.filter(parts, lambda f: f != "")


def evidence_quality(flags, identity, confidence, coverage, taxonomy) -> Column:
    """HIGH / MODERATE / LOW trust in the marker evidence of one record."""
    identity, confidence, coverage = col(identity), col(confidence), col(coverage)
    present = flag_list(flags)
    unnamed = F.lower(F.trim(F.coalesce(col(taxonomy), F.lit("")))).isin(*NULL_WORDS)
    blocked = F.arrays_overlap(present, F.array(*map(F.lit, BLOCKING_FLAGS)))
    soft = F.arrays_overlap(present, F.array(*map(F.lit, SOFT_FLAGS)))
    low = blocked | (identity < 90.0) | (coverage < 80.0) | (identity.isNull() & unnamed)
    moderate = soft | (identity < 95.0) | (confidence < 0.8) | (coverage < 90.0)
    # NULL comparisons must not hide a later TRUE, hence the coalesces.
    return F.when(F.coalesce(low, F.lit(False)), "LOW").when(F.coalesce(moderate, F.lit(False)), "MODERATE").otherwise("HIGH")


def placement_flags(best, identity, confidence, coverage, nearest, has_metrics, taxonomy) -> Column:
    """Ordered placement warnings of one classified record."""
    best, identity, confidence, coverage, nearest, taxonomy = map(col, (best, identity, confidence, coverage, nearest, taxonomy))
    assigned = ~F.upper(F.coalesce(taxonomy, F.lit("NA"))).isin("", "NA")
    none = best.isNull() | best.isin("", "NA") | identity.isNull() | (identity == 0)
    far = nearest < 97.0
    return F.array_compact(
        F.array(
            F.when(none, "NO_REFERENCE_HIT"),
            F.when(identity < 95.0, "LOW_CLASSIFICATION_IDENTITY"),
            F.when(confidence < 0.8, "LOW_CONFIDENCE"),
            F.when(coverage < 90.0, "LOW_QUERY_COVERAGE"),
            F.when(far, "LOW_NEAREST_IDENTITY"),
            F.when(far & assigned, "NOVEL_BUT_ASSIGNED"),
            F.when(col(has_metrics) & (nearest.isNull() | (nearest == 0)) & assigned, "ASSIGNED_WITHOUT_PLACEMENT_SUPPORT"),
        )
    )


def _evidence_parts(spread, row: dict[str, Column]) -> list[Column]:
    """Sentences that both reason texts share; each is null where there is nothing to say."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    share = lambda c, words: F.when(c > 0, F.format_string(f"{words} %.2f%%", c))
    strength, told, rank = F.upper(text(row["rarity_strength"])), text(row["rarity_reason"]), text(row["target_rank"])
    rarity = F.concat(F.lit("diversity metadata "), F.lower(strength), F.lit(" confidence"), F.when(told != "", F.concat(F.lit(" ("), told, F.lit(")"))).otherwise(""))
    return [
        F.when(spread.isNotNull(), F.format_string("marginal patristic distance %.5f", spread)),
        share(row["nearest_identity"], "nearest cultured baseline"), share(row["project_nearest_identity"], "nearest project marker"),
        F.when(strength.isin("HIGH", "MODERATE"), rarity), F.when(~rank.isin("", "NA", "None"), F.concat(F.lit("target "), rank, F.lit("-level context"))),
    ]


def ranking_reason(opening, spread, nearest_identity, project_nearest_identity, rarity_strength, rarity_reason, target_rank) -> Column:
    """Why a row has its place in a sequencing set: ``opening``, then what spoke for it."""
    names = ("nearest_identity", "project_nearest_identity", "rarity_strength", "rarity_reason", "target_rank")
    row = dict(zip(names, map(col, (nearest_identity, project_nearest_identity, rarity_strength, rarity_reason, target_rank)), strict=True))
    return F.concat_ws("; ", col(opening), *_evidence_parts(col(spread), row))


def round_reason(tier, available, target, nearest_genome_identity, spread, nearest_identity, rarity_strength, rarity_reason, target_rank) -> Column:
    """Why a row is in a budgeted round, by the tier it was taken from."""
    tier, available, genome = map(col, (tier, available, nearest_genome_identity))
    opening = (
        F.when(tier == "COVERAGE_GAP", F.concat(F.lit("fills remaining "), col(target).cast("string"), F.lit("-genome coverage gap")))
        .when(tier == "NOVEL_GENOME_NEIGHBOURHOOD", "no close genome representation at the 98.65% marker threshold")
        .when(tier == "DIVERSITY_EXPANSION", F.concat(F.lit("post-target diversity expansion from "), available.cast("string"), F.lit(" available genomes")))
        .otherwise("post-target extension despite close existing genome representation")
    )
    names = ("nearest_identity", "rarity_strength", "rarity_reason", "target_rank")
    row = dict(zip(names, map(col, (nearest_identity, rarity_strength, rarity_reason, target_rank)), strict=True)) | {"project_nearest_identity": F.lit(None).cast("double")}
    held = F.when(genome > 0, F.format_string("nearest available genome %.2f%% marker identity", genome))
    return F.concat_ws("; ", opening, held, *_evidence_parts(col(spread), row))
