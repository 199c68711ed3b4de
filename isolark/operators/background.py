"""Classification summaries, database merges and genome coverage per species."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isolark.functions.scores import GENOME_TARGET
from isolark.functions.taxonomy import norm_taxon, species_name


def classification_tiers(rows: DataFrame) -> DataFrame:
    """Confidence tiers per dataset plus a TOTAL row; one row per query in, NULL identity = no hit."""
    ident = F.col("identity")
    counts = rows.rollup("dataset").agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count("identity").alias("classified"),
        F.count_if(ident.isNull()).alias("unclassified"),
        F.count_if(ident >= 97).alias("high"),
        F.count_if((ident >= 90) & (ident < 97)).alias("medium"),
        F.count_if(ident < 90).alias("low"),
        F.grouping("dataset").alias("_total"),
    )
    share = lambda c: F.round(100.0 * F.col(c) / F.col("total_input"), 1).alias("pct_" + c)
    return counts.select(
        F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("dataset")).alias("dataset"),
        "total_input", "classified", "unclassified", "high", "medium", "low",
        *[share(c) for c in ("high", "medium", "low", "classified", "unclassified")],
    )


def enrich_by_pool(best: DataFrame, target_info: DataFrame, pools: list[str]) -> DataFrame:
    """Dataset and lineage of each pool's best hit: one long join, then one pivot."""
    info = target_info.select("target", "dataset", "taxonomy")
    long = best.join(info, "target", "left").groupBy("query")
    cols = []
    for pool in pools:
        here = F.col("pool") == pool
        for field, name in (("target", "hit"), ("dataset", "dataset"), ("taxonomy", "taxonomy")):
            cols.append(F.max(F.when(here, F.col(field))).alias(f"{pool}_{name}"))
    return long.agg(*cols)


def merge_databases(queries: DataFrame, best: DataFrame, databases: list[str]) -> DataFrame:
    """One row per query with the assignment of every reference database side by side."""
    cols = []
    for db in databases:
        here = F.col("ref_db") == db
        cols.append(F.max(F.when(here, F.col("taxonomy"))).alias(f"taxon_{db}"))
        cols.append(F.max(F.when(here, F.col("identity"))).alias(f"identity_{db}"))
    return queries.select("query").join(best.groupBy("query").agg(*cols), "query", "left")


def species_coverage(taxa: DataFrame, roles: DataFrame, ledger: DataFrame, target: int = GENOME_TARGET) -> DataFrame:
    """Committed genomes per species by source, and the gap to the target.

    Baseline genomes win over partner-available ones, which win over pending
    selections, so a record counts once.
    """
    rows = (
        taxa.withColumn("species_key", norm_taxon(species_name("taxonomy")))
        .filter(F.col("species_key").isNotNull())
        .join(roles, "dataset", "left")
        .join(ledger.select("id", "selected", "available"), "id", "left")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    baseline = yes((F.col("role") == "baseline") & F.col("genomes_available"))
    partner = ~baseline & yes(F.col("available"))
    pending = ~baseline & ~yes(F.col("available")) & yes(F.col("selected"))
    counted = rows.groupBy("species_key").agg(
        F.count_if(baseline & (F.col("tier") == "priority")).alias("priority_genomes"),
        F.count_if(baseline & (F.col("tier") == "secondary")).alias("secondary_genomes"),
        F.count_if(partner).alias("partner_genomes"),
        F.count_if(pending).alias("pending_genomes"),
    )
    committed = F.col("priority_genomes") + F.col("secondary_genomes") + F.col("partner_genomes") + F.col("pending_genomes")
    return counted.withColumn("committed", committed).withColumn("pangenome_gap", F.greatest(F.lit(0), target - F.col("committed")))


def adjust_priority(rows: DataFrame, target: int = GENOME_TARGET) -> DataFrame:
    """Priority and score after the genome collection is taken into account."""
    identity = F.coalesce("genome_identity", F.lit(0.0))
    ge97, ge95 = F.coalesce("genome_ge_97", F.lit(0)), F.coalesce("genome_ge_95", F.lit(0))
    gap = F.coalesce("pangenome_gap", F.lit(target))
    known = F.col("species_key").isNotNull()
    base, score = F.col("sequencing_priority"), F.col("novelty_score")
    minus = lambda points: F.greatest(F.lit(0.0), score - points)
    nearby = (ge95 > 0) & (base == "HIGH")
    return rows.withColumns(
        {
            "adjusted_priority": F.when(F.col("available"), "SEQUENCED")
            .when(F.col("selected"), "SELECTED_PENDING")
            .when(known & (gap > 0), base)
            .when(known & (identity >= 98.65), "LOW_PANGENOME_TARGET_MET")
            .when(ge97 > 0, "MEDIUM_RELATED_GENOME_CLADE")
            .when(nearby, "MEDIUM_SELECTED_NEARBY")
            .otherwise(base),
            "adjusted_score": F.round(
                F.when(F.col("available") | F.col("selected") | (known & (gap > 0)), score)
                .when(known & (identity >= 98.65), minus(25.0))
                .when((ge97 > 0) | nearby, minus(10.0))
                .otherwise(score),
                2,
            ),
        }
    )
