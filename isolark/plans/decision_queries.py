"""Registered queries on decisions, genome collections and dataset lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from isolark.functions import identifiers as I, scores, taxonomy as T
from isolark.operators import collection as C, decisions as D, selection as S, trees
from isolark.plans.bindings import view
from isolark.plans.scalar_queries import _FLAGS, _QUALITY
from isolark.registry import query

_ROWS = f"""
r AS (SELECT *, {_QUALITY} AS quality, seq_no % 15 > 0 AS bp, seq_no % 12 > 0 AS pp, seq_no % 14 > 0 AS rp, greatest(0, 9 - seq_no % 12) AS gap, seq_no % 12 AS committed, concat('x', seq_no % 5) AS tt,
  CASE seq_no % 9 WHEN 0 THEN 'BASELINE_REDUNDANT' WHEN 1 THEN 'PANGENOME_BOUNDARY_REVIEW' WHEN 2 THEN 'PRIMARY' WHEN 3 THEN 'BACKUP' WHEN 4 THEN 'DIVERSITY_CANDIDATE' WHEN 5 THEN 'ALTERNATE' ELSE '' END AS role FROM (SELECT *, {_FLAGS} AS fl FROM {{assessment}}) z),
l AS (SELECT *, CASE WHEN NOT bp OR nearest_identity IS NULL THEN 'UNKNOWN - no cultured baseline' WHEN nearest_identity < 97 THEN 'LARGE - no match >=97%' WHEN nearest_identity < 98.65 THEN 'MODERATE - nearest 97-98.65%' ELSE 'SMALL - close match >=98.65%' END AS cultured_gap,
  CASE WHEN NOT pp THEN 'UNKNOWN - no project collection' WHEN project_matches_ge_97 = 0 THEN 'UNCOVERED - 0 neighbours >=97%' WHEN project_matches_ge_97 <= 3 THEN concat('SPARSE - ', project_matches_ge_97, ' neighbour(s) >=97%')
    WHEN project_matches_ge_97 <= 10 THEN concat('MODERATE - ', project_matches_ge_97, ' neighbours >=97%') ELSE concat('DENSE - ', project_matches_ge_97, ' neighbours >=97%') END AS project_coverage FROM r),
pn AS (SELECT *, coalesce(target_rank IN ('species', 'genus', 'family'), false) AS st,
  list_filter([CASE WHEN target_rank IN ('species', 'genus', 'family') THEN concat('target match (', tt, ')') WHEN target_rank = 'order' THEN concat('order-level target context (', tt, ')') END,
   CASE WHEN rarity_strength IN ('HIGH', 'MODERATE') THEN 'diversity metadata supports an underrepresented isolate' END,
   CASE WHEN bp AND nearest_identity < 97 THEN printf('no close cultured isolate (%.2f%%)', nearest_identity) END, CASE WHEN pp AND project_nearest_identity < 97 THEN printf('no close project isolate (%.2f%%)', project_nearest_identity) END,
   CASE WHEN rp AND reference_nearest_identity < 98.65 THEN printf('divergent from external reference (%.2f%%)', reference_nearest_identity) END, CASE WHEN gap > 0 THEN concat(gap, ' genome(s) still required for pangenome target') END], lambda x: x IS NOT NULL) AS pos,
  list_filter([CASE WHEN available THEN 'current isolate already has a genome available' WHEN selected THEN 'current isolate is already selected; genome pending' END, CASE WHEN quality <> 'HIGH' THEN concat(lower(quality), ' marker evidence') END,
   CASE WHEN role = 'BASELINE_REDUNDANT' THEN 'near-identical to a cultured baseline marker at high query coverage' END, CASE WHEN role = 'PANGENOME_BOUNDARY_REVIEW' THEN 'not admitted to the baseline-pangenome extension (checked)' END,
   CASE WHEN gap = 0 THEN 'assessment-species pangenome target already met' END, CASE WHEN project_coverage LIKE 'DENSE%' THEN 'dense prior project neighbourhood' END, CASE WHEN cultured_gap LIKE 'SMALL%' THEN 'close cultured-baseline match' END,
   CASE WHEN cultured_gap LIKE 'UNKNOWN%' AND project_coverage LIKE 'UNKNOWN%' THEN 'baseline and prior-project comparisons unavailable' END], lambda x: x IS NOT NULL) AS neg FROM l),
d AS (SELECT *, CASE WHEN available THEN 'ALREADY SEQUENCED' WHEN selected THEN 'ALREADY SELECTED - GENOME PENDING' WHEN quality = 'LOW' THEN 'REVIEW BEFORE SELECTION' WHEN role = 'BASELINE_REDUNDANT' THEN 'EXCLUDE - BASELINE REDUNDANT'
   WHEN role = 'PANGENOME_BOUNDARY_REVIEW' THEN 'REVIEW - PANGENOME BOUNDARY' WHEN role = 'PRIMARY' THEN 'PRIORITISE - SET PRIMARY' WHEN role = 'BACKUP' THEN 'RESERVE - SET BACKUP' WHEN role = 'DIVERSITY_CANDIDATE' THEN 'SECONDARY - STRAIN DIVERSITY'
   WHEN gap = 0 THEN 'LOWER PRIORITY - TARGET MET' WHEN role = 'ALTERNATE' THEN 'SECONDARY CANDIDATE' WHEN st OR len(pos) >= 2 THEN 'STRONG CANDIDATE' WHEN len(pos) > 0 THEN 'SECONDARY CANDIDATE'
   WHEN cultured_gap LIKE 'SMALL%' AND (project_coverage LIKE 'MODERATE%' OR project_coverage LIKE 'DENSE%') THEN 'LOWER PRIORITY - LIMITED ADDED VALUE' WHEN cultured_gap LIKE 'UNKNOWN%' AND project_coverage LIKE 'UNKNOWN%' THEN 'REVIEW BEFORE SELECTION'
   ELSE 'SECONDARY CANDIDATE' END AS decision, list_concat(list_slice(pos, 1, 3), list_slice(neg, 1, 2)) AS rs FROM pn)"""


def _decided(spark, sf):
    k = F.col("seq_no")
    quality = scores.evidence_quality("placement_flags", "classification_identity", "classification_confidence", "classification_query_coverage", "taxonomy")
    role = F.element_at(
        F.array(*map(F.lit, ("BASELINE_REDUNDANT", "PANGENOME_BOUNDARY_REVIEW", "PRIMARY", "BACKUP", "DIVERSITY_CANDIDATE", "ALTERNATE", "", "", ""))), (k % 9 + 1).cast("int")
    )
    rows = view(spark, sf, "assessment").withColumns(
        {
            "quality": quality, "baseline_pool": k % 15 > 0, "project_pool": k % 12 > 0, "reference_pool": k % 14 > 0, "gap": F.greatest(F.lit(0), 9 - k % 12),
            "committed": k % 12, "target_taxon": F.concat(F.lit("x"), (k % 5).cast("string")), "role": role, "extension_status": F.lit("checked"),
        }
    )
    return D.decision_table(rows)


@query(
    "decision_table",
    f"""WITH {_ROWS.strip()}
SELECT id, quality, cultured_gap, project_coverage, decision, CASE WHEN len(rs) = 0 THEN 'no strong novelty or redundancy signal' ELSE array_to_string(rs, '; ') END AS decision_reason FROM d""",
)
def decision_table(spark, sf):
    return D.report_order(_decided(spark, sf)).select("id", "quality", "cultured_gap", "project_coverage", "decision", "decision_reason")


@query("decision_counts", f"WITH {_ROWS.strip()} SELECT decision, count(*) AS isolates FROM d GROUP BY 1")
def decision_counts(spark, sf):
    return _decided(spark, sf).groupBy("decision").agg(F.count(F.lit(1)).alias("isolates"))


@query("isolate_decisions")
def isolate_decisions(spark, sf):
    """Flagship: which isolates add enough novelty to be worth a genome, and why."""
    closed = trees.closure(view(spark, sf, "tree_nodes"))
    sets = S.sequencing_sets(view(spark, sf, "assessed"), closed, trees.local_clades(closed, view(spark, sf, "tree_nodes")))
    yes = F.lit(True)
    rows = sets.withColumns({"baseline_pool": yes, "project_pool": yes, "reference_pool": yes, "target_taxon": F.lit("listed taxon")})
    decided = D.decision_table(rows)
    return D.report_order(decided).select("id", "decision", "role", "rank", "set_id", "gap", "novelty_score", "cultured_gap", "project_coverage", "genome_coverage", "decision_reason")


@query(
    "genome_collection",
    """
SELECT t.id, t.dataset, CASE WHEN r.role = 'baseline' AND r.genomes_available THEN 'baseline' WHEN l.available THEN 'partner' ELSE 'pending' END AS source,
  CASE WHEN t.taxonomy <> 'NA' THEN t.taxonomy END AS taxonomy
FROM {taxa} t LEFT JOIN {roles} r ON r.dataset = t.dataset LEFT JOIN {ledger} l ON l.id = t.id
WHERE (r.role = 'baseline' AND r.genomes_available) OR l.available OR l.selected""",
)
def genome_collection(spark, sf):
    rows = view(spark, sf, "taxa").join(view(spark, sf, "roles"), "dataset", "left").join(view(spark, sf, "ledger"), "id", "left")
    baseline = (F.col("role") == "baseline") & F.col("genomes_available")
    source = F.when(baseline, "baseline").when(F.col("available"), "partner").otherwise("pending")
    return rows.filter(baseline | F.col("available") | F.col("selected")).select("id", "dataset", source.alias("source"), T.null_text("taxonomy").alias("taxonomy"))


@query(
    "committed_by_species",
    """
SELECT DISTINCT lower(regexp_replace(split_part(taxonomy, ';s__', 2), '[^A-Za-z0-9]+', '', 'g')) AS species_key, t.id
FROM {taxa} t LEFT JOIN {roles} r ON r.dataset = t.dataset LEFT JOIN {ledger} l ON l.id = t.id
WHERE strpos(taxonomy, ';s__') > 0 AND ((r.role = 'baseline' AND r.genomes_available) OR l.available OR l.selected)""",
)
def committed_by_species(spark, sf):
    rows = genome_collection(spark, sf).withColumn("species_key", T.norm_taxon(T.species_name("taxonomy")))
    return rows.filter("species_key is not null").select("species_key", "id").distinct()


@query("new_records", "SELECT concat('C', o_custkey) AS id, count(*) AS orders FROM {orders} WHERE concat('C', o_custkey) NOT IN (SELECT id FROM {ledger} WHERE selected) GROUP BY 1")
def new_records(spark, sf):
    seen = view(spark, sf, "ledger").filter("selected").select("id")
    incoming = view(spark, sf, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("id"))
    return incoming.join(seen, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "marker_qc_counts",
    """
SELECT t.dataset, count(*) FILTER (qc_class LIKE 'PASS%') AS passed, count(*) FILTER (qc_class = 'PASS_WITH_WARNINGS') AS review, count(*) FILTER (qc_class LIKE 'FAIL%') AS failed
FROM {taxa} t LEFT JOIN {marker_qc} q ON q.sequence_id = t.id GROUP BY 1""",
)
def marker_qc_counts(spark, sf):
    rows = view(spark, sf, "taxa").select("id", "dataset").join(view(spark, sf, "marker_qc").withColumnRenamed("sequence_id", "id"), "id", "left")
    qc = F.col("qc_class")
    return rows.groupBy("dataset").agg(
        F.count_if(F.startswith(qc, F.lit("PASS"))).alias("passed"), F.count_if(qc == "PASS_WITH_WARNINGS").alias("review"), F.count_if(F.startswith(qc, F.lit("FAIL"))).alias("failed")
    )


@query(
    "dataset_registry",
    """
WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'SILVA' WHEN 1 THEN 'Green-Genes2' WHEN 2 THEN 'gtdb_r220' WHEN 3 THEN 'my set' WHEN 4 THEN 'NCBI 16S' ELSE p_brand END AS name FROM {part})
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'SILVA' WHEN 1 THEN 'GreenGenes2' WHEN 2 THEN 'GTDB' WHEN 4 THEN 'NCBI16S' ELSE name END AS label FROM n""",
)
def dataset_registry(spark, sf):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "SILVA").when(k == 1, "Green-Genes2").when(k == 2, "gtdb_r220").when(k == 3, "my set").when(k == 4, "NCBI 16S").otherwise(F.col("p_brand"))
    rows = view(spark, sf, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", I.dataset_label("name").alias("label"))


_SEEN_IN = "SELECT id, dataset FROM {taxa} UNION ALL SELECT id, concat('a', dataset) FROM {taxa} WHERE seq_no % 2 = 0"
_STATED = """SELECT id, CASE WHEN seq_no % 3 > 0 THEN dataset END AS dataset, CASE WHEN taxonomy <> 'NA' THEN taxonomy ELSE '' END AS taxonomy FROM {taxa}
  UNION ALL SELECT id, NULL, concat('general;', id) FROM {taxa} WHERE seq_no % 5 = 0
  UNION ALL SELECT id, concat('a', dataset), concat('second;', id) FROM {taxa} WHERE seq_no % 4 = 0"""


@query(
    "first_taxonomy",
    f"""
WITH s AS ({_SEEN_IN}), t AS ({_STATED}),
j AS (SELECT s.id, s.dataset, t.taxonomy, t.dataset AS named FROM s LEFT JOIN t ON s.id = t.id AND (t.dataset = s.dataset OR t.dataset IS NULL))
SELECT id, min(dataset) AS dataset, first(taxonomy ORDER BY dataset, named IS NULL, taxonomy) FILTER (taxonomy <> '') AS taxonomy FROM j GROUP BY id""",
)
def first_taxonomy(spark, sf):
    taxa = view(spark, sf, "taxa")
    seen = taxa.select("id", "dataset").unionByName(taxa.filter("seq_no % 2 = 0").select("id", F.concat(F.lit("a"), "dataset").alias("dataset")))
    stated = taxa.select("id", F.when(F.col("seq_no") % 3 > 0, F.col("dataset")).alias("dataset"), F.when(F.col("taxonomy") != "NA", F.col("taxonomy")).otherwise("").alias("taxonomy"))
    general = taxa.filter("seq_no % 5 = 0").select("id", F.lit(None).cast("string").alias("dataset"), F.concat(F.lit("general;"), "id").alias("taxonomy"))
    second = taxa.filter("seq_no % 4 = 0").select("id", F.concat(F.lit("a"), "dataset").alias("dataset"), F.concat(F.lit("second;"), "id").alias("taxonomy"))
    return C.first_taxonomy(seen, stated.unionByName(general).unionByName(second))


_ROLE = "CASE seq_no % 7 WHEN 0 THEN 'primary' WHEN 1 THEN 'BACKUP' WHEN 2 THEN 'Sequenced' WHEN 3 THEN 'COMMITTED' WHEN 4 THEN 'ALTERNATE' WHEN 5 THEN 'other' END"
_RANK = "CASE seq_no % 5 WHEN 0 THEN '2' WHEN 1 THEN '1.0' WHEN 2 THEN 'none' WHEN 3 THEN '10' END"


@query(
    "identity_anchor",
    f"""
SELECT dataset, id AS anchor FROM (SELECT dataset, id, upper({_ROLE}) AS role, {_RANK} AS r FROM {{seqs}} WHERE id IN (SELECT id FROM {{aligned}} WHERE is_anchor))
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY CASE role WHEN 'PRIMARY' THEN 0 WHEN 'BACKUP' THEN 1 WHEN 'SEQUENCED' THEN 2 WHEN 'COMMITTED' THEN 2 WHEN 'ALTERNATE' THEN 4 ELSE 99 END,
  coalesce(cast(try_cast(r AS double) AS int), 999), id) = 1""",
)
def identity_anchor(spark, sf):
    targets = view(spark, sf, "seqs").select("dataset", "id", F.col("id").alias("leaf"), F.expr(_ROLE).alias("role"), F.expr(_RANK).alias("set_rank"))
    return S.identity_anchor(targets, view(spark, sf, "aligned").filter("is_anchor"), "dataset")
