"""Registered queries over alignment hits, novelty and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from isolark.functions import scores
from isolark.functions.taxonomy import norm_taxon, species_name
from isolark.operators import background, hits as H
from isolark.plans.bindings import view
from isolark.registry import query

BEST = "ORDER BY identity DESC, ordinal, target"

_SCORES = """
    round(least(100, greatest(0, least(60, (100 - nearest_identity) * 3))
      + CASE WHEN matches_ge_99 <= 1 THEN 20 WHEN matches_ge_99 <= 5 THEN 10 ELSE 0 END
      + CASE WHEN matches_ge_97 <= 3 THEN 15 WHEN matches_ge_97 <= 10 THEN 7.5 ELSE 0 END
      + CASE WHEN matches_ge_95 <= 10 THEN 5 ELSE 0 END), 2) AS novelty_score,
    CASE WHEN matches_ge_99 <= 1 AND matches_ge_97 <= 1 THEN 'isolated' WHEN matches_ge_97 <= 3 THEN 'sparse'
         WHEN matches_ge_97 <= 10 THEN 'moderate' ELSE 'crowded' END AS crowding,
    CASE WHEN nearest_identity < 97 AND matches_ge_99 <= 1 AND matches_ge_97 <= 3 THEN 'HIGH'
         WHEN nearest_identity < 98.5 AND matches_ge_99 <= 2 AND matches_ge_97 <= 10 THEN 'MEDIUM' ELSE 'LOW' END AS sequencing_priority,
    nearest_identity < 97 AS novel"""

_METRICS = """
usable AS (SELECT * FROM {hits} WHERE identity >= 50 AND query_coverage >= 70),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY identity DESC, ordinal, target) rn FROM usable) x WHERE rn = 1),
dens AS (SELECT query, count(*) FILTER (identity >= 99) n99, count(*) FILTER (identity >= 97) n97, count(*) FILTER (identity >= 95) n95
         FROM usable GROUP BY query),
metrics AS (SELECT q.query, b.target AS nearest_hit, coalesce(b.identity, 0) AS nearest_identity, b.query_coverage AS nearest_query_coverage,
       coalesce(n99, 0) AS matches_ge_99, coalesce(n97, 0) AS matches_ge_97, coalesce(n95, 0) AS matches_ge_95
FROM {queries_all} q LEFT JOIN best b USING (query) LEFT JOIN dens USING (query))"""


@query(
    "hits_parse",
    """
SELECT query, target, identity, alnlen,
  CASE WHEN qc IS NOT NULL THEN round(least(100, greatest(0, qc)), 4) END AS query_coverage,
  CASE WHEN tc IS NOT NULL THEN round(least(100, greatest(0, tc)), 4) END AS target_coverage FROM (
  SELECT trim(p[1]) AS query, trim(p[2]) AS target, try_cast(p[3] AS double) AS identity, cast(try_cast(p[4] AS double) AS int) AS alnlen, len(p) AS n,
         coalesce(try_cast(p[13] AS double), 100 * try_cast(p[4] AS double) / nullif(try_cast(p[11] AS double), 0)) AS qc,
         coalesce(try_cast(p[14] AS double), 100 * try_cast(p[4] AS double) / nullif(try_cast(p[12] AS double), 0)) AS tc
  FROM (SELECT string_split(value, chr(9)) AS p FROM {hit_lines}) y) x
WHERE n >= 3 AND identity IS NOT NULL AND query <> ''""",
)
def hits_parse(spark, sf):
    parsed = H.parse_hit_lines(view(spark, sf, "hit_lines"))
    return parsed.select("query", "target", "identity", "alnlen", "query_coverage", "target_coverage")


@query(
    "nearest_hit",
    """
WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY identity DESC, ordinal, target) rn
   FROM {hits} WHERE identity >= 50 AND query_coverage >= 70 AND query <> target) x WHERE rn = 1)
SELECT q.query, b.target AS nearest_hit, coalesce(b.identity, 0) AS nearest_identity,
       b.query_coverage AS nearest_query_coverage, b.alnlen AS nearest_alignment_length
FROM {queries_all} q LEFT JOIN best b USING (query)""",
)
def nearest_hit(spark, sf):
    return H.nearest(view(spark, sf, "queries_all"), view(spark, sf, "hits"))


@query(
    "density_counts",
    """
WITH dens AS (SELECT query, count(*) FILTER (identity >= 99) n99, count(*) FILTER (identity >= 97) n97, count(*) n95
   FROM {hits} WHERE identity >= 95 AND query_coverage >= 70 AND query <> target GROUP BY query)
SELECT query, coalesce(n99, 0) AS matches_ge_99, coalesce(n97, 0) AS matches_ge_97, coalesce(n95, 0) AS matches_ge_95
FROM {queries_all} LEFT JOIN dens USING (query)""",
)
def density_counts(spark, sf):
    return H.density(view(spark, sf, "queries_all"), view(spark, sf, "hits"))


@query("novelty_score", f"WITH {_METRICS.strip()} SELECT *, {_SCORES} FROM metrics")
def novelty_score(spark, sf):
    return H.metrics(view(spark, sf, "queries_all"), view(spark, sf, "hits"))


@query(
    "topk_hits",
    """
SELECT query, target, identity, rank FROM (
  SELECT query, target, identity, row_number() OVER (PARTITION BY query ORDER BY identity DESC, ordinal, target) AS rank
  FROM {hits} WHERE identity >= 90) x WHERE rank <= 3""",
)
def topk_hits(spark, sf):
    return H.top_hits(view(spark, sf, "hits"), k=3, floor=90.0).select("query", "target", "identity", "rank")


@query(
    "pool_metrics",
    f"""
WITH tagged AS (SELECT h.*, unnest(CASE h.pool WHEN 'priority' THEN ['priority', 'combined'] WHEN 'secondary' THEN ['secondary', 'combined']
      ELSE [h.pool] END) AS pool2 FROM {{hits}} h),
usable AS (SELECT * FROM tagged WHERE identity >= 50 AND query_coverage >= 70),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, pool2 ORDER BY identity DESC, ordinal, target) rn FROM usable) x WHERE rn = 1),
dens AS (SELECT query, pool2, count(*) FILTER (identity >= 99) n99, count(*) FILTER (identity >= 97) n97, count(*) FILTER (identity >= 95) n95
         FROM usable GROUP BY query, pool2),
frame AS (SELECT query, pool FROM {{queries_all}}, (SELECT DISTINCT pool2 AS pool FROM tagged) p),
m AS (SELECT f.query, f.pool, b.target AS nearest_hit, coalesce(b.identity, 0) AS nearest_identity, b.query_coverage AS nearest_query_coverage,
       coalesce(n99, 0) AS matches_ge_99, coalesce(n97, 0) AS matches_ge_97, coalesce(n95, 0) AS matches_ge_95
  FROM frame f LEFT JOIN best b ON f.query = b.query AND f.pool = b.pool2 LEFT JOIN dens d ON f.query = d.query AND f.pool = d.pool2)
SELECT *, {_SCORES} FROM m""",
)
def pool_metrics(spark, sf):
    hits = view(spark, sf, "hits")
    tagged = hits.withColumn("pools", H.pool_tags("pool"))
    pools = tagged.select(F.explode("pools").alias("pool"))
    return H.pool_metrics(view(spark, sf, "queries_all"), tagged, pools)


@query(
    "retry_cascade",
    """
WITH r AS (SELECT *, CASE WHEN query_coverage >= 70 THEN 1 WHEN query_coverage >= 50 THEN 2 WHEN query_coverage >= 30 THEN 3 ELSE 4 END AS round
   FROM {hits} WHERE identity >= 98),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round, identity DESC, ordinal, target) rn FROM r) x WHERE rn = 1)
SELECT q.query, b.round, b.target AS best_hit, b.identity FROM {queries_all} q LEFT JOIN best b USING (query)""",
)
def retry_cascade(spark, sf):
    return H.retry_cascade(view(spark, sf, "queries_all"), view(spark, sf, "hits"), floor=98.0)


@query(
    "classify_lookup",
    """
WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY identity DESC, ordinal, target) rn
   FROM {hits} WHERE identity >= 95 AND query_coverage >= 70) x WHERE rn = 1)
SELECT q.query, b.target AS best_hit, b.identity, b.query_coverage,
       CASE WHEN b.target IS NOT NULL THEN coalesce(t.taxonomy, 'NA') END AS taxonomy,
       coalesce(t.confidence, round(b.identity / 100, 4)) AS confidence
FROM {queries_all} q LEFT JOIN best b USING (query) LEFT JOIN {target_taxa} t ON t.target = b.target""",
)
def classify_lookup(spark, sf):
    taxonomy = view(spark, sf, "target_taxa").select("target", "taxonomy", "confidence")
    return H.classify(view(spark, sf, "queries_all"), view(spark, sf, "hits"), taxonomy, floor=95.0)


@query(
    "taxonomic_disagreement",
    """
WITH named AS (SELECT h.query, h.target, h.identity, h.ordinal, t.taxonomy,
     CASE WHEN t.taxonomy IS NULL OR upper(trim(t.taxonomy)) IN ('', 'NA') THEN NULL ELSE lower(t.taxonomy) END AS k
   FROM {hits} h LEFT JOIN {target_taxa} t USING (target) WHERE identity >= 97),
g AS (SELECT query, k, count(*) AS n, min(taxonomy) AS taxon, arg_min(identity, (-identity, ordinal, target)) AS bi,
      arg_min(target, (-identity, ordinal, target)) AS bt FROM named GROUP BY query, k),
t AS (SELECT query, cast(sum(n) AS bigint) AS high_quality_hits, cast(sum(CASE WHEN k IS NOT NULL THEN n ELSE 0 END) AS bigint) AS assigned_hits, count(k) AS distinct_taxa FROM g GROUP BY query HAVING count(k) >= 2)
SELECT query, high_quality_hits, assigned_hits, distinct_taxa, taxon, n AS hits, bi AS best_identity, bt AS best_hit FROM g JOIN t USING (query) WHERE k IS NOT NULL""",
)
def taxonomic_disagreement(spark, sf):
    return H.disagreement(view(spark, sf, "hits"), view(spark, sf, "target_taxa"))


@query(
    "classification_tiers",
    """
WITH best AS (SELECT query_no, max(identity) AS identity FROM {hits} WHERE identity >= 89 AND query_coverage >= 70 GROUP BY query_no),
x AS (SELECT concat('DB', q.query_no % 7) AS dataset, b.identity FROM {queries_all} q LEFT JOIN best b USING (query_no)),
g AS (SELECT dataset, count(*) AS total_input, count(identity) AS classified, count(*) - count(identity) AS unclassified,
   count(*) FILTER (identity >= 97) AS high, count(*) FILTER (identity >= 90 AND identity < 97) AS medium, count(*) FILTER (identity < 90) AS low
 FROM x GROUP BY GROUPING SETS ((dataset), ()))
SELECT coalesce(dataset, 'TOTAL') AS dataset, total_input, classified, unclassified, high, medium, low,
  round(100.0 * high / total_input, 1) AS pct_high, round(100.0 * medium / total_input, 1) AS pct_medium, round(100.0 * low / total_input, 1) AS pct_low,
  round(100.0 * classified / total_input, 1) AS pct_classified, round(100.0 * unclassified / total_input, 1) AS pct_unclassified
FROM g""",
)
def classification_tiers(spark, sf):
    queries = view(spark, sf, "queries_all")
    best = H.admitted(view(spark, sf, "hits"), 89.0, H.MIN_COVERAGE).groupBy("query").agg(F.max("identity").alias("identity"))
    rows = queries.join(best, "query", "left").select(
        F.concat(F.lit("DB"), (F.col("query_no") % 7).cast("string")).alias("dataset"), "identity"
    )
    return background.classification_tiers(rows)


@query(
    "hit_enrichment",
    """
WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, pool ORDER BY identity DESC, ordinal, target) rn
   FROM {hits} WHERE identity >= 50 AND query_coverage >= 70) x WHERE rn = 1),
e AS (SELECT b.query, b.pool, b.target, t.dataset, t.taxonomy FROM best b LEFT JOIN {target_taxa} t USING (target))
SELECT query,
  max(target) FILTER (pool = 'project') AS project_hit, max(dataset) FILTER (pool = 'project') AS project_dataset, max(taxonomy) FILTER (pool = 'project') AS project_taxonomy,
  max(target) FILTER (pool = 'reference') AS reference_hit, max(dataset) FILTER (pool = 'reference') AS reference_dataset, max(taxonomy) FILTER (pool = 'reference') AS reference_taxonomy,
  max(target) FILTER (pool = 'priority') AS priority_hit, max(dataset) FILTER (pool = 'priority') AS priority_dataset, max(taxonomy) FILTER (pool = 'priority') AS priority_taxonomy
FROM e GROUP BY query""",
)
def hit_enrichment(spark, sf):
    best = H.best_hit(H.admitted(view(spark, sf, "hits"), 50.0, H.MIN_COVERAGE), keys=("query", "pool"))
    return background.enrich_by_pool(best, view(spark, sf, "target_taxa"), ["project", "reference", "priority"])


@query(
    "multi_db_merge",
    """
WITH best AS (SELECT * FROM (SELECT h.query, t.dataset AS ref_db, h.target, h.identity, t.taxonomy,
     row_number() OVER (PARTITION BY query, t.dataset ORDER BY identity DESC, ordinal, target) rn
   FROM {hits} h JOIN {target_taxa} t USING (target) WHERE identity >= 90 AND query_coverage >= 70) x WHERE rn = 1)
SELECT q.query, max(taxonomy) FILTER (ref_db = 'DB0') AS taxon_DB0, max(identity) FILTER (ref_db = 'DB0') AS identity_DB0,
  max(taxonomy) FILTER (ref_db = 'DB1') AS taxon_DB1, max(identity) FILTER (ref_db = 'DB1') AS identity_DB1,
  max(taxonomy) FILTER (ref_db = 'DB2') AS taxon_DB2, max(identity) FILTER (ref_db = 'DB2') AS identity_DB2
FROM {queries_all} q LEFT JOIN best b USING (query) GROUP BY q.query""",
)
def multi_db_merge(spark, sf):
    tagged = (
        H.admitted(view(spark, sf, "hits"), 90.0, H.MIN_COVERAGE)
        .join(view(spark, sf, "target_taxa").select("target", "taxonomy", F.col("dataset").alias("ref_db")), "target")
    )
    best = H.best_hit(tagged, keys=("query", "ref_db"), extra=("taxonomy",))
    return background.merge_databases(view(spark, sf, "queries_all"), best, ["DB0", "DB1", "DB2"])


@query(
    "evidence_class",
    """
WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, pool ORDER BY identity DESC, ordinal, target) rn
   FROM {hits} WHERE identity >= 50 AND query_coverage >= 70 AND pool IN ('priority', 'secondary')) x WHERE rn = 1),
w AS (SELECT q.query, p.identity AS pid, p.query_coverage AS pcov, s.identity AS sid, s.query_coverage AS scov,
        q.query_no % 10 <> 0 AS ppool, q.query_no % 8 <> 0 AS spool, q.query_no % 40 <> 0 AS apool
   FROM {queries_all} q LEFT JOIN (SELECT * FROM best WHERE pool = 'priority') p USING (query)
   LEFT JOIN (SELECT * FROM best WHERE pool = 'secondary') s USING (query)),
x AS (SELECT *, ppool AND coalesce(pid >= 99.8 AND pcov >= 95, false) OR spool AND coalesce(sid >= 99.8 AND scov >= 95, false) AS red,
   ppool AND coalesce(pid >= 98.65 AND pcov >= 95, false) AS pc, spool AND coalesce(sid >= 98.65 AND scov >= 95, false) AS sc FROM w)
SELECT query, CASE WHEN NOT (ppool OR spool OR apool) THEN 'NO CULTURED BASELINE AVAILABLE' WHEN red THEN 'CULTURED BASELINE REDUNDANT'
  WHEN pc THEN 'PRIORITY COVERED' WHEN sc AND ppool THEN 'PRIORITY GAP / SECONDARY COVERED' WHEN sc THEN 'SECONDARY COVERED / PRIORITY NOT ASSESSED'
  WHEN ppool AND spool THEN 'NOVEL TO BOTH BASELINES' WHEN ppool THEN 'NOVEL TO PRIORITY / SECONDARY NOT ASSESSED'
  WHEN spool THEN 'NOVEL TO SECONDARY / PRIORITY NOT ASSESSED' ELSE 'NO CULTURED BASELINE AVAILABLE' END AS evidence_class
FROM x""",
)
def evidence_class(spark, sf):
    hits = view(spark, sf, "hits").filter(F.col("pool").isin("priority", "secondary"))
    best = H.best_hit(H.admitted(hits, 50.0, H.MIN_COVERAGE), keys=("query", "pool"))
    pick = lambda pool, field: F.max(F.when(F.col("pool") == pool, F.col(field)))
    wide = best.groupBy("query").agg(
        pick("priority", "identity").alias("pid"),
        pick("priority", "query_coverage").alias("pcov"),
        pick("secondary", "identity").alias("sid"),
        pick("secondary", "query_coverage").alias("scov"),
    )
    no = F.col("query_no")
    return (
        view(spark, sf, "queries_all")
        .join(wide, "query", "left")
        .select(
            "query",
            scores.evidence_class("pid", "pcov", no % 10 != 0, "sid", "scov", no % 8 != 0, no % 40 != 0).alias("evidence_class"),
        )
    )


_COVER = """
cover AS (SELECT lower(regexp_replace(split_part(taxonomy, ';s__', 2), '[^A-Za-z0-9]+', '', 'g')) AS species_key,
    count(*) FILTER (r.tier = 'priority' AND r.genomes_available) AS priority_genomes,
    count(*) FILTER (r.tier = 'secondary' AND r.genomes_available) AS secondary_genomes,
    count(*) FILTER (NOT coalesce(r.role = 'baseline' AND r.genomes_available, false) AND coalesce(l.available, false)) AS partner_genomes,
    count(*) FILTER (NOT coalesce(r.role = 'baseline' AND r.genomes_available, false) AND NOT coalesce(l.available, false) AND coalesce(l.selected, false)) AS pending_genomes
  FROM {taxa} t LEFT JOIN {roles} r USING (dataset) LEFT JOIN {ledger} l ON l.id = t.id
  WHERE strpos(taxonomy, ';s__') > 0 GROUP BY 1)"""


@query(
    "species_coverage",
    f"""
WITH {_COVER.strip()}
SELECT *, priority_genomes + secondary_genomes + partner_genomes + pending_genomes AS committed,
  greatest(0, 9 - (priority_genomes + secondary_genomes + partner_genomes + pending_genomes)) AS pangenome_gap FROM cover""",
)
def species_coverage(spark, sf):
    return background.species_coverage(view(spark, sf, "taxa"), view(spark, sf, "roles"), view(spark, sf, "ledger"))


@query(
    "adjusted_priority",
    f"""
WITH {_COVER.strip()},
{_METRICS.strip()},
scored AS (SELECT *, {_SCORES} FROM metrics),
gen AS (SELECT query, count(*) FILTER (identity >= 97) AS g97, count(*) FILTER (identity >= 95) AS g95, max(identity) AS gid
   FROM {{hits}} WHERE pool = 'genomes' AND identity >= 50 AND query_coverage >= 70 GROUP BY query),
w AS (SELECT s.query, s.novelty_score, s.sequencing_priority, t.id, l.selected, l.available, coalesce(gid, 0) AS gid, coalesce(g97, 0) AS g97, coalesce(g95, 0) AS g95,
    CASE WHEN strpos(t.taxonomy, ';s__') > 0 THEN lower(regexp_replace(split_part(t.taxonomy, ';s__', 2), '[^A-Za-z0-9]+', '', 'g')) END AS species_key
  FROM scored s JOIN {{queries_all}} q USING (query) JOIN {{taxa}} t ON t.seq_no = q.cust LEFT JOIN {{ledger}} l ON l.id = t.id LEFT JOIN gen USING (query)),
x AS (SELECT w.*, greatest(0, 9 - coalesce(priority_genomes + secondary_genomes + partner_genomes + pending_genomes, 0)) AS gap FROM w LEFT JOIN cover USING (species_key))
SELECT query, id,
  CASE WHEN available THEN 'SEQUENCED' WHEN selected THEN 'SELECTED_PENDING' WHEN species_key IS NOT NULL AND gap > 0 THEN sequencing_priority
    WHEN species_key IS NOT NULL AND gid >= 98.65 THEN 'LOW_PANGENOME_TARGET_MET' WHEN g97 > 0 THEN 'MEDIUM_RELATED_GENOME_CLADE'
    WHEN g95 > 0 AND sequencing_priority = 'HIGH' THEN 'MEDIUM_SELECTED_NEARBY' ELSE sequencing_priority END AS adjusted_priority,
  round(CASE WHEN available OR selected OR (species_key IS NOT NULL AND gap > 0) THEN novelty_score
    WHEN species_key IS NOT NULL AND gid >= 98.65 THEN greatest(0, novelty_score - 25) WHEN g97 > 0 THEN greatest(0, novelty_score - 10)
    WHEN g95 > 0 AND sequencing_priority = 'HIGH' THEN greatest(0, novelty_score - 10) ELSE novelty_score END, 2) AS adjusted_score
FROM x""",
)
def adjusted_priority(spark, sf):
    queries, hits = view(spark, sf, "queries_all"), view(spark, sf, "hits")
    isolates = view(spark, sf, "taxa").select(
        "id", F.col("seq_no").alias("cust"), norm_taxon(species_name("taxonomy")).alias("species_key")
    )
    base = H.metrics(queries, hits).select("query", "novelty_score", "sequencing_priority")
    genomes = (
        H.admitted(hits.filter("pool = 'genomes'"), 50.0, H.MIN_COVERAGE)
        .groupBy("query")
        .agg(
            F.max("identity").alias("genome_identity"),
            F.count_if(F.col("identity") >= 97).alias("genome_ge_97"),
            F.count_if(F.col("identity") >= 95).alias("genome_ge_95"),
        )
    )
    coverage = background.species_coverage(view(spark, sf, "taxa"), view(spark, sf, "roles"), view(spark, sf, "ledger"))
    rows = (
        base.join(queries, "query")
        .join(isolates, "cust")
        .join(view(spark, sf, "ledger").select("id", "selected", "available"), "id", "left")
        .join(genomes, "query", "left")
        .join(coverage.select("species_key", "pangenome_gap"), "species_key", "left")
    )
    adjusted = background.adjust_priority(rows)
    return adjusted.select("query", "id", "adjusted_priority", "adjusted_score")
