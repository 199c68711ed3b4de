"""Registered queries on trees, panels, sequencing sets and budgeted rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from isolark.functions import scores
from isolark.operators import selection as S, trees
from isolark.plans.bindings import view
from isolark.plans.scalar_queries import _FLAGS, _QUALITY
from isolark.registry import query
from isolark.session import cut_lineage

_CLOSURE = """
RECURSIVE_PLACEHOLDER
up AS (SELECT node_id, node_id AS ancestor_id, cast(0 AS double) AS dist, 0 AS hops FROM {tree_nodes}
  UNION ALL SELECT u.node_id, n.parent_id, u.dist + greatest(0, n.branch_length), u.hops + 1 FROM up u JOIN {tree_nodes} n ON n.node_id = u.ancestor_id WHERE n.parent_id IS NOT NULL)"""
_CLOSURE = _CLOSURE.replace("RECURSIVE_PLACEHOLDER\n", "").strip()
_CTX = f"""{_CLOSURE},
leaf AS (SELECT node_id FROM {{tree_nodes}} WHERE is_leaf),
cnt AS (SELECT ancestor_id, count(*) AS n FROM up JOIN leaf USING (node_id) GROUP BY 1),
anc AS (SELECT u.node_id, u.ancestor_id, u.hops, u.dist, c.n FROM up u JOIN leaf USING (node_id) JOIN cnt c ON c.ancestor_id = u.ancestor_id WHERE hops > 0)"""


def _closed(spark, sf):
    return trees.closure(view(spark, sf, "tree_nodes"))


@query("tree_closure", f"WITH {_CLOSURE} SELECT node_id, ancestor_id, round(dist, 6) AS dist, hops FROM up")
def tree_closure(spark, sf):
    return _closed(spark, sf).select("node_id", "ancestor_id", F.round("dist", 6).alias("dist"), "hops")


@query(
    "leaf_counts",
    f"WITH {_CTX} SELECT ancestor_id AS node_id, n AS leaf_count FROM cnt",
)
def leaf_counts(spark, sf):
    return trees.leaf_counts(_closed(spark, sf), view(spark, sf, "tree_nodes"))


@query(
    "leaf_isolation",
    """
SELECT node_id, round(branch_length / (SELECT max(branch_length) FROM {tree_nodes} WHERE is_leaf), 6) AS isolation FROM {tree_nodes} WHERE is_leaf""",
)
def leaf_isolation(spark, sf):
    return trees.leaf_isolation(view(spark, sf, "tree_nodes"))


@query(
    "patristic",
    f"""
WITH {_CLOSURE}
SELECT left_leaf, right_leaf, arg_min(a.ancestor_id, a.hops) AS mrca, round(min(a.dist + b.dist), 6) AS distance
FROM (SELECT DISTINCT * FROM {{tree_pairs}}) p JOIN up a ON a.node_id = left_leaf JOIN up b ON b.node_id = right_leaf AND a.ancestor_id = b.ancestor_id
GROUP BY 1, 2""",
)
def patristic(spark, sf):
    return trees.patristic(view(spark, sf, "tree_pairs"), _closed(spark, sf))


@query(
    "context_root",
    f"""
WITH {_CTX}
SELECT node_id, CASE WHEN arg_min(n, hops) > 30 THEN arg_min(ancestor_id, hops)
   ELSE coalesce(arg_min(ancestor_id, hops) FILTER (n >= 8 AND n <= 30), arg_max(ancestor_id, hops) FILTER (n <= 30)) END AS context_root
FROM anc GROUP BY 1""",
)
def context_root(spark, sf):
    return trees.context_root(_closed(spark, sf), view(spark, sf, "tree_nodes"))


@query(
    "local_clades",
    f"WITH {_CTX} SELECT node_id, coalesce(arg_max(ancestor_id, hops) FILTER (n <= 30), arg_min(ancestor_id, hops)) AS clade FROM anc GROUP BY 1",
)
def local_clades(spark, sf):
    return trees.local_clades(_closed(spark, sf), view(spark, sf, "tree_nodes"))


_CLADES = "clades AS (SELECT node_id, coalesce(arg_max(ancestor_id, hops) FILTER (n <= 30), arg_min(ancestor_id, hops)) AS clade FROM anc GROUP BY 1)"


@query(
    "clade_members",
    f"""
WITH {_CTX}, {_CLADES},
tg AS (SELECT c.clade, c.node_id AS leaf FROM clades c JOIN {{taxa}} t ON t.id = c.node_id WHERE t.seq_no % 10 = 3),
fc AS (SELECT c.clade, c.node_id AS leaf FROM clades c JOIN {{taxa}} t ON t.id = c.node_id WHERE t.seq_no % 20 = 7),
below AS (SELECT u.ancestor_id AS clade, u.node_id AS leaf FROM up u JOIN leaf USING (node_id) WHERE u.ancestor_id IN (SELECT clade FROM tg)),
d AS (SELECT b.clade, b.leaf, min(x.dist + y.dist) AS distance FROM below b JOIN tg USING (clade) JOIN up x ON x.node_id = b.leaf JOIN up y ON y.node_id = tg.leaf AND y.ancestor_id = x.ancestor_id GROUP BY 1, 2),
r AS (SELECT d.*, (d.clade, d.leaf) IN (SELECT clade, leaf FROM tg) OR (d.clade, d.leaf) IN (SELECT clade, leaf FROM fc) AS fixed FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY clade, fixed ORDER BY distance, leaf) AS rk, count(*) FILTER (fixed) OVER (PARTITION BY clade) AS nf FROM r)
SELECT clade, leaf, round(distance, 6) AS distance, fixed FROM k WHERE fixed OR rk + nf <= 12""",
)
def clade_members(spark, sf):
    closed, nodes = _closed(spark, sf), view(spark, sf, "tree_nodes")
    clades = trees.local_clades(closed, nodes).join(view(spark, sf, "taxa").select(F.col("id").alias("node_id"), "seq_no"), "node_id")
    pick = lambda m, r: clades.filter(F.col("seq_no") % m == r).select("clade", F.col("node_id").alias("leaf"))
    return trees.clade_members(pick(10, 3), pick(20, 7), closed, nodes, maximum=12)


@query(
    "prune_tree",
    f"""WITH {_CLOSURE},
k AS (SELECT node_id FROM {{tree_nodes}} WHERE is_leaf AND regexp_matches(node_id, '[13579]$')),
alive AS (SELECT DISTINCT ancestor_id AS node_id FROM up WHERE node_id IN (SELECT node_id FROM k)),
solid AS (SELECT node_id FROM k UNION SELECT parent_id FROM {{tree_nodes}} WHERE node_id IN (SELECT node_id FROM alive) AND parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 1),
near AS (SELECT node_id, ancestor_id, dist FROM up WHERE hops > 0 AND node_id IN (SELECT node_id FROM solid) AND ancestor_id IN (SELECT node_id FROM solid) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY hops) = 1)
SELECT s.node_id, n.ancestor_id AS parent_id, round(coalesce(n.dist, 0), 6) AS branch_length, s.node_id IN (SELECT node_id FROM k) AS is_leaf FROM solid s LEFT JOIN near n USING (node_id)""",
)
def prune_tree(spark, sf):
    nodes = view(spark, sf, "tree_nodes")
    keep = nodes.filter("is_leaf").filter(F.col("node_id").rlike("[13579]$")).select("node_id")
    return trees.induced_subtree(nodes, _closed(spark, sf), keep)


# ---- selection -----------------------------------------------------------------

_LEAF_TABLE = """
lt AS (SELECT node_id AS leaf, max(ancestor_id) FILTER (hops = 1) AS h, max(ancestor_id) FILTER (hops = 2) AS g, max(ancestor_id) FILTER (hops = 3) AS n, max(ancestor_id) FILTER (hops = 4) AS r,
   max(dist) FILTER (hops = 5) AS dl, max(dist) FILTER (hops = 5) - max(dist) FILTER (hops = 1) AS dh, max(dist) FILTER (hops = 5) - max(dist) FILTER (hops = 2) AS dg,
   max(dist) FILTER (hops = 5) - max(dist) FILTER (hops = 3) AS dn, max(dist) FILTER (hops = 5) - max(dist) FILTER (hops = 4) AS dr
  FROM up WHERE node_id IN (SELECT node_id FROM leaf) GROUP BY 1)"""
_DIST = "(CASE WHEN a.leaf = b.leaf THEN 0 ELSE a.dl + b.dl - 2 * (CASE WHEN a.h = b.h THEN a.dh WHEN a.g = b.g THEN a.dg WHEN a.n = b.n THEN a.dn WHEN a.r = b.r THEN a.dr ELSE 0 END) END)"
_EVIDENCE_RANK = """CASE evidence_class WHEN 'NOVEL TO BOTH BASELINES' THEN 4 WHEN 'PRIORITY GAP / SECONDARY COVERED' THEN 3 WHEN 'PRIORITY COVERED' THEN 2
   WHEN 'NO CULTURED BASELINE AVAILABLE' THEN 1 WHEN 'CULTURED BASELINE REDUNDANT' THEN 0"""
_RARITY = "CASE rarity_strength WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END"
_TARGET = "CASE target_rank WHEN 'species' THEN 5 WHEN 'genus' THEN 4 WHEN 'order' THEN 2 ELSE 0 END"
_PANEL_EV = f"""({_EVIDENCE_RANK} ELSE CASE WHEN coalesce(nearest_identity >= 99.8 AND nearest_query_coverage >= 95, false) THEN 0 WHEN nearest_identity < 98.65 THEN 4 ELSE 1 END END,
   CASE quality WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END, 100 - coalesce(nearest_identity, 100), 100 - coalesce(project_nearest_identity, 100),
   100 - coalesce(reference_nearest_identity, 100), isolation, {_RARITY}, rarity_score, {_TARGET}, target_score, coalesce(classification_confidence, 0), id)"""


def _panel_sql(steps: int) -> str:
    """Unrolled farthest-first over cand(grp, id, leaf, ev) and anch(grp, leaf)."""
    ctes = [
        f"""st0 AS (SELECT c.grp, c.id, c.leaf, c.ev, (SELECT min({_DIST}) FROM lt a, lt b, anch k WHERE a.leaf = c.leaf AND k.grp = c.grp AND b.leaf = k.leaf) AS spread FROM cand c)"""
    ]
    for i in range(1, steps + 1):
        ctes.append(
            f"""pk{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (spread IS NOT NULL) DESC, coalesce(spread, 0) DESC, ev DESC) AS rn FROM st{i - 1}) x WHERE rn = 1)"""
        )
        ctes.append(
            f"""st{i} AS (SELECT s.grp, s.id, s.leaf, s.ev, least(s.spread, (SELECT {_DIST} FROM lt a, lt b WHERE a.leaf = s.leaf AND b.leaf = p.leaf)) AS spread
              FROM st{i - 1} s JOIN pk{i} p ON p.grp = s.grp AND p.id <> s.id)"""
        )
    union = " UNION ALL ".join(f"SELECT grp, id, {i} AS rank, spread FROM pk{i}" for i in range(1, steps + 1))
    return ", ".join(ctes) + f", panel AS ({union})"


_GROUPED = f"""
base AS (SELECT a.*, {_QUALITY} AS quality, CASE WHEN strpos(taxonomy, ';s__') > 0 THEN regexp_replace(lower(split_part(taxonomy, ';s__', 2)), '[^a-z0-9]+', '', 'g') END AS sk, c.clade
   FROM (SELECT *, {_FLAGS} AS fl FROM {{assessed}}) a LEFT JOIN clades c ON c.node_id = a.leaf),
gr AS (SELECT *, CASE WHEN sk IS NOT NULL THEN concat('species:', sk) ELSE concat('local:', coalesce(clade, 'no_tree_context'), '|',
     CASE WHEN taxonomy = 'NA' THEN 'unclassified' ELSE concat('g:', lower(split_part(taxonomy, 'g__', 2))) END) END AS grp FROM base),
hd AS (SELECT grp, greatest(max(priority_count) + max(secondary_count) + max(selected_count) + max(pending_count), count(*) FILTER (available OR selected)) AS committed,
   CASE WHEN bool_or(sk IS NOT NULL) AND max(priority_count) > 0 THEN 'PRIORITY_BASELINE_EXTENSION' WHEN bool_or(sk IS NOT NULL) AND max(secondary_count) > 0 THEN 'SECONDARY_BASELINE_EXTENSION'
     ELSE 'CANDIDATE_ONLY_GROUP' END AS group_type FROM gr GROUP BY grp),
b1 AS (SELECT gr.*, committed, greatest(0, 9 - committed) AS gap, group_type, group_type <> 'CANDIDATE_ONLY_GROUP' AS ext,
    CASE WHEN priority_taxonomy LIKE '%s___%' AND priority_taxonomy NOT LIKE '%s\\_\\_' ESCAPE '\\' THEN regexp_replace(lower(regexp_extract(priority_taxonomy, '(^|;)s__(.*)$', 2)), '[^a-z0-9]+', '', 'g') END AS psk0,
    CASE WHEN strpos(secondary_taxonomy, ';s__') > 0 THEN regexp_replace(lower(split_part(secondary_taxonomy, ';s__', 2)), '[^a-z0-9]+', '', 'g') END AS ssk FROM gr JOIN hd USING (grp)),
b2 AS (SELECT *, nullif(psk0, '') AS psk, CASE WHEN priority_hit IS NULL AND secondary_hit IS NULL THEN coalesce(nearest_identity >= 99.8 AND nearest_query_coverage >= 95, false)
     ELSE coalesce(priority_hit IS NOT NULL AND priority_identity >= 99.8 AND priority_coverage >= 95, false) OR coalesce(secondary_hit IS NOT NULL AND secondary_identity >= 99.8 AND secondary_coverage >= 95, false) END AS redundant FROM b1),
b3 AS (SELECT *,
   CASE WHEN priority_hit IS NULL THEN NULL WHEN psk IS NULL THEN 'PRIORITY_BASELINE_SPECIES_UNRESOLVED' WHEN psk <> sk THEN 'PRIORITY_BASELINE_SPECIES_MISMATCH'
     WHEN coalesce(priority_identity < 98.65, true) THEN 'PRIORITY_BASELINE_IDENTITY_BELOW_EXTENSION_THRESHOLD' WHEN coalesce(priority_coverage < 95, true) THEN 'PRIORITY_BASELINE_COVERAGE_BELOW_EXTENSION_THRESHOLD'
     ELSE 'ELIGIBLE_PRIORITY_BASELINE_EXTENSION' END AS pv,
   CASE WHEN secondary_hit IS NULL THEN NULL WHEN ssk IS NULL THEN 'SECONDARY_BASELINE_SPECIES_UNRESOLVED' WHEN ssk <> sk THEN 'SECONDARY_BASELINE_SPECIES_MISMATCH'
     WHEN coalesce(secondary_identity < 98.65, true) THEN 'SECONDARY_BASELINE_IDENTITY_BELOW_EXTENSION_THRESHOLD' WHEN coalesce(secondary_coverage < 95, true) THEN 'SECONDARY_BASELINE_COVERAGE_BELOW_EXTENSION_THRESHOLD'
     ELSE 'ELIGIBLE_SECONDARY_BASELINE_EXTENSION' END AS sv FROM b2),
b4 AS (SELECT *, CASE WHEN NOT ext THEN 'NOT_APPLICABLE_CANDIDATE_GROUP' WHEN sk IS NULL THEN 'CANDIDATE_SPECIES_UNRESOLVED' WHEN pv IS NULL AND sv IS NULL THEN 'BASELINE_HIT_UNAVAILABLE'
     WHEN pv LIKE 'ELIG%' THEN pv WHEN sv LIKE 'ELIG%' THEN sv ELSE coalesce(pv, sv) END AS extension_status FROM b3),
b5 AS (SELECT *, redundant AND ext AND extension_status LIKE 'ELIG%' AND gap > 0 AS retained FROM b4),
gate AS (SELECT *, CASE WHEN available THEN 'SEQUENCED' WHEN selected THEN 'COMMITTED' WHEN quality = 'LOW' THEN 'REVIEW_EVIDENCE' WHEN redundant AND NOT retained THEN 'BASELINE_REDUNDANT'
     WHEN ext AND extension_status NOT LIKE 'ELIG%' THEN 'PANGENOME_BOUNDARY_REVIEW' ELSE 'ELIGIBLE' END AS gate FROM b5)"""


@query(
    "diversity_panel",
    f"""
WITH {_CTX}, {_LEAF_TABLE.strip()},
src AS (SELECT *, concat('n', nation_no) AS grp, {_QUALITY} AS quality FROM (SELECT *, {_FLAGS} AS fl FROM {{assessed}}) z),
cand AS (SELECT grp, id, leaf, {_PANEL_EV} AS ev FROM src WHERE NOT (available OR selected)),
anch AS (SELECT DISTINCT grp, leaf FROM src WHERE available AND seq_no % 4 = 1),
{_panel_sql(3)} SELECT grp, id, rank, round(spread, 6) AS spread FROM panel""",
)
def diversity_panel(spark, sf):
    rows = view(spark, sf, "assessed").withColumns(
        {
            "grp": F.concat(F.lit("n"), F.col("nation_no").cast("string")),
            "quality": scores.evidence_quality(
                "placement_flags", "classification_identity", "classification_confidence", "classification_query_coverage", "taxonomy"
            ),
        }
    )
    pool = rows.filter(~(F.col("available") | F.col("selected"))).select("grp", "id", "leaf", S.panel_evidence().alias("evidence"))
    anchors = rows.filter(F.col("available") & (F.col("seq_no") % 4 == 1)).select("grp", "leaf").distinct()
    return S.diversity_panel(pool, anchors, _closed(spark, sf), size=3)


@query(
    "sequencing_sets",
    f"""
WITH {_CTX}, {_CLADES}, {_LEAF_TABLE.strip()}, {_GROUPED.strip()},
cand AS (SELECT grp, id, leaf, {_PANEL_EV} AS ev FROM gate WHERE gate = 'ELIGIBLE'),
anch AS (SELECT DISTINCT grp, leaf FROM gate WHERE available OR selected),
{_panel_sql(9)}
SELECT g.id, g.grp, g.group_type, cast(g.committed AS bigint) AS committed, cast(g.gap AS bigint) AS gap, g.extension_status,
   concat(CASE WHEN g.group_type = 'CANDIDATE_ONLY_GROUP' THEN 'ISSET' ELSE 'ISEXT' END, '_', upper(substr(sha1(g.grp), 1, 8))) AS set_id,
   CASE WHEN gate <> 'ELIGIBLE' THEN gate WHEN p.rank IS NULL THEN 'ALTERNATE' WHEN gap = 0 THEN 'DIVERSITY_CANDIDATE' WHEN p.rank <= gap THEN 'PRIMARY' ELSE 'BACKUP' END AS role,
   p.rank, round(p.spread, 6) AS spread
FROM gate g LEFT JOIN panel p ON p.grp = g.grp AND p.id = g.id""",
)
def sequencing_sets(spark, sf):
    closed = _closed(spark, sf)
    clades = trees.local_clades(closed, view(spark, sf, "tree_nodes"))
    out = S.sequencing_sets(view(spark, sf, "assessed"), closed, clades)
    return out.select("id", "grp", "group_type", "committed", "gap", "extension_status", "set_id", "role", "rank", "spread")


@query("round_selection")
def round_selection(spark, sf, budget: int = 24):
    closed, nodes = _closed(spark, sf), view(spark, sf, "tree_nodes")
    members = cut_lineage(S.grouped(view(spark, sf, "assessed"), trees.local_clades(closed, nodes)))
    header = S.group_header(members)
    rows = S.gated(members, header, include_moderate=False).filter("gate = 'ELIGIBLE'")
    anchors = members.filter(F.col("available") | F.col("selected")).select("grp", "leaf")
    counts = header.select("grp", F.col("committed").alias("count0"))
    return S.budgeted_round(rows, anchors, counts, closed, budget)
