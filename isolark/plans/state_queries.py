"""Registered queries on project state, ledgers and cumulative reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from isolark.functions import identifiers as I, scores
from isolark.operators import collection as C, reporting as R, state as S
from isolark.plans.bindings import view
from isolark.registry import query

_STATE = """CASE lower(word) WHEN 'received' THEN 'RECEIVED' WHEN 'trace-review' THEN 'TRACE_REVIEW' WHEN 'approved' THEN 'SAB_APPROVED' WHEN 'dna pending' THEN 'DNA_EXTRACTION_PENDING'
   WHEN 'proposed' THEN 'PROPOSED' WHEN 'qc_passed' THEN 'GENOME_QC_PASSED' END"""
_SNAP = "decision string, gap int, role string"


@query(
    "status_events",
    f"""
WITH ok AS (SELECT *, {_STATE} AS status FROM {{status_updates}} WHERE id LIKE 'C%' AND id IN (SELECT id FROM {{taxa}}) AND {_STATE} IS NOT NULL),
e AS (SELECT id, line, ts, status, detail, lag(status) OVER (PARTITION BY id ORDER BY ts, line) AS old_status FROM ok)
SELECT id, line, old_status, status, detail FROM e WHERE old_status IS DISTINCT FROM status OR detail <> ''""",
)
def status_events(spark, sf):
    events, _ = S.status_import(view(spark, sf, "status_updates"), view(spark, sf, "taxa"))
    return events.select("id", "line", "old_status", "status", "detail")


@query(
    "status_import",
    f"""
SELECT line, id, word, CASE WHEN id NOT IN (SELECT id FROM {{taxa}}) THEN 'unknown id' ELSE 'unknown status' END AS reason
FROM {{status_updates}} WHERE id NOT IN (SELECT id FROM {{taxa}}) OR {_STATE} IS NULL""",
)
def status_import(spark, sf):
    return S.status_import(view(spark, sf, "status_updates"), view(spark, sf, "taxa"))[1]


_CURRENT = f"cur AS (SELECT id, arg_max({_STATE}, (ts, line)) AS status FROM {{status_updates}} WHERE {_STATE} IS NOT NULL GROUP BY id)"


@query("status_counts", f"WITH {_CURRENT} SELECT coalesce(status, 'RECEIVED') AS status, count(*) AS isolates FROM {{taxa}} LEFT JOIN cur USING (id) GROUP BY 1")
def status_counts(spark, sf):
    current = S.current_status(view(spark, sf, "status_updates"))
    rows = view(spark, sf, "taxa").select("id").join(current, "id", "left")
    return rows.groupBy(F.coalesce("status", F.lit("RECEIVED")).alias("status")).agg(F.count(F.lit(1)).alias("isolates"))


@query(
    "proposal_transition",
    f"""
WITH {_CURRENT}
SELECT id, 'PROPOSED' AS status FROM {{ledger}} WHERE selected AND id NOT IN (SELECT id FROM cur WHERE status NOT IN ('RECEIVED', 'TRACE_REVIEW', 'PROPOSED'))""",
)
def proposal_transition(spark, sf):
    proposals = view(spark, sf, "ledger").filter("selected").select("id")
    return S.proposal_transition(proposals, S.current_status(view(spark, sf, "status_updates")))


@query(
    "latest_assessment",
    """
WITH ok AS (SELECT s.* FROM {snapshots} s LEFT JOIN {roles} r ON r.dataset = s.dataset LEFT JOIN {taxa} t ON t.id = s.sequence_id
   WHERE (r.role IS DISTINCT FROM 'candidate' OR t.dataset = s.dataset) AND payload NOT LIKE '%broken'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY created_at DESC, entry DESC) rn FROM ok) x WHERE rn = 1)
SELECT sequence_id, snapshot_id, dataset, payload->>'decision' AS decision, cast(payload->>'gap' AS int) AS gap, payload->>'role' AS role FROM l""",
)
def latest_assessment(spark, sf):
    return S.latest_assessment(view(spark, sf, "snapshots"), view(spark, sf, "roles"), view(spark, sf, "taxa"), _SNAP)


@query(
    "decision_changes",
    """
WITH ids AS (SELECT snapshot_id, row_number() OVER (ORDER BY max((created_at, entry)) DESC) AS k FROM {snapshots} GROUP BY 1),
p AS (SELECT * FROM (SELECT s.*, k, row_number() OVER (PARTITION BY snapshot_id, sequence_id ORDER BY created_at DESC, entry DESC) rn FROM {snapshots} s JOIN ids USING (snapshot_id) WHERE k <= 2) x WHERE rn = 1),
v AS (SELECT sequence_id, k, CASE WHEN payload LIKE '%broken' THEN NULL ELSE payload END AS j FROM p),
o AS (SELECT sequence_id, true AS h, j->>'decision' AS d, j->>'gap' AS g, j->>'role' AS r FROM v WHERE k = 2), n AS (SELECT sequence_id, true AS h, j->>'decision' AS d, j->>'gap' AS g, j->>'role' AS r FROM v WHERE k = 1),
b AS (SELECT coalesce(o.sequence_id, n.sequence_id) AS sequence_id, coalesce(o.d, CASE WHEN o.h THEN 'NA' ELSE 'NOT_ASSESSED' END) AS od, coalesce(n.d, CASE WHEN n.h THEN 'NA' ELSE 'NOT_ASSESSED' END) AS nd,
   coalesce(o.g, 'NA') AS og, coalesce(n.g, 'NA') AS ng, coalesce(o.r, 'NA') AS orr, coalesce(n.r, 'NA') AS nr FROM o FULL JOIN n ON o.sequence_id = n.sequence_id)
SELECT sequence_id, od AS previous_decision, nd AS current_decision, od <> nd AS decision_changed,
  coalesce(nullif(concat_ws('; ', CASE WHEN orr <> nr THEN concat('set role: ', orr, ' -> ', nr) END, CASE WHEN og <> ng THEN concat('pangenome gap: ', og, ' -> ', ng) END), ''), 'recalculation did not change tracked evidence') AS change_reason
FROM b""",
)
def decision_changes(spark, sf):
    return S.decision_changes(view(spark, sf, "snapshots"), _SNAP)


@query(
    "ledger_validation",
    """
WITH nm AS (SELECT *, concat_ws(chr(31), lower(partner), lower(genome), lower(selection)) AS sg FROM {ledger_rows} WHERE trim(sequence_id) <> ''),
f AS (SELECT sequence_id, min(line) AS fl, arg_min(sg, line) AS fs FROM nm GROUP BY 1), j AS (SELECT nm.*, fl, fs FROM nm JOIN f USING (sequence_id))
SELECT line, sequence_id, CASE WHEN sg = fs THEN 'DUPLICATE_METADATA_ID' ELSE 'CONFLICTING_METADATA_ID' END AS code, 'ERROR' AS severity FROM j WHERE line <> fl
UNION ALL SELECT line, sequence_id, 'MISSING_PARTNER_ID', 'ERROR' FROM j WHERE line = fl AND partner = ''
UNION ALL SELECT line, sequence_id, CASE WHEN genome = '' THEN 'MISSING_GENOME_STATUS' ELSE 'INVALID_GENOME_STATUS' END, 'ERROR' FROM j WHERE line = fl AND genome NOT IN ('Yes', 'no', 'N')
UNION ALL SELECT line, sequence_id, 'INVALID_SELECTION_STATUS', 'ERROR' FROM j WHERE line = fl AND selection = 'perhaps'
UNION ALL SELECT line, sequence_id, 'PARTNER_ID_MISMATCH', 'ERROR' FROM j WHERE line = fl AND partner NOT IN ('', 'p0')
UNION ALL SELECT NULL, id, 'MISSING_PARTNER_METADATA_ROW', 'ERROR' FROM {seqs} WHERE id NOT IN (SELECT sequence_id FROM j)""",
)
def ledger_validation(spark, sf):
    return S.ledger_validation(view(spark, sf, "ledger_rows"), view(spark, sf, "seqs"), expected_partner="P0")


@query(
    "ledger_gaps",
    """
WITH l AS (SELECT DISTINCT sequence_id AS id FROM {ledger_rows} WHERE sequence_id <> '')
SELECT id, 'sequence without ledger row' AS side FROM {seqs} WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, 'ledger row without sequence' FROM l WHERE id NOT IN (SELECT id FROM {seqs})""",
)
def ledger_gaps(spark, sf):
    seqs = view(spark, sf, "seqs").select("id")
    rows = view(spark, sf, "ledger_rows").filter("sequence_id <> ''").select(F.col("sequence_id").alias("id")).distinct()
    left = seqs.join(rows, "id", "left_anti").withColumn("side", F.lit("sequence without ledger row"))
    return left.unionByName(rows.join(seqs, "id", "left_anti").withColumn("side", F.lit("ledger row without sequence")))


_GENOME = """
g AS (SELECT p.*, CASE lower(CASE WHEN trim(status) = '' THEN 'sequenced' ELSE status END) WHEN 'sequenced' THEN 'SEQUENCED' WHEN 'genome qc passed' THEN 'GENOME_QC_PASSED' WHEN 'qc-failed' THEN 'GENOME_QC_FAILED' WHEN 'withdrawn' THEN 'WITHDRAWN' END AS state,
   try_cast(nullif(completeness, 'NA') AS double) AS comp, try_cast(nullif(contamination, '') AS double) AS cont, CASE qc_pass WHEN 'pass' THEN true WHEN 'no' THEN false END AS ex FROM {genome_rows} p),
g2 AS (SELECT *, comp IS NOT NULL AND cont IS NOT NULL AS met, coalesce(comp >= 90 AND cont <= 5, false) AS ok FROM g),
g3 AS (SELECT *, ex IS NULL AND state = 'SEQUENCED' AND met AS auto FROM g2),
g4 AS (SELECT *, CASE WHEN auto THEN CASE WHEN ok THEN 'GENOME_QC_PASSED' ELSE 'GENOME_QC_FAILED' END ELSE state END AS fs, CASE WHEN auto THEN ok ELSE coalesce(ex, state = 'GENOME_QC_PASSED') END AS pass FROM g3),
g5 AS (SELECT *, CASE WHEN trim(sequence_id) = '' THEN 'missing sequence_id' WHEN sequence_id NOT IN (SELECT id FROM {taxa}) THEN 'unknown sequence_id' WHEN trim(genome_id) = '' THEN 'missing genome_id'
   WHEN state = 'WITHDRAWN' THEN 'status not allowed' WHEN fs = 'GENOME_QC_FAILED' AND pass OR fs = 'GENOME_QC_PASSED' AND NOT pass THEN 'status conflicts with qc flag' WHEN pass AND met AND NOT ok THEN 'qc pass conflicts with metrics' END AS reason FROM g4)"""


@query(
    "genome_import",
    f"""
WITH {_GENOME.strip()}
SELECT line, sequence_id, genome_id, CASE WHEN reason IS NULL THEN 'IMPORTED' ELSE 'REJECTED' END AS result, reason, CASE WHEN reason IS NULL THEN fs END AS genome_status,
  CASE WHEN reason IS NULL THEN pass END AS genome_qc_pass, ani_cluster, genome_taxonomy FROM g5""",
)
def genome_import(spark, sf):
    return S.genome_import(view(spark, sf, "genome_rows"), view(spark, sf, "taxa"))


@query(
    "genome_feedback",
    f"""
WITH {_GENOME.strip()},
k AS (SELECT g5.*, CASE WHEN genome_taxonomy <> '' THEN genome_taxonomy ELSE t.taxonomy END AS tx FROM g5 LEFT JOIN {{taxa}} t ON t.id = sequence_id WHERE reason IS NULL AND pass)
SELECT DISTINCT regexp_replace(lower(split_part(tx, ';s__', 2)), '[^a-z0-9]+', '', 'g') AS species_key, sequence_id, nullif(ani_cluster, '') AS ani_cluster FROM k WHERE strpos(tx, ';s__') > 0""",
)
def genome_feedback(spark, sf):
    return S.genome_feedback(genome_import(spark, sf), view(spark, sf, "taxa"))


@query(
    "removal_plan",
    f"""
WITH {_GENOME.strip()},
n AS (SELECT sequence_id, count(*) AS n FROM g5 WHERE reason IS NULL GROUP BY 1),
q AS (SELECT line, trim(requested_id) AS requested_id, min(line) OVER (PARTITION BY trim(requested_id)) AS fl FROM {{removal_requests}})
SELECT line, requested_id, CASE WHEN requested_id = '' THEN 'INVALID_REQUEST' WHEN t.id IS NULL THEN 'NOT_FOUND' WHEN line <> fl THEN 'DUPLICATE_REQUEST' WHEN r.role = 'baseline' THEN 'BLOCKED_BASELINE'
   WHEN coalesce(l.available, false) OR coalesce(n.n, 0) > 0 THEN 'BLOCKED_GENOME_RECORD' ELSE 'READY' END AS status, coalesce(n.n, 0) AS genome_records
FROM q LEFT JOIN {{taxa}} t ON t.id = q.requested_id LEFT JOIN {{roles}} r ON r.dataset = t.dataset LEFT JOIN {{ledger}} l ON l.id = t.id LEFT JOIN n ON n.sequence_id = q.requested_id""",
)
def removal_plan(spark, sf):
    accepted = genome_import(spark, sf).filter("result = 'IMPORTED'")
    return S.removal_plan(view(spark, sf, "removal_requests"), view(spark, sf, "taxa"), view(spark, sf, "roles"), view(spark, sf, "ledger"), accepted)


@query(
    "marker_flag",
    """
WITH r AS (SELECT sequence_id, CASE lower(decision) WHEN 'accept' THEN 'APPROVED' WHEN 'approved' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' ELSE 'NOT_REVIEWED' END AS review FROM {marker_reviews})
SELECT t.id, q.qc_class, coalesce(r.review, 'NOT_REVIEWED') AS review, CASE WHEN q.qc_class IS NULL THEN 'MARKER_QC_UNVERIFIED' WHEN q.qc_class = 'FAIL_QC' OR r.review = 'REJECTED' THEN 'MARKER_QC_FAILED'
  WHEN q.qc_class = 'PASS_HIGH_CONFIDENCE' THEN '' WHEN r.review = 'APPROVED' THEN 'MARKER_QC_REVIEW_APPROVED' ELSE 'MARKER_QC_REVIEW_REQUIRED' END AS flag
FROM {taxa} t LEFT JOIN {marker_qc} q ON q.sequence_id = t.id LEFT JOIN r ON r.sequence_id = t.id""",
)
def marker_flag(spark, sf):
    return S.marker_flag(view(spark, sf, "taxa"), view(spark, sf, "marker_qc"), view(spark, sf, "marker_reviews"))


_SUPPLIER = r"""
fk AS (SELECT regexp_replace(regexp_replace(lower(list_extract(string_split(path, '/'), -1)), '\.(ab1|abi)$', ''), '[-_](f|r|forward|reverse)$', '') AS k, path, embedded_primer FROM {read_files}),
ix AS (SELECT k, count(*) AS n, min((path, embedded_primer)) AS f FROM fk GROUP BY 1),
s0 AS (SELECT r.*, regexp_replace(lower(supplier_id), '[-_](f|r|forward|reverse)$', '') AS k FROM {supplier_rows} r),
s1 AS (SELECT s0.*, ix.n, ix.f[1] AS path0, coalesce(ix.f[2], '') AS emb, min(line) FILTER (n = 1 AND sequence_id <> '') OVER (PARTITION BY s0.k) AS claim FROM s0 LEFT JOIN ix ON ix.k = s0.k),
s2 AS (SELECT *, CASE lower(direction) WHEN 'fwd' THEN 'forward' WHEN 'reverse' THEN 'reverse' ELSE CASE WHEN primer LIKE '%R' THEN 'reverse' WHEN primer LIKE '%F' THEN 'forward' END END AS dir,
   CASE WHEN sequence_id = '' THEN 'MISSING_SEQUENCE_ID' WHEN n IS NULL THEN 'READ_FILE_NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS_READ_FILE' WHEN line <> claim THEN 'READ_FILE_MULTIPLE_ASSIGNMENTS' END AS problem FROM s1),
s3 AS (SELECT *, CASE WHEN primer <> '' THEN primer WHEN emb <> '' THEN emb WHEN dir = 'reverse' THEN '907R' ELSE 'unknown' END AS pr,
   CASE WHEN primer <> '' THEN 'supplied_by_metadata' WHEN emb <> '' THEN 'embedded_in_abif' WHEN dir = 'reverse' THEN 'configured_for_batch' ELSE 'unresolved' END AS src FROM s2),
rec AS (SELECT line, sequence_id, supplier_id, CASE WHEN problem IS NULL THEN path0 END AS path, dir AS direction, CASE WHEN problem IS NULL THEN pr END AS primer, CASE WHEN problem IS NULL THEN src END AS primer_assignment,
   concat_ws(';', problem, CASE WHEN sequence_id <> '' AND dir IS NULL THEN 'MISSING_DIRECTION' END, CASE WHEN problem IS NULL AND src = 'unresolved' THEN 'UNRESOLVED_PRIMER' END,
     CASE WHEN problem IS NULL AND ((pr LIKE '%R' AND dir = 'forward') OR (pr LIKE '%F' AND dir = 'reverse')) THEN 'PRIMER_DIRECTION_CONFLICT' END) AS issues FROM s3)"""


@query("supplier_reconcile", f"WITH {_SUPPLIER.strip()} SELECT * FROM rec")
def supplier_reconcile(spark, sf):
    return S.supplier_reconcile(view(spark, sf, "supplier_rows"), view(spark, sf, "read_files"), reverse_primer="907R")


@query(
    "intake_status",
    f"""
WITH {_SUPPLIER.strip()},
a AS (SELECT cast(sum(len(list_filter(string_split(issues, ';'), lambda c: c <> '' AND c <> 'UNRESOLVED_PRIMER'))) AS bigint) AS errors, count(*) FILTER (primer_assignment = 'unresolved') AS unresolved_primers, count(path) AS mapped_reads, count(DISTINCT nullif(sequence_id, '')) AS isolates FROM rec)
SELECT *, CASE WHEN errors > 0 THEN 'FAIL' WHEN unresolved_primers > 0 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS status FROM a""",
)
def intake_status(spark, sf):
    return S.intake_status(supplier_reconcile(spark, sf))


@query("first_wins_union", "SELECT id, arg_min(dataset, prio) AS dataset, arg_min(n, prio) AS n FROM (SELECT id, dataset, length AS n, 0 AS prio FROM {seqs} WHERE seq_no % 3 = 0 UNION ALL SELECT id, 'second', -1, 1 FROM {seqs} WHERE seq_no % 2 = 0) x GROUP BY id")
def first_wins_union(spark, sf):
    seqs = view(spark, sf, "seqs")
    first = seqs.filter("seq_no % 3 = 0").select("id", "dataset", F.col("length").alias("n"), F.lit(0).alias("prio"))
    second = seqs.filter("seq_no % 2 = 0").select("id", F.lit("second").alias("dataset"), F.lit(-1).alias("n"), F.lit(1).alias("prio"))
    return C.first_wins(first.unionByName(second), ["id"], ["prio"]).drop("prio")


@query("merge_taxonomy", "SELECT coalesce(a.id, b.id) AS id, coalesce(b.taxonomy, a.taxonomy) AS taxonomy FROM (SELECT id, taxonomy FROM {taxa} WHERE seq_no % 3 > 0) a FULL JOIN (SELECT id, concat('d__New;g__', segment) AS taxonomy FROM {taxa} WHERE seq_no % 4 = 0) b ON a.id = b.id")
def merge_taxonomy(spark, sf):
    taxa = view(spark, sf, "taxa").withColumn("dataset", F.lit("all"))
    base = taxa.filter("seq_no % 3 > 0").select("id", "dataset", "taxonomy")
    new = taxa.filter("seq_no % 4 = 0").select("id", "dataset", F.concat(F.lit("d__New;g__"), "segment").alias("taxonomy"))
    return S.upsert(base, new, "taxonomy").select("id", "taxonomy")


@query("id_conflicts", "SELECT a.id, md5(regexp_replace(translate(a.sequence, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ \\t\\n\\v\\f\\r]+', '', 'g')) AS stored FROM {seqs} a WHERE a.seq_no % 6 = 0")
def id_conflicts(spark, sf):
    stored = view(spark, sf, "seqs")
    changed = F.when(F.col("seq_no") % 6 == 0, F.concat("sequence", F.lit("X"))).otherwise(F.concat(F.lit("  "), I.ascii_upper("sequence"), F.lit("\n")))
    return S.id_conflicts(stored, stored.select("id", changed.alias("sequence"))).select("id", "stored")


@query("unique_names", "SELECT doc_id, CASE WHEN k = 1 THEN source ELSE concat(source, '__dup', k - 1) END AS unique_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {documents}) x")
def unique_names(spark, sf):
    return C.unique_names(view(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_name")


@query(
    "project_dataset_summary",
    f"""
WITH {_CURRENT},
a AS (SELECT t.dataset, role, tier, genomes_available, count(*) AS sequences, count(*) FILTER (coalesce(l.available, false)) AS own, count(*) FILTER (c.status = 'PROPOSED') AS proposed
  FROM {{taxa}} t LEFT JOIN {{roles}} r ON r.dataset = t.dataset LEFT JOIN {{ledger}} l ON l.id = t.id LEFT JOIN cur c ON c.id = t.id GROUP BY 1, 2, 3, 4)
SELECT dataset, coalesce(role, 'unregistered') AS role, tier, CASE WHEN genomes_available THEN sequences ELSE own END AS genomes, proposed, sequences FROM a""",
)
def project_dataset_summary(spark, sf):
    return R.dataset_rollup(view(spark, sf, "taxa"), view(spark, sf, "roles"), view(spark, sf, "ledger"), S.current_status(view(spark, sf, "status_updates")))


@query(
    "isolate_ledger",
    f"""
WITH {_CURRENT}
SELECT t.id, t.dataset, coalesce(l.partner_id, '') AS partner_id, coalesce(c.status, 'RECEIVED') AS status, coalesce(q.qc_class, 'UNVERIFIED') AS marker_qc, coalesce(l.selected, false) AS selected, coalesce(l.available, false) AS available
FROM {{taxa}} t LEFT JOIN {{ledger}} l ON l.id = t.id LEFT JOIN cur c ON c.id = t.id LEFT JOIN {{marker_qc}} q ON q.sequence_id = t.id""",
)
def isolate_ledger(spark, sf):
    fill = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return (
        view(spark, sf, "taxa").select("id", "dataset")
        .join(view(spark, sf, "ledger"), "id", "left")
        .join(S.current_status(view(spark, sf, "status_updates")), "id", "left")
        .join(view(spark, sf, "marker_qc").select(F.col("sequence_id").alias("id"), F.col("qc_class").alias("marker_qc")), "id", "left")
        .select("id", "dataset", fill("partner_id", ""), fill("status", "RECEIVED"), fill("marker_qc", "UNVERIFIED"), fill("selected", False), fill("available", False))
    )


@query("merge_rollups", "SELECT dataset, cast(sum(n) AS bigint) AS n FROM (SELECT dataset, count(*) AS n FROM {taxa} GROUP BY 1 UNION ALL SELECT dataset, count(*) FROM {qc_runs} WHERE dataset <> '' GROUP BY 1) x GROUP BY 1")
def merge_rollups(spark, sf):
    staged = view(spark, sf, "qc_runs").filter("dataset <> ''").select("dataset")
    return view(spark, sf, "taxa").select("dataset").unionByName(staged).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query(
    "qc_run_dedupe",
    """
SELECT dataset, signature, manifest, workflow, passed, failed, read_files FROM (SELECT *, row_number() OVER (PARTITION BY dataset, signature
  ORDER BY (workflow = 'interview'), (dataset = ''), passed + failed DESC, read_files DESC, manifest) rn FROM {qc_runs}) x WHERE rn = 1""",
)
def qc_run_dedupe(spark, sf):
    return R.qc_run_dedupe(view(spark, sf, "qc_runs"))


_INV = """round(least(100, least(30, novelty_score * 0.3::double) + least(25, isolation * 25) + CASE WHEN matches_ge_99 = 0 THEN 15 WHEN matches_ge_99 <= 2 THEN 8 ELSE 0 END + CASE WHEN matches_ge_97 <= 3 THEN 10 WHEN matches_ge_97 <= 8 THEN 5 ELSE 0 END
   + CASE WHEN seq_no % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(nearest_identity, 100) < 90 THEN 10 WHEN coalesce(nearest_identity, 100) < 95 THEN 7 WHEN coalesce(nearest_identity, 100) < 97 THEN 4 ELSE 0 END), 2)"""
_INV_DEC = "cast(round(cast(cast(" + _INV[len("round("):-len(", 2)")] + " AS varchar) AS decimal(28,14)), 2) AS double)"


def _assessed(spark, sf):
    conflict = F.col("seq_no") % 5 == 0
    inv = R.investigation_score("novelty_score", "isolation", "matches_ge_97", "matches_ge_99", conflict, "nearest_identity")
    return view(spark, sf, "assessed").withColumns({"investigation": inv, "cluster": F.concat(F.lit("K"), (F.col("seq_no") % 97).cast("string"))})


@query("investigation_score", f"SELECT id, {_INV_DEC} AS investigation FROM {{assessed}}")
def investigation_score(spark, sf):
    return _assessed(spark, sf).select("id", "investigation")


_CL = f"cl AS (SELECT *, {_INV_DEC} AS investigation, concat('K', seq_no % 97) AS cluster, CASE seq_no % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS priority FROM {{assessed}})"


@query(
    "taxonomy_consensus",
    f"""
WITH {_CL}, c AS (SELECT cluster, taxonomy, count(*) AS n FROM cl WHERE taxonomy <> 'NA' GROUP BY 1, 2),
x AS (SELECT cluster, arg_min(taxonomy, (-n, taxonomy)) AS consensus, max(n) / sum(n) AS share FROM c GROUP BY 1)
SELECT cluster, consensus, round(share, 3) AS agreement, CASE WHEN share = 1 THEN 'unanimous' WHEN share >= 0.5 THEN 'majority' ELSE 'mixed' END AS mode FROM x""",
)
def taxonomy_consensus(spark, sf):
    return R.taxonomy_consensus(_assessed(spark, sf), "cluster")


@query(
    "cluster_summary",
    f"""
WITH {_CL}, fl AS (SELECT cluster, string_agg(DISTINCT f, ';' ORDER BY f) AS flags FROM (SELECT cluster, trim(unnest(string_split(upper(placement_flags), ';'))) AS f FROM cl) y WHERE f <> '' GROUP BY 1)
SELECT cluster, count(*) AS size, round(avg(novelty_score), 3) AS mean_novelty, max(novelty_score) AS max_novelty, min(nearest_identity) AS min_nearest, round(avg(nearest_identity), 3) AS mean_nearest,
  round(avg(matches_ge_97), 3) AS mean_ge_97, min(matches_ge_97) AS min_ge_97, round(avg(isolation), 4) AS mean_isolation, arg_min(priority, CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS best_priority,
  max(investigation) AS investigation, coalesce(max(flags), '') AS flags FROM cl LEFT JOIN fl USING (cluster) GROUP BY cluster""",
)
def cluster_summary(spark, sf):
    rows = _assessed(spark, sf).withColumns(
        {"priority": F.when(F.col("seq_no") % 3 == 0, "LOW").when(F.col("seq_no") % 3 == 1, "MEDIUM").otherwise("HIGH"), "flags": scores.flag_list("placement_flags")}
    )
    return R.cluster_summary(rows).drop("consensus", "agreement", "mode")


@query(
    "backup_candidates",
    f"""
WITH {_CL}, r AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY investigation DESC, id) - 1 AS k FROM cl)
SELECT cluster, max(id) FILTER (k = 0) AS head, max(id) FILTER (k = 1) AS backup_1, max(id) FILTER (k = 2) AS backup_2, max(id) FILTER (k = 3) AS backup_3, max(id) FILTER (k = 4) AS backup_4, max(id) FILTER (k = 5) AS backup_5 FROM r WHERE k <= 5 GROUP BY 1""",
)
def backup_candidates(spark, sf):
    return R.backup_candidates(_assessed(spark, sf))


@query(
    "metadata_rarity",
    """
WITH l AS (SELECT id, field, value, regexp_replace(lower(trim(value)), ' +', ' ', 'g') AS nv FROM (UNPIVOT (SELECT id, host, country, site FROM {attributes}) ON host, country, site INTO NAME field VALUE value) u WHERE lower(trim(value)) NOT IN ('', 'na', 'none')),
c AS (SELECT field, nv, count(*) AS n, min(value) AS display FROM l GROUP BY 1, 2), t AS (SELECT field, sum(n) AS total FROM c GROUP BY 1),
s AS (SELECT c.field, nv, display, n, cast(total AS bigint) AS total, CASE WHEN total > 1 AND n < total THEN cast(round(cast(cast(100.0::double * (total - n) / (total - 1) AS varchar) AS decimal(28,14)), 2) AS double) ELSE 0 END AS score FROM c JOIN t USING (field)),
h AS (SELECT l.id, s.score, s.field, concat(s.field, '=', display, ' (', n, '/', total, ')') AS txt, row_number() OVER (PARTITION BY id ORDER BY score DESC, s.field DESC) AS k FROM l JOIN s ON s.field = l.field AND s.nv = l.nv WHERE score > 0)
SELECT id, max(score) AS score, count(*) FILTER (score >= 60) AS informative_fields, CASE WHEN max(score) >= 90 OR count(*) FILTER (score >= 60) >= 2 THEN 'HIGH' WHEN max(score) >= 60 THEN 'MODERATE' ELSE 'LOW' END AS strength,
  string_agg(txt, '; ' ORDER BY k) FILTER (k <= 2) AS reason FROM h GROUP BY id""",
)
def metadata_rarity(spark, sf):
    return R.metadata_rarity(view(spark, sf, "attributes"), "id", ["host", "country", "site"])


@query(
    "attribute_typing",
    """
WITH l AS (SELECT field, lower(trim(value)) AS v FROM (UNPIVOT (SELECT id, host, site, cultured, depth FROM {attributes}) ON host, site, cultured, depth INTO NAME field VALUE value) u WHERE lower(trim(value)) NOT IN ('', 'na')),
a AS (SELECT field, count(*) AS cells, count(DISTINCT v) AS values, bool_and(v IN ('yes', 'no', '0', '1')) AS b, bool_and(try_cast(v AS double) IS NOT NULL) AS n, max(try_cast(v AS double)) AS m FROM l GROUP BY 1)
SELECT field, cells, values, CASE WHEN b THEN 'binary' WHEN n THEN 'numeric' ELSE 'categorical' END AS kind, CASE WHEN NOT b AND n THEN m END AS maximum FROM a""",
)
def attribute_typing(spark, sf):
    return R.attribute_typing(view(spark, sf, "attributes"), "id", ["host", "site", "cultured", "depth"])


@query(
    "guild_assignment",
    """
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'Proteolytic/Peptidolytic' ELSE 'Methanogenic Archaea' END
  WHEN p_partkey % 7 IN (0, 1) THEN 'Proteolytic/Peptidolytic' WHEN p_partkey % 7 = 2 THEN 'Methanogenic Archaea' WHEN p_partkey % 3 = 0 THEN 'Butyrate Producers' WHEN p_partkey % 3 = 2 THEN 'Succinate/Propionate Producers'
  WHEN p_partkey % 4 = 0 THEN 'Butyrate Producers' WHEN p_partkey % 4 = 1 THEN 'Proteolytic/Peptidolytic' WHEN p_partkey % 4 = 2 THEN 'Amylolytic/Starch Degraders' ELSE 'Other / Unclassified' END AS guild FROM {guild_taxa}""",
)
def guild_assignment(spark, sf):
    return R.guild_assignment(view(spark, sf, "guild_taxa")).select("p_partkey", "guild")


_MSA = """(SELECT count(*) FILTER (x IN ('A','C','G','T') AND y IN ('A','C','G','T')) AS compared, count(*) FILTER (x IN ('A','C','G','T') AND x = y) AS same
   FROM (SELECT unnest(string_split(a.aligned, '')) AS x, unnest(string_split(b.aligned, '')) AS y) z)"""


@query(
    "pairwise_identity",
    f"""
SELECT context, left_id, right_id, CASE WHEN compared > 0 THEN round(100.0 * same / compared, 4) END AS identity, compared FROM (
  SELECT a.context, a.id AS left_id, b.id AS right_id, m.* FROM {{aligned}} a JOIN {{aligned}} b ON a.context = b.context AND a.id <= b.id, LATERAL {_MSA} m) q""",
)
def pairwise_identity(spark, sf):
    return R.pairwise_identity(view(spark, sf, "aligned"), "context")


@query(
    "refresh_nearest",
    f"""
SELECT id, hit AS nearest_hit, round(100.0 * same / compared, 4) AS identity, compared FROM (
  SELECT a.id, b.id AS hit, m.* FROM {{aligned}} a JOIN {{aligned}} b ON a.grp = b.grp AND a.id <> b.id AND NOT a.is_anchor AND b.is_anchor, LATERAL {_MSA} m) q
WHERE compared > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY 100.0 * same / compared DESC, compared DESC, hit DESC) = 1""",
)
def refresh_nearest(spark, sf):
    rows = view(spark, sf, "aligned")
    return R.refresh_nearest(rows.filter("not is_anchor").select("grp", "id", "aligned"), rows.filter("is_anchor").select("grp", "id", "aligned"), "grp")


@query(
    "alignment_quality",
    """
WITH a AS (SELECT length(aligned) AS w, length(replace(aligned, '-', '')) AS u, length(aligned) - length(replace(replace(aligned, 'N', ''), 'n', '')) AS n FROM {aligned})
SELECT count(*) AS rows, count(*) FILTER (u < 1200) AS short_rows, count(*) FILTER (n > 0.01 * w) AS high_n_rows, count(*) FILTER (u = 0) AS all_gap_rows, min(u) AS min_ungapped,
  (SELECT u FROM a ORDER BY u LIMIT 1 OFFSET (SELECT count(*) // 2 FROM a)) AS upper_median, count(*) < 3 AS too_few FROM a""",
)
def alignment_quality(spark, sf):
    return R.alignment_quality(view(spark, sf, "aligned"))


_CALLS = "CASE seq_no % 7 WHEN 0 THEN 'chimera' WHEN 1 THEN 'INDETERMINATE' WHEN 2 THEN 'skipped' WHEN 3 THEN 'unheard of' ELSE 'PASS' END"


@query(
    "provenance_flags",
    f"""
WITH r AS (SELECT sequence_id, CASE lower(decision) WHEN 'accept' THEN 'APPROVED' WHEN 'approved' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' ELSE 'NOT_REVIEWED' END AS review FROM {{marker_reviews}}),
m AS (SELECT a.id, a.placement_flags, q.qc_class, coalesce(r.review, 'NOT_REVIEWED') AS review, CASE WHEN q.qc_class IS NULL THEN 'MARKER_QC_UNVERIFIED' WHEN q.qc_class = 'FAIL_QC' OR r.review = 'REJECTED' THEN 'MARKER_QC_FAILED'
  WHEN q.qc_class = 'PASS_HIGH_CONFIDENCE' THEN '' WHEN r.review = 'APPROVED' THEN 'MARKER_QC_REVIEW_APPROVED' ELSE 'MARKER_QC_REVIEW_REQUIRED' END AS mf,
  upper(CASE WHEN seq_no % 5 > 0 THEN {_CALLS} END) AS call, CASE WHEN seq_no % 5 > 0 THEN seq_no % 11 / 2e0 END AS chimera_score
  FROM {{assessment}} a LEFT JOIN {{marker_qc}} q ON q.sequence_id = a.id LEFT JOIN r ON r.sequence_id = a.id),
f AS (SELECT *, CASE coalesce(call, 'NOT_RUN') WHEN 'PASS' THEN '' WHEN 'CHIMERA' THEN 'CHIMERA_DETECTED' WHEN 'INDETERMINATE' THEN 'CHIMERA_INDETERMINATE' WHEN 'SKIPPED' THEN 'CHIMERA_CHECK_SKIPPED' ELSE 'CHIMERA_NOT_RUN' END AS cf,
  list_filter(string_split(coalesce(placement_flags, ''), ';'), lambda x: x <> '') AS held FROM m)
SELECT id, array_to_string(list_concat(held, list_filter([mf, cf], lambda x: x <> '' AND NOT list_contains(held, x))), ';') AS placement_flags, coalesce(qc_class, 'QUALITY_UNVERIFIED') AS marker_qc_class,
  review AS marker_manual_review_status, CASE WHEN mf = '' THEN 'MARKER_QC_PASSED' ELSE mf END AS marker_qc_flag, coalesce(call, 'NOT_RUN') AS chimera_call, chimera_score FROM f""",
)
def provenance_flags(spark, sf):
    assessed = view(spark, sf, "assessment")
    marker = S.marker_flag(assessed, view(spark, sf, "marker_qc"), view(spark, sf, "marker_reviews"))
    chimeras = assessed.filter("seq_no % 5 > 0").select("id", F.expr(_CALLS).alias("call"), (F.col("seq_no") % 11 / 2.0).alias("score"))
    return S.provenance_flags(assessed.select("id", "placement_flags"), marker, chimeras)


@query(
    "project_pool",
    """
WITH s AS (SELECT * FROM {seqs} WHERE length(sequence) > 0), c AS (SELECT dataset FROM {roles} WHERE role = 'candidate'), b AS (SELECT dataset FROM {roles} WHERE role = 'baseline')
SELECT 'registered' AS kind, id, 'project_collection' AS pool FROM s WHERE dataset IN (SELECT dataset FROM c)
UNION ALL SELECT 'baselines only', id, 'project_collection' FROM s WHERE dataset IS NULL OR dataset NOT IN (SELECT dataset FROM b)
UNION ALL SELECT 'nothing left', id, 'reference' FROM s WHERE seq_no % 10 = 0""",
)
def project_pool(spark, sf):
    seqs, roles = view(spark, sf, "seqs"), view(spark, sf, "roles")
    reference = seqs.filter("seq_no % 10 = 0 AND length(sequence) > 0")
    baselines = roles.filter("role = 'baseline'")
    every = seqs.select("dataset").distinct().withColumn("role", F.lit("baseline"))
    kinds = {"registered": roles, "baselines only": baselines, "nothing left": every}
    parts = [C.project_pool(seqs.filter("dataset IS NOT NULL") if kind == "nothing left" else seqs, own, reference).select(F.lit(kind).alias("kind"), "id", "pool") for kind, own in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
