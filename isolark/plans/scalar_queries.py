"""Registered queries for lineage, identifier and filter expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from isolark.functions import identifiers as I, scores, taxonomy as T
from isolark.operators import collection as C, targets
from isolark.plans.bindings import view
from isolark.registry import query

# DuckDB text: lineage parts as (rank, name) rows of view x(id, taxonomy).
_PARTS = """
parts AS (SELECT id, i, CASE WHEN lower(trim(split_part(p, '__', 1))) = 'superkingdom' THEN 'd' ELSE substr(lower(trim(split_part(p, '__', 1))), 1, 1) END AS rank,
     regexp_replace(trim(substr(p, strpos(p, '__') + 2)), '\\s+', ' ', 'g') AS name
  FROM (SELECT id, unnest(string_split(taxonomy, ';')) AS p, unnest(range(len(string_split(taxonomy, ';')))) AS i FROM {taxa}) y WHERE strpos(p, '__') > 0),
lin AS (SELECT id, rank, arg_max(name, i) AS name FROM parts WHERE name <> '' GROUP BY id, rank)"""


@query(
    "lineage_parse",
    f"""
WITH {_PARTS.strip()}
SELECT t.id, max(name) FILTER (rank = 'd') AS d, max(name) FILTER (rank = 'p') AS p, max(name) FILTER (rank = 'c') AS c, max(name) FILTER (rank = 'o') AS o,
  max(name) FILTER (rank = 'f') AS f, max(name) FILTER (rank = 'g') AS g, max(name) FILTER (rank = 's') AS s,
  max(regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) FILTER (rank = 's') AS species_key
FROM {{taxa}} t LEFT JOIN lin USING (id) GROUP BY t.id""",
)
def lineage_parse(spark, sf):
    parsed = view(spark, sf, "taxa").select("id", T.lineage_map("taxonomy").alias("lineage"))
    ranks = [T.rank_value(F.col("lineage"), r).alias(r) for r in T.RANKS]
    return parsed.select("id", *ranks, T.norm_taxon(T.rank_value(F.col("lineage"), "s")).alias("species_key"))


@query(
    "domain_filter",
    """
SELECT id, strpos(taxonomy, 'Archaea') > 0 AS kept, strpos(taxonomy, 'Archaea') > 0 OR taxonomy = 'NA' AS survives_prune FROM {taxa}""",
)
def domain_filter(spark, sf):
    taxa = view(spark, sf, "taxa")
    match = T.domain_matches("taxonomy", "archaeal")
    return taxa.select("id", match.alias("kept"), (match | T.null_text("taxonomy").isNull()).alias("survives_prune"))


@query("domain_pruned", "SELECT id, dataset FROM {taxa} WHERE strpos(taxonomy, 'Bacteria') > 0 OR taxonomy = 'NA'")
def domain_pruned(spark, sf):
    return C.domain_filter(view(spark, sf, "taxa"), "bacterial", prune=True).select("id", "dataset")


@query(
    "taxon_slice",
    """
WITH m AS (SELECT id, taxonomy FROM {taxa} WHERE r_name = 'EUROPE' AND taxonomy <> 'NA')
SELECT * FROM m WHERE (SELECT count(*) FROM m) >= 3""",
)
def taxon_slice(spark, sf):
    return C.taxon_slice(view(spark, sf, "taxa"), "p__Europe").select("id", "taxonomy")


@query(
    "canonical_id",
    r"""
SELECT page_id, raw_id, nullif(regexp_replace(regexp_replace(regexp_replace(list_extract(string_split(list_extract(regexp_split_to_array(trim(raw_id), '\s+'), 1), '|'), -1),
   '#.*$', ''), ':\d+-\d+(\([^)]*\))?$', ''), '^[()\[\]{}]+|[()\[\]{}]+$', '', 'g'), '') AS canonical
FROM {raw_ids}""".replace("[()\\[\\]{}]", "[()\\[\\]\\x7b\\x7d]"),
)
def canonical_id(spark, sf):
    return view(spark, sf, "raw_ids").select("page_id", "raw_id", I.canonical_id("raw_id").alias("canonical"))


_KEYS = r"""
  SELECT {id} AS rid, k, min(pos) AS pos FROM (SELECT {id}, unnest(keys) AS k, unnest(range(len(keys))) AS pos FROM (SELECT {id},
    list_concat([raw_id, tok, canon, list_extract(string_split(tok, '|'), -1), trim(regexp_replace(canon, '[^0-9A-Za-z]+', '_', 'g'), '_')], regexp_split_to_array(tok, '[|_:\-.]+')) AS keys
   FROM (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(list_extract(string_split(tok, '|'), -1), '#.*$', ''), ':\d+-\d+(\([^)]*\))?$', ''), '^[()\[\]]+|[()\[\]]+$', '', 'g'), ''), '') AS canon
     FROM (SELECT *, list_extract(regexp_split_to_array(trim(raw_id), '\s+'), 1) AS tok FROM {src}) a) b) c) d WHERE k <> '' GROUP BY 1, 2"""


@query(
    "key_fallback_join",
    "WITH probe AS (" + _KEYS.replace("{id}", "page_id").replace("{src}", "{raw_ids}") + "),"
    "ref AS (" + _KEYS.replace("{id}", "raw_id").replace("{src}", "(SELECT concat('seq_', page_id) AS raw_id FROM {pages}) r") + "),"
    """
refkey AS (SELECT k, arg_min(rid, (pos, rid)) AS rid FROM ref GROUP BY k),
found AS (SELECT p.rid AS page_id, arg_min(p.k, (p.pos, p.k)) AS matched_key, arg_min(r.rid, (p.pos, p.k)) AS matched_id FROM probe p JOIN refkey r USING (k) GROUP BY 1)
SELECT i.page_id, f.matched_key, f.matched_id FROM {raw_ids} i LEFT JOIN found f USING (page_id)""",
)
def key_fallback_join(spark, sf):
    reference = view(spark, sf, "pages").select(F.concat(F.lit("seq_"), F.col("page_id").cast("string")).alias("ref_id"), F.col("url").alias("val"))
    found = C.resolve_by_keys(view(spark, sf, "raw_ids"), "raw_id", reference, "ref_id", "val")
    return found.select("page_id", "matched_key", "matched_id")


@query(
    "reference_header_parse",
    r"""
SELECT p_partkey, regexp_extract(header, '^(\S+)', 1) AS ref_id,
  CASE WHEN strpos(lineage, 'd__') > 0 THEN lineage END AS taxonomy FROM (SELECT *,
   regexp_replace(trim(regexp_replace(regexp_extract(header, '^\S+\s+(.*)$', 1), '\[.*$', '')), '\s*;\s*', ';', 'g') AS lineage FROM {ref_headers}) x""",
)
def reference_header_parse(spark, sf):
    return view(spark, sf, "ref_headers").select("p_partkey", T.reference_header("header").alias("h")).select("p_partkey", "h.ref_id", "h.taxonomy")


@query(
    "reference_consistency",
    """
WITH a AS (SELECT DISTINCT concat('C', o_custkey) AS key FROM {orders}), b AS (SELECT DISTINCT id AS key FROM {taxa} WHERE taxonomy <> 'NA'),
j AS (SELECT coalesce(a.key, b.key) AS key, a.key IS NOT NULL AS ina, b.key IS NOT NULL AS inb FROM a FULL JOIN b ON a.key = b.key)
SELECT count(*) FILTER (ina) AS left_ids, count(*) FILTER (inb) AS right_ids, count(*) FILTER (ina AND inb) AS shared,
  round(count(*) FILTER (ina AND inb) / greatest(count(*) FILTER (ina), 1), 4) AS overlap, count(*) FILTER (ina AND inb) / greatest(count(*) FILTER (ina), 1) < 0.8 AS warn,
  (SELECT string_agg(key, ';' ORDER BY key) FROM (SELECT key FROM j WHERE NOT inb ORDER BY key LIMIT 25) x) AS left_only,
  (SELECT coalesce(string_agg(key, ';' ORDER BY key), '') FROM (SELECT key FROM j WHERE NOT ina ORDER BY key LIMIT 25) x) AS right_only
FROM j""",
)
def reference_consistency(spark, sf):
    left = view(spark, sf, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("key"))
    right = view(spark, sf, "taxa").filter("taxonomy <> 'NA'").select(F.col("id").alias("key"))
    return C.consistency(left, right)


@query(
    "reverse_complement",
    "SELECT id, md5(reverse(translate(sequence, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn'))) AS rc_md5 FROM {seqs}",
)
def reverse_complement(spark, sf):
    return view(spark, sf, "seqs").select("id", F.md5(I.reverse_complement("sequence")).alias("rc_md5"))


_GATE = """
gate AS (SELECT id, seq_no, length(sequence) AS length, n AS n_count, CASE WHEN length(sequence) > 0 THEN 100.0 * n / length(sequence) ELSE 0 END AS pct
  FROM (SELECT *, length(sequence) - length(replace(replace(sequence, 'N', ''), 'n', '')) AS n FROM {seqs}) x)"""


@query(
    "qc_gate",
    f"""
WITH {_GATE.strip()}
SELECT id, length, n_count, round(pct, 6) AS n_percent, concat_ws(';', CASE WHEN length < 800 THEN 'too_short' END, CASE WHEN pct > 5 THEN 'too_many_n' END) AS reasons,
  NOT (length < 800 OR pct > 5) AS kept FROM gate""",
)
def qc_gate(spark, sf):
    return C.qc_gate(view(spark, sf, "seqs")).select("id", "length", "n_count", "n_percent", "reasons", "kept")


@query(
    "qc_totals",
    f"""
WITH {_GATE.strip()}
SELECT count(*) AS total_input, count(*) FILTER (NOT (length < 800 OR pct > 5)) AS kept, count(*) FILTER (length < 800 OR pct > 5) AS rejected_total,
  count(*) FILTER (length < 800) AS rejected_too_short, count(*) FILTER (pct > 5) AS rejected_too_many_n,
  (SELECT coalesce(string_agg(id, ';' ORDER BY seq_no), '') FROM (SELECT * FROM gate WHERE NOT (length < 800 OR pct > 5) ORDER BY seq_no LIMIT 10) y) AS sample_kept FROM gate""",
)
def qc_totals(spark, sf):
    return C.qc_totals(C.qc_gate(view(spark, sf, "seqs")))


@query(
    "dereplicate",
    """
SELECT id, md5(sequence) AS digest, first_value(id) OVER w AS representative, count(*) OVER (PARTITION BY sequence) AS copies, id = first_value(id) OVER w AS is_representative
FROM {seqs} WINDOW w AS (PARTITION BY sequence ORDER BY seq_no)""",
)
def dereplicate(spark, sf):
    return C.dereplicate(view(spark, sf, "seqs"))


@query(
    "stable_set_id",
    "SELECT id, concat('ISEXT_', upper(substr(sha1(concat('species:', id)), 1, 8))) AS set_id, sha256(sequence) AS content_sha FROM {seqs}",
)
def stable_set_id(spark, sf):
    return view(spark, sf, "seqs").select(
        "id",
        I.stable_set_id(F.concat(F.lit("species:"), F.col("id")), F.lit("ISEXT")).alias("set_id"),
        F.sha2("sequence", 256).alias("content_sha"),
    )


@query(
    "short_ids",
    """
WITH v AS (SELECT id, seq_no, cast(concat('0x', substr(md5(concat(sequence, '|0')), 1, 8)) AS bigint) AS v FROM {seqs}),
c AS (SELECT id, seq_no, concat(chr(cast(65 + (v % 17576) // 676 AS int)), chr(cast(65 + (v % 17576) // 26 % 26 AS int)), chr(cast(65 + v % 17576 % 26 AS int)), lpad(cast(v // 4096 % 100 AS varchar), 2, '0')) AS candidate FROM v)
SELECT id, candidate, seq_no = min(seq_no) OVER (PARTITION BY candidate) AS first_claim FROM c""",
)
def short_ids(spark, sf):
    tries = view(spark, sf, "seqs").select("id", "seq_no", I.short_id("sequence", F.lit(0)).alias("candidate"))
    first = tries.groupBy("candidate").agg(F.min("seq_no").alias("first"))
    return tries.join(first, "candidate").select("id", "candidate", (F.col("seq_no") == F.col("first")).alias("first_claim"))


@query("short_ids_unique")
def short_ids_unique(spark, sf):
    headers = view(spark, sf, "seqs").select("seq_no", F.concat_ws("|", "id", "dataset").alias("header"))
    return C.short_ids(headers)


def _hsv(h: str, s: float, v: float) -> str:
    parts = []
    for six in ("vqpptv", "tvvqpp", "pptvvq"):
        cases = " ".join(f"WHEN {i} THEN {ch}" for i, ch in enumerate(six))
        parts.append(f"printf('%02x', cast(floor((CASE sec {cases} END) * 255) AS int))")
    return (
        f"(SELECT concat('#', {', '.join(parts)}) FROM (SELECT sec % 6 AS sec, {v}::double AS v, {v}::double * (1.0::double - {s}::double) AS p,"
        f" {v}::double * (1.0::double - {s}::double * f) AS q, {v}::double * (1.0::double - {s}::double * (1.0::double - f)) AS t"
        f" FROM (SELECT cast(floor(({h}) * 6.0::double) AS int) AS sec, ({h}) * 6.0::double - floor(({h}) * 6.0::double) AS f) a) b)"
    )


_HUE = "(cast(concat('0x', substr(md5({x}), 1, 8)) AS bigint) % 360) / 360.0::double"


@query(
    "label_colours",
    "WITH n AS (SELECT DISTINCT p_name AS name, p_size FROM {part}), h AS (SELECT *, " + _HUE.replace("{x}", "name") + " AS hue, "
    + _HUE.replace("{x}", "concat(name, '_jitter')") + " AS jit FROM n),"
    " k AS (SELECT *, hue + 0.33::double - floor(hue + 0.33::double) AS fam, (floor(hue * 8) % 8 + 0.5::double) / 8 + (jit - 0.5::double) * 0.0625::double AS ds FROM h)"
    " SELECT name, p_size, " + _hsv("hue", 0.65, 0.95) + " AS name_colour, " + _hsv("fam", 0.65, 0.90) + " AS family_colour, "
    + _hsv("ds - floor(ds)", 0.85, 0.92) + " AS dataset_colour, " + _hsv("p_size / 100.0::double * 0.33::double", 0.95, 0.95) + " AS identity_colour FROM k",
)
def label_colours(spark, sf):
    names = view(spark, sf, "part").select(F.col("p_name").alias("name"), "p_size").distinct()
    return names.select(
        "name",
        "p_size",
        I.name_colour("name").alias("name_colour"),
        I.rank_colour("name", "family").alias("family_colour"),
        I.dataset_colour("name").alias("dataset_colour"),
        I.identity_colour(F.col("p_size") / 100.0).alias("identity_colour"),
    )


@query(
    "tolerant_casts",
    """
SELECT event_id, CASE WHEN w IN ('', 'na', 'none') THEN NULL ELSE try_cast(raw AS double) END AS as_double,
  cast(trunc(CASE WHEN w IN ('', 'na', 'none') THEN NULL ELSE try_cast(raw AS double) END) AS int) AS as_int,
  CASE WHEN flag IN ('yes', 'true', '1') THEN true WHEN flag IN ('no', '0') THEN false END AS as_bool
FROM (SELECT event_id, trim(raw) AS raw, lower(trim(raw)) AS w, flag FROM {messy}) x""",
)
def tolerant_casts(spark, sf):
    return view(spark, sf, "messy").select(
        "event_id", I.tolerant_double("raw").alias("as_double"), I.tolerant_int("raw").alias("as_int"), I.tolerant_bool("flag").alias("as_bool")
    )


@query(
    "dataset_roles",
    """
SELECT dataset, role, CASE WHEN tier IN ('priority', 'secondary') THEN tier WHEN strpos(dataset, '7') > 0 THEN 'priority' ELSE 'secondary' END AS inferred_tier FROM {roles}""",
)
def dataset_roles(spark, sf):
    return view(spark, sf, "roles").select("dataset", "role", I.baseline_tier("dataset", "tier", token="7").alias("inferred_tier"))


@query(
    "safe_names",
    r"""
SELECT page_id, substr(trim(regexp_replace(regexp_replace(url, '\.(fasta|fna|fa|tsv|csv|txt)(\.gz)?$', ''), '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 24) AS safe,
  CASE WHEN regexp_matches(raw_id, '[\(\[].*?[\)\]]') THEN trim(regexp_extract(raw_id, '[\(\[](.*?)[\)\]]', 1)) ELSE raw_id END AS bracket
FROM {pages} JOIN {raw_ids} USING (page_id)""",
)
def safe_names(spark, sf):
    return (
        view(spark, sf, "pages")
        .select("page_id", "url")
        .join(view(spark, sf, "raw_ids"), "page_id")
        .select("page_id", I.safe_name("url").alias("safe"), I.bracketed("raw_id").alias("bracket"))
    )


@query("pool_select", "SELECT id, dataset FROM {seqs} WHERE dataset IS DISTINCT FROM 'src3' AND dataset NOT IN ('src4', 'src5') AND length(sequence) > 0")
def pool_select(spark, sf):
    return C.pool_select(view(spark, sf, "seqs"), run_dataset="src3", exclude=["src4", "src5"]).select("id", "dataset")


@query("allow_list", "SELECT id, dataset FROM {seqs} WHERE seq_no IN (SELECT doc_id FROM {labels}) AND id NOT LIKE 'D1%'")
def allow_list(spark, sf):
    ids = view(spark, sf, "labels").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"))
    return C.exclude_anchors(C.allow_list(view(spark, sf, "seqs"), ids), "D1").select("id", "dataset")


@query(
    "alphabet_check",
    r"""
SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(translate(sequence, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTURYSWKMBDHVN.\-]'))), '') AS invalid FROM {seqs}""",
)
def alphabet_check(spark, sf):
    return view(spark, sf, "seqs").select("id", F.array_join(I.foreign_characters("sequence"), "").alias("invalid"))


_QUALITY = """CASE WHEN list_has_any(fl, ['NO_REFERENCE_HIT','NO_CLASSIFICATION','CHIMERA','CHIMERA_CONFIRMED','CHIMERA_DETECTED','CHIMERA_INDETERMINATE','CHIMERA_CHECK_SKIPPED','CHIMERA_NOT_RUN','VERY_SHORT','HIGH_N_CONTENT','MARKER_QC_FAILED','MARKER_QC_REVIEW_REQUIRED','MARKER_QC_UNVERIFIED'])
   OR coalesce(classification_identity < 90, false) OR coalesce(classification_query_coverage < 80, false) OR (classification_identity IS NULL AND taxonomy = 'NA') THEN 'LOW'
  WHEN list_has_any(fl, ['LOW_CLASSIFICATION','LOW_CONFIDENCE','DISAGREEMENT','CONFLICT']) OR coalesce(classification_identity < 95, false)
   OR coalesce(classification_confidence < 0.8, false) OR coalesce(classification_query_coverage < 90, false) THEN 'MODERATE' ELSE 'HIGH' END"""
_FLAGS = "list_transform(string_split(upper(placement_flags), ';'), lambda f: trim(f))"


@query("evidence_quality", f"SELECT id, {_QUALITY} AS evidence_quality FROM (SELECT *, {_FLAGS} AS fl FROM {{assessment}}) x")
def evidence_quality(spark, sf):
    return view(spark, sf, "assessment").select(
        "id",
        scores.evidence_quality(
            "placement_flags", "classification_identity", "classification_confidence", "classification_query_coverage", "taxonomy"
        ).alias("evidence_quality"),
    )


@query(
    "placement_flags",
    """
SELECT id, concat_ws(';', CASE WHEN priority_hit IS NULL OR classification_identity IS NULL OR classification_identity = 0 THEN 'NO_REFERENCE_HIT' END,
  CASE WHEN classification_identity < 95 THEN 'LOW_CLASSIFICATION_IDENTITY' END, CASE WHEN classification_confidence < 0.8 THEN 'LOW_CONFIDENCE' END,
  CASE WHEN classification_query_coverage < 90 THEN 'LOW_QUERY_COVERAGE' END, CASE WHEN nearest_identity < 97 THEN 'LOW_NEAREST_IDENTITY' END,
  CASE WHEN nearest_identity < 97 AND taxonomy <> 'NA' THEN 'NOVEL_BUT_ASSIGNED' END,
  CASE WHEN nearest_identity IS NULL AND taxonomy <> 'NA' THEN 'ASSIGNED_WITHOUT_PLACEMENT_SUPPORT' END) AS flags FROM {assessment}""",
)
def placement_flags(spark, sf):
    flags = scores.placement_flags(
        "priority_hit", "classification_identity", "classification_confidence", "classification_query_coverage", "nearest_identity", F.lit(True), "taxonomy"
    )
    return view(spark, sf, "assessment").select("id", F.array_join(flags, ";").alias("flags"))


_TERMS = r"""
raw AS (SELECT *, regexp_replace(hierarchy, '\([^)]*\)', '', 'g') AS main,
    regexp_replace(array_to_string(regexp_extract_all(hierarchy, '\(([^)]*)\)', 1), ','), '(?i)(^|,)\s*including\s*:?\s*', '\1', 'g') AS inn FROM {target_entries}),
terms AS (SELECT DISTINCT target_id, target_role, rank, regexp_replace(lower(nm), '[^a-z0-9]+', '', 'g') AS name FROM (
  SELECT target_id, target_role, substr(trim(p), 1, 1) AS rank, split_part(p, '__', 2) AS nm FROM (SELECT *, unnest(string_split(main, ';')) AS p FROM raw) a WHERE strpos(p, '__') > 0
  UNION ALL SELECT target_id, target_role, substr(p, 1, 1), substr(p, 4) FROM (SELECT *, unnest(regexp_extract_all(inn, '[dkpcofgs]__[^;,()]+')) AS p FROM raw) b
  UNION ALL SELECT target_id, target_role, '*', p FROM (SELECT *, unnest(string_split(regexp_replace(inn, '[dkpcofgs]__[^;,()]+', ' ', 'g'), ',')) AS p FROM raw) c) d
  WHERE regexp_replace(lower(nm), '[^a-z0-9]+', '', 'g') NOT IN ('', 'including'))"""


@query("target_terms", f"WITH {_TERMS.strip()} SELECT * FROM terms")
def target_terms(spark, sf):
    return targets.target_terms(view(spark, sf, "target_entries"))


_MATCH = f"""{_PARTS.strip()}, {_TERMS.strip()},
dom AS (SELECT target_id, count(*) FILTER (rank NOT IN ('*', 'd', 'k')) = 0 AS only_domain FROM terms GROUP BY 1),
cand AS (SELECT l.id, l.rank, l.name AS taxon, t.target_id, sc AS rank_score, cast(round(cast(cast(round(sc::double * CASE WHEN a.classification_identity IS NULL THEN 1 ELSE least(100, greatest(0, a.classification_identity)) / 100 END, 6) AS varchar) AS decimal(28,14)), 2) AS double) AS target_score
  FROM lin l JOIN (VALUES ('d', 10, 0), ('p', 30, 1), ('c', 45, 2), ('o', 60, 3), ('f', 75, 4), ('g', 90, 5), ('s', 100, 6)) r(rank, sc, pos) ON r.rank = l.rank
  JOIN terms t ON t.name = regexp_replace(lower(l.name), '[^a-z0-9]+', '', 'g') AND t.rank IN (l.rank, '*') JOIN dom USING (target_id) JOIN {{assessment}} a ON a.id = l.id
  WHERE (l.rank = 'd' AND only_domain) OR pos >= 1),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY target_score DESC, rank_score DESC, target_id DESC) rn FROM cand) x WHERE rn = 1)"""


@query("target_match", f"WITH {_MATCH} SELECT id, target_id, rank, taxon, cast(rank_score AS double) AS rank_score, target_score FROM matched")
def target_match(spark, sf):
    rows = view(spark, sf, "assessment").select("id", "taxonomy", F.col("classification_identity").alias("identity"))
    return targets.match_targets(rows, targets.target_terms(view(spark, sf, "target_entries")))


@query(
    "evaluation_score",
    f"""WITH {_MATCH}
SELECT a.id, cast(round(cast(cast(round(least(100, CASE WHEN a.seq_no % 4 = 0 THEN 0.65::double * a.novelty_score + 0.35::double * coalesce(m.target_score, 0)
   ELSE 0.75::double * (a.isolation * 100) + 0.25::double * coalesce(m.target_score, 0) END), 6) AS varchar) AS decimal(28,14)), 2) AS double) AS evaluation_score
FROM {{assessment}} a LEFT JOIN matched m USING (id)""",
)
def evaluation_score(spark, sf):
    rows = view(spark, sf, "assessment")
    found = target_match(spark, sf).select("id", F.col("target_score").alias("matched_score"))
    investigation = F.when(F.col("seq_no") % 4 != 0, F.col("isolation") * 100.0)
    return rows.join(found, "id", "left").select("id", targets.evaluation_score(investigation, "matched_score", "novelty_score").alias("evaluation_score"))


@query(
    "taxonomy_agreement",
    f"""
WITH {_PARTS.strip()},
w AS (SELECT id, max(name) FILTER (rank = 'd') d, max(name) FILTER (rank = 'p') p, max(name) FILTER (rank = 's') s, count(*) n FROM lin GROUP BY id),
x AS (SELECT t.id, w.*, t.seq_no FROM {{taxa}} t LEFT JOIN w ON w.id = t.id),
y AS (SELECT t.id, x.d, x.p, x.s, x.n, o.od, o.op, o.os FROM {{taxa}} t LEFT JOIN w x ON x.id = t.id
   CROSS JOIN (SELECT 'Bacteria' AS od, 'ASIA' AS op, 'BUILDING india' AS os) o),
k AS (SELECT *, regexp_replace(lower(d), '[^a-z0-9]+', '', 'g') AS dk, regexp_replace(lower(p), '[^a-z0-9]+', '', 'g') AS pk, regexp_replace(lower(s), '[^a-z0-9]+', '', 'g') AS sk FROM y)
SELECT id, CASE WHEN n IS NULL THEN NULL WHEN d IS NOT NULL AND dk <> 'bacteria' THEN 'none' WHEN p IS NOT NULL AND pk <> 'asia' THEN 'domain'
   WHEN s IS NOT NULL AND sk = 'buildingindia' THEN 'species' ELSE 'phylum' END AS deepest_shared,
  CASE WHEN n IS NULL THEN NULL WHEN dk <> 'bacteria' THEN concat('domain:', d, '!=Bacteria') WHEN pk <> 'asia' THEN concat('phylum:', p, '!=ASIA')
   WHEN s IS NOT NULL AND sk <> 'buildingindia' THEN concat('species:', s, '!=BUILDING india') ELSE 'none' END AS conflict FROM k""",
)
def taxonomy_agreement(spark, sf):
    other = F.lit("d__Bacteria; p__ASIA; s__BUILDING india")
    compared = view(spark, sf, "taxa").select("id", T.agreement("taxonomy", other).alias("a"))
    return compared.select("id", "a.deepest_shared", "a.conflict")


@query(
    "label_groups",
    r"""
SELECT p_partkey, concat('p__', p_brand, ' ', p_size) AS raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat('Brand_', p_brand, ' ', p_size), '[\s_]+', '_', 'g'), '(_\d+)+$', ''), '(_[A-Za-z])+$', ''), '^$', 'unknown') AS display,
  CASE WHEN strpos(t.taxonomy, ';s__') > 0 THEN concat('s__', split_part(t.taxonomy, ';s__', 2)) ELSE '' END AS terminal
FROM {part} JOIN {target_taxa} t ON t.target = concat('T', p_partkey)""",
)
def label_groups(spark, sf):
    joined = view(spark, sf, "part").join(
        view(spark, sf, "target_taxa").select("target", "taxonomy"), F.col("target") == F.concat(F.lit("T"), F.col("p_partkey").cast("string"))
    )
    return joined.select(
        "p_partkey",
        F.concat(F.lit("p__"), "p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("raw"),
        T.display_name(F.concat(F.lit("Brand_"), "p_brand", F.lit(" "), F.col("p_size").cast("string"))).alias("display"),
        T.terminal_taxon("taxonomy").alias("terminal"),
    )


@query(
    "group_labels",
    f"""
WITH {_PARTS.strip()},
r AS (SELECT t.id, max(name) FILTER (rank = 'p') AS p, max(name) FILTER (rank = 'd') AS d FROM {{taxa}} t LEFT JOIN lin USING (id) GROUP BY t.id)
SELECT id, p AS phylum, CASE WHEN p IN ('MIDDLE EAST') THEN 'MIDDLE_east' WHEN p IN ('ASIA', 'EUROPE') THEN 'Firm' WHEN d = 'Archaea' AND p IS NOT NULL THEN 'Archaea' WHEN p IN ('AFRICA', 'AMERICA') THEN 'africa' ELSE p END AS label FROM r""",
)
def group_labels(spark, sf):
    specs = ["africa, America", "archaea", "", "Firm: asia,EUROPE, not there", "MIDDLE_east"]
    ranks = view(spark, sf, "taxa").select("id", T.rank_of("taxonomy", "p").alias("phylum"), T.rank_of("taxonomy", "d").alias("domain"))
    return ranks.select("id", "phylum", T.group_label("phylum", "domain", specs).alias("label"))


_SPREAD = "CASE WHEN seq_no % 6 > 0 THEN seq_no % 101 / 997e0 END"
_TIER = "CASE seq_no % 4 WHEN 0 THEN 'COVERAGE_GAP' WHEN 1 THEN 'NOVEL_GENOME_NEIGHBOURHOOD' WHEN 2 THEN 'DIVERSITY_EXPANSION' ELSE 'REDUNDANT_EXTENSION' END"
_TOLD = "CASE WHEN seq_no % 3 = 0 THEN concat('rare ', dataset) WHEN seq_no % 3 = 1 THEN '' END"
_SAID = """CASE WHEN spread IS NOT NULL THEN printf('marginal patristic distance %.5f', spread) END, CASE WHEN nearest_identity > 0 THEN printf('nearest cultured baseline %.2f%%', nearest_identity) END, {project}
  CASE WHEN rarity_strength IN ('HIGH', 'MODERATE') THEN concat('diversity metadata ', lower(rarity_strength), ' confidence', CASE WHEN told <> '' THEN concat(' (', told, ')') ELSE '' END) END,
  CASE WHEN coalesce(target_rank, '') NOT IN ('', 'NA', 'None') THEN concat('target ', target_rank, '-level context') END"""
_PROJECT = "CASE WHEN project_nearest_identity > 0 THEN printf('nearest project marker %.2f%%', project_nearest_identity) END,"


@query(
    "reason_texts",
    f"""
WITH r AS (SELECT *, {_SPREAD} AS spread, {_TIER} AS tier, {_TOLD} AS told FROM {{assessment}})
SELECT id, concat_ws('; ', concat('rank ', seq_no % 9), {_SAID.replace("{project}", _PROJECT)}) AS ranking_reason,
  concat_ws('; ', CASE tier WHEN 'COVERAGE_GAP' THEN 'fills remaining 9-genome coverage gap' WHEN 'NOVEL_GENOME_NEIGHBOURHOOD' THEN 'no close genome representation at the 98.65% marker threshold'
    WHEN 'DIVERSITY_EXPANSION' THEN concat('post-target diversity expansion from ', seq_no % 12, ' available genomes') ELSE 'post-target extension despite close existing genome representation' END,
    CASE WHEN reference_nearest_identity > 0 THEN printf('nearest available genome %.2f%% marker identity', reference_nearest_identity) END, {_SAID.replace("{project}", "")}) AS round_reason FROM r""",
)
def reason_texts(spark, sf):
    rows = view(spark, sf, "assessment").withColumns({"spread": F.expr(_SPREAD).cast("double"), "tier": F.expr(_TIER), "told": F.expr(_TOLD), "opening": F.concat(F.lit("rank "), (F.col("seq_no") % 9).cast("string")), "had": F.col("seq_no") % 12})
    shared = ("rarity_strength", "told", "target_rank")
    return rows.select(
        "id", scores.ranking_reason("opening", "spread", "nearest_identity", "project_nearest_identity", *shared).alias("ranking_reason"),
        scores.round_reason("tier", "had", F.lit(scores.GENOME_TARGET), "reference_nearest_identity", "spread", "nearest_identity", *shared).alias("round_reason"),
    )
