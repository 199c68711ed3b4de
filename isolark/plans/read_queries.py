"""Registered queries on read quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from isolark.functions import identifiers as I, quality as Q
from isolark.operators import assembly, reads as R
from isolark.plans.bindings import view
from isolark.registry import query
from isolark.session import cut_lineage, spread

_Q = "list_transform(string_split(quality_text, ''), lambda c: greatest(0, ascii(c) - 33))"
_E = "pow(10.0::double, -q / 10.0::double)"
_ERR = f"list_transform({_Q}, lambda q: {_E})"
_ARR = f"arr AS (SELECT *, string_split(sequence, '') AS bs, {_Q} AS qs FROM {{reads}})"
_WEAK = "list_transform(range(1, len(bs) + 1), lambda i: qs[i] < 20 OR NOT list_contains(['A','C','G','T'], bs[i]))"
_RUN = "coalesce(list_max(list_transform(string_split(array_to_string(list_transform(wk, lambda f: CASE WHEN f THEN 'x' ELSE ' ' END), ''), ' '), lambda s: length(s))), 0)"

# Kadane over exploded positions: restarts are where the prefix sum reaches a new minimum.
_MOTT = """
pos AS (SELECT read_id, i, q, 0.01::double - pow(10.0::double, -q / 10.0::double) AS g FROM (SELECT read_id, unnest(qs) AS q, unnest(range(len(qs))) AS i FROM arr) x),
pre AS (SELECT *, sum(g) OVER (PARTITION BY read_id ORDER BY i) AS s FROM pos),
low AS (SELECT *, coalesce(min((s, -i)) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), (0::double, 1)) AS m FROM pre),
sc AS (SELECT *, s - least(0, m[1]) AS score, CASE WHEN m[1] >= 0 THEN 0 ELSE 1 - m[2] END AS st FROM low),
bst AS (SELECT read_id, arg_max(st, (round(score, 9), -i)) AS b0, arg_max(i, (round(score, 9), -i)) + 1 AS b1, max(score) AS top FROM sc GROUP BY 1),
cutt AS (SELECT a.*, CASE WHEN top > 0 THEN b0 ELSE 0 END AS b0, CASE WHEN top > 0 THEN b1 ELSE 0 END AS b1 FROM arr a JOIN bst USING (read_id)),
mt AS (SELECT *, substr(sequence, b0 + 1, b1 - b0) AS z FROM cutt),
trimmed AS (SELECT *, CASE WHEN length(trim(z, 'N')) > 0 THEN b0 + length(z) - length(ltrim(z, 'N')) ELSE 0 END AS t0, CASE WHEN length(trim(z, 'N')) > 0 THEN b1 - (length(z) - length(rtrim(z, 'N'))) ELSE 0 END AS t1 FROM mt)"""


def _reads(spark, sf):
    return view(spark, sf, "reads").withColumn("qualities", Q.phred_array("quality_text"))


def _prepared(spark, sf, policy=Q.ReadPolicy(min_read_length=100)):
    # A file of texts has few row groups; the reads are spread before the work on their bases.
    rows = spread(view(spark, sf, "reads"), "read_id").withColumn("qualities", Q.phred_array("quality_text"))
    return R.prepare_reads(R.settled(rows), policy)


@query("mott_trim", f"WITH {_ARR}, {_MOTT.strip()} SELECT read_id, t0 AS trim_start, t1 AS trim_end FROM trimmed")
def mott_trim(spark, sf):
    trimmed = _reads(spark, sf).select("read_id", Q.mott_trim("sequence", "qualities").alias("t"))
    return trimmed.select("read_id", F.col("t.start").alias("trim_start"), F.col("t.end").alias("trim_end"))


@query(
    "mask_low_quality",
    f"""
WITH {_ARR}, w AS (SELECT *, {_WEAK} AS wk FROM arr)
SELECT read_id, array_to_string(list_transform(range(1, len(bs) + 1), lambda i: CASE WHEN wk[i] THEN 'N' ELSE bs[i] END), '') AS masked,
  len(list_filter(range(1, len(bs) + 1), lambda i: wk[i] AND (bs[i] <> 'N' OR qs[i] < 20))) AS masked_bases FROM w""",
)
def mask_low_quality(spark, sf):
    rows = _reads(spark, sf).select("read_id", Q.mask_low_quality("sequence", "qualities").alias("m"))
    return rows.select("read_id", F.col("m.sequence").alias("masked"), F.col("m.masked").alias("masked_bases"))


@query("longest_run", f"WITH {_ARR}, w AS (SELECT *, {_WEAK} AS wk FROM arr) SELECT read_id, {_RUN} AS longest FROM w")
def longest_run(spark, sf):
    return _reads(spark, sf).select("read_id", Q.longest_run(Q.weak_flags("sequence", "qualities")).alias("longest"))


@query(
    "expected_errors",
    f"""
WITH {_ARR} SELECT read_id, round(list_sum(list_transform(range(1, len(bs) + 1), lambda i: CASE WHEN list_contains(['A','C','G','T'], bs[i]) THEN pow(10.0::double, -qs[i] / 10.0::double) ELSE 0 END)), 5) AS expected_errors,
  round(list_avg(qs), 4) AS mean_q FROM arr""",
)
def expected_errors(spark, sf):
    return _reads(spark, sf).select(
        "read_id",
        F.round(Q.expected_errors("sequence", "qualities"), 5).alias("expected_errors"),
        F.round(Q.mean_quality("qualities"), 4).alias("mean_q"),
    )


_READ_QC = f"""
WITH {_ARR}, w AS (SELECT *, {_WEAK} AS wk, quality_source NOT IN ('ab1_missing_pcon', 'fasta_quality_unverified') AS ver FROM arr),
m AS (SELECT *, length(sequence) AS n, list_avg(qs) AS mq, list_sum(list_transform(range(1, len(bs) + 1), lambda i: CASE WHEN list_contains(['A','C','G','T'], bs[i]) THEN pow(10.0::double, -qs[i] / 10.0::double) ELSE 0 END)) AS ee,
  100.0::double * (length(sequence) - length(replace(sequence, 'N', ''))) / length(sequence) AS np, {_RUN} AS run FROM w),
r AS (SELECT *, concat_ws(';', CASE WHEN quality_source = 'ab1_missing_pcon' THEN 'quality_scores_missing_ab1_missing_pcon' END, CASE WHEN mixed_peak_percent > 15 THEN 'mixed_peak_percent_gt_15' END, CASE WHEN n < 300 THEN 'trimmed_length_lt_300' END,
    CASE WHEN ver AND n > 0 AND mq < 20 THEN 'mean_q_lt_20' END, CASE WHEN ver AND ee > 8 THEN 'expected_errors_gt_8' END, CASE WHEN np > 5 THEN 'n_percent_gt_5' END, CASE WHEN ver AND run > 20 THEN 'internal_low_quality_run_gt_20' END) AS f,
  concat_ws(';', CASE WHEN quality_source = 'fasta_quality_unverified' THEN 'quality_scores_unavailable_fasta_not_assumed' END, @trace@CASE WHEN mixed_peak_percent <= 15 AND mixed_peak_percent > 7.5 THEN printf('mixed_peak_percent_%.2f', mixed_peak_percent) END,
    CASE WHEN np <= 5 AND np > 3 THEN 'n_percent_gt_3' END, CASE WHEN NOT (ver AND run > 20) AND run > 5 THEN 'internal_low_quality_run_gt_5' END) AS wn FROM m)
SELECT read_id, CASE WHEN f <> '' THEN 'FAIL_QC' WHEN wn <> '' THEN 'PASS_WITH_WARNINGS' ELSE 'PASS_HIGH_CONFIDENCE' END AS qc_class, concat_ws(';', nullif(f, ''), nullif(wn, '')) AS reasons FROM r"""


def _measured(spark, sf):
    return _reads(spark, sf).withColumns(
        {
            "length": F.length("sequence"),
            "mean_q": Q.mean_quality("qualities"),
            "expected_errors": Q.expected_errors("sequence", "qualities"),
            "n_percent": 100.0 * (F.length("sequence") - F.length(F.replace("sequence", F.lit("N"), F.lit("")))) / F.length("sequence"),
            "run": Q.longest_run(Q.weak_flags("sequence", "qualities")),
        }
    )


@query("read_qc", _READ_QC.replace("@trace@", ""))
def read_qc(spark, sf):
    rows = _measured(spark, sf).withColumns(Q.read_qc())
    return rows.select("read_id", "qc_class", F.array_join("qc_reasons", ";").alias("reasons"))


@query("read_qc_traced", _READ_QC.replace("@trace@", "CASE WHEN starts_with(quality_source, 'ab1_') AND length(sequence) % 3 = 0 THEN 'chromatogram_trace_channels_unavailable' END, "))
def read_qc_traced(spark, sf):
    """As read_qc, for reads of which every third length comes without dye channels."""
    rows = _measured(spark, sf).withColumns(Q.read_qc(traced=F.length("sequence") % 3 > 0))
    return rows.select("read_id", "qc_class", F.array_join("qc_reasons", ";").alias("reasons"))


@query(
    "orient_reads",
    """
SELECT read_id, md5(CASE WHEN direction = 'reverse' THEN reverse(translate(sequence, 'ACGTURYSWKMBDHVNacgturyswkmbdhvn', 'TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn')) ELSE sequence END) AS oriented_md5,
  md5(CASE WHEN direction = 'reverse' THEN reverse(quality_text) ELSE quality_text END) AS quality_md5 FROM {reads}""",
)
def orient_reads(spark, sf):
    back = F.col("direction") == "reverse"
    return view(spark, sf, "reads").select(
        "read_id",
        F.md5(F.when(back, I.reverse_complement("sequence")).otherwise(F.col("sequence"))).alias("oriented_md5"),
        F.md5(F.when(back, F.reverse("quality_text")).otherwise(F.col("quality_text"))).alias("quality_md5"),
    )


@query(
    "processing_mode",
    """
SELECT read_id, CASE conv_id % 11 WHEN 0 THEN 'best_read' WHEN 1 THEN 'assemble' WHEN 2 THEN 'assemble' WHEN 3 THEN 'best_read' END AS mode FROM {reads}""",
)
def processing_mode(spark, sf):
    return view(spark, sf, "reads").select("read_id", Q.processing_mode("mode_text").alias("mode"))


@query(
    "group_mode",
    """
WITH m AS (SELECT sequence_id, CASE WHEN turn % 2 = 1 AND conv_id % 5 = 0 THEN 'assemble' ELSE CASE conv_id % 11 WHEN 0 THEN 'best_read' WHEN 1 THEN 'assemble' WHEN 2 THEN 'assemble' WHEN 3 THEN 'best_read' END END AS m FROM {reads})
SELECT sequence_id, CASE WHEN bool_or(coalesce(m = 'best_read', false)) THEN 'best_read' ELSE 'assemble' END AS mode, CASE WHEN count(DISTINCT m) > 1 THEN 'conflicting_processing_modes_assemble_best_read' ELSE '' END AS warning FROM m GROUP BY 1""",
)
def group_mode(spark, sf):
    mixed = (F.col("turn") % 2 == 1) & (F.col("conv_id") % 5 == 0)
    return R.group_mode(view(spark, sf, "reads").withColumn("mode_text", F.when(mixed, "merge").otherwise(F.col("mode_text"))))


@query(
    "best_read",
    f"""
WITH {_ARR}, k AS (SELECT *, round(list_avg(qs), 9) AS mq, round(list_avg({_ERR}), 12) AS me, length(sequence) AS n, length(sequence) - length(replace(sequence, 'N', '')) AS nn FROM arr),
u AS (SELECT *, quality_source <> 'ab1_missing_pcon' AS ok FROM k)
SELECT sequence_id, count(*) AS reads, count(*) FILTER (ok) AS kept_reads, arg_max(read_id, (mq, -me, n, -nn, read_id)) FILTER (ok) AS selected_read, arg_max(n, (mq, -me, n, -nn, read_id)) FILTER (ok) AS length,
  round(arg_max(mq, (mq, -me, n, -nn, read_id)) FILTER (ok), 4) AS mean_q, CASE WHEN count(*) FILTER (ok) = 0 THEN 'failed_no_reads' ELSE 'best_read' END AS status FROM u GROUP BY 1""",
)
def best_read(spark, sf):
    rows = _reads(spark, sf).withColumns(
        {"kept": F.col("quality_source") != "ab1_missing_pcon", "oriented": F.col("sequence"), "oriented_q": F.col("qualities")}
    )
    return R.best_read(rows)


@query(
    "per_base_profile",
    f"""
WITH {_ARR}, p AS (SELECT read_id, direction, length(sequence) AS n, unnest(bs) AS base, unnest(qs) AS q, unnest(range(len(bs))) AS i FROM arr),
x AS (SELECT *, CASE WHEN i < 5 THEN 'left_trimmed' WHEN i >= n - 5 THEN 'right_trimmed' ELSE 'kept' END AS region FROM p)
SELECT read_id, i + 1 AS position, base, q AS quality, round(pow(10.0::double, -q / 10.0::double), 9) AS error, region, CASE WHEN region = 'kept' THEN CASE WHEN q < 20 THEN 'N' ELSE base END ELSE '' END AS base_after_mask,
  region = 'kept' AND q < 20 AND base <> 'N' AS masked, CASE WHEN region = 'kept' THEN CASE WHEN direction = 'reverse' THEN n - 5 - i ELSE i - 4 END END AS oriented_position FROM x""",
)
def per_base_profile(spark, sf):
    rows = _reads(spark, sf).withColumns({"trim_start": F.lit(5), "trim_end": F.length("sequence") - 5, "kept": F.lit(True)})
    masked = F.array_join(F.zip_with(Q.bases("sequence"), "qualities", lambda b, q: F.when(q < 20, "N").otherwise(b)), "")
    return R.per_base_profile(rows.withColumn("masked_sequence", F.substring(masked, F.lit(6), F.length("sequence") - 10)))


@query(
    "read_concordance",
    """
WITH k AS (SELECT o_custkey % 700 AS iso, o_orderkey AS rd, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('G', o_custkey % 700 % 50 + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END) END AS g,
   CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE concat('F', o_custkey % 700 % 20) END AS f FROM {orders}),
a AS (SELECT iso, count(*) FILTER (g IS NOT NULL OR f IS NOT NULL) AS n, count(g) AS ng, count(f) AS nf, count(DISTINCT g) AS dg, count(DISTINCT f) AS df FROM k GROUP BY 1)
SELECT concat('I', iso) AS sequence_id, CASE WHEN n >= 2 AND ng = n THEN 'genus' WHEN n >= 2 AND nf = n THEN 'family' ELSE 'NA' END AS compared_rank,
  CASE WHEN n >= 2 AND ng = n THEN CASE WHEN dg > 1 THEN 'CONFLICT' ELSE 'CONCORDANT' END WHEN n >= 2 AND nf = n THEN CASE WHEN df > 1 THEN 'CONFLICT' ELSE 'CONCORDANT' END ELSE 'INSUFFICIENT_CLASSIFICATION' END AS status FROM a""",
)
def read_concordance(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    iso = c % 700
    genus = F.when((c % 9 == 0) | (o % 17 == 0), "").otherwise(F.concat(F.lit("G"), (iso % 50 + F.when(o % 29 == 0, 1).otherwise(0)).cast("string")))
    family = F.when(c % 6 == 0, "").otherwise(F.concat(F.lit("F"), (iso % 20).cast("string")))
    rows = view(spark, sf, "orders").select(
        F.concat(F.lit("I"), iso.cast("string")).alias("sequence_id"), o.cast("string").alias("read_id"), F.concat(F.lit("d__Bacteria;f__"), family, F.lit(";g__"), genus).alias("taxonomy")
    )
    return R.read_concordance(rows)


@query(
    "consensus_base",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, substr('ACGTN', cast(l_partkey % 5 + 1 AS int), 1) AS a, cast(l_quantity AS int) AS qa, substr('ACGTN', cast(l_suppkey % 5 + 1 AS int), 1) AS b, cast(l_partkey % 45 AS int) AS qb FROM {lineitem}),
p AS (SELECT *, least(0.75::double, pow(10.0::double, -qa / 10.0::double)) AS pa, least(0.75::double, pow(10.0::double, -qb / 10.0::double)) AS pb FROM x),
l AS (SELECT *, (1 - pa) * (pb / 3) AS la, (pa / 3) * (1 - pb) AS lb, (pa / 3) * (pb / 3) AS lo FROM p),
t AS (SELECT *, CASE WHEN la > lb OR (la = lb AND a > b) THEN a ELSE b END AS wb, greatest(la, lb) / (la + lb + 2 * lo) AS post, (pa * pb / 3) / greatest((1 - pa) * (1 - pb) + pa * pb / 3, 1e-12::double) AS same FROM l),
q AS (SELECT *, cast(least(60, greatest(0, round(-10 * log10(least(1, greatest(1e-6::double, 1 - post)))))) AS int) AS dq, cast(least(60, greatest(0, round(-10 * log10(least(1, greatest(1e-6::double, same)))))) AS int) AS sq FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN a = 'N' THEN b WHEN b = 'N' THEN a WHEN a = b THEN a WHEN post < 10.0::double / 11 THEN 'N' ELSE wb END AS base,
  CASE WHEN a = 'N' THEN qb WHEN b = 'N' THEN qa WHEN a = b THEN sq WHEN post < 10.0::double / 11 THEN least(qa, qb, dq) ELSE dq END AS quality, a <> 'N' AND b <> 'N' AND a <> b AND post < 10.0::double / 11 AS ambiguous FROM q""",
)
def consensus_base(spark, sf):
    letter = lambda c: F.substring(F.lit("ACGTN"), (F.col(c) % 5 + 1).cast("int"), F.lit(1))
    rows = view(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", letter("l_partkey").alias("a"), F.col("l_quantity").cast("int").alias("qa"), letter("l_suppkey").alias("b"), (F.col("l_partkey") % 45).cast("int").alias("qb")
    )
    return rows.select("l_orderkey", "l_linenumber", Q.consensus_base("a", "qa", "b", "qb").alias("c")).select("l_orderkey", "l_linenumber", "c.base", "c.quality", "c.ambiguous")


@query(
    "mixed_peak",
    """
WITH x AS (SELECT l_orderkey, [l_partkey % 90 + 10, l_suppkey % 70 + 5, l_orderkey % 60, l_linenumber * 20] AS s, substr('ACGT', cast(l_partkey % 4 + 1 AS int), 1) AS b, cast(l_quantity AS int) AS q FROM {lineitem}),
r AS (SELECT l_orderkey, q, CASE WHEN s[list_position(['A','C','G','T'], b)] > 0 THEN list_max(list_filter(s, lambda v, i: i <> list_position(['A','C','G','T'], b))) / s[list_position(['A','C','G','T'], b)] ELSE 0 END AS ratio FROM x)
SELECT l_orderkey, coalesce(round(100.0 * count(*) FILTER (q >= 20 AND ratio >= 0.33) / nullif(count(*) FILTER (q >= 20), 0), 4), 0) AS mixed_peak_percent FROM r GROUP BY 1""",
)
def mixed_peak(spark, sf):
    li = view(spark, sf, "lineitem")
    signal = F.array((F.col("l_partkey") % 90 + 10), (F.col("l_suppkey") % 70 + 5), (F.col("l_orderkey") % 60), (F.col("l_linenumber") * 20).cast("long"))
    called = F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1))
    # A read has at most seven called peaks here, so the arrays are short by construction.
    peaks = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(signal.alias("s"), called.alias("b"), F.col("l_quantity").cast("int").alias("q"))).alias("p"))
    ratios = Q.secondary_ratio(F.transform("p", lambda x: x["s"]), F.transform("p", lambda x: x["b"]))
    rows = peaks.select("l_orderkey", ratios.alias("r"), F.transform("p", lambda x: x["q"]).alias("q"))
    return rows.select("l_orderkey", F.round(Q.mixed_peak_percent("r", "q"), 4).alias("mixed_peak_percent"))


@query(
    "infer_read_info",
    """
SELECT conv_id, turn, concat('iso', conv_id, '_batch', turn) AS sequence_id, CASE conv_id % 4 WHEN 0 THEN '27F' WHEN 1 THEN '1492R' WHEN 2 THEN 'ITS4' ELSE 'unknown' END AS primer, CASE WHEN conv_id % 4 = 1 THEN 'reverse' ELSE 'forward' END AS direction
FROM {conversations} WHERE conv_id % 4 < 3 UNION ALL SELECT conv_id, turn, concat('iso', conv_id, '-batch', turn), 'unknown', 'forward' FROM {conversations} WHERE conv_id % 4 = 3""",
)
def infer_read_info(spark, sf):
    name = F.when(F.col("conv_id") % 4 == 3, F.concat(F.lit("x/iso"), F.col("conv_id").cast("string"), F.lit("-batch"), F.col("turn").cast("string"), F.lit(".ab1"))).otherwise(
        F.concat(F.lit("in/iso"), F.col("conv_id").cast("string"), F.lit("-"), F.element_at(F.array(F.lit("27f"), F.lit("1492R"), F.lit("its4"), F.lit("")), (F.col("conv_id") % 4 + 1).cast("int")), F.lit("_batch"), F.col("turn").cast("string"), F.lit(".ab1"))
    )
    return view(spark, sf, "conversations").select("conv_id", "turn", Q.read_info(name).alias("r")).select("conv_id", "turn", "r.*")


@query(
    "assembly_qc",
    """
WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 600 + o_orderkey % 900 END AS n, o_orderkey % 400 / 10e0 AS mq, o_orderkey % 90 / 10e0 AS ee, o_orderkey % 70 / 10e0 AS np, o_orderkey % 19 AS cf, o_orderkey % 5 AS am,
  CASE o_orderkey % 4 WHEN 0 THEN 'assembled' WHEN 1 THEN 'single_read' WHEN 2 THEN 'partial_no_overlap' ELSE 'best_read' END AS st, o_custkey % 3 + 1 AS gr, o_custkey % 2 AS um, o_custkey % 3 AS fr, o_custkey % 7 > 0 AS ver, CASE WHEN o_orderkey % 4 = 3 THEN 'best_read' ELSE 'assemble' END AS md FROM {orders}),
d AS (SELECT *, CASE WHEN n > 0 THEN 100.0::double * cf / n ELSE 0 END AS den FROM x),
r AS (SELECT *, concat_ws(';', CASE WHEN n = 0 THEN 'no_output_sequence' END, CASE WHEN n > 0 AND n < 800 THEN 'output_length_lt_800' END, CASE WHEN ver AND n > 0 AND mq < 20 THEN 'output_mean_q_lt_20' END, CASE WHEN ver AND ee > 5 THEN 'output_expected_errors_gt_5' END,
    CASE WHEN np > 5 THEN 'output_n_percent_gt_5' END, CASE WHEN den > 1 THEN 'overlap_conflict_density_gt_1' END, CASE WHEN st = 'partial_no_overlap' THEN st END) AS f,
  concat_ws(';', CASE WHEN np <= 5 AND np > 3 THEN 'output_n_percent_gt_3' END, CASE WHEN st = 'single_read' AND gr > 1 AND md = 'assemble' THEN 'only_one_primer_read_passed_qc' END, CASE WHEN am > 2 THEN concat('ambiguous_overlap_conflicts_', am) END,
    CASE WHEN um > 0 AND md = 'assemble' THEN concat('unmerged_primer_reads_', um) END, CASE WHEN fr > 0 AND (md = 'assemble' OR n = 0) THEN concat('failed_reads_', fr) END) AS w FROM d)
SELECT k AS o_orderkey, CASE WHEN f <> '' THEN 'FAIL_QC' WHEN w <> '' THEN 'PASS_WITH_WARNINGS' ELSE 'PASS_HIGH_CONFIDENCE' END AS qc_class, CASE WHEN f <> '' THEN 'RESEQUENCE' WHEN w <> '' THEN 'MANUAL_REVIEW' ELSE 'ACCEPT' END AS recommendation,
  concat_ws(';', nullif(f, ''), nullif(w, '')) AS reasons, round(den, 3) AS conflict_density FROM r""",
)
def assembly_qc(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = view(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 23 == 0, 0).otherwise(600 + k % 900).alias("length"), (k % 400 / 10.0).alias("mean_q"), (k % 90 / 10.0).alias("expected_errors"),
        (k % 70 / 10.0).alias("n_percent"), (k % 19).alias("conflicts"), (k % 5).alias("ambiguous"),
        F.element_at(F.array(*map(F.lit, ("assembled", "single_read", "partial_no_overlap", "best_read"))), (k % 4 + 1).cast("int")).alias("status"),
        (c % 3 + 1).alias("group_reads"), (c % 2).alias("unmerged"), (c % 3).alias("failed_reads"), (c % 7 > 0).alias("verified"),
        F.when(k % 4 == 3, "best_read").otherwise("assemble").alias("mode"),
    )
    return R.assembly_qc(rows).select("o_orderkey", "qc_class", "recommendation", "reasons", "conflict_density")


@query("primer_trim")
def primer_trim(spark, sf):
    primed = F.concat(F.lit("GG"), F.when(F.col("primer") == "27F", "AGAGTTTGATCATGGCTCAG").when(F.col("primer") == "515F", "GTGCCAGCAGCCGCGGTTA").otherwise("ACGT"), F.col("sequence"))
    rows = view(spark, sf, "reads").select("read_id", "primer", primed.alias("sequence"))
    return rows.select("read_id", "primer", Q.primer_end("sequence", "primer").alias("cut"))


@query("prepared_reads")
def prepared_reads(spark, sf):
    return _prepared(spark, sf).select("read_id", "trim_start", "trim_end", "length", "masked_bases", "run", "qc_class", "kept")


@query("failure_manifest")
def failure_manifest(spark, sf):
    return R.failure_manifest(_prepared(spark, sf))


@query("failed_reads")
def failed_reads(spark, sf):
    return R.failed_reads(_prepared(spark, sf))


#: Spaces of a text are unknown bases, about one letter in six: reads of texts may hold as many, and be as short as an overlap.
_TEXTS = Q.ReadPolicy(min_read_length=Q.POLICY.min_overlap, warn_n_percent=25.0, max_n_percent=40.0)


def _fragments(spark, sf):
    """Overlapping reads of one text, trimmed, masked, judged and oriented: its first 60 %, its last 60 % from the other strand, and the whole turn."""
    rows = view(spark, sf, "reads")
    size = F.length("sequence")
    cut = (size * 0.6).cast("int")

    def piece(tag, start, n, back=False):
        seq, quals = F.substring("sequence", start, n), F.substring("quality_text", start, n)
        return F.struct(
            F.concat("read_id", F.lit(tag)).alias("read_id"), F.lit("reverse" if back else "forward").alias("direction"),
            (I.reverse_complement(seq) if back else seq).alias("sequence"), (F.reverse(quals) if back else quals).alias("quality_text"),
        )

    pieces = F.array(piece("a", F.lit(1), cut), piece("b", size - cut + 1, cut, True), piece("w", F.lit(1), size))
    reads = rows.select(F.concat(F.lit("F"), "read_id").alias("sequence_id"), "primer", "quality_source", "mixed_peak_percent", F.inline(pieces))
    even = spread(reads, "read_id").withColumn("qualities", Q.phred_array("quality_text")).drop("quality_text")
    prepared = R.prepare_reads(R.settled(even), _TEXTS)
    return cut_lineage(prepared.select("sequence_id", "read_id", "kept", "direction", "oriented", "oriented_q"))


@query("assemble_isolates")
def assemble_isolates(spark, sf):
    out = assembly.assemble(_fragments(spark, sf))
    return out.select("sequence_id", "status", F.length("consensus").alias("length"), "unmerged", "min_identity", "conflicts", "ambiguous")


@query("read_placements")
def read_placements(spark, sf):
    reads = _fragments(spark, sf)
    return assembly.placements(reads, assembly.assemble(reads))


@query("overlap_pairs")
def overlap_pairs(spark, sf):
    return assembly.best_pairs(_fragments(spark, sf).filter("kept and length(oriented) > 0"))
