"""Read-level jobs: trim, mask, classify, orient, pick or assemble per isolate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from isolark.functions import quality as Q, taxonomy as T
from isolark.functions.identifiers import n_percent, reverse_complement
from isolark.operators import assembly
from isolark.session import cut_lineage


def settled(df: DataFrame) -> DataFrame:
    """Same rows, with every column computed before anything above it.

    A filter on a long chain of derived columns would otherwise be pushed below
    them by copying the whole chain into its condition.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def prepare_reads(reads: DataFrame, policy: Q.ReadPolicy = Q.POLICY, primers: dict[str, str] | None = None) -> DataFrame:
    """Trim, cut primers, mask, measure, classify and orient; narrow, no shuffle.

    Each step is settled before the next one, which mentions its columns several
    times: unsettled, the optimizer would copy the walks over bases into all of them.

    Reads without qualities keep everything between their first and last called
    base, and only ambiguous bases are masked. Needs (read_id, sequence_id, direction, primer, sequence, qualities,
    quality_source, mixed_peak_percent).
    """
    known = ~F.col("quality_source").isin(*Q.NO_QUALITY)
    trimmed = reads.withColumn("t", F.when(known, Q.mott_trim("sequence", "qualities", policy.min_quality)).otherwise(Q.trim_unverified("sequence")))
    trimmed = settled(trimmed).withColumns(
        {
            "trim_start": F.col("t.start"),
            "trim_end": F.col("t.end"),
            "_seq": F.substring("sequence", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")),
            "_q": F.slice("qualities", F.col("t.start") + 1, F.col("t.end") - F.col("t.start")),
        }
    )
    cut = settled(trimmed).withColumn("_cut", Q.primer_end("_seq", "primer", primers=primers))
    cut = settled(cut).withColumns(
        {
            "trim_start": F.col("trim_start") + F.col("_cut"),
            "trimmed": F.substring("_seq", F.col("_cut") + 1, F.length("_seq")),
            "trimmed_q": F.slice("_q", F.col("_cut") + 1, F.greatest(F.lit(0), F.size("_q") - F.col("_cut"))),
        }
    )
    masked = settled(cut).withColumn("m", F.when(known, Q.mask_low_quality("trimmed", "trimmed_q", policy.mask_quality)).otherwise(Q.mask_unverified("trimmed", "trimmed_q")))
    measured = settled(masked).withColumns(
        {
            "masked_sequence": F.col("m.sequence"),
            "masked_q": F.col("m.qualities"),
            "masked_bases": F.col("m.masked"),
            "run": Q.longest_run(F.when(known, Q.weak_flags("trimmed", "trimmed_q", policy.mask_quality)).otherwise(F.transform(Q.bases("trimmed"), lambda b: ~b.isin("A", "C", "G", "T")))),
            "length": F.length("m.sequence"),
            "mean_q": Q.mean_quality("m.qualities"),
            "expected_errors": Q.expected_errors("m.sequence", "m.qualities"),
            "n_percent": n_percent("m.sequence"),
        }
    )
    judged = settled(measured).withColumns(Q.read_qc(policy))
    back = F.col("direction") == "reverse"
    oriented = settled(judged).withColumns(
        {
            "kept": F.col("qc_class") != "FAIL_QC",
            "oriented": F.when(back, reverse_complement("masked_sequence")).otherwise(F.col("masked_sequence")),
            "oriented_q": F.when(back, F.reverse("masked_q")).otherwise(F.col("masked_q")),
        }
    ).drop("t", "m", "_seq", "_q", "_cut")
    return settled(oriented)


def group_mode(reads: DataFrame, default: str = "assemble") -> DataFrame:
    """Processing mode per isolate: any explicit best_read wins; a conflict is named."""
    mode = reads.select("sequence_id", Q.processing_mode("mode_text").alias("m"))
    agg = mode.groupBy("sequence_id").agg(F.array_sort(F.collect_set("m")).alias("modes"))
    chosen = F.when(F.array_contains("modes", "best_read"), "best_read").when(F.size("modes") > 0, "assemble").otherwise(default)
    warning = F.when(F.size("modes") > 1, F.concat(F.lit("conflicting_processing_modes_"), F.array_join("modes", "_"))).otherwise("")
    return agg.select("sequence_id", chosen.alias("mode"), warning.alias("warning"))


def best_read(prepared: DataFrame) -> DataFrame:
    """Best kept read per isolate: mean quality, mean error, length, fewer Ns, read id."""
    scored = prepared.withColumns(
        {
            "_mq": F.round(Q.mean_quality("oriented_q"), 9),
            "_me": F.round(Q.mean_error("oriented_q"), 12),
            "_n": F.length("oriented") - F.length(F.replace("oriented", F.lit("N"), F.lit(""))),
        }
    )
    key = F.struct("_mq", (-F.col("_me")).alias("e"), F.length("oriented").alias("l"), (-F.col("_n")).alias("n"), "read_id")
    usable = F.col("kept") & (F.length("oriented") > 0)
    agg = scored.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(usable).alias("kept_reads"),
        F.max_by(F.struct("read_id", "oriented", "_mq"), F.when(usable, key)).alias("b"),
    )
    return agg.select(
        "sequence_id", "reads", "kept_reads", F.col("b.read_id").alias("selected_read"), F.length("b.oriented").alias("length"),
        F.round("b._mq", 4).alias("mean_q"), F.when(F.col("kept_reads") == 0, "failed_no_reads").otherwise("best_read").alias("status"),
    )


def per_base_profile(prepared: DataFrame) -> DataFrame:
    """One row per called base with error probability, trim region, mask and oriented position."""
    cells = F.posexplode(F.arrays_zip(Q.bases("sequence").alias("base"), F.col("qualities").alias("q"))).alias("i", "c")
    rows = prepared.select("read_id", "direction", "kept", "trim_start", "trim_end", "masked_sequence", cells)
    i = F.col("i")
    region = F.when(i < F.col("trim_start"), "left_trimmed").when(i >= F.col("trim_end"), "right_trimmed").otherwise("kept")
    inside = region == "kept"
    after = F.when(inside, F.substring("masked_sequence", i - F.col("trim_start") + 1, F.lit(1))).otherwise("")
    oriented = F.when(F.col("kept") & inside, F.when(F.col("direction") == "reverse", F.col("trim_end") - i).otherwise(i - F.col("trim_start") + 1))
    return rows.select(
        "read_id", (i + 1).alias("position"), F.col("c.base").alias("base"), F.col("c.q").alias("quality"),
        F.round(Q.error_probability(F.col("c.q")), 9).alias("error"), region.alias("region"), after.alias("base_after_mask"),
        ((after == "N") & (F.col("c.base") != "N")).alias("masked"), oriented.cast("int").alias("oriented_position"),
    )


def read_concordance(assigned: DataFrame) -> DataFrame:
    """Do the independently classified reads of an isolate agree at genus, else family?"""
    rows = assigned.select("sequence_id", "read_id", T.rank_of("taxonomy", "g").alias("g"), T.rank_of("taxonomy", "f").alias("f"))
    known = rows.filter("g is not null or f is not null")
    agg = known.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("g").alias("ng"), F.count("f").alias("nf"), F.countDistinct("g").alias("dg"), F.countDistinct("f").alias("df")
    )
    out = assigned.select("sequence_id").distinct().join(agg, "sequence_id", "left")
    rank = F.when((F.col("n") >= 2) & (F.col("ng") == F.col("n")), "genus").when((F.col("n") >= 2) & (F.col("nf") == F.col("n")), "family")
    distinct = F.when(rank == "genus", F.col("dg")).when(rank == "family", F.col("df"))
    status = F.when(rank.isNull(), "INSUFFICIENT_CLASSIFICATION").when(distinct > 1, "CONFLICT").otherwise("CONCORDANT")
    return out.select("sequence_id", F.coalesce(rank, F.lit("NA")).alias("compared_rank"), status.alias("status"))


def failed_reads(prepared: DataFrame) -> DataFrame:
    """One row per read that failed, with its reasons."""
    return prepared.filter(~F.col("kept")).select("sequence_id", "read_id", F.array_join("qc_reasons", ";").alias("reasons"))


def _quality_key(sequence, quals) -> dict[str, Column]:
    """What the better of two reads has more of: mean quality, then small errors, length and few Ns."""
    n = F.length(sequence) - F.length(F.translate(sequence, "Nn", ""))
    return {"_mq": F.round(Q.mean_quality(quals), 9), "_me": -F.round(Q.mean_error(quals), 12), "_l": F.length(sequence), "_n": -n}


def failure_manifest(prepared: DataFrame, policy: Q.ReadPolicy = Q.POLICY, default: str = "assemble") -> DataFrame:
    """One row per isolate whose final sequence fails, with why, what it came from and its best recoverable read.

    Reads are assembled, or the best one is taken, as the isolate's mode says (``mode_text``, if there is one), and what
    comes out is judged. Lists of reads and their reasons stay in ``failed_reads``, one row per read, so an isolate with
    very many reads never has to fit in one cell.
    """
    mode = ["mode_text"] if "mode_text" in prepared.columns else []
    rows = cut_lineage(prepared.select("sequence_id", "read_id", "direction", "quality_source", "kept", "qc_class", "qc_reasons", "sequence", "trimmed", "trimmed_q", "oriented", "oriented_q", *mode))
    modes = group_mode(rows, default) if mode else rows.select("sequence_id", F.lit(default).alias("mode"), F.lit("").alias("warning")).distinct()
    modes = cut_lineage(modes.withColumnRenamed("warning", "mode_warning"))
    of = lambda m: rows.join(modes.filter(F.col("mode") == m).select("sequence_id"), "sequence_id", "left_semi")

    merged = assembly.assemble(of("assemble"))
    usable = F.col("kept") & (F.length("oriented") > 0)
    ranked = settled(of("best_read").withColumns(_quality_key(F.col("oriented"), F.col("oriented_q"))))
    key = F.struct("_mq", "_me", "_l", "_n", "read_id")
    single = ranked.groupBy("sequence_id").agg(F.max_by(F.struct("read_id", "oriented", "oriented_q"), F.when(usable, key)).alias("b")).select(
        "sequence_id", F.when(F.col("b").isNull(), "failed_no_reads").otherwise("best_read").alias("status"), F.coalesce("b.oriented", F.lit("")).alias("consensus"),
        F.coalesce("b.oriented_q", F.array().cast("array<int>")).alias("qualities"), F.when(F.col("b").isNull(), F.array().cast("array<string>")).otherwise(F.array("b.read_id")).alias("used"),
        F.lit(0).alias("unmerged"), F.lit(0).alias("conflicts"), F.lit(0).alias("ambiguous"), F.col("b.read_id").alias("selected_read"),
    )
    columns = single.columns
    outputs = cut_lineage(merged.withColumn("selected_read", F.lit(None).cast("string")).select(columns).unionByName(single))

    warned = rows.filter("qc_class = 'PASS_WITH_WARNINGS'").select("sequence_id", "read_id", F.explode("qc_reasons").alias("reason")).filter("not startswith(reason, 'n_percent_gt_')")
    used = outputs.select("sequence_id", F.explode("used").alias("read_id"))
    warnings = warned.join(used, ["sequence_id", "read_id"]).groupBy("sequence_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("read_"), "reason"))).alias("read_warnings"))

    whole = F.col("kept") & (F.length("oriented") > 0)
    scored = rows.withColumns(_quality_key(F.when(whole, F.col("oriented")).otherwise(F.col("trimmed")), F.when(whole, F.col("oriented_q")).otherwise(F.col("trimmed_q"))))
    back = F.col("direction") == "reverse"
    turned = lambda c: F.when(back, reverse_complement(c)).otherwise(F.col(c))
    review = F.when(F.length("oriented") > 0, F.col("oriented")).when(F.length("trimmed") > 0, turned("trimmed")).otherwise(turned("sequence"))
    known = F.col("kept") & ~F.col("quality_source").isin(*Q.NO_QUALITY)
    groups = settled(scored.withColumn("review", review)).groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("reads"), F.count_if("kept").alias("kept_reads"), F.count_if(~F.col("kept")).alias("failed_reads"), F.bool_or(known).alias("verified"),
        F.max_by(F.struct("read_id", F.length("review").alias("length"), n_percent("review").alias("n_percent")), F.when(F.length("review") > 0, key)).alias("r"),
    )

    told = outputs.withColumns({"length": F.length("consensus"), "mean_q": Q.mean_quality("qualities"), "expected_errors": Q.expected_errors("consensus", "qualities"), "n_percent": n_percent("consensus")})
    told = settled(told.drop("consensus", "qualities", "used")).join(modes, "sequence_id").join(groups, "sequence_id").join(warnings, "sequence_id", "left")
    judged = settled(assembly_qc(told.withColumn("group_reads", F.col("reads")), policy)).filter("qc_class = 'FAIL_QC'")
    short = (F.col("length") > 0) & (F.col("length") < policy.min_final_length)
    return judged.select(
        "sequence_id", "reads", F.col("r.read_id").alias("best_recoverable"), F.col("r.length").alias("recoverable_length"), F.round("r.n_percent", 3).alias("recoverable_n_percent"),
        "kept_reads", "failed_reads", "mode", F.when(short, f"filtered_output_length_lt_{policy.min_final_length}").otherwise(F.col("status")).alias("status"), "qc_class", "recommendation", "reasons",
        F.col("length").alias("output_length"), F.round("mean_q", 2).alias("mean_q"), F.round("expected_errors", 4).alias("expected_errors"), F.round("n_percent", 3).alias("n_percent"), "selected_read",
    )


def assembly_qc(assemblies: DataFrame, policy: Q.ReadPolicy = Q.POLICY) -> DataFrame:
    """Final class and recommendation of a consensus.

    Needs (length, mean_q, expected_errors, n_percent, conflicts, ambiguous,
    status, group_reads, unmerged, failed_reads, verified, mode); mode_warning
    and read_warnings, texts of what is warned of, are told if they are there.
    """
    n, conflicts = F.col("length"), F.coalesce("conflicts", F.lit(0))
    density = F.when(n > 0, 100.0 * conflicts / n).otherwise(0.0)
    has = n > 0
    assemble = F.col("mode") == "assemble"
    p = policy
    fails = F.array(
        F.when(~has, "no_output_sequence"),
        F.when(has & (n < p.min_final_length), f"output_length_lt_{p.min_final_length}"),
        F.when(F.col("verified") & has & (F.col("mean_q") < p.min_mean_quality), f"output_mean_q_lt_{p.min_mean_quality:g}"),
        F.when(F.col("verified") & (F.col("expected_errors") > p.max_output_expected_errors), f"output_expected_errors_gt_{p.max_output_expected_errors:g}"),
        F.when(F.col("n_percent") > p.max_n_percent, f"output_n_percent_gt_{p.max_n_percent:g}"),
        F.when(density > p.max_conflict_density, f"overlap_conflict_density_gt_{p.max_conflict_density:g}"),
        F.when(F.col("status").isin("failed_no_reads", "partial_no_overlap"), F.col("status")),
    )
    many = F.coalesce("ambiguous", F.lit(0))
    text = lambda c: F.when(F.col(c) != "", F.col(c)) if c in assemblies.columns else F.lit(None).cast("string")
    warns = F.array(
        F.when((F.col("n_percent") <= p.max_n_percent) & (F.col("n_percent") > p.warn_n_percent), f"output_n_percent_gt_{p.warn_n_percent:g}"),
        F.when((F.col("status") == "single_read") & (F.col("group_reads") > 1) & assemble, "only_one_primer_read_passed_qc"),
        F.when(many > p.max_ambiguous_overlap_conflicts_without_review, F.concat(F.lit("ambiguous_overlap_conflicts_"), many.cast("string"))),
        F.when((F.col("unmerged") > 0) & assemble, F.concat(F.lit("unmerged_primer_reads_"), F.col("unmerged").cast("string"))),
        text("mode_warning"),
        F.when((F.col("failed_reads") > 0) & (assemble | ~has), F.concat(F.lit("failed_reads_"), F.col("failed_reads").cast("string"))),
    )
    if "read_warnings" in assemblies.columns:
        warns = F.concat(warns, F.coalesce("read_warnings", F.array().cast("array<string>")))
    judged = assemblies.withColumns(Q.qc_outcome(fails, warns))
    return judged.withColumns({"conflict_density": F.round(density, 3), "recommendation": Q.recommendation("qc_class"), "reasons": F.array_join("qc_reasons", ";")}).drop("qc_reasons")
