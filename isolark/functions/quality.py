"""Per-read quality analytics as Column expressions over base and Phred arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from isolark.functions.taxonomy import col, once


@dataclass(frozen=True)
class ReadPolicy:
    """Read and consensus thresholds (fixed values of policy version 2.2)."""

    min_quality: int = 20
    min_read_length: int = 300
    min_final_length: int = 800
    min_mean_quality: float = 20.0
    mask_quality: int = 20
    max_read_expected_errors: float = 8.0
    max_output_expected_errors: float = 5.0
    warn_n_percent: float = 3.0
    max_n_percent: float = 5.0
    warn_internal_low_quality_run: int = 5
    max_internal_low_quality_run: int = 20
    max_conflict_density: float = 1.0
    max_ambiguous_overlap_conflicts_without_review: int = 2
    secondary_peak_ratio: float = 0.33
    max_mixed_peak_percent: float = 15.0
    mixed_peak_min_quality: int = 20
    quality_difference: int = 10
    min_overlap: int = 40
    min_overlap_identity: float = 0.95

    def __post_init__(self):
        if min(self.min_read_length, self.min_final_length, self.min_overlap) < 1:
            raise ValueError("lengths must be at least 1")
        if not 0 <= self.warn_n_percent <= self.max_n_percent <= 100:
            raise ValueError("N percentages must satisfy 0 <= warn <= max <= 100")
        if not 0 <= self.max_mixed_peak_percent <= 100:
            raise ValueError("max_mixed_peak_percent must be between 0 and 100")
        if self.warn_internal_low_quality_run > self.max_internal_low_quality_run:
            raise ValueError("warn run cannot exceed the maximum run")
        if self.secondary_peak_ratio <= 0 or not 0 <= self.min_overlap_identity <= 1:
            raise ValueError("ratio must be positive and overlap identity within 0..1")
        if min(self.min_quality, self.mask_quality, self.quality_difference, self.min_mean_quality, self.max_read_expected_errors) < 0:
            raise ValueError("quality thresholds cannot be negative")


POLICY = ReadPolicy()

# Sequencing primers by name (IUPAC), as published for 16S, ITS, 18S and 28S markers.
PRIMERS = {
    "8F": "AGAGTTTGATCCTGGCTCAG", "27F": "AGAGTTTGATCMTGGCTCAG", "63F": "CAGGCCTAACACATGCAAGTC", "338F": "ACTCCTACGGGAGGCAGCAG",
    "341F": "CCTACGGGNGGCWGCAG", "357F": "CTCCTACGGGAGGCAGCAG", "515F": "GTGYCAGCMGCCGCGGTAA", "519F": "CAGCMGCCGCGGTAANWC",
    "785F": "GGATTAGATACCCBDGTAGTC", "1055F": "ATGGCTGTCGTCAGCT", "534R": "ATTACCGCGGCTGCTGG", "806R": "GGACTACNVGGGTWTCTAAT",
    "907R": "CCGTCAATTCMTTTRAGTTT", "926R": "CCGYCAATTYMTTTRAGTTT", "1100R": "GGGTTGCGCTCGTTG", "1392R": "ACGGGCGGTGTGTRC",
    "1406R": "ACGGGCGGTGTGTRCAA", "1492R": "TACGGYTACCTTGTTACGACTT", "1525R": "AAGGAGGTGWTCCARCC",
    "ITS1": "TCCGTAGGTGAACCTGCGG", "ITS1F": "CTTGGTCATTTAGAGGAAGTAA", "ITS2": "GCTGCGTTCTTCATCGATGC", "ITS3": "GCATCGATGAAGAACGCAGC",
    "ITS4": "TCCTCCGCTTATTGATATGC", "ITS4B": "CAGGAGACTTGTACACGGTCCAG", "ITS5": "GGAAGTAAAAGTCGTAACAAGG",
    "NS1": "GTAGTCATATGCTTGTCTC", "NS2": "GGCTGCTGGCACCAGACTTGC", "NS3": "GCAAGTCTGGTGCCAGCAGCC", "NS4": "CTTCCGTCAATTCCTTTAAG",
    "NS5": "AACTTAAAGGAATTGACGGAAG", "NS6": "GCATCACAGACCTGTTATTGCCTC", "NS7": "GAGGCAATAACAGGTCTGTGATGC", "NS8": "TCCGCAGGTTCACCTACGGA",
    "528F": "GCGGTAATTCCAGCTCCAA", "1391F": "GTACACACCGCCCGTC", "EukBr": "TGATCCTTCTGCAGGTTCACCTAC",
    "LR0R": "ACCCGCTGAACTTAAGC", "LR3": "CCGTGTTTCAAGACGGG", "LR5": "TCCTGAGGGAAACTTCG", "LR6": "CGCCAGTTCTGCTTACC",
    "NL1": "GCATATCAATAAGCGGAGGAAAAG", "NL4": "GGTCCGTGTTTCAAGACGG",
}
# Bases that each IUPAC code stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: Each code as a bit mask of its bases, written as one hexadecimal digit so that texts can be translated.
MASKS = {code: f"{sum(1 << 'ACGT'.index(b) for b in bases):x}" for code, bases in IUPAC.items()}
IUPAC_LETTERS, IUPAC_SETS = "".join(MASKS), "".join(MASKS.values())

# Sources of reads that carry no qualities.
NO_QUALITY = ("fasta_quality_unverified", "ab1_missing_pcon")

# Words that ask for the best single read or for assembly.
BEST_READ_WORDS = (
    "best", "best_read", "bestread", "quality_best", "best_quality", "highest_quality", "select_best", "choose_best", "single_best", "pick_best",
    "independent", "independently", "separate", "separate_reads", "individual", "individual_reads", "no_assemble", "noassembly", "no_assembly",
    "dont_assemble", "do_not_assemble", "unassembled", "convert_only", "fasta_only",
)
ASSEMBLE_WORDS = (
    "assemble", "assembled", "assembly", "merge", "merged", "consensus", "overlap", "assemble_reads", "merge_reads", "long_read", "longer_sequence",
)


def phred_array(text) -> Column:
    """Phred+33 text to an int array, clamped at zero."""
    return F.transform(bases(text), lambda c: F.greatest(F.lit(0), F.ascii(c) - 33))


def bases(seq) -> Column:
    """Letters of a text; none of an empty one."""
    return F.slice(F.split(col(seq), ""), F.lit(1), F.length(col(seq)))


def error_probability(q) -> Column:
    return F.pow(F.lit(10.0), -F.greatest(F.lit(0), q) / 10.0)


def mott_trim(seq, quals, cutoff: int = POLICY.min_quality) -> Column:
    """Struct(start, end) of the best-scoring stretch, terminal Ns stripped; (0, 0) when none."""
    limit = 10.0 ** (-cutoff / 10.0)
    zero = F.lit(0)
    start = F.struct(
        F.lit(0.0).alias("score"), zero.alias("start"), F.lit(0.0).alias("best"), zero.alias("b0"), zero.alias("b1"), zero.alias("i")
    )

    def step(acc, q):
        gain = F.lit(limit) - error_probability(q)
        fresh = acc["score"] <= 0
        score = F.when(fresh, gain).otherwise(acc["score"] + gain)
        begin = F.when(fresh, acc["i"]).otherwise(acc["start"])
        better = score > acc["best"]
        return F.struct(
            score.alias("score"), begin.alias("start"), F.when(better, score).otherwise(acc["best"]).alias("best"),
            F.when(better, begin).otherwise(acc["b0"]).alias("b0"), F.when(better, acc["i"] + 1).otherwise(acc["b1"]).alias("b1"),
            (acc["i"] + 1).alias("i"),
        )

    found = F.aggregate(col(quals), start, step, lambda acc: F.struct(acc["b0"].alias("b0"), acc["b1"].alias("b1")))
    cut = lambda f: F.struct(f["b0"].alias("b0"), f["b1"].alias("b1"), F.substring(col(seq), f["b0"] + 1, f["b1"] - f["b0"]).alias("s"))

    def stripped(f):
        n = F.length(f["s"])
        left, right = n - F.length(F.ltrim(f["s"], F.lit("N"))), n - F.length(F.rtrim(f["s"], F.lit("N")))
        kept = F.length(F.trim(f["s"], F.lit("N"))) > 0
        return F.struct(F.when(kept, f["b0"] + left).otherwise(0).alias("start"), F.when(kept, f["b1"] - right).otherwise(0).alias("end"))

    return once(once(found, cut), stripped)


def trim_unverified(seq) -> Column:
    """Struct(start, end) of a read without qualities: what lies between its first and last A, C, G or T."""
    n = F.length(col(seq))
    start = n - F.length(F.regexp_replace(col(seq), "^[^ACGT]+", ""))
    return F.struct(start.alias("start"), F.greatest(start, F.length(F.regexp_replace(col(seq), "[^ACGT]+$", ""))).alias("end"))


def mask_unverified(seq, quals) -> Column:
    """Struct(sequence, qualities, masked) of a read without qualities: only ambiguous bases become N."""
    masked = F.regexp_replace(col(seq), "[^ACGT]", "N")
    return F.struct(masked.alias("sequence"), col(quals).alias("qualities"), (F.length(masked) - F.length(F.replace(masked, F.lit("N"), F.lit("")))).alias("masked"))


def mask_low_quality(seq, quals, cutoff: int = POLICY.mask_quality) -> Column:
    """Struct(sequence, qualities, masked): weak or ambiguous bases become N with quality at most 2."""
    cells = F.zip_with(
        bases(seq),
        col(quals),
        lambda b, q: F.struct(
            (q < cutoff).alias("low"), (~b.isin("A", "C", "G", "T")).alias("odd"), b.alias("b"), q.alias("q")
        ),
    )
    hide = lambda x: x["low"] | x["odd"]
    return once(
        cells,
        lambda cells: F.struct(
            F.array_join(F.transform(cells, lambda x: F.when(hide(x), "N").otherwise(x["b"])), "").alias("sequence"),
            F.transform(cells, lambda x: F.when(hide(x), F.least(x["q"], F.lit(2))).otherwise(x["q"])).alias("qualities"),
            F.size(F.filter(cells, lambda x: hide(x) & ((x["b"] != "N") | x["low"]))).alias("masked"),
        ),
    )


def longest_run(flags: Column) -> Column:
    """Length of the longest run of TRUE in a boolean array."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc, x):
        now = F.when(x, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.aggregate(flags, start, step, lambda acc: acc["top"])


def weak_flags(seq, quals, cutoff: int = POLICY.mask_quality) -> Column:
    return F.zip_with(bases(seq), col(quals), lambda b, q: (q < cutoff) | ~b.isin("A", "C", "G", "T"))


def mean_quality(quals) -> Column:
    total = F.aggregate(col(quals), F.lit(0.0), lambda acc, q: acc + q)
    return F.when(F.size(col(quals)) > 0, total / F.size(col(quals))).otherwise(0.0)


def mean_error(quals) -> Column:
    total = F.aggregate(col(quals), F.lit(0.0), lambda acc, q: acc + error_probability(q))
    return F.when(F.size(col(quals)) > 0, total / F.size(col(quals))).otherwise(0.0)


def expected_errors(seq, quals) -> Column:
    """Sum of error probabilities over A, C, G and T calls."""
    cells = F.zip_with(bases(seq), col(quals), lambda b, q: F.when(b.isin("A", "C", "G", "T"), error_probability(q)).otherwise(0.0))
    return F.aggregate(cells, F.lit(0.0), lambda acc, e: acc + e)


def primer_end(seq, primer, min_identity: float = 0.8, max_offset: int = 5, least: int = 12, primers: dict[str, str] | None = None) -> Column:
    """Bases to cut so that a primer seen at the read start is removed (0 when none is)."""
    reach = max(map(len, (primers or PRIMERS).values()), default=0) + max_offset
    lookup = F.create_map(*[F.lit(x) for n, s in (primers or PRIMERS).items() for x in (n.upper(), s.translate(str.maketrans(IUPAC_LETTERS, IUPAC_SETS)))])
    want = F.split(F.coalesce(F.try_element_at(lookup, F.upper(col(primer))), F.lit("")), "")
    sets = F.split(F.translate(F.substring(col(seq), 1, reach), IUPAC_LETTERS, IUPAC_SETS), "")
    code = lambda c: F.conv(c, 16, 10).cast("int")

    def at(x, offset):
        want, sets = x["want"], x["sets"]
        window = F.slice(sets, F.lit(offset + 1), F.greatest(F.lit(0), F.least(F.size(want), F.size(sets) - offset)))
        hits = lambda w: F.size(F.filter(F.zip_with(w, F.slice(want, F.lit(1), F.size(w)), lambda a, b: code(a).bitwiseAND(code(b))), lambda x: x > 0))
        told = lambda w: F.struct((hits(w) / F.size(w)).alias("share"), F.size(w).alias("n"), F.lit(-offset).alias("o"))
        long = (F.size(want) >= least) & (F.size(sets) - offset >= least)
        return once(F.when(long, once(window, told)), lambda f: F.when(f["share"] >= min_identity, f))

    best = once(F.struct(want.alias("want"), sets.alias("sets")), lambda x: F.array_max(F.array(*[at(x, o) for o in range(max_offset + 1)])))
    return F.when(F.length(col(seq)) < least, 0).otherwise(once(best, lambda b: F.coalesce(b["n"] - b["o"], F.lit(0))))


def secondary_ratio(channels: Column, called: Column) -> Column:
    """Strongest other dye signal over the called one, per base, from arrays of (A, C, G, T) signals."""
    def ratio(signal, base):
        own = F.element_at(signal, F.array_position(F.array(*map(F.lit, "ACGT")), base).cast("int"))
        others = F.array_max(F.transform(F.filter(F.arrays_zip(signal.alias("s"), F.array(*map(F.lit, "ACGT")).alias("b")), lambda x: x["b"] != base), lambda x: x["s"]))
        return F.when(own > 0, others / own).otherwise(0.0)

    return F.zip_with(channels, called, lambda s, b: F.when(b.isin("A", "C", "G", "T"), ratio(s, b)).otherwise(0.0))


def mixed_peak_percent(ratios, quals, policy: ReadPolicy = POLICY) -> Column:
    """Share of well-called bases whose second peak is high."""
    strong = F.filter(F.zip_with(col(ratios), col(quals), lambda r, q: F.when(q >= policy.mixed_peak_min_quality, r)), lambda r: r.isNotNull())
    mixed = F.filter(strong, lambda r: r >= policy.secondary_peak_ratio)
    return F.when(F.size(strong) > 0, 100.0 * F.size(mixed) / F.size(strong)).otherwise(0.0)


def processing_mode(text) -> Column:
    """best_read / assemble / NULL: exact word, then separated chunks, then any mention."""
    word = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    key = word(col(text))
    chunks = F.filter(F.transform(F.split(F.lower(col(text)), r"[;,|/]+"), word), lambda c: c != "")
    mentions = lambda c, words: F.rlike(c, F.lit("|".join(words)))
    return (
        F.when(key == "", None)
        .when(key.isin(*BEST_READ_WORDS), "best_read")
        .when(key.isin(*ASSEMBLE_WORDS), "assemble")
        .when(F.exists(chunks, lambda c: mentions(c, BEST_READ_WORDS)), "best_read")
        .when(F.exists(chunks, lambda c: mentions(c, ASSEMBLE_WORDS)), "assemble")
        .when(mentions(key, BEST_READ_WORDS), "best_read")
        .when(mentions(key, ASSEMBLE_WORDS), "assemble")
    )


def read_info(name) -> Column:
    """Struct(sequence_id, primer, direction) from a read file name."""
    stem = F.regexp_replace(F.element_at(F.split(col(name), "/"), -1), r"(?<=.)\.[^.]*$", "")
    tokens = F.filter(F.split(stem, r"[_\-. ]+"), lambda t: t != "")
    known = F.create_map(*[F.lit(x) for p in PRIMERS for x in (p.upper(), p)])
    first = F.try_element_at(F.filter(F.transform(tokens, lambda t, i: F.struct(F.try_element_at(known, F.upper(t)).alias("primer"), i.alias("i"))), lambda x: x["primer"].isNotNull()), F.lit(1))
    rest = F.array_join(F.filter(tokens, lambda t, i: i != first["i"]), "_")
    primer = first["primer"]
    return F.struct(
        F.when(primer.isNotNull() & (rest != ""), rest).otherwise(stem).alias("sequence_id"),
        F.coalesce(primer, F.lit("unknown")).alias("primer"),
        F.when(F.endswith(F.upper(F.coalesce(primer, F.lit(""))), F.lit("R")), "reverse").otherwise("forward").alias("direction"),
    )


def read_qc(df_policy: ReadPolicy = POLICY, allow_missing_quality: bool = False, traced: Column | None = None) -> dict[str, Column]:
    """QC class and ordered reasons from columns length, mean_q, expected_errors, n_percent, run, mixed, quality_source.

    ``traced`` tells whether a chromatogram read came with its dye channels; without it nothing is said about them.
    """
    p = df_policy
    n, mean_q, ee = F.col("length"), F.col("mean_q"), F.col("expected_errors")
    n_pct, run, mixed, source = F.col("n_percent"), F.col("run"), F.col("mixed_peak_percent"), F.col("quality_source")
    unverified = source == "fasta_quality_unverified"
    missing = source == "ab1_missing_pcon"
    verified = ~unverified & ~missing
    fails = F.array(
        F.when(missing, F.concat(F.lit("quality_scores_missing_"), source)) if not allow_missing_quality else F.lit(None).cast("string"),
        F.when(mixed > p.max_mixed_peak_percent, f"mixed_peak_percent_gt_{p.max_mixed_peak_percent:g}"),
        F.when(n < p.min_read_length, f"trimmed_length_lt_{p.min_read_length}"),
        F.when(verified & (n > 0) & (mean_q < p.min_mean_quality), f"mean_q_lt_{p.min_mean_quality:g}"),
        F.when(verified & (ee > p.max_read_expected_errors), f"expected_errors_gt_{p.max_read_expected_errors:g}"),
        F.when(n_pct > p.max_n_percent, f"n_percent_gt_{p.max_n_percent:g}"),
        F.when(verified & (run > p.max_internal_low_quality_run), f"internal_low_quality_run_gt_{p.max_internal_low_quality_run}"),
    )
    run_fails = verified & (run > p.max_internal_low_quality_run)
    warns = F.array(
        F.when(unverified, "quality_scores_unavailable_fasta_not_assumed"),
        F.when(missing, F.concat(F.lit("quality_scores_missing_allowed_"), source)) if allow_missing_quality else F.lit(None).cast("string"),
        F.when(F.startswith(source, F.lit("ab1_")) & ~F.coalesce(traced, F.lit(False)), "chromatogram_trace_channels_unavailable") if traced is not None else F.lit(None).cast("string"),
        F.when((mixed <= p.max_mixed_peak_percent) & (mixed > max(1.0, p.max_mixed_peak_percent / 2)), F.format_string("mixed_peak_percent_%.2f", mixed)),
        F.when((n_pct <= p.max_n_percent) & (n_pct > p.warn_n_percent), f"n_percent_gt_{p.warn_n_percent:g}"),
        F.when(~run_fails & (run > p.warn_internal_low_quality_run), f"internal_low_quality_run_gt_{p.warn_internal_low_quality_run}"),
    )
    return qc_outcome(fails, warns)


def qc_outcome(fails: Column, warns: Column) -> dict[str, Column]:
    fails, warns = F.array_compact(fails), F.array_compact(warns)
    label = F.when(F.size(fails) > 0, "FAIL_QC").when(F.size(warns) > 0, "PASS_WITH_WARNINGS").otherwise("PASS_HIGH_CONFIDENCE")
    return {"qc_class": label, "qc_reasons": F.concat(fails, warns)}


def recommendation(qc_class) -> Column:
    return F.when(col(qc_class) == "FAIL_QC", "RESEQUENCE").when(col(qc_class) == "PASS_WITH_WARNINGS", "MANUAL_REVIEW").otherwise("ACCEPT")


def consensus_base(a, qa, b, qb, difference: int = POLICY.quality_difference) -> Column:
    """Struct(base, quality, ambiguous) of two observations under independent Phred errors."""
    a, qa, b, qb = map(col, (a, qa, b, qb))
    pa, pb = F.least(F.lit(0.75), error_probability(qa)), F.least(F.lit(0.75), error_probability(qb))
    phred = lambda e: F.least(F.lit(60), F.greatest(F.lit(0), F.round(-10.0 * F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-6), e)))).cast("int")))
    right, wrong = (1 - pa) * (1 - pb), pa * pb / 3.0
    like_a, like_b, like_other = (1 - pa) * (pb / 3.0), (pa / 3.0) * (1 - pb), (pa / 3.0) * (pb / 3.0)
    total = like_a + like_b + 2.0 * like_other
    top = F.array_max(F.array(F.struct(like_a.alias("l"), a.alias("b")), F.struct(like_b.alias("l"), b.alias("b"))))
    posterior = top["l"] / total
    odds = 10.0 ** (difference / 10.0)
    weak = posterior < odds / (1.0 + odds)
    out = lambda base, q, amb: F.struct(base.alias("base"), q.alias("quality"), amb.alias("ambiguous"))
    no = F.lit(False)
    return (
        F.when(a == "N", out(b, qb, no))
        .when(b == "N", out(a, qa, no))
        .when(a == b, out(a, phred(wrong / F.greatest(right + wrong, F.lit(1e-12))), no))
        .when(weak, out(F.lit("N"), F.least(qa, qb, phred(1 - posterior)), F.lit(True)))
        .otherwise(out(top["b"], phred(1 - posterior), no))
    )
