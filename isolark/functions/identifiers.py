"""Identifiers, hashes, colours and tolerant casts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from isolark.functions.taxonomy import col, null_text

# IUPAC nucleotide codes and their complements (case kept, U pairs with A).
IUPAC_FROM = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
IUPAC_TO = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"
IUPAC_CODES = "ACGTURYSWKMBDHVN.-"
ASCII_LOWER, ASCII_UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Words accepted as yes / no in ledgers.
YES_WORDS = ("1", "true", "t", "yes", "y")
NO_WORDS = ("0", "false", "f", "no", "n")
PASS_WORDS, FAIL_WORDS = ("pass", "passed"), ("fail", "failed")

# Isolate states and the other spellings accepted for them.
STATES = (
    "RECEIVED", "TRACE_REVIEW", "MARKER_QC_PASSED", "PROPOSED", "SAB_APPROVED", "DNA_EXTRACTION_PENDING",
    "DNA_EXTRACTION_FAILED", "LIBRARY_PENDING", "SEQUENCED", "GENOME_QC_FAILED", "GENOME_QC_PASSED", "WITHDRAWN",
)
STATE_ALIASES = {
    "APPROVED": "SAB_APPROVED",
    "DNA_FAILED": "DNA_EXTRACTION_FAILED",
    "DNA_PENDING": "DNA_EXTRACTION_PENDING",
    "QC_PASSED": "GENOME_QC_PASSED",
    "QC_FAILED": "GENOME_QC_FAILED",
    "GENOME_AVAILABLE": "GENOME_QC_PASSED",
}


def ascii_upper(c) -> Column:
    """Upper-case ASCII letters only, so every engine agrees on the result."""
    return F.translate(col(c), ASCII_LOWER, ASCII_UPPER)


def reverse_complement(c) -> Column:
    return F.reverse(F.translate(col(c), IUPAC_FROM, IUPAC_TO))


def n_count(c) -> Column:
    return (F.length(col(c)) - F.length(F.translate(col(c), "Nn", ""))).cast("int")


def n_percent(c) -> Column:
    size = F.length(col(c))
    return F.when(size > 0, 100.0 * n_count(c) / size).otherwise(F.lit(0.0))


def foreign_characters(c) -> Column:
    """Sorted distinct characters that are not IUPAC codes, '.' or '-'."""
    odd = F.regexp_extract_all(ascii_upper(c), F.lit(f"[^{IUPAC_CODES}]".replace(".-", ".\\-")), F.lit(0))
    return F.array_sort(F.array_distinct(odd))


def canonical_id(c) -> Column:
    """First token, last pipe field, without fragment, coordinates or brackets."""
    token = F.element_at(F.split(F.trim(col(c)), r"\s+"), 1)
    token = F.element_at(F.split(token, r"\|"), -1)
    token = F.regexp_replace(token, "#.*$", "")
    token = F.regexp_replace(token, r":\d+-\d+(\([^)]*\))?$", "")
    token = F.regexp_replace(token, r"^[()\[\]{}]+|[()\[\]{}]+$", "")
    return F.when(token != "", token)


def lookup_keys(c) -> Column:
    """Distinct lookup keys of an identifier, most specific first."""
    raw = F.trim(col(c))
    first = F.element_at(F.split(raw, r"\s+"), 1)
    last_field = F.element_at(F.split(first, r"\|"), -1)
    canon = canonical_id(raw)
    squeezed = F.regexp_replace(F.regexp_replace(F.coalesce(canon, F.lit("")), "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    pieces = F.split(first, r"[|_:\-.]+")
    keys = F.concat(F.array(raw, first, F.coalesce(canon, F.lit("")), last_field, squeezed), pieces)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def hash_int(c) -> Column:
    """First 32 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(col(c)), 1, 8), 16, 10).cast("long")


def short_id(header, attempt) -> Column:
    """Three letters and two digits derived from header and attempt number."""
    value = hash_int(F.concat(col(header), F.lit("|"), attempt.cast("string")))
    letters = [F.substring(F.lit(ASCII_UPPER), (F.floor(value % 17576 / d) % 26 + 1).cast("int"), F.lit(1)) for d in (676, 26, 1)]
    digits = F.lpad((F.floor(value / 4096) % 100).cast("string"), 2, "0")
    return F.concat(*letters, digits)


def stable_set_id(group_key, prefix) -> Column:
    return F.concat(col(prefix), F.lit("_"), F.upper(F.substring(F.sha1(col(group_key)), 1, 8)))


def hsv_hex(h: Column, s: Column, v: Column) -> Column:
    """``#rrggbb`` of a hue/saturation/value colour, each in 0..1."""
    sector = F.floor(h * 6.0)
    f = h * 6.0 - sector
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    case = lambda *six: F.element_at(F.array(*six), (sector % 6 + 1).cast("int"))
    byte = lambda x: F.lpad(F.lower(F.hex(F.floor(x * 255).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), byte(case(v, q, p, p, t, v)), byte(case(t, v, v, q, p, p)), byte(case(p, p, t, v, v, q)))


def hue(c) -> Column:
    return (hash_int(c) % 360) / F.lit(360.0)


def name_colour(c) -> Column:
    return hsv_hex(hue(c), F.lit(0.65), F.lit(0.95))


# Hue offset, saturation and value per rank.
RANK_COLOURS = {"phylum": (0.0, 0.85, 0.97), "family": (0.33, 0.65, 0.90), "genus": (0.66, 0.45, 0.80)}


def rank_colour(c, rank: str) -> Column:
    offset, s, v = RANK_COLOURS.get(rank, (0.0, 0.65, 0.90))
    shifted = hue(c) + offset
    return hsv_hex(shifted - F.floor(shifted), F.lit(s), F.lit(v))


def dataset_colour(c, bins: int = 8) -> Column:
    """Binned hue plus a small jitter, so similar hashes stay apart."""
    slot = F.floor(hue(c) * bins) % bins
    jitter = (hue(F.concat(col(c), F.lit("_jitter"))) - 0.5) * (0.5 / bins)
    h = (slot + 0.5) / bins + jitter
    return hsv_hex(h - F.floor(h), F.lit(0.85), F.lit(0.92))


def identity_colour(c) -> Column:
    """Red (0) to green (1 or 100 %); grey when unknown."""
    value = F.when((col(c) > 1) & (col(c) <= 100), col(c) / 100.0).otherwise(col(c))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(col(c).isNull() | F.isnan(col(c)), "#cccccc").otherwise(hsv_hex(clipped * 0.33, F.lit(0.95), F.lit(0.95)))


def tolerant_double(c) -> Column:
    return null_text(c).try_cast("double")


def tolerant_int(c) -> Column:
    """Integers that may be written as decimals; truncates toward zero."""
    return tolerant_double(c).try_cast("int")


def tolerant_bool(c, outcomes: bool = False) -> Column:
    """Explicit yes / no words, else NULL; ``outcomes`` also accepts pass / fail."""
    word = F.lower(F.trim(col(c)))
    yes, no = (YES_WORDS + PASS_WORDS, NO_WORDS + FAIL_WORDS) if outcomes else (YES_WORDS, NO_WORDS)
    return F.when(word.isin(*yes), True).when(word.isin(*no), False)


def state_name(c) -> Column:
    """Canonical isolate state, NULL for unknown words."""
    word = F.regexp_replace(F.upper(F.trim(col(c))), r"[-\s]+", "_")
    aliases = F.create_map(*[F.lit(x) for pair in STATE_ALIASES.items() for x in pair])
    word = F.coalesce(F.try_element_at(aliases, word), word)
    return F.when(word.isin(*STATES), word)


def supplier_key(c) -> Column:
    """Supplier read name without trace suffix and direction tag, case folded."""
    base = F.regexp_replace(F.lower(F.trim(col(c))), r"\.(ab1|abi)(\.gz)?$", "")
    return F.regexp_replace(base, r"[-_](f|r|forward|reverse)$", "")


def direction_name(c) -> Column:
    word = F.lower(F.trim(col(c)))
    return F.when(word.isin("f", "fwd", "forward"), "forward").when(word.isin("r", "rev", "reverse"), "reverse")


def safe_name(c, limit: int = 24) -> Column:
    """File-name-safe label: known suffixes cut, other characters as underscores."""
    base = F.regexp_replace(col(c), r"\.(fasta|fna|fa|tsv|csv|txt)(\.gz)?$", "")
    safe = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(safe, 1, limit)


def bracketed(c) -> Column:
    """Content of the first (...) or [...] group; the text itself when there is none."""
    inner = F.trim(F.regexp_extract(col(c), r"[\(\[](.*?)[\)\]]", 1))
    return F.when(F.rlike(col(c), F.lit(r"[\(\[].*?[\)\]]")), inner).otherwise(col(c))


def baseline_tier(dataset, explicit, token: str = "priority") -> Column:
    """Explicit tier when valid, else priority when the name carries ``token``."""
    tier = F.lower(F.trim(F.coalesce(col(explicit), F.lit(""))))
    tier = F.when(tier == "primary", "priority").otherwise(tier)
    named = F.when(F.contains(F.lower(F.coalesce(col(dataset), F.lit(""))), F.lit(token)), "priority").otherwise("secondary")
    return F.when(tier.isin("priority", "secondary"), tier).otherwise(named)


# Labels of well-known reference collections by normalised name.
REFERENCE_LABELS = {
    "hungate16s": "Hungate16S",
    "hungate": "Hungate16S",
    "silva": "SILVA",
    "rdp": "RDP",
    "homd": "HOMD",
    "greengenes2": "GreenGenes2",
    "gg2": "GreenGenes2",
    "ncbi16s": "NCBI16S",
    "gtdb": "GTDB",
}


def dataset_label(name, known: dict[str, str] = REFERENCE_LABELS) -> Column:
    """Registered label: exact normalised name, then containment either way, else the name."""
    key = F.regexp_replace(F.lower(col(name)), r"[-_\s]", "")
    exact = F.try_element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), key)
    near = [F.when(F.contains(key, F.lit(k)) | (F.contains(F.lit(k), key) & (key != "")), v) for k, v in known.items()]
    return F.coalesce(exact, *near, col(name))
