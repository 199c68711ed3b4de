"""Lineage strings, taxon names and domains as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

RANKS = ("d", "p", "c", "o", "f", "g", "s")
RANK_NAMES = ("domain", "phylum", "class", "order", "family", "genus", "species")

# Adjective and noun forms that name the same domain.
DOMAIN_ALIASES = {
    "bacterial": "bacteria",
    "bacterium": "bacteria",
    "bacteria": "bacteria",
    "archaeal": "archaea",
    "archaea": "archaea",
    "fungal": "fungi",
    "fungus": "fungi",
    "fungi": "fungi",
    "eukaryotic": "eukaryota",
    "eukarya": "eukaryota",
    "eukaryota": "eukaryota",
}

# Texts that mean "no value" in ledgers and assessment tables.
NULL_WORDS = ("", "na", "none")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it.

    Spark shares repeated expressions only where they are always computed, so not in the branches of a CASE.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def null_text(c) -> Column:
    """Trimmed text with the usual spellings of "no value" turned into NULL."""
    text = F.trim(col(c))
    return F.when(~F.lower(text).isin(*NULL_WORDS), text)


def clean_taxon(c) -> Column:
    """Trim, drop surrounding quotes, squeeze whitespace."""
    unquoted = F.regexp_replace(F.trim(col(c)), r"""^["']+|["']+$""", "")
    return F.regexp_replace(unquoted, r"\s+", " ")


def norm_taxon(c) -> Column:
    """Lower-case alphanumeric form used whenever two names are compared."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def norm_domain(c) -> Column:
    name = norm_taxon(c)
    aliases = F.create_map(*[F.lit(x) for pair in DOMAIN_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, name), name)


def lineage_map(c) -> Column:
    """``rank letter -> name``; a rank written twice keeps its last name."""

    def entry(part):
        cut = F.instr(part, "__")
        rank = F.lower(F.trim(F.substring(part, F.lit(1), cut - 1)))
        rank = F.when(rank == "superkingdom", "d").otherwise(F.substring(rank, 1, 1))
        return F.struct(rank.alias("rank"), clean_taxon(F.substring(part, cut + 2, F.length(part))).alias("name"))

    parts = F.transform(F.filter(F.split(col(c), ";"), lambda p: F.instr(p, "__") > 0), entry)
    parts = F.filter(parts, lambda p: p["name"] != "")
    # Spark refuses duplicate map keys by default, so only the last of each rank is kept.
    last = once(parts, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["rank"] == p["rank"])))
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def rank_value(lineage: Column, rank: str) -> Column:
    """Name at one rank of a parsed lineage map."""
    return F.try_element_at(lineage, F.lit(rank))


def rank_of(c, rank: str) -> Column:
    """Name at one rank straight from the lineage text: the last non-empty one.

    One anchored regular expression inside generated code; several ranks of a
    long table are much cheaper this way than through a map.
    """
    opener = {"d": "(?:d|superkingdom)", "s": "(?!superkingdom)s"}.get(rank, rank)
    name = F.regexp_extract(col(c), rf"""(?i)^(?:.*;)?\s*{opener}[^;_]*__[\s"']*([^;\s"'][^;]*)""", 1)
    return F.when(name != "", clean_taxon(name))


def species_name(c) -> Column:
    """Species of a lineage text, NULL for placeholder names."""
    name = rank_of(c, "s")
    return F.when(~F.lower(name).isin("na", "none", "unclassified"), name)


def domain_matches(taxonomy, wanted: str) -> Column:
    """Rank-aware domain/kingdom test; an unranked string must equal the domain."""
    target = norm_domain(F.lit(wanted))
    d = F.coalesce(norm_domain(rank_of(taxonomy, "d")), F.lit(""))
    k = F.coalesce(norm_domain(rank_of(taxonomy, "k")), F.lit(""))
    by_text = F.coalesce(norm_domain(taxonomy) == target, F.lit(False))
    return F.when((d != "") | (k != ""), (d == target) | (k == target)).otherwise(by_text)


def lineage_key(c) -> Column:
    """Whole-lineage comparison text: lower case, squeezed, empty parts dropped."""
    parts = F.transform(F.split(F.trim(col(c)), ";"), lambda p: F.lower(F.regexp_replace(F.trim(p), r"\s+", " ")))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), ";")
    return F.when(~F.upper(F.trim(col(c))).isin("", "NA"), joined)


def deepest_taxon(c, skip_species: bool = True) -> Column:
    """Struct(rank, name) of the deepest filled rank, NULL when none is."""
    order = [r for r in reversed(RANKS) if not (skip_species and r == "s")]
    picks = [F.when(rank_of(c, r).isNotNull(), F.struct(F.lit(r).alias("rank"), rank_of(c, r).alias("name"))) for r in order]
    return F.coalesce(*picks)


def terminal_taxon(c) -> Column:
    """Last part of a lineage that carries a name (``g__`` alone carries none)."""
    parts = F.transform(F.split(col(c), ";"), lambda p: F.trim(p))
    named = F.filter(parts, lambda p: ~p.endswith("__") & ~F.lower(p).isin(*NULL_WORDS))
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))


def display_name(c) -> Column:
    """Group label: trailing numeric tokens, then single-letter sub-groups, removed."""
    joined = F.array_join(F.filter(F.split(clean_taxon(c), r"[\s_]+"), lambda p: p != ""), "_")
    no_digits = F.regexp_replace(joined, r"(_\d+)+$", "")
    no_letter = F.regexp_replace(no_digits, r"(_[A-Za-z])+$", "")
    return F.when(F.coalesce(joined, F.lit("")).rlike(r"^[\d_]*$"), F.lit("unknown")).otherwise(no_letter)


def group_label(phylum, domain, specs: list[str]) -> Column:
    """Label of a phylum by the user's group specs; phyla that none names keep their own.

    A spec is ``archaea`` or ``bacteria`` (every phylum of that domain), a list of
    phyla named after its first, or ``Label:list``. Names match whatever their
    case, blanks and underscores; of several specs that name a phylum the last counts.
    """
    phylum, domain = col(phylum), F.lower(F.coalesce(col(domain), F.lit("")))
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[\\s_]+", "_")
    label = phylum
    for spec in filter(None, (s.strip() for s in specs)):
        if spec.lower() in ("archaea", "bacteria"):
            label = F.when(F.contains(domain, F.lit(spec.lower())) & phylum.isNotNull(), F.lit(spec.capitalize())).otherwise(label)
            continue
        head, colon, tail = spec.partition(":")
        names = [n.strip() for n in (tail if colon else spec).split(",") if n.strip()]
        if names:
            named = F.lit(head.strip() if colon else names[0])
            label = F.when(plain(phylum).isin(*[plain_name(n) for n in names]), named).otherwise(label)
    return label


def plain_name(name: str) -> str:
    return re.sub(r"[\s_]+", "_", name.strip().lower())


def agreement(left, right) -> Column:
    """Struct(deepest_shared, conflict): walk the ranks both name until one differs."""
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(name).alias("rank"), rank_of(left, r).alias("a"), rank_of(right, r).alias("b"))
            for i, (r, name) in enumerate(zip(RANKS, RANK_NAMES))
        ]
    )
    named = F.filter(
        F.transform(ranks, lambda x: F.struct(x["i"].alias("i"), x["rank"].alias("rank"), x["a"].alias("a"), x["b"].alias("b"),
                                              norm_taxon(x["a"]).alias("na"), norm_taxon(x["b"]).alias("nb"))),
        lambda x: (x["na"] != "") & (x["nb"] != ""),
    )
    walk = F.aggregate(
        named,
        F.struct(F.lit("none").alias("deepest"), F.lit("none").alias("conflict")),
        lambda acc, x: F.when(acc["conflict"] != "none", acc)
        .when(x["na"] == x["nb"], F.struct(x["rank"].alias("deepest"), F.lit("none").alias("conflict")))
        .otherwise(F.struct(acc["deepest"].alias("deepest"), F.concat(x["rank"], F.lit(":"), x["a"], F.lit("!="), x["b"]).alias("conflict"))),
    )
    ranked = lambda c: F.contains(F.coalesce(col(c), F.lit("")), F.lit("__"))
    known = ranked(left) & ranked(right)
    return F.when(known, F.struct(walk["deepest"].alias("deepest_shared"), walk["conflict"].alias("conflict")))


def reference_header(c) -> Column:
    """Struct(ref_id, taxonomy) from ``id lineage [attributes]``; lineage needs ``d__``."""
    text = F.trim(col(c))
    ref_id = F.regexp_extract(text, r"^(\S+)", 1)
    rest = F.trim(F.regexp_replace(F.regexp_extract(text, r"^\S+\s+(.*)$", 1), r"\[.*$", ""))
    lineage = F.regexp_replace(rest, r"\s*;\s*", ";")
    return F.struct(
        F.when(ref_id != "", ref_id).alias("ref_id"),
        F.when(F.instr(lineage, "d__") > 0, lineage).alias("taxonomy"),
    )
