"""Target lists: terms of hierarchy strings and matching of lineages against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isolark.functions import taxonomy as T

# Score of a match per rank, and the rank order.
RANK_SCORES = {"d": 10.0, "k": 10.0, "p": 30.0, "c": 45.0, "o": 60.0, "f": 75.0, "g": 90.0, "s": 100.0}
RANK_POSITION = {r: i for i, r in enumerate("dpcofgs")} | {"k": 0}

def _two_places(c):
    """Two decimals; the first rounding removes binary noise that would flip exact halves."""
    return F.round(F.round(c, 6), 2)


def target_terms(entries: DataFrame) -> DataFrame:
    """One row per (entry, rank, normalised name); unranked names have rank ``*``."""
    main = F.regexp_replace("hierarchy", r"\([^)]*\)", "")
    ranked_main = F.transform(
        F.filter(F.split(main, ";"), lambda p: F.instr(p, "__") > 0),
        lambda p: F.struct(
            F.substring(F.lower(F.trim(F.substring_index(p, "__", 1))), 1, 1).alias("rank"),
            T.norm_taxon(F.regexp_replace(p, r"^[^_]*__", "")).alias("name"),
        ),
    )
    inner = F.regexp_replace(F.array_join(F.regexp_extract_all("hierarchy", F.lit(r"\(([^)]*)\)"), F.lit(1)), ","), r"(?i)(^|,)\s*including\s*:?\s*", "$1")
    ranked_inner = F.transform(
        F.regexp_extract_all(inner, F.lit(r"([dkpcofgs]__[^;,()]+)"), F.lit(1)),
        lambda p: F.struct(F.substring(p, 1, 1).alias("rank"), T.norm_taxon(F.substring(p, F.lit(4), F.length(p))).alias("name")),
    )
    bare = F.transform(
        F.split(F.regexp_replace(inner, r"[dkpcofgs]__[^;,()]+", " "), r"[;,]"),
        lambda p: F.struct(F.lit("*").alias("rank"), T.norm_taxon(F.trim(p)).alias("name")),
    )
    terms = F.array_distinct(F.concat(ranked_main, ranked_inner, bare))
    exploded = entries.select("target_id", "target_role", F.explode(terms).alias("t"))
    out = exploded.select("target_id", "target_role", F.col("t.rank").alias("rank"), F.col("t.name").alias("name"))
    return out.filter((F.col("name") != "") & (F.col("name") != "including"))


def match_targets(rows: DataFrame, terms: DataFrame, min_rank: str = "p") -> DataFrame:
    """Best target per row of (id, taxonomy, identity): score, then rank score, then id."""
    floor = RANK_POSITION[min_rank]
    ranked = F.count_if((F.col("rank") != "*") & ~F.col("rank").isin("d", "k"))
    only_domain = terms.groupBy("target_id").agg((ranked == 0).alias("domain_only"))
    terms = terms.join(only_domain, "target_id").select("target_id", F.col("rank").alias("t_rank"), "name", "domain_only")
    ranks = F.array(*[F.struct(F.lit(r).alias("rank"), T.rank_of("taxonomy", r).alias("taxon")) for r in T.RANKS])
    names = rows.select("id", "identity", F.inline(ranks)).filter(F.col("taxon").isNotNull())
    names = names.withColumn("name", T.norm_taxon("taxon"))
    # Distinct names are few against the rows that carry them: resolve each
    # (rank, name) once, then bring the per-name winner back to the rows.
    position = F.create_map(*[F.lit(x) for pair in RANK_POSITION.items() for x in pair])
    allowed = ((F.col("rank") == "d") & F.col("domain_only")) | (F.try_element_at(position, F.col("rank")) >= floor)
    hit = (F.col("t_rank") == "*") | (F.col("t_rank") == F.col("rank"))
    by_name = names.select("rank", "name").distinct().join(terms, "name").filter(hit & allowed).groupBy("rank", "name").agg(F.max("target_id").alias("target_id"))
    scores = F.create_map(*[F.lit(x) for pair in RANK_SCORES.items() for x in pair])
    factor = F.coalesce(F.greatest(F.lit(0.0), F.least(F.col("identity"), F.lit(100.0))) / 100.0, F.lit(1.0))
    tax_score = F.try_element_at(scores, F.col("rank"))
    scored = names.join(by_name, ["rank", "name"]).select(
        "id", "target_id", "rank", "taxon", tax_score.alias("rank_score"), _two_places(tax_score * factor).alias("target_score")
    )
    best = scored.groupBy("id").agg(
        F.max_by(F.struct("target_id", "rank", "taxon", "rank_score", "target_score"), F.struct("target_score", "rank_score", "target_id")).alias("b")
    )
    return best.select("id", *[F.col("b." + c).alias(c) for c in ("target_id", "rank", "taxon", "rank_score", "target_score")])


def evaluation_score(investigation, target_score, novelty):
    """Blend of the investigation (or else novelty) score with the target score."""
    target = F.coalesce(T.col(target_score), F.lit(0.0))
    with_inv = 0.75 * T.col(investigation) + 0.25 * target
    without = 0.65 * F.coalesce(T.col(novelty), F.lit(0.0)) + 0.35 * target
    return _two_places(F.least(F.lit(100.0), F.coalesce(with_inv, without)))
