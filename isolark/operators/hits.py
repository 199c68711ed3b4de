"""Operators over alignment hits: parsing, best hit, density, pools, cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from isolark.functions import scores
from isolark.functions.taxonomy import lineage_key

HIT_FIELDS = ("query", "target", "identity", "alnlen", "mismatches", "gaps", "qlo", "qhi", "tlo", "thi", "ql", "tl", "query_coverage", "target_coverage")
NEAREST_FLOOR, DENSITY_FLOOR, MIN_COVERAGE = 50.0, 95.0, 70.0
RETRY_COVERAGES = (70.0, 50.0, 30.0, 0.0)


def parse_hit_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated hit rows of 14, 12 or at least 3 columns to typed hits.

    Rows with fewer than three fields or no usable identity are skipped; the
    12-column form has no coverage, so it is derived from alignment length.
    """
    lines = lines.select(F.split(column, "\t").alias("p"))
    parts = F.col("p")
    at = lambda i: F.try_element_at(parts, F.lit(i + 1))
    num = lambda i: at(i).try_cast("double")
    count = lambda i: num(i).try_cast("int")
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)))
    fields = F.struct(
        F.trim(at(0)).alias("query"),
        F.trim(at(1)).alias("target"),
        num(2).alias("identity"),
        *[count(i).alias(HIT_FIELDS[i]) for i in range(3, 12)],
        num(12).alias("_qcov"),
        num(13).alias("_tcov"),
        F.size(parts).alias("_n"),
    )
    # The generator settles the fields: conditions and rules above it read columns instead of parsing again.
    wide = lines.select(F.inline(F.array(fields))).filter((F.col("_n") >= 3) & F.col("identity").isNotNull() & (F.col("query") != ""))
    from_length = lambda length: F.when(F.col(length) > 0, 100.0 * F.col("alnlen") / F.col(length))
    rated = wide.select(*HIT_FIELDS[:12], F.inline(F.array(F.struct(F.coalesce("_qcov", from_length("ql")).alias("_q"), F.coalesce("_tcov", from_length("tl")).alias("_t")))))
    return rated.select(*HIT_FIELDS[:12], F.round(clamp(F.col("_q")), 4).alias("query_coverage"), F.round(clamp(F.col("_t")), 4).alias("target_coverage"))


def admitted(hits: DataFrame, floor: float, min_coverage: float, exclude_self: bool = True) -> DataFrame:
    keep = (F.col("identity") >= floor) & (F.col("query_coverage") >= min_coverage)
    if exclude_self:
        keep = keep & (F.col("query") != F.col("target"))
    return hits.filter(keep)


def best_key() -> Column:
    """Ordering of hits: higher identity first, then the smaller ordinal and target."""
    return F.struct((-F.col("identity")).alias("i"), F.col("ordinal"), F.col("target"))


def best_hit(hits: DataFrame, keys=("query",), extra=("alnlen",)) -> DataFrame:
    """Best hit per key by partial aggregation, so a hot query never fills one task."""
    fields = ("target", "identity", "query_coverage", *extra)
    top = F.min_by(F.struct(*fields), best_key())
    return hits.groupBy(*keys).agg(top.alias("b")).select(*keys, *[F.col("b." + f).alias(f) for f in fields])


def nearest(queries: DataFrame, hits: DataFrame, floor=NEAREST_FLOOR, min_coverage=MIN_COVERAGE) -> DataFrame:
    """One row per query; no admitted hit means identity 0 and a NULL target."""
    best = best_hit(admitted(hits, floor, min_coverage))
    return queries.select("query").join(best, "query", "left").select(
        "query",
        F.col("target").alias("nearest_hit"),
        F.coalesce("identity", F.lit(0.0)).alias("nearest_identity"),
        F.col("query_coverage").alias("nearest_query_coverage"),
        F.col("alnlen").alias("nearest_alignment_length"),
    )


def density_aggs() -> list[Column]:
    return [
        F.count_if((F.col("identity") >= t) & (F.col("query_coverage") >= MIN_COVERAGE)).alias(f"matches_ge_{int(t)}")
        for t in (99.0, 97.0, 95.0)
    ]


def density(queries: DataFrame, hits: DataFrame) -> DataFrame:
    counts = admitted(hits, DENSITY_FLOOR, MIN_COVERAGE).groupBy("query").agg(*density_aggs())
    out = queries.select("query").join(counts, "query", "left")
    return out.select("query", *[F.coalesce(f"matches_ge_{t}", F.lit(0)).alias(f"matches_ge_{t}") for t in (99, 97, 95)])


def metrics(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Nearest hit, density, score, crowding and priority in one aggregation of the hits."""
    usable = admitted(hits, NEAREST_FLOOR, MIN_COVERAGE)
    agg = usable.groupBy("query").agg(
        F.min_by(F.struct("target", "identity", "query_coverage", "alnlen"), best_key()).alias("b"), *density_aggs()
    )
    joined = queries.select("query").join(agg, "query", "left")
    return score_metrics(
        joined.select(
            "query",
            F.col("b.target").alias("nearest_hit"),
            F.coalesce("b.identity", F.lit(0.0)).alias("nearest_identity"),
            F.col("b.query_coverage").alias("nearest_query_coverage"),
            *[F.coalesce(f"matches_ge_{t}", F.lit(0)).alias(f"matches_ge_{t}") for t in (99, 97, 95)],
        )
    )


def score_metrics(df: DataFrame) -> DataFrame:
    ident, g99, g97, g95 = "nearest_identity", "matches_ge_99", "matches_ge_97", "matches_ge_95"
    return df.withColumns(
        {
            "novelty_score": scores.novelty_score(ident, g99, g97, g95),
            "crowding": scores.crowding(g99, g97),
            "sequencing_priority": scores.sequencing_priority(ident, g99, g97),
            "novel": F.col(ident) < scores.NOVEL_BELOW,
        }
    )


def pool_tags(pool) -> Column:
    """Pools a hit counts for: both baseline tiers also form the combined baseline."""
    pool = F.col(pool) if isinstance(pool, str) else pool
    return F.when(pool.isin("priority", "secondary"), F.array(pool, F.lit("combined"))).otherwise(F.array(pool))


def pool_metrics(queries: DataFrame, tagged_hits: DataFrame, pools: DataFrame) -> DataFrame:
    """Metrics per (query, pool) from hits tagged with every pool their target is in.

    ``pools`` is the short list of pools that were searched; a pool that was
    searched without a hit scores 100, one that was not searched is not listed.
    """
    by_pool = tagged_hits.select("*", F.explode("pools").alias("_pool")).drop("pool").withColumnRenamed("_pool", "pool")
    agg = (
        admitted(by_pool, NEAREST_FLOOR, MIN_COVERAGE)
        .groupBy("query", "pool")
        .agg(F.min_by(F.struct("target", "identity", "query_coverage"), best_key()).alias("b"), *density_aggs())
    )
    names = pools.agg(F.array_sort(F.collect_set("pool"))).scalar()
    frame = queries.select("query", F.explode(names).alias("pool"))
    joined = frame.join(agg, ["query", "pool"], "left")
    return score_metrics(
        joined.select(
            "query",
            "pool",
            F.col("b.target").alias("nearest_hit"),
            F.coalesce("b.identity", F.lit(0.0)).alias("nearest_identity"),
            F.col("b.query_coverage").alias("nearest_query_coverage"),
            *[F.coalesce(f"matches_ge_{t}", F.lit(0)).alias(f"matches_ge_{t}") for t in (99, 97, 95)],
        )
    )


def retry_cascade(queries: DataFrame, hits: DataFrame, floor: float = 80.0) -> DataFrame:
    """Best hit at the first coverage threshold that admits any hit, and which round it was."""
    rounds = F.lit(None).cast("int")
    for number, threshold in reversed(list(enumerate(RETRY_COVERAGES, start=1))):
        rounds = F.when(F.col("query_coverage") >= threshold, number).otherwise(rounds)
    usable = hits.filter(F.col("identity") >= floor).withColumn("round", rounds).filter("round is not null")
    # Hits of the first round are those of the smallest round number, so one
    # aggregation ordered by (round, best) replaces the repeated searches.
    key = F.struct(F.col("round"), best_key().alias("k"))
    best = usable.groupBy("query").agg(F.min_by(F.struct("round", "target", "identity"), key).alias("b"))
    return queries.select("query").join(best, "query", "left").select(
        "query", F.col("b.round").alias("round"), F.col("b.target").alias("best_hit"), F.col("b.identity").alias("identity")
    )


def classify(queries: DataFrame, hits: DataFrame, taxonomy: DataFrame, floor: float = 80.0) -> DataFrame:
    """Best hit with its lineage; confidence falls back to identity / 100."""
    best = best_hit(admitted(hits, floor, MIN_COVERAGE, exclude_self=False))
    out = queries.select("query").join(best, "query", "left").join(taxonomy, "target", "left")
    return out.select(
        "query",
        F.col("target").alias("best_hit"),
        "identity",
        "query_coverage",
        F.when(F.col("target").isNotNull(), F.coalesce("taxonomy", F.lit("NA"))).alias("taxonomy"),
        F.coalesce("confidence", F.round(F.col("identity") / 100.0, 4)).alias("confidence"),
    )


def disagreement(hits: DataFrame, taxonomy: DataFrame, threshold: float = 97.0) -> DataFrame:
    """Queries whose high-identity hits resolve to two or more lineages.

    One row per (query, lineage) with its hit count and best hit, beside the
    query's totals; a query with very many lineages never has to fit in one row.
    """
    named = (
        hits.filter(F.col("identity") >= threshold)
        .join(taxonomy.select("target", "taxonomy"), "target", "left")
        .withColumn("tax_key", lineage_key("taxonomy"))
    )
    groups = named.groupBy("query", "tax_key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("target", "identity"), best_key()).alias("b"), F.min("taxonomy").alias("taxon")
    )
    known = F.col("tax_key").isNotNull()
    totals = groups.groupBy("query").agg(
        F.sum("n").alias("high_quality_hits"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("assigned_hits"), F.count("tax_key").alias("distinct_taxa")
    )
    mixed = groups.filter(known).join(totals.filter("distinct_taxa >= 2"), "query")
    return mixed.select(
        "query", "high_quality_hits", "assigned_hits", "distinct_taxa", "taxon", F.col("n").alias("hits"), F.col("b.identity").alias("best_identity"), F.col("b.target").alias("best_hit")
    )


def top_hits(hits: DataFrame, k: int = 10, floor: float = 80.0) -> DataFrame:
    """The k best hits per query; Spark trims each task to k rows before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc("identity"), "ordinal", "target")
    return hits.filter(F.col("identity") >= floor).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def parse_chimera_lines(lines: DataFrame) -> DataFrame:
    """(id, call, score, left_parent, right_parent) of a score-first chimera table: score, query, parents, ..., verdict last.

    Lines without a query are left out; a score that is no number is null, and a
    verdict other than Y or N is INDETERMINATE.
    """
    cells = F.split("value", "\t")
    cell = lambda at: F.coalesce(F.get("c", F.lit(at)), F.lit(""))
    verdict = F.upper(F.trim(F.element_at("c", -1)))
    call = F.when(verdict == "Y", "CHIMERA").when(verdict == "N", "PASS").otherwise("INDETERMINATE")
    rows = lines.select(cells.alias("c")).filter((F.size("c") >= 2) & (cell(1) != ""))
    return rows.select(cell(1).alias("id"), call.alias("call"), F.trim(cell(0)).try_cast("double").alias("score"), cell(2).alias("left_parent"), cell(3).alias("right_parent"))


def chimera_report(queries: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row per query (id) with its verdict; a query that the table doesn't hold is INDETERMINATE."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return queries.select("id").join(parsed, "id", "left").select("id", F.coalesce("call", F.lit("INDETERMINATE")).alias("call"), "score", blank("left_parent"), blank("right_parent"))
