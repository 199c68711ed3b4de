"""Sequence-collection operators: QC gate, dereplication, filters, key resolution."""

from __future__ import annotations

from itertools import count as attempts

from pyspark.sql import Column, DataFrame, functions as F

from isolark.functions import identifiers as I, taxonomy as T


def qc_gate(seqs: DataFrame, min_len: int = 800, max_n_percent: float = 5.0) -> DataFrame:
    """Length, N statistics and every rejection reason of each sequence; no row is dropped."""
    if not 0.0 <= max_n_percent <= 100.0:
        raise ValueError("max_n_percent must be between 0 and 100")
    size, n_pct = F.length("sequence"), I.n_percent("sequence")
    reasons = F.array_compact(
        F.array(F.when(size < min_len, "too_short"), F.when(n_pct > max_n_percent, "too_many_n"))
    )
    return seqs.withColumns(
        {
            "length": size,
            "n_count": I.n_count("sequence"),
            "n_percent": F.round(n_pct, 6),
            "reasons": F.array_join(reasons, ";"),
            "kept": F.size(reasons) == 0,
        }
    )


def qc_totals(gated: DataFrame, sample: int = 10) -> DataFrame:
    """Counts per outcome with a few example ids (the smallest), without collecting all ids."""
    short, many = F.contains("reasons", F.lit("too_short")), F.contains("reasons", F.lit("too_many_n"))
    totals = gated.agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("rejected_total"),
        F.count_if(short).alias("rejected_too_short"),
        F.count_if(many).alias("rejected_too_many_n"),
    )
    first = gated.filter("kept").select("seq_no", "id").orderBy("seq_no").limit(sample)
    names = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", "id"))), lambda r: r["id"]), ";")).scalar()
    return totals.withColumn("sample_kept", names)


def dereplicate(seqs: DataFrame) -> DataFrame:
    """Member map of exact copies: every id with its representative and the copy count.

    The representative is the first-seen record.  Both halves aggregate before
    they shuffle, so a group of copies never meets in one task.
    """
    keyed = seqs.select("id", "seq_no", F.md5("sequence").alias("digest"))
    groups = keyed.groupBy("digest").agg(F.min_by("id", "seq_no").alias("representative"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(groups, "digest").select("id", "digest", "representative", "copies", (F.col("id") == F.col("representative")).alias("is_representative"))


def domain_filter(df: DataFrame, domain: str, prune: bool = False, column: str = "taxonomy") -> DataFrame:
    """Keep one domain; the prune form only drops records known to belong elsewhere."""
    match = T.domain_matches(column, domain)
    unknown = T.null_text(column).isNull()
    return df.filter(match | unknown) if prune else df.filter(match & F.col(column).isNotNull())


def taxon_slice(df: DataFrame, taxon: str, rank: str = "auto", min_rows: int = 3) -> DataFrame:
    """Members of one taxon; empty when it has fewer than ``min_rows`` members."""
    if "__" in taxon:
        prefix, taxon = taxon.split("__", 1)
        rank = prefix[:1].lower()
    elif rank == "auto":
        rank = "d" if taxon.strip().lower() in T.DOMAIN_ALIASES else "p"
    wanted = "".join(ch for ch in taxon.lower() if ch.isalnum() and ch.isascii())
    value = T.rank_of("taxonomy", rank)
    if rank == "d":
        hit = T.norm_domain(value) == F.lit(T.DOMAIN_ALIASES.get(wanted, wanted))
    else:
        hit = T.norm_taxon(value) == F.lit(wanted)
    members = df.filter(hit)
    return members.filter(members.agg(F.count(F.lit(1))).scalar() >= min_rows)


def pool_select(seqs: DataFrame, run_dataset: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Pool members: non-empty sequences, the running batch and excluded datasets left out."""
    keep = F.coalesce(F.length("sequence") > 0, F.lit(False))
    if run_dataset is not None:
        keep = keep & ~F.col("dataset").eqNullSafe(run_dataset)
    if include:
        keep = keep & F.coalesce(F.col("dataset").isin(*include), F.lit(False))
    if exclude:
        keep = keep & ~F.coalesce(F.col("dataset").isin(*exclude), F.lit(False))
    return seqs.filter(keep)


def project_pool(seqs: DataFrame, roles: DataFrame, reference: DataFrame) -> DataFrame:
    """The project's pool by what there is: sequences of candidate datasets, if any is registered; else of all datasets but baselines; else ``reference``.

    ``pool`` names the choice. The counts behind it are subqueries of one plan, so
    nothing is decided while the plan is built.
    """
    usable = seqs.filter(F.coalesce(F.length("sequence") > 0, F.lit(False)))
    candidates = roles.filter("role = 'candidate'").agg(F.count(F.lit(1)))
    known = roles.select("dataset", "role").dropDuplicates(["dataset"])
    placed = usable.join(known, "dataset", "left").withColumn("_some", candidates.scalar() > 0)
    own = placed.filter(F.when(F.col("_some"), F.col("role").eqNullSafe("candidate")).otherwise(~F.col("role").eqNullSafe("baseline")))
    named = own.select("id", "sequence", F.lit("project_collection").alias("pool"))
    return named.unionByName(reference.select("id", "sequence", F.lit("reference").alias("pool")).filter(named.agg(F.count(F.lit(1))).scalar() == 0))


def exclude_anchors(df: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    return df.filter(~F.startswith(F.col(column), F.lit(prefix)))


def allow_list(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(column), column, "left_semi")


def resolve_by_keys(left: DataFrame, left_id: str, right: DataFrame, right_id: str, value: str) -> DataFrame:
    """Match two identifier columns through their lookup keys, most specific key first.

    Each reference key belongs to one record (the smallest id), so a hot key
    joins to one row and the result keeps exactly one row per left id.
    """
    keyed = lambda df, c: df.select("*", F.posexplode(I.lookup_keys(c)).alias("priority", "key"))
    reference = keyed(right, right_id).groupBy("key").agg(
        F.min_by(F.struct(F.col(right_id).alias("rid"), F.col(value).alias("val")), F.struct("priority", right_id)).alias("r")
    )
    probes = keyed(left.select(left_id).distinct(), left_id)
    found = (
        probes.join(reference, "key")
        .groupBy(left_id)
        .agg(F.min_by(F.struct("key", "r"), F.struct("priority", "key")).alias("m"))
    )
    return left.join(found, left_id, "left").select(
        *left.columns, F.col("m.key").alias("matched_key"), F.col("m.r.rid").alias("matched_id"), F.col("m.r.val").alias("value")
    )


def consistency(left: DataFrame, right: DataFrame, key: str = "key", limit: int = 25, warn_below: float = 0.8) -> DataFrame:
    """Overlap of two id sets: counts, ratio, warning and the first missing ids of each side."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    left_only, right_only = F.col("_b").isNull(), F.col("_a").isNull()
    totals = both.agg(
        F.count("_a").alias("left_ids"),
        F.count("_b").alias("right_ids"),
        F.count_if(F.col("_a") & F.col("_b")).alias("shared"),
    )

    def first(condition: Column) -> Column:
        few = both.filter(condition).select(key).orderBy(key).limit(limit)
        return few.agg(F.array_join(F.array_sort(F.collect_list(key)), ";")).scalar()

    ratio = F.col("shared") / F.greatest("left_ids", F.lit(1))
    return totals.select(
        "*", F.round(ratio, 4).alias("overlap"), (ratio < warn_below).alias("warn"),
        first(left_only).alias("left_only"), first(right_only).alias("right_only"),
    )


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Earliest row per key, by aggregation so hot keys stay spread until combined."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col("_r." + c).alias(c) for c in rest]).select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Latest row per key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col("_r." + c).alias(c) for c in rest]).select(*df.columns)


def short_ids(records: DataFrame, header: str = "header", order: str = "seq_no") -> DataFrame:
    """Unique compact ids: losers of a collision try again with the next attempt number.

    What is settled meets every attempt, so it is never broadcast: the driver would
    gather all ids once per attempt.
    """
    from isolark.session import cut_lineage

    pending = cut_lineage(records.select(header, order))
    if pending.count() > 26**3 * 100:
        raise ValueError("more headers than compact ids can hold; use the full identifiers")
    done = None
    for attempt in attempts():
        tries = pending.withColumn("short_id", I.short_id(header, F.lit(attempt)))
        if done is not None:
            free = tries.join(done.select("short_id").hint("merge"), "short_id", "left_anti")
        else:
            free = tries
        won = free.groupBy("short_id").agg(F.min_by(F.struct(header, order), order).alias("w"))
        won = won.select("short_id", F.col(f"w.{header}").alias(header), F.col(f"w.{order}").alias(order))
        done = cut_lineage(won if done is None else done.unionByName(won))
        pending = cut_lineage(pending.join(done.select(order).hint("merge"), order, "left_anti"))
        if pending.isEmpty():
            return done


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``name``, ``name__dup1``, ``name__dup2`` ... in order of appearance."""
    from isolark.operators.ordered import running_number

    numbered = running_number(df, name, [order], "_copy")
    suffix = F.concat(F.col(name), F.lit("__dup"), (F.col("_copy") - 1).cast("string"))
    return numbered.withColumn("unique_name", F.when(F.col("_copy") == 1, F.col(name)).otherwise(suffix)).drop("_copy")


def first_taxonomy(sequences: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row per id: its first dataset and its first non-empty taxonomy.

    A taxonomy row counts for a sequence of the same id if it names the same
    dataset or none. The two cases are two keyed joins with one row per key on
    the right, so the condition needs no nested loop and no key multiplies rows.
    Taxonomies of earlier datasets come first, within one those that name it.
    """
    stated = taxonomy.filter(F.coalesce("taxonomy", F.lit("")) != "")
    own = stated.filter("dataset IS NOT NULL").groupBy("id", "dataset").agg(F.min("taxonomy").alias("own"))
    general = stated.filter("dataset IS NULL").groupBy("id").agg(F.min("taxonomy").alias("general"))
    lean = sequences.select("id", "dataset").distinct()
    found = lean.join(own, ["id", "dataset"], "left").join(general, "id", "left").withColumn("taxonomy", F.coalesce("own", "general"))
    return found.groupBy("id").agg(F.min("dataset").alias("dataset"), F.min_by("taxonomy", F.when(F.col("taxonomy").isNotNull(), F.coalesce("dataset", F.lit("")))).alias("taxonomy"))
