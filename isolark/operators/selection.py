"""Constrained selection: gates, diversity panels, sequencing sets, budgeted rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from isolark.functions import scores, taxonomy as T
from isolark.functions.identifiers import stable_set_id
from isolark.operators.trees import nearest_marked, root_depth
from isolark.session import cut_lineage

# Strength of a target rank, of metadata rarity and of evidence.
TARGET_STRENGTH = {"species": 5, "s": 5, "genus": 4, "g": 4, "family": 3, "f": 3, "order": 2, "o": 2, "class": 1, "c": 1, "phylum": 0, "p": 0}
RARITY_STRENGTH = {"high": 2, "moderate": 1, "low": 0, "na": 0}
QUALITY_STRENGTH = {"HIGH": 2, "MODERATE": 1, "LOW": 0}


def _rank(table: dict, c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(0))


def leaf_paths(closed: DataFrame, leaves: DataFrame) -> DataFrame:
    """Root path of each requested leaf as an array; its length is the depth of the tree."""
    depth = root_depth(closed).select(F.col("node_id").alias("ancestor_id"), "root_dist")
    rows = closed.join(leaves.select(F.col("leaf").alias("node_id")).distinct(), "node_id", "left_semi").join(depth, "ancestor_id")
    return rows.groupBy(F.col("node_id").alias("leaf")).agg(
        F.collect_list(F.struct(F.col("ancestor_id").alias("v"), F.col("root_dist").alias("d"))).alias("path"),
        F.max("root_dist").alias("leaf_dist"),
    )


def _distance_to_pick() -> Column:
    shared = F.filter("path", lambda x: F.array_contains(F.col("p_nodes"), x["v"]))
    fork = F.array_max(F.transform(shared, lambda x: x["d"]))
    return F.col("leaf_dist") + F.col("p_dist") - 2.0 * fork


def contenders(candidates: DataFrame, anchors: DataFrame, closed: DataFrame, size: int, maximise: bool) -> DataFrame:
    """``candidates`` with their start ``spread``, without those that ``size`` farthest-first picks of a group can't reach.

    Of the members of one leaf the first ``size`` by evidence can be picked. Leaves
    that hang on one parent by the same branch have the same distance to all
    others and to each other, so of those with the same start the first ``size``
    by evidence can. Where no anchor stands on them, a longer branch means a larger
    distance throughout, so that ``size`` clearly longer ones leave a leaf no turn;
    only while there is no distance at all evidence alone decides.
    """
    order = F.desc if maximise else F.asc
    up = closed.filter("hops = 1").select(F.col("node_id").alias("leaf"), F.col("ancestor_id").alias("parent"))
    inner = up.select(F.col("parent").alias("leaf"), F.lit(True).alias("inner")).distinct()
    place = root_depth(closed).select(F.col("node_id").alias("leaf"), "root_dist").join(up, "leaf", "left").join(inner, "leaf", "left")
    # What hangs below an inner node is nearer to it than to its siblings.
    place = place.select("leaf", "root_dist", F.when(F.col("inner"), F.col("leaf")).otherwise(F.coalesce("parent", "leaf")).alias("twin"))
    start = nearest_marked(candidates, anchors, closed, "grp", exclude_self=not maximise).withColumnRenamed("distance", "spread")
    marked = anchors.select("grp", "leaf", F.lit(True).alias("marked")).distinct()
    own = Window.partitionBy("grp", "leaf").orderBy(order("evidence"))
    rows = candidates.select("grp", "id", "leaf", "evidence").withColumns({"_n": F.row_number().over(own), "_lead": F.first("evidence").over(own)}).filter(F.col("_n") <= size)
    rows = rows.join(place, "leaf", "left").join(start, ["grp", "leaf"], "left").join(marked, ["grp", "leaf"], "left")
    twins = Window.partitionBy("grp", "twin", "root_dist", "spread", "marked").orderBy(order("_lead"))
    rows = cut_lineage(rows.withColumn("_t", F.dense_rank().over(twins)).filter(F.col("_t") <= size))
    # Length of the branch that ``size`` leaves of the parent reach, of those that no anchor stands on.
    longest = Window.partitionBy("grp", "twin").orderBy(F.desc("root_dist"), "leaf")
    free = rows.filter("_n = 1 and marked is null and twin is not null")
    least = free.withColumn("_r", F.row_number().over(longest)).filter(F.col("_r") == size).select("grp", "twin", F.col("root_dist").alias("least"))
    first = Window.partitionBy("grp", "twin", F.col("spread").isNull(), "marked").orderBy(order("_lead"))
    rows = rows.join(least, ["grp", "twin"], "left").withColumn("_e", F.dense_rank().over(first))
    near = F.col("root_dist") >= F.col("least") - (F.col("least") + 1.0) * 1e-9
    kept = F.col("marked").isNotNull() | F.col("least").isNull() | near | (F.col("spread").isNull() & (F.col("_e") <= size))
    return rows.filter(kept).select("grp", "id", "leaf", "evidence", "spread")


class FarthestFirst:
    """Picks one more member of every group per step, all groups in parallel, at most ``size``.

    One step is a partially aggregated arg-max per group and one join of the
    group's pick back to its candidates; a group of any size is never gathered.
    Steps walk over :func:`contenders` only, whose number the size of the tree's
    inner part bounds.
    """

    def __init__(self, candidates: DataFrame, anchors: DataFrame, closed: DataFrame, maximise: bool, size: int):
        self.maximise = maximise
        rows = cut_lineage(contenders(candidates, anchors, closed, size, maximise))
        self.state = cut_lineage(rows.join(leaf_paths(closed, rows), "leaf", "left").select("grp", "id", "leaf", "path", "leaf_dist", "evidence", "spread"))
        self.picks: DataFrame | None = None
        self.step = 0

    def key(self) -> Column:
        has, spread = F.col("spread").isNotNull(), F.coalesce("spread", F.lit(0.0))
        if self.maximise:
            return F.struct(has.cast("int").alias("k0"), spread.alias("k1"), F.col("evidence"))
        return F.struct((1 - has.cast("int")).alias("k0"), (-spread).alias("k1"), F.col("evidence"))

    def advance(self) -> None:
        self.step += 1
        choose = F.max_by if self.maximise else F.min_by
        pick = self.state.groupBy("grp").agg(
            choose(F.struct("id", "leaf", "spread", "leaf_dist", "path", self.key().alias("key")), self.key()).alias("w")
        )
        pick = cut_lineage(
            pick.select(
                "grp", F.col("w.id").alias("id"), F.col("w.spread").alias("spread"), F.col("w.key").alias("key"), F.col("w.leaf").alias("p_leaf"),
                F.transform("w.path", lambda x: x["v"]).alias("p_nodes"), F.col("w.leaf_dist").alias("p_dist"), F.lit(self.step).alias("rank"),
            )
        )
        self.picks = pick if self.picks is None else self.picks.unionByName(pick)
        joined = self.state.join(pick.select("grp", F.col("id").alias("p_id"), "p_leaf", "p_nodes", "p_dist"), "grp")
        new = _distance_to_pick()
        if not self.maximise:
            new = F.when(F.col("leaf") != F.col("p_leaf"), new)
        rest = joined.filter(F.col("id") != F.col("p_id")).withColumn("spread", F.least("spread", new))
        # Materialised every step: the next step reads it twice.
        self.state = cut_lineage(rest.select(*self.state.columns))


def diversity_panel(candidates: DataFrame, anchors: DataFrame, closed: DataFrame, size: int = scores.PANEL_SIZE) -> DataFrame:
    """Farthest-first ranks 1..size per group of (grp, id, leaf, evidence)."""
    walk = FarthestFirst(candidates, anchors, closed, maximise=True, size=size)
    for _ in range(size):
        walk.advance()
    return walk.picks.select("grp", "id", "rank", F.round("spread", 6).alias("spread"))


def panel_evidence(rank_label="evidence_class") -> Column:
    """Tie-breaking evidence of a panel candidate; larger is preferred, id last."""
    missing = lambda c: 100.0 - F.coalesce(c, F.lit(100.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(
        scores.evidence_rank(rank_label, "nearest_identity", "nearest_query_coverage").alias("e0"),
        _rank(QUALITY_STRENGTH, F.col("quality")).alias("e1"),
        missing("nearest_identity").alias("e2"),
        missing("project_nearest_identity").alias("e3"),
        missing("reference_nearest_identity").alias("e4"),
        zero("isolation").alias("e5"),
        _rank(RARITY_STRENGTH, F.lower("rarity_strength")).alias("e6"),
        zero("rarity_score").alias("e7"),
        _rank(TARGET_STRENGTH, F.lower("target_rank")).alias("e8"),
        zero("target_score").alias("e9"),
        zero("classification_confidence").alias("e10"),
        F.col("id").alias("e11"),
    )


def round_evidence() -> Column:
    """Ordering of a round candidate after its distance; smaller is preferred, id last."""
    away = lambda c: -F.when(F.col(c) > 0, F.greatest(F.lit(0.0), 100.0 - F.col(c))).otherwise(F.lit(0.0))
    less = lambda c: -F.coalesce(c, F.lit(0.0))
    divergence = lambda c: F.coalesce(away(c), F.lit(0.0))
    return F.struct(
        (-scores.evidence_rank("evidence_class")).alias("e0"),
        divergence("nearest_genome_identity").alias("e1"),
        divergence("nearest_identity").alias("e2"),
        divergence("project_nearest_identity").alias("e3"),
        divergence("reference_nearest_identity").alias("e4"),
        less("isolation").alias("e5"),
        (-_rank(RARITY_STRENGTH, F.lower("rarity_strength"))).alias("e6"),
        less("rarity_score").alias("e7"),
        (-_rank(TARGET_STRENGTH, F.lower("target_rank"))).alias("e8"),
        less("target_score").alias("e9"),
        F.col("id").alias("e10"),
    )


def _tier(hit: str, identity: str, coverage: str, taxonomy: str, label: str) -> Column:
    return F.struct(
        F.lit(label).alias("label"), F.col(hit).alias("hit"), F.col(identity).alias("identity"), F.col(coverage).alias("coverage"),
        T.norm_taxon(T.species_name(taxonomy)).alias("species"),
    )


def baseline_hits(rows: DataFrame) -> DataFrame:
    """Baseline hit records per row; the combined pool only counts when no tier has a hit."""
    tiers = F.filter(
        F.array(
            _tier("priority_hit", "priority_identity", "priority_coverage", "priority_taxonomy", "PRIORITY_BASELINE"),
            _tier("secondary_hit", "secondary_identity", "secondary_coverage", "secondary_taxonomy", "SECONDARY_BASELINE"),
        ),
        lambda r: r["hit"].isNotNull(),
    )
    return rows.withColumn("hits", tiers)


def redundancy(identity=scores.REDUNDANT[0], coverage=scores.REDUNDANT[1]) -> Column:
    """Is any baseline hit near-identical over nearly all of the query?"""
    by_hit = F.exists("hits", lambda r: F.coalesce((r["identity"] >= identity) & (r["coverage"] >= coverage), F.lit(False)))
    combined = F.coalesce((F.col("nearest_identity") >= identity) & (F.col("nearest_query_coverage") >= coverage), F.lit(False))
    return F.when(F.size("hits") > 0, by_hit).otherwise(combined)


def extension_status(identity=scores.EXTENSION[0], coverage=scores.EXTENSION[1]) -> Column:
    """ELIGIBLE_* for the first tier that can be extended, else the first failure."""
    own = F.col("species_key")

    def verdict(r):
        return (
            F.when(r["species"].isNull(), F.concat(r["label"], F.lit("_SPECIES_UNRESOLVED")))
            .when(r["species"] != own, F.concat(r["label"], F.lit("_SPECIES_MISMATCH")))
            .when(r["identity"].isNull() | (r["identity"] < identity), F.concat(r["label"], F.lit("_IDENTITY_BELOW_EXTENSION_THRESHOLD")))
            .when(r["coverage"].isNull() | (r["coverage"] < coverage), F.concat(r["label"], F.lit("_COVERAGE_BELOW_EXTENSION_THRESHOLD")))
            .otherwise(F.concat(F.lit("ELIGIBLE_"), r["label"], F.lit("_EXTENSION")))
        )

    verdicts = F.transform("hits", verdict)
    eligible = F.filter(verdicts, lambda v: F.startswith(v, F.lit("ELIGIBLE_")))
    return (
        F.when(own.isNull(), "CANDIDATE_SPECIES_UNRESOLVED")
        .when(F.size("hits") == 0, "BASELINE_HIT_UNAVAILABLE")
        .otherwise(F.coalesce(F.try_element_at(eligible, F.lit(1)), F.try_element_at(verdicts, F.lit(1))))
    )


def grouped(rows: DataFrame, clades: DataFrame) -> DataFrame:
    """Selection group: species when named, else local clade plus deepest named rank."""
    deepest = T.deepest_taxon("taxonomy")
    local = F.concat(
        F.lit("local:"), F.coalesce("clade", F.lit("no_tree_context")), F.lit("|"),
        F.coalesce(F.concat(F.col("_deep.rank"), F.lit(":"), T.norm_taxon("_deep.name")), F.lit("unclassified")),
    )
    named = rows.join(clades.select(F.col("node_id").alias("leaf"), "clade"), "leaf", "left")
    named = named.withColumns({"species_key": T.norm_taxon(T.species_name("taxonomy")), "_deep": deepest})
    return named.withColumn("grp", F.when(F.col("species_key").isNotNull(), F.concat(F.lit("species:"), "species_key")).otherwise(local)).drop("_deep")


def group_header(rows: DataFrame, target: int = scores.GENOME_TARGET) -> DataFrame:
    """Per group: committed genomes (reported maxima or the distinct ids), gap and kind."""
    yes = F.col("available") | F.col("selected")
    top = lambda c: F.max(F.coalesce(c, F.lit(0)))
    agg = rows.groupBy("grp").agg(
        top("priority_count").alias("n_priority"),
        top("secondary_count").alias("n_secondary"),
        top("selected_count").alias("n_selected"),
        top("pending_count").alias("n_pending"),
        F.count_if(yes).alias("n_ids"),
        F.count(F.lit(1)).alias("n_members"),
        F.max(F.col("species_key").isNotNull()).alias("_species"),
    )
    committed = F.greatest(F.col("n_priority") + F.col("n_secondary") + F.col("n_selected") + F.col("n_pending"), F.col("n_ids"))
    kind = (
        F.when(F.col("_species") & (F.col("n_priority") > 0), "PRIORITY_BASELINE_EXTENSION")
        .when(F.col("_species") & (F.col("n_secondary") > 0), "SECONDARY_BASELINE_EXTENSION")
        .otherwise("CANDIDATE_ONLY_GROUP")
    )
    prefix = F.when(kind == "CANDIDATE_ONLY_GROUP", "ISSET").otherwise("ISEXT")
    return agg.select(
        "grp", "n_members", committed.alias("committed"), F.greatest(F.lit(0), target - committed).alias("gap"),
        kind.alias("group_type"), stable_set_id("grp", prefix).alias("set_id"),
    )


def gated(rows: DataFrame, header: DataFrame, include_moderate: bool = True) -> DataFrame:
    """Role of every row before ranking; rows that reach the panel are ``ELIGIBLE``."""
    checked = baseline_hits(rows.join(header, "grp"))
    checked = checked.withColumns(
        {
            "quality": scores.evidence_quality(
                "placement_flags", "classification_identity", "classification_confidence", "classification_query_coverage", "taxonomy"
            ),
            "redundant": redundancy(),
            "extension": F.col("group_type") != "CANDIDATE_ONLY_GROUP",
            "extension_status": F.when(F.col("group_type") != "CANDIDATE_ONLY_GROUP", extension_status()).otherwise("NOT_APPLICABLE_CANDIDATE_GROUP"),
        }
    )
    eligible = F.startswith("extension_status", F.lit("ELIGIBLE_"))
    retained = F.col("redundant") & F.col("extension") & eligible & (F.col("gap") > 0)
    weak = (F.col("quality") == "LOW") | (F.lit(not include_moderate) & (F.col("quality") == "MODERATE"))
    role = (
        F.when(F.col("available"), "SEQUENCED")
        .when(F.col("selected"), "COMMITTED")
        .when(weak, "REVIEW_EVIDENCE")
        .when(F.col("redundant") & ~retained, "BASELINE_REDUNDANT")
        .when(F.col("extension") & ~eligible, "PANGENOME_BOUNDARY_REVIEW")
        .otherwise("ELIGIBLE")
    )
    status = (
        F.when(F.col("available") | F.col("selected"), "NOT_APPLICABLE_COMMITTED")
        .when(weak & F.col("redundant") & ~retained, "PENDING_REVIEW_NEAR_IDENTICAL_BASELINE")
        .when(weak & retained, "RETAINED_FOR_PANGENOME_GAP_PENDING_REVIEW")
        .when(weak, "NOT_EVALUATED_EVIDENCE")
        .when(F.col("redundant") & ~retained, "EXCLUDED_NEAR_IDENTICAL_BASELINE")
        .when(F.col("extension") & ~eligible, "NOT_EVALUATED_PANGENOME_BOUNDARY")
        .when(retained, "RETAINED_FOR_PANGENOME_GAP")
        .otherwise("ELIGIBLE")
    )
    return checked.withColumns({"gate": role, "redundancy_status": status})


def sequencing_sets(rows: DataFrame, closed: DataFrame, clades: DataFrame, size: int = scores.PANEL_SIZE) -> DataFrame:
    """Roles, ranks and set ids of every assessed row."""
    members = grouped(rows, clades)
    members = cut_lineage(gated(members, group_header(members)))
    committed = members.filter(F.col("available") | F.col("selected")).select("grp", "leaf")
    pool = members.filter("gate = 'ELIGIBLE'").select("grp", "id", "leaf", panel_evidence().alias("evidence"))
    panel = diversity_panel(pool, committed, closed, size)
    out = members.join(panel, ["grp", "id"], "left")
    role = (
        F.when(F.col("gate") != "ELIGIBLE", F.col("gate"))
        .when(F.col("rank").isNull(), "ALTERNATE")
        .when(F.col("gap") == 0, "DIVERSITY_CANDIDATE")
        .when(F.col("rank") <= F.col("gap"), "PRIMARY")
        .otherwise("BACKUP")
    )
    return out.withColumn("role", role)


def budgeted_round(rows: DataFrame, anchors: DataFrame, counts: DataFrame, closed: DataFrame, budget: int, backups: int = 2,
                   target: int = scores.GENOME_TARGET) -> DataFrame:
    """Greedy selection of ``budget`` genomes over all groups, then backups per primary.

    Only the picked group's count and anchors change in a greedy step, so each
    group's pick order is independent of the others.  With ``best`` the running
    maximum of a group's pick keys, the greedy order over groups is the global
    order of ``best``; one top-``budget`` sort replaces the sequential loop.
    Groups advance together until none of them could contribute a further pick.
    """
    # Read in every round of the loop below.
    rows, anchors, counts = cut_lineage(rows), cut_lineage(anchors), cut_lineage(counts)
    walk = FarthestFirst(rows.select("grp", "id", "leaf", round_evidence().alias("evidence")), anchors, closed, maximise=False, size=budget)
    closeness = cut_lineage(rows.select("grp", "id", "nearest_genome_identity").join(walk.state.select("grp", "id"), ["grp", "id"], "left_semi"))
    running = Window.partitionBy("grp").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = 1
    while True:
        while walk.step < min(upto, budget):
            walk.advance()
        count = F.coalesce("count0", F.lit(0)) + F.col("rank") - 1
        gap = F.greatest(F.lit(0), target - count)
        no_close = F.coalesce((F.col("nearest_genome_identity") > 0) & (F.col("nearest_genome_identity") < 98.65), F.lit(False))
        keyed = walk.picks.join(closeness, ["grp", "id"]).join(counts, "grp", "left").select(
            "grp", "id", "rank", "spread", "nearest_genome_identity", count.alias("count_before"), gap.alias("gap_before"),
            F.struct(F.when(gap > 0, 0).otherwise(1).alias("a"), (-gap).alias("b"), F.when(no_close, 0).otherwise(1).alias("c"), count.alias("d"), "key").alias("full"),
        )
        merged = keyed.withColumn("best", F.max("full").over(running))
        chosen = cut_lineage(merged.orderBy("best", "grp", "rank").limit(budget))
        # ``best`` never falls within a group, so only groups whose newest pick
        # made the cut can still contribute; the others stop being advanced.
        newest = chosen.filter(F.col("rank") == walk.step).select("grp")
        walk.state = cut_lineage(walk.state.join(newest, "grp", "left_semi"))
        if walk.step >= budget or walk.state.isEmpty():
            break
        upto *= 2
    nearest = F.col("nearest_genome_identity")
    tier = (
        F.when(F.col("gap_before") > 0, "COVERAGE_GAP")
        .when((nearest > 0) & (nearest < 98.65), "NOVEL_GENOME_NEIGHBOURHOOD")
        .when(nearest >= 99.0, "REDUNDANT_EXTENSION")
        .otherwise("DIVERSITY_EXPANSION")
    )
    # At most ``budget`` rows are numbered here.
    primaries = chosen.withColumn("round_rank", F.row_number().over(Window.orderBy("best", "grp", "rank")))
    primaries = primaries.withColumn("nth", F.col("rank")).withColumn("tier", tier)
    per_group = primaries.groupBy("grp").agg(F.count(F.lit(1)).alias("n_primary"))
    leaves = rows.select("grp", "id", "leaf")
    final_anchors = anchors.select("grp", "leaf").unionByName(primaries.join(leaves, ["grp", "id"]).select("grp", "leaf"))
    rest = rows.join(per_group, "grp").join(primaries.select("grp", "id"), ["grp", "id"], "left_anti")
    rest = rest.select("grp", "id", "leaf", "n_primary", round_evidence().alias("evidence"))
    spread = nearest_marked(rest, final_anchors, closed, "grp", exclude_self=True).withColumnRenamed("distance", "spread")
    ordered = rest.join(spread, ["grp", "leaf"], "left").withColumn(
        "n", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("spread").isNull(), F.desc("spread"), "evidence"))
    )
    reserve = ordered.filter(F.col("n") <= backups * budget).filter(F.col("n") <= F.col("n_primary") * backups)
    reserve = reserve.withColumns({"nth": F.ceil(F.col("n") / backups).cast("int"), "backup_rank": ((F.col("n") - 1) % backups + 1).cast("int")})
    reserve = reserve.join(primaries.select("grp", "nth", "round_rank", "tier", F.col("id").alias("backup_for")), ["grp", "nth"])
    first = primaries.select(
        "id", "grp", F.lit("PRIMARY").alias("role"), "round_rank", F.lit(None).cast("int").alias("backup_rank"), F.lit(None).cast("string").alias("backup_for"),
        "tier", F.round("spread", 6).alias("spread"),
    )
    return first.unionByName(
        reserve.select("id", "grp", F.lit("BACKUP").alias("role"), "round_rank", "backup_rank", "backup_for", "tier", F.round("spread", 6).alias("spread"))
    )


# The order in which roles are asked for the row that identities are shown against.
ANCHOR_ROLES = {"PRIMARY": 0, "BACKUP": 1, "SEQUENCED": 2, "COMMITTED": 2, "DIVERSITY_CANDIDATE": 3, "ALTERNATE": 4}


def identity_anchor(targets: DataFrame, aligned: DataFrame, group: str) -> DataFrame:
    """(``group``, anchor): of each group's targets (leaf, role, set_rank, id) the first by role, rank and id whose leaf is in the alignment.

    Unknown roles come last, and a rank that is no number counts as 999. Groups
    without an aligned target have no anchor.
    """
    roles = F.create_map(*[F.lit(x) for pair in ANCHOR_ROLES.items() for x in pair])
    role = F.coalesce(F.try_element_at(roles, F.upper(F.coalesce("role", F.lit("")))), F.lit(99))
    rank = F.coalesce(F.col("set_rank").cast("string").try_cast("double").try_cast("int"), F.lit(999))
    first = F.struct(role.alias("a"), rank.alias("b"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("c"))
    held = targets.join(aligned.select(F.col("id").alias("leaf")).distinct(), "leaf", "left_semi")
    return held.groupBy(group).agg(F.min_by("leaf", first).alias("anchor"))
