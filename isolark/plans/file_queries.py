"""Registered queries that write a given table in a file format and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from isolark.operators import hits as H
from isolark.plans.bindings import view
from isolark.registry import query
from isolark.session import shared_folder
from isolark.sources import files, sinks


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("scan_fasta", "SELECT id AS record_id, md5(regexp_replace(sequence, '[ \\t\\n\\v\\f\\r]+', '', 'g')) AS digest FROM {seqs}")
def scan_fasta(spark, sf):
    path = _folder(spark)
    sinks.write_fasta(view(spark, sf, "seqs").select("id", F.regexp_replace("sequence", ">", "> ").alias("sequence")), path)
    return files.read_fasta(spark, path).select("record_id", F.md5("sequence").alias("digest"))


_VERDICT = "CASE seq_no % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'n ' WHEN 2 THEN '?' ELSE 'N' END"


@query(
    "scan_chimera_table",
    f"""
WITH t AS (SELECT id, CASE WHEN seq_no % 7 > 0 THEN seq_no % 50 / 8e0 END AS score, CASE upper(trim({_VERDICT})) WHEN 'Y' THEN 'CHIMERA' WHEN 'N' THEN 'PASS' ELSE 'INDETERMINATE' END AS call FROM {{taxa}} WHERE seq_no % 5 > 0)
SELECT x.id, coalesce(t.call, 'INDETERMINATE') AS call, t.score, CASE WHEN t.id IS NULL THEN '' ELSE concat(x.id, 'a') END AS left_parent, CASE WHEN t.id IS NULL THEN '' ELSE x.dataset END AS right_parent FROM {{taxa}} x LEFT JOIN t USING (id)""",
)
def scan_chimera_table(spark, sf):
    path, taxa = _folder(spark), view(spark, sf, "taxa")
    score = F.when(F.col("seq_no") % 7 > 0, (F.col("seq_no") % 50 / 8.0).cast("string")).otherwise("*")
    line = F.concat_ws("\t", score, "id", F.concat("id", F.lit("a")), "dataset", F.lit("filler"), F.expr(_VERDICT))
    taxa.filter("seq_no % 5 > 0").select(line.alias("value")).unionByName(taxa.filter("seq_no % 10 = 0").select(F.lit("0.5\t\tlost").alias("value"))).write.text(path)
    return H.chimera_report(taxa, files.read_chimera_table(spark, path))


@query("scan_alignment", "SELECT id, md5(replace(upper(regexp_replace(aligned, '[^A-Za-z-]', '', 'g')), 'U', 'T')) AS digest, length(regexp_replace(aligned, '[^A-Za-z-]', '', 'g')) AS width FROM {aligned} WHERE aligned IS NOT NULL")
def scan_alignment(spark, sf):
    path = _folder(spark)
    rows = view(spark, sf, "aligned").filter("aligned IS NOT NULL").select(F.concat(F.lit(" "), "id", F.lit(" ")).alias("id"), F.lower(F.regexp_replace("aligned", "[^A-Za-z-]", "")).alias("sequence"))
    sinks.write_fasta(rows, path)
    return files.read_alignment(spark, path).select("id", F.md5("aligned").alias("digest"), F.length("aligned").alias("width"))


@query("scan_attributes", "SELECT id, dataset, cast(length AS varchar) AS letters, CASE WHEN domain <> '' THEN concat(domain, ', \"as given\"') END AS domain FROM {seqs}")
def scan_attributes(spark, sf):
    path = _folder(spark)
    rows = view(spark, sf, "seqs").select(F.col("id").alias("Isolate"), "dataset", F.col("length").cast("string").alias("letters"), F.when(F.col("domain") != "", F.concat("domain", F.lit(', "as given"'))).alias("domain"))
    rows.write.csv(path, header=True, escape='"')
    return files.read_attributes(spark, path)


@query("state_versions", "SELECT id, dataset, 'second' AS version FROM {taxa} WHERE seq_no % 2 = 0 UNION ALL SELECT id, dataset, 'first' FROM {taxa}")
def state_versions(spark, sf):
    """Two versions of one state table, written beside each other and read back."""
    path, taxa = _folder(spark), view(spark, sf, "taxa").select("id", "dataset", "seq_no")
    sinks.write_state(taxa, path, "taxonomy", "first")
    sinks.write_state(taxa.filter("seq_no % 2 = 0"), path, "taxonomy", "second")
    read = lambda version: sinks.read_state(spark, path, "taxonomy", version).select("id", "dataset", F.lit(version).alias("version"))
    return read("first").unionByName(read("second"))


@query("scan_fastq", "SELECT read_id, length(sequence) AS n, md5(replace(sequence, chr(10), 'N')) AS digest FROM {reads} WHERE sequence <> ''")
def scan_fastq(spark, sf):
    path = _folder(spark)
    reads = view(spark, sf, "reads")
    one_line = lambda c, fill: F.replace(c, F.lit("\n"), F.lit(fill))
    clean = reads.filter("sequence <> ''").select(
        F.concat(F.lit("@"), "read_id", F.lit("\n"), one_line("sequence", "N"), F.lit("\n+\n"), one_line("quality_text", "!")).alias("value")
    )
    clean.write.text(path)
    return files.read_fastq(spark, path).select("read_id", F.length("sequence").alias("n"), F.md5("sequence").alias("digest"))


@query("scan_ledger", "SELECT id, partner_id, CASE WHEN selected THEN 'yes' WHEN NOT selected THEN 'no' END AS selected FROM {ledger}")
def scan_ledger(spark, sf):
    path = _folder(spark)
    word = lambda c: F.when(F.col(c), "yes").when(~F.col(c), "no")
    rows = view(spark, sf, "ledger").select(
        F.col("id").alias("Isolate-ID"), F.col("partner_id").alias("Partner Acronym"), word("selected").alias("Selected for sequencing"), word("available").alias("Genome Available")
    )
    rows.write.csv(path, sep="\t", header=True)
    back = files.read_ledger(spark, path)
    return back.select(F.col("sequence_id").alias("id"), "partner_id", F.col("selected_for_genome_sequencing").alias("selected"))


@query(
    "scan_ledgers_mixed",
    """
SELECT id AS sequence_id, partner_id, concat('kept "', id, '", shelf ', length(id)) AS note FROM {ledger} WHERE length(id) % 2 = 0
UNION ALL SELECT id, concat(partner_id, ' lab'), NULL FROM {ledger} WHERE length(id) % 2 = 1""",
)
def scan_ledgers_mixed(spark, sf):
    """One folder with two headers: commas and quotes, and tabs with other names in another order."""
    path, rows = _folder(spark), view(spark, sf, "ledger")
    even, odd = (rows.filter(F.length("id") % 2 == k) for k in (0, 1))
    note = F.concat(F.lit('kept "'), "id", F.lit('", shelf '), F.length("id").cast("string"))
    even.select(F.col("partner_id").alias("Partner"), note.alias("Note"), F.col("id").alias("Isolate ID")).write.csv(f"{path}/a", header=True, escape='"')
    odd.select(F.col("id").alias("unique-id"), F.concat("partner_id", F.lit(" lab")).alias("Partner Acronym")).write.csv(f"{path}/b", sep="\t", header=True)
    return files.read_ledger(spark, f"{path}/*").select("sequence_id", "partner_id", "note")


@query("scan_taxonomy_table", "SELECT target AS id, taxonomy, confidence FROM {target_taxa}")
def scan_taxonomy_table(spark, sf):
    path = _folder(spark)
    rows = view(spark, sf, "target_taxa").select("target", "taxonomy", "confidence")
    rows.write.csv(path, sep="\t", header=False, nullValue="NA")
    return files.read_taxonomy_table(spark, path)


@query(
    "scan_taxonomy_named",
    """
SELECT target AS id, CASE WHEN k = 0 THEN concat(taxonomy, ', "strain" ', target) ELSE taxonomy END AS taxonomy,
  CASE WHEN k < 2 THEN try_cast(confidence AS double) END AS confidence FROM (SELECT *, cast(substring(target, 2) AS bigint) % 3 AS k FROM {target_taxa}) t WHERE taxonomy <> ''""",
)
def scan_taxonomy_named(spark, sf):
    """One folder, three kinds of files: quoted commas and swapped names, tabs with a commented header, no header at all."""
    path = _folder(spark)
    rows = view(spark, sf, "target_taxa").select(F.col("target").alias("id"), "taxonomy", F.col("confidence").cast("string").alias("confidence"))
    kind = lambda k: rows.filter(F.substring("id", 2, 20).cast("long") % 3 == k)
    quoted = kind(0).select(F.col("confidence").alias("Score"), F.concat("taxonomy", F.lit(', "strain" '), "id").alias("Taxon"), F.col("id").alias("Feature ID"))
    quoted.write.csv(f"{path}/a", header=True, quoteAll=True, escape='"')
    tabbed = kind(1).select(F.concat_ws("\t", F.lit("x"), "id", F.coalesce("confidence", F.lit("NA")), "taxonomy").alias("value"))
    head = F.lit("# note\tOTU ID\tconfidence\tlineage\n#a comment\n\n")
    in_file = tabbed.groupBy(F.pmod(F.xxhash64("value"), F.lit(16))).agg(F.concat(head, F.array_join(F.collect_list("value"), "\n")).alias("value"))
    in_file.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/b")
    kind(2).select(F.concat_ws("\t", "id", "taxonomy").alias("value")).write.text(f"{path}/c")
    return files.read_taxonomy_table(spark, f"{path}/*")


@query("tree_nodes_file", "SELECT coalesce(is_leaf, false) AS is_leaf, count(*) AS nodes, round(sum(greatest(branch_length, 0)), 4) AS total FROM {tree_nodes} WHERE node_id LIKE 'C%' GROUP BY 1")
def tree_nodes_file(spark, sf):
    path = _folder(spark)
    leaves = view(spark, sf, "tree_nodes").filter("is_leaf")
    # One tree file per parent clade: leaves joined into a flat clade string.
    clade = F.array_join(F.collect_list(F.concat("node_id", F.lit(":"), F.greatest("branch_length", F.lit(0.0)).cast("string"))), ",")
    trees = leaves.groupBy("parent_id").agg(F.concat(F.lit("("), clade, F.lit(");")).alias("value"))
    trees.repartition(16).select("value").write.option("maxRecordsPerFile", 1).text(path)
    nodes = files.read_newick(spark, path)
    return nodes.filter("is_leaf").groupBy("is_leaf").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("branch_length"), 4).alias("total"))


_FILE = "string_agg(concat('>', id, chr(10), coalesce(sequence, '')), chr(10) ORDER BY seq_no)"


@query(
    "file_inventory",
    f"SELECT octet_length(encode(t || chr(10))) AS size, sha256(t || chr(10)) AS sha256 FROM (SELECT {_FILE} AS t FROM {{seqs}} GROUP BY seq_no // 50) f",
)
def file_inventory(spark, sf):
    """Fifty records a file; their sizes and digests are those of the text that was written."""
    path = _folder(spark)
    record = F.concat(F.lit(">"), "id", F.lit("\n"), F.coalesce("sequence", F.lit("")))
    per_file = view(spark, sf, "seqs").groupBy(F.floor(F.col("seq_no") / 50)).agg(F.sort_array(F.collect_list(F.struct("seq_no", record.alias("r")))).alias("rs"))
    per_file.select(F.array_join("rs.r", "\n").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.inventory(spark, path, "part-*").select("size", "sha256")


@query(
    "unpivot_sample_map",
    """
SELECT concat('iso', conv_id) AS sequence_id, concat('r', conv_id, '_', turn, '.ab1') AS read_file, '27F' AS primer, 'forward' AS direction, CASE WHEN conv_id % 3 = 0 THEN 'best_read' END AS processing_mode FROM {conversations}
UNION ALL SELECT concat('iso', conv_id), concat('s', conv_id, '_', turn, '.ab1'), '907R', 'reverse', CASE WHEN conv_id % 3 = 0 THEN 'best_read' END FROM {conversations}
UNION ALL SELECT concat('iso', conv_id), concat('t', conv_id, '_', turn, '.ab1'), '907R', 'reverse', CASE WHEN conv_id % 3 = 0 THEN 'best_read' END FROM {conversations}""",
)
def unpivot_sample_map(spark, sf):
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    name = lambda p: F.concat(F.lit(p), c, F.lit("_"), t, F.lit(".ab1"))
    wide = view(spark, sf, "conversations").select(
        F.concat(F.lit("iso"), c).alias("isolate_id"), name("r").alias("27f"), F.concat(name("s"), F.lit("; "), name("t")).alias("907r"),
        F.when(F.col("conv_id") % 3 == 0, "best read").otherwise("").alias("processing_mode"),
    )
    return files.unpivot_sample_map(wide, "isolate_id")


@query(
    "assessment_import",
    """
SELECT id, taxonomy, cast(nearest_identity AS double) AS nearest_identity FROM (
  SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.t ELSE a.t END AS taxonomy, CASE WHEN b.id IS NOT NULL THEN b.n ELSE a.n END AS nearest_identity
  FROM (SELECT id, nullif(taxonomy, 'NA') AS t, nearest_identity AS n FROM {assessment} WHERE seq_no % 3 > 0 OR seq_no % 2 = 1) a
  FULL JOIN (SELECT id, nullif(taxonomy, 'NA') AS t, priority_identity AS n FROM {assessment} WHERE seq_no % 2 = 0) b ON a.id = b.id) x""",
)
def assessment_import(spark, sf):
    rows = view(spark, sf, "assessment")
    old = rows.filter("seq_no % 3 > 0 OR seq_no % 2 = 1").select(F.col("id").alias("ID"), F.col("taxonomy").alias("GTDBTaxonomy"), F.col("nearest_identity").alias("NearestIdentity"))
    new = rows.filter("seq_no % 2 = 0").select("id", "taxonomy", F.col("priority_identity").alias("nearest_identity"))
    names = {"id": ("id", "ID"), "taxonomy": ("taxonomy", "GTDBTaxonomy", "Taxonomy"), "nearest_identity": ("nearest_identity", "NearestIdentity")}
    merged = files.import_assessments([old, new], names)
    return merged.select("id", "taxonomy", F.col("nearest_identity").cast("double").alias("nearest_identity"))


@query(
    "unpivot_by_cell",
    """
SELECT concat('iso', conv_id) AS sequence_id, concat('a', conv_id, '_', turn, '.AB1') AS read_file FROM {conversations} WHERE conv_id % 2 = 0
UNION ALL SELECT concat('iso', conv_id), concat('b', conv_id, '_', turn, '.fastq.gz') FROM {conversations}
UNION ALL SELECT concat('iso', conv_id), concat('c', conv_id, '_', turn) FROM {conversations}""",
)
def unpivot_by_cell(spark, sf):
    """Files in a column of any name, known by their cells; in file_* columns, known by the name; notes stay out."""
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    name = lambda p, end: F.concat(F.lit(p), c, F.lit("_"), t, F.lit(end))
    wide = view(spark, sf, "conversations").select(
        F.concat(F.lit("iso"), c).alias("isolate_id"), F.when(F.col("conv_id") % 2 == 0, name("a", ".AB1")).otherwise("no trace").alias("remarks"),
        name("b", ".fastq.gz").alias("trace_file_1"), name("c", "").alias("file_2"), F.lit("a note").alias("note"),
    )
    return files.unpivot_sample_map(wide, "isolate_id").select("sequence_id", "read_file")
