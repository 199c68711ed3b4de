"""Domain views over the given tables.

Each view is one SELECT that Spark SQL and DuckDB both accept, so the Spark
query and its SQL twin start from the same rows.  ``{name}`` refers to a given
table or to another view.  Views are linear in the tables they read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # --- sequence records: one document = one record, its source = the dataset
    "seqs": """
        SELECT doc_id AS seq_no, concat('D', cast(doc_id AS string)) AS id, text AS sequence,
               length(text) AS length, source AS dataset, lang AS domain
        FROM {documents}""",
    "roles": """
        SELECT dataset,
               CASE WHEN k % 5 < 2 THEN 'baseline' ELSE 'candidate' END AS role,
               CASE WHEN k % 5 = 0 THEN 'priority' WHEN k % 5 = 1 THEN 'secondary' END AS tier,
               k % 5 < 2 AND k % 3 <> 1 AS genomes_available
        FROM (SELECT DISTINCT source AS dataset, cast(substring(source, 4, 9) AS int) AS k FROM {documents}) x""",
    # --- lineages per isolate (customer); every seventh has none
    "taxa": """
        SELECT c_custkey AS seq_no, concat('C', cast(c_custkey AS string)) AS id,
               concat('src', cast(c_custkey % 20 AS string)) AS dataset,
               CASE WHEN c_custkey % 7 = 0 THEN 'NA'
                    WHEN c_custkey % 7 = 1 THEN concat('domain__ ', CASE WHEN r_regionkey = 0 THEN 'Archaea' ELSE 'Bacteria' END,
                         '; phylum__', r_name, ';class__; o__Order  ', cast(n_nationkey AS string), '; g__', c_mktsegment)
                    ELSE concat('d__', CASE WHEN r_regionkey = 0 THEN 'Archaea' ELSE 'Bacteria' END,
                         ';p__', r_name, ';c__C', cast(n_nationkey % 4 AS string), ';o__O', cast(n_nationkey % 6 AS string),
                         ';f__', n_name, ';g__', c_mktsegment, ';s__', c_mktsegment, ' ', lower(n_name)) END AS taxonomy,
               c_acctbal AS balance, n_nationkey AS nation_no, r_regionkey AS region_no, n_name, r_name, c_mktsegment AS segment
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    # --- reference lineages per target (part); some missing
    "target_taxa": """
        SELECT concat('T', cast(p_partkey AS string)) AS target, concat('DB', cast(p_size % 6 AS string)) AS dataset,
               CASE WHEN p_partkey % 11 = 0 THEN 'NA'
                    ELSE concat('d__Bacteria;p__', p_brand, ';g__', replace(p_type, ' ', '_'), ';s__', p_name) END AS taxonomy,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round((80 + p_partkey % 20) / 100e0, 2) END AS confidence
        FROM {part}""",
    # --- alignment hits: one lineitem = one hit of a query (order) on a target (part)
    "hits": """
        SELECT l_orderkey AS query_no, concat('Q', cast(l_orderkey AS string)) AS query,
               concat('T', cast(l_partkey AS string)) AS target, l_linenumber AS ordinal,
               round(100 - ((l_partkey * 7 + l_suppkey * 13 + l_orderkey * 3 + l_linenumber * 401) % 1200) / 100e0, 2) AS identity,
               cast(300 + l_partkey % 1200 AS int) AS alnlen,
               round(40 + ((l_suppkey * 17 + l_linenumber * 1103 + l_orderkey) % 6001) / 100e0, 2) AS query_coverage,
               CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
               CASE l_linenumber % 6 WHEN 0 THEN 'project' WHEN 1 THEN 'reference' WHEN 2 THEN 'priority'
                    WHEN 3 THEN 'secondary' WHEN 4 THEN 'reference' ELSE 'genomes' END AS pool
        FROM {lineitem}""",
    # --- the same hits as tab-separated text: 14 columns, 12 columns, short and broken rows
    "hit_lines": """
        SELECT CASE n % 20
                 WHEN 0 THEN concat_ws(chr(9), query, target)
                 WHEN 1 THEN concat_ws(chr(9), query, target, 'n/a', '10')
                 WHEN 2 THEN concat_ws(chr(9), query, target, cast(identity AS string))
                 WHEN 3 THEN concat_ws(chr(9), query, target, cast(identity AS string), cast(alnlen AS string),
                      '1', '0', '1', '9', '1', '9', cast(alnlen - 40 + n % 90 AS string), '0')
                 ELSE concat_ws(chr(9), query, target, cast(identity AS string), cast(alnlen AS string), '1', '0', '1', '9', '1', '9',
                      cast(alnlen + 30 AS string), '1500', cast(query_coverage + 30 AS string), cast(query_coverage - 45 AS string)) END AS value
        FROM (SELECT *, query_no + ordinal AS n FROM {hits}) x""",
    "queries_all": "SELECT o_orderkey AS query_no, concat('Q', cast(o_orderkey AS string)) AS query, o_custkey AS cust FROM {orders}",
    # --- identifiers as they appear in reference files: pipes, coordinates, fragments, brackets
    "raw_ids": """
        SELECT page_id, CASE page_id % 6
                 WHEN 0 THEN concat('db|', url, '#fragment ', cast(page_id AS string), ' extra words')
                 WHEN 1 THEN concat('read', cast(page_id AS string), ':100-', cast(100 + page_id AS string), '(+)')
                 WHEN 2 THEN concat('(ASV_', cast(page_id AS string), ')')
                 WHEN 3 THEN concat('gb|NR_', cast(page_id AS string), '.1|isolate_', cast(page_id AS string))
                 WHEN 4 THEN concat('contig-', cast(page_id AS string), ':5-90  second token')
                 ELSE concat('seq_', cast(page_id AS string), '_1') END AS raw_id
        FROM {pages}""",
    # --- reference headers: id, lineage, attributes
    "ref_headers": """
        SELECT p_partkey, CASE p_partkey % 9
                 WHEN 0 THEN concat('T', cast(p_partkey AS string))
                 WHEN 1 THEN concat('T', cast(p_partkey AS string), ' no lineage here')
                 ELSE concat('T', cast(p_partkey AS string), ' d__Bacteria ; p__', p_brand, ' ;g__', p_type, ' [size=', cast(p_size AS string), '] [x=1]') END AS header
        FROM {part}""",
    # --- numbers and yes/no words as ledgers write them
    "messy": """
        SELECT event_id,
               CASE event_id % 8 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN ' None ' WHEN 3 THEN concat(' ', cast(event_id AS string), '.75 ')
                    WHEN 4 THEN 'twelve' WHEN 5 THEN concat('-', cast(event_id AS string)) ELSE cast(event_id AS string) END AS raw,
               CASE event_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'true' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' ELSE '1' END AS flag
        FROM {events}""",
    # --- target list entries (region/nation terms, unranked names, a domain-only entry)
    "target_entries": """
        SELECT concat('W', lpad(cast(n_nationkey AS string), 3, '0')) AS target_id,
               CASE n_nationkey % 5
                 WHEN 0 THEN concat('d__Bacteria; p__', r_name, ' (including f__', n_name, ' and relatives)')
                 WHEN 1 THEN concat('d__Bacteria; p__Other; f__', n_name)
                 WHEN 2 THEN concat('g__BUILDING; s__building ', lower(n_name))
                 WHEN 3 THEN concat('o__O', cast(n_nationkey % 6 AS string), ' (including MACHINERY, c__C', cast(n_nationkey % 4 AS string), ')')
                 ELSE 'd__Archaea' END AS hierarchy,
               CASE n_nationkey % 3 WHEN 0 THEN 'core' ELSE 'context' END AS target_role
        FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    # --- one assessment row per isolate
    "assessment": """
        SELECT t.id, t.seq_no, t.dataset, t.taxonomy, t.nation_no,
               CASE WHEN k % 13 = 0 THEN NULL ELSE round(86 + (k * 37 % 1400) / 100e0, 2) END AS classification_identity,
               CASE WHEN k % 17 = 0 THEN NULL ELSE round(0.7 + (k * 11 % 30) / 100e0, 2) END AS classification_confidence,
               CASE WHEN k % 19 = 0 THEN NULL ELSE round(76 + (k * 53 % 2400) / 100e0, 2) END AS classification_query_coverage,
               CASE WHEN k % 23 = 0 THEN NULL ELSE round(92 + (k * 41 % 800) / 100e0, 2) END AS nearest_identity,
               round(85 + (k * 29 % 1500) / 100e0, 2) AS nearest_query_coverage,
               CASE WHEN k % 29 = 0 THEN NULL ELSE round(90 + (k * 43 % 1000) / 100e0, 2) END AS project_nearest_identity,
               cast(k * 7 % 15 AS int) AS project_matches_ge_97,
               CASE WHEN k % 31 = 0 THEN NULL ELSE round(93 + (k * 47 % 700) / 100e0, 2) END AS reference_nearest_identity,
               CASE WHEN k % 4 = 0 THEN NULL ELSE concat('P', cast(k % 50 AS string)) END AS priority_hit,
               CASE WHEN k % 4 = 0 OR k % 37 = 1 THEN NULL ELSE round(96.5 + (k * 59 % 350) / 100e0, 2) END AS priority_identity,
               round(90 + (k * 31 % 1000) / 100e0, 2) AS priority_coverage,
               CASE WHEN k % 8 = 1 THEN 'd__Bacteria;s__' WHEN k % 8 = 2 THEN 's__Else where' ELSE t.taxonomy END AS priority_taxonomy,
               CASE WHEN k % 3 <> 0 THEN NULL ELSE concat('S', cast(k % 40 AS string)) END AS secondary_hit,
               CASE WHEN k % 3 <> 0 THEN NULL ELSE round(96 + (k * 61 % 400) / 100e0, 2) END AS secondary_identity,
               round(91 + (k * 17 % 900) / 100e0, 2) AS secondary_coverage,
               t.taxonomy AS secondary_taxonomy,
               CASE k % 16 WHEN 3 THEN 'CHIMERA; LOW_CONFIDENCE' WHEN 5 THEN 'low_confidence' WHEN 7 THEN 'NOVEL_BUT_ASSIGNED;marker_qc_failed'
                    WHEN 9 THEN 'LOW_NEAREST_IDENTITY' ELSE '' END AS placement_flags,
               coalesce(l.selected, false) AS selected, coalesce(l.available, false) AS available,
               CASE WHEN nation_no % 3 = 0 THEN 2 + nation_no % 4 ELSE 0 END AS priority_count,
               CASE WHEN nation_no % 3 = 1 THEN 1 + nation_no % 3 ELSE 0 END AS secondary_count,
               cast(k % 3 AS int) AS selected_count, cast(k % 2 AS int) AS pending_count,
               CASE k % 9 WHEN 0 THEN 'NOVEL TO BOTH BASELINES' WHEN 1 THEN 'PRIORITY GAP / SECONDARY COVERED' WHEN 2 THEN 'PRIORITY COVERED'
                    WHEN 3 THEN 'CULTURED BASELINE REDUNDANT' WHEN 4 THEN 'NO CULTURED BASELINE AVAILABLE' ELSE '' END AS evidence_class,
               round((k * 67 % 1000) / 1000e0, 4) AS isolation,
               CASE k % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' ELSE 'LOW' END AS rarity_strength,
               round((k * 71 % 10000) / 100e0, 2) AS rarity_score,
               CASE k % 10 WHEN 0 THEN 'species' WHEN 1 THEN 'genus' WHEN 2 THEN 'order' WHEN 3 THEN 'phylum' END AS target_rank,
               round((k * 73 % 9000) / 100e0, 2) AS target_score,
               round((k * 79 % 10000) / 100e0, 2) AS novelty_score,
               cast(k * 3 % 9 AS int) AS matches_ge_99, cast(k * 5 % 14 AS int) AS matches_ge_97,
               CASE WHEN k % 27 = 0 THEN NULL ELSE round(94 + (k * 83 % 600) / 100e0, 2) END AS nearest_genome_identity
        FROM (SELECT *, seq_no AS k FROM {taxa}) t LEFT JOIN {ledger} l ON l.id = t.id""",
    # --- a rooted tree: root, region, nation, segment, quarter, isolate; lengths are exact binary fractions
    "tree_nodes": """
        SELECT 'root' AS node_id, cast(NULL AS string) AS parent_id, cast(0 AS double) AS branch_length, false AS is_leaf
        FROM {region} WHERE r_regionkey = 0
        UNION ALL SELECT concat('R', cast(r_regionkey AS string)), 'root', (r_regionkey + 1) / 16e0, false FROM {region}
        UNION ALL SELECT concat('N', cast(n_nationkey AS string)), concat('R', cast(n_regionkey AS string)), (n_nationkey % 7 + 1) / 32e0, false FROM {nation}
        UNION ALL SELECT DISTINCT concat('G', cast(c_nationkey AS string), substring(c_mktsegment, 1, 2)), concat('N', cast(c_nationkey AS string)),
               (c_nationkey % 3 + 1) / 64e0, false FROM {customer}
        UNION ALL SELECT DISTINCT concat('H', cast(c_nationkey AS string), substring(c_mktsegment, 1, 2), cast(c_custkey % 4 AS string)),
               concat('G', cast(c_nationkey AS string), substring(c_mktsegment, 1, 2)), (c_custkey % 4 + 1) / 128e0, false FROM {customer}
        UNION ALL SELECT concat('C', cast(c_custkey AS string)), concat('H', cast(c_nationkey AS string), substring(c_mktsegment, 1, 2), cast(c_custkey % 4 AS string)),
               CASE WHEN c_custkey % 50 = 0 THEN -1 ELSE (c_custkey * 7919 % 97 + 1) / 1024e0 END, true FROM {customer} WHERE c_custkey % 33 <> 0""",
    # --- leaf pairs whose tree distance is asked for; some leaves are not in the tree
    "tree_pairs": """
        SELECT concat('C', cast(c_custkey AS string)) AS left_leaf, concat('C', cast((c_custkey * 17) % 1000 + 1 AS string)) AS right_leaf FROM {customer}""",
    # --- assessment rows with the tree leaf that stands for them
    "assessed": """
        SELECT *, CASE WHEN seq_no % 21 = 0 THEN concat('C', cast(seq_no - 1 AS string)) ELSE id END AS leaf FROM {assessment}""",
    # --- status updates in arrival order; some ids and some words are unknown
    "status_updates": """
        SELECT o_orderkey AS line, CASE WHEN o_custkey % 40 = 0 THEN concat('X', cast(o_custkey AS string)) ELSE concat('C', cast(o_custkey AS string)) END AS id,
               CASE o_orderkey % 8 WHEN 0 THEN 'received' WHEN 1 THEN 'trace-review' WHEN 2 THEN 'Approved' WHEN 3 THEN 'dna pending' WHEN 4 THEN 'PROPOSED'
                    WHEN 5 THEN 'qc_passed' WHEN 6 THEN 'received' ELSE 'lost in post' END AS word,
               CASE WHEN o_orderkey % 5 = 0 THEN 'checked by hand' ELSE '' END AS detail, o_orderdate AS ts
        FROM {orders}""",
    # --- assessment snapshots: one per year and isolate, JSON payloads, some broken, some from other datasets
    "snapshots": """
        SELECT concat('S', cast(year(o_orderdate) AS string)) AS snapshot_id, o_orderdate AS created_at, o_orderkey AS entry, concat('C', cast(o_custkey AS string)) AS sequence_id,
               CASE o_orderkey % 3 WHEN 0 THEN concat('src', cast(o_custkey % 20 AS string)) WHEN 1 THEN 'src3' ELSE 'import' END AS dataset,
               CASE WHEN o_orderkey % 31 = 0 THEN concat(chr(123), 'broken') ELSE concat(chr(123), '"decision":"', CASE o_orderkey % 4 WHEN 0 THEN 'STRONG CANDIDATE' WHEN 1 THEN 'SECONDARY CANDIDATE' ELSE 'ALREADY SEQUENCED' END,
                    '","gap":', cast(o_custkey % 5 + o_orderkey % 2 AS string), ',"role":"', CASE o_orderkey % 3 WHEN 0 THEN 'PRIMARY' ELSE 'BACKUP' END, '"', chr(125)) END AS payload
        FROM {orders}""",
    # --- partner ledger as submitted: repeated, conflicting and incomplete rows
    "ledger_rows": """
        SELECT cast(d.doc_id + 2 AS bigint) AS line, CASE WHEN d.doc_id % 29 = 0 THEN '' ELSE concat('D', cast(d.doc_id - CASE WHEN d.doc_id % 17 = 5 THEN 1 ELSE 0 END AS string)) END AS sequence_id,
               CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE concat('p', cast(d.doc_id % 3 * (d.doc_id % 2) AS string)) END AS partner,
               CASE WHEN l.quality = 1 THEN 'Yes' WHEN l.quality = 0 THEN 'no' WHEN d.doc_id % 11 = 0 THEN 'unsure' WHEN d.doc_id % 7 = 0 THEN '' ELSE 'N' END AS genome,
               CASE WHEN l.toxic = 1 THEN 'perhaps' WHEN d.doc_id % 3 = 0 THEN 'yes' ELSE '' END AS selection
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    # --- genome results as reported
    "genome_rows": """
        SELECT p_partkey AS line, CASE WHEN p_partkey % 37 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'nobody' ELSE concat('C', cast(p_partkey % 150 + 1 AS string)) END AS sequence_id,
               CASE WHEN p_partkey % 23 = 0 THEN '' ELSE concat('GEN', cast(p_partkey AS string)) END AS genome_id,
               CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'sequenced' WHEN 2 THEN 'genome qc passed' WHEN 3 THEN 'QC-FAILED' WHEN 4 THEN 'SEQUENCED' ELSE 'withdrawn' END AS status,
               CASE WHEN p_partkey % 5 = 0 THEN 'NA' ELSE cast(80 + p_partkey % 21 AS string) END AS completeness,
               CASE WHEN p_partkey % 7 = 0 THEN '' ELSE cast(p_partkey % 9 AS string) END AS contamination,
               CASE p_partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'no' ELSE '' END AS qc_pass,
               CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('ani', cast(p_partkey % 12 AS string)) END AS ani_cluster,
               CASE WHEN p_partkey % 4 = 3 THEN concat('d__Bacteria;s__', p_brand) ELSE '' END AS genome_taxonomy
        FROM {part}""",
    "removal_requests": """
        SELECT o_orderkey AS line, CASE WHEN o_orderkey % 41 = 0 THEN ' ' WHEN o_orderkey % 43 = 0 THEN concat('Z', cast(o_custkey AS string)) ELSE concat('C', cast(o_custkey AS string)) END AS requested_id
        FROM {orders}""",
    # --- marker quality classes and manual reviews
    "marker_qc": """
        SELECT concat('C', cast(c_custkey AS string)) AS sequence_id, CASE c_custkey % 4 WHEN 0 THEN 'PASS_HIGH_CONFIDENCE' WHEN 1 THEN 'PASS_WITH_WARNINGS' ELSE 'FAIL_QC' END AS qc_class
        FROM {customer} WHERE c_custkey % 5 <> 0""",
    "marker_reviews": """
        SELECT concat('C', cast(c_custkey AS string)) AS sequence_id, CASE c_custkey % 5 WHEN 0 THEN 'Accept' WHEN 1 THEN 'approved' WHEN 2 THEN 'reject' ELSE 'later' END AS decision
        FROM {customer} WHERE c_custkey % 3 = 0""",
    # --- supplier rows and the read files they should match
    "supplier_rows": """
        SELECT conv_id * 1000 + turn AS line, CASE WHEN conv_id % 31 = 0 THEN '' ELSE concat('iso', cast(conv_id AS string)) END AS sequence_id,
               concat('Run', cast(conv_id AS string), '-', cast(turn - CASE WHEN conv_id % 12 = 0 AND turn > 0 THEN 1 ELSE 0 END AS string), CASE WHEN role = 'user' THEN '_F' ELSE '_r' END) AS supplier_id,
               CASE WHEN turn % 7 = 6 THEN '' WHEN role = 'user' THEN 'Fwd' ELSE 'reverse' END AS direction,
               CASE conv_id % 4 WHEN 0 THEN '27F' WHEN 1 THEN '1492R' ELSE '' END AS primer
        FROM {conversations}""",
    "read_files": """
        SELECT concat('in/', CASE WHEN conv_id % 9 = 0 AND turn = 0 THEN 'b/' ELSE 'a/' END, 'RUN', cast(conv_id AS string), '-', cast(turn AS string), '.ab1') AS path,
               CASE WHEN conv_id % 4 = 2 THEN '27F' ELSE '' END AS embedded_primer
        FROM {conversations} WHERE conv_id % 10 <> 3
        UNION ALL SELECT concat('in/c/run', cast(conv_id AS string), '-', cast(turn AS string), '.abi'), '' FROM {conversations} WHERE conv_id % 15 = 1 AND turn = 0""",
    # --- quality-control runs, several per (dataset, signature)
    "qc_runs": """
        SELECT concat('run', lpad(cast(o_orderkey AS string), 12, '0')) AS manifest, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE concat('src', cast(o_custkey % 20 AS string)) END AS dataset, concat('sig', cast(o_custkey % 211 AS string)) AS signature,
               CASE WHEN o_orderstatus = 'F' THEN 'interview' ELSE 'paper_trail' END AS workflow, cast(o_orderkey % 50 AS int) AS passed, cast(o_orderkey % 7 AS int) AS failed, cast(o_orderkey % 90 AS int) AS read_files
        FROM {orders}""",
    # --- isolate attributes as free text
    "attributes": """
        SELECT concat('C', cast(c_custkey AS string)) AS id, c_mktsegment AS host, n_name AS country,
               CASE WHEN c_custkey % 9 = 0 THEN 'NA' ELSE concat('site ', cast(c_custkey % 40 AS string)) END AS site,
               CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'No' END AS cultured,
               cast(c_custkey % 100 / 4e0 AS string) AS depth
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # --- lineages with names a guild table knows, exactly, by prefix or not at all
    "guild_taxa": """
        SELECT p_partkey, concat(CASE WHEN p_partkey % 10 = 0 THEN 'd__Archaea' ELSE 'd__Bacteria' END, ';p__',
               CASE p_partkey % 4 WHEN 0 THEN 'Bacillota_A' WHEN 1 THEN 'Bacteroidota' WHEN 2 THEN 'Spirochaetota' ELSE 'Unknownota' END, ';f__',
               CASE p_partkey % 3 WHEN 0 THEN 'Lachnospiraceae' WHEN 1 THEN 'Nowhereaceae' ELSE 'Selenomonadaceae_B' END, ';g__',
               CASE p_partkey % 7 WHEN 0 THEN 'Prevotella' WHEN 1 THEN 'Prevotellamassilia' WHEN 2 THEN 'Methanobrevibacter_A 123' WHEN 3 THEN 'Nobody' WHEN 4 THEN '' ELSE p_brand END) AS taxonomy
        FROM {part}""",
    # --- aligned rows: letters of a text as bases, everything else as gaps; ten rows per context
    "aligned": """
        SELECT doc_id, concat('D', cast(doc_id AS string)) AS id, doc_id % 3 = 0 AS is_anchor, source AS grp, cast(floor(doc_id / 10) AS bigint) AS context,
               translate(lower(text), 'acgtbdefhijklmnopqrsuvwxyz ', 'ACGTACGTACGTACGTACGTACGTAC-') AS aligned
        FROM {documents}""",
    # --- chromatogram reads: one conversation turn = one read, letters as bases, a Phred+33 string of the same length
    "reads": """
        SELECT conv_id, turn, concat('I', cast(conv_id AS string)) AS sequence_id, concat('I', cast(conv_id AS string), '_', cast(turn AS string)) AS read_id,
               CASE WHEN role = 'user' THEN 'forward' ELSE 'reverse' END AS direction, CASE turn % 4 WHEN 0 THEN '27F' WHEN 1 THEN '1492R' WHEN 2 THEN '515F' ELSE 'unknown' END AS primer,
               CASE conv_id % 11 WHEN 0 THEN 'best read' WHEN 1 THEN 'Assemble/merge' WHEN 2 THEN 'assembled' WHEN 3 THEN 'do-not-assemble' ELSE '' END AS mode_text,
               CASE WHEN conv_id % 13 = 0 AND turn = 1 THEN 'ab1_missing_pcon' WHEN conv_id % 17 = 0 THEN 'fasta_quality_unverified' ELSE 'fastq' END AS quality_source,
               round((conv_id * 7 + turn * 13) % 400 / 20e0, 2) AS mixed_peak_percent,
               translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTACNTG') AS sequence,
               translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,', 'IIHIIGFHIG5IIHIIDHIIIGA)CBEEEEEEEEEEEEEEEEEEEEEEEEEE8(0') AS quality_text
        FROM {conversations}""",
    # --- partner ledger flags per isolate
    "ledger": """
        SELECT concat('C', cast(c_custkey AS string)) AS id, concat('partner', cast(c_nationkey % 9 AS string)) AS partner_id,
               CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS selected,
               CASE c_custkey % 9 WHEN 0 THEN true WHEN 2 THEN NULL ELSE false END AS available
        FROM {customer}""",
}


def expand(sql: str) -> str:
    """``sql`` with every view it mentions defined in a WITH clause (DuckDB text)."""
    needed: dict[str, None] = {}

    def visit(name: str) -> None:
        if name in VIEWS and name not in needed:
            for inner in re.findall(r"\{(\w+)\}", VIEWS[name]):
                visit(inner)
            needed[name] = None

    for name in re.findall(r"\{(\w+)\}", sql):
        visit(name)
    plain = re.sub(r"\{(\w+)\}", r"\1", sql.strip())
    if not needed:
        return plain
    ctes = ",\n".join(f"{n} AS ({re.sub(chr(123) + r'(\w+)' + chr(125), r'\1', VIEWS[n]).strip()})" for n in needed)
    if plain[:4].lower() == "with":
        return f"WITH RECURSIVE {ctes},\n{plain[4:].lstrip()}"
    return f"WITH RECURSIVE {ctes}\n{plain}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view (or given table) as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    inputs = {inner: view(spark, sf_dir, inner) for inner in dict.fromkeys(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **inputs)
