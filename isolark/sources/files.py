"""Readers for sequence, read, tree, hit, ledger and taxonomy files."""

from __future__ import annotations

import csv
import gzip
import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from isolark.functions.identifiers import ascii_upper, direction_name
from isolark.functions.quality import PRIMERS, processing_mode, read_info
from isolark.functions.taxonomy import null_text

# File name endings of reads, and header spellings per ledger column.
READ_SUFFIXES = (
    ".ab1", ".abi", ".ab1.gz", ".abi.gz", ".fasta", ".fa", ".fna", ".fasta.gz", ".fa.gz", ".fna.gz", ".fastq", ".fq", ".fastq.gz", ".fq.gz",
)
LEDGER_SYNONYMS = {
    "sequence_id": ("sequence_id", "seq_id", "id", "isolate_id", "sample_id", "unique_id", "uniqueid", "unique_sequence_id", "sample", "isolate", "isolate_number", "sample_number"),
    "partner_id": ("partner_id", "partner", "partner_acronym"),
    "already_sequenced": ("already_sequenced", "genome_available"),
    "selected_for_genome_sequencing": ("selected_for_genome_sequencing", "selected_for_sequencing"),
}


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, sequence); the whole header line is the id, body lines are joined.

    Records are split by the reader itself, so one large plain file is read in
    parallel; gz files are decoded by the codec.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    header = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""))
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    return raw.select(header.alias("record_id"), F.regexp_replace(body, r"\s+", "").alias("sequence")).filter("record_id <> ''")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Aligned rows: trimmed id, upper case, U as T."""
    rows = read_fasta(spark, path)
    return rows.select(F.trim("record_id").alias("id"), F.translate(F.upper("sequence"), "U", "T").alias("aligned"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, sequence, qualities) from four-line records.

    '@' also occurs in quality text, so records cannot be split on it.  Lines are
    read in parallel and numbered per file from the line counts of the earlier
    file splits; every four consecutive lines then form a record.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.input_file_name().alias("f"), F.input_file_block_start().alias("s"), F.monotonically_increasing_id().alias("m")
    )
    splits = lines.groupBy("f", "s").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row per file split: the window holds the splits of one file only.
    before = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("f", "s", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = lines.join(offsets, ["f", "s"]).withColumn("line", F.col("m") - F.col("first") + F.col("before"))
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    records = numbered.groupBy("f", F.floor(F.col("line") / 4).alias("record")).agg(
        part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual")
    ).filter("qual is not null")
    sound = F.startswith("head", F.lit("@")) & F.startswith("plus", F.lit("+"))
    bad = F.raise_error(F.concat(F.lit("malformed FASTQ record near "), "head"))
    seq = ascii_upper(F.trim("seq"))
    checked = records.select(F.when(sound, F.trim(F.substring("head", F.lit(2), F.length("head")))).otherwise(bad).alias("read_id"), seq.alias("sequence"), "qual")
    padded = F.rpad("qual", F.length("sequence"), "!")
    quals = F.transform(F.split(padded, ""), lambda c: F.greatest(F.lit(0), F.ascii(c) - 33))
    return checked.select("read_id", "sequence", F.when(F.length("sequence") > 0, quals).otherwise(F.array().cast("array<int>")).alias("qualities"))


_TRACE = (
    "path string, read_id string, sequence string, qualities array<int>, quality_available boolean, peaks array<int>, "
    "a array<int>, c array<int>, g array<int>, t array<int>, error string"
)


def _decode_trace(data: bytes) -> dict:
    """Base calls, qualities, peaks and dye channels of one ABIF file."""
    if data[:4] != b"ABIF":
        raise ValueError("not an ABIF file")
    count, _size, offset = struct.unpack(">iii", data[18:30])
    entries = {}
    for i in range(count):
        at = offset + 28 * i
        name, number, kind, width, items, length = struct.unpack(">4sihhii", data[at : at + 20])
        raw = data[at + 20 : at + 20 + length] if length <= 4 else data[(start := struct.unpack(">i", data[at + 20 : at + 24])[0]) : start + length]
        entries[name.decode("ascii", "replace"), number] = (kind, items, raw)

    def first(name, *numbers):
        return next((entries[name, n] for n in numbers if (name, n) in entries), None)

    shorts = lambda e: list(struct.unpack(f">{len(e[2]) // 2}h", e[2][: len(e[2]) // 2 * 2])) if e else []
    called = first("PBAS", 2, 1)
    seq = called[2].decode("ascii", "replace").upper() if called else ""
    seq = "".join(b if b in "ACGTRYSWKMBDHVN" else "N" for b in seq)
    scores = first("PCON", 2, 1)
    quals = list(scores[2]) if scores else []
    order = first("FWO_", 1)
    order = order[2].decode("ascii", "replace").upper() if order else "GATC"
    dyes = {base: shorts(first("DATA", 9 + i)) for i, base in enumerate(order[:4])}
    available = len(quals) >= len(seq) > 0
    return {
        "sequence": seq, "qualities": (quals + [0] * len(seq))[: len(seq)], "quality_available": available, "peaks": shorts(first("PLOC", 2, 1)),
        **{b.lower(): dyes.get(b, []) for b in "ACGT"},
    }


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Chromatogram files as one row each; undecodable files keep their error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[aA][bB]1,[aA][bB][iI],[aA][bB]1.[gG][zZ],[aA][bB][iI].[gG][zZ]}").load(path)
    names = [c.split()[0] for c in _TRACE.split(", ")]

    def decode(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                blank = dict.fromkeys(names)
                name = file.rsplit("/", 1)[-1]
                packed = name.lower().endswith(".gz")
                stem = (name[:-3] if packed else name).rsplit(".", 1)[0]
                try:
                    rows.append({**blank, **_decode_trace(gzip.decompress(content) if packed else bytes(content)), "path": file, "read_id": stem})
                except (ValueError, struct.error, IndexError, OSError, EOFError) as exc:
                    rows.append({**blank, "path": file, "read_id": stem, "error": str(exc)})
            yield pd.DataFrame(rows, columns=names)

    return raw.select("path", "content").mapInPandas(decode, _TRACE)


def _header(name: str) -> str:
    return name.strip().lstrip("﻿").lower().replace("-", "_").replace(" ", "_")


def _ledger_columns(names: list[str], synonyms: dict[str, tuple[str, ...]]) -> list[Column]:
    """Known columns by their synonyms, the first filled cell of them, and all others trimmed."""
    compact = {c.replace("_", ""): c for c in names}
    picks, used = [], set()
    for target, options in synonyms.items():
        found = [c for n in options for c in ([n] if n in names else [compact[n.replace("_", "")]] if n.replace("_", "") in compact else [])]
        found = list(dict.fromkeys(found))
        if found:
            used.update(found)
            picks.append(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in found]).alias(target))
    return [*picks, *[F.trim(F.col(f"`{c}`")).alias(c) for c in names if c not in used]]


def read_ledger(spark: SparkSession, path: str, synonyms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Ledger of one file or a folder of them with normalised headers; each known column is found by its synonyms.

    Every file has its own header and delimiter. Files of one header are read
    together; columns that a file lacks are null. A header's repeated names count once.
    """
    lines = text_lines(spark, path)
    heads = first_lines(lines).select("file", "head", comma_separated("head").alias("comma"))
    parts = None
    # One step per distinct header, not per file.
    for row in heads.select("head", "comma").distinct().orderBy("head").collect():
        cells = next(csv.reader([row["head"]], delimiter="," if row["comma"] else "\t"))
        named = [_header(c) or f"column_{i}" for i, c in enumerate(cells)]
        names = [n if n not in named[:i] else f"{n}_{i}" for i, n in enumerate(named)]
        own = heads.filter(F.col("head") == F.lit(row["head"])).select("file")
        kept = lines.filter(F.col("value") != F.lit(row["head"])).join(own, "file", "left_semi")
        split = separated("value", F.lit(row["comma"]), len(names))
        found = kept.select(split.alias("_c")).select(*[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(names)])
        filled = found.filter(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in names]) != "")
        part = filled.select(*_ledger_columns(names, synonyms or LEDGER_SYNONYMS))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts if parts is not None else spark.createDataFrame([], "sequence_id string")


# Names of the columns of a taxonomy table, in lower case without signs.
ID_NAMES = ("id", "featureid", "feature", "otuid", "otu", "asvid", "asv", "sequenceid", "seqid", "queryid", "accession", "accessionid")
TAXONOMY_NAMES = ("taxon", "taxonomy", "lineage", "classification", "taxonomiclineage")
CONFIDENCE_NAMES = ("confidence", "conf", "score", "probability")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value) of all lines that aren't blank; ``at`` orders the lines of a file."""
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("value", "\\r$", "").alias("value")).filter(F.trim("value") != "")


def comma_separated(head: str) -> Column:
    """Is a file's first line, and so the file, delimited by commas rather than tabs?"""
    bare = F.lower(F.regexp_replace("file", "(?i)[.]gz$", ""))
    tabs_only = F.contains(F.col(head), F.lit("\t")) & ~F.contains(F.col(head), F.lit(","))
    return F.when(F.endswith(bare, F.lit(".csv")), ~tabs_only).when(F.rlike(bare, F.lit("[.](tsv|tab|txt)$")) & F.contains(F.col(head), F.lit("\t")), False).otherwise(~F.contains(F.col(head), F.lit("\t")))


def first_lines(lines: DataFrame) -> DataFrame:
    """(file, head): the first of each file's ``lines`` (file, at, value); ``at`` orders the lines of a file."""
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))


def separated(column: str, comma: Column, width: int) -> Column:
    """The cells of a delimited line as an array, quotes respected; ``comma`` tells commas from tabs."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda sep: F.from_csv(F.col(column), schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    listed = lambda row: F.array(*[row[f"c{i}"] for i in range(width)])
    return F.when(comma, listed(cells(","))).otherwise(listed(cells("\t")))


def read_taxonomy_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, taxonomy, confidence) of one table or a folder of them, each file by its own header and delimiter.

    A header names the columns in any order, behind a comment sign too; without
    one the first three cells are meant. Quoted cells may hold the delimiter.
    Rows without an id or a taxonomy are left out, as are comments.
    """
    text = text_lines(spark, path)
    remark = F.startswith(F.ltrim("value"), F.lit("#"))
    names_taxonomy = F.rlike(F.lower("value"), F.lit("taxon|lineage"))
    lines = text.filter(~remark | names_taxonomy).withColumn("value", F.when(remark, F.regexp_replace("value", "^\\s*#\\s*", "")).otherwise(F.col("value"))).withColumn("remark", remark)
    heads = first_lines(lines)
    # Files are few beside their lines; the widest head bounds the cells that are laid out.
    width = heads.agg(F.max(F.size(F.split("head", "[,\t]")))).first()[0] or 1
    comma = comma_separated("head")
    cells = F.transform(separated("head", F.col("comma"), width), lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""))
    place = lambda names: F.nullif(F.array_position(F.transform(F.col("names"), lambda n: F.coalesce(n.isin(*names), F.lit(False))), True), F.lit(0))
    heads = heads.withColumn("comma", comma).withColumn("names", cells)
    heads = heads.withColumns({"id_at": place(ID_NAMES), "taxonomy_at": place(TAXONOMY_NAMES), "confidence_at": place(CONFIDENCE_NAMES)})
    several = F.size(F.filter("names", lambda n: n.isNotNull())) > 1
    headed = F.col("taxonomy_at").isNotNull() | (F.col("id_at").isNotNull() & several)
    plan = heads.select(
        "file", "head", "comma", headed.alias("headed"), F.coalesce("id_at", F.lit(1)).alias("id_at"), F.coalesce("taxonomy_at", F.lit(2)).alias("taxonomy_at"),
        F.coalesce("confidence_at", F.when(~headed, 3)).alias("confidence_at"),
    )
    # A header may come again in a split of its file, and data rows are never the header's text.
    rows = lines.join(plan, "file").filter(~(F.col("headed") & (F.col("value") == F.col("head"))) & ~F.col("remark"))
    cell = lambda at: F.trim(F.get(F.col("cells"), F.col(at).cast("int") - 1))
    found = rows.withColumn("cells", separated("value", F.col("comma"), max(width, 3)))
    return found.select(cell("id_at").alias("id"), cell("taxonomy_at").alias("taxonomy"), null_text(cell("confidence_at")).try_cast("double").alias("confidence")).filter("id <> '' AND taxonomy <> ''")


def read_target_list(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, hierarchy, target_role) from a table whose headers contain those words."""
    sep = "\t" if path.endswith((".tsv", ".txt", ".tsv.gz", ".txt.gz")) else ","
    raw = spark.read.csv(path, header=True, sep=sep, escape='"', inferSchema=False)
    column = lambda *words: next((c for w in words for c in raw.columns if w in c.lower()), None)
    ident, hierarchy, role = column("mwl", "target", "id"), column("hierarchy", "tax"), column("role")
    cell = lambda c: F.trim(F.col(f"`{c}`")) if c else F.lit("")
    return raw.select(cell(ident).alias("target_id"), cell(hierarchy).alias("hierarchy"), F.coalesce(cell(role), F.lit("")).alias("target_role")).filter("hierarchy <> ''")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Alignment hit tables of any supported width as typed hits."""
    from isolark.operators.hits import parse_hit_lines

    return parse_hit_lines(spark.read.text(path))


def read_chimera_table(spark: SparkSession, path: str) -> DataFrame:
    """Score-first chimera tables as typed calls."""
    from isolark.operators.hits import parse_chimera_lines

    return parse_chimera_lines(spark.read.text(path))


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Attribute table: the first column is the id, the others stay text."""
    sep = "\t" if path.endswith((".tsv", ".txt", ".tsv.gz", ".txt.gz")) else ","
    raw = spark.read.csv(path, header=True, sep=sep, escape='"', inferSchema=False)
    return raw.withColumnRenamed(raw.columns[0], "id")


def _newick_rows(tree: str, text: str):
    """Node rows of one tree, read left to right with an explicit stack."""
    text = text.strip().rstrip(";")
    rows, stack, serial, i = [], [], 0, 0

    def fresh(parent):
        nonlocal serial
        rows.append([tree, f"n{serial}", parent, 0.0, "", True])
        serial += 1
        return len(rows) - 1

    node = fresh(None)
    while i < len(text):
        ch = text[i]
        if ch == "(":
            rows[node][5] = False
            stack.append(node)
            node = fresh(rows[node][1])
            i += 1
        elif ch == ",":
            node = fresh(rows[stack[-1]][1])
            i += 1
        elif ch == ")":
            node = stack.pop()
            i += 1
        elif ch.isspace():
            i += 1
        else:
            if ch in "'\"":
                end = text.index(ch, i + 1)
                label, i = text[i + 1 : end], end + 1
            else:
                end = i
                while end < len(text) and text[end] not in "(),:":
                    end += 1
                label, i = text[i:end].strip(), end
            if label:
                rows[node][4] = label
            if i < len(text) and text[i] == ":":
                end = i + 1
                while end < len(text) and text[end] not in "(),":
                    end += 1
                try:
                    rows[node][3] = float(text[i + 1 : end])
                except ValueError:
                    rows[node][3] = 0.0
                i = end
    return rows


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Node table of every tree file: (tree_id, node_id, parent_id, branch_length, name, is_leaf)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("tree_id"), "value")
    columns = ["tree_id", "node_id", "parent_id", "branch_length", "name", "is_leaf"]

    def parse(batches):
        for pdf in batches:
            for tree, text in zip(pdf["tree_id"], pdf["value"]):
                yield pd.DataFrame(_newick_rows(tree, text), columns=columns)

    return raw.mapInPandas(parse, "tree_id string, node_id string, parent_id string, branch_length double, name string, is_leaf boolean")


#: Bytes of a file that are hashed at a time.
CHUNK = 4 << 20
#: Lines that a leaf of the digest's tree holds on average.
LEAF = 64


def _hash_files(batches):
    """SHA-256 of each path's file, read in chunks from whatever file system its address names."""
    import hashlib

    from urllib.parse import quote

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            path = row.column("path")[0].as_py()
            scheme, _, rest = path.partition(":")
            rest = rest if rest.startswith("//") else f"//{rest}"  # Spark writes local paths with one slash, and all paths unescaped
            system, place = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([digest.hexdigest()])], [*row.schema.names, "sha256"])


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file below a folder.

    The listing reads no content; files of any size are hashed in chunks where
    the tasks are, so no file stands in a row. Spark's listing has no entry for an
    empty file, as no task would read it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size")).mapInArrow(_hash_files, "path string, size long, sha256 string")


def directory_digest(files: DataFrame) -> DataFrame:
    """One digest over an inventory: a tree over the paths' hashes whose depth follows from the number of files.

    A leaf holds the sorted lines of the paths that share their first hexadecimal
    digits, about ``LEAF`` of them; each level above folds up to 16 digests, so no
    cell grows with the folder.
    """
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    count, total = files.agg(F.count(F.lit(1)), F.sum("size")).first()
    depth = 0
    while LEAF * 16**depth < count:
        depth += 1
    lines = files.select(F.sha2("path", 256).alias("place"), F.concat_ws(":", "path", "sha256").alias("line"))
    tree = lines.groupBy(F.substring("place", 1, depth).alias("place")).agg(fold("line").alias("line"))
    for level in range(depth - 1, -1, -1):
        tree = tree.groupBy(F.substring("place", 1, level).alias("place")).agg(fold(F.concat_ws(":", "place", "line")).alias("line"))
    root = tree.agg(F.max("line").alias("digest"))  # one line, or none of an empty folder
    return root.select(F.lit(count).cast("long").alias("files"), F.lit(total or 0).cast("long").alias("bytes"), "digest")


def unpivot_sample_map(wide: DataFrame, id_column: str, row_columns: tuple[str, ...] = ("primer", "direction", "processing_mode")) -> DataFrame:
    """Long read map from a wide one: file cells split, primer from row, then column, then file name."""
    known = {p.lower(): p for p in PRIMERS}

    def primer_of(name: str) -> str:
        tokens = name.lower().split("_")
        return next((known[t] for t in tokens if t in known), "")

    named = ("file", "files", "filename", "read_file", "read_files", "path")
    starts = tuple(f"{p}file_" for p in ("", "read_", "ab1_", "abi_", "trace_", "chromatogram_"))
    is_file = lambda c: bool(primer_of(c)) or c.endswith(("_file", "_files", "_path", "_paths")) or c.startswith(starts) or c in named
    rows = [c for c in row_columns if c in wide.columns]
    files = [c for c in wide.columns if c != id_column and c not in rows]
    long = wide.select(id_column, *rows, *[F.col(f"`{c}`").cast("string").alias(c) for c in files]).unpivot([id_column, *rows], files, "column", "cell").filter("trim(cell) <> ''")
    # A column counts as files by its name; in any other one, the cells that end as read files do.
    by_name = [c for c in files if is_file(c)]
    by_cell = reduce(lambda x, y: x | y, [F.endswith(F.lower(F.trim("cell")), F.lit(e)) for e in READ_SUFFIXES])
    long = long.filter(F.col("column").isin(*by_name) | by_cell if by_name else by_cell)
    long = long.withColumn("read_file", F.explode(F.filter(F.transform(F.split("cell", "[;,|]"), lambda p: F.trim(p)), lambda p: p != "")))
    names = F.create_map(*[F.lit(x) for c in files for x in (c, primer_of(c))])
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in wide.columns else F.lit(None).cast("string")
    info = read_info("read_file")
    stated = F.coalesce(blank("primer"), F.nullif(F.try_element_at(names, F.col("column")), F.lit("")))
    primer = F.coalesce(stated, info["primer"])
    by_primer = F.when(F.endswith(F.upper(primer), F.lit("R")), "reverse").otherwise("forward")
    said = direction_name("direction") if "direction" in wide.columns else F.lit(None).cast("string")
    mode = processing_mode("processing_mode") if "processing_mode" in wide.columns else F.lit(None).cast("string")
    return long.select(
        F.coalesce(F.nullif(F.trim(F.col(id_column)), F.lit("")), info["sequence_id"]).alias("sequence_id"), "read_file", primer.alias("primer"),
        F.coalesce(said, F.when(stated.isNotNull(), by_primer), info["direction"]).alias("direction"), mode.alias("processing_mode"),
    )


def import_assessments(tables: list[DataFrame], names: dict[str, tuple[str, ...]], key: str = "id") -> DataFrame:
    """Rows of several historical assessment tables under current names; later tables win."""
    from isolark.operators.collection import last_wins

    merged = None
    for order, table in enumerate(tables):
        def pick(options: tuple[str, ...]) -> Column:
            present = [null_text(F.col(f"`{o}`").cast("string")) for o in options if o in table.columns]
            return F.coalesce(*present) if present else F.lit(None).cast("string")

        part = table.select(*[pick(options).alias(name) for name, options in names.items()], F.lit(order).alias("_order"))
        merged = part if merged is None else merged.unionByName(part)
    return last_wins(merged.filter(F.col(key).isNotNull()), [key], ["_order"]).drop("_order")
