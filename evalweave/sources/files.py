"""Readers of the files an evaluation starts from. All are lazy DataFrames; a missing folder gives an empty one."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.keys import plain_pmcid
from evalweave.functions.text import strip

# Endings of supplementary files, documents first, and those taken from packages.
DOCUMENT_ENDINGS = ["xlsx", "xls", "pdf", "docx", "doc", "csv", "tsv", "txt"]
IMAGE_ENDINGS = ["png", "jpg", "jpeg", "gif", "bmp", "webp"]
PACKAGE_ENDINGS = ["xlsx", "xls", "pdf", "docx", "doc", "csv", "txt", "zip", "png", "jpg", "jpeg", "tiff", "tif", "eps", "svg"]
ID_HEADERS = ("pmcid", "pmid", "id")


def _listing(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    try:
        return reader.load(folder).select("path", "modificationTime", "length")
    except Exception as e:  # the folder doesn't exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def xml_listing(spark: SparkSession, folder: str) -> DataFrame:
    """id and path of each XML file of a folder; the id is the name up to the first ``_``; of one id the last name counts."""
    stem = F.regexp_replace(file_name(F.col("path")), r"(?i)\.xml$", "")
    rows = _listing(spark, folder, "*.xml").select(F.substring_index(stem, "_", 1).alias("id"), "path")
    return rows.groupBy("id").agg(F.max("path").alias("path"))


def texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and whole text of each file."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line: blank lines, comments and header words dropped, each once, in order."""
    line = strip(F.col("value"))
    keep = (line != "") & ~line.startswith("#") & ~F.lower(line).isin(*ID_HEADERS)
    return spark.read.text(path).where(keep).select(line.alias("id")).distinct().orderBy("id")


def id_list_as_written(spark: SparkSession, path: str, prefix: str = "PMC") -> DataFrame:
    """Lines that start with the prefix, order and repeats kept: pos, id."""
    whole = spark.read.option("wholetext", "true").text(path)
    rows = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    return rows.select("pos", strip(F.col("line")).alias("id")).where(F.col("id").startswith(prefix))


def id_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a CSV: from the column named like an id (any case, blanks), else the first; a headerless
    file is told by an id in its first line. Plain form, each once at its first place: pos, id."""
    head = spark.read.text(path).limit(1).collect()
    cells = [c.strip().strip('"') for c in head[0][0].split(",")] if head else []
    headerless = any(c.upper().startswith("PMC") and c[3:].isdigit() or c.isdigit() for c in cells[:1])
    rows = spark.read.option("header", str(not headerless).lower()).option("inferSchema", "false").csv(path)
    if not rows.columns:
        return spark.createDataFrame([], "pos bigint, id string")
    named = [c for c in rows.columns if c.lower().replace(" ", "").replace("_", "") in ("pmcid", "pmcids", "pmc")]
    numbered = rows.select(F.monotonically_increasing_id().alias("pos"), plain_pmcid(F.col(f"`{(named or rows.columns)[0]}`")).alias("id"))
    return numbered.where("id is not null").groupBy("id").agg(F.min("pos").alias("pos")).select("pos", "id")


def ids_of_names(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Ids found in file names, each once."""
    return listing.select(F.upper(F.regexp_extract(file_name(F.col(path_col)), r"(?i)(PMC\d+)", 1)).alias("id")).where("id <> ''").distinct()


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-record results with their loose scores; where those are missing the strict ones stand in."""
    ddl = "pmcid string, gt_category string, ext_category string, category_correct boolean, tp int, fp int, fn int, precision double, recall double, primary_f1 double, loose_tp int, loose_fp int, loose_fn int, loose_f1 double, gt_item_count int, ext_item_count int, error_message string"
    rows = spark.read.option("header", "true").option("enforceSchema", "false").schema(ddl).csv(path)
    return rows.withColumns({f"loose_{x}": F.coalesce(f"loose_{x}", y) for x, y in (("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("f1", "primary_f1"))})


def results_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a results file; missing loose counts fall back to the strict ones."""
    rec = "pmcid string, gt_category string, ext_category string, category_correct boolean, tp int, fp int, fn int, precision double, recall double, primary_f1 double, loose_tp int, loose_fp int, loose_fn int, loose_f1 double, gt_item_count int, ext_item_count int, error_message string"
    rows = spark.read.option("multiLine", "true").schema(f"records array<struct<{rec.replace(' ', ':').replace(',:', ',')}>>").json(path)
    rows = rows.select(F.inline("records"))
    return rows.withColumns({f"loose_{x}": F.coalesce(f"loose_{x}", y) for x, y in (("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("f1", "primary_f1"))})


def splits(spark: SparkSession, path: str) -> DataFrame:
    """split, part and id of a splits file, whichever of its three layouts it has."""
    ids = "array<string>"
    text = spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("j"))
    top = text.select(F.explode(F.from_json("j", "map<string,string>")).alias("split", "v")).where("split <> 'metadata'")
    inner = top.where("split in ('splits', 'split_indices')").select(F.explode(F.from_json("v", "map<string,string>")).alias("split", "v"))
    all_splits = top.where("split not in ('splits', 'split_indices')").unionByName(inner)
    parts = F.from_json("v", "map<string,string>")
    plain = all_splits.where(F.ltrim("v").startswith("[")).select("split", F.lit("all").alias("part"), F.explode(F.from_json("v", ids)).alias("id"))
    named = all_splits.where(F.ltrim("v").startswith("{")).select("split", F.explode(parts).alias("part", "w")).where(F.ltrim("w").startswith("["))
    return plain.unionByName(named.select("split", "part", F.explode(F.from_json("w", ids)).alias("id")))


def stored_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """pmcid, raw output and parsed output (JSON text, ``{}`` where there is none) of stored extractions."""
    rows = texts(spark, folder, "*.json")
    get = lambda k: F.get_json_object("text", f"$.{k}")
    return rows.select(get("pmcid").alias("pmcid"), get("timestamp").alias("timestamp"), get("raw_output").alias("raw_output"), F.coalesce(get("parsed_output"), F.lit("{}")).alias("parsed_output"))


def supplementary_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Supported files below the roots: id (their folder), name, ext, size_kb, rank (documents first, then images)."""
    rows = None
    for root in roots:
        part = _listing(spark, root, "*", recursive=True)
        rows = part if rows is None else rows.unionByName(part)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    kind = F.when(F.col("ext").isin(DOCUMENT_ENDINGS), 0).when(F.col("ext").isin(IMAGE_ENDINGS), 1)
    found = rows.withColumn("ext", ext).withColumn("rank", kind).where("rank is not null")
    return found.select(F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+$", 1).alias("id"), file_name(F.col("path")).alias("name"), "ext", F.round(F.col("length") / 1024, 1).alias("size_kb"), "rank", "path")


def file_manifest(files: DataFrame) -> DataFrame:
    """Per id the number of files and their list, documents first."""
    item = F.struct("rank", "ext", F.lower("name").alias("l"), "name", "size_kb")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["name"].alias("name"), x["ext"].alias("ext"), x["size_kb"].alias("size_kb")))
    return files.groupBy("id").agg(F.count(F.lit(1)).alias("total_files"), listed.alias("files"))


def ending(path: Column) -> Column:
    """The ending of a path's last component in lower case, '' where it has none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.([^.]+)$", 1))


def endings(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def oa_index(spark: SparkSession, path: str) -> DataFrame:
    """The open-access index: pmcid to path, first line skipped, of one id the last line counts."""
    ddl = "ftp_path string, citation string, pmcid string, timestamp string, pmid string, license string"
    rows = spark.read.schema(ddl).csv(path).withColumn("_n", F.monotonically_increasing_id())
    rows = rows.where("ftp_path like 'oa_%' and pmcid is not null and lower(pmcid) <> 'nan'")
    return rows.groupBy(F.upper(F.trim("pmcid")).alias("pmcid")).agg(F.max_by("ftp_path", "_n").alias("ftp_path"))


def from_package(names: Column) -> Column:
    """Which members of a package are supplementary: by ending or a name with ``supp``, never XML."""
    ext = lambda n: F.lower(F.regexp_extract(n, r"\.([^./]+)$", 1))
    return F.filter(names, lambda n: (ext(n).isin(PACKAGE_ENDINGS) | F.lower(n).contains("supp")) & ~ext(n).isin("xml", "nxml"))


def tracker(spark: SparkSession, path: str) -> DataFrame:
    """The download tracker, empty where there is none yet."""
    ddl = "pmid string, pmcid string, pmcid_status string, download_date string, fulltext_xml_status string, error_message string"
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], ddl)
    return spark.read.option("header", "true").schema(ddl).csv(path)


def rules_text(spark: SparkSession, path: str) -> str | None:
    """A small text file at once (format rules); None where it is missing."""
    if "://" not in path and not os.path.exists(path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A sheet saved as CSV: text columns under trimmed names, with _row, its rows in order; columns without a name are dropped."""
    rows = spark.read.option("header", "true").option("sep", sep).option("multiLine", "true").option("escape", '"').option("inferSchema", "false").csv(path)
    named = [c for c in rows.columns if c.strip() and not c.startswith("_c")]
    return rows.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(c.strip()) for c in named])


def legend_csv(spark: SparkSession, path: str) -> DataFrame:
    """A legend's first two columns: abbrev (upper case), full_name (lower case); rows with a blank one are left out."""
    rows = sheet(spark, path)
    a, b = rows.columns[1:3]
    out = rows.select(F.upper(strip(F.col(f"`{a}`"))).alias("abbrev"), F.lower(strip(F.col(f"`{b}`"))).alias("full_name"))
    return out.where("abbrev <> '' and full_name <> ''")


def strict_json(c: Column) -> Column:
    """JSON text as VARIANT; text that can't be read is an error, null stays null."""
    return F.parse_json(c)


def grouped_by_name(listing: DataFrame) -> DataFrame:
    """Files by the part of their name before the first dot: id, paths in order. In: path."""
    id_ = F.substring_index(file_name(F.col("path")), ".", 1)
    return listing.where(id_ != "").groupBy(id_.alias("id")).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def supplement_sources(listing: DataFrame, ids: DataFrame) -> DataFrame:
    """Files that belong to an id: in a folder of its name, one or two levels up, or with a name that begins with it. id, path, each once."""
    parts = F.split("path", r"[/\\]")
    above = lambda k: F.when(F.size(parts) > k, F.element_at(parts, -1 - k))
    names = F.array(F.regexp_extract(file_name(F.col("path")), r"(?i)^(PMC\d+)", 1), above(1), above(2))
    named = listing.select("path", F.explode(F.array_distinct(F.array_compact(names))).alias("n")).withColumn("n", F.upper("n"))
    return named.join(ids.select(F.upper("id").alias("n"), "id").distinct(), "n").select("id", "path").distinct()


def xml_texts(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """path and text of a folder's XML files; ``first``: only so many, by name (that is the feature)."""
    rows = texts(spark, folder, "*.xml")
    return rows if first is None else rows.orderBy(file_name(F.col("path")), "path").limit(first)
