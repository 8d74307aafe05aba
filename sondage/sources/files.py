"""Reading files by kind, listing them, and deciding what may come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import heads

MEGABYTE = 1024 * 1024

# File kinds by extension, first bytes by kind, and the intake limits.
EXTENSION_TYPES = {
    "csv": "csv", "xlsx": "excel", "xls": "excel", "json": "json", "parquet": "parquet", "txt": "text", "tsv": "text",
    "zip": "archive", "tar": "archive", "gz": "archive",
}
SIGNATURES = {b"PK": "zip", b"\x1f\x8b": "gzip", b'{"': "json"}
ALLOWED_EXTENSIONS = ("csv", "json", "parquet", "xlsx", "xls")
MAX_DOWNLOAD_MB = 100

SEPARATORS = (",", ";", "\t", "|")
_SNIFF_LINES = 20


def extension(path: Column) -> Column:
    """Lower-case last extension of a path, blank when it has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def classify_file_type(path: Column, head: Column | None = None) -> Column:
    """Kind by extension; by the first bytes (binary ``head``) where the extension says nothing."""
    ext = extension(path)
    kinds = F.create_map(*[F.lit(x) for kv in EXTENSION_TYPES.items() for x in kv])
    by_head = F
    if head is not None:
        for signature, kind in SIGNATURES.items():
            start = F.substring(head, 1, len(signature))
            by_head = by_head.when(start == F.lit(bytearray(signature)), kind)
        sniffed = by_head.otherwise("unknown")
    else:
        sniffed = F.lit("unknown")
    return F.coalesce(F.try_element_at(kinds, ext), sniffed)


def file_manifest(spark: SparkSession, root: str, sniff: bool = False) -> DataFrame:
    """``(path, length, ext, file_type)`` of every file below a folder, paths relative to it.

    Listing needs no content. ``sniff`` reads the first ten bytes of the files whose extension is unknown, of any size.
    """
    heads.register(spark)
    listed = spark.read.format("file_heads").option("known", ",".join(EXTENSION_TYPES)).option("sniff", sniff).load(root)
    ext = extension(F.col("path"))
    return listed.select("path", "length", ext.alias("ext"), classify_file_type(F.col("path"), F.col("head") if sniff else None).alias("file_type"))


def file_type_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("file_type").agg(F.count(F.lit(1)).alias("n_files"))


def ingest_gate(manifest: DataFrame, max_mb: int = MAX_DOWNLOAD_MB) -> DataFrame:
    """Files with an allowed extension that are not too large."""
    return manifest.where(extension(F.col("path")).isin(*ALLOWED_EXTENSIONS) & (F.col("length") / MEGABYTE <= max_mb))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The separator that occurs equally often, and at least once, in each of the first lines."""
    lines = spark.read.text(path).where(F.length("value") > 0).limit(_SNIFF_LINES)
    counts = [F.regexp_count("value", F.lit("\\" + s if s == "|" else s)) for s in SEPARATORS]
    row = lines.agg(*[e for c in counts for e in (F.min(c), F.max(c))]).first()
    steady = [(row[2 * i], -i) for i in range(len(SEPARATORS)) if row[2 * i] and row[2 * i] == row[2 * i + 1]]
    return SEPARATORS[-max(steady)[1]] if steady else SEPARATORS[0]


def _one_object_per_line(spark: SparkSession, path: str) -> bool:
    """Whether the first line is an object of its own; such files can be split among tasks."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1)
    row = first.select(F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull()).first()
    return row is None or bool(row[0])


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read one table by its extension: csv, json, parquet, tab-separated text, or a guessed separator.

    Pass ``schema`` for text formats in production: inferring types costs a
    second pass over the files.
    """
    ext = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    reader = spark.read.schema(schema) if schema else spark.read
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext == "json":
        return reader.option("multiLine", not _one_object_per_line(spark, path)).option("mode", "FAILFAST").json(path)
    separator = {"csv": ",", "txt": "\t", "tsv": "\t"}.get(ext) or sniff_delimiter(spark, path)
    return reader.csv(path, header=True, sep=separator, inferSchema=schema is None)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """A table that an earlier stage wrote; types are kept, so dates stay dates."""
    return spark.read.parquet(path)


def read_grouped(spark: SparkSession, root: str) -> list[tuple[str, str, DataFrame]]:
    """``(extension, shape, table)`` of the table files below a folder: one read, and one inference of types, for all
    files of the same extension and layout, however many these are.

    The shape is a Parquet file's schema or a text file's first line. Each table has a column ``table_id``, the
    path of the file that a row is from. Files that cannot be read, and names that begin with ``_`` or ``.``, are left out.
    """
    heads.register(spark)
    listed = spark.read.format("file_heads").option("sniff", False).option("shapes", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    tables = listed.select("path", "shape", extension(F.col("path")).alias("ext")).where(
        F.col("ext").isin("csv", "tsv", "txt", "json", "parquet") & F.col("shape").isNotNull() & ~name.rlike("^[_.]"))
    groups = tables.groupBy("ext", "shape").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("ext", "shape").collect()
    found = []
    for group in groups:  # a row per layout; the paths are what a reader is given
        paths = [f"{root.rstrip('/')}/{p}" for p in group["paths"]]
        if group["ext"] == "parquet":
            frame = spark.read.parquet(*paths)
        elif group["ext"] == "json":
            frame = spark.read.option("multiLine", not _one_object_per_line(spark, paths[0])).json(paths)
        else:
            separator = "," if group["ext"] == "csv" else "\t"
            frame = spark.read.csv(paths, header=True, sep=separator, inferSchema=True)
        found.append((group["ext"], group["shape"], frame.select("*", F.col("_metadata.file_path").alias("table_id"))))
    return found


def read_all(spark: SparkSession, paths: list[str],
             use: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The readable tables by path, and ``(path, status, error)`` rows for all of them."""
    tables, rows = {}, []
    for path in paths:
        try:
            table = read_table(spark, path)
            tables[path] = use(table) if use else table
            rows.append((path, "success", None))
        except Exception as error:  # a bad file is recorded and the others go on
            rows.append((path, "failed", str(error)))
    return tables, spark.createDataFrame(rows, "path string, status string, error string")
