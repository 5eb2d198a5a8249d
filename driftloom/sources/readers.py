"""Table scans: CSV, TSV, Parquet, JSON records and trees of cycler files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftloom.sources.stage import stage


def read_csv(spark: SparkSession, path, schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; types are inferred only when no schema is given (onboarding)."""
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_tsv(spark: SparkSession, path, schema: StructType | str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path, schema: StructType | str | None = None, *, whole_file: bool = False) -> DataFrame:
    """JSON records, one per line, or one array per file with ``whole_file``."""
    reader = spark.read.option("multiLine", whole_file)
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Choose the reader by the file's suffix; anything unknown is CSV."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        return read_parquet(spark, path)
    if low.endswith((".json", ".jsonl")):
        return read_json(spark, path, schema)
    return read_csv(spark, path, schema, sep="\t" if low.endswith(".tsv") else ",")


# Names inside a cycler tree, as patterns on the whole path.
FOLDER_PATTERN = r"(?i)/SP2_(\d+)C_(\w+)[^/]*/[^/]*$"
SOC_PATTERN = r"(?i)(\d+)SOC[^/]*$"
REQUIRED = {
    "Test_Time(s)": "test_time_s",
    "Current(A)": "current_a",
    "Voltage(V)": "voltage_v",
    "Charge_Capacity(Ah)": "charge_capacity_ah",
    "Discharge_Capacity(Ah)": "discharge_capacity_ah",
}


@dataclass
class CyclerTree:
    """Rows of the readable files, one row per skipped file with the reason, and one per cell that is no number."""

    rows: DataFrame
    rejects: DataFrame
    bad_cells: DataFrame


def _file_sizes(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path and size in bytes of every file, from the listing alone; the unpacked size for gzip files.

    A gzip file ends with its unpacked size modulo 2^32; only these files are opened for it, and one too large to be a
    single value has a null size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = files.option("pathGlobFilter", glob).load(root).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    )
    packed = F.lower("path").endswith(".gz")
    if found.filter(packed).isEmpty():
        return found
    last = F.hex(F.substring("content", -4, 4))
    tail = F.conv(F.concat(*[F.substring(last, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    unpacked = files.option("pathGlobFilter", "*.[gG][zZ]").load(root).filter(F.col("length") < 2**31 - 1).select(
        F.col("_metadata.file_path").alias("path"), tail.alias("unpacked")
    )
    return found.join(unpacked, "path", "left").select("path", F.when(packed, F.col("unpacked")).otherwise(F.col("size")).alias("size"))


def read_cycler_tree(
    spark: SparkSession, root: str, glob: str = "*.csv", *, folder_pattern: str = FOLDER_PATTERN, soc_pattern: str = SOC_PATTERN
) -> CyclerTree:
    """All cycler CSV files below ``root`` as one labelled table.

    Temperature and protocol come from the folder name, the initial state of
    charge from the file name.  Columns are found through each file's own
    header, so files may order them differently.  Files with a bad name, a
    missing column or content that cannot be read to its end are skipped and
    have a row in ``rejects``; when none is left this raises.  A cell that is
    no number is null in ``rows`` and has a row in ``bad_cells``; an empty
    cell is null alone.  Whether a file was read to its end is told by its size:
    what is missing must exceed one byte a line, the second half of a line's end.
    A file of no bytes has no row anywhere, as Spark's listing leaves it out.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
        .text(root)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value",
            F.monotonically_increasing_id().alias("place"),
        )
    )
    # a comma is a border where an even number of quotes follows; "" inside quotes is one quote
    cells = F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    cells = F.transform(cells, lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))
    names = F.transform(cells, F.trim)
    # the header is the first line of a file's first block that names any known column; one task reads a block in order
    known = (F.col("start") == 0) & F.arrays_overlap(names, F.array(*[F.lit(c) for c in REQUIRED]))
    contents = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("value")).alias("n_bytes"),
        F.min_by(F.when(known, names), F.when(known, F.col("place"))).alias("names"),
    )
    files = _file_sizes(spark, root, glob).join(contents, "path", "left")
    # beside the lines' own bytes a file has one or two for each line's end, and three at most before the first
    ends = F.pmod(F.col("size") - F.coalesce("n_bytes", F.lit(0)) + 1, F.lit(2**32))
    whole_read = (F.col("size") == 0) | ends.between(F.coalesce("n_lines", F.lit(0)), 2 * F.coalesce("n_lines", F.lit(0)) + 4)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    whole = F.url_decode("path")
    absent = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), F.coalesce("names", F.array().cast("array<string>")))
    files = files.withColumns(
        {
            "temperature_c": F.nullif(F.regexp_extract(whole, folder_pattern, 1), F.lit("")).cast("int"),
            "test_type": F.upper(F.regexp_extract(whole, folder_pattern, 2)),
            "initial_soc": F.nullif(F.regexp_extract(whole, soc_pattern, 1), F.lit("")).cast("double") / 100.0,
            "source_file": name,
            "absent": absent,
        }
    )
    files = files.withColumn(
        "reason",
        F.when(~whole_read, F.concat(F.lit("unreadable: "), whole))
        .when(F.col("temperature_c").isNull(), F.concat(F.lit("folder name: "), whole))
        .when(F.col("initial_soc").isNull(), F.concat(F.lit("file name: "), name))
        .when(F.size("absent") > 0, F.concat(F.lit("missing columns: "), F.array_join("absent", ", "))),
    )
    files = stage(files, "cycler-files")  # one row per file, used for rows, rejects and the check below
    accepted = files.filter(F.col("reason").isNull()).select(
        "path", "names", "temperature_c", "test_type", "initial_soc", "source_file"
    )
    if accepted.isEmpty():
        raise RuntimeError(f"no readable cycler file under {root}")

    def cell(raw: str):
        return F.get("_cells", F.array_position("names", raw).cast("int") - 1)

    # a header that is repeated further down is no row
    data = lines.join(accepted, "path").withColumn("_cells", cells).filter(F.transform("_cells", F.trim) != F.col("names"))
    labels = ["temperature_c", "test_type", "initial_soc", "source_file", "path"]
    rows = data.select(*[cell(raw).try_cast("double").alias(std) for raw, std in REQUIRED.items()], *labels)
    written = F.array(*[F.struct(F.lit(raw).alias("column"), cell(raw).alias("value")) for raw in REQUIRED])
    bad = F.filter(written, lambda c: (F.trim(c["value"]) != "") & c["value"].try_cast("double").isNull())
    bad_cells = data.select("path", F.explode(bad).alias("_bad"), F.col("value").alias("line")).select("path", "_bad.column", "_bad.value", "line")
    return CyclerTree(rows, files.filter(F.col("reason").isNotNull()).select("path", "reason"), bad_cells)
