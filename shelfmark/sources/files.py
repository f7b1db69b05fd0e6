"""Reading asset files and stored catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N

CATALOG_SCHEMA = (
    "id: string, filename: string, path: string, categories: array<string>, tags: array<string>, "
    "created: timestamp, size: bigint, width: int, height: int"
)
ENVELOPE_SCHEMA = "total bigint, lastUpdated string, emojis array<struct<" + CATALOG_SCHEMA + ">>"
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def extension_glob(types: list[str]) -> str:
    """A glob for the given endings in any letter case, so that other files are never opened."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in t) for t in types) + "}"


def scan_assets(
    spark: SparkSession, path: str, types: list[str] | None = None, recursive: bool = False, content: bool = False
) -> DataFrame:
    """Files as rows (filename, file_path, size, created); bytes are read only if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if types:
        reader = reader.option("pathGlobFilter", extension_glob(types))
    return _named(reader.load(path), content)


def stream_assets(
    spark: SparkSession, path: str, types: list[str] | None = None, files_per_trigger: int = 10_000
) -> DataFrame:
    """The same rows as a stream that yields every new file once."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    if types:
        reader = reader.option("pathGlobFilter", extension_glob(types))
    return _named(reader.load(path), True)


def _named(files: DataFrame, content: bool) -> DataFrame:
    columns = [
        F.url_decode(F.replace(N.base_name(F.col("path")), F.lit("+"), F.lit("%2B"))).alias("filename"),
        F.col("path").alias("file_path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("created"),
    ]
    return files.select(*columns, *(["content"] if content else []))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Records of a catalog stored as one JSON envelope; an absent or unreadable file is empty.

    The envelope is a single document by nature; catalogs that grow are stored as tables.
    """
    files = spark.read.option("multiLine", True).schema(ENVELOPE_SCHEMA).json
    try:
        envelope = files(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"pos: int, {CATALOG_SCHEMA}")
    return envelope.select(F.posexplode("emojis").alias("pos", "record")).select("pos", "record.*")


def read_catalog_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
