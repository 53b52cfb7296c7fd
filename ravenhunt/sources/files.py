"""File manifest - existence, type, size limit and SHA-256 per file.

``binaryFile`` lists files on any Hadoop file system and reads each file's
bytes in the task that hashes it. With a size limit, the content of larger
files is not even read (the reader applies the filter on length before it
opens a file); a file beyond Spark's 2 GiB for one value needs such a limit.
Works on a single file or a whole directory tree.

``json_documents`` reads files that are one JSON document each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
MAX_FILE_BYTES = 100 * 1024 * 1024  # the ``size_ok`` flag
ALLOWED_EXTENSIONS = [".csv", ".json", ".jsonl", ".log", ".txt"]
# ----------------------------------------------------------------------------

# Control characters, which no JSON text holds unescaped: no document is broken.
NO_BREAK = "\x01\x02\x03\x04"
ONE_RECORD = 1 << 30  # bytes; a record of the line reader ends at 2 GiB


def json_documents(reader: DataFrameReader, path: str | list[str]) -> DataFrame:
    """Files read as one JSON document each, by a reader with a schema.

    ``multiLine`` opens the file again for every number that is read as text (to
    take it as it is written), so a document is read as one record of the line
    reader, which holds its bytes. Only files too large for that take ``multiLine``."""
    docs = reader.option("lineSep", NO_BREAK).json(path)
    size = F.col("_metadata.file_size")
    if docs.where(size > ONE_RECORD).isEmpty():  # no file is read to find out: the listing says it
        return docs
    large = reader.option("multiLine", True).json(path)
    return docs.where(size <= ONE_RECORD).unionByName(large.where(size > ONE_RECORD))


def file_manifest(
    spark: SparkSession,
    path: str,
    allowed_extensions: list[str] | None = None,
    max_bytes: int | None = None,
    glob: str | None = None,
    size_flag: int = MAX_FILE_BYTES,
) -> DataFrame:
    allowed = ALLOWED_EXTENSIONS if allowed_extensions is None else allowed_extensions
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    digest = F.sha2(F.col("content"), 256)
    rows = files.where(F.col("length") <= max_bytes) if max_bytes is not None else files
    rows = rows.select("path", "length", "modificationTime", digest.alias("sha256"))
    if max_bytes is not None:
        large = files.where(F.col("length") > max_bytes).select("path", "length", "modificationTime")
        rows = rows.unionByName(large.withColumn("sha256", F.lit(None).cast("string")))
    ext = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./]*)$", 1))
    size_ok = F.col("length") <= F.lit(size_flag)
    return rows.select(
        "path",
        "length",
        "modificationTime",
        ext.alias("extension"),
        ext.isin(allowed).alias("extension_allowed"),
        size_ok.alias("size_ok"),
        "sha256",
    )
