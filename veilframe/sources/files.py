"""Files of many kinds: read as bytes, told apart by how they begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How files of a kind begin, in hexadecimal digits, and a media type.
BEGINS = {"pdf": ("255044462D",), "png": ("89504E470D0A1A0A",), "jpeg": ("FFD8FF",), "tiff": ("49492A00", "4D4D002A"), "bmp": ("424D",)}
ZIP = "504B"
RIFF, WEBP = "52494646", "57454250"
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
# Fixed values end.
MOST_BYTES = 20 << 20


def kind(content: Column, name: Column, declared: Column | None = None, most_bytes: int = MOST_BYTES) -> Column:
    """struct<kind, error>: docx, pdf, png, jpeg, tiff, bmp or webp, else why there is none: empty, too large, unsupported.

    A zip is a docx only by its name or its declared media type. Null content is empty.
    """
    head = F.hex(F.substring(content, 1, 12))
    named = F.coalesce(F.lower(name).rlike(r"(?s)[^/]\.docx\z"), F.lit(False))
    if declared is not None:
        named = named | F.coalesce(declared == DOCX_TYPE, F.lit(False))
    found = F.when(head.startswith(ZIP) & named, "docx")
    for k, starts in BEGINS.items():
        for s in starts:
            found = found.when(head.startswith(s), k)
    found = found.when(head.startswith(RIFF) & head.endswith(WEBP), "webp")
    size = F.octet_length(content)
    error = F.when(F.coalesce(size == 0, F.lit(True)), "empty").when(size > most_bytes, "too large").when(found.isNull(), "unsupported")
    return F.struct(F.when(error.isNull(), found).alias("kind"), error.alias("error"))


def read(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length, kind, error and content of each file at ``path``; the bytes of files over ``most_bytes`` are not read.

    Spark's readers leave out files without a byte, so these have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= most_bytes).select("path", "length", "content").withColumn("k", kind(F.col("content"), F.col("path"), None, most_bytes))
    large = files.where(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.struct(F.lit(None).cast("string").alias("kind"), F.lit("too large").alias("error")).alias("k"))
    return small.unionByName(large).select("path", "length", "k.kind", "k.error", "content")
