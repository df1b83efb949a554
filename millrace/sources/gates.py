"""What is accepted: file names, sizes and first bytes, as status columns instead of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.params import ALLOWED_EXT, IMAGE_EXT, MAX_UPLOAD_BYTES, ZIP_EXT

# The first bytes of image files, in hex.
IMAGE_MAGIC = {
    ".png": "^89504E470D0A1A0A", ".jpg": "^FFD8FF", ".jpeg": "^FFD8FF", ".gif": "^474946383[79]61", ".bmp": "^424D",
    ".tif": "^(49492A00|4D4D002A)", ".tiff": "^(49492A00|4D4D002A)", ".webp": "^52494646.{8}57454250",
}


def extension(name: Column) -> Column:
    """The last suffix of a file name in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))


def gate(files: DataFrame, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """``files`` (name, content, and optionally declared_size) with ext, length, sha256, status and error.

    status is 200, 413 (declared or measured size), 415 (extension, or first bytes that don't fit it) or 422
    (empty); the first that applies in that order of checks.
    """
    ext, size = extension(F.col("name")), F.octet_length("content")
    declared = F.col("declared_size") if "declared_size" in files.columns else F.lit(None).cast("long")
    magic = F.hex(F.substring("content", 1, 16))
    image = F.lit(False)
    for e, pattern in IMAGE_MAGIC.items():
        image = image | ((ext == e) & magic.rlike(pattern))
    failed = (
        F.when(~ext.isin(*ALLOWED_EXT), F.struct(F.lit(415), F.lit("extension not accepted")))
        .when(declared > limit, F.struct(F.lit(413), F.lit("declared size over the limit")))
        .when(size > limit, F.struct(F.lit(413), F.lit("size over the limit")))
        .when(F.coalesce(size, F.lit(0)) == 0, F.struct(F.lit(422), F.lit("empty file")))
        .when((ext == ".pdf") & ~magic.startswith("255044462D"), F.struct(F.lit(415), F.lit("not a PDF")))
        .when(ext.isin(*ZIP_EXT) & ~magic.startswith("504B0304"), F.struct(F.lit(415), F.lit("not a zip container")))
        .when(ext.isin(*IMAGE_EXT) & ~image, F.struct(F.lit(415), F.lit("not an image")))
        .otherwise(F.struct(F.lit(200), F.lit(None).cast("string")))
    )
    out = files.withColumns({"ext": ext, "length": size.cast("long"), "sha256": F.sha2("content", 256), "mr_f": failed})
    return out.withColumns({"status": F.col("mr_f.col1"), "error": F.col("mr_f.col2")}).drop("mr_f")


def first_of_digest(docs: DataFrame, digest: Column, order: str, known: DataFrame | None = None) -> DataFrame:
    """``docs`` with status 200, or 409 where an earlier row (by ``order``) or ``known`` (sha256) has its digest."""
    keyed = docs.withColumn("sha256", digest)
    first = keyed.groupBy("sha256").agg(F.min(order).alias("mr_first"))
    out = keyed.join(first, "sha256").withColumn("status", F.when(F.col(order) == F.col("mr_first"), 200).otherwise(409)).drop("mr_first")
    if known is not None:
        out = out.join(known.select("sha256", F.lit(True).alias("mr_k")), "sha256", "left")
        out = out.withColumn("status", F.when(F.coalesce("mr_k", F.lit(False)), 409).otherwise(F.col("status"))).drop("mr_k")
    return out
