"""Image files below several roots, in one order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.numbering import numbered
from tarnwork.sources.annotations import IMAGE_EXTENSIONS


def ordered_images(files: DataFrame, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(root, path, number) of (root, path): image files by root, then path, numbered from 0; extensions in any case."""
    ends = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    return numbered(files.where(ends.isin(*extensions)).select("root", "path").distinct(), "root", "path")


def list_images(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(root, path, number) of all images below the roots, of which each may be a single file; contents are not read.

    A root that does not exist is refused, and so are roots that hold no image at all. A
    single file counts whatever its extension.
    """
    found = None
    for number, root in enumerate(roots):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(root)
        alone = fs.getFileStatus(at).isFile()
        below = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.lit(number).alias("root"), F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.lit(alone).alias("alone"))
        found = below if found is None else found.unionAll(below)
    ends = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    images = found.where(F.col("alone") | ends.isin(*extensions)).select("root", "path").distinct()
    out = numbered(images, "root", "path")
    if out.isEmpty():
        raise RuntimeError(f"no image below {list(roots)}")
    return out
