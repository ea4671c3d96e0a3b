"""Readers: the driver's tables, and files that become documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

_KINDS = {"pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "tif", "tiff", "heic")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (pdf, image; null for others, with an error), length, content of files under ``path``."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin(*_KINDS["pdf"]), "pdf").when(ext.isin(*_KINDS["image"]), "image")
    return spark.read.format("binaryFile").load(path).select("path", kind.alias("kind"), F.when(kind.isNull(), F.concat(F.lit("unsupported: "), ext)).alias("error"), "length", "content")


def opened(files_: DataFrame) -> DataFrame:
    """path, kind, n_pages, error of :func:`files`: an image is a page, a PDF has those of its page tree, compressed or not.

    A document without pages, like one of another kind, is an error and has none.
    """
    read = files_.withColumn("pdf", pdf.page_boxes(F.when(F.col("kind") == "pdf", F.col("content"))))
    n = F.when(F.col("kind") == "image", 1).when(F.col("kind") == "pdf", F.size("pdf.pages")).otherwise(0)
    error = F.coalesce("error", F.when(F.col("kind") == "pdf", F.col("pdf.error")))
    return read.select("path", "kind", n.cast("int").alias("n_pages"), error.alias("error"))


def image_pages(opened_: DataFrame) -> DataFrame:
    """path, page, has_layer of the images among :func:`opened`: one page each, without a text layer."""
    return opened_.where("kind = 'image' and error is null").select("path", F.lit(0).alias("page"), F.lit(False).alias("has_layer"))


def installed_models(spark: SparkSession, path: str) -> DataFrame:
    """org, repo, bytes, complete of models kept as org/repo/files; complete if a weights file is there."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = F.regexp_extract_all("path", F.lit(r"([^/]+)"), 1)
    depth = len([p for p in path.split("://")[-1].split("/") if p])
    named = listed.select(F.element_at(parts, -3).alias("org"), F.element_at(parts, -2).alias("repo"), "path", "length").where(F.size(parts) >= depth + 3)
    return named.groupBy("org", "repo").agg(F.sum("length").alias("bytes"), F.bool_or(F.col("path").endswith(".safetensors")).alias("complete"))


def render_scale(width, height, dpi: float = 300.0, cap: float = 40e6):
    """Pixels a point at ``dpi``, less where the page would exceed ``cap`` pixels."""
    scale = F.lit(dpi / 72)
    pixels = width * height * scale * scale
    return F.least(scale, scale * F.sqrt(F.lit(cap) / pixels))


def from_bottom_left(x, y, w, h, page_w, page_h):
    """A box in points from the bottom left as shares of the page from the top left."""
    return F.struct((x / page_w).alias("x"), (1 - (y + h) / page_h).alias("y"), (w / page_w).alias("w"), (h / page_h).alias("h"))
