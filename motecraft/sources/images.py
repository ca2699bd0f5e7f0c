"""Images from folders, lists and uploads: scan, validation, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motecraft.functions import values
from motecraft.sources import formats

#: Suffixes of the plain scan, of the wide scan and of uploads, with the first bytes of their formats.
PLAIN_SUFFIXES = ("png",)
SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
MAGIC = {"png": ("89504E470D0A1A0A",), "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",), "tif": ("49492A00", "4D4D002A"), "tiff": ("49492A00", "4D4D002A"), "bmp": ("424D",)}
#: Fixed limits of an upload.
MAX_FILES, MAX_BYTES, MAX_TOTAL_BYTES, MAX_PIXELS = 50, 25 * 2**20, 250 * 2**20, 25_000_000


def _glob(suffixes) -> str:
    each = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    return "*.{" + ",".join(each(s) for s in suffixes) + "}"


def scan(spark: SparkSession, folder: str, suffixes=SUFFIXES, recursive: bool = False) -> DataFrame:
    """Files of a folder by suffix in any case: `path`, `name`, `suffix`, `content`, `n_bytes`, `sha256`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", _glob(suffixes)).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return described(files)


def ordered(files: DataFrame) -> DataFrame:
    """Files by name without case; equal ones by name and path."""
    return files.orderBy(values.casefold(F.col("name")), "name", "path")


def plain_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The older scan: PNG files of the folder itself, each once, in order."""
    return ordered(scan(spark, folder, PLAIN_SUFFIXES).dropDuplicates(["path"]))


def described(files: DataFrame) -> DataFrame:
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\+", "%2B"))
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), "content", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def listed(spark: SparkSession, list_file: str) -> DataFrame:
    """Names of a list file in order: UTF-8 with or without a mark, trimmed, blank lines skipped; `place`, `name`.

    A name that is absolute or climbs up is an error.
    """
    lines = spark.read.text(list_file, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r\n|\r|\n")).alias("place", "line"))
    named = lines.select("place", F.trim("line").alias("name")).where("name <> ''")
    bad = F.col("name").rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")
    return named.select("place", F.when(bad, F.raise_error(F.concat(F.lit("not a name inside the folder: "), "name"))).otherwise(F.col("name")).alias("name"))


def selected(files: DataFrame, names: DataFrame) -> DataFrame:
    """The listed files with their `place`; a listed name without a file is an error."""
    joined = names.join(files, "name", "left")
    found = F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no such image: "), "name"))).otherwise(F.col("path"))
    return joined.withColumn("path", found)


def conflicts(files: DataFrame) -> DataFrame:
    """Reasons why a selection can't be processed as one batch: `problem`, `name`; empty if it can.

    Stems must differ even in another case, as results are named after them; suffixes must be known; a path may stand
    once, however its slashes are written; a selection without any file has the problem `empty` and no name.
    """
    stem = values.casefold(F.regexp_replace("name", r"\.[^.]*$", ""))
    twice = files.groupBy(stem.alias("stem")).agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1")
    unknown = files.where(~F.col("suffix").isin(*SUFFIXES))
    again = files.groupBy(F.regexp_replace(_plain(F.col("path")), r"(?<=.)/(?:\.?/)+", "/").alias("path")).agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1")
    tell = lambda df, problem: df.select(F.lit(problem).alias("problem"), "name")
    empty = files.agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("name")).where("n = 0")
    return tell(twice, "same stem").union(tell(unknown, "suffix")).union(tell(again, "listed twice")).union(tell(empty, "empty"))


def checked(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`files` with `error`: a bad name, size, suffix, content that isn't of the suffix's format, or several frames; else null.

    `frames`, `orientation` and `deep` (16-bit grey) are read from the file's own tables.
    """
    start = F.hex(F.substring("content", 1, 8))
    fits = F.lit(False)
    for suffix, starts in MAGIC.items():
        for m in starts:
            fits = fits | ((F.col("suffix") == suffix) & start.startswith(m))
    error = (
        F.when(~values.valid_file_name(F.col("name"), SUFFIXES), "file name")
        .when(F.col("n_bytes") > max_bytes, "file too large")
        .when(~fits, "content is not of the suffix's format")
        .when(F.col("frames") > 1, "several frames")
    )
    return files.withColumn("facts", formats.facts_of(F.col("content"))).select(*files.columns, "facts.*").withColumn("error", error)


def within_limits(files: DataFrame, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """One row: `n_files`, `n_bytes` and `accepted` of an upload; it is refused whole if nothing in it is sound."""
    counted = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.count_if(F.col("error").isNull()).alias("n_sound"))
    return counted.withColumn("accepted", (F.col("n_files") <= max_files) & (F.col("n_bytes") <= max_total) & (F.col("n_sound") > 0))


def _plain(path):
    """A path with one slash after the scheme, however its source writes it."""
    return F.regexp_replace(path, "^([a-zA-Z0-9+.-]+):/+", "$1:/")


def decoded(spark: SparkSession, folder: str, files: DataFrame, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Image rows of checked files by Spark's image source, undecodable ones with `error`.

    Pictures are turned as their orientation mark says, and of 16-bit grey the high bytes are kept; the image source does
    neither.
    """
    raw = spark.read.format("image").load(folder).select("image.*").withColumn("at", _plain(F.col("origin"))).drop("origin")
    deep = formats.grey_of(F.when(F.col("deep") & F.col("error").isNull(), F.col("content")))
    kept = files.withColumn("grey", deep).drop("content").withColumn("at", _plain(F.col("path")))
    joined = kept.join(raw, "at", "left").withColumns({"data": F.when(F.col("deep"), F.col("grey")).otherwise(F.col("data")), "nChannels": F.when(F.col("deep"), 1).otherwise(F.col("nChannels"))})
    pixels = F.col("width").cast("long") * F.col("height")
    undecodable = (F.coalesce(F.col("height"), F.lit(-1)) < 0) | F.col("data").isNull()
    judged = joined.withColumn("error", F.coalesce("error", F.when(undecodable, "the image can't be decoded").when(pixels > max_pixels, "too many pixels")))
    on_side = F.col("orientation") >= 5
    turned = formats.turned_of(F.when((F.col("orientation") > 1) & F.col("error").isNull(), F.col("data")), F.col("height"), F.col("width"), F.col("nChannels"), F.col("orientation"))
    seen = judged.withColumn("turned", turned).withColumns({"data": F.coalesce("turned", "data"), "seen_width": F.when(on_side, F.col("height")).otherwise(F.col("width")), "seen_height": F.when(on_side, F.col("width")).otherwise(F.col("height"))})
    return seen.select(F.col("name").alias("image_id"), "name", F.col("seen_width").alias("width"), F.col("seen_height").alias("height"), F.col("nChannels").alias("n_channels"), "data", "sha256", "n_bytes", "error")


def export_names(files: DataFrame, batch: str) -> DataFrame:
    """Batch-unique names that carry nothing of the users' own: twelve hex digits of the batch and a number."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(values.casefold(F.col("name")), "path"))
    return files.withColumn("export_name", F.concat(F.format_string("%s_image_%03d.", F.lit(batch[:12]), place), "suffix"))
