"""Results as JSON, CSV, HTML payloads, pictures and manifests."""

from __future__ import annotations

import struct
import uuid
import zlib
from pathlib import Path
from urllib.parse import quote

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motecraft.config import Config
from motecraft.functions import values
from motecraft.operators import report, review


def image_records(summary: DataFrame, points: DataFrame, exclusions: DataFrame) -> DataFrame:
    """One nested record per image: its summary, `points` by id, `excluded` by position."""
    listed = points.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in points.columns if c not in ("image_id", "id")]))).alias("points"))
    left_out = exclusions.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "radius", "area", "reason"))).alias("excluded"))
    return summary.join(listed, "image_id", "left").join(left_out, "image_id", "left")


def as_json(records: DataFrame) -> DataFrame:
    """`image_id` and `json`, the record as text; absent values are left out, characters are not escaped."""
    return records.select("image_id", F.to_json(F.struct(*records.columns)).alias("json"))


def write_image_json(records: DataFrame, folder: str) -> None:
    """One JSON file per image, in a folder named after it."""
    as_json(records).repartition("image_id").write.mode("overwrite").partitionBy("image_id").text(folder)


def batch_document(records: DataFrame, cfg: Config, method: str, model_version: str | None = None) -> DataFrame:
    """One row `json`: parameters, method and all image records by name. For a batch that fits one document."""
    images = F.array_sort(F.collect_list(F.struct("image_id", *[c for c in records.columns if c != "image_id"]))).alias("images")
    head = [F.lit(model_version).alias("model_version"), F.from_json(F.lit(cfg.to_json()), F.schema_of_json(F.lit(cfg.to_json()))).alias("config"), F.lit(method).alias("method")]
    return records.agg(images).select(F.to_json(F.struct(*head, "images")).alias("json"))


def html_payload(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.regexp_replace(json, "<", "\\\\u003c")


#: Fixed columns of the count tables.
PLAIN_COUNTS = ("count", "accepted_count", "review_count", "red_region_count")
MODEL_COUNTS = ("baseline_count", "count", "review_count", "model_rejected_count", "dim_proposal_count")


def count_table(summary: DataFrame, model: bool = False, total: bool = True) -> DataFrame:
    """Counts by name, and a row TOTAL last. Names are made safe for spreadsheets."""
    ready = summary.withColumn("accepted_count", F.col("count") - F.col("review_count"))
    measures = list(MODEL_COUNTS if model else PLAIN_COUNTS)
    rows = report.with_total(ready, "name", measures) if total else ready.select("name", *measures, F.lit(0).alias("is_total"))
    return rows.orderBy("is_total", values.casefold(F.col("name")), "name").select(report.csv_safe(F.col("name")).alias("name"), *measures)


def write_csv(rows: DataFrame, folder: str) -> None:
    """CSV files in the order of the rows, each with a header whose first name carries the mark spreadsheets look for."""
    marked = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0])
    marked.write.mode("overwrite").option("header", True).csv(folder)


def picture_name(image_id: str) -> str:
    """The file name of an image's picture: unlike for unlike images, and without separators of paths."""
    return quote(image_id, safe=" ()[]+=@,") + ".png"


def source_path(name: Column, folder: str = "images") -> Column:
    """A relative address of a file of the bundle; the separators between folders stay."""
    return F.concat(F.lit(folder + "/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))


def write_pictures(pictures: DataFrame, folder: str) -> int:
    """Write each `png` as a file into a folder that all executors share; how many were written.

    A file appears whole or not at all, so that a task that runs twice does no harm.
    """

    def run(batches):
        import pandas as pd

        target = Path(folder)
        target.mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for row in batch.itertuples():
                part = target / f".{uuid.uuid4().hex}"
                part.write_bytes(row.png)
                part.replace(target / picture_name(row.image_id))
            yield pd.DataFrame({"n": [len(batch)]})

    return pictures.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_bundle(result: dict[str, DataFrame], folder: str, cfg: Config = Config(), model: bool = False, images: DataFrame | None = None) -> None:
    """All results of a batch: per-image JSON, the batch document, counts, and the upload manifest.

    With the images also their annotated pictures and red masks, as files, and a payload for a page that shows them: one
    line of JSON an image, safe inside a script element.
    """
    records = image_records(result["summary"].withColumn("src", source_path(F.col("name"))), result["points"], result["exclusions"])
    write_image_json(records, f"{folder}/images")
    batch_document(records, cfg, "learned" if model else "training-free").write.mode("overwrite").text(f"{folder}/detections")
    write_csv(count_table(result["summary"], model), f"{folder}/counts")
    manifest = result["summary"].select("name", "sha256").unionByName(result["errors"].select(F.col("image_id").alias("name"), "error"), allowMissingColumns=True)
    manifest.select(F.to_json(F.struct("name", "sha256", "error")).alias("json")).write.mode("overwrite").text(f"{folder}/manifest")
    if images is not None:
        good = images.join(result["summary"].select("image_id"), "image_id", "left_semi")
        write_pictures(annotations(good, result["points"], result["exclusions"]), f"{folder}/annotated")
        write_pictures(red_masks(good, cfg), f"{folder}/red_masks")
        as_json(records).select(html_payload(F.col("json")).alias("value")).write.mode("overwrite").text(f"{folder}/payload")


def png(image: np.ndarray) -> bytes:
    """A PNG of a grey or BGR image."""
    deep = image.ndim == 3
    rows = image[:, :, ::-1] if deep else image
    raw = b"".join(b"\0" + np.ascontiguousarray(r).tobytes() for r in rows)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if deep else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


#: Fixed colours (BGR) of what is drawn: accepted, in review, excluded.
COLOURS = {"accepted": (0, 200, 0), "review": (0, 165, 255), "excluded": (0, 0, 255)}


def annotated(image: np.ndarray, points: list[dict], excluded: list[dict]) -> np.ndarray:
    """The image with a circle around each point that isn't removed, and around each excluded region."""
    out = image.copy()
    circles = [(p["x"], p["y"], p["radius"], COLOURS[p["status"]]) for p in points if not p.get("removed")]
    for x, y, radius, colour in [*circles, *((e["x"], e["y"], e["radius"], COLOURS["excluded"]) for e in excluded)]:
        turn = np.linspace(0, 2 * np.pi, max(16, int(8 * radius)), endpoint=False)
        for r in (radius, radius + 1):
            iy, ix = np.rint(y + r * np.sin(turn)).astype(int), np.rint(x + r * np.cos(turn)).astype(int)
            inside = (iy >= 0) & (iy < out.shape[0]) & (ix >= 0) & (ix < out.shape[1])
            out[iy[inside], ix[inside]] = colour
    return out


def annotations(images: DataFrame, points: DataFrame, exclusions: DataFrame) -> DataFrame:
    """`image_id` and `png`, the annotated picture, made where the image is."""
    import pandas as pd

    from motecraft.operators.detect import bgr

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                image = bgr(r["data"], r["height"], r["width"], r["n_channels"])
                yield pd.DataFrame({"image_id": [r["image_id"]], "png": [png(annotated(image, list(r["points"]), list(r["excluded"])))]})

    p = review.with_optional(points).groupBy("image_id").agg(F.collect_list(F.struct("x", "y", "radius", "status", "removed")).alias("points"))
    e = exclusions.groupBy("image_id").agg(F.collect_list(F.struct("x", "y", "radius")).alias("excluded"))
    joined = images.select("image_id", "width", "height", "n_channels", "data").join(p, "image_id", "left").join(e, "image_id", "left")
    filled = joined.withColumns({"points": F.coalesce("points", F.array().cast(p.schema["points"].dataType)), "excluded": F.coalesce("excluded", F.array().cast(e.schema["excluded"].dataType))})
    return filled.mapInPandas(run, "image_id string, png binary")


def red_masks(images: DataFrame, cfg: Config = Config()) -> DataFrame:
    """`image_id` and `png`, the red mask in the size of the image (nearest pixel)."""
    import pandas as pd

    from motecraft.operators.detect import bgr, red_mask, scaled

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                mask = red_mask(scaled(bgr(r["data"], r["height"], r["width"], r["n_channels"]), cfg.scale), cfg)
                iy, ix = (np.arange(n) * m // n for n, m in zip((r["height"], r["width"]), mask.shape, strict=True))
                yield pd.DataFrame({"image_id": [r["image_id"]], "png": [png((mask[iy][:, ix] * 255).astype(np.uint8))]})

    return images.select("image_id", "width", "height", "n_channels", "data").mapInPandas(run, "image_id string, png binary")
