"""Scans of result folders, label documents, caches and logs, and sinks for exports.

Defined results: unreadable or malformed documents are left out by the catalog and result scans;
missing columns are null; empty folders give empty frames.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "id string, name string, created_at string, frame_count bigint, first_frame bigint, last_frame bigint, duration_s double, delay int, colors struct<left string, right string>, size_bytes bigint, source string"
LABELS = ("images array<struct<image_id string, file_name string, width int, height int>>, annotations array<struct<id string, image_id string, track_id bigint, supercategory string, "
          "attributes struct<role string, team string, jersey string>, bbox_image struct<x double, y double, w double, h double>, bbox_pitch map<string, double>>>")
PERCEPTION = ("seq string, rows array<struct<frame bigint, image_id string, track bigint, cls string, score double, bbox array<double>, pitch array<double>, feat array<double>, "
              "jersey struct<p array<float>, pnone float>>>")
#: Columns of the players' export, in order.
PLAYER_COLUMNS = ("id", "role", "team", "jersey", "frames", "seconds", "distance_m", "avg_speed_ms", "max_speed_ms", "sprints")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of a folder from their ``meta.json``, newest first, ties by id downwards; malformed ones left out."""
    rows = spark.read.schema(META + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and id is not null").drop("_bad").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``sequence, path, size``: files below a folder without their content; the sequence is the folder above."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("sequence"), "path", F.col("length").alias("size"))


def read_labels(spark: SparkSession, path: str, kind: str | None = "object") -> DataFrame:
    """Annotations of label documents with the position of their image (``frame``), optionally of one supercategory."""
    docs = spark.read.schema(LABELS).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("document"))
    images = docs.select("document", F.posexplode("images").alias("frame", "i")).select("document", "frame", "i.*")
    notes = docs.select("document", F.explode("annotations").alias("a")).select("document", "a.*")
    notes = notes.where(F.col("supercategory") == kind) if kind else notes
    return notes.join(images, ["document", "image_id"], "left")


def read_perception(spark: SparkSession, path: str) -> DataFrame:
    """``seq`` and the rows of perception caches, one document a clip."""
    docs = spark.read.schema(PERCEPTION).option("multiLine", True).json(path)
    return docs.select("seq", F.explode("rows").alias("r")).select("seq", "r.*")


def read_arrays(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of ``.npz`` files: entry i of each named array; ``columns`` gives names and kinds (``double``, ``bigint``, ``array<double>``)."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for place, content in zip(part["path"], part["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    out = {"path": place} | {c: [v.tolist() for v in held[c]] if t.startswith("array") else held[c] for c, t in columns.items()}
                yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def read_text_figures(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """``path`` and one array of figures a pattern (its first group, every match in order) of whole text logs."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", *[F.transform(F.regexp_extract_all("value", F.lit(p), F.lit(1)), lambda v: v.try_cast("double")).alias(n) for n, p in patterns.items()])


def read_results(spark: SparkSession, path: str, defaults: dict[str, object]) -> DataFrame:
    """One row a result document: nested ``config`` beside the figures, defaults for what is missing; unreadable files left out."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    held = {f.name: F.col(f"`{f.name}`") for f in rows.schema.fields if f.name not in ("config", "_corrupt_record")}
    if "config" in rows.columns and rows.schema["config"].dataType.typeName() == "struct":
        held |= {f.name: F.col(f"config.`{f.name}`") for f in rows.schema["config"].dataType.fields}
    return rows.select(*[F.coalesce(held[c], F.lit(d)).alias(c) if c in held else F.lit(d).alias(c) for c, d in defaults.items()])


def new_lines(now: DataFrame, before: DataFrame) -> DataFrame:
    """Lines of a snapshot that an earlier one did not hold; repeats count."""
    return now.exceptAll(before)


def write_positions(p: DataFrame, path: str) -> None:
    """Positions as CSV: a row for every person with a position (repeats of an id too)."""
    p.where(F.col("x").isNotNull()).select("frame", "id", "team", "jersey", "role", "x", "y").write.mode("overwrite").option("header", True).csv(path)


def write_players(summary: DataFrame, path: str) -> None:
    """Player summaries as CSV with the fixed ten columns."""
    summary.select(*PLAYER_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_boxes_until(boxes: DataFrame, frame: int, path: str) -> None:
    """The boxes of the first frames as lines of a boxes file."""
    from kinefold.sources.recordings import box_lines

    box_lines(boxes.where(F.col("frame") <= frame)).write.mode("overwrite").text(path)


def prediction_documents(predictions: DataFrame) -> DataFrame:
    """``seq, document``: one JSON document a clip with its predictions in order of frame and track."""
    each = F.struct("frame", "track", *[c for c in predictions.columns if c not in ("seq", "frame", "track")])
    return predictions.groupBy("seq").agg(F.to_json(F.struct(F.array_sort(F.collect_list(each)).alias("predictions")), {"ignoreNullFields": "false"}).alias("document"))


def live_lines(answers: DataFrame) -> DataFrame:
    """``delay, frame, value``: a frame's answers as one compact JSON line, positions with two decimals."""
    person = F.struct("id", "role", "team", "jersey", F.array(F.round("x", 2), F.round("y", 2)).alias("xy"))
    people = answers.groupBy("match_id", "delay", "frame").agg(F.array_sort(F.collect_list(person)).alias("people"))
    return people.select("match_id", "delay", "frame", F.to_json(F.struct("frame", "delay", "people"), {"ignoreNullFields": "false"}).alias("value"))


def write_live(answers: DataFrame, path: str, checkpoint: str):
    """The live lines of a stream, a folder a delay: every micro-batch is appended once."""

    def append(batch: DataFrame, _: int) -> None:
        live_lines(batch).select("delay", "value").write.mode("append").partitionBy("delay").text(path)

    return answers.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def newest_only(lines: DataFrame, delay: int) -> DataFrame:
    """What a slow subscriber of one delay gets: the newest frame of each recording."""
    return lines.where(F.col("delay") == delay).groupBy("match_id").agg(F.max_by("value", "frame").alias("value"), F.max("frame").alias("frame"))


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels with tabs between columns."""
    labels.write.mode("overwrite").option("sep", "\t").csv(path)


def without(rows: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """The table without some recordings (write it over the old one to delete them)."""
    return rows.where(~F.coalesce(F.col(key).isin(ids), F.lit(False)))
