"""Readers and writers: recordings, catalogs, boxes, tables, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERSON = "struct<id bigint, role string, team string, jersey string, box array<double>, xy array<double>>"
LINE = (f"frame bigint, delay int, people array<{PERSON}>, ball struct<box array<double>, xy array<double>>, colors struct<left string, right string>")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, raw``: text lines in file order, blank ones skipped.

    ``line_no`` grows with the place in the file, but is not dense: files are read in splits.
    """
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))
    return rows.where(F.length(F.trim("raw")) > 0)


def parse_recordings(lines: DataFrame, match_id=None) -> DataFrame:
    """Recording lines of the frames table from raw JSON lines; lines that are no object or have no frame are left out.

    The match is the name of the file's folder unless given as a column.
    """
    folder = F.element_at(F.split("path", "/"), -2) if match_id is None else match_id
    return lines.select(folder.alias("match_id"), "line_no", F.from_json("raw", LINE).alias("l")).where("l.frame is not null").select("match_id", "line_no", "l.*")


def line_errors(lines: DataFrame) -> DataFrame:
    """``path, line_no, error``: the first error of every file, by the order of the checks.

    A line must be a JSON object with an integer frame and a list of people, and frames must
    rise strictly.  The order test runs over the valid frame numbers of a file (one window).
    """
    v = F.try_parse_json("raw")
    kind = lambda p: F.try_variant_get(v, p, "string")
    parsed = lines.select("path", "line_no", "raw", v.isNotNull().alias("json"), F.schema_of_variant(v).alias("shape"), F.schema_of_variant(F.try_variant_get(v, "$.frame", "variant")).alias("fs"),
                          F.schema_of_variant(F.try_variant_get(v, "$.people", "variant")).alias("ps"), kind("$.frame").try_cast("bigint").alias("frame"))
    w = Window.partitionBy("path").orderBy("line_no")
    before = F.max("frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    error = (F.when(~F.col("json"), "not JSON").when(~F.col("shape").startswith("OBJECT"), "not an object").when(F.coalesce(F.col("fs") != "BIGINT", F.lit(True)), "frame is no integer")
             .when(F.coalesce(~F.col("ps").startswith("ARRAY"), F.lit(True)), "people is no list").when(F.col("frame") <= before, "frames do not rise"))
    return parsed.withColumn("error", error).where("error is not null").groupBy("path").agg(F.min(F.struct("line_no", "error")).alias("e")).select("path", "e.line_no", "e.error")


def content_id(raw) -> object:
    """Identity of a recording by its content."""
    return F.concat(F.lit("m_"), F.substring(F.sha2(raw, 256), 1, 10))


def new_only(incoming: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the catalog does not hold yet, once each."""
    return incoming.dropDuplicates([key]).join(catalog.select(key), key, "left_anti")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``frame, id, box`` of a box file (frame, id, x, y, width, height, conf, ...)."""
    rows = spark.read.csv(path, schema="frame bigint, id bigint, x double, y double, w double, h double, conf double, cls string, vis double")
    return rows.where("frame is not null and h is not null").select("frame", "id", F.array("x", "y", "w", "h").alias("box"), "conf")


def box_lines(boxes: DataFrame) -> DataFrame:
    """``value``: lines of a box file with two decimals."""
    g = lambda i: F.get("box", F.lit(i))
    return boxes.select(F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,1,-1,-1", "frame", "id", g(0), g(1), g(2), g(3)).alias("value"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """``path, section`` (a map): key = value pairs of small text files."""
    pair = spark.read.text(path).select(F.input_file_name().alias("path"), F.regexp_extract("value", r"^\s*([^=\[#;]+?)\s*=\s*(.*?)\s*$", 1).alias("k"), F.regexp_extract("value", r"^\s*([^=\[#;]+?)\s*=\s*(.*?)\s*$", 2).alias("v"))
    return pair.where("k <> ''").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("section"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``name, value``: samples of a metrics text, summed over label sets."""
    m = r"^([A-Za-z_:][\w:]*)(\{[^}]*\})?\s+(\S+)"
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.regexp_extract("value", m, 1).alias("name"), F.regexp_extract("value", m, 3).try_cast("double").alias("v"))
    return rows.where("name <> '' and v is not null").groupBy("name").agg(F.sum("v").alias("value"))


def metric_lines(samples: DataFrame) -> DataFrame:
    """``value``: metrics text lines of ``name, labels (map), kind, amount, at``; counters are summed, gauges keep the last."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    rows = samples.withColumn("_l", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""))
    amount = F.when(F.col("kind") == "counter", F.col("s")).otherwise(F.col("l"))
    return rows.groupBy("name", "_l", "kind").agg(F.sum("amount").alias("s"), F.max_by("amount", "at").alias("l")).select(F.concat_ws(" ", F.concat("name", "_l"), amount.cast("string")).alias("value"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and new rows by key, the new one where both have it (a union and one window)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new")))).where("_k = 1").drop("_k", "_new")


def patched(old: DataFrame, change: DataFrame, key: list[str]) -> DataFrame:
    """Old rows with the non-null fields of the change; new keys are added."""
    fields = [c for c in old.columns if c not in key]
    o, n = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in fields]), change.select(*key, *[F.col(c).alias(f"_n_{c}") for c in fields])
    return o.join(n, key, "full").select(*key, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in fields])


def resolve_aliases(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``id, root``: every id of ``id, alias_of`` with the end of its chain; null root marks a cycle.

    Pointer doubling: each round halves what is left of a chain, so long chains take few
    joins; every few rounds the lineage is cut in the shared folder.
    """
    from kinefold.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(links.sparkSession)
    now = links.where("alias_of is not null").select("id", F.col("alias_of").alias("next")).checkpoint()
    ends = links.where("alias_of is null").select("id", F.col("id").alias("root"))
    size = now.count()
    for _ in range(min(rounds, max(1, size.bit_length() + 1))):
        step = now.select(F.col("id").alias("next"), F.col("next").alias("_after"))
        now = now.join(step, "next", "left").select("id", F.coalesce("_after", "next").alias("next")).checkpoint()
    stuck = now.join(links.where("alias_of is not null").select(F.col("id").alias("next")), "next", "left_semi").select("id")
    good = now.join(stuck, "id", "left_anti").select("id", F.col("next").alias("root"))
    return ends.unionByName(good).unionByName(stuck.select("id", F.lit(None).cast(links.schema["id"].dataType).alias("root")))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """``n, value``: lines of a Markdown table of a small report."""
    head = [" | ".join(columns), " | ".join("---" for _ in columns)]
    body = rows.select(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"), F.row_number().over(Window.orderBy(*order)).alias("n"))
    top = rows.sparkSession.createDataFrame([(i - 1, t) for i, t in enumerate(head)], "n int, value string")
    return top.unionByName(body.select("n", "value")).select("n", F.concat(F.lit("| "), "value", F.lit(" |")).alias("value"))
