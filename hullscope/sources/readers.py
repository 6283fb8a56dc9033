"""Readers for the input shapes: JSON lines, TSV with and without JSON tails, CSV, plain lists, document trees, XML, line sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled, normal_image


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, n: int) -> DataFrame:
    """Any n rows: for a look, not for statistics."""
    return df.limit(n)


def json_lines(spark: SparkSession, path: str | list[str], schema: str, bad: str = "skip") -> DataFrame:
    """bad: 'skip' leaves unreadable lines out, 'fail' ends with the first one."""
    return spark.read.schema(schema).option("mode", {"skip": "DROPMALFORMED", "fail": "FAILFAST"}[bad]).json(path)


def checked_lines(spark: SparkSession, path: str) -> DataFrame:
    """Target list as JSON lines: '#' lines and blank ones are comments; a row names its image, or repository and tag. A line that isn't JSON ends the read with its text."""
    raw = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' AND NOT startswith(value, '#')")
    ok = F.try_parse_json("value").isNotNull() | (F.col("value") == "") | F.col("value").startswith("#")  # the filter may run later
    own = raw.select(F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), "value"))).alias("value"))
    d = own.select(F.from_json("value", "image string, repository_namespace string, repository_name string, tag_name string, weights double, weight double").alias("d")).select("d.*")
    ns = F.when(F.coalesce("repository_namespace", F.lit("")).isin("", "library"), F.lit("")).otherwise(F.concat("repository_namespace", F.lit("/")))
    image = F.coalesce(F.nullif("image", F.lit("")), F.concat(ns, "repository_name", F.lit(":"), filled(F.col("tag_name"), "latest")))
    return d.select(normal_image(image).alias("image"), F.coalesce("weight", "weights", F.lit(0.0)).alias("weight")).where("image IS NOT NULL")


def tsv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Tab-separated, gzip too; short rows are filled with ''. A gzip file is one split: repartition after reading where it is large."""
    df = spark.read.option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").schema(ddl).csv(path)
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def tsv_json(spark: SparkSession, path: str, key: str = "id", value: str = "images") -> DataFrame:
    """'<number>TAB["...", ...]' lines."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].try_cast("bigint").alias(key), F.from_json(parts[1], "array<string>").alias(value)).where(F.col(key).isNotNull())


def csv_targets(spark: SparkSession, path: str, image: str = "Image", ip: str = "IP") -> DataFrame:
    """Target list as CSV with a header; rows without an image and '#' rows are left out; a missing column is an error."""
    df = spark.read.option("header", True).csv(path)
    if image not in df.columns:
        raise ValueError(f"no column {image}: {df.columns}")
    rows = df.where(F.coalesce(F.trim(image), F.lit("")) != "").where(~F.trim(image).startswith("#"))
    return rows.select(normal_image(F.col(image)).alias("image"), (F.nullif(F.trim(ip), F.lit("")) if ip in df.columns else F.lit(None).cast("string")).alias("ip"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """A plain list: what follows '#' is a comment."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("value")).where("value <> ''")


def in_lines(df: DataFrame, lines: DataFrame, column: str) -> DataFrame:
    """Rows whose column is one of the lines; a null isn't."""
    return df.join(lines.select(F.col("value").alias(column)).distinct(), column, "left_semi")


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files below a folder: (path, slug: the file's folder, doc)."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return df.select(F.input_file_name().alias("path"), F.element_at(F.split(F.input_file_name(), "/"), -2).alias("slug"), F.col("value").alias("doc"))


def reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports stored one file each; documents that don't parse are left out."""
    return documents(spark, path, "report.json").where(F.try_parse_json("doc").isNotNull()).select("slug", F.from_json("doc", schema).alias("r")).select("slug", "r.*")


def stored_reports(df: DataFrame, schema: str, max_bytes: int = 256 << 20) -> DataFrame:
    """(image, report_json) rows parsed; oversize and broken documents are left out before parsing."""
    return df.where((F.octet_length("report_json") <= max_bytes) & F.try_parse_json("report_json").isNotNull()).select("image", F.from_json("report_json", schema).alias("r"))


def xml_results(spark: SparkSession, path: str, ddl: str, row: str = "result") -> DataFrame:
    return spark.read.option("rowTag", row).schema(ddl).xml(path)


def best_host(files: DataFrame, preference: list[str]) -> DataFrame:
    """Of a slug's (host, slug, doc) rows with content, the one of the most preferred host."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("host"))
    rows = files.where("coalesce(doc, '') <> ''").withColumn("__p", F.when(rank > 0, rank).otherwise(len(preference) + 1))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("slug").orderBy("__p", "host"))).where("__r = 1").drop("__r", "__p")


def bounded_ranges(spark: SparkSession, df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows dealt into contiguous key ranges."""
    return df.repartitionByRange(parts, key)


def query_results(rows: DataFrame, first: str, *others: DataFrame) -> DataFrame:
    """The first source that has rows."""
    for df in (rows, *others):
        if not df.isEmpty():
            return df
    return rows


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Pattern rules of a YAML list of flat mappings, one 'key: value' a line, values plain or quoted: name, regex, severity.

    Configuration, so it is read on the driver; a rule without a name or a pattern is an error.
    """
    import re

    found: list[dict[str, str]] = []
    for (doc,) in spark.read.option("wholetext", True).text(path).collect():
        for line in doc.split("\n"):
            m = re.match(r"\s*(-\s+)?([A-Za-z_]+):\s+(.*?)\s*$", line)
            if not m or line.lstrip().startswith("#"):
                continue
            if m[1]:
                found.append({})
            value = m[3]
            if len(value) > 1 and value[0] == value[-1] == "'":
                value = value[1:-1].replace("''", "'")
            elif len(value) > 1 and value[0] == value[-1] == '"':
                value = value[1:-1].replace('\\"', '"').replace("\\\\", "\\")
            found[-1][m[2]] = value
    for r in found:
        if not r.get("name") or not r.get("regex"):
            raise ValueError(f"a rule needs a name and a pattern: {r}")
    return spark.createDataFrame([(r["name"], r["regex"], r.get("severity", "unknown").lower()) for r in found], "name string, regex string, severity string")
