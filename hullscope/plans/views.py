"""Domain tables derived from the driver's tables, as DataFrames and as the same SQL.

findings: lineitem as scanner findings of 2,000 images; images: orders as scanned images with ranking values; jobs: orders as
a work queue; edges: part as a layer forest; events as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

SQL = {
    "findings": """SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 2000 AS image, CASE l_suppkey % 3 WHEN 0 THEN 'trivy' WHEN 1 THEN 'grype' ELSE 'osv' END AS scanner,
 CASE WHEN l_linenumber <= 4 THEN 'pkg-vuln' WHEN l_linenumber = 5 THEN 'secret' WHEN l_linenumber = 6 THEN 'image-config' ELSE 'sbom-component' END AS category,
 CASE CAST(round(l_discount * 100) AS INTEGER) % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'unknown' END AS severity,
 CASE WHEN l_linenumber = 1 THEN 'GHSA-' ELSE 'CVE-' END || CAST(2010 + l_partkey % 15 AS VARCHAR) || '-' || CAST(1000 + l_partkey % 50 AS VARCHAR) AS id, 'lib/' || replace(p_name, ' ', '-') || '@1.' || CAST(l_linenumber AS VARCHAR) AS package,
 CASE p_type WHEN 'STANDARD' THEN 'deb' WHEN 'MEDIUM' THEN 'apk' WHEN 'PROMO' THEN 'npm' WHEN 'LARGE' THEN 'go-module' WHEN 'SMALL' THEN 'PyPI' ELSE '' END AS ecosystem,
 CASE WHEN l_tax < 0.02 THEN 'private key' ELSE p_brand END AS title, l_quantity AS cvss FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "images": """SELECT o_orderkey AS image, CASE WHEN o_custkey % 10 = 0 THEN '' WHEN o_custkey % 10 = 1 THEN 'Library' ELSE 'ns' || CAST(o_custkey % 40 AS VARCHAR) END AS ns, 'repo' || CAST(o_custkey AS VARCHAR) AS repo,
 CASE WHEN o_orderkey % 5 = 0 THEN 'latest' WHEN o_orderkey % 97 = 0 THEN 'sha256-' || repeat('0', 64) || '.sig' ELSE 'v' || CAST(o_orderkey % 7 AS VARCHAR) END AS tag,
 CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE md5(CAST(o_orderkey % 9000 AS VARCHAR)) END AS digest, CAST(round(o_totalprice) AS BIGINT) AS pull, CAST(round(o_totalprice) AS BIGINT) + o_custkey AS exposure,
 o_custkey % 50 AS dependency_weight, o_custkey AS downstream, o_orderstatus AS status, o_orderdate AS updated FROM orders""",
    "jobs": """SELECT o_orderkey AS id, 'img' || CAST(o_orderkey AS VARCHAR) AS image, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'running' END AS status, round(o_totalprice / 1000) AS weight, CAST(o_orderkey % 4 AS INTEGER) AS attempts,
 CAST(o_custkey AS DOUBLE) AS started_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey + 10 AS DOUBLE) END AS heartbeat_at FROM orders""",
    "edges": "SELECT p_partkey AS seq, (p_partkey - 1) // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey - 100000, (p_partkey - 1) // 2, p_partkey FROM part WHERE p_partkey > 0 AND p_partkey % 11 = 0",
    "refs": "SELECT p_partkey AS node, CAST(p_retailprice * 10 AS BIGINT) % 1000 + CASE WHEN p_partkey < 40 THEN 700 ELSE 0 END AS pull, p_size % 3 AS pos, 'ns' || CAST(p_partkey % 50 AS VARCHAR) AS ns, 'r' || CAST(p_partkey % 700 AS VARCHAR) AS repo, CASE WHEN p_size % 4 = 0 THEN 'latest' ELSE 'v' || CAST(p_size AS VARCHAR) END AS tag, md5(CAST(p_partkey AS VARCHAR)) AS digest FROM part WHERE p_size % 5 <> 0",
}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_quantity", "l_tax")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    pick = lambda c, names: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    kind = F.col("p_type")
    eco = F.when(kind == "STANDARD", "deb").when(kind == "MEDIUM", "apk").when(kind == "PROMO", "npm").when(kind == "LARGE", "go-module").when(kind == "SMALL", "PyPI").otherwise("")
    return rows.select(
        (F.col("l_orderkey") * 10 + n).alias("seq"), (F.col("l_orderkey") % 2000).alias("image"), pick(F.col("l_suppkey") % 3, ["trivy", "grype", "osv"]).alias("scanner"),
        F.when(n <= 4, "pkg-vuln").when(n == 5, "secret").when(n == 6, "image-config").otherwise("sbom-component").alias("category"),
        pick(F.round(F.col("l_discount") * 100).cast("int") % 6, ["critical", "high", "medium", "low", "info", "unknown"]).alias("severity"),
        F.concat(F.when(n == 1, "GHSA-").otherwise("CVE-"), (2010 + F.col("l_partkey") % 15).cast("string"), F.lit("-"), (1000 + F.col("l_partkey") % 50).cast("string")).alias("id"),
        F.concat(F.lit("lib/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@1."), n.cast("string")).alias("package"), eco.alias("ecosystem"), F.when(F.col("l_tax") < 0.02, "private key").otherwise(F.col("p_brand")).alias("title"), F.col("l_quantity").alias("cvss"),
    ).withColumn("cves", F.array().cast("array<string>"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cust, key, pull = F.col("o_custkey"), F.col("o_orderkey"), F.round("o_totalprice").cast("bigint")
    return o.select(
        key.alias("image"), F.when(cust % 10 == 0, "").when(cust % 10 == 1, "Library").otherwise(F.concat(F.lit("ns"), (cust % 40).cast("string"))).alias("ns"), F.concat(F.lit("repo"), cust.cast("string")).alias("repo"),
        F.when(key % 5 == 0, "latest").when(key % 97 == 0, F.concat(F.lit("sha256-"), F.repeat(F.lit("0"), 64), F.lit(".sig"))).otherwise(F.concat(F.lit("v"), (key % 7).cast("string"))).alias("tag"),
        F.when(key % 13 == 0, "").otherwise(F.md5((key % 9000).cast("string"))).alias("digest"), pull.alias("pull"), (pull + cust).alias("exposure"), (cust % 50).alias("dependency_weight"), cust.alias("downstream"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return o.select(
        key.alias("id"), F.concat(F.lit("img"), key.cast("string")).alias("image"), F.when(status == "O", "pending").when(status == "F", "done").otherwise("running").alias("status"), F.round(F.col("o_totalprice") / 1000).alias("weight"), (key % 4).cast("int").alias("attempts"),
        F.col("o_custkey").cast("double").alias("started_at"), F.when(key % 3 != 0, (F.col("o_custkey") + 10).cast("double")).alias("heartbeat_at"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heap tree with three children a node; every eleventh node has an earlier second parent, which the later edge overrides."""
    p = table(spark, sf_dir, "part").select("p_partkey").where("p_partkey > 0")
    k = F.col("p_partkey")
    first = p.select(k.alias("seq"), F.floor((k - 1) / 3).alias("parent"), k.alias("child"))
    return first.unionByName(p.where(k % 11 == 0).select((k - 100000).alias("seq"), F.floor((k - 1) / 2).alias("parent"), k.alias("child")))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_size") % 5 != 0)
    k = F.col("p_partkey")
    return p.select(
        k.alias("node"), ((F.col("p_retailprice") * 10).cast("bigint") % 1000 + F.when(k < 40, 700).otherwise(0)).alias("pull"), (F.col("p_size") % 3).alias("pos"), F.concat(F.lit("ns"), (k % 50).cast("string")).alias("ns"), F.concat(F.lit("r"), (k % 700).cast("string")).alias("repo"),
        F.when(F.col("p_size") % 4 == 0, "latest").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("tag"), F.md5(k.cast("string")).alias("digest"),
    )
