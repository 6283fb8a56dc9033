"""Queries on files: the driver's tables written in every input and output shape, read back, and held against the tables.

Files go to a new folder below the shared folder that the cluster names, as every intermediate table does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text as tx
from ..operators import graph, rules
from ..operators.checkpoint import shared
from ..sources import readers, sinks
from ..sources.readers import table
from . import views
from .registry import query


def place(spark, name: str) -> str:
    return f"{shared(spark)}/hullscope/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str, **options: str) -> str:
    """The one string column of rows as a text file set; its path."""
    path = place(rows.sparkSession, name)
    rows.write.options(**options).text(path)
    return path


def orders(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").cast("double").alias("p"))


O = "(SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, CAST(o_totalprice AS DOUBLE) AS p FROM orders)"  # noqa: E741
_REF = "CASE k % 4 WHEN 0 THEN 'user' || c || '/app:v' || k WHEN 1 THEN 'tool' || k || ':latest' ELSE 'ns' || c || '/repo' || k || ':latest' END"


@query("file_target_lines", f"SELECT {_REF} AS image, CASE WHEN k % 4 = 3 THEN 0.0E0 ELSE p END AS weight FROM {O}")
def target_lines(s, d):
    """Target lists as JSON lines, with comments, blank lines, full references and split ones."""
    o = orders(s, d)
    doc = F.when(F.col("k") % 4 == 0, F.to_json(F.struct(F.concat(F.lit("user"), F.col("c"), F.lit("/app:v"), F.col("k")).alias("image"), F.col("p").alias("weight")))).when(
        F.col("k") % 4 == 1, F.to_json(F.struct(F.lit("library").alias("repository_namespace"), F.concat(F.lit("tool"), F.col("k")).alias("repository_name"), F.col("p").alias("weights")))
    ).otherwise(F.to_json(F.struct(F.concat(F.lit("ns"), F.col("c")).alias("repository_namespace"), F.concat(F.lit("repo"), F.col("k")).alias("repository_name"), F.lit("latest").alias("tag_name"), F.when(F.col("k") % 4 == 2, F.col("p")).alias("weight"))))
    path = staged(o.select(F.concat(F.when(F.col("k") % 5 == 0, F.lit("# a comment\n\n  ")).otherwise(""), doc).alias("value")), "targets")
    return readers.checked_lines(s, path)


@query("file_target_csv", f"SELECT 'img' || k || CASE WHEN k % 2 = 0 THEN ':latest' ELSE ':v1' END AS image, CASE WHEN k % 3 = 0 THEN NULL ELSE '10.0.0.' || (k % 250) END AS ip FROM {O} WHERE k % 7 > 1")
def target_csv(s, d):
    o, path = orders(s, d), place(s, "targets")
    name = F.concat(F.when(F.col("k") % 7 == 1, "#").otherwise(""), F.lit("img"), F.col("k"), F.when(F.col("k") % 2 == 0, "").otherwise(":v1"))
    sinks.csv_metrics(o.select(F.when(F.col("k") % 7 == 0, "").otherwise(name).alias("Image"), F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit(" 10.0.0."), F.col("k") % 250)).alias("IP"), "st"), path, ["Image", "Other", "IP"])
    return readers.csv_targets(s, path)


@query("file_list_filter", f"SELECT k FROM {O} WHERE c IN (SELECT c FROM {O} WHERE k % 11 = 0)")
def list_filter(s, d):
    path = staged(orders(s, d).where("k % 11 = 0").select(F.concat(F.col("c"), F.when(F.col("k") % 2 == 0, "  # why").otherwise("")).alias("value")).unionAll(s.createDataFrame([("# only a comment",), ("",)], "value string")), "list")
    return readers.in_lines(orders(s, d).withColumn("c", F.col("c").cast("string")), readers.listed(s, path), "c").select("k")


@query("file_gzip_tsv", f"SELECT CAST(k AS VARCHAR) AS k, CASE WHEN k % 5 = 0 THEN '' ELSE st END AS st, CAST(c AS VARCHAR) AS c FROM {O}")
def gzip_tsv(s, d):
    """Tab-separated, compressed; a second write with resume leaves the first alone; missing fields read as empty."""
    path = place(s, "tsv")
    sinks.gzip_tsv(orders(s, d).select("k", F.when(F.col("k") % 5 != 0, F.col("st")).alias("st"), "c"), path)
    sinks.gzip_tsv(orders(s, d).limit(1).select("k", "st", "c"), path)
    return readers.tsv(s, path, "k string, st string, c string")


@query("file_tsv_json", "SELECT l_orderkey AS id, count(*) AS n, min(l_partkey) AS least FROM lineitem GROUP BY 1")
def tsv_json(s, d):
    """'number TAB JSON list' lines, with lines that have no number between them."""
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.col("l_partkey").cast("string"))).alias("v"))
    path = staged(rows.select(F.concat(F.when(F.col("l_orderkey") % 9 == 0, F.lit("header\t[]\n")).otherwise(""), F.col("l_orderkey"), F.lit("\t"), "v").alias("value")), "tails", compression="gzip")
    return readers.tsv_json(s, path).select("id", F.size("images").cast("bigint").alias("n"), F.array_min(F.transform("images", lambda x: x.cast("bigint"))).alias("least"))


@query("file_json_lines", f"SELECT k, st FROM {O} WHERE k % 6 <> 0")
def json_lines(s, d):
    path = staged(orders(s, d).select(F.when(F.col("k") % 6 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("k", "st"))).alias("value")), "lines")
    return readers.json_lines(s, path, "k bigint, st string")


@query("file_reports", "SELECT 'slug' || l_suppkey AS slug, count(*) AS findings, count(*) FILTER (l_linenumber = 1) AS high FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1")
def reports(s, d):
    """A folder for each target with a report in it: written by target, read as a document tree; broken documents are left out."""
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.when(F.col("l_linenumber") == 1, "high").otherwise("low").alias("severity"))).alias("findings"))).alias("doc"))
    path = place(s, "reports")
    sinks.per_target(rows.select(F.concat(F.lit("slug"), "k").alias("slug"), F.when(F.col("k") % 5 == 0, F.lit("{broken")).otherwise(F.col("doc")).alias("doc")), path, "slug")
    found = readers.documents(s, path, "*.json").select(F.regexp_replace("slug", "^slug=", "").alias("slug"), F.get_json_object("doc", "$.doc").alias("report_json"))
    own = readers.stored_reports(found.withColumnRenamed("slug", "image"), "findings array<struct<severity:string>>")
    return own.select(F.col("image").alias("slug"), F.size("r.findings").cast("bigint").alias("findings"), F.size(F.filter("r.findings", lambda f: f["severity"] == "high")).cast("bigint").alias("high"))


@query("file_xml_results", f"SELECT k, 'name ' || c AS name, p AS severity FROM {O}")
def xml_results(s, d):
    """Reports of many results each, one a file."""
    result = F.concat(F.lit("<result><k>"), "k", F.lit("</k><name>name "), "c", F.lit("</name><severity>"), F.col("p").cast("string"), F.lit("</severity></result>"))
    rows = orders(s, d).groupBy(F.floor(F.col("k") / 1000)).agg(F.concat(F.lit("<report>"), F.array_join(F.collect_list(result), ""), F.lit("</report>")).alias("value")).select("value")
    return readers.xml_results(s, staged(rows, "xml", maxRecordsPerFile="1"), "k bigint, name string, severity double").select("k", "name", "severity")


@query("file_upsert", f"SELECT k, CASE WHEN k % 3 = 0 THEN 'new' ELSE st END AS st FROM {O} UNION ALL SELECT -k - 1, 'added' FROM {O} WHERE k % 3 = 0")
def upsert(s, d):
    """The next version of a keyed table: of a key's new rows the last counts."""
    o, path = orders(s, d).select("k", "st"), place(s, "keyed")
    o.write.parquet(path)
    new = o.where("k % 3 = 0").select("k", F.explode(F.array(F.struct(F.lit("old").alias("st"), F.lit(1).alias("seq")), F.struct(F.lit("new").alias("st"), F.lit(2).alias("seq")))).alias("x")).select("k", "x.st", "x.seq")
    return sinks.upsert(s, path, new.unionByName(o.where("k % 3 = 0").select((-F.col("k") - 1).alias("k"), F.lit("added").alias("st"), F.lit(1).alias("seq"))), ["k"])


@query("file_snapshot", f"SELECT st, count(*) AS n FROM {O} GROUP BY 1")
def snapshot(s, d):
    """A copy before a change: a second one does not replace the first."""
    path = place(s, "snapshot")
    sinks.snapshot(orders(s, d), path)
    sinks.snapshot(orders(s, d).limit(1), path)
    rows = readers.json_lines(s, path, "st string", "fail").groupBy("st").agg(F.count(F.lit(1)).alias("n"))
    artefact = place(s, "artefact")
    sinks.json_artefact(rows, artefact)
    return readers.json_lines(s, artefact, "st string, n bigint", "fail")


@query("host_files", "SELECT l_suppkey AS slug, min(CASE WHEN l_quantity > 10 THEN CASE l_linenumber WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 100 + l_linenumber END END) AS host FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 10) > 0")
def host_files(s, d):
    """Of a target's files with content the one of the most preferred host."""
    rows = table(s, d, "lineitem").select(F.concat(F.lit("h"), "l_linenumber").alias("host"), F.col("l_suppkey").alias("slug"), F.when(F.col("l_quantity") > 10, "x").otherwise("").alias("doc")).distinct()
    best = readers.best_host(rows, ["h2", "h1"])
    return best.select("slug", F.when(F.col("host") == "h2", 0).when(F.col("host") == "h1", 1).otherwise(F.substring("host", 2, 9).cast("int") + 100).cast("bigint").alias("host"))


@query("layer_nodes", """WITH l AS (SELECT l_orderkey AS image, 'x' || (l_partkey % 50) AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
 SELECT id, count(DISTINCT CASE WHEN i = n THEN image END) AS tops FROM l GROUP BY id""")
def layer_nodes(s, d):
    """Distinct nodes of layer lists, with how many images end at each."""
    images = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    nodes, _, _ = graph.chain(images, F.transform("l", lambda x: F.concat(F.lit("x"), x["l_partkey"] % 50)))
    return nodes.select("id", F.size("images").cast("bigint").alias("tops"))


@query("image_names", f"SELECT k, CASE WHEN k % 3 = 0 THEN 'r' || c || ':latest' WHEN k % 3 = 1 THEN 'a/r' || c || ':v' || k ELSE 'h:5000/r' || c || '@sha256:0' END AS image FROM {O}")
def image_names(s, d):
    o = orders(s, d)
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" r"), "c")).when(F.col("k") % 3 == 1, F.concat(F.lit("a/r"), "c", F.lit(":v"), "k")).otherwise(F.concat(F.lit("h:5000/r"), "c", F.lit("@sha256:0")))
    return o.select("k", tx.normal_image(raw).alias("image"))


@query("port_lists", f"SELECT k, CASE WHEN k % 4 = 3 THEN '' WHEN k % 4 = 2 THEN c || ',' || k ELSE c || '/tcp' END AS ports FROM {O}")
def port_lists(s, d):
    k, c = F.col("k").cast("string"), F.col("c").cast("string")
    i = F.when(F.col("k") % 4 == 0, F.concat(F.lit("EXPOSE map["), c, F.lit("/tcp:{}]"))).when(F.col("k") % 4 == 1, F.concat(F.lit("EXPOSE ["), c, F.lit("/tcp]"))).when(F.col("k") % 4 == 2, F.concat(F.lit("EXPOSE "), c, F.lit(" "), k)).otherwise(F.concat(F.lit("RUN sleep "), c))
    return orders(s, d).select("k", F.array_join(tx.exposed_ports(i), ",").alias("ports"))


@query("osv_scores", f"SELECT k, CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'critical' ELSE 'unknown' END AS severity, CASE k % 4 WHEN 0 THEN 7.4E0 WHEN 2 THEN 9.8E0 END AS score FROM {O}")
def osv_scores(s, d):
    """A vector or a number decides, else the database's word; a CVSS 4 vector gets its coarse score."""
    entry = lambda v: F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit(v).alias("score")))
    own = F.when(F.col("k") % 4 == 0, entry("CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N")).when(F.col("k") % 4 == 2, entry("CVSS:4.0/AV:N/AC:L/VC:H/VI:N/VA:N")).otherwise(F.array().cast("array<struct<type:string,score:string>>"))
    return orders(s, d).select("k", own.alias("e"), F.when(F.col("k") % 4 == 1, "MODERATE").alias("w")).select("k", sev.osv_severity(F.col("e"), F.col("w")).alias("severity"), sev.osv_best(F.col("e")).alias("score"))


@query("config_checks", f"""SELECT k, CASE k % 5 WHEN 0 THEN 'mongo' WHEN 1 THEN 'redis' WHEN 2 THEN 'nginx' WHEN 3 THEN 'elasticsearch' ELSE 'mosquitto' END AS app,
 CASE k % 5 WHEN 0 THEN 'no-authentication,binds-all-interfaces:critical' WHEN 1 THEN CASE WHEN c % 2 = 0 THEN 'no-authentication' ELSE '' END WHEN 2 THEN 'directory-traversal' WHEN 3 THEN '' ELSE CASE WHEN c % 2 = 0 THEN 'no-authentication' ELSE '' END END AS issues FROM {O}""")
def config_checks(s, d):
    """Configuration files by path and what is wrong in them."""
    k = F.col("k") % 5
    even = F.col("c") % 2 == 0
    path = F.when(k == 0, "/etc/mongodb.conf").when(k == 1, "/etc/redis.conf").when(k == 2, "/etc/nginx.conf").when(k == 3, "/etc/elasticsearch.yml").otherwise("/etc/mosquitto.conf")
    body = F.when(k == 0, "net:\n  bindIp: 0.0.0.0\n#authorization: enabled").when((k == 1) & even, "port 6379").when(k == 1, "requirepass secret").when(k == 2, "location / {\n autoindex on;\n}").when(k == 3, "cluster.name: x").when(even, "allow_anonymous true").otherwise("listener 1883")
    own = orders(s, d).select("k", rules.config_app(path).alias("app"), body.alias("body"))
    label = lambda x: F.when(x["severity"] == "critical", F.concat(x["issue"], F.lit(":critical"))).otherwise(x["issue"])
    return own.select("k", "app", F.array_join(F.transform(rules.config_issues(F.col("app"), F.col("body")), label), ",").alias("issues"))


@query("run_commands", f"SELECT k, CASE WHEN k % 2 = 0 THEN 'docker run -d app' || c ELSE '' END AS command FROM {O}")
def run_commands(s, d):
    text = F.concat(F.lit("Use it:\n"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("docker run -d app"), F.col("c").cast("string"))).otherwise("no command"), F.lit("\nEnd"))
    return orders(s, d).select("k", F.array_join(rules.run_commands(text), ";").alias("command"))


@query("wide_integers", f"SELECT k, CAST(c AS BIGINT) * 4294967296 + k AS id FROM {O}")
def wide_integers(s, d):
    return orders(s, d).select("k", tx.wide_integer(F.struct(F.col("c").alias("high"), F.col("k").alias("low"))).alias("id"))


@query("instants", "SELECT o_orderkey AS k, epoch(o_orderdate) AS seconds FROM orders")
def instants(s, d):
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(day, F.lit("Z"))).when(k == 1, F.concat(day, F.lit("+00:00"))).when(k == 2, day).otherwise(F.concat(F.lit('{"$date": "'), day, F.lit('Z"}')))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.unix_timestamp(tx.instant(raw)).cast("double").alias("seconds"))


@query("digest_forms", "SELECT digest <> '' AS legal, count(*) AS n FROM {images} GROUP BY 1")
def digest_forms(s, d):
    """Whole digests against cut ones."""
    own = F.when(F.col("digest") == "", F.lit("sha256:short")).otherwise(F.concat(F.lit("sha256:"), "digest", "digest"))
    return views.images(s, d).groupBy(tx.legal_digest(own).alias("legal")).agg(F.count(F.lit(1)).alias("n"))
