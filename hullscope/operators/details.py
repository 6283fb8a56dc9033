"""Detail tables of twelve further tools: one projection each over (target, doc), doc being the tool's whole output.

They keep the tools' own columns instead of the findings model. Documents that don't parse give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cves_in, filled


def cut(value: Column, most: int | None = None, default: str = "") -> Column:
    own = F.coalesce(value.cast("string"), F.lit(default))
    return F.substring(own, 1, most) if most else own


def parsed(docs: DataFrame, ddl: str) -> DataFrame:
    return docs.where(F.try_parse_json("doc").isNotNull()).select("target", F.from_json("doc", ddl).alias("d"))


def listed(docs: DataFrame, item: str) -> DataFrame:
    """A document that is an array of items, or one item."""
    rows = docs.where(F.try_parse_json("doc").isNotNull())
    items = F.when(F.ltrim("doc").startswith("["), F.from_json("doc", f"array<{item}>")).otherwise(F.array(F.from_json("doc", item)))
    return rows.select("target", F.explode(items).alias("x")).where("x IS NOT NULL")


def json_lines(docs: DataFrame, ddl: str) -> DataFrame:
    return parsed(docs.select("target", F.explode(F.split("doc", r"\r?\n")).alias("doc")), ddl)


def osv(docs: DataFrame) -> DataFrame:
    v = parsed(docs, "results array<struct<packages:array<struct<package:struct<name:string,version:string,ecosystem:string>,vulnerabilities:array<struct<id:string,aliases:array<string>,summary:string,severity:array<struct<type:string,score:string>>>>>>>>")
    v = v.select("target", F.explode("d.results").alias("r")).select("target", F.explode("r.packages").alias("k")).select("target", "k.package", F.explode("k.vulnerabilities").alias("v"))
    aliases = F.coalesce("v.aliases", F.array().cast("array<string>"))
    cve = F.coalesce(F.try_element_at(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(1)), F.try_element_at(aliases, F.lit(1)), F.col("v.id"), F.lit("?"))
    scores = F.filter(F.transform(F.filter("v.severity", lambda s: s["type"].startswith("CVSS")), lambda s: F.nullif(F.regexp_extract(s["score"], r"(\d+\.\d+)$", 1), F.lit("")).cast("double")), lambda x: x.isNotNull())
    return v.select("target", cve.alias("cve"), cut(F.col("v.id")).alias("id"), cut(F.col("package.name"), default="?").alias("pkg"), cut(F.col("package.version"), default="?").alias("version"), cut(F.col("package.ecosystem"), default="?").alias("ecosystem"), F.substring(F.trim(cut(F.col("v.summary"))), 1, 240).alias("summary"), F.coalesce(F.try_element_at(scores, F.lit(-1)), F.lit(0.0)).alias("cvss"))


def detect_secrets(docs: DataFrame) -> DataFrame:
    rows = parsed(docs, "results map<string,array<struct<type:string,line_number:int,is_verified:boolean>>>").select("target", F.explode("d.results").alias("file", "found")).select("target", "file", F.explode("found").alias("s"))
    return rows.select("target", cut(F.col("file"), 140).alias("file"), cut(F.col("s.type"), default="?").alias("type"), F.coalesce("s.line_number", F.lit(0)).alias("line_number"), F.coalesce("s.is_verified", F.lit(False)).alias("is_verified"))


def checkov(docs: DataFrame) -> DataFrame:
    rows = listed(docs, "struct<check_type:string,results:struct<failed_checks:array<struct<check_id:string,check_name:string,severity:string,file_path:string,resource:string,guideline:string>>>>").select("target", F.col("x.check_type").alias("framework"), F.explode("x.results.failed_checks").alias("c"))
    return rows.select("target", cut(F.col("c.check_id"), default="?").alias("check_id"), cut(F.col("c.check_name"), 120).alias("check_name"), F.upper(filled(F.col("c.severity"), "UNKNOWN")).alias("severity"), cut(F.col("c.file_path"), default="?").alias("file_path"), cut(F.col("c.resource"), default="?").alias("resource"), cut(F.col("framework"), default="?").alias("framework"), cut(F.col("c.guideline")).alias("guideline"))


def arachni(docs: DataFrame) -> DataFrame:
    rows = parsed(docs, "issues array<struct<name:string,severity:string,cwe:string,description:string,vector:struct<url:string,method:string>>>").select("target", F.explode("d.issues").alias("i"))
    return rows.select("target", cut(F.col("i.name"), default="?").alias("name"), F.lower(filled(F.col("i.severity"), "informational")).alias("severity"), cut(F.col("i.cwe")).alias("cwe"), cut(F.col("i.vector.url"), 160).alias("url"), cut(F.col("i.vector.method")).alias("method"), cut(F.col("i.description"), 300).alias("description"))


def yara(docs: DataFrame) -> DataFrame:
    rows = docs.select("target", F.explode(F.split("doc", r"\r?\n")).alias("line")).select("target", F.trim("line").alias("line")).where("line <> '' AND NOT startswith(line, 'Error:')")
    pair = r"^(\S+)\s+(.+)$"
    return rows.where(F.col("line").rlike(pair)).select("target", F.regexp_extract("line", pair, 1).alias("rule"), F.substring(F.regexp_extract("line", pair, 2), 1, 160).alias("path"))


def retire(docs: DataFrame) -> DataFrame:
    rows = listed(docs, "struct<file:string,results:array<struct<component:string,version:string,vulnerabilities:array<struct<severity:string,identifiers:struct<summary:string,CVE:array<string>>>>>>>").select("target", "x.file", F.explode("x.results").alias("r")).select("target", "file", "r.component", "r.version", F.explode("r.vulnerabilities").alias("v"))
    return rows.select("target", cut(F.col("file"), 140, "?").alias("file"), cut(F.col("component"), default="?").alias("component"), cut(F.col("version"), default="?").alias("version"), F.lower(filled(F.col("v.severity"), "low")).alias("severity"), cut(F.col("v.identifiers.summary"), 200).alias("summary"), F.coalesce(F.array_join(F.slice("v.identifiers.CVE", 1, 2), ", "), F.lit("")).alias("cve"))


def testssl(docs: DataFrame) -> DataFrame:
    rows = listed(docs, "struct<id:string,severity:string,finding:string,ip:string,port:string>")
    return rows.select("target", cut(F.col("x.id"), default="?").alias("id"), F.lower(filled(F.col("x.severity"), "info")).alias("severity"), cut(F.col("x.finding"), 240).alias("finding"), cut(F.col("x.ip")).alias("ip"), cut(F.col("x.port")).alias("port"))


def hadolint(docs: DataFrame) -> DataFrame:
    rows = listed(docs, "struct<code:string,level:string,line:int,column:int,message:string>")
    return rows.select("target", cut(F.col("x.code"), default="?").alias("code"), F.lower(filled(F.col("x.level"), "info")).alias("level"), F.coalesce("x.line", F.lit(0)).alias("line"), F.coalesce("x.column", F.lit(0)).alias("column"), cut(F.col("x.message"), 200).alias("message"))


def httpx(docs: DataFrame) -> DataFrame:
    rows = json_lines(docs, "url string, status_code int, title string, webserver string, server string, tech array<string>, tls string, scheme string, content_type string")
    tech = F.coalesce(F.array_join(F.slice("d.tech", 1, 8), ", "), F.lit(""))
    return rows.select("target", cut(F.col("d.url")).alias("url"), F.coalesce("d.status_code", F.lit(0)).alias("status_code"), cut(F.col("d.title"), 120).alias("title"), filled(F.col("d.webserver"), cut(F.col("d.server"))).alias("server"), tech.alias("tech"), F.when(cut(F.col("d.tls")).isin("", "{}", "null", "false"), "no").otherwise("yes").alias("tls_grab"), cut(F.col("d.scheme")).alias("scheme"), cut(F.col("d.content_type")).alias("content_type"))


def whispers(docs: DataFrame) -> DataFrame:
    rows = listed(docs, "struct<key:string,value:string,file:string,line:int,rule_id:string,severity:string>")
    return rows.select("target", cut(F.col("x.key"), default="?").alias("key"), cut(F.col("x.value"), 80).alias("value"), cut(F.col("x.file"), 140, "?").alias("file"), F.coalesce("x.line", F.lit(0)).alias("line"), cut(F.col("x.rule_id")).alias("rule_id"), F.lower(filled(F.col("x.severity"), "info")).alias("severity"))


def jaeles(docs: DataFrame) -> DataFrame:
    rows = parsed(docs, "vuln_url string, sign_id string, info string")
    return rows.select("target", cut(F.col("d.vuln_url")).alias("vuln_url"), cut(F.col("d.sign_id")).alias("sign_id"), cut(F.col("d.info"), 200).alias("info"))


def openvas(docs: DataFrame) -> DataFrame:
    """<result> elements of a report: name, host, port, severity, CVEs; of a report that isn't XML its base64 text is decoded first."""
    xml = F.when(F.ltrim("doc").startswith("<"), F.col("doc")).otherwise(F.coalesce(F.try_to_binary(F.regexp_replace("doc", r"\s+", ""), F.lit("base64")).cast("string"), F.lit("")))
    rows = docs.select("target", F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<result\b.*?</result>"), F.lit(0))).alias("r"))
    tag = lambda name: F.trim(F.regexp_extract("r", rf"(?s)<{name}\b[^>]*>([^<]*)", 1))
    return rows.select("target", tag("name").alias("name"), tag("host").alias("host"), tag("port").alias("port"), F.coalesce(tag("severity").try_cast("double"), F.lit(0.0)).alias("cvss"), cves_in(F.col("r")).alias("cves"))


EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"openvas": openvas, "osv": osv, "detect-secrets": detect_secrets, "checkov": checkov, "arachni": arachni, "yara": yara, "retire": retire, "testssl": testssl, "hadolint": hadolint, "httpx": httpx, "whispers": whispers, "jaeles": jaeles}
