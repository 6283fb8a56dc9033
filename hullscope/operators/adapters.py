"""Scanner outputs to findings: one projection for each tool over (image, name, ip, doc), doc being a whole file's text.

Each parser declares the part of the format that it reads and turns it into rows with ``schemas.FINDING``'s columns by
explode and select; a document that isn't valid JSON gives no rows. Line formats (JSON lines, text) are split first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import from_cvss, osv_best, osv_severity, parse_severity, tool_level
from ..functions.text import cves_in, endpoint, filled, without_tags
from ..schemas import FINDING_FIELDS

def no_strings() -> Column:
    return F.array().cast("array<string>")


def text(value: Column | str | None, most: int | None = None) -> Column:
    own = F.coalesce(value.cast("string") if isinstance(value, Column) else F.lit(value), F.lit(""))
    return F.substring(own, 1, most) if most else own


def present(items: Column, most: int = 10) -> Column:
    """The non-empty ones, the first few."""
    return F.slice(F.filter(F.coalesce(items, no_strings()), lambda x: F.coalesce(x, F.lit("")) != ""), 1, most)


def finding(rows: DataFrame, scanner: str, category: str | Column, severity: Column, **own: Column) -> DataFrame:
    """The columns of a finding; what isn't given is empty, cvss and target_ip null."""
    defaults = {name: F.lit("") for name, _ in FINDING_FIELDS} | {"cvss": F.lit(None).cast("double"), "cves": no_strings(), "references": no_strings()}
    cols = defaults | own | {"scanner": F.lit(scanner), "category": F.lit(category) if isinstance(category, str) else category, "severity": severity, "target_image": F.col("image"), "target_name": F.col("name"), "target_ip": F.col("ip")}
    return rows.select(*(cols[name].cast(kind).alias(name) for name, kind in FINDING_FIELDS))


def parsed(docs: DataFrame, ddl: str) -> DataFrame:
    return docs.where(F.try_parse_json("doc").isNotNull()).withColumn("d", F.from_json("doc", ddl))


def lines(docs: DataFrame) -> DataFrame:
    """(image, name, ip, doc, pos): one row a line."""
    return docs.select("image", "name", "ip", F.posexplode(F.split("doc", r"\r?\n")).alias("pos", "doc"))


def syft(docs: DataFrame) -> DataFrame:
    a = parsed(docs, "artifacts array<struct<name:string,version:string,type:string,purl:string,licenses:array<string>,locations:array<struct<path:string>>>>").select("image", "name", "ip", F.explode("d.artifacts").alias("a"))
    license_ = F.transform(F.coalesce("a.licenses", no_strings()), lambda x: F.coalesce(F.get_json_object(x, "$.value"), x))
    return finding(
        a, "syft", "sbom-component", F.lit("info"), id=filled(F.col("a.purl"), F.concat(text(F.col("a.name")), F.lit("@"), text(F.col("a.version")))), title=text(F.col("a.name")), version=text(F.col("a.version")), package=text(F.col("a.name")),
        ecosystem=text(F.col("a.type")), description=F.array_join(license_, ", "), location=text(F.try_element_at(present(F.col("a.locations.path")), F.lit(1))),
    )


def trivy(docs: DataFrame) -> DataFrame:
    ddl = """Results array<struct<Target:string,Class:string,Type:string,
      Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,Description:string,PkgPath:string,CVSS:map<string,struct<V2Score:double,V3Score:double,V40Score:double>>,References:array<string>>>,
      Secrets:array<struct<RuleID:string,Category:string,Severity:string,Title:string,Match:string,StartLine:string>>,
      Misconfigurations:array<struct<ID:string,Title:string,Description:string,Message:string,Severity:string,References:array<string>>>>>"""
    r = parsed(docs, ddl).select("image", "name", "ip", F.explode("d.Results").alias("r")).withColumn("loc", filled(F.col("r.Target"), text(F.col("r.Class"))))
    v = r.select("*", F.explode("r.Vulnerabilities").alias("v"))
    score = F.array_max(F.flatten(F.transform(F.map_values("v.CVSS"), lambda x: F.array(x["V3Score"], x["V40Score"], x["V2Score"]))))
    own = cves_in(F.col("v.VulnerabilityID"))
    vulns = finding(
        v, "trivy", "pkg-vuln", parse_severity(F.col("v.Severity")), id=text(F.col("v.VulnerabilityID")), title=filled(F.col("v.Title"), text(F.col("v.VulnerabilityID"))), description=text(F.col("v.Description"), 1000), cvss=score, package=text(F.col("v.PkgName")),
        version=text(F.col("v.InstalledVersion")), fixed_version=text(F.col("v.FixedVersion")), ecosystem=text(F.col("r.Type")), location=filled(F.col("v.PkgPath"), F.col("loc")),
        cves=F.when(F.size(own) > 0, own).otherwise(cves_in(F.array_join(F.coalesce("v.References", no_strings()), " "))), references=F.slice(F.coalesce("v.References", no_strings()), 1, 10),
    )
    s = r.select("*", F.explode("r.Secrets").alias("s"))
    secrets = finding(s, "trivy", "secret", parse_severity(F.col("s.Severity")), id=text(F.col("s.RuleID")), title=filled(F.col("s.Title"), F.coalesce("s.Category", F.lit("secret"))), description=text(F.col("s.Match"), 300), location=F.concat("loc", F.lit(":"), text(F.col("s.StartLine"))))
    m = r.select("*", F.explode("r.Misconfigurations").alias("m"))
    configs = finding(m, "trivy", "image-config", parse_severity(F.col("m.Severity")), id=text(F.col("m.ID")), title=filled(F.col("m.Title"), text(F.col("m.ID"))), description=F.substring(filled(F.col("m.Description"), text(F.col("m.Message"))), 1, 600), location=F.col("loc"), references=F.slice(F.coalesce("m.References", no_strings()), 1, 5))
    return vulns.unionByName(secrets).unionByName(configs)


def grype(docs: DataFrame) -> DataFrame:
    ddl = """matches array<struct<vulnerability:struct<id:string,severity:string,description:string,cvss:array<struct<metrics:struct<baseScore:double>>>,fix:struct<versions:array<string>>,urls:array<string>,relatedVulnerabilities:array<struct<id:string>>>,
      artifact:struct<name:string,version:string,type:string,locations:array<struct<path:string>>>>>"""
    m = parsed(docs, ddl).select("image", "name", "ip", F.explode("d.matches").alias("m")).select("image", "name", "ip", "m.vulnerability", "m.artifact")
    score = F.array_max("vulnerability.cvss.metrics.baseScore")
    sev, own = F.col("vulnerability.severity"), cves_in(F.col("vulnerability.id"))
    related = F.filter(F.coalesce("vulnerability.relatedVulnerabilities.id", no_strings()), lambda x: F.upper(x).startswith("CVE"))
    link = F.transform(F.coalesce("vulnerability.urls", no_strings()), lambda x: F.coalesce(F.get_json_object(x, "$.url"), x))
    return finding(
        m, "grype", "pkg-vuln", F.when((text(sev) != "") & (sev != "Unknown"), parse_severity(sev)).otherwise(from_cvss(score)), id=text(F.col("vulnerability.id")), title=text(F.col("vulnerability.id")), description=text(F.col("vulnerability.description"), 1000), cvss=score,
        package=text(F.col("artifact.name")), version=text(F.col("artifact.version")), fixed_version=F.array_join(F.coalesce("vulnerability.fix.versions", no_strings()), ", "), ecosystem=text(F.col("artifact.type")),
        location=text(F.try_element_at(present(F.col("artifact.locations.path")), F.lit(1))), cves=F.when(F.size(own) > 0, own).otherwise(related), references=F.slice(link, 1, 10),
    )


def osv(docs: DataFrame) -> DataFrame:
    ddl = """results array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string,ecosystem:string>,
      vulnerabilities:array<struct<id:string,aliases:array<string>,summary:string,details:string,severity:array<struct<type:string,score:string>>,database_specific:struct<severity:string>,references:array<struct<url:string>>>>>>>>"""
    r = parsed(docs, ddl).select("image", "name", "ip", F.explode("d.results").alias("r"))
    v = r.select("image", "name", "ip", F.col("r.source.path").alias("path"), F.explode("r.packages").alias("k")).select("image", "name", "ip", "path", "k.package", F.explode("k.vulnerabilities").alias("v"))
    alias = F.filter(F.coalesce("v.aliases", no_strings()), lambda x: F.upper(x).startswith("CVE"))
    vid = F.coalesce(F.try_element_at(alias, F.lit(1)), text(F.col("v.id")))
    return finding(
        v, "osv", "pkg-vuln", osv_severity(F.col("v.severity"), F.col("v.database_specific.severity")), id=vid, title=F.substring(filled(F.col("v.summary"), vid), 1, 200), description=text(F.col("v.details"), 1000), cvss=osv_best(F.col("v.severity")),
        package=text(F.col("package.name")), version=text(F.col("package.version")), ecosystem=text(F.col("package.ecosystem")), location=text(F.col("path")), cves=F.when(F.size(alias) > 0, alias).otherwise(cves_in(vid)), references=present(F.col("v.references.url")),
    )


def dockle(docs: DataFrame) -> DataFrame:
    d = parsed(docs, "details array<struct<code:string,title:string,level:string,alerts:array<string>>>").select("image", "name", "ip", F.explode("d.details").alias("x")).where(~F.upper(text(F.col("x.level"))).isin("PASS", "SKIP", "IGNORE"))
    return finding(d, "dockle", "image-config", tool_level("dockle", F.col("x.level")), id=text(F.col("x.code")), title=filled(F.col("x.title"), text(F.col("x.code"))), description=F.substring(F.array_join(F.coalesce("x.alerts", no_strings()), "; "), 1, 800))


def trufflehog(docs: DataFrame) -> DataFrame:
    r = parsed(lines(docs), "DetectorName string, Verified boolean, Redacted string, Raw string, SourceName string, SourceMetadata struct<Data:map<string,map<string,string>>>").where("d.DetectorName IS NOT NULL")
    ok = F.coalesce("d.Verified", F.lit(False))
    places = F.flatten(F.transform(F.map_values("d.SourceMetadata.Data"), lambda m: F.array(*(F.try_element_at(m, F.lit(k)) for k in ("file", "path", "link", "image", "layer", "Layer", "File")))))
    where = F.coalesce(F.try_element_at(present(places), F.lit(1)), text(F.col("d.SourceName")))
    return finding(r, "trufflehog", "secret", F.when(ok, "critical").otherwise("medium"), id=text(F.col("d.DetectorName")), title=F.concat(F.when(ok, "verified ").otherwise(""), F.col("d.DetectorName")), description=F.substring(filled(F.col("d.Redacted"), text(F.col("d.Raw"))), 1, 300), location=where)


def clair(docs: DataFrame) -> DataFrame:
    item = "struct<name:string,severity:string,normalized_severity:string,description:string,links:string,fixed_in_version:string,package:struct<name:string,version:string>,repository:struct<name:string>>"
    is_map = F.startswith(F.ltrim(F.get_json_object("doc", "$.vulnerabilities")), F.lit("{"))
    items = F.when(is_map, F.map_values(F.from_json(F.get_json_object("doc", "$.vulnerabilities"), f"map<string,{item}>"))).otherwise(F.from_json(F.get_json_object("doc", "$.vulnerabilities"), f"array<{item}>"))
    v = docs.where(F.try_parse_json("doc").isNotNull()).select("image", "name", "ip", F.explode(items).alias("v"))
    own = cves_in(F.col("v.name"))
    return finding(
        v, "clair", "pkg-vuln", parse_severity(filled(F.col("v.normalized_severity"), F.col("v.severity"))), id=text(F.col("v.name")), title=text(F.col("v.name")), description=text(F.col("v.description"), 1000), package=text(F.col("v.package.name")), version=text(F.col("v.package.version")),
        fixed_version=text(F.col("v.fixed_in_version")), location=text(F.col("v.repository.name")), cves=F.when(F.size(own) > 0, own).otherwise(cves_in(F.col("v.links"))), references=F.slice(F.filter(F.split(text(F.col("v.links")), r"\s+"), lambda x: x.startswith("http")), 1, 10),
    )


def dependency_check(docs: DataFrame) -> DataFrame:
    score = "struct<baseScore:double,score:double>"
    ddl = f"dependencies array<struct<fileName:string,filePath:string,packages:array<struct<id:string>>,vulnerabilities:array<struct<name:string,severity:string,description:string,cvssv2:{score},cvssv3:{score},cvssv4:{score},references:array<struct<url:string>>>>>>"
    d = parsed(docs, ddl).select("image", "name", "ip", F.explode("d.dependencies").alias("x"))
    d = d.select("image", "name", "ip", filled(F.col("x.fileName"), text(F.col("x.filePath"))).alias("file"), text(F.try_element_at(F.filter(F.coalesce("x.packages.id", no_strings()), lambda p: p.startswith("pkg:")), F.lit(1))).alias("purl"), F.explode("x.vulnerabilities").alias("v"))
    bare = F.substr("purl", F.lit(5))
    name = F.col("v.name")
    return finding(
        d, "dependency-check", "pkg-vuln", parse_severity(F.col("v.severity")), id=text(name), title=filled(name, "vulnerability"), description=F.substring(F.trim(text(F.col("v.description"))), 1, 1200), cvss=F.coalesce("v.cvssv4.baseScore", "v.cvssv3.baseScore", "v.cvssv2.baseScore", "v.cvssv2.score"),
        package=F.substring(F.when(F.col("purl") != "", F.split_part(bare, F.lit("@"), F.lit(1))).otherwise(F.col("file")), 1, 120), ecosystem=F.when(F.col("purl") != "", F.split_part(bare, F.lit("/"), F.lit(1))).otherwise(""), location=F.substring("file", 1, 200),
        cves=F.when(F.upper(text(name)).startswith("CVE"), F.array(name)).otherwise(cves_in(name)), references=present(F.col("v.references.url")),
    )


def inner_path(path: Column) -> Column:
    """Without the scan's mount point."""
    return F.regexp_replace(text(path), "^/scan/", "")


def semgrep(docs: DataFrame) -> DataFrame:
    ddl = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string,metadata:struct<category:string,source:string,references:array<string>>>>>"
    r = parsed(docs, ddl).select("image", "name", "ip", F.explode("d.results").alias("r"))
    check, message = text(F.col("r.check_id")), F.col("r.extra.message")
    secret = F.lower(check).contains("secret") | F.lower(text(F.col("r.extra.metadata.category"))).contains("secret")
    return finding(
        r, "semgrep", F.when(secret, "secret").otherwise("other"), tool_level("semgrep", F.col("r.extra.severity"), parse_severity(F.col("r.extra.severity"))), id=filled(F.substring(F.element_at(F.split(check, r"\."), -1), 1, 80), F.substring(check, 1, 80)), title=F.substring(filled(message, check), 1, 200),
        description=F.substring(F.trim(text(message)), 1, 1000), location=F.regexp_replace(F.concat(inner_path(F.col("r.path")), F.lit(":"), text(F.col("r.start.line"))), ":+$", ""), references=present(F.array(F.try_element_at("r.extra.metadata.references", F.lit(1)), F.col("r.extra.metadata.source"))),
    )


def yara(docs: DataFrame) -> DataFrame:
    """'RULE /scan/path' lines, each with the '0x...' lines that follow. The file's lines are folded: a match opens a row, a string line joins the last."""
    kind = "array<struct<rule:string,path:string,strings:array<string>>>"
    match = r"^(\S+)\s+(/scan/\S.*)$"

    def step(found: Column, line: Column) -> Column:
        opened = F.concat(found, F.array(F.struct(F.regexp_extract(line, match, 1).alias("rule"), F.regexp_extract(line, match, 2).alias("path"), no_strings().alias("strings"))))
        last = F.element_at(found, -1)
        longer = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.struct(last["rule"].alias("rule"), last["path"].alias("path"), F.concat(last["strings"], F.array(F.trim(line))).alias("strings"))))
        return F.when(line.rlike(match), opened).when((F.size(found) > 0) & line.startswith("0x"), longer).otherwise(found)

    r = docs.select("image", "name", "ip", F.explode(F.aggregate(F.split(F.coalesce("doc", F.lit("")), r"\r?\n"), F.array().cast(kind), step)).alias("y"))
    return finding(r, "yara", "malware", F.lit("medium"), id=F.col("y.rule"), title=F.concat(F.lit("YARA rule "), "y.rule"), description=F.substring(F.array_join(F.slice("y.strings", 1, 8), "; "), 1, 600), location=inner_path(F.col("y.path")))


def clamav(docs: DataFrame) -> DataFrame:
    hit = r"^(.*?): (.+?) FOUND\s*$"
    r = lines(docs).where(F.col("doc").rlike(hit)).select("*", F.regexp_extract("doc", hit, 1).alias("path"), F.regexp_extract("doc", hit, 2).alias("sig"))
    return finding(r, "clamav", "malware", F.lit("high"), id=F.col("sig"), title=F.col("sig"), description=F.concat(F.lit("ClamAV signature "), "sig"), location=inner_path(F.col("path")))


def nuclei(docs: DataFrame) -> DataFrame:
    ddl = "`template-id` string, templateID string, host string, `matched-at` string, info struct<name:string,severity:string,description:string,reference:array<string>,classification:struct<`cve-id`:array<string>,`cvss-score`:double>>"
    r = parsed(lines(docs), ddl).where("d IS NOT NULL")
    at = filled(F.col("d.`matched-at`"), text(F.col("d.host")))
    return finding(
        r, "nuclei", "web-vuln", parse_severity(F.col("d.info.severity")), id=filled(F.col("d.`template-id`"), text(F.col("d.templateID"))), title=text(F.col("d.info.name")), description=text(F.col("d.info.description"), 800), cvss=F.col("d.info.classification.`cvss-score`"), location=at,
        endpoint=filled(endpoint(at), endpoint(F.col("d.host"))), cves=F.transform(F.coalesce("d.info.classification.`cve-id`", no_strings()), F.upper), references=F.slice(F.coalesce("d.info.reference", no_strings()), 1, 10),
    )


def nikto(docs: DataFrame) -> DataFrame:
    host = "struct<ip:string,host:string,port:string,vulnerabilities:array<struct<id:string,OSVDB:string,msg:string,title:string,url:string,references:string>>>"
    hosts = F.when(F.ltrim("doc").startswith("["), F.from_json("doc", f"array<{host}>")).otherwise(F.array(F.from_json("doc", host)))
    v = docs.where(F.try_parse_json("doc").isNotNull()).select("image", "name", "ip", F.explode(hosts).alias("h")).select("image", "name", "ip", "h", F.explode("h.vulnerabilities").alias("v"))
    msg = filled(F.col("v.msg"), text(F.col("v.title")))
    at = F.regexp_replace(F.concat(filled(F.col("h.ip"), text(F.col("h.host"))), F.lit(":"), text(F.col("h.port"))), "^:+|:+$", "")
    return finding(v, "nikto", "web-vuln", F.lit("low"), id=filled(F.col("v.id"), text(F.col("v.OSVDB"))), title=F.substring(msg, 1, 200), description=F.substring(msg, 1, 800), location=text(F.col("v.url")), endpoint=at, cves=cves_in(msg), references=present(F.array("v.references")))


def zap(docs: DataFrame) -> DataFrame:
    ddl = "site array<struct<`@name`:string,name:string,alerts:array<struct<pluginid:string,alertRef:string,alert:string,name:string,riskcode:string,riskdesc:string,desc:string,reference:string,cweid:string,instances:array<struct<uri:string>>>>>>"
    a = parsed(docs, ddl).select("image", "name", "ip", F.explode("d.site").alias("s")).select("image", "name", "ip", filled(F.col("s.`@name`"), text(F.col("s.name"))).alias("base"), F.explode("s.alerts").alias("a"))
    uri = filled(F.try_element_at(F.col("a.instances.uri"), F.lit(1)), F.col("base"))
    return finding(
        a, "zap", "web-vuln", tool_level("zap", F.col("a.riskcode"), parse_severity(F.col("a.riskdesc"))), id=filled(F.col("a.pluginid"), text(F.col("a.alertRef"))), title=filled(F.col("a.alert"), text(F.col("a.name"))), description=F.substring(without_tags(F.col("a.desc")), 1, 1000), location=uri,
        endpoint=filled(endpoint(uri), endpoint(F.col("base"))), references=F.slice(F.filter(F.split(without_tags(F.col("a.reference")), r"\s+"), lambda x: x.startswith("http")), 1, 10),
    )


#: Titles of findings that the tool gives none.
INJECTION, OTHER_RESULT = "SQL injection confirmed by sqlmap", "sqlmap result"


def sqlmap(docs: DataFrame) -> DataFrame:
    """Logs that record an injection point, and any JSON object that isn't empty."""
    log = docs.where(F.col("doc").contains("is vulnerable") | F.col("doc").contains("Parameter:"))
    other = docs.where(F.ltrim("doc").startswith("{") & F.try_parse_json("doc").isNotNull() & (F.size(F.coalesce(F.json_object_keys("doc"), no_strings())) > 0))
    own = lambda rows, title: finding(rows, "sqlmap", "web-vuln", F.lit("high"), id=F.lit("sqli"), title=F.lit(title), description=text(F.col("doc"), 2000))
    return own(log, INJECTION).unionByName(own(other, OTHER_RESULT))


def openvas(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """CSV rows (columns may have either of two names) to findings; repeated results are one, targets are found by their address."""
    col = lambda *names: F.trim(F.coalesce(*(F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in rows.columns), F.lit("")))
    own = rows.select(
        col("IP", "Host").alias("addr"), col("Port").alias("port"), col("Port Protocol", "Protocol").alias("proto"), col("NVT OID", "OID").alias("oid"), col("NVT Name", "Name").alias("title"), col("CVSS").try_cast("double").alias("cvss"), cves_in(col("CVEs")).alias("cves"),
        col("Severity").alias("severity"), col("Summary", "Vulnerability Insight").alias("summary"), col("Other References").alias("other"), col("Result ID").alias("result"),
    ).dropDuplicates(["addr", "port", "oid", "title", "result"])
    own = own.join(targets.select("image", "name", "ip").dropDuplicates(["ip"]), F.col("addr") == F.col("ip"), "left").withColumn("name", F.coalesce("name", F.concat(F.lit("ip_"), "addr"))).withColumn("image", text(F.col("image"))).withColumn("ip", F.nullif("addr", F.lit("")))
    first = F.try_element_at("cves", F.lit(1))
    return finding(
        own, "openvas", "network-vuln", F.when(F.col("severity") != "", parse_severity(F.col("severity"))).otherwise(from_cvss(F.col("cvss"))), id=filled(F.col("oid"), F.coalesce(first, F.col("title"))), title=F.col("title"), description=F.substring("summary", 1, 1500), cvss=F.col("cvss"),
        location=F.regexp_replace(F.concat("port", F.lit("/"), "proto"), "^/+|/+$", ""), endpoint=F.regexp_replace(F.concat("addr", F.lit(":"), "port"), "^:+|:+$", ""), cves=F.col("cves"), references=F.slice(F.regexp_extract_all("other", F.lit(r"(https?://\S+)"), F.lit(1)), 1, 10),
    )


#: name: (parser, mode, stack). Static tools read the image, dynamic ones a running container.
REGISTRY: dict[str, tuple[Callable[[DataFrame], DataFrame], str, str]] = {
    "clair": (clair, "static", "image"), "clamav": (clamav, "static", "rootfs"), "dependency-check": (dependency_check, "static", "rootfs"), "dockle": (dockle, "static", "image"), "grype": (grype, "static", "image"), "nikto": (nikto, "dynamic", "web"), "nuclei": (nuclei, "dynamic", "web"),
    "osv": (osv, "static", "image"), "semgrep": (semgrep, "static", "rootfs"), "sqlmap": (sqlmap, "dynamic", "web"), "syft": (syft, "static", "image"), "trivy": (trivy, "static", "image"), "trufflehog": (trufflehog, "static", "image"), "yara": (yara, "static", "rootfs"), "zap": (zap, "dynamic", "web"),
}


def selected(only: list[str] | None = None, skip: list[str] | None = None, mode: str | None = None) -> list[str]:
    """Names of the registry; an unheard-of name is an error."""
    for n in [*(only or []), *(skip or [])]:
        if n not in REGISTRY:
            raise ValueError(f"no scanner named {n}")
    return [n for n, (_, m, _) in REGISTRY.items() if (not only or n in only) and n not in (skip or []) and (mode is None or m == mode)]


def parse(docs: DataFrame, tool: str) -> DataFrame:
    return REGISTRY[tool][0](docs)
