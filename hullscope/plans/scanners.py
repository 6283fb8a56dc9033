"""Queries on scanner outputs: documents of every tool, built from lineitem, through the tool's adapter to findings.

A document is made for each order, with an item for each of its lines; the SQL says what must come out, from lineitem alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import adapters, details
from ..sources.readers import table
from .registry import query

WORDS = ("CRITICAL", "High", "moderate", "low", "Negligible", "odd")
BASE = "(SELECT 'img' || CAST(l_orderkey AS VARCHAR) AS image, 'name' || CAST(l_orderkey AS VARCHAR) AS name, CAST(l_partkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(l_suppkey AS BIGINT) AS s, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)"
LEVEL = "CASE CAST(k % 6 AS INTEGER) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'unknown' END"
BY_SCORE = "CASE WHEN {x} >= 9 THEN 'critical' WHEN {x} >= 7 THEN 'high' WHEN {x} >= 4 THEN 'medium' WHEN {x} > 0 THEN 'low' ELSE 'info' END"


def text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def struct(**fields) -> Column:
    return F.struct(*(v.alias(k.replace("__", "-").replace("at_", "@")) for k, v in fields.items()))


def word(K: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WORDS)), (K % 6 + 1).cast("int"))


def values() -> tuple[Column, ...]:
    """Of a line: part, line number, supplier and quantity."""
    return tuple(map(F.col, ("k", "n", "s", "q")))


def lines(s, d) -> DataFrame:
    o = F.col("l_orderkey").cast("string")
    return table(s, d, "lineitem").select(F.concat(F.lit("img"), o).alias("image"), F.concat(F.lit("name"), o).alias("name"), F.col("l_partkey").cast("bigint").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_suppkey").cast("bigint").alias("s"), F.col("l_quantity").cast("double").alias("q"))


def documents(s, d, item: Column, whole=None, join: bool = False) -> DataFrame:
    """image, name, ip, doc: whole(items) as JSON, or the items, which are texts, one a line."""
    rows = lines(s, d).groupBy("image", "name").agg(F.collect_list(item).alias("items"))
    doc = F.array_join("items", "\n") if join else F.to_json(whole(F.col("items")))
    return rows.select("image", "name", F.lit("10.0.0.1").alias("ip"), doc.alias("doc"))


def shown(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col("target_image").alias("image"), *(F.array_join(c, ",").alias(c) if c in ("cves", "references") else F.col(c) for c in columns))


def adapter(tool: str, columns: tuple[str, ...], sql: str, item, whole=None, join: bool = False) -> None:
    query(f"adapter_{tool.replace('-', '_')}", sql)(lambda s, d: shown(adapters.parse(documents(s, d, item(*values()), whole, join), tool), *columns))


field = lambda name: lambda items: F.struct(items.alias(name))

adapter(
    "syft", ("category", "id", "package", "version", "ecosystem", "description", "location"),
    f"SELECT image, 'sbom-component' AS category, CASE WHEN k % 2 = 0 THEN 'pkg:deb/p' || k ELSE 'p' || k || '@1.' || n END AS id, 'p' || k AS package, '1.' || n AS version, 'deb' AS ecosystem, 'MIT, BSD' AS description, '/lib/' || s AS location FROM {BASE}",
    lambda K, N, S, Q: struct(name=text("p", K), version=text("1.", N), type=F.lit("deb"), purl=F.when(K % 2 == 0, text("pkg:deb/p", K)).otherwise(""), licenses=F.array(F.lit("MIT"), F.lit("BSD")), locations=F.array(struct(path=F.lit("")), struct(path=text("/lib/", S)))), field("artifacts"),
)
adapter(
    "trivy", ("category", "id", "severity", "package", "version", "fixed_version", "ecosystem", "cvss", "location", "title", "description", "cves", "references"),
    f"""SELECT image, CASE WHEN n <= 4 THEN 'pkg-vuln' WHEN n = 5 THEN 'secret' ELSE 'image-config' END AS category, CASE WHEN n <= 4 THEN 'CVE-2020-' || (1000 + k) WHEN n = 5 THEN 'rule' || k ELSE 'DS' || k END AS id, {LEVEL} AS severity, CASE WHEN n <= 4 THEN 'p' || s ELSE '' END AS package,
 CASE WHEN n <= 4 THEN '1.' || n ELSE '' END AS version, CASE WHEN n <= 4 AND k % 2 = 0 THEN '2.0' ELSE '' END AS fixed_version, CASE WHEN n <= 4 THEN 'debian' ELSE '' END AS ecosystem, CASE WHEN n <= 4 THEN greatest(q / 10, 1.0) END AS cvss, CASE WHEN n = 5 THEN 'layer:' || s ELSE 'layer' END AS location,
 CASE WHEN n <= 4 THEN 'CVE-2020-' || (1000 + k) WHEN n = 5 THEN 'keys' ELSE 'DS' || k END AS title, CASE WHEN n <= 4 THEN 'about' WHEN n = 5 THEN 'found' ELSE 'message' END AS description, CASE WHEN n <= 4 THEN 'CVE-2020-' || (1000 + k) ELSE '' END AS cves, CASE WHEN n <= 4 THEN 'http://r/' || k ELSE '' END AS "references" FROM {BASE}""",
    lambda K, N, S, Q: struct(
        Target=F.lit("layer"), Type=F.lit("debian"),
        Vulnerabilities=F.when(N <= 4, F.array(struct(VulnerabilityID=text("CVE-2020-", 1000 + K), PkgName=text("p", S), InstalledVersion=text("1.", N), FixedVersion=F.when(K % 2 == 0, "2.0"), Severity=word(K), Description=F.lit("about"), CVSS=F.create_map(F.lit("nvd"), struct(V3Score=Q / 10), F.lit("own"), struct(V3Score=F.lit(1.0))), References=F.array(text("http://r/", K))))),
        Secrets=F.when(N == 5, F.array(struct(RuleID=text("rule", K), Category=F.lit("keys"), Severity=word(K), Match=F.lit("found"), StartLine=S))), Misconfigurations=F.when(N >= 6, F.array(struct(ID=text("DS", K), Message=F.lit("message"), Severity=word(K)))),
    ), field("Results"),
)
adapter(
    "grype", ("category", "id", "severity", "package", "version", "fixed_version", "ecosystem", "cvss", "location", "cves", "references"),
    f"""SELECT image, 'pkg-vuln' AS category, CASE WHEN k % 2 = 0 THEN 'CVE-2021-' || (1000 + k) ELSE 'GHSA-' || k END AS id, CASE WHEN k % 3 = 0 THEN {BY_SCORE.format(x="q / 5")} ELSE {LEVEL} END AS severity, 'p' || s AS package, '1.' || n AS version, '2.0, 3.0' AS fixed_version, 'deb' AS ecosystem, q / 5 AS cvss, '/x/' || s AS location,
 CASE WHEN k % 2 = 0 THEN 'CVE-2021-' || (1000 + k) ELSE 'CVE-2019-' || (1000 + k) END AS cves, 'http://u/' || k AS "references" FROM {BASE}""",
    lambda K, N, S, Q: struct(
        vulnerability=struct(id=F.when(K % 2 == 0, text("CVE-2021-", 1000 + K)).otherwise(text("GHSA-", K)), severity=F.when(K % 3 == 0, "Unknown").otherwise(word(K)), cvss=F.array(struct(metrics=struct(baseScore=Q / 5)), struct(metrics=struct(baseScore=F.lit(0.0)))), fix=struct(versions=F.array(F.lit("2.0"), F.lit("3.0"))), urls=F.array(text("http://u/", K)), relatedVulnerabilities=F.array(struct(id=F.lit("GHSA-x")), struct(id=text("CVE-2019-", 1000 + K)))),
        artifact=struct(name=text("p", S), version=text("1.", N), type=F.lit("deb"), locations=F.array(struct(path=text("/x/", S)))),
    ), field("matches"),
)
_OSV = "CASE CAST(k % 3 AS INTEGER) WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"
adapter(
    "osv", ("category", "id", "severity", "cvss", "package", "version", "ecosystem", "title", "location", "cves", "references"),
    f"""SELECT image, 'pkg-vuln' AS category, CASE WHEN n % 2 = 0 THEN 'CVE-2018-' || (1000 + k) ELSE 'GHSA-' || k END AS id, {_OSV.format(a="'high'", b="'medium'", c="'unknown'")} AS severity, {_OSV.format(a="7.4E0", b="NULL", c="NULL")} AS cvss, 'p' || s AS package, '1.' || n AS version, 'npm' AS ecosystem,
 CASE WHEN n % 2 = 0 THEN 'CVE-2018-' || (1000 + k) ELSE 'GHSA-' || k END AS title, '/lock' AS location, CASE WHEN n % 2 = 0 THEN 'CVE-2018-' || (1000 + k) ELSE '' END AS cves, 'http://o/' || k AS "references" FROM {BASE}""",
    lambda K, N, S, Q: struct(package=struct(name=text("p", S), version=text("1.", N), ecosystem=F.lit("npm")), vulnerabilities=F.array(struct(
        id=text("GHSA-", K), aliases=F.when(N % 2 == 0, F.array(F.lit("X-1"), text("CVE-2018-", 1000 + K))), severity=F.when(K % 3 == 0, F.array(struct(type=F.lit("CVSS_V3"), score=F.lit("CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N")))), database_specific=F.when(K % 3 == 1, struct(severity=F.lit("MODERATE"))), references=F.array(struct(url=text("http://o/", K)), struct(url=F.lit("")))))),
    lambda items: F.struct(F.array(F.struct(F.struct(F.lit("/lock").alias("path")).alias("source"), items.alias("packages"))).alias("results")),
)
adapter(
    "dockle", ("category", "id", "severity", "title", "description"),
    f"SELECT image, 'image-config' AS category, 'CIS-' || k AS id, CASE n % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'CIS-' || k AS title, 'a; b' || s AS description FROM {BASE} WHERE k % 5 <> 0",
    lambda K, N, S, Q: struct(code=text("CIS-", K), level=F.when(K % 5 == 0, "PASS").when(N % 3 == 0, "FATAL").when(N % 3 == 1, "WARN").otherwise("INFO"), alerts=F.array(F.lit("a"), text("b", S))), field("details"),
)
adapter(
    "trufflehog", ("category", "id", "severity", "title", "description", "location"),
    f"SELECT image, 'secret' AS category, 'D' || s AS id, CASE WHEN k % 2 = 0 THEN 'critical' ELSE 'medium' END AS severity, CASE WHEN k % 2 = 0 THEN 'verified ' ELSE '' END || 'D' || s AS title, 'raw' || k AS description, '/f/' || n AS location FROM {BASE} WHERE k % 7 <> 0",
    lambda K, N, S, Q: F.when(K % 7 == 0, "no JSON").otherwise(F.to_json(struct(DetectorName=text("D", S), Verified=K % 2 == 0, Raw=text("raw", K), SourceMetadata=struct(Data=F.create_map(F.lit("Docker"), F.create_map(F.lit("file"), text("/f/", N))))))), join=True,
)
adapter(
    "clair", ("category", "id", "severity", "package", "version", "fixed_version", "location", "cves", "references"),
    f"""SELECT image, 'pkg-vuln' AS category, 'CVE-2017-' || (1000 + k) AS id, {LEVEL} AS severity, 'p' || s AS package, '1.' || n AS version, '2' AS fixed_version, 'debian' AS location, 'CVE-2017-' || (1000 + k) AS cves, 'http://c/' || k AS "references" FROM {BASE}""",
    lambda K, N, S, Q: struct(name=text("CVE-2017-", 1000 + K), normalized_severity=word(K), links=text("see http://c/", K), fixed_in_version=F.lit("2"), package=struct(name=text("p", S), version=text("1.", N)), repository=struct(name=F.lit("debian"))), field("vulnerabilities"),
)
adapter(
    "dependency-check", ("category", "id", "severity", "cvss", "package", "ecosystem", "location", "cves", "references"),
    f"""SELECT image, 'pkg-vuln' AS category, 'CVE-2016-' || (1000 + k) AS id, {LEVEL} AS severity, q AS cvss, CASE WHEN k % 2 = 0 THEN 'maven/org/a' || s ELSE 'a' || s || '.jar' END AS package, CASE WHEN k % 2 = 0 THEN 'maven' ELSE '' END AS ecosystem, 'a' || s || '.jar' AS location, 'CVE-2016-' || (1000 + k) AS cves, 'http://d/' || k AS "references" FROM {BASE}""",
    lambda K, N, S, Q: struct(fileName=text("a", S, ".jar"), packages=F.when(K % 2 == 0, F.array(struct(id=text("pkg:maven/org/a", S, "@1")))), vulnerabilities=F.array(struct(name=text("CVE-2016-", 1000 + K), severity=word(K), cvssv3=struct(baseScore=Q), references=F.array(struct(url=text("http://d/", K)))))), field("dependencies"),
)
adapter(
    "semgrep", ("category", "id", "severity", "title", "location", "references"),
    f"""SELECT image, CASE WHEN k % 2 = 0 THEN 'secret' ELSE 'other' END AS category, 'rule' || k AS id, CASE n % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'message ' || s AS title, 'app/f' || s || ':' || n AS location, 'http://s/' || k AS "references" FROM {BASE}""",
    lambda K, N, S, Q: struct(check_id=text(F.when(K % 2 == 0, "generic.secrets.rule").otherwise("py.lang.rule"), K), path=text("/scan/app/f", S), start=struct(line=N), extra=struct(severity=F.when(N % 3 == 0, "ERROR").when(N % 3 == 1, "WARNING").otherwise("INFO"), message=text("message ", S), metadata=struct(references=F.array(text("http://s/", K))))), field("results"),
)
adapter(
    "yara", ("category", "id", "severity", "location", "description"),
    f"SELECT image, 'malware' AS category, 'R' || k AS id, 'medium' AS severity, 'bin/' || s AS location, '0x' || n || ':$a: 41; 0x99:$b: 42' AS description FROM {BASE}",
    lambda K, N, S, Q: text("R", K, " /scan/bin/", S, "\n0x", N, ":$a: 41\n0x99:$b: 42\nnoise"), join=True,
)
adapter(
    "clamav", ("category", "id", "severity", "location"),
    f"SELECT image, 'malware' AS category, 'Sig-' || k AS id, 'high' AS severity, 'e/' || s AS location FROM {BASE} WHERE k % 3 <> 0",
    lambda K, N, S, Q: F.when(K % 3 == 0, text("/scan/e/", S, ": OK")).otherwise(text("/scan/e/", S, ": Sig-", K, " FOUND")), join=True,
)
adapter(
    "nuclei", ("category", "id", "severity", "title", "cvss", "location", "endpoint", "cves"),
    f"SELECT image, 'web-vuln' AS category, 't' || k AS id, {LEVEL} AS severity, 'n' || s AS title, q AS cvss, 'http://h' || s || ':8080/x' || n AS location, 'h' || s || ':8080' AS endpoint, 'CVE-2015-' || (1000 + k) AS cves FROM {BASE}",
    lambda K, N, S, Q: F.to_json(F.struct(text("t", K).alias("template-id"), text("http://h", S, ":8080").alias("host"), text("http://h", S, ":8080/x", N).alias("matched-at"), F.struct(text("n", S).alias("name"), word(K).alias("severity"), F.struct(F.array(text("cve-2015-", 1000 + K)).alias("cve-id"), Q.alias("cvss-score")).alias("classification")).alias("info"))), join=True,
)
adapter(
    "nikto", ("category", "id", "severity", "location", "endpoint", "cves"),
    f"SELECT image, 'web-vuln' AS category, CAST(k AS VARCHAR) AS id, 'low' AS severity, '/a' || s AS location, '1.2.3.' || n || ':80' AS endpoint, 'CVE-2014-' || (1000 + k) AS cves FROM {BASE}",
    lambda K, N, S, Q: struct(ip=text("1.2.3.", N), port=F.lit("80"), vulnerabilities=F.array(struct(id=K.cast("string"), msg=text("old cve-2014-", 1000 + K), url=text("/a", S)))), lambda items: items,
)
adapter(
    "zap", ("category", "id", "severity", "title", "description", "location", "endpoint", "references"),
    f"""SELECT image, 'web-vuln' AS category, CAST(k AS VARCHAR) AS id, CASE n % 4 WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity, 'alert ' || s AS title, 'x & y' AS description, 'http://z' || s || ':8/p' AS location, 'z' || s || ':8' AS endpoint, 'http://r/' || k AS "references" FROM {BASE}""",
    lambda K, N, S, Q: struct(pluginid=K.cast("string"), alert=text("alert ", S), riskcode=(N % 4).cast("string"), desc=F.lit("<p>x &amp; y</p>"), reference=text("<p>http://r/", K, "</p>"), instances=F.array(struct(uri=text("http://z", S, ":8/p")))),
    lambda items: F.struct(F.array(F.struct(F.lit("http://base").alias("@name"), items.alias("alerts"))).alias("site")),
)
adapter(
    "sqlmap", ("category", "id", "severity"), f"SELECT DISTINCT image, 'web-vuln' AS category, 'sqli' AS id, 'high' AS severity FROM {BASE} WHERE k % 4 = 0",
    lambda K, N, S, Q: F.when(K % 4 == 0, text("Parameter: p", K)).otherwise("nothing here"), join=True,
)


def openvas(s, d):
    K, N, S, Q = values()
    rows = lines(s, d).select(text("10.", S, ".0.1").alias("IP"), (8000 + N).cast("string").alias("Port"), F.lit("tcp").alias("Port Protocol"), text("1.3.", K).alias("NVT OID"), text("test ", K).alias("NVT Name"), Q.cast("string").alias("CVSS"), text("CVE-2013-", 1000 + K, ", CVE-2013-", 1000 + K).alias("CVEs"))
    targets = table(s, d, "supplier").where("s_suppkey % 2 = 0").select(text("img", F.col("s_suppkey")).alias("image"), F.col("s_name").alias("name"), text("10.", F.col("s_suppkey"), ".0.1").alias("ip"))
    return adapters.openvas(rows, targets).groupBy("target_name", "target_image", "id", "location", "endpoint").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_join("cves", ",")).alias("cves"))


query("adapter_openvas", f"""SELECT coalesce(s_name, 'ip_10.' || s || '.0.1') AS target_name, CASE WHEN s_name IS NULL THEN '' ELSE 'img' || s END AS target_image, '1.3.' || k AS id, (8000 + n) || '/tcp' AS location, '10.' || s || '.0.1:' || (8000 + n) AS endpoint, CAST(1 AS BIGINT) AS n, 'CVE-2013-' || (1000 + k) AS cves
 FROM (SELECT DISTINCT s, k, n FROM {BASE}) LEFT JOIN supplier ON s_suppkey = s AND s_suppkey % 2 = 0""")(openvas)


def detail(tool: str, columns: tuple[str, ...], sql: str, item, whole=None, join: bool = False) -> None:
    query(f"detail_{tool.replace('-', '_')}", sql)(lambda s, d: details.EXTRACTORS[tool](documents(s, d, item(*values()), whole, join).select(F.col("image").alias("target"), "doc")).select("target", *columns))


detail("detect-secrets", ("file", "type", "line_number", "is_verified"), f"SELECT DISTINCT image AS target, 'f' || n || '-' || k || '-' || s || '-' || q AS file, 'kind ' || s AS type, CAST(k AS INTEGER) AS line_number, k % 2 = 0 AS is_verified FROM {BASE}",
       lambda K, N, S, Q: struct(key=text("f", N, "-", K, "-", S, "-", Q), value=F.array(struct(type=text("kind ", S), line_number=K, is_verified=K % 2 == 0))), lambda items: F.struct(F.map_from_entries(items).alias("results")))
detail("checkov", ("framework", "check_id", "severity", "file_path"), f"SELECT image AS target, 'docker' AS framework, 'CKV_' || k AS check_id, CASE WHEN k % 2 = 0 THEN 'HIGH' ELSE 'UNKNOWN' END AS severity, '/d' || s AS file_path FROM {BASE}",
       lambda K, N, S, Q: struct(check_id=text("CKV_", K), severity=F.when(K % 2 == 0, "high"), file_path=text("/d", S)), lambda items: F.struct(F.lit("docker").alias("check_type"), F.struct(items.alias("failed_checks")).alias("results")))
detail("hadolint", ("code", "level", "line"), f"SELECT image AS target, 'DL' || k AS code, CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'info' END AS level, CAST(n AS INTEGER) AS line FROM {BASE}", lambda K, N, S, Q: struct(code=text("DL", K), level=F.when(K % 2 == 0, "Warning"), line=N), lambda items: items)
detail("testssl", ("id", "severity", "finding", "port"), f"SELECT image AS target, 'tls' || k AS id, 'low' AS severity, 'found ' || s AS finding, '443' AS port FROM {BASE}", lambda K, N, S, Q: struct(id=text("tls", K), severity=F.lit("LOW"), finding=text("found ", S), port=F.lit("443")), lambda items: items)
detail("httpx", ("url", "status_code", "title", "tech"), f"SELECT image AS target, 'http://h' || k AS url, CAST(200 + n AS INTEGER) AS status_code, 'title ' || s AS title, 'a, b' AS tech FROM {BASE}", lambda K, N, S, Q: F.to_json(struct(url=text("http://h", K), status_code=200 + N, title=text("title ", S), tech=F.array(F.lit("a"), F.lit("b")))), join=True)
detail("retire", ("file", "component", "version", "severity"), f"SELECT image AS target, 'f' || n AS file, 'c' || k AS component, '1.' || s AS version, 'low' AS severity FROM {BASE}", lambda K, N, S, Q: struct(file=text("f", N), results=F.array(struct(component=text("c", K), version=text("1.", S), vulnerabilities=F.array(struct(identifiers=struct(summary=F.lit("x"))))))), lambda items: items)
