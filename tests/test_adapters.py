"""One small document for each tool, exact fields."""

import json

import pytest

from hullscope.operators import adapters


def parse(spark, tool, doc):
    docs = spark.createDataFrame([("shop:3", "shop", "198.51.100.4", doc if isinstance(doc, str) else json.dumps(doc))], "image string, name string, ip string, doc string")
    return [r.asDict() for r in adapters.parse(docs, tool).collect()]


def test_trivy(spark):
    doc = {"Results": [{"Target": "usr/app", "Type": "alpine", "Vulnerabilities": [{"VulnerabilityID": "TEMP-77", "PkgName": "made-up", "InstalledVersion": "0.9", "Severity": "negligible", "CVSS": {"a": {"V2Score": 3.1}, "b": {"V40Score": 4.4}}, "References": ["see CVE-2011-44444", "http://q"], "PkgPath": "opt/z"}],
        "Secrets": [{"RuleID": "r9", "Severity": "crit", "Match": "m" * 400, "StartLine": 5}], "Misconfigurations": [{"ID": "X-3", "Severity": "important", "Description": "why", "Message": "other", "References": list("abcdefg")}]}, {"Target": "", "Class": "os-pkgs"}]}
    got = {r["category"]: r for r in parse(spark, "trivy", doc)}
    vuln, secret, config = got["pkg-vuln"], got["secret"], got["image-config"]
    assert (vuln["id"], vuln["title"], vuln["package"], vuln["cvss"], vuln["severity"], vuln["cves"], vuln["location"], vuln["fixed_version"]) == ("TEMP-77", "TEMP-77", "made-up", 4.4, "info", ["CVE-2011-44444"], "opt/z", "")
    assert (secret["title"], secret["severity"], len(secret["description"]), secret["location"]) == ("secret", "critical", 300, "usr/app:5")
    assert (config["id"], config["title"], config["severity"], config["description"], config["references"]) == ("X-3", "X-3", "high", "why", list("abcde"))


def test_grype(spark):
    match = lambda id_, severity, score, related: {"vulnerability": {"id": id_, "severity": severity, "cvss": [{"metrics": {"baseScore": s}} for s in score], "fix": {"versions": []}, "urls": [{"url": "http://w"}], "relatedVulnerabilities": related}, "artifact": {"name": "made-up", "version": "3", "type": "gem"}}
    rows = {r["id"]: r for r in parse(spark, "grype", {"matches": [match("GHSA-q", "Unknown", [2.0, 4.5], [{"id": "cve-2012-0009"}, {"id": "GHSA-r"}]), match("CVE-2013-12", "minor", [], [])]})}
    a, b = rows["GHSA-q"], rows["CVE-2013-12"]
    assert (a["severity"], a["cvss"], a["cves"], a["fixed_version"], a["location"]) == ("medium", 4.5, ["cve-2012-0009"], "", "")
    assert (b["severity"], b["cvss"], b["ecosystem"]) == ("low", None, "gem")


@pytest.mark.parametrize(
    ("severity", "database", "expected"),
    [([{"type": "CVSS_V3", "score": "6.6"}], "LOW", ("medium", 6.6)), ([{"type": "CVSS_V3", "score": "CVSS:3.0/AV:P/AC:L"}], "crit", ("critical", None)), ([{"type": "WORD", "score": "important"}], None, ("high", None)), ([], "minor", ("low", None)), ([], None, ("unknown", None))],
)
def test_osv(spark, severity, database, expected):
    v = {"id": "PYSEC-5", "aliases": ["GHSA-5", "CVE-2014-0505"], "details": "long", "severity": severity, "references": [{"url": "http://v"}, {}]} | ({"database_specific": {"severity": database}} if database else {})
    (r,) = parse(spark, "osv", {"results": [{"source": {"path": "Gemfile.lock"}, "packages": [{"package": {"name": "made-up", "version": "8", "ecosystem": "RubyGems"}, "vulnerabilities": [v]}]}]})
    assert ((r["severity"], r["cvss"]), r["id"], r["title"], r["cves"], r["location"], r["references"]) == (expected, "CVE-2014-0505", "CVE-2014-0505", ["CVE-2014-0505"], "Gemfile.lock", ["http://v"])


def test_nuclei(spark):
    line = {"templateID": "old-name", "host": "https://shop.test", "info": {"name": "Open panel", "severity": "note", "reference": [f"http://{i}" for i in range(12)]}}
    (r,) = parse(spark, "nuclei", "plain text\n" + json.dumps(line) + "\r\n")
    assert (r["id"], r["severity"], r["location"], r["endpoint"], r["cvss"], r["cves"], len(r["references"])) == ("old-name", "info", "https://shop.test", "shop.test", None, [], 10)


def test_dependency_check(spark):
    doc = {"dependencies": [{"filePath": "/w/lib.dll", "vulnerabilities": [{"name": "mentions cve-2009-0001", "severity": "odd", "cvssv2": {"score": 4.9}, "description": " padded "}]}, {"fileName": "clean.dll"}]}
    (r,) = parse(spark, "dependency-check", doc)
    assert (r["severity"], r["cvss"], r["ecosystem"], r["package"], r["location"], r["description"], r["cves"]) == ("unknown", 4.9, "", "/w/lib.dll", "/w/lib.dll", "padded", ["CVE-2009-0001"])


def test_semgrep(spark):
    doc = {"results": [{"check_id": "go.net.bind", "path": "srv/run.go", "extra": {"severity": "info", "message": " listens "}}, {"check_id": "java.crypto.weak", "path": "/scan/K.java", "start": {"line": 3}, "extra": {"severity": "CRITICAL", "metadata": {"category": "Hardcoded-Secrets", "source": "http://rule"}}}]}
    a, b = sorted(parse(spark, "semgrep", doc), key=lambda r: r["category"])
    assert (a["category"], a["id"], a["severity"], a["location"], a["description"]) == ("other", "bind", "low", "srv/run.go", "listens")
    assert (b["category"], b["severity"], b["title"], b["location"], b["references"]) == ("secret", "critical", "java.crypto.weak", "K.java:3", ["http://rule"])


def test_text_formats(spark):
    a, b = sorted(parse(spark, "yara", "R1 /scan/bin/x\n0x10:$a: 41\n0x20:$b: 42\nnoise\nR2 /scan/y\n"), key=lambda r: r["id"])
    assert (a["id"], a["location"], a["description"]) == ("R1", "bin/x", "0x10:$a: 41; 0x20:$b: 42")
    assert (b["location"], b["description"]) == ("y", "")
    (r,) = parse(spark, "clamav", "/scan/e/f: Eicar-Test FOUND\nScanned: 1\n")
    assert (r["id"], r["location"], r["severity"]) == ("Eicar-Test", "e/f", "high")


def test_other_tools(spark):
    (r,) = parse(spark, "dockle", {"details": [{"code": "CIS-1", "title": "t", "level": "FATAL", "alerts": ["a", "b"]}, {"code": "x", "level": "PASS"}]})
    assert (r["severity"], r["description"]) == ("high", "a; b")
    (r,) = parse(spark, "trufflehog", json.dumps({"DetectorName": "AWS", "Verified": True, "Raw": "k", "SourceMetadata": {"Data": {"Docker": {"file": "/f", "line": "3"}}}}))
    assert (r["severity"], r["title"], r["location"]) == ("critical", "verified AWS", "/f")
    (r,) = parse(spark, "syft", {"artifacts": [{"name": "n", "version": "1", "type": "deb", "purl": "", "licenses": ["MIT", {"value": "BSD"}]}]})
    assert (r["category"], r["id"], r["description"]) == ("sbom-component", "n@1", "MIT, BSD")
    for doc in ({"vulnerabilities": {"k": {"name": "CVE-2000-1234", "severity": "Negligible", "package": {"name": "p"}}}}, {"vulnerabilities": [{"name": "CVE-2000-1234", "severity": "Negligible", "package": {"name": "p"}}]}):
        (r,) = parse(spark, "clair", doc)
        assert (r["severity"], r["package"], r["cves"]) == ("info", "p", ["CVE-2000-1234"])
    for doc in ([{"ip": "1.2.3.4", "port": 80, "vulnerabilities": [{"id": 7, "msg": "old CVE-2001-0001", "url": "/a"}]}], {"host": "1.2.3.4", "port": "80", "vulnerabilities": [{"id": 7, "msg": "old CVE-2001-0001", "url": "/a"}]}):
        (r,) = parse(spark, "nikto", doc)
        assert (r["endpoint"], r["cves"], r["location"], r["id"]) == ("1.2.3.4:80", ["CVE-2001-0001"], "/a", "7")
    (r,) = parse(spark, "zap", {"site": [{"@name": "http://h", "alerts": [{"pluginid": "1", "alert": "a", "riskcode": "3", "desc": "<p>x &amp; y</p>", "instances": [{"uri": "http://h:8/p"}]}]}]})
    assert (r["severity"], r["endpoint"], r["description"]) == ("high", "h:8", "x & y")
    assert len(parse(spark, "sqlmap", "Parameter: id is vulnerable")) == 1
    for tool in adapters.REGISTRY:
        assert parse(spark, tool, "{broken") == []


def test_openvas(spark):
    rows = spark.createDataFrame([("10.0.0.1", "80", "tcp", "1.2", "name", "7.5", "CVE-2020-1111, CVE-2020-1111", "", "")] * 2, ["IP", "Port", "Port Protocol", "NVT OID", "NVT Name", "CVSS", "CVEs", "Severity", "Summary"])
    targets = spark.createDataFrame([("img", "nm", "10.0.0.1")], "image string, name string, ip string")
    (r,) = adapters.openvas(rows, targets).collect()
    assert (r.target_name, r.severity, r.location, r.endpoint, r.cves) == ("nm", "high", "80/tcp", "10.0.0.1:80", ["CVE-2020-1111"])


def test_registry():
    assert "zap" not in adapters.selected(mode="static")
    with pytest.raises(ValueError):
        adapters.selected(only=["nope"])
