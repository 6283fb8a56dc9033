"""One small document for each detail extractor."""

import base64
import json

import pytest

from hullscope.operators import details

CASES = {
    "osv": ({"results": [{"packages": [{"package": {"name": "n"}, "vulnerabilities": [{"id": "G", "aliases": ["X", "CVE-2020-1"], "severity": [{"type": "CVSS_V3", "score": "7.5"}]}]}]}]}, {"cve": "CVE-2020-1", "pkg": "n", "version": "?", "cvss": 7.5}),
    "detect-secrets": ({"results": {"a.py": [{"type": "AWS", "line_number": 3}]}}, {"file": "a.py", "type": "AWS", "line_number": 3, "is_verified": False}),
    "checkov": ({"check_type": "dockerfile", "results": {"failed_checks": [{"check_id": "C1"}]}}, {"check_id": "C1", "severity": "UNKNOWN", "framework": "dockerfile", "resource": "?"}),
    "arachni": ({"issues": [{"name": "xss", "severity": "High", "vector": {"url": "u", "method": "get"}}]}, {"name": "xss", "severity": "high", "url": "u", "method": "get"}),
    "yara": ("Error: x\nRule1 /a/b c\nlonely\n", {"rule": "Rule1", "path": "/a/b c"}),
    "retire": ([{"file": "f.js", "results": [{"component": "jq", "version": "1", "vulnerabilities": [{"severity": "HIGH", "identifiers": {"summary": "s", "CVE": ["a", "b", "c"]}}]}]}], {"component": "jq", "severity": "high", "cve": "a, b"}),
    "testssl": ([{"id": "BEAST", "severity": "LOW", "finding": "f", "port": 443}], {"id": "BEAST", "severity": "low", "port": "443"}),
    "hadolint": ([{"code": "DL1", "level": "Warning", "line": 2}], {"code": "DL1", "level": "warning", "line": 2, "column": 0}),
    "httpx": ('{"url": "http://u", "status_code": 200, "tech": ["a", "b"], "tls": {"v": 1}}\nbad', {"url": "http://u", "tech": "a, b", "tls_grab": "yes", "server": ""}),
    "whispers": ([{"key": "k", "value": 5, "severity": "MINOR"}], {"key": "k", "value": "5", "file": "?", "severity": "minor"}),
    "jaeles": ({"vuln_url": "u", "sign_id": "s"}, {"vuln_url": "u", "sign_id": "s", "info": ""}),
    "openvas": ("<report><result id='1'><name>N</name><host>h</host><port>80/tcp</port><severity>7.5</severity><x>CVE-2020-1234</x></result></report>", {"name": "N", "host": "h", "port": "80/tcp", "cvss": 7.5, "cves": ["CVE-2020-1234"]}),
}


@pytest.mark.parametrize("tool", sorted(details.EXTRACTORS))
def test_extractor(spark, tool):
    doc, want = CASES[tool]
    docs = spark.createDataFrame([("t", doc if isinstance(doc, str) else json.dumps(doc))], "target string, doc string")
    (row,) = details.EXTRACTORS[tool](docs).collect()
    assert {k: row[k] for k in want} == want and row.target == "t"


def test_base64_report(spark):
    docs = spark.createDataFrame([("t", base64.b64encode(CASES["openvas"][0].encode()).decode()), ("t", "%%%"), ("t", None)], "target string, doc string")
    assert details.openvas(docs).count() == 1
