"""Severity scales, CVSS scores and their precedence, as column expressions (no user functions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from worst to least, rank 5 to 0.
SEVERITIES = ("critical", "high", "medium", "low", "info", "unknown")
RANK = {s: 5 - i for i, s in enumerate(SEVERITIES)}
#: Other names of severities.
SYNONYMS = {
    "critical": "critical", "crit": "critical", "high": "high", "important": "high", "error": "high", "medium": "medium", "moderate": "medium", "warning": "medium", "warn": "medium", "low": "low", "minor": "low",
    "info": "info", "informational": "info", "negligible": "info", "none": "info", "log": "info", "note": "info", "unknown": "unknown",
}
#: Levels that one tool has for itself.
TOOL_LEVELS = {
    "dockle": {"FATAL": "high", "WARN": "medium", "INFO": "low", "SKIP": "info", "PASS": "info", "IGNORE": "info"},
    "semgrep": {"ERROR": "high", "WARNING": "medium", "INFO": "low"},
    "zap": {"3": "high", "2": "medium", "1": "low", "0": "info"},
}
#: CVSS 3 metric weights; privileges required depend on the scope (unchanged, changed).
CVSS3 = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "IMPACT": {"H": 0.56, "L": 0.22, "N": 0.0},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_CHANGED": {"N": 0.85, "L": 0.68, "H": 0.50},
}
#: The coarse CVSS 4 estimate's factors.
CVSS4 = {"AV": {"N": 1.0, "A": 0.85, "L": 0.7, "P": 0.5}, "AC": {"L": 1.0, "H": 0.75}}


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    own = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    found = F.try_element_at(own, key)
    return found if default is None else F.coalesce(found, default)


def parse_severity(text: Column) -> Column:
    """Any tool's word for a severity; null and unheard-of words are unknown."""
    return lookup(SYNONYMS, F.lower(F.trim(F.coalesce(text.cast("string"), F.lit("")))), F.lit("unknown"))


def from_cvss(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("info")


def severity_rank(severity: Column) -> Column:
    return lookup(RANK, severity, F.lit(0))


def severity_name(rank: Column) -> Column:
    return lookup({v: k for k, v in RANK.items()}, rank)


def known_or_unknown(severity: Column) -> Column:
    return F.when(severity.isin(*SEVERITIES), severity).otherwise("unknown")


def tool_level(tool: str, level: Column, fallback: Column | None = None) -> Column:
    return lookup(TOOL_LEVELS[tool], F.upper(F.coalesce(level.cast("string"), F.lit(""))), fallback if fallback is not None else F.lit("unknown"))


def metric(vector: Column, name: str) -> Column:
    """The value of a metric in CVSS:x/AV:N/...; of a repeated metric the last one counts; null if absent."""
    found = F.regexp_extract_all(vector, F.lit(f"/{name}:([^/]*)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def round_up(x: Column) -> Column:
    """Up to the next tenth, on the binary value."""
    return F.ceil(x * F.lit(10.0)).cast("double") / F.lit(10.0)


def cvss3(vector: Column) -> Column:
    """Base score of a CVSS 3 vector; null if a metric is missing or unheard-of."""
    changed = F.coalesce(metric(vector, "S") == "C", F.lit(False))
    av, ac, ui = (lookup(CVSS3[k], metric(vector, k)) for k in ("AV", "AC", "UI"))
    pr = F.when(changed, lookup(CVSS3["PR_CHANGED"], metric(vector, "PR"))).otherwise(lookup(CVSS3["PR"], metric(vector, "PR")))
    left = [F.lit(1.0) - lookup(CVSS3["IMPACT"], metric(vector, k)) for k in ("C", "I", "A")]
    base = F.lit(1.0) - reduce(lambda a, b: a * b, left)
    impact = F.when(changed, F.lit(7.52) * (base - 0.029) - F.lit(3.25) * F.pow(base - 0.02, F.lit(15.0))).otherwise(F.lit(6.42) * base)
    reach = F.lit(8.22) * av * ac * pr * ui
    raw = F.least(F.when(changed, F.lit(1.08) * (impact + reach)).otherwise(impact + reach), F.lit(10.0))
    whole = impact.isNotNull() & reach.isNotNull()
    return F.when(whole & (impact <= 0), F.lit(0.0)).when(whole, round_up(raw))


def cvss4(vector: Column) -> Column:
    """A coarse score of a CVSS 4 vector: worst impact times ease of attack."""
    impact = [lookup(CVSS3["IMPACT"], metric(vector, k)) for k in ("VC", "VI", "VA")]
    worst = F.when(reduce(lambda a, b: a & b, (x.isNotNull() for x in impact)), F.greatest(*impact))
    av = F.when(metric(vector, "AV").isNull(), F.lit(1.0)).otherwise(lookup(CVSS4["AV"], metric(vector, "AV"), F.lit(0.7)))
    ac = F.when(metric(vector, "AC").isNull(), F.lit(1.0)).otherwise(lookup(CVSS4["AC"], metric(vector, "AC"), F.lit(0.85)))
    return F.when(worst == 0, F.lit(0.0)).when(worst.isNotNull(), F.bround(F.least(F.lit(10.0), worst * av * ac * F.lit(17.5)), 1))


def osv_score(kind: Column, score: Column) -> Column:
    """One severity entry of an OSV record as a number, if it is one."""
    bare = F.regexp_extract(score, r"^\s*(\d+(?:\.\d+)?)\s*$", 1)
    return F.when(score.startswith("CVSS:3"), cvss3(score)).when(score.startswith("CVSS:4"), cvss4(score)).when(F.upper(kind).startswith("CVSS") & (bare != ""), bare.try_cast("double"))


def osv_severity(entries: Column, database_severity: Column) -> Column:
    """entries: array<struct<type, score>>. A numeric score decides, else the database's word, else a word among the scores."""
    best = osv_best(entries)
    words = F.filter(F.transform(F.coalesce(entries, F.array().cast("array<struct<type:string,score:string>>")), lambda e: F.when(~F.upper(e["score"]).startswith("CVSS:"), parse_severity(e["score"]))), lambda w: w.isNotNull() & (w != "unknown"))
    word = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("unknown"))
    return F.when(best.isNotNull(), from_cvss(best)).when(F.coalesce(database_severity, F.lit("")) != "", parse_severity(database_severity)).otherwise(word)


def osv_best(entries: Column) -> Column:
    return F.array_max(F.transform(entries, lambda e: osv_score(e["type"], e["score"])))
