"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for every document and keeps the measurements and one integer with a bit for each
rule that failed. Policies are versioned masks over these bits: applying one (``apply_policy``), comparing two or
asking what each rule alone removes (``ablations``) is bitwise arithmetic on the ledger and never reads a text again.

Defined cases: a null text counts as empty (no words, so ``few_words`` fails). Repeated rows give repeated rows. An
empty table gives an empty ledger. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SYMBOLS = b"#*$%&|<>"
_SEPARATORS = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: Bits never change their meaning; a new rule takes the next bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule(3, "symbols", "10 * n_symbols > n_words"),
    Rule(4, "repeated_lines", "n_lines >= 10 AND 2 * n_dup_lines > n_lines"),
    Rule(5, "shouting", "n_upper > n_lower"),
    Rule(6, "exclamation", "10 * n_exclaims > n_words"),
)

#: Versioned policies: the mask of the rules that a document must not fail.
POLICIES = {"base": 0b0000011, "v1": 0b0011111, "v2": 0b1111111}

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_lower bigint, n_exclaims bigint"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    found = Counter(windows)
    if len(found) == n:
        return 0
    hit = np.fromiter((found[w] > 1 for w in windows), bool, n)
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= hit
    return int(covered.sum())


def measure(texts: list[bytes | None]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(9)]
    for raw in texts:
        b = raw or b""
        words = b.split()
        lines = [x for x in b.split(b"\n") if x.strip(_SEPARATORS)]
        inked = b.translate(None, _SEPARATORS)
        chars = len(inked) if inked.isascii() else len(inked.decode("utf-8", "replace"))
        row = (len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(b) - len(b.translate(None, _UPPER)), len(b) - len(b.translate(None, _LOWER)), b.count(b"!"))
        for col, x in zip(out, row, strict=True):
            col.append(x)
    return out


def fail_bits(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL that Spark and DuckDB both take."""
    return " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in rules)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The key, the measurements and fail_bits (bigint) of every row; one pass, no shuffle."""
    return map_texts(docs, [F.col(key)], measure, MEASURES, text).withColumn("fail_bits", F.expr(fail_bits(rules)).cast("bigint"))


def apply_policy(rows: DataFrame, mask: int, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")) == 0)


def ablations(rows: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy does: rows that fail it, rows that only it removes, rows kept with and without it.

    Works on counts by bitmask: at most 2^rules rows leave the first aggregation, whatever the input has.
    """
    own = F.array(*(F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("rule_mask")) for r in rules if mask >> r.bit & 1))
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    joined = counts.select("fail_bits", "n", F.inline(own))
    tally = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    return joined.groupBy("bit", "rule").agg(
        tally(hit.bitwiseAND(F.col("rule_mask")) != 0).alias("n_failed"),
        tally(hit == F.col("rule_mask")).alias("n_only_this"),
        tally(hit == 0).alias("n_kept"),
        tally((hit == 0) | (hit == F.col("rule_mask"))).alias("n_kept_without"),
    )


def op1_rows(docs: DataFrame, policy: str = "v2") -> DataFrame:
    rows = ledger(docs).withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"]).cast("bigint")) != 0)
    return apply_policy(rows, POLICIES[policy]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


_WORDS_SQL = r"coalesce(text, '') AS body"

LEDGER_SQL = rf"""
t AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(body, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
g AS (SELECT rid, i, word AS a, lead(word, 1) OVER (PARTITION BY rid ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM w),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT i + d.k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) d(k) WHERE n > 1 GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM t),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
wc AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
m AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  length(regexp_replace(body, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(body, '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(body, '[^!]', '', 'g')) AS n_exclaims
  FROM t LEFT JOIN wc USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN cov USING (rid)),
led AS (SELECT *, CAST({fail_bits()} AS BIGINT) AS fail_bits FROM m)
"""

OP1_SQL = f"""WITH {LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {POLICIES["base"]}) <> 0 AS base_failed, (fail_bits & {POLICIES["v2"]}) = 0 AS kept, fail_bits FROM led"""

ABLATION_SQL = f"""WITH {LEDGER_SQL},
ru AS (SELECT * FROM (VALUES {", ".join(f"({r.bit}, '{r.name}', {1 << r.bit})" for r in RULES)}) x(bit, rule, rule_mask))
SELECT CAST(bit AS INTEGER) AS bit, rule, CAST(count(*) FILTER ((fail_bits & {POLICIES["v2"]} & rule_mask) <> 0) AS BIGINT) AS n_failed,
CAST(count(*) FILTER ((fail_bits & {POLICIES["v2"]}) = rule_mask) AS BIGINT) AS n_only_this, CAST(count(*) FILTER ((fail_bits & {POLICIES["v2"]}) = 0) AS BIGINT) AS n_kept,
CAST(count(*) FILTER ((fail_bits & {POLICIES["v2"]}) IN (0, rule_mask)) AS BIGINT) AS n_kept_without
FROM led, ru GROUP BY bit, rule"""
