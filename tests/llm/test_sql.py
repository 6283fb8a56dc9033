"""Corpus queries against their SQL, where SQL can express them."""

import pytest

from compare import rows
from hullscope.llm import queries as corpus

QUERIES, SQL = corpus.queries(), corpus.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_every_operator_is_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []


#: Of these, the rows that repeat a document become one; the others keep every row.
ONE_A_DOCUMENT = {"op2_exact_dedup"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op") and n != "op6_url_filters"))
def test_odd_and_empty_tables(odd, nothing, name):
    from hullscope.llm import brown_lm, exact_dedup, language_id, mixing, pieces, quality_rules, secret_scan, simhash, weak_labels

    fn = {"op1": quality_rules.op1_rows, "op2": exact_dedup.op2_rows, "op3": language_id.op3_rows, "op4": simhash.op4_rows, "op5": pieces.op5_rows, "op7": weak_labels.op7_rows, "op8": secret_scan.op8_rows, "op9": mixing.op9_rows, "op10": brown_lm.op10_rows}[name.split("_")[0]]
    assert fn(odd).count() == (8 if name in ONE_A_DOCUMENT else 9)
    assert fn(nothing).count() == 0 and fn(nothing).columns == fn(odd).columns
