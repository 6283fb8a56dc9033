"""Each stage of the pipeline on its own input, against a brute-force version where there is one."""

from collections import Counter

import corpus_pipeline as cp
from hullscope.llm import mixing
from test_near_copies import brute


def test_stages(spark, sf_dir, docs, tmp_path):
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    rows, before = docs, None
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, rows, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        before, rows = rows, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert rows.columns == docs.columns
        a, b = before.toPandas(), rows.toPandas()
        if name == "exact dedup":
            assert sorted(b.doc_id) == sorted(a.groupby("text").doc_id.max())
        if name == "SimHash near-dedup":
            # five words and a similarity of 0.8, not op4's three words and two bits
            ids = sorted(a.doc_id)
            text = dict(zip(a.doc_id, a.text))
            assert sorted(b.doc_id) == sorted(ids[i] for i in set(brute([text[k] for k in ids])))
        if name == "mixing":
            assert set(b.doc_id) <= set(a.doc_id) and b.doc_id.value_counts().max() <= 2
    assert rows.where("NOT round_trip").count() == 0


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_empty_tables(spark, sf_dir, nothing):
    for _, stage in cp.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0


def test_odd_rows(spark, sf_dir, odd):
    """Nulls, empty texts, a long one, equal rows and clashing columns, stage by stage."""
    kept = ids(cp.quality(spark, odd, sf_dir))
    assert not {1, 2, 3} & set(kept)
    out = cp.exact(spark, odd, sf_dir)
    assert out.columns == odd.columns and ids(out) == [2, 3, 5, 6, 7, None]  # null and empty are equal; of 4, 5 and 5 one row of 5
    out = cp.near(spark, odd, sf_dir)
    assert out.columns == odd.columns and ids(out) == [1, 4, 6, 7, None]  # 1, 2 and 3 have no words
    drawn = Counter()
    for r in mixing.drawn(odd).collect():
        drawn[r.doc_id] += r.copies
    out = cp.mix(spark, odd, sf_dir)
    assert out.columns == odd.columns and Counter(ids(out)) == +drawn
    rows = cp.tokens(spark, odd, sf_dir).collect()
    assert len(rows) == 9 and all(r.round_trip for r in rows) and {r.doc_id: r.n_tokens for r in rows}[1] == 0
