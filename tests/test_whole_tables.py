"""Registered queries read whole tables: the smallest scale that has more rows than the old cuts, against DuckDB over all rows."""

from pathlib import Path

import pytest

from compare import rows
from hullscope import plans
from hullscope.plans import views

QUERIES, _ = plans.load()
AT = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck10():
    if not AT.exists():
        pytest.skip("no driver tables here")
    import duckdb

    con = duckdb.connect()
    for p in AT.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_image_counts(spark, duck10):
    images = duck10.execute("SELECT count(*) FROM orders").fetchone()[0]
    vulnerable = duck10.execute(f"SELECT count(DISTINCT f.image) FROM ({views.SQL['findings']}) f JOIN orders ON o_orderkey = f.image WHERE category = 'pkg-vuln'").fetchone()[0]
    per_image = QUERIES["per_image_counts"](spark, str(AT))
    assert per_image.count() == per_image.select("image").distinct().count() == images > 2500
    worst = {r.worst: r.n for r in QUERIES["worst_severity_histogram"](spark, str(AT)).collect()}
    assert sum(worst.values()) == images and worst["none"] == images - vulnerable
    shares = {r.what: (r.n, r.pct) for r in QUERIES["prevalence"](spark, str(AT)).collect()}
    assert shares["vulnerability"] == (vulnerable, pytest.approx(vulnerable * 100 / images, abs=1e-6))


def test_every_image_has_its_layer_chain(spark, sf_dir, duck):
    from hashlib import sha256

    def sha(x):
        return sha256(x.encode()).hexdigest()

    want, image, before = [], None, ""
    for key, part in duck.execute("SELECT l_orderkey, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey").fetchall():
        pos, before = (pos + 1, sha(before + sha(str(part)))) if key == image else (1, sha(sha(str(part))))
        image = key
        want.append((key, pos, before))
    assert max(want)[0] > 500
    assert sorted(map(tuple, QUERIES["layer_chain"](spark, sf_dir).select("image", "pos", "id").collect())) == want


def test_queue_takes_all_jobs_and_targets(spark, sf_dir, duck):
    jobs, parts = (duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("orders", "part"))
    failed = {r.id: r.status for r in QUERIES["queue_fail_retry"](spark, sf_dir).collect()}
    assert len(failed) == jobs > 500 and max(failed) > 500
    assert all(v == ("failed" if k % 4 >= 3 else "pending") for k, v in failed.items() if k % 5 == 0)
    seeded = [r.image for r in QUERIES["queue_seed"](spark, sf_dir).collect()]
    assert len(seeded) == len(set(seeded)) == jobs + parts


def test_merged_order_and_propagation_are_whole(spark, sf_dir, duck):
    assert QUERIES["merged_order"](spark, str(AT)).count() > 400
    starts = duck.execute("SELECT 'CVE-' || p_size, count(*) FROM part GROUP BY 1").fetchall()
    assert {r.source: r.direct for r in QUERIES["cve_propagation"](spark, sf_dir).collect()} == dict(starts)
