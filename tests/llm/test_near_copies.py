"""Near copies against the Jaccard similarity of all pairs."""

import math
from itertools import combinations
from random import Random

import numpy as np
import pytest

import corpus_pipeline as cp
from hullscope.llm import near_copies


def brute(texts):
    """By index: the least index that pairs of 0.8 or more connect."""

    def shingles(t):
        words = (t or "").lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def made():
    draw = Random(3)
    out = [None, "", "three small words", "Three  small words", "one two three four five"]
    for k in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(60 + 20 * k)]
        out.append(" ".join(words))
        for changes in (1, 2, 3, 5, 9):  # similarities on both sides of 0.8
            copy = list(words)
            for i in draw.sample(range(len(copy)), changes):
                copy[i] = "changed"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [4096, 4])
def test_stage_drops_exactly_the_near_copies(spark, monkeypatch, block):
    """With buckets whole, and with nearly all of them cut."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = made()
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    label = brute(texts)
    assert 5 < len(texts) - len(set(label)) < len(texts) - 5
    assert sorted(r.doc_id for r in cp.near(spark, docs, "").collect()) == sorted(set(label))


def test_driver_documents(spark, docs):
    rows = sorted(docs.where("doc_id IS NOT NULL").collect(), key=lambda r: r.doc_id)
    label = brute([r.text for r in rows])
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == sorted(rows[i].doc_id for i in set(label))


def test_ids(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text), (7, text + " end"), (7, text + " end"), (9, "end " + text), (None, "alone")]
    out = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(7, text + " end"), (7, text + " end"), (None, "alone")], key=repr)


def test_plans_keep_the_recall():
    """Thresholds of any plan catch a pair of 0.8 with the stated probability; partitions don't share bits."""
    rng, p = np.random.default_rng(1), near_copies.agreement()
    sample = rng.integers(-30, 31, (300, near_copies.DIMS))
    for rows in (1, 100, 10**5, 10**8):
        plan = near_copies.planned(sample, rows)
        caught = [p**plan.width, p**plan.width + plan.width * (1 - p) * p ** (plan.width - 1)]
        assert math.prod(1 - caught[t] for _, t in plan.parts) <= 1 - near_copies.RECALL
        bits = [b for own, _ in plan.parts for b in own]
        assert len(bits) == len(set(bits)) and all(len(own) == plan.width for own, _ in plan.parts)


def test_pairs_of_exactly_this_similarity_meet():
    """Sets of 360 shingles that share 320 (Jaccard 0.8): share a bucket, and pass the sketch."""
    rng = np.random.default_rng(2)
    plan = near_copies.planned(rng.integers(-30, 31, (300, near_copies.DIMS)), 10**6)
    found = 0
    for _ in range(300):
        h = rng.integers(0, 2**64, 400, dtype=np.uint64)
        x, y = (near_copies.vector(s) for s in (h[:360], h[40:]))
        keys = plan.keys(np.stack([x, y]))
        found += bool(set(keys[0].tolist()) & set(keys[1].tolist())) and ((x > 0) != (y > 0)).sum() <= near_copies.SKETCH
    assert found >= 294


def test_thresholds_of_one_meet_one_bit_apart():
    rng = np.random.default_rng(3)
    plan = near_copies.Plan(4, ((tuple(range(4)), 1), (tuple(range(4, 8)), 0)))
    own = rng.integers(-30, 31, (60, near_copies.DIMS))
    bits = own @ near_copies.rotations(8).T > 0
    keys = [set(k.tolist()) for k in plan.keys(own)]
    for i in range(60):
        for j in range(i):
            near = (bits[i] != bits[j])
            if near[:4].sum() <= 1 or not near[4:].any():
                assert keys[i] & keys[j]
