"""Corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from hullscope.llm import brown_lm, components, exact_dedup, language_id, mixing, pieces, quality_rules, secret_scan, simhash, url_filters, weak_labels

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# quality rules


def test_repeated_words_by_hand():
    assert quality_rules.repeated_words(b"a b c a b c x".split()) == 6 and quality_rules.repeated_words(b"a a a a".split()) == 4 and quality_rules.repeated_words(b"a b c".split()) == 0


def test_policies_and_ablations(docs):
    led = quality_rules.ledger(docs).cache()
    mask = quality_rules.POLICIES["v2"]
    kept = {v: quality_rules.apply_policy(led, m).where("kept").count() for v, m in quality_rules.POLICIES.items()}
    assert kept["v2"] <= kept["v1"] <= kept["base"]
    for r in quality_rules.ablations(led, mask).collect():
        assert r.n_kept == kept["v2"] and r.n_kept_without == quality_rules.apply_policy(led, mask & ~(1 << r.bit)).where("kept").count()


# exact dedup


def test_bloom_merge_misses_no_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    h[2500:3000] = h[:500]
    bits = exact_dedup.bits_for(len(h))
    parts = []
    for own in np.array_split(h, 7):
        seen, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        exact_dedup.add(seen, twice, own, bits)
        parts.append((seen, twice))
    seen, twice = parts[0]
    for s, t in parts[1:]:
        seen, twice = seen | s, twice | t | (seen & s)
    flags = exact_dedup.flagged(twice, h, bits)
    assert flags[:500].all() and flags[2500:3000].all() and flags.mean() < 0.25


def test_few_single_rows_are_flagged(spark):
    """Each shard's filter has its own size: singles are flagged at one rate, whatever the number of rows."""
    h = np.random.default_rng(6).integers(-(2**63), 2**63, 200_000)
    df = spark.createDataFrame(pd.DataFrame({"h": np.concatenate([h, h[:500]])}), "h long").repartition(5)
    found = {r.h for r in exact_dedup.repeated_hashes(df).collect()}
    assert set(h[:500].tolist()) <= found and len(found) < 500 + 0.01 * len(h)


def test_repeated_hashes_beyond_the_broadcast_bound(docs, monkeypatch):
    want = sorted(map(tuple, exact_dedup.op2_rows(docs).collect()))
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 0)
    assert sorted(map(tuple, exact_dedup.op2_rows(docs).collect())) == want
    assert exact_dedup.dedup(docs).count() == sum(r[3] for r in want)


def test_repeated_rows_and_null_ids(spark, duck):
    rows = [(5, "same"), (5, "same"), (4, "same"), (None, "same"), (7, "same"), (None, "alone"), (None, "twice"), (None, "twice"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.op2_rows(df).collect()}
    assert got == {(5, 7, 5, False), (4, 7, 5, False), (None, 7, 5, False), (7, 7, 5, True), (None, None, 1, True), (None, None, 2, True), (1, 2, 2, False), (2, 2, 2, True)}
    import duckdb

    con = duckdb.connect()
    pdf = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con.register("documents", pdf)
    assert sorted(map(repr, con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.OP2_SQL})").fetchall())) == sorted(repr(tuple(r)) for r in exact_dedup.op2_rows(df).collect())
    assert sorted(map(repr, map(tuple, exact_dedup.dedup(df).collect()))) == sorted(map(repr, [(7, "same"), (None, "alone"), (None, "twice"), (2, "")]))


def test_survivor_of_rows_that_differ_elsewhere(spark):
    rows = [(1, "t", "b"), (1, "t", "a"), (1, "t", None)]
    got = {exact_dedup.dedup(spark.createDataFrame(o, "doc_id long, text string, lang string")).first().lang for o in (rows, rows[::-1])}
    assert len(got) == 1


def test_dedup_keeps_the_largest_id(odd, docs, texts):
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("text = 'same text here for you'").collect()) == [5]
    best = {}
    for k, t in texts.items():
        best[t] = max(k, best.get(t, -1))
    assert sorted(r.doc_id for r in exact_dedup.dedup(docs).select("doc_id").collect()) == sorted(best.values())


# language


def test_kneser_ney_sums_to_one():
    m = language_id.kneser_ney({"x": {"abba": 3, "abc": 1}, "y": {"cab": 2}})
    chars = ["a", "b", "c", chr(language_id.EOS), "?"]
    for context in ("abb", chr(2) * 3, chr(2) + "ab", "zzz"):
        codes = [np.array(list(map(ord, context + c)), np.uint32) for c in chars]
        p = np.exp(np.concatenate([m.places(c, np.array([3])) for c in codes])).sum(axis=0)
        assert np.allclose(p, 1, atol=1e-5), context


def slow_kneser_ney(words, chars, w, i, order=4):
    """P(w[i] | w[i-order+1..i-1]) by the textbook recursion over plain counts; w is framed, words: framed word -> count."""
    grams = {order: Counter()}
    for s, n in words.items():
        for j in range(order - 1, len(s)):
            grams[order][s[j - order + 1 : j + 1]] += n
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def p(k, context, c):
        if k == 0:
            return 1 / chars
        own = {g[-1]: n for g, n in grams[k].items() if g[:-1] == context}
        lower = p(k - 1, context[1:], c)
        if not own:
            return lower
        ones, twos = (sum(n == x for n in grams[k].values()) for x in (1, 2))
        d = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))
        return max(own.get(c, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * lower

    return p(order, w[i - order + 1 : i], w[i])


def test_kneser_ney_equals_the_recursion():
    counts = {"x": {"abba": 3, "abc": 1, "bab": 2, "caab": 1}, "y": {"cab": 2, "a": 5, "cc": 1}}
    m = language_id.kneser_ney(counts)
    chars = len({c for own in counts.values() for w in own for c in w}) + 2  # the end, and an unseen one
    for word in ("abba", "cab", "bcaz", "a", "zz"):
        framed = chr(2) * 3 + word + chr(3)
        for j, lang in enumerate(m.languages):
            own = {chr(2) * 3 + w + chr(3): n for w, n in counts[lang].items()}
            want = sum(math.log(slow_kneser_ney(own, chars, framed, i)) for i in range(3, len(framed)))
            assert math.isclose(m.words([word])[0, j], want, rel_tol=1e-4), (word, lang)


def test_every_labelled_language_is_learned(spark):
    """Languages of 1 to 5 documents, of equal rows and of null keys."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(20):
        for i in range(1 + k % 5):
            rows.append((1000 * k + i, " ".join(letters[k] * 3 + letters[(k + j) % 26] for j in range(3, 9 + i)), f"l{k:02}"))
    rows += [(None, "жук жил", "nul")] * 300 + [(7, "12 34", "digits")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True), per_language=100)
    assert set(model.languages) == {r[2] for r in rows} - {"digits"}
    got = language_id.identify(df, model, [F.col("lang")]).collect()
    assert all(r.lang_pred == (r.lang if r.lang != "digits" else "und") for r in got)


def test_language_accuracy_and_letters(docs, odd):
    got = language_id.op3_rows(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out))
    und = {r.doc_id for r in language_id.op3_rows(odd).where("lang_pred = 'und'").collect()}
    assert {1, 2, 3} <= und and not {4, 5, 6} & und


# simhash


def slow_fingerprint(text):
    words = (text or "").encode().translate(LOW).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_components_equal_brute_force(docs, texts):
    fps = {k: slow_fingerprint(t) for k, t in texts.items()}
    ids = sorted(fps)
    label = simhash.all_pairs_components([fps[i] for i in ids])
    want = {i: (f"{fps[i]:016x}", ids[c]) for i, c in zip(ids, label)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_rows(docs).collect()} == want


@pytest.mark.parametrize("bucket", [400, 3])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, bucket):
    """A ball of close fingerprints, chains of two-bit steps and single ones, with the bucket bound at work."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))} | {int(x) for x in rng.integers(0, 2**63, 300)}
    chain = int(rng.integers(0, 2**63))
    for i in range(0, 60, 2):
        chain ^= 3 << i
        fps.add(chain)
    fps |= {0, 2**64 - 1, 2**64 - 4, 2**63, 2**63 + 1}
    ordered = sorted(fps)
    label = simhash.all_pairs_components(ordered)
    want = {}
    for f, c in zip(ordered, label):
        want.setdefault(c, set()).add(f)
    df = spark.createDataFrame([(simhash.signed(f),) for f in ordered], "fp long")
    comp = {r.node: r.component for r in components.components(simhash.links(df)).collect()}
    got = {}
    for f in ordered:
        got.setdefault(comp.get(simhash.signed(f), simhash.signed(f)), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_plan_covers_the_distance():
    rng = np.random.default_rng(5)
    for rows in (100, 10**6, 10**10):
        chosen = simhash.plan(rng.integers(0, 2**64, 500, dtype=np.uint64), rows)
        # thresholds t over disjoint masks find every pair within two bits iff sum(t + 1) > 2
        assert sum(t + 1 for _, t in chosen) == 3
        masks = [m for m, _ in chosen]
        assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1000), (300, 301)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[301] == 300 and 1000 not in got


# tokens


@pytest.fixture(scope="module")
def transducer():
    try:
        with open(pieces.MODEL_FILE, "rb") as f:
            return pieces.Transducer(f.read())
    except FileNotFoundError:
        pytest.skip("no vocabulary file here")


def test_encoding_equals_the_library(transducer, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    own = [*texts.values(), "", " ", "  a  b   c", "\n\n x\ty", "日本語 テスト \U0001f642", "<s> </s> <0x0A>", "a" * 60, "    " * 20 + "def f():", "\x00\x01", "ﬁ ½ é"]
    assert transducer.encode_many(own) == lib.encode(own)
    assert all(transducer.decode(ids) == t for t, ids in zip(own, transducer.encode_many(own)))


def test_array_paths_equal_scalar_paths(transducer):
    words = [pieces.SPACE + w for w in ("the", "erntionly", "straße", "élan.", "x" * 24, "Ünder,", "a", "10,000.5")]
    assert [np.frombuffer(x, np.int32).tolist() for x in transducer.merge_paths(words)] == [transducer.merge_path(w) for w in words]
    assert transducer.merge_paths(["a\U000130a0"])[0] is None


def test_unigram_path_is_the_cheapest():
    vocabulary = [("<unk>", 0.0, 2), ("a", -2.0, 1), ("b", -2.1, 1), ("ab", -3.0, 1), ("ba", -2.5, 1), ("aba", -9.0, 1)]
    t = pieces.Transducer.of(vocabulary, pieces.UNIGRAM, {3: 0, 4: 0})
    score = {p: s for p, s, k in vocabulary if k == 1}

    def best(s):
        if not s:
            return 0.0
        return max(score[s[:n]] + best(s[n:]) for n in (1, 2, 3) if s[:n] in score)

    for s in ("aba", "abab", "baab", "bbb"):
        assert math.isclose(sum(vocabulary[i][1] for i in t.encode(s)), best(s))


def test_ids_round_trip_in_spark(docs, transducer):
    rows = pieces.op5_rows(docs)
    assert rows.where("NOT round_trip OR size(ids) <> n_tokens").count() == 0
    back = pieces.decoded(rows, [F.col("doc_id")]).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert back.where("text <> t").count() == 0


# lists in time


def test_intervals_and_keys(spark):
    log = spark.createDataFrame([("d:x.com", "add", "2024-01-05"), ("d:x.com", "remove", "2024-02-01"), ("d:x.com", "add", "2024-03-01"), ("p:y.org/a", "add", "2024-01-01"), ("d:y.org", "add", "2024-01-01"), ("d:y.org", "remove", "2024-01-01"), (None, "add", "2024-01-01"), ("d:z.net", None, "2024-01-01")], "key string, action string, day string").withColumn("day", F.col("day").cast("date"))
    captures = [(1, "http://a.x.com/p", "2024-01-04"), (2, "http://a.x.com/p", "2024-01-05"), (3, "https://u@X.COM.:80/", "2024-01-31"), (4, "http://x.com", "2024-02-01"), (5, "http://x.com", "2025-01-01"), (6, "http://y.org/a/b?c", "2024-05-01"), (7, "http://y.org/b", "2024-05-01"), (8, None, "2024-01-01"), (9, "no url", None), (10, "http://notx.com/", "2024-01-10")]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")).withColumn("key", F.lit("clash"))
    got = {r.page_id: r.blocked for r in url_filters.judged(df, log).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True, 7: False, 8: False, 9: False, 10: False}


def test_list_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {tuple(r) for r in url_filters.op6_rows(pages).collect()}
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", -1)
    assert {tuple(r) for r in url_filters.op6_rows(pages).collect()} == want
    assert url_filters.op6_rows(pages.limit(0)).count() == 0


def test_url_filters_stay_in_the_jvm(spark, sf_dir):
    plan = url_filters.op6_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# weak labels


def test_classifier_against_labels(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    got = weak_labels.op7_rows(docs).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.15


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    bad_rate = {1: 0.01, 0: 0.4}
    patterns = Counter()
    for g in good:
        patterns["".join("2" if rng.random() < 0.2 else "0" if rng.random() < bad_rate[int(g)] else "1" for _ in weak_labels.LABELLERS)] += 1
    prior, table = weak_labels.em(patterns)
    assert abs(prior - 0.8) < 0.05 and np.abs(table[:, 0, 0] - 0.4).max() < 0.1 and table[:, 1, 0].max() < 0.05


def test_scores_equal_brute_force(docs, texts):
    """Plain loops: votes, expectation-maximisation, features as dictionaries, and gradient steps over all documents."""
    wl = weak_labels
    ids = sorted(texts)
    bodies = [texts[i].encode() for i in ids]
    votes = [[f.vote(wl.signals(b, b.split()), len(b.split())) if b.split() else 2 for f in wl.LABELLERS] for b in bodies]
    prior, rate = 0.85, [{0: wl.START[0], 1: wl.START[1]} for _ in wl.LABELLERS]

    def good(v):
        odds = math.log(prior / (1 - prior))
        for r, x in zip(rate, v):
            odds += math.log(r[1] / r[0]) if x == 0 else math.log((1 - r[1]) / (1 - r[0])) if x == 1 else 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))

    for _ in range(100):
        g, old = [good(v) for v in votes], prior
        prior = min(0.98, max(0.02, (sum(g) + 0.85 * wl.BELIEF) / (len(g) + wl.BELIEF)))
        for j in range(len(rate)):
            rate[j] = {k: (sum(w for w, v in zip(own, votes) if v[j] == 0) + wl.BELIEF * wl.START[k]) / (sum(w for w, v in zip(own, votes) if v[j] != 2) + wl.BELIEF) for k, own in ((1, g), (0, [1 - w for w in g]))}
        if abs(prior - old) < 1e-9:
            break
    target = [good(v) for v in votes]
    rows = []
    for b in bodies:
        own, words = {}, b.split()
        for w in words:
            shape = wl._RUNS.sub(rb"\1", w.translate(wl._SHAPE))
            for k in (wl.bucket(b"word:", w), wl.bucket(b"shape:", shape)):
                own[k] = own.get(k, 0.0) + 1 / max(wl.LEAST_WORDS, len(words))
        for k, s in enumerate(wl.signals(b, words)):
            at = wl.bucket(b"signal%d:" % k, b"%d" % min(9, int(s * 10)))
            own[at] = own.get(at, 0.0) + 0.3
        rows.append((np.array(list(own)), np.array(list(own.values()))))
    w, b, g2, b2 = np.zeros(1 << wl.HASH_BITS), 0.0, np.full(1 << wl.HASH_BITS, 1e-8), 1e-8
    for _ in range(80):
        grad, gb = 1e-5 * w, 0.0
        for (at, value), y in zip(rows, target):
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, w[at] @ value + b)))) - y) / len(rows)
            grad[at] += error * value
            gb += error
        g2 += grad**2
        b2 += gb**2
        w, b = w - 0.5 * grad / np.sqrt(g2), b - 0.5 * gb / math.sqrt(b2)
    want = {i: 1 / (1 + math.exp(-(w[at] @ value + b))) if body.split() else 0.0 for i, body, (at, value) in zip(ids, bodies, rows)}
    for r in weak_labels.op7_rows(docs).collect():
        assert math.isclose(r.score, want[r.doc_id], abs_tol=1e-4) and r.kept == (want[r.doc_id] >= 0.5), r.doc_id


def test_empty_texts_score_nothing(odd):
    got = {r.doc_id: r.score for r in weak_labels.op7_rows(odd).collect()}
    assert got[1] == got[2] == got[3] == 0.0


# secrets


def slow_base(text):
    out = []
    for kind, pattern, group, least in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_base_spans_equal_plain_patterns(docs, texts):
    more = {10**6 + i: t for i, t in enumerate(["é token: \"abcdefgh\" Api_Key=12345678 apikey='short'", "AKIA" + "A" * 12 + " xAKIA123456789012é", "f" * 40 + "g " + "0" * 31, "password = \n12345678", "a" * 32 + " é " + "a" * 32 + "x" + "b" * 33, "SECRET\"   :   'aaaa.bbbb=cc" ])}
    scanner = secret_scan.default_scanner()
    for k, t in {**texts, **more}.items():
        base, every = secret_scan.spans(t.encode(), scanner)
        assert secret_scan.shown(base) == slow_base(t), k
        assert set(base) <= set(every)


def test_automata_know_their_formats():
    scanner = secret_scan.default_scanner()
    for kind in secret_scan.FORMATS:
        new = secret_scan.labelled(kind, 200, seed=99)
        assert np.mean([scanner.kind_of(s)[0] == kind for s in new]) > 0.9, kind
    assert not any(scanner.kind_of(w)[0] for w in ("internationalization12", "2024-01-01-some-title-here", "ghp_short1", "0123456789abcdef0123456789abcdef01234567", "ghp_" + "a1" * 19))


def test_credentials_inside_longer_runs():
    scanner = secret_scan.default_scanner()
    draw = np.random.default_rng(8)
    some = lambda n: "".join(draw.choice(list(secret_scan.ALNUM), n))
    gh, google = f"ghp_{some(36)}", f"AIza{some(35)}"
    for before, s, after, kind in [("GITHUB_PAT=", gh, "", "github"), ("export GH=", gh, ";", "github"), ("é path/", gh, "/x", "github"), ("http://h/p?k=", google, "&b", "google_api"), *[("x ", f"eyJ{some(17)}.eyJ{some(n)}.{some(m)}", " y", "jwt") for n, m in ((60, 43), (120, 43), (300, 43), (300, 342))]]:
        assert secret_scan.spans((before + s + after).encode(), scanner) == ([], [(len(before), len(before) + len(s), kind)]), (before, s)
    assert secret_scan.spans(f"{gh}a".encode(), scanner)[1] == []


def test_found_spans_equal_brute_force(texts):
    """Every start after a break, every end before one, each scored on its own."""
    scanner = secret_scan.default_scanner()

    def slow(run):
        found = {}
        for a in (i for i in range(len(run)) if i == 0 or not run[i - 1].isalnum()):
            for b in (j for j in range(a + 1, len(run) + 1) if j == len(run) or not run[j].isalnum()):
                for k, x in scanner.automata.items():
                    if (score := x.bits(run[a:b])) >= scanner.thresholds[k]:
                        found[a, k] = (a, b, k, score)
        out = []
        for a, b, k, _ in sorted(found.values(), key=lambda x: (x[0], -x[1], -x[3], x[2])):
            if all(b <= s or e <= a for s, e, _ in out):
                out.append((a, b, k))
        return sorted(out)

    made = [f"A={c}/{d}.{c}" for k in secret_scan.FORMATS for c, d in zip(secret_scan.labelled(k, 4, 3), secret_scan.labelled("github", 4, 5))]
    some = 0
    for t in [*texts.values(), " ".join(made)]:
        every = secret_scan.spans((t or "").encode(), scanner)[1]
        own = [(s, e, k) for s, e, k in every if k not in secret_scan.BASE_KINDS]
        base = [x for x in every if x[2] in secret_scan.BASE_KINDS]
        want = [(m.start() + a, m.start() + b, k) for m in re.finditer("[A-Za-z0-9+/_=.-]{20,}", t or "") for a, b, k in slow(m[0])]
        assert own == sorted(x for x in want if not any(x[0] < e and s < x[1] for s, e, _ in base))
        some += len(own)
    assert some > 20


def test_scan_time_is_linear():
    import time

    scanner = secret_scan.default_scanner()
    lines = "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(40_000)).encode()
    began = time.perf_counter()
    assert len(secret_scan.spans(lines, scanner)[0]) == 40_000
    assert time.perf_counter() - began < 20  # 2.6 MB; the square of it would take minutes


def test_secret_columns(docs, texts):
    for r in secret_scan.op8_rows(docs).collect():
        assert r.base_sha256 == hashlib.sha256(slow_base(texts[r.doc_id] or "").encode()).hexdigest()


# mixing


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        over = {s for s in open_ if per * w[s] > 2 * sizes[s]}
        if not over:
            target |= {s: per * w[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_by_repeated_sharing(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, n))} | {None: 17}
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = slow_targets(sizes)
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in sizes), n


def test_mix_is_near_target_and_repeatable(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    a, b = (mixing.op9_rows(x).toPandas().sort_values("doc_id").reset_index(drop=True) for x in (docs, docs.repartition(7)))
    pd.testing.assert_frame_equal(a, b)
    a = a.merge(docs.select("doc_id", "source").toPandas())
    by = a.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (a.taken <= 2 * a["size"]).all() and ((by.taken - by.target).abs() <= 2 * by.most).all()


def test_mix_without_broadcasts(docs, monkeypatch):
    want = {tuple(r) for r in mixing.op9_rows(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert {tuple(r) for r in mixing.op9_rows(docs).collect()} == want


def test_rows_that_repeat_a_key_get_their_own_copies(spark):
    """A key in two sources, null keys, and rows that repeat all columns: every row is drawn, none is merged."""
    rows = [(i % 5 if i % 7 else None, f"w{i % 4} " * (20 + i % 3), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = Counter()
    for r in mixing.drawn(df).collect():
        copies[(r.doc_id, r.size, r.source)] += r.copies
    got = Counter((r.doc_id, len(r.text.split()), r.source) for r in mixing.mixed(df).collect())
    assert got == +copies and sum(got.values()) > 60


def test_mixed_rows(docs):
    drawn = {r.doc_id: r.copies for r in mixing.drawn(docs).collect()}
    out = mixing.mixed(docs)
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert out.columns == docs.columns and all(got.get(k, 0) == c for k, c in drawn.items())


# language-model scores


def slow_scores(texts, held):
    c = Counter()
    for k, t in texts.items():
        if not held[k]:
            c.update(t.encode().translate(LOW).split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    tokens = {k: [*t.encode().translate(LOW).split(), None] for k, t in texts.items()}
    return {k: (sum(c.get(w, 0) > 0 for w in ws), n, sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws), len(ws)) for k, ws in tokens.items()}


@pytest.mark.parametrize("frequent", [150_000, 300])
def test_base_scores_equal_brute_force(docs, texts, monkeypatch, frequent):
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    want = slow_scores(texts, held)
    rows = brown_lm.op10_rows(docs).collect()
    for r in rows:
        known, n, base, size = want[r.doc_id]
        assert (r.held_out, r.n_known, r.train_tokens, r.n_tokens) == (held[r.doc_id], known, n, size) and math.isclose(r.base_score, base, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # classes help on texts not learned from


def slow_neighbours(texts, of):
    """word -> Counter of (side, class of the neighbour); 'end' stands around a text."""
    out = {}
    for t in texts:
        ws = [None, *t.encode().translate(LOW).split(), None]
        for i in range(1, len(ws) - 1):
            own = out.setdefault(ws[i], Counter())
            for side, j in ((0, i - 1), (1, i + 1)):
                k = brown_lm.END if ws[j] is None else of.get(ws[j])
                if k is not None:
                    own[side, k] += 1
    return out


def likelihood(table):
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    return sum(map(f, table.ravel())) - sum(map(f, table.sum(axis=0))) - sum(map(f, table.sum(axis=1)))


def test_gains_are_differences_of_the_likelihood():
    """Joining a word to a class changes the class bigrams' likelihood by its gain, up to what holds for all classes."""
    rng = np.random.default_rng(4)
    size = 5
    table = rng.integers(0, 30, (size, size)).astype(float)
    beside, same = rng.integers(0, 4, (6, 2 * size)).astype(float), rng.integers(0, 3, 6).astype(float)
    got = brown_lm.gains(table, size - 1, beside, same)
    for w in range(6):
        own = []
        for c in range(size - 1):
            new = table.copy()
            new[:, c] += beside[w, :size]
            new[c] += beside[w, size:]
            new[c, c] += same[w]
            own.append(likelihood(new) - likelihood(table))
        # the other classes' sums grow alike whichever class the word joins, but for the class itself
        own = np.array(own)
        before, after = beside[w, :size], beside[w, size:]
        row, column = table.sum(axis=1), table.sum(axis=0)
        g = lambda x, y: brown_lm.xlogx(x + y) - brown_lm.xlogx(x)
        for c in range(size - 1):
            others = sum(g(row[k : k + 1], before[k : k + 1])[0] for k in range(size) if k != c) + sum(g(column[k : k + 1], after[k : k + 1])[0] for k in range(size) if k != c)
            joint = g(row[c : c + 1], after.sum(keepdims=True) + before[c] + same[w])[0] + g(column[c : c + 1], before.sum(keepdims=True) + after[c] + same[w])[0]
            alone = g(row[c : c + 1], after.sum(keepdims=True) + same[w])[0] + g(column[c : c + 1], before.sum(keepdims=True) + same[w])[0]
            assert math.isclose(got[w, c], own[c] + others + joint - alone, rel_tol=1e-9, abs_tol=1e-9)
        assert np.allclose(got[w], brown_lm.gain_of_one(table, size - 1, beside[w, :size], beside[w, size:], same[w]))


def test_every_known_word_is_clustered(docs, texts, spark, monkeypatch):
    """Classes of all training words, and the scores, against a slow version with the same blocks."""
    monkeypatch.setattr(brown_lm, "FREQUENT", 300)
    monkeypatch.setattr(brown_lm, "FIRST", 40)
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    learn = docs.where(brown_lm.remainder("doc_id", 7) != 2)
    own = [texts[k] for k in texts if not held[k]]
    counts = Counter(w for t in own for w in t.encode().translate(LOW).split())
    words = brown_lm.word_counts(learn, "text").cache()
    assert {bytes(r.word): r.c for r in words.collect()} == counts
    frequent, threshold = brown_lm.Frequent.of(words, 300)
    index = spark.sparkContext.broadcast(frequent.index)
    known, rare = brown_lm.classed(learn, frequent, index, "text")
    of = {w: int(known[i]) for w, i in frequent.index.items()}
    rest = {bytes(r.word): r["class"] for r in rare.collect()}
    assert set(of) | set(rest) == set(counts) and not set(of) & set(rest) and set(of.values()) | set(rest.values()) <= set(range(brown_lm.CLASSES))
    # block by block, from plain counts
    sides = lambda found, ws: np.array([[found[w][s, k] for s in (0, 1) for k in range(33)] for w in ws])

    def bigrams_of(classes):
        table = np.zeros((33, 33))
        for t in own:
            ks = [32, *(classes.get(w) for w in t.encode().translate(LOW).split()), 32]
            for i, j in zip(ks, ks[1:]):
                if i is not None and j is not None:
                    table[i, j] += 1
        return table

    now = dict(zip(list(frequent.index)[:40], brown_lm.exchange(brown_lm.first_bigrams(learn, index, 40, "text")).tolist()))
    second = list(frequent.index)[40:]
    now |= dict(zip(second, brown_lm.best(bigrams_of(now), sides(slow_neighbours(own, now), second)).tolist()))
    beside, table = sides(slow_neighbours(own, now), second), bigrams_of(now)
    for i, w in enumerate(second):  # they leave the table
        table[now[w]] -= beside[i, 33:]
        table[:, now[w]] -= beside[i, :33]
    table = np.maximum(table, 0)
    now |= dict(zip(second, brown_lm.best(table, beside).tolist()))
    for i, w in enumerate(second):
        table[now[w]] += beside[i, 33:]
        table[:, now[w]] += beside[i, :33]
    assert now == of
    some = sorted(rest)
    assert [rest[w] for w in some] == brown_lm.best(table, sides(slow_neighbours(own, now), some)).tolist()
    # scores
    of |= rest
    n, v = sum(counts.values()) + len(own), len(counts) + 1
    mass, kinds = np.zeros(32), np.zeros(32)
    for w, c in counts.items():
        mass[of[w]] += c
        kinds[of[w]] += 1
    bigrams = np.zeros((34, 34))
    for t in own:
        ks = [32, *(of[w] for w in t.encode().translate(LOW).split()), 32]
        for i, j in zip(ks, ks[1:]):
            bigrams[i, j] += 1
    shares = np.where(np.append(kinds > 0, True), bigrams[:33, :33].sum(axis=0) + 1, 0)
    shares /= shares.sum()
    p = lambda i, j: (shares[j] if i == 33 else (bigrams[i, j] + 20 * shares[j]) / (bigrams[i, :33].sum() + 20))
    for r in brown_lm.op10_rows(docs).collect():
        prior, score = 32, 0.0
        for w in texts[r.doc_id].encode().translate(LOW).split():
            if w in of:
                k = of[w]
                score += math.log10(p(prior, k) * (counts[w] + 1) / (mass[k] + kinds[k] + 1))
            else:
                k = 33
                score += math.log10(sum(p(prior, c) / (mass[c] + kinds[c] + 1) for c in range(32)))
            prior = k
        score += math.log10(p(prior, 32))
        assert math.isclose(r.score, score, rel_tol=1e-9), r.doc_id
        assert r.train_tokens == n


def test_class_model_sums_to_one():
    """Over all known words, one unknown word and the end, P(token | history) is a distribution."""
    rng = np.random.default_rng(3)
    of, counts = rng.integers(0, 20, 500), rng.integers(1, 50, 500)  # some classes stay empty
    mass, kinds = np.bincount(of, weights=counts, minlength=32), np.bincount(of, minlength=32)
    table = np.zeros((34, 34))
    table[:20, :20] = rng.integers(0, 40, (20, 20))
    table[32, :20] = table[:20, 32] = 7
    m = brown_lm.fitted(table, mass, kinds)
    for history in (0, 19, 31, 32, 33):
        p = 10 ** (m.transition[history, of] + np.log10(counts + 1) - m.norm[of])
        assert math.isclose(p.sum() + 10 ** m.transition[history, 33] + 10 ** m.transition[history, 32], 1, rel_tol=1e-9)


def test_exchange_finds_planted_classes():
    """Words of two planted classes that always alternate."""
    rng = np.random.default_rng(0)
    k = 12
    pairs = np.zeros((k + 1,) * 2, np.int64)
    for a in range(1, k + 1):
        for b in range(1, k + 1):
            if (a % 2) != (b % 2):
                pairs[a, b] = rng.integers(50, 100)
    own = brown_lm.exchange(pairs, 2)
    assert len(set(own[::2])) == len(set(own[1::2])) == 1 and own[0] != own[1]


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in brown_lm.scored(docs, F.lit(False), [F.col("doc_id")]).collect()}
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows.values()) and rows[1].n_tokens == 3 and rows[2].n_tokens == 1
