"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or abstain (2) on every document. Expectation-maximisation over the counts of
vote patterns of all documents (at most 3^LABELLERS, whatever the corpus) estimates each labeller's accuracies - the
chance of a bad vote, where it votes at all, given the unknown class - and the share of good documents, without any hand
label. Abstaining says nothing. The start (bad votes are rare on good documents, and a bad one gets some) and a weak
Dirichlet prior of the same shape keep the classes from swapping. The posterior of
a document's votes is the soft label that trains a logistic scorer over hashed features (words, word shapes and coarse
signals, 2^HASH_BITS buckets), so that what no labeller names can count too. The scorer's probability decides.

The scorer is fitted on a bounded sample, about TRAIN_ROWS documents chosen by a hash of the key, each with a value for
2^HASH_BITS buckets at most however long its text; the pattern counts and the scores cover every document and whole texts.

Defined cases: null and empty texts score 0 and are rejected. Repeated rows get equal scores. An empty table gives an
empty result. Extra columns are ignored, and passed on by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

HASH_BITS = 16
TRAIN_ROWS = 4000
#: Shorter texts count as so long, so that one word alone says little.
LEAST_WORDS = 25
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Common words of English, French, German and Spanish.
STOP_WORDS = frozenset("the of and to in a is that it for on was as with be by are this from or le la les des et un une que qui dans pour par der die das und ist von zu den mit ein eine nicht el los las de y en del se por con para su al".encode().split())
_SHAPE = bytes(65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 97 if 97 <= c <= 122 or c >= 128 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_SYMBOLS = b"#*$%&|<>"
_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def signals(b: bytes, words: list[bytes]) -> tuple[float, ...]:
    """Shares in 0..1 (but the mean length): what labellers look at."""
    n = len(words)
    if not n:
        return (0.0,) * 9
    kinds = Counter(words)
    symbols = len(b) - len(b.translate(None, _SYMBOLS))
    upper, lower = (len(b) - len(b.translate(None, x)) for x in (_CAPITALS, _SMALL))
    stops = sum(c for w, c in kinds.items() if w.lower().strip(_EDGES) in STOP_WORDS) / n
    lines = [x for x in b.split(b"\n") if x]
    inked = len(b.translate(None, b" \t\n\x0b\x0c\r"))
    marks = len(b) - len(b.translate(None, _EDGES))
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    return (symbols / n, b.count(b"!") / n, b.count(b" | ") / n, upper / max(1, upper + lower), stops, 1 - len(kinds) / n, repeats, 1 - len(set(lines)) / max(1, len(lines)), marks / max(1, inked))


@dataclass(frozen=True)
class Labeller:
    """Votes bad from one bound of a signal on, good up to the other, and abstains between them or on fewer words."""

    name: str
    signal: int
    bad: float
    good: float
    least_words: int = 5

    def vote(self, x: tuple[float, ...], n: int) -> int:
        value = x[self.signal]
        if n < self.least_words:
            return ABSTAIN
        if self.bad >= self.good:
            return BAD if value >= self.bad else GOOD if value <= self.good else ABSTAIN
        return BAD if value <= self.bad else GOOD if value >= self.good else ABSTAIN


LABELLERS = (
    Labeller("symbols", 0, 0.3, 0.02),
    Labeller("exclamation", 1, 0.3, 0.02),
    Labeller("table_bars", 2, 0.2, 0.005),
    Labeller("capitals", 3, 0.4, 0.15),
    Labeller("stop_words", 4, 0.0, 0.08, 40),
    Labeller("few_kinds", 5, 0.85, 0.6, 20),
    Labeller("same_word_again", 6, 0.3, 0.02),
    Labeller("same_line_again", 7, 0.6, 0.2, 40),
    Labeller("marks", 8, 0.25, 0.12, 10),
)


def votes(texts: list[bytes | None]) -> list[list[str]]:
    out = []
    for t in texts:
        words = (t or b"").split()
        x = signals(t or b"", words)
        out.append("".join(str(f.vote(x, len(words))) for f in LABELLERS) if words else "2" * len(LABELLERS))
    return [out]


#: P(bad vote | class) to start from, and how many documents this belief weighs: it washes out as the corpus grows.
START = {GOOD: 0.003, BAD: 0.2}
BELIEF = 20.0


def em(patterns: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """(share of good documents, table[labeller, class, vote]) for the votes bad and good."""
    table = np.empty((len(LABELLERS), 2, 2))
    for k in (BAD, GOOD):
        table[:, k] = (START[k], 1 - START[k])
    prior = 0.85
    if not patterns:
        return prior, table
    seen = np.array([[int(v) for v in p] for p in sorted(patterns)])
    weight = np.array([patterns[p] for p in sorted(patterns)], float)
    for _ in range(rounds):
        good = posterior(seen, prior, table)
        old, prior = prior, float(np.clip((weight @ good + 0.85 * BELIEF) / (weight.sum() + BELIEF), 0.02, 0.98))
        for k in (BAD, GOOD):
            own = (weight * (good if k == GOOD else 1 - good))[:, None]
            bad, fine = ((own * (seen == v)).sum(axis=0) for v in (BAD, GOOD))
            table[:, k, BAD] = (bad + BELIEF * START[k]) / (bad + fine + BELIEF)
            table[:, k, GOOD] = 1 - table[:, k, BAD]
        if abs(prior - old) < 1e-9:
            break
    return prior, table


def posterior(seen: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(good | votes) for rows of votes."""
    odds = np.full(len(seen), np.log(prior / (1 - prior)))
    for v in (BAD, GOOD):
        odds += (seen == v) @ (np.log(table[:, GOOD, v]) - np.log(table[:, BAD, v]))
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def bucket(kind: bytes, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(kind)) & ((1 << HASH_BITS) - 1)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket, value): each word's and shape's share, and one unit for each signal's tenth; values of one owner may repeat a bucket."""
    ids: dict[bytes, int] = {}
    tokens, sizes, extra = [], np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        words = (t or b"").split()
        sizes[i] = len(words)
        tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
        extra.append([bucket(b"signal%d:" % k, b"%d" % min(9, int(x * 10))) for k, x in enumerate(signals(t or b"", words))])
    token = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    share = 1 / np.maximum(sizes, LEAST_WORDS)[owner]
    word = np.fromiter((bucket(b"word:", w) for w in ids), np.int64, len(ids))
    shape = np.fromiter((bucket(b"shape:", _RUNS.sub(rb"\1", w.translate(_SHAPE))) for w in ids), np.int64, len(ids))
    signal = np.array(extra, np.int64).reshape(len(texts), -1)
    return (
        np.concatenate([owner, owner, np.repeat(np.arange(len(texts)), signal.shape[1])]),
        np.concatenate([word[token], shape[token], signal.ravel()]),
        np.concatenate([share, share, np.full(signal.size, 0.3)]),
    )


def train(owner: np.ndarray, at: np.ndarray, value: np.ndarray, target: np.ndarray, epochs: int = 80, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression with soft targets, AdaGrad steps."""
    size = 1 << HASH_BITS
    w, b, g2, b2 = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(epochs if len(target) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[at] * value, minlength=len(target)) + b, -30, 30)))
        error = (p - target) / len(target)
        grad = np.bincount(at, weights=error[owner] * value, minlength=size) + decay * w
        g2 += grad**2
        b2 += error.sum() ** 2
        w -= rate * grad / np.sqrt(g2)
        b -= rate * error.sum() / np.sqrt(b2)
    return w, b


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    prior: float
    table: np.ndarray

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        owner, at, value = features(texts)
        x = np.bincount(owner, weights=self.weights[at] * value, minlength=len(texts)) + self.bias
        empty = np.array([not (t or b"").strip() for t in texts], bool)
        return np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Scorer:
    """Vote patterns of all documents; features of about ``rows`` of them."""
    counted = map_texts(docs, [], votes, "votes string", text).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = {r["votes"]: r["n"] for r in counted}  # 3^LABELLERS at most
    prior, table = em(patterns)
    share = min(1.0, rows / max(1, sum(patterns.values())))
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("quality"), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def sparse(texts: list[bytes | None]) -> list:
        owner, at, value = features(texts)
        packed = owner.astype(np.int64) << HASH_BITS | at
        keys, back = np.unique(packed, return_inverse=True)
        sums = np.bincount(back, weights=value, minlength=len(keys))
        offsets = np.searchsorted(keys >> HASH_BITS, np.arange(len(texts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in ((keys & ((1 << HASH_BITS) - 1)).astype(np.int32), sums.astype(np.float32))]
        return [*votes(texts), *lists]

    sample = map_texts(chosen, [F.col(key).alias("__key")], sparse, "votes string, at array<int>, value array<float>", text).orderBy("__key").drop("__key").toPandas()
    if not len(sample):
        return Scorer(np.zeros(1 << HASH_BITS), 0.0, prior, table)
    target = posterior(np.array([[int(v) for v in p] for p in sample["votes"]]), prior, table)
    w, b = train(np.repeat(np.arange(len(sample)), sample["at"].map(len)), np.concatenate(sample["at"].tolist()), np.concatenate(sample["value"].tolist()).astype(float), target)
    return Scorer(w, b, prior, table)


def judged(docs: DataFrame, keys: list[Column], scorer: Scorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """keys, then votes, score (0 to 1) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # 2^HASH_BITS weights
    return map_texts(docs, keys, lambda texts: [*votes(texts), pa.array(shared.value.score(texts))], "votes string, score double", text).withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that the classifier rejects; one more pass over the texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, key, text))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            out = []
            for i in range(0, len(x), 500):
                out.append(shared.value.score([None if t is None else t.encode() for t in x.iloc[i : i + 500]]))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(score(F.col(text)) >= threshold)


def op7_rows(docs: DataFrame) -> DataFrame:
    return judged(docs, [F.col("doc_id")], fit(docs))
