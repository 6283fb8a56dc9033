"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text's words (runs of letters, lower case) are scored as ``^^^word$`` with 4-grams of characters, so a word's score
doesn't depend on its neighbours and each distinct word of a slice is scored once. The model is a few sorted arrays:
for each order the hashes of all n-grams of any language with the languages' log-probabilities side by side, and the
hashes of all contexts with their back-off weights. The language with the lowest cross-entropy per character wins.

Calibration: of a language with CALIBRATE sampled documents or more a fifth isn't counted but scored; smaller languages
keep all of theirs for learning, so every language with a labelled document that has a letter can be predicted. They set the temperature that turns
cross-entropies into a probability, and for each language the cross-entropy above which a text is ``rejected`` (it
looks like no learned language); rejection is a column of its own and does not change ``lang_pred``.

The model is fitted on a bounded sample: about ``per_language`` whole documents for each language, chosen by a hash of
the key, so that rows, not partitions or order, decide. Prediction reads every row and whole texts.

Memory: words of a language beyond MOST_WORDS distinct ones (the least frequent, ties by word) are not learned, a
documented bound like ``per_language``; the tables hold log-probabilities only of the n-grams that a language has.

Defined cases: null text or a text without a letter is ``und`` with score 0; null languages aren't learned from; with
no labelled document at all every text is ``und``. Repeated rows are predicted each, and count each in learning. An empty
table gives an empty result; extra columns are ignored. Of equal scores the language first in order wins.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gather_texts, map_texts, remainder

ORDER = 4
BOS, EOS = 2, 3
PER_LANGUAGE = 400
CALIBRATE = 50
MOST_WORDS = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)


def letters(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w[0].isalpha() or any(map(str.isalpha, w)) for w in words)


def framed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^^^word$`` for all words end to end, and each word's first place."""
    pad = chr(BOS) * (ORDER - 1)
    joined = "".join(f"{pad}{w}{chr(EOS)}" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(w) + ORDER for w in words), np.int64, len(words))
    return codes, np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(words) else np.zeros(0, np.int64)


def window_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For order k = 1..ORDER: a 64-bit hash of the k codes that end at each place (places < k - 1 are void)."""
    out, h, power = [], np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[k:] = codes[: len(codes) - k] if k else codes
            h = h + (shifted + np.uint64(1)) * power
            power = power * _BASE
            out.append(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return out


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by order: sorted hashes
    logp: list[np.ndarray]  # by order: (grams, languages)
    contexts: list[np.ndarray]  # by order of the gram they precede: sorted hashes
    backoff: list[np.ndarray]  # by order: (contexts, languages)
    unseen: np.ndarray  # a character that no language has
    temperature: float = 10.0
    reject: np.ndarray | None = None

    def places(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log-probabilities (places, languages) of the characters at the given places."""
        hashes = window_hashes(codes)
        out = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            if not len(left):
                break
            own, (i, found) = at[left], find(self.grams[k - 1], hashes[k - 1][at[left]])
            out[left[found]] += self.logp[k - 1][i[found]]
            left, own = left[~found], own[~found]
            if k > 1:
                j, known = find(self.contexts[k - 1], hashes[k - 2][own - 1])
                out[left[known]] += self.backoff[k - 1][j[known]]
        out[left] += self.unseen
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability (words, languages), end of word included."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        codes, first = framed(words)
        sizes = np.diff(np.append(first, len(codes)))
        scored = np.ones(len(codes), bool)
        for k in range(ORDER - 1):
            scored[first + k] = False
        at = np.flatnonzero(scored)
        return np.add.reduceat(self.places(codes, at), np.concatenate([[0], np.cumsum(sizes - ORDER + 1)[:-1]]), axis=0)


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return i, table[i] == wanted


def kneser_ney(counts: dict[str, dict[str, int]]) -> Model:
    """counts: language -> word -> count."""
    languages = sorted(counts)
    alphabet = {c for own in counts.values() for w in own for c in w} | {chr(EOS)}
    n_chars = len(alphabet) + 1
    raw: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(languages))) for _ in range(ORDER)]
    pad = chr(BOS) * (ORDER - 1)
    for j, lang in enumerate(languages):
        for w, n in counts[lang].items():
            s = pad + w + chr(EOS)
            for i in range(ORDER - 1, len(s)):
                raw[ORDER - 1][s[i - ORDER + 1 : i + 1]][j] += n
    for k in range(ORDER - 1, 0, -1):  # continuation counts: by how many characters an n-gram is preceded
        for g, n in raw[k].items():
            raw[k - 1][g[1:]] += n > 0
    grams, logp, contexts, backoff = [], [], [], []
    below: dict[str, np.ndarray] = {}
    floor = np.full(len(languages), 1 / n_chars)
    unseen = np.zeros(len(languages))
    for k in range(ORDER):
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
        kinds: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
        ones, twos = np.zeros(len(languages)), np.zeros(len(languages))
        for g, n in raw[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += n > 0
            ones += n == 1
            twos += n == 2
        discount = np.clip(np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.1, 0.9)
        weight = {c: np.where(t > 0, discount * kinds[c] / np.maximum(t, 1), 1.0) for c, t in total.items()}
        prob = {}
        for g, n in raw[k].items():
            t, lower = total[g[:-1]], below.get(g[1:], floor) if k else floor
            prob[g] = np.where(t > 0, np.maximum(n - discount, 0) / np.maximum(t, 1), 0) + weight[g[:-1]] * lower
        if k == 0:
            unseen = np.log(weight.get("", np.ones(len(languages))) * floor)
        for table, values, out_keys, out_values, back in ((prob, prob, grams, logp, 0), (weight, weight, contexts, backoff, 1)):
            keys = list(table)
            own = [x for x in keys if len(x) == k + 1 - back]
            h = hashes_of(own, k + 1 - back)
            order = np.argsort(h, kind="stable")
            out_keys.append(h[order])
            out_values.append(np.log(np.stack([values[own[i]] for i in order])).astype(np.float32) if own else np.zeros((0, len(languages)), np.float32))
        below = prob
    return Model(languages, grams, logp, contexts, backoff, unseen.astype(np.float32))


def hashes_of(grams: list[str], size: int) -> np.ndarray:
    if size == 0 or not grams:
        return np.zeros(len(grams) if size == 0 else 0, np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
    h, power = np.zeros(len(grams), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h + (codes[:, size - 1 - k].astype(np.uint64) + np.uint64(1)) * power
            power = power * _BASE
        return h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)


def entropies(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in nats a character (texts, languages), and whether the text has a letter."""
    ids: dict[str, int] = {}
    owned, sizes, has = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for i, b in enumerate(texts):
        words = letters(b.decode("utf-8", "replace")) if b else []
        has[i] = has_letter(words)
        sizes[i] = len(words)
        owned.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
    token = np.concatenate(owned) if owned else np.zeros(0, np.int64)
    distinct = list(ids)
    logs = model.words(distinct)
    chars = np.fromiter((len(w) + 1 for w in distinct), np.int64, len(distinct))
    owner = np.repeat(np.arange(len(texts)), sizes)
    total = np.maximum(np.bincount(owner, weights=chars[token], minlength=len(texts)), 1)
    return np.stack([-np.bincount(owner, weights=logs[token, j], minlength=len(texts)) / total for j in range(logs.shape[1])], axis=1), has


def predict(model: Model, texts: list[bytes | None]) -> list[list]:
    if not model.languages:
        return [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)]
    ce, has = entropies(model, texts)
    best = ce.argmin(axis=1)
    gap = np.exp(-(ce - ce.min(axis=1, keepdims=True)) * model.temperature)
    score = np.where(has, 1 / gap.sum(axis=1), 0.0)
    low = ce[np.arange(len(texts)), best]
    limit = model.reject[best] if model.reject is not None else np.inf
    return [[model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], score.tolist(), [float(x) if h else None for x, h in zip(low, has, strict=True)], (~has | (low > limit)).tolist()]


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Reads about per_language documents of each language; what reaches the driver is their words with counts."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], [], [], [], [], np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit("language"), "key", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sizes.items()))
    enough = [k for k, n in sizes.items() if min(n, per_language) >= CALIBRATE]
    aside = F.col("lang").isin(enough) & (F.pmod(F.xxhash64(F.lit("calibrate"), "key", "text"), F.lit(5)) == 0)
    sample = rows.where(draw < share).withColumn("part", F.when(aside, F.lit(1)).otherwise(F.lit(0)))

    def count(items: Iterator) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = defaultdict(Counter)
        for batch, first, texts in items:
            for lang_, b in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts, strict=True):
                own[lang_].update(letters((b or b"").decode("utf-8", "replace")))
        for lang_, c in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = defaultdict(dict)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # the words of per_language documents

    def learn(some: DataFrame) -> None:
        found = gather_texts(some, [F.col("lang")], count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        for r in found.withColumn("place", place).where(F.col("place") <= MOST_WORDS).toLocalIterator():
            counts[r["lang"]][r["word"]] = r["n"]

    learn(sample.where("part = 0").drop("part"))
    for missing in sorted(set(sizes) - set(counts)):  # the draw left none of it, as where all of its rows are equal
        learn(rows.where((F.col("lang") == missing) & F.col("text").rlike(r"\p{L}")).limit(per_language))
    model = kneser_ney(counts)
    if not model.languages:
        return model
    held = map_texts(sample.where("part = 1"), [F.col("lang")], lambda t: [entropies(model, t)[0].tolist(), entropies(model, t)[1].tolist()], "ce array<double>, has boolean").where("has").collect()
    known = {k: j for j, k in enumerate(model.languages)}
    held = [(known[r["lang"]], r["ce"]) for r in held if r["lang"] in known]
    model.reject = np.full(len(model.languages), np.inf)
    if held:
        y, ce = np.array([a for a, _ in held]), np.array([b for _, b in held])
        gap = ce - ce[np.arange(len(y)), y][:, None]
        losses = {t: np.log(np.exp(-np.clip(gap * t, -60, 60)).sum(axis=1)).mean() for t in (1.0, 2.0, 5.0, 10.0, 20.0)}
        model.temperature = min(losses, key=lambda t: (losses[t], t))
        for j in range(len(model.languages)):
            if len(own := ce[y == j, j]) >= 20:
                model.reject[j] = np.quantile(own, 0.99) * 1.15
    return model


def identify(docs: DataFrame, model: Model, keys: list[Column], text: str = "text") -> DataFrame:
    """keys, then lang_pred, score (0 to 1), cross_entropy (nats a character, null if und) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    return map_texts(docs, keys, lambda texts: predict(shared.value, texts), "lang_pred string, score double, cross_entropy double, rejected boolean", text)


def op3_rows(docs: DataFrame) -> DataFrame:
    held = remainder("doc_id", 4) == 2
    return identify(docs, fit(docs, ~held), [F.col("doc_id"), held.alias("held_out")])
