"""LM scoring by Brown class-based bigrams.

Every word of the training documents has a class, found by exchange in blocks of falling frequency:

1. The FIRST most frequent words are exchanged one by one between CLASSES classes, until none moves, so that the
   likelihood of the class bigrams among them (and the end of a text) rises most.
2. The other frequent words (FREQUENT at most) gather their neighbours' classes from all training texts; each then goes to
   the class that raises the likelihood most, given the class bigrams so far.
3. All neighbours' classes are counted again with the classes of both blocks. The second block is exchanged once more,
   now against counts that it is part of, and every remaining word of the training texts gets its class from its counts.

A word that no classed word stands beside goes to the class with the largest count.

A text's probability is the product over its tokens of P(class | previous class) * P(word | class): transitions between the
classes of all training tokens, interpolated with class frequencies, and add-one emissions inside a class, which leave mass
for one unknown word. An unknown word gets that mass summed over the classes, and what follows it the class frequencies.
The same tokens get the unigram add-one base score.

Scale. Counts of words and of their neighbours' classes grow with the corpus and are aggregated by shuffle; remaining words
are judged in a sorted stream, one at a time, and their classes stay a table. Only words above a count threshold that at
most FREQUENT words reach (found from a histogram of counts) are broadcast, with class and count, and tables of classes by
classes. A document keeps a byte a token and its own remaining words, which meet their classes in one equi-join.

Defined cases: null and empty texts are one end token. Rows that repeat are scored each. With no training document every
token has base score 0, and every token but the end is unknown. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather_texts, remainder, written

FREQUENT = 150_000
FIRST = 600
CLASSES = 32
END, UNKNOWN = CLASSES, CLASSES + 1
#: Neighbours' classes: those before and those after, the end included.
SIDES = 2 * (CLASSES + 1)
PARTIAL_WORDS = 250_000
PARTIAL_PAIRS = 2_000_000
TRANSITION_PRIOR = 20.0
PENDING = 255
_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_UPPER_TO_LOWER).split()


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(word binary, c): partial counts of each task are emitted whenever they hold PARTIAL_WORDS words."""

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(items: Iterator) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for _, _, texts in items:
            for t in texts:
                own.update(tokens(t))
                if len(own) >= PARTIAL_WORDS:
                    yield batch(own)
                    own = Counter()
        if own:
            yield batch(own)

    return gather_texts(train, [], count, "word binary, n bigint", text).groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Frequent:
    """Words by falling count (equal counts by word): the clustered ones come first."""

    index: dict[bytes, int]
    counts: np.ndarray

    @classmethod
    def of(cls, words: DataFrame, most: int) -> tuple[Frequent, int]:
        """The words of at least a threshold count that no more than ``most`` words reach, and that threshold."""
        step = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2(F.col("c").cast("double")) * 64).cast("bigint") - 6 * 64 + 64)
        histogram = sorted(((r["s"], r["n"], r["low"]) for r in words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect()), reverse=True)
        threshold, held = None, 0
        for _, n, low in histogram:  # a few thousand steps at most, whatever the corpus
            held += n
            if held > most:
                break
            threshold = low
        if threshold is None:
            return cls({}, np.zeros(0, np.int64)), 1 << 62
        rows = sorted(((r["c"], bytes(r["word"])) for r in words.where(F.col("c") >= threshold).toLocalIterator()), key=lambda x: (-x[0], x[1]))
        return cls({w: i for i, (_, w) in enumerate(rows)}, np.array([c for c, _ in rows], np.int64)), threshold


def codes(index: dict[bytes, int], texts: list[bytes | None]) -> np.ndarray:
    """Places in the index of all tokens end to end; -1: a remaining or unknown word, -2: the end of a text."""
    out = []
    for t in texts:
        words = tokens(t)
        out += [np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words)), np.array([-2])]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def after_end(x: np.ndarray) -> np.ndarray:
    """The token before each one; each text starts after an end."""
    return np.concatenate([[-2], x[:-1]])


def first_bigrams(train: DataFrame, shared, first: int, text: str) -> np.ndarray:
    """Counts of neighbours among the first words (1, 2...) and the end (0)."""
    n = first + 1

    def count(items: Iterator) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n * n, np.int64)
        for _, _, texts in items:
            x = codes(shared.value, texts)
            y = np.where(x == -2, 0, np.where((x >= 0) & (x < first), x + 1, -1))
            before = np.concatenate([[0], y[:-1]])
            ok = (before >= 0) & (y >= 0)
            own += np.bincount(before[ok] * n + y[ok], minlength=n * n)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["pair", "n"])

    out = np.zeros(n * n, np.int64)
    for r in gather_texts(train, [], count, "pair bigint, n bigint", text).groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():  # n * n rows at most
        out[r["pair"]] = r["n"]
    return out.reshape(n, n)


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 15) -> np.ndarray:
    """The class of each word by counts of neighbours (0: the end, then the words): words move one by one while that helps."""
    n = len(pairs) - 1
    classes = max(1, min(classes, n))
    own = np.concatenate([[classes], np.arange(n) % classes])
    member = np.zeros((n + 1, classes + 1))
    member[np.arange(n + 1), own] = 1
    counts = pairs.astype(float)
    for _ in range(rounds):
        moved = 0
        table = member.T @ counts @ member
        for w in range(1, n + 1):
            a = own[w]
            same = counts[w, w]
            after, before = counts[w] @ member, counts[:, w] @ member
            after[a] -= same
            before[a] -= same
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= same
            gain = gain_of_one(table, classes, before, after, same)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b] += after
            table[:, b] += before
            table[b, b] += same
            if b != a:
                member[w, a], member[w, b], own[w] = 0, 1, b
                moved += 1
        if not moved:
            break
    return own[1:]


def gain_of_one(table: np.ndarray, classes: int, before: np.ndarray, after: np.ndarray, same: float) -> np.ndarray:
    """``gains`` for one word with counts beside most classes."""
    rows, cols, d = table[:classes], table[:, :classes].T, np.arange(classes)
    own, a, b = table[d, d], after[:classes], before[:classes]
    left, right = rows.sum(axis=1), cols.sum(axis=1)
    gain = (xlogx(rows + after) - xlogx(rows)).sum(axis=1) + (xlogx(cols + before) - xlogx(cols)).sum(axis=1)
    gain += xlogx(own + a + b + same) - xlogx(own + a) - xlogx(own + b) + xlogx(own)
    return gain - (xlogx(left + after.sum() + same) - xlogx(left)) - (xlogx(right + before.sum() + same) - xlogx(right))


def gains(table: np.ndarray, classes: int, beside: np.ndarray, same: np.ndarray) -> np.ndarray:
    """(words, classes): how the log-likelihood of the class bigrams grows if a word that the table doesn't hold joins a class.

    table: counts by (class, class), the end last; beside: of each word the classes before it, then those after; same:
    how often it follows itself.
    """
    size = len(table)
    out = np.zeros((len(beside), classes))
    d = np.arange(classes)
    row, column = table[:classes].sum(axis=1), table[:, :classes].sum(axis=0)
    for side, cells, sums in ((beside[:, :size], table[:, :classes].T, column), (beside[:, size:], table[:classes], row)):
        w, k = np.nonzero(side)
        grown = cells[:, k].T  # (entries, classes)
        change = xlogx(grown + side[w, k][:, None]) - xlogx(grown)
        for c in range(classes):
            out[:, c] += np.bincount(w, weights=change[:, c], minlength=len(beside))
        total = side.sum(axis=1)[:, None] + same[:, None]
        out -= xlogx(sums + total) - xlogx(sums)
    # the cell of a class with itself grows by what comes before, after and between
    before, after, own = beside[:, :classes], beside[:, size : size + classes], table[d, d]
    out -= xlogx(own + before) - xlogx(own) + xlogx(own + after) - xlogx(own)
    out += xlogx(own + before + after + same[:, None]) - xlogx(own)
    return out


def best(table: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """The class of each word; the largest class if nothing speaks for any."""
    if not len(beside):
        return np.zeros(0, np.int64)
    out = np.zeros(len(beside), np.int64)
    for at in range(0, len(beside), 4096):
        some = beside[at : at + 4096].astype(float)
        out[at : at + 4096] = gains(table, CLASSES, some, np.zeros(len(some))).argmax(axis=1)
    out[beside.sum(axis=1) == 0] = int(table[:CLASSES].sum(axis=1).argmax())
    return out


def class_before_and_after(x: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the class before it and, shifted by CLASSES + 1, the one after it; -1 where that word has none yet."""
    own = np.where(x == -2, END, -1)
    own[x >= 0] = classes[x[x >= 0]]
    after = np.concatenate([own[1:], [-1]])
    return np.concatenate([[END], own[:-1]]), np.where(after >= 0, after + CLASSES + 1, -1)


def frequent_neighbours(train: DataFrame, shared, known, size: int, text: str) -> np.ndarray:
    """(frequent words, SIDES): counts of their neighbours' classes."""

    def count(items: Iterator) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def run() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times.astype(np.int64))], names=["key", "n"])

        for _, _, texts in items:
            x = codes(shared.value, texts)
            for side in class_before_and_after(x, known.value):
                ok = (x >= 0) & (side >= 0)
                held.append(x[ok] * SIDES + side[ok])
                n += len(held[-1])
            if n >= PARTIAL_PAIRS:
                yield run()
                held, n = [], 0
        if n:
            yield run()

    out = np.zeros(size * SIDES, np.int64)
    for batch in gather_texts(train, [], count, "key bigint, n bigint", text).groupBy("key").agg(F.sum("n").alias("n")).toArrow().to_batches():  # FREQUENT * SIDES rows at most
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.reshape(size, SIDES)


def class_table(classes: np.ndarray, beside: np.ndarray, ends: int) -> np.ndarray:
    """Counts by (class, class) among classed words and ends: what stands after each class; ends: training texts that are empty follow an end by an end."""
    table = np.zeros((CLASSES + 1, CLASSES + 1))
    ok = classes >= 0
    np.add.at(table, classes[ok], beside[ok, CLASSES + 1 :])
    first = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(first.T, classes[ok], beside[ok, : CLASSES + 1])
    table[END, :CLASSES] = first[END, :CLASSES]
    table[END, END] = ends
    return table


def rare_classes(train: DataFrame, shared, known, table: np.ndarray, text: str) -> DataFrame:
    """(word, class) of the training words that aren't in the index. A word's neighbours are packed bytes, merged in a
    stream sorted by word, so no list of a word's places is held."""

    def gather(items: Iterator) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, bytearray] = defaultdict(bytearray)

        def run() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(map(bytes, own.values())), pa.binary())], names=["word", "beside"])

        n = 0
        for _, _, texts in items:
            x = codes(shared.value, texts)
            before, after = class_before_and_after(x, known.value)
            rare = np.flatnonzero(x == -1)
            index = shared.value
            words = (w for t in texts for w in tokens(t) if w not in index)
            for w, a, b in zip(words, before[rare].tolist(), after[rare].tolist(), strict=True):
                at = own[w]
                if a >= 0:
                    at.append(a)
                if b >= 0:
                    at.append(b)
            n += len(rare)
            if n >= PARTIAL_WORDS:
                yield run()
                own.clear()
                n = 0
        if own:
            yield run()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        sides: list[np.ndarray] = []

        def run(upto: int) -> pa.RecordBatch:
            found = best(table, np.stack(sides[:upto]))
            return pa.RecordBatch.from_arrays([pa.array(words[:upto], pa.binary()), pa.array(found.astype(np.int32))], names=["word", "class"])

        for batch in batches:
            for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(np.frombuffer(x, np.uint8), minlength=SIDES)
                if words and words[-1] == w:
                    sides[-1] = sides[-1] + own
                else:
                    words.append(w)
                    sides.append(own)
            if len(words) > 4096:
                yield run(len(words) - 1)
                del words[:-1], sides[:-1]
        if words:
            yield run(len(words))

    rows = gather_texts(train, [], gather, "word binary, beside binary", text)
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(judge, "word binary, class int")


@dataclass
class Model:
    transition: np.ndarray  # log10 P(class | previous class), the end and unknown words included
    norm: np.ndarray  # log10 of each class's denominator; 0 for the end and unknown words


def fitted(table: np.ndarray, mass: np.ndarray, kinds: np.ndarray) -> Model:
    """table: bigram counts by class, the end and unknown words included; mass and kinds: tokens and words of each class."""
    counts = table[:UNKNOWN, :UNKNOWN].astype(float)
    used = np.concatenate([kinds > 0, [True]])
    used[0] |= not kinds.any()
    shares = np.where(used, counts.sum(axis=0) + 1, 0.0)
    shares /= shares.sum()
    rows = np.concatenate([counts, np.zeros((1, UNKNOWN))])  # after an unknown word: the shares
    p = (rows + TRANSITION_PRIOR * shares) / (rows.sum(axis=1, keepdims=True) + TRANSITION_PRIOR)
    denominators = mass + kinds + 1.0
    unknown = (p[:, :CLASSES] / denominators).sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        transition = np.log10(np.concatenate([p, unknown], axis=1))
    return Model(transition, np.concatenate([np.log10(denominators), [0.0, 0.0]]))


def packed(index: dict[bytes, int], known: np.ndarray, logs: np.ndarray, texts: list[bytes | None]) -> list:
    """By text: the classes of its tokens (PENDING where the word isn't in the index), how many words are, their sum of
    log10(c + 1), and the other words with their places among the pending ones."""
    sequences, found, sums, words, places = [], [], [], [], []
    for t in texts:
        own = tokens(t)
        x = np.fromiter(map(index.get, own, repeat(-1)), np.int64, len(own))
        sequence = np.full(len(own) + 1, PENDING, np.uint8)
        sequence[-1] = END
        sequence[:-1][x >= 0] = known[x[x >= 0]]
        at: dict[bytes, int] = {}
        order = [at.setdefault(own[i], len(at)) for i in np.flatnonzero(x < 0).tolist()]
        sequences.append(sequence.tobytes())
        found.append(int((x >= 0).sum()))
        sums.append(float(logs[x[x >= 0]].sum()))
        words.append(list(at))
        places.append(np.array(order, "<i4").tobytes())
    return [pa.array(sequences, pa.binary()), pa.array(found, pa.int64()), pa.array(sums, pa.float64()), pa.array(places, pa.binary()), pa.array(words, pa.list_(pa.binary()))]


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes in the pending places; what meets no class is unknown. Columns: keys, then sequence, known, logs, places, got."""
    for batch in batches:
        n = batch.num_columns - 5
        got = batch.column(n + 4)
        flat = got.flatten()
        at, of, c = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        upto = np.cumsum(got.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out: list[list] = [[], [], []]
        for i, (sequence, known, logs, places) in enumerate(zip(*(batch.column(n + j).to_pylist() for j in range(4)), strict=True)):
            x, order = np.frombuffer(sequence, np.uint8), np.frombuffer(places, "<i4")
            if len(order):
                own = slice(upto[i - 1] if i else 0, upto[i])
                place, log = np.full(int(order.max()) + 1, UNKNOWN, np.uint8), np.zeros(int(order.max()) + 1)
                place[at[own]], log[at[own]] = of[own], np.log10(c[own] + 1.0)
                x = x.copy()
                x[x == PENDING] = place[order]
                known += int((place[order] != UNKNOWN).sum())
                logs += float(log[order].sum())
            for col, v in zip(out, (x.tobytes(), known, logs), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=[*batch.schema.names[:n], "sequence", "n_known", "logs"])


def sequence_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = UNKNOWN + 1
    own = np.zeros(n * n, np.int64)
    for batch in batches:
        for s in batch.column(0).to_pylist():
            x = np.frombuffer(s, np.uint8).astype(np.int64)
            own += np.bincount(np.concatenate([[END], x[:-1]]) * n + x, minlength=n * n)
    at = np.flatnonzero(own)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["pair", "n"])


def sequence_score(model: Model, sequence: bytes, logs: float) -> float:
    x = np.frombuffer(sequence, np.uint8)
    before = np.concatenate([[END], x[:-1]])
    return float(model.transition[before, x].sum() - model.norm[x].sum() + logs)


def classed(learn: DataFrame, frequent: Frequent, index, text: str) -> tuple[np.ndarray, DataFrame]:
    """The classes of the frequent words, and (word, class) of all others."""
    spark = learn.sparkSession
    size, first = len(frequent.index), min(FIRST, len(frequent.index))
    known = np.full(size, -1, np.int64)
    if first:
        known[:first] = exchange(first_bigrams(learn, index, first, text))
    empty_ends = learn.where(F.coalesce(F.trim(F.col(text)), F.lit("")) == "").count()
    for block in (1, 2):
        shared = spark.sparkContext.broadcast(known.copy())
        beside = frequent_neighbours(learn, index, shared, size, text) if size else np.zeros((0, SIDES), np.int64)
        table = class_table(known, beside, empty_ends)
        if block == 1:
            known[first:] = best(table, beside[first:])
        else:  # one exchange of the second block: each word leaves the counts before it is judged, a slice at a time
            for at in range(first, size, 4096):
                some = slice(at, min(size, at + 4096))
                out = table.copy()
                np.subtract.at(out, known[some], beside[some, CLASSES + 1 :])
                np.subtract.at(out.T, known[some], beside[some, : CLASSES + 1])
                table = np.maximum(out, 0)
                known[some] = best(table, beside[some])
                np.add.at(table, known[some], beside[some, CLASSES + 1 :])
                np.add.at(table.T, known[some], beside[some, : CLASSES + 1])
    shared = spark.sparkContext.broadcast(known.copy())
    return known, written(rare_classes(learn, index, shared, table, text), "word-classes")


def scored(docs: DataFrame, train, keys: list, text: str = "text") -> DataFrame:
    """keys, then n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity of every row; learns from the rows that train selects."""
    spark = docs.sparkSession
    learn = docs.where(train)
    words = written(word_counts(learn, text), "word-counts")
    ends = learn.count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    total, kinds = sums["t"] + ends, sums["n"] + (ends > 0)
    frequent, threshold = Frequent.of(words, FREQUENT)
    index = spark.sparkContext.broadcast(frequent.index)  # FREQUENT words at most
    known, rare = classed(learn, frequent, index, text)
    rare = written(words.where(F.col("c") < threshold).join(rare.hint("merge"), "word").select("word", "c", "class"), "rare-words")
    mass, members = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(mass, known, frequent.counts)
    np.add.at(members, known, 1)
    for r in rare.groupBy("class").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("n")).collect():  # CLASSES rows at most
        mass[r["class"]] += r["t"]
        members[r["class"]] += r["n"]
    shared = spark.sparkContext.broadcast((known, np.log10(frequent.counts + 1.0)))

    def pack(items: Iterator) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch, first, texts in items:
            own = [batch.column(i).slice(first, len(texts)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), *own, *packed(index.value, *shared.value, texts)], names=["row", *names, *made])
            row += len(texts)

    from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

    chosen = docs.withColumn("__train", F.coalesce(train, F.lit(False)))
    fields = [*docs.select(*keys).limit(0).schema.fields, StructField("__train", chosen.schema["__train"].dataType)]
    names, made = [f.name for f in fields], ["sequence", "known", "logs", "places", "words"]
    schema = StructType([StructField("row", LongType()), *fields, *_parse_datatype_string("sequence binary, known bigint, logs double, places binary, words array<binary>").fields])
    rows = written(gather_texts(chosen, [*keys, F.col("__train")], pack, schema, text), "sequences")
    own = rows.select("row", F.posexplode("words").alias("at", "word")).join(rare.hint("merge"), "word")
    got = own.groupBy("row").agg(F.collect_list(F.struct("at", "class", "c")).alias("got"))  # the words of one text
    rows = rows.drop("words").join(got.hint("merge"), "row", "left").drop("row")
    rows = written(rows.mapInArrow(filled, StructType([*fields, *_parse_datatype_string("sequence binary, n_known bigint, logs double").fields])), "classed")
    table = np.zeros((UNKNOWN + 1) ** 2)
    for r in rows.where("__train").select("sequence").mapInArrow(sequence_bigrams, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # classes by classes
        table[r["pair"]] = r["n"]
    model = spark.sparkContext.broadcast(fitted(table.reshape(UNKNOWN + 1, UNKNOWN + 1), mass, members))

    @F.pandas_udf("double")
    def score(sequence: pd.Series, logs: pd.Series) -> pd.Series:
        return pd.Series([sequence_score(model.value, s, x) for s, x in zip(sequence, logs, strict=True)], dtype=float)

    out = rows.withColumn("score", score("sequence", "logs")).withColumn("n_tokens", F.length("sequence").cast("bigint"))
    end = math.log10(ends + 1) - math.log10(total + kinds + 1)
    base = F.col("logs") - (F.col("n_tokens") - 1) * F.lit(math.log10(total + kinds + 1)) + F.lit(end)
    return out.select(*names[:-1], "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op10_rows(docs: DataFrame) -> DataFrame:
    held = remainder("doc_id", 7) == 2
    return scored(docs, ~held, [F.col("doc_id"), held.alias("held_out")])
