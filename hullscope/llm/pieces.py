"""SentencePiece encoding and decoding by a weighted transducer and its shortest path.

``Transducer`` compiles a model file: the normaliser (white space to U+2581, prefix), an arc for every piece, and byte
arcs for characters that no piece has. Composing it with a text gives a lattice over character positions; the encoding
is the path of least weight in the tropical semiring (weights add along a path, the least path wins):

* unigram models: an arc weighs minus its piece's score, a byte fallback as the library's unknown piece;
* BPE models: the weight is on pairs of arcs, 0 if the second piece may follow the first and infinite if not. A pair may
  follow iff merging the two pieces' joint text gives back exactly these two: a sequence is the merge result iff all
  its neighbours are such pairs, so one path of weight 0 exists, and each prefix has one as well. States therefore keep
  one back pointer for each position.

The lattice has cut points: between two characters that no piece has side by side every path has a state, so what lies
between two cuts is solved on its own and kept in a bounded cache. The distinct new parts of a slice of texts go through
the lattice together, one array step for each (position, arc length). Runs of two or more white spaces are merged
literally, as their pieces share one score and the pair rule needs an order without ties.

Defined cases: null and empty texts have no tokens and decode to an empty text.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts that a worker remembers in each of two generations, as packed 32-bit ids.
CACHE = 60_000
#: Pairs of pieces that a worker remembers; a miss is worked out anew.
PAIRS = 150_000
#: Parts of up to so many characters are solved in arrays.
ARRAY_LENGTH = 24
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(b):
        tag = varint()
        match tag & 7:
            case 0:
                yield tag >> 3, varint()
            case 1 | 5:
                n = 8 if tag & 7 == 1 else 4
                i += n
                yield tag >> 3, b[i - n : i]
            case 2:
                n = varint()
                i += n
                yield tag >> 3, b[i - n : i]
            case other:
                raise ValueError(f"wire type {other}")


class HashTable:
    """Open addressing over 64-bit keys (not 0) with 32-bit values, looked up in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.values[slot[mine]] = values[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values)"""
        slot = self.slot(keys)
        at = self.keys[slot]
        found = at == keys
        left = np.flatnonzero(~found & (at != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            at = self.keys[slot[left]]
            hit = at == keys[left]
            found[left[hit]] = True
            left = left[~hit & (at != 0)]
        return found, self.values[slot]


class Transducer:
    def __init__(self, model: bytes):
        pieces, self.kind, norm = [], UNIGRAM, {}
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(fields(value))
        self.start(pieces, norm)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, norm: dict | None = None) -> Transducer:
        """From (piece, score, type) instead of a file."""
        self = cls.__new__(cls)
        self.kind = kind
        self.start(pieces, norm or {})
        return self

    def start(self, pieces: list[tuple[str, float, int]], norm: dict) -> None:
        if norm.get(2):
            raise ValueError("character maps of normalisers are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind}")
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1)) if norm else False
        self.text = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER, UNUSED)}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.bytes = [next((i for i, (p, _, t) in enumerate(pieces) if t == BYTE and p == f"<0x{b:02X}>"), self.unknown) for b in range(256)] if any(t == BYTE for _, _, t in pieces) else None
        self.byte_ids = frozenset(self.bytes or ())
        self.made = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.begins = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # a space run opens a part unless some piece has a space behind another character
        self.inner_space = any(x[1] == SPACE and x[0] != SPACE for x in self.joined)
        self.parts = re.compile(r"(?s).+" if self.inner_space else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if not any("\n" in x for x in self.joined) else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.least = min(self.score, default=0.0) - 10.0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        begins = sorted(self.begins)
        self.arcs = HashTable(np.array([self.hashed(x) for x in begins], np.uint64), np.array([self.ids.get(x, -1) for x in begins], np.int32))
        self.sizes = np.array([max(1, len(x)) for x in self.text], np.int64)
        self.is_byte = np.zeros(len(self.text), bool)
        self.is_byte[list(self.byte_ids)] = True
        self.pair_keys, self.pair_values = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    @staticmethod
    def hashed(s: str) -> int:
        h = 7
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return h or 1

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return ((SPACE if self.prefix and text else "") + text).replace(" ", SPACE)

    def fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """The merges of BPE, one by one: best score first, leftmost of equals."""
        at = list(text)
        left, right = list(range(-1, len(at) - 1)), list(range(1, len(at) + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else len(at)
            if i >= 0 and j < len(at) and (t := self.ids.get(at[i] + at[j])) is not None:
                heapq.heappush(heap, (-self.score[t], i, len(at[i]) + len(at[j])))

        for i in range(len(at)):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if not at[i] or j >= len(at) or len(at[i]) + len(at[j]) != size:
                continue
            at[i] += at[j]
            at[j] = ""
            right[i] = right[j]
            if right[i] < len(at):
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [x for x in at if x]

    def follows(self, a: int, b: int) -> bool:
        """Weight 0 of the pair of arcs? a is -1 at the start."""
        key = (a + 1) << 20 | b
        known = self.pairs.get(key)
        if known is None:
            own = [self.text[b]] if a < 0 else [self.text[a], self.text[b]]
            known = self.merged("".join(own)) == own
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def merge_path(self, s: str) -> list[int]:
        n = len(s)
        last: list[int | None] = [None] * (n + 1)
        last[0] = -1
        begins, ids, follows = self.begins, self.ids, self.follows
        for i in range(n):
            a = last[i]
            if a is None:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                arc = s[i:j]
                if arc not in begins:
                    break
                if last[j] is None and (t := ids.get(arc)) is not None and follows(a, t):
                    last[j] = t
        out = []
        while n:
            t = last[n]
            out.append(t)
            n -= len(self.text[t])
        return out[::-1]

    def score_path(self, s: str) -> list[int]:
        n = len(s)
        best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])] + [(float("inf"), 0, [])] * n
        for i in range(n):
            weight = best[i][0]
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                arc = s[i:j]
                if arc not in self.begins:
                    break
                if (t := self.ids.get(arc)) is not None:
                    single |= j == i + 1
                    if weight - self.score[t] < best[j][0]:
                        best[j] = (weight - self.score[t], i, [t])
            if not single and weight - self.least < best[i + 1][0]:
                best[i + 1] = (weight - self.least, i, self.fallback(s[i]))
        out: list[int] = []
        while n:
            _, i, own = best[n]
            out = own + out
            n = i
        return out

    def between_cuts(self, s: str) -> list[int]:
        if self.kind == UNIGRAM:
            return self.score_path(s)
        if len(s) == 1:
            return [self.ids[s]] if s in self.ids else self.fallback(s)
        if SPACE * 2 in s:
            return [self.ids[x] for x in self.merged(s)]
        return self.merge_path(s)

    def all_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """follows() in arrays, by a direct-mapped table in front of the dictionary."""
        keys = (a.astype(np.int64) + 1) << 20 | b
        slot = ((keys.view(np.uint64) * _MIX) >> np.uint64(44)).astype(np.int64)
        known = self.pair_keys[slot] == keys
        out = self.pair_values[slot]
        if not known.all():
            new, back = np.unique(keys[~known], return_inverse=True)
            values = np.array([self.follows((k >> 20) - 1, k & 0xFFFFF) for k in new.tolist()], bool)
            out[~known] = values[back]
            at = ((new.view(np.uint64) * _MIX) >> np.uint64(44)).astype(np.int64)
            self.pair_keys[at], self.pair_values[at] = new, values
            again = self.pair_keys[at] != new  # two new pairs for one slot: the one whose key stayed has its value
            if again.any():
                order = np.flatnonzero(~again)
                self.pair_values[at[order]] = values[order]
        return out

    def merge_paths(self, parts: list[str]) -> list[bytes | None]:
        """merge_path() of many parts (up to ARRAY_LENGTH characters) at once, as packed ids; None where a character has no piece."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-n, kind="stable")
        size = n[order]
        most = int(size[0])
        flat = np.frombuffer("".join(parts[i] for i in order.tolist()).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        codes = np.zeros((len(parts), most), np.uint64)
        codes[np.arange(most)[None, :] < size[:, None]] = flat
        last = np.full((len(parts), most + 1), -2, np.int32)
        last[:, 0] = -1
        for i in range(most):
            rows = np.arange(int(np.searchsorted(-size, -i, side="left")))  # those longer than i
            rows = rows[last[rows, i] != -2]
            h = np.full(len(rows), 7, np.uint64)
            for j in range(i + 1, min(most, i + self.longest) + 1):
                inside = size[rows] >= j
                if not inside.all():
                    rows, h = rows[inside], h[inside]
                if not len(rows):
                    break
                h = h * _BASE + codes[rows, j - 1]
                found, piece = self.arcs.find(h)
                if not found.all():
                    rows, h, piece = rows[found], h[found], piece[found]
                open_ = np.flatnonzero((piece >= 0) & (last[rows, j] == -2))
                if len(open_):
                    own, t = rows[open_], piece[open_]
                    ok = self.all_follow(last[own, i], t)
                    last[own[ok], j] = t[ok]
        at = size.copy()
        lost = last[np.arange(len(parts)), at] == -2
        at[lost] = 0
        steps = []
        live = np.flatnonzero(at > 0)
        while len(live):
            t = last[live, at[live]]
            step = np.full(len(parts), -1, np.int32)
            step[live] = t
            steps.append(step)
            at[live] -= self.sizes[t]
            live = live[at[live] > 0]
        table = np.stack(steps[::-1], axis=1) if steps else np.zeros((len(parts), 0), np.int32)
        width = table.shape[1]
        starts = (np.arange(1, len(parts) + 1) * width - (table >= 0).sum(axis=1)) * 4
        packed = np.ascontiguousarray(table).tobytes()
        out: list[bytes | None] = [None] * len(parts)
        for k, i, j, gone in zip(order.tolist(), starts.tolist(), (np.arange(1, len(parts) + 1) * 4 * width).tolist(), lost.tolist(), strict=True):
            out[k] = None if gone else packed[i:j]
        return out

    def part(self, s: str) -> list[int]:
        out: list[int] = []
        i = 0
        for j in range(1, len(s) + 1):
            if j == len(s) or s[j - 1 : j + 1] not in self.joined:
                out += self.between_cuts(s[i:j])
                i = j
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers end to end."""
        split = [self.parts.findall(self.normalised(x)) for x in texts]
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        known: dict[str, bytes] = {}  # of this slice
        unknown = []
        for s in set().union(*split):
            ids = self.new.get(s) or self.old.get(s)
            if ids is None:
                unknown.append(s)
            else:
                known[s] = ids
        plain = [s for s in unknown if len(s) <= ARRAY_LENGTH and SPACE * 2 not in s] if self.kind == BPE else []
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            known.update((s, ids) for s, ids in zip(some, self.merge_paths(some), strict=True) if ids is not None)
        for s in unknown:
            if s not in known:
                known[s] = np.array(self.part(s), np.int32).tobytes()
        for s in unknown[: CACHE - len(self.new)]:
            if len(s) < 48:
                self.new[s] = known[s]
        get = known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def decode(self, ids: list[int]) -> str:
        made = self.made
        b = b"".join(map(made.__getitem__, ids))
        return (b[1:] if self.prefix and b[:1] == b" " else b).decode("utf-8", "replace")


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """Once for each Python worker."""
    key = hash(model)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encode_column(t: Transducer, texts: list[bytes | None]) -> list:
    plain = [b.decode() if b else "" for b in texts]
    packed = t.packed(plain)
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    values = np.frombuffer(b"".join(packed), np.int32)
    owner = np.repeat(np.arange(len(packed)), sizes)
    own_bytes = np.bincount(owner[t.is_byte[values]], minlength=len(packed))
    same = [t.decode(np.frombuffer(x, np.int32).tolist()) == y for x, y in zip(packed, plain, strict=True)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(sizes), pa.array(own_bytes.astype(np.int64)), same]


def model_bytes(docs: DataFrame, path: str) -> bytes:
    """A driver-side path or one that only Spark's readers open."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])


def encoded(docs: DataFrame, keys: list[Column], path: str = MODEL_FILE, text: str = "text") -> DataFrame:
    """keys, then ids, n_tokens, n_byte_tokens and round_trip: decoding the ids gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(docs, path))  # a vocabulary file
    return map_texts(docs, keys, lambda texts: encode_column(compiled(shared.value), texts), "ids array<int>, n_tokens bigint, n_byte_tokens bigint, round_trip boolean", text)


def decoded(rows: DataFrame, keys: list[Column], path: str = MODEL_FILE, ids: str = "ids") -> DataFrame:
    """keys and text, from a column of ids; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(model_bytes(rows, path))

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = compiled(shared.value)
        for x in batches:
            yield pd.Series([None if v is None else t.decode(list(v)) for v in x], dtype=object)

    return rows.select(*keys, back(F.col(ids)).alias("text"))


def op5_rows(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    return encoded(docs, [F.col("doc_id")], path)
