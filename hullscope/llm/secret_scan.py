"""Secret scans by grammar inference.

``infer`` learns a probabilistic automaton from labelled credentials of one kind: it starts from their prefix tree and
merges states, red and blue, the most frequent first, that are statistically compatible: equal outgoing and end frequencies
(Hoeffding bound, checked down the tree) and equal mean remaining length. A fixed prefix stays a chain of states, a part of
fixed length becomes a chain of one state a place, and a part of any length folds into loops, so the automaton and nothing
else decides the length. A character that a state hasn't seen, of a class it has seen two members of, is let through at the
price of half an example.

Every start is scored: in each run of LEAST or more credential characters (``[A-Za-z0-9+/_=.-]``) all automata start at the
run's first character and after every character that is no letter or digit, and walk until they reject. An end counts where
no letter or digit follows. Its score is the log-odds in bits of the automaton's probability, end included, against a
uniform choice of characters; it becomes a span if the score reaches the kind's threshold, which labelled credentials kept
out of the inference set. Of a kind's ends from one start
the last counts; of spans that overlap the first, then the longest, then the highest score. Where two walks reach one state the better one goes
on, so the time is linear in the text.

Spans of the base patterns always stay; a found span that one of them overlaps adds nothing.

Defined cases: null counts as empty; empty texts have no spans; an empty table gives an empty result. Offsets are code
points, end exclusive. Repeated rows are scanned each. Extra columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
BASE_KINDS = ("assign", "access", "hex")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_LONG = re.compile(r"[^\x20\x09-\x0D]{20,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
LEAST = 20
ALPHABET = 66
_BREAK = re.compile(r"[^A-Za-z0-9]")
#: Characters of the tree below a state that decide which state takes it.
DEPTH = 8
LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
ALNUM = LOWER + UPPER + DIGITS

#: Public credential formats as (kind, parts); a part is a literal, or (characters, least, mean) with as many
#: more than the least as a geometric distribution of that mean says.
FORMATS: dict[str, list[str | tuple[str, int, int]]] = {
    "aws_access": ["ASIA", (UPPER + "234567", 16, 0)],
    "github": ["ghp_", (ALNUM, 36, 0)],
    "gitlab": ["glpat-", (ALNUM + "_-", 20, 0)],
    "google_api": ["AIza", (ALNUM + "_-", 35, 0)],
    "jwt": ["eyJ", (ALNUM + "_-", 12, 20), ".eyJ", (ALNUM + "_-", 20, 60), ".", (ALNUM + "_-", 22, 60)],
    "slack": ["xoxb-", (DIGITS, 10, 1), "-", (DIGITS, 10, 1), "-", (ALNUM, 24, 0)],
    "stripe": ["sk_live_", (ALNUM, 24, 0)],
}


def labelled(kind: str, count: int = 600, seed: int = 7) -> list[str]:
    """Labelled credentials of a public format, drawn by a fixed seed."""
    draw = random.Random(f"{seed}:{kind}")

    def part(p: str | tuple[str, int, int]) -> str:
        if isinstance(p, str):
            return p
        more = int(math.log(1 - draw.random()) / math.log(p[2] / (p[2] + 1))) if p[2] else 0
        return "".join(draw.choices(p[0], k=p[1] + more))

    return ["".join(map(part, FORMATS[kind])) for _ in range(count)]


class Automaton:
    """States are numbers; next[state][character] = [state, count]; of each state: the strings through it, those that end
    there, and the sum and sum of squares of what they still have to go."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.next: list[dict[str, list]] = [{}]
        self.total, self.ends, self.left, self.left2 = [0], [0], [0], [0]
        for s in examples:
            at = 0
            for i in range(len(s) + 1):
                go = len(s) - i
                self.total[at] += 1
                self.left[at] += go
                self.left2[at] += go * go
                if not go:
                    self.ends[at] += 1
                    break
                if s[i] not in self.next[at]:
                    self.next[at][s[i]] = [len(self.next), 0]
                    self.next.append({})
                    for x in (self.total, self.ends, self.left, self.left2):
                        x.append(0)
                arc = self.next[at][s[i]]
                arc[1] += 1
                at = arc[0]
        self.spread = self.left2[0] / max(1, len(examples)) - (self.left[0] / max(1, len(examples))) ** 2
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.merge_all()
        self.arcs = self.compiled()

    def differs(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def length_gap(self, a: int, b: int) -> float:
        """Difference of the mean remaining lengths in standard errors; the variance of all examples' lengths counts as two."""
        n, m = self.total[a], self.total[b]
        gap = abs(self.left[a] / n - self.left[b] / m)
        if gap < 1e-9:
            return 0.0
        spread = (self.left2[a] - self.left[a] ** 2 / n + self.left2[b] - self.left[b] ** 2 / m + 2 * self.spread) / (n + m)
        return gap / math.sqrt(spread * (1 / n + 1 / m)) if spread > 1e-9 else math.inf

    def compatible(self, a: int, b: int) -> bool:
        """The blue state b and DEPTH characters of the tree below it against a and what follows it."""
        pairs = [(a, b, 0)]
        while pairs:
            a, b, depth = pairs.pop()
            n, m = self.total[a], self.total[b]
            if self.differs(self.ends[a], n, self.ends[b], m) or self.length_gap(a, b) > 4 + 16 / min(n, m):  # lengths have long tails
                return False
            own, other = self.next[a], self.next[b]
            slack = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c, q in other.items():
                p = own.get(c)
                if abs((p[1] if p else 0) / n - q[1] / m) > slack:
                    return False
                if p and depth < DEPTH:
                    pairs.append((p[0], q[0], depth + 1))
            if any(p[1] / n > slack for c, p in own.items() if c not in other):
                return False
        return True

    def fold(self, a: int, b: int) -> list[tuple[int, str]]:
        """Adds the tree below b to a; the arcs that are new."""
        work, new = [(a, b)], []
        while work:
            a, b = work.pop()
            for x in (self.total, self.ends, self.left, self.left2):
                x[a] += x[b]
            for c, (to, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    work.append((self.next[a][c][0], to))
                else:
                    self.next[a][c] = [to, n]
                    new.append((a, c))
        return new

    def fit(self, red: int, blue: int) -> float:
        """Log-likelihood of the strings below the blue state, DEPTH characters of them, from the red one on."""
        work, out = [(red, blue, 0)], 0.0
        while work:
            a, b, depth = work.pop()
            n = self.total[a] + ALPHABET + 1
            out += self.ends[b] * math.log((self.ends[a] + 1) / n)
            for c, (to, k) in self.next[b].items():
                arc = self.next[a].get(c)
                out += k * math.log(((arc[1] if arc else 0) + 1) / n)
                if depth < DEPTH:
                    if arc:
                        work.append((arc[0], to, depth + 1))
                    else:
                        out -= k * math.log(ALPHABET)  # the rest is left to chance for one more character
        return out

    def merge_all(self) -> None:
        """The blue state that most strings reach comes next, so that what follows rare arcs is judged when it has gathered.
        It may join its parent (a loop) or a red state that another arc of its parent leads to (one place of a format, or
        the way out of a loop); of those that it is compatible with, the one that explains it best takes it."""
        red: dict[int, None] = {0: None}
        blue = {(0, c): None for c in sorted(self.next[0])}
        while blue:
            parent, c = max(blue, key=lambda x: self.next[x[0]][x[1]][1])
            del blue[parent, c]
            state = self.next[parent][c][0]
            if state in red:
                continue
            places = dict.fromkeys([parent, *(to for _, (to, _) in sorted(self.next[parent].items()) if to in red)])
            near = [r for r in places if self.compatible(r, state)]
            if not near:
                red[state] = None
                blue |= {(state, x): None for x in sorted(self.next[state])}
            else:
                into = near[0] if len(near) == 1 else max(near, key=lambda r: self.fit(r, state) - self.length_gap(r, state) ** 2 / 2)
                self.next[parent][c][0] = into
                blue |= {x: None for x in sorted(self.fold(into, state)) if x[0] in red}

    def compiled(self) -> list[dict[str, tuple[int, float]]]:
        """By state and character: (state, log2 P + log2 of the alphabet), with unseen members of classes seen twice."""
        out = []
        for state, arcs in enumerate(self.next):
            n = self.total[state] or 1
            own = {c: (to, math.log2(k / n) + math.log2(ALPHABET)) for c, (to, k) in arcs.items()}
            for members in (LOWER, UPPER, DIGITS):
                seen = [arcs[c] for c in members if c in arcs]
                if len(seen) >= 2:
                    to = max(seen, key=lambda x: (x[1], -x[0]))[0]
                    for c in members:
                        own.setdefault(c, (to, math.log2(0.5 / n) + math.log2(ALPHABET)))
            out.append(own)
        return out

    def bits(self, s: str) -> float:
        """log2-odds of the string, end included, against a uniform choice of characters; -inf where it isn't accepted."""
        at, odds = 0, 0.0
        for c in s:
            arc = self.arcs[at].get(c)
            if arc is None:
                return -math.inf
            at, odds = arc[0], odds + arc[1]
        return odds + math.log2(self.ends[at] / self.total[at]) if self.ends[at] else -math.inf


@dataclass
class Scanner:
    automata: dict[str, Automaton]
    thresholds: dict[str, float]

    def kind_of(self, s: str) -> tuple[str | None, float]:
        """The kind of a whole string."""
        best = max(((a.bits(s), k) for k, a in self.automata.items() if a.bits(s) >= self.thresholds[k]), default=(-math.inf, None))
        return best[1], best[0]

    def walk(self, run: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of what reaches its threshold, from every start to every end."""
        out: list[tuple[int, int, str, float]] = []
        last = len(run) - 1
        starts = [0, *(m.end() for m in _BREAK.finditer(run) if m.end() <= last)]
        active: dict[tuple[str, int], tuple[float, int]] = {}
        i = done = 0  # done: how many starts were used
        while True:
            if not active:
                if done == len(starts):
                    return out
                i = starts[done]
            c = run[i]
            if done < len(starts) and starts[done] == i:
                done += 1
                for k, a in self.automata.items():
                    if c in a.arcs[0] and active.get((k, 0), (-math.inf, 0))[0] < 0:
                        active[k, 0] = (0.0, i)
            following: dict[tuple[str, int], tuple[float, int]] = {}
            for (k, state), (odds, start) in active.items():
                arc = self.automata[k].arcs[state].get(c)
                if arc is not None:
                    at = (k, arc[0])
                    if at not in following or following[at][0] < odds + arc[1]:
                        following[at] = (odds + arc[1], start)
            active = following
            if active and (i == last or not run[i + 1].isalnum()):
                for (k, state), (odds, start) in active.items():
                    a = self.automata[k]
                    if a.ends[state] and (score := odds + math.log2(a.ends[state] / a.total[state])) >= self.thresholds[k]:
                        out.append((start, i + 1, k, score))
            if i == last:
                return out
            i += 1

    def found(self, run: str) -> list[tuple[int, int, str]]:
        """Spans that don't overlap: of a kind's ends from one start the last; the first start, the longest, the highest score."""
        out: list[tuple[int, int, str]] = []
        last = {(a, k): (a, b, k, odds) for a, b, k, odds in self.walk(run)}
        for a, b, k, _ in sorted(last.values(), key=lambda x: (x[0], -x[1], -x[3], x[2])):
            at = bisect.bisect(out, (a,))
            if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or out[at][0] >= b):
                out.insert(at, (a, b, k))
        return out


def infer(examples: dict[str, list[str]]) -> Scanner:
    """A quarter of each kind's examples is kept out and sets the threshold: the score that all but one in a hundred of
    them reach (one that the automaton rejects has the score -inf and counts), less half a bit."""
    automata, thresholds = {}, {}
    for kind, all_ in sorted(examples.items()):
        fit, held = [x for i, x in enumerate(all_) if i % 4], all_[::4]
        automata[kind] = Automaton(fit)
        scores = sorted(map(automata[kind].bits, held or fit))
        least = scores[len(scores) // 100]
        thresholds[kind] = least - 0.5 if least > -math.inf else min([x for x in scores if x > -math.inf], default=math.inf)
    return Scanner(automata, thresholds)


def base_spans(text: str, raw: bytes, long_words: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    out = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for at, word in long_words:  # a run of 32 lies in one word
        if len(word) >= 32:
            out += [(at + m.start(), at + m.end(), "hex") for m in _HEX_RUN.finditer(word)]
    return out


def spans(raw: bytes | None, scanner: Scanner) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then by kind as listed."""
    if not raw:
        return [], []
    text = raw.decode()
    order = {k: i for i, k in enumerate((*BASE_KINDS, *sorted(scanner.automata)))}
    by = lambda x: (x[0], order[x[2]], x[1])
    long_words = [(m.start(), m[0]) for m in _LONG.finditer(text)]
    base = sorted(base_spans(text, raw, long_words), key=by)
    more = []
    for at, word in long_words:
        for m in _CANDIDATE.finditer(word):
            first = at + m.start()
            more += [(first + a, first + b, k) for a, b, k in scanner.found(m[0])]
    return base, sorted(base + apart(more, base), key=by)


def apart(more: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that no base span overlaps."""
    starts = [x[0] for x in base]
    reach: list[int] = []
    for x in base:
        reach.append(max(x[1], reach[-1] if reach else 0))
    out = []
    for x in more:
        i = bisect.bisect_left(starts, x[1])
        if i == 0 or reach[i - 1] <= x[0]:
            out.append(x)
    return out


def shown(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(texts: list[bytes | None], scanner: Scanner) -> list[list]:
    out: list[list] = [[] for _ in range(5)]
    for t in texts:
        base, every = spans(t, scanner)
        counts = defaultdict(int)
        for _, _, k in base:
            counts[k] += 1
        for col, x in zip(out, (*(counts[k] for k in BASE_KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)), strict=True):
            col.append(x)
    return out


def scanned(docs: DataFrame, keys: list[Column], scanner: Scanner, text: str = "text") -> DataFrame:
    """keys, then n_assign, n_access, n_hex, base_sha256 and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # automata of a few hundred strings a kind
    return map_texts(docs, keys, lambda texts: scan(texts, shared.value), "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", text)


def default_scanner(make: Callable[[str], list[str]] = labelled) -> Scanner:
    return infer({k: make(k) for k in FORMATS})


def op8_rows(docs: DataFrame) -> DataFrame:
    return scanned(docs, [F.col("doc_id")], default_scanner())
