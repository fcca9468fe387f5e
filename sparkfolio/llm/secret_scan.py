"""Secret scans: base patterns, and credential formats inferred as probabilistic automata.

Each format is learned from labelled credentials: their prefix tree's states are merged where their next symbols and the
lengths of what is still to come are statistically compatible (Hoeffding bounds), which leaves a probabilistic automaton.
Every span of a text's runs of token characters that a format allows (from the run's begin, a mark in it or a literal prefix to its end or a
mark, of a length that the automata give a chance) is scored by its likelihood under each automaton, its end included; it's a
credential where that is as high as for labelled ones and clearly higher than under ordinary words.
"""

from __future__ import annotations

import bisect
import math
import os
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SpanHash, pieces

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough

_U, _L, _D = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Published credential formats as (literal prefix, alphabet, length after the prefix).
FORMATS = {
    "cloud access id": ("AKIA", _U + "234567", 16),
    "code host token": ("ghp_", _U + _L + _D, 36),
    "chat token": ("xoxb-", _D + _L + _U + "-", 50),
    "map key": ("AIza", _U + _L + _D + "-_", 35),
    "payment key": ("sk_live_", _U + _L + _D, 24),
    "web token": ("eyJ", _U + _L + _D + "-_", 60),
    "hex digest": ("", "abcdef" + _D, 40),
    "secret key": ("", _U + _L + _D + "+/", 40),
}
#: Labelled credentials of a format that an automaton is learned from, and as many again to calibrate it; significance of the
#: merging tests; nats by which a credential must be likelier than ordinary text, or less if labelled ones are; the least
#: likelihood of a candidate's length under a format.
LABELLED, ALPHA, MARGIN, LENGTH = 150, 0.05, 10.0, 1e-4
#: Symbols that all labelled credentials of a format begin with make a literal prefix if there are so many.
LITERAL = 3
#: Frequent words of several languages: which letters follow each other in words.
WORDS = """
the of and to in that is was for with as his on be at by had not are but from have they which you were all their one been there would when who will more out said what about
into than them could other then some these two may first like only new people time over such through after where most should well because great general information international number service
government development administration education environment university understanding responsible configuration application performance available different important question something
der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem so zum haben nur oder aber vor zur
bis mehr durch man sein wurde sei gesellschaft entwicklung verantwortung zwischen geschwindigkeit versicherung schaft keit heit lich ung wirtschaft deutschland verschiedene bundesrepublik
le de un et avoir que pour dans ce il qui ne sur se pas plus pouvoir par je avec tout faire son mettre autre on mais nous comme ou si leur homme elle devoir avant deux grand premier autres quelques
gouvernement organisation environnement administration travail tion eau ment toujours maintenant aujourd quelque internationale
la los que el en por con para una no las del su lo como pero sus esta sobre entre cuando muy sin ser hay desde todo nos durante estado todos mucho nada cosas tiempo mismo vida ahora parte nuestro
ciudad trabajo gobierno desarrollo conocimiento responsabilidad mente cion dad importante siempre mientras anteriormente
www http https com org net html index user name file path home src lib main test data value key list type string config server client request response error message default
"""
#: How a symbol's class follows another's in words, names and numbers: upper, lower, digit, mark; -1 at the start.
STEPS = {-1: (0.25, 0.55, 0.15, 0.05), 0: (0.49, 0.45, 0.03, 0.03), 1: (0.04, 0.88, 0.02, 0.06), 2: (0.03, 0.04, 0.83, 0.1), 3: (0.2, 0.5, 0.2, 0.1)}
#: Chance that a word ends after a symbol of each class.
ENDS = (0.1, 0.15, 0.25, 0.05)
_CLASSES = [_U, _L, _D, "+/_.-"]
SYMBOLS = "".join(_CLASSES)
_CLASS = {c: k for k, cs in enumerate(_CLASSES) for c in cs}
_LOW = 1e-6


def labelled_credentials(name: str, n: int, seed: int) -> list[str]:
    """Credentials of a published format, drawn at random: what is learned from where no labelled ones are given."""
    prefix, alphabet, length = FORMATS[name]
    rng = random.Random(f"{name}:{seed}")
    return [prefix + "".join(rng.choice(alphabet) for _ in range(length)) for _ in range(n)]


class Node:
    """A state of the prefix tree: edges and their counts, strings that end here, and how long strings still are."""

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.count: Counter = Counter()
        self.end = 0
        self.rest: Counter = Counter()

    @property
    def through(self) -> int:
        return self.rest.total()


class Automaton:
    """A probabilistic automaton inferred from strings by state merging.

    States are taken by depth, and at each depth those of most strings first: a state is merged with a compatible one
    of its own depth or else of a smaller depth, and is kept if there is none.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        root = Node()
        for s in strings:
            node = root
            for i, c in enumerate(s):
                node.rest[len(s) - i] += 1
                node.count[c] += 1
                node = node.next.setdefault(c, Node())
            node.rest[0] += 1
            node.end += 1
        kept, level = [root], [root]
        while level:
            found: list[Node] = []
            edges = sorted(((q, c) for q in level for c in q.next), key=lambda e: (-e[0].next[e[1]].through, e[1]))
            for q, c in edges:  # of one depth: they are alike unless enough strings say that they aren't
                b = q.next[c]
                if (into := next((r for r in found if r is not b and self._alike(r, b)), None)) is not None:
                    self._fold(into, b)
                    q.next[c] = into
                elif all(b is not r for r in found):
                    found.append(b)
            level = []
            for b in found:
                if (into := next((r for r in kept if self._alike(r, b)), None)) is None:
                    kept.append(b)
                    level.append(b)
                else:
                    for q in kept:
                        for c in q.next:
                            if q.next[c] is b:
                                q.next[c] = into
                    self._fold(into, b)
        self._tables(kept)

    def _near(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return not n1 or not n2 or abs(f1 / n1 - f2 / n2) < self.alpha * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, a: Node, b: Node) -> bool:
        """Whether two states are compatible in the lengths to come, the classes and the symbols that follow."""
        n, m = a.through, b.through
        if not all(self._near(a.rest[k], n, b.rest[k], m) for k in a.rest.keys() | b.rest.keys()):
            return False
        for cs in _CLASSES:  # a random part is told by its classes before its single symbols
            if not self._near(sum(a.count[c] for c in cs), n, sum(b.count[c] for c in cs), m):
                return False
        return all(self._near(a.count[c], n, b.count[c], m) for c in a.count.keys() | b.count.keys())

    def _fold(self, a: Node, b: Node) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            a.end += b.end
            a.rest.update(b.rest)
            a.count.update(b.count)
            for c, child in b.next.items():
                if c not in a.next:
                    a.next[c] = child
                elif a.next[c] is not child:
                    todo.append((a.next[c], child))

    def _tables(self, kept: list[Node]) -> None:
        """logp and next by state and symbol, log probability to end by state, and which lengths are likely at all.

        A symbol not seen in a state counts by its class and leads where its class, or else any symbol, mostly does; one
        state more takes what comes after an end."""
        at = {id(q): i for i, q in enumerate(kept)}
        n = len(kept) + 1
        self.states, every = len(kept), len(SYMBOLS)
        self.logp, self.next, self.end = np.full((n, every), math.log(_LOW)), np.full((n, every), n - 1), np.full(n, math.log(_LOW))
        for i, q in enumerate(kept):
            through = max(q.through, 1)
            self.end[i] = math.log(max(q.end / through, _LOW))
            any_of = at[id(q.next[max(q.count, key=lambda c: q.count[c])])] if q.count else n - 1
            for cs in _CLASSES:
                seen = [c for c in cs if q.count[c]]
                share = sum(q.count[c] for c in cs) / through
                to = at[id(q.next[max(seen, key=lambda c: q.count[c])])] if seen else any_of
                for c in cs:
                    k = SYMBOLS.index(c)
                    self.logp[i, k] = math.log(0.5 * q.count[c] / through + 0.5 * share / len(cs) + _LOW)
                    self.next[i, k] = at[id(q.next[c])] if c in seen else to
        step = np.zeros((n, n))
        np.add.at(step, (np.repeat(np.arange(n), every), self.next.ravel()), np.exp(self.logp).ravel())
        now, likely = np.eye(n)[0], []
        while now.sum() >= LENGTH:
            likely.append(now @ np.exp(self.end) >= LENGTH)
            now = now @ step
        self.likely = np.array([*likely, False])  # the last stands for all greater lengths

    def score(self, s: str) -> float:
        """Log likelihood of a string, its end included."""
        q, total = 0, 0.0
        for c in s:
            k = SYMBOLS.index(c)
            total += self.logp[q, k]
            q = self.next[q, k]
        return total + self.end[q]


class Ordinary:
    """Words, names and numbers: the class of a symbol by the class before, a letter by the letter before, whatever its case.
    States are the symbols, and one for the start."""

    def __init__(self):
        pairs, single = Counter(), Counter()
        for w in WORDS.split():
            pairs.update(zip(w, w[1:], strict=False))
            single.update(w)
        n, after = sum(single.values()), Counter()
        for (x, _), k in pairs.items():
            after[x] += k
        every = len(SYMBOLS)
        self.logp, self.next = np.zeros((every + 1, every)), np.tile(np.arange(every), (every + 1, 1))
        self.end = np.array([math.log(ENDS[_CLASS[c]]) for c in SYMBOLS] + [math.log(_LOW)])
        for i, x in enumerate([*SYMBOLS, ""]):
            before = x.lower() if x and _CLASS[x] < 2 else ""
            stay = math.log(1 - ENDS[_CLASS[x]]) if x else 0.0
            for k, y in enumerate(SYMBOLS):
                p = STEPS[_CLASS[x] if x else -1][_CLASS[y]]
                if _CLASS[y] < 2:
                    one = 0.9 * single[y.lower()] / n + 0.1 / 26
                    p *= (pairs[before, y.lower()] + 5 * one) / (after[before] + 5)
                else:
                    p /= len(_CLASSES[_CLASS[y]])
                self.logp[i, k] = stay + math.log(p)
        self.start = every


def monotonous(s: str) -> float:
    """Log likelihood of a run that repeats itself, or of at most 8 symbols over and over, whichever is likelier."""
    n, every, out = len(s), len(SYMBOLS), []
    for lag in range(1, 5):
        same = sum(x == y for x, y in zip(s, s[lag:], strict=False))
        out.append(same * math.log(0.9) + max(n - lag - same, 0) * math.log(0.1 / every) - min(lag, n) * math.log(every))
    if (k := len(set(s))) <= 8:
        out.append(-n * math.log(k) - math.log(math.comb(every, k)))
    return max(out)


class Detector:
    """Automata with their calibrated thresholds, and the model of ordinary text."""

    def __init__(self, learn: dict[str, list[str]], check: dict[str, list[str]]):
        """From labelled credentials by format: those to learn from, and others to calibrate with."""
        self.ordinary, self.names = Ordinary(), sorted(learn)
        self.automata = [Automaton(learn[x]) for x in self.names]
        self.least, self.lead = [], []
        for x, a in zip(self.names, self.automata, strict=True):
            held = check.get(x) or learn[x]
            own, plain = np.array([a.score(s) for s in held]), self.scores(held)[:, -1]
            # as 99 of 100 labelled ones have it, with a little room
            self.least.append(np.quantile(own, 0.01) - 2.0)
            self.lead.append(max(0.0, min(MARGIN, np.quantile(own - plain, 0.01))))
        #: All lengths that some format gives a chance, and the formats' literal prefixes with the lengths of each.
        each = [np.flatnonzero(a.likely) for a in self.automata]
        self.sizes = np.unique(np.concatenate(each)) if each else np.zeros(0, dtype=np.int64)
        same = [os.path.commonprefix(learn[x]) for x in self.names]
        self.literals = [(re.escape(x.encode()), n) for x, n in zip(same, each, strict=True) if len(x) >= LITERAL]

    def scores(self, strings: list[str]) -> np.ndarray:
        """Log likelihoods of strings: a column for each automaton, and the last for ordinary text."""
        size = np.array([len(s) for s in strings], dtype=np.int64)
        flat = np.frombuffer("".join(strings).encode(), dtype=np.uint8)
        return self.run(_SYMBOL[flat], np.cumsum(size) - size, size, -np.inf)

    def run(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, least: float | np.ndarray) -> np.ndarray:
        """As scores(), of spans of an array of symbols.  A span whose likelihood under all automata is below ``least``
        before its end is not followed further, as every symbol lowers it; its scores are then negative infinity."""
        models = [*self.automata, self.ordinary]
        out = np.full((len(start), len(models)), -np.inf)
        total, state = np.zeros((len(start), len(models))), np.zeros((len(start), len(models)), dtype=np.int64)
        state[:, -1] = self.ordinary.start
        rows, t = np.arange(len(start)), 0
        while len(rows):
            ends = size[rows] == t
            if ends.any():
                for m, model in enumerate(models):
                    out[rows[ends], m] = total[ends, m] + model.end[state[ends, m]]
            go = ~ends & (total[:, :-1] >= least).any(axis=1)
            rows, total, state = rows[go], total[go], state[go]
            c = symbols[start[rows] + t]
            for m, model in enumerate(models):
                total[:, m] += model.logp[state[:, m], c]
                state[:, m] = model.next[state[:, m], c]
            t += 1
        return out

    def lengths(self, size: np.ndarray) -> np.ndarray:
        """By span and automaton: whether the length alone is likely enough."""
        return np.stack([a.likely[np.minimum(size, len(a.likely) - 1)] for a in self.automata], axis=1)

    def accepts(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which spans some automaton finds as likely as its own credentials and likelier than ordinary words by its lead."""
        return self.margins(symbols, start, size) > -np.inf

    def margins(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """By how much the likeliest automaton that accepts a span exceeds ordinary words; negative infinity if none does."""
        scores = self.run(symbols, start, size, np.array(self.least))
        with np.errstate(invalid="ignore"):
            good = (scores[:, :-1] >= np.array(self.least)) & (scores[:, :-1] - scores[:, -1:] >= np.array(self.lead))
        good &= self.lengths(size)
        for i in np.flatnonzero(good.any(axis=1)):
            s = "".join(SYMBOLS[k] for k in symbols[start[i] : start[i] + size[i]])
            good[i] &= scores[i, :-1] > monotonous(s)
        with np.errstate(invalid="ignore"):
            return np.where(good, scores[:, :-1] - scores[:, -1:], -np.inf).max(axis=1, initial=-np.inf)


def published() -> Detector:
    """The detector of the published formats."""
    return Detector({x: labelled_credentials(x, LABELLED, 1) for x in FORMATS}, {x: labelled_credentials(x, LABELLED, 2) for x in FORMATS})


def learned(labelled: DataFrame, rows: int = LABELLED) -> Detector:
    """A detector from labelled credentials (format, credential); nulls and those with other than token characters don't count.

    Of each format about ``rows`` are learned from and as many calibrate, chosen by a hash: a bound on what reaches the driver.
    """
    good = labelled.filter("format is not null").filter(F.col("credential").rlike(r"^[A-Za-z0-9+/_.-]+$")).select("format", "credential")
    sizes = good.groupBy("format").agg(F.count("*").alias("n"))
    spot = F.pmod(F.xxhash64("credential", F.lit("label")), F.lit(1_000_000)) / 1_000_000
    some = good.join(sizes, "format").filter(spot < 2 * rows / F.col("n")).select("format", "credential", (F.pmod(F.xxhash64("credential"), F.lit(2)) == 0).alias("check")).collect()
    parts: tuple[dict, dict] = ({}, {})
    for r in sorted(some, key=lambda r: (r["format"], r["credential"])):
        parts[r["check"]].setdefault(r["format"], []).append(r["credential"])
    return Detector(*parts)


def base_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the base matches."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _runs(p, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of a piece's marked bytes; document bounds part runs."""
    edge = np.zeros(len(ok) + 2, dtype=bool)
    edge[1:-1] = ok
    first = np.flatnonzero(edge[1:-1] & ~edge[:-2])
    stop = np.flatnonzero(edge[1:-1] & ~edge[2:]) + 1
    inner = p.offsets[1:-1][(p.offsets[1:-1] > 0) & (p.offsets[1:-1] < len(ok))]
    inner = np.unique(inner[ok[inner] & ok[inner - 1]]) if len(inner) else inner
    return np.sort(np.append(first, inner)), np.sort(np.append(stop, inner))


def _suspects(p) -> np.ndarray:
    """Documents of a piece that can hold a base match: with = or :, AKIA or a long hexadecimal run."""
    d, out = p.data, np.zeros(p.n, dtype=bool)
    mark = lambda at: out.__setitem__(np.searchsorted(p.offsets, at, side="right") - 1, True)
    mark(np.flatnonzero((d == 58) | (d == 61)))
    mark(np.array([m.start() for m in re.finditer(rb"AKIA", d.tobytes())], dtype=np.int64))
    first, stop = _runs(p, ((d >= 48) & (d <= 57)) | ((d >= 97) & (d <= 102)))
    mark(first[stop - first >= 24])
    return out


_SYMBOL = np.full(256, len(SYMBOLS), dtype=np.int64)
for _k, _c in enumerate(SYMBOLS):
    _SYMBOL[ord(_c)] = _k


_PARTS = np.zeros(256, dtype=bool)
_PARTS[[ord(c) for c in "+/_.-"]] = True


def _candidates(p, detector: Detector) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every span that a format allows: from a run's begin, from behind a mark inside it or from where a format's literal
    prefix stands, up to the run's end, to a mark, or, behind a prefix, as far as that format's lengths go."""
    symbols = _SYMBOL[p.data]
    first, stop = _runs(p, symbols < len(SYMBOLS))
    sizes = detector.sizes
    long = stop - first >= sizes[0]
    starts, ends = [], []
    for a, b in zip(first[long].tolist(), stop[long].tolist()):
        marks = np.flatnonzero(_PARTS[p.data[a:b]]) + a
        begins, limits = np.unique(np.concatenate([[a], marks + 1])), np.concatenate([marks, [b]])
        # each begin meets the limits within the longest length, which are neighbours
        low, high = np.searchsorted(limits, begins + sizes[0]), np.searchsorted(limits, begins + sizes[-1], side="right")
        n = np.maximum(high - low, 0)
        starts.append(np.repeat(begins, n))
        ends.append(limits[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        text = p.data[a:b].tobytes()
        for literal, lengths in detector.literals:
            for m in re.finditer(literal, text):
                at = a + m.start() + lengths
                at = at[at <= b]
                starts.append(np.full(len(at), a + m.start()))
                ends.append(at)
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    start, end = np.concatenate(starts), np.concatenate(ends)
    fits = np.isin(end - start, sizes)
    return start[fits], end[fits]


def _formats(p, detector: Detector) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end in bytes of the accepted candidates; of overlapping ones the one of largest margin.  Each different
    candidate is scored once."""
    start, stop = _candidates(p, detector)
    _, first, back = np.unique(SpanHash(p.data)(start, stop), return_index=True, return_inverse=True)
    margin = detector.margins(_SYMBOL[p.data], start[first], (stop - start)[first])[back]
    held: list[tuple[int, int]] = []
    for i in np.lexsort((start, -margin)).tolist():
        if margin[i] == -np.inf:
            break
        span = int(start[i]), int(stop[i])
        at = bisect.bisect(held, span)
        if (at == 0 or held[at - 1][1] <= span[0]) and (at == len(held) or span[1] <= held[at][0]):
            held.insert(at, span)
    start, stop = np.array(held, dtype=np.int64).reshape(-1, 2).T
    return np.searchsorted(p.offsets, start, side="right") - 1, start, stop


def _scan(shared):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column("text")):
                found: list[list] = [[] for _ in range(p.n)]
                if len(p.data):
                    for i in np.flatnonzero(_suspects(p)).tolist():
                        found[i] = base_secrets(p.text(i))
                    for i, a, b in zip(*(x.tolist() for x in _formats(p, shared.value)), strict=True):
                        text, at = p.data[p.offsets[i] : b], int(p.offsets[i])
                        x = int(((text[: a - at] & 0xC0) != 0x80).sum())
                        if not any(s < x + b - a and x < e for k, s, e in found[i] if k != "format"):
                            found[i].append(("format", x, x + b - a))
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in sorted(f, key=lambda x: (x[1], KINDS.index(x[0])))] for f in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[p.rows], pa.array(spans, kind)], ["doc_id", "spans"])

    return run


def scan(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, spans) of every row: spans of (kind, start, end) in code points, end exclusive, by start and then kind.

    Kinds: assign, access and hex by pattern, each leftmost and non-overlapping, and format for spans of token characters
    outside these that an automaton accepts.  ``=``, ``:``, quotes and white space end a run; keys are found inside paths and names too.  The detector is that of
    the published formats unless learned() gives another.  Null and empty texts have none; repeated rows and rows
    without a doc_id are scanned each; an empty table gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector or published())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(shared), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
