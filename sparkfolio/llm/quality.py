"""Quality rules: base counts of each text, and its Jensen-Shannon distance from what its language looks like."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import SpanHash, pieces, window_hash

#: Classes of bytes: lower case, upper case, digit, white space, sentence marks, symbols, other ASCII, beyond ASCII.
CLASSES = 8
SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[list(b".,;:'\"?!-()")] = 4
_CLASS[list(SYMBOLS)] = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: So many common words are kept per language.
COMMON = 60
#: Least characters and words from which a histogram is compared, and the largest distances (0 to 1) of a kept text.
MIN_CHARS, MIN_WORDS, MAX_CLASS, MAX_WORDS = 200, 50, 0.33, 0.55
#: A language's texts of one power of two of words are kept up to so many times the way from the median distance to the upper
#: quartile, or LEAST from the median; with fewer than ENOUGH different distances the next shorter texts' limit holds.
SPREAD, LEAST, ENOUGH = 6, 0.05, 30


def _trimmed(p):
    start, end, doc = p.words()
    data = _LOWER[p.data]
    mark = _CLASS[p.data] >= 4
    mark &= p.data < 128
    stop = end.copy()
    for _ in range(3):
        stop -= mark[stop - 1] & (stop - start > 1)
    return data, start, end, stop, doc


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece and language: counts of character classes (word null, with the class in ``bin``) and of words by hash."""
    for batch in batches:
        langs = np.array([x or "" for x in batch.column("lang").to_pylist()], dtype=object)
        for p in pieces(batch.column("text"), 8 << 20):
            names, own = np.unique(langs[p.rows].astype(str), return_inverse=True)
            data, start, _, stop, doc = _trimmed(p)
            owner = np.repeat(own, np.diff(p.offsets))
            classes = np.bincount(owner * CLASSES + _CLASS[p.data], minlength=len(names) * CLASSES)
            words = np.bincount(own[doc], minlength=len(names))
            keys, owners = SpanHash(data)(start, stop).view(np.int64), own[doc]
            rows = [(str(x), None, k, int(classes[i * CLASSES + k])) for i, x in enumerate(names) for k in range(CLASSES)]
            rows += [(str(x), None, -1, int(words[i])) for i, x in enumerate(names)]
            yield _counts(*zip(*rows, strict=True))
            for i, x in enumerate(names):
                key, n = np.unique(keys[owners == i], return_counts=True)
                yield _counts([str(x)] * len(key), key, np.zeros(len(key), dtype=np.int32), n)


def _counts(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["lang", "word", "bin", "n"])


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language ("" for null): shares of character classes, hashes of its common words, their shares and that of all others.

    Counts are over all documents and words of any length; a language has CLASSES + COMMON + 1 of them, which is all that
    reaches the driver.  Words are ranked in parts by hash first, so no task ranks a whole vocabulary.
    """
    seen = docs.select("lang", "text").mapInArrow(_survey, "lang string, word long, bin int, n long").groupBy("lang", "word", "bin").agg(F.sum("n").alias("n"))
    for part in (F.pmod("word", F.lit(256)), F.lit(0)):
        top = F.row_number().over(W.partitionBy("lang", F.col("word").isNull(), part).orderBy(F.desc("n"), "word", "bin"))
        seen = seen.withColumn("top", top).filter((F.col("top") <= COMMON) | F.col("word").isNull())
    out: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    rows = seen.collect()
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        classes = np.zeros(CLASSES)
        for r in own:
            if r["word"] is None and r["bin"] >= 0:
                classes[r["bin"]] = r["n"]
        total = sum(r["n"] for r in own if r["word"] is None and r["bin"] < 0)
        words = [(r["word"], r["n"]) for r in own if r["word"] is not None]
        hashes = np.array([w for w, _ in words], dtype=np.int64).view(np.uint64)
        by = np.argsort(hashes)
        share = np.append(np.array([n for _, n in words], dtype=float)[by], total - sum(n for _, n in words))
        out[lang] = classes / max(classes.sum(), 1), hashes[by], share / max(share.sum(), 1)
    return out


def limits(docs: DataFrame, refs, most: float = MAX_WORDS) -> dict[str, list[float]]:
    """Per language the largest word distance of a kept text, by the power of two of its words.

    From the quartiles of all documents' distances, as short texts are further away by chance; different distances count
    once each, so that copies have no weight.  Always less than the distance of a text with none of the common words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    far = docs.select("lang", "text").mapInArrow(_distances(shared), "lang string, power int, distance double").distinct()
    rows = far.groupBy("lang", "power").agg(F.count("*").alias("n"), F.percentile_approx("distance", [0.5, 0.75], F.lit(1000)).alias("q")).collect()
    seen = {(r["lang"], r["power"]): r["q"] for r in rows if r["n"] >= ENOUGH}
    out = {}
    for lang, (_, _, share) in refs.items():
        none = np.append(np.zeros(len(share) - 1), 1.0)[None]
        limit, out[lang] = min(most, float(jensen_shannon(none, share)[0]) - 1e-6), []
        for power in range(64):
            if (q := seen.get((lang, power))) is not None:
                limit = min(limit, q[0] + max(SPREAD * (q[1] - q[0]), LEAST))
            out[lang].append(limit)
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of the rows of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(d / 2, 0))


MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, word_limit double"


def base_counts(p) -> dict[str, np.ndarray]:
    """Counts by document of a piece, each exact over the whole text."""
    start, end, doc = p.words()
    n = p.n
    lead = np.zeros(len(p.data) + 1, dtype=np.int64)
    np.cumsum((p.data & 0xC0) != 0x80, out=lead[1:])
    spans = SpanHash(p.data)
    per = lambda w: np.bincount(doc, weights=w, minlength=n).astype(np.int64)
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": per(lead[end] - lead[start])}
    symbol = np.zeros(len(p.data) + 1, dtype=np.int64)
    np.cumsum(_CLASS[p.data] == 5, out=symbol[1:])
    out["n_symbols"] = np.diff(symbol[p.offsets])
    # lines: bounds at \n and at document bounds
    breaks = np.flatnonzero(p.data == 10)
    first = np.union1d(p.offsets[:-1], breaks + 1)
    first = first[first < len(p.data)]
    owner = np.searchsorted(p.offsets, first, side="right") - 1
    stop = np.minimum(np.append(first[1:], len(p.data)), p.offsets[owner + 1])
    stop = stop - ((stop > first) & (p.data[np.maximum(stop - 1, 0)] == 10))
    has = np.searchsorted(start, first) < np.searchsorted(start, stop)
    first, stop, owner = first[has], stop[has], owner[has]
    out["n_dup_lines"] = _again(spans(first, stop), owner, n)
    words = spans(start, end)
    grams = window_hash(words, 5)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if len(grams):
        inside = np.flatnonzero(doc[: len(grams)] == doc[4:])
        value, own = grams[inside], doc[inside]
        by = np.lexsort((value, own))
        same = np.zeros(len(by) + 1, dtype=bool)
        same[1:-1] = (value[by[1:]] == value[by[:-1]]) & (own[by[1:]] == own[by[:-1]])
        twice = inside[by[same[1:] | same[:-1]]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    out["n_repeat_words"] = per(np.cumsum(covered[:-1]) > 0)
    return out


def _again(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values of each owner are equal to an earlier one of it."""
    by = np.lexsort((value, owner))
    same = np.zeros(len(by), dtype=bool)
    same[1:] = (value[by[1:]] == value[by[:-1]]) & (owner[by[1:]] == owner[by[:-1]])
    return np.bincount(owner[by[same]], minlength=n)


def _word_distances(p, own: np.ndarray, refs) -> np.ndarray:
    """Of each document of a piece: the distance of its common words from its language's."""
    data, start, _, stop, doc = _trimmed(p)
    words, far = SpanHash(data)(start, stop), np.zeros(p.n)
    for lang in set(own):
        _, keys, share = refs[lang]
        rows = np.flatnonzero(own == lang)
        mine = np.zeros(p.n, dtype=bool)
        mine[rows] = True
        w = np.flatnonzero(mine[doc])
        i = np.searchsorted(keys, words[w])
        i[i == len(keys)] = 0
        hit = keys[i] == words[w] if len(keys) else np.zeros(len(w), dtype=bool)
        count = np.bincount(doc[w] * len(share) + np.where(hit, i, len(keys)), minlength=p.n * len(share)).reshape(p.n, -1)[rows]
        far[rows] = jensen_shannon(count / np.maximum(count.sum(axis=1), 1)[:, None], share)
    far[np.bincount(doc, minlength=p.n) < MIN_WORDS] = 0
    return far


def _powers(n_words: np.ndarray) -> np.ndarray:
    return np.frexp(n_words)[1]


def _distances(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([x or "" for x in batch.column("lang").to_pylist()], dtype=object)
            for p in pieces(batch.column("text")):
                own, n = langs[p.rows], np.bincount(p.words()[2], minlength=p.n)
                far, some = _word_distances(p, own, shared.value), n >= MIN_WORDS
                yield pa.RecordBatch.from_arrays([pa.array(own[some], pa.string()), pa.array(_powers(n[some]).astype(np.int32)), pa.array(far[some])], ["lang", "power", "distance"])

    return run


def _measure(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, most = shared.value
        for batch in batches:
            langs = np.array([x or "" for x in batch.column("lang").to_pylist()], dtype=object)
            for p in pieces(batch.column("text")):
                out, own = base_counts(p), langs[p.rows]
                owner = np.repeat(np.arange(p.n), np.diff(p.offsets))
                classes = np.bincount(owner * CLASSES + _CLASS[p.data], minlength=p.n * CLASSES).reshape(p.n, CLASSES)
                chars, far = classes.sum(axis=1), np.zeros((3, p.n))
                for lang in set(own):
                    rows = np.flatnonzero(own == lang)
                    far[0, rows] = jensen_shannon(classes[rows] / np.maximum(chars[rows], 1)[:, None], refs[lang][0])
                    far[2, rows] = np.array(most[lang])[_powers(out["n_words"][rows])]
                far[0, chars < MIN_CHARS] = 0
                far[1] = _word_distances(p, own, refs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[p.rows], *(pa.array(out[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), *map(pa.array, far)], [x.split()[0] for x in MEASURED.split(", ")])

    return run


def quality(docs: DataFrame, max_class: float = MAX_CLASS, max_words: float = MAX_WORDS) -> DataFrame:
    """Per row: the base counts, class_distance, word_distance (0 under the least lengths), base_failed and kept.

    A text fails the base rules with fewer than 10 words or with more than a fifth of its words in repeated 5-word
    windows.  It is kept if it passes and neither histogram is further from its language's than allowed (max_class, and
    what limits() finds for its length, max_words at most).  Null counts as empty; a null language is compared with all rows of null language; repeated rows are measured each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    refs = references(docs)
    shared = docs.sparkSession.sparkContext.broadcast((refs, limits(docs, refs, max_words)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    seen = docs.mapInArrow(_measure(shared), MEASURED).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("class_distance") <= max_class) & (F.col("word_distance") <= F.col("word_limit"))
    return seen.withColumn("kept", kept).drop("word_limit")
