"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model is learned for each language from a bounded sample of labelled rows.  Spark counts the longest character
n-grams and, from them, all that the formula needs: the different characters before each shorter n-gram, the totals of each
context and how many n-grams were met once and twice; these are rows per (n-gram, language).  SHARD languages at a time
become sorted hash arrays that tasks look whole texts up in: keys with a column of log probabilities (and of back-off
weights) for each language.  With more languages, texts pass shard after shard, so a broadcast never grows with their number.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .text import Piece, give_back, mix, pieces, tidy

ORDER = 5
#: Labelled rows per language that a model is fitted on, and their characters, about; languages that are scored at once.
TRAIN_ROWS, TRAIN_CHARS, SHARD = 1000, 8_000_000, 8
#: Bytes of text that are scored at once: each takes some 100 bytes of arrays.
PIECE = 1 << 18
_FACTORS = [np.uint64(pow(0x100000001B3, t, 1 << 64)) for t in range(ORDER)]
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: what it's folded to, and whether it's a letter."""
    top = 0x10000 if not len(codes) or codes.max() < 0x10000 else 0x110000
    if top not in _tables:
        t, letter = np.full(top, 32, dtype=np.uint32), np.zeros(top, dtype=bool)
        for c in range(top):
            s = chr(c)
            kind = unicodedata.category(s)[0]
            if kind in "LM":
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
                letter[c] = kind == "L"
        _tables[top] = t, letter
    return _tables[top]


def _fold(codes: np.ndarray) -> np.ndarray:
    """Letters in lower case and marks as they are, a space for anything else."""
    return _table(codes)[0][codes]


def is_letter(codes: np.ndarray) -> np.ndarray:
    return _table(codes)[1][codes]


def letters(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all documents, each beginning with a space and without other double spaces, the
    document of each, and its place in the document."""
    codes = np.frombuffer(p.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(p.data) + 1, dtype=np.int64)
    np.cumsum((p.data & 0xC0) != 0x80, out=lead[1:])
    bounds = lead[p.offsets]
    chars = np.insert(_fold(codes), bounds[:-1], 32)
    doc = np.repeat(np.arange(p.n), np.diff(bounds) + 1)
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32) | (doc[1:] != doc[:-1])
    chars, doc = chars[keep], doc[keep]
    return chars, doc, np.arange(len(chars)) - np.searchsorted(doc, doc)


def gram_hash(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place; the first n - 1 places mean nothing."""
    c = chars.astype(np.uint64)
    h = c.copy()
    for t in range(1, n):
        h[t:] += c[:-t] * _FACTORS[t]
    return mix(h + np.uint64(n << 58))


def _keys(codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of codes."""
    n = codes.shape[1]
    return gram_hash(codes.ravel(), n)[n - 1 :: n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for p in pieces(batch.column("text"), PIECE):
            chars, doc, place = letters(p)
            bounds = np.searchsorted(doc, np.arange(p.n + 1))
            each: dict[str, Counter] = {}
            for i in range(p.n):
                s = chars[bounds[i] : bounds[i + 1]].astype("<u4").tobytes().decode("utf-32-le")
                count = each.setdefault(langs[p.first + i], Counter())
                count.update(s[k : k + ORDER] for k in range(len(s) - ORDER + 1))
                count.update(s[:k] for k in range(1, min(ORDER, len(s) + 1)))
            for lang, count in each.items():
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count)), pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["lang", "gram", "n"])


def statistics(grams: DataFrame) -> DataFrame:
    """(lang, gram, c, total, kinds) from counts (lang, gram, n) of n-grams of ORDER characters and of shorter beginnings.

    c is the count of a longest n-gram, and of a shorter one the number of different characters before it, a beginning
    counted as often as it is one.  total and kinds are the sum of c and the number of all n-grams that continue it by one
    character.  The empty n-gram is the context of single characters; its c is null.
    """
    longer = grams.select("lang", F.explode(F.expr("transform(sequence(1, char_length(gram)), i -> substring(gram, i))")).alias("gram")).distinct().filter("char_length(gram) > 1")
    before = longer.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
    c = cut(grams.withColumnRenamed("n", "c").unionByName(before).groupBy("lang", "gram").agg(F.sum("c").alias("c")), "continuations")
    context = c.groupBy("lang", F.expr("left(gram, char_length(gram) - 1)").alias("gram")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    return c.join(context, ["lang", "gram"], "full_outer").fillna(0, ["total", "kinds"])


class Model:
    """Of some languages: per order sorted keys with log probabilities and back-off weights by language; thresholds of rejection.

    An n-gram that one of them has gets its interpolated probability in all of them.
    """

    def __init__(self, langs: list[str], stats: pa.Table, met: dict[tuple[str, int], tuple[int, int]], size: int):
        """From rows of statistics(), how many n-grams of each language and order were met once and twice, and the
        number of different characters of all languages and one more."""
        self.langs, many = langs, len(langs)
        at = pc.index_in(stats["lang"], pa.array(langs)).to_numpy()
        length = pc.utf8_length(stats["gram"]).to_numpy()
        c, total, kinds = (stats[x].to_numpy().astype(float) for x in ("c", "total", "kinds"))
        self.keys, self.logp, self.back = [], [], []
        prob = np.full((1, many), 1 / size)
        below = np.zeros(1, dtype=np.uint64)
        totals, all_kinds = np.zeros((2, 1, many))
        none = length == 0
        totals[0, at[none]], all_kinds[0, at[none]] = total[none], kinds[none]
        for n in range(1, ORDER + 1):
            rows = np.flatnonzero(length == n)
            codes = np.frombuffer("".join(stats["gram"].take(rows).to_pylist()).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
            key, first, own = np.unique(_keys(codes), return_index=True, return_inverse=True)
            counts, sums, different = np.zeros((3, len(key), many))
            counts[own, at[rows]], sums[own, at[rows]], different[own, at[rows]] = c[rows], total[rows], kinds[rows]
            context, suffix = (np.searchsorted(below, _keys(x)) if n > 1 else np.zeros(len(first), dtype=np.int64) for x in (codes[first, :-1], codes[first, 1:]))
            once, twice = (np.array([met.get((x, n), (0, 0))[k] for x in langs]) for k in (0, 1))
            d = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.9)
            safe = np.where(totals > 0, totals, 1)
            gamma = np.where(totals > 0, d * all_kinds / safe, 1.0)
            if n == 1:
                self.unknown = np.log(gamma[0] / size).astype(np.float32)
            self.back.append(np.log(gamma).astype(np.float32))
            prob = np.maximum(counts - d, 0) / safe[context] + gamma[context] * prob[suffix]
            self.keys.append(key)
            self.logp.append(np.log(prob).astype(np.float32))
            below, totals, all_kinds = key, sums, different
        self.limits = None

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n - 1]
        if not len(keys):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        i = np.searchsorted(keys, h)
        i[i == len(keys)] = 0
        return i, keys[i] == h

    def score(self, p: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Per document the number of characters and the cross-entropy in nats a character by language."""
        chars, doc, place = letters(p)
        out = np.zeros((p.n, len(self.langs)))
        todo = np.flatnonzero(place > 0)
        count = np.bincount(doc[todo], minlength=p.n)
        count[np.bincount(doc[todo], weights=is_letter(chars[todo]), minlength=p.n) == 0] = 0
        logp = np.zeros((len(todo), len(self.langs)), dtype=np.float32)
        rest = np.arange(len(todo))
        for n in range(ORDER, 0, -1):
            h = gram_hash(chars, n)
            i, hit = self.find(n, h[todo[rest]])
            hit &= place[todo[rest]] >= n - 1
            logp[rest[hit]] += self.logp[n - 1][i[hit]]
            rest = rest[~hit]
            if n > 1 and len(rest):
                before = todo[rest] - 1
                i, known = self.find(n - 1, gram_hash(chars, n - 1)[before])
                known &= place[before] >= n - 2
                logp[rest[known]] += self.back[n - 1][i[known]]
        logp[rest] += self.unknown
        if len(todo):
            full = np.flatnonzero(np.bincount(doc[todo], minlength=p.n))
            out[full] = -np.add.reduceat(logp, np.searchsorted(doc[todo], full), axis=0, dtype=np.float64)
        return count, out / np.maximum(count, 1)[:, None]

    def rejected(self, best: np.ndarray, count: np.ndarray, entropy: np.ndarray) -> np.ndarray:
        """Whether a text is less like its best language than nearly all labelled texts of its length."""
        if self.limits is None:
            return np.zeros(len(best), dtype=bool)
        mean, sd, times = self.limits
        return entropy > mean[best] + times[best] * (sd[best] + 2 / np.sqrt(np.maximum(count, 1)))


def _calibrate(shared):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for p in pieces(batch.column("text"), PIECE):
                count, h = model.score(p)
                own = np.array([model.langs.index(x) for x in langs[p.rows]])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count), pa.array(h[np.arange(p.n), own])], ["lang", "count", "h"])

    return run


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, quantile: float = 0.999) -> list[Model]:
    """Models of SHARD languages each from labelled ``rows`` (doc_id, text, lang); none if there are none.

    About ``train_rows`` rows of each language, and of long texts as many as have about ``train_chars`` characters, chosen by
    a hash of doc_id, are used in whole: nine tenths for counts and one tenth to calibrate rejection: at one and a half
    times the given quantile of standardised cross-entropy, and never below 4 deviations (more where few rows calibrate).
    Repeated rows count as often as they are there; rows without a text or a language teach nothing.
    """
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).collect()}
    if not sizes:
        return []
    langs = sorted(sizes)
    spot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit("fit")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_rows / sizes[lang]["n"], train_chars / max(sizes[lang]["chars"], 1)))])
    sample = cut(rows.filter(spot < share[F.col("lang")] * 1_000_000).select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(10)) == 0).alias("later")), "labelled")
    grams = sample.filter("not later").select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    stats = cut(statistics(cut(grams, "grams")), "statistics")
    each = stats.filter("c is not null").groupBy("lang", F.char_length("gram").alias("order")).agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"))
    met = {(r["lang"], r["order"]): (r["once"], r["twice"]) for r in each.collect()}  # ORDER rows a language
    size = stats.filter("char_length(gram) = 1").select("gram").distinct().count() + 1
    models = []
    for k in range(0, len(langs), SHARD):
        some = langs[k : k + SHARD]
        model = Model(some, stats.filter(F.col("lang").isin(some)).toArrow(), met, size)
        later = sample.filter("later").filter(F.col("lang").isin(some)).select("lang", "text")
        seen = later.mapInArrow(_calibrate(rows.sparkSession.sparkContext.broadcast(model)), "lang long, count long, h double").filter("count > 0").toArrow()
        lang, count, h = (seen[x].to_numpy() for x in ("lang", "count", "h"))
        limits = np.zeros((3, len(some)))
        for i in range(len(some)):
            n, e = count[lang == i], h[lang == i]
            mean, sd = (e.mean(), e.std()) if len(e) >= 5 else (np.inf, 1.0)
            limits[:, i] = mean, sd, max(4.0 + 60 / len(e), 1.5 * np.quantile((e - mean) / (sd + 2 / np.sqrt(n)), quantile)) if len(e) >= 5 else 0
        model.limits = limits
        models.append(model)
        del seen, lang, count, h
        give_back()  # the driver keeps no more than the model
    return models


#: What texts carry from shard to shard: characters, least cross-entropy, its language, log of the sum of all likelihoods over
#: CERTAIN characters at most, whether calibration rejects it.
CARRIED = "_count long, _low double, _lang string, _all double, _bad boolean"
CERTAIN = 64


def _predict(shared, text: str, last: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            had = "_low" in batch.schema.names
            names = [x for x in batch.schema.names if x[0] != "_" or x == "_text" and not last]
            for p in pieces(batch.column(text), PIECE):
                count, h = model.score(p)
                best = h.argmin(axis=1)
                low = h[np.arange(p.n), best]
                all_of = np.logaddexp.reduce(-h * np.minimum(count, CERTAIN)[:, None], axis=1)
                lang, bad = np.array(model.langs, dtype=object)[best], model.rejected(best, count, low)
                if had:
                    old = {x: batch.column(x)[p.rows].to_numpy(zero_copy_only=False) for x in ("_low", "_lang", "_all", "_bad")}
                    stays = old["_low"] <= low
                    low, lang, bad = np.where(stays, old["_low"], low), np.where(stays, old["_lang"], lang), np.where(stays, old["_bad"], bad).astype(bool)
                    all_of = np.logaddexp(all_of, old["_all"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[p.rows] for c in names), pa.array(count), pa.array(low), pa.array(lang, pa.string()), pa.array(all_of), pa.array(bad)], [*names, "_count", "_low", "_lang", "_all", "_bad"]
                )

    return run


def identify(docs: DataFrame, models: list[Model], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred, score, entropy and rejected.

    lang_pred is the language of the lowest cross-entropy a character over the whole text, score its posterior over
    CERTAIN characters at most (0 to 1), rejected whether calibration finds the text unlike every learned language.
    A null, empty or letterless text (marks and digits are no letters), and any text without a model, is ``und`` with score 0
    and rejected.  Every row is predicted by itself, so repeated rows have the same result; of equal languages the first by
    name is taken.  Columns of ``keep`` must not have one of the four names; all others may have any.
    """
    spark = docs.sparkSession
    own = [f"k{i}" for i in range(len(keep))]
    text = own[keep.index("text")] if "text" in keep else "_text"
    now = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(own, keep, strict=True)), *([] if "text" in keep else [F.col("text").alias("_text")]))
    for i, model in enumerate(models):
        last = i + 1 == len(models)
        fields = [f"{f.name} {f.dataType.simpleString()}" for f in now.schema if f.name[0] != "_" or f.name == "_text" and not last]
        now = now.mapInArrow(_predict(spark.sparkContext.broadcast(model), text, last), ", ".join([*fields, CARRIED]))
        if not last:
            now = cut(now, "scored")  # so that workers hold one shard at a time
    if not models:
        now = now.selectExpr(*own, "0L AS _count", "0D AS _low", "'und' AS _lang", "0D AS _all", "true AS _bad")
    none = F.col("_count") == 0
    power = F.least(F.col("_count"), F.lit(CERTAIN))
    return now.select(
        *(F.col(k).alias(c) for k, c in zip(own, keep, strict=True)), F.when(none, F.lit("und")).otherwise(F.col("_lang")).alias("lang_pred"),
        F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.exp(-F.col("_low") * power - F.col("_all")))).alias("score"),
        F.col("_low").alias("entropy"), (none | F.col("_bad")).alias("rejected"),
    )


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is 2 modulo 4; these rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
