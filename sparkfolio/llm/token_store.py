"""Token ids in a content-addressed store.

Texts become id streams that a rolling hash over the last ids cuts into chunks, so equal passages give equal
chunks wherever they stand.  A chunk is stored once under the digest of its ids; a document is a recipe of
digests; Merkle manifests over the stored chunks and over the recipes tell whether a store is whole.  Tables of a
store (Parquet, in one folder):

* ``objects/kind=0``: digest (16 bytes of BLAKE2b), body (zstd of little-endian ids, 2 bytes each if the vocabulary
  allows, else 4);
* ``recipes``: doc_id, start (ids of all documents before it), n_tokens, digests, by ascending doc_id;
* ``manifest``: per table and first digest byte the hash of the sorted leaves below, and per table the root.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut, new_path
from .text import Piece, SpanHash, mix, pieces, spaced, tidy

#: Rolling window, expected length beyond the least one (a power of two), least and largest length of a chunk, in ids.
WINDOW, MEAN, LEAST, MOST = 32, 512, 128, 4096
#: Words whose ids a worker remembers (about 35 bytes each), and digests of chunks a task has sent (about 100 bytes each).
CACHE, SENT = 1_000_000, 100_000
END_ID = 1
#: Texts on which the encoding by words must give what the tokenizer gives for the whole text.
PROBE = (
    "", " ", "one", "A plain sentence, of words. And another one.", "Tabs\tand\nlines\r\n\n  two  spaces", "end... 3.14, 1,000 e.g. a.b, (x), [y] x=y; it's \"so\"!?",
    "\u00c9t\u00e9 Stra\u00dfe \u0130 na\u00efve e\u0301", "\u4e2d\u6587 \u3000 \u0440\u0443\u0441\u0441\u043a\u0438\u0439. \u0645\u0631\u062d\u0628\u0627 \U0001f600", "CamelCase HTML5 snake_case x1y2 --flag http://a.b/c?d=e&f", "\x0b\x0c\x1c\x85 \u2028 \xa0 end.",
)


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


class Encoder:
    """Ids of texts by a tokenizer file.

    If the file lower-cases and its tokens never hold white space (PROBE tells), each different word of a piece is
    encoded once and a worker remembers the words it has met in sorted hash arrays, up to CACHE of them.  With any
    other file whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.forget()
        probe = list(pieces(pa.array(PROBE)))[0]
        whole = self.whole(probe)
        try:
            self.by_words = all(np.array_equal(a, b) for a, b in zip(self.words(probe), whole, strict=True))
        except ValueError:  # a model that can't be asked for single words
            self.by_words = False

    def whole(self, p: Piece) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(p.text(i), add_special_tokens=False).ids, dtype=self.width) for i in range(p.n)]

    def __call__(self, p: Piece) -> list[np.ndarray]:
        """The id stream of each document of a piece."""
        return self.words(p) if self.by_words else self.whole(p)

    def forget(self) -> None:
        self.key, self.check = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        self.at, self.size, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=self.width)
        self.met = np.zeros(0, dtype=bool)

    def plain(self, raws: list[bytes]) -> tuple[list[int], list[int]]:
        """All ids of some _PLAIN words and how many each has: the steps before the model leave lower-case letters as they are."""
        tokenize, ids, size = self.model.tokenize, [], []
        for signs in b" ".join(raws).decode("latin-1").translate(_BYTE_SIGNS).split(" ") if raws else ():
            tokens = tokenize(signs)
            size.append(len(tokens))
            ids += [t.id for t in tokens]
        return ids, size

    def other(self, raws: list[bytes]) -> tuple[list[int], list[int]]:
        """The same of any words, encoded in one call of the tokenizer."""
        if not raws:
            return [], []
        made = self.tokenizer.encode([raw.decode("utf-8", "replace") for raw in raws], is_pretokenized=True, add_special_tokens=False)
        return made.ids, np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(raws)).tolist()

    def learn(self, key: np.ndarray, check: np.ndarray, raws: list[bytes]) -> None:
        plain = np.array([_PLAIN.fullmatch(raw) is not None for raw in raws], dtype=bool)
        size, at = np.zeros(len(raws), dtype=np.int32), np.zeros(len(raws), dtype=np.int64)
        for encode, own in ((self.plain, np.flatnonzero(plain)), (self.other, np.flatnonzero(~plain))):
            ids, size[own] = encode([raws[k] for k in own.tolist()])
            at[own] = np.cumsum(size[own]) - size[own] + len(self.flat)
            self.flat = np.concatenate([self.flat, np.array(ids, dtype=self.width)])
        into = np.searchsorted(self.key, key)  # both are sorted
        self.key, self.check, self.at, self.size, self.met = (
            np.insert(a, into, b) for a, b in ((self.key, key), (self.check, check), (self.at, at), (self.size, size), (self.met, False))
        )

    def make_room(self) -> None:
        """Forgets all words but those met again since they were learned or room was made, and these too if they are most."""
        keep = np.flatnonzero(self.met)
        if 2 * len(keep) > CACHE:
            self.forget()
            return
        size = self.size[keep]
        self.flat = self.flat[np.repeat(self.at[keep], size) + spaced(size)]
        self.key, self.check, self.size, self.at = self.key[keep], self.check[keep], size, np.cumsum(size, dtype=np.int64) - size
        self.met = np.zeros(len(keep), dtype=bool)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, key)
        i[i == len(self.key)] = 0
        return i, (self.key[i] == key) & (self.check[i] == check) if len(self.key) else np.zeros(len(key), dtype=bool)

    def words(self, p: Piece) -> list[np.ndarray]:
        """The id stream of each document of a piece, word by word."""
        start, end, doc = p.words()
        low = _LOWER[p.data]
        # one full stop or comma after a letter and at a word's end is a token of its own
        last = low[end - 1]
        parted = np.flatnonzero((end - start > 1) & ((last == 46) | (last == 44)) & (low[end - 2] >= 97) & (low[end - 2] <= 122))
        at = parted + 1
        start, stop, doc = np.insert(start, at, end[parted] - 1), np.insert(end, at, end[parted]), np.insert(doc, at, doc[parted])
        stop[parted + np.arange(len(parted))] -= 1
        key = SpanHash(low)(start, stop)
        unique, first, back = different(key)
        a, b = start[first], stop[first]
        check = (b - a).astype(np.uint32) << np.uint32(16) | low[a].astype(np.uint32) << np.uint32(8) | low[b - 1] if len(a) else np.zeros(0, dtype=np.uint32)
        i, known = self.find(unique, check)
        if not known.all():
            if len(self.key) + len(unique) > CACHE:
                self.make_room()
                i, known = self.find(unique, check)
            new, raw = np.flatnonzero(~known), low.tobytes()
            self.learn(unique[new], check[new], [raw[x:y] for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True)])
            i, _ = self.find(unique, check)
        self.met[i[known]] = True  # new words are not met again yet
        size = self.size[i][back]
        ids = self.flat[np.repeat(self.at[i][back], size) + spaced(size)] if len(size) else self.flat[:0]
        ends = np.append(0, np.cumsum(size))[np.searchsorted(doc, np.arange(p.n + 1))]
        return [ids[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _byte_signs() -> dict[int, int]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)} | {32: 32}  # no word holds a space


_BYTE_SIGNS = _byte_signs()
#: a-z and the lower-case letters from U+00DF to U+00FF.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def different(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with first places and inverse; only the different keys are sorted, not all."""
    met = pa.array(key).dictionary_encode()
    codes, keys = met.indices.to_numpy(), met.dictionary.to_numpy()
    order = np.argsort(keys)
    first, rank = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the last one written is the first place
    rank[order] = np.arange(len(keys))
    return keys[order], first[order], rank[codes]


#: mix() of the ids that two bytes hold.
_SIGNS = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(977))


def cuts_of(ids: np.ndarray, bounds: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each id stream, counted from its own begin; the streams stand one after another between ``bounds``."""
    found = np.zeros(0, dtype=np.int64)
    if len(ids) > LEAST:
        sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(_SIGNS[ids] if ids.dtype.itemsize == 2 else mix(ids.astype(np.uint64) + np.uint64(977)), out=sums[1:])
        found = np.flatnonzero(mix(sums[WINDOW:] - sums[:-WINDOW]) & np.uint64(MEAN - 1) == 0) + WINDOW
    # an end lies behind WINDOW ids of its own stream
    upto = np.searchsorted(found, bounds[1:], side="right").tolist()
    since = np.searchsorted(found, bounds[:-1] + WINDOW).tolist()
    for first, n, i, j in zip(bounds[:-1].tolist(), np.diff(bounds).tolist(), since, upto, strict=True):
        ends, last = [], 0
        for at in (found[i:j] - first).tolist() if n > LEAST else ():
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST:
                ends.append(at)
                last = at
        while n - last > MOST:
            last += MOST
            ends.append(last)
        if last < n:
            ends.append(n)
        yield ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return next(cuts_of(ids, np.array([0, len(ids)])))


ENCODED = "deal binary, kind int, body binary, doc_id long, n_tokens long, digests array<binary>"
_ENCODED = pa.schema([("deal", pa.binary()), ("kind", pa.int32()), ("body", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary()))])


def _encode(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, pack, sent = encoder(path), zstandard.ZstdCompressor(3), set()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for p in pieces(batch.column("text")):
                rows = []
                streams = encode(p)
                end_id = np.array([END_ID], dtype=streams[0].dtype)
                bounds = np.append(0, np.cumsum([len(x) + 1 for x in streams]))
                flat = np.concatenate([x for stream in streams for x in (stream, end_id)])
                raw, width = flat.tobytes(), flat.itemsize
                for i, ends in enumerate(cuts_of(flat, bounds)):
                    recipe, last, first = [], 0, int(bounds[i])
                    for end in ends:
                        chunk = raw[(first + last) * width : (first + end) * width]
                        recipe.append(d := digest(chunk))
                        if d not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(d)
                            rows.append((d, 0, pack.compress(chunk), None, None, None))
                        last = end
                    doc = ids[p.first + i]
                    rows.append((digest(f"{doc}".encode()), 1, None, doc, last, recipe))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENCODED, strict=True)], schema=_ENCODED)

    return run


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input ordered by kind and digest: chunks once, recipes all."""
    last = None
    for batch in batches:
        keep = []
        for kind, d in zip(batch.column("kind").to_pylist(), batch.column("deal").to_pylist(), strict=True):
            keep.append(kind == 1 or d != last)
            if kind == 0:
                last = d
        yield batch.filter(pa.array(keep, pa.bool_()))


def _checked(width: str):
    """Per stored chunk what it holds; a chunk that isn't what its digest says stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for d, body in zip(batch.column("digest").to_pylist(), batch.column("body").to_pylist(), strict=True):
                raw = unpack.decompress(body)
                if digest(raw) != d:
                    raise ValueError(f"chunk {d.hex()} of the store is damaged")
                wide = np.frombuffer(raw, dtype=width).astype("<u4").tobytes()
                out.append((d, len(wide) // 4, zlib.crc32(wide)))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["digest", "n", "crc"])

    return run


def _times(a: int, b: int) -> int:
    """Product modulo the CRC-32 polynomial, bits reversed."""
    m, p = 1 << 31, 0
    while True:
        if a & m:
            p ^= b
            if not a & (m - 1):
                return p
        m >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1


@lru_cache(1 << 16)
def _shift(n: int) -> int:
    """x to the power of 8 n."""
    p, square, n = 1 << 31, 1 << 23, n
    while n:
        if n & 1:
            p = _times(square, p)
        square = _times(square, square)
        n >>= 1
    return p


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of the concatenation of parts given by (crc32, bytes)."""
    out = 0
    for crc, n in parts:
        if n:
            out = (_times(_shift(n), out) if out else 0) ^ crc  # nothing before the first part
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [sorted((x["at"], x["crc"], x["n"]) for x in xs) for xs in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array([sum(n for *_, n in x) for x in parts], pa.int64()), pa.array([crc32_joined([(c, 4 * n) for _, c, n in x]) for x in parts], pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def _leaves(table: DataFrame, name: str, leaf) -> DataFrame:
    """Per first byte the hash over the sorted leaves, by way of a million branches with one leaf in a million each, so even
    10^11 leaves are at most some 100,000 in a branch; above, a branch has 4,096 below it."""
    hashed = lambda c: F.sha2(F.concat_ws("", F.array_sort(F.collect_list(c))), 256).alias("hash")
    low = table.select(F.hex(leaf).alias("leaf")).groupBy(F.substring("leaf", 1, 5).alias("branch")).agg(hashed(F.col("leaf")))
    return low.groupBy(F.substring("branch", 1, 2).alias("branch")).agg(hashed(F.concat("branch", "hash"))).withColumn("table", F.lit(name))


def manifest(chunks: DataFrame, recipes: DataFrame) -> DataFrame:
    """(table, branch, hash): Merkle branches of both tables and, with an empty branch, their roots."""
    leaf = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("start").cast("string"), F.lit(":"), F.hex(F.array_join(F.transform("digests", F.hex), "")))))
    branches = _leaves(chunks, "chunks", F.col("digest")).unionByName(_leaves(recipes, "recipes", leaf))
    roots = branches.groupBy("table").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.concat("branch", "hash")))), 256).alias("hash")).withColumn("branch", F.lit(""))
    return branches.unionByName(roots).select("table", "branch", "hash")


def write_store(docs: DataFrame, tokenizer: str, folder: str | None = None) -> str:
    """Writes all texts of ``docs`` and returns the store's folder.

    A null or empty text has the end id only.  Documents stand by ascending doc_id (null first); repeated rows are
    documents of their own whose chunks are stored once.  An empty table gives an empty store.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "store")
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(tokenizer), ENCODED)
    encoded.repartition("deal").sortWithinPartitions("kind", "deal").mapInArrow(_unique, ENCODED).withColumnRenamed("deal", "digest").write.partitionBy("kind").parquet(f"{folder}/objects")
    # rows of one doc_id may be many: what they hold and, of equal rows, where they stand in the files part them further
    recipes = _objects(spark, folder, 1).select("doc_id", "n_tokens", "digests", F.xxhash64("digests").alias("held"), F.monotonically_increasing_id().alias("place"))
    dealt = cut(recipes.repartitionByRange("doc_id", "n_tokens", "held", "place").withColumn("part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a partition
    before, rows = 0, []
    for r in parts:
        rows.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "part int, before long")
    order = W.partitionBy("part").orderBy("doc_id", "n_tokens", "held", "place").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens"))
    placed.select("doc_id", "start", "n_tokens", "digests").write.parquet(f"{folder}/recipes")
    manifest(_objects(spark, folder, 0), spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")
    return folder


def _objects(spark: SparkSession, folder: str, kind: int) -> DataFrame:
    schema = ENCODED.replace("deal binary", "digest binary").replace("kind int, ", "")
    return spark.read.schema(schema + ", kind int").parquet(f"{folder}/objects").filter(F.col("kind") == kind)


def read_store(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files alone; stops if they are damaged."""
    chunks, recipes = _objects(spark, folder, 0), spark.read.parquet(f"{folder}/recipes")
    now, then = manifest(chunks, recipes), spark.read.parquet(f"{folder}/manifest")
    both = now.withColumn("n", F.lit(1)).unionByName(then.withColumn("n", F.lit(-1)))
    if not both.groupBy("table", "branch", "hash").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty():
        raise ValueError(f"the manifest of {folder} doesn't fit its tables")
    held = chunks.select("digest", "body").mapInArrow(_checked(Encoder(tokenizer).width), "digest binary, n long, crc long")
    asked = recipes.select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    parts = asked.join(held, "digest").groupBy("doc_id", "start").agg(F.collect_list(F.struct("at", "crc", "n")).alias("parts"))
    return parts.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """(doc_id, start, ids) of every document: the id streams put together again."""
    width = Encoder(tokenizer).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(unpack.decompress(x["body"]), dtype=width) for x in sorted(xs, key=lambda x: x["at"])]).astype(np.int32) for xs in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    asked = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    parts = asked.join(_objects(spark, folder, 0).select("digest", "body"), "digest").groupBy("doc_id", "start").agg(F.collect_list(F.struct("at", "body")).alias("parts"))
    return parts.mapInArrow(run, "doc_id long, start long, ids array<int>")
