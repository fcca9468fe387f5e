"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

The index is a stored table of postings (term, document, position) of every test term, with one posting of the
reserved term 0 at each document's end, which tells its length.  A test window is looked up from its rarest
term: that term's postings, moved back by its offset, are the first candidates; they are intersected with the
next rarest term's postings at its own offset, and what is left with all other terms of the window.  Near matches are found
alike, with each term at most a few words off its place.
Each intersection is an equi-join on (document, position, term), so a frequent term's list is never multiplied by the
number of windows it is in, and a document's text is read once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import free_name, keyed
from .storage import cut

#: Rows up to which a small side is broadcast (a few tens of MB); larger ones are shuffled.
BROADCAST_ROWS = 500_000
END = "\x00"
#: Words by which a term of a near match may be off its place.
SLOP = 3


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, lower-case letters and anything beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def test_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, phrase): each ``size`` consecutive words of an item; all of them if an item has fewer, but some."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    return words.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size}))")).alias("phrase")).distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stores and returns (term, doc_id, pos) of all occurrences of ``terms`` (word, term) and of each document's end."""
    tokens = docs.select("doc_id", F.posexplode(F.array_append(words_of(F.col("text")), F.lit(END))).alias("pos", "word"))
    return cut(tokens.join(terms, "word").select("term", "doc_id", "pos"), "postings")


def plan(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(win, size, terms): per phrase its (term, offset) structs from the rarest term on."""
    often = index.groupBy("term").agg(F.count("*").alias("often"))
    each = phrases.select("win", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "word")).select("win", "size", "offset", F.xxhash64("word").alias("term"))
    each = each.join(often, "term", "left").fillna(0, ["often"])
    return each.groupBy("win", "size").agg(F.array_sort(F.collect_list(F.struct("often", "term", "offset"))).alias("terms"))


def _near(left: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """Rows of ``left`` (doc_id, term, at, ...) with ``off``, how far from ``at`` the term stands, for each place within ``slop``.

    Places are dealt into blocks of 2 * slop + 1 words, so a place within reach is in one of at most two blocks: an equi-join,
    whose rows don't grow with how often a term occurs elsewhere.
    """
    block = 2 * slop + 1
    asked = left.withColumn("_block", F.explode(F.array_distinct(F.array(*(F.floor((F.col("at") + d) / block) for d in (-slop, slop))))))
    held = lists.select("doc_id", "term", F.col("pos").alias("_pos"), F.floor(F.col("pos") / block).alias("_block"))
    return asked.join(held, ["doc_id", "term", "_block"]).withColumn("off", F.col("_pos") - F.col("at")).filter(F.abs("off") <= slop).drop("_block", "_pos")


def candidates(index: DataFrame, plan_: DataFrame, slop: int = 0) -> DataFrame:
    """(win, doc_id, start, off) where a window's rarest term stands as if the window began at ``start``, with its next rarest
    term at most ``slop`` words off its place; off is the least deviation, 0 for windows of one word."""
    first = plan_.filter("terms[0].often > 0").select(F.expr("terms[0].term").alias("term"), F.expr("terms[0].offset").alias("back"), "win", F.expr("get(terms, 1).term").alias("next"), F.expr("get(terms, 1).offset").alias("ahead"))
    one = index.join(first, "term").select("win", "doc_id", (F.col("pos") - F.col("back")).alias("start"), "back", "next", "ahead")
    second = plan_.filter("size(terms) > 1").select(F.expr("terms[1].term").alias("term")).distinct()
    lists = index.join(second, "term", "left_semi")
    asked = one.filter("next is not null").select("win", "doc_id", "start", "back", F.col("next").alias("term"), (F.col("start") + F.col("ahead")).alias("at"))
    # two terms of one window never share a place
    two = _near(asked, lists, slop).filter("at + off <> start + back").groupBy("win", "doc_id", "start").agg(F.min(F.abs("off")).alias("off"))
    return two.unionByName(one.filter("next is null").select("win", "doc_id", "start", F.lit(0).alias("off")))


def phrase_matches(index: DataFrame, plan_: DataFrame, found: DataFrame) -> DataFrame:
    """(win, size, doc_id, start) of every exact occurrence of a window in a document, of the stored candidates."""
    rest = plan_.select("win", "size", F.expr("slice(terms, 3, greatest(size(terms) - 2, 0))").alias("rest"))
    exact = found.filter("off = 0 and start >= 0")
    need = exact.join(rest, "win")
    doc_ids = small(cut(exact.select("doc_id").distinct(), "matched"))
    lists = index.filter("term <> 0").join(doc_ids, "doc_id", "left_semi").withColumnRenamed("pos", "at")
    asked = need.filter("size(rest) > 0").select("win", "size", "doc_id", "start", F.explode("rest").alias("r")).select("win", "size", "doc_id", "start", F.expr("start + r.offset").alias("at"), F.expr("r.term").alias("term"))
    held = asked.join(lists, ["doc_id", "at", "term"]).groupBy("win", "size", "doc_id", "start").agg(F.count_distinct("at").alias("n")).filter("n = size - 2").drop("n")
    return held.unionByName(need.filter("size(rest) = 0").select("win", "size", "doc_id", "start"))


def proximity_matches(index: DataFrame, plan_: DataFrame, found: DataFrame, slop: int = SLOP) -> DataFrame:
    """(win, doc_id, start, off): windows all of whose terms stand at most ``slop`` words off their places, counted from
    the rarest one; off is the largest of their least deviations.  found: candidates() with this slop.  Exact ones are among them."""
    rest = plan_.select("win", F.expr("slice(terms, 3, greatest(size(terms) - 2, 0))").alias("rest"))
    need = found.join(rest, "win")
    doc_ids = small(cut(found.select("doc_id").distinct(), "near"))
    lists = index.filter("term <> 0").join(doc_ids, "doc_id", "left_semi")
    asked = need.select("win", "doc_id", "start", F.col("off").alias("first"), F.explode("rest").alias("r")).select("win", "doc_id", "start", "first", F.expr("r.term").alias("term"), F.expr("r.offset").alias("offset"), F.expr("start + r.offset").alias("at"))
    each = _near(asked, lists, slop).groupBy("win", "doc_id", "start", "first", "offset").agg(F.min(F.abs("off")).alias("off"))
    all_of = each.groupBy("win", "doc_id", "start", "first").agg(F.count("*").alias("n"), F.max("off").alias("off"))
    met = all_of.join(rest.select("win", F.size("rest").alias("many")), "win").filter("n = many")
    return met.select("win", "doc_id", "start", F.greatest("first", "off").alias("off")).unionByName(need.filter("size(rest) = 0").select("win", "doc_id", "start", "off"))


def prepare(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored index, the stored windows (item_id, phrase, win) and the stored lookup plan, which is to be broadcast
    wherever it's joined if its rows allow that (the hint holds for what is selected from it)."""
    windows = cut(test_windows(benchmark, size).withColumn("win", F.xxhash64("phrase")), "windows")
    spark = docs.sparkSession
    end = spark.range(1).select(F.lit(END).alias("word"), F.lit(0).cast("long").alias("term"))
    terms = small(cut(windows.select(F.explode("phrase").alias("word")).distinct().withColumn("term", F.xxhash64("word")).unionByName(end), "terms"))
    index = build_index(docs, terms)
    return index, windows, small(cut(plan(index, windows.select("win", "phrase").distinct()), "plan"))


def hit_rows(rows: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id): those of ``rows``, whose long doc_id no other row has, with an occurrence of a window of ``size`` consecutive
    benchmark words, as contamination() finds them (n_hit > 0)."""
    index, _, plan_ = prepare(rows, benchmark, size)
    return phrase_matches(index, plan_, cut(candidates(index, plan_), "candidates")).select("doc_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, items): per row the number of its words, of those inside an occurrence of a
    window of ``size`` consecutive benchmark words, and the sorted item_ids (as strings) whose windows occur.

    With a ``slop`` also near_items: the item_ids with a window that occurs exactly or near (proximity_matches()).

    A null or empty text has no words; an item without words has no window; a shorter item is one window.
    Every row is a document of its own, whatever its doc_id: null and repeated ids get a key that is written with the rows.
    Without benchmark items nothing is hit.
    """
    docs = docs.select("doc_id", "text")
    key = free_name(docs, "row")
    rows = keyed(docs, key, "contamination_rows")
    ids = rows.select(F.col(key).alias("doc_id"), F.col("doc_id").cast("long").alias("_id"))
    docs = rows.select(F.col(key).alias("doc_id"), "text")
    index, windows, plan_ = prepare(docs, benchmark, size)
    found = cut(candidates(index, plan_, slop or 0), "candidates")
    matches = cut(phrase_matches(index, plan_, found), "matches")
    hits = matches.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    hits = hits.select("doc_id", F.expr("cast(size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.size - 1))))) as long)").alias("n_hit"))
    named = small(windows.select("win", "item_id"))
    items_of = lambda found, name: found.join(named, "win").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias(name))
    items = items_of(matches, "items")
    length = index.filter("term = 0").groupBy("doc_id").agg(F.max("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = length.join(hits, "doc_id", "left").join(items, "doc_id", "left").join(ids, "doc_id")
    columns = [F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")]
    if slop is None:
        return out.select(*columns)
    near = cut(items_of(proximity_matches(index, plan_, found, slop).unionByName(matches.select("win", "doc_id", "start", F.lit(0).alias("off"))), "near_items"), "near_items")
    return out.join(near, "doc_id", "left").select(*columns, F.coalesce("near_items", none).alias("near_items"))
