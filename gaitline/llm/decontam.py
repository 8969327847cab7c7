"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Test items are cut into windows of consecutive words. Document frequencies of their terms come from one pass over the
corpus; a second pass stores the index: postings (term, document, position) of the terms that are among the
rarest of some window, dealt by term, frequent terms in slices. The search starts from each window's rarest term: its
postings, shifted by the term's place in the item, are the first list; the lists of the next rarest terms, shifted by theirs,
are intersected with it one after another. In the proximity search the lists may differ by a slack. In the phrase
search the few places left are held against the document's words, which stand for the lists of the other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import through_disk

#: A word is a run of lower-case ASCII letters, digits and anything beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH = 13
#: Lists that are intersected for each window, from the rarest term on.
LISTS = 3
#: Windows of the test items that may be broadcast; more of them are joined by shuffling. Documents found (16 bytes each) likewise.
BROADCAST_WINDOWS, BROADCAST_DOCS = 200_000, 500_000
#: A term with over one part in so many of the postings is dealt out in slices; there are fewer such terms than this.
HEAVY = 1000


def words(text: Column) -> Column:
    """The words in order; null and empty texts have none."""
    clean = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "^" + BREAKS, "")
    return F.filter(F.split(clean, BREAKS), lambda w: w != "")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(item, at, terms: windows of `length` words of each item, one of a shorter item that has words; item, item_id: its names).

    Items of equal words are one item with several names; a null item_id is a name like any other.
    """
    cut = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("all")).filter(F.size("all") > 0).withColumn("item", F.xxhash64("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - length, F.lit(0)))
    each = cut.select("item", "all").distinct().select("item", "all", F.explode(starts).alias("at"))
    return each.select("item", "at", F.slice("all", F.col("at") + 1, length).alias("terms")), cut.select("item", "item_id").distinct()


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, pos, term: a row for each word. key: hash of the text, telling apart rows of the same id."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.posexplode(words(F.col(text))).alias("pos", "term"))


#: Files that a table bounded by BROADCAST_WINDOWS is written to.
SMALL_FILES = 4


def _sided(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _written(df: DataFrame, name: str, small: bool) -> DataFrame:
    return through_disk(df.coalesce(SMALL_FILES) if small else df, name)


def term_counts(docs: DataFrame, cut: DataFrame, small: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, df: postings of each term of the windows over all documents; summed by task before the shuffle either way."""
    vocabulary = cut.select(F.explode("terms").alias("term")).distinct()
    each = postings(docs, doc_id, text).select("term")
    if small:
        counts = each.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(vocabulary, "term")
    return _written(counts, "terms", small)


def tracks(cut: DataFrame, counts: DataFrame, n_terms: int = LISTS) -> DataFrame:
    """item, places, terms, ends: where in the item the n_terms rarest terms of a window are, the rarest first, and which windows
    (at, length, two hashes of their words) have these.

    Windows with a term that the corpus lacks can't occur and go. Fewer words than n_terms: the last is repeated.
    """
    each = cut.select("item", "at", "terms", F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    ranked = F.array_sort(F.collect_list(F.struct("df", "term", (F.col("at") + F.col("offset")).alias("place"))))
    wins = each.groupBy("item", "at").agg(F.max(F.col("df").isNull()).alias("lacking"), ranked.alias("ranked"), F.first("terms").alias("words")).filter("not lacking")
    rarest = F.transform(F.sequence(F.lit(1), F.lit(n_terms)), lambda k: F.element_at("ranked", F.least(k, F.size("ranked"))))
    wins = wins.withColumn("rarest", rarest)
    end = F.struct("at", F.size("words").alias("length"), F.xxhash64("words").alias("phrase"), F.xxhash64(F.lit(1), "words").alias("again"))
    return wins.groupBy("item", F.col("rarest.place").alias("places"), F.col("rarest.term").alias("terms")).agg(F.collect_list(end).alias("ends"))


def store(docs: DataFrame, counts: DataFrame, small: bool, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(the index: term, slice, doc_id, key, pos, written to the shared folder; term, slices).

    Of the terms of counts (term, df) only. A term with over 1 / HEAVY of the postings is cut into slices by document and
    place, so no task gets much more than that; the list of these terms is broadcast, being shorter than HEAVY.
    """
    total = counts.agg(F.sum("df")).first()[0] or 1
    slices = counts.select("term", F.ceil(F.col("df") * HEAVY / total).cast("int").alias("slices"))
    one = F.pmod(F.xxhash64("doc_id", "key", "pos"), F.coalesce("slices", F.lit(1)))
    if small:
        found = postings(docs, doc_id, text).join(F.broadcast(slices), "term").withColumn("slice", one.cast("int"))
    else:
        found = postings(docs, doc_id, text).join(F.broadcast(slices.filter("slices > 1")), "term", "left").withColumn("slice", one.cast("int")).drop("slices")
        found = found.join(_sliced(slices), ["term", "slice"])
    dealt = found.select("term", "slice", "doc_id", "key", "pos").repartition("term", "slice").sortWithinPartitions("term", "slice", "doc_id", "key", "pos")
    return through_disk(dealt, "postings"), slices


def _sliced(slices: DataFrame) -> DataFrame:
    return slices.select("term", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))


def intersect(index: DataFrame, slices: DataFrame, found: DataFrame, small: bool, n_terms: int = LISTS, slack: int = 0) -> DataFrame:
    """doc_id, key, item, shift, ends: where the lists of a track's terms meet, each shifted by its place, within `slack`.

    shift: where the item would begin by the rarest term. Every list after the first is joined by document, term and
    position, so no term, item or document is a task's alone.
    """
    first = found.select(F.col("terms")[0].alias("term"), F.struct("item", "places", "terms", "ends").alias("track")).groupBy("term").agg(F.collect_list("track").alias("tracks"))
    if small:
        now = index.join(F.broadcast(first), "term")
    else:
        now = index.join(first.join(_sliced(slices), "term"), ["term", "slice"])
    now = now.select("doc_id", "key", "pos", F.explode("tracks").alias("track")).select("doc_id", "key", "track.*", (F.col("pos") - F.col("track.places")[0]).alias("shift"))
    width = 2 * slack + 1
    for k in range(1, n_terms):
        want = now.withColumn("w_id", F.col("doc_id")).withColumn("w_key", F.col("key")).withColumn("term", F.col("terms")[k]).withColumn("want", F.col("shift") + F.col("places")[k]).drop("doc_id", "key")
        block = F.floor(F.col("want") / width)
        want = want.withColumn("block", F.explode(F.array(block - 1, block, block + 1)) if slack else block)
        needed = found.select(F.col("terms")[k].alias("term")).distinct()
        held = index.join(_sided(needed, small), "term", "left_semi").select("doc_id", "key", F.col("term").alias("h_term"), "pos", F.floor(F.col("pos") / width).alias("h_block"))
        same = F.col("w_id").eqNullSafe(F.col("doc_id")) & (F.col("w_key") == F.col("key")) & (F.col("term") == F.col("h_term")) & (F.col("block") == F.col("h_block"))
        met = want.join(held, same & (F.abs(F.col("pos") - F.col("want")) <= slack), "left_semi")
        now = met.select(F.col("w_id").alias("doc_id"), F.col("w_key").alias("key"), "item", "places", "terms", "ends", "shift")
    return now.select("doc_id", "key", "item", "shift", "ends").distinct() if slack else now.select("doc_id", "key", "item", "shift", "ends")


def _search(docs: DataFrame, cut: DataFrame, small: bool, doc_id: str, text: str, n_terms: int, slack: int) -> DataFrame:
    counts = term_counts(docs, cut, small, doc_id, text)
    found = _written(tracks(cut, counts, n_terms), "tracks", small)
    needed = found.select(F.explode("terms").alias("term")).distinct()
    index, slices = store(docs, _written(counts.join(needed, "term", "left_semi"), "terms", small), small, doc_id, text)
    return intersect(index, slices, found, small, n_terms, slack)


def _few(cut: DataFrame, broadcast_windows: int) -> bool:
    return cut.limit(broadcast_windows + 1).count() <= broadcast_windows


def _windows(items: DataFrame, text: str, length: int, broadcast_windows: int) -> tuple[DataFrame, DataFrame, bool]:
    cut, names = windows(items, "item_id", text, length)
    small = _few(cut, broadcast_windows)
    return cut if small else through_disk(cut, "windows"), names, small


def phrase_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, broadcast_windows: int = BROADCAST_WINDOWS, n_terms: int = LISTS) -> DataFrame:
    """doc_id, key, item_id, at, start, length: every occurrence of every window in every document.

    key: hash of the text, telling apart rows of the same id. start: position of its first word, from 0. The rarest terms
    are compared themselves, whole windows by 128 bits of hash. Nulls and empty texts match nothing; equal rows give the
    same matches once; an empty table of documents or items gives no row; other columns are not looked at. A null
    item_id is an item like any other. The windows are broadcast if they number at most broadcast_windows, counted first.
    """
    cut, names, small = _windows(items, text, length, broadcast_windows)
    met = _search(docs, cut, small, doc_id, text, n_terms, 0).select("doc_id", "key", "item", "shift", F.explode("ends").alias("end"))
    some = met.withColumn("start", F.col("shift") + F.col("end.at")).filter("start >= 0")
    some = through_disk(some.groupBy(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key")).agg(F.collect_set(F.struct("item", "start", "end")).alias("some")), "met")
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key"))
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    whole = whole.join(_sided(some.select("c_id", "c_key"), _few(some, BROADCAST_DOCS)), same, "left_semi").dropDuplicates(["doc_id", "key"])
    back = whole.join(some, same).select("doc_id", "key", words(F.col("text")).alias("doc_terms"), "some")
    fits = lambda x: F.slice("doc_terms", x["start"] + 1, x["end"]["length"])
    good = F.filter("some", lambda x: (F.xxhash64(fits(x)) == x["end"]["phrase"]) & (F.xxhash64(F.lit(1), fits(x)) == x["end"]["again"]) & (x["start"] + x["end"]["length"] <= F.size("doc_terms")))
    hits = back.select("doc_id", "key", F.explode(good).alias("hit")).select("doc_id", "key", "hit.item", F.col("hit.end.at").alias("at"), "hit.start", F.col("hit.end.length").alias("length"))
    return hits.join(_sided(names, small), "item").select("doc_id", "key", "item_id", "at", "start", "length")


def proximity_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, n_terms: int = LISTS, slack: int = 2, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, key, item_id, at, start: where a window's n_terms rarest terms occur, each within `slack` words of its place.

    start: where the window would begin by its rarest term (by frequency, then code point, then place); it may lie before
    the text. Windows of fewer words need all of theirs. Nulls, empty texts and empty tables as in phrase_matches().
    """
    cut, names, small = _windows(items, text, length, broadcast_windows)
    met = _search(docs, cut, small, doc_id, text, n_terms, slack).select("doc_id", "key", "item", "shift", F.explode("ends.at").alias("at"))
    return met.join(_sided(names, small), "item").select("doc_id", "key", "item_id", "at", (F.col("shift") + F.col("at")).alias("start")).distinct()


def covered(spans: Column) -> Column:
    """Positions inside any of the spans, an array of struct(start, length)."""
    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(x["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(end, acc["upto"]).alias("upto"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), add)["n"]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hits_per: int = 20) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated; one row for each row of docs, none for an empty table.

    n_hit: words inside any occurrence of a window. contaminated: n_hit > 0 and hits_per * n_hit >= n_words. n_items counts ids,
    a null one too, which the hash of the ids leaves out. Null and empty texts have zeros; without items all have.
    Matches are gathered by document as distinct spans, no more than the document has words for each length.
    """
    found = phrase_matches(docs, items, doc_id, text, length)
    name = F.struct(F.col("item_id").cast("string").alias("id"))
    spans = found.groupBy(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key")).agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set(name).alias("items"))
    spans = spans.select("m_id", "m_key", covered(F.col("spans")).cast("long").alias("hit"), F.size("items").cast("long").alias("held"), F.array_sort(F.filter("items.id", lambda x: x.isNotNull())).alias("items"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    out = base.join(spans, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    out = out.withColumn("n_hit", F.coalesce("hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "key", "n_words", "n_hit", F.coalesce("held", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (hits_per * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
