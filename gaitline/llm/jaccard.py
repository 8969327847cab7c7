"""N-gram Jaccard join by universe-partition pigeonhole.

A document's set of word shingles is cut into segments by a hash of the shingle. Two sets that link differ in few
shingles, so most segments are the same in both, or differ by one deletion: a size band's number of segments
and whether they are matched exactly or with their one-deletion neighbourhoods is allocated by cost. Segment
subsets are indexed by hash. What comes out is verified on the whole shingle sets.

1. One pass over the texts sends the segments' hashes in packets by hash range. What no other document of
   the task or of another task has is counted for its document; one whose differing segments are more than
   any partner allows links with nothing and goes. Copies in other tasks count as others, which keeps more.
2. The rest, one document for each set, is indexed. Each set is verified against the one at an end of a bucket that
   it meets most often, components are formed, and only buckets that hold several components go on. Near
   copies of one text are compared with the text in their middle; of those beyond its reach, only pairs that differ
   from it in common are compared with each other, which the triangle's rule proves to be enough. What has no such middle
   is compared by buckets, each set probing with its rarest segments. No bucket is cut short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .graph import components
from .kernel import as_strings, grams, mix, in_parts, words_of, Words
from .packets import cuts, n_ranges, pack, pack_sorted, unpack, unpack_sorted
from .shared import lean_driver, through_disk

WORDS, PERCENT = 5, 80
#: Size bands grow by this factor; hashes that a task gathers before it sends them.
BAND_RATIO, PACKET_KEYS = 1.5, 600_000
_U = np.uint64
_SHARED = 0xFFFFFFFF


def bands(upto: int) -> list[tuple[int, int]]:
    """(least, largest) size of each band, up to the one that holds `upto`."""
    out, lo = [], 1
    while not out or out[-1][1] < upto:
        nxt = max(lo + 1, math.ceil(lo * BAND_RATIO))
        out.append((lo, nxt - 1))
        lo = nxt
    return out


def differing(size: int, percent: int = PERCENT) -> int:
    """Most shingles in which a set may differ from a linked one that is no smaller."""
    return (100 - percent) * size // percent


def _tail(mean: float, at_least: int) -> float:
    """P(Poisson(mean) >= at_least)."""
    term = total = math.exp(-mean)
    for k in range(1, at_least):
        term *= mean / k
        total += term
    return max(0.0, 1.0 - total)


def allocate(lo: int, hi: int, percent: int = PERCENT) -> tuple[int, int]:
    """(distance, segments) of a band: 1: segments match exactly; 2: with one deletion.

    Cost of a document: hashes sent, and the chance that so many of its segments are empty that these must be
    sent as well, weighed by the bucket that all such documents share.
    """
    h = differing(hi, percent)
    if h == 0:
        return 1, 1
    best = None
    for distance in (1, 2):
        least = h + 1 if distance == 1 else h // 2 + 1
        for m in range(least, least + max(4, h)):
            void = (1 - 1 / m) ** lo + (lo / m * (1 - 1 / m) ** (lo - 1) if distance == 2 else 0.0)
            free = m - (h if distance == 1 else h // 2)
            cost = m + (hi if distance == 2 else 0) + 1e5 * _tail(m * void, free) if m > 1 else 1.0 + hi
            if best is None or cost < best[0]:
                best = cost, distance, m
    return best[1], best[2]


_plans: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}


def plan(upto: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(least, largest, distance, segments) of the bands that hold sizes up to `upto`."""
    key = len(bands(max(upto, 1))), percent
    if key not in _plans:
        _plans[key] = [(lo, hi, *allocate(lo, hi, percent)) for lo, hi in bands(max(upto, 1))]
    return _plans[key]


def shingle_sets(w: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles, sorted by text; a text of fewer words has its whole sequence as one."""
    count = w.counts()
    key, whole = grams(w.hash, w.doc, n)
    docs, keys = [w.doc[: len(key)][whole]], [key[whole]]
    begin = np.cumsum(count) - count
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            g, _ = grams(w.hash, w.doc, k)
            docs.append(few)
            keys.append(mix(g[begin[few]] + _U(k)))
    doc, keys = np.concatenate(docs).astype(np.int64), np.concatenate(keys)
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, keys = doc[order], keys[order]
    both = mix(keys + doc.astype(np.uint64) * _U(0xA24BAED4963EE407))
    order = np.argsort(both)
    again = both[order][1:] == both[order][:-1]
    new = np.ones(len(keys), bool)
    new[order[1:][again]] = False
    return doc[new], keys[new]


def class_of(doc: np.ndarray, keys: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, size) of each text's set; the class is a 64-bit hash of the set, 0 for an empty one."""
    size = np.bincount(doc, minlength=n_docs)
    total = np.zeros(n_docs, np.uint64)
    np.add.at(total, doc, mix(keys ^ _U(0x5851F42D4C957F2D)))
    return np.where(size > 0, mix(total + size.astype(np.uint64)), _U(0)).view(np.int64), size


def segments(doc: np.ndarray, keys: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each band: (slots' texts, need of each slot, hashes, slot of each hash).

    A slot is a text within a band: its own, or one below that holds sizes it may link with. need: how many of its
    hashes must be shared for it to link with anything there. slot arrays are numbered within the yield.
    """
    if not len(keys):
        return
    shingles = mix(keys ^ _U(0x14057B7EF767814F))
    least = -(-percent * size // 100)
    for b, (lo, hi, distance, m) in enumerate(plan(int(size.max()), percent)):
        chosen = np.flatnonzero((size >= lo) & (least <= hi))
        if not len(chosen):
            continue
        slot_of = np.full(len(size), -1, np.int64)
        slot_of[chosen] = np.arange(len(chosen))
        rows = slot_of[doc] >= 0
        slot, x = slot_of[doc[rows]], shingles[rows]
        seg = ((mix(x + _U(0x9E3779B97F4A7C15 * (b + 1) & 0xFFFFFFFFFFFFFFFF)) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        cell = slot * m + seg
        held = np.bincount(cell, minlength=len(chosen) * m)
        sums = np.zeros(len(held), np.uint64)
        np.add.at(sums, cell, x)
        at = np.flatnonzero(held)
        length, total = held[at], sums[at]
        salt = mix((at % m).astype(np.uint64) + _U((b + 1) << 32))
        h = np.where(size[chosen] <= hi, (100 - percent) * size[chosen] // percent, differing(hi, percent))
        filled = np.bincount(at // m, minlength=len(chosen))
        if distance == 1:
            free, void = m - h, m - filled
            sent, owner = [mix(total ^ salt)], [at // m]
        else:
            free, void = m - h // 2, m - np.bincount((at // m)[length >= 2], minlength=len(chosen))
            many = held[cell] > 1
            rest, home = sums[cell][many] - x[many], cell[many]
            sent = [mix(total ^ salt), mix(rest ^ mix((home % m).astype(np.uint64) + _U((b + 1) << 32)))]
            owner = [at // m, home // m]
        bad = void >= free
        if m == 1:
            bad = np.zeros(len(chosen), bool)
        if bad.any():  # their empty segments, and those that one deletion empties, are hashes as well
            s = np.repeat(np.flatnonzero(bad), m)
            k = np.tile(np.arange(m), int(bad.sum()))
            none = held[s * m + k] <= (0 if distance == 1 else 1)
            sent.append(mix(mix(k[none].astype(np.uint64) + _U((b + 1) << 32)) ^ _U(0)))
            owner.append(s[none])
        need = np.where(bad | (distance == 2), 1, np.maximum(1, free - void))
        yield chosen, need, np.concatenate(sent), np.concatenate(owner)


_META = "range long, chunk long, keys binary, slots binary, meta binary"


def _gather(n: int, percent: int):
    """Batches of (doc_id, text) -> packets; with each chunk one of its documents and slots."""
    import pickle

    def send(chunk: int, held: list[tuple], n_slots: int) -> Iterator[pa.RecordBatch]:
        keys, slots = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(keys, kind="stable")
        keys, slots = keys[order], slots[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        owner = np.where(np.diff(np.append(np.flatnonzero(first), len(keys))) > 1, _SHARED, slots[first])
        keys = keys[first]
        ranges, begin = cuts(keys, n)
        meta = {k: np.concatenate([h[2][k] for h in held]) for k in held[0][2]}
        out = [(int(r), pack_sorted(keys[s:e]), pack(owner[s:e])) for r, s, e in zip(ranges, begin[:-1], begin[1:])]
        rows = [*((r, chunk, k, s, None) for r, k, s in out), (chunk % n, chunk, None, None, pickle.dumps(meta))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["range", "chunk", "keys", "slots", "meta"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n_keys, n_slots, seen = TaskContext.get().partitionId() << 24, [], 0, 0, set()
        for b in in_parts(batches):
            ids, text_keys = (np.array(b.column(0).fill_null(0)), np.array(b.column(0).is_valid())), np.array(b.column(2))
            for w in words_of(as_strings(b.column(1)), lower=True):
                doc, keys = shingle_sets(w)
                cls, size = class_of(doc, keys, w.n_docs)
                own = slice(w.first, w.first + w.n_docs)
                # one document of a set speaks for it in this chunk
                fresh = np.zeros(w.n_docs, bool)
                for k, c in enumerate(cls.tolist()):
                    if size[k] and c not in seen:
                        seen.add(c)
                        fresh[k] = True
                rows = fresh[doc]
                sent = list(segments(doc[rows], keys[rows], np.where(fresh, size, 0), percent))
                at, parts = n_slots, []
                for texts, _, hashes, slot in sent:
                    parts.append((hashes, slot + at))
                    at += len(texts)
                meta = {
                    "doc_id": ids[0][own], "valid": ids[1][own], "key": text_keys[own], "cls": cls, "size": size,
                    "slot_cls": np.concatenate([cls[s[0]] for s in sent]) if sent else np.zeros(0, np.int64),
                    "need": np.concatenate([s[1] for s in sent]) if sent else np.zeros(0, np.int64),
                    "total": np.concatenate([np.bincount(s[3], minlength=len(s[0])) for s in sent]) if sent else np.zeros(0, np.int64),
                }
                n_slots = at
                held.append((np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64), np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64), meta))
                n_keys += len(held[-1][0])
                if n_keys > PACKET_KEYS:
                    yield from send(chunk, held, n_slots)
                    chunk, held, n_keys, n_slots, seen = chunk + 1, [], 0, 0, set()
        if held:
            yield from send(chunk, held, n_slots)

    return run


def _alone(table: pa.Table) -> pa.Table:
    """One range: for each chunk, how many hashes of each slot nothing else has. Documents pass through."""
    chunks, keys, slots, out = [], [], [], {"chunk": [], "slots": [], "counts": [], "meta": []}
    for c, k, s, meta in zip(*(table.column(x).to_pylist() for x in ("chunk", "keys", "slots", "meta"))):
        if meta is not None:
            for name, v in zip(out, (c, None, None, meta)):
                out[name].append(v)
            continue
        keys.append(unpack_sorted(k))
        slots.append(unpack(s))
        chunks.append((c, len(keys[-1])))
    if keys:
        key, slot = np.concatenate(keys), np.concatenate(slots)
        chunk = np.repeat(np.arange(len(chunks)), [n for _, n in chunks])
        order = np.argsort(key, kind="stable")
        key, slot, chunk = key[order], slot[order], chunk[order]
        alone = np.ones(len(key), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        alone &= slot != _SHARED
        both = np.unique((chunk[alone].astype(np.int64) << 32) | slot[alone], return_counts=True)
        at = np.searchsorted(both[0] >> 32, np.arange(len(chunks) + 1))
        for k, (c, _) in enumerate(chunks):
            s, e = at[k], at[k + 1]
            if e > s:
                for name, v in zip(out, (c, pack_sorted((both[0][s:e] & 0xFFFFFFFF).astype(np.uint64)), pack(both[1][s:e]), None)):
                    out[name].append(v)
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], list(out))


def _alive(table: pa.Table) -> pa.Table:
    """One chunk: its documents, and whether their set may link with another."""
    import pickle

    alone, meta = {}, None
    for s, n, m in zip(*(table.column(x).to_pylist() for x in ("slots", "counts", "meta"))):
        if m is not None:
            meta = pickle.loads(m)
            continue
        for k, c in zip(unpack_sorted(s).tolist(), unpack(n).tolist()):
            alone[k] = alone.get(k, 0) + c
    lonely = np.zeros(len(meta["need"]), np.int64)
    lonely[list(alone)] = list(alone.values())
    open_ = np.unique(meta["slot_cls"][meta["total"] - lonely >= meta["need"]])
    alive = np.isin(meta["cls"], open_) & (meta["size"] > 0)
    ids = pa.array(meta["doc_id"], pa.int64(), mask=~meta["valid"])
    return pa.table([ids, pa.array(meta["key"]), pa.array(meta["cls"]), pa.array(meta["size"].astype(np.int64)), pa.array(alive)], ["doc_id", "key", "cls", "n", "alive"])


def sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, key, cls, n, alive: each row's text (a hash), set, its size, and whether another set may link with it."""
    n = n_ranges(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))
    sent = rows.mapInArrow(_gather(n, percent), _META)
    back = sent.groupBy("range").applyInArrow(_alone, "chunk long, slots binary, counts binary, meta binary")
    return through_disk(back.groupBy("chunk").applyInArrow(_alive, "doc_id long, key long, cls long, n long, alive boolean"), "sets")


#: Shingles counted in so many parts of the universe, for a bound on the distance of two sets before theirs are sent.
SPREAD = 64
#: Sets are about a hub up to so many times the distance of a link.
ORBIT = 2
#: Rows of pairs, labels or hashes (16 to 24 bytes each) that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 250_000
#: Shingles (8 bytes each) of hubs that are broadcast at most.
BROADCAST_SHINGLES = 500_000


def _sided(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _survivors(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """cls, n, spread array<int>, shingles array<long>: the sets that may link, once each."""
    reps = through_disk(found.filter("alive and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep")), "reps")
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(_sided(reps), F.col("doc_id") == F.col("rep")).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            wanted = np.array(b.column(0))
            for w in words_of(as_strings(b.column(1)), lower=True):
                doc, keys = shingle_sets(w)
                cls, size = class_of(doc, keys, w.n_docs)
                kept = cls == wanted[w.first : w.first + w.n_docs]  # a repeated id may bring another text
                spread = np.bincount(doc * SPREAD + (keys >> _U(58)).astype(np.int64), minlength=w.n_docs * SPREAD).reshape(-1, SPREAD)[kept]
                own = keys[kept[doc]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size[kept]))).astype(np.int32)), pa.array(own))
                spreads = pa.ListArray.from_arrays(pa.array(np.arange(0, spread.size + 1, SPREAD, dtype=np.int32)), pa.array(spread.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(cls[kept]), pa.array(size[kept]), spreads, lists], ["cls", "n", "spread", "shingles"])

    out = through_disk(some.mapInArrow(run, "cls long, n long, spread array<int>, shingles array<long>"), "shingles")
    rows, sets_ = out.agg(F.count(F.lit(1)), F.countDistinct("cls")).first()
    return out if rows == sets_ else through_disk(out.dropDuplicates(["cls"]), "shingles")


def _index(survivors: DataFrame, percent: int) -> DataFrame:
    """sig, band, spare and the other columns of survivors but the sets: the segments' hashes. spare: how many of the set's
    hashes in the band need not be probed.
    """
    kept = [c for c in survivors.columns if c not in ("n", "spread", "shingles")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                sets_ = some.column(some.num_columns - 1)
                size = np.array(sets_.value_lengths())
                doc = np.repeat(np.arange(len(size)), size)
                for band, (texts, need, hashes, slot) in enumerate(segments(doc, np.array(sets_.flatten()).view(np.uint64), size, percent)):
                    row = pa.array(texts[slot])
                    # exact segments: a partner shares at least `need` of them, so all but need - 1 must be probed
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(slot), band, np.int32)), pa.array((need[slot] - 1).astype(np.int32)), *(some.column(k).take(row) for k in range(len(kept)))], ["sig", "band", "spare", *kept])

    return survivors.select(*kept, "shingles").mapInArrow(run, "sig long, band int, spare int, " + ", ".join(f"{c} long" for c in kept))


def _near(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, c) that may link by the sets' sizes and spreads: what these differ in is at most the sets' distance."""
    light = survivors.select("cls", "n", "spread")
    a, b = (light.select(*(F.col(c).alias(f"{c}_{x}") for c in light.columns)) for x in "ab")
    both = pairs.join(a, F.col("a") == F.col("cls_a")).join(b, F.col("b") == F.col("cls_b"))
    apart = F.aggregate(F.zip_with("spread_a", "spread_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    fits = (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return through_disk(both.filter(fits).select("a", "b", "c"), "near")


def _verify(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, of classes that link, by their whole sets. Each brings one set to the other's place."""
    near = pairs
    whole = survivors.select("cls", "n", "shingles")
    sent = whole.join(_sided(near), F.col("cls") == F.col("b")).select("a", "b", F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    pivots = whole.join(_sided(through_disk(near.select("a").distinct(), "pivots")).withColumnRenamed("a", "p"), F.col("cls") == F.col("p"), "left_semi")
    both = sent.join(pivots, F.col("a") == F.col("cls"))
    same = F.size(F.array_intersect("shingles", "sb"))
    return through_disk(both.filter(100 * same >= percent * (F.col("n") + F.col("nb") - same)).select("a", "b"), "links")


def _pairs(index: DataFrame) -> DataFrame:
    """All pairs a < b of a bucket where one probes.

    A set probes with its rarest hashes, all but `spare` of them; hashes that are gone were in no bucket with another.
    """
    sizes = index.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(W.partitionBy("cls", "band").orderBy(F.desc("c"), "sig"))
    probes = index.join(sizes, "sig").withColumn("rank", rank).filter("rank > spare").select("sig", F.col("cls").alias("a"))
    both = probes.join(index.select("sig", F.col("cls").alias("b")), "sig").filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The whole join: (membership: doc_id, key, cls, n; pairs: a, b of linked classes, a < b).

    Grows with the number of links between different sets; linked() doesn't.
    """
    found = sets(docs, doc_id, text, percent)
    survivors = _survivors(docs, found, doc_id, text)
    index = _index(survivors, percent)
    shared = index.groupBy("sig").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x < y").select("sig")
    return found.drop("alive"), _verify(_near(_pairs(through_disk(index.join(shared, "sig"), "index")).withColumn("c", F.lit(1)), survivors, percent).select("a", "b"), survivors, percent)


def _all(tables: list[DataFrame]) -> DataFrame:
    total = tables[0]
    for t in tables[1:]:
        total = total.unionByName(t)
    return total


def _labels(edges: list[DataFrame]) -> DataFrame:
    lean_driver(edges[0].sparkSession)
    return through_disk(components(_all(edges)).withColumnRenamed("node", "cls"), "labels")


def _mixed(index: DataFrame) -> DataFrame:
    """The hashes whose buckets hold several labels."""
    return index.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("sig")


def _open(index: DataFrame) -> DataFrame:
    """Rows of mixed buckets that can still bring a link: a set needs more than `spare` of them in a band. Twice over, as
    what goes makes other buckets single.
    """
    for _ in range(2):
        held = F.count(F.lit(1)).over(W.partitionBy("cls", "band"))
        enough = through_disk(index.withColumn("held", held).filter("held > spare").drop("held"), "apart")
        index = enough.join(_mixed(enough), "sig")
    return through_disk(index, "apart")


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, c) the one with the largest c for each node: as many as there are nodes at most."""
    ways = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "c").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "c"))
    first = ways.groupBy("u").agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("v"))
    return through_disk(first.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "tried")


def class_labels(docs: DataFrame, found: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """cls, label: sets that link with a different one, and their component."""
    survivors = _survivors(docs, found, doc_id, text)

    # the ends of each bucket, which are random members: classes are hashes
    ends = _index(survivors, percent).groupBy("sig").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b")
    tried = _best(_near(ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")), survivors, percent))
    edges = [_verify(tried, survivors, percent)]
    labels = _labels(edges)

    # only buckets that hold several components go on
    named = survivors.join(_sided(labels), "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "shingles")
    index = _index(named, percent)
    left = _open(index.join(_sided(through_disk(_mixed(index), "mixed")), "sig"))

    # near copies of one text: what each differs in from the text in their middle
    orbits = _orbits(left, survivors, percent)
    edges.append(through_disk(orbits.filter("near and cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")), "links"))
    labels = _labels(edges)
    named = left.drop("label").join(_sided(labels), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    left = _open(named.join(_mixed(named), "sig"))
    around = orbits.drop("label").join(_sided(labels), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    several = through_disk(around.groupBy("hub").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("hub"), "hubs")
    around = through_disk(around.join(_sided(several), "hub"), "orbits")

    # at last all pairs across components: of one orbit by what they differ in, the others by buckets
    pairs = _same_orbit(around, percent).unionByName(_other_orbits(left, around, survivors, percent)).distinct()
    edges.append(_verify(_near(pairs.join(tried, ["a", "b"], "left_anti").withColumn("c", F.lit(1)), survivors, percent).select("a", "b"), survivors, percent))
    return _labels(edges)


def _orbits(left: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """cls, hub, label, n, r, added array<long>, n_added, n_gone, near: the sets about a hub, the set whose buckets are the fullest of
    those that they meet; added and gone: what a set has and lacks against it, r in all, near: no more than links
    allow. Only sets within ORBIT times that.
    """
    sizes = left.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    score = left.join(sizes, "sig").groupBy("cls").agg(F.avg("c").alias("score"))
    tops = left.join(score, "cls").groupBy("sig").agg(F.max(F.struct("score", "cls")).alias("top")).select("sig", F.col("top.cls").alias("hub"))
    votes = left.join(tops, "sig").groupBy("cls", "label", "hub").agg(F.count(F.lit(1)).alias("c"))
    hubs = through_disk(votes.groupBy("cls", "label").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub")), "hubs")
    small = hubs.count() <= BROADCAST_ROWS
    for _ in range(2):  # a hub's own hub stands for it
        up = hubs.select(F.col("cls").alias("hub"), F.col("hub").alias("up"))
        hubs = hubs.join(F.broadcast(up) if small else up, "hub", "left").select("cls", "label", F.coalesce("up", "hub").alias("hub"))
    hubs = through_disk(hubs, "hubs")
    whole = survivors.select("cls", "n", "shingles")
    own = whole.join(_sided(hubs), "cls")
    middles = through_disk(hubs.select("hub").distinct(), "hubs")
    held = through_disk(whole.join(_sided(middles), F.col("cls") == F.col("hub")).select("hub", F.col("n").alias("nh"), F.col("shingles").alias("sh")), "middles")
    # a hub with many sets about it: where the hubs' own sets are small enough, these stay where they are
    few = (held.agg(F.sum("nh")).first()[0] or 0) <= BROADCAST_SHINGLES
    both = own.join(F.broadcast(held) if few else held, "hub").withColumn("added", F.array_except("shingles", "sh")).withColumn("n_added", F.size("added").cast("long"))
    both = both.withColumn("n_gone", F.col("nh") - F.col("n") + F.col("n_added")).withColumn("r", F.col("n_added") + F.col("n_gone"))
    limit = (100 - percent) * (F.col("n") + F.col("nh"))
    out = both.filter((100 + percent) * F.col("r") <= ORBIT * limit)
    return through_disk(out.select("cls", "hub", "label", "n", "r", "added", "n_added", "n_gone", ((100 + percent) * F.col("r") <= limit).alias("near")), "orbits")


def _same_orbit(around: DataFrame, percent: int) -> DataFrame:
    """a < b: pairs about one hub, of different labels, that may link.

    Their distance is r + r less twice what they added or lost in common. Either they added something in common, or
    what they lost in common must do, which is no more than the lesser of their losses.
    """
    added = around.select("hub", "cls", "label", F.explode("added").alias("e"))
    common = added.alias("x").join(added.alias("y"), (F.col("x.hub") == F.col("y.hub")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.label") != F.col("y.label")))
    common = common.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    # of two labels about a hub one is beyond its reach; the other must have lost more than it added
    light = around.drop("added").withColumn("gain", F.col("n_gone") - F.col("n_added")).withColumn("over", (100 + percent) * F.col("r") - (100 - percent) * F.col("n"))
    y = light.filter("gain > 0").alias("y")
    most = light.groupBy("hub").agg(F.max("gain").alias("most")).filter("most > 0")
    # a partner has at most 100 / percent as many shingles
    x = light.filter("not near").join(most, "hub").filter(percent * F.col("over") - 100 * (100 - percent) * F.col("n") <= percent * (100 + percent) * F.col("most")).alias("x")
    reach = F.col("x.over") + (100 + percent) * F.col("y.r") - (100 - percent) * F.col("y.n")
    fits = reach <= 2 * (100 + percent) * F.least("x.n_gone", "y.n_gone")
    lost = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.cls") != F.col("y.cls")) & (F.col("x.label") != F.col("y.label")) & fits)
    lost = lost.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    return common.unionByName(lost)


def _other_orbits(left: DataFrame, around: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """a < b: pairs of one bucket and different labels that don't share a hub, and may link by sizes and spreads."""
    named = through_disk(left.join(around.select("cls", "hub"), "cls", "left"), "apart")
    sizes = named.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(W.partitionBy("cls", "band").orderBy(F.desc("c"), "sig"))
    # sets without a hub probe with their rarest hashes, all but `spare`; what is gone was in no bucket with another label
    alone = named.filter("hub is null").join(sizes, "sig").withColumn("rank", rank).filter("rank > spare").select("sig", "cls", "label")
    first = _met(through_disk(alone, "probes"), named.select("sig", "cls", "label"), survivors, percent, F.lit(True))
    # sets of different hubs: those of a bucket's lesser hubs against the others
    held = named.filter("hub is not null").select("sig", "cls", "label", "hub")
    hubs = held.groupBy("sig", "hub").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(F.max(F.struct("c", "hub")).alias("top"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("sig", F.col("top.hub").alias("major"))
    mixed = through_disk(held.join(hubs, "sig"), "mixed")
    second = _met(mixed.filter("hub <> major").drop("major"), mixed.drop("major"), survivors, percent, F.col("x.hub") != F.col("y.hub"))
    return first.unionByName(second)


def _met(probes: DataFrame, index: DataFrame, survivors: DataFrame, percent: int, rule: Column) -> DataFrame:
    """a < b: a probe's set with those of its buckets, of other labels, by the rule. Sizes and spreads are part of the join's
    condition, so pairs that can't link are not made.
    """
    light = survivors.select("cls", "n", "spread")
    x = probes.join(light, "cls").alias("x")
    y = index.join(probes.select("sig").distinct(), "sig").join(light, "cls").alias("y")
    apart = F.aggregate(F.zip_with("x.spread", "y.spread", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, d: s + d)
    most = (100 - percent) * (F.col("x.n") + F.col("y.n"))
    near = (100 + percent) * F.abs(F.col("x.n") - F.col("y.n")) <= most
    both = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label")) & rule & near & ((100 + percent) * apart <= most))
    return both.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles long, component_id long, key long; one row for each row of docs, none for an empty table.

    Two documents link when 100 * intersection >= percent * union of their sets of 5-word shingles (with fewer words,
    the whole sequence). component_id: the smallest doc_id that links reach, itself included. Null and empty
    texts have empty sets and link with nothing; a null doc_id links with nothing either and has a null component.
    Rows of equal text are one set; rows that repeat an id with other texts each join their own component; key, a
    hash of the text, tells them apart. Other columns are not looked at. Shingles are 64-bit hashes.
    """
    lean_driver(docs.sparkSession)
    found = sets(docs, doc_id, text, percent)
    labels = class_labels(docs, found, doc_id, text, percent)
    # one row a set: of sets with several documents or links the smallest id, of each component the smallest of these
    firsts = found.filter("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held"))
    groups = through_disk(firsts.join(_sided(labels), "cls", "left").filter("held > 1 or label is not null").select("cls", F.coalesce("label", "cls").alias("label"), "first"), "groups")
    least = through_disk(groups.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    owner = through_disk(groups.join(_sided(least), "label").select("cls", "component_id"), "owners")
    named = found.join(_sided(owner), "cls", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"), "key")
