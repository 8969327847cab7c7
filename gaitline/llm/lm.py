"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of every order up to `order` and a uniform one are mixed with weights by bucket of the
context's frequency. The weights are learned by expectation-maximisation on held-out counts: one training text in
TUNING, by its hash, so that copies go together, is deleted, and its tokens are predicted from the counts of the others. The
estimates that score have the counts of all training texts.

A task sends the distinct n-grams of its texts in packets by hash range; each range sums the training counts of
its n-grams over the whole corpus and answers every packet with them. So a frequent word is one entry a task,
nothing is joined row by row, and no count is dropped. Words are 64-bit hashes, longer n-grams 48-bit ones.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import as_strings, mix, in_parts, words_of
from .packets import cuts, n_ranges, pack, pack_sorted, unpack, unpack_sorted
from .shared import through_disk

ORDER = 2
#: Tokens that a task gathers before it sends them.
CHUNK_TOKENS = 1_500_000
#: One training text in so many is held out to learn the weights.
TUNING = 10
BUCKETS, ROUNDS = 40, 40
#: Probabilities are told apart to a quarter of a power of two where the weights are learned.
STEPS, LEVELS = 4, 160
_U = np.uint64
_END, _BEGIN, _ROLL = _U(0x6C62272E07BB0142), _U(0x27D4EB2F165667C5), _U(0xD1342543DE82EF95)
_PACKET = "range long, chunk long, keys binary, counts binary, apart binary, meta binary"


def gram_keys(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for n from 1; first: where texts begin. A begin mark pads the front."""
    out, before, key = [tokens], tokens, tokens
    for n in range(2, order + 1):
        before = np.concatenate((np.array([_BEGIN], np.uint64), before[:-1]))
        before[first] = _BEGIN
        key = key + before * (_ROLL ** _U(n - 1))
        out.append(mix(key + _U(n)) & ~_U(0xFFFF))
    return out


def _gather(n: int, order: int):
    def send(chunk: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        tokens, length = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        ids, valid, out, tuning = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4, 5))
        first = np.cumsum(length) - length
        train, aside = (np.repeat(x, length).astype(np.float64) for x in (~out, tuning))
        rows = []
        for k, key in enumerate(gram_keys(tokens, first, order)):
            own, inverse = np.unique(key, return_inverse=True)
            counts, apart = (np.bincount(inverse, x, minlength=len(own)).astype(np.uint64) for x in (train, aside))
            ranges, begin = cuts(own, n)
            rows += [(k * n + int(r), chunk, pack_sorted(own[s:e]), pack(counts[s:e], np.uint64), pack(apart[s:e], np.uint64), None) for r, s, e in zip(ranges, begin[:-1], begin[1:])]
            if k == 0:
                # frequent words get small numbers, which pack well
                rank = np.argsort(np.argsort(-np.bincount(inverse), kind="stable"), kind="stable")
                meta = {"words": pack_sorted(own), "rank": pack(rank), "stream": pack(rank[inverse]), "length": length, "doc_id": ids, "valid": valid, "held": out, "tuning": tuning}
        rows.append((chunk % n, chunk, None, None, None, pickle.dumps(meta)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.binary()] * 4))], ["range", "chunk", "keys", "counts", "apart", "meta"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n_tokens = TaskContext.get().partitionId() << 24, [], 0
        for b in in_parts(batches):
            ids, valid, out, tuning = np.array(b.column(0).fill_null(0)), np.array(b.column(0).is_valid()), np.array(b.column(1)), np.array(b.column(2))
            for w in words_of(as_strings(b.column(3)), lower=True):
                length = w.counts() + 1
                tokens = np.full(int(length.sum()), _END, np.uint64)
                tokens[np.arange(len(w.hash)) + w.doc] = w.hash
                own = slice(w.first, w.first + w.n_docs)
                held.append((tokens, length, ids[own], valid[own], out[own], tuning[own]))
                n_tokens += len(tokens)
                if n_tokens >= CHUNK_TOKENS:
                    yield from send(chunk, held)
                    chunk, held, n_tokens = chunk + 1, [], 0
        if held:
            yield from send(chunk, held)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """One range of one order: every packet's n-grams with their counts over all packets. Texts pass through.

    distinct, of one packet only: n-grams of the range with a count.
    """
    names = ("range", "chunk", "counts", "apart", "meta", "distinct")
    rows, packets = [], []
    for r, c, k, counts, apart, meta in zip(*(table.column(x).to_pylist() for x in ("range", "chunk", "keys", "counts", "apart", "meta"))):
        if meta is not None:
            rows.append((r, c, None, None, meta, 0))
        else:
            packets.append((r, c, unpack_sorted(k), unpack(counts, np.uint64), unpack(apart, np.uint64)))
    if packets:
        _, inverse = np.unique(np.concatenate([p[2] for p in packets]), return_inverse=True)
        total, aside = (np.bincount(inverse, np.concatenate([p[k] for p in packets]).astype(np.float64)).astype(np.uint64) for k in (3, 4))
        at = 0
        for k, (r, c, keys, *_) in enumerate(packets):
            own = inverse[at : at + len(keys)]
            rows.append((r, c, pack(total[own], np.uint64), pack(aside[own], np.uint64), None, int((total > 0).sum()) if not k else 0))
            at += len(keys)
    return pa.table([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], list(names))


#: A row for each chunk of texts: their ids and lengths, totals of the chunk, for each order the training counts of the n-grams
#: that end at its tokens, and of the held-out texts' tokens the counts without these texts.
_CHUNKS = "doc_id array<long>, held_out array<boolean>, tuning array<boolean>, n_tokens array<long>, train_tokens long, train_docs long, distinct long, counts array<binary>, base array<binary>"


def _resolved(n: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        answers, meta, distinct = [{} for _ in range(order)], None, 0
        for r, c, a, m, d in zip(*(table.column(x).to_pylist() for x in ("range", "counts", "apart", "meta", "distinct"))):
            if m is not None:
                meta = pickle.loads(m)
            else:
                answers[r // n][r % n] = unpack(c, np.uint64), unpack(a, np.uint64)
                distinct += d if r < n else 0
        length, words = meta["length"], unpack_sorted(meta["words"])
        by_rank = np.empty(len(words), np.uint64)
        by_rank[unpack(meta["rank"])] = words
        tokens = by_rank[unpack(meta["stream"])]
        tuned = np.repeat(meta["tuning"], length)
        counts, base = [], []
        for key, found in zip(gram_keys(tokens, np.cumsum(length) - length, order), answers):
            _, inverse = np.unique(key, return_inverse=True)
            total, aside = (np.concatenate([found[r][k] for r in sorted(found)])[inverse] for k in (0, 1))
            counts.append(pack(total, np.uint64))
            base.append(pack(total[tuned] - aside[tuned], np.uint64))
        ids = pa.array(meta["doc_id"], pa.int64(), mask=~meta["valid"])
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        train = ~meta["held"]
        cells = [one(ids), one(pa.array(meta["held"])), one(pa.array(meta["tuning"])), one(pa.array(length.astype(np.int64))), pa.array([int(length[train].sum())]), pa.array([int(train.sum())]), pa.array([distinct])]
        return pa.table([*cells, pa.array([counts], pa.list_(pa.binary())), pa.array([base], pa.list_(pa.binary()))], ["doc_id", "held_out", "tuning", "n_tokens", "train_tokens", "train_docs", "distinct", "counts", "base"])

    return run


def counted(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """_CHUNKS' rows: the texts of docs with the counts of their n-grams over the whole training corpus.

    Texts are read once. What is shuffled follows the distinct n-grams of each task's texts.
    """
    n = n_ranges(docs, text)
    held = F.coalesce(held_out, F.lit(False))
    tuning = ~held & (F.pmod(F.xxhash64(F.col(text)), F.lit(TUNING)) == 0)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held"), tuning.alias("tuning"), F.col(text).alias("text"))
    sent = rows.mapInArrow(_gather(n, order), _PACKET)
    back = sent.groupBy("range").applyInArrow(_summed, "range long, chunk long, counts binary, apart binary, meta binary, distinct long")
    return through_disk(back.groupBy("chunk").applyInArrow(_resolved(n, order), _CHUNKS), "counts")


def totals(table: DataFrame) -> tuple[int, int, int]:
    """(tokens, distinct words, texts) of the training texts of counted()'s rows."""
    return tuple(int(x or 0) for x in table.agg(F.sum("train_tokens"), F.sum("distinct"), F.sum("train_docs")).first())


def bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for none, then by powers of two."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _contexts(counts: list[np.ndarray], length: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """The contexts' counts of each order at each token; a text begins after the mark, as often as there are texts. None for order 1."""
    first = np.cumsum(length) - length
    out = [np.zeros(0)]
    for c in counts[:-1]:
        before = np.concatenate((np.zeros(1), c[:-1])) if len(c) else np.zeros(0)
        before[first] = n_docs
        out.append(before)
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _unpacked(row: list[bytes]) -> list[np.ndarray]:
    return [unpack(c, np.uint64).astype(np.float64) for c in row]


def learn(table: DataFrame, n: int, v: int, n_docs: int, order: int = ORDER) -> np.ndarray:
    """weights[bucket, order], order 0 being the uniform estimate; the context of the highest order gives the bucket.

    Every token of the held-out texts counts, predicted from the other training texts. They are gathered as a histogram over
    (bucket, level of each estimate), whose size is fixed. Without held-out texts all estimates weigh the same.
    """
    aside = table.select(F.explode(F.arrays_zip("tuning", "n_tokens")).alias("t")).filter("t.tuning").agg(F.sum("t.n_tokens"), F.count(F.lit(1))).first()
    n, n_docs = n - int(aside[0] or 0), n_docs - int(aside[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, float] = {}
        for b in batches:
            for tuning, length, base in zip(*(b.column(k).to_pylist() for k in range(3))):
                length = np.array(length)[np.array(tuning, bool)]
                if not len(length):
                    continue
                counts = _unpacked(base)
                contexts = _contexts(counts, length, n_docs)
                cell = bucket(contexts[-1]) if order > 1 else np.zeros(len(counts[0]), np.int64)
                for k in range(order):
                    p = counts[0] / max(1, n) if k == 0 else _ratio(counts[k], contexts[k])
                    level = np.where(p > 0, np.minimum(np.rint(-STEPS * np.log2(np.maximum(p, 1e-300))), LEVELS - 2), LEVELS - 1)
                    cell = cell * LEVELS + np.maximum(level, 0).astype(np.int64)
                for c, k in zip(*(x.tolist() for x in np.unique(cell, return_counts=True))):
                    total[c] = total.get(c, 0) + k
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["cell", "tokens"])

    cells = table.select("tuning", "n_tokens", "base").mapInArrow(run, "cell long, tokens long").groupBy("cell").agg(F.sum("tokens").alias("tokens")).toArrow()
    cell, weight = np.array(cells["cell"], np.int64), np.array(cells["tokens"], np.float64)
    p = np.empty((len(cell), order + 1))
    p[:, 0] = 1.0 / (v + 1)
    for k in range(order, 0, -1):
        level, cell = cell % LEVELS, cell // LEVELS
        p[:, k] = np.where(level == LEVELS - 1, 0.0, 2.0 ** (-level / STEPS))
    out = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    tokens = np.bincount(cell, weight, minlength=BUCKETS) if len(cell) else np.zeros(BUCKETS)
    for _ in range(ROUNDS if len(cell) else 0):
        share = p * out[cell]
        share *= (weight / share.sum(1))[:, None]
        new = np.stack([np.bincount(cell, share[:, k], minlength=BUCKETS) for k in range(order + 1)], 1)
        out = np.where(tokens[:, None] > 0, (new + 0.1) / (tokens[:, None] + 0.1 * (order + 1)), out)
    if order > 1:  # a context that was never seen gives no estimate
        out[0, order] = 0.0
        out[0] /= out[0].sum()
    return out


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each row of docs, none for an empty table.

    Tokens are the text's words, A-Z as a-z, and an end mark; null counts as an empty text. held_out: over docs'
    columns, which rows are not learned from. base_score: add-one unigrams; score: the interpolated model's log10
    probability. Without training rows the model is uniform. Other columns are not looked at.
    """
    table = counted(docs, held_out, doc_id, text, order)
    n, v, n_docs = totals(table)
    weights = learn(table, n, v, n_docs, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, held = (b.column(c).slice(k, 1).flatten() for c in (0, 1))
                length = np.array(b.column(2).slice(k, 1).flatten())
                counts = _unpacked(b.column(3)[k].as_py())
                contexts = _contexts(counts, length, n_docs)
                share = weights[bucket(contexts[-1]) if order > 1 else np.zeros(len(counts[0]), np.int64)]
                p = share[:, 0] / (v + 1) + share[:, 1] * counts[0] / max(1, n)
                for j in range(1, order):
                    p += share[:, j + 1] * _ratio(counts[j], contexts[j])
                first = np.cumsum(length) - length
                of = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
                known, base, full = of((counts[0] > 0).astype(np.int64)), of(np.log10((counts[0] + 1) / (n + v + 1))), of(np.log10(p))
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(length), pa.array(known), pa.array(np.full(len(length), n, np.int64)), pa.array(base), pa.array(full)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.select("doc_id", "held_out", "n_tokens", "counts").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
