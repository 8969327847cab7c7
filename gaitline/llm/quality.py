"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a document are standardised and mapped by random Fourier features, whose inner products approximate
a Gaussian kernel; ridge scores come from the normal equations, summed by partition; isotonic regression on
a part held back turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import as_strings, in_parts, words_of, _STARTS_CHAR
from .repetition import BASE_GRAM, in_repeats, line_repeats
from .shared import through_disk

N_FEATURES, WIDTH, RIDGE, SEED = 256, 6.0, 1.0, 17
#: Bound of the labelled rows that the model is fitted on.
TRAIN_ROWS = 200_000
#: Partitions of the sums: each sends one matrix of N_FEATURES by N_FEATURES.
SUM_PARTS = 8
#: Steps of the sampling rate.
GRAIN = 1 << 40
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "word_chars", "symbol_words", "bar_words", "digit_share", "upper_share", "dot_share", "comma_share",
    "other_share", "lines_by_words", "dup_line_chars", "repeat_words", "same_as_last", "distinct_words", "beyond_ascii", "short_words", "long_words",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_DIGITS, _UPPER = _table(b"0123456789"), _table(bytes(range(65, 91)))
_SYMBOLS, _DOTS, _COMMAS = _table(b"#*$%&<>{}[]=\\^~@_"), _table(b".!?"), _table(b",;:")
_LETTERS = _UPPER | _table(bytes(range(97, 123))) | (np.arange(256) > 127)
_OTHER = ~(_DIGITS | _LETTERS | _DOTS | _COMMAS | _table(b" \t\n\r\x0b\x0c"))


def statistics(texts: pa.LargeStringArray) -> np.ndarray:
    """[text, statistic], bounded shares but for the first two; zeros for an empty text."""
    out = []
    for w in words_of(texts, lower=True):
        n = w.n_docs
        n_words = w.counts()
        per_word, chars = np.maximum(n_words, 1), w.chars()
        mean = lambda x: np.bincount(w.doc, x, minlength=n) / per_word  # noqa: E731, B023
        size = np.maximum(np.diff(w.bounds), 1)

        def share(table):
            upto = np.concatenate(([0], np.cumsum(table[w.data])))
            return (upto[w.bounds[1:]] - upto[w.bounds[:-1]]) / size  # noqa: B023

        def holding(table):
            upto = np.concatenate(([0], np.cumsum(table[w.data])))
            return mean(upto[w.end] > upto[w.start])  # noqa: B023

        _, dup_chars = line_repeats(w)
        total = np.maximum(np.bincount(w.doc, chars, minlength=n), 1)
        newlines = np.concatenate(([0], np.cumsum(w.data == 10)))
        lines = newlines[w.bounds[1:]] - newlines[w.bounds[:-1]]
        again = np.zeros(len(w.hash))
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        key = w.hash ^ (w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.zeros(len(key))
        first[np.unique(key, return_index=True)[1]] = 1
        lone = (w.end - w.start == 1) & (w.data[w.start] == ord("|")) if len(w.start) else np.zeros(0)
        columns = [
            np.log1p(n_words), mean(np.minimum(chars, 40)), holding(_SYMBOLS), mean(lone), share(_DIGITS), share(_UPPER), share(_DOTS), share(_COMMAS),
            share(_OTHER), lines / per_word, dup_chars / total, mean(in_repeats(w, BASE_GRAM)), mean(again), mean(first), share(~_STARTS_CHAR), mean(chars <= 2), mean(chars >= 16),
        ]
        out.append(np.stack(columns, 1))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def measured(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns to keep and x array<double>, the statistics; null texts count as empty. No shuffle."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema
    n = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            x = statistics(as_strings(b.column(b.num_columns - 1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], "x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.mapInArrow(run, f"{fields}, x array<double>")


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features; none if nothing was learned
    knots: np.ndarray  # raw scores
    values: np.ndarray  # calibrated at the knots


def features(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, n: int = N_FEATURES) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / WIDTH, (x.shape[1], n)) * np.sqrt(x.shape[1]) / 2, rng.uniform(0, 2 * np.pi, n)
    z = np.clip((x - centre) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / n) * np.cos(z @ w + b), np.ones((len(x), 1))])


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean score, mean label) of each block, both increasing."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(score[order].tolist(), label[order].tolist()):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y1, n1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + n1, blocks[-1][2] + s1]
    return np.array([s / n for _, n, s in blocks]), np.array([y / n for y, n, _ in blocks])


def fit(rows: DataFrame, label: str, calibrate: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """The model of rows with x and a 0/1 label; about train_rows of them at most, by a hash of x.

    calibrate: which rows are held back for the calibration. Without rows of either label all scores are 0.5.
    The labelled rows go through the shared folder, as several passes read them.
    """
    known = through_disk(rows.select("x", F.col(label).cast("double").alias("y"), calibrate.alias("held")).filter("y is not null"), "training")
    n = known.count()
    share = min(GRAIN, -(-train_rows * GRAIN // max(1, n)))
    some = known.filter(F.pmod(F.xxhash64("x"), F.lit(GRAIN)) < share).repartition(SUM_PARTS)
    d = len(STATISTICS)
    moments = some.select(*(F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)), *(F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(d))).first()
    if not n or moments[0] is None:
        return Model(np.zeros(d), np.ones(d), np.zeros(0), np.zeros(1), np.full(1, 0.5))
    centre = np.array(moments[:d])
    scale = np.maximum(np.array(moments[d:]), 1e-6)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = N_FEATURES + 1
        a, v = np.zeros((m, m)), np.zeros(m)
        for b in in_parts(batches):
            x = np.array(b.column(0).flatten()).reshape(-1, d)
            z, y = features(x, centre, scale), np.array(b.column(1))
            a += z.T @ z
            v += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([v.tobytes()])], ["a", "v"])

    parts = some.filter("not held").select("x", "y").mapInArrow(sums, "a binary, v binary").collect()
    m = N_FEATURES + 1
    a = sum(np.frombuffer(r["a"]).reshape(m, m) for r in parts) + RIDGE * np.eye(m)
    weights = np.linalg.solve(a, sum(np.frombuffer(r["v"]) for r in parts))
    held = some.filter("held").select("x", "y").toArrow()
    if not held.num_rows:
        return Model(centre, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    raw = features(np.array(held["x"].combine_chunks().flatten()).reshape(-1, d), centre, scale) @ weights
    knots, values = isotonic(raw, np.array(held["y"]))
    return Model(centre, scale, weights, knots, values)


def calibrated(model: Model, x: np.ndarray) -> np.ndarray:
    """Scores in 0 to 1: the isotonic steps, joined by lines, and a thousandth of the raw score to part ties."""
    if not len(model.weights):
        return np.full(len(x), 0.5)
    raw = features(x, model.centre, model.scale) @ model.weights
    return 0.999 * np.clip(np.interp(raw, model.knots, model.values), 0, 1) + 0.001 / (1 + np.exp(-4 * (raw - 0.5)))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows of measured() with score double for x; one row out for each row in, no shuffle."""
    kept = [c for c in rows.columns if c != "x"]
    d = len(STATISTICS)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(b.num_columns - 1).flatten()).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(calibrated(model, x))], [*b.schema.names[:-1], "score"])

    return rows.select(*kept, "x").mapInArrow(run, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, train: Column, calibrate: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, train, score double, predicted int; one row for each row of docs, none for an empty table.

    train, calibrate: over docs' id; which labelled rows may be learned from, and which of them calibrate. Labels
    are joined by id (a repeated or null label row of an id counts as its largest); null ids have no label.
    Texts are read once: their statistics, some 140 bytes a text, go through the shared folder.
    """
    rows = through_disk(measured(docs.select(F.col(doc_id).cast("long").alias("doc_id"), train.alias("train"), calibrate.alias("held"), F.col(text).alias("text")), "doc_id", "train", "held"), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = fit(rows.filter("train").join(known, "doc_id"), "label", F.col("held"))
    out = score(rows.drop("held"), model)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
