"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths over the words, in numpy: one pass of prefix sums, from which any run's hash is a
difference. For each length the characters inside n-grams that occur again in the same text, and the characters of lines
that occur again, as shares of all characters in words. A text fails when a share passes its limit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import as_strings, in_parts, mix, rolling, run_hashes, words_of, Words

#: N-gram length -> largest share of characters inside duplicated n-grams, and one for lines. From
#: length 5 and for lines the published limits for web text, below the base rule's share. The published limits of the
#: lengths 2 to 4 are for the most frequent n-gram, not for this share; those here lie between the shares of texts
#: labelled good (0.25 at most) and of labelled bad ones that repeat short runs only (1.0), see the README.
GRAM_LIMITS = {2: 0.50, 3: 0.50, 4: 0.50, 5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
#: Symbols to a word above which a text is reported as markup or noise; no part of the verdict.
SYMBOL_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"
BASE_GRAM, BASE_WORDS, BASE_SHARE = 5, 10, 20

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in GRAM_LIMITS)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def in_repeats_of(w: Words, lengths: Iterable[int]) -> dict[int, np.ndarray]:
    """Length -> which words lie in a run of so many words found twice or more in its text, the first included."""
    out, prefix = {}, rolling(w.hash)
    upto = np.cumsum(w.counts())[w.doc] if len(w.hash) else np.zeros(0, np.int64)
    where = np.arange(len(w.hash))
    # the text is part of the key: repeats across texts don't count
    text = w.doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for n in sorted(lengths):
        # a run that repeats begins with a shorter run that repeats
        where = where[where + n <= upto[where]]
        where = where[_repeated(mix(run_hashes(prefix, where, n) + text[where]))]
        inside = np.zeros(len(w.hash) + 1, np.int32)
        np.add.at(inside, where, 1)
        np.add.at(inside, where + n, -1)
        out[n] = np.cumsum(inside[:-1]) > 0
    return out


def in_repeats(w: Words, n: int) -> np.ndarray:
    """in_repeats_of() one length."""
    return in_repeats_of(w, [n])[n]


def line_repeats(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each text: lines with a word that equal an earlier line, and the characters in words of these lines."""
    nl = w.data == 0x0A
    edge = np.zeros(len(w.data) + 1, bool)
    edge[1:][nl] = True
    edge[w.bounds] = True
    begin = np.flatnonzero(edge[:-1])
    if not len(begin):
        z = np.zeros(w.n_docs, np.int64)
        return z, z
    # a line is its bytes: a rolling sum over them, blanks included, with its length and text
    end = np.append(begin[1:], len(w.data))
    end = end - nl[end - 1]
    size = end - begin
    held = size > 0
    begin, end, size = begin[held], end[held], size[held]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    byte = w.data[np.repeat(begin, size) + at].astype(np.uint64) + np.uint64(1)
    # Horner by blocks would need a loop; powers by place, mixed, serve as independent weights
    weight = mix(at.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    total = np.add.reduceat(mix(byte * np.uint64(0x9FB21C651E98DF25) + weight), np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
    doc = np.searchsorted(w.bounds, begin, "right") - 1
    upto = np.searchsorted(w.start, np.append(begin, len(w.data)))
    words_in = np.searchsorted(w.start, end) - upto[:-1]
    chars = np.concatenate(([0], np.cumsum(w.chars())))
    real = words_in > 0
    key = mix(total + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + mix(doc.astype(np.uint64)))[real]
    doc, first, n_in = doc[real], upto[:-1][real], words_in[real]
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order][1:] == key[order][:-1]
    inside = (chars[first + n_in] - chars[first])[later]
    return np.bincount(doc[later], minlength=w.n_docs), np.bincount(doc[later], inside, minlength=w.n_docs).astype(np.int64)


def _is_symbol() -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(SYMBOLS, np.uint8)] = True
    return out


def measure(texts: pa.LargeStringArray) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but doc_id."""
    parts: dict[str, list[np.ndarray]] = {}
    symbol = _is_symbol()
    for w in words_of(texts, lower=False):
        n, chars = w.n_docs, w.chars()
        of = lambda x: np.bincount(w.doc, x, minlength=n).astype(np.int64)
        marks = np.concatenate(([0], np.cumsum(symbol[w.data])))
        dup, dup_chars = line_repeats(w)
        inside = in_repeats_of(w, {BASE_GRAM, *GRAM_LIMITS})
        now = {"n_words": w.counts(), "word_chars": of(chars), "n_symbols": marks[w.bounds[1:]] - marks[w.bounds[:-1]], "n_dup_lines": dup, "n_repeat_words": of(inside[BASE_GRAM]), "dup_line_chars": dup_chars}
        now |= {f"dup_{k}gram_chars": of(np.where(inside[k], chars, 0)) for k in GRAM_LIMITS}
        for k, v in now.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(v).astype(np.int64) for k, v in parts.items()}


def coverage(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SCHEMA's columns; one row for each row of docs. Null and empty texts have zeros; other columns aren't looked at. No shuffle."""
    schema = SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            found = measure(as_strings(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in found.values())], ["doc_id", *found])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def judge(measured: DataFrame) -> DataFrame:
    """coverage()'s rows with base_failed, coverage_failed, symbol_failed and kept booleans.

    kept: neither the base rule nor a limit of lines or n-grams is broken. symbol_failed tells of markup and noise, for the
    caller to act on. No row is added or lost; a text without words fails the base rule only.
    """
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_SHARE * F.col("n_words"))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    broken = F.col("dup_line_chars") > LINE_LIMIT * chars
    for n, most in GRAM_LIMITS.items():
        broken = broken | (F.col(f"dup_{n}gram_chars") > most * chars)
    out = measured.withColumn("base_failed", base).withColumn("coverage_failed", broken)
    return out.withColumn("symbol_failed", F.col("n_symbols") > SYMBOL_LIMIT * F.col("n_words")).withColumn("kept", ~F.col("base_failed") & ~F.col("coverage_failed"))
