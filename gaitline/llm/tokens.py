"""Token counts by offset-mapped attribution.

A whole text is encoded once; the tokens' spans are joined to the spans of sections or fields as intervals, and a
token over a boundary is allocated by an explicit rule. A byte-level vocabulary covers the text's bytes without
gaps, so the spans are running sums of the tokens' byte lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import as_strings, in_parts, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published pre-tokenisation pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
RULES = ("first", "last", "most")

_encodings: dict[int, tuple] = {}


def load_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes):
    """(encoding, byte length of each id), built once in a process."""
    key = hash(vocabulary)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, k in ranks.items():
            sizes[k] = len(piece)
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[key]


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens over a boundary). Both arrays: ends of adjoining spans from 0.

    rule: a token over boundaries goes to the section of its first byte, of its last, or of most of its bytes
    (ties: the earlier section).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not len(token_ends):
        return np.zeros(len(section_ends), np.int64), 0
    begin = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, begin, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    over = np.flatnonzero(first != last)
    owner = first if rule == "first" else last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for t in over.tolist():
            cuts = np.concatenate(([begin[t]], section_ends[first[t] : last[t]], [token_ends[t]]))
            owner[t] = first[t] + int(np.diff(cuts).argmax())
    return np.bincount(owner, minlength=len(section_ends)), len(over)


def _valid(raw: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, int]:
    """(text, ends of the sections in its bytes, its bytes); what is no UTF-8 becomes replacement characters."""
    b = raw.tobytes()
    try:
        return b.decode(), ends, len(b)
    except UnicodeDecodeError:
        parts = [x.tobytes().decode(errors="replace") for x in np.split(raw, ends)]
        sizes = np.cumsum([len(x.encode()) for x in parts])
        return "".join(parts), sizes[: len(ends)], int(sizes[-1])


def _counted(pieces: Iterator[tuple[np.ndarray, np.ndarray]], encoding, sizes: np.ndarray, rule: str) -> list[pa.Array]:
    total, n_sections, crossing, each = [], [], [], []
    for raw, ends in pieces:
        text, ends, n = _valid(raw, ends)
        ids = np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.int64)
        held, over = allocate(np.cumsum(sizes[ids]), ends, rule)
        total.append(len(ids))
        n_sections.append(len(ends))
        crossing.append(over)
        each.append(held)
    flat = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(n_sections))).astype(np.int32)
    return [pa.array(total, pa.int64()), pa.array(n_sections, pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, bounds in slices(as_strings(column)):
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield data[s:e]


def count_tokens(docs: DataFrame, sections: str = "\n", doc_id: str = "doc_id", text: str = "text", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing long, section_tokens array<long>; one row for each row of docs, none for an empty table.

    A section ends after each `sections` (one ASCII character), which belongs to it, and at the text's end; an
    empty text has none, and null counts as empty. Spans are in bytes of UTF-8, so that a token which ends inside a
    character has a place; bytes that are no UTF-8 count as replacement characters. Other columns are not looked at.
    No shuffle.
    """
    if len(sections) != 1 or ord(sections) > 127:
        raise ValueError("sections must end with one ASCII character")
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for raw in _texts(column):
            ends = np.flatnonzero(raw == ord(sections)) + 1
            if len(raw) and (not len(ends) or ends[-1] < len(raw)):
                ends = np.append(ends, len(raw))
            yield raw, ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(sent.value)
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *_counted(pieces(b.column(1)), encoding, sizes, rule)], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def count_field_tokens(docs: DataFrame, fields: Sequence[str], joiner: str = "\n", doc_id: str = "doc_id", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_crossing long, field_tokens map<string, long>; one row for each row of docs.

    The string columns `fields`, nulls as empty, are encoded as one text with `joiner` between, which belongs to the field
    before it; each token is attributed to a field by the rule. No shuffle; other columns are not looked at.
    """
    if not fields or len(set(fields)) != len(fields):
        raise ValueError("fields must be given and distinct")
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    held = [F.concat(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(joiner if k < len(fields) - 1 else "")) for k, c in enumerate(fields)]
    sizes_of = F.array(*(F.octet_length(x).cast("long") for x in held))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(*held).alias("text"), sizes_of.alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(sent.value)
        for b in in_parts(batches):
            ends = np.cumsum(np.array(b.column(2).flatten(), np.int64).reshape(-1, len(fields)), 1)
            total, _, crossing, each = _counted(zip(_texts(b.column(1)), ends), encoding, sizes, rule)
            yield pa.RecordBatch.from_arrays([b.column(0), total, crossing, each], ["doc_id", "n_tokens", "n_crossing", "each"])

    out = rows.mapInArrow(run, "doc_id long, n_tokens long, n_crossing long, each array<long>")
    return out.select("doc_id", "n_tokens", "n_crossing", F.map_from_arrays(F.array(*map(F.lit, fields)), "each").alias("field_tokens"))
