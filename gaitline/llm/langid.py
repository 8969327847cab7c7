"""Language identification by segmentation-marginalised unigrams.

For each language a probability for every piece of a fixed public vocabulary; a word's probability is the sum
over all its segmentations into pieces, by a forward algorithm; a text's score adds the words' logarithms. Words are runs of
letters, of any length: all pieces of letters are used, whatever their length, and no segmentation is left out.
The piece probabilities are learned by expectation-maximisation over all segmentations (forward-backward).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .kernel import as_strings, in_parts, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bounds of the sample that the probabilities are learned from: texts a language, languages, and words of all of them.
TRAIN_DOCS, MAX_LANGUAGES, MAX_WORDS = 300, 200, 500_000
#: Steps of the sampling rate, and how many times the texts wanted it lets through at first.
GRAIN, MARGIN = 1 << 40, 4
ROUNDS = 2
#: Pseudo-words of the pooled distribution added to each language; probability of a character beyond the vocabulary.
SMOOTHING, UNKNOWN = 2000.0, 1e-7
UNDETERMINED = "und"
CACHE_WORDS = 700_000
#: Longer words are summed in logarithms, which do not underflow; words of a lattice.
PLAIN_CHARS, LATTICE_WORDS = 24, 2_000

_letters = regex.compile(r"\p{L}+")


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """All pieces of letters, with their word mark, of a sentencepiece model; words are runs of letters, so others never match."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    low = {p.lower() for p in names}
    return sorted(p for p in low if p.strip("▁") and p.lstrip("▁").isalpha() and p.count("▁") <= 1)


@dataclass
class Edges:
    """The pieces at all places of some words: an edge leads from node `start` to node `end`. Word k has nodes first[k] to last[k]."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    place: np.ndarray  # characters before the edge, in its word
    word: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Trie:
    """The vocabulary as sorted (state, character) keys, so that all places of many words step at once."""

    def __init__(self, pieces: list[str]) -> None:
        self.n = len(pieces)
        states, steps, held = {"": 0}, {}, {}
        for k, p in enumerate(pieces):
            for i in range(len(p)):
                to = states.setdefault(p[: i + 1], len(states))
                steps[(states[p[:i]] << 21) | ord(p[i])] = to
            held[states[p]] = k
        self.keys = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(len(states), -1, np.int64)
        self.piece[list(held)] = list(held.values())

    def edges(self, words: list[str]) -> Edges:
        """Every piece at every place; a character that is no piece has an edge of its own, numbered n + 1."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        begin = np.cumsum(size) - size
        upto = (begin + size)[word]
        at, state, k = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        starts, ends, pieces = [], [], []
        while len(at):
            key = (state << 21) | chars[at + k]
            slot = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[slot] == key if len(self.keys) else np.zeros(len(at), bool)
            to = np.where(hit, self.to[slot], 0) if len(self.keys) else np.zeros(len(at), np.int64)
            piece = np.where(hit, self.piece[to], -1)
            if k == 0:
                piece = np.where(piece < 0, self.n + 1, piece)
            found = piece >= 0
            starts.append(at[found])
            ends.append(at[found] + k + 1)
            pieces.append(piece[found])
            k += 1
            more = hit & (at + k < upto[at])
            at, state = at[more], to[more]
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, pieces))
        own = word[start]
        # a word has one node more than characters
        return Edges(start + own, end + own, piece, start - begin[own], own, begin + np.arange(len(words)), begin + size + np.arange(len(words)))


def _groups(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted edges, bounds of those with one value): no two of them, by start or by end, meet in a node."""
    by = np.argsort(order, kind="stable")
    return by, np.flatnonzero(np.concatenate(([True], order[by][1:] != order[by][:-1], [True]))) if len(by) else np.zeros(1, np.int64)


def forward(e: Edges, p: np.ndarray, logs: bool = False) -> np.ndarray:
    """alpha[node, language]: probability of a word's characters up to the node over all segmentations; p: [piece, language].

    logs: p and alpha are logarithms.
    """
    alpha = np.full((int(e.last[-1]) + 1 if len(e.last) else 0, p.shape[1]), -np.inf if logs else 0.0)
    alpha[e.first] = 0.0 if logs else 1.0
    by, bounds = _groups(e.place)
    for s, t in zip(bounds[:-1], bounds[1:]):
        rows = by[s:t]
        to, via = e.end[rows], alpha[e.start[rows]]
        if logs:
            alpha[to] = np.logaddexp(alpha[to], via + p[e.piece[rows]])
        else:
            alpha[to] += via * p[e.piece[rows]]
    return alpha


def backward(e: Edges, p: np.ndarray, logs: bool = False) -> np.ndarray:
    """beta[node, language]: probability of the characters after the node, as forward()."""
    beta = np.full((int(e.last[-1]) + 1 if len(e.last) else 0, p.shape[1]), -np.inf if logs else 0.0)
    beta[e.last] = 0.0 if logs else 1.0
    by, bounds = _groups(-(e.place + e.end - e.start))
    for s, t in zip(bounds[:-1], bounds[1:]):
        rows = by[s:t]
        to, via = e.start[rows], beta[e.end[rows]]
        if logs:
            beta[to] = np.logaddexp(beta[to], via + p[e.piece[rows]])
        else:
            beta[to] += via * p[e.piece[rows]]
    return beta


def expected(e: Edges, p: np.ndarray, weight: np.ndarray, logs: bool = False) -> np.ndarray:
    """Expected number of uses of each piece [piece, language]; p: probabilities; weight: count of each word [word, language]."""
    q = np.log(np.maximum(p, 1e-300)) if logs else p
    alpha, beta = forward(e, q, logs), backward(e, q, logs)
    whole = alpha[e.last][e.word]
    if logs:
        use = np.exp(alpha[e.start] + q[e.piece] + beta[e.end] - whole) * weight[e.word]
    else:
        use = alpha[e.start] * p[e.piece] * beta[e.end] * (weight[e.word] / np.maximum(whole, 1e-300))
    return np.stack([np.bincount(e.piece, use[:, c], minlength=len(p)) for c in range(p.shape[1])], 1) if p.shape[1] else np.zeros_like(p)


def parts_of(word: str) -> list[str]:
    """The runs of letters of a lower-case word, marked where they begin."""
    return ["▁" + run for run in _letters.findall(word)]


def _lattices(words: list[str]) -> Iterator[tuple[list[int], bool]]:
    """(numbers of words, whether they are long) in runs of words of like length."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    short = next((k for k, x in enumerate(order) if len(words[x]) > PLAIN_CHARS), len(order))
    for lo, hi, logs in ((0, short, False), (short, len(order), True)):
        for at in range(lo, hi, LATTICE_WORDS):
            yield order[at : min(at + LATTICE_WORDS, hi)], logs


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray  # [piece, language]; then a row of zeros, and one for unknown characters
    #: word hash -> row of `rows`, or -1 for a word without a letter
    cache: dict[int, int] = field(default_factory=dict, repr=False)
    rows: list[np.ndarray] = field(default_factory=list, repr=False)
    trie: Trie | None = field(default=None, repr=False)

    def log_scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: natural logarithm of each word's probability; of words of several runs of letters, the runs' sum."""
        self.trie = self.trie or Trie(self.pieces)
        number: dict[str, int] = {}
        owner, part = [], []
        for k, w in enumerate(words):
            for run in parts_of(w):
                owner.append(k)
                part.append(number.setdefault(run, len(number)))
        runs = list(number)
        z = np.zeros((len(runs), len(self.languages)))
        logp = np.log(np.maximum(self.p, 1e-300))
        for some, logs in _lattices(runs):
            e = self.trie.edges([runs[k] for k in some])
            whole = forward(e, logp if logs else self.p, logs)[e.last]
            z[some] = whole if logs else np.log(np.maximum(whole, 1e-300))
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, np.array(owner, np.int64), z[np.array(part, np.int64)])
        return out


def train(counts: Iterable[tuple[str, str, float]], languages: list[str], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """The model of (language, word, count) rows."""
    number = {x: k for k, x in enumerate(languages)}
    total: dict[str, np.ndarray] = {}
    for lang, word, n in counts:
        for part in parts_of(word):
            if part not in total:
                total[part] = np.zeros(len(languages))
            total[part][number[lang]] += n
    words, trie = sorted(total), Trie(pieces)
    p = np.full((len(pieces) + 2, len(languages)), 1.0 / max(1, len(pieces)))
    p[-2], p[-1] = 0.0, UNKNOWN
    for _ in range(rounds):
        uses = np.zeros_like(p)
        for some, logs in _lattices(words):
            uses += expected(trie.edges([words[k] for k in some]), p, np.array([total[words[k]] for k in some]), logs)
        uses = uses[:-2]
        pooled = uses.sum(1) + 0.01
        uses = uses + SMOOTHING * (pooled / pooled.sum())[:, None]
        p[:-2] = uses / uses.sum(0)
    return Model(languages, pieces, p)


def _word_text(raw: bytes) -> str:
    """A word as it is looked up; bytes that are no UTF-8 become replacement characters, which are no letters."""
    return raw.decode(errors="replace").lower()


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS, max_languages: int = MAX_LANGUAGES, max_words: int = MAX_WORDS) -> Model:
    """The model of docs whose lang and text aren't null: of each language the train_docs distinct texts with the least hashes,
    however often each occurs, and of their words the max_words most frequent.

    Over max_languages languages: ValueError. No rows: a model without languages.
    """
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash")).filter("lang is not null and text is not null")
    order = F.pmod("hash", F.lit(GRAIN))
    sizes = [(r["lang"], max(1, r["n"])) for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).limit(max_languages + 1).collect()]
    if len(sizes) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not sizes:
        return Model([], [], np.zeros((2, 0)))
    # a rate lets a few times as many texts through as are wanted, all of a small language; then exactly the first ones are taken
    share = F.create_map(*(F.lit(x) for k, n in sizes for x in (k, min(GRAIN, MARGIN * train_docs * GRAIN // n + 1 if n > train_docs else GRAIN))))
    near = known.filter(order < share[F.col("lang")]).groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("copies"))
    taken = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(order, "hash"))).filter(F.col("k") <= train_docs)
    taken = taken.select(F.col("lang").alias("t_lang"), F.col("hash").alias("t_hash"), F.greatest(F.lit(1), F.floor(F.lit(1 << 20) / F.col("copies"))).cast("long").alias("weight"))
    # at most train_docs rows for each of max_languages languages; all copies of a text weigh as one
    some = known.join(F.broadcast(taken), (F.col("lang") == F.col("t_lang")) & (F.col("hash") == F.col("t_hash"))).select("lang", "weight", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}
        for b in in_parts(batches):
            langs, weight = b.column(0).to_pylist(), b.column(1).to_pylist()
            for w in words_of(as_strings(b.column(2)), lower=True):
                raw = w.data.tobytes()
                for d, s, e in zip(w.doc.tolist(), w.start.tolist(), w.end.tolist()):
                    key = langs[w.first + d], _word_text(raw[s:e])
                    total[key] = total.get(key, 0) + weight[w.first + d]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])

    counted = some.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "lang", "word").limit(max_words).toArrow()
    return train(zip(rows.column("lang").to_pylist(), rows.column("word").to_pylist(), (n / (1 << 20) for n in rows.column("n").to_pylist())), sorted(k for k, _ in sizes), load_pieces(vocabulary))


def classify(texts: pa.LargeStringArray, model: Model) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; `und` and 0 without a letter."""
    names, best, cache = [], [], model.cache
    for w in words_of(texts, lower=True):
        keys, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(cache) > CACHE_WORDS:
            cache.clear()
            model.rows.clear()
        known = keys.tolist()
        new = [k for k, h in enumerate(known) if h not in cache]
        if new:
            raw = w.data.tobytes()
            words = [_word_text(raw[s:e]) for s, e in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())]
            held = sum(map(len, model.rows))
            model.rows.append(model.log_scores(words))
            cache.update((known[k], held + j if _letters.search(word) else -1) for j, (k, word) in enumerate(zip(new, words)))
        if len(model.rows) > 64:
            model.rows[:] = [np.concatenate(model.rows)]
        at = np.array([cache[h] for h in known], np.int64)
        lettered = at >= 0
        table = _rows_at(model.rows, at) * lettered[:, None] if len(at) else np.zeros((0, len(model.languages)))
        any_letter = np.bincount(w.doc[lettered[inverse]], minlength=w.n_docs) > 0
        total = np.stack([np.bincount(w.doc, table[inverse, c], minlength=w.n_docs) for c in range(len(model.languages))], 1) if model.languages else np.zeros((w.n_docs, 0))
        for has, row in zip(any_letter.tolist(), total):
            if not has or not model.languages:
                names.append(UNDETERMINED)
                best.append(0.0)
            else:
                k = int(row.argmax())
                names.append(model.languages[k])
                best.append(float(1.0 / np.exp(row - row[k]).sum()))
    return names, np.array(best)


def _rows_at(parts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Rows of the parts one after another, without joining them."""
    begin = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    which = np.searchsorted(begin, np.maximum(at, 0), "right") - 1
    out = np.zeros((len(at), parts[0].shape[1]))
    for k in np.unique(which).tolist():
        rows = which == k
        out[rows] = parts[k][np.maximum(at[rows], 0) - begin[k]]
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with pred_col string and score_col double (the language's posterior, equal priors) appended or replaced.

    One row out for each row in, no shuffle. Null texts and texts without a letter: `und`, 0; so is every text
    under a model without languages. The model (pieces times languages, both bounded) goes out with the task.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p))
    kept = docs.drop(pred_col, score_col)
    at = next(k for k, c in enumerate(kept.columns) if c.lower() == text.lower())
    schema = T.StructType([*kept.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in in_parts(batches):
            names, score = classify(as_strings(b.column(at)), own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names), pa.array(score)], [*b.schema.names, pred_col, score_col])

    return kept.mapInArrow(run, schema)
