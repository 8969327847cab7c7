"""Operators without SQL, against brute force, exact round trips or held-out rows; and the kernels under them."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaitline.llm import jaccard, langid, lm, packets, quality, queries, repetition, sharding, tokens
from gaitline.llm.kernel import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# --- kernels ---------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\x0b\x85ß", max_size=30), max_size=8), st.sampled_from([1, 7, 1 << 20]))
def test_words_and_hashes(ts, most):
    counts, seen = [], {}
    for w in words_of(pa.array(ts, pa.large_string()), True, most):
        counts += w.counts().tolist()
        for s, e, h in zip(w.start, w.end, w.hash):
            word = w.data[s:e].tobytes().decode().translate(LOW)
            assert seen.setdefault(word, h) == h
    assert counts == [len(WORD.findall(t)) for t in ts] and len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True))
def test_packets_round_trip(keys):
    k = np.sort(np.array(keys, np.uint64))
    assert (packets.unpack_sorted(packets.pack_sorted(k)) == k).all()
    ranges, begin = packets.cuts(k, 7)
    assert sum(e - s for s, e in zip(begin[:-1], begin[1:])) == len(k) and (np.diff(ranges) > 0).all()


# --- sharding -----------------------------------------------------------------------------------------------


def naive_table(names, size):
    import hashlib

    order = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        start, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        order.append(iter([(start + k * skip) % size for k in range(size)]))
    table = {}
    while len(table) < size:
        for s in range(len(names)):
            if len(table) < size:
                table[next(p for p in order[s] if p not in table)] = s
    return [table[k] for k in range(size)]


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    assert sharding.lookup_table(names, 211).tolist() == naive_table(names, 211)
    full = np.bincount(sharding.lookup_table(queries.SHARDS))
    assert full.max() - full.min() <= 1
    before, after = sharding.lookup_table(names, 10007), sharding.lookup_table(names[:-1], 10007)
    stayed = (before == after)[before < 6].mean()
    assert stayed > 0.85  # a shard that leaves moves few slots of the others
    w = np.bincount(sharding.lookup_table(names[:2], 10007, [3, 1]))
    assert abs(w[0] / w[1] - 3) < 0.01
    for bad in ((names, 210), (names, 5), ([], 11), (["a", "a"], 11)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, sf_small):
    import hashlib

    table = sharding.lookup_table(queries.SHARDS)
    for r in queries.op1_sharding(spark, sf_small).collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, table[slot])


# --- learned operators: held-out rows ---------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert ((out.predicted == 1) == (out.quality == 1)).mean() > 0.95
    assert (out.predicted == (out.score >= 0.3)).all()


def naive_statistics(text):
    w = WORD.findall(text)
    low = [x.translate(LOW) for x in w]
    n, raw = max(len(w), 1), text.encode()
    size = max(len(raw), 1)
    share = lambda chars: sum(b in chars for b in raw) / size
    grams = [tuple(low[i : i + 5]) for i in range(len(low) - 4)]
    often = Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        words = WORD.findall(line.decode())
        if words:
            dup += sum(map(len, words)) if line in seen else 0
            seen.add(line)
    total = max(sum(map(len, w)), 1)
    upper, digits, dots, commas = bytes(range(65, 91)), b"0123456789", b".!?", b",;:"
    letters = upper + bytes(range(97, 123)) + bytes(range(128, 256))
    other = bytes(b for b in range(256) if b not in digits + letters + dots + commas + b" \t\n\r\x0b\x0c")
    symbols = b"#*$%&<>{}[]=\\^~@_"
    beyond = sum((b & 0xC0) == 0x80 for b in raw) / size
    return [
        math.log1p(len(w)), sum(min(len(x), 40) for x in w) / n, sum(any(b in symbols for b in x.encode()) for x in w) / n, sum(x == "|" for x in w) / n, share(digits), share(upper), share(dots), share(commas),
        share(other), raw.count(b"\n") / n, dup / total, len(inside) / n, sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n, beyond, sum(len(x) <= 2 for x in w) / n, sum(len(x) >= 16 for x in w) / n,
    ]


def test_quality_statistics_equal_plain_counts(spark, sf_small):
    some = [t for t in texts(spark, sf_small).values() if t][:80] + ["", " \n", "a b c d e a b c d e\nx | | é ÄÖ\nx | | é ÄÖ\n", "word " * 30]
    got = quality.statistics(pa.array(some, pa.large_string()))
    assert np.allclose(got, [naive_statistics(t) for t in some], rtol=1e-9, atol=1e-12)


def test_ridge_equals_one_solve(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(k), i % 5 == 0) for i, (r, k) in enumerate(zip(x, y))], "x array<double>, label int, held boolean").repartition(7)
    model = quality.fit(rows, "label", F.col("held"))
    z = quality.features(x, x.mean(0), x.std(0))
    train = np.arange(400) % 5 != 0
    want = np.linalg.solve(z[train].T @ z[train] + quality.RIDGE * np.eye(z.shape[1]), z[train].T @ y[train])
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.scale, x.std(0)) and np.allclose(model.weights, want, atol=1e-8)
    knots, values = quality.isotonic(z[~train] @ want, y[~train].astype(float))
    assert np.allclose(model.knots, knots) and np.allclose(model.values, values)
    few = quality.fit(rows, "label", F.col("held"), train_rows=100)
    assert len(few.weights) == len(want) and not np.allclose(few.weights, want)


def test_isotonic():
    knots, values = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert values.tolist() == [0.0, 0.5, 1.0] and knots.tolist() == [1.0, 2.5, 4.0]


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(0).normal(size=(20, len(quality.STATISTICS)))
    z = quality.features(x, np.zeros(x.shape[1]), np.ones(x.shape[1]), 20_000)[:, :-1]
    s = 2 * quality.WIDTH / math.sqrt(x.shape[1])
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * s * s))
    assert np.abs(z @ z.T - exact).max() < 0.06


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "bc", "c", "▁abc"]
    p = np.array([[0.2], [0.1], [0.3], [0.15], [0.2], [0.05], [0.0], [1e-7]])
    # ▁ alone is beyond the vocabulary: its paths are as unlikely as that
    paths = 0.2 * 0.3 * 0.2 + 0.2 * 0.15 + 0.1 * 0.2 + 0.05
    e = langid.Trie(pieces).edges(["▁abc", "▁c"])
    assert langid.forward(e, p)[e.last[0], 0] == pytest.approx(paths, rel=1e-5)
    assert np.exp(langid.forward(e, np.log(np.maximum(p, 1e-300)), True)[e.last[0], 0]) == pytest.approx(paths, rel=1e-5)
    for logs in (False, True):
        uses = langid.expected(langid.Trie(pieces).edges(["▁abc"]), p, np.array([[1.0]]), logs)
        assert uses[5, 0] == pytest.approx(0.05 / paths, rel=1e-4) and uses[0, 0] == pytest.approx((0.012 + 0.03) / paths, rel=1e-4)


@pytest.fixture(scope="module")
def language_model(spark, sf_small):
    return langid.learn(spark.read.parquet(f"{sf_small}/documents.parquet"))


def naive_log_score(text, model):
    """Every segmentation of every run of letters, by a plain recursion over its places."""
    import regex

    number, longest = {x: k for k, x in enumerate(model.pieces)}, max(map(len, model.pieces))
    out = np.zeros(len(model.languages))
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        for run in regex.findall(r"\p{L}+", word.translate(LOW).lower()):
            run = "▁" + run
            z = [np.zeros(len(out))] + [np.full(len(out), -np.inf) for _ in run]
            for j in range(1, len(run) + 1):
                for i in range(max(0, j - longest), j):
                    k = number.get(run[i:j], len(number) + 1 if j == i + 1 else None)
                    if k is not None:
                        z[j] = np.logaddexp(z[j], z[i] + np.log(model.p[k]))
            out += z[-1]
    return out


def test_scores_of_whole_texts_equal_all_segmentations(spark, sf_small, language_model):
    model = language_model
    assert max(map(len, model.pieces)) > 12 and len(model.pieces) > 23_000
    known = [t for t in texts(spark, sf_small).values() if t][:25] + ["x" * 400 + " Straßenbahnhaltestellenverzeichnis" * 3, "ÄÖÜ internationalisation's 12ab34 日本語"]
    names, score = langid.classify(pa.array(known, pa.large_string()), model)
    for t, name, got in zip(known, names, score):
        row = naive_log_score(t, model)
        assert name == model.languages[int(row.argmax())] and got == pytest.approx(1 / np.exp(row - row.max()).sum(), rel=1e-6)


def test_very_long_words_and_broken_text(language_model):
    broken = pa.array([b"caf\xe9 der die das", b"\xff\xfe 12", b"a" * 200_000 + b" the"], pa.large_binary()).view(pa.large_string())
    names, score = langid.classify(broken, language_model)
    assert names[0] != "und" and names[1] == "und" and names[2] != "und" and (0 <= score).all() and (score <= 1).all()


# --- language model ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_equals_counts(spark, sf_small, order):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    table = lm.counted(docs, held, order=order)
    n, v, d = lm.totals(table)
    weights = lm.learn(table, n, v, d, order)
    assert np.allclose(weights.sum(1), 1)
    grams = [Counter() for _ in range(order)]
    toks = {k: WORD.findall((t or "").translate(LOW)) + [0] for k, t in texts(spark, sf_small).items()}
    for k, w in toks.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            p = [None] * (order - 1) + w
            for g in range(1, order + 1):
                grams[g - 1].update(tuple(p[i - g + 1 : i + 1]) for i in range(order - 1, len(p)))
    assert (n, v) == (sum(grams[0].values()), len(grams[0]))
    for r in lm.score(docs, held, order=order).limit(60).collect():
        w = toks[r["doc_id"]]
        p = [None] * (order - 1) + w
        total = 0.0
        for i in range(order - 1, len(p)):
            context = lambda g: d if all(x is None for x in p[i - g + 1 : i]) else grams[g - 2][tuple(p[i - g + 1 : i])]  # noqa: E731, B023
            top = context(order) if order > 1 else 0
            share = weights[min(int(math.log2(top)) + 1, lm.BUCKETS - 1) if top else 0]
            q = share[0] / (v + 1) + share[1] * grams[0][(p[i],)] / n
            for g in range(2, order + 1):
                q += share[g] * (grams[g - 1][tuple(p[i - g + 1 : i + 1])] / context(g) if context(g) else 0)
            total += math.log10(q)
        assert r["score"] == pytest.approx(total, rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((grams[0][(x,)] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["n_known"] == sum(grams[0][(x,)] > 0 for x in w)


def test_lm_weights_are_learned_on_held_out_texts(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    tuned = {r["doc_id"] for r in docs.filter(F.pmod(F.xxhash64("text"), F.lit(lm.TUNING)) == 0).select("doc_id").collect()}
    table = lm.counted(docs, F.lit(False), order=2)
    n, v, d = lm.totals(table)
    got = lm.learn(table, n, v, d, 2)
    toks = {k: [None, *WORD.findall((t or "").translate(LOW)), 0] for k, t in texts(spark, sf_small).items()}
    one, two = Counter(), Counter()
    for k, w in toks.items():
        if k not in tuned:
            one.update(w[1:])
            two.update(zip(w, w[1:]))
    n_base, starts = sum(one.values()), sum(k not in tuned for k in toks)
    rows = []  # bucket and the estimates of each held-out token
    for k in tuned:
        for a, b in zip(toks[k], toks[k][1:]):
            c = starts if a is None else one[a]
            rows.append((int(lm.bucket(np.array([c]))[0]), 1 / (v + 1), one[b] / n_base, two[a, b] / c if c else 0.0))
    which, p = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    want = np.full((lm.BUCKETS, 3), 1 / 3)
    for _ in range(lm.ROUNDS):
        share = p * want[which]
        share /= share.sum(1)[:, None]
        for c in np.unique(which):
            mine = share[which == c]
            want[c] = (mine.sum(0) + 0.1) / (len(mine) + 0.3)
    for c in np.unique(which):
        if c and (which == c).sum() > 200:  # levels of a quarter of a power of two: a little off
            assert np.abs(got[c] - want[c]).max() < 0.06


def test_lm_beats_unigrams_on_held_out_text(spark, sf_small):
    out = queries.op6_lm_scoring(spark, sf_small).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


# --- near duplicates ----------------------------------------------------------------------------------------------


def brute_components(docs, percent=80):
    sets = {}
    for k, t in docs.items():
        w = WORD.findall((t or "").translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    inv, parent = defaultdict(list), {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(sets):
        near = Counter(j for s in sets[k] for j in inv[s])
        for j, n in near.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((root(k), root(j)))
                parent[b] = a
        for s in sets[k]:
            inv[s].append(k)
    return {k: (len(sets[k]), root(k)) for k in sets}


def edited(rng, words, share):
    return [f"x{rng.integers(1 << 30)}" if rng.random() < share else w for w in words]


def test_linked_equals_brute_force(spark):
    """A large group about one text at and beyond the limit, chains, shared passages, deletions, short texts."""
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{rng.integers(1 << 30)}" for _ in range(n)]
    base, passage, out = fresh(200), fresh(60), []
    out += [edited(rng, base, s) for s in rng.uniform(0, 0.06, 150)] + [base]
    out += [base[int(rng.integers(0, 60)) : 200 - int(rng.integers(0, 30))] for _ in range(40)]  # losses only
    out += [base + fresh(int(rng.integers(1, 70))) for _ in range(40)]  # additions only
    for _ in range(60):
        at = int(rng.integers(0, 100))
        own = fresh(int(rng.integers(30, 200)))
        out.append(own[:at] + passage + own[at:])
    chain = fresh(150)
    for _ in range(25):
        chain = edited(rng, chain, 0.015)
        out.append(chain)
    small = fresh(12)
    out += [edited(rng, small, 0.05) for _ in range(60)] + [small[:k] for k in range(1, 13)]
    docs = {k: " ".join(w) for k, w in enumerate(out)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(df).collect()}
    assert got == brute_components(docs)


def test_links_are_complete(spark):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(120)]
    docs = {k: " ".join(edited(rng, base, 0.02)) for k in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    members, pairs = jaccard.links(df)
    of = {r["cls"]: r["doc_id"] for r in members.collect()}
    got = {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in pairs.collect()}
    sh = {k: {tuple(t.split()[i : i + 5]) for i in range(116)} for k, t in docs.items()}
    want = {(a, b) for a in docs for b in docs if a < b and sh[a] != sh[b] and 100 * len(sh[a] & sh[b]) >= 80 * len(sh[a] | sh[b])}
    assert got == want and want


@given(st.integers(1, 400))
@settings(max_examples=40, deadline=None)
def test_allocation_leaves_a_match(size):
    lo, hi, distance, m = jaccard.plan(size, 80)[-1]
    assert lo <= size <= hi
    h = jaccard.differing(hi)
    assert m - (h if distance == 1 else h // 2) >= 1


# --- tokens, repetition ---------------------------------------------------------------------------------------------


def test_tokens_cover_the_text(spark, sf_small):
    encoding, _ = tokens.encoder(tokens.load_vocabulary())
    known = texts(spark, sf_small)
    for r in queries.op8_token_counts(spark, sf_small).collect():
        t = known[r["doc_id"]]
        ids = encoding.encode_ordinary(t)
        starts = np.concatenate(([0], np.cumsum([len(encoding.decode_single_token_bytes(i)) for i in ids])[:-1])).astype(int)
        lines = t.encode().split(b"\n")
        ends = np.cumsum([len(x) + 1 for x in lines])
        want = Counter(np.searchsorted(ends, starts, "right").tolist())
        n = len(lines) - (lines[-1] == b"")
        assert r["n_tokens"] == len(ids) and r["section_tokens"] == [want[k] for k in range(n)]


@pytest.mark.parametrize("rule, want", [("first", [1, 1, 1]), ("last", [1, 0, 2]), ("most", [1, 1, 1])])
def test_allocation_rules(rule, want):
    # tokens 0-3, 3-9, 9-12 over sections 0-4, 4-8, 8-12: the second token begins in the first section
    got, over = tokens.allocate(np.array([4, 9, 12]), np.array([4, 8, 12]), rule)
    assert got.tolist() == want and over == 1
    with pytest.raises(ValueError):
        tokens.allocate(np.array([1]), np.array([1]), "none")


def test_repetition_coverage_of_known_texts():
    m = repetition.measure(pa.array(["a b c d e a b c d e", "x y\nx y\n\nx y", "p q r s t u v w"], pa.large_string()))
    assert m["n_repeat_words"].tolist() == [10, 0, 0] and m["n_dup_lines"].tolist() == [0, 2, 0] and m["dup_line_chars"].tolist() == [0, 4, 0]


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf_small).cache()
        kept[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    known = texts(spark, sf_small)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    first = ids(kept["language_id"])
    assert first == sorted(k for k, t in known.items() if t and re.search(r"[^\W\d_]", t))
    comp = brute_components({k: known[k] for k in first})
    assert ids(kept["jaccard_join"]) == sorted(k for k in first if comp[k][1] == k)
    assert set(ids(kept["decontamination"])) < set(ids(kept["jaccard_join"]))
    assert set(ids(kept["mixing"])) <= set(ids(kept["decontamination"]))
    assert ids(kept["sharding"]) == ids(kept["mixing"]) and kept["sharding"].columns == [*columns, "slot", "shard"]


def test_join_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (2, text), (2, text), (None, text), (3, None), (3, None), (4, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] for r in P.join_stage(spark, df, "").collect()), key=str) == [1, 3, 4, None]
