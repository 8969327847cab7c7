"""Each stage of the corpus pipeline against a brute-force version, on small tables with nulls, repeated ids and ties."""

import re
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import LOW, WORD, brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def said(rng, n, kinds=400):
    return " ".join(f"w{k}" for k in rng.integers(0, kinds, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    a, b = said(rng, 60), said(rng, 80)
    near = a.replace(a.split()[30], "other", 1)
    out = [(1, a, "en", "x"), (2, a, "en", "x"), (2, b, "en", "y"), (2, b, "en", "y"), (2, near, "en", "x"), (None, a, "de", None), (None, b, None, "y"), (3, None, None, "x"), (3, None, None, "x"), (4, "", "en", None), (5, "12 34 !", "en", "z"), (6, b + " tail", "en", "y"), (7, None, None, None)]
    out += [(k, said(rng, int(rng.integers(1, 90))), "en", ["x", "y", None][k % 3]) for k in range(10, 60)]
    return [(*r, 0) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("hub", F.lit(1)).withColumn("key", F.lit("k"))


def got(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect())


def test_language_stage(spark, docs, rows):
    out = P.language_stage(spark, docs, "")
    assert out.columns == docs.columns
    model = P.langid.learn(docs)
    assert model.languages == ["de", "en"]
    want = Counter()
    for r in rows:
        if r[1] and re.search(r"[a-z]", r[1]):
            scores = model.log_scores(r[1].split()).sum(0)
            if 1 / np.exp(scores - scores.max()).sum() >= P.MIN_SCORE:
                want[r[:4]] += 1
    assert got(out) == want


def test_join_stage(spark, docs, rows):
    out = P.join_stage(spark, docs, "")
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts.setdefault((r[0], r[1]), len(texts))
    by = {v: k for k, v in texts.items()}
    # the components of the distinct (id, text) rows; in each the smallest id stays, with one text
    comp = {k: c for k, (_, c) in brute_components({v: k[1] for k, v in texts.items()}).items()}
    groups = {}
    for v, c in comp.items():
        groups.setdefault(c, []).append(by[v])
    have = [(k[0], k[1]) for k in got(out).elements() if k[0] is not None]
    assert len(have) == len(set(have)) == len(groups)
    for members in groups.values():
        assert [m for m in members if m in set(have)] == [m for m in members if m[0] == min(x[0] for x in members) and m in set(have)] and any(m in set(have) for m in members)
    assert sum(v for k, v in got(out).items() if k[0] is None) == 2 and (2, rows[2][1]) in have


def test_decontamination_stage(spark, docs, rows, tmp_path):
    items = [(1, " ".join(rows[0][1].split()[5:30])), (None, rows[20][1]), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tests = [ITEM.findall((t or "").translate(LOW)) for _, t in items]
    wins = {tuple(w[i : i + 13]) for w in tests for i in range(max(1, len(w) - 12)) if w}
    want = Counter()
    for r in rows:
        w = ITEM.findall((r[1] or "").translate(LOW))
        hit = {j for i in range(len(w)) for n in {len(x) for x in wins} if tuple(w[i : i + n]) in wins for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want[r[:4]] += 1
    out = P.decontamination_stage(spark, docs, str(tmp_path))
    assert got(out) == want and sum(want.values()) < len(rows)


def test_mixing_stage(spark, docs, rows):
    out = P.mixing_stage(spark, docs, "")
    have = got(out)
    known = Counter(r[:4] for r in rows)
    size = lambda t: len(WORD.findall(t or ""))
    assert all(n <= 2 * known[k] and size(k[1]) for k, n in have.items())
    per = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    aim = P.mixing.targets(list(per.items()))
    for s in per:
        took = sum(n * size(k[1]) for k, n in have.items() if k[3] == s)
        assert abs(took - aim[s]) <= max(size(r[1]) for r in rows if r[3] == s)
    # what comes out is what the mix says, row by row
    said = Counter()
    for r in P.mixing.mix(docs).collect():
        said[r["doc_id"], r["size"]] += r["taken"]
    came = Counter()
    for k, n in have.items():
        came[k[0], size(k[1])] += n * size(k[1])
    assert {k: v for k, v in said.items() if v} == dict(came)


def test_sharding_stage(spark, docs, rows):
    import hashlib

    out = P.sharding_stage(spark, docs, "").collect()
    table = P.place.__globals__["lookup_table"](P.SHARDS)
    assert len(out) == len(rows)
    for r in out:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % 65537
        assert (r["slot"], r["shard"]) == (slot, table[slot])


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_of_an_empty_table(spark, docs, sf_small, name, stage):
    out = stage(spark, docs.limit(0), sf_small)
    assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
