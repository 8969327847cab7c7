"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitline.llm import chat, decontam, jaccard, langid, lm, mixing, quality, repetition, sharding, tokens
from gaitline.llm.shared import fold

PROSE = " ".join(f"word{k % 37} and{k % 11}" for k in range(60))
LONG = " ".join(f"w{k}" for k in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "b"), (2, PROSE, "en", "b"), (3, None, None, None), (4, "", "en", "a"), (None, PROSE, "de", None), (5, "one two", "de", "a"), (6, LONG, "en", "a"),
    (7, " \t\n\x0b ", None, "b"), (8, "ÄÖ é\x85x 123 !?", "fr", "c"), (9, "123 456 !", None, "a"), (None, None, None, None), (10, "One  TWO", "de", "a"), (11, "x" * 3000, "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["hub", "label", "size", "key", "terms", "sig", "held", "train", "x", "chunk", "range", "pattern", "seeded", "count", "rep", "cls", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sharding(docs, none):
    out = sharding.place(docs, "doc_id", ["a", "b", "c"], 101)
    assert out.count() == len(ROWS) and out.filter("shard is null").count() == 0
    assert out.select("doc_id", "shard").distinct().count() == docs.select("doc_id").distinct().count()
    assert sharding.place(none, "doc_id", ["a"], 11).count() == 0
    again = sharding.place(out, "doc_id", ["a", "b", "c"], 101)  # its own columns are replaced
    assert again.columns == out.columns
    for key in ("slot", "shard", "SHARD"):  # a key of these names is read, then replaced
        named = sharding.place(docs.withColumnRenamed("doc_id", key), key, ["a", "b", "c"], 101)
        assert sorted(r["shard"] for r in named.collect()) == sorted(r["shard"] for r in out.collect())


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (5, None), (6, 0), (8, 1), (99, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels, fold(F.col("doc_id"), 5) != 0, fold(F.col("doc_id"), 5) == 1).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.classify(none, labels, F.lit(True), F.lit(False)).count() == 0
    unlabelled = quality.classify(docs, labels.limit(0), F.lit(True), F.lit(False)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}


def test_mixing(docs, none):
    out = mixing.mix(docs).collect()
    assert len(out) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs.filter("doc_id in (3, 4)")).agg(F.sum("taken")).first()[0] == 0


def test_overlapping_memberships(spark):
    df = spark.createDataFrame([(k, " ".join(["w"] * 10), ["a", "b"] if k % 2 else ["a"]) for k in range(40)], "doc_id long, text string, both array<string>")
    out = mixing.mix(df, memberships="both").collect()
    # 1.5 times 600 words of memberships, but each of the 400 words may be taken twice at most
    assert sum(r["taken"] for r in out) <= 800 and all(r["taken"] <= 20 for r in out)


def test_route_fills_quotas_at_least_cost():
    # the first pattern can serve both sources, the second only the first source
    flow = mixing.route({0: 100, 1: 100}, {0: [0, 1], 1: [0]}, {0: 100, 1: 100})
    assert sum(v for (p, s), v in flow.items() if s == 0) == 100 and sum(v for (p, s), v in flow.items() if s == 1) == 100
    assert sum(v for (p, _), v in flow.items() if p == 1) == 100  # no repetition while a first use is free


def test_flow_of_overlapping_sources():
    made = mixing.plan([(("a", "b"), 100), (("a",), 300), (("b",), 50), (("c", None), 80)])
    got = {s: sum(v for (_, t), v in made.flow.items() if t == s) for s in made.targets}
    # c and the null source share 80 words, twice at most; a and b get what they aim at
    assert all(abs(got[s] - made.targets[s]) < 1e-6 for s in "ab") and got["c"] + got[None] == 160
    assert all(t <= 2 * n + 1e-6 for t, (_, n) in zip(made.taken(), made.patterns)) and made.sizes["a"] == 400


def test_planner_is_quick_with_many_sources():
    import time

    began = time.time()
    made = mixing.plan([((f"s{k:06d}",), 1 + k % 977) for k in range(30_000)])
    assert time.time() - began < 20 and len(made.taken()) == 30_000


def test_a_repeated_id_is_cut_by_texts(spark, monkeypatch):
    df = spark.range(300).selectExpr("cast(null AS long) AS doc_id", "repeat('w ', cast(5 + id % 7 AS int)) || id AS text", "'a' AS source")
    whole = sorted(r["taken"] for r in mixing.mix(df, share=0.5).collect())
    monkeypatch.setattr(mixing, "END_ROWS", 2)
    assert sorted(r["taken"] for r in mixing.mix(df, share=0.5).collect()) == whole and 0 < sum(x > 0 for x in whole) < 300


def test_language(docs, none):
    model = langid.learn(docs)
    out = langid.identify(docs, model).collect()
    by = {(r["doc_id"], r["text"]): r for r in out}
    assert len(out) == len(ROWS) and model.languages == ["de", "en", "fr"]
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in by if k[1] in (None, "", " \t\n\x0b ", "123 456 !"))
    assert by[8, "ÄÖ é\x85x 123 !?"]["lang_pred"] != "und"
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(none)).collect()} == {"und"}


def test_jaccard(docs, none):
    out = jaccard.linked(docs).collect()
    assert len(out) == len(ROWS)
    of = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in out}
    n = next(r["n_shingles"] for r in out if r["doc_id"] == 1)
    assert of[1, n] == of[2, n] == 1 and of[None, n] is None and of[3, 0] == 3 and of[4, 0] == 4 and of[7, 0] == 7
    assert of[5, 1] == of[10, 1] == 5 and of[11, 1] == 11
    assert jaccard.linked(none).count() == 0


def test_lm(docs, none):
    out = lm.score(docs, fold(F.col("doc_id"), 7) == 2).collect()
    assert len(out) == len(ROWS) and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (3, 4, 7)} == {1}
    assert lm.score(none, F.lit(False)).count() == 0
    untrained = lm.score(docs, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in untrained)
    assert all(r["score"] < 0 or r["n_tokens"] == 1 for r in untrained)


def test_tokens(docs, none):
    out = tokens.count_tokens(docs).collect()
    assert len(out) == len(ROWS) and all(sum(r["section_tokens"]) == r["n_tokens"] for r in out)
    assert {(r["n_tokens"], r["n_sections"]) for r in out if r["doc_id"] in (3, 4)} == {(0, 0)}
    assert tokens.count_tokens(none).count() == 0


def test_tokens_of_broken_text(spark):
    broken = spark.createDataFrame([(1, bytearray(b"one \xff\xfe two\nthr\xc3")), (2, bytearray(b"\n\n"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) AS text")
    out = {r["doc_id"]: r for r in tokens.count_tokens(broken).collect()}
    assert out[1]["n_sections"] == 2 and sum(out[1]["section_tokens"]) == out[1]["n_tokens"] > 4 and out[2]["n_sections"] == 2


def test_tokens_of_fields(spark):
    df = spark.createDataFrame([(1, "A title", "The body goes on", None), (2, None, None, None)], "doc_id long, title string, body string, note string")
    out = {r["doc_id"]: r for r in tokens.count_field_tokens(df, ["title", "body", "note"]).collect()}
    encoding, _ = tokens.encoder(tokens.load_vocabulary())
    assert out[1]["n_tokens"] == len(encoding.encode_ordinary("A title\nThe body goes on\n")) == sum(out[1]["field_tokens"].values())
    assert out[1]["field_tokens"]["note"] == 0 and out[1]["field_tokens"]["title"] == len(encoding.encode_ordinary("A title\n"))
    assert out[2]["n_tokens"] == sum(out[2]["field_tokens"].values()) and tokens.count_field_tokens(df.limit(0), ["title"]).count() == 0


def test_repetition(docs, none):
    out = repetition.judge(repetition.coverage(docs)).collect()
    assert len(out) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] < 10)
    assert next(r["n_words"] for r in out if r["doc_id"] == 6) == 60_000
    assert repetition.coverage(none).count() == 0


def test_decontamination(docs, none, spark):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "one two"), (5, PROSE)], "item_id long, text string")
    out = decontam.contamination(docs, items).collect()
    assert len(out) == len(ROWS)
    hit = [r for r in out if r["contaminated"]]
    assert {r["doc_id"] for r in hit} == {1, 2, None, 5, 10} and all(r["n_items"] == 2 for r in hit if r["doc_id"] == 1)
    assert decontam.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination(none, items).count() == 0


def test_shuffled_search_equals_broadcast(docs, spark):
    items = spark.createDataFrame([(1, PROSE), (4, "one two")], "item_id long, text string")
    a, b = (sorted(map(tuple, decontam.phrase_matches(docs, items, broadcast_windows=n).select("doc_id", "item_id", "at", "start").collect()), key=str) for n in (0, 1000))
    assert a == b and a


def test_proximity_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    said = lambda n, kinds: " ".join(f"t{k}" for k in (rng.zipf(1.5, n) % kinds))
    texts = {k: said(int(rng.integers(0, 60)), 40) for k in range(60)} | {99: None}
    tests = {k: said(int(n), 40) for k, n in enumerate((16, 14, 13, 5, 2, 1))} | {7: "", None: texts[3] or "t1"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(tests.items()), "item_id long, text string")
    df = Counter(w for t in texts.values() for w in (t or "").split())
    for n_terms, slack, most in ((3, 2, 1000), (2, 1, 0), (3, 0, 1000)):
        want = set()
        for item, text in tests.items():
            ws = text.split()
            for at in range(max(1, len(ws) - 12) if ws else 0):
                win = ws[at : at + 13]
                if any(not df[w] for w in win):
                    continue
                rare = sorted((df[w], w, k) for k, w in enumerate(win))[:n_terms]
                for doc, t in texts.items():
                    has = lambda p: {q for q, w in enumerate((t or "").split()) if w == p}  # noqa: E731, B023
                    starts = {q - rare[0][2] for q in has(rare[0][1])}
                    want |= {(doc, item, at, s) for s in starts if all(any(abs(q - s - k) <= slack for q in has(w)) for _, w, k in rare[1:])}
        got = decontam.proximity_matches(docs, items, n_terms=n_terms, slack=slack, broadcast_windows=most).select("doc_id", "item_id", "at", "start").collect()
        assert set(map(tuple, got)) == want and len(got) == len(want) and want


def test_null_items_count(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "x"), (None, "d")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, items).collect()}
    digest = hashlib.sha256(b"5").hexdigest()
    assert [(got[k]["n_hit"], got[k]["n_items"], got[k]["items_sha256"]) for k in (1, 2)] == [(4, 2, digest), (4, 2, digest)]


def test_a_frequent_term_is_dealt_in_slices(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('of the ', 20) || 'word' || id AS text")
    items = spark.createDataFrame([(1, "of the of the"), (2, "the word7")], "item_id long, text string")
    cut, _ = decontam.windows(items)
    for small in (True, False):
        index, slices = decontam.store(docs, decontam.term_counts(docs, cut, small), small)
        cells = {(r["term"], r["slice"]): r["count"] for r in index.groupBy("term", "slice").count().collect()}
        assert sum(cells.values()) == 16_001 and max(cells.values()) < 60 and slices.filter("slices > 1").count() == 2
    got = {r["doc_id"]: r["n_hit"] for r in decontam.contamination(docs, items).collect()}
    assert got == {k: 40 + (k == 7) for k in range(400)}


def test_chat(spark):
    rows = [(1, 1, "user", "### User: hi </turn>\n### x"), (1, 2, "assistant", None), (1, None, None, "\\h # <"), (1, 2, "assistant", None), (None, 1, "assistant", ""), (2, 1, "a:b!\nc", "x\n"), (2, 2, "assistant", " </turn>\n \\b"), (3, 1, "assistant", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit("x"))
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("", "\\h # <"), ("user", "### User: hi </turn>\n### x"), ("assistant", ""), ("assistant", "")]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("a:b!\nc", "x\n"), ("assistant", " </turn>\n \\b")]
    assert out[3]["level"] == 0 and out[3]["formatted"] == "### assistant: plain </turn>\n" and out[None]["n_turns"] == 1
    # whole conversations are escaped only where nothing less reads back; very long texts are whole
    long = spark.createDataFrame([(1, 0, "user", "x </turn>\n ### y" * 40_000), (1, 1, "assistant", "z" * 2_000_000)], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(long).first()
    assert [len(t["text"]) for t in r["turns"]] == [16 * 40_000, 2_000_000]
    loss = chat.format_conversations(df).select("conv_id", chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()
    assert {r["conv_id"]: r["l"] for r in loss} == {1: "", 2: " </turn>\n \\b", 3: "plain", None: ""}
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
