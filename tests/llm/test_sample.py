"""The sample that language ID learns from."""

from gaitline.llm import langid


def test_a_language_of_few_texts_copied_often_is_learned(spark):
    few = spark.createDataFrame([(lang, f"{word} {k}") for lang, word in (("aa", "alpha"), ("bb", "beta")) for k in range(2)], "lang string, text string")
    many = few.crossJoin(spark.range(2000)).select("lang", "text")
    model = langid.learn(many, train_docs=3)
    # with no text of its own a language has the pooled distribution only
    assert model.languages == ["aa", "bb"]
    score = model.log_scores(["alpha", "beta"])
    assert score[0, 0] > score[0, 1] and score[1, 1] > score[1, 0]


def test_the_sample_is_exact_and_copies_weigh_as_one(spark):
    rows = [("aa", f"alpha w{k}") for k in range(500)] + [("aa", "copy copy")] * 3000 + [("bb", "beta")] * 7
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    a, b = langid.learn(docs, train_docs=40), langid.learn(docs.repartition(3), train_docs=40)
    assert (a.p == b.p).all()
    alone = langid.learn(docs.distinct(), train_docs=40)
    assert abs(alone.p - a.p).max() < 1e-3
    few = langid.learn(docs, train_docs=40, max_words=1)
    assert few.languages == ["aa", "bb"] and (few.p != a.p).any()
