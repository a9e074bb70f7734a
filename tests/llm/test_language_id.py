import numpy as np
from pyspark.sql import functions as F

from tallyward.llm import language_id


def model(documents, cut=None):
    texts = [t.encode() for t in documents.text[:200]]
    return language_id.fit(texts, list(documents.lang[:200].fillna("en")), epochs=2), [t.encode()[:cut].decode("utf-8", "ignore").encode() for t in documents.text]


def test_a_text_alone_and_in_any_batch(documents):
    """A prediction is a function of its text: the same bits alone, in any order and beside any others."""
    m, texts = model(documents, 14)
    texts += [b"", b" ", b"a", b"\n\n", "é".encode(), b"x" * 9]
    p = m.probabilities(texts)
    assert (p[::-1] == m.probabilities(texts[::-1])).all()
    assert (p == np.vstack([m.probabilities([t]) for t in texts])).all()
    order = np.random.default_rng(3).permutation(len(texts))
    assert (p[order] == m.probabilities([texts[i] for i in order])).all()


def test_long_texts_alone_and_in_a_batch(documents):
    m, texts = model(documents)
    texts = texts[:60] + [b" ".join(texts)]
    assert (m.probabilities(texts) == np.vstack([m.probabilities([t]) for t in texts])).all()


def test_fit_and_prediction_see_the_same(documents):
    """The features of a text alone are those of the same text in a batch."""
    texts = [t.encode()[:50] for t in documents.text[:20]]
    w = language_id.edged(texts)
    for k in language_id.ORDERS:
        at = language_id.ngrams(w.buf, k, w.at)
        for i, t in enumerate(texts):
            one = language_id.edged([t])
            assert (at[w.at[i] : w.at[i + 1]] == language_id.ngrams(one.buf, k, one.at)).all()


def test_predictions_in_either_order(spark, documents):
    rows = [(int(d), t[:14], x) for d, t, x in zip(documents.doc_id, documents.text, documents.lang)]
    m, _ = model(documents)
    get = lambda rows: {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), m).collect()}
    assert get(rows) == get(rows[::-1])


def test_windows_are_whole_words():
    text = b" ".join(b"w%d" % i for i in range(1000))
    words = set(text.split())
    for turn in (0, 1, 7, 12345, 10**9):
        got = language_id.window(text, turn, 100)
        assert 0 < len(got) <= 100 and set(got.split()) <= words
    assert language_id.window(b"x" * 500, 3, 100) == b"x" * 100
    assert language_id.window(text, 5, 10**6) == text
    "é".encode() in language_id.window("é".encode() * 500, 3, 101)
    language_id.window("é".encode() * 500, 3, 101).decode()


def test_long_texts_null_and_repeated_ids_are_learnt_from(spark):
    """A language with long texts only, one without ids and one whose rows share an id are all known; a flood of copies is bounded."""
    rng = np.random.default_rng(4)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, make("abcdef", 9000), "aa") for i in range(8)] + [(None, make("ghijkl", 60), "bb") for _ in range(30)] + [(77, make("mnopqr", 60), "cc") for _ in range(30)]
    rows += [(77, "stu vwx " * 20, "dd")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = language_id.sample(docs, 100, 20_000)
    assert {x: langs.count(x) for x in "aa bb cc dd".split()} == {"aa": 8, "bb": 25, "cc": 25, "dd": 25}
    assert max(map(len, texts)) <= 20_000
    m = language_id.fit(texts, langs)
    got = language_id.predict(docs.withColumn("truth", F.col("lang")), m, ("truth",)).groupBy("truth").agg(F.avg((F.col("truth") == F.col("lang_pred")).cast("int")).alias("a"))
    assert all(r.a > 0.95 for r in got.collect())
