import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyward.llm import base, language_id, quality_classifier, quality_rules, sentencepiece_codec, textcore, token_counts

from . import brute
from .conftest import odd_texts

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_words_and_statistics(documents):
    texts = odd_texts() + list(documents.text[:40])
    got = textcore.doc_stats([None if t is None else t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert tuple(row[:5]) == brute.statistics(t)


@given(st.lists(st.text(alphabet="ab \n\té", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_statistics_of_any_batch(texts):
    got = textcore.doc_stats([t.encode() for t in texts])
    assert [tuple(r[:5]) for r in got] == [brute.statistics(t) for t in texts]


# Quality rules


def test_quality_rules(spark, sf, documents):
    got = {r.doc_id: r for r in quality_rules.op3_quality_rules(spark, sf).collect()}
    for d, t in zip(documents.doc_id, documents.text):
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.statistics(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        if not r.base_failed:
            assert r.kept == (r.distance**2 <= quality_rules.chi2_quantile(1 - 1e-5, quality_rules.P))


def test_quality_rules_tell_junk(spark, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.op3_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r.quality: r.k for r in got.collect()}
    assert share[0] < 0.05 and share[1] > 0.93


def test_chi2():
    assert quality_rules.chi2_quantile(0.975, 8) == pytest.approx(17.5345, abs=1e-3)


def test_quality_rules_on_odd_rows(odd, empty):
    rows = quality_rules.verdicts(odd).collect()
    assert len(rows) == odd.count()
    assert quality_rules.verdicts(empty).count() == 0
    kept = quality_rules.accepted(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert quality_rules.accepted(empty).count() == 0


# Classifiers


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op6_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())


def test_trees_follow_a_rule():
    x = np.random.default_rng(3).random((2000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert ((quality_classifier.fit(x, y, trees=40).scores(x) > 0.5) == y).mean() > 0.97
    assert quality_classifier.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
    assert (quality_classifier.fit(x, np.ones(2000)).scores(x) > 0.99).all()


def test_weights_are_repeats():
    x = np.random.default_rng(5).random((200, 3)).round(1)
    y, w = (x[:, 0] > 0.4).astype(float), np.random.default_rng(6).integers(1, 4, 200)
    one, two = quality_classifier.fit(x, y, trees=5, weight=w.astype(float)), quality_classifier.fit(np.repeat(x, w, 0), np.repeat(y, w), trees=5)
    assert one.start == pytest.approx(two.start)


def test_sample_is_bounded_and_copies_weigh(spark):
    """What is ranked is a share by hash, whatever the number of rows; copies of a row are one of them."""
    rows = [(i, *np.random.default_rng(i).random(len(quality_classifier.FEATURES)).tolist()) for i in range(400)] + [(1000, *[0.5] * len(quality_classifier.FEATURES))] * 300
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{f} double" for f in quality_classifier.FEATURES))
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000, 1)] * 2, "doc_id long, quality int")
    seen = {}
    real = quality_classifier.fit
    try:
        quality_classifier.fit = lambda x, y, weight: seen.update(rows=len(x), weight=weight) or real(x, y, trees=1, weight=weight)
        quality_classifier.learned(df, labels, "quality", 1000)
        assert seen["rows"] == 401 and seen["weight"].max() == 600
        quality_classifier.learned(df, labels, "quality", 50)
        assert seen["rows"] == 50
    finally:
        quality_classifier.fit = real


def test_flat_traversal_is_the_walk():
    x = np.random.default_rng(4).random((300, 3))
    model = quality_classifier.fit(x, (x[:, 0] > x[:, 1]).astype(float), trees=5, depth=3)
    for row in x[:20]:
        total = model.start
        for f, limit, value in zip(model.feature, model.limit, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > limit[node])
            total += value[node - len(f)]
        assert total == pytest.approx(model.margins(row[None])[0])


def test_classifiers_on_odd_rows(spark, odd, empty, folder):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = folder(documents=odd, labels=labels)
    assert quality_classifier.op6_quality_classifier(spark, d).count() == odd.count()
    rows = language_id.op10_language_id(spark, d).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in (r for r in rows if r.doc_id is not None):
        if texts[r.doc_id] is None or not any(c.isalpha() for c in texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in ("en", "fr")


def test_classifiers_on_empty_tables(spark, empty, folder):
    d = folder(documents=empty, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality_classifier.op6_quality_classifier(spark, d).count() == 0
    assert language_id.op10_language_id(spark, d).count() == 0


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = language_id.op10_language_id(spark, sf).join(langs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_without_labels(spark, odd, folder):
    rows = language_id.op10_language_id(spark, folder(documents=odd.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in rows} == {"und"}


# Tokenizers


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())


def test_encoding_is_the_library_s(library, documents):
    c = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    for t in [t for t in odd_texts() if t is not None and len(t) < 50_000] + list(documents.text[:60]):
        ids, spans = c.encode(t)
        assert ids == library.encode(t)
        assert c.decode(ids) == library.decode(ids)
        ends = [0, *[b for _, b in spans]]
        assert [a for a, _ in spans] == ends[:-1] and (not t or ends[-1] == len(t.encode()))


@given(st.text(alphabet=st.sampled_from("ab \n\t▁é語<0x>s\U0001f600'"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_encoding_of_any_text(library, text):
    c = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    ids, _ = c.encode(text)
    assert ids == library.encode(text) and c.decode(ids) == library.decode(ids)


def test_op7(spark, odd, library, folder):
    for r in sentencepiece_codec.op7_sentencepiece(spark, folder(documents=odd.where("doc_id is not null"))).join(odd, "doc_id").collect():
        ids = library.encode(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == brute.sha(",".join(map(str, ids)))
        assert r.decoded_sha256 == brute.sha(library.decode(ids))


def test_encoded_lists(odd, empty, library):
    path = sentencepiece_codec.model_path()
    for r in sentencepiece_codec.encoded(odd, path, ("doc_id", "text")).collect():
        assert r.ids == library.encode(r.text or "") and len(r.ends) == len(r.ids)
    assert sentencepiece_codec.encoded(empty, path).count() == 0


def test_compiled_character_map():
    """A map of a -> 'bc' and ab -> '' in a double array made by hand: the longest key wins, places follow."""
    units = [0] * 1024

    def put(node, label=0, base=0, leaf=False):
        units[node] = label | (base << 10) | (256 if leaf else 0)

    root, a, ab = 1, 600, 700
    put(0, base=root)
    put(root ^ 97, label=97, base=(root ^ 97) ^ a, leaf=True)
    units[a] = (1 << 31) | 1  # value 1: text at 1
    put(a ^ 98, label=98, base=(a ^ 98) ^ ab, leaf=True)
    units[ab] = (1 << 31) | 0  # value 0: the empty text
    trie = np.array(units, "<u4").tobytes()
    m = sentencepiece_codec.CharMap(len(trie).to_bytes(4, "little") + trie + b"\0bc\0")
    assert m.longest(b"ab", 0) == (2, b"") and m.longest(b"ac", 0) == (1, b"bc") and m.longest(b"x", 0) is None
    c = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    c.map, c.prefix = m, False
    norm, align = c.normalise("xaab y")
    assert norm == b"xbc y" and align.tolist() == [0, 1, 1, 4, 5, 6]
    c.squeeze, c.prefix = True, True
    norm, align = c.normalise("  x  y ")
    assert norm == b" x y" and align.tolist() == [2, 2, 3, 5, 6]


@pytest.fixture(scope="module")
def counting():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(spark, odd, empty, counting, folder):
    _, tok = counting
    rows = token_counts.op8_token_counts(spark, folder(documents=odd.where("doc_id is not null"))).join(odd, "doc_id").collect()
    for r in rows:
        t = r.text or ""
        assert r.n_tokens == len(tok.encode(t, add_special_tokens=False).ids)
        assert r.n_bytes == len(t.encode()) and r.over_limit == (r.n_tokens > 2048)
    assert token_counts.counted(empty, counting[0]).count() == 0


TOKENIZERS = ("word_bpe_49k.json", "byte_bpe_50k.json")  # of the second, a unit's tokens depend on the space before it


def long_texts(documents):
    rng = np.random.default_rng(8)
    mixed = "".join(rng.choice(list("ab  \n\t'sé语12.!\u0301<|>"), 4000))
    return [t for t in odd_texts() if t and len(t) < 50_000] + list(documents.text[:30]) + [
        "x" * 3000, "y" * 700 + " " + "z" * 900, " " * 2000 + "a", "a" + " " * 2000, "a" + "\n \t" * 900 + "b", "语" * 2000, "e\u0301" * 1500, "<|endoftext|>" * 300, "it's don't we'll " * 200, mixed,
    ]


@pytest.mark.parametrize("file", TOKENIZERS)
@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (300, 16), (1000, 100)])
def test_chunks_are_spliced(file, chunk, overlap, documents):
    c = token_counts.Counter(public_tokenizers.path(file), chunk, overlap)
    for t in long_texts(documents):
        assert c.counts([t.encode()]) == [len(c.tokenizer.encode(t, add_special_tokens=False).ids)]


@pytest.mark.parametrize("file", TOKENIZERS)
@given(st.text(alphabet=st.sampled_from("ab  \n'sé语1.\u0301<|>"), min_size=60, max_size=300))
@settings(max_examples=60, deadline=None)
def test_chunks_of_any_text(file, text):
    c = token_counts.counter(public_tokenizers.path(file), 50, 12)
    assert c.counts([text.encode()]) == [len(c.tokenizer.encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize("file", TOKENIZERS)
def test_units_and_whole_texts_agree(file, documents):
    """What is remembered of units is what the library gives whole texts, also when there is no room to remember."""
    texts = [t.encode() for t in [*odd_texts()[1:], *documents.text[:60]] if len(t) < 60_000] + [None, b"\xff a\xfe", b"x" * 900 + b" y"]
    for memory in (64 << 20, 2000, 0):
        c = token_counts.Counter(public_tokenizers.path(file), memory=memory)
        assert c.apart == (file == TOKENIZERS[0])
        want = [len(c.tokenizer.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids) for t in texts]
        assert c.counts(texts) == want and c.counts(texts[::-1]) == want[::-1]
        assert c.held <= memory


@given(st.text(alphabet=st.sampled_from("ab  \n\t'sé语1.\u0301\u3000\x85\x1cΣİ<|>"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_units_of_any_text(text):
    c = token_counts.counter(public_tokenizers.path(TOKENIZERS[0]))
    assert c.counts([text.encode()]) == [len(c.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_only_tokenizers_that_drop_space_have_units():
    import json

    from tokenizers import Tokenizer

    good = json.loads(Tokenizer.from_file(public_tokenizers.path(TOKENIZERS[0])).to_str())
    assert token_counts.drops_space(good)
    for change in ({"normalizer": {"type": "Strip"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"added_tokens": [good["added_tokens"][0] | {"lstrip": True}]}):
        assert not token_counts.drops_space(good | change)


def test_long_texts_are_not_encoded_whole(documents):
    """Chunks stay of their size where words let them be spliced."""
    c = token_counts.Counter(public_tokenizers.path(TOKENIZERS[1]), 1000, 100)
    text, seen = " ".join(documents.text[:40]), []
    inner = c.tokenizer

    class Watched:
        def encode(self, part, **kw):
            seen.append(len(part))
            return inner.encode(part, **kw)

    c.tokenizer = Watched()
    assert c.huge(text) == len(inner.encode(text, add_special_tokens=False).ids)
    assert max(seen) <= 1000 and sum(seen) < 1.5 * len(text)


def test_without_words_the_text_is_one_piece():
    """A tokenizer that joins across spaces proves no boundary, and is right all the same."""
    from tokenizers import Tokenizer, models

    model = models.BPE({"a": 0, " ": 1, "a ": 2, "a a ": 3}, [("a", " "), ("a ", "a ")])
    c = token_counts.Counter(public_tokenizers.path(TOKENIZERS[0]), 64, 8)
    c.tokenizer = Tokenizer(model)
    text = "a " * 301
    assert c.counts([text.encode()]) == [len(c.tokenizer.encode(text).ids)]


def test_shared_folder_is_the_session_s(spark):
    assert base.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(base.shared_dir(spark).removeprefix("file://"))
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")


def test_intermediate_tables_can_be_cleared(spark):
    base.written(spark.range(3), "gone")
    path = base._written[-1].removeprefix("file://")
    assert os.path.isdir(path)
    base.clear(spark)
    assert not os.path.exists(path) and not base._written


def test_slices_hold_whole_texts_by_bytes():
    import pyarrow as pa

    texts = pa.array([b"ab", None, b"", b"x" * 50, b"abc", b"abcd", b"abcde"], pa.binary())
    assert list(base.runs(texts, 8)) == [(0, 3), (3, 4), (4, 6), (6, 7)]
    assert list(base.runs(texts, 1000)) == [(0, 7)]
    assert list(base.runs(texts[:0], 8)) == []


def test_hashes_of_parts_are_those_of_the_whole():
    from tallyward.llm.textcore import run_hash

    buf = np.random.default_rng(3).integers(33, 255, 5000, dtype=np.uint8)
    for start in ([0], [0, 1, 40, 41, 900, 4999], list(range(0, 5000, 7))):
        start = np.array(start)
        whole = run_hash(buf, start, 10_000)
        for most in (1, 64, 1000):
            assert (run_hash(buf, start, most) == whole).all()
    assert len(run_hash(buf[:0], np.zeros(0, np.int64))) == 0


def test_arrow_batches_stay_modest(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, then in (("64m", str(8 << 20)), ("1m", "1m")):
            spark.conf.set(key, given)
            base.modest_batches(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)
