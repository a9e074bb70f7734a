import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyward.llm import exchange, learned_partitions, mixing, ngram_lm, registry, sentencepiece_codec, simhash, substring_dedup

from . import brute

# SimHash


@pytest.mark.parametrize("plan", simhash.PLANS)
def test_covering_meets_every_pair(plan):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 500).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    cover = simhash.Covering(plan)
    at = {}
    for side, fp in (("x", x), ("y", y)):
        row, anchor, home = cover.anchors(fp)
        assert np.bincount(row[home], minlength=500).tolist() == [1] * 500
        at[side] = (set(zip(row.tolist(), anchor.tolist())), dict(zip(row[home].tolist(), anchor[home].tolist())))
    assert all((i, at["x"][1][i]) in at["y"][0] or (i, at["y"][1][i]) in at["x"][0] for i in range(500))


def test_golay_is_perfect():
    code = simhash.Code(*simhash.golay(), 0)
    assert len(code.within) == 2048 and code.within[:, 0].tolist() == [1] * 2048


def test_simhash(spark, sf, documents):
    want = dict(zip(documents.doc_id, brute.components(list(zip(documents.doc_id, documents.text)))))
    for r in simhash.op9_simhash(spark, sf).collect():
        f, c = want[r.doc_id]
        assert (r.fingerprint, r.component_id) == (f"{f:016x}", c)


@pytest.mark.parametrize(("plan", "block", "visitors"), [("middle", 20_000, 20_000), ("fine", 20_000, 20_000), ("coarse", 3, 20_000), ("coarse", 4, 7), ("coarse", 20_000, 5)])
def test_links_join_the_same(spark, plan, block, visitors):
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 2**62, 12)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(15)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, 3, plan, block, visitors)).collect()}
    order = sorted(fps)
    parent = {f: f for f in order}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(order):
        for b in order[:i]:
            if bin(a ^ b).count("1") <= 3:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert {f: got.get(f, f) for f in order} == {f: find(f) for f in order}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_simhash_on_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter((d, f, c) for (d, _), (f, c) in zip(rows, brute.components(rows)))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.classes(odd).collect())
    assert got == want
    assert simhash.classes(empty).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    want = Counter(d for (d, _), c in zip(rows, brute.alike(rows)) if d == c)
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert simhash.representatives(empty).count() == 0


def test_similar_documents_are_found(spark):
    """Copies with a few words changed (five-word similarity of 0.85) are joined; other texts with the same common words aren't."""
    rng = np.random.default_rng(11)
    common = np.array([f"c{i}" for i in range(20)])
    rows = []
    for i in range(40):
        words = [str(rng.choice(common, p=np.arange(20, 0, -1) / 210)) if rng.random() < 0.5 else f"w{rng.integers(5000)}" for _ in range(600)]
        other = list(words)
        for at in range(40, 600, 64):
            other[at] = f"new{rng.integers(5000)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i for i in range(40))
    assert sum(got[2 * i + 1] == 2 * i for i in range(40)) >= 32
    assert all(got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(40))


@pytest.mark.parametrize(("block", "visitors"), [(4000, 4000), (3, 4000), (3, 5), (4000, 5)])
def test_blocks_of_an_anchor_join_the_same(spark, block, visitors):
    rng = np.random.default_rng(12)
    rows = [(i, int(i // 20 * 7919 * 2**33) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False)), *(int(i // 20),) * simhash.LANES) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, fp long, " + ", ".join(f"s{k} long" for k in range(simhash.LANES)))
    got = {r.node: r.root for r in simhash.components(simhash.similar_links(df, 4, 0, "coarse", block, visitors)).collect()}
    parent = list(range(80))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(80):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4 and rows[i][2] == rows[j][2]:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    assert {i: got.get(i, i) for i in range(80)} == {i: find(i) for i in range(80)}


def test_signature_lanes_follow_shingles():
    a = simhash.signatures([b"a b c d e f", b"A B C D E F", b"a b", b"", None, b"f e d c b a"])
    assert (a[0] == a[1]).all() and (a[3] == a[4]).all() and not a[3].any() and a[2].any() and (a[0] != a[5]).any()


# Repeated passages


def check_removal(rows, got):
    for (d, t), gone in zip(rows, brute.removed(rows)):
        kept = b" ".join(w for i, w in enumerate(brute.words(t)) if i not in gone)
        assert (d, len(brute.words(t)), len(gone), brute.sha(kept)) in got


def test_substring_dedup(spark, sf, documents):
    got = {tuple(r) for r in substring_dedup.op5_substring_dedup(spark, sf).collect()}
    assert len(got) == len(documents)
    check_removal(list(zip(documents.doc_id, documents.text)), got)


def test_substring_dedup_in_small_batches(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = substring_dedup.deduplicated(odd, result="digest", batch_bytes=2000, shard_bytes=5000).collect()
    assert len(out) == len(rows)
    check_removal(rows, {tuple(r) for r in out})
    far = substring_dedup.deduplicated(odd, result="digest", batch_bytes=2000, shard_bytes=2000, fanout=2).collect()
    assert Counter(map(tuple, far)) == Counter(map(tuple, out))
    assert substring_dedup.deduplicated(empty).count() == 0


def test_cleaned_texts_and_spans(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    want = Counter((d, brute.without(t, g)) for (d, t), g in zip(rows, brute.removed(rows)))
    out = substring_dedup.deduplicated(odd.where("doc_id is not null"), batch_bytes=5000).collect()
    assert Counter((r.doc_id, r.text) for r in out) == want
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in out)
    kept = substring_dedup.without_repeats(odd)
    assert kept.columns == odd.columns
    assert all(r.n_chars == len(r.text) for r in kept.collect())


# n-grams


def lm_rows(rows, order):
    """Counts, base scores and exact scores (without quantised probabilities), by dictionaries of n-grams."""
    tokens = [[w.lower() for w in brute.words(t)] + [None] for _, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 10 == 0 for d, _ in rows]
    counts, after = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    gram = lambda seq, n, k: tuple(seq[j] if j >= 0 else "start" for j in range(k - n, k + 1))
    for seq, h in zip(tokens, held):
        for i in range(len(seq) if not h else 0):
            for n in range(order):
                counts[n][gram(seq, n, i)] += 1
                after[n][gram(seq, n, i)[:-1]] += 1
    size, kinds = sum(counts[0].values()), len(counts[0])
    power = math.log(kinds) / math.log(size) if kinds > 1 else 0.5
    for (d, _), seq, h in zip(rows, tokens, held):
        base = high = 0.0
        for i in range(len(seq)):
            p = (counts[0][(seq[i],)] + 0.1) / (size + 0.1 * (kinds + 1))
            base += math.log10(p)
            for n in range(1, order):
                c = after[n][gram(seq, n, i)[:-1]]
                p = (counts[n][gram(seq, n, i)] + c**power * p) / (c + c**power) if c else p
            high += math.log10(p)
        yield d, h, len(seq), sum(counts[0][(w,)] > 0 for w in seq), size, base, high


def check_scores(got, want, order):
    """A stored probability is within half a step of its exact value, and so is the one below that it was made from."""
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
        assert abs(a[6] - b[6]) <= a[2] * (order - 1) * math.log10(2) / ngram_lm.STEPS / 2 + 1e-9


@pytest.mark.parametrize(("order", "fanout"), [(2, 1024), (3, 1024), (3, 2)])
def test_scores(spark, documents, order, fanout):
    rows = list(zip(documents.doc_id.tolist()[:120], documents.text[:120]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    got = ngram_lm.scored(df, order, batch_bytes=40_000, shard_bytes=100_000, fanout=fanout).collect()
    check_scores(got, lm_rows(rows, order), order)


def test_scores_of_odd_rows(spark, odd, empty, folder):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_scores(ngram_lm.op1_ngram_lm(spark, folder(documents=odd)).collect(), lm_rows(rows, 3), 3)
    assert ngram_lm.scored(empty.withColumn("held_out", F.lit(True))).count() == 0
    only = ngram_lm.scored(odd.withColumn("held_out", F.lit(True))).collect()
    assert len(only) == len(rows) and {(r.n_known, r.train_tokens, r.score) for r in only} == {(0, 0, 0.0)}


def test_probabilities_of_a_context_add_up(documents):
    """What a trie and its back-off say of all words after a context, the unknown one included."""
    words = [w.lower() for t in documents.text[:60] for w in t.split()]
    one, two = Counter(words), Counter(zip(words, words[1:]))
    corpus = ngram_lm.Corpus(len(one), len(words), 60)
    lower = {w: float(corpus.unigram(np.array([c]))[0]) for w, c in [*one.items(), ("unknown", 0)]}
    assert sum(lower.values()) == pytest.approx(1)
    for context in [w for w, _ in one.most_common(5)] + [w for w, c in one.items() if c == 1][:5]:
        after = {w: c for (v, w), c in two.items() if v == context}
        n = np.array([sum(after.values())])
        stored = {w: float(ngram_lm.restored(ngram_lm.quantised(corpus.smoothed(np.array([c]), n, ngram_lm.restored(ngram_lm.quantised(np.array([lower[w]]))))))[0]) for w, c in after.items()}
        total = sum(stored.get(w, float(corpus.backoff(n)[0]) * p) for w, p in lower.items())
        assert 2 ** (-1.0 / ngram_lm.STEPS) <= total <= 2 ** (1.0 / ngram_lm.STEPS)


def test_small_and_large_probabilities_are_kept():
    p = 10.0 ** -np.arange(0, 300, 7)
    assert (abs(np.log2(ngram_lm.restored(ngram_lm.quantised(p)) / p)) <= 0.5 / ngram_lm.STEPS + 1e-9).all()


def test_tries_find_what_they_hold():
    rng = np.random.default_rng(3)
    for bits in (46, 64):
        key = np.unique(rng.integers(0, 2**62, 3000).astype(np.uint64) * np.uint64(4) >> np.uint64(64 - bits))
        codes = rng.integers(1, 900, len(key)).astype(np.uint16)
        half = rng.random(len(key)) < 0.5
        found = ngram_lm.Trie.of(key[half], codes[half], bits - ngram_lm.CONTEXT_BITS).find(key)
        assert (found == np.where(half, codes, 0)).all()


def test_held_out_texts_score_above_the_base(spark):
    got = ngram_lm.op1_ngram_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_elias_fano():
    rng = np.random.default_rng(7)
    for n, top in ((0, 1), (1, 9), (700, 2**40), (700, 300)):
        x = np.sort(rng.integers(0, top, n).astype(np.uint64))
        e = ngram_lm.EliasFano.of(x)
        assert (e[np.arange(n)] == x).all()
        q = rng.integers(0, top, 300).astype(np.uint64)
        place, equal = e.successor(q, np.zeros(300, np.int64), np.full(300, n))
        assert (place == np.searchsorted(x, q)).all() and (equal == np.isin(q, x)).all()
        assert (e.low.nbytes + e.high.nbytes) * 8 <= n * (3 + max(0, math.log2(top / max(n, 1)))) + 400


# Nearest neighbours


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_search_recall(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute.nearest(vectors)
    got = found(learned_partitions.op4_learned_partitions(spark, sf))
    assert set(got) == {i for i in vectors if i % 50 == 0}
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in got]
    assert sum(hits) / (5 * len(hits)) >= 0.9


def test_search_over_all_partitions_is_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (900, 8)).round(2)
    x[100:160] = x[100]  # ties
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    want = brute.nearest({r.vec_id: list(r.embedding) for r in df.collect()})
    got = found(learned_partitions.search(df, df.where("vec_id % 50 = 0"), parts=4, probes=4))
    for q, hits in got.items():
        assert [v for v, _ in hits] == [v for v, _ in want[q]]
        assert [s for _, s in hits] == pytest.approx([s for _, s in want[q]])


def test_search_in_blocks_is_exact(spark):
    """However members and queries are cut, every query meets every member of the partitions that it probes."""
    x = np.random.default_rng(18).normal(0, 1, (700, 6))
    df = spark.createDataFrame([(i, v.tolist(), i, i, 0.5) for i, v in enumerate(x)], "vec_id long, embedding array<float>, part int, rank int, score double")
    want = brute.nearest({r.vec_id: list(r.embedding) for r in df.collect()})
    for members, asking in ((60, 9), (5000, 10), (70, 5000)):
        got = found(learned_partitions.search(df, df.where("vec_id % 9 = 0"), parts=3, probes=3, members=members, asking=asking))
        assert len(got) == 78 and all([v for v, _ in hits] == [v for v, _ in want[q]] for q, hits in got.items())


def test_probes_hold_the_recall(spark):
    """The number of probes is measured: few in clustered vectors, and the recall is there."""
    rng = np.random.default_rng(19)
    centre = rng.normal(0, 1, (40, 16))
    x = centre[rng.integers(0, 40, 3000)] + rng.normal(0, 0.2, (3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute.nearest({r.vec_id: list(r.embedding) for r in df.collect()})
    got = found(learned_partitions.search(df, df.where("vec_id % 20 = 0")))
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in got]
    assert len(got) == 150 and sum(hits) / (5 * len(hits)) >= 0.9
    unit = learned_partitions.unit(x)
    router = learned_partitions.fit(unit[600:], 27)
    assert learned_partitions.probes_for(unit, router, 5, 0.95, np.arange(600)) <= 9


def test_search_of_huge_tiny_and_repeated_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [2e-300, 1e-300]), (2, [1.0, -1.0]), (2, [1.0, -1.0]), (3, [1e308, 0.0]), (50, [1e-308, 0.0]), (50, [1e-308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(learned_partitions.search(df, df.where("vec_id % 50 = 0")))
    assert [v for v, _ in got[50]] == [3, 1, 0, 2, 2] and [s for _, s in got[50]] == pytest.approx([1, 2 / 5**0.5, 0.5**0.5, 0.5**0.5, 0.5**0.5])
    assert [v for v, _ in got[0]] == [1, 3, 50, 50, 2]


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (100, [0.0, 2.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(learned_partitions.search(df, df.where("vec_id % 50 = 0")))
    assert {q: [v for v, _ in hits] for q, hits in got.items()} == {0: [1, 100], 100: [1, 0]}
    assert learned_partitions.search(df.limit(0), df.limit(0)).count() == 0


def test_partitions_are_balanced():
    x = np.random.default_rng(9).normal(0, 1, (600, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = learned_partitions.neighbours(x, 5)
    where = learned_partitions.balanced_cut(x, near, 6)
    assert np.bincount(where, minlength=6).max() <= math.ceil(600 / 6 * 1.15)
    assert (where[near] == where[:, None]).mean() > 0.3


# Mixing


def mix_brute(rows, share=1.5, most=2.0):
    """Targets by resharing the excess round by round; rows: (doc_id, source, text)."""
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if per * weight[s] > most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else per * weight[s]
        left -= sum(target[s] for s in (over or free))
        free -= over or free
    return sizes, target


def check_mix(rows, got):
    sizes, target = mix_brute(rows)
    source = {d: s for d, s, _ in rows}
    words = {d: len(brute.words(t)) for d, _, t in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size
        assert (r.position is not None) == (r.taken > 0) and (r.position is None or 0 <= r.position <= 1)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_mixing(spark, sf, documents):
    got = mixing.op2_mixing(spark, sf)
    check_mix(list(zip(documents.doc_id, documents.source, documents.text)), got.collect())
    assert sorted(got.collect()) == sorted(mixing.op2_mixing(spark, sf).collect())
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_mixing_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.sql(registry.oracle_sql()["op2_mixing"])
    got = mixing.op2_mixing(spark, sf)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(str, map(tuple, got.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_mixing_odd_rows(spark, odd, empty, folder):
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_mix([(r.doc_id, r.source, r.text) for r in unique.collect()], mixing.op2_mixing(spark, folder(documents=unique)).collect())
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert all(n <= 4 for n in Counter(r.doc_id for r in mixed.collect()).values())
    assert mixing.mixed(empty).count() == 0


def test_mixing_all_rows(spark, odd, folder):
    assert mixing.op2_mixing(spark, folder(documents=odd)).count() == odd.count()


def test_no_words_no_targets(spark, folder):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(r.target, r.taken, r.position) for r in mixing.op2_mixing(spark, folder(documents=df)).collect()} == {(0.0, 0, None)}


def test_schedules_are_inverted(spark):
    for knots in mixing.SCHEDULES:
        area = mixing.integrals(knots)[-1]
        t = spark.range(101).select(F.expr(mixing.inverse(knots, f"(id / 100.0D * {area!r}D)")).alias("t")).collect()
        for i, r in enumerate(t):
            done = sum((min(r.t, b) - a) * (2 * u + (v - u) / (b - a) * (min(r.t, b) - a)) / 2 for (a, u), (b, v) in zip(knots, knots[1:]) if r.t > a)
            assert done == pytest.approx(i / 100 * area, abs=1e-9)


# The pipeline


def test_pipeline_stages(spark, sf, documents):
    """Each stage against a plain version, on the rows that the one before it kept."""
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "simhash_near_dedup" and 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    keep = stages[0](spark, docs, sf).cache()
    before = set(rows(docs))
    for r in rows(keep):
        n, _, _, _, again = brute.statistics(r[1])
        assert r in before and n >= 50 and again <= n / 2
    one = stages[1](spark, keep, sf).cache()
    pairs = [(r[0], r[1]) for r in rows(keep)]
    assert sorted(r[0] for r in rows(one)) == sorted(d for (d, _), c in zip(pairs, brute.alike(pairs)) if d == c)
    clean = stages[2](spark, one, sf).cache()
    pairs = [(r[0], r[1]) for r in rows(one)]
    want = {d: brute.without(t, g) for (d, t), g in zip(pairs, brute.removed(pairs)) if len(g) < len(brute.words(t))}
    assert {r[0]: r[1] for r in rows(clean)} == want and all(r[4] == len(r[1]) for r in rows(clean))
    mix = stages[3](spark, clean, sf).cache()
    sizes, target = mix_brute([(r[0], r[3], r[1]) for r in rows(clean)])
    longest, taken, count = Counter(), Counter(), Counter()
    for r in rows(clean):
        longest[r[3]] = max(longest[r[3]], len(brute.words(r[1])))
    for r in rows(mix):
        taken[r[3]] += len(brute.words(r[1]))
        count[r[0]] += 1
        assert want[r[0]] == r[1]
    assert max(count.values()) <= 2 and all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in sizes)
    more = docs.withColumns({"row": F.lit(1), "size": F.lit("s"), "key": F.lit(2.5)})  # columns that operators have too
    assert all(f(spark, more.limit(40), sf).columns == more.columns for f in stages[:4])
    for r in stages[4](spark, mix, sf).collect():
        assert r.ids == library.encode(want[r.doc_id]) and r.decoded_sha256 == brute.sha(library.decode(r.ids))


def test_pipeline_on_odd_rows(spark, odd, empty, folder):
    assert corpus_pipeline.run(spark, folder(documents=odd)).columns == ["doc_id", "lang", "source", "ids", "ends", "decoded_sha256"]


def test_pipeline_on_nothing(spark, empty, folder):
    assert corpus_pipeline.run(spark, folder(documents=empty)).count() == 0
