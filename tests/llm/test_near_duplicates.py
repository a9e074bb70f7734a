import numpy as np

from tallyward.llm import simhash

from . import brute


def edited(rng, n, edits):
    """A text of mostly distinct words, and a copy with single words changed."""
    w = [f"w{x}" for x in rng.integers(1_000_000, size=n)]
    other = list(w)
    for at in rng.choice(n, edits, replace=False):
        other[at] = f"new{rng.integers(1_000_000)}"
    return " ".join(w), " ".join(other)


def similarity(a, b):
    x, y = brute.shingle_set(a), brute.shingle_set(b)
    return len(x & y) / len(x | y)


def joined(spark, rows):
    return {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_pairs_at_the_threshold_are_met(spark):
    """Nothing at 0.8 or more is lost, whether or not texts have frequent words."""
    rng = np.random.default_rng(21)
    rows = [(i * 2 + k, t) for i in range(120) for k, t in enumerate(edited(rng, int(rng.choice([60, 200, 600])), int(rng.integers(1, 14))))]
    got = joined(spark, rows)
    high = [i for i in range(120) if similarity(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8]
    assert len(high) > 40
    assert [i for i in high if got[2 * i + 1] != 2 * i] == []


def test_pairs_below_the_threshold_stay(spark):
    """Nothing under 0.8 is joined, however close to it."""
    rng = np.random.default_rng(22)
    rows = []
    while len(rows) < 160:
        a, b = edited(rng, 200, int(rng.integers(5, 9)))
        if 0.7 <= similarity(a, b) < 0.8:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = joined(spark, rows)
    assert [i for i, _ in rows if got[i] != i] == []


def test_stage_against_all_pairs(spark, documents):
    """The components of exact similarity over all pairs, of documents and of texts without frequent words."""
    rng = np.random.default_rng(23)
    rows = [(int(d), t) for d, t in zip(documents.doc_id, documents.text)]
    rows += [(10_000 + 2 * i + k, t) for i in range(40) for k, t in enumerate(edited(rng, 200, int(rng.integers(1, 9))))]
    assert joined(spark, rows) == dict(zip([d for d, _ in rows], brute.alike(rows)))


def grown(rng, n, size, edits):
    """Texts of one base, each with its own number of single words changed."""
    base = [f"w{x}" for x in rng.integers(1_000_000, size=size)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.choice(size, int(rng.choice(edits)), replace=False):
            w[at] = f"new{rng.integers(1_000_000)}"
        out.append(" ".join(w))
    return out


def test_alike_but_apart_are_not_all_compared(spark, monkeypatch):
    """Texts of one base at 0.5 to 0.8, with nearer ones among them: the components of all pairs, from far fewer pairs than those."""
    rng = np.random.default_rng(24)
    compared, exact = [], simhash.as_similar
    monkeypatch.setattr(simhash, "as_similar", lambda pairs, *a: compared.append(pairs.count()) or exact(pairs, *a))
    rows = list(enumerate(grown(rng, 250, 150, [4, 5, 6, 7, 8]) + grown(rng, 60, 150, [0, 1, 2, 3, 9, 20]) + grown(rng, 100, 60, [1, 2, 3])))
    for i in range(0, 250, 10):  # copies of edited texts, with an edit more
        w = rows[i][1].split()
        w[int(rng.integers(150))] = f"more{i}"
        rows.append((len(rows), " ".join(w)))
    assert joined(spark, rows) == dict(zip([d for d, _ in rows], brute.alike(rows)))
    assert compared[-1] < 250 * 249 / 2 / 10


def test_apart_pairs_lose_no_link(spark):
    """Groups of one key of every mix of sizes and differences, none joined before: the links that are left join what all pairs do."""
    rng = np.random.default_rng(25)
    rows = []
    for g in range(25):
        n = int(rng.integers(2, 30))
        some = grown(rng, n, int(rng.integers(6, 60)), [0, 1, 1, 2, 3, 5])
        some = [" ".join(t.split()[: int(rng.integers(4, 61))]) if rng.random() < 0.3 else t for t in some]
        rows += [(g, len(rows) + i, t) for i, t in enumerate(dict.fromkeys(some))]
    each = [(g, i, len(brute.shingle_set(t)), i) for g, i, t in rows]
    texts = spark.createDataFrame([(i, t) for _, i, t in rows], "id long, text string")
    pairs = simhash.apart_pairs(spark.createDataFrame(each, "key long, id long, size long, root long"), texts, 5, 0.8)
    roots = {r.node: r.root for r in simhash.components(simhash.as_similar(pairs, texts, 5, 0.8)).collect()}
    for g in range(25):
        own = [(i, t) for k, i, t in rows if k == g]
        assert [roots.get(i, i) for i, _ in own] == brute.alike(own)
