from collections import Counter

import numpy as np
import pytest

from tallyward.llm import base, exchange


class Sums(exchange.Rule):
    """How often a key is known in all, whether any asker marked it, and the least id; keys of two kinds may share their bits."""

    fields, same = {"n": exchange.COUNT, "marked": exchange.FLAG, "least": exchange.ID, "kind": exchange.COUNT}, ("kind",)
    gives = {"n": exchange.COUNT, "marked": exchange.FLAG, "less": exchange.FLAG}

    def combine(self, group, n, own):
        least, kind = np.full(n, 1 << 60), np.zeros(n, np.int64)
        np.minimum.at(least, group, own["least"])
        kind[group] = own["kind"]
        return {"n": np.bincount(group, own["n"], n).astype(np.int64), "marked": np.bincount(group, own["marked"], n) > 0, "least": least, "kind": kind}

    def answer(self, key, held):
        return {"n": held["n"], "marked": held["marked"], "less": np.zeros(len(key), bool)}

    def give(self, got, own, held):
        return got | {"less": got["less"] | (held["least"] < own["least"])}

    def totals(self, key, held):
        return np.array([len(key), held["n"].sum()])


def keys(t):
    """Keys of a packed table: the numbers in its texts."""
    x = [int(v) for s in t.column("text").to_pylist() for v in s.split()]
    c = Counter((v * 0x9E3779B97F4A7C15 % 2**64, v % 2) for v in x for v in (v, v + 1_000_000 - v % 2))
    pairs = sorted(c)
    key, kind = np.array([k for k, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)
    return key, {"n": np.array([c[p] for p in pairs]), "marked": kind > 0, "least": np.full(len(pairs), min(t.column("doc_id").to_pylist())), "kind": kind}


def run(spark, texts, fanout, shards):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(3)
    batches = exchange.packed(docs, ("doc_id",), 60)
    out = exchange.exchanged(batches, keys, Sums(), shards, "sums", fanout=fanout)
    blocks = {r.batch: exchange.opened(r.block) for r in batches.rows.collect()}
    got = {}
    for r in out.where("batch >= 0").collect():
        got.setdefault(r.batch, {})[r.shard] = bytes(r.block)
    return batches, out, blocks, got


@pytest.mark.parametrize(("fanout", "shards"), [(1024, 7), (3, 7), (2, 30), (2, 1)])
def test_every_key_gets_its_answer(spark, fanout, shards):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 150, 12))) for _ in range(60)]
    batches, out, blocks, got = run(spark, texts, fanout, shards)
    fan = exchange.fans(shards, fanout)[0]
    total, least, kinds = Counter(), {}, set()
    for t in blocks.values():
        key, own = keys(t)
        for k, n, kind, d in zip(key.tolist(), own["n"], own["kind"], own["least"]):
            total[k, kind] += n
            least[k, kind] = min(least.get((k, kind), 1 << 60), d)
    for b, t in blocks.items():
        key, own = keys(t)
        told = exchange.collected(key, got[b], Sums(), fan)
        for i, k in enumerate(zip(key.tolist(), own["kind"].tolist())):
            assert told["n"][i] == total[k] and told["marked"][i] == (k[1] > 0) and told["less"][i] == (least[k] < own["least"][i])
    assert exchange.totals(out, 2) == [len(total), sum(total.values())]


def test_blocks_grow_with_the_input(spark):
    """Twice the documents and twice the shards make twice the blocks, not four times."""
    rng = np.random.default_rng(6)
    count = {}
    for n in (40, 80, 160):
        before = len(base._written)
        batches, out, _, _ = run(spark, [" ".join(map(str, rng.integers(0, 10**6, 12))) for _ in range(n)], 4, n // 4)
        hops = [spark.read.parquet(p).count() for p in base._written[before + 1 :]]  # of all hops: relayed and answered blocks
        assert max(hops) <= 4 * 3 * batches.count + 400
        count[n] = sum(hops) / len(hops)
    assert count[160] < 5.2 * count[40]


def test_fans():
    for shards in (1, 2, 1000, 1024, 1025, 10**6, 3 * 10**7):
        f = exchange.fans(shards)
        assert np.prod(f) >= shards and max(f) <= exchange.FANOUT and (len(f) == 1 or 1024 ** (len(f) - 1) < shards)


def test_blocks_come_back_as_they_were():
    rng = np.random.default_rng(7)
    kinds = {"a": exchange.FLAG, "b": exchange.COUNT, "c": exchange.ID}
    for n in (0, 1, 9, 500):
        key = np.sort(rng.integers(0, 2**62, n).astype(np.uint64) * np.uint64(3))
        values = {"a": rng.random(n) < 0.5, "b": rng.integers(0, 70_000, n), "c": rng.integers(-5, 2**62, n)}
        k, v = exchange.decoded(exchange.encoded(key, values, kinds), kinds)
        assert (k == key).all() and all((v[f] == values[f]).all() for f in kinds)
        _, v = exchange.decoded(exchange.encoded(None, values, kinds), kinds, keyed=False)
        assert all((v[f] == values[f]).all() for f in kinds)
