"""SimHash near-duplicates by anchor-point covering.

The codewords of a covering code are the anchors. Every fingerprint has one nearest anchor, its home, and visits each
anchor that is at most ``bits`` further away than its home. Of two fingerprints within ``bits`` of each other, the one
that is further from its home always visits the home of the other; so comparing, at each anchor, those at home with
all that are there finds every link, exactly. (That stays within covering radius plus threshold, and is fewer.)

Equal fingerprints are merged before anything else; an anchor hands on a spanning forest of its links, never all
pairs; anchors that are home to many, or that many visit, are split into a grid of both. Components come from alternating large-star and
small-star rounds over written tables.

Defined cases: a null or empty text, or one of spaces, has fingerprint zero and links like any other; with fewer words
than a shingle has, the whole sequence is the one shingle; repeated rows share their fingerprint; a null id never
becomes a component's id unless all its ids are null; a bit set in exactly half the hashes is 0; huge texts are hashed
whole; other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .textcore import Words, mixed

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprints(texts, words: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set where over half its shingles' XXH64 have it."""
    import xxhash

    digest = xxhash.xxh64_digest
    parts, count = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = (t or b"").lower().split()  # bytes.lower() and bytes.split() know ASCII only
        if not w:
            continue
        joined = b" ".join(w)
        if len(w) <= words:
            hashes = [digest(joined, seed)]
        else:
            end = list(accumulate(map(len, w), lambda a, b: a + 1 + b))
            start = [0, *[e + 1 for e in end[: len(w) - words]]]
            hashes = [digest(joined[a:b], seed) for a, b in zip(start, end[words - 1 :])]
        count[i] = len(hashes)
        parts += hashes
    out = np.zeros((len(texts), 64), bool)
    if parts:
        lanes = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8)
        row = np.repeat(np.arange(len(texts)) * 256, count)
        for lane in range(8):
            hist = np.bincount(row + lanes[:, lane], minlength=256 * len(texts)).reshape(-1, 256)
            out[:, 8 * lane : 8 * lane + 8] = hist @ _BITS * 2 > count[:, None]
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


class Code:
    """A perfect binary code of up to 23 bits, by the columns of its parity check.

    For every syndrome, the error patterns up to ``reach`` heavier than its lightest, in order of weight.
    """

    def __init__(self, columns: list[int], radius: int, reach: int):
        n = len(columns)
        self.n, self.columns = n, np.array(columns, np.uint32)
        patterns, weights = [], []
        for w in range(min(n, radius + reach) + 1):
            for bits in combinations(range(n), w):
                patterns.append(sum(1 << b for b in bits))
                weights.append(w)
        patterns, weights = np.array(patterns, np.uint32), np.array(weights)
        syndrome = self.syndrome(patterns)
        size = 1 << int(self.columns.max()).bit_length()
        least = np.full(size, 99)
        np.minimum.at(least, syndrome, weights)
        extra = weights - least[syndrome]
        keep = extra <= reach
        order = np.lexsort((extra[keep], syndrome[keep]))
        self.pattern, self.extra = patterns[keep][order], extra[keep][order]
        s = syndrome[keep][order]
        self.first = np.searchsorted(s, np.arange(size))
        #: by syndrome and budget: how many patterns are within it
        self.within = np.stack([np.bincount(s[self.extra <= b], minlength=size) for b in range(reach + 1)], axis=1)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint32)
        for i, c in enumerate(self.columns):
            out ^= ((x >> np.uint32(i)) & np.uint32(1)) * c
        return out


def repetition(n: int) -> tuple[list[int], int]:
    """All bits equal: two codewords, radius (n - 1) / 2."""
    return [1 << i for i in range(n - 1)] + [(1 << (n - 1)) - 1], (n - 1) // 2


def golay() -> tuple[list[int], int]:
    """The binary Golay code of 23 bits: 4096 codewords, radius 3; remainders of x^i by its generator."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= 0b110001110101
    return out, 3


#: Products of codes side by side over the low bits: (codes, log2 of the anchors, anchors that a fingerprint visits on average).
PLANS = {
    "coarse": (lambda: [repetition(7)] * 9, 9, 30),
    "middle": (lambda: [repetition(5)] * 12, 12, 92),
    "fine": (lambda: [golay(), golay(), repetition(9), repetition(9)], 26, 420),
}


def plan_for(n: int) -> str:
    """The plan with the least work for n fingerprints: rows to move, and pairs to compare at about a thousandth of that."""
    return min(PLANS, key=lambda p: n * PLANS[p][2] * (1 + n / 2 ** PLANS[p][1] / 1000))


class Covering:
    def __init__(self, plan: str, bits: int = 3):
        self.bits = bits
        made: dict[str, Code] = {}
        self.codes = [made.setdefault(str(c), Code(*c, bits)) for c in PLANS[plan][0]()]

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each visit: the row, the anchor, and whether it is the row's home."""
        row = np.arange(len(fp))
        anchor, extra, shift = np.zeros(len(fp), np.uint64), np.zeros(len(fp), np.int64), 0
        for code in self.codes:
            x = ((fp >> np.uint64(shift)) & np.uint64((1 << code.n) - 1)).astype(np.uint32)
            s = code.syndrome(x)[row]
            n = code.within[s, self.bits - extra]
            total = np.cumsum(n)
            at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(code.first[s] - (total - n), n)
            row, anchor, extra = np.repeat(row, n), np.repeat(anchor, n), np.repeat(extra, n) + code.extra[at]
            anchor = anchor | ((x[row] ^ code.pattern[at]).astype(np.uint64) << np.uint64(shift))
            shift += code.n
        return row, anchor, extra == 0


def visits(fps: DataFrame, plan: str, bits: int) -> DataFrame:
    """(anchor, home, fp): each fingerprint at each anchor it visits."""
    import pyarrow as pa

    def run(batches):
        cover = Covering(plan, bits)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 4096):
                row, anchor, home = cover.anchors(fp[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(home), pa.array(fp[lo : lo + 4096][row].view(np.int64))], ["anchor", "home", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, home boolean, fp long")


def visitors_of(fps: DataFrame, plan: str, bits: int) -> DataFrame:
    """(anchor, h, n): how many fingerprints each anchor is home to and how many are there, in parts that add up."""
    import pyarrow as pa

    def run(batches):
        cover = Covering(plan, bits)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 4096):
                _, anchor, home = cover.anchors(fp[lo : lo + 4096])
                each, which = np.unique(anchor, return_inverse=True)
                homes, there = np.bincount(which, home, len(each)).astype(np.int64), np.bincount(which, minlength=len(each))
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(homes), pa.array(there)], ["anchor", "h", "n"])

    return fps.select("fp").mapInArrow(run, "anchor long, h long, n long")


def spread_out(fps: DataFrame, n: int, key: str, each: int = 100_000) -> DataFrame:
    """Dealt so that a task has about ``each`` fingerprints, which visit many times as many anchors."""
    return fps.repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // each)), key)


def forest(fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is joined by pairs of a row at home and any row within ``bits``: at most one for each row."""
    label = np.arange(len(fp))
    joined = False
    for h in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[h]) <= bits)
        if len(near) > 1 and (label[near] != label[near[0]]).any():
            joined = True
            old = np.unique(label[near])
            to = np.arange(len(fp))
            to[old] = old[0]
            label = to[label]
    if not joined:
        return fp[:0], fp[:0]
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[at], fp[label[at]]


def split_hot(seen: DataFrame, counts: DataFrame, key: str, homes: int, visitors: int) -> DataFrame:
    """Adds part and sets home: rows (anchor, home, key) of anchors with more than so many homes or visitors are dealt
    over a grid of parts, each of which compares some of the homes with some of all that are there.

    A row at home stands in all parts of its line of the grid as one, and every row in all parts of its column as one
    that is only compared with; so any pair of a home and a visitor meets in exactly one part.
    counts: (anchor, h, n) of visitors_of().
    """
    n = counts.groupBy("anchor").agg(F.sum("h").alias("h"), F.sum("n").alias("n")).where((F.col("h") > homes) | (F.col("n") > visitors))
    hot = base.written(n.select(F.col("anchor").alias("a0"), F.greatest(F.ceil(F.col("h") / homes), F.lit(1)).cast("int").alias("lines"), F.ceil(F.col("n") / visitors).cast("int").alias("columns")), "hot")
    if not (count := hot.count()):
        return seen.withColumn("part", F.lit(0))
    seen = seen.join(base.small(hot, count, 100_000), F.col("anchor") == F.col("a0"), "left").drop("a0")
    seen = seen.withColumns({"lines": F.coalesce("lines", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
    line, column = F.pmod(F.xxhash64(F.lit(1), key), F.col("lines")).cast("int"), F.pmod(F.xxhash64(F.lit(2), key), F.col("columns")).cast("int")
    in_column = F.transform(F.sequence(F.lit(0), F.col("lines") - 1), lambda i: F.struct((i * F.col("columns") + column).alias("part"), (F.col("home") & (i == line)).alias("home")))
    others = F.filter(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.col("home") & (j != column))
    in_line = F.transform(others, lambda j: F.struct((line * F.col("columns") + j).alias("part"), F.lit(True).alias("home")))
    rest = [c for c in seen.columns if c not in ("home", "lines", "columns")]
    return seen.select(*rest, F.explode(F.concat(in_column, in_line)).alias("spot")).select(*rest, "spot.part", "spot.home")


def links(fps: DataFrame, bits: int = 3, plan: str | None = None, block: int = 4_096, visitors: int = 16_384) -> DataFrame:
    """(a, b): links between different fingerprints within ``bits`` that join all that such pairs join. fps: distinct."""
    import pyarrow as pa

    n = fps.count()
    plan, fps = plan or plan_for(n), spread_out(fps, n, "fp")
    seen = split_hot(visits(fps, plan, bits), visitors_of(fps, plan, bits), "fp", block, visitors).select("anchor", "part", "home", "fp")
    seen = seen.repartition("anchor", "part").sortWithinPartitions("anchor", "part")

    def compare(batches):
        kept: list = []

        def groups(anchor, part, home, fp, last):
            new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
            cuts = [0, *new.tolist()] + ([len(fp)] if last else [])
            out_a, out_b = [fp[:0]], [fp[:0]]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1:
                    a, b = forest(fp[lo:hi], home[lo:hi], bits)
                    out_a.append(a)
                    out_b.append(b)
            return np.concatenate(out_a), np.concatenate(out_b), cuts[-1] if cuts else 0

        def batch(a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))), pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], ["a", "b"])

        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)]
        size = 0
        for b in batches:
            kept.append([b.column("anchor").to_numpy(), b.column("part").to_numpy(), b.column("home").to_numpy(zero_copy_only=False), b.column("fp").to_numpy().view(np.uint64)])
            size += b.num_rows
            if size >= 100_000:
                now = [np.concatenate(x) for x in zip(rest, *kept)]
                a, c, done = groups(*now, False)
                rest, kept, size = [x[done:] for x in now], [], 0
                if len(a):
                    yield batch(a, c)
        now = [np.concatenate(x) for x in zip(rest, *kept)]
        if len(now[0]):
            a, c, _ = groups(*now, True)
            if len(a):
                yield batch(a, c)

    return seen.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge (a, b).

    Large-star and small-star rounds in turn until nothing changes; each round is written, and no row is larger than
    a pair, so a centre with millions of neighbours is only a key of a combining sum and of a join.
    """
    edges = base.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("x")).first()
    before = mark(edges)
    while before["n"]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k")
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = base.written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        edges = base.written(small, "small")
        after = mark(edges)
        if after == before:
            break
        before = after
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def classes(docs: DataFrame, words: int = 3, bits: int = 3, keep: tuple[str, ...] = ("doc_id",), plan: str | None = None) -> DataFrame:
    """keep, fp (64 bits as a long) and component_id, the least doc_id of the component, of each document."""

    def make():
        return lambda texts: {"fp": fingerprints(texts, words).view(np.int64)}

    rows = base.written(base.map_texts(docs, make, "fp long", tuple(dict.fromkeys((*keep, "doc_id")))), "fps")
    each = base.written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(each, bits, plan))
    known = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = base.written(known, "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select(F.col("fp").alias("fp0"), "component_id")
    return rows.join(known, F.col("fp") == F.col("fp0")).drop("fp0")


LANES = 4


def signatures(texts, words: int = 5, seed: int = 42) -> np.ndarray:
    """LANES * 64 sign bits of each text's shingles, as 64-bit lanes: bits enough to estimate a similarity.

    The lanes come from one hash of a shingle by scrambling.
    """
    w = Words([None if t is None else t.lower() for t in texts])
    size = np.minimum(w.n, words)
    h, ok = w.windows(words)
    at = np.flatnonzero(ok)
    doc, h = w.doc[at], h[at]
    for k in range(1, words):  # texts with fewer words are one shingle
        few, inside = w.windows(k)
        one = np.flatnonzero(inside & (size[w.doc[: len(few)]] == k) & (w.n[w.doc[: len(few)]] == k))
        doc, h = np.concatenate([doc, w.doc[one]]), np.concatenate([h, few[one]])
    count = np.bincount(doc, minlength=len(w.raw))
    out = np.zeros((len(w.raw), LANES), np.uint64)
    for lane in range(LANES):
        with np.errstate(over="ignore"):
            bytes_ = mixed(h + np.uint64(seed + lane) * np.uint64(0x9E3779B97F4A7C15)).astype(">u8").view(np.uint8).reshape(-1, 8)
        bits = np.zeros((len(w.raw), 64), bool)
        for j in range(8):
            hist = np.bincount(doc * 256 + bytes_[:, j], minlength=256 * len(w.raw)).reshape(-1, 256)
            bits[:, 8 * j : 8 * j + 8] = hist @ _BITS * 2 > count[:, None]
        out[:, lane] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def allowed(similarity: float) -> int:
    """Signature bits that may differ at a Jaccard similarity: as the angle says, and one standard deviation more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * LANES
    return int(n * p + math.sqrt(n * p * (1 - p)))


def similar_links(rows: DataFrame, bits: int, differ: int, plan: str | None = None, block: int = 4_000, visitors: int = 16_384) -> DataFrame:
    """(a, b): links between ids of rows (id, fp, s0..) whose fp are within bits and whose signatures differ in no more
    than ``differ`` bits, enough to join all that such pairs join. id: distinct."""
    import pyarrow as pa

    n = rows.count()
    plan, rows = plan or plan_for(n), spread_out(rows, n, "id")
    lanes = [f"s{i}" for i in range(LANES)]

    def visit(batches):
        cover = Covering(plan, bits)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 4096):
                row, anchor, home = cover.anchors(fp[lo : lo + 4096])
                rest = b.slice(lo, 4096).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(home), *rest.columns], ["anchor", "home", *rest.schema.names])

    fields = "anchor long, home boolean, id long, fp long, " + ", ".join(f"{x} long" for x in lanes)
    seen = rows.select("id", "fp", *lanes).mapInArrow(visit, fields)
    seen = split_hot(seen, visitors_of(rows, plan, bits), "id", block, visitors)
    seen = seen.select("anchor", "part", "home", "id", "fp", *lanes).repartition("anchor", "part").sortWithinPartitions("anchor", "part")

    def cell(home, ids, fp, sign):
        """A spanning forest of the links of the rows at home with all that are there."""
        label = np.arange(len(ids))
        for h in np.flatnonzero(home):
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[h]) <= bits)
            if len(near) > 1:
                near = near[np.bitwise_count(sign[near] ^ sign[h]).sum(axis=1, dtype=np.int64) <= differ]
            if len(near) > 1 and (label[near] != label[near[0]]).any():
                old = np.unique(label[near])
                to = np.arange(len(ids))
                to[old] = old[0]
                label = to[label]
        at = np.flatnonzero(label != np.arange(len(ids)))
        return ids[at], ids[label[at]]

    def compare(batches):
        held: list = []

        def columns(bs):
            return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in bs]) for i in range(5 + LANES)]

        def out(c, last):
            key = np.flatnonzero((np.diff(c[0]) != 0) | (np.diff(c[1]) != 0)) + 1
            cuts = [0, *key.tolist()] + ([len(c[0])] if last else [])
            found = []
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1 and c[2][lo:hi].any():
                    sign = np.stack([x[lo:hi] for x in c[5:]], axis=1).view(np.uint64)
                    found.append(cell(c[2][lo:hi], c[3][lo:hi], c[4][lo:hi].view(np.uint64), sign))
            return found, cuts[-1]

        rest, size = None, 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 100_000:
                c = columns(held)
                c = c if rest is None else [np.concatenate(x) for x in zip(rest, c)]
                found, done = out(c, False)
                rest, held, size = [x[done:] for x in c], [], 0
                for x, y in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        if held or rest is not None:
            c = columns(held) if held else rest
            c = c if rest is None or not held else [np.concatenate(x) for x in zip(rest, c)]
            for x, y in out(c, True)[0] if len(c[0]) else []:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return seen.mapInArrow(compare, "a long, b long").distinct()


#: Bands of a sketch and minima in each: two sets at a similarity of 0.8 have none in common with a chance of 3e-6.
BANDS, MINIMA = 24, 4
_TURNS = mixed(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def names(texts) -> np.ndarray:
    """64 bits for the words of each text in their order, in small letters."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(b" ".join((t or b"").lower().split())) for t in texts], np.uint64)


def hashed(texts, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles each text has, and their 64 bits, in order within a text."""
    w = Words([None if t is None else t.lower() for t in texts])
    d, n = len(w.raw), w.n
    h, ok = w.windows(words)
    at = np.flatnonzero(ok)
    doc, h = w.doc[at], h[at]
    for k in range(1, words):  # texts with fewer words are one shingle
        few, inside = w.windows(k)
        one = np.flatnonzero(inside & (n[w.doc[: len(few)]] == k))
        doc, h = np.concatenate([doc, w.doc[one]]), np.concatenate([h, few[one]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return np.bincount(doc[new], minlength=d), h[new]


def sketches(texts, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles each text has, and BANDS keys of them.

    A key is a hash of MINIMA least values of the shingles under as many scramblings, so two texts share one with a
    chance of their similarity to the power of MINIMA, independently for each band. Texts without words share all.
    """
    size, h = hashed(texts, words)
    d, some = len(size), size > 0
    start = (np.cumsum(size) - size)[some]
    keys = np.zeros((d, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        if len(h):
            for i, turn in enumerate(_TURNS):
                keys[some, i // MINIMA] = mixed(keys[some, i // MINIMA] ^ np.minimum.reduceat(h * turn, start))
        keys = mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return size, keys


def shingles(text: bytes | None, words: int) -> set:
    """The different shingles themselves; with fewer words than one has, the whole sequence is the one."""
    w = (text or b"").lower().split()
    return set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else {tuple(w)} if w else set()


def as_similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) of ids whose texts' shingles have a Jaccard similarity of at least so much, counted exactly.

    texts: (id, text) with distinct ids.
    """
    from fractions import Fraction

    import pyarrow as pa

    least = Fraction(str(similarity))

    def run(batches):
        known: tuple = (None, None)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            at = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                if known[0] != b[i]:  # rows come sorted by b
                    known = (b[i], shingles(y.as_py(), words))
                one, two = shingles(x.as_py(), words), known[1]
                common = len(one & two)
                if common * least.denominator >= least.numerator * (len(one) + len(two) - common):
                    at.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in at], pa.int64()), "b": pa.array([b[i] for i in at], pa.int64())})

    base.modest_batches(pairs.sparkSession)
    binary = F.col("text").cast("binary")
    one = pairs.join(texts.select(F.col("id").alias("a"), binary.alias("x")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), binary.alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def apart_pairs(rows: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): pairs of ids of different roots, with all that are as similar and share a key, but few others; pairs within
    reach of the least different text of their group stand for all that are so by that alone.

    rows: (key, id, size, root); texts: (id, text). Texts joined by keys are a group. Its core are the shingles that over
    half its texts have, and D is what tells a text from the core, in either direction. Two texts differ by just what their D
    differ by, which is (1 - t) / (1 + t) of both sizes at most if they are t similar. So either their D have a shingle in
    common: the rarest of those has few places before it in the order of both D, and the numbers of places before
    and after it must agree. Or both D are small: then each of the two is as close to the text with the least D of all.
    Any core would do for that; one that copies share leaves them little to meet by.
    """
    from fractions import Fraction

    import pyarrow as pa

    p, q = Fraction(str(similarity)).as_integer_ratio()
    low, high = F.lit(q - p), F.lit(q + p)  # low / high of both sizes is the most that two texts may differ by

    def make():
        def run(some):
            size, h = hashed(some, words)
            return {"shingles": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), h.view(np.int64))}

        return run

    hubs = rows.groupBy("key").agg(F.min("id").alias("hub"))
    groups = components(rows.join(hubs, "key").where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    groups = groups.select(F.col("node").alias("id"), F.col("root").alias("grp"))
    members = base.written(rows.select("id", "size", "root").distinct().join(groups, "id"), "members")
    sets = base.written(base.map_texts(texts.join(members, "id"), make, "shingles array<long>", ("grp", "id", "size", "root")), "sets")

    total = members.groupBy("grp").agg(F.count("*").alias("total"))
    n = sets.select("grp", F.explode("shingles").alias("h")).groupBy("grp", "h").agg(F.count("*").alias("n")).where("n > 1")
    n = n.join(total, "grp").withColumn("core", 2 * F.col("n") > F.col("total"))
    n = base.written(n.select("grp", "h", "core", F.when(F.col("core"), F.col("total") - F.col("n")).otherwise(F.col("n")).alias("n")), "counts")
    core = n.where("core").groupBy("grp").agg(F.collect_list("h").alias("core"))
    core = base.small(core, n.where("core").count(), 100_000)
    none = F.array().cast("array<long>")
    apart = sets.join(core, "grp", "left").withColumn("core", F.coalesce("core", none))
    apart = apart.select("grp", "id", "size", "root", F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles")).alias("d"))
    apart = base.written(apart.withColumn("n_d", F.size("d").cast("long")), "differences")

    # those in D that another text's D has too, the rarest first, after those that none has
    of_text = ["grp", "id", "size", "root", "n_d"]
    places = apart.select(*of_text, F.explode("d").alias("h")).join(n.where("n > 1").drop("core"), ["grp", "h"])
    places = places.groupBy(*of_text).agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("d"))
    places = places.select(*of_text, F.posexplode("d").alias("at", "e"), (F.col("n_d") - F.size("d")).alias("alone"))
    places = places.select(*of_text, (F.col("alone") + F.col("at")).alias("before"), F.col("e.h").alias("h")).where(F.col("before") * p <= low * F.col("size"))
    most = members.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    places = base.written(places.join(most, "grp").withColumn("many", F.col("root") == F.col("most")).drop("most"), "places")
    x, y = places.where("not many").alias("x"), places.alias("y")
    c = F.col
    after = F.abs((c("x.n_d") - c("x.before")) - (c("y.n_d") - c("y.before")))
    agree = high * (c("x.before") + c("y.before") + after) <= low * (c("x.size") + c("y.size"))
    similar_size = F.least("x.size", "y.size") * q >= F.greatest("x.size", "y.size") * p
    found = x.join(y, (c("x.grp") == c("y.grp")) & (c("x.h") == c("y.h")) & (c("x.root") != c("y.root")) & agree & similar_size & (c("y.many") | (c("x.id") < c("y.id"))))
    found = found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    spread = apart.select("grp", "id", "root", (high * F.col("n_d") - low * F.col("size")).alias("s"))
    least = spread.groupBy("grp").agg(F.min(F.struct("s", "id", "root")).alias("m"))
    star = spread.join(least, "grp").where((F.col("root") != F.col("m.root")) & (F.col("s") + F.col("m.s") <= 0))
    return found.union(star.select(F.least("id", "m.id").alias("a"), F.greatest("id", "m.id").alias("b"))).distinct()


def met_links(each: DataFrame, docs: DataFrame, close: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links that join all pairs of ids that share a key and are as similar. each: (id, size, keys), id distinct;
    docs: (id, text); close: pairs (a, b) that are proposed otherwise.

    First every id of a key is compared with the least one there, and pairs of close; then, of those at a key that are
    still apart, the pairs that what tells them from their group leaves (apart_pairs). So every pair that meets is
    compared, joined by others already, or told apart by its shingles; neither copies nor texts that are merely alike are
    compared all with each other.
    """
    near = lambda x, y: F.least(x, y) >= F.floor(similarity * F.greatest(x, y))
    at = each.select("id", "size", F.explode("keys").alias("key"))
    hubs = at.groupBy("key").agg(F.min(F.struct("id", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = base.written(at.join(hubs, "key"), "met")
    close = base.written(close, "close")
    ids = met.select("id").union(close.select("a")).union(close.select("b")).distinct()
    texts = docs.join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    texts = base.written(texts, "texts")
    star = met.where((F.col("id") != F.col("hub.id")) & near(F.col("size"), F.col("hub.size"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
    star = base.written(star.union(close).distinct(), "star")
    first = base.written(as_similar(star, texts, words, similarity), "links")
    roots = base.written(components(first), "joined")
    rows = met.join(roots, met["id"] == roots["node"], "left").select("key", "id", "size", F.coalesce("root", "id").alias("root"))
    apart = rows.groupBy("key").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("key")
    rows = base.written(rows.join(apart, "key", "left_semi"), "apart")
    rest = base.written(apart_pairs(rows, texts, words, similarity), "rest")
    return first.union(as_similar(rest, texts, words, similarity))


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and component_id of each document, joined where shingles of so many words are so similar.

    Candidates are texts whose fingerprints of single words are within ``bits`` (found at their anchors) and whose
    signatures of LANES * 64 bits over the shingles are close, and, since such bits miss pairs, all that share a key.
    A link is kept only if the shingles' exact Jaccard similarity is high enough.
    """
    lanes = [f"s{i}" for i in range(LANES)]

    def make():
        import pyarrow as pa

        def run(texts):
            size, keys = sketches(texts, words)
            sign = signatures(texts, words).view(np.int64)
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel())
            return {"id": names(texts).view(np.int64), "fp": fingerprints(texts, 1).view(np.int64)} | {x: sign[:, i] for i, x in enumerate(lanes)} | {"size": size, "keys": listed}

        return run

    fields = "id long, fp long, " + ", ".join(f"{x} long" for x in lanes) + ", size long, keys array<long>"
    source = docs.select(F.struct(*dict.fromkeys((*keep, "doc_id"))).alias("row"), "text")
    rows = base.written(base.map_texts(source, make, fields, ("row",)), "signed")
    each = base.written(rows.groupBy("id").agg(F.min("row.doc_id").alias("first"), *[F.first(x).alias(x) for x in ("fp", *lanes, "size", "keys")]), "distinct")
    named = base.map_texts(docs, lambda: lambda texts: {"id": names(texts).view(np.int64)}, "id long", ("text",))
    close = similar_links(each, bits, allowed(similarity))
    roots = components(met_links(each, named, close, words, similarity))
    known = each.join(roots, each["id"] == roots["node"], "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    known = base.written(known, "roots")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select(F.col("id").alias("id0"), "component_id")
    return rows.join(known, F.col("id") == F.col("id0")).select(*[F.col("row").getField(k).alias(k) for k in keep], "component_id")


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of similar documents the one whose id is the component's, with all columns.

    Rows without an id stand or fall together, and so do rows that share an id.
    """
    found = similar_classes(docs.select("doc_id", "text"), words, similarity)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    return rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    docs = base.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
