"""Questions of packed batches of documents to shards of keys, and the answers, without moving the texts.

Documents are packed once into batches of a few MB (a row each, as compressed Arrow data, in a table bucketed by
batch). A batch asks each shard about its distinct keys in one block, with what it knows of them; a shard merges what
all batches know of its keys and answers each. A key that is in a third of all documents is there once for each batch,
so no shard gets hot; answers are far smaller than texts, and joining them leaves the bucketed batches where they are.

A batch never sends more than FANOUT blocks. With more shards than that, blocks go by relays, a digit of the key at a
time: a relay takes as many batches' blocks of one digit as make a batch again, merges them, and asks on as one batch.
So the number of blocks is in proportion to the input, times the number of hops (which grows with its logarithm), and
no task holds more than a batch, a relay or a shard, whose sizes are parameters.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Bytes of text in a batch; one longer text stands alone.
BATCH_BYTES = 4 << 20
#: Blocks that one batch or relay sends at most.
FANOUT = 1024


@dataclass
class Batches:
    """Packed documents (batch, rows, bytes, block), how many batches there are, and their bytes of text."""

    rows: DataFrame
    count: int
    bytes: int

    @property
    def key_bits(self) -> int:
        """Bits of a hash by which any of the corpus's n-grams is taken for another with a chance of 2^-18 at most."""
        return min(64, 18 + max(22, int(self.bytes + 2).bit_length()))


def packed(docs: DataFrame, keep: tuple[str, ...], batch_bytes: int = BATCH_BYTES) -> Batches:
    """All documents in batches, each in the order of doc_id, nulls last."""
    source = docs.select(*keep, F.col("text").cast("binary").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held, size, made = [], 0, 0

        def flush():
            nonlocal held, size, made
            t = pa.Table.from_batches(held)
            t = t.take(pa.compute.sort_indices(t, [("doc_id", "ascending")])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
                out.write_table(t)
            made += 1
            row = [[first + made], [t.num_rows], [size], [sink.getvalue().to_pybytes()]]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.binary())], ["batch", "rows", "bytes", "block"])

        for b in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            lo = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > batch_bytes:
                    if i > lo:
                        held.append(b.slice(lo, i - lo))
                    lo = i
                    yield flush()
                size += n + 1
            if lo < b.num_rows:
                held.append(b.slice(lo))
        if held:
            yield flush()
        pa.default_memory_pool().release_unused()

    base.modest_batches(docs.sparkSession)
    rows = base.bucketed(source.mapInArrow(run, "batch long, rows long, bytes long, block binary"), "batches", "batch", buckets(source))
    total = rows.agg(F.count("*"), F.sum("bytes")).first()
    return Batches(rows, total[0], total[1] or 0)


def buckets(source: DataFrame, each: int = 64 << 20, most: int = 100_000) -> int:
    """As many as make each about this large by the planner's estimate, and no fewer than shuffle partitions."""
    least = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, min(most, size // each))  # beyond that nothing is known


def opened(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(block)).read_all()


#: Kinds of what goes with a key: flags as bits, counts in as many bytes as the largest needs, ids by a dictionary.
FLAG, COUNT, ID = "flag", "count", "id"
_squeeze, _open = zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that the compressor sees the empty high bytes; first, how many planes."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = data[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.view("<u8").ravel(), at + 1 + n * width


def encoded(key: np.ndarray | None, values: dict[str, np.ndarray], kinds: dict[str, str]) -> bytes:
    """Ascending keys (if any) as differences, and what goes with each."""
    n = len(next(iter(values.values()))) if key is None else len(key)
    out = [struct.pack("<I", n)]
    if key is not None:
        out.append(_planes(np.diff(key, prepend=np.uint64(0))))
    for name, kind in kinds.items():
        x = values[name]
        if kind == FLAG:
            out.append(np.packbits(x).tobytes())
        elif kind == COUNT:
            out.append(_planes(x))
        else:
            each, which = np.unique(x, return_inverse=True)
            out += [struct.pack("<I", len(each)), each.astype("<i8").tobytes(), _planes(which)]
    return _squeeze.compress(b"".join(out))


def decoded(block: bytes, kinds: dict[str, str], keyed: bool = True) -> tuple[np.ndarray | None, dict[str, np.ndarray]]:
    data = _open.decompress(block)
    n, at, key, values = struct.unpack_from("<I", data)[0], 4, None, {}
    if keyed:
        d, at = _unplanes(data, at, n)
        key = np.cumsum(d, dtype=np.uint64)
    for name, kind in kinds.items():
        if kind == FLAG:
            values[name] = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
            at += -(-n // 8)
        elif kind == COUNT:
            x, at = _unplanes(data, at, n)
            values[name] = x.astype(np.int64)
        else:
            m = struct.unpack_from("<I", data, at)[0]
            each = np.frombuffer(data, "<i8", m, at + 4)
            which, at = _unplanes(data, at + 4 + 8 * m, n)
            values[name] = each[which.astype(np.int64)] if m else np.zeros(0, np.int64)
    return key, values


class Rule:
    """What is known of a key and what a shard makes of it."""

    #: what goes with a key, and which of that tells keys apart that share their bits
    fields: dict[str, str] = {}
    same: tuple[str, ...] = ()
    #: what an answer says of a key
    gives: dict[str, str] = {}

    def combine(self, group: np.ndarray, n: int, own: dict) -> dict:
        """The fields of each of n keys from those of all that know it; the same whether in one step or in several."""
        raise NotImplementedError

    def answer(self, key: np.ndarray, held: dict) -> dict:
        """What the shard says of each key (ascending), from the combined fields of all batches."""
        raise NotImplementedError

    def give(self, got: dict, own: dict, held: dict) -> dict:
        """What one asker is told of its keys: got from further on, own fields, held: those of the step that it asked."""
        return got

    def totals(self, key: np.ndarray, held: dict) -> np.ndarray | None:
        """Numbers of this shard that are added up over all shards."""
        return None


class _Merged:
    """The blocks that one step got, merged by key."""

    def __init__(self, blocks: list[bytes], rule: Rule):
        parts = [decoded(b, rule.fields) for b in blocks]
        self.cuts = np.cumsum([len(k) for k, _ in parts])
        key = np.concatenate([k for k, _ in parts])
        self.own = {f: np.concatenate([v[f] for _, v in parts]) for f in rule.fields}
        if rule.same:
            order = np.lexsort((*[self.own[f] for f in rule.same], key))
        else:
            order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        for f in rule.same:
            new[1:] |= self.own[f][order][1:] != self.own[f][order][:-1]
        self.group = np.empty(len(key), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.key = key[new]
        self.held = rule.combine(self.group, len(self.key), self.own)

    def given(self, rule: Rule, got: dict) -> list[bytes]:
        """The answer to each block."""
        spread_ = lambda d: {f: x[self.group] for f, x in d.items()}
        value = rule.give(spread_(got), self.own, spread_(self.held))
        split = {f: np.split(value[f], self.cuts[:-1]) for f in rule.gives}
        return [encoded(None, {f: split[f][i] for f in rule.gives}, rule.gives) for i in range(len(self.cuts))]


def sliced(key: np.ndarray, fan: int):
    """(digit, which): for each last digit that some of the keys have, which those are, in ascending order of the key."""
    digit = (key % np.uint64(fan)).astype(np.int64)
    order = np.argsort(digit.astype(np.uint16) if fan <= 1 << 16 else digit, kind="stable")
    cuts = np.flatnonzero(np.diff(digit[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(digit[part[0]]), part


def _cut(key: np.ndarray, values: dict, kinds: dict, fan: int):
    """(digit, block): ascending keys by their last digit, without it."""
    for digit, part in sliced(key, fan):
        yield digit, encoded(key[part] // np.uint64(fan), {f: values[f][part] for f in kinds}, kinds)


def fans(shards: int, most: int = FANOUT) -> list[int]:
    """How far each hop fans out, so that all of them reach at least so many shards."""
    hops = 1
    while most**hops < shards:
        hops += 1
    each = next(f for f in range(max(1, int(shards ** (1 / hops)) - 1), most + 1) if f**hops >= shards)
    return [each] * hops


def collected(key: np.ndarray, answers: dict[int, bytes], rule: Rule, fan: int, first: int = 0, step: int = 1) -> dict[str, np.ndarray]:
    """What the answers {shard: block} say of each of the ascending keys that were asked about."""
    out = {f: np.zeros(len(key), bool if kind == FLAG else np.int64) for f, kind in rule.gives.items()}
    for digit, part in sliced(key, fan):
        _, got = decoded(answers[first + step * digit], rule.gives, keyed=False)
        for f in out:
            out[f][part] = got[f]
    return out


_ROWS = "shard long, batch long, block binary"


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([r[1] for r in rows], pa.int64()), "block": pa.array([r[2] for r in rows], pa.binary())})


def _sorted(t: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
    t = t.take(pa.array(np.argsort(t.column("batch").to_numpy(), kind="stable")))
    return t.column("shard").to_pylist(), t.column("batch").to_pylist(), t.column("block").to_pylist()


def questions(batches: DataFrame, ask, rule: Rule, fan: int, *answers: str) -> DataFrame:
    """(shard, batch, block): ask(documents, answers...) gives ascending keys and their fields; answers are {shard: block}."""

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                key, own = ask(opened(b.column("block")[i].as_py()), *[answer_of(b.column(a)[i]) for a in answers])
                n = b.column("batch")[i].as_py()
                yield from _table([(digit, n, x) for digit, x in _cut(key, own, rule.fields, fan)]).to_batches()
        pa.default_memory_pool().release_unused()

    return batches.select("batch", "block", *answers).mapInArrow(run, _ROWS)


def answer_of(cell) -> dict[int, bytes]:
    return {x["shard"]: x["block"] for x in cell.as_py() or []}


def exchanged(batches: Batches, ask, rule: Rule, shards: int, tag: str, asking: DataFrame | None = None, answers: tuple[str, ...] = (), fanout: int = FANOUT) -> DataFrame:
    """(shard, batch, block): what each batch is told by each of the first hop's shards, written.

    asking: the batches with the answers that ask() needs. Rows of negative batches hold the shards' totals.
    """
    steps = fans(shards, fanout)
    asked = questions(batches.rows if asking is None else asking, ask, rule, steps[0], *answers)
    relays, askers, reach = [], batches.count, steps[0]
    for fan in steps[1:]:
        groups = max(1, -(-askers // steps[0]))
        relay = F.col("shard") * groups + F.pmod(F.xxhash64("batch"), F.lit(groups))
        kept = base.written(asked.withColumn("relay", relay), f"{tag}_relay")
        relays.append((kept, fan, reach))
        asked = kept.groupBy("relay").applyInArrow(_relay(rule, fan, reach), _ROWS)
        askers, reach = steps[0] * groups, reach * fan
    out = asked.groupBy("shard").applyInArrow(_reply(rule, reach), _ROWS)
    for kept, fan, step in reversed(relays):
        out = kept.groupBy("relay").cogroup(out.groupBy("batch")).applyInArrow(_back(rule, fan, step), _ROWS)
    return base.written(out, tag)


def _relay(rule: Rule, fan: int, step: int):
    """Asks on about the merged keys of the blocks of one relay."""

    def run(t: pa.Table) -> pa.Table:
        relay = t.column("relay")[0].as_py()
        shard, _, blocks = _sorted(t)
        m = _Merged(blocks, rule)
        return _table([(shard[0] + step * digit, relay, x) for digit, x in _cut(m.key, m.held, rule.fields, fan)])

    return run


def _reply(rule: Rule, shards: int):
    """Answers all blocks of one shard."""

    def run(t: pa.Table) -> pa.Table:
        shard, batch, blocks = _sorted(t)
        m = _Merged(blocks, rule)
        key = m.key * np.uint64(shards) + np.uint64(shard[0])
        rows = list(zip(shard, batch, m.given(rule, rule.answer(key, m.held))))
        if (totals := rule.totals(key, m.held)) is not None:
            rows.append((shard[0], -1 - shard[0] % 4096, totals.astype("<i8").tobytes()))
        return _table(rows)

    return run


def _back(rule: Rule, fan: int, step: int):
    """Tells the askers of one relay what it was told."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # totals pass by
            return right.select(["shard", "batch", "block"])
        shard, batch, blocks = _sorted(left)
        m = _Merged(blocks, rule)
        told = dict(zip(right.column("shard").to_pylist(), right.column("block").to_pylist()))
        return _table(list(zip(shard, batch, m.given(rule, collected(m.key, told, rule, fan, shard[0], step)))))

    return run


def totals(answers: DataFrame, n: int) -> list[int]:
    """The n numbers that all shards add up to."""

    def run(it):
        for b in it:
            t = np.array([np.frombuffer(x, "<i8") for x in b.column("block").to_pylist()]).reshape(-1, n).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in t], [f"t{i}" for i in range(n)])

    row = answers.where("batch < 0").select("block").mapInArrow(run, ", ".join(f"t{i} long" for i in range(n))).agg(*[F.sum(f"t{i}") for i in range(n)]).first()
    return [x or 0 for x in row]


def joined(batches: DataFrame, **answers: DataFrame) -> DataFrame:
    """The batches with, under each name, the array of (shard, block) that they were answered: FANOUT at most."""
    for name, df in answers.items():
        each = df.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("shard", "block")).alias(name)).withColumnRenamed("batch", "to")
        batches = batches.join(each.hint("shuffle_hash"), batches["batch"] == each["to"], "left").drop("to")
    return batches


def shards_for(batches: Batches, bytes_in_shard: int) -> int:
    """As many shards as make each about this large, and no fewer than there are shuffle partitions."""
    return max(int(batches.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-batches.bytes // bytes_in_shard))
