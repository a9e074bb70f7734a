"""Exact substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``block`` words, the index; any window of ``window`` words holds a
whole block if 2 * block - 1 <= window. All rolling windows of block length probe the index; a block that is met
anywhere else than at itself is a hit. Around hits, windows of full length are compared by a 64-bit hash of theirs, which
extends the hits (and by 32 bits of a second hash, since at 10^13 windows some millions of unequal pairs would share
the first): overlapping windows that repeat add up to the maximal exact repeat. The words of a window that also starts
in a document with a smaller doc_id go.

Probes and windows travel as sorted, packed keys, each once for a batch of documents, with one-bit answers (see
exchange.py); texts stay in place. A passage that is in every document costs a key for each batch.

Defined cases: a null or empty text has no words; a null doc_id is larger than all others and equal to itself; rows
with the same doc_id don't count as smaller than each other, nor do repeats within one document; documents under
``window`` words are left alone; a huge text is a batch by itself; other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, exchange
from .textcore import Words

LAST = np.iinfo(np.int64).max


def _texts(t: pa.Table) -> Words:
    return Words(t.column("text").to_pylist())


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()


def _probes(w: Words, block: int, bits: int):
    """The distinct keys of all rolling blocks, which key each place has, and which places are whole anchors."""
    h, ok = w.windows(block)
    at = np.flatnonzero(ok)
    key, inverse = np.unique(h[at] >> np.uint64(64 - bits), return_inverse=True)
    anchor = (at - w.first[w.doc[at]]) % block == 0
    return at, key, inverse, anchor


class Blocks(exchange.Rule):
    """Is a block an anchor somewhere, and there more than once?"""

    fields, gives = {"indexed": exchange.FLAG, "twice": exchange.FLAG}, {"hit": exchange.FLAG}

    def combine(self, group, n, own):
        return {"indexed": np.bincount(group, own["indexed"], n) > 0, "twice": np.bincount(group, 1 + own["twice"], n) > 1}

    def answer(self, key, held):
        return {"hit": held["indexed"] & held["twice"]}


class Windows(exchange.Rule):
    """Does a window start in a document with a smaller doc_id than any that the asker knows of? Alike are only windows
    with the same key of 64 bits and the same check of 32 more."""

    fields, same, gives = {"check": exchange.COUNT, "least": exchange.ID}, ("check",), {"smaller": exchange.FLAG}

    def combine(self, group, n, own):
        least = np.full(n, LAST)
        np.minimum.at(least, group, own["least"])
        check = np.zeros(n, np.int64)
        check[group] = own["check"]
        return {"check": check, "least": least}

    def answer(self, key, held):
        return {"smaller": np.zeros(len(key), bool)}

    def give(self, got, own, held):
        return {"smaller": got["smaller"] | (held["least"] < own["least"])}


@dataclass(frozen=True)
class Plan:
    """Words of a block and of a window, bits of a block's key, and how far a batch fans out."""

    block: int
    window: int
    bits: int
    fan: int


def _ask_blocks(plan: Plan):
    def ask(t):
        _, key, inverse, anchor = _probes(_texts(t), plan.block, plan.bits)
        indexed = np.zeros(len(key), bool)
        indexed[inverse[anchor]] = True
        return key, {"indexed": indexed, "twice": np.bincount(inverse, minlength=len(key)) > 1}

    return ask


def _candidates(w: Words, ids: np.ndarray, plan: Plan, hits: dict[int, bytes]):
    """The places of the windows that hold a hit, the distinct ones among them by key and check, which one each place
    has, and the least doc_id of each."""
    at, key, inverse, _ = _probes(w, plan.block, plan.bits)
    hit = exchange.collected(key, hits, Blocks(), plan.fan)["hit"]
    mark = np.zeros(len(w.doc) + 1, np.int64)
    mark[at[hit[inverse]] + 1] = 1
    mark = np.cumsum(mark)
    h, ok = w.windows(plan.window)
    s = np.flatnonzero(ok)
    s = s[mark[s + plan.window - plan.block + 1] > mark[s]]
    check = (w.windows(plan.window, again=True)[0][s] >> np.uint64(32)).astype(np.int64) if len(s) else np.zeros(0, np.int64)
    order = np.lexsort((s, check, h[s]))  # documents stand in the order of doc_id, so the first place is of the least
    key, check = h[s][order], check[order]
    new = np.ones(len(s), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(new) - 1
    return s, key[new], check[new], which, ids[w.doc[s[order[new]]]]


def _ask_windows(plan: Plan):
    def ask(t, hits):
        _, key, check, _, least = _candidates(_texts(t), _ids(t), plan, hits)
        return key, {"check": check, "least": least}

    return ask


def _removed(t: pa.Table, plan: Plan, hits, answers) -> tuple[Words, np.ndarray]:
    """Marks the words of the batch that go."""
    w, ids = _texts(t), _ids(t)
    s, key, _, which, least = _candidates(w, ids, plan, hits)
    smaller = exchange.collected(key, answers, Windows(), plan.fan)["smaller"]
    gone = s[smaller[which] | (ids[w.doc[s]] > least[which])]
    edge = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + plan.window, -1)
    return w, np.cumsum(edge)[:-1] > 0


def _digests(w: Words, gone: np.ndarray) -> dict[str, list]:
    removed = np.bincount(w.doc[gone], minlength=len(w.raw))
    sha, keep = [], ~gone
    for i, raw in enumerate(w.raw):
        words = raw.split()
        if removed[i]:
            mask = keep[w.first[i] : w.first[i + 1]].tolist()
            words = [x for x, k in zip(words, mask) if k]
        sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return {"n_words": w.n, "n_removed": removed, "kept_sha256": sha}


def _cleaned(w: Words, gone: np.ndarray) -> dict[str, list]:
    """The text without the words that go (each with the white space after it), and their runs as (first, end) words."""
    removed = np.bincount(w.doc[gone], minlength=len(w.raw))
    text, spans = [], []
    for i, raw in enumerate(w.raw):
        if not removed[i]:
            text.append(raw.decode("utf-8", "replace"))
            spans.append([])
            continue
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        edge = np.flatnonzero(np.diff(gone[lo:hi].astype(np.int8), prepend=0, append=0))
        spans.append([[int(a), int(b)] for a, b in zip(edge[::2], edge[1::2])])
        at = np.append(w.start[lo:hi], w.at[i + 1] - 1) - w.at[i]
        out, k = [raw[: at[0]]], 0
        for a, b in spans[-1]:
            out.append(raw[at[k] : at[a]])
            k = b
        out.append(raw[at[k] :])
        text.append(b"".join(out).decode("utf-8", "replace"))
    return {"n_words": w.n, "n_removed": removed, "text": text, "spans": spans}


#: What deduplicated() can return, with the types.
RESULTS = {
    "digest": (_digests, [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())], "n_words long, n_removed long, kept_sha256 string"),
    "text": (_cleaned, [("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))], "n_words long, n_removed long, text string, spans array<array<long>>"),
}


def deduplicated(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = 13, result: str = "text", batch_bytes: int = exchange.BATCH_BYTES, shard_bytes: int = 16 << 20, fanout: int = exchange.FANOUT) -> DataFrame:
    """keep and, for each document, n_words, n_removed and the cleaned text with the removed spans (or its digest)."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    columns = tuple(dict.fromkeys((*keep, "doc_id")))
    batches = exchange.packed(docs, columns, batch_bytes)
    shards = exchange.shards_for(batches, shard_bytes)
    plan = Plan((window + 1) // 2, window, batches.key_bits, exchange.fans(shards, fanout)[0])
    hits = exchange.exchanged(batches, _ask_blocks(plan), Blocks(), shards, "hits", fanout=fanout)
    asking = exchange.joined(batches.rows, hits=hits)
    windows = exchange.exchanged(batches, _ask_windows(plan), Windows(), shards, "windows", asking, ("hits",), fanout)
    make, arrow, fields = RESULTS[result]
    kept = StructType([docs.schema[k] for k in keep])  # columns of docs, apart from the results
    schema = StructType(kept.fields + _parse_datatype_string(fields).fields)

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                t = exchange.opened(b.column("block")[i].as_py())
                w, gone = _removed(t, plan, exchange.answer_of(b.column("hits")[i]), exchange.answer_of(b.column("windows")[i]))
                got = make(w, gone)
                columns = [t.column(k).combine_chunks() for k in keep] + [pa.array(got[n], kind) for n, kind in arrow]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *[n for n, _ in arrow]])

    return exchange.joined(batches.rows, hits=hits, windows=windows).select("block", "hits", "windows").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """The documents with repeated passages taken out of text (and n_chars set); one without a word left goes."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = deduplicated(docs.select("doc_id", "text", F.struct(*rest).alias("row")), ("row",), window)
    out = out.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    docs = base.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return deduplicated(docs, result="digest")
