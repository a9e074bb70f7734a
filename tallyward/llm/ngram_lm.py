"""Scoring texts by an n-gram model in Elias-Fano tries.

Order by order, batches of documents ask shards about their n-grams (see exchange.py), with how often they have each
in training texts. For words the shards answer exact counts. For a longer n-gram a batch also says how often its context
was seen and how likely the word is by the order below, both learned from the answers before; so the shard has all
that the smoothed probability takes. It builds a trie of the n-grams seen in training: contexts in order, monotone
pointers to where each context's words begin, and the words, all as Elias-Fano sequences, with the smoothed
probability of each n-gram quantised to sixteenths of an octave, however small it is. The levels are memory-mapped,
and an n-gram is looked up by a successor search for the context and then, within the range that the pointers give, one for the word
relative to its context. An n-gram that the trie lacks backs off: the weight that its context leaves, times the
probability of the order below.

The smoothing is Witten and Bell's interpolation, P(w | c) = (count(c w) + T(c) P(w | c')) / (count(c) + T(c)), T being how many different
words follow a context. That number isn't gathered (a frequent context would have all words in one place) but taken
from Heaps' law of the corpus itself: T(c) = count(c) ^ (ln V / ln N). Over all words, the unknown one included, the
probabilities of a context add up to 1 but for the quantisation. P of order 1 is the additive unigram probability.

What is gathered is all n-grams of the corpus; nothing is pruned or capped. Words go by 64 bits of hash, longer n-grams
by as many as keep the chance that an unseen one is taken for a seen one under 2^-18 at any size of the corpus. Shards
take n-grams by a hash of the whole n-gram, and a batch asks for each once, so frequent contexts don't gather anywhere.

Defined cases: a null or empty text is its end token alone; a huge text is a batch by itself; a null id hashes as the
empty text; rows that share an id or a text are learned and scored each by itself; without training documents every token is unknown (N = V = 0, the
base terms are log10 of 1, and the model's as well); columns beside those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, exchange
from .textcore import Words, mixed

U = np.uint64
#: The end of a text, and what stands before its first word.
END, START = mixed(np.array([0x656E64, 0x7374617274], U))
#: Of a key's bits, those of the context; the others are of the word as seen from its whole context.
CONTEXT_BITS = 18
STEPS = 16  # of the quantised logarithm in an octave


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(universe / n) bits each."""

    FIELDS = ("low", "high", "rank")

    def __init__(self, n: int, bits: int, top: int, low, high, rank):
        """top: the upper part of the last member."""
        self.n, self.bits, self.top, self.low, self.high, self.rank = n, bits, top, low, high, rank

    @classmethod
    def of(cls, x: np.ndarray) -> EliasFano:
        n = len(x)
        top = int(x[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        i = np.arange(n, dtype=U)
        low = np.zeros(n * bits // 64 + 2, U)
        if bits and n:
            at = i * U(bits)
            value = x & U((1 << bits) - 1)
            word, off = (at >> U(6)).astype(np.int64), at & U(63)
            np.bitwise_or.at(low, word, value << off)
            over = off + U(bits) > U(64)
            np.bitwise_or.at(low, word[over] + 1, value[over] >> (U(64) - off[over]))
        ones = (x >> U(bits)) + i
        high = np.zeros((int(ones[-1]) >> 6) + 2 if n else 1, U)
        if n:
            np.bitwise_or.at(high, (ones >> U(6)).astype(np.int64), U(1) << (ones & U(63)))
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, bits, int(x[-1]) >> bits if n else 0, low, high, rank)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The i-th members."""
        word = np.searchsorted(self.rank, i, "right") - 1
        place = _selected(self.high[word], i - self.rank[word])
        high = (word * 64 + place - i).astype(U) << U(self.bits)
        return high | self._low(i) if self.bits else high

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The lower bits of the i-th members."""
        if not self.bits:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.bits)
        word, off = (at >> U(6)).astype(np.int64), at & U(63)
        low = self.low[word] >> off
        over = np.flatnonzero(off + U(self.bits) > U(64))
        low[over] |= self.low[word[over] + 1] << (U(64) - off[over])
        return low & U((1 << self.bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th zero of the high bits stands."""
        zeros = np.arange(len(self.rank)) * 64 - self.rank
        word = np.searchsorted(zeros, k, "right") - 1
        r, x = k - zeros[word], ~self.high[np.minimum(word, len(self.high) - 1)]
        return word * 64 + _selected(x, r)

    def _run(self, at: np.ndarray) -> np.ndarray:
        """How many ones follow each other in the high bits from a place on."""
        out = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            place = at[open_] + out[open_]
            off = (place & 63).astype(U)
            word = ~(self.high[np.minimum(place >> 6, len(self.high) - 1)] >> off)
            with np.errstate(over="ignore"):
                ones = np.minimum(np.bitwise_count((word & (~word + U(1))) - U(1)), 64 - (place & 63))
            out[open_] += ones
            open_ = open_[(ones == 64 - (place & 63)) & (place + ones < 64 * len(self.high))]
        return out

    def successor(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value, the first place in lo..hi whose member is no less (hi if there is none), and whether it is equal.

        The high bits say which few members share the value's upper part; of those only the lower bits are compared.
        """
        if not self.n:
            return hi.copy(), np.zeros(len(value), bool)
        top = (value >> U(self.bits)).astype(np.int64)
        most = int(self.top)
        inside = np.minimum(top, most)
        at = np.where(inside > 0, self._zero(np.maximum(inside - 1, 0)) + 1, 0)  # where the bits of that part begin
        first = at - inside
        last = np.minimum(first + self._run(at), self.n)
        first = np.where(top > most, self.n, first)
        last = np.where(top > most, self.n, last)
        lo = np.minimum(np.maximum(lo, first), hi)
        end = np.maximum(np.minimum(hi, last), lo)
        below = value & U((1 << self.bits) - 1)
        stop = end.copy()
        open_ = np.flatnonzero(lo < end)
        while len(open_):
            mid = (lo[open_] + end[open_]) >> 1
            less = self._low(mid) < below[open_]
            lo[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < end[open_]]
        equal = lo < stop
        equal[equal] = self._low(lo[equal]) == below[equal]
        return lo, equal


_ONES, _HIGHS = U(0x0101010101010101), U(0x8080808080808080)
#: Of each byte, the place of its r-th set bit.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def _selected(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th set bit of each word: bytes' running sums of bits tell the byte, a table the bit in it."""
    r = r.astype(U)
    with np.errstate(over="ignore"):
        s = x - ((x >> U(1)) & U(0x5555555555555555))
        s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
        s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES
        shift = np.bitwise_count(((r * _ONES | _HIGHS) - s) & _HIGHS).astype(U) << U(3)
    shift = np.minimum(shift, U(56))
    before = ((s << U(8)) >> shift) & U(255)
    return (shift + _IN_BYTE[((x >> shift) & U(255)).astype(np.int64), ((r - before) & U(7)).astype(np.int64)]).astype(np.int64)


class Trie:
    """n-grams of one order: contexts, pointers to their words, words relative to their contexts, quantised probabilities."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, words: EliasFano, codes: np.ndarray, word_bits: int):
        self.contexts, self.pointers, self.words, self.codes, self.word_bits = contexts, pointers, words, codes, word_bits

    @classmethod
    def of(cls, key: np.ndarray, codes: np.ndarray, word_bits: int) -> Trie:
        """key: ascending, a context's bits above a word's; codes: quantised probabilities."""
        context, word = key >> U(word_bits), key & U((1 << word_bits) - 1)
        new = np.flatnonzero(np.diff(context, prepend=~context[:1]) != 0) if len(key) else np.zeros(0, np.int64)
        place = np.zeros(len(key), U)
        place[new[1:]] = 1
        return cls(EliasFano.of(context[new]), EliasFano.of(np.append(new, len(key)).astype(U)), EliasFano.of((np.cumsum(place, dtype=U) << U(word_bits)) | word), codes, word_bits)

    def arrays(self):
        for part in (self.contexts, self.pointers, self.words):
            for f in EliasFano.FIELDS:
                yield part, f, getattr(part, f)
        yield self, "codes", self.codes

    def mapped(self, path: str) -> Trie:
        """The same with all levels in a file that is mapped into memory."""
        with open(path, "wb") as f:
            spots = []
            for owner, name, a in self.arrays():
                f.write(b"\0" * (-f.tell() % 8))
                spots.append((owner, name, a.dtype, a.shape, f.tell()))
                f.write(a.tobytes())
        for owner, name, kind, shape, at in spots:
            setattr(owner, name, np.asarray(np.memmap(path, kind, "r", at, shape)) if shape[0] else np.zeros(0, kind))
        return self

    def find(self, key: np.ndarray) -> np.ndarray:
        """The code of each key (ascending), 0 where there is none."""
        out = np.zeros(len(key), np.uint16)
        if not self.contexts.n or not len(key):
            return out
        context = key >> U(self.word_bits)
        new = np.concatenate([[True], context[1:] != context[:-1]])
        asked = context[new]  # each context is searched for once
        start = np.zeros(len(asked), np.int64)
        c, there = self.contexts.successor(asked, start, start + self.contexts.n)
        lo, hi = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        lo[there], hi[there] = self.pointers[c[there]].astype(np.int64), self.pointers[c[there] + 1].astype(np.int64)
        of = np.cumsum(new) - 1
        at = np.flatnonzero(there[of])
        value = (c[of[at]].astype(U) << U(self.word_bits)) | (key[at] & U((1 << self.word_bits) - 1))
        w, ok = self.words.successor(value, lo[of[at]], hi[of[at]])
        out[at[ok]] = self.codes[w[ok]]
        return out


def quantised(p: np.ndarray) -> np.ndarray:
    """A probability's logarithm in steps of 1 / STEPS of an octave, from 1 up; 0 is kept for none."""
    return (1 + np.rint(-STEPS * np.log2(p))).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return np.exp2((1.0 - code) / STEPS)


@dataclass(frozen=True)
class Corpus:
    """Of the training texts: V different tokens, N tokens, and how many texts there are."""

    v: int
    n: int
    texts: int

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.n + 0.1 * (self.v + 1))

    def types(self, count: np.ndarray) -> np.ndarray:
        """How many different words follow a context that was seen so often, by Heaps' law."""
        power = math.log(self.v) / math.log(self.n) if self.v > 1 else 0.5
        return np.power(count.astype(float), power)

    def backoff(self, count: np.ndarray) -> np.ndarray:
        """The weight that a context leaves to the order below; 1 where it was never seen."""
        t = self.types(count)
        return np.where(count > 0, t / np.maximum(count + t, 1e-300), 1.0)

    def smoothed(self, count: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P of n-grams seen count times, after contexts seen so often, with the probability of the order below."""
        t = self.types(seen)
        return (count + t * lower) / (seen + t)


class Tokens:
    """The tokens of a batch, an end after each text, with the keys of the n-grams that end at them."""

    def __init__(self, t: pa.Table, bits: int):
        w = Words([None if x is None else x.lower() for x in t.column("text").to_pylist()])
        self.bits, self.n = bits, w.n + 1
        self.token = np.insert(w.hash, w.first[1:], END)
        self.doc = np.repeat(np.arange(len(w.raw)), self.n)
        self.place = np.arange(len(self.token)) - (np.cumsum(self.n) - self.n)[self.doc]

    def key(self, level: int) -> np.ndarray:
        """Of the n-gram of level + 1 tokens that ends at each token."""
        if not level:
            return self.token
        context = np.zeros(len(self.token), U)
        with np.errstate(over="ignore"):
            for back in range(1, level + 1):
                before = np.full(len(self.token), START, U)
                before[back:] = np.where(self.place[back:] >= back, self.token[:-back], START)
                context = mixed(context * U(0x9E3779B97F4A7C15) + before)
            word = mixed(self.token + context * U(0xD6E8FEB86659FD93))
        word_bits = self.bits - CONTEXT_BITS
        return ((context >> U(64 - CONTEXT_BITS)) << U(word_bits)) | (word >> U(64 - word_bits))

    def distinct(self, level: int):
        """The distinct keys, where each of them is, and which one each token has."""
        key = self.key(level)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        return key[new], order[new], which

    def context(self, count: np.ndarray, texts: int) -> np.ndarray:
        """How often each token's context was seen, from how often the n-grams of the order below were."""
        out = np.full(len(count), texts, np.int64)
        out[1:] = np.where(self.place[1:] == 0, texts, count[:-1])
        return out


class Unigrams(exchange.Rule):
    """Words: exact counts; totals are V, N and how many texts there are."""

    fields, gives = {"count": exchange.COUNT}, {"count": exchange.COUNT}

    def combine(self, group, n, own):
        return {"count": np.bincount(group, own["count"], n).astype(np.int64)}

    def answer(self, key, held):
        return {"count": held["count"]}

    def totals(self, key, held):
        return np.array([(held["count"] > 0).sum(), held["count"].sum(), held["count"][key == END].sum()])


class Ngrams(exchange.Rule):
    """Longer n-grams: codes of the trie's smoothed probabilities, and exact counts where they are contexts of another order."""

    fields = {"count": exchange.COUNT, "seen": exchange.COUNT, "lower": exchange.COUNT}

    def __init__(self, corpus: Corpus, word_bits: int, last: bool):
        self.corpus, self.word_bits = corpus, word_bits
        self.gives = {"code": exchange.COUNT} | ({} if last else {"count": exchange.COUNT})

    def combine(self, group, n, own):
        out = {"count": np.bincount(group, own["count"], n).astype(np.int64)}
        for f in ("seen", "lower"):  # alike wherever they are known
            out[f] = np.zeros(n, np.int64)
            np.maximum.at(out[f], group, own[f])
        return out

    def answer(self, key, held):
        known = held["count"] > 0
        codes = quantised(self.corpus.smoothed(held["count"][known], held["seen"][known], restored(held["lower"][known])))
        with tempfile.TemporaryDirectory() as folder:
            code = Trie.of(key[known], codes, self.word_bits).mapped(os.path.join(folder, "level")).find(key)
        return {"code": code.astype(np.int64), "count": held["count"]}


def _known(k: Tokens, level: int, answers: dict[int, bytes], rule: exchange.Rule, fan: int) -> dict[str, np.ndarray]:
    """What was answered, of each token."""
    key, _, which = k.distinct(level)
    return {f: x[which] for f, x in exchange.collected(key, answers, rule, fan).items()}


def _learned(t: pa.Table, k: Tokens) -> np.ndarray:
    return (~np.array(t.column("held_out").to_pylist(), bool))[k.doc]


def _ask_words(bits: int):
    def ask(t):
        k = Tokens(t, bits)
        key, _, which = k.distinct(0)
        return key, {"count": np.bincount(which, _learned(t, k), len(key)).astype(np.int64)}

    return ask


def _ask_ngrams(level: int, bits: int, corpus: Corpus, below: exchange.Rule, fan: int):
    """Asks about the n-grams of an order, given what was answered about the one below."""

    def ask(t, answers):
        k = Tokens(t, bits)
        got = _known(k, level - 1, answers, below, fan)
        lower = quantised(corpus.unigram(got["count"])) if level == 1 else got["code"]
        seen = k.context(got["count"], corpus.texts)
        key, first, which = k.distinct(level)
        count = np.bincount(which, _learned(t, k), len(key)).astype(np.int64)
        # Only n-grams of training texts have all this; of equal ones, one that is learned would say the same.
        tell = lambda x: np.where(count > 0, x[first].astype(np.int64), 0)
        return key, {"count": count, "seen": tell(seen), "lower": tell(lower)}

    return ask


def _scores(t: pa.Table, answers: list[dict[int, bytes]], bits: int, corpus: Corpus, rules: list, fans: list[int]):
    k = Tokens(t, bits)
    docs = len(k.n)
    got = _known(k, 0, answers[0], rules[0], fans[0])
    known = np.bincount(k.doc, got["count"] > 0, docs).astype(np.int64)
    p = corpus.unigram(got["count"])
    low = np.bincount(k.doc, np.log10(p), docs)
    for level in range(1, len(rules)):
        back = corpus.backoff(k.context(got["count"], corpus.texts))
        got = _known(k, level, answers[level], rules[level], fans[level])
        p = np.where(got["code"] > 0, restored(got["code"]), back * p)
    return k.n, known, low, np.bincount(k.doc, np.log10(p), docs)


def scored(docs: DataFrame, order: int = 3, batch_bytes: int = 6 << 20, shard_bytes: int = 16 << 20, fanout: int = exchange.FANOUT) -> DataFrame:
    """docs has doc_id, text and held_out; learns from the others, scores all: see op1_ngram_lm for the columns."""
    batches = exchange.packed(docs, ("doc_id", "held_out"), batch_bytes)
    bits, shards = batches.key_bits, exchange.shards_for(batches, shard_bytes)
    fan = exchange.fans(shards, fanout)[0]
    rules: list[exchange.Rule] = [Unigrams()]
    answers = [exchange.exchanged(batches, _ask_words(bits), rules[0], shards, "words", fanout=fanout)]
    corpus = Corpus(*exchange.totals(answers[0], 3))
    for level in range(1, order):
        ask = _ask_ngrams(level, bits, corpus, rules[-1], fan)
        rules.append(Ngrams(corpus, bits - CONTEXT_BITS, level == order - 1))
        asking = exchange.joined(batches.rows, told=answers[-1])
        answers.append(exchange.exchanged(batches, ask, rules[-1], shards, f"ngrams{level + 1}", asking, ("told",), fanout))
    names = [f"a{i}" for i in range(order)]

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                t = exchange.opened(b.column("block")[i].as_py())
                tokens, known, low, high = _scores(t, [exchange.answer_of(b.column(a)[i]) for a in names], bits, corpus, rules, [fan] * order)
                columns = [t.column("doc_id").combine_chunks(), t.column("held_out").combine_chunks(), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(np.full(len(tokens), corpus.n)), pa.array(low), pa.array(high)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return exchange.joined(batches.rows, **dict(zip(names, answers))).select("block", *names).mapInArrow(run, fields)


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    docs = base.read(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (base.crc_mod("doc_id", 10) == 0).alias("held_out"))
    return scored(docs)
