"""Token counts of whole texts, huge ones through overlapping chunks that are spliced where both agree.

A text over ``chunk_chars`` is cut into chunks that overlap, and the tokenizer encodes each by itself, with the offsets
of its tokens and the words (units of its pre-tokenizer) that they belong to. Near a torn edge a chunk's tokens may be
wrong, so two neighbours are spliced at a boundary that both of them prove: a word that begins at the same
place of the text, ends at the same place and has the same tokens in both, away from either edge, between two ASCII
characters. Up to there the left chunk is right, since what follows can't reach back over the words in between; from there on the right one
is, since a pre-tokenizer goes from left to right and a word is encoded by itself. Where no boundary is proven the overlap is doubled, and
then the left chunk itself grows, up to the whole rest of the text; so a tokenizer without words of its own gets the
text in one piece.

Shorter texts are encoded whole. Where the tokenizer's own description shows that it drops white space and never reads
past it, that comes to the same as encoding each unit between ASCII white space, and a unit's number of tokens is
remembered within a bounded memory; without such a description every text goes to the library.

Defined cases: a null or empty text has no bytes and no tokens; bytes that aren't UTF-8 count as U+FFFD; repeated
rows and ids are counted each by itself; columns beside those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .textcore import Words

#: Normalisers that change no character by what stands on the other side of an ASCII white space.
_LOCAL = {"NFC", "NFD", "Lowercase"}
#: Joined by each kind of ASCII white space, these must give what they give apart.
_PROBES = ("word", "Word's", "'s", "1", "12a", ".", "...!", "\u0301", "é", "가", "Σ", "<|endoftext|>", "a<|startoftext|>b", "ßİ", "\u200d", "\u3000x", "\x1c", "\x85y")

#: Characters next to a torn edge that no boundary may lie in, and words whose ends another could still change.
EDGE_CHARS, EDGE_WORDS = 16, 2


class Chunk:
    """text[start:end], encoded: where its words begin and end in the text, and which tokens they have."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        e = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.tokens = start, end, len(e.ids)
        self.ids = np.array(e.ids, np.int64)
        word = np.array([-1 - i if w is None else w for i, w in enumerate(e.word_ids)], np.int64)
        self.first = np.flatnonzero(np.diff(word, prepend=word[:1] - 1) != 0) if len(word) else np.zeros(0, np.int64)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2) + start
        self.begin = spans[self.first, 0]
        self.last = np.append(self.first, len(word))[1:]
        self.finish = spans[self.last - 1, 1]

    def stable(self, text: str) -> np.ndarray:
        """Which words neither edge can have changed; at the ends of the text nothing is torn."""
        ok = np.ones(len(self.first), bool)
        if self.start > 0:
            ok &= self.begin >= self.start + EDGE_CHARS
        if self.end < len(text):
            ok &= self.finish <= self.end - EDGE_CHARS
            ok[max(0, len(ok) - EDGE_WORDS) :] = False
        return ok

    def token_at(self, place: int) -> int | None:
        """The number of tokens before the word that begins at a place of the text."""
        at = np.flatnonzero(self.begin == place)
        return int(self.first[at[0]]) if len(at) == 1 else None


def common(left: Chunk, right: Chunk, text: str, after: int) -> int | None:
    """A place after another where a word begins that both chunks prove; of several, the one in the middle."""
    ours, theirs = np.flatnonzero(left.stable(text) & (left.begin > after)), np.flatnonzero(right.stable(text))
    places, i, j = np.intersect1d(left.begin[ours], right.begin[theirs], return_indices=True)
    found = []
    for place, a, b in zip(places.tolist(), ours[i].tolist(), theirs[j].tolist()):
        alike = left.finish[a] == right.finish[b] and np.array_equal(left.ids[left.first[a] : left.last[a]], right.ids[right.first[b] : right.last[b]])
        if alike and text[place - 1 : place + 1].isascii() and left.token_at(place) is not None and right.token_at(place) is not None:
            found.append(place)
    return found[len(found) // 2] if found else None


def drops_space(description: dict) -> bool:
    """Whether a tokenizer's tokens are matches of a pattern without white space, in text that is normalised locally."""
    listed = lambda x, inner: x[inner] if x and x["type"] == "Sequence" else [x] if x else []
    for n in listed(description.get("normalizer"), "normalizers"):
        if n["type"] not in _LOCAL and not (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "):
            return False
    split = (listed(description.get("pre_tokenizer"), "pretokenizers") or [{"type": None}])[0]
    matches = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]
    added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["content"].split() != [a["content"]]) for a in description.get("added_tokens", []))
    return bool(matches and added and "(?" not in split["pattern"]["Regex"] and r"[^\s" in split["pattern"]["Regex"])


class Counter:
    """Counts the tokens of texts as a tokenizer file of the tokenizers library gives them.

    memory: bytes of remembered units, with what a dictionary takes for each; longer units than ``longest`` aren't.
    """

    def __init__(self, path: str, chunk_chars: int = 1 << 16, overlap_chars: int = 1 << 10, memory: int = 64 << 20, longest: int = 256):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap, self.memory, self.longest = chunk_chars, overlap_chars, memory, longest
        self.seen: dict[bytes, int] = {}
        self.held = 0
        whole = lambda t: len(self.tokenizer.encode(t, add_special_tokens=False).ids)
        self.apart = drops_space(json.loads(self.tokenizer.to_str())) and all(whole(a + gap + b) == whole(a) + whole(b) for a in _PROBES for b in _PROBES for gap in (" ", "\n", "\t\r", "\x0b\x0c"))

    def huge(self, text: str) -> int:
        """The tokens of a long text, from overlapping chunks."""
        n = len(text)
        left = Chunk(self.tokenizer, text, 0, min(n, self.chunk))
        total, splice, taken = 0, 0, 0  # tokens counted; where the last splice is; tokens of this chunk before it
        while left.end < n:
            overlap, place = self.overlap, None
            while place is None:
                lo = max(left.start + 1, left.end - overlap)
                right = Chunk(self.tokenizer, text, lo, min(n, left.end + self.chunk - min(overlap, self.chunk // 2)))
                place = common(left, right, text, splice)
                if place is None and lo == left.start + 1:
                    break
                overlap *= 2
            if place is None:  # nothing is proven within this chunk: take more text into it
                left = Chunk(self.tokenizer, text, left.start, min(n, left.end + max(self.chunk, left.end - left.start)))
                taken = left.token_at(splice) if splice else 0
                if taken is None:  # not even the last splice stands
                    return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            total += left.token_at(place) - taken
            left, splice, taken = right, place, right.token_at(place)
        return total + left.tokens - taken

    def each(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[bytes]) -> np.ndarray:
        """The tokens of different units."""
        new = [u for u in units if u not in self.seen]
        got = dict(zip(new, self.each([u.decode("utf-8", "replace") for u in new])))
        out = np.fromiter((got[u] if u in got else self.seen[u] for u in units), np.int64, len(units))
        kept = {u: n for u, n in got.items() if len(u) <= self.longest}
        size = sum(map(len, kept)) + 150 * len(kept)
        if self.held + size > self.memory:
            self.seen.clear()
            self.held = 0
        if size <= self.memory:
            self.seen.update(kept)
            self.held += size
        return out

    def counts(self, texts) -> list[int]:
        texts = [t or b"" for t in texts]
        long = {i: whole for i, t in enumerate(texts) if len(t) > self.chunk and len(whole := t.decode("utf-8", "replace")) > self.chunk}
        short = [b"" if i in long else t for i, t in enumerate(texts)]
        if self.apart:
            w = Words(short)
            first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)[1:]
            units = [w.data[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist())]
            out = np.bincount(w.doc, self.units(units)[inverse], len(texts)).astype(np.int64).tolist()
        else:
            out = self.each([t.decode("utf-8", "replace") for t in short])
        for i, whole in long.items():
            out[i] = self.huge(whole)
        return out


_counters: dict[tuple, Counter] = {}


def counter(path: str, *sizes: int) -> Counter:
    """The counter of this process for a tokenizer file."""
    if (path, *sizes) not in _counters:
        _counters[(path, *sizes)] = Counter(path, *sizes)
    return _counters[(path, *sizes)]


def counted(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), chunk_chars: int = 1 << 16, overlap_chars: int = 1 << 10) -> DataFrame:
    """keep, n_bytes and n_tokens of each document."""

    def make():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        c = counter(path, chunk_chars, overlap_chars)
        return lambda texts: {"n_bytes": [len(t or b"") for t in texts], "n_tokens": c.counts(texts)}

    return base.map_texts(docs, make, "n_bytes long, n_tokens long", keep)


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    docs = base.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return counted(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
