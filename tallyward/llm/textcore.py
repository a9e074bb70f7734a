"""Vectorised numpy work on whole batches of texts: words, hashes, statistics.

A text is handled as UTF-8 bytes. Words are runs of bytes other than space and 0x09-0x0D, which is what
``bytes.split()`` gives. A null text counts as empty.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        return _mixed(x.astype(np.uint64, copy=False))


#: One random number for each byte value at each of 32 places of a word.
TABLE = mixed(np.arange(1, 32 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FAR = np.uint64(0xD6E8FEB86659FD93)
STEP = np.uint64(0x9E3779B97F4A7C17)


def run_hash(buf: np.ndarray, start: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """64 bits for each run of bytes from one start to the next: random numbers by byte and place, summed and scrambled.

    Runs go through in parts of about ``most`` bytes, whose intermediate arrays are small.
    """
    out = np.empty(len(start), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(buf), most)), len(start))).tolist()
    for lo, hi in zip(cuts, cuts[1:]):
        part = buf[start[lo] : start[hi] if hi < len(start) else len(buf)]
        out[lo:hi] = _run_hash(part, start[lo:hi] - start[lo])
    return out


def _run_hash(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    size = np.diff(start, append=len(buf))
    place = np.arange(len(buf)) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        part = TABLE[((place & 31) << 8) + buf]
        if len(far := np.flatnonzero(place >= 32)):
            part[far] *= np.power(FAR, (place[far] >> 5).astype(np.uint64))
        return _mixed(np.add.reduceat(part, start) + size.astype(np.uint64))


class Words:
    """The words of a batch of texts.

    buf: all texts, each ended by a line feed; at: where each text starts in it (and the end);
    start, end: of each word in buf; doc: the text of each word; first: the first word of each text (and the end).
    """

    def __init__(self, texts):
        parts = [b"" if t is None else t if isinstance(t, bytes) else t.encode() for t in texts]
        self.raw = parts
        self.data = b"\n".join(parts) + b"\n" if parts else b""
        self.buf = np.frombuffer(self.data, np.uint8)
        self.at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=self.at[1:])
        self.solid = ~SPACE[self.buf]
        edge = np.diff(self.solid.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self._hash = None

    @property
    def n(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        """64 bits for each word: a sum of random numbers by byte and place, scrambled."""
        if self._hash is None:
            size = self.end - self.start
            self._hash = run_hash(self.buf[self.solid], np.cumsum(size) - size)
        return self._hash

    def windows(self, k: int, again: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each k consecutive words, by first word, and whether they lie in one text (a rolling polynomial).

        again: a second hash, of the words' hashes scrambled once more.
        """
        n = max(0, len(self.doc) - k + 1)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        up, down = _powers(len(self.doc))
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed(self.hash ^ FAR) if again else self.hash) * up, dtype=np.uint64)])
            h = _mixed((run[k:] - run[:-k]) * down[:n])
        return h, self.doc[:n] == self.doc[k - 1 :]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    global _UP, _DOWN
    if len(_UP) < n:
        with np.errstate(over="ignore"):
            _UP = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, STEP)]))
            _DOWN = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(STEP), -1, 1 << 64)))]))
    return _UP[:n], _DOWN[:n]


_UP = _DOWN = np.ones(1, np.uint64)


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over the bytes of each text."""
    return np.add.reduceat(values, at[:-1], dtype=np.int64) if len(at) > 1 else np.zeros(0, np.int64)


def per_doc(words: Words, mask: np.ndarray) -> np.ndarray:
    """How many of the marked words each text has."""
    return np.bincount(words.doc[: len(mask)][mask], minlength=len(words.raw))


def repeated(key: np.ndarray) -> np.ndarray:
    """Marks each entry whose key is there twice or more."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
DIGIT = _table(bytes(range(48, 58)))
LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)))
POINT = (np.arange(256) & 0xC0 != 0x80).astype(np.uint8)
POINT_IN_WORD = POINT * ~SPACE
STOP = _table(b".!?")
#: Columns of doc_stats(); the first five are exact counts that callers publish.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_points", "n_upper", "n_digits", "n_letters", "n_lines", "n_distinct", "n_stops", "longest_word")


def doc_stats(texts) -> np.ndarray:
    """STATS of each text as a float array (all counts are exact)."""
    w = Words(texts)
    d = len(w.raw)
    out = np.zeros((d, len(STATS)))
    if not d:
        return out
    out[:, 0] = w.n
    for c, table in ((1, POINT_IN_WORD), (2, SYMBOL), (5, POINT), (6, UPPER), (7, DIGIT), (8, LETTER), (11, STOP)):
        out[:, c] = per_text(table[w.buf], w.at)
    out[:, 5] -= 1  # the added line feed
    for i, raw in enumerate(w.raw):
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[i, 9] = len(lines)
        out[i, 3] = len(lines) - len(set(lines))
    if len(w.doc):
        salt = mixed(w.doc.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key := w.hash ^ salt)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        out[:, 10] = np.bincount(w.doc[order][new], minlength=d)
        some = w.n > 0
        out[some, 12] = np.maximum.reduceat(w.end - w.start, w.first[:-1][some])
        h, ok = w.windows(3)
        at = np.flatnonzero(ok)
        again = at[repeated(h[at] ^ salt[at])]
        cover = np.zeros(len(w.doc), bool)
        for j in range(3):
            cover[again + j] = True
        out[:, 4] = per_doc(w, cover)
    return out


def slices(texts, ids, most: int = 4 << 20):
    """(texts, ids) in runs of about this many bytes at most; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > most:
            yield texts[at:i], ids[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield texts[at:], ids[at:]
