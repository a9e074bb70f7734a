"""SentencePiece encoding and decoding with the place of every piece in the original bytes.

Normalisation is done here: at each place the longest key of the model's compiled character map (a double-array
trie over UTF-8) is replaced, white space is escaped, and every normalised byte remembers the source byte it comes
from. The normalised text is then segmented by the library through a copy of the model whose own normaliser is
switched off, so the ids are the library's, and the ends of the pieces project back to source bytes.

No piece of a vocabulary may hold a character followed by an escaped space; where that is so (it is checked), a text
falls apart before each run of spaces and around line feeds: each different unit of a slice of texts is segmented
once. Otherwise whole texts are segmented.

Defined cases: a null or empty text has no tokens; bytes that aren't UTF-8 count as U+FFFD; repeated rows and ids are encoded
each by itself; a huge text is a slice by itself; of map keys at one place the longest counts, so there are no ties; columns beside
those asked for are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .textcore import run_hash

SPACE = "▁"
_SPACE = SPACE.encode()


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        shift += 7
        if c < 128:
            return out, i


def fields(b: bytes):
    """(number, wire type, value, encoded field) of a protobuf message."""
    i = 0
    while i < len(b):
        start = i
        key, i = _varint(b, i)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield number, kind, value, b[start:i]


class CharMap:
    """A compiled character map: a double-array trie of keys, and NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = None, b""
        if len(blob) > 4:
            n = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
            self.texts = blob[4 + n :]

    def longest(self, b: bytes, i: int) -> tuple[int, bytes] | None:
        """The length of the longest key at b[i:], and what replaces it."""
        units = self.units
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        found = None
        for j in range(i, len(b)):
            node ^= b[j]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != b[j]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (j + 1 - i, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Codec:
    """A SentencePiece model read from its file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.pieces: list[tuple[bytes, int]] = []
        rest, normalizer = [], b""
        for number, _, value, raw in fields(model):
            if number == 1:
                piece = {k: v for k, _, v, _ in fields(value)}
                self.pieces.append((piece.get(1, b""), piece.get(3, 1)))
            if number == 3:
                normalizer = value
            else:
                rest.append(raw)
        spec = {k: v for k, _, v, _ in fields(normalizer)}
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        off = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"  # no prefix, no squeezing, no escaping
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + bytes([len(off)]) + off)
        plain = [p.decode("utf-8", "replace") for p, kind in self.pieces if kind in (1, 4, 5)]
        line = self.bare.encode("\n")
        self.line = line[0] if len(line) == 1 and self.pieces[line[0]][1] == 6 else -1
        self.splits = self.escape and self.line >= 0 and not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in plain)
        self.surface = [bytes([int(p[1:-1], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(_SPACE, b" ") for p, kind in self.pieces]
        self.length = np.array([len(b) for b in self.surface])
        self.kind = np.array([kind for _, kind in self.pieces])
        self.decimals = strings([b"%d," % i for i in range(len(self.pieces))])
        self.surfaces = strings(self.surface)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, spaces not escaped yet, and for each of them (and the end) the place in the source where it comes from."""
        source = text.encode()
        if not source:
            return b"", np.zeros(1, np.int64)
        if self.map.units is None and not self.squeeze and _SPACE not in source:
            a = np.frombuffer(source, np.uint8)
            head = b" " if self.prefix else b""
            return head + source, np.concatenate([np.zeros(len(head), np.int64), np.arange(len(a) + 1)])
        pairs: list[tuple[int, int]] = []
        i = 0
        while i < len(source):
            hit = self.map.longest(source, i) if self.map.units is not None else None
            n, new = hit or (1 if source[i] < 0x80 else 2 if source[i] < 0xE0 else 3 if source[i] < 0xF0 else 4, None)
            new = source[i : i + n] if new is None else new
            parts = new.split(_SPACE) if self.escape else [new]
            for k, part in enumerate(parts):
                pairs += [(256, i)] * (k > 0)  # the mark itself: a space from here on, but never squeezed
                pairs += [(c, i) for c in part]
            i += n
        if self.squeeze:  # no space at either end, none after another
            kept: list[tuple[int, int]] = []
            for c, at in pairs:
                if c == 32 and (not kept or kept[-1][0] == 32):
                    continue
                kept.append((c, at))
            end = len(source)
            while kept and kept[-1][0] == 32:
                end = kept.pop()[1]
            pairs = kept
        else:
            end = len(source)
        if not pairs:
            return b"", np.array([end])
        if self.prefix:
            pairs.insert(0, (32, pairs[0][1]))
        return bytes(32 if c == 256 else c for c, _ in pairs), np.array([*(i for _, i in pairs), end])

    def _starts(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where units start in joined normalised texts: at a text, at a run of spaces, at and after a line feed."""
        new = np.zeros(len(buf) + 1, bool)
        new[at] = True
        if self.splits:
            blank = buf == 32
            new[:-1] |= blank & ~np.concatenate([[False], blank[:-1]])
            line = buf == 10
            new[:-1] |= line
            new[1:] |= line
        return np.flatnonzero(new[:-1])

    def _segment(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all units one after another, the sizes of their pieces in unescaped bytes, the ids of each unit."""
        mark = _SPACE if self.escape else b" "
        texts = [u.replace(b" ", mark).decode("utf-8", "replace") for u in units]
        ids, sizes, count = [], [], np.zeros(len(units), np.int64)
        step = 2000 if self.splits else 1
        for lo in range(0, len(units), step):
            joined = "\n".join(texts[lo : lo + step])
            got = np.array(self.bare.encode(joined), np.int64)
            size = self.length[got] if len(got) else got
            if (self.kind[got] == 2).any():  # an unknown piece is as long as what it stands for
                size = np.array([len(p.encode()) - (len(mark) - 1) * p.count(mark.decode()) for p in self.bare.encode(joined, out_type=str)])
            if step > 1:
                cut = got == self.line
                count[lo : lo + step] = np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(got)]])) - 1
                got, size = got[~cut], size[~cut]
            else:
                count[lo] = len(got)
            ids.append(got)
            sizes.append(size)
        none = np.zeros(0, np.int64)
        return np.concatenate([*ids, none]), np.concatenate([*sizes, none]), count

    def batch(self, texts: list[bytes | None]):
        """Of all texts: the ids one after another, where each text's begin, the ends of the pieces in source bytes."""
        pairs = [self.normalise((t or b"").decode("utf-8", "replace")) for t in texts]
        data = b"".join([p[0] for p in pairs])
        at = np.cumsum([0] + [len(p[0]) for p in pairs])
        buf = np.frombuffer(data, np.uint8)
        start = self._starts(buf, at)
        n = len(start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), [np.zeros(0, np.int64) for _ in texts]
        first, inverse = np.unique(run_hash(buf, start), return_index=True, return_inverse=True)[1:]
        end = np.append(start[1:], len(buf))
        units = [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        lines = [i for i, u in enumerate(units) if u == b"\n"] if self.splits else []
        for i in lines:
            units[i] = b""
        ids, sizes, count = self._segment(units)
        if lines:  # the separator itself is a unit too
            k = int(count[: lines[0]].sum())
            ids, sizes = np.insert(ids, k, self.line), np.insert(sizes, k, 1)
            count[lines[0]] = 1
        begin = np.cumsum(count) - count
        reps = count[inverse]
        total = np.cumsum(reps)
        take = np.arange(int(total[-1])) + np.repeat(begin[inverse] - (total - reps), reps)
        ids, ends = ids[take], np.cumsum(sizes[take])
        bounds = np.append(0, total)[np.searchsorted(start, at)]
        spans = [p[1][ends[a:b] - o] for p, a, b, o in zip(pairs, bounds[:-1].tolist(), bounds[1:].tolist(), at[:-1].tolist())]
        return ids, bounds, spans

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """The ids, and the source bytes (start, end) that each piece covers."""
        ids, _, (ends,) = self.batch([text.encode()])
        ends = [0, *ends.tolist()]
        return ids.tolist(), list(zip(ends[:-1], ends[1:]))

    def decode(self, ids: list[int]) -> str:
        """The text of the pieces; runs of byte pieces become characters, or U+FFFD where they are none."""
        return self._text(b"".join([self.surface[i] for i in ids])).decode()

    def _text(self, joined: bytes) -> bytes:
        try:
            joined.decode()
        except UnicodeDecodeError:
            joined = joined.decode("utf-8", "replace").encode()
        return joined[1:] if self.prefix and joined.startswith(b" ") else joined

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The decoded text of each run of ids between two bounds, in UTF-8."""
        data = rendered(ids, *self.surfaces)
        at = np.append(0, np.cumsum(self.surfaces[2][ids]))[bounds].tolist()
        return [self._text(data[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]

    def digests(self, texts: list[bytes | None]) -> dict[str, list]:
        """Number of ids, and SHA-256 of the ids, of the decoded text and of the pieces' ends in source bytes."""
        ids, bounds, spans = self.batch(texts)
        numbers = rendered(ids, *self.decimals)
        digits = np.append(0, np.cumsum(self.decimals[2][ids]))[bounds]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {
            "n_tokens": np.diff(bounds),
            "ids_sha256": [sha(numbers[lo : max(lo, hi - 1)]) for lo, hi in zip(digits[:-1].tolist(), digits[1:].tolist())],
            "decoded_sha256": [sha(t) for t in self.decoded(ids, bounds)],
            "ends_sha256": [sha(e.astype("<i8").tobytes()) for e in spans],
        }


def strings(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as one array, with where each starts and how long it is."""
    size = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size


def rendered(ids: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> bytes:
    """The strings of the ids, one after another."""
    n = size[ids]
    return data[np.arange(int(n.sum())) + np.repeat(at[ids] - (np.cumsum(n) - n), n)].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this process for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 and ends_sha256 of each document."""

    def make():
        c = codec(path)

        return c.digests

    return base.map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string", keep)


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the ids, the end of each piece in source bytes, and the SHA-256 of the decoded text of each document."""
    import pyarrow as pa

    def make():
        c = codec(path)

        def run(texts):
            ids, bounds, spans = c.batch(texts)
            at = pa.array(bounds.astype(np.int32))
            ends = np.concatenate([*spans, np.zeros(0, np.int64)])
            return {
                "ids": pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())),
                "ends": pa.ListArray.from_arrays(at, pa.array(ends.astype(np.int32))).cast(pa.list_(pa.int32())),
                "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in c.decoded(ids, bounds)],
            }

        return run

    return base.map_texts(docs, make, "ids array<int>, ends array<int>, decoded_sha256 string", keep)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ends_sha256 of each document."""
    docs = base.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs, path or model_path())
