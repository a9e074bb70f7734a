"""The wire format of uploads: cells of a 32-bit index and a 32-bit float, little-endian, under AES-128 in counter mode.

A codec only: the key is a function of the client id and the counter starts at zero every time, so it keeps nothing
secret.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CELL = 8


def client_key(client_id) -> Column:
    """Four zero bytes, the id in four big-endian bytes, eight zero bytes."""
    return F.unhex(F.concat(F.lit("00000000"), F.lpad(F.hex(client_id), 8, "0"), F.lit("0" * 16)))


def keystream(key, blocks, counter: int = 0) -> Column:
    """Encrypted consecutive 16-byte big-endian counters (and a block of padding): that is counter mode's stream.

    Counters are numbers of 128 bits that wrap, added up in four words of 32 bits with their carries.
    """
    words = [counter >> 32 * k & 0xFFFFFFFF for k in range(4)]  # the lowest first

    def at(i):
        carry, out = i, []
        for w in words:
            total = F.lit(w).cast("long") + carry
            out.append(F.lpad(F.hex(total.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
            carry = F.shiftright(total, 32)
        return F.concat(*reversed(out))

    counters = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), at)
    return F.aes_encrypt(F.unhex(F.array_join(counters, "")), key, F.lit("ECB"), F.lit("PKCS"))


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values end to end, and where each begins; nulls are empty."""
    a = a.cast(pa.binary())
    ends = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset).astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] else np.zeros(0, np.uint8)
    return data, ends


def _binary(data: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.array(~null).buffers()[1], pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


@F.arrow_udf(BinaryType())
def _xor(data: pa.Array, stream: pa.Array) -> pa.Array:
    """Byte by byte over a whole batch; a value takes as much of its stream as it is long."""
    a, at = _bytes(data)
    b, first = _bytes(stream)
    null = data.is_null().to_numpy(zero_copy_only=False) | stream.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(null, 0, np.diff(at))
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _binary(a[np.repeat(at[:-1], sizes) + inside] ^ b[np.repeat(first[:-1], sizes) + inside], sizes, null)


def xored(data, stream) -> Column:
    """Bytes xor those of a stream that is at least as long."""
    return _xor(data, stream)


def crypted(data, client_id) -> Column:
    """Encrypts or decrypts (it is its own inverse) the bytes of a client."""
    blocks = F.greatest(F.ceil(F.length(data) / F.lit(16)), F.lit(1)).cast("long")
    return _xor(data, keystream(client_key(client_id), blocks))


@F.arrow_udf(BinaryType())
def pack_cells(cells: pa.Array) -> pa.Array:
    """array<struct<idx: bigint, value: float>> to bytes, in the given order, over a whole batch."""
    null = cells.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(null, 0, pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))
    flat = cells.flatten()
    out = np.empty(len(flat), np.dtype([("i", "<u4"), ("v", "<f4")]))
    out["i"], out["v"] = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    return _binary(np.frombuffer(out.tobytes(), np.uint8), sizes * CELL, null)


def encoded_dense(updates: DataFrame, d: int, keys: tuple[str, ...] = ("fl_id", "round", "client_id")) -> DataFrame:
    """(keys, payload): the dense vector of each client as d cells of index and value in order, 0 where it sent nothing;
    repeated cells add up. decoded() reads it."""
    cells = updates.where((F.col("idx") >= 0) & (F.col("idx") < d)).groupBy(*keys, "idx").agg(F.sum("value").alias("value"))
    sparse = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("value").cast("float").alias("value")))).alias("c"))
    at, zero = F.transform("c", lambda x: x["idx"]), F.lit(0.0).cast("float")
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1).cast("long")), at).alias("a"), F.concat(at, F.array(F.lit(d).cast("long"))).alias("b"), F.concat(F.transform("c", lambda x: x["value"]), F.array(zero)).alias("v"))
    runs = F.transform(ends, lambda p: F.concat(F.array_repeat(zero, (p["b"] - p["a"] - 1).cast("int")), F.array(p["v"])))
    whole = F.transform(F.slice(F.flatten(runs), 1, d), lambda v, i: F.struct(i.cast("long").alias("idx"), v.alias("value")))
    return sparse.select(*keys, pack_cells(whole).alias("payload"))


def encoded(updates: DataFrame, keys: tuple[str, ...] = ("fl_id", "round", "client_id"), order: str = "idx") -> DataFrame:
    """(keys, payload): the cells of each client, by index (or in the order of another column)."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("float").alias("value"))))
    return updates.groupBy(*keys).agg(cells.alias("c")).select(*keys, pack_cells(F.transform("c", lambda x: F.struct(x["idx"], x["value"]))).alias("payload"))


def _u32(hexed) -> Column:
    """Eight hex digits, low byte first, as a number."""
    swapped = F.concat(F.substring(hexed, 7, 2), F.substring(hexed, 5, 2), F.substring(hexed, 3, 2), F.substring(hexed, 1, 2))
    return F.conv(swapped, 16, 10).cast("long")


def float_of(bits) -> Column:
    """The number that 32 bits stand for, subnormals, infinities and NaN included."""
    sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
    power = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    part = bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
    normal = (1.0 + part / 2.0**23) * F.pow(F.lit(2.0), (power - 127).cast("double"))
    special = F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(power == 0, part / 2.0**23 * 2.0**-126).when(power == 255, special).otherwise(normal)


def decoded(payloads: DataFrame, keys: tuple[str, ...] = ("fl_id", "round", "client_id")) -> DataFrame:
    """(keys, idx, value) from the bytes, with built-in functions only; a torn last cell is left out."""
    hexed = F.hex("payload")
    n = F.floor(F.length("payload") / F.lit(CELL)).cast("int")
    cells = payloads.where(n > 0).select(*keys, hexed.alias("_h"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
    cell = F.substr("_h", F.col("_i") * 16 + 1, F.lit(16))
    cells = cells.select(*keys, _u32(F.substring(cell, 1, 8)).alias("idx"), _u32(F.substring(cell, 9, 8)).alias("_b"))
    return cells.select(*keys, "idx", float_of(F.col("_b")).alias("value"))
