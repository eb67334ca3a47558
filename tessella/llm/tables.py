"""Sums of count tables over all tasks, without one task that gathers a row from each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4096
#: Chunks in a record batch, 4 MB.
BATCH = 128
SCHEMA = "name string, chunk long, counts binary"


def chunks(tables: dict[str, np.ndarray]):
    """Record batches (name, chunk, counts) of the non-zero chunks of flat int64 tables."""
    for name, table in tables.items():
        parts = [(i // CHUNK, table[i : i + CHUNK]) for i in range(0, len(table), CHUNK)]
        parts = [(i, x) for i, x in parts if x.any()]
        for i in range(0, len(parts), BATCH):
            some = parts[i : i + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([k for k, _ in some], pa.int64()), pa.array([np.ascontiguousarray(x, np.int64).tobytes() for _, x in some], pa.binary())], ["name", "chunk", "counts"])


def _sum(key, batches):
    total = None
    for batch in batches if hasattr(batches, "__next__") else batches.to_batches():
        for x in batch.column(batch.schema.get_field_index("counts")):
            part = np.frombuffer(x.as_py(), np.int64)
            total = part.copy() if total is None else total + part
    return pa.table({"name": [key[0].as_py()], "chunk": [key[1].as_py()], "counts": [total.tobytes()]}, schema=pa.schema([("name", pa.string()), ("chunk", pa.int64()), ("counts", pa.binary())]))


def summed(parts: DataFrame, salts: int = 16) -> dict[str, dict[int, np.ndarray]]:
    """The sums by name and chunk on the driver. Rows of a chunk are summed in salted groups first; the result's size is that of the tables."""
    first = parts.withColumn("_s", (F.spark_partition_id() % salts).cast("long")).groupBy("name", "chunk", "_s").applyInArrow(_sum, SCHEMA)
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in first.groupBy("name", "chunk").applyInArrow(_sum, SCHEMA).toLocalIterator():
        out.setdefault(r["name"], {})[r["chunk"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out


def whole(found: dict[int, np.ndarray], size: int) -> np.ndarray:
    table = np.zeros(size, np.int64)
    for i, x in found.items():
        table[i * CHUNK : i * CHUNK + len(x)] = x
    return table


#: Bits of a bitmap of hashes, whatever their number.
MAP_BITS = 26


def _packed(batches):
    """part, on (places below 4096) -> part, bits (512 bytes)."""
    for batch in batches:
        bits = np.zeros((batch.num_rows, 4096), np.uint8)
        lists = batch.column(1)
        bits[np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["part", "bits"])


def bitmap(df: DataFrame, h: Column) -> bytes:
    """A map of 2**MAP_BITS bits (8 MB) with the bit of each 64-bit hash set, by its high bits."""
    slot = F.shiftrightunsigned(h, 64 - MAP_BITS)
    parts = df.select(slot.alias("slot")).groupBy(F.expr("slot div 4096").alias("part")).agg(F.collect_set(F.expr("cast(slot % 4096 as int)")).alias("on"))
    bits = np.zeros(((1 << MAP_BITS) // 4096, 512), np.uint8)
    got = parts.mapInArrow(_packed, "part long, bits binary").toArrow()
    if got.num_rows:
        bits[got.column("part").to_numpy()] = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(-1, 512)
    return bits.tobytes()


def in_bitmap(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (uint64) is set."""
    slot = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return ((np.frombuffer(bits, np.uint8)[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)


#: Counters in a chunk of a packed table.
PACK = 1 << 16
PACKED = "chunk long, counts binary"


def packed(table: np.ndarray):
    """Record batches (chunk, counts) of the non-zero chunks of a flat uint32 table, compressed."""
    for i in range(0, len(table), PACK):
        if (part := table[i : i + PACK]).any():
            yield pa.RecordBatch.from_arrays([pa.array([i // PACK], pa.int64()), pa.array([_close(part)], pa.binary())], ["chunk", "counts"])


def _close(part: np.ndarray) -> bytes:
    """Bytes of a counter, then the counters in so many, compressed."""
    kind = np.min_scalar_type(int(part.max()))
    return bytes([kind.itemsize]) + pa.compress(part.astype(kind).tobytes(), "zstd", asbytes=True)


def _open(counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts[1:], counts[0] * PACK, "zstd", asbytes=True), f"u{counts[0]}").astype(np.uint32)


def _merge(key, table):
    total = np.zeros(PACK, np.uint64)
    for x in table.column("counts"):
        total += _open(x.as_py())
    sums = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pa.table({"chunk": [key[0].as_py()], "counts": [_close(sums)]}, schema=pa.schema([("chunk", pa.int64()), ("counts", pa.binary())]))


def unpacked(parts: DataFrame, size: int, salts: int = 4) -> np.ndarray:
    """The sum of packed tables of `size` counters (a multiple of PACK) on the driver; rows of a chunk are summed in salted groups first."""
    first = parts.withColumn("_s", (F.spark_partition_id() % salts).cast("long")).groupBy("chunk", "_s").applyInArrow(_merge, PACKED)
    out = np.zeros(size, np.uint32)
    for r in first.groupBy("chunk").applyInArrow(_merge, PACKED).toLocalIterator():
        out[r["chunk"] * PACK : (r["chunk"] + 1) * PACK] = _open(bytes(r["counts"]))
    return out
