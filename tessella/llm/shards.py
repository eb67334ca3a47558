"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within each source, row i of n gets the fractional rank
(i + 0.5) / n, and the order of all rows by that rank is cut into shards whose row counts
differ by one at most. Any stretch of that order holds each source in proportion, so every
shard matches the mixture.

No window spans a source: a source's rows are spread over hash ranges, the ranks within a
range are offset by the counts of the ranges before it, and the same is done again for the
global order. Windows over whole sources or the whole table run only over those counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, fresh

#: Rows of a source in a hash range, and of the global order in a stretch of it, about: what one window sorts.
RANGE_ROWS = 200_000


def _ranked(df: DataFrame, group: list[str], ranges: str, order: list, out: str, scratch: Scratch, name: str) -> DataFrame:
    """df with `out`: the rank from 0 of each row in its group by (ranges, order)."""
    keys = [*group, ranges]
    n, r, before = fresh(df.columns, "_n", "_r", "_before")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(name, counts.select(*keys, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(r, rank).join(offsets, keys).withColumn(out, (F.col(r) + F.col(before)).cast("long")).drop(r, before)


def interleave(rows: DataFrame, shards: int, *, seed: str = "shards", ranges: int | None = None, id_col: str = "doc_id", source_col: str = "source", ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in its shard); all columns are carried, so pass narrow rows.

    Null sources are a source of their own. Rows that repeat an id lie next to each other in
    the shuffle, null ids as one id; `ties` orders them, and rows equal in those too are
    interchangeable. An empty table gives an empty result; with fewer rows than shards some
    shards stay empty. `ranges` (by default one for about RANGE_ROWS rows) changes only how the
    work is split. Rows that share an id beyond that number are sorted in one task.
    """
    scratch = Scratch(rows.sparkSession)
    s, h, b, i, n, f, p = fresh(rows.columns, "_s", "_h", "_b", "_i", "_n", "_f", "_p")
    total = rows.count()
    ranges = ranges or max(64, -(-total // RANGE_ROWS))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    order = [h, id_col, *ties]
    start = rows.withColumn(s, F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))).withColumn(h, digest)
    start = start.withColumn(b, F.expr(f"cast(cast(conv(substring({h}, 1, 8), 16, 10) as long) * {ranges}L div 4294967296L as int)"))
    inner = scratch.keep("within", _ranked(start, [s], b, order, i, scratch, "sources"))
    totals = scratch.keep("totals", inner.groupBy(s).agg(F.count(F.lit(1)).alias(n)))
    parted = inner.join(totals, s).withColumn(f, (F.col(i) + 0.5) / F.col(n)).withColumn(b, F.floor(F.col(f) * ranges).cast("int"))
    placed = _ranked(parted, [], b, [f, h, s, id_col, *ties], p, scratch, "order")
    placed = placed.withColumn("shard", F.expr(f"cast(({p} * {shards}L) div {max(total, 1)}L as int)"))
    return placed.withColumn("slot", F.expr(f"{p} - (shard * {total}L + {shards - 1}L) div {shards}L")).drop(s, h, b, i, n, f, p)


def shard_documents(docs: DataFrame, shards: int, *, seed: str = "shards", ranges: int | None = None) -> DataFrame:
    """docs (with doc_id and source) with shard and slot; any other columns are kept, a former `shard` or `slot` is replaced.

    The texts move once: places are found on narrow rows and joined. Rows that repeat an id
    are told apart by a digest of their columns and a number, found only if there are any;
    rows without id are one id.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    key, d, k, c = fresh(docs.columns, "_key", "_d", "_k", "_c")
    repeats = scratch.keep("repeats", docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias(c)).where(f"{c} > 1").limit(1))
    if repeats.isEmpty():
        keyed = docs.withColumn(key, F.lit(0))
    else:
        keyed = scratch.keep("keyed", docs.withColumn(key, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))))
    placed = interleave(keyed.select("doc_id", key, "source"), shards, seed=seed, ranges=ranges, ties=(key,))
    places = placed.select(F.col("doc_id").alias(d), F.col(key).alias(k), "shard", "slot")
    return keyed.join(places, F.expr(f"doc_id <=> {d} AND {key} = {k}")).select(*docs.columns, "shard", "slot")


def shard_report(docs: DataFrame, shards: int = 40, *, seed: str = "shards", ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law `rows`: counts differ by one at most.

    size is the UTF-8 bytes of the text plus 16 (null: 16), text_crc32 that of the bytes (null:
    of none). Equal texts are no unit of this law: each row has its own place in the
    interleaving, so copies spread over the shards like other rows.
    """
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "source", (F.octet_length(binary) + 16).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"))
    placed = interleave(rows, shards, seed=seed, ranges=ranges, ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
