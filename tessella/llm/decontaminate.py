"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive tokens; tokens under its zeros don't enter the hash, so
a hit survives substitutions there. Hashes of all documents meet those of the benchmark,
each hit names an item and a diagonal (the shift between the two token sequences), and the
overlap along the diagonal is compared token by token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from . import text as tx
from .storage import Scratch

U = np.uint64
#: Any 13 tokens or more of which a fifth are substituted still have a hit. Such a stretch holds one of 13 with 2, 15 with 3,
#: 20 with 4 or 25 with 5 substitutions (or fewer); tests try all their placements.
MASKS = ("11111011", "1100101111", "11011100011", "11100000101011", "1001010100111", "110111101")
MIN_TOKENS = 13
MIN_SHARE = 0.8
SHORTEST = 5
#: Benchmark tokens up to which the index goes to every task, about 110 bytes each; seeds of a larger benchmark are joined.
BLOCK_TOKENS = 500_000
FOUND = "doc_id long, item_id long, start long, n_overlap long, n_matched long, coverage double"

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (runs of letters and digits of the lower-cased text; bytes from 128 on count as letters) and their rows."""
    buf, offs = tx.utf8(pc.utf8_lower(column))
    starts, ends, row = tx.words(buf, offs, SEPARATORS)
    return tx.spans(tx.prefix(buf), starts, ends), row


def seeds(word: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every placement of a mask within a row, and the first token of each."""
    span = len(mask)
    n = len(word) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, U(int(mask, 2) + (span << 32)))
    for p, c in enumerate(mask):
        if c == "1":
            total += word[p : p + n] * (tx.mix(tx.STEPS[p + 1 : p + 2]) | U(1))
    at = np.flatnonzero(row[:n] == row[span - 1 : span - 1 + n])
    return tx.mix(total[at]), at


def item_seeds(word: np.ndarray, row: np.ndarray, size: np.ndarray, masks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of the seeds of benchmark items: a solid mask holds items of its length, the others items of MIN_TOKENS or more."""
    keys, at = [], []
    for mask in masks:
        h, first = seeds(word, row, mask)
        whole = size[row[first]] == len(mask) if set(mask) == {"1"} else size[row[first]] >= MIN_TOKENS
        keys.append(h[whole])
        at.append(first[whole])
    return np.concatenate(keys), np.concatenate(at)


def lines_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of a text column and the row of each."""
    lists = pc.split_pattern(pc.fill_null(column, ""), "\n")
    return lists.flatten(), np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy())


def line_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first token and number of tokens of each line of 1 to SHORTEST - 1 tokens."""
    lines, row = lines_of(column)
    word, line = tokens(lines)
    at = tx.bounds(line, len(row))
    size = np.diff(at)
    first = at[:-1] - at[:-1][np.searchsorted(row, row)]  # counted from the first token of the row
    h = np.zeros(len(row), np.uint64)
    for i in range(SHORTEST - 1):
        has = np.flatnonzero(size > i)
        h[has] += word[at[:-1][has] + i] * (tx.mix(tx.STEPS[i + 1 : i + 2]) | U(1))
    some = np.flatnonzero((size > 0) & (size < SHORTEST))
    return tx.mix(h[some] + size[some].astype(np.uint64)), row[some], first[some], size[some]


def short_items(ids: np.ndarray, word: np.ndarray, row: np.ndarray, size: np.ndarray) -> dict[int, list[int]]:
    """Ids of the items of 1 to SHORTEST - 1 tokens by the hash that a line of the same tokens has."""
    at = np.searchsorted(row, np.arange(len(size)))
    out: dict[int, list[int]] = {}
    for i in np.flatnonzero((size > 0) & (size < SHORTEST)):
        h = np.zeros(1, np.uint64)
        for k in range(size[i]):
            h += word[at[i] + k] * (tx.mix(tx.STEPS[k + 1 : k + 2]) | U(1))
        out.setdefault(int(tx.mix(h + U(size[i]))[0]), []).append(int(ids[i]))
    return out


@dataclass
class Index:
    """One block of benchmark items: their tokens and the sorted seed hashes."""

    ids: np.ndarray
    word: np.ndarray
    bounds: np.ndarray
    masks: list[str]
    key: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    seen: np.ndarray
    short: dict[int, list[int]]

    @staticmethod
    def build(ids: list[int], texts: list[str | None]) -> Index:
        word, row = tokens(pa.array(texts, pa.string()))
        bounds = tx.bounds(row, len(ids))
        size = np.diff(bounds)
        masks = [*MASKS, *("1" * int(n) for n in np.unique(size) if SHORTEST <= n < MIN_TOKENS)]
        key, at = item_seeds(word, row, size, masks)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        seen = np.zeros(1 << 22, bool)
        seen[key >> U(42)] = True
        return Index(np.array(ids, np.int64), word, bounds, masks, key, row[at].astype(np.int32), (at - bounds[row[at]]).astype(np.int32), seen, short_items(np.array(ids, np.int64), word, row, size))


def overlap(equal: np.ndarray, share: float, least: int) -> tuple[int, int]:
    """Of the stretches [a, b) of at least `least` places that match in at least that share, one of the most matches; (0, 0) for none.

    For each end the leftmost start whose prefix sum (1 - share a match, -share a mismatch)
    is not above that of the end is the longest stretch, so none ending there matches more.
    Mismatches at its ends are cut off while `least` places remain.
    """
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))])
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums - 1e-9)
    match = np.concatenate([[0], np.cumsum(equal)])
    ends = np.arange(len(sums))
    ok = np.flatnonzero(ends - first >= least)
    if not len(ok):
        return 0, 0
    b = int(ok[np.argmax(match[ok] - match[first[ok]])])
    a = int(first[b])
    while b - a > least and not equal[a]:
        a += 1
    while b - a > least and not equal[b - 1]:
        b -= 1
    return a, b


def best_overlaps(candidates, texts, items, min_tokens: int, share: float) -> list[tuple]:
    """(row, item, start, n_overlap, n_matched, coverage) of the best overlap of each pair among (row, item, shift) candidates.

    texts and items give the token hashes of a row and of an item.
    """
    best: dict[tuple, tuple] = {}
    for r, item, shift in candidates:
        doc, own = texts(r), items(item)
        lo, hi = max(0, -shift), min(len(own), len(doc) - shift)
        equal = doc[shift + lo : shift + hi] == own[lo:hi]
        a, b = overlap(equal, share, int(min(min_tokens, len(own))))
        if b > a:
            m = int(equal[a:b].sum())
            best[r, item] = max(best.get((r, item), (0,)), (m, -(shift + lo + a), b - a, m / len(own)))
    return [(r, i, -s, n, m, c) for (r, i), (m, s, n, c) in sorted(best.items())]


def found_in(ix: Index, part: pa.RecordBatch, min_tokens: int, share: float) -> list[tuple]:
    """(row, item id, start, n_overlap, n_matched, coverage) of a batch (doc_id, text)."""
    column = part.column(part.schema.get_field_index("text"))
    word, row = tokens(column)
    doc = tx.bounds(row, part.num_rows)
    found = []
    for mask in ix.masks:
        h, at = seeds(word, row, mask)
        near = np.flatnonzero(ix.seen[h >> U(42)])
        h, at = h[near], at[near]
        lo, hi = np.searchsorted(ix.key, h, "left"), np.searchsorted(ix.key, h, "right")
        hit = np.flatnonzero(hi > lo)
        for i in range(0, len(hit), 4096):
            some = hit[i : i + 4096]
            n = hi[some] - lo[some]
            which = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            r = np.repeat(row[at[some]], n)
            found.append(np.unique(np.stack([r, ix.item[which], np.repeat(at[some] - doc[row[at[some]]], n) - ix.pos[which]]), axis=1))
    out = []
    if found:
        candidates = np.unique(np.concatenate(found, axis=1), axis=1).T.tolist()
        best = best_overlaps(candidates, lambda r: word[doc[r] : doc[r + 1]], lambda i: ix.word[ix.bounds[i] : ix.bounds[i + 1]], min_tokens, share)
        out = [(r, int(ix.ids[i]), *rest) for r, i, *rest in best]
    if ix.short:
        once = {}
        for h, r, first, n in zip(*(x.tolist() for x in line_hashes(column))):
            for item in ix.short.get(h, ()):
                once.setdefault((r, item), (first, n, n, 1.0))
        out = sorted(out + [(*k, *v) for k, v in once.items()])
    return out


def matcher(index, min_tokens: int, share: float):
    """mapInArrow function: doc_id, text -> FOUND."""

    def run(batches):
        for batch in batches:
            for part, _, _ in tx.slices(batch):
                if rows := found_in(index.value, part, min_tokens, share):
                    row, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *map(pa.array, rest)], ["doc_id", "item_id", "start", "n_overlap", "n_matched", "coverage"])

    return run


def _benchmark_seeds(min_tokens: int):
    """mapInArrow function: item_id, text -> h, item_id, pos; lines of short items have pos -1."""

    def run(batches):
        for batch in batches:
            word, row = tokens(batch.column(1))
            at = tx.bounds(row, batch.num_rows)
            size = np.diff(at)
            h, first = item_seeds(word, row, size, [*MASKS, *("1" * n for n in range(SHORTEST, MIN_TOKENS))])
            short = short_items(np.arange(batch.num_rows), word, row, size)
            lines = [(k, i) for k, found in short.items() for i in found]
            key = np.concatenate([h, np.array([k for k, _ in lines], np.uint64)])
            item = np.concatenate([row[first], np.array([i for _, i in lines], np.int64)]).astype(np.int64)
            pos = np.concatenate([first - at[row[first]], np.full(len(lines), -1)]).astype(np.int64)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(item)), pa.array(pos)], ["h", "item_id", "pos"])

    return run


def _document_seeds(known):
    """mapInArrow function: doc_id, th, text -> h, doc_id, th, at, n: the seeds that the benchmark may have; lines of short items have n > 0."""

    def run(batches):
        for batch in batches:
            for part, _, _ in tx.slices(batch):
                column = part.column(2)
                word, row = tokens(column)
                doc = tx.bounds(row, part.num_rows)
                for mask in [*MASKS, *("1" * n for n in range(SHORTEST, MIN_TOKENS)), ""]:
                    if mask:
                        h, at = seeds(word, row, mask)
                        r, at, n = row[at], at - doc[row[at]], np.zeros(len(at), np.int64)
                    else:
                        h, r, at, n = line_hashes(column)
                    some = np.flatnonzero(tables.in_bitmap(known.value, h))
                    if len(some):
                        take = pa.array(r[some])
                        yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(at[some]), pa.array(n[some])], ["h", "doc_id", "th", "at", "n"])

    return run


def _compared(min_tokens: int, share: float):
    """mapInArrow function: doc_id, item_id, doc, item, shifts -> FOUND."""

    def run(batches):
        for batch in batches:
            for part, _, _ in tx.slices(batch, "doc"):
                sides = []
                for name in ("doc", "item"):
                    word, row = tokens(part.column(part.schema.get_field_index(name)))
                    at = tx.bounds(row, part.num_rows)
                    sides.append(lambda r, word=word, at=at: word[at[r] : at[r + 1]])
                shifts = part.column(part.schema.get_field_index("shifts")).to_pylist()
                rows = best_overlaps(((r, r, s) for r, found in enumerate(shifts) for s in found), *sides, min_tokens, share)
                if rows:
                    row, _, *rest = zip(*rows)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *map(pa.array, rest)], ["doc_id", "item_id", "start", "n_overlap", "n_matched", "coverage"])

    return run


def _joined(spark: SparkSession, docs: DataFrame, items: DataFrame, min_tokens: int, share: float) -> DataFrame:
    """FOUND for a benchmark of any size: hashes of both sides are joined, and the texts of each pair that met compared."""
    scratch = Scratch(spark)
    known = scratch.keep("seeds", items.mapInArrow(_benchmark_seeds(min_tokens), "h long, item_id long, pos long"))
    packed = spark.sparkContext.broadcast(tables.bitmap(known, F.col("h")))
    texts = docs.withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text")
    seen = texts.mapInArrow(_document_seeds(packed), "h long, doc_id long, th long, at long, n long")
    met = seen.join(known, "h").where("(n > 0) = (pos < 0)")
    hits = scratch.keep("hits", met.select("doc_id", "th", "item_id", "n", F.when(F.col("n") > 0, F.col("at")).otherwise(F.col("at") - F.col("pos")).alias("shift")).distinct())
    lines = hits.where("n > 0").groupBy("doc_id", "th", "item_id", "n").agg(F.min("shift").alias("start")).select("doc_id", "th", "item_id", "start", F.col("n").alias("n_overlap"), F.col("n").alias("n_matched"), F.lit(1.0).alias("coverage"))
    pairs = hits.where("n = 0").groupBy("doc_id", "th", "item_id").agg(F.sort_array(F.collect_list("shift")).alias("shifts"))
    on = [texts["doc_id"].eqNullSafe(pairs["doc_id"]), texts["th"] == pairs["th"]]
    both = texts.join(pairs, on).select(texts["doc_id"], "item_id", texts["text"].alias("doc"), "shifts").join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "item_id", "doc", "item", "shifts")
    rows = texts.select(texts["doc_id"].alias("d"), texts["th"].alias("t"))
    whole = rows.join(lines, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))).select("doc_id", "item_id", "start", "n_overlap", "n_matched", "coverage")
    return both.mapInArrow(_compared(min_tokens, share), FOUND).unionByName(whole)


def _items(benchmark: DataFrame, block_tokens: int) -> tuple[DataFrame, bool]:
    """item_id and text of the items, and whether their index is small enough for every task."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return items, (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= 2 * block_tokens


def _index(spark: SparkSession, items: DataFrame):
    rows = sorted(items.collect())
    return spark.sparkContext.broadcast(Index.build([r[0] for r in rows], [r[1] for r in rows]))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, min_tokens: int = MIN_TOKENS, share: float = MIN_SHARE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, start, n_overlap, n_matched, coverage): the best confirmed overlap of each document and item that share one.

    docs(doc_id, text), benchmark(item_id, text). An overlap has at least min_tokens tokens,
    `share` of them equal place by place. start is the first overlapping token of the document,
    coverage the matched share of the item. At the default min_tokens and share every overlap is
    found. An item of 5 to 12 tokens matches where all its tokens stand in a row, one of 1 to 4
    where a whole line of the document has just its tokens. Null texts match nothing; rows
    without id are matched like others; rows that repeat an id give a row each.

    A benchmark of up to block_tokens tokens goes to every task as an index, and the documents
    aren't shuffled. Seeds of a larger one are joined with those seeds of the documents that a
    bitmap of fixed size lets pass, and only texts of pairs that meet are moved.
    """
    items, small = _items(benchmark, block_tokens)
    docs = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not small:
        return _joined(spark, docs, items, min_tokens, share)
    return docs.mapInArrow(matcher(_index(spark, items), min_tokens, share), FOUND)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, min_tokens: int = MIN_TOKENS, share: float = MIN_SHARE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs without the rows that have a confirmed overlap, all columns as they were.

    With a benchmark of one block each row is judged by its own text; with a larger one rows
    that share an id go together. Null and empty texts stay.
    """
    items, small = _items(benchmark, block_tokens)
    if not small:
        bad = contaminated(spark, docs.select("doc_id", "text"), benchmark, min_tokens=min_tokens, share=share, block_tokens=block_tokens).select("doc_id").distinct()
        return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]), "left_anti").select(*(docs[c] for c in docs.columns))
    index = _index(spark, items)

    def run(batches):
        for batch in batches:
            for part, _, _ in tx.slices(batch):
                stay = np.ones(part.num_rows, bool)
                stay[[r for r, *_ in found_in(index.value, part, min_tokens, share)]] = False
                yield part.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
