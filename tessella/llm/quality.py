"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]):
all pairwise interactions in time linear in the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .storage import fresh

U = np.uint64
WORD_BITS = 15
FACTORS = 8
BINS = 10
#: Bound of the labelled rows that the fit takes, in the order of a hash of their ids; about 1 KB each on the driver.
TRAIN_ROWS = 20_000
EPOCHS, BATCH, RATE, DECAY = 8, 256, 0.02, 2e-5
THRESHOLD = 0.3
STATS = ("n_words", "word_len", "upper", "symbols", "digits", "marks", "other_ascii", "wide", "space", "distinct_words", "distinct_pairs", "dup_lines", "line_words", "longest_word", "n_chars")
_CLASS = np.zeros((6, 256), np.float64)
_CLASS[0, 65:91] = 1
_CLASS[1, [ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, [ord(c) for c in "!?"]] = 1
_CLASS[4, [ord(c) for c in ".,;:'\"()-_/\\@=+[]{}~^`"]] = 1
_CLASS[5, 128:] = 1


def distinct(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs, sorted by row then key."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[new], row[new]


def features(buf: np.ndarray, offs: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (rows x STATS, NaN where undefined), and hashed distinct words as (bucket, row), sorted by row."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    starts, ends, row = tx.words(buf, offs)
    count = np.bincount(row, minlength=n).astype(float)
    total = np.zeros((6, n))
    some = np.flatnonzero(size)
    for i in range(6):
        if len(some):
            total[i, some] = np.add.reduceat(_CLASS[i][buf], offs[:-1][some])
    length = (ends - starts).astype(float)
    word_bytes = np.bincount(row, length, n)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    low = tx.LOWER[buf]
    pre = tx.prefix(low)
    word = tx.spans(pre, starts, ends)
    key, key_row = distinct(word, row, n)
    pair = word[:-1] * U(3) + word[1:]
    same = row[:-1] == row[1:]
    _, pair_row = distinct(pair[same], row[:-1][same], n)
    breaks = np.flatnonzero(buf == 10)
    edges = np.unique(np.concatenate([offs[:-1][some], breaks + 1, offs[1:][some]]))
    edges = edges[edges <= len(buf)]
    l0, l1 = edges[:-1], edges[1:]
    has = np.searchsorted(starts, l1) > np.searchsorted(starts, l0)
    l0, l1 = l0[has], l1[has]
    line_row = np.searchsorted(offs[1:], l0, "right")
    tail = l1 - (low[l1 - 1] == 10) if len(l1) else l1
    lines = np.bincount(line_row, minlength=n)
    _, dl = distinct(tx.spans(pre, l0, tail), line_row, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        stats = np.stack([np.log1p(count), word_bytes / count, *(total / size), 1 - word_bytes / size, np.bincount(key_row, minlength=n) / count, np.bincount(pair_row, minlength=n) / np.maximum(count - 1, 0), 1 - np.bincount(dl, minlength=n) / lines, np.log1p(count / lines), np.log1p(longest), np.log1p(np.maximum(n_chars, 0))], axis=1)
    stats[~np.isfinite(stats)] = np.nan
    return stats, (key >> U(64 - WORD_BITS)).astype(np.int64), key_row


@dataclass
class Machine:
    """Edges of the statistics' bins, and weights: words first, then a place for each bin and for an undefined value."""

    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, stats: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return assemble(self.edges, stats, bucket, row)

    def score(self, stats: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
        idx, val, at = self.rows(stats, bucket, row)
        z, _ = forward(self.w0, self.w, self.v, idx, val, at)
        return 1 / (1 + np.exp(-z))


def assemble(edges, stats, bucket, row):
    """Feature index, value and row offsets: statistics' bins at 1, words at 1 / sqrt(distinct words)."""
    n, k = stats.shape
    which = np.stack([np.searchsorted(edges[j], stats[:, j], "right") for j in range(k)], axis=1)
    which[np.isnan(stats)] = BINS
    base = (1 << WORD_BITS) + np.arange(k) * (BINS + 1)
    words = np.bincount(row, minlength=n)
    at = np.concatenate([[0], np.cumsum(words + k)])
    idx = np.empty(at[-1], np.int64)
    val = np.ones(at[-1], np.float32)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words) + np.repeat(at[:-1], words)
    idx[slot] = bucket
    val[slot] = np.repeat(1 / np.sqrt(np.maximum(words, 1)), words)
    idx[(at[1:, None] - k + np.arange(k)).reshape(-1)] = (which + base).reshape(-1)
    return idx, val, at


def forward(w0, w, v, idx, val, at):
    vx = v[idx] * val[:, None]
    s = np.add.reduceat(vx, at[:-1], axis=0)
    q = np.add.reduceat(vx * vx, at[:-1], axis=0)
    z = w0 + np.add.reduceat(w[idx] * val, at[:-1]) + 0.5 * (s * s - q).sum(axis=1)
    return z, s


def gathered(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows (row i has values[at[i]:at[i + 1]]) one after the other, and the place in `rows` each is from."""
    size = at[rows + 1] - at[rows]
    end = np.cumsum(size)
    src = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(at[rows] - (end - size), size)
    return values[src], np.repeat(np.arange(len(rows)), size)


def fit(stats: np.ndarray, words: np.ndarray, at: np.ndarray, label: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the log loss over shuffled batches; the same rows in the same order give the same machine.

    Row i has the word buckets words[at[i]:at[i + 1]].
    """
    rng = np.random.default_rng(seed)
    n, k = stats.shape
    edges = np.zeros((k, BINS - 1))
    for j in range(k):
        known = stats[~np.isnan(stats[:, j]), j]
        if len(known):
            edges[j] = np.quantile(known, np.arange(1, BINS) / BINS)
    d = (1 << WORD_BITS) + k * (BINS + 1)
    rate = (label.sum() + 1) / (n + 2)
    w0 = float(np.log(rate / (1 - rate)))
    w, v = np.zeros(d, np.float32), rng.normal(0, 0.05, (d, FACTORS)).astype(np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v)]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate_now = RATE * (1 - epoch / EPOCHS)
        for i in range(0, n, BATCH):
            some = order[i : i + BATCH]
            bucket, row = gathered(words, at, some)
            idx, val, ends = assemble(edges, stats[some], bucket.astype(np.int64), row)
            z, s = forward(w0, w, v, idx, val, ends)
            err = ((1 / (1 + np.exp(-z))) - label[some]).astype(np.float32) / len(some)
            r = np.repeat(np.arange(len(some)), np.diff(ends))
            e = err[r] * val
            used, inv = np.unique(idx, return_inverse=True)
            gw = np.bincount(inv, e, len(used)) + DECAY * w[used]
            full = e[:, None] * (s[r] - v[idx] * val[:, None])
            gv = np.stack([np.bincount(inv, full[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * v[used]
            step += 1
            w0 -= rate_now * 0.1 * float(err.sum())
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for x, g, (m1, m2) in zip((w, v), (gw, gv), moments):
                m1[used] = 0.9 * m1[used] + 0.1 * g
                m2[used] = 0.999 * m2[used] + 0.001 * g * g
                x[used] -= rate_now * fix * m1[used] / (np.sqrt(m2[used]) + 1e-8)
    return Machine(edges, w0, w, v)


def held_out(id_col: str = "doc_id") -> Column:
    """Fifth 0 of crc32 of the id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


TAKEN = "doc_id long, quality byte, digest long, stats binary, words binary"


def _extract(batches):
    """doc_id, text, n_chars, quality -> TAKEN: the statistics as doubles and the word buckets as 16-bit numbers, one row's after the other's."""
    for batch in batches:
        for part, buf, offs in tx.slices(batch):
            stats, bucket, row = features(buf, offs, tx.ints(part, "n_chars"))
            n, at = part.num_rows, tx.bounds(row, part.num_rows)
            digest = tx.spans(tx.prefix(buf), offs[:-1], offs[1:])
            packed = lambda x, ends: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3).cast(pa.int8()), pa.array(digest.view(np.int64)), packed(stats, np.arange(n + 1) * 8 * len(STATS)), packed(bucket.astype(np.uint16), 2 * at)], ["doc_id", "quality", "digest", "stats", "words"])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one row after the other, and the n+1 offsets of its rows."""
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) // np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, kind, int(offs[-1])) if data is not None else np.zeros(0, kind)
    return values, offs


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars; where docs have no n_chars, the length of the text."""
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(chars.cast("double"), F.lit(0.0)).alias("n_chars"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine from labelled documents outside the held-out fifth, or None where there is no such row or one class only.

    At most `rows` labels are taken, in the order of a hash of the ids.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("quality"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(rows)
    taken = _slim(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "n_chars", "quality")
    got = taken.mapInArrow(_extract, TAKEN).toArrow().combine_chunks()
    label = got.column("quality").to_numpy().astype(np.float64)
    if not len(label) or label.min() == label.max():
        return None
    first = lambda name: got.column(name).chunk(0)
    order = np.lexsort((got.column("digest").to_numpy(), got.column("doc_id").to_numpy()))
    stats = _flat(first("stats"), np.float64)[0].reshape(-1, len(STATS))[order]
    words, at = _flat(first("words"), np.uint16)
    size = np.diff(at)[order]
    words, _ = gathered(words, at, order)
    del got
    return fit(stats, words, np.concatenate([[0], np.cumsum(size)]), label[order])


def scored(spark: SparkSession, docs: DataFrame, machine: Machine | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; without a machine each score is 0.5. Null and empty texts are scored by their statistics."""
    model = spark.sparkContext.broadcast(machine)

    def run(batches):
        m = model.value
        for batch in batches:
            for part, buf, offs in tx.slices(batch):
                score = np.full(part.num_rows, 0.5) if m is None else m.score(*features(buf, offs, tx.ints(part, "n_chars")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(float))], ["doc_id", "score"])

    return _slim(docs).mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs scored at the threshold or above, all columns as they were.

    Each row is scored by its own text, so repeats stay or go together; rows without id or text
    are scored like any other. Without labels of both classes every row stays.
    """
    model = spark.sparkContext.broadcast(train(spark, docs, labels))
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    columns = docs.columns
    (name,) = fresh(columns, "_chars")
    wide = docs.withColumn(name, F.coalesce(chars.cast("double"), F.lit(0.0)))

    def run(batches):
        m = model.value
        for batch in batches:
            for part, buf, offs in tx.slices(batch):
                if m is not None:
                    part = part.filter(pa.array(m.score(*features(buf, offs, tx.ints(part, name))) >= threshold))
                yield part.select(columns)

    return wide.mapInArrow(run, docs.schema)
