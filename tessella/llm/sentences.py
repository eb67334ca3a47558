"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; runs meet over all documents, the
first of equal runs stays, and a sentence that any other run of them covers is removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .storage import Scratch

U = np.uint64
#: (least sentences of a run, least words of it): a run has as many sentences as both take.
RUNS = ((3, 10), (2, 16))
#: A sentence of more words is cut at content, so that long passages without stops have runs as well: before each word whose hash is the smallest of its neighbours up to RADIUS words away.
LONG, RADIUS = 24, 4
SPAN = "h long, doc_id long, th long, at long, k int"
#: Stands for a null id, behind all others.
NAMELESS = (1 << 63) - 1
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]"]] = True


def lowest(word: np.ndarray, row: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether each hash has `radius` words of its row on both sides, is smaller than those before it and not above those after it."""
    out = np.ones(len(word), bool)
    for i in range(1, radius + 1):
        same = row[i:] == row[:-i]
        out[i:] &= same & (word[i:] < word[:-i])
        out[:-i] &= same & (word[:-i] <= word[i:])
    out[:radius] = out[max(len(out) - radius, 0) :] = False
    return out


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, row, number of words and hash of every sentence, and the hash's words as (first word) indices.

    A sentence ends with a word whose last byte, closing quotes and brackets aside, is one
    of . ! ? or the CJK full stop, at a line break, and at the end of the text. Its hash is
    that of its words in lower case (ASCII), whatever white space lies between them. Within a
    sentence of more than LONG words the cuts depend on RADIUS words on both sides only, so
    that equal passages are cut alike wherever they start.
    """
    low = tx.LOWER[buf]
    starts, ends, row = tx.words(low, offs)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    word = tx.spans(tx.prefix(low), starts, ends)
    tail = ends - 1
    for _ in range(2):
        tail = np.where(_CLOSE[low[tail]] & (tail > starts), tail - 1, tail)
    stop = _STOP[low[tail]]
    wide = tail - 2 >= starts
    stop |= wide & (low[tail] == 0x82) & (low[np.maximum(tail - 1, 0)] == 0x80) & (low[np.maximum(tail - 2, 0)] == 0xE3)
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    begin = np.ones(len(starts), bool)
    begin[1:] = stop[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]]) | (row[1:] != row[:-1])
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, len(starts)))
    begin |= np.repeat(size > LONG, size) & lowest(word, row)
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, len(starts)))
    inside = np.arange(len(starts)) - np.repeat(first, size)
    begin |= np.repeat(size > 2 * LONG, size) & (inside % LONG == 0)  # one word over and over has no smallest
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, len(starts)))
    p, inv = tx.powers(len(word) + 1)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * p[: len(word)])])
    h = tx.mix((pre[first + size] - pre[first]) * inv[first] + size.astype(np.uint64))
    return starts[first], row[first], size, h, first


def runs(row: np.ndarray, size: np.ndarray, h: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and hash of each run: at least k sentences of a row, and as many as hold `least` words."""
    n = len(row)
    at = np.arange(n)
    words = np.concatenate([[0], np.cumsum(size)])
    stop = np.maximum(at + k, np.searchsorted(words, words[:-1] + least))
    at = np.flatnonzero((stop <= n) & (row[np.minimum(stop, n) - 1] == row)) if n else at
    stop = stop[at]
    p, inv = tx.powers(n + 1)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:n])])
    return at, stop - at, tx.mix((pre[stop] - pre[at]) * inv[at] + U(least))


def _spans(batches):
    for batch in batches:
        for part, buf, offs in tx.slices(batch):
            start, row, size, h, _ = sentences(buf, offs)
            base = tx.bounds(row, part.num_rows)
            ids, th = tx.ints(part, "doc_id"), tx.ints(part, "th")
            for k, least in RUNS:
                at, count, key = runs(row, size, h, k, least)
                # a run seen before in the same text is removed wherever the first is; only the first joins
                order = np.lexsort((at, key, row[at]))
                k1, r1 = key[order], row[at][order]
                first = np.ones(len(order), bool)
                first[1:] = (k1[1:] != k1[:-1]) | (r1[1:] != r1[:-1])
                keep = np.sort(order[first])
                at, count, key = at[keep], count[keep], key[keep]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row[at]]), pa.array(th[row[at]]), pa.array(at - base[row[at]]), pa.array(count.astype(np.int32))], ["h", "doc_id", "th", "at", "k"])


def _cut(batches):
    for batch in batches:
        for part, buf, offs in tx.slices(batch):
            start, row, size, h, _ = sentences(buf, offs)
            n = len(start)
            base = tx.bounds(row, part.num_rows)
            edge = np.zeros(n + 1, np.int64)
            for k, least in RUNS:  # later copies within the text
                at, count, key = runs(row, size, h, k, least)
                order = np.lexsort((at, key, row[at]))
                k1, r1 = key[order], row[at][order]
                again = np.zeros(len(order), bool)
                again[1:] = (k1[1:] == k1[:-1]) & (r1[1:] == r1[:-1])
                again = order[again]
                np.add.at(edge, at[again], 1)
                np.add.at(edge, at[again] + count[again], -1)
            where = part.column(part.schema.get_field_index("where"))
            lists = where.to_pylist()
            for i, found in enumerate(lists):
                for x in found or ():
                    edge[base[i] + x["at"]] += 1
                    edge[base[i] + x["at"] + x["k"]] -= 1
            gone = np.cumsum(edge)[:n] > 0
            stop = np.where(np.append(row[1:] == row[:-1], False), np.append(start[1:], 0), offs[1:][row]) if n else start
            removed = np.bincount(row[gone], minlength=part.num_rows)
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            raw = buf.tobytes()
            for i in np.flatnonzero(removed):
                a, b = base[i], base[i + 1]
                pieces = [raw[offs[i] : start[a]]] + [raw[x:y] for x, y, g in zip(start[a:b].tolist(), stop[a:b].tolist(), gone[a:b].tolist()) if not g]
                texts[i] = b"".join(pieces).decode("utf-8")
            words = np.bincount(row[gone], size[gone], part.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(base)), pa.array(removed), pa.array(words), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "n_removed_words", "text"])


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_removed_words, text for every row of docs(doc_id, text).

    Of equal runs the first stays: that of the smallest doc_id (rows without id come last), of
    rows of one id that of the smallest xxhash64 of the text, there the first in the text.
    Sentences that another of them covers are cut from the text with the white space behind
    them. A run has three sentences or more, as many as hold ten words, or two or more for sixteen;
    what no such run covers is never removed. A null text stays null; texts without words have no sentence.
    Rows of one id and one text are one place: copies among themselves stay.

    Runs shuffle as (hash, id, text hash): minima combine before the shuffle, and a run that
    many documents share is a hot key of a plain join, which adaptive execution can split.
    """
    scratch = Scratch(spark)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = slim.where("text IS NOT NULL").mapInArrow(_spans, SPAN)
    place = F.struct("doc_id", "th")
    firsts = scratch.keep("firsts", found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first"))
    others = found.join(firsts, "h").where("doc_id <> first.doc_id OR th <> first.th").select("doc_id", "th", "at", "k").distinct()
    by_doc = others.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("at", "k"))).alias("where"))
    cut = slim.join(by_doc, ["doc_id", "th"], "left").select("doc_id", "text", "where").mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, n_removed_words long, text string")
    return cut.withColumn("doc_id", F.expr(f"nullif(doc_id, {NAMELESS}L)"))
