"""Language identification of mixed text: scripts narrow the candidates, Viterbi over words labels the spans.

Every word gets a score for each language from hashed byte n-grams, the script of its
letters excludes languages that don't write in it, and the best path of labels through a
document pays a penalty for each switch of language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scripts, tables
from . import text as tx
from .quality import held_out

U = np.uint64
GRAMS, BITS = (2, 3, 4), 16
#: Cost of a switch and bound of what one word can say for or against a language, in natural-log units.
SWITCH, WORD_BOUND = 12.0, 6.0
#: Least share of a language's words in a script for the script to admit the language.
SCRIPT_SHARE = 0.005
BLOCK = 64
SLICE = 2 << 20


def lowered(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tx.utf8(pc.utf8_lower(part.column(part.schema.get_field_index("text"))))


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams (columns GRAMS, -1 where too long) at each place of the words set between spaces, first place and size of each word."""
    size = ends - starts + 2
    at = np.cumsum(size) - size
    total = int(size.sum())
    src = np.arange(total) - np.repeat(at - starts + 1, size)
    padded = np.append(buf, np.uint8(32))[np.clip(src, 0, len(buf))]
    padded[at] = 32
    padded[at + size - 1] = 32
    left = np.repeat(at + size, size) - np.arange(total)
    code = padded.astype(np.uint64)
    out = np.full((len(GRAMS), total), -1, np.int64)
    h = np.zeros(total, np.uint64)
    for i in range(max(GRAMS)):
        h[: total - i] = (h[: total - i] << U(8)) | code[i:]
        if i + 1 in GRAMS:
            ok = left > i
            out[GRAMS.index(i + 1), ok] = ((h[ok] * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int64)
    return out, at, size


def word_scripts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Main script of each word, scripts.NONE for words without letters."""
    if not len(starts):
        return np.zeros(0, np.int64)
    by = scripts.of_spans(buf, starts, len(starts), np.arange(len(starts)))
    return np.where(by.sum(axis=1) > 0, by.argmax(axis=1), scripts.NONE)


def gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans one after the other with a space behind each: bytes, starts, ends."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    out = np.append(buf, np.uint8(32))[np.arange(int(size.sum())) - np.repeat(at - starts, size)]
    out[at + size - 1] = 32
    return out, at, at + size - 1


def lettered(buf: np.ndarray, offs: np.ndarray):
    """Start, end, row and number of every word with letters, and the distinct ones by number: bytes, starts, ends, scripts.

    Scripts and n-grams are looked up once for a distinct word of the slice, not for each place.
    """
    starts, ends, row = tx.words(buf, offs)
    _, first, inv = np.unique(tx.spans(tx.prefix(buf), starts, ends), return_index=True, return_inverse=True)
    own, a, b = gathered(buf, starts[first], ends[first])
    script = word_scripts(own, a)
    some = script != scripts.NONE
    here = some[inv]
    return starts[here], ends[here], row[here], (np.cumsum(some) - 1)[inv[here]], own, a[some], b[some], script[some]


def _count(batches):
    held: dict[str, np.ndarray] = {}
    words: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, _, _ in tx.slices(batch, limit=SLICE):
            _, _, row, number, own, a, b, script = lettered(*lowered(part))
            if not len(row):
                continue
            g, at, size = grams(own, a, b)
            names, lang = np.unique(np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object).astype(str), return_inverse=True)
            times = np.bincount(lang[row] * len(a) + number, minlength=len(names) * len(a)).reshape(len(names), len(a))
            for name, count in zip(names.tolist(), times):
                if not count.any():
                    continue
                t = held.setdefault(name, np.zeros(len(GRAMS) << BITS, np.int64))
                of_place = np.repeat(count, size)
                for i in range(len(GRAMS)):
                    ok = g[i] >= 0
                    t[i << BITS : (i + 1) << BITS] += np.bincount(g[i][ok], of_place[ok], 1 << BITS).astype(np.int64)
                w = words.setdefault(name, np.zeros(len(scripts.NAMES), np.int64))
                w += np.bincount(script, count, len(scripts.NAMES)).astype(np.int64)
    yield from tables.chunks({f"g{k}": v for k, v in held.items()} | {f"s{k}": v for k, v in words.items()})


@dataclass
class Speaker:
    """Languages, log probabilities of the n-grams (one row a bucket of each size) and the languages that each script admits."""

    langs: list[str]
    logp: np.ndarray
    admits: np.ndarray

    def word_scores(self, buf, starts, ends, script) -> np.ndarray:
        g, at, size = grams(buf, starts, ends)
        score = np.zeros((g.shape[1], len(self.langs)), np.float32)
        logp = np.vstack([self.logp, np.zeros((1, len(self.langs)), np.float32)])
        for i in range(len(GRAMS)):
            score += logp.take(np.where(g[i] >= 0, (i << BITS) + g[i], len(self.logp)), axis=0)
        if not len(at):
            return np.zeros((0, len(self.langs)), np.float32)
        total = np.add.reduceat(score, at, axis=0) / len(GRAMS)
        admitted = self.admits[script]
        total = np.where(admitted, total, -np.inf)
        total -= total.max(axis=1, keepdims=True)
        return np.maximum(total, np.where(admitted, -WORD_BOUND, -2 * WORD_BOUND)).astype(np.float32)


def train(docs: DataFrame) -> Speaker | None:
    """Counts over all documents with text and lang outside the held-out fifth; None where there are none.

    Each task sends its n-gram tables of fixed size, a language at a time.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out()).select("text", F.col("lang").cast("string").alias("lang"))
    found = tables.summed(known.mapInArrow(_count, tables.SCHEMA))
    langs = sorted(k[1:] for k in found if k[0] == "g")
    if not langs:
        return None
    logp = np.zeros((len(GRAMS) << BITS, len(langs)), np.float32)
    share = np.zeros((len(scripts.NAMES), len(langs)))
    for j, name in enumerate(langs):
        t = tables.whole(found[f"g{name}"], len(GRAMS) << BITS).astype(float)
        for i in range(len(GRAMS)):
            part = t[i << BITS : (i + 1) << BITS] + 0.5
            logp[i << BITS : (i + 1) << BITS, j] = np.log(part / part.sum())
        w = tables.whole(found[f"s{name}"], len(scripts.NAMES))
        share[:, j] = w / w.sum()
    admits = share >= SCRIPT_SHARE
    admits[~admits.any(axis=1)] = True
    return Speaker(langs, logp, admits)


def _top(x: np.ndarray) -> np.ndarray:
    """Maximum over the last axis, which is short and stays."""
    out = x[..., :1]
    for i in range(1, x.shape[-1]):
        out = np.maximum(out, x[..., i : i + 1])
    return out


def viterbi(score: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word for rows of words bounds[i]:bounds[i+1].

    Exact, in blocks: the best gain through each block from each label before it to each
    label at its end is found for all blocks at once; a pass over the blocks of each row
    fixes the labels at their ends, and the blocks are traced back, again all at once.
    """
    n_lang = score.shape[1]
    size = np.diff(bounds)
    blocks = -(-size // BLOCK)
    first = np.repeat(bounds[:-1], blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    last = np.minimum(first + BLOCK, np.repeat(bounds[1:], blocks))
    b = len(first)
    if not b:
        return np.zeros(0, np.int64)
    gain = np.where(np.eye(n_lang, dtype=bool), 0.0, -switch)[None].repeat(b, axis=0).astype(np.float32)
    gain += score[first][:, None, :]
    for t in range(1, BLOCK):
        live = np.flatnonzero(first + t < last)
        if not len(live):
            break
        g = gain[live]
        gain[live] = np.maximum(g, _top(g) - switch) + score[first[live] + t][:, None, :]
    order = np.argsort(-blocks, kind="stable")
    start = (np.cumsum(blocks) - blocks)[order]
    left = blocks[order]
    value = np.zeros((len(order), n_lang), np.float32)
    back = np.zeros((b, n_lang), np.int64)
    steps = int(left.max())
    for k in range(steps):
        m = int(np.searchsorted(-left, -k, "left"))
        at = start[:m] + k
        through = value[:m, :, None] + gain[at]
        back[at] = through.argmax(axis=1)
        value[:m] = through.max(axis=1)
    end = np.zeros(b, np.int64)
    enter = np.zeros(b, np.int64)
    state = np.zeros(len(order), np.int64)
    for k in range(steps - 1, -1, -1):
        m = int(np.searchsorted(-left, -k, "left"))
        at = start[:m] + k
        ends_here = left[:m] == k + 1
        state[:m][ends_here] = value[:m][ends_here].argmax(axis=1)
        end[at] = state[:m]
        enter[at] = back[at, state[:m]]
        state[:m] = enter[at]
    best = np.where(np.arange(n_lang)[None] == enter[:, None], 0.0, -switch).astype(np.float32) + score[first]
    came = np.zeros((len(score), n_lang), np.int8)
    for t in range(1, BLOCK):
        live = np.flatnonzero(first + t < last)
        if not len(live):
            break
        v = best[live]
        top, least = v.argmax(axis=1), _top(v) - switch
        stay = v >= least
        came[first[live] + t] = np.where(stay, np.arange(n_lang)[None], top[:, None])
        best[live] = np.where(stay, v, least) + score[first[live] + t]
    label = np.zeros(len(score), np.int64)
    label[last - 1] = end
    now = end.copy()
    for t in range(BLOCK - 1, 0, -1):
        live = np.flatnonzero(first + t < last)
        at = first[live] + t
        now[live] = came[at, now[live]]
        label[at - 1] = now[live]
    return label


def _labelled(model, part):
    starts, ends, row, number, own, a, b, script = lettered(*lowered(part))
    label = viterbi(model.word_scores(own, a, b, script)[number], tx.bounds(row, part.num_rows)) if len(row) else np.zeros(0, np.int64)
    return starts, ends, row, label


def identified(spark: SparkSession, docs: DataFrame, speaker: Speaker | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text).

    lang_pred is the language of most bytes of words with letters (ties: the first by name),
    score their share; `und` with score 0 where text is null or has no letter (Unicode category L), or nothing was
    learned. Each row is judged by its own text; ids may repeat or be null.
    """
    model = spark.sparkContext.broadcast(speaker)

    def run(batches):
        m = model.value
        for batch in batches:
            for part, _, _ in tx.slices(batch, limit=SLICE):
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if m is not None:
                    starts, ends, row, label = _labelled(m, part)
                    k = len(m.langs)
                    mass = np.bincount(row * k + label, ends - starts, part.num_rows * k).reshape(-1, k)
                    total = mass.sum(axis=1)
                    some = total > 0
                    lang[some] = np.array(m.langs, object)[mass[some].argmax(axis=1)]
                    score[some] = mass[some].max(axis=1) / total[some]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def spans(spark: SparkSession, docs: DataFrame, speaker: Speaker | None) -> DataFrame:
    """doc_id, span, lang, text: the stretches of one language of every document, in order. Documents without letters have none."""
    model = spark.sparkContext.broadcast(speaker)

    def run(batches):
        m = model.value
        for batch in batches:
            for part, _, _ in tx.slices(batch, limit=SLICE):
                if m is None:
                    continue
                starts, _, row, label = _labelled(m, part)
                low, offs = lowered(part)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                r = row[at]
                after = np.append(at[1:], len(label))
                same = np.append(r[1:] == r[:-1], False) if len(r) else np.zeros(0, bool)
                begin = np.where(np.append(False, r[1:] == r[:-1]), starts[at], offs[r]) if len(r) else at
                stop = np.where(same, starts[np.minimum(after, len(starts) - 1)], offs[r + 1]) if len(r) else at
                # positions are of the lower-cased text; characters are counted to cut the text itself
                ids, raw, lower = part.column(0).to_pylist(), part.column(part.schema.get_field_index("text")).to_pylist(), low.tobytes()
                out, number, seen = [], 0, -1
                for d, a, b, lab in zip(r.tolist(), begin.tolist(), stop.tolist(), label[at].tolist()):
                    number = number + 1 if d == seen else 0
                    seen = d
                    i, j = (len(lower[offs[d] : x].decode("utf-8")) for x in (a, b))
                    out.append((ids[d], number, m.langs[lab], raw[d][i:j]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "span", "lang", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, span long, lang string, text string")
