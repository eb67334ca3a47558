"""LM scoring by logistic context mixing, beside a unigram base score.

A text is the sequence of its words (ASCII letters in lower case), each ended by a space,
and one end symbol. Its code has three parts.

Across words: a text is cut at content to segments of about SEGMENT words. After a segment
that other training texts (or this text, earlier) hold as well, one bit says whether the next
segment is among its known successors there, and if so the successor is coded by its count.
Hashed contexts (outcomes before, number of successors, distance) predict the bit, a mixer
gated by the outcomes before adds them in the logistic domain, and a map refines the sum. So
what the model knows of longer texts grows with the corpus. A training text doesn't count
for itself here.

Words of the other segments: a word's bucket (by its hash) is predicted decision by decision
by the words before it, mixed in the logistic domain (see sequence.py). In its bucket a word
that training holds costs by its exact count. The Good-Turing share of words counted once is
set aside for unseen words before that.

Unseen words: their bytes are predicted bit by bit, high bit first. Hashed contexts of the
word so far each predict the bit, a mixer adds their predictions with weights chosen by a
gate (bit, place in the word, and whether the longest context was ever seen), and an adaptive
probability map refines the sum. It learns online from the distinct words of training, task
by task, and the weights are averaged.

Distinct words are priced once; a document adds up the costs of its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sequence, tables
from . import text as tx
from .sequence import END, squash
from .storage import Scratch

U = np.uint64
#: Bytes of the word so far that a context sees, and bits of its table.
CONTEXTS = ((2, 16), (3, 18), (4, 19), (6, 20))
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for _, b in CONTEXTS])])
PLACES, LEVELS, MAP_LIMIT = 4, 33, 8.0
GATES = 2 * 8 * PLACES
PRIOR, STEP, MAP_PRIOR = 0.4, 0.02, 20.0
CHUNK = 1 << 15
SLICE = 1 << 19
#: Rows of slices that a task holds to merge their counts.
MERGE = 1 << 18
#: At most so many words, those above some count, have their costs in every task; the other words join theirs.
HEAD = 1 << 18
#: Mean words of a segment (a power of two), and most.
SEGMENT, LONGEST = 32, 128
#: Cells of the successor bit: outcomes before (two, each none, no or yes), magnitude of the successors' number, whether the last such bit was for the segment just before.
HISTORIES, MAGNITUDES = 9, 8
CELLS = HISTORIES * MAGNITUDES * 2


def held_out() -> Column:
    """Fifth 1 of crc32 of the id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


@dataclass
class Words:
    """Distinct words of a slice: hash, and for every token its row and its place among them; the last token of each row is the end."""

    key: np.ndarray
    inv: np.ndarray
    row: np.ndarray
    data: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(buf: np.ndarray, offs: np.ndarray) -> Words:
        n = len(offs) - 1
        low = tx.LOWER.take(buf)
        starts, ends, row = tx.words(low, offs)
        word = tx.spans(tx.prefix(low), starts, ends)
        key, inv = np.unique(np.append(word, np.full(n, END)), return_inverse=True)
        first = np.empty(len(key), np.int64)
        first[inv] = np.arange(len(inv))
        s = np.append(starts, np.zeros(n, np.int64))[first]
        e = np.append(ends, np.zeros(n, np.int64))[first]
        size = e - s + 1
        begin = np.cumsum(size) - size
        src = np.arange(int(size.sum())) - np.repeat(begin - s, size)
        data = np.append(low, np.uint8(0))[np.minimum(src, len(low))]
        data[begin + size - 1] = np.where(e > s, 32, 0)
        return Words(key, inv, np.append(row, np.arange(n)), data, begin)


def coded(words: Words, chunk: int = CHUNK):
    """Ranges of distinct words of about `chunk` bytes: (first word, last, word of each byte, bytes, context hashes, places, byte before)."""
    stop = np.append(words.begin[1:], len(words.data))
    i = 0
    while i < len(words.begin):
        j = max(i + 1, int(np.searchsorted(stop, words.begin[i] + chunk, "right")))
        a, b = words.begin[i], stop[j - 1]
        data = words.data[a:b]
        at = words.begin[i:j] - a
        size = stop[i:j] - words.begin[i:j]
        place = np.arange(b - a) - np.repeat(at, size)
        pre = tx.prefix(data)
        ctx = []
        for k, (n, _) in enumerate(CONTEXTS):
            lo = np.arange(b - a) - (np.minimum(place, n) if n else place)
            ctx.append(((tx.spans(pre, lo, np.arange(b - a)) ^ tx.STEPS[k + 1]) >> U(32)).astype(np.uint32))
        before = np.where(place > 0, np.append(np.uint8(0), data[:-1]), 0).astype(np.int64)
        yield i, j, np.repeat(np.arange(j - i), size), data, ctx, np.minimum(place, PLACES - 1), before
        i = j


def slots(ctx: list[np.ndarray], data: np.ndarray, bit: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Table slot of each context at a bit, and the bit."""
    node = ((1 << bit) | (data.astype(np.uint32) >> np.uint32(8 - bit))) * np.uint32(0x9E3779B1)
    out = []
    for k, (_, bits) in enumerate(CONTEXTS):
        h = ((ctx[k] ^ node) * np.uint32(0x85EBCA6B)) ^ (ctx[k] >> np.uint32(15))
        out.append(((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)).astype(np.int64))
    return out, ((data >> np.uint8(7 - bit)) & 1).astype(bool)


@dataclass
class Mixer:
    """Logits of the contexts' slots, weights by gate (longest context seen x bit x place), and the map's logits by (byte before, level)."""

    logit: np.ndarray
    weight: np.ndarray
    refine: np.ndarray | None
    seen: np.ndarray

    def mix(self, ctx, data, place, bit):
        where, y = slots(ctx, data, bit)
        st = np.empty((len(CONTEXTS) + 1, len(data)), np.float32)
        for k, s in enumerate(where):
            self.logit[OFFSETS[k] : OFFSETS[k + 1]].take(s, out=st[k], mode="clip")
        st[-1] = 0.3
        gate = self.seen[where[-1]] * (8 * PLACES) + bit * PLACES + place
        x = st[0] * self.weight[:, 0].take(gate)
        for k in range(1, len(st)):
            x += st[k] * self.weight[:, k].take(gate)
        return x, st, gate, y

    def cell(self, x, before):
        pos = (np.clip(x, -MAP_LIMIT, MAP_LIMIT) + MAP_LIMIT) * ((LEVELS - 1) / (2 * MAP_LIMIT))
        low = np.minimum(pos.astype(np.int64), LEVELS - 2)
        return before * LEVELS + low, (pos - low).astype(np.float32)

    def bits(self, words: Words) -> np.ndarray:
        """Code length of every distinct word in bits."""
        out = np.zeros(len(words.key))
        for i, j, which, data, ctx, place, before in coded(words):
            total = np.zeros(len(data))
            for bit in range(8):
                x, _, _, y = self.mix(ctx, data, place, bit)
                if self.refine is not None:
                    cell, part = self.cell(x, before)
                    x = 0.5 * x + 0.5 * (self.refine[cell] * (1 - part) + self.refine[cell + 1] * part)
                total += np.logaddexp(0, np.where(y, -x, x))
            out[i:j] = np.bincount(which, total, j - i) / np.log(2)
        return out


def _stream(batches):
    """Words from rows (word); data of each word with its end byte."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("word"))
        data, offs = tx.utf8(col)
        if len(col):
            yield Words(np.arange(len(col)), np.zeros(0), np.zeros(0), data, offs[:-1])


def _count(batches):
    table = np.zeros(2 * OFFSETS[-1], np.int64)
    for words in _stream(batches):
        for _, _, _, data, ctx, _, _ in coded(words):
            for bit in range(8):
                where, y = slots(ctx, data, bit)
                for k, s in enumerate(where):
                    np.add.at(table, 2 * (OFFSETS[k] + s) + y, 1)
    yield from tables.chunks({"counts": table})


def start_weights() -> np.ndarray:
    """Before training: the longer contexts lead, the longest only where it was seen."""
    n = len(CONTEXTS)
    off = np.append(0.2 * np.arange(1, n), [0.0, 0.0])
    on = np.append(np.full(n - 1, 0.15), [0.6, 0.0])
    return np.repeat(np.stack([off, on]), GATES // 2, axis=0).astype(np.float32)


def _learn(model):
    def run(batches):
        logit, seen = model.value
        m = Mixer(logit, start_weights(), None, seen)
        second = np.full(m.weight.shape, 1e-4)
        mass, steps, path = np.zeros(GATES), np.zeros(GATES), np.zeros(m.weight.shape)
        for words in _stream(batches):
            for _, _, _, data, ctx, place, _ in coded(words, CHUNK // 8):
                for bit in range(8):
                    x, st, gate, y = m.mix(ctx, data, place, bit)
                    err = y - squash(x)
                    n = np.bincount(gate, minlength=GATES)
                    now = np.flatnonzero(n)
                    n = n[now]
                    g = np.stack([np.bincount(gate, err * st[k], GATES)[now] for k in range(len(st))], axis=1) / n[:, None]
                    second[now] = 0.99 * second[now] + 0.01 * g * g
                    m.weight[now] += (STEP / np.sqrt(1 + steps[now] / 100))[:, None] * g / np.sqrt(second[now])
                    steps[now] += 1
                    late = n * (steps[now] > 20)  # the mean of the path, without its start, is what counts
                    path[now] += late[:, None] * m.weight[now]
                    mass[now] += late
        fixed = np.concatenate([path.reshape(-1), mass]) * 1024
        yield from tables.chunks({"weights": np.rint(fixed).astype(np.int64)})

    return run


def _gather(model):
    def run(batches):
        m = model.value
        table = np.zeros(2 * 256 * LEVELS, np.int64)
        for words in _stream(batches):
            for _, _, _, data, ctx, place, before in coded(words):
                for bit in range(8):
                    x, _, _, y = m.mix(ctx, data, place, bit)
                    cell, part = m.cell(x, before)
                    np.add.at(table, 2 * (cell + (part > 0.5)) + y, 1)
        yield from tables.chunks({"map": table})

    return run


def train(spark: SparkSession, vocabulary: DataFrame) -> Mixer:
    """A mixer for the bytes of words that it has not seen, from all training words of vocabulary(word, c), each once."""
    words = vocabulary.where("c > 0").select("word")
    n = tables.whole(tables.summed(words.mapInArrow(_count, tables.SCHEMA), 4).get("counts", {}), 2 * OFFSETS[-1]).reshape(-1, 2)
    logit = np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR)).astype(np.float32)
    seen = n[OFFSETS[-2] :].sum(axis=1) > 0
    del n
    k = len(CONTEXTS) + 1
    sent = spark.sparkContext.broadcast((logit, seen))
    sums = tables.whole(tables.summed(words.mapInArrow(_learn(sent), tables.SCHEMA)).get("weights", {}), GATES * (k + 1))
    sent.destroy()
    mass = sums[GATES * k :].astype(float)
    weight = np.where(mass[:, None] > 0, sums[: GATES * k].reshape(GATES, k) / np.maximum(mass, 1)[:, None], start_weights()).astype(np.float32)
    mixer = Mixer(logit, weight, None, seen)
    sent = spark.sparkContext.broadcast(mixer)
    c = tables.whole(tables.summed(words.mapInArrow(_gather(sent), tables.SCHEMA)).get("map", {}), 2 * 256 * LEVELS).reshape(-1, 2)
    sent.destroy()
    level = np.tile(np.linspace(-MAP_LIMIT, MAP_LIMIT, LEVELS), 256)
    mixer.refine = np.log((c[:, 1] + MAP_PRIOR * squash(level)) / (c[:, 0] + MAP_PRIOR * squash(-level))).astype(np.float32)
    return mixer


def segments(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, row, number in the row and hash of every segment: cut behind words whose hash with the word before says so, and every LONGEST words without such."""
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    begin = np.ones(len(word), bool)
    before = np.append(U(0), np.where(row[1:] == row[:-1], word[:-1], U(0)))  # nothing of another row
    pair = tx.mix(word * U(3) + before)
    begin[1:] = (row[1:] != row[:-1]) | (pair[:-1] % U(SEGMENT) == 0)
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, len(word)))
    begin |= (np.arange(len(word)) - np.repeat(first, size)) % LONGEST == 0
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, len(word)))
    p, inv = tx.powers(len(word) + 1)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * p[: len(word)])])
    h = tx.mix((pre[first + size] - pre[first]) * inv[first] + size.astype(np.uint64))
    r = row[first]
    return first, r, np.arange(len(first)) - np.searchsorted(r, r), h


def earlier(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: how often its keys stood before it, and how often they stand in all."""
    n = len(keys[0])
    order = np.lexsort((np.arange(n), *keys))
    new = np.ones(n, bool)
    for k in keys:
        s = k[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:] if n > 1 else new[1:]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    before, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[order] = np.arange(n) - np.repeat(first, size)
    total[order] = np.repeat(size, size)
    return before, total


STEPS = "p long, s long, doc_id long, th long, ord int, training int, dp int, ds int"


def _steps(batches):
    """doc_id, th, text, training -> STEPS: every segment behind another one; dp and ds are what the text itself adds to the counts of p and of (p, s)."""
    for batch in batches:
        for part, buf, offs in tx.slices(batch, limit=SLICE):
            low = tx.LOWER.take(buf)
            starts, ends, row = tx.words(low, offs)
            _, r, ord_, h = segments(tx.spans(tx.prefix(low), starts, ends), row)
            at = np.flatnonzero(ord_ > 0)
            if not len(at):
                continue
            r, p, s = r[at], h[at - 1], h[at]
            learn = tx.ints(part, "training").astype(np.int64)[r]
            before_p, own_p = earlier(p, r)
            before_s, own_s = earlier(s, p, r)
            take = pa.array(r)
            i32 = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(s.view(np.int64)), part.column(0).take(take), part.column(1).take(take), i32(ord_[at]), i32(learn), i32(before_p - learn * own_p), i32(before_s - learn * own_s)], ["p", "s", "doc_id", "th", "ord", "training", "dp", "ds"])


def cells(number: np.ndarray, n: np.ndarray, hit: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Cell of each successor bit, from what is known before it: rows in order, segment numbers in order within a row."""
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    one = np.where(first, 0, np.append(0, hit[:-1] + 1))
    two = np.where(first | np.append(True, first[:-1]), 0, np.append([0, 0], hit[:-2] + 1)[: len(row)])
    near = ~first & (np.append(0, number[:-1]) == number - 1)
    size = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), MAGNITUDES - 1)
    return ((one * 3 + two) * MAGNITUDES + size) * 2 + near


def bit_costs(counts: np.ndarray) -> np.ndarray:
    """(CELLS, 2) bits of a no and a yes in each cell, from the outcomes counted there: contexts mixed by the outcomes before, and refined."""
    n = counts.reshape(HISTORIES, MAGNITUDES, 2, 2).astype(float)
    views = [n.sum(axis=(1, 2), keepdims=True), n.sum(axis=(0, 2), keepdims=True), n.sum(axis=(0, 1), keepdims=True), n.sum(axis=2, keepdims=True)]
    st = np.stack([np.broadcast_to(np.log((v[..., 1] + PRIOR) / (v[..., 0] + PRIOR)), n.shape[:3]) for v in views], axis=-1)
    weight = np.full((HISTORIES, len(views)), 1 / len(views))
    total = np.maximum(n.sum(axis=(1, 2, 3)), 1.0)
    for _ in range(300):
        x = np.einsum("hmgk,hk->hmg", st, weight)
        err = n[..., 1] - (n[..., 0] + n[..., 1]) * squash(x)
        weight += 0.3 * np.einsum("hmg,hmgk->hk", err, st) / total[:, None] / np.maximum((st**2).mean(axis=(1, 2)), 1.0)
    x = np.einsum("hmgk,hk->hmg", st, weight)
    p = (n[..., 1] + MAP_PRIOR * squash(x)) / (n.sum(axis=-1) + MAP_PRIOR)
    return -np.log2(np.clip(np.stack([1 - p, p], axis=-1), 1e-9, 1)).reshape(CELLS, 2)


def _events(batch) -> tuple[np.ndarray, ...]:
    """Row, segment number, successors and count of this one, of each event of a batch."""
    column = batch.column(batch.schema.get_field_index("events"))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten()
    field = lambda name: flat.field(name).to_numpy().astype(np.int64)
    return np.repeat(np.arange(batch.num_rows), size), field("ord"), field("n"), field("c")


def _outcomes(batches):
    table = np.zeros(2 * CELLS, np.int64)
    for batch in batches:
        row, number, n, c = _events(batch)
        if len(row):
            hit = (c > 0).astype(np.int64)
            np.add.at(table, 2 * cells(number, n, hit, row) + hit, 1)
    yield from tables.chunks({"bits": table})


def _merged(parts: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """The counts of equal hashes in one row."""
    key, inv = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    first = np.empty(len(key), np.int64)
    first[inv] = np.arange(len(inv))
    c = np.bincount(inv, np.concatenate([x[2] for x in parts]), len(key)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.concat_arrays([x[1] for x in parts]).take(pa.array(first)), pa.array(c)], ["h", "word", "c"])


def _tokens(batches):
    """Distinct tokens, with the end byte, and their counts in training texts; merged whenever MERGE rows of slices are there."""
    parts, rows = [], 0
    for batch in batches:
        for part, buf, offs in tx.slices(batch, limit=4 * SLICE):
            words = Words.of(buf, offs)
            learn = tx.ints(part, "training").astype(float)
            c = np.bincount(words.inv, learn[words.row], len(words.key))
            at = np.append(words.begin, len(words.data)).astype(np.int32)
            word = pa.Array.from_buffers(pa.binary(), len(words.key), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(words.data))])
            parts.append((words.key, word, c))
            rows += len(words.key)
            if rows >= MERGE:
                yield _merged(parts)
                parts, rows = [], 0
    if parts:
        yield _merged(parts)


def _spell(model):
    def run(batches):
        for batch in batches:
            for words in _stream([batch]):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.bits(words))], ["h", "bits"])

    return run


PARTS = "doc_id long, th long, h long, n long, out long, way float, n_known long, base double, bits double, n_bytes long"


def _split(head, costs, model, weight, turns):
    """doc_id, th, text, training, events -> a row a document with its sums over the head words (h null), and a row for each other distinct word of it; out: how often outside known segments; way: bits of its bucket there."""

    def run(batches):
        keys, seen, logs, known = head.value
        mixer = sequence.Sequence(*model.value, weight, turns)
        names = ["doc_id", "th", "h", "n", "out", "way", "n_known", "base", "bits", "n_bytes"]
        for batch in batches:
            for part, buf, offs in tx.slices(batch, limit=SLICE):
                n = part.num_rows
                words = Words.of(buf, offs)
                outside = np.ones(len(words.inv))
                bits = np.zeros(n)
                row, number, total, c = _events(part)
                if len(row):
                    hit = (c > 0).astype(np.int64)
                    spent = costs.value[cells(number, total, hit, row), hit] + np.where(hit, np.log2(total / np.maximum(c, 1)), 0)
                    bits += np.bincount(row, spent, n)
                    m = len(words.inv) - n  # ends of texts come last and are in no segment
                    first, r, _, _ = segments(words.key[words.inv[:m]], words.row[:m])
                    at = np.searchsorted(r, row[hit > 0]) + number[hit > 0]
                    stop = np.append(first[1:], m)[at]
                    edge = np.zeros(m + 1, np.int64)
                    np.add.at(edge, first[at], 1)
                    np.add.at(edge, stop, -1)
                    outside[:m] = np.cumsum(edge)[:-1] == 0
                at = np.minimum(np.searchsorted(keys, words.key), len(keys) - 1)
                there = keys[at] == words.key
                sums = [np.bincount(words.row, np.where(there, x[at], 0.0)[words.inv], n) for x in (seen, logs)]
                word = words.key[words.inv]
                todo = np.flatnonzero(outside)
                own = tx.ints(part, "training").astype(bool)[words.row[todo]]
                way = np.zeros(len(word))
                way[todo] = mixer.bits(word[todo], [c[todo] for c in sequence.contexts(word, words.row)], own)
                bits += np.bincount(words.row, np.where(there, known[at], 0.0)[words.inv] * outside + way * (there & seen[at])[words.inv], n)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), none, pa.array(np.bincount(words.row, minlength=n)), none, pa.nulls(n, pa.float32()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(bits), pa.array(np.diff(offs))], names)
                tail = ~there[words.inv]
                pair, where, times = np.unique(words.row[tail] * len(words.key) + words.inv[tail], return_inverse=True, return_counts=True)
                row, which = np.divmod(pair, len(words.key))
                if k := len(row):
                    none, take = pa.nulls(k, pa.float64()), pa.array(row)
                    out = np.bincount(where, outside[tail], k).astype(np.int64)
                    spent = np.bincount(where, way[tail], k).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(words.key[which].view(np.int64)), pa.array(times), pa.array(out), pa.array(spent), pa.nulls(k, pa.int64()), none, none, pa.nulls(k, pa.int64())], names)

    return run


def _in(bits, inside: bool):
    """The rows whose (doc_id, th) may be, or cannot be, in a bitmap of hashes `u`; `u` is dropped."""

    def run(batches):
        for batch in batches:
            u = batch.column(batch.schema.get_field_index("u")).to_numpy().astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(tables.in_bitmap(bits.value, u) == inside)).drop_columns(["u"])

    return run


def successors(spark: SparkSession, slim: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, th, events(ord, n, c): the segments of each text whose predecessor is known elsewhere, with the number of its known successors and how many are this one."""
    steps = scratch.keep("steps", slim.select("doc_id", "th", "text", (~held_out()).alias("training")).mapInArrow(_steps, STEPS))
    pairs = scratch.keep("pairs", steps.groupBy("p", "s").agg(F.sum("training").alias("c"), F.count(F.lit(1)).alias("m")))
    known = pairs.groupBy("p").agg(F.sum("c").alias("n"), F.sum("m").alias("m")).where("m > 1").select("p", "n")
    near = steps.select("p", "s", "doc_id", "th", "ord", "dp", "ds").join(known, "p").withColumn("n", F.expr("n + dp")).where("n > 0")
    counted = near.join(pairs.where("m > 1").select("p", "s", "c"), ["p", "s"], "left").withColumn("c", F.coalesce(F.col("c") + F.col("ds"), F.lit(0)))
    event = F.struct("ord", F.col("n").cast("long").alias("n"), F.col("c").cast("long").alias("c"))
    events = scratch.keep("events", counted.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(event)).alias("events")))
    scratch.drop("steps", "pairs")
    return events


def head_count(priced: DataFrame) -> int:
    """The least count that at most HEAD words of priced(c) reach."""
    found = priced.groupBy("c").agg(F.count(F.lit(1)).alias("words")).toArrow()
    c, words = (found.column(i).to_numpy() for i in range(2))
    order = np.argsort(-c)
    fits = np.cumsum(words[order]) <= HEAD
    return int(c[order][fits][-1]) if fits.any() else int(c.max(initial=0)) + 1


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs(doc_id, text).

    Training texts are those outside the held-out fifth. base_score is the sum over tokens
    of log10((c + 0.5) / (N + 0.5 * (V + 1))) with counts of all training tokens; the end
    of a text is a token of its own, and unseen words are one class. score is log10 of the
    probability that the code of the module's head gives the text, unseen words spelled;
    bits_per_byte the same in bits over the bytes of the text (null for none). Null counts as
    empty text. Words and segments are told apart by 64-bit hashes. Rows may repeat an id, or
    have none: each is scored by its own text; an empty table gives an empty result.

    The costs of the most frequent words, HEAD at most, go to all tasks; only the other words of each
    document are shuffled to meet theirs, so no hot word is a hot key. Only texts that share
    a segment with another one are shuffled, to meet their events.
    """
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    counted = slim.select("text", (~held_out()).alias("training")).mapInArrow(_tokens, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))
    vocabulary = scratch.keep("vocabulary", counted)
    n, v, once = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    floor = float(n + 0.5 * (v + 1))
    new = (once + 0.5) / (n + 1) if n else 1.0
    mixer = spark.sparkContext.broadcast(train(spark, vocabulary))
    unseen = vocabulary.where("c = 0").select("h", "word").mapInArrow(_spell(mixer), "h long, bits double").select("h", F.lit(0).cast("long").alias("c"), (F.col("bits") - float(np.log2(new))).alias("bits"))
    bucket = F.shiftrightunsigned("h", 64 - sequence.BUCKET_BITS).alias("bucket")
    inside = vocabulary.where("c > 0").groupBy(bucket).agg(F.sum("c").alias("all"))
    found = inside.toArrow()
    mass = np.zeros(sequence.BUCKETS, np.int64)
    mass[found.column(0).to_numpy()] = found.column(1).to_numpy()
    total = spark.createDataFrame(pa.table({"bucket": np.arange(sequence.BUCKETS), "all": mass}))
    cost = F.log2("all") - F.log2("c") - F.lit(float(np.log2(1 - new)) if new < 1 else 0.0)
    seen = vocabulary.where("c > 0").select("h", "c", bucket).join(F.broadcast(total), "bucket")
    priced = scratch.keep("priced", unseen.unionByName(seen.select("h", "c", cost.alias("bits"))))
    mixer.destroy()
    scratch.drop("vocabulary")
    top = priced.where(F.col("c") >= head_count(priced)).toArrow()
    if not top.num_rows:
        top = pa.table({"h": [0], "c": [0], "bits": [0.0]})
    keys = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    count, known = top.column("c").to_numpy()[order], top.column("bits").to_numpy()[order]
    head = spark.sparkContext.broadcast((keys[order], count > 0, np.log10((count + 0.5) / floor), known))
    del top
    model, weight, turns = sequence.train(spark, slim.where(~held_out()).select("text"), mass)
    events = successors(spark, slim, scratch)
    learned = events.where(~held_out()).mapInArrow(_outcomes, tables.SCHEMA)
    costs = spark.sparkContext.broadcast(bit_costs(tables.whole(tables.summed(learned).get("bits", {}), 2 * CELLS).reshape(-1, 2)))
    unit = F.xxhash64("doc_id", "th")
    bits = spark.sparkContext.broadcast(tables.bitmap(events, unit))
    plain = "doc_id long, text string, th long, training boolean"
    marked = slim.withColumn("training", ~held_out()).withColumn("u", unit)
    quiet = marked.withColumn("events", F.lit(None).cast("array<struct<ord:int,n:bigint,c:bigint>>"))
    loud = marked.mapInArrow(_in(bits, True), plain).alias("d").join(events.alias("e"), F.expr("d.doc_id <=> e.doc_id AND d.th = e.th"), "left").select("d.doc_id", "d.text", "d.th", "d.training", "e.events")
    columns = ["doc_id", "th", "text", "training", "events"]
    split, rest = _split(head, costs, model, weight, turns), _in(bits, False)
    alone = quiet.select(*columns, "u").mapInArrow(lambda batches: split(rest(batches)), PARTS)  # one Python worker a task
    parts = scratch.keep("parts", alone.unionByName(loud.select(columns).mapInArrow(split, PARTS)))
    for sent in (head, model, costs, bits):
        sent.destroy()
    scratch.drop("events")
    known = F.col("c") > 0
    tail = parts.where("h IS NOT NULL").select("doc_id", "th", "h", "n", "out", "way").join(priced, "h").select("doc_id", "th", F.when(known, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(floor))).alias("base"), (F.col("out") * F.col("bits") + F.when(known, F.col("way")).otherwise(0)).alias("bits"))
    sums = ["n_known", "base", "bits"]
    tails = tail.groupBy("doc_id", "th").agg(*(F.sum(c).alias(c) for c in sums))
    zero = F.lit(0).cast("long")
    both = parts.where("h IS NULL").select("doc_id", "th", F.lit(1).alias("rows"), "n", *sums, "n_bytes").unionByName(tails.select("doc_id", "th", F.lit(0).alias("rows"), zero.alias("n"), *sums, zero.alias("n_bytes")))
    total = both.groupBy("doc_id", "th").agg(*(F.sum(c).alias(c) for c in ("rows", "n", *sums, "n_bytes")))
    # equal rows of an id were summed: each has its share
    each = total.withColumn("_", F.explode(F.expr("sequence(1L, rows)")))
    whole = lambda c: F.expr(f"{c} div rows")
    real = lambda c: F.col(c) / F.col("rows")
    return each.select("doc_id", held_out().alias("held_out"), whole("n").alias("n_tokens"), whole("n_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), real("base").alias("base_score"), (real("bits") * float(-np.log10(2))).alias("score"), F.expr("bits / nullif(n_bytes, 0)").alias("bits_per_byte"))
