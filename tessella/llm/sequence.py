"""Words predicted in sequence by logistic mixing of word contexts.

A word belongs to one of 2**12 buckets by its hash, and a bucket is told by the decisions on
its way down a Huffman tree of the training tokens' buckets. Each decision is predicted by
the node alone and by the one and the two words before with the node (slots of hashed tables
that count no and yes). A mixer adds the predictions in the logistic domain with weights
chosen by how much each context has seen there and whether that was of one kind, and an
adaptive map refines the sum. Counts are those of all training tokens, without the token
itself where it is one; the weights and the map learn online, task by task, from the error
of each prediction, and the weights are averaged.

The end of a text is a word as well, and is predicted and looked back at like one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import tables
from . import text as tx

U = np.uint64
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
#: Words that the longest context looks back at, and bits of each context's table.
ORDERS, SLOT_BITS = 2, 22
#: Kinds of evidence in a slot: six magnitudes of its count, the last four apart where it has both outcomes.
STATES = 10
GATES = STATES**ORDERS
INPUTS = ORDERS + 2
#: Levels of the map over logits of -MAP_LIMIT to MAP_LIMIT.
LEVELS, MAP_LIMIT, MAP_PRIOR, STEP = 129, 8.0, 20.0, 0.02
#: Tokens of a step of learning, and of a block of scoring.
LESSON, BLOCK = 1 << 12, 1 << 13
SLICE = 1 << 17
#: Bits of a slot that the context alone decides, so that contexts in order stay in one part of the table; tokens that are brought in order at once.
PART_BITS, TOKENS = 6, 1 << 19
#: A slot as seen by a token: its logit in 12 bits, in steps of 1/SHARP around 0, and its kind of evidence above them.
LOW, MIDDLE, SHARP = 0xFFF, 2048, 128
END = tx.mix(np.array([0xE0F], np.uint64))[0]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def buckets(word: np.ndarray) -> np.ndarray:
    return (word >> U(64 - BUCKET_BITS)).astype(np.int64)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token of texts in lower case; the words come first, then the end of each row."""
    starts, ends, row = tx.words(buf, offs)
    n = len(offs) - 1
    return np.append(tx.spans(tx.prefix(buf), starts, ends), np.full(n, END)), np.append(row, np.arange(n))


def contexts(word: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """For each token, in the order of `tokens`, the hash of the word before it, of the two before, and so on; nothing of another row."""
    n = int(row[-1]) + 1 if len(row) else 0
    inner, every = row[: len(row) - n], np.arange(n)
    place = np.append(np.arange(len(inner)) + inner, np.searchsorted(inner, every, "right") + every)
    w, r = np.empty_like(word), np.empty_like(row)
    w[place], r[place] = word, row
    out, h = [], np.zeros(len(w), np.uint64)
    for k in range(1, ORDERS + 1):
        back = np.zeros(len(w), np.uint64)
        back[k:] = np.where(r[k:] == r[:-k], w[:-k], U(0))
        h = tx.mix(h * U(3) + back + tx.STEPS[k])
        out.append((h >> U(32)).astype(np.uint32)[place])
    return out


@dataclass
class Tree:
    """Decisions of bucket b: size[b] of them, the one of depth d at [d, b]. code: the node, hashed, even and PART_BITS short, plus 1 for a yes; logit: of a yes there."""

    size: np.ndarray
    code: np.ndarray
    logit: np.ndarray

    @staticmethod
    def of(count: np.ndarray) -> Tree:
        """The Huffman tree of the buckets' counts; buckets without any count half."""
        n = len(count)
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, bool)
        heap = [(2 * c + 1, i) for i, c in enumerate(count.tolist())]
        heapq.heapify(heap)
        for k in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = k
            side[j] = True
            heapq.heapreplace(heap, (a + b, k))
        leaf, here, parts = np.arange(n), np.arange(n), []
        while len(here):
            parts.append((leaf, up[here] - n, side[here]))
            on = up[here] != 2 * n - 2
            leaf, here = leaf[on], up[here][on]
        leaf, node, yes = (np.concatenate(x) for x in zip(*parts))
        size = np.bincount(leaf, minlength=n)
        mass = (count + 0.5)[leaf]
        ones, all_ = np.bincount(node, mass * yes, n - 1), np.bincount(node, mass, n - 1)
        depth = np.concatenate([size[x[0]] - 1 - k for k, x in enumerate(parts)])
        code, logit = np.zeros((size.max(), n), np.uint32), np.zeros((size.max(), n), np.float32)
        code[depth, leaf] = (node.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(PART_BITS) & ~np.uint32(1)) | yes
        logit[depth, leaf] = np.log(ones / (all_ - ones))[node]
        return Tree(size, code, logit)

    def way(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the tokens by falling number of decisions, and how many have a decision of each depth."""
        size = self.size[bucket]
        order = np.argsort((size.max(initial=0) - size).astype(np.uint16), kind="stable")
        return order, np.cumsum(np.bincount(size)[::-1])[::-1][1:]


def levels(many: np.ndarray) -> list[tuple[int, slice]]:
    """Of all decisions, listed depth by depth with the tokens in the order of Tree.way: how many tokens, and where."""
    stop = np.cumsum(many).tolist()
    return [(n, slice(e - n, e)) for n, e in zip(many.tolist(), stop)]


def listed(table: np.ndarray, bucket: np.ndarray, steps: list[tuple[int, slice]]) -> np.ndarray:
    """Entries of table[depth, bucket] for all decisions of the ordered tokens' buckets."""
    out = np.empty(steps[-1][1].stop if steps else 0, table.dtype)
    for row, (n, at) in zip(table, steps):
        row.take(bucket[:n], out=out[at], mode="clip")
    return out


def slot(ctx: np.ndarray, node: np.ndarray, steps: list[tuple[int, slice]]) -> np.ndarray:
    """Slot of every decision, from the ordered tokens' contexts."""
    h = np.empty_like(node)
    for n, at in steps:
        np.bitwise_xor(ctx[:n], node[at], out=h[at])
    part = h >> np.uint32(32 - PART_BITS)  # nodes have no such bits
    part <<= np.uint32(SLOT_BITS - PART_BITS)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - SLOT_BITS + PART_BITS)
    h |= part
    return h


#: Count that a byte stands for: itself below 64, within a twentieth above.
COUNTS = np.append(np.arange(64), np.rint(2.0 ** (6 + np.arange(1, 193) * 26 / 192)).astype(np.int64))
EDGES = np.append(COUNTS[1:64], np.ceil(np.sqrt(COUNTS[63:-1] * COUNTS[64:].astype(float))).astype(np.int64))


def views(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """Both counts of every slot in two bytes; LOOKS tells what they say."""
    out = np.empty(len(no), np.uint16)
    for i in range(0, len(no), 1 << 18):
        n, y = (np.searchsorted(EDGES, c[i : i + (1 << 18)], "right") for c in (no, yes))
        out[i : i + (1 << 18)] = (n << 8) | y
    return out


def _looks() -> np.ndarray:
    """What two bytes of counts say to a token that is not in them (first 2**16), that is there with a no, and with a yes."""
    out = []
    for a, b in ((0, 0), (1, 0), (0, 1)):
        n, y = np.repeat(np.maximum(COUNTS - a, 0), 256), np.tile(np.maximum(COUNTS - b, 0), 256)
        logit = np.rint(np.log((y + 0.4) / (n + 0.4)) * SHARP).astype(np.int64)
        state = np.searchsorted([1, 2, 4, 16, 256], n + y, "right") + 4 * ((n > 0) & (y > 0))
        out.append((state << 12) | (np.clip(logit, -MIDDLE, MIDDLE - 1) + MIDDLE))
    return np.concatenate(out).astype(np.uint16)


LOOKS = _looks()


def start_weights() -> np.ndarray:
    """Before learning: the longest context with evidence leads."""
    out = np.zeros((STATES, STATES, INPUTS))
    out[0, 0, :3] = 1, 0, 0
    out[0, 1:, :3] = 0.4, 0.6, 0
    out[1:, 0, :3] = 0.4, 0, 0.6
    out[1:, 1:, :3] = 0.2, 0.3, 0.5
    return out.reshape(GATES, INPUTS).astype(np.float32)


@dataclass
class Sequence:
    """Counts of the slots, by context (see views), weights by gate, and the bits of a no and a yes by (gate, level)."""

    tree: Tree
    said: np.ndarray
    weight: np.ndarray
    costs: np.ndarray | None

    def mix(self, word, ctx, own):
        """Order of the tokens and steps of their decisions, and of all decisions the outcome, inputs, gate, mixed logit and cell of the map; own: 1 for tokens that are in the counts themselves."""
        bucket = buckets(word)
        order, many = self.tree.way(bucket)
        steps, bucket = levels(many), bucket[order]
        node = listed(self.tree.code, bucket, steps)
        y = node & np.uint32(1)
        node ^= y
        view = y + np.uint32(1)
        view <<= np.uint32(16)
        if not own.all():
            mine = own[order].astype(np.uint32)
            for n, at in steps:
                view[at] *= mine[:n]
        st = np.empty((INPUTS, len(y)), np.float32)
        st[0], st[-1] = listed(self.tree.logit, bucket, steps), 0.3
        kinds = np.zeros(len(y), np.uint16)
        for k in range(ORDERS):
            at = slot(ctx[k][order], node, steps)
            v = LOOKS.take(view | self.said[k].take(at))
            kinds *= np.uint16(STATES)
            kinds += v >> np.uint16(12)
            np.subtract(v & np.uint16(LOW), np.float32(MIDDLE), out=st[k + 1], dtype=np.float32)
            st[k + 1] *= np.float32(1 / SHARP)
        gate = kinds.astype(np.int64)
        x = st[0] * self.weight[:, 0].take(gate)
        for k in range(1, INPUTS - 1):
            x += st[k] * self.weight[:, k].take(gate)
        x += (self.weight[:, -1] * np.float32(0.3)).take(gate)
        level = np.clip(x, -MAP_LIMIT, MAP_LIMIT)
        level += np.float32(MAP_LIMIT)
        level *= np.float32((LEVELS - 1) / (2 * MAP_LIMIT))
        level += np.float32(0.5)
        cell = gate * LEVELS
        cell += level.astype(np.int32)
        return order, steps, y, st, gate, x, cell

    def bits(self, word: np.ndarray, ctx: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        """Code length of every token's bucket in bits; own: 1 for tokens of training texts, else 0."""
        out = np.zeros(len(word))
        flat = self.costs.reshape(-1)
        for i in range(0, len(word), BLOCK):
            j = min(i + BLOCK, len(word))
            order, steps, y, _, _, _, cell = self.mix(word[i:j], [c[i:j] for c in ctx], own[i:j])
            cell *= 2
            cell += y
            spent, total = flat.take(cell), np.zeros(j - i)
            for n, at in steps:
                total[:n] += spent[at]
            out[i:j][order] = total
        return out


def _texts(batches) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        for _, buf, offs in tx.slices(batch, limit=SLICE):
            word, row = tokens(tx.LOWER.take(buf), offs)
            yield word, contexts(word, row)


def _add(table: np.ndarray, tree: Tree, key: np.ndarray) -> None:
    """Adds the decisions of tokens, given as context and bucket in one number, to a table of no and yes by slot; equal ones at once."""
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(first, len(key))).astype(np.uint32)
    key = key[first]
    ctx, bucket = (key >> U(BUCKET_BITS)).astype(np.uint32), (key & U(BUCKETS - 1)).astype(np.int64)
    for i in range(0, len(key), BLOCK):
        b, c, t = (x[i : i + BLOCK] for x in (bucket, ctx, times))
        order, many = tree.way(b)
        steps = levels(many)
        node = listed(tree.code, b[order], steps)
        y = node & np.uint32(1)
        node ^= y
        s = slot(c[order], node, steps)
        s <<= np.uint32(1)
        s |= y
        t, n_times = t[order], np.empty(len(s), np.uint32)
        for n, at in steps:
            n_times[at] = t[:n]
        np.add.at(table, s.astype(np.int64), n_times)


def _tally(tree):
    def run(batches):
        table = np.zeros((ORDERS, 2 << SLOT_BITS), np.uint32)
        held, size = [[] for _ in range(ORDERS)], 0
        for word, ctx in _texts(batches):
            bucket = buckets(word).astype(np.uint64)
            for k in range(ORDERS):
                held[k].append(ctx[k].astype(np.uint64) << U(BUCKET_BITS) | bucket)
            size += len(word)
            if size >= TOKENS:
                for k in range(ORDERS):
                    _add(table[k], tree.value, np.concatenate(held[k]))
                held, size = [[] for _ in range(ORDERS)], 0
        if size:
            for k in range(ORDERS):
                _add(table[k], tree.value, np.concatenate(held[k]))
        yield from tables.packed(table.reshape(-1))

    return run


def _learn(model):
    def run(batches):
        m = Sequence(*model.value, start_weights(), None)
        second = np.full(m.weight.shape, 1e-4)
        mass, steps, path = np.zeros(GATES), np.zeros(GATES), np.zeros(m.weight.shape)
        seen = np.zeros(2 * GATES * LEVELS, np.int64)
        for word, ctx in _texts(batches):
            for i in range(0, len(word), LESSON):
                some = word[i : i + LESSON]
                _, _, y, st, gate, x, cell = m.mix(some, [c[i : i + LESSON] for c in ctx], np.ones(len(some), bool))
                cell *= 2
                cell += y
                seen += np.bincount(cell, minlength=len(seen))
                err = y.astype(np.float32) - squash(x)
                n = np.bincount(gate, minlength=GATES)
                now = np.flatnonzero(n)
                n = n[now]
                g = np.stack([np.bincount(gate, err * st[k], GATES)[now] for k in range(INPUTS)], axis=1) / n[:, None]
                second[now] = 0.99 * second[now] + 0.01 * g * g
                m.weight[now] += (STEP / np.sqrt(1 + steps[now] / 100))[:, None] * g / np.sqrt(second[now])
                steps[now] += 1
                late = n * (steps[now] > 20)  # the mean of the path, without its start, is what counts
                path[now] += late[:, None] * m.weight[now]
                mass[now] += late
        fixed = np.concatenate([path.reshape(-1), mass]) * 1024
        yield from tables.chunks({"weights": np.rint(fixed).astype(np.int64), "map": seen})

    return run


def train(spark: SparkSession, texts: DataFrame, count: np.ndarray) -> tuple[Broadcast, np.ndarray, np.ndarray]:
    """The parts of the Sequence of texts(text), all of them training texts: tree and slots in every task, weights, costs. count: their tokens by bucket."""
    tree = Tree.of(count)
    slots = tables.unpacked(texts.mapInArrow(_tally(spark.sparkContext.broadcast(tree)), tables.PACKED), ORDERS << (SLOT_BITS + 1)).reshape(ORDERS, -1, 2)
    said = np.stack([views(s[:, 0], s[:, 1]) for s in slots])
    del slots
    model = spark.sparkContext.broadcast((tree, said))
    del said
    learned = tables.summed(texts.mapInArrow(_learn(model), tables.SCHEMA))
    return model, *settled(learned)


def settled(learned: dict[str, dict[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and costs from the sums of all tasks."""
    sums = tables.whole(learned.get("weights", {}), GATES * (INPUTS + 1))
    mass = sums[GATES * INPUTS :].astype(float)
    weight = np.where(mass[:, None] > 0, sums[: GATES * INPUTS].reshape(GATES, INPUTS) / np.maximum(mass, 1)[:, None], start_weights()).astype(np.float32)
    c = tables.whole(learned.get("map", {}), 2 * GATES * LEVELS).reshape(-1, 2)
    level = np.tile(np.linspace(-MAP_LIMIT, MAP_LIMIT, LEVELS), GATES)
    p = (c[:, 1] + MAP_PRIOR * squash(level)) / (c.sum(axis=1) + MAP_PRIOR)
    return weight, -np.log2(np.stack([1 - p, p], axis=1))
