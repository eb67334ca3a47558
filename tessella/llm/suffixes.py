"""Exact substring dedup with suffixes sorted by deep-shallow sorting.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else.
Only suffixes at content-defined anchors are sorted: the anchor of a window of `length`
bytes is its leftmost smallest k-gram hash, so equal windows have equal anchors at equal
places, and each anchor owns the consecutive windows that chose it.

Anchors meet by k-gram. Equal surroundings (all owned windows of an anchor) are counted
before anything is sorted, so copies of any number are one class, and a class seen twice is
settled. What is left shares a k-gram but differs around it: there the suffixes that start
at the anchors, and the reversed texts before them, are sorted (multikey quicksort to a
shallow depth, blind tries below) and the common lengths on both sides tell which owned
windows recur. Groups with more classes than one task should hold are split by the place
of the anchor in the window, which lengthens the string that members share, until they fit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .storage import Scratch

U = np.uint64
LENGTH, GRAM = 400, 100
#: Bytes behind the known common part that multikey quicksort looks at.
SHALLOW = 8
#: Most classes that are sorted together.
GROUP = 1024
SPLIT = 8
ANCHORS = "h long, c long, doc_id long, k long, pos long, lo long, hi long, n long"
CONTEXTS = "h0 long, c0 long, key long, cls long, n long, ctx binary, off int, la int, lb int"


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each stretch of w values: prefix minima of blocks of w against suffix minima."""
    n = len(v) - w + 1
    blocks = -(-len(v) // w)
    padded = np.full(blocks * w, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Row, place, first and last owned window, k-gram hash and hash of the surroundings of every anchor."""
    size = np.diff(offs)
    n_win = np.maximum(size - length + 1, 0)
    total = int(n_win.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    pre = tx.prefix(buf)
    at = np.arange(len(buf) - gram + 1)
    kg = tx.spans(pre, at, at + gram)
    v = (kg & U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    low = sliding_min(v, length - gram + 1)
    row = np.repeat(np.arange(len(size)), n_win)
    s = np.arange(total) - np.repeat(np.cumsum(n_win) - n_win - offs[:-1], n_win)
    p = (low[s] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], total) - 1
    p, lo, hi = p[first], s[first], s[last]
    outer = tx.mix(tx.spans(pre, lo, hi + length) ^ tx.mix((p - lo).astype(np.uint64)))
    return row[first], p, lo, hi, kg[p], outer


def _anchors(length, gram):
    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.slices(batch):
                row, p, lo, hi, h, c = anchors(buf, offs, length, gram)
                if not len(row):
                    continue
                order = np.lexsort((p, c, h, row))
                row, p, lo, hi, h, c = (x[order] for x in (row, p, lo, hi, h, c))
                new = np.ones(len(row), bool)
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(row)))
                ids, keys = tx.ints(part, "doc_id"), tx.ints(part, "k")
                base = offs[:-1]
                signed = lambda x: pa.array(x.view(np.int64))
                r = row[first]
                yield pa.RecordBatch.from_arrays([signed(h[first]), signed(c[first]), pa.array(ids[r]), pa.array(keys[r]), pa.array(p[first] - base[r]), pa.array(lo[first] - base[r]), pa.array(hi[first] - base[r]), pa.array(times)], ["h", "c", "doc_id", "k", "pos", "lo", "hi", "n"])
                # surroundings that come twice in one text settle there: their stretches, merged
                again = np.flatnonzero(np.repeat(times > 1, times))
                if len(again):
                    o = again[np.lexsort((lo[again], row[again]))]
                    r, a, b = row[o], lo[o], hi[o] + length
                    reach = np.maximum.accumulate(b)
                    cut = np.ones(len(o), bool)
                    cut[1:] = (a[1:] > reach[:-1]) | (r[1:] != r[:-1])
                    f = np.flatnonzero(cut)
                    e = reach[np.append(f[1:], len(o)) - 1]
                    r, a = r[f], a[f]
                    none = pa.nulls(len(f), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(ids[r]), pa.array(keys[r]), none, pa.array(a - base[r]), pa.array(e - base[r]), none], ["h", "c", "doc_id", "k", "pos", "lo", "hi", "n"])

    return run


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    hi = min(len(a), len(b))
    if a[known:hi] == b[known:hi]:
        return hi
    lo = known
    while hi - lo > 1:  # a[:lo] is common, a[:hi] isn't
        mid = (lo + hi) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Strings in sorted order by one full comparison each: inner nodes keep only a depth and the branching bytes."""

    def __init__(self, strings: list[bytes], first: int, known: int):
        self.strings, self.known = strings, known
        self.root: list | int = first
        self.same: dict[int, list[int]] = {first: [first]}

    @staticmethod
    def symbol(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    def insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, list):
            kids = node[1]
            nxt = kids.get(self.symbol(s, node[0]))
            node = nxt if nxt is not None else next(iter(kids.values()))
        t = self.strings[node]
        d = common(s, t, self.known)
        if d == len(s) == len(t):
            self.same[node].append(i)
            return
        self.same[i] = [i]
        above, here = None, self.root
        while isinstance(here, list) and here[0] < d:
            above, here = here, here[1][self.symbol(s, here[0])]
        if isinstance(here, list) and here[0] == d:
            here[1][self.symbol(s, d)] = i
            return
        split = [d, {self.symbol(t, d): here, self.symbol(s, d): i}]
        if above is None:
            self.root = split
        else:
            above[1][self.symbol(s, above[0])] = split

    def walk(self, depth: int, order: list[int], lcp: list[int]) -> None:
        """Append the strings in order, with the common length of each and the one before (depth for the first)."""
        stack = [(self.root, depth)]
        while stack:
            node, d = stack.pop()
            if isinstance(node, list):
                kids = sorted(node[1].items())
                stack.extend((kid, node[0]) for _, kid in kids[:0:-1])
                stack.append((kids[0][1], d))
            else:
                for k, i in enumerate(self.same[node]):
                    order.append(i)
                    lcp.append(d if not k else len(self.strings[i]))


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings, and for each place the common length with the string before it (0 for the first).

    All strings share `known` bytes. Multikey quicksort splits them by a byte at a time down
    to a shallow depth; groups that are equal that far go to a blind trie.
    """
    order: list[int] = []
    lcp: list[int] = []
    stop = known + shallow
    stack = [(list(range(len(strings))), known, known)]
    while stack:
        group, d, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            lcp.append(before)
            continue
        if d >= stop:
            trie = BlindTrie(strings, group[0], d if all(len(strings[i]) >= d for i in group) else 0)
            for i in group[1:]:
                trie.insert(i)
            trie.walk(before, order, lcp)
            continue
        symbols = [BlindTrie.symbol(strings[i], d) for i in group]
        pivot = sorted((symbols[0], symbols[len(symbols) // 2], symbols[-1]))[1]
        less = [i for i, x in zip(group, symbols) if x < pivot]
        same = [i for i, x in zip(group, symbols) if x == pivot]
        more = [i for i, x in zip(group, symbols) if x > pivot]
        if pivot == -1 and same:  # ended strings are equal
            parts = [("ended", same)]
        else:
            parts = [("deeper", same)]
        if less:
            parts.insert(0, ("again", less))
        if more:
            parts.append(("again", more))
        out = []
        for k, (what, g) in enumerate(parts):
            out.append((what, g, before if k == 0 else d))
        if [w for w, _, _ in out] == ["ended"]:
            for k, i in enumerate(same):
                order.append(i)
                lcp.append(before if not k else len(strings[i]))
            continue
        for what, g, b in reversed(out):
            if what == "deeper":
                stack.append((g, d + 1, b))
            elif what == "again":
                stack.append((g, d, b))
            else:
                stack.append((g, stop, b))
    lcp_ = np.array(lcp, np.int64)
    if len(lcp_):
        lcp_[0] = 0
    return np.array(order, np.int64), lcp_


def recurring(ctx: list[bytes], off: np.ndarray, la: np.ndarray, lb: np.ndarray, times: np.ndarray, length: int, known: int) -> list[list[tuple[int, int]]]:
    """For each class of a group: the stretches [a, b] of places of the anchor in windows that recur.

    ctx holds the surroundings, off the anchor in them; windows with the anchor at la..lb are owned.
    """
    g = len(ctx)
    whole = [[(int(a), int(b))] if t > 1 else [] for a, b, t in zip(la, lb, times)]
    if g < 2:
        return whole
    right = [c[o:] for c, o in zip(ctx, off.tolist())]
    left = [c[:o][::-1] for c, o in zip(ctx, off.tolist())]
    ro, rl = deep_shallow(right, known)
    lo, ll = deep_shallow(left, 0)
    places = np.arange(int(la.min()), int(lb.max()) + 1)
    by_right = np.cumsum(rl[None, :] < (length - places)[:, None], axis=1)
    by_left = np.cumsum(ll[None, :] < places[:, None], axis=1)
    key = np.empty((len(places), g), np.int64)
    key[:, ro] = by_right * (g + 1)
    add = np.empty_like(key)
    add[:, lo] = by_left
    key += add
    owned = (places[:, None] >= la[None, :]) & (places[:, None] <= lb[None, :])
    key = np.where(owned, key, -1 - np.arange(g)[None, :])
    order = np.argsort(key, axis=1, kind="stable")
    sorted_ = np.take_along_axis(key, order, axis=1)
    same = sorted_[:, 1:] == sorted_[:, :-1]
    twice = np.zeros_like(owned)
    twice[:, 1:] |= same
    twice[:, :-1] |= same
    found = np.zeros_like(owned)
    np.put_along_axis(found, order, twice, axis=1)
    out = []
    for i in range(g):
        if times[i] > 1:
            out.append(whole[i])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], found[:, i].astype(np.int8), [0]])))
        out.append([(int(places[a]), int(places[b - 1])) for a, b in zip(edge[::2], edge[1::2])])
    return out


def _settle(length, gram):
    """mapInArrow function over classes sorted by key: key, cls, n, ctx, off, la, lb -> key, cls, spans."""

    def run(batches):
        held: list[tuple] = []

        def close():
            if not held:
                return None
            key = held[0][0]
            cls = [r[1] for r in held]
            off, la, lb, n = (np.array([r[i] for r in held], np.int64) for i in (4, 5, 6, 2))
            known = min(gram, min(len(r[3]) - r[4] for r in held))
            spans = recurring([r[3] for r in held], off, la, lb, n, length, known)
            return [(key, c, [{"a": a, "b": b} for a, b in s]) for c, s in zip(cls, spans) if s]

        for batch in batches:
            out = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and held[0][0] != r[0]:
                    out += close() or []
                    held = []
                held.append(r)
            if out:
                yield _verdicts(out)
        if last := close():
            yield _verdicts(last)

    return run


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _verdicts(rows):
    key, cls, spans = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(cls, pa.int64()), pa.array(spans, _SPANS)], ["key", "cls", "spans"])


def _contexts(length):
    """doc_id, text, wanted(h, c, n, pos, lo, hi) -> CONTEXTS of one occurrence of each class."""

    def run(batches):
        names = ["h0", "c0", "key", "cls", "n", "ctx", "off", "la", "lb"]
        for batch in batches:
            for part, buf, offs in tx.slices(batch):
                raw, out = buf.tobytes(), []
                for i, wanted in enumerate(part.column(part.schema.get_field_index("wanted")).to_pylist()):
                    for w in wanted:
                        a, b = w["lo"], w["hi"] + length
                        out.append((w["h"], w["c"], w["h"], w["c"], w["n"], raw[offs[i] + a : offs[i] + b], w["pos"] - a, w["pos"] - w["hi"], w["pos"] - a))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 5 + (pa.binary(),) + (pa.int32(),) * 3)], names)

    return run


def _split(length, parts):
    """CONTEXTS -> CONTEXTS by blocks of the anchor's place, each keyed by the string that all windows of the block share."""

    def run(batches):
        names = ["h0", "c0", "key", "cls", "n", "ctx", "off", "la", "lb"]
        for batch in batches:
            out = []
            for h0, c0, key, cls, n, ctx, off, la, lb, first, step in zip(*(c.to_pylist() for c in batch.columns)):
                for x in range(first, first + parts * step, step):
                    y = x + step - 1
                    a, b = max(la, x), min(lb, y)
                    if a > b:
                        continue
                    inner = ctx[max(off - x, 0) : off + length - y]
                    outer = ctx[off - b : off + length - a]
                    digest = lambda *v: int.from_bytes(hashlib.blake2b(b"|".join(v), digest_size=8).digest(), "little", signed=True)
                    out.append((h0, c0, digest(inner, b"%d %d %d" % (key, x, y)), digest(outer, b"%d %d" % (a, b)), n, outer, b, a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(),) * 5 + (pa.binary(),) + (pa.int32(),) * 3)], names)

    return run


def _finish(batches):
    for batch in batches:
        for part, buf, offs in tx.slices(batch):
            raw = buf.tobytes()
            n, removed, runs, digest = [], [], [], []
            for i, spans in enumerate(part.column(part.schema.get_field_index("spans")).to_pylist()):
                text = raw[offs[i] : offs[i + 1]]
                at, gone, count, kept = 0, 0, 0, hashlib.sha256()
                for s in spans or ():
                    a, b = s["a"], s["b"]
                    if a > at or (a == at == 0 and not count):
                        kept.update(text[at:a])
                        count += 1
                        gone += b - a
                        at = b
                    elif b > at:
                        gone += b - at
                        at = b
                kept.update(text[at:])
                n.append(len(text))
                removed.append(gone)
                runs.append(count)
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(batches):
    for batch in batches:
        for part, buf, offs in tx.slices(batch):
            raw, out = buf.tobytes(), []
            for i, spans in enumerate(part.column(part.schema.get_field_index("spans")).to_pylist()):
                text, at, kept = raw[offs[i] : offs[i + 1]], 0, []
                for s in spans or ():
                    kept.append(text[at : max(at, s["a"])])
                    at = max(at, s["b"])
                out.append(b"".join([*kept, text[at:]]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "kept"])


def repeated_spans(spark: SparkSession, docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, text, spans for every row of docs(doc_id, text): the stretches [a, b) of bytes to remove, in order; they may touch or overlap.

    Null counts as empty text; texts shorter than `length` bytes have no spans. Rows that
    repeat an id are texts of their own, equal texts of one id included.
    """
    scratch = Scratch(spark)
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    found = scratch.keep("anchors", slim.mapInArrow(_anchors(length, gram), ANCHORS))
    seen = found.where("h IS NOT NULL")
    classes = scratch.keep("classes", seen.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("doc_id").alias("rep")))
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("h")
    open_ = scratch.keep("open", classes.join(several, "h", "left_semi"))
    one = seen.drop("n").join(open_.select("h", "c", "n", F.col("rep").alias("doc_id")), ["h", "c", "doc_id"]).dropDuplicates(["h", "c"])
    wanted = one.groupBy("doc_id", "k").agg(F.collect_list(F.struct("h", "c", "n", "pos", "lo", "hi")).alias("wanted"))
    source = slim.join(wanted, ["doc_id", "k"])
    work = scratch.keep("contexts", source.select("doc_id", "text", "wanted").mapInArrow(_contexts(length), CONTEXTS).dropDuplicates(["h0", "c0"]))
    done = [classes.where("n > 1").select("h", "c", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))]
    span = length - gram + 1
    # blocks of places: all of them, then an eighth of that, and so on to single places
    level, parent, step = 0, SPLIT * -(-span // SPLIT), -(-span // SPLIT)
    while True:
        merged = work if level == 0 else scratch.keep(f"merged{level}", work.groupBy("key", "cls").agg(F.sum("n").alias("n"), F.first("ctx").alias("ctx"), F.first("off").alias("off"), F.first("la").alias("la"), F.first("lb").alias("lb")))
        sizes = scratch.keep(f"sizes{level}", merged.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.max("n").alias("m")).where("g > 1 OR m > 1"))
        fit = merged.join(sizes.where(f"g <= {group}").select("key"), "key", "left_semi").select("key", "cls", "n", "ctx", "off", "la", "lb")
        settled = scratch.keep(f"settled{level}", fit.repartition("key").sortWithinPartitions("key").mapInArrow(_settle(length, gram), "key long, cls long, spans array<struct<a:int,b:int>>"))
        verdict = settled.select(F.col("key").alias("h"), F.col("cls").alias("c"), "spans") if level == 0 else work.select("h0", "c0", "key", "cls").join(settled, ["key", "cls"]).select(F.col("h0").alias("h"), F.col("c0").alias("c"), "spans")
        done.append(verdict)
        hot = sizes.where(f"g > {group}").select("key")
        if hot.isEmpty():
            break
        if level:
            whole = merged.where("n > 1").join(hot, "key", "left_semi").select("key", "cls", F.array(F.struct(F.col("la").alias("a"), F.col("lb").alias("b"))).alias("spans"))
            done.append(work.select("h0", "c0", "key", "cls").join(whole, ["key", "cls"]).select(F.col("h0").alias("h"), F.col("c0").alias("c"), "spans"))
        wide = work.join(hot, "key", "left_semi").select("h0", "c0", "key", "cls", "n", "ctx", "off", "la", "lb", F.expr(f"cast(la div {parent} as int) * {parent}").alias("first"), F.lit(step).alias("step"))
        work = scratch.keep(f"work{level + 1}", wide.mapInArrow(_split(length, -(-parent // step)), CONTEXTS))
        level, parent, step = level + 1, step, -(-step // SPLIT)
    verdicts = done[0]
    for d in done[1:]:
        verdicts = verdicts.unionByName(d)
    verdicts = scratch.keep("verdicts", verdicts)
    places = seen.join(verdicts, ["h", "c"])
    windows = places.where("spans IS NOT NULL").select("doc_id", "k", "pos", F.explode("spans").alias("s")).selectExpr("doc_id", "k", "pos - s.b AS a", f"pos - s.a + {length} AS b")
    whole = places.where("spans IS NULL").selectExpr("doc_id", "k", "lo AS a", f"hi + {length} AS b")
    local = found.where("h IS NULL").selectExpr("doc_id", "k", "lo AS a", "hi AS b")
    spans = windows.unionByName(whole).unionByName(local).groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return slim.join(spans, ["doc_id", "k"], "left").select(F.when(F.col("doc_id") != F.lit(-(1 << 62)), F.col("doc_id")).alias("doc_id"), "text", "spans")


def reported(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text)."""
    return repeated_spans(spark, docs, **options).mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id and the kept bytes of every row; bytes, as a cut may fall within a character."""
    return repeated_spans(spark, docs, **options).mapInArrow(_cut, "doc_id long, kept binary")
