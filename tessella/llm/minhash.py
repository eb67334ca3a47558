"""Near-duplicate documents: SuperMinHash signatures, banding, exact confirmation, components.

Each distinct shingle of a document draws a random permutation of the signature's places,
lazily, one place a level; at level j it offers the value j + r there. A place keeps the
smallest offer. As a value of level j is below every value of level j + 1, all shingles of
a document go through the levels together and stop once each place is filled, which is
after one level for long documents. The values of a signature are correlated so that the
estimate of the similarity has less variance than independent minima give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .storage import Scratch, fresh

U = np.uint64
WORDS, BANDS, ROWS = 5, 50, 5
SIGS = "doc_id long, th long, n_shingles long, fp1 long, fp2 long, bands array<long>, bits array<long>"
#: Bits of the maps of sets that candidates are held against before their texts are.
MAP = 1024
#: Places of lazily drawn permutations held at a time.
STEP_MEMORY = 24_000_000


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles by row, and the n+1 offsets of the rows.

    ASCII letters count in lower case. A row of 1 to k-1 words has its whole sequence as
    the one shingle, a row without words none.
    """
    n = len(offs) - 1
    low = tx.LOWER[buf]
    starts, ends, row = tx.words(low, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = tx.spans(tx.prefix(low), starts, ends)
    at = tx.bounds(row, n)
    count = np.diff(at)
    mult = tx.mix(np.arange(1, k + 1, dtype=np.uint64) * tx.GOLD) | U(1)
    full = np.maximum(count - k + 1, 0)
    sizes = np.where(count == 0, 0, np.maximum(full, 1))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    total = int(out_at[-1])
    first = np.arange(total) - np.repeat(out_at[:-1] - at[:-1], sizes)
    sums = np.zeros(total, np.uint64)
    limit = np.repeat(at[1:], sizes)
    for i in range(k):
        pos = first + i
        ok = pos < limit
        sums += np.where(ok, word[np.minimum(pos, len(word) - 1)] * mult[i], U(0))
    hashes = tx.mix(sums + np.repeat(np.minimum(count, k).astype(np.uint64), sizes))
    for a, b in zip(out_at[:-1], out_at[1:]):
        hashes[a:b].sort()
    new = np.ones(total, bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[out_at[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], kept[out_at]


def superminhash(elems: np.ndarray, at: np.ndarray, m: int, seed: int = 0) -> np.ndarray:
    """Signatures (rows x m, uint64: level in the high half, draw in the low half) of sets given as in shingles().

    A row without elements keeps the largest value in every place.
    """
    n = len(at) - 1
    top = np.iinfo(np.uint64).max
    sig = np.full(n * m, top, np.uint64)
    row = np.repeat(np.arange(n), np.diff(at))
    salt = tx.mix(np.array([seed + 1], np.uint64))

    def offer(rows, place, draw, level):
        np.minimum.at(sig, rows * m + place, (draw >> U(32)) | (U(level) << U(32)))

    draw = tx.mix(elems ^ salt)
    place = ((draw & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
    offer(row, place, draw, 0)
    open_ = (sig.reshape(n, m).max(axis=1) == top) & (np.diff(at) > 0)
    todo = np.flatnonzero(open_)
    size = np.diff(at)
    while len(todo):
        take = max(1, int(np.searchsorted(np.cumsum(size[todo]) * m, STEP_MEMORY)))
        part, todo = todo[:take], todo[take:]
        idx = np.flatnonzero(np.isin(row, part)) if len(part) < n else np.arange(len(row))
        e, r = elems[idx], row[idx]
        perm = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
        lanes = np.arange(len(e))
        p0 = place[idx]
        perm[lanes, p0] = 0
        for level in range(1, m):
            draw = tx.mix(e ^ (salt + tx.STEPS[level]))
            k = level + ((draw & U(0xFFFFFFFF)) * U(m - level) >> U(32)).astype(np.int64)
            at_k = perm[lanes, k].astype(np.int64)
            perm[lanes, k] = perm[lanes, level]
            offer(r, at_k, draw, level)
            left = sig.reshape(n, m)[part].max(axis=1) == top
            if not left.any():
                break
            if left.sum() * 2 < len(left):
                part = part[left]
                stay = np.isin(r, part)
                e, r, perm = e[stay], r[stay], perm[stay]
                lanes = np.arange(len(e))
    return sig.reshape(n, m)


def sketches(bands: int = BANDS, rows: int = ROWS, words: int = WORDS, seed: int = 0):
    """mapInArrow function: doc_id, th, text -> SIGS."""
    m = bands * rows

    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.slices(batch):
                h, at = shingles(buf, offs, words)
                sig = superminhash(h, at, m, seed)
                n = len(at) - 1
                size = np.diff(at)
                some = size > 0
                fp = np.zeros((2, n), np.uint64)
                if len(h):
                    where = at[:-1][some]
                    fp[0, some] = np.add.reduceat(tx.mix(h + U(1)), where)
                    fp[1, some] = np.add.reduceat(tx.mix(h ^ tx.GOLD), where)
                mixed = tx.mix(sig)
                band = np.zeros((n, bands), np.uint64)
                for i in range(rows):
                    band += mixed[:, i::rows] * tx.mix(np.array([i + 77], np.uint64))[0]
                band = tx.mix(band + np.arange(bands, dtype=np.uint64) * tx.GOLD)
                low = np.zeros((n, 2, (m + 63) // 64 * 64), np.uint8)
                low[:, 0, :m] = mixed & U(1)
                low[:, 1, :m] = (mixed >> U(1)) & U(1)
                bits = np.packbits(low, axis=2).view(np.int64).reshape(n, -1)
                lists = lambda x, w: pa.ListArray.from_arrays(pa.array(np.append(0, np.where(some, w, 0).cumsum()), pa.int32()), pa.array(x[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), lists(band, bands), lists(bits, bits.shape[1])], ["doc_id", "th", "n_shingles", "fp1", "fp2", "bands", "bits"])

    return run


def confirm(percent: int, words: int):
    """mapInArrow function: u, v, tu, tv -> u, v of the pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.slices(batch, "tu"):
                a, a_at = shingles(buf, offs, words)
                b, b_at = shingles(*tx.utf8(part.column(3)), words)
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
                    if len(x) > len(y):
                        x, y = y, x
                    if not len(x) or 100 * len(x) < percent * len(y):
                        continue
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
                if keep.any():
                    yield part.select(["u", "v"]).filter(pa.array(keep))

    return run


def occurrences(words: int):
    """mapInArrow function: id, text -> h, id: a row for each shingle of the set."""

    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.slices(batch):
                h, at = shingles(buf, offs, words)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(at))))], ["h", "id"])

    return run


def parities(words: int):
    """mapInArrow function: id, text -> id, map: for each of MAP places whether the set has an odd number of shingles there.

    Two sets differ in at least as many shingles as their maps have unlike places.
    """

    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.slices(batch):
                h, at = shingles(buf, offs, words)
                n = part.num_rows
                odd = np.bincount(np.repeat(np.arange(n), np.diff(at)) * MAP + (tx.mix(h) % U(MAP)).astype(np.int64), minlength=n * MAP) & 1
                bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (MAP // 64), pa.int32()), pa.array(bits))], ["id", "map"])

    return run


def grouped(spark: SparkSession, docs: DataFrame, *, percent: int = 75, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, seed: int = 0) -> DataFrame:
    """doc_id, th, n_shingles, comp and component_id for every row of docs(doc_id, text).

    th is xxhash64 of the text, comp a number of the component (null without shingles),
    component_id the smallest doc_id in it (null where all are).

    Documents with 100 * intersection >= percent * union of their shingle sets are linked.
    Rows of equal sets are one class from the start, so groups of copies of any size cost
    one aggregation. With 50 bands of 5 places a pair at similarity 0.75 meets in no band
    with probability 1.3e-6, one at 0.8 with 2.4e-9.

    Classes that meet in a band are confirmed on their full sets in three rounds, each over
    what the rounds before left apart: every class with the partner it meets most often (each
    bucket is led by the class that meets the most others, the original of a group of copies);
    the best pair between two components; then every pair that still lies across components
    and can be similar enough at all. The last needs no pairs to be found out for most
    classes: shingles that no other open class has can't be in an intersection, which bounds
    the similarity of a class with any other of a given size, so that it leaves the buckets
    where all are too large for it. Pairs that remain are bounded likewise, and passed by
    where the 2-bit places of their signatures agree too seldom (six standard deviations).
    """
    scratch = Scratch(spark)
    m = bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    sig = scratch.keep("sig", docs.mapInArrow(sketches(bands, rows, words, seed), SIGS).withColumn("uid", F.monotonically_increasing_id()))
    some = sig.where("n_shingles > 0")
    classes = scratch.keep("classes", some.groupBy("fp1", "fp2").agg(F.min("uid").alias("id"), F.min("doc_id").alias("rep")))
    reps = some.join(classes.select(F.col("id").alias("uid")), "uid", "left_semi")
    spread = reps.select(F.col("uid").alias("id"), F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    met = scratch.keep("met", spread.join(full, "bucket"))
    weight = met.groupBy("id").agg(F.sum("k").alias("w"))
    ranked = met.join(weight, "id").select("bucket", "id", "w")
    lead = ranked.groupBy("bucket").agg(F.max(F.struct("w", "id")).alias("b")).select("bucket", F.col("b.id").alias("leader"))
    hits = scratch.keep("hits", met.select("bucket", "id").join(lead, "bucket"))
    scratch.drop("met")
    open_rows = reps.select("uid", "doc_id", "th").join(hits.select(F.col("id").alias("uid")).distinct(), "uid", "left_semi")
    same = [docs["doc_id"].eqNullSafe(open_rows["doc_id"]), docs["th"] == open_rows["th"]]
    texts = scratch.keep("texts", docs.join(open_rows, same).select(open_rows["uid"], docs["text"]).dropDuplicates(["uid"]))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        with_u = pairs.select("u", "v").join(texts.select(F.col("uid").alias("u"), F.col("text").alias("tu")), "u")
        with_v = with_u.join(texts.select(F.col("uid").alias("v"), F.col("text").alias("tv")), "v")
        return scratch.keep(name, with_v.select("u", "v", "tu", "tv").mapInArrow(confirm(percent, words), "u long, v long"))

    star = hits.where("id <> leader").groupBy("id", "leader").agg(F.count(F.lit(1)).alias("shared"))
    best = star.groupBy("id").agg(F.max(F.struct("shared", "leader")).alias("b")).select(F.col("id").alias("u"), F.col("b.leader").alias("v"))
    edges = confirmed(best, "edges1")
    comp = components(edges, scratch, "comp1")

    def label(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.join(comp.select(F.col("id").alias(key), F.col("comp").alias(out)), key, "left").withColumn(out, F.coalesce(out, key))

    across = label(label(star, "id", "cu"), "leader", "cv").where("cu <> cv")
    pairs = scratch.keep("pairs2", across.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.max(F.struct("shared", "id", "leader")).alias("p")).select(F.col("p.id").alias("u"), F.col("p.leader").alias("v")))
    if not pairs.isEmpty():
        edges = edges.union(confirmed(pairs, "edges2"))
        comp = components(edges, scratch, "comp2")

    ids = scratch.keep("labelled", label(hits.select("bucket", "id"), "id", "c"))

    def apart(df: DataFrame) -> DataFrame:
        mixed = df.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n_shingles").alias("least")).where("lo <> hi").select("bucket", "least")
        return df.join(mixed, "bucket")

    mixed = ids.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    live = scratch.keep("live", ids.join(mixed, "bucket", "left_semi"))
    if not live.isEmpty():
        held = texts.join(live.select(F.col("id").alias("uid")).distinct(), "uid", "left_semi")
        alone = held.select("uid", "text").mapInArrow(occurrences(words), "h long, id long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
        info = some.select(F.col("uid").alias("id"), "n_shingles", "bits").join(alone, "id", "left").withColumn("common", F.expr("n_shingles - coalesce(alone, 0)")).drop("alone")
        # i common shingles of sets of x and y give i / (x + y - i), so (100 + percent) * i >= percent * (x + y) has to hold
        fits = f"{100 + percent} * common >= {percent} * (n_shingles + least)"
        info = info.join(held.select("uid", "text").mapInArrow(parities(words), "id long, map array<long>"), "id")
        first = apart(live.join(info, "id")).where(fits).drop("least")
        open_ = scratch.keep("open", apart(first).where(fits).drop("least"))
        similar = percent / 100
        p = (1 + 3 * similar) / 4
        least = int(m * p - 6 * (m * p * (1 - p)) ** 0.5)
        half = (m + 63) // 64
        differ = " + ".join(f"bit_count((a.bits[{i}] ^ b.bits[{i}]) | (a.bits[{i + half}] ^ b.bits[{i + half}]))" for i in range(half))
        unlike = " + ".join(f"bit_count(a.map[{i}] ^ b.map[{i}])" for i in range(MAP // 64))
        a, b = open_.alias("a"), open_.alias("b")
        left = a.join(b, F.expr(f"a.bucket = b.bucket AND a.id < b.id AND a.c <> b.c AND 100 * least(a.n_shingles, b.n_shingles) >= {percent} * greatest(a.n_shingles, b.n_shingles) AND {100 + percent} * least(a.common, b.common) >= {percent} * (a.n_shingles + b.n_shingles) AND {100 - percent} * (a.n_shingles + b.n_shingles) >= {100 + percent} * ({unlike}) AND {m} - ({differ}) >= {least}"))
        pairs = scratch.keep("pairs3", left.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct())
        if not pairs.isEmpty():
            edges = edges.union(confirmed(pairs, "edges3"))
            comp = components(edges, scratch, "comp3")

    named = label(classes, "id", "comp")
    ends = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = scratch.keep("found", named.join(ends, "comp").select("fp1", "fp2", "comp", "component_id"))
    scratch.drop("hits", "texts", "labelled", "live", "open")
    return sig.select("doc_id", "th", "n_shingles", F.expr("if(n_shingles > 0, fp1, null)").alias("fp1"), "fp2").join(found, ["fp1", "fp2"], "left").select("doc_id", "th", "n_shingles", "comp", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text); see grouped().

    component_id is the smallest doc_id that links reach. Null and empty texts have no shingle
    and are linked with nothing. Rows that repeat an id are documents of their own with that
    id: each is linked by its own text. Rows without id are linked as well; they take the
    smallest id of their component and are kept only where it has none.
    """
    return grouped(spark, docs, **options).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near_duplicates(), all columns as they were: that of the smallest doc_id, there of the smallest hash of the text; rows without id come last.

    Rows without shingles (null and empty texts) are groups of their own and stay, but rows of one id and one text are one.
    """
    scratch = Scratch(spark)
    found = scratch.keep("grouped", grouped(spark, docs, **options))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    keep = found.where("comp IS NOT NULL").groupBy("comp").agg(first.alias("f")).select("f.doc_id", "f.th").union(found.where("comp IS NULL").select("doc_id", "th").distinct())
    d, t, n = fresh(docs.columns, "_id", "_text", "_row")
    wide = docs.withColumn(d, F.col("doc_id").cast("long")).withColumn(t, F.xxhash64("text"))
    keep = keep.select(F.col("doc_id").alias(f"{d}k"), F.col("th").alias(f"{t}k"))
    kept = wide.join(keep, F.col(d).eqNullSafe(F.col(f"{d}k")) & (F.col(t) == F.col(f"{t}k")), "left_semi")
    repeats = found.where("doc_id IS NOT NULL").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1)
    nameless = found.where("doc_id IS NULL").limit(1)
    if not (repeats.isEmpty() and nameless.isEmpty()):
        kept = kept.dropDuplicates([d, t])
    return kept.select(*docs.columns)
