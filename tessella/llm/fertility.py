"""Quality rules from tokenisers: characters per token, byte-fallback share and token entropy under public vocabularies.

A vocabulary made for natural text splits junk into more tokens, falls back to bytes more
often or repeats few tokens. Each language of a script gets its own bands: quartiles of the
measures over its documents that pass the base rules, widened by a multiple of their
distance; a document outside a band is rejected. Rare languages take the bands of their
script, rare scripts those of all rare scripts together.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scripts
from . import text as tx
from .storage import Scratch

U = np.uint64
VOCABULARIES = "/opt/tokenizers"
PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Bands reach this many interquartile distances (of at least LEAST) beyond the quartiles; languages and scripts with fewer documents are pooled.
WIDTH, LEAST, MIN_DOCS = 3.0, 0.02, 100
MEASURES = ("piece_chars", "byte_chars", "fallback", "entropy")
SLICE = 4 << 20
SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, " + ", ".join(f"{m} double" for m in MEASURES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_loaded: dict[str, tuple] = {}


def vocabularies(folder: str) -> tuple:
    """The two tokenisers, read once a process: (SentencePiece, first and last id of its byte pieces, byte-level encoding)."""
    if folder not in _loaded:
        import sentencepiece
        import tiktoken

        pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        with open(os.path.join(folder, RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        _loaded[folder] = pieces, is_byte, tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder]


def repeats(word: np.ndarray, row: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Words a row that lie in windows of so many words found twice or more in it."""
    m = len(word) - window + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(window):
        h += word[i : i + m] * (tx.mix(tx.STEPS[i + 1 : i + 2]) | U(1))
    at = np.flatnonzero(row[:m] == row[window - 1 :])
    h, r = tx.mix(h[at]), row[at]
    order = np.lexsort((h, r))
    h, r, at = h[order], r[order], at[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return np.bincount(row[np.cumsum(edge)[:-1] > 0], minlength=n)


def duplicate_lines(buf: np.ndarray, offs: np.ndarray, pre: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines a row that hold a word and equal an earlier line of the row."""
    n = len(offs) - 1
    begin = np.concatenate([offs[:-1], np.flatnonzero(buf == 10) + 1])
    begin.sort()
    row = np.searchsorted(offs[1:], begin, "right")
    ok = row < n
    begin, row = begin[ok], row[ok]
    begin, first = np.unique(begin, return_index=True)
    row = row[first]
    end = np.minimum(np.concatenate([begin[1:], [len(buf)]]), offs[1:][row])
    cut = end - ((end > begin) & (buf[np.maximum(end - 1, 0)] == 10))
    has = np.searchsorted(starts, cut) > np.searchsorted(starts, begin)
    begin, cut, row = begin[has], cut[has], row[has]
    h = tx.spans(pre, begin, cut)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=n)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for y in lists for x in y), np.int64, int(size.sum())), size


def measure(buf: np.ndarray, offs: np.ndarray, folder: str) -> dict[str, np.ndarray]:
    """Base counts and tokeniser measures of each row. Tokenisers see each distinct word of the slice once, behind a space."""
    n = len(offs) - 1
    starts, ends, row = tx.words(buf, offs)
    pre = tx.prefix(buf)
    word = tx.spans(pre, starts, ends)
    letters = ((buf & 0xC0) != 0x80) & ~tx.SPACES[buf]
    ones = np.concatenate([[0], np.cumsum(letters)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    n_words, chars = np.bincount(row, minlength=n), ones[offs[1:]] - ones[offs[:-1]]
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]], "n_dup_lines": duplicate_lines(buf, offs, pre, starts), "n_repeat_words": repeats(word, row, n)}
    by_script = scripts.of_spans(buf, offs[:-1], n, np.arange(n)) if n else np.zeros((0, len(scripts.NAMES)))
    out["script"] = np.where(by_script.sum(axis=1) > 0, np.array(scripts.NAMES, object)[by_script.argmax(axis=1)], "none")
    pieces, is_byte, ranks = vocabularies(folder)
    _, first, inv = np.unique(word, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    ids, size = _flat(pieces.encode(texts, num_threads=1) if texts else [])
    coarse = np.fromiter((len(ranks.encode_ordinary(" " + t)) for t in texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(size)])
    fall = np.concatenate([[0], np.cumsum(is_byte[ids])])
    fall = fall[at[1:]] - fall[at[:-1]]
    tokens, fallen, ranked = (np.bincount(row, x[inv], n) for x in (size, fall, coarse))
    entropy = np.full(n, np.nan)
    doc = tx.bounds(row, n)
    v = len(is_byte)
    for i in range(0, n, 32):
        j = min(n, i + 32)
        w = inv[doc[i] : doc[j]]
        k = size[w]
        where = np.arange(int(k.sum())) + np.repeat(at[w] - (np.cumsum(k) - k), k)
        count = np.bincount(np.repeat(row[doc[i] : doc[j]] - i, k) * v + ids[where], minlength=(j - i) * v)
        some = np.flatnonzero(count)
        c = count[some].astype(float)
        t = tokens[i:j]
        with np.errstate(invalid="ignore", divide="ignore"):
            entropy[i:j] = (np.log2(t) - np.bincount(some // v, c * np.log2(c), j - i) / t) / np.log2(t)
    with np.errstate(invalid="ignore", divide="ignore"):
        out |= {"piece_chars": chars / tokens, "byte_chars": chars / ranked, "fallback": fallen / tokens, "entropy": entropy}
    return out


def _measured(folder: str):
    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.slices(batch, limit=SLICE):
                m = measure(buf, offs, folder)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(m[k], from_pandas=True) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *MEASURES))], ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *MEASURES])

    return run


def binned(measured: DataFrame) -> DataFrame:
    """(script, lang, measure, v, n): counts of the values, rounded to thousandths, of the documents that pass the base rules."""
    stacked = measured.where("NOT base_failed").selectExpr("script", "lang", f"stack({len(MEASURES)}, " + ", ".join(f"'{m}', {m}" for m in MEASURES) + ") AS (measure, value)").where("value IS NOT NULL")
    return stacked.groupBy("script", "lang", "measure", F.round("value", 3).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def bands(bins: DataFrame, keys: list[str], *, width: float = WIDTH, least: float = LEAST, min_docs: int = MIN_DOCS) -> DataFrame:
    """(keys, measure, low, high) of each group of bins(keys, measure, v, n) with so many documents."""
    at = [*keys, "measure"]
    counts = bins.groupBy(*at, "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*at)
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    q = upto.groupBy(*at).agg(F.max("all").alias("docs"), *(F.min(F.when(F.col("upto") >= F.col("all") * x, F.col("v"))).alias(name) for name, x in (("q1", 0.25), ("q3", 0.75))))
    reach = width * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
    return q.where(F.col("docs") >= min_docs).select(*at, (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def limited(measured: DataFrame, bins: DataFrame, width: float) -> DataFrame:
    """measured with the columns <measure>_low and <measure>_high: the bands of the language, else those of the script, else those of all scripts without."""
    by_script = bands(bins, ["script"], width=width)
    rare = bins.join(F.broadcast(by_script.select("script", "measure")), ["script", "measure"], "left_anti")
    levels = [(["script", "lang"], bands(bins, ["script", "lang"], width=width)), (["script"], by_script), ([], bands(rare, [], width=width, min_docs=1))]
    sides = [(m, side) for m in MEASURES for side in ("low", "high")]
    for i, (keys, level) in enumerate(levels):
        wide = level.groupBy(*keys).agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}_{i}") for m, side in sides))
        measured = measured.join(F.broadcast(wide), keys, "left") if keys else measured.crossJoin(F.broadcast(wide))
    return measured.withColumns({f"{m}_{side}": F.coalesce(*(f"{m}_{side}_{i}" for i in range(len(levels)))) for m, side in sides})


def ruled(spark: SparkSession, docs: DataFrame, *, folder: str = VOCABULARIES, width: float = WIDTH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script, the measures and `outside` for every row of docs(doc_id, text[, lang]).

    kept: not base_failed and within all bands of its script and lang (null or no column: one
    language more); a measure that is undefined rejects nothing. Null counts as empty text: no words, base_failed.
    """
    scratch = Scratch(spark)
    failed = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(_measured(folder), SCHEMA).withColumn("base_failed", F.expr(failed))
    measured = scratch.keep("measured", rows)
    joined = limited(measured, scratch.keep("bins", binned(measured)), width)
    outside = F.array_compact(F.array(*(F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in MEASURES)))
    return joined.withColumn("outside", outside).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *MEASURES, "outside")
