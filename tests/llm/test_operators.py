"""The operators against brute force on small documents, and rows that are odd in every way."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessella.llm import decontaminate, fertility, language, lm, minhash, mixing, quality, sentences, shards, suffixes, tables
from tessella.llm import text as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the of ing er an re th on at en ed is it or es ti".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        k = min(n - len(out), rng.randint(4, 12))
        s = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."] if k > 1 else [s[0] + "."]
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(25)]
    passage = prose(rng, 90)
    docs = list(base)
    for i in range(8):
        w = base[i].split()
        for _ in range(i):
            w[rng.randrange(len(w))] = "changed" + str(rng.random())[2:6]
        docs.append(" ".join(w))
    docs += [base[0], base[0], base[1].upper(), passage, prose(rng, 30) + " " + passage + "\n" + prose(rng, 30), None, "", " \n\t ", "one", "Two words", "a b c d", "xy " * 300, "ünïcode ☃ 漢字 " * 60, "!!! ??? ...", "\n".join(["same line here"] * 12)]
    rows = [(i, t, ["en", "de"][i % 2] if i % 7 else None, f"s{i % 3}" if i % 5 else None, len(t or "") if i % 4 else None) for i, t in enumerate(docs)]
    rows.append(rows[4])  # a repeated row
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    return out


def test_words_and_hashes():
    texts = ["a b", None, "", " c\x0bd\xa0e ", "f"]
    buf, offs = tx.utf8(pa.array(texts))
    s, e, r = tx.words(buf, offs)
    got = [(int(k), buf[a:b].tobytes()) for a, b, k in zip(s, e, r)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    h = tx.spans(tx.prefix(buf), s, e)
    assert len(set(h.tolist())) == len(got)
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10] * 5}).slice(1, 3)
    assert [p.num_rows for p, _, _ in tx.slices(batch, limit=20)] == [2, 1]


def test_suffix_sort_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 14))) for _ in range(rng.randint(1, 9))]
        order, lcp = suffixes.deep_shallow(strings, 0, rng.choice((0, 1, 3)))
        got = [strings[i] for i in order]
        assert sorted(order) == list(range(len(strings))) and got == sorted(strings)
        want = [0] + [len(x) if x == y else next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) for x, y in zip(got, got[1:])]
        assert lcp.tolist() == want


@pytest.mark.parametrize("group", [1024, 2])
def test_suffix_dedup(spark, corpus, nothing, group):
    rows, df = corpus
    n = 40
    seen = Counter(t[i : i + n] for _, x, *_ in rows for t in [(x or "").encode()] for i in range(len(t) - n + 1))
    want = {}
    for i, x, *_ in rows:
        t = (x or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want.setdefault(i, []).append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    assert by_id(suffixes.reported(spark, df, length=n, gram=10, group=group), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffixes.reported(spark, nothing).count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    both = np.concatenate([a[:240], a[60:]])
    sig = minhash.superminhash(both, np.array([0, 240, 480]), 192)
    assert abs((sig[0] == sig[1]).mean() - 180 / 300) < 0.12
    one = minhash.superminhash(a[:1], np.array([0, 1, 1]), 192)
    assert len(set((one[0] >> np.uint64(32)).tolist())) == 192 and (one[1] == np.iinfo(np.uint64).max).all()


def test_near_duplicates(spark, corpus, nothing):
    rows, df = corpus
    sets = {}
    for i, x, *_ in rows:
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    want = {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    got = by_id(minhash.near_duplicates(spark, df), "n_shingles", "component_id", "kept")
    assert {k: v[0] for k, v in got.items()} == want and sum(map(len, got.values())) == len(rows)
    assert minhash.near_duplicates(spark, nothing).count() == 0
    assert minhash.one_of_each(spark, df).count() == sum(v[2] for v in want.values())


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(14)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = [(1, a, "p"), (1, b, "q"), (2, a + " x", "r"), (3, b + " y", "s"), (None, a, "t"), (None, None, "u"), (None, "two words", "v"), (None, "two words", "w"), (5, "", "x"), (1, a, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _id string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(spark, df).collect())
    assert got == sorted([(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (0, 1, False), (0, 0, True), (0, 0, True), (0, 0, True), (5, 5, True)])
    one = minhash.one_of_each(spark, df)
    assert one.columns == df.columns and sorted((r["doc_id"] or 0, r["text"]) for r in one.where("text IS NOT NULL").collect()) == sorted([(0, "two words"), (1, a), (1, b), (5, "")])


def test_large_group_of_near_copies(spark):
    rng = random.Random(16)
    base = prose(rng, 150).split()
    docs = []
    for i in range(250):
        w = list(base)
        for p in rng.sample(range(len(w)), rng.randint(0, 14)):
            w[p] = rng.choice(["of", "to", "new" + str(rng.random())])
        docs.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: find(i) for i in range(len(docs))} and len(set(got.values())) > 20


def test_parity_maps_bound_the_difference():
    rng = random.Random(17)
    texts = [" ".join(rng.choices(SYLLABLES, k=rng.randint(1, 400))) for _ in range(20)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(20)), "text": texts})
    maps = [np.array(x, np.int64).view(np.uint64) for b in minhash.parities(5)([batch]) for x in b.column(1).to_pylist()]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in texts]
    for i, j in itertools.combinations(range(20), 2):
        assert int(np.bitwise_count(maps[i] ^ maps[j]).sum()) <= len(sets[i] ^ sets[j])


def test_every_two_substitutions_leave_a_hit():
    for lost in itertools.combinations(range(decontaminate.MIN_TOKENS), 2):
        assert any(all(m[p - o] == "0" for p in lost if 0 <= p - o < len(m)) for m in decontaminate.MASKS for o in range(decontaminate.MIN_TOKENS - len(m) + 1))


def test_every_fifth_substituted_leaves_a_hit():
    for n, k in ((13, 2), (15, 3), (20, 4), (25, 5)):
        lost = np.array([sum(1 << p for p in c) for c in itertools.combinations(range(n), k)])
        hit = np.zeros(len(lost), bool)
        for m in decontaminate.MASKS:
            for o in range(n - len(m) + 1):
                hit |= (lost & (int(m[::-1], 2) << o)) == 0
        assert hit.all(), (n, k)


def test_overlap_is_the_stretch_of_most_matches():
    flank = np.zeros(4, bool)
    for n, k in ((13, 2), (20, 3)):
        for lost in itertools.combinations(range(n), k):
            equal = np.ones(n, bool)
            equal[list(lost)] = False
            a, b = decontaminate.overlap(np.concatenate([flank, equal, flank]), 0.8, 13)
            assert b - a >= 13 and 10 * (m := int(np.concatenate([flank, equal, flank])[a:b].sum())) >= 8 * (b - a) and m >= min(n - k, 11)
    rng = np.random.default_rng(4)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 45)) < rng.choice([0.5, 0.75, 0.85])
        match = np.concatenate([[0], np.cumsum(equal)])
        ok = [int(match[b] - match[a]) for a in range(len(equal)) for b in range(a + 13, len(equal) + 1) if 10 * (match[b] - match[a]) >= 8 * (b - a)]
        a, b = decontaminate.overlap(equal, 0.8, 13)
        assert equal[a:b].sum() == max(ok, default=0) and (b - a >= 13) == bool(ok)


def test_overlaps_of_the_stated_share_are_found(spark):
    rng = random.Random(6)
    item = [f"w{i}" for i in range(25)]
    cases = [(13, c) for c in itertools.combinations(range(13), 2)] + [(15, (3, 7, 11)), (20, (4, 9, 14, 19)), (25, (4, 9, 14, 19, 24))] + [(n, tuple(rng.sample(range(n), n // 5))) for n in (16, 18, 20, 22, 25) for _ in range(20)]
    docs = [(i, " ".join(["x y z", *("sub" if p in c else w for p, w in enumerate(item[:n])), "u v"])) for i, (n, c) in enumerate(cases)]
    found = decontaminate.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(len(cases))) and all(r["n_overlap"] >= 13 and 10 * r["n_matched"] >= 8 * r["n_overlap"] for r in found)


def test_decontamination(spark, nothing):
    rng = random.Random(5)
    items = [prose(rng, 30), prose(rng, 14), "only six words are in here", None, ""]
    words = items[0].split()
    swapped = [w if i % 8 != 3 else "zzz" for i, w in enumerate(words)]
    docs = ["x y z " + items[0].upper(), prose(rng, 20) + " " + " ".join(swapped), " ".join(words[:13]), " ".join(words[:8]), "so " + items[2] + " now", "only six words were in here", None, "", prose(rng, 80)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (decontaminate.BLOCK_TOKENS, 20):
        got = decontaminate.contaminated(spark, df, bench, block_tokens=block)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(0, 0), (1, 0), (2, 0), (4, 2)}
        assert sorted(r["doc_id"] for r in decontaminate.decontaminate(spark, df, bench, block_tokens=block).collect()) == [3, 5, 6, 7, 8]
    assert decontaminate.contaminated(spark, nothing, bench).count() == 0
    assert decontaminate.contaminated(spark, df, bench.limit(0)).count() == 0


def test_decontamination_is_brute_force(spark):
    rng = random.Random(15)
    vocabulary = [f"t{i}" for i in range(40)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (30, 22, 14, 13, 9, 6, 3, 1)]
    docs = []
    for _ in range(120):
        t = rng.choices(vocabulary, k=rng.randint(0, 40))
        for item in rng.sample(items, 2):
            w = item.split()
            a = rng.randrange(max(1, len(w) - 13))
            w = w[a : a + rng.randint(10, 30)]
            for _ in range(rng.randint(0, len(w) // 4)):
                w[rng.randrange(len(w))] = "other"
            t[rng.randint(0, len(t)) :] = [*w, rng.choice(["\n", "end"])] + t[rng.randint(0, len(t)) :]
        docs.append((rng.choice([None, len(docs)]), " ".join(t)))
    docs += [(7, "x\n" + items[6].upper() + "!\ny"), (7, "x " + items[6]), (None, items[7])]
    want = Counter()
    for i, text in docs:
        t, lines = text.lower().split(), [tuple(x.replace("!", " ").lower().split()) for x in text.split("\n")]
        for k, item in enumerate(items):
            w = item.split()
            found = False
            if len(w) < 5:
                found = tuple(w) in lines
            else:
                for shift in range(-len(w), len(t)):
                    lo, hi = max(0, -shift), min(len(w), len(t) - shift)
                    match = np.concatenate([[0], np.cumsum([t[shift + p] == w[p] for p in range(lo, hi)])]).astype(int)
                    n = len(match)
                    found |= any((match[b] - match[a] == len(w)) if len(w) < 13 else 10 * (match[b] - match[a]) >= 8 * (b - a) for a in range(n) for b in range(a + min(13, len(w)), n))
            want[i, k] += found
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (decontaminate.BLOCK_TOKENS, 20):
        got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, df, bench, block_tokens=block).collect())
        assert got == +want
    clashing = df.selectExpr("doc_id", "text", "doc_id AS item_id", "text AS th")
    assert decontaminate.decontaminate(spark, clashing, bench).columns == clashing.columns


def test_quality_learns_structure(spark, corpus, nothing):
    rng = random.Random(8)
    good = [prose(rng, rng.randint(20, 120)) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, rng.randint(20, 120)).split()) for _ in range(100)]
    texts = [x for p in zip(good, good[100:], good[200:], bad) for x in p]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 0 if t in bad else 1, 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    machine = quality.train(spark, docs, labels)
    got = quality.scored(spark, docs, machine).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (texts[r["doc_id"]] not in bad) for r in held]) > 0.95
    odd = quality.scored(spark, corpus[1].drop("n_chars"), machine).collect()
    assert len(odd) == len(corpus[0]) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.train(spark, docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.scored(spark, docs.limit(3), None).collect()} == {0.5}
    assert quality.keep_good(spark, nothing, labels).columns == nothing.columns
    z, _ = quality.forward(0.1, *(np.arange(1, 7, dtype=float).reshape(6, -1)[:, 0], np.arange(12, dtype=float).reshape(6, 2) / 10), np.array([0, 2, 5]), np.array([1.0, 0.5, 2.0]), np.array([0, 3]))
    w, v, x, f = np.arange(1, 7), np.arange(12).reshape(6, 2) / 10, [1.0, 0.5, 2.0], [0, 2, 5]
    slow = 0.1 + sum(w[i] * a for i, a in zip(f, x)) + sum(v[f[i]] @ v[f[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert z[0] == pytest.approx(slow)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    sizes = [1, 3, 63, 64, 65, 0, 200]
    score = rng.normal(0, 3, (sum(sizes), 3)).astype(np.float32)
    at = np.concatenate([[0], np.cumsum(sizes)])
    label = language.viterbi(score, at, 4.0)
    for a, b in zip(at[:-1], at[1:]):
        if b > a:
            v = score[a].astype(float)
            for t in range(a + 1, b):
                v = (v[:, None] - 4.0 * (1 - np.eye(3))).max(axis=0) + score[t]
            p = label[a:b]
            assert score[np.arange(a, b), p].sum() - 4.0 * (p[1:] != p[:-1]).sum() == pytest.approx(v.max(), abs=1e-2)


def test_letters_are_those_of_unicode():
    import unicodedata

    from tessella.llm import scripts

    chars = "aZ1\u0660\u0966\u0e50\u2102\u3005\u00aa\u0301é漢字ж!\u02b0\U00020000\U0001f600"
    at, script = scripts.characters(np.frombuffer(chars.encode(), np.uint8))
    assert len(at) == len(chars) and [x != scripts.NONE for x in script] == [unicodedata.category(c)[0] == "L" for c in chars]


def test_languages(spark, corpus, nothing):
    rng = random.Random(4)
    words = {"aa": "bal dom kir tun".split(), "bb": "ésh öry wex qui".split(), "ru": "да нет мир дом".split()}
    make = lambda k, n: " ".join(rng.choice(words[k]) + rng.choice(words[k]) for _ in range(n))
    docs = [(i, make(k, 40), k, None, None) for i, k in enumerate(["aa", "bb", "ru"] * 40)]
    df = spark.createDataFrame(docs, SCHEMA)
    speaker = language.train(df)
    assert [r["lang_pred"] for r in language.identified(spark, df, speaker).orderBy("doc_id").collect()] == [d[2] for d in docs]
    mixed = spark.createDataFrame([(0, make("aa", 30) + " " + make("ru", 30)), (1, None), (2, "123 !!"), (3, "")], "doc_id long, text string")
    parts = language.spans(spark, mixed, speaker).orderBy("span").collect()
    assert [r["lang"] for r in parts] == ["aa", "ru"] and "".join(r["text"] for r in parts) == mixed.orderBy("doc_id").first()["text"]
    assert [tuple(r)[2:] for r in language.identified(spark, mixed, speaker).orderBy("doc_id").collect()][1:] == [("und", 0.0)] * 3
    assert language.train(nothing) is None and language.identified(spark, nothing, None).count() == 0
    assert language.identified(spark, corpus[1], language.train(corpus[1])).count() == len(corpus[0])


def test_lm_base_counts_and_gain(spark, corpus, nothing):
    rows, df = corpus
    toks = lambda x: (x or "").encode().lower().split() + [None]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows}
    c = Counter(w for i, x, *_ in rows if not held[i] for w in toks(x))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, x, *_ in rows:
        t = toks(x)
        want.setdefault(i, []).append((held[i], len(t), sum(c[w] > 0 for w in t), n, pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))))
    got = lm.scored(spark, df)
    assert by_id(got, "held_out", "n_tokens", "n_known", "train_tokens", "base_score") == want
    assert all(r["score"] < 0 and (r["bits_per_byte"] is None) == (not dict((i, x) for i, x, *_ in rows)[r["doc_id"]]) for r in got.collect())
    assert lm.scored(spark, nothing).count() == 0
    odd = spark.createDataFrame([(None, "one two"), (None, "three"), (None, None), (7, "one two"), (7, "other"), (7, "other")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in lm.scored(spark, odd).collect()) == [(0, 1), (0, 2), (0, 3), (7, 2), (7, 2), (7, 3)]


def test_lm_score_spells_unseen_words(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    rng = random.Random(10)
    unseen = ["qzxv", "qzxvkjwqpzxvqkjwzzqxvbnm", "erinon", "xq9"]
    docs = [(i, prose(rng, 60)) for i in range(200) if i not in held] + list(zip(held, unseen))
    got = {r["doc_id"]: r for r in lm.scored(spark, spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()}
    one = [got[i] for i in held]
    assert [r["n_tokens"] - r["n_known"] for r in one] == [1] * 4
    assert all(r["bits_per_byte"] * len(w) * math.log10(2) == pytest.approx(-r["score"]) for r, w in zip(one, unseen))
    assert one[1]["score"] < one[0]["score"] - 5 and one[2]["score"] > one[0]["score"]


def test_lm_knows_longer_texts(spark):
    rng = random.Random(13)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    passage = prose(rng, 1200)
    docs = [(i, prose(rng, 600)) for i in range(100)]
    docs[held[0]] = (held[0], prose(rng, 20) + " " + passage)
    learned = next(i for i in range(100) if i not in held)
    docs[learned] = (learned, passage + " " + prose(rng, 20))
    twice = [i for i in range(100) if i not in held][5:7]
    docs[twice[1]] = (twice[1], docs[twice[0]][1])
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm.scored(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    usual = sorted(x for i, x in got.items() if i not in (held[0], learned, *twice))
    assert max(got[held[0]], got[twice[0]], got[twice[1]]) < 0.75 * usual[5] and got[twice[0]] == pytest.approx(got[twice[1]])


def test_lm_successors_are_brute_force(spark):
    rng = random.Random(12)
    parts = [prose(rng, 40) for _ in range(6)]
    docs = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(40)] + [(41, None), (41, "a"), (None, " ".join(parts))]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

    def cut(text):
        buf, offs = tx.utf8(pa.array([text or ""]))
        low = tx.LOWER[buf]
        s, e, row = tx.words(low, offs)
        first, r, number, h = lm.segments(tx.spans(tx.prefix(low), s, e), row)
        assert (np.diff(np.append(first, len(s))) <= lm.LONGEST).all() and number.tolist() == list(range(len(h)))
        return h.tolist()

    cuts = [(i, t, cut(t)) for i, t in docs]
    total = Counter(pair for i, _, h in cuts if not held(i) for pair in zip(h, h[1:]))
    want = {}
    for i, t, h in cuts:
        pairs = list(zip(h, h[1:]))
        own, found = Counter(pairs) if not held(i) else Counter(), []
        for k, (p, s) in enumerate(pairs):
            known = Counter(total)
            known.subtract(own)
            known.update(pairs[:k])
            n = sum(c for (q, _), c in known.items() if q == p)
            if n > 0:
                found.append((k + 1, n, known[p, s]))
        if found:
            want[i, t] = found
    from tessella.llm.storage import Scratch
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text"))
    got = lm.successors(spark, df, Scratch(spark)).join(df.withColumnRenamed("doc_id", "id"), "th").where("id <=> doc_id").collect()
    assert {(r["id"], r["text"]): [tuple(e) for e in r["events"]] for r in got} == want


def test_lm_successor_bits():
    rng = np.random.default_rng(3)
    row = np.sort(rng.integers(0, 6, 60))
    number = np.arange(60) + rng.integers(0, 2, 60).cumsum()
    n, hit = rng.integers(1, 400, 60), rng.integers(0, 2, 60)
    for i, cell in enumerate(lm.cells(number, n, hit, row).tolist()):
        before = [k for k in range(i) if row[k] == row[i]][-2:][::-1]
        one, two = ([hit[k] + 1 for k in before] + [0, 0])[:2]
        near = bool(before) and number[before[0]] == number[i] - 1
        assert cell == ((one * 3 + two) * lm.MAGNITUDES + min(int(math.log2(n[i])), lm.MAGNITUDES - 1)) * 2 + near
    counts = rng.integers(0, 5000, (lm.CELLS, 2))
    bits = lm.bit_costs(counts)
    assert (2.0**-bits).sum(axis=1) == pytest.approx(np.ones(lm.CELLS)) and np.abs(2.0 ** -bits[:, 1] - counts[:, 1] / counts.sum(axis=1)).max() < 0.2
    assert np.isfinite(lm.bit_costs(np.zeros((lm.CELLS, 2), np.int64))).all()


def test_lm_mixes_the_words_before():
    from tessella.llm import sequence

    class Value:
        def __init__(self, value):
            self.value = value

    rng = random.Random(21)
    names = [f"w{i}" for i in range(60)]
    after = {w: rng.sample(names, 2) for w in names}

    def walk(n):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(walk(200)) for _ in range(600)])], ["text"])
    count = sum(np.bincount(sequence.buckets(w), minlength=sequence.BUCKETS) for w, _ in sequence._texts([batch]))
    tree = sequence.Tree.of(count)
    flat = np.zeros(sequence.ORDERS << (sequence.SLOT_BITS + 1), np.uint32)
    for part in sequence._tally(Value(tree))([batch]):
        k = part.column(0)[0].as_py() * tables.PACK
        flat[k : k + tables.PACK] = tables._open(part.column(1)[0].as_py())
    assert flat.sum() == sequence.ORDERS * (count * tree.size).sum()
    said = np.stack([sequence.views(s[:, 0], s[:, 1]) for s in flat.reshape(sequence.ORDERS, -1, 2)])
    learned = {}
    for part in sequence._learn(Value((tree, said)))([batch]):
        for name, chunk, x in zip(*(c.to_pylist() for c in part.columns)):
            learned.setdefault(name, {})[chunk] = np.frombuffer(x, np.int64)
    model = sequence.Sequence(tree, said, *sequence.settled(learned))

    def bits(words):
        word, row = sequence.tokens(*tx.utf8(pa.array([" ".join(words)])))
        return model.bits(word, sequence.contexts(word, row), np.zeros(len(word), bool)).sum()

    text = walk(300)
    assert bits(text) < 0.5 * bits(rng.sample(text, len(text)))  # the same words in another order
    every = np.arange(sequence.BUCKETS, dtype=np.uint64) << np.uint64(64 - sequence.BUCKET_BITS)
    word, row = sequence.tokens(*tx.utf8(pa.array(["w1 w2"])))
    before = [np.repeat(c[1], len(every)) for c in sequence.contexts(word, row)]
    assert (2.0 ** -model.bits(every, before, np.zeros(len(every), bool))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_slots_are_small_and_exact(monkeypatch):
    from tessella.llm import sequence

    rng = np.random.default_rng(4)
    no, yes = (rng.integers(0, 64, 1 << sequence.SLOT_BITS).astype(np.uint32) for _ in range(2))
    said = sequence.views(no, yes)
    assert said.nbytes * sequence.ORDERS < 20e6  # every executor and the driver keep a copy on disk, whatever the input
    for view, a, b in ((0, 0, 0), (1, 1, 0), (2, 0, 1)):
        got = sequence.LOOKS[(view << 16) + said.astype(int)] & sequence.LOW
        logit = np.log((np.maximum(yes.astype(int) - b, 0) + 0.4) / (np.maximum(no.astype(int) - a, 0) + 0.4))
        assert np.abs((got - float(sequence.MIDDLE)) / sequence.SHARP - logit).max() < 0.51 / sequence.SHARP
    large = np.unique(np.rint(2.0 ** rng.uniform(6, 31.9, 9999)).astype(np.uint32))
    kept = sequence.COUNTS[sequence.views(large, 0 * large) >> 8]
    assert np.abs(kept / large - 1).max() < 0.06
    # tokens brought in order and equal ones added at once give the counts of one by one
    tree = sequence.Tree.of(rng.integers(0, 99, sequence.BUCKETS))
    ctx, bucket = rng.integers(0, 2**32, 40).astype(np.uint32)[rng.integers(0, 40, 500)], rng.integers(0, 30, 500)
    table, want = np.zeros(2 << sequence.SLOT_BITS, np.uint32), Counter()
    monkeypatch.setattr(sequence, "BLOCK", 64)
    sequence._add(table, tree, ctx.astype(np.uint64) << np.uint64(sequence.BUCKET_BITS) | bucket.astype(np.uint64))
    for c, b in zip(ctx.tolist(), bucket.tolist()):
        for code in tree.code[: tree.size[b], b].tolist():
            x = c ^ (code & ~1)
            low = (x * 0xC2B2AE35 % 2**32) >> (32 - sequence.SLOT_BITS + sequence.PART_BITS)
            want[2 * ((x >> (32 - sequence.PART_BITS) << (sequence.SLOT_BITS - sequence.PART_BITS)) | low) + (code & 1)] += 1
    assert {int(i): int(table[i]) for i in np.flatnonzero(table)} == want


def test_lm_head_takes_whole_counts(spark, monkeypatch):
    priced = spark.createDataFrame([(c,) for c in (0, 1, 1, 1, 5, 7, 7, 9)], "c long")
    for most, least in ((1, 9), (2, 9), (3, 7), (4, 5), (6, 5), (7, 1), (9, 0)):
        monkeypatch.setattr(lm, "HEAD", most)
        assert lm.head_count(priced) == least
    assert lm.head_count(priced.where("c < 0")) >= 0


def test_lm_costs_are_a_distribution():
    rng = np.random.default_rng(0)
    mixer = lm.Mixer(rng.normal(0, 1, lm.OFFSETS[-1]).astype(np.float32), lm.start_weights(), rng.normal(0, 1, 256 * lm.LEVELS).astype(np.float32), rng.random(1 << lm.CONTEXTS[-1][1]) < 0.5)
    data = np.arange(256, dtype=np.uint8)
    one = lm.Words(np.arange(256), np.zeros(0), np.zeros(0), data, np.arange(256))
    assert (2.0 ** -mixer.bits(one)).sum() == pytest.approx(1, abs=1e-4)


def test_fertility(spark, corpus, nothing):
    rows, df = corpus
    got = by_id(fertility.ruled(spark, df), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, x, *_ in rows:
        x = x or ""
        w = x.encode().split()
        lines = [k for k in x.encode().split(b"\n") if k.split()]
        win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = len({k + j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(8)})
        want = (len(w), sum(len(k.decode()) for k in w), sum(ch in "#*$%&|<>" for ch in x), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w))
        assert set(got[i]) == {want}, i
    assert fertility.ruled(spark, nothing).count() == 0


def test_fertility_bands_by_language_and_rare_scripts(spark):
    rng = random.Random(12)
    rows = []

    def add(lang, script, n, low, high):
        for _ in range(n):
            rows.append((len(rows), lang, script, rng.uniform(low, high)))
        return len(rows) - 1

    add("aa", "latin", 200, 1.9, 2.0)
    add("bb", "latin", 200, 2.6, 2.7)
    junk = add("bb", "latin", 1, 1.95, 1.95)  # usual in the other language
    good = add("aa", "latin", 1, 1.95, 1.95)
    few = add("cc", "latin", 1, 2.3, 2.3)
    add("dd", "thai", 40, 0.9, 1.0)
    odd = add("dd", "thai", 1, 5.0, 5.0)
    measured = spark.createDataFrame([(i, lang, script, False, x, x, 0.0, 0.7) for i, lang, script, x in rows], "doc_id long, lang string, script string, base_failed boolean, " + ", ".join(f"{m} double" for m in fertility.MEASURES))
    got = {r["doc_id"]: r["piece_chars_low"] <= r["piece_chars"] <= r["piece_chars_high"] for r in fertility.limited(measured, fertility.binned(measured), fertility.WIDTH).collect()}
    assert len(got) == len(rows) and {i for i, inside in got.items() if not inside} == {junk, odd} and got[good] and got[few]


def spans_of(rows):
    """Texts after sentence-span dedup, one row after the other, by the rule alone."""
    cuts = []
    for _, x in rows:
        buf, offs = tx.utf8(pa.array([x or ""]))
        start, _, size, h, _ = sentences.sentences(buf, offs)
        cuts.append((start.tolist(), size.tolist(), h.tolist(), buf.tobytes()))
    place = lambda i: (rows[i][0] is None, rows[i][0] or 0, spans_of.th[rows[i][1]])
    runs = {}
    for i, (_, size, h, _) in enumerate(cuts):
        for k, least in sentences.RUNS:
            for a in range(len(h)):
                b = a + k
                while b <= len(h) and sum(size[a:b]) < least:
                    b += 1
                if b <= len(h):
                    runs.setdefault((least, tuple(h[a:b])), []).append((place(i), a, b, i))
    gone = [[False] * len(c[0]) for c in cuts]
    for found in runs.values():
        first = min(found)[:2]
        for where, a, b, i in found:
            if (where, a) != first:
                gone[i][a:b] = [True] * (b - a)
    out = []
    for (start, _, _, raw), g in zip(cuts, gone):
        edge = [*start, len(raw)]
        out.append((raw[: edge[0]] + b"".join(raw[a:b] for a, b, x in zip(edge, edge[1:], g) if not x)).decode())
    return out


def test_cuts_do_not_depend_on_other_rows():
    rng = random.Random(20)
    texts = [prose(rng, n).replace(".", "" if k % 2 else ".").lower() for k, n in enumerate((1, 2, 3, 30, 200, 7, 90))]

    def cuts(rows):
        buf, offs = tx.utf8(pa.array(rows))
        low = tx.LOWER[buf]
        s, e, row = tx.words(low, offs)
        word = tx.spans(tx.prefix(low), s, e)
        _, r, number, h = lm.segments(word, row)
        start, own, _, key, _ = sentences.sentences(buf, offs)
        return [(h[r == i].tolist(), number[r == i].tolist(), key[own == i].tolist()) for i in range(len(rows))]

    alone = [cuts([t])[0] for t in texts]
    for order in ([3, 1, 0, 2, 4, 6, 5], [0, 1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1, 0]):
        assert cuts([texts[i] for i in order]) == [alone[i] for i in order]


def test_sentence_spans(spark, corpus, nothing):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    passage = " ".join(prose(rng, 12) for _ in range(5))
    flat = prose(rng, 70).replace(".", "").lower()
    c = prose(rng, 40)
    docs = [(2, prose(rng, 40) + "\n" + passage), (1, "Lead in here now. " + passage + " " + prose(rng, 20)), (3, passage + "\n" + passage), (4, prose(rng, 60)), (5, None), (6, "")]
    docs += [(7, prose(rng, 9) + " Some words ahead " + flat + " and behind."), (8, "Others stand here before it " + flat), (9, "again " * 400), (None, passage), (None, c), (2, c), (2, "Short. " + passage[:200])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans_of.th = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    got = sentences.deduplicated(spark, df).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter((i, t) for (i, _), t in zip(docs, spans_of(docs)))
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[1] == docs[1][1] and text[4] == docs[3][1] and text[5] is None and text[6] == ""
    assert text[3].strip() == "" and len(text[8].split()) < 40 and len(text[9].split()) < 120
    rows = [(i, x) for i, x, *_ in corpus[0]]
    spans_of.th = {r["text"]: r["h"] for r in corpus[1].select("text", F.xxhash64("text").alias("h")).collect()}
    unique = list(dict.fromkeys(rows))
    got = sentences.deduplicated(spark, corpus[1]).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["text"] or "") for r in got} == {(i, t) for (i, _), t in zip(unique, spans_of(unique))}
    assert sentences.deduplicated(spark, nothing).count() == 0


def test_sentence_spans_of_one_id_with_other_texts(spark):
    rng = random.Random(19)
    a, c = prose(rng, 90), prose(rng, 20)
    docs = [(1, a), (2, a), (2, c)]
    got = Counter((r["doc_id"], r["text"]) for r in sentences.deduplicated(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect())
    assert got == Counter([(1, a), (2, ""), (2, c)])


def test_mixture(spark, corpus, nothing):
    rows, df = corpus
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows) and {r["n_tokens"] for r in got if r["doc_id"] == 0} == {len(rows[0][1].split())}
    cells = spark.createDataFrame([(s, k, "t", 10.0 * (i + 1) + 7 * j) for i, s in enumerate("ab") for j, k in enumerate("xyz")], "source string, lang string, topic string, tokens double")
    from tessella.llm.storage import Scratch

    raked = mixing.rake(cells, Scratch(spark), {"source": 0.0, "lang": 0.5, "topic": 1.0}, 30).join(cells, ["source", "lang", "topic"]).toPandas()
    w = raked["factor"] * raked["tokens"]
    assert w.groupby(raked["source"]).sum().tolist() == pytest.approx([w.sum() / 2] * 2) and w.sum() == pytest.approx(raked["tokens"].sum())
    for r in mixing.margins(mixing.mixed(df, rate=0.01)).collect():
        assert r["expected"] == pytest.approx(r["target"], abs=0.02), r
    assert mixing.mixed(nothing).count() == 0 and mixing.sampled(df.withColumnRenamed("n_chars", "probability")).columns[-1] == "probability"


def test_shards(spark, corpus, nothing):
    rows, df = corpus
    got = shards.shard_report(df, 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for i, x, *_ in rows)
    each = Counter(r["shard"] for r in got)
    assert set(each) == set(range(7)) and max(each.values()) - min(each.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in each.items())
    whole = shards.shard_documents(df.withColumnRenamed("lang", "shard"), 7)
    assert whole.count() == len(rows) and whole.columns.count("shard") == 1
    assert shards.shard_report(nothing).count() == 0 and shards.shard_documents(nothing, 3).count() == 0
    many = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")
    mix = shards.shard_documents(many, 10).groupBy("shard").agg({"source": "count"}).count()
    share = shards.shard_documents(many, 10).where("source = 'hot'").groupBy("shard").count().collect()
    assert mix == 10 and max(r["count"] for r in share) - min(r["count"] for r in share) <= 2


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, a text of megabytes, empty ones, and columns whose names the operators use themselves."""
    rng = random.Random(21)
    long = " ".join(prose(rng, 2000) for _ in range(300))
    texts = [(None, prose(rng, 60)), (None, None), (None, ""), (3, prose(rng, 60)), (3, prose(rng, 50)), (3, None), (4, long), (5, "٠١٢ ０१२ 3"), (6, "ℂ々")]
    names = ["_id", "_text", "_row", "_kept", "_key", "_k", "_d", "_c", "_chars", "_t", "u", "th", "h", "id", "comp", "kept", "n", "events", "where", "probability", "slot"]
    rows = [(i, t, "en", "s", len(t or ""), *range(len(names))) for i, t in texts]
    return texts, spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{n} int" for n in names)).repartition(2)


def test_odd_rows_give_a_row_each(spark, odd):
    texts, df = odd
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    ids = Counter(i for i, _ in texts)
    speaker = language.train(df)
    for out in (suffixes.reported(spark, df), quality.scored(spark, df, quality.train(spark, df, labels)), language.identified(spark, df, speaker), lm.scored(spark, df), fertility.ruled(spark, df), sentences.deduplicated(spark, df), mixing.mixed(df), minhash.near_duplicates(spark, df), shards.shard_report(df, 4)):
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == ids, out.columns
    lang = Counter((r["doc_id"], r["lang_pred"]) for r in language.identified(spark, df, speaker).collect())
    assert lang[5, "und"] == 1 and lang[6, "en"] == 1 and lang[None, "und"] == 2
    assert "".join(r["text"] for r in language.spans(spark, df, speaker).where("doc_id = 4").collect()) == texts[6][1]


def test_odd_rows_in_the_stages(spark, odd):
    texts, df = odd
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, texts[0][1])], "item_id long, text string")
    whole = [(i, t) for i, t in texts]
    for block in (decontaminate.BLOCK_TOKENS, 20):
        clean = decontaminate.decontaminate(spark, df, bench, block_tokens=block)
        assert clean.columns == df.columns and (None, texts[0][1]) not in [(r["doc_id"], r["text"]) for r in clean.select("doc_id", "text").collect()]
    for out, n in ((quality.keep_good(spark, df, labels), None), (minhash.one_of_each(spark, df), len(whole)), (mixing.sampled(df, rate=10.0), len(whole))):
        got = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
        assert out.columns == df.columns and not Counter(got) - Counter(whole) and n in (None, len(got))
    placed = shards.shard_documents(df, 3)
    assert [c for c in placed.columns if c not in ("shard", "slot")] == [c for c in df.columns if c != "slot"] and placed.count() == len(whole)
    none = df.limit(0)
    assert minhash.one_of_each(spark, none).count() == decontaminate.decontaminate(spark, none, bench).count() == quality.keep_good(spark, none, labels).count() == mixing.sampled(none).count() == shards.shard_documents(none, 3).count() == 0


def test_tables_sum(spark):
    def emit(batches):
        for _ in batches:
            yield from tables.chunks({"x": np.arange(10000), "y": np.zeros(5, np.int64)})

    got = tables.summed(spark.range(8).repartition(4).mapInArrow(emit, tables.SCHEMA))
    total = tables.whole(got["x"], 10000)
    assert set(got) == {"x"} and (total == np.arange(10000) * (total[1])).all() and total[1] >= 4


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.select(columns).exceptAll(before.select(columns)).count() == 0
        assert docs.columns == columns if i < 4 else docs.columns == [*columns, "shard", "slot"]
    assert 0 < docs.count() < before.count() + 1
