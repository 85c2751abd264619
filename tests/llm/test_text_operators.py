"""Operators on texts against brute force on small corpora with nulls, empties, ties, repeated rows and clashing names."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, minhash_forest, suffix_dedup, window_dedup
from tidewatch.llm import exchange as X
from tidewatch.llm import kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, block int, kept string, node long"  # names that operators use themselves


def corpus() -> list[tuple]:
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, long_ = say(40), say(6000)
    texts = [None, "", " \n\t ", "one", "One", "two words", say(80), passage, "x " * 300, "aaaa" * 100]
    for k in range(60):
        texts.append(say(30) + "\n" + passage + " " + say(k))
        near = say(120).split()
        texts.append(" ".join(near))
        near[k % 120] = "changed"
        texts.append(" ".join(near).upper() if k % 9 == 0 else " ".join(near))
    texts += [long_, long_ + " end", texts[20], texts[20]]
    rows = [(i * 3 + 1, t, 7, "k", 9) for i, t in enumerate(texts)]
    rows += [(rows[15][0], rows[15][1], 7, "k", 9), (rows[16][0], passage, 7, "k", 9), (None, passage, 7, "k", 9), (None, None, 7, "k", 9)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def removal(rows, width, units):
    first: dict = {}
    for i, t, *_ in rows:
        u = units(t)
        for k in range(len(u) - width + 1):
            if i is not None:
                key = tuple(u[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            if i is not None and first[tuple(u[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, u, gone))
    return out


def test_window_dedup(docs):
    want = sorted(((i, len(u), sum(g), hashlib.sha256(" ".join(x for x, d in zip(u, g, strict=True) if not d).encode()).hexdigest()) for i, u, g in removal(corpus(), 13, lambda t: WORD.findall(t or ""))), key=str)
    got = window_dedup.remove_repeats(docs, 13, digest=True, block_bytes=2000)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == want
    assert sorted((r.doc_id, r.n_removed) for r in window_dedup.remove_repeats(docs.where("doc_id > 0"), 13).collect()) == sorted((w[0], w[2]) for w in want if w[0] is not None)


@pytest.mark.parametrize("hot", [False, True])
def test_two_levels_of_exchange_give_the_same(docs, hot):
    """Blocks in groups, buckets in two steps: the rows of a single level, which other tests compare with brute force."""
    rows = docs if not hot else docs.unionByName(docs.selectExpr("doc_id + 1 as doc_id", "text", "block", "kept", "node")).unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "concat('odd ', text) as text", "block", "kept", "node"))
    assert X.levels(16, 16, 0) == (4, 4) and X.levels(17, 34, 0) == (7, 5) and X.levels(4096, 4096) == (4096, 1) and X.levels(4097, 4097)[1] == 65
    for operator, width in ((window_dedup, 13), (suffix_dedup, 50)):
        one, two = ([tuple(r) for r in operator.remove_repeats(rows, width, digest=True, block_bytes=2000, flat=flat).collect()] for flat in (X.FLAT, 0))
        assert sorted(one, key=str) == sorted(two, key=str) and any(r[2] for r in two)


def thue_morse() -> tuple[str, str]:
    """Two words that hashes modulo a power of two confuse under any base."""
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    return a, b


def test_different_words_of_equal_weak_hashes(spark):
    a, b = thue_morse()
    rest = " ".join(f"w{k}" for k in range(12))
    rows = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a}  {rest}")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in window_dedup.remove_repeats(rows, 13).collect()} == {(1, 0), (2, 0), (3, 13)}
    few = spark.createDataFrame([(1, f"{a} x y z u"), (2, f"{b} x y z u"), (3, f"{a}  x y z U")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash_forest.near_duplicates(few, 85).collect()} == {(1, 1), (2, 2), (3, 1)}
    items = spark.createDataFrame([(9, f"{a} x y z u")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(few, items).collect()} == {1, 3}


def test_equal_hashes_remove_nothing_unless_the_words_are_equal(spark, monkeypatch):
    """With one hash for all windows the words alone decide."""
    rows = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i // 2, 30 + i // 2))) for i in range(12)], "doc_id long, text string")
    want = {(r.doc_id, r.n_removed) for r in window_dedup.remove_repeats(rows, 13, block_bytes=100).collect()}
    got = pa.table({"doc_id": pa.array(range(12), pa.int64()), "text": [r.text for r in rows.orderBy("doc_id").collect()], "block": pa.array([0] * 12, pa.int32())})
    monkeypatch.setattr(K, "runs_of", lambda codes, length: np.full(max(0, len(codes) - length + 1), 7, np.uint64))
    out = window_dedup.finish(13, 1, True)(got, X.rows([])).to_pylist()
    assert {(r["doc_id"], r["n_removed"]) for r in out} == want and any(n for _, n in want)


def test_suffix_dedup(docs):
    want = sorted(((i, len(u), sum(g), hashlib.sha256(bytes(x for x, d in zip(u, g, strict=True) if not d)).hexdigest()) for i, u, g in removal(corpus(), 50, lambda t: (t or "").encode())), key=str)
    got = suffix_dedup.remove_repeats(docs, 50, digest=True, block_bytes=2000)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()), key=str) == want


def test_suffix_levels_merge_geometrically():
    import numpy as np

    levels = suffix_dedup.SuffixLevels(4)
    for k in range(16):
        text = np.frombuffer(b"%08d" % (k * 1111), np.uint8)
        first = levels.add(text, np.arange(5), np.full(5, k))
        assert (levels.add(text, np.arange(5), np.full(5, k)) == -1).all() and len(first) == 5
    assert len(levels.levels) <= 6


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert window_dedup.remove_repeats(none).isEmpty() and suffix_dedup.remove_repeats(none).isEmpty()
    assert minhash_forest.near_duplicates(none).isEmpty() and decontaminate.matches(none, items).isEmpty()


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, percent):
    rows = corpus()
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(up))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    at = list(range(len(sets)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and None not in (sets[a][0], sets[b][0]) and 100 * len(x & y) >= percent * len(x | y):
                at[root(a)] = root(b)
    groups: dict = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    want = sorted(((i, len(s), None if i is None else min(groups[root(k)]), True if i is None else i == min(groups[root(k)])) for k, (i, s) in enumerate(sets)), key=str)
    assert sorted((tuple(r) for r in minhash_forest.near_duplicates(docs, percent).collect()), key=str) == want


def test_large_group_of_near_copies(spark):
    """More near copies than a leaf holds: one component."""
    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[r.randrange(200)] = f"c{i}"
        rows.append((i, " ".join(w)))
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert got.select("component_id").distinct().count() == 1


def matched(text, items) -> set:
    """The items that a text holds, by brute force."""
    from collections import Counter

    up, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), set()
    grams = lambda x, n: Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
    d = WORD.findall((text or "").translate(up))
    for item, body in items:
        x = WORD.findall((body or "").translate(up))
        n, width = min(len(x), len(d)), min(5, len(x))
        for a in range(len(d) - n + 1) if x else ():
            p, q = grams(d[a : a + n], width), grams(x, width)
            if p and 100 * (p & q).total() >= 80 * (p | q).total():
                out.add(item)
    return out


def test_clean_judges_rows_not_ids(spark):
    item = " ".join(f"i{k}" for k in range(20))
    rows = [(1, "x " + item), (1, "clean text of the same id"), (None, item + " y"), (None, "clean text without an id"), (None, None), (2, "")]
    left = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(None, item)], "item_id long, text string"))
    assert sorted(map(tuple, left.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)


def test_decontamination(spark, docs):
    rows = corpus()
    passage = next(t for i, t, *_ in rows if i is None and t)
    w = passage.split()
    items = [(1, passage), (2, " ".join(w[:20])), (3, " ".join([*w[:10], "other", *w[11:40]])), (4, None), (5, ""), (6, "one"), (7, passage), (None, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    from collections import Counter

    grams = lambda x, n: Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
    want = set()
    for i, t, *_ in rows:
        d = WORD.findall((t or "").translate(up))
        for item, text in items:
            x = WORD.findall((text or "").translate(up))
            if item is None or not x:
                continue
            n, width = min(len(x), len(d)), min(5, len(x))
            for a in range(len(d) - n + 1):
                p, q = grams(d[a : a + n], width), grams(x, width)
                if p and 100 * (p & q).total() >= 80 * (p | q).total():
                    want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want and len(want) > 100
    parts = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, part_words=10).collect()}
    assert parts == want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    bad = {t for i, t, *_ in rows if i in {x for x, _ in want}} & {t for i, t, *_ in rows if t and not matched(t, items).isdisjoint({1, 2, 3, 5, 6, 7})}
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((i, t) for i, t, *_ in rows if t not in bad), key=str)


def test_report(spark, docs):
    bench = spark.createDataFrame([(2, "one"), (1, "One")], "item_id long, text string")
    assert {tuple(r["items"]) for r in decontaminate.report(docs, bench).where(F.col("n_items") == 2).collect()} == {(1, 2)}


def test_group_around_the_threshold(spark, monkeypatch):
    """A family in one region whose pairs lie on both sides of the threshold: the same components as all pairs give, whatever neighbours
    leave out; blocks smaller than the group change nothing."""
    r = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in r.sample(range(120), r.randint(1, 4)):
            w[at] = f"c{r.randint(0, 10**6)}"
        texts.append(w)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    assert 2 < len(set(comp)) < 140
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    for side in (1 << 19, 2000):
        monkeypatch.setattr(minhash_forest, "SIDE", side)
        got = minhash_forest.near_duplicates(docs, 85).select("doc_id", "component_id").collect()
        assert [c for _, c in sorted(map(tuple, got))] == comp
