"""Rollups, search, archives, classifier, sharding, mixing and pipeline."""

import base64
import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hash_ring, pfair, queries, token_counts, toxicity, vamana, warc

CHANGES = "op string, doc_id long, text string, source string, lang string, tokens int"


def test_rollup(spark, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path / "home"), {"w": token_counts.whitespace()})
    make = lambda *rows: spark.createDataFrame([(*x, 0) for x in rows], CHANGES)
    read = lambda: {(x.source, x.lang): (x.documents, x.tokens, x.bytes) for x in r.totals().collect()}
    assert read() == {}
    first = make(("insert", 1, "a b c", "s", "en"), ("insert", 2, "a", "s", None), ("insert", 3, None, None, None), ("insert", None, "x y", "s", "en"), ("insert", 4, "ü", "s", "en"))
    assert r.commit("1", first) and not r.commit("1", first)
    assert read() == {("s", "en"): (3, 6, 10), ("s", None): (1, 1, 1), (None, None): (1, 0, 0)}
    assert r.commit("2", make(("revise", 1, "a b", "t", "en"), ("delete", 2, None, None, None), ("delete", 2, None, None, None), ("delete", 99, None, None, None), ("DELETE", 3, None, None, None)))
    assert read() == {("s", "en"): (2, 3, 5), ("t", "en"): (1, 2, 3)}
    assert r.commit("3", make(("insert", 2, "b b", "s", None))) and r.commit("4", make(("delete", 2, None, None, None), ("delete", 1, None, None, None)))
    assert read() == {("s", "en"): (2, 3, 5)}
    assert r.commit("5", spark.createDataFrame([], CHANGES)) and len(r.batches()) == 5
    with pytest.raises(Exception, match="unknown op"):
        r.commit("6", make(("upsert", 1, "a", "s", "en")))
    assert len(r.batches()) == 5
    with pytest.raises(ValueError):
        r.commit("a/b", first)


def test_rollup_folds_its_history(spark, tmp_path):
    """With a fold after any batch, totals are those of a rollup that never folds, and of the living documents counted at once."""
    count = lambda home: token_counts.Rollup(spark, str(tmp_path / home), {"w": token_counts.whitespace()})
    folds, plain, living, r = count("folds"), count("plain"), {}, random.Random(2)
    read = lambda x: sorted(map(tuple, x.totals().collect()), key=str)
    assert not folds.compact()
    for batch in range(5):
        rows = []
        for _ in range(12):
            op, i, text, source = r.choice(["insert", "delete", "revise"]), r.randint(1, 9), r.choice([None, "", "a b", "ü x y"]), r.choice([None, "s", "t"])
            if any(i == x[1] for x in rows) or op == "insert" and i in living:
                continue
            rows.append((op, i, text, source, "en", 0))
            living.pop(i, None)
            if op != "delete":
                living[i] = (text or "", source)
        rows.append(("insert", None, "of no id", "s", "en", 0))
        living[-batch - 1] = ("of no id", "s")
        changes = spark.createDataFrame(rows, CHANGES)
        assert folds.commit(f"b{batch}", changes) and plain.commit(f"b{batch}", changes)
        if batch in (1, 2, 4):
            assert folds.compact() and not folds.compact()
        if batch == 2:
            folds.prune()
        assert not folds.commit("b0", changes) and folds.batches() == plain.batches()
        want: dict = {}
        for text, source in living.values():
            n = want.setdefault((source, "en", "w"), [0, 0, 0])
            n[:] = [n[0] + 1, n[1] + len(text.split()), n[2] + len(text.encode())]
        assert read(folds) == read(plain) == sorted(((*k, *n) for k, n in want.items()), key=str)
    folds.prune()
    assert not (tmp_path / "folds/batches/b4/ledger").exists() and len(list((tmp_path / "folds/bases").iterdir())) == 1
    assert read(folds) == read(plain)
    assert folds.current().where("sign <> 1").isEmpty() and folds.current().count() == sum(i > 0 for i in living)


@pytest.mark.parametrize("nulls", [1, 3])
def test_token_count_query_keeps_one_null_text(spark, tmp_path, nulls):
    rows = [(i, None, "s", "en") for i in range(5, 5 + nulls)] + [(1, "a b", "s", "en"), (2, "a b", "t", "en"), (3, "", "s", "en"), (4, "", "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.source, x.lang, x.tokenizer): (x.documents, x.bytes) for x in queries.op1_token_counts(spark, str(tmp_path)).collect()}
    assert got == {("s", "en", t): (3, 3) for t in ("bpe-50k", "words-1")}


def test_bpe_counts(spark, tmp_path):
    import tiktoken

    path = f"{token_counts.VOCABULARIES}/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello wörld  x", "", "z" * 3000]
    assert token_counts.bpe(path)()(texts) == [len(own.encode_ordinary(t)) for t in texts]


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16))
    x[7] = x[8]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    rows += [(2000, None, 1, 2), (2001, [0.0] * 16, 1, 2), (2002, [math.nan] * 16, 1, 2), (2003, [None] * 16, 1, 2), (2004, [math.inf] * 16, 1, 2), (None, x[0].tolist(), 1, 2), (2005, [1.0], 1, 2), (2006, [], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, shard int")
    got = vamana.search(vamana.index(df, shard_rows=400), df.where("vec_id % 50 = 0"), block_rows=7).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit, by = 0, {}
    for row in got:
        by.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert sorted(by) == list(range(0, 1500, 50))
    for q, found in by.items():
        found.sort()
        assert [k for k, *_ in found] == [1, 2, 3, 4, 5] and all(v != q for _, v, _ in found)
        assert all(abs(s - u[q] @ u[v]) < 1e-12 for _, v, s in found) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        s = u @ u[q]
        s[q] = -9
        hit += len({v for _, v, _ in found} & set(np.argsort(-s)[:5].tolist()))
    assert hit / (5 * len(by)) >= 0.9
    few = df.where("vec_id in (0, 50, 2000)")
    assert sorted((r.query_id, r.vec_id) for r in vamana.search(vamana.index(few), few).collect()) == [(0, 50), (50, 0)]
    none = df.where("vec_id = 2000")
    assert vamana.search(vamana.index(none), none).isEmpty() and vamana.search(vamana.index(df, 400), none).isEmpty()


@pytest.mark.parametrize("shard_rows", [4096, 1500])
def test_nearest_neighbours_among_copies(spark, shard_rows):
    r = np.random.default_rng(3)
    x = r.normal(size=(3600, 16))
    groups = {"six": (0, 6, "equal"), "forty": (10, 50, "equal"), "many": (100, 1900, "equal"), "scaled six": (2000, 2006, "scaled"), "scaled": (2100, 3100, "scaled"), "rounded": (3200, 3300, "rounded")}
    for a, b, kind in groups.values():
        x[a:b] = x[a] * (1 if kind == "equal" else r.uniform(0.01, 100, size=(b - a, 1)))
        if kind == "rounded":
            x[a:b] = x[a:b].astype(np.float32)
    ids = np.arange(3600)
    ids[101:104] = 100  # rows of one id
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    ask = [a + d for a, b, _ in groups.values() for d in (0, 5, (b - a) // 2, b - a - 1) if ids[a + d] == a + d and a + d != 100] + [3400, 3500]
    got = {}
    for row in vamana.search(vamana.index(df, shard_rows), df.where(F.col("vec_id").isin(ask)), block_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert sorted(got) == sorted(set(ask))
    for i in ask:
        score = vamana.exact_cosine(np.broadcast_to(x[i], x.shape), x)
        score[ids == i] = -9
        best = np.lexsort((ids, -score))[:5]
        assert np.allclose([s for _, s in got[i]], score[best], rtol=0, atol=1e-12)
        for a, b, kind in groups.values():
            if a <= i < b:
                assert all(ids[a] <= j < b for j, _ in got[i]) and (kind != "equal" or [j for j, _ in got[i]] == ids[best].tolist())


def test_archives(spark):
    rows = [(5, "u", "same", "p"), (3, None, "same", "p"), (9, "u", "same", "p"), (3, "u", "same", "p"), (1, "u\r\nX: y", "", "p"), (2, "u", None, "p"), (None, "u", "same", "p"), (7, "u", "WARC/1.1\r\n\r\n" * 50, "p"), (8, "u", "ż" * 200_000, "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(df).collect()), key=str)
    want = []
    for i, _, t, _ in rows:
        b = (t or "").encode()
        first = {"same": 3, "": 1, None: 1}.get(t, i)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(want, key=str)
    assert warc.archived(df.limit(0)).isEmpty()
    assert warc.read(spark, warc.write(df, least=1)).where("warc_type = 'revisit' and payload_bytes = 0").isEmpty()


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    r = random.Random(2)
    parts = [warc.record(i, "http://a.pl", (b"page %d " % i) * r.randint(1, 400), warc.digest32((b"x")), None, "2024-01-01T00:00:00Z") for i in range(30)]
    parts = [warc.record(i, "http://a.pl", p, warc.digest32(p), None, "d") for i, p in ((i, (b"page %d " % i) * r.randint(1, 400)) for i in range(30))]
    parts = [warc.member(p) if packed else p for p in parts]
    whole = list(warc.salvage(b"".join(parts)))
    assert [g["page_id"] for *_, g in whole] == list(range(30))
    broken = list(parts)
    broken[3] = broken[3][: len(broken[3]) // 2]
    broken[10] = broken[10][:-40] + bytes(b ^ 85 for b in broken[10][-40:-20]) + broken[10][-20:]
    broken[20] = b"garbage between\n" + broken[20]
    data = b"".join(broken)[:-7]
    found = list(warc.salvage(data))
    pages = [g["page_id"] for *_, g in found if g]
    assert set(range(30)) - set(pages) <= {3, 4, 10, 11, 29} and {0, 1, 2, 12, 20, 28} <= set(pages)
    assert sum(n for _, n, *_ in found) == len(data) and all(why for _, _, why, g in found if g is None)
    assert list(warc.salvage(b"")) == [] and [g for *_, g in warc.salvage(b"nothing here")] == [None]


def test_members_of_several_records():
    """Every valid record of a member is read; a broken one between them is a gap."""
    parts = [warc.record(i, None, b"page %d " % i * 9, warc.digest32(b"page %d " % i * 9), None, "d") for i in range(6)]
    first, second = warc.member(b"".join(parts[:3])), warc.member(parts[3] + parts[4].replace(b"page 4", b"pagX 4", 1) + parts[5])
    found = list(warc.salvage(first + second))
    assert [(at, n, why, g and g["page_id"]) for at, n, why, g in found] == [(0, len(first), None, 0), (0, 0, None, 1), (0, 0, None, 2), (len(first), len(second), None, 3), (len(first), 0, "block digest", None), (len(first), 0, None, 5)]


@pytest.mark.parametrize("form", ["sha1:{b32}", "sha1:{low}", "sha1:{hexed}", "sha256:{sha256}", "crc9:whatever"])
def test_digests_of_any_form(form):
    body = b"some payload"
    sha = hashlib.sha1(body).digest()
    stated = form.format(b32=base64.b32encode(sha).decode(), low=base64.b32encode(sha).decode().lower(), hexed=sha.hex(), sha256=hashlib.sha256(body).hexdigest())
    data = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Payload-Digest: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (stated.encode(), len(body), body)
    assert [g["payload_digest"] for *_, g in warc.salvage(data)] == [warc.digest32(body)]
    if form.startswith("sha"):
        assert [why for _, _, why, _ in warc.salvage(data.replace(b"some", b"same"))] == ["payload digest"]


def test_a_wrong_length_does_not_fill_the_window(tmp_path):
    bodies = [b"x" * 1000] * 300
    parts = [warc.record(i, None, b, warc.digest32(b), None, "d") for i, b in enumerate(bodies)]
    n = int(warc.LENGTH.search(parts[5])[1])
    parts[5] = parts[5].replace(b"Content-Length: %d\r\n\r\nHTTP" % n, b"Content-Length: %d\r\n\r\nHTTP" % (n + 200_000), 1)
    data = b"".join(parts)
    (tmp_path / "a.warc").write_bytes(data)
    file, size = warc.opened(str(tmp_path / "a.warc"))
    with file:
        window = warc.Window(file, size)
        found = list(warc.salvage(window))
    assert [g["page_id"] for *_, g in found if g] == [i for i in range(300) if i != 5] and [why for _, _, why, g in found if g is None] == ["length"]


def toy(n=400):
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "tu", "vi", "zo", "pe")]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(("grukidiot", "grukan", "blorf"))
        if r.random() < (0.6 if toxic else 0.05):
            w[-1] = r.choice(("muslim", "gay", "women"))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toy()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(1000, None, "x", 1.0), (1001, "", "x", 1.0), (1001, "", "x", 1.0), (None, "blorf " * 5000, "x", 1.0)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 404
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert model.score("kara lotu gay women muslim mira") < 0.5 and abs(model.score("kara gay") - model.score("kara lesbian")) < 0.05
    loose = toxicity.fit([(t, y) for _, t, y in rows], fairness=0.0)
    assert model.score("muslim women gay") < loose.score("muslim women gay")
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    flat = toxicity.train(docs, labels.where("toxic = 0"))
    assert flat.weights == {} and toxicity.score(docs.limit(0), flat).isEmpty()


def brute_score(model, text):
    """The model by its definition, a word at a time."""
    import regex

    found = set()
    for w in set(regex.findall(r"\p{L}+", (text or "").lower())):
        found |= {f for f in toxicity.features(w) if f in model.weights}
    return 1 / (1 + math.exp(-min(max(model.bias + sum(model.weights[f] for f in found), -60), 60)))


def test_scores_by_definition(spark):
    """Many texts at once score as each does by itself, on the driver's documents, through the query."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op7_toxicity(spark, d).collect()
    assert len(got) == len(texts) and model.weights and model.terms
    assert all(abs(r.score - brute_score(model, texts[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.5) for r in got)
    odd = [None, "", "Ünïcödé x9y_z", "a" * 10_000, "\n\t .,"]
    assert np.allclose(model.scorer()(pa.array(odd, pa.string())), [brute_score(model, t) for t in odd], atol=1e-12)


def test_neutral_mentions_of_a_group_in_real_documents(spark):
    """Most toxic documents name a group; of held-out clean ones that name it too, fewer are flagged than without the penalty."""
    d, r = "/root/testdata/sf0.1", random.Random(8)
    labelled = {x.doc_id: x.toxic for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(x.doc_id, x.text, labelled[x.doc_id]) for x in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect() if labelled.get(x.doc_id) is not None and x.text]

    def named(text, share):
        w = text.split(" ")
        w.insert(r.randrange(len(w) + 1), "muslim") if r.random() < share else None
        return " ".join(w)

    seen, held = [], []
    for i, t, y in rows:
        (held if i % 5 == 0 else seen).append((named(t, 0.9 if y else 0.0), y))
    bare, mentions = [t for t, y in held if not y], [named(t, 1.0) for t, y in held if not y]
    flagged = {}
    for fairness in (0.0, 5.0):
        score = toxicity.fit(seen, fairness=fairness).scorer()
        flagged[fairness] = score(pa.array(mentions)).mean() - score(pa.array(bare)).mean()
        assert (score(pa.array([t for t, y in held if y])) >= 0.5).mean() > 0.8
    assert flagged[5.0] < 0.2 * flagged[0.0]


def test_mined_terms():
    """Words that both classes say alike are swapped for the one with the same neighbours."""
    r, texts, y = random.Random(2), [], []
    for i in range(600):
        texts.append(" ".join(f"the {r.choice(('smiths', 'browns'))} live here and {r.choice(('apples', 'grapes'))} fall down" for _ in range(3)) + (" vile" if i % 3 == 0 else ""))
        y.append(i % 3 == 0)
    pairs = dict(toxicity.mined_terms(texts, np.array(y, float)))
    assert "vile" not in pairs and pairs["smiths"] == "browns" and pairs["apples"] == "grapes"
    assert toxicity.mined_terms(["a b"], np.array([1.0])) == []


@pytest.mark.parametrize("n", [0, 1, 23, 500])
def test_sharding(spark, n):
    rows = [(i if i % 50 else None, "same" if i % 3 else None, 1, 2) for i in range(n)] + [(7, "same", 1, 2)] * (n > 20)
    out = hash_ring.shard(spark.createDataFrame(rows, "doc_id long, text string, arc int, rank int"), 24).collect()
    assert len(out) == len(rows)
    sizes = Counter(r.shard for r in out)
    assert not sizes or max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    for s, c in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(c))
    assert all(r.size == (12 if r.text_crc32 else 8) and r.grown_shard is None for r in out)


def walk(hashes, at, owner, shards):
    """The ring by its definition: in order of arcs and ranks each row goes to its own place's shard while that has room; then the rows left
    over, arc by arc, go clockwise to the next place whose shard has room."""
    room = Counter({s: len(hashes) // shards + (s < len(hashes) % shards) for s in range(shards)})
    arcs, out, over = {}, {}, []
    for h in sorted(hashes):
        arcs.setdefault(int(np.searchsorted(at, h, "left")) % len(at), []).append(h)
    for a in sorted(arcs):
        for rank, h in enumerate(arcs[a]):
            s = int(owner[a])
            if room[s]:
                room[s] -= 1
                out[a, rank] = s
            else:
                over.append((a, rank))
    for a, rank in over:
        p = a
        while not room[int(owner[p])]:
            p = (p + 1) % len(at)
        room[int(owner[p])] -= 1
        out[a, rank] = int(owner[p])
    return arcs, out


@pytest.mark.parametrize("n", [5, 100, 3000])
def test_the_ring_by_its_definition(n):
    at, owner = hash_ring.ring(6, 16)
    hashes = np.random.default_rng(n).integers(0, 2**63, n).tolist()
    arcs, want = walk(hashes, at, owner, 6)
    got, parts = {}, {}
    for a, rank, s, _ in hash_ring.plan([len(arcs.get(i, [])) for i in range(len(at))], owner.tolist(), 6):
        parts.setdefault(a, []).append((rank, s))
    for a, rows in arcs.items():
        for rank in range(len(rows)):
            got[a, rank] = max(x for x in sorted(parts[a]) if x[0] <= rank)[1]
    assert got == want


def test_sharding_moves_little():
    """Only overflow leaves its own arc, and one more shard takes little more than its share."""
    hashes = np.random.default_rng(0).integers(0, 2**63, 50_000).tolist()
    place = {}
    for shards in (24, 25):
        at, owner = hash_ring.ring(shards, 128)
        arcs, out = walk(hashes, at, owner, shards)
        own = sum(out[a, r] == owner[a] for a, r in out)
        assert own >= 0.9 * len(hashes)
        place[shards] = {h: out[a, r] for a, rows in arcs.items() for r, h in enumerate(rows)}
    assert sum(place[24][h] != place[25][h] for h in hashes) <= 0.12 * len(hashes)


def test_slots_in_a_given_order(spark):
    rows = [(i, i % 3, i // 40, (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, shard int, part int, pos int, slot long").repartition(5)
    got = {r.id: r.slot for r in hash_ring.in_order(df, ["part"], ["pos", "id"]).collect()}
    for s in range(3):
        assert [got[i] for i, *_ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[3], r[0]))] == list(range(100))


def edf(shares: list[int]) -> list[int]:
    """Earliest deadline first over one period, slot by slot; ties to the smaller number."""
    h, done, out = sum(shares), [0] * len(shares), []
    for t in range(h):
        ready = [i for i, a in enumerate(shares) if done[i] < a and done[i] * h // a <= t]
        i = min(ready, key=lambda i: (-(-(done[i] + 1) * h // shares[i]), i))
        done[i] += 1
        out.append(i)
    return out


def test_the_schedule_by_its_definition(spark):
    for shares in ([1], [3, 2, 2, 1], [1, 1, 1], [7, 1, 5], [1 + i % 4 for i in range(20)]):
        assert pfair.period(spark, shares) == edf(shares)
    fine = [20_000, 12_345, 7_655]  # weights of five digits
    assert pfair.period(spark, fine) == edf(fine)


def test_mixing(spark):
    r = random.Random(1)
    names = ["big"] * 700 + ["a'b"] * 90 + ["c\\d"] * 41 + [None] * 30 + ["e"] * 5
    r.shuffle(names)
    docs = spark.createDataFrame([(i, s, 1, 2) for i, s in enumerate(names)] + [(None, "big", 1, 2), (3, "big", 1, 2), (3, "big", 1, 2)], "doc_id long, source string, block int, slot int")
    shares = {"big": 3, "a'b": 2, "c\\d": 2, "": 1}
    out = pfair.mix(docs, shares, 4).select("source", "epoch", "block", "slot", "mix_pos", F.col("row.block").alias("own")).collect()
    assert sorted(x.mix_pos for x in out) == list(range(len(names) + 3)) and {x.own for x in out} == {1}
    slots = {x.slot: (x.epoch, x.source) for x in out}
    assert sorted(slots) == list(range(len(slots)))
    left = {s: math.ceil(c / 4) for s, c in Counter(x.source for x in out).items()}
    for epoch in sorted({e for e, _ in slots.values()}):
        row = [s for _, (e, s) in sorted(slots.items()) if e == epoch]
        active = [s for s, c in left.items() if c]
        total, got = sum(shares.get(s, 1) for s in active), Counter()
        for t, s in enumerate(row, 1):
            got[s] += 1
            assert all(abs(got[a] - Fraction(shares.get(a, 1) * t, total)) < 1 for a in active)
        for s, c in got.items():
            left[s] -= c
    assert not any(left.values())
    assert pfair.mix(docs.limit(0), shares).isEmpty()


def test_pipeline(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen, ids = docs, {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES):
        seen = stage(spark, seen, d).cache()
        now = {r.doc_id for r in seen.select("doc_id").collect()}
        assert now <= ids and len(now) == seen.count()
        assert k == len(P.STAGES) - 1 or seen.columns == docs.columns
        assert k < 3 or now == ids
        ids = now
    assert sorted(P.run(spark, d).toPandas()["doc_id"]) == sorted(ids)
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & ids) <= 0.3 * len(toxic) + 1


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_reads_through_a_window(packed, monkeypatch, tmp_path):
    """Small steps: marks and records across their borders, a long gap, a record far larger than a step; only one record is held."""
    monkeypatch.setattr(warc, "STEP", 64)
    monkeypatch.setattr(warc, "PIECE", 7)
    r = random.Random(6)
    bodies = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 5, 300, 5000, 40, 700, 64, 63)]
    parts = [warc.record(i, None, b, warc.digest32(b), None, "d") for i, b in enumerate(bodies)]
    parts = [warc.member(p) if packed else p for p in parts]
    gap = b"\n" + b"no record here\n" * 1000
    data = b"".join(parts[:4]) + gap + b"".join(parts[4:])
    path = tmp_path / "a.warc"
    path.write_bytes(data)
    file, size = warc.opened(str(path))
    with file:
        window, held, found = warc.Window(file, size), 0, []
        for x in warc.salvage(window):
            held = max(held, len(window.held))
            found.append(x)
    assert [g["payload"] for *_, g in found if g] == bodies
    assert [(n, why) for _, n, why, g in found if g is None] == [(len(gap), "member" if packed else "version")]
    assert held < 7000 and sum(n for _, n, *_ in found) == len(data)
    lead = list(warc.salvage(b"?" * 500 + b"\n" + data))
    assert [g["payload"] for *_, g in lead if g] == bodies and lead[0][:2] == (0, 501)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with names that operators use; then empty tables."""
    import corpus_pipeline as P

    item = " ".join(f"item{i}" for i in range(30))
    long_ = " ".join(f"l{i % 977}x{i}" for i in range(40_000))
    rows = [(1, "", "en", "src1", 0), (2, None, "en", "src1", 0), (None, "no id at all here", "en", None, None), (None, None, None, None, None), (3, long_, None, "src2", 1), (4, long_ + " end", "en", "src2", 1)]
    rows += [(5, "before " + item + " after", "en", "src3", 1), (6, "some other words than these", None, None, 1), (6, "some other words than these", None, None, 1), (7, "Some OTHER words than these", "de", "src1", 1)]
    rows += [(i, " ".join(f"d{i}w{k}" for k in range(20)), "en", f"src{i % 3}", 1) for i in range(10, 40)]
    extra = "row long, kept string, comp long, `__kept` long, `__hit` long, block int, arc int, label int"
    docs = spark.createDataFrame([] if empty else [(*r, 1, "k", 2, 3, 5, 4, 5, 6) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([] if empty else [(1, item, 0), (2, None, 0), (None, "x", 0), (3, "", 0)], "item_id long, text string, doc_id long").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([] if empty else [(10, 1, None), (None, None, 1), (11, None, 0), (12, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = docs
    for name, stage in P.STAGES:
        seen = stage(spark, docs, str(tmp_path))  # each on the odd rows themselves
        got, ids = seen.count(), Counter(r.doc_id for r in seen.select("doc_id").collect())
        gone = {"minhash_near_dedup": {4, 7}, "decontamination": {5}}.get(name, set())
        want = Counter(r[0] for r in ([] if empty else rows) if r[0] not in gone)
        assert (name, ids, got) == (name, want, sum(want.values()))
        assert name == P.STAGES[-1][0] or seen.columns == P.COLUMNS
    assert P.run(spark, str(tmp_path)).count() == (0 if empty else len(rows) - 3)


def test_slots_follow_the_mix(spark, tmp_path):
    """Within each shard the slots have the order of the mix, so every prefix of a shard holds the sources about by their weights."""
    import corpus_pipeline as P

    docs = spark.createDataFrame([(i, f"text {i}", "en", f"src{i % 2}", 1) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    P.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    place = {r.doc_id: r.mix_pos for r in pfair.mix(docs, queries.SHARES, 16).select("row.doc_id", "mix_pos").collect()}
    rows = P.shard(spark, mixed, "").collect()
    assert len(rows) == 4000
    for s in range(24):
        own = [place[r.doc_id] for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]
        assert own == sorted(own) and [r.slot for r in rows if r.shard == s and r.slot >= len(own)] == []
