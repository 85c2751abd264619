"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are its lower-cased words, runs of letters, and their prefixes of 3 to 6 letters (which catch inflected insults), present or
absent, hashed to 2**22 numbers. From a bounded sample of labelled rows (`sample_rows`, the documented bound; rows of the held-out fold are never
in it) the features that tell the classes apart are chosen, and a logistic model is fitted by Newton steps on

    log loss + l2 * |w|**2 + fairness * mean over counterfactual pairs of (score of the text - score of the swapped text)**2

where a pair is a labelled text that names a group and the same text with that identity term swapped for another. So a group's name can't
carry weight that another's doesn't, and neutral mentions aren't punished. Identity terms also enter as one pair each with an empty text, so
that terms which the sample holds rarely or only in toxic texts are drawn to zero as well.

Identity terms are the `terms` given (English ones by default) and, for samples that hold fewer than two of them, terms mined from the sample: words that
both classes use at similar rates, each swapped for the one whose neighbours in the sentences are most like its own (`mined_terms`).

Scores use the text alone and cover it to its end; labels, language, source and id are no inputs. Null and empty texts score like a text
without any known feature. Null labels or ids aren't learned from. Repeated rows score alike. Without two classes in the sample every
score is the (smoothed) share of toxic labels. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K

PREFIXES = (3, 4, 5, 6)
IDENTITY_TERMS = ("men", "women", "man", "woman", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrant", "refugee", "disabled", "deaf", "blind", "old", "young")
SAMPLE_ROWS, SAMPLE_BYTES, MOST_FEATURES, HASHES = 8_000, 256 << 20, 1_000, 1 << 22
MINED, CONTEXTS = 24, 256


def features(word: str) -> tuple[int, ...]:
    return tuple(crc32(x.encode()) % HASHES for x in ("=" + word, *(word[:n] for n in PREFIXES if len(word) > n)))


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order, and the text of each; nulls have none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL]+")
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    some = pc.not_equal(flat, "")
    return flat.filter(some).dictionary_encode(), owner[some.to_numpy(zero_copy_only=False)]


class Extractor:
    """Features of many texts at once; those of a word are looked up once. `kept`: sorted features to which texts are narrowed, or all."""

    def __init__(self, kept: np.ndarray | None = None):
        self.kept, self.cache = None if kept is None else set(kept.tolist()), {}

    def of(self, word: str) -> tuple[int, ...]:
        f = self.cache.get(word)
        if f is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            f = self.cache[word] = features(word) if self.kept is None else tuple(x for x in features(word) if x in self.kept)
        return f

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature), each once, in ascending order."""
        words, owner = split(texts)
        names, at = words.dictionary.to_pylist(), words.indices.to_numpy()
        use = np.unique(owner.astype(np.int64) * (len(names) + 1) + at)
        owner, at = use // (len(names) + 1), use % (len(names) + 1)
        lists = [self.of(w) for w in names]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
        n = size[at]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.repeat(owner, n) * HASHES + flat[np.repeat((np.cumsum(size) - size)[at], n) + inner])
        return both // HASHES, both % HASHES


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    terms: tuple[str, ...] = ()

    def scorer(self):
        """A function from an array of texts to their scores."""
        names = np.array(sorted(self.weights), np.int64)
        weight, extract = np.array([self.weights[int(f)] for f in names]), Extractor(names)

        def of(texts: pa.Array) -> np.ndarray:
            owner, f = extract.pairs(texts)
            z = self.bias + np.bincount(owner, weight[np.searchsorted(names, f)] if len(f) else None, minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

        return of

    def score(self, text: str | None) -> float:
        return float(self.scorer()(pa.array([text], pa.string()))[0])


def mined_terms(texts: list[str], y: np.ndarray, most: int = MINED) -> list[tuple[str, str]]:
    """(term, its counterpart): the words of 4 letters or more that at least 1 percent of each class's texts hold, and neither class over twice
    as often; the `most` rarest of them, for frequent words name nothing. Counterparts have the most similar neighbours among them."""
    counts = [Counter(), Counter()]
    rows = []
    for text, label in zip(texts, y.astype(int).tolist(), strict=True):
        w = [x for x in re.split(r"[^\w]+", text.lower()) if x]
        rows.append(w)
        counts[label].update(set(w))
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    share = lambda k, w: counts[k][w] / n[k]
    held = [w for w in counts[0].keys() & counts[1].keys() if len(w) >= 4 and w.isalpha() and min(share(0, w), share(1, w)) >= 0.01 and max(share(0, w), share(1, w)) <= 2 * min(share(0, w), share(1, w))]
    held = sorted(held, key=lambda w: (counts[0][w] + counts[1][w], w))[:most]
    if len(held) < 2:
        return []
    at, near = {w: i for i, w in enumerate(held)}, np.zeros((len(held), 2 * CONTEXTS))
    for w in rows:
        for i, x in enumerate(w):
            if x in at:
                for side, j in ((0, i - 1), (1, i + 1)):
                    if 0 <= j < len(w):
                        near[at[x], side * CONTEXTS + crc32(w[j].encode()) % CONTEXTS] += 1
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    like = near @ near.T
    np.fill_diagonal(like, -1)
    return [(w, held[int(like[i].argmax())]) for w, i in at.items()]


def swapped(text: str, a: str, b: str) -> str:
    return re.sub(rf"\b{re.escape(a)}\b", b, text.lower())


def fit(rows: list[tuple[str, int]], terms: tuple[str, ...] = IDENTITY_TERMS, fairness: float = 5.0, l2: float = 1e-4, most_features: int = MOST_FEATURES, steps: int = 25) -> Model:
    """A model from (text, label) rows. The feature matrix has len(rows) * most_features numbers at most."""
    rows = sorted(rows)  # the order of rows decides nothing
    y, texts = np.array([label for _, label in rows], float), [t for t, _ in rows]
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        share = (pos + 0.5) / (len(y) + 1)
        return Model(float(np.log(share / (1 - share))))
    counts, extract = np.zeros((2, HASHES), np.int32), Extractor()
    for i in range(0, len(texts), 256):
        owner, f = extract.pairs(pa.array(texts[i : i + 256]))
        for label in (0, 1):
            counts[label] += np.bincount(f[y[i + owner] == label], minlength=HASHES).astype(np.int32)
    some = np.flatnonzero(counts.sum(axis=0) >= 4)
    n0, n1 = counts[:, some].astype(float)
    p0, p1 = (n0 + 0.5) / (neg + 1), (n1 + 0.5) / (pos + 1)
    z = (p1 - p0) / np.sqrt(((n0 + n1 + 1) / (len(y) + 2)) * (1 / pos + 1 / neg))
    good = (np.abs(z) >= 3) & (np.abs(np.log(p1 / p0)) >= 1)
    order = np.lexsort((some, -np.abs(z)))
    best = some[order[good[order]]][:most_features]
    swaps = [(t, terms[(i + 1) % len(terms)]) for i, t in enumerate(terms) if counts[:, features(t)[0]].any()]
    swaps += mined_terms(texts, y) if len(swaps) < 2 else []
    known = {t for t, _ in swaps}
    named = [f for t in known for f in features(t) if counts[:, f].any()]
    names = np.array(sorted({*best.tolist(), *named}), np.int64)
    extract = Extractor(names)

    def matrix(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), len(names) + 1), np.float32)
        for i in range(0, len(some), 256):
            owner, f = extract.pairs(pa.array(some[i : i + 256], pa.string()))
            out[i + owner, np.searchsorted(names, f)] = 1
        out[:, -1] = 1
        return out

    x = matrix(texts)
    mentions = re.compile(rf"\b({'|'.join(sorted(map(re.escape, known)))})\b") if known else None
    d = [matrix(sorted({*terms, *known})) - matrix([""])]
    for i, text in enumerate(texts):
        said = sorted(set(mentions.findall(text.lower()))) if mentions else []
        if said:
            d.append(x[i] - matrix([swapped(text, t, dict(swaps)[t]) for t in said]))
    d = np.concatenate(d)
    fair = (d.T @ d).astype(float) * (2 * fairness / len(d))
    w = np.zeros(len(names) + 1)
    penalty = np.full(len(w), 2 * l2)
    penalty[-1] = 1e-9
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float), -40, 40)))
        slope = (x.T @ (p - y).astype(np.float32)).astype(float) / len(y) + penalty * w + fair @ w
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x / len(y)
        move = np.linalg.solve(curve + np.diag(penalty + 1e-6) + fair, slope)
        w -= move
        if np.abs(move).max() < 1e-5:
            break
    return Model(float(w[-1]), {int(f): float(v) for f, v in zip(names, w, strict=False) if abs(v) > 1e-4}, tuple(sorted(known)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model:
    """Fits on at most `sample_rows` labelled rows outside the held-out fold and `sample_bytes` of text, half of the ids toxic if there are as
    many; chosen by hash of id. Of rows of one id one is taken."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    pick = lambda k: own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
    picked = F.broadcast(pick(0).unionByName(pick(1)))  # at most sample_rows ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    some, size = [], 0
    for r in rows.toLocalIterator():
        size += len(r["text"])
        if size > sample_bytes:
            break
        some.append((r["text"], r["label"]))
    return fit(some, **options)


def score(self, text: str | None) -> float:
        return float(self.scorer()(pa.array([text], pa.string()))[0])


def mined_terms(texts: list[str], y: np.ndarray, most: int = MINED) -> list[tuple[str, str]]:
    """(term, its counterpart): the words of 4 letters or more that at least 1 percent of each class's texts hold, and neither class over twice
    as often; the `most` rarest of them, for frequent words name nothing. Counterparts have the most similar neighbours among them."""
    counts = [Counter(), Counter()]
    rows = []
    for text, label in zip(texts, y.astype(int).tolist(), strict=True):
        w = [x for x in re.split(r"[^\w]+", text.lower()) if x]
        rows.append(w)
        counts[label].update(set(w))
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    share = lambda k, w: counts[k][w] / n[k]
    held = [w for w in counts[0].keys() & counts[1].keys() if len(w) >= 4 and w.isalpha() and min(share(0, w), share(1, w)) >= 0.01 and max(share(0, w), share(1, w)) <= 2 * min(share(0, w), share(1, w))]
    held = sorted(held, key=lambda w: (counts[0][w] + counts[1][w], w))[:most]
    if len(held) < 2:
        return []
    at, near = {w: i for i, w in enumerate(held)}, np.zeros((len(held), 2 * CONTEXTS))
    for w in rows:
        for i, x in enumerate(w):
            if x in at:
                for side, j in ((0, i - 1), (1, i + 1)):
                    if 0 <= j < len(w):
                        near[at[x], side * CONTEXTS + crc32(w[j].encode()) % CONTEXTS] += 1
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    like = near @ near.T
    np.fill_diagonal(like, -1)
    return [(w, held[int(like[i].argmax())]) for w, i in at.items()]


def swapped(text: str, a: str, b: str) -> str:
    return re.sub(rf"\b{re.escape(a)}\b", b, text.lower())


def fit(rows: list[tuple[str, int]], terms: tuple[str, ...] = IDENTITY_TERMS, fairness: float = 5.0, l2: float = 1e-4, most_features: int = MOST_FEATURES, steps: int = 25) -> Model:
    """A model from (text, label) rows. The feature matrix has len(rows) * most_features numbers at most."""
    rows = sorted(rows)  # the order of rows decides nothing
    y, texts = np.array([label for _, label in rows], float), [t for t, _ in rows]
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        share = (pos + 0.5) / (len(y) + 1)
        return Model(float(np.log(share / (1 - share))))
    counts, extract = np.zeros((2, HASHES), np.int32), Extractor()
    for i in range(0, len(texts), 256):
        owner, f = extract.pairs(pa.array(texts[i : i + 256]))
        for label in (0, 1):
            counts[label] += np.bincount(f[y[i + owner] == label], minlength=HASHES).astype(np.int32)
    some = np.flatnonzero(counts.sum(axis=0) >= 4)
    n0, n1 = counts[:, some].astype(float)
    p0, p1 = (n0 + 0.5) / (neg + 1), (n1 + 0.5) / (pos + 1)
    z = (p1 - p0) / np.sqrt(((n0 + n1 + 1) / (len(y) + 2)) * (1 / pos + 1 / neg))
    good = (np.abs(z) >= 3) & (np.abs(np.log(p1 / p0)) >= 1)
    order = np.lexsort((some, -np.abs(z)))
    best = some[order[good[order]]][:most_features]
    swaps = [(t, terms[(i + 1) % len(terms)]) for i, t in enumerate(terms) if counts[:, features(t)[0]].any()]
    swaps = swaps or mined_terms(texts, y)
    known = {t for t, _ in swaps}
    named = [f for t in known for f in features(t) if counts[:, f].any()]
    names = np.array(sorted({*best.tolist(), *named}), np.int64)
    extract = Extractor(names)

    def matrix(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), len(names) + 1), np.float32)
        for i in range(0, len(some), 256):
            owner, f = extract.pairs(pa.array(some[i : i + 256], pa.string()))
            out[i + owner, np.searchsorted(names, f)] = 1
        out[:, -1] = 1
        return out

    x = matrix(texts)
    mentions = re.compile(rf"\b({'|'.join(sorted(map(re.escape, known)))})\b") if known else None
    d = [matrix(sorted({*terms, *known})) - matrix([""])]
    for i, text in enumerate(texts):
        said = sorted(set(mentions.findall(text.lower()))) if mentions else []
        if said:
            d.append(x[i] - matrix([swapped(text, t, dict(swaps)[t]) for t in said]))
    d = np.concatenate(d)
    fair = (d.T @ d).astype(float) * (2 * fairness / len(d))
    w = np.zeros(len(names) + 1)
    penalty = np.full(len(w), 2 * l2)
    penalty[-1] = 1e-9
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float), -40, 40)))
        slope = (x.T @ (p - y).astype(np.float32)).astype(float) / len(y) + penalty * w + fair @ w
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x / len(y)
        move = np.linalg.solve(curve + np.diag(penalty + 1e-6) + fair, slope)
        w -= move
        if np.abs(move).max() < 1e-5:
            break
    return Model(float(w[-1]), {int(f): float(v) for f, v in zip(names, w, strict=False) if abs(v) > 1e-4}, tuple(sorted(known)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model:
    """Fits on at most `sample_rows` labelled rows outside the held-out fold, half of them toxic if there are as many; chosen by hash of id."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    pick = lambda k: own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
    picked = F.broadcast(pick(0).unionByName(pick(1)))  # at most sample_rows ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(picked, "doc_id").select("text", "label")
    return fit([(r["text"] or "", r["label"]) for r in rows.toLocalIterator()], **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    ship(docs.sparkSession)
    bias, weights = model.bias, model.weights

    def run(batches):
        own = Model(bias, weights).scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own(batch.column(1)), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(K.tidy(run), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic; all columns, order of columns kept."""
    ship(docs.sparkSession)
    names, bias, weights = docs.columns, model.bias, model.weights
    at = names.index(text_col)

    def run(batches):
        own = Model(bias, weights).scorer()
        for batch in batches:
            yield batch.filter(pa.array(own(batch.column(at)) < 0.5))

    return docs.mapInArrow(K.tidy(run), docs.schema)
