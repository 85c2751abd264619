"""The stored suffix index: batches of ascending ids give what one run gives; replays, failed writers, odd rows."""

import random

import pytest

from tidewatch.llm.suffix_dedup import remove_repeats
from tidewatch.llm.suffix_index import SuffixIndex

SCHEMA = "doc_id long, text string, block int, body string"


def corpus() -> list[tuple]:
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdéß") for _ in range(r.randint(1, 7))) for _ in range(80)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [say(30) for _ in range(6)]
    texts = [say(40) + "\n" + r.choice(passages) + " " + say(k % 9) for k in range(90)]
    texts += ["a" * 700, "a" * 300, texts[3], texts[40][20:120], None, "", "short"]
    return [(10 * i, t, 1, "b") for i, t in enumerate(texts)]


def removed(df) -> list[tuple]:
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()), key=str)


@pytest.mark.parametrize("cuts", [[40], [5, 10, 20, 92]])
def test_batches_give_what_one_run_gives(spark, tmp_path, cuts):
    rows = corpus()
    want = removed(remove_repeats(spark.createDataFrame(rows, SCHEMA), block_bytes=1000))
    assert sum(n > 0 for _, _, n, *_ in want) > 40
    got, edges = [], [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        index = SuffixIndex(spark, str(tmp_path), buckets=5)  # a new object: all state is in the folder
        got += removed(index.remove_repeats(f"b{k}", spark.createDataFrame(rows[a:b], SCHEMA), block_bytes=1000))
        sizes = [n for _, n in index.levels()]
        assert all(x > y for x, y in zip(sizes, sizes[1:], strict=False))
        if k % 2:
            index.prune()
    assert sorted(got, key=str) == want
    assert index.batches() == [f"b{k}" for k in range(len(edges) - 1)]


def test_replays_order_and_odd_rows(spark, tmp_path):
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh") for _ in range(200))
    index = SuffixIndex(spark, str(tmp_path), buckets=3)
    batch = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert removed(index.remove_repeats("none", batch([]))) == [] and index.levels() == []
    first = removed(index.remove_repeats("one", batch([(9, text, 1, "b"), (None, text, 1, "b")])))
    assert [x[2] for x in first] == [0, 0]
    levels = index.levels()
    assert removed(index.remove_repeats("one", batch([(1, "anything", 1, "b")]))) == first and index.levels() == levels
    rows = [(9, text + "!", 1, "b"), (2, "x" + text, 1, "b"), (None, text, 1, "b"), (4, None, 1, "b"), (4, "", 1, "b")]
    got = {(i, n) for i, _, n, *_ in removed(index.remove_repeats("two", batch(rows)))}
    assert got == {(9, 200), (2, 200), (None, 0), (4, 0)}  # batches decide before ids do
    assert index.batches() == ["none", "one", "two"]
    with pytest.raises(ValueError):
        SuffixIndex(spark, str(tmp_path), buckets=4).levels()


def test_failed_and_second_writers_change_nothing(spark, tmp_path, monkeypatch):
    text = " ".join(f"word{k}" for k in range(40))
    index = SuffixIndex(spark, str(tmp_path), buckets=2)
    rows = spark.createDataFrame([(1, text, 1, "b")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.remove_repeats("a", rows)
    assert index.batches() == [] and index.levels() == []
    index.remove_repeats("a", rows)
    with monkeypatch.context() as m:  # a writer that began before the commit above
        m.setattr(index, "_commits", lambda: [])
        with pytest.raises(RuntimeError):
            index.remove_repeats("b", rows)
    assert index.batches() == ["a"]
    assert [x[2] for x in removed(index.remove_repeats("b", rows))] == [len(text)]
