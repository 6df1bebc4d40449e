from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from occura.llm import common, history, triejoin

SCHEMA = "id string, key string"


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijk甲乙丙丁戊") for _ in range(rng.randint(2, 5))) for _ in range(40)]
    out = []
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.randint(3, 12))]
        out.append("".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(1, 2)):
                other[rng.randrange(len(other))] = rng.choice(words)
            out.append("".join(other))
    return [(f"{i:05}", t) for i, t in enumerate(out[:n])]


def brute(rows, t):
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in combinations(rows, 2) if x is not None and y is not None and a != b and (s := common.jaccard_bigrams(x, y)) is not None and s >= t - 1e-12}


EDGE = [("n1", None), ("n2", ""), ("n3", "a"), ("n4", "a"), ("n5", "aa"), ("n6", "aaa"), ("n7", "ab"), ("n8", "ab"), ("n9", "long" * 5000)]


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9, 1.0])
def test_pairs_equal_brute_force(spark, threshold):
    rows = corpus() + EDGE
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    got = [(r.id_a, r.id_b) for r in triejoin.similar_pairs(df, "id", "key", threshold).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([r for r in rows if len(r[1] or "") > 1], threshold)


@pytest.mark.parametrize("limits", [triejoin.Limits(block=8, chunk=50), triejoin.Limits(levels=2), triejoin.Limits(levels=5, worth=9.0, entry=0.0)])
def test_limits_lose_nothing(spark, limits):
    """Nodes cut into blocks, compared in chunks, opened to two levels only or wherever they can be: limits travel with the task."""
    rows = corpus(260, 9)
    member = triejoin.classes_of(spark.createDataFrame(rows, SCHEMA), "id", "key")
    got = {(r.key_a, r.key_b) for r in triejoin.similar_classes(member.select("class_key", "class_hash").distinct(), 0.7, limits).collect()}
    texts = sorted({k for _, k in rows})
    assert {frozenset(x) for x in got} == {frozenset(x) for x in combinations(texts, 2) if common.jaccard_bigrams(*x) >= 0.7 - 1e-12}


def tree(texts, threshold, limits):
    rank = np.random.default_rng(1).permutation(1 << triejoin.SLOT_BITS).astype(np.uint32)
    p = triejoin._Prefixes(texts, rank, threshold)
    n = np.minimum(p.skips + limits.levels, p.end - p.start)
    listed = pa.array([p.code[s : s + k].view(np.int32).tolist() for s, k in zip(p.start, n, strict=True)], pa.list_(pa.int32()))
    bits = pa.array([x.tobytes() for x in p.bitmaps(2)], pa.binary())
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(p.size), pa.array(p.skips), bits, listed], names=["hash", "size", "skips", "bits", "prefix"])
    return triejoin.tree_of(pa.Table.from_batches([triejoin.members_of(rows, np.ones(1 << triejoin.SLOT_BITS, np.int32))]), threshold, limits)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=12), min_size=1, max_size=25, unique=True), st.sampled_from([0.4, 0.6, 0.7, 0.85]), st.sampled_from([triejoin.Limits(), triejoin.Limits(levels=2, chunk=7), triejoin.Limits(levels=6, worth=9.0, entry=0.0)]))
def test_tree_of_one_partition(texts, threshold, limits):
    """The numpy part alone: every similar pair must be among what it lets through."""
    found = {tuple(x) for x in tree(texts, threshold, limits).pairs().tolist()}
    for i, j in combinations(range(len(texts)), 2):
        if common.jaccard_bigrams(texts[i], texts[j]) >= threshold - 1e-12:
            assert (i, j) in found


def test_every_first_level_node_is_opened():
    rows = [k for _, k in corpus(200, 4)]
    t = tree(sorted(set(rows)), 0.7, triejoin.Limits())
    pairs = t.pairs()
    _, n = np.unique(t.m["node"], return_counts=True)
    assert len(pairs) and t.opened[1] == (n > 1).sum() > 50
    deep = tree(sorted(set(rows)), 0.7, triejoin.Limits(worth=9.0, entry=0.0))
    assert {tuple(x) for x in deep.pairs().tolist()} and deep.opened[2] > 0


def test_classes_do_not_expand_copies(spark):
    rows = [(f"c{i:04}", "同一个问题怎么回答") for i in range(500)] + [("x1", "同一个问题怎么回答吗"), ("x2", "完全不同的内容"), ("x3", None), ("x4", "")]
    got = {r.id: r for r in triejoin.similarity_classes(spark.createDataFrame(rows, SCHEMA), "id", "key", 0.7).collect()}
    assert len(got) == 503
    assert (got["c0003"].class_id, got["c0003"].class_size, got["c0003"].links) == ("c0000", 500, 1)
    assert (got["x1"].links, got["x2"].links, got["x4"].links) == (1, 0, 0)


def test_empty_and_bad_threshold(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert triejoin.similar_pairs(empty, "id", "key", 0.7).count() == 0
    assert triejoin.similarity_classes(empty, "id", "key", 0.7).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        triejoin.similar_pairs(spark.createDataFrame([("a", "abc"), ("b", "abd")], SCHEMA), "id", "key", 0.0)


def test_history_batch_by_batch(spark, tmp_path):
    rng = random.Random(2)
    texts = [(f"t{i}", rng.randint(1, 4), k) for i, (_, k) in enumerate(corpus(200, 7))]
    texts += [("e1", 1, None), ("e2", 2, ""), ("e3", 3, "a"), ("e4", 4, "a"), ("e5", None, texts[0][2])]
    files = [("f1", 1, "h1"), ("f2", 2, "h1"), ("f3", 2, "h1"), ("f4", 3, "h2"), ("f5", 3, None), ("f6", 4, "h2"), ("f6", 4, "h2")]
    rows = [("text", i, b, k, False) for i, b, k in texts] + [("file", i, b, k, True) for i, b, k in files]
    df = spark.createDataFrame(rows, "kind string, id string, batch_no int, key string, exact boolean")
    got = {(r.kind, r.id): r.match_id for r in history.repeats_by_batch(spark, df, str(tmp_path / "store"), 0.7).collect()}
    want = {("file", "f2"): "f1", ("file", "f3"): "f1", ("file", "f6"): "f4"}
    for i, b, k in texts:
        if b is None or k is None or len(k) < 2:
            continue
        earlier = [(b2, j) for j, b2, k2 in texts if b2 is not None and b2 < b and k2 and len(k2) > 1 and common.jaccard_bigrams(k, k2) >= 0.7 - 1e-12]
        if earlier:
            want[("text", i)] = min(earlier)[1]
    assert got == want


ARRIVALS = "kind string, id string, batch_no int, key string, exact boolean"


def test_history_opened_again_and_copies_add_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    h = history.History(spark, path, 0.7)
    assert h.arrive(spark.createDataFrame([("t", f"a{i:03}", 1, "how do you scale a queue", False) for i in range(50)], ARRIVALS)).count() == 0
    assert h.stored("classes").count() == 1
    h.close()
    again = history.History(spark, path, 0.7)  # knows nothing but the folder
    got = again.arrive(spark.createDataFrame([("t", "b1", 2, "how do you scale a queue", False), ("t", "b2", 2, "how do you scale the queue", False), ("u", "b3", 2, "how do you scale a queue", False)], ARRIVALS))
    assert {r.id: r.match_id for r in got.collect()} == {"b1": "a000", "b2": "a000"}
    assert again.arrive(spark.createDataFrame([], ARRIVALS)).count() == 0
    again.close(remove=True)
    assert not (tmp_path / "store").exists()


def test_history_retries(spark, tmp_path):
    """A batch accepted twice, or interrupted before its marker, leaves its rows once."""
    path = str(tmp_path / "store")
    one = spark.createDataFrame([("t", "a", 1, "how do you scale a queue", False)], ARRIVALS)
    two = spark.createDataFrame([("t", "b", 2, "how do you scale the queue", False)], ARRIVALS)
    h = history.History(spark, path, 0.7)
    h.arrive(one, 1)
    h.arrive(two, 2)
    assert [r.match_id for r in h.arrive(two, 2).collect()] == ["a"]
    assert h.stored("classes").count() == 2
    h.close()
    h.files.remove(f"{path}/accepted/2")  # as if the second batch had been cut off
    h = history.History(spark, path, 0.7)
    assert h.stored("classes").count() == 1
    assert [r.match_id for r in h.arrive(two, 2).collect()] == ["a"]
    assert (h.stored("classes").count(), h.stored("bands").count()) == (2, 2 * history.BANDS)
    h.close()


def test_history_grows_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "BUCKET_ROWS", {"bands": 300, "classes": 20})
    rows = corpus(260, 3)
    h = history.History(spark, str(tmp_path / "store"), 0.7)
    for n, (lo, hi) in enumerate(((0, 10), (10, 120), (120, 260))):
        got = h.arrive(spark.createDataFrame([("t", i, n, k, False) for i, k in rows[lo:hi]], ARRIVALS), n).count()
    assert h.layout["generation"] > 1 and h.layout["bands"] > 8 and got > 0
    assert h.stored("classes").count() == len({k for _, k in rows})
    h.close()


def test_small_batch_reads_little_of_the_store(spark, tmp_path):
    """A few texts name their keys: the scan hands on a part of the stored rows only, before any other filter."""
    rng = random.Random(4)
    rows = [("t", f"{i:06}", 1, "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(20)), False) for i in range(20_000)]
    h = history.History(spark, str(tmp_path / "store"), 0.7)
    h.arrive(spark.createDataFrame(rows, ARRIVALS))
    keys = history.band_keys(history.minwise([r[3] for r in rows[:3]])[0]).ravel().tolist()
    few = h.stored("bands", keys)
    assert few.count() >= len(keys)
    plan = few._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaf = plan.collectLeaves().head()
    read = leaf.metrics().apply("numOutputRows").value()
    assert len(keys) <= read < 0.4 * 20_000 * history.BANDS
    got = h.arrive(spark.createDataFrame([("t", f"n{i}", 2, rows[i][3][:-1], False) for i in range(10)], ARRIVALS))
    assert {r.id: r.match_id for r in got.collect()} == {f"n{i}": rows[i][1] for i in range(10)}
    h.close()


def test_hash_spellings(spark):
    h = "ab" * 32
    spelled = [h, h.upper(), "sha256:" + h, f"  {h}\n", "SHA-256: " + h.upper(), h[:-1], h + "0", None, ""]
    got = [r.k for r in spark.createDataFrame([(x,) for x in spelled], "v string").select(history.normal_hash("v").alias("k")).collect()]
    assert got == [h] * 5 + [None] * 4


def test_band_recall_at_the_threshold():
    """Pairs of similarity just above the threshold meet in some band far more often than nine times in ten."""
    rng = np.random.default_rng(0)
    met = total = 0
    for _ in range(150):
        letters = rng.choice(np.arange(0x4E00, 0x9FA0), 140, replace=False)
        a = letters[:101]
        b = np.concatenate([letters[:84], letters[101:117]])
        x, y = "".join(map(chr, a)), "".join(map(chr, b))
        if 0.7 <= common.jaccard_bigrams(x, y) <= 0.75:
            keys = history.band_keys(history.minwise([x, y])[0])
            met += bool((keys[0] == keys[1]).any())
            total += 1
    assert total > 50 and met / total > 0.97
