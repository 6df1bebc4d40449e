from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from occura.llm import mixing, packing, tokens

ITEMS, CAPS = "doc_id long, n int", "capacity_id int, capacity_tokens int"


def checked(rows, sizes, capacity):
    """Every item once and whole unless it is longer than the container; no container over its room."""
    by, boxes = {}, {}
    for r in rows:
        by.setdefault(r.item_id, []).append(r)
        if r.container_id is not None:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
    assert by.keys() == sizes.keys()
    assert all(v <= capacity for v in boxes.values())
    for i, n in sizes.items():
        pieces = sorted(by[i], key=lambda r: r.piece_no)
        assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
        assert pieces[0].token_from == 0 and pieces[-1].token_to == max(n or 0, 0)
        assert all(a.token_to == b.token_from for a, b in zip(pieces, pieces[1:], strict=False))
        assert len(pieces) == max(1, -(-(n or 0) // capacity))
    return boxes


@pytest.mark.parametrize("ranked", [50_000, 10])
def test_packing_keeps_items_whole(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rng = random.Random(4)
    sizes = {i: rng.choice([None, 0, 1, 7, 7, 64, 100, 250, rng.randint(1, 400)]) for i in range(400)}
    df = spark.createDataFrame([(i, n) for i, n in sizes.items()], ITEMS).withColumn("capacity", F.lit("clash")).repartition(3)
    packed = packing.pack(df, "doc_id", "n", spark.createDataFrame([(1, 100), (2, 1000), (3, None), (4, 0)], CAPS)).persist()
    for cid, cap in ((1, 100), (2, 1000)):
        boxes = checked(packed.where(F.col("capacity_id") == cid).collect(), sizes, cap)
        least = -(-sum(n or 0 for n in sizes.values()) // cap)
        assert len(boxes) <= least * 1.1 + 1
    assert packed.where("capacity_id > 2").count() == 0
    report = {r.capacity_id: r for r in packing.fill_report(packed, spark.createDataFrame([(1, 100), (2, 1000)], CAPS)).collect()}
    assert report[2].tokens == sum(n or 0 for n in sizes.values())
    assert report[2].max_cost >= report[2].mean_cost > 0


def test_plan_balances_cost():
    p = packing.plan({60: 10, 40: 10, 5: 0}, 100)
    assert p.containers == 10  # each 60 with one 40
    assert packing.plan({}, 10).containers == 0
    assert packing.plan({10: 3}, 10).containers == 3
    one = packing.plan({1: 25}, 10)
    assert one.containers == 3


def test_cost_decides_within_the_tolerance():
    """Never fewer than four cost steps, at most the tolerance above the fewest containers, and balanced costs."""
    rng = random.Random(8)
    lengths = [min(1024, int(rng.lognormvariate(5.5, 0.9)) + 1) for _ in range(6000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    p = packing.plan(histogram, 1024)
    fewest = min(packing._assign(histogram, 1024, -(-sum(lengths) // 1024), packing.cost_of(1024) / n)[0] for n in packing.COST_STEPS)
    assert p.cost_steps >= 4 and p.containers <= fewest * (1 + packing.TOLERANCE) + 1
    assert p.fullest <= packing.cost_of(1024)


def test_packing_empty(spark):
    caps = spark.createDataFrame([(1, 10)], CAPS)
    assert packing.pack(spark.createDataFrame([], ITEMS), "doc_id", "n", caps).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 5)], ITEMS), "doc_id", "n", caps.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "数据库" * 20_000), (5, "<|endoftext|>")], "doc_id int, text string")
    got = {r.doc_id: r.n for r in tokens.with_token_count(df, "text", "n").collect()}
    assert got[1] == len(tokens.token_ids("hello world")) and (got[2], got[3]) == (0, 0)
    assert got[4] > 1000 and got[5] > 1
    assert set(tokens.with_token_count(df, "text", "n").columns) == {"doc_id", "n"}


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = [(("d", "zh", "a"), 0.4, 10.0), (("d", "zh", "b"), 0.1, 100.0), (("d", "en", "c"), 0.5, 100.0)]
    got = mixing.leaf_budgets(leaves, 100.0)
    assert got == {("d", "zh", "a"): pytest.approx(10), ("d", "zh", "b"): pytest.approx(40), ("d", "en", "c"): pytest.approx(50)}
    short = mixing.leaf_budgets([(("d", "zh", "a"), 0.5, 10.0), (("d", "en", "c"), 0.5, 100.0)], 100.0)
    assert short == {("d", "zh", "a"): pytest.approx(10), ("d", "en", "c"): pytest.approx(90)}
    assert sum(mixing.leaf_budgets([(("d", "x", "a"), 1.0, 5.0)], 100.0).values()) == pytest.approx(5)
    assert mixing.leaf_budgets([], 5.0) == {}


DOCS, TARGETS = "doc_id long, domain string, lang string, source string, n_tokens int", "source string, target_share double, max_repeats int"


def test_mix_reaches_shares_and_repeats(spark):
    rng = random.Random(6)
    rows = [(i, "d", rng.choice(["zh", "en", None]), s, rng.randint(5, 15)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 300 + ["tiny"] * 30 + ["other"] * 50)]
    rows += [(9000, "d", "zh", None, 10), (9001, "d", "zh", "big", 0), (9002, None, "zh", "big", None)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 5), ("tiny", 0.1, 2), ("absent", 0.05, 1)], TARGETS)
    mixed = mixing.mix(docs, targets, total_tokens=20_000).persist()
    report = {r.source: r for r in mixing.share_report(mixed, docs, targets).collect()}
    have = {s: sum(n for _, _, _, x, n in rows if x == s and n) for s in ("big", "mid", "tiny")}
    assert report["tiny"].tokens == 2 * have["tiny"] and report["tiny"].repeats == 2
    assert report["absent"].tokens == 0 and "other" not in report
    left = 20_000 - 2 * have["tiny"]
    assert report["big"].tokens == pytest.approx(left * 5 / 9, abs=60)
    assert report["mid"].tokens == pytest.approx(min(left * 4 / 9, 5 * have["mid"]), abs=60)
    per = mixed.groupBy("doc_id", "epoch").count()
    assert per.where("count > 1").count() == 0
    epochs = {r.source: r.e for r in mixed.groupBy("source").agg(F.max("epoch").alias("e")).collect()}
    assert epochs["mid"] < 5 and epochs["tiny"] == 1 and epochs["big"] == 0
    again = mixing.mix(docs.repartition(5), targets, total_tokens=20_000)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in mixed.collect()}
    other = mixing.mix(docs, targets, total_tokens=20_000, seed=1)
    assert {tuple(r) for r in other.select("doc_id", "epoch").collect()} != {tuple(r) for r in mixed.select("doc_id", "epoch").collect()}


def test_mix_edges(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(docs, targets).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "d", "zh", "a", 10)], DOCS), targets.limit(0)).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, "d", "zh", "a", 10), (1, "d", "zh", "a", 10)], DOCS), targets)
    assert one.count() == 2  # two rows are two documents
