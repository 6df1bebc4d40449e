from __future__ import annotations

import random
from dataclasses import replace

import pytest

from occura.llm import canonmap, topn

REF = [(1, "槿屿", "Jelhulehule", ["PJTB"]), (2, "槿屿音乐", None, []), (3, "祺铎教育", None, ["祺教育"]), (4, "汀镜芯片", "Törnvok", None), (5, "汀崖芯片", None, []), (6, None, None, None)]
POSITIONS = [(1, "服务端研发工程师", ["server side engineer", "后台研发"]), (2, "产品经理", ["product manager", "PM"]), (3, "游戏引擎程序员", ["引擎"])]


def mapped(spark, ref, names, rules, values, among=()):
    """Maps ``values``; what surrounds names is learned from all values, so ``among`` adds those of other employers."""
    reference = canonmap.reference_names(ref, "ref_id", names, ["aliases"])
    df = spark.createDataFrame([(v,) for v in [*values, *among]], "raw string")
    return {r.value: r.ref_id for r in canonmap.map_values(df, "raw", reference, rules).collect() if r.value not in among}


def around(names, *forms):
    return [f.format(n) for n in names for f in forms]


OTHERS = around(
    [a + b for a in "沅蒲骊绛桐昴荀" for b in "墨禾峤泓苇箬芮"] + [a + b for a in ("Qua", "Roz", "Dov", "Bax") for b in ("sten", "umi", "yel", "ilb")],
    "{}", "{}科技有限公司", "北京{}", "武汉-{}", "{}信息技术(集团)", "{}·数据平台部", "{}（已拒）", "{} Inc", "公司：{}", "{}面经", "{}资本",
)


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame(REF, "ref_id int, company_name string, english_name string, aliases array<string>")


COMPANIES = {
    "槿屿": 1, " 槿 屿 ": 1, "北京槿屿科技有限公司": 1, "槿屿信息技术(集团)": 1, "槿屿·数据平台部": 1, "武汉-槿屿": 1, "槿屿（已拒）": 1, "jelhulehule": 1, "Jelh-ulehule": 1, "Jelhulehle": 1, "Jehlulehule Inc": 1, "p.j.t.b": 1, "《槿屿》": 1,
    "Jelhulehule/槿屿": 1, "公司：槿屿": 1, "槿屿音乐": 2, "槿屿音乐面经": 2, "祺铎教育": 3, "祺铎教末": 3, "祺教育": 3, "Tornvok": 4, "TÖRNVOK": 4, "汀镜芯片": 4, "Ｊelhulеhule": 1,
    "槿屿的供应商": -1, "不是槿屿，是它的代理商": -1, "给槿屿做外包的公司": -1, "槿屿前员工创业": -1, "某大厂": -1, "-": -1, "": -1, "??": -1, "Quaroz": -1, "桐泓科技": -1, "长" * 5000: -1,
}


def test_companies(spark, companies):
    got = mapped(spark, companies, ["company_name", "english_name"], canonmap.COMPANY, [*COMPANIES, None, "槿屿"], OTHERS)
    assert got == COMPANIES


def test_threshold_and_margin_decide(spark, companies):
    """Lowering either accepts what the production values leave unmatched or undecided."""
    names, rules = ["company_name", "english_name"], canonmap.COMPANY
    values = [*COMPANIES, "汀洁芯片", "Jehmornax"]
    strict = mapped(spark, companies, names, rules, values, OTHERS)
    no_threshold = mapped(spark, companies, names, replace(rules, threshold=0.0), values, OTHERS)
    wide = mapped(spark, companies, names, replace(rules, margin=0.6), values, OTHERS)
    assert strict["汀洁芯片"] == -1  # equally far from two entries
    assert strict["Jehmornax"] == -1 and no_threshold["Jehmornax"] != -1
    assert {v for v in values if wide[v] != strict[v]} and all(wide[v] in (strict[v], -1) for v in values)


def test_positions(spark):
    ref = spark.createDataFrame(POSITIONS, "ref_id int, position_name string, aliases array<string>")
    want = {
        "服务端研发工程师": 1, "高级服务端研发工程师": 1, "服务端研发工程师（实习）": 1, "工程师（服务端研发": 1, "工程师-服务端研发": 1, "服务端研发攻城狮": 1, "服务端研法工程师": 1, "Sr. server side engineer": 1, "serversideengineer": 1,
        "server side enginere": 1, "后台研发实习": 1, "2026届产品经理": 2, "PM (campus)": 2, "产品经理 P6": 2, "产品经理\n": 2, "游戏引擎程序猿": 3, "引擎岗": 3, "会计": -1, "N/A": -1, "岗位不限": -1,
    }
    others = around([a + b for a in "硬件药物财税客服园林" for b in "测绘评审培训"], "{}攻城狮", "高级{}", "{}（实习）", "{}岗", "2026届{}", "{} P6", "Sr. {}", "{} (campus)", "{}实习", "{}程序猿")
    assert mapped(spark, ref, ["position_name"], canonmap.POSITION, list(want), others) == want


def test_empty_sides(spark, companies):
    assert mapped(spark, companies, ["company_name"], canonmap.COMPANY, []) == {}
    assert mapped(spark, companies.limit(0), ["company_name"], canonmap.COMPANY, ["槿屿", None]) == {"槿屿": -1}


def test_equal_entries_are_a_tie(spark):
    ref = spark.createDataFrame([(1, "甲乙", []), (2, "甲乙", [])], "ref_id int, company_name string, aliases array<string>")
    assert mapped(spark, ref, ["company_name"], canonmap.COMPANY, ["甲乙"]) == {"甲乙": -1}


def test_bounded_heap():
    h = topn.BoundedHeap(2)
    for score, ident in ((1, "a"), (None, "n"), (5, "b"), (5, "a"), (5, "b"), (7, "z"), (7, "y")):
        h.offer(score, ident)
    assert [k[2] for k in h.best()] == ["y", "z"]
    h = topn.BoundedHeap(3)
    for score, ident in ((None, "b"), (None, "a"), (0, "c"), (2, "c")):
        h.offer(score, ident)
    assert [k[2] for k in h.best()] == ["c", "a", "b"]


@pytest.mark.parametrize("held", [500_000, 3])
def test_top_n_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(topn, "HELD", held)  # handing heaps on early must change nothing
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "", None]), rng.choice([None, float("nan"), 1.0, 2.0, 3.0]), rng.choice([f"i{k}" for k in range(60)] + [None])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "grp string, score double, ident string, s string").repartition(7)
    got = {(r.grp, r.rank_no): r.ident for r in topn.top_n_per_group(df, "grp", "score", "ident", 5).collect()}
    best: dict = {}
    for g, s, i in rows:
        if g is not None and i is not None:
            s = None if s is None or s != s else s
            key = (s is None, -(s or 0))
            best.setdefault(g, {})[i] = min(best.get(g, {}).get(i, key), key)
    want = {(g, n): i for g, items in best.items() for n, (i, _) in enumerate(sorted(items.items(), key=lambda kv: (kv[1], kv[0]))[:5], 1)}
    assert got == want


def test_top_n_edges(spark):
    df = spark.createDataFrame([], "g string, s double, i string")
    assert topn.top_n_per_group(df, "g", "s", "i", 5).count() == 0
    with pytest.raises(ValueError, match="at least"):
        topn.top_n_per_group(df, "g", "s", "i", 0)
