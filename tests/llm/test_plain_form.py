from __future__ import annotations

import pytest

from occura.llm import plainform

CASES = {
    "ＱＰＳ１２": "QPS12", "（１）": "（1）", "⼀种⽤法": "一种用法", "不同": "不同", "P​9\xad9": "P99", "a　b\xa0c d": "a b c d", "école": "école",
    "Sраrk": "Spark", "QΡЅ": "QPS", "Вертолин公司": "Вертолин公司", "α-β 剪枝": "α-β 剪枝", "Θ(n²)": "Θ(n²)", "x\ty ": "x\ty ", "": "", "Kе́val": "Kéval", "нейронnet": "нейронnet", "ﾃｽﾄ": "テスト", "！？，": "！？，",
    "ｶﾞｰﾄﾞﾊﾟ": "ガードパ", "ﾞ": "゛", "𝐆𝐨𝟏": "Go1", "ﬁne": "fine", "Gооɡle": "Google", "ԍo": "Go", "հello": "hello", "Հայաստան": "Հայաստան", "第Ⅳ章①": "第Ⅳ章①", "μs λx Δt": "μs λx Δt", "ɡɑ": "ɡɑ", "か\u3099": "が",
}


def test_cases(spark):
    df = spark.createDataFrame([*CASES.items(), (None, None)], "v string, want string")
    for r in plainform.with_plain_form(df, "v", plain="got").collect():
        assert r.got == r.want, ascii(r.v)


def test_plain_form_is_stable(spark):
    df = spark.createDataFrame([(x,) for x in CASES.values()], "v string")
    assert plainform.with_plain_form(df, "v", plain="p").where("p <> v").count() == 0


def test_key(spark):
    df = spark.createDataFrame([("Ａ-b，Ç 中​文²!_",), ("…",), (None,)], "v string")
    assert [r.k for r in plainform.with_plain_form(df, "v", key="k").collect()] == ["abç中文²", "", None]


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "Ａ", "old", [1])], "id int, v string, p string, `a.b` array<int>")
    got = plainform.with_plain_form(df, "v", plain="p", key="k").first()
    assert (got.id, got.v, got.p, got.k, got["a.b"]) == (1, "Ａ", "A", "a", [1])
    with pytest.raises(ValueError, match="own"):
        plainform.with_plain_form(df, "v", plain="v")


def test_changed_rows(spark):
    long = "好" * 60_000 + "Ａ"
    df = spark.createDataFrame([("1", "Ａ"), ("1", "Ａ"), ("2", "A"), ("3", None), ("4", ""), ("5", long)], "id string, t string")
    got = {r.row_id: r.plain_form for r in plainform.changed_rows(df, "id", "t").collect()}
    assert got == {"1": "A", "5": long[:-1] + "A"}
    assert plainform.changed_rows(df.limit(0), "id", "t").count() == 0
