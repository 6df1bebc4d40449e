from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from occura.llm import langid

DATA = "/root/testdata/sf0.01"
SENTENCES = {
    "zh": ["面试官先让我讲项目，重点追问消息队列那一块。", "整体感受是不难，但是很看重细节，建议提前准备。", "中间网络断了一次，重新连上之后换了一道题。", "复盘下来，这部分必须重新学。"],
    "ja": ["面接官はまず経験について聞き、そこから深掘りされました。", "途中で通信が切れたので、別の問題に変わりました。", "最後の境界条件を見落としてしまいました。", "費用の話しかできませんでした。"],
    "en": ["The interviewer opened with my work on caches and kept digging.", "They wanted to know why we did not pick it, and I only talked about cost.", "My call dropped once, so they swapped the question for one about queues.", "It took several days before they got back to me."],
    "de": ["Es vergingen viele Tage, bis sich jemand wieder bei mir meldete.", "Auf meine Frage nach der Größe hieß es, es seien etwa zehn Personen.", "Die Verbindung brach einmal ab, danach bekam ich eine neue Frage.", "Sie wollten wissen, warum wir das nicht gewählt haben."],
    "fr": ["Il a fallu plusieurs jours avant que l'on me réponde enfin.", "La connexion a coupé une fois, puis ils ont posé une autre question.", "Ils voulaient savoir pourquoi nous n'avions pas choisi cela.", "J'ai su expliquer comment cela fonctionne, mais j'ai bloqué."],
}


def documents():
    out = []
    for k in range(60):
        for lang, s in SENTENCES.items():
            wrong = "en" if lang != "en" else "fr"
            out.append((len(out), "\n\n".join(s[(k + i) % 4] for i in range(3)), wrong if k % 9 == 0 else lang))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(documents(), "doc_id long, text string, lang string"), "doc_id", "text", "lang")


def judged(spark, model, text, lang=None):
    df = spark.createDataFrame([(1, text, lang)], "doc_id long, text string, lang string")
    return [(r.para_no, r.lang, r.doubtful) for r in langid.segment_languages(df, "doc_id", "text", "lang", model).orderBy("para_no", "lang").collect()]


@pytest.mark.parametrize("label", ["zh", "ZH", "zh-CN", "zh_Hans", " zh "])
def test_labels(label):
    assert langid.label_code(label) == "zh"


@pytest.mark.parametrize("label", [None, "", "??", "und", "chinese", "z"])
def test_labels_that_name_nothing(label):
    assert langid.label_code(label) is None


def test_paragraphs_and_segments():
    text = "# 标题\r\n第一句。第二句！\r\n \t\r\n\r\n```python\nx = 1\n\ny = 2\n```\n\n---\n\n2026-01-02\n\n- See https://a.example/b?c=d now. It works."
    assert langid.paragraphs(text) == 6
    got = list(langid.segments(text))
    assert [p for p, _ in got] == [1, 1, 1, 5, 6, 6]
    assert [s for p, s in got if p == 1] == ["标题", "第一句。", "第二句！"]
    assert got[-1] == (6, "It works.")
    assert list(langid.segments(None)) == [] and langid.paragraphs("") == 0


def test_mixed_document(spark, model):
    text = f"{SENTENCES['zh'][0]}\n\n{SENTENCES['fr'][0]} {SENTENCES['fr'][1]}\n\n```\nselect the and of to\n```\n\n{SENTENCES['zh'][1]}\n{SENTENCES['ja'][0]}"
    assert judged(spark, model, text, "zh") == [(1, "zh", True), (2, "fr", True), (4, "ja", True), (4, "zh", True)]


def test_terms_inside_a_sentence_do_not_count(spark, model):
    assert judged(spark, model, "大家 deadline 前记得 update 一下 resume，这部分很看重细节，建议准备。", "zh") == [(1, "zh", False)]
    assert judged(spark, model, "They wanted to know why recruiters call this step a 面经 chat, and I only talked about it.", "en-US") == [(1, "en", False)]


@pytest.mark.parametrize(("label", "doubtful"), [("de", False), ("DE_de", False), ("en", True), (None, True), ("und", True)])
def test_wrong_or_missing_label(spark, model, label, doubtful):
    assert judged(spark, model, "\n\n".join(SENTENCES["de"][:2]), label) == [(1, "de", doubtful), (2, "de", doubtful)]


def test_edges(spark, model):
    for text in (None, "", "   \n", "---", "```\ncode\n", "2026-01-01\n12:30"):
        assert judged(spark, model, text, "en") == []
    assert judged(spark, model, SENTENCES["en"][0] * 2000, "en") == [(1, "en", False)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    unfitted = langid.fit(empty, "doc_id", "text", "lang")
    assert judged(spark, unfitted, "whatever this is", "en") == [(1, "und", True)]
    assert judged(spark, unfitted, "不管这是什么", None) == [(1, "und", True)]


def test_scripts_without_a_profile(spark, model):
    for text in ("Мы долго говорили о кэше.", "면접관은 먼저 경험을 물었습니다.", "سألني عن الخبرة أولا.", "ผู้สัมภาษณ์ถามถึงประสบการณ์"):
        df = spark.createDataFrame([(1, f"{text}\n\n{SENTENCES['en'][0]}", "en")], "doc_id long, text string, lang string")
        got = langid.segment_languages(df, "doc_id", "text", "lang", model).orderBy("para_no").collect()
        assert [(r.para_no, r.lang, r.doubtful) for r in got] == [(1, "und", True), (2, "en", True)]
        assert got[0].confidence == 0


def test_labelled_languages_of_another_script_get_profiles(spark):
    ru = ["Мы долго говорили о кэше и очередях.", "Потом мне дали другую задачу по базам данных.", "Связь один раз прервалась, и вопрос заменили."]
    ko = ["면접관은 먼저 제 경험을 물었습니다.", "그 다음에 데이터베이스 문제를 냈습니다.", "연결이 한 번 끊겨서 질문이 바뀌었습니다."]
    rows = documents() + [(1000 + i, "\n\n".join(t), lang) for i, (lang, t) in enumerate([("ru", ru), ("ko", ko)] * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert judged(spark, model, f"{ru[1]}\n\n{ko[2]}", "ru") == [(1, "ru", True), (2, "ko", True)]


def test_document_languages(spark, model):
    rows = [(1, "\n\n".join(SENTENCES["de"][:2]), "de"), (2, "---", "en"), (3, None, None), (4, "Мы долго говорили.", "ru")]
    got = {r.doc_id: r for r in langid.document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", model).collect()}
    assert {i: (r.lang, r.languages, r.doubtful) for i, r in got.items()} == {1: ("de", 1, False), 2: ("und", 0, True), 3: ("und", 0, True), 4: ("und", 1, True)}
    assert got[1].confidence > 0 and got[2].confidence == got[4].confidence == 0


def test_confidence_and_extra_columns(spark, model):
    df = spark.createDataFrame([(1, SENTENCES["ja"][1], "ja", "x", 5)], "doc_id long, text string, lang string, confidence string, para_no int")
    r = langid.segment_languages(df, "doc_id", "text", "lang", model).first()
    assert r.lang == "ja" and 0 < r.confidence <= 1 and r.main == "ja"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test data")
def test_held_out_accuracy(spark):
    """Fitted on half of the labelled documents: the other half's main language is their label's, but for wrong labels."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    held = docs.where("doc_id % 2 = 1")
    main = {r.doc_id: r.main for r in langid.segment_languages(held, "doc_id", "text", "lang", model).select("doc_id", "main").distinct().collect()}
    labelled = [(r.doc_id, langid.label_code(r.lang)) for r in held.where(F.col("lang").isNotNull()).collect() if langid.label_code(r.lang)]
    right = sum(main.get(i) == code for i, code in labelled)
    assert right / len(labelled) > 0.85  # the rest carries wrong labels
    kana = held.where(F.col("text").rlike("[ぁ-ん].*[ぁ-ん].*[ぁ-ん]") & ~F.col("text").rlike("[a-z]{3,} [a-z]{2,} [a-z]{2,}"))
    japanese = [main.get(r.doc_id) for r in kana.select("doc_id", "text").collect() if sum("ぁ" <= c <= "ん" for c in r.text) > len(r.text) / 5]
    assert japanese and all(x == "ja" for x in japanese)
