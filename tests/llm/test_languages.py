import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import languages as L
from corvane.llm import queries
from corvane.session import table

WORDS = {
    "en": "the and of to in is was for that with on as are this by from they have not had but what were when we there can an your which said if do will each about how up".split(),
    "de": "der und die das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también".split(),
}


def sentence(r, lang):
    return " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(7, 15))).capitalize() + "."


def test_tags(spark):
    cases = {"EN": "en", " en-US": "en", "en_GB": "en", "eng": "en", "Bahasa Indonesia": "id", "in": "id", "German": "de", "de-AT": "de", "??": None, "und": None, "": None, "n/a": None, None: None, "xx": None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {x.t: x.c for x in df.select("t", L.language_tag(F.col("t")).alias("c")).collect()} == cases


def test_sentences_and_folding():
    t = "First one here. Second; one | third\n- Fourth line\r\nÜBER 12 Straßen"
    assert [t[a:b] for a, b in L.sentences(t)] == ["First one here.", "Second;", "one ", "third", "- Fourth line", "ÜBER 12 Straßen"]
    long = "a sentence that is long enough to be wrapped here\nand goes on there"
    assert len(L.sentences(long)) == 1
    assert L.folded_sentences("* ÉTÉ 12 des années de la vie belle")[0][2] == "ete des annees de la vie belle"
    assert L.folded_sentences("Jane Roe Poe jane.roe (at) mail.example x") == []
    assert L.folded_sentences(None) == L.folded_sentences("") == L.folded_sentences(" \n ") == []


def test_held_out_accuracy_with_wrong_labels(spark):
    r = random.Random(7)
    rows, truth = [], {}
    for i in range(400):
        lang = r.choice(list(WORDS))
        other = r.choice([x for x in WORDS if x != lang])
        mixed = r.random() < 0.2
        text = " ".join(sentence(r, lang) for _ in range(6)) + (" " + sentence(r, other) if mixed else "")
        truth[i] = {lang, other} if mixed else {lang}
        rows.append((i, text, other if r.random() < 0.15 else lang, "clash"))
    rows += [(900, None, "en", ""), (901, "", None, ""), (902, "x " * 50_000, "en", ""), (903, "Python, SQL", "de", "")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, languages string")
    model = L.train(df, "text", "lang", "doc_id", per_language=60)
    out = {x.doc_id: x for x in L.identify(df, model, "text", ["doc_id"], segments=True).collect()}
    good = sum({y.lang for y in out[i].languages} == t for i, t in truth.items())
    assert good / len(truth) > 0.95
    assert all(out[i].languages == [] for i in (900, 901, 903))
    for i in truth:
        s = out[i].segments
        assert all(a.end <= b.start for a, b in zip(s, s[1:], strict=False)) and {x.lang for x in s} == {x.lang for x in out[i].languages}
    assert L.identify(df.limit(0), model, "text", ["doc_id"]).count() == 0


def test_nothing_to_learn(spark):
    with pytest.raises(ValueError):
        L.train(spark.createDataFrame([(1, "a", None)], "doc_id int, text string, lang string"), "text", "lang", "doc_id")


def test_one_language_model():
    m = L.fit({"en": Counter(["the one sentence that there is here"])})
    c = L.Classifier(m)
    c.learn(["the one sentence that there is here"])
    assert c.memo["the one sentence that there is here"][0] == 0


def test_corpus_labels_mostly_hold(spark):
    d = "/root/testdata/sf0.01"
    out = queries.p1_found(spark, d).collect()
    assert {x.src_table for x in out} == {"documents", "evidence", "annotations"}
    n = table(spark, d, "documents").count()
    assert 0.1 * n < len({x.row_id for x in out if x.src_table == "documents"}) < 0.4 * n


def test_snippets_and_annotations(spark, tmp_path):
    r = random.Random(3)
    text = lambda lang, n: " ".join(sentence(r, lang) for _ in range(n))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(i, text(lang, 6), lang) for i, lang in enumerate(list(WORDS) * 20)], "doc_id bigint, text string, lang string", "documents")
    snippets = [("e1", "c1", text("de", 4)), ("e2", "c1", text("en", 1) + " " + text("de", 3)), ("e3", "c2", text("es", 3)), ("e4", "c3", ""), ("e5", "c3", None)]
    save(snippets * 2, "id string, candidate_id string, snippet string", "evidence")
    save([("c1", "k1", "de"), ("c1", "k2", "en"), (" C2", "k1", None), ("c3", "k1", "en"), ("c9", "k1", "fr")], "candidate_id string, criterion_id string, cv_language string", "annotations")
    parts = queries.p1_snippets(spark, str(tmp_path)).collect()
    assert {x.id for x in parts} == {"e1", "e2", "e3", "e4", "e5"}
    assert {(x.id, x.lang) for x in parts} == {("e1", "de"), ("e2", "de"), ("e3", "es"), ("e4", None), ("e5", None)}
    assert {x.segment_lang for x in parts if x.id == "e2"} == {"en", "de"} and all((x.confidence is None) == (x.lang is None) for x in parts)
    rows = queries.p1_annotations(spark, str(tmp_path)).collect()
    assert {(x.candidate_id, x.criterion_id, x.lang) for x in rows} == {("c1", "k1", "de"), ("c1", "k2", "de"), (" C2", "k1", "es"), ("c3", "k1", None), ("c9", "k1", None)}
    assert len(rows) == 5 and all((x.confidence is None) == (x.lang is None) for x in rows)


def test_scripts_without_blanks_and_hangul(spark):
    r = random.Random(5)
    chars = {"zh": "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动", "ja": "のにはをたがでてとしれさあるいもするからなことしてい人年大日中本会社私時行見月分後前生"}
    korean = "저는 서울에 그리고 있습니다 회사에서 업무를 합니다 우리는 매일 새로운 계획을 준비하고 함께 일했습니다 작년부터".split()

    def text(lang):
        if lang == "ko":
            return " ".join(" ".join(r.choice(korean) for _ in range(r.randrange(7, 12))) + "." for _ in range(5))
        return "".join("".join(r.choice(chars[lang]) for _ in range(r.randrange(14, 30))) + "。" for _ in range(5))

    rows = [(i, text(lang), lang if i > 20 else "") for i, lang in enumerate(["zh", "ja", "ko"] * 30)]
    rows.append((900, text("zh") + text("ja"), None))
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    out = {x.doc_id: [y.lang for y in x.languages] for x in L.identify(df, L.train(df, "text", "lang", "doc_id"), "text", ["doc_id"]).collect()}
    assert all(out[i] == [("zh", "ja", "ko")[i % 3]] for i in range(90))
    assert sorted(out[900]) == ["ja", "zh"]
    assert L.folded_sentences("저는 서울에 그리고 있습니다 회사에서 업무를")[0][2] == "저는 서울에 그리고 있습니다 회사에서 업무를"
    assert [t for *_, t in L.folded_sentences("我在中国的一个大国生活了很久。短句。")] == ["我在中国的一个大国生活了很久。"]
