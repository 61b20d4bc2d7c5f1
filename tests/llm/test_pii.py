"""Personal data: the labelled sentences, and recall on wording that training does not have."""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkmill.llm import pii, pii_labels

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
# Carriers kept out of training, to measure recall on other wording.
HELD_OUT = {
    "zh": """本期排版{person}，封面{person}。|读者群里最活跃的是{person}同学|快递员说{person}的包裹放在{address}门口。|若遇缺货请短信{phone}告知。|通知书送达{address}，{person}签字。|客服邮箱换成了{email}，旧的停用。|实名认证需要{id}这样的号码。|老读者{person}从{address}写信来。|审稿老师{person}退回了这一章。|加{phone}的微信领番外。|投诉请发{email}并留下{phone}。|中奖者{person}请于月底前领奖。""",
    "en": """A parcel for {person} is waiting at {address}.|The prize goes to {person} of {address}.|Typo hunters may use {email} all week.|Our proofreader {person} found nine slips.|If lost, return to {address}.|Ring {phone} after six.|Applicant {person}, number {id}, was accepted.|We are grateful to {person} for the index.|Letters from {person} came with no stamp.|The new address is {address}, as of May.|Orders: {phone} or {email}.|Signed copies were sent to {person} and {person}.""",
    "de": """Das Päckchen für {person} liegt in der Post, Absender {address}.|Fehlermeldungen nimmt {email} entgegen.|Unser Leser {person} fand drei Fehler.|Nach 18 Uhr gilt {phone}.|Neue Anschrift: {address}.|Für den Hinweis danken wir {person}.""",
    "ru": """Посылка для {person} лежит на почте, адрес: {address}.|Новый телефон редакции {phone}.|Ошибки собирает {person}, {email}.|Приз вручён читателю {person}.|Наш новый адрес: {address}.|Заявка номер {id} принята от {person}.""",
    "ja": """荷物は{person}様の{address}に届きます。|誤植は{email}までお知らせください。|校正者の{person}が三か所見つけました。|新しい住所は{address}です。|夜は{phone}におかけください。|読者{person}さんの葉書を紹介します。""",
}
PLAIN = ["The wind did the rest and nobody spoke of it again.", "He followed Mara from the mill to Orrin Bridge, and said nothing.", "他推开门，雨停了。", "沈青崖看了看柳十七，把短刀收进袖中。", "Mara went to Orrin about a brass key.", "Он ждал рассвета у моста.", "Тихон отдал ключ Велимиру.", "凪は灯子より先に坂の上へ着いた。", "Der Müller trug das Bündel zum Tor."] * 30


@pytest.fixture(scope="module")
def model():
    return pii.fit(PLAIN, 14_000, 5)


def test_recall_on_carriers_kept_out_of_training(model):
    rng = np.random.default_rng(99)
    v = pii_labels.Values(rng)
    cases = [pii_labels._fill(s, lang, v) for lang, xs in HELD_OUT.items() for s in re.split(r"[|\n]", xs) for _ in range(12)]
    got = set()
    for r, a, b, k in pii.found_spans(model, pa.array([t for t, _ in cases])):
        got.add((r, a, b, k))
    want = {(i, *s) for i, (_, spans) in enumerate(cases) for s in spans}
    share = {kind: np.mean([x in got for x in want if x[3] == k]).round(3) for k, kind in enumerate(pii_labels.KINDS)}
    print(share, "precision", round(len(want & got) / len(got), 3))
    assert min(share.values()) > 0.6 and np.mean(list(share.values())) > 0.75 and len(want & got) / len(got) > 0.75


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="needs the test tables")
def test_no_carrier_is_from_the_tables():
    texts = "\n".join(x for x in pq.read_table(DOCUMENTS, columns=["text"]).column("text").to_pylist() if x)
    for lang, xs in pii_labels.POSITIVE.items():
        for s in re.split(r"[|\n]", xs):
            fixed = re.sub(r"\{\w+\}|<\w+>", "", s)
            if sum(c.isalpha() for c in fixed) < 3:
                continue  # a value with marks around it
            words = lambda m: "(?:" + "|".join(re.sub(r"<\\?\w+>", r".{1,20}", re.escape(w)) for w in pii_labels.WORDS[lang][m[1]]) + ")"  # noqa: B023, E731
            pattern = re.sub(r"<(\w+)>", words, re.sub(r"\\\{\w+\\\}", r"[^\n。！？]{2,40}?", re.escape(s)))
            found = re.search(pattern, texts)
            assert not found, (s, found[0])


def test_masking(spark, model):
    rows = [(1, "联系邮箱：lin.wen48@paper.example，三日后再说。\n第二行", 3), (2, None, 3), (3, "", 3), (4, "没有别的。", 3), (1, "联系邮箱：lin.wen48@paper.example，三日后再说。\n第二行", 3), (5, "走。" * 40_000, 3)]
    frame = spark.createDataFrame(rows, "doc bigint, text string, kind int")
    got = sorted(((r.doc, r.text, r["values"]) for r in pii.masked(frame, model).collect()), key=lambda r: r[0])
    assert got[0] == got[1] == (1, "联系邮箱：<EMAIL>，三日后再说。\n第二行", 1)
    assert got[2:] == [(2, None, 0), (3, "", 0), (4, "没有别的。", 0), (5, "走。" * 40_000, 0)]
    spans = pii.personal_data(frame, model).where("doc = 1").collect()
    assert {(r.start_pos, r.end_pos, r.kind) for r in spans} == {(5, 28, "email")}
    assert pii.personal_data(frame.limit(0), model).collect() == []


def test_training_lines_and_kept_model(spark, monkeypatch):
    monkeypatch.setattr(pii, "EXAMPLES", 60)
    monkeypatch.setattr(pii, "EPOCHS", 1)
    monkeypatch.setattr(pii, "fit", lambda lines, fit=pii.fit: fit(lines, 60, 1))
    frame = spark.createDataFrame([(i, f"line {i}\r\n\n" + "x" * 1000) for i in range(50)] + [(None, None), (99, "")], "doc bigint, text string")
    lines = pii.corpus_lines(frame, 1000)
    assert len(lines) == 100 and max(map(len, lines)) == pii.LINE_LENGTH
    first = pii.trained(frame)
    monkeypatch.setattr(pii, "fit", lambda lines: pytest.fail("trained again"))
    assert (pii.trained(frame).embed == first.embed).all()


@pytest.mark.parametrize("line, kind, want", [("信箱 a.b [at] c [dot] test。", "email", "a.b [at] c [dot] test"), ("电话(+86)143-84274218。", "phone", "(+86)143-84274218"), ("拨0190-5552426转157，", "phone", "0190-5552426转157"), ("号４８０１０３１９９２０８１２７８４X，", "id_number", "４８０１０３１９９２０８１２７８４X")])
def test_exact_form(line, kind, want):
    a = line.index(want)
    assert pii.checked(line, a + 1, a + len(want) - 1, pii.KINDS.index(kind)) == (a, a + len(want))


def test_digits_are_read_by_the_length_of_their_run():
    points = np.frombuffer("a12b３４５".encode("utf-32-le"), np.uint32)
    got = pii.read(points, np.array([0, 7])).tolist()
    assert got == [97, pii.RUNS + 2, pii.RUNS + 2, 98, *[pii.RUNS + 3] * 3]
    assert pii.read(points, np.array([0, 2, 7]))[1] == pii.RUNS + 1


def test_numbers_of_fifteen_digits_and_family_names_are_drawn():
    v = pii_labels.Values(np.random.default_rng(7))
    assert any(re.fullmatch(r"\d{15}", v.id("zh")) for _ in range(200))
    assert not set("温简荆桑仇游阎郗覃佟") - {v.person("zh")[0] for _ in range(20_000)}


@pytest.mark.parametrize("line", ["Dank an Hedwig Auerbach sagt das ganze Haus.", "Bring it back to 205 Alder Row, Ashby.", "Leave it at 39b Fen Street.", "Wir sind im Lindenweg 7 zu finden."])
def test_lines_that_may_hold_values_are_not_taught_as_free_of_them(line):
    assert pii_labels.cues().search(line)
