"""Sentences, consistent forms, wrong encodings, tokens and leaks."""

import base64
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkmill.llm import bpe, canonical, codepoints, leaks, mojibake, sentences
from inkmill.llm.queries import p3_found, vocabulary_path


@pytest.mark.parametrize(
    "line, want",
    [
        ("他走了。“别去！”她说。雨停了？！", ["他走了。", "“别去！”她说。", "雨停了？！"]),
        ("“没人见过。”“等他回来？”温寒江守着。", ["“没人见过。”", "“等他回来？”", "温寒江守着。"]),
        ("“先去……”苏扶桑低声说，“递给他！”夜深了。", ["“先去……”苏扶桑低声说，“递给他！”", "夜深了。"]),
        ("他写下“印章。”三个字的注脚，走了。", ["他写下“印章。”三个字的注脚，走了。"]),
        ("约莫7.3斤（真重。），存成 juan2.txt，改到 v5.3.4 版。", ["约莫7.3斤（真重。），存成 juan2.txt，改到 v5.3.4 版。"]),
        ("Dr. Orr and Mrs. Lee met at 6 a.m. At dusk they left.", ["Dr. Orr and Mrs. Lee met at 6 a.m.", "At dusk they left."]),
        ("He hesitated ... and left. “Stop! No entry.” she said. (It rained.) Yes.", ["He hesitated ... and left.", "“Stop! No entry.” she said.", "(It rained.) Yes."]),
        ("J. R. Lee of St. Ann packed rope, etc. Then he left; see vol. 2, pp. 3-4.", ["J. R. Lee of St. Ann packed rope, etc.", "Then he left; see vol. 2, pp. 3-4."]),
        ("Am 17. Mai trug er z. B. 5,4 kg Salz usw. nach Süden. Gut!", ["Am 17. Mai trug er z. B. 5,4 kg Salz usw. nach Süden.", "Gut!"]),
        ("„Bleib hier! Es wird dunkel“, sagte er. Ja.", ["„Bleib hier! Es wird dunkel“, sagte er.", "Ja."]),
        ("В 831 г. Велемир, т. е. сын, ушёл. А. Б. Лукин с ул. Новой ждал.", ["В 831 г. Велемир, т. е. сын, ушёл.", "А. Б. Лукин с ул. Новой ждал."]),
        ("「もう行くよ！」と凪は言った。傘を拾った｡", ["「もう行くよ！」と凪は言った。", "傘を拾った｡"]),
        ("“어서 가자.” 해솔이 말했다. 무게는 1.6kg이었다.", ["“어서 가자.” 해솔이 말했다.", "무게는 1.6kg이었다."]),
        ("เมื่อพ.ศ. 2391 เขาเดินไป ชายชรารอ", ["เมื่อพ.ศ. 2391 เขาเดินไป", "ชายชรารอ"]),
        ("हم डॉ. राम से मिले। क्या वह गया? हाँ॥", ["हم डॉ. राम से मिले।", "क्या वह गया?", "हाँ॥"]),
        ("دفع 1.5 دينارا. هل رجع؟ نعم.", ["دفع 1.5 دينارا.", "هل رجع؟", "نعم."]),
        ("17．他走了。", ["17．他走了。"]),
        ("He left in Jan. 2020. Snow fell.", ["He left in Jan. 2020.", "Snow fell."]),
        ("No. He left. See No. 12 and Fig. IV there.", ["No.", "He left.", "See No. 12 and Fig. IV there."]),
        ("Come with me. We left the house.", ["Come with me.", "We left the house."]),
        ("𑄌𑄋𑄴𑄟𑅁 𑄌𑄋𑄴𑄟𑅁", ["𑄌𑄋𑄴𑄟𑅁", "𑄌𑄋𑄴𑄟𑅁"]),
        ("……", []),
        ("  上一章 ← 目录 → 下一章  ", ["上一章 ← 目录 → 下一章"]),
    ],
)
def test_sentences_of_a_line(line, want):
    assert [line[a:b] for a, b in sentences.sentences(line)] == want


def test_every_terminator_of_every_script_ends_a_sentence():
    marks = sentences.regex.findall(r"\p{STerm}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    assert len(marks) > 140
    for m in marks:
        line = f"漢字{m}漢字"
        assert [line[a:b] for a, b in sentences.sentences(line)] == [f"漢字{m}", "漢字"], hex(ord(m))


def test_sentences_frame(spark):
    docs = spark.createDataFrame([(1, "一。\r\n二\n\n***\n三！四", 9), (2, None, 9), (3, "", 9), (1, "甲。", 9)], "doc bigint, text string, n int")
    rows = sorted((r.doc, r.n, r.start_pos, r.end_pos) for r in sentences.split_sentences(docs).collect())
    assert rows == [(1, 0, 0, 2), (1, 0, 0, 2), (1, 1, 4, 5), (1, 2, 11, 13), (1, 3, 13, 14)]
    assert sentences.split_sentences(docs.limit(0)).collect() == []
    long = "他走了。" * 50_000
    assert len(sentences.sentences(long)) == 50_000


ALIKE = [("Café", "Café"), ("第１２章", "第12章"), ("Сap", "Cap"), ("一​二", "一二"), ("⼗⼈", "十人"), ("Ⅱ ﬁ", "II fi"), ("a b", "a b"), ("ｶﾞ", "ガ"), ("○——", "〇――"), ("한", "한"), ("x\r\ny", "x\ny"), ("Ӧ", "Ö")]
VISIBLE = [("人", "入"), ("①", "1"), ("千", "干"), ("a", "b"), ("a", "ab"), ("é", "e"), ("—", "-"), ("a b", "ab")]


def test_forms():
    form = lambda x: canonical.canonical_array(pa.array([x]))[0].as_py()
    assert all(form(a) == form(b) for a, b in ALIKE)
    assert not any(form(a) == form(b) for a, b in VISIBLE)
    assert canonical.canonical_array(pa.array([None, "", "\r", "\n"], pa.string())).to_pylist() == [None, "", "\n", "\n"]
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(0xC0, 0x250), *range(0x300, 0x340), *range(0xAC00, 0xAC40), 0x1100, 0x1161, 0x30AB, 0x3099]]
    for _ in range(300):
        s = "".join(rng.choice(pool) for _ in range(9))
        assert form(unicodedata.normalize("NFC", s)) == form(unicodedata.normalize("NFD", s)) == form(form(s))


def test_alike_pairs(spark):
    rows = [("t", 1, 7, "Café"), ("t", 2, 7, "Café"), ("t", 3, 7, "Café"), ("t", 4, 7, "Cafe"), ("t", 5, 8, "Café"), ("t", 6, None, "Café"), ("u", 7, 7, "Сafé"), ("t", 8, 7, ""), ("t", 9, 7, None), ("t", 2, 7, "Café")]
    got = {tuple(r) for r in canonical.alike_pairs(spark.createDataFrame(rows, "tab string, row bigint, place bigint, field string")).collect()}
    assert got == {("t", 1, 2), ("t", 2, 3)}
    kept = canonical.with_form(spark.createDataFrame([(1, None), (2, "Ａ")], "form bigint, text string").withColumnRenamed("form", "x"))
    assert sorted((r.x, r.form) for r in kept.collect()) == [(1, None), (2, "A")]


def test_tokens_are_those_of_the_public_tokenizer(spark):
    tiktoken, vocab = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = ["a", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "２", "é", "漢", "!", "\r\n", "　", "\xa0", "😀", "ก", "่", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + [None, "", "long " * 30_000, "x" * 3000]
    encoder = bpe.Encoder(vocabulary_path())
    for text, ids in zip(texts, bpe.encode_array(pa.array(texts), encoder).to_pylist()):
        assert ids == (public.encode_ordinary(text) if text else [])
        assert bpe.decode_ids(ids, vocabulary_path()) == (text or "")
    frame = spark.createDataFrame([(1, "héllo wörld", 5), (2, None, 5), (3, "", 5), (1, "héllo wörld", 5)], "doc bigint, text string, ids int")
    rows = bpe.with_ids(frame, vocabulary_path()).collect()
    both = bpe.with_ids(frame.select("doc", "text"), vocabulary_path(), begins="at")
    for r in bpe.with_text(both.withColumn("same", F.col("ids")), vocabulary_path(), "same").collect():
        spelled = r.text.encode()
        assert r.text == (r.text and "héllo wörld") and len(r["at"]) == len(r.ids)
        assert [bpe.decode_ids([i], vocabulary_path()).encode() for i in r.ids] == [spelled[a:b] for a, b in zip(r["at"], [*r["at"][1:], len(spelled)])]
    assert sorted((r.doc, r.ids) for r in rows) == sorted([(1, public.encode_ordinary("héllo wörld"))] * 2 + [(2, []), (3, [])])


def test_code_points_round_trip():
    xs = ["a漢😀", "", None, "é́"]
    points, offsets, _ = codepoints.decode(pa.array(xs))
    assert codepoints.encode(points, offsets, np.array([x is None for x in xs])).to_pylist() == xs
    assert [p.to_pylist() for _, p in codepoints.pieces(pa.array(xs), 8)] == [["a漢😀", "", None], ["é́"]]


def _noise(rng, n):
    return "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(6)
    item = _noise(rng, 120)
    en = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    edited = item[10:30] + "Х" + item[31:55] + item[54:70]
    docs = [
        (1, "前" + item + "后", True), (2, "，".join(item[20:66]), True), (3, item[20:60], False), (4, edited, True), (5, _noise(rng, 300), False), (6, None, False), (7, "", False),
        (8, "..." + en[30:140].upper() + "!", True), (9, en[30:90], False), (10, item[:40] + _noise(rng, 9) + item[50:90], False), (1, "前" + item + "后", True), (11, (_noise(rng, 5000) + item[:60] + _noise(rng, 5000)), True),
    ]
    items = spark.createDataFrame([(100, item, "zh", "x"), (101, en, "en", "x"), (102, None, "zh", "x"), (103, "前。", "zh", "x")], "item bigint, text string, lang string, doc string")
    frame = spark.createDataFrame([d[:2] for d in docs], "doc bigint, text string")
    want = {(d, 101 if d in (8, 9) else 100) for d, _, hit in docs if hit}
    for block in (10**6, 50):
        assert {tuple(r) for r in leaks.leaks(frame, items, block).collect()} == want
    assert leaks.leaks(frame.limit(0), items).collect() == [] and leaks.leaks(frame, items.limit(0)).collect() == []


def test_runs_of_letters_on_both_sides():
    rng = random.Random(4)
    left, right = _noise(rng, 30), _noise(rng, 30)
    items = leaks.index_items([1, 2, 3], ["甲" * 10_000, left + "乙" * 10_000 + right, "丙丁" * 5_000], ["zh", "zh", "zh"])
    texts = ["甲" * 10_000, "x" * 20 + "甲" * 44 + "y" * 20, left + "乙" * 40, "乙" * 40 + right, left + "乙" * 9, "丁丙" * 3_000, "丙丁" * 22]
    row, item = leaks.passages(*leaks.letters(pa.array(texts)), items)
    assert set(zip(row.tolist(), item.tolist())) == {(0, 0), (2, 1), (3, 1), (5, 2)}


def test_wrong_encodings(spark):
    rng = random.Random(8)
    words = ["夜深了", "他推开门", "雨停的时候", "远处的灯", "一盏一盏灭了", "没有人说话", "青石板路", "风里轻轻作响", "Café Zoë", "le château d’été", "Тихон ждал рассвета", "у старой переправы"]
    make = lambda: "，".join(rng.choice(words) for _ in range(12)) + "。"
    texts = [make() for _ in range(400)]
    rows, want = [], {}
    pairs = [("utf-8", "gb18030"), ("utf-8", "cp1252"), ("gb18030", "cp1252"), ("gb18030", "big5")]
    for i, t in enumerate(texts):
        rows.append(("s", i, i, t))
        if i % 10 == 0:
            written, read = pairs[i // 10 % 4]
            said = "，".join(rng.choice(words[:8]) for _ in range(5))
            rows.append(("s", 1000 + i, i, t[:20] + "\n" + mojibake.misread(said, written, read) + "\n" + t[20:]))
            want[1000 + i] = said
    rows += [("s", 5000, 1, "锟斤拷锟斤拷"), ("s", 5001, 1, "a�b"), ("s", 5002, 1, None), ("s", 5003, None, ""), ("s", 5004, None, "NÃO ABRIR, SEÑOR")]
    got = {r.row: r for r in mojibake.garbled(spark.createDataFrame(rows, "tab string, row bigint, place bigint, text string")).collect()}
    assert set(got) == {*want, 5000, 5001}
    restored = sum(said in got[i].text for i, said in want.items())
    assert restored >= 0.6 * len(want) and not got[5001].whole
    assert mojibake.garbled(spark.createDataFrame([], "tab string, row bigint, place bigint, text string")).collect() == []


def test_explaining_a_pair():
    clean = "夜深了，他推开门。"
    assert ("utf-8", "cp1252") in mojibake.explain(mojibake.misread(clean, "utf-8", "cp1252"), clean)
    assert mojibake.explain("abc", "abd") == []
    assert mojibake.undo("CafÃ©", "utf-8", "cp1252") == ("Café", 0)


def test_a_rare_pair_is_learned_from_all_records(spark):
    rng = random.Random(9)
    words = ["夜深了", "他推开门", "雨停的时候", "远处的灯", "一盏一盏灭了", "没有人说话", "青石板路", "风里轻轻作响"]
    make = lambda n: "，".join(rng.choice(words) for _ in range(n)) + "。"
    rows = [("s", i, None, make(2)) for i in range(40_000)]
    rows += [("s", 100_000 + i, None, make(3) + mojibake.misread(make(6), "gb18030", "cp1252")) for i in range(4)]
    frame = spark.createDataFrame(rows, "tab string, row bigint, place bigint, text string")
    assert {r.row for r in mojibake.garbled(frame).collect()} == {100_000 + i for i in range(4)}


@pytest.mark.parametrize("pair", [("gb18030", "cp1252"), ("utf-8", "cp1252"), ("gb18030", "big5")])
def test_text_garbled_over_several_lines(pair):
    share = np.full(0x110000, -20.0, np.float32)
    lines = ["夜深了，他推开门。", "", "雨停的时候，远处的灯一盏一盏灭了。", "风轻。"]
    for c in "".join(lines):
        share[ord(c)] = -4.0
    fixer = mojibake.Repairer(share, [pair])
    for end in ("\n", "\r\n"):
        clean = end.join(lines)
        text = "Vor. " + end.join(mojibake.misread(x, *pair) for x in lines)
        points, offsets, _ = codepoints.decode(pa.array([text]))
        assert fixer.repair([text], [fixer.find(points, offsets)]) == ["Vor. " + clean]


def test_rows_without_a_place_are_no_look_alikes(spark, tmp_path):
    spark.createDataFrame([(1, "n", 1, "Café"), (2, None, 1, "Café"), (3, None, 1, "Cafe\u0301"), (4, "n", 1, "Cafe\u0301")], "chapter_row bigint, novel string, chapter_index int, title string").write.parquet(str(tmp_path / "chapters.parquet"))
    spark.createDataFrame([(1, "n", 1, None, "é"), (2, "n", 1, None, "e\u0301")], "scene_row bigint, novel string, chapter_index int, start_paragraph int, text string").write.parquet(str(tmp_path / "scenes.parquet"))
    assert [tuple(r) for r in p3_found(spark, str(tmp_path)).collect()] == [("chapters", 1, 4)]
