import random

import pytest

from inkmill.operators import chapters as C
from inkmill.operators import paragraphs as P
from inkmill.operators import scenes as S
from inkmill.operators import validation as V


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")


def got_chapters(spark, lines, profile="split"):
    rows = C.chapters(P.paragraphs(docs(spark, "\n".join(lines)), profile), profile).orderBy("chapter_index").collect()
    return [(r.chapter_index, r.chapter_title, r.start_para, r.end_para) for r in rows]


def test_chapters_with_preface(spark):
    lines = ["楔子", "开篇的话", "第1章 渡口", "船来了", "雨停了", "第2章 旧桥", "桥断了"]
    assert got_chapters(spark, lines) == [(1, "序章/前言", 0, 1), (2, "第1章 渡口", 2, 4), (3, "第2章 旧桥", 5, 6)]


def test_chapter_numerals_and_false_positives(spark):
    assert [c[1] for c in got_chapters(spark, ["第一章", "内容1", "第二十回", "内容2", "第三百零五节", "内容3"])] == ["第一章", "第二十回", "第三百零五节"]
    assert [c[1] for c in got_chapters(spark, ["Chapter 1 Start", "content", "Chapter 20 End", "content"])] == ["Chapter 1 Start", "Chapter 20 End"]
    assert [c[2:] for c in got_chapters(spark, ["第一章", "内容", "他数到：第三盏灯灭了。", "第5章", "内容"])] == [(0, 2), (3, 4)]


def test_profiles_differ(spark):
    lines = ["引子", "　第一章 x", "第 1 章", "第1万章", "第两章", "文"]
    assert [c[1] for c in got_chapters(spark, lines)] == ["序章/前言", "第一章 x", "第两章"]
    assert [c[1] for c in got_chapters(spark, lines, "ingest")] == ["第 1 章", "第1万章"]
    assert got_chapters(spark, ["无题"], "ingest") == []


def test_markdown_types(spark):
    text = "# t\n- a\n1. b\n> q\n```\n\ncode\n```\nx\n```\nopen"
    rows = P.typed(P.paragraphs(docs(spark, text))).orderBy("para_index").collect()
    assert [r.para_type for r in rows] == ["HEADER", "LIST_ITEM", "LIST_ITEM", "QUOTE", "CODE_BLOCK", "CODE_BLOCK", "CODE_BLOCK", "CODE_BLOCK", "TEXT", "CODE_BLOCK", "CODE_BLOCK"]
    assert [r.is_anchor for r in rows][:2] == [True, False]


def test_line_ends_nulls_and_empty_tables(spark):
    rows = P.paragraphs(docs(spark, "a\r\nb\rc\n", None, "", "\n")).orderBy("doc", "para_index").collect()
    assert [(r.doc, r.content) for r in rows] == [(0, "a"), (0, "b"), (0, "c"), (3, "")]
    empty = spark.createDataFrame([], "doc bigint, text string")
    assert S.scenes(empty).collect() == [] and S.segments(empty).collect() == []


@pytest.mark.parametrize(
    "lines, want",
    [
        (["他问道：", "“你好。”"], [("NARRATION", 2)]),
        (["“你好。”", "他笑了。"], [("DIALOGUE", 2)]),
        (["一段正文", "# 标题", "一段正文"], [("NARRATION", 1), ("HEADER", 1), ("NARRATION", 1)]),
        (["```", "x = 1", "```"], [("CODE_BLOCK", 3)]),
    ],
)
def test_segments_absorb(spark, lines, want):
    rows = S.segments(docs(spark, "\n".join(lines))).orderBy("segment").collect()
    assert [(r.seg_type, r.n_paras) for r in rows] == want


def test_segments_without_absorbing(spark):
    text = "\n".join(["“一。”", "“二。”", "“三。”", "“四。”", "他走了。"])
    assert [(r.seg_type, r.n_paras) for r in S.segments(docs(spark, text), absorb=False).orderBy("segment").collect()] == [("DIALOGUE", 4), ("NARRATION", 1)]


def scene_fold(segments, limits):
    """The rule spelled out over whole segments, as a check of the running form."""
    scenes, buffer = [], []
    for kind, size in segments:
        length, talk = sum(s for _, s in buffer), sum(k == S.DIALOGUE for k, _ in buffer)
        target = limits.target if not buffer else limits.code_target if any(k == S.CODE for k, _ in buffer) else limits.dialogue_target if talk / len(buffer) > 0.5 else limits.target
        if buffer and length >= target:
            scenes.append(buffer)
            buffer = []
        buffer = [*buffer, (kind, size)]
    return [len(s) for s in [*scenes, buffer] if s]


def test_scene_fold_against_plain_form():
    rng = random.Random(3)
    for _ in range(200):
        segs = [(rng.choice([0, 1, 2, 3]), rng.randint(1, 900)) for _ in range(rng.randint(1, 40))]
        numbers = S.scene_numbers(list(range(len(segs))), [k for k, _ in segs], [n for _, n in segs])
        assert [numbers.count(i) for i in sorted(set(numbers))] == scene_fold(segs, S.Limits())


def test_scenes_partition_paragraphs_and_carry_context(spark):
    lines = ["第1章 a"] + ["字" * 700 + f"{i}。" for i in range(7)] + ["第2章 b", "末"]
    rows = S.scenes(docs(spark, "\n".join(lines))).orderBy("chapter_index", "scene").collect()
    assert "".join(r.text for r in rows) == "\n".join(lines) + "\n"
    assert all(len(r.prefix_context) == (0 if r.scene == 0 else 199) for r in rows)
    assert [r.word_count for r in rows] == [len(r.text) for r in rows] and len({r.id for r in rows}) == len(rows)
    assert rows[0].quality_score == 1.0 and rows[-1].quality_score == 0.7 and rows[0].density_score == 1.0
    assert S.first_scenes(S.scenes(docs(spark, "\n".join(lines))), 2).count() == 2


def test_length_validation(spark):
    scenes = spark.createDataFrame([("a", "t", 0), ("b", None, 3), ("c", "t", 100), ("d", "t", 9000), ("e", "t", None)], "id string, chapter_title string, word_count int")
    v = V.length_violations(scenes)
    assert {(r.id, r.severity) for r in v.collect()} == {("a", "error"), ("b", "warning"), ("d", "warning"), ("e", "error")}
    assert {(r.severity, r.n) for r in V.summary(v).collect()} == {("error", 2), ("warning", 2)}
    with pytest.raises(ValueError):
        V.assert_valid(v)


def test_one_target_for_all_scenes(spark):
    kinds, sizes = [S.DIALOGUE] * 4, [500] * 4
    assert S.scene_numbers([0, 1, 2, 3], kinds, sizes) == [0, 0, 0, 1]
    assert S.scene_numbers([0, 1, 2, 3], kinds, sizes, S.Limits(fixed=True, target=900)) == [0, 0, 1, 1]


def test_results_of_several_validators(spark):
    a = spark.createDataFrame([(1, "warning", "w")], "id bigint, severity string, message string")
    V.assert_valid(V.combined(a, a.limit(0)))
    with pytest.raises(ValueError, match="invalid scene 2"):
        V.assert_valid(V.combined(a, spark.createDataFrame([(2, "error", "e")], a.schema)))
