import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.operators import answers as A
from inkmill.operators import context as X
from inkmill.operators import retrieval as R

HIT = "query bigint, question string, id string, novel string, version string, chapter_title string, chapter_index int, start_paragraph int, end_paragraph int, text string, word_count int, characters array<string>, score double"


def hits(spark, *rows):
    full = [(1, r.get("question", "q"), r["id"], r.get("novel", "n"), "v", "t", r.get("ch", 1), r.get("start", 0), r.get("end", 0), r.get("text", "x"), len(r.get("text") or ""), r.get("characters"), r.get("score", 0.5)) for r in rows]
    return spark.createDataFrame(full, HIT)


@pytest.mark.parametrize("q, kind", [("船夫的师傅叫什么", "CHARACTER"), ("明天的天气好吗", "UNSUPPORTED"), ("渡口何时结冰", "TIMELINE"), ("盐仓位于何处", "LOCATION"), ("铜镜有几面", "FACT"), ("  ", "UNSUPPORTED"), (None, "UNSUPPORTED")])
def test_answer_policy(spark, q, kind):
    assert spark.createDataFrame([(q,)], "q string").select(R.answer_policy(F.col("q"))).first()[0] == kind


@pytest.mark.parametrize("q, now, want", [("上一章的船去哪了", 7, (6, None)), ("这一章的钟响了吗", 4, (4, None)), ("渡口边他说了什么", 3, (None, "dialogue")), ("上一章里他说了什么", 12, (11, "dialogue")), ("谁拿了灯", 9, (None, None)), ("上一章", 0, (0, None))])
def test_chapter_range_and_role(spark, q, now, want):
    a, _ = R.chapter_range(F.col("q"), F.col("n"))
    assert tuple(spark.createDataFrame([(q, now)], "q string, n int").select(a, R.asked_role(F.col("q"))).first()) == want


def test_keywords(spark):
    rows = spark.createDataFrame([("铜镜何在？abc 12",), ("镜",), ("他 说",), ("",), (None,)], "q string").select(T.keywords(F.col("q"))).collect()
    assert [r[0] for r in rows] == [["abc", "12", "铜镜", "镜何", "何在"], ["镜"], [], [], []]


def test_rescore_values(spark):
    got = {r.id: r.score for r in X.rescored(hits(spark, {"id": "1", "text": "铜镜碎了", "question": "铜镜何在？"}, {"id": "2", "text": "无", "question": "铜镜何在？"}, {"id": "3", "text": None, "score": None})).collect()}
    assert got["1"] == pytest.approx(0.32) and got["2"] == pytest.approx(0.30) and got["3"] == 0


def test_dedupe_keeps_the_best(spark):
    rows = X.deduplicated(hits(spark, {"id": "1", "score": 0.8}, {"id": "1", "score": 0.9}, {"id": None, "start": 3}, {"id": None, "start": 3})).collect()
    assert sorted((r.id or "-", r.score) for r in rows) == [("-", 0.5), ("1", 0.9)]


def test_merge_limits(spark):
    for gap, groups in ((-6, 2), (-5, 1), (2, 1), (3, 2)):
        rows = X.merged(hits(spark, {"id": "a", "start": 1, "end": 10}, {"id": "b", "start": 10 + gap, "end": 30}), 1000).collect()
        assert len(rows) == groups, gap
    one = X.merged(hits(spark, {"id": "a", "start": 1, "end": 1, "text": "A"}, {"id": "b", "start": 2, "end": 2, "text": "B"}), 1000).first()
    assert one.text == "A" + X.SEPARATOR + "B" and one.merged_ids == ["a", "b"] and one.chunk_type == "merged_scene"
    assert X.merged(hits(spark, {"id": "a", "start": 1, "end": 1}, {"id": "b", "start": 2, "end": 2}), 14).count() == 1
    assert X.merged(hits(spark, {"id": "a", "start": 1, "end": 1}, {"id": "b", "start": 2, "end": 2}), 13).count() == 2
    assert X.merged(hits(spark, {"id": "a", "start": 1, "end": 1}, {"id": "b", "start": 2, "end": 2, "novel": "other"}), 900).count() == 2
    between = X.merged(hits(spark, {"id": "a", "start": 1, "end": 1}, {"id": "b", "start": 2, "end": 2, "novel": "other"}, {"id": "c", "start": 3, "end": 3}), 900).collect()
    assert sorted(r.merged_ids for r in between) == [["a", "c"], ["b"]]


def test_stage_counts(spark):
    h = hits(spark, {"id": "a", "start": 1, "end": 1}, {"id": "a", "start": 1, "end": 1}, {"id": "b", "start": 2, "end": 2}, {"id": "c", "ch": 5, "text": "y" * 100})
    joined = X.merged(X.deduplicated(X.rescored(h, False)))
    got = X.stage_counts(h, joined, X.within_budget(joined, 60)).first().asDict()
    assert got == {"query": 1, "original": 4, "deduplicated": 3, "merged": 2, "final": 1, "total_tokens": 14, "dropped": 1}


def test_budget_skips_and_goes_on(spark):
    assert X.budget_picks([60, 50, 30], 100, 5) == [True, False, True]
    assert X.budget_picks([60, 50, 30], 1000, 2) == [True, True, False]
    rng = random.Random(5)
    for _ in range(100):
        t = [rng.randint(0, 50) for _ in range(12)]
        picks = X.budget_picks(t, 100, 4)
        assert sum(itertools.compress(t, picks)) <= 100 and sum(picks) <= 4
    rows = X.assembled(hits(spark, {"id": "1", "ch": 2, "score": 0.9, "text": "x" * 40}, {"id": "2", "ch": 1, "score": 0.8, "text": "x" * 34}, {"id": "3", "ch": 3, "score": 0.7, "text": "x" * 20}), most_tokens=100, rescore=False).collect()
    assert {(r.id, r.rank) for r in rows} == {("1", 1), ("3", 2)}


def test_prompt_refusal_and_citations(spark):
    h = hits(spark, {"id": "k1", "text": "灯塔灭了", "question": "谁灭的灯"}, {"id": "k2", "ch": 2, "text": "守塔人走了"})
    blocks = X.assembled(h, rescore=False)
    questions = spark.createDataFrame([(1, "谁灭的灯"), (2, "没有答案")], "query bigint, question string")
    prompts = {r["query"]: r.prompt for r in A.prompts(blocks, "Be brief.", "JSON", questions).collect()}
    assert prompts[1].startswith("=== System Instruction ===\nBe brief.\n\n=== Context ===\n[Block 1 - k1]") and prompts[1].endswith("=== Output Constraint ===\nJSON")
    assert "=== Context ===\n\n\n=== User Question ===\n没有答案" in prompts[2]
    assert [(r["query"], r.answer.answer, r.answer.citations, r.answer.confidence) for r in A.with_refusals(questions, blocks).collect()] == [(2, A.REFUSAL, [], 0.0)]
    raw = '{"answer": "a", "citations": [{"chunkId": "k2"}, {"chunkId": "other"}, {"chunkId": null}], "confidence": 1.5}'
    answers = spark.createDataFrame([(1, raw)], "query bigint, raw string").select("query", A.parsed(F.col("raw")).alias("answer"))
    assert [(r.n, r.id) for r in A.checked_citations(answers, blocks).collect()] == [(0, "k2")]
    assert A.out_of_range(answers).count() == 1


def test_failures_and_repair(spark):
    rows = spark.createDataFrame([('{"answer": "a"}',), ('{"chunk_id": "x"}',), ("no",), ("",), (None,)], "r string")
    assert [r[0] for r in rows.select(A.failure(F.col("r"))).collect()] == [None, "chunk", "no answer", "empty", "empty"]
    fixed = rows.limit(2).select(A.repaired(F.from_json("r", A.ANSWER)).alias("a")).collect()
    assert [(r.a.answer, r.a.citations, r.a.confidence) for r in fixed] == [("a", [], 0.0), (A.NO_ANSWER, [], 0.0)]
    with pytest.raises(Exception, match="no answer"):
        rows.select(A.repaired(F.from_json(F.lit(None).cast("string"), A.ANSWER))).collect()


@pytest.mark.parametrize(
    "raw, answer, sure",
    [
        ('Hi ```json\n{"answer": "a", "confidence": 100}\n``` bye', "a", 100.0),
        ('{"answer": "a"} tail', "a", 0.8),
        ('{"response": "r"}', "r", 0.8),
        ('{"response": {"description": "d"}}', "d", 0.8),
        ('{"content": "c"}', "c", 0.8),
        ("nothing", None, None),
        (None, None, None),
    ],
)
def test_reading_answers(spark, raw, answer, sure):
    a = spark.createDataFrame([(raw,)], "r string").select(A.parsed(F.col("r")).alias("a")).first().a
    assert (a and a.answer, a and a.confidence) == (answer, sure)
    assert a is None or a.citations == []


def test_hydration(spark):
    scenes = spark.createDataFrame([(1, "x", "n", "v"), (2, "x", "n", "v"), (3, "y", "n", None)], "scene_row bigint, id string, novel string, version string")
    found = spark.createDataFrame([(7, "x", "n", "v"), (8, "z", "n", "v"), (9, "y", "n", None)], "hit bigint, id string, novel string, version string")
    assert [(r.hit, r.scene_row) for r in R.hydrate(found, scenes).collect()] == [(7, 1)]
    assert sorted(r.hit for r in R.unhydrated(found, scenes).collect()) == [8, 9]


def test_retrieval_filters_before_taking_the_best(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.8, 0.2], [0.0, 1.0]]
    store = spark.createDataFrame([(i, "nm"[i % 2], "v", f"s{i}", v[i]) for i in range(4)], "vec_row bigint, novel string, version string, id string, embedding array<float>")
    scenes = spark.createDataFrame([(10 + i, "nm"[i % 2], "v", f"s{i}") for i in range(3)], "scene_row bigint, novel string, version string, id string")
    asked = spark.createDataFrame([(1, "q", [1.0, 0.0], "m", None), (2, "q", [1.0, 0.0], " ", "v"), (3, "q", [1.0, 0.0], "none", "v"), (4, "q", None, None, None)], "query bigint, question string, embedding array<float>, novel string, version string")
    got = sorted((r["query"], r.scene_row) for r in R.retrieved(store, scenes, asked, 2, 2).collect())
    assert got == [(1, 11), (2, 10), (2, 11)]  # the second best of question 1 has no scene
    assert len(R.retrieved(store, scenes, asked.drop("novel", "version"), size=2).where("query = 1").collect()) == 3


def test_the_budget_reads_its_hits_once(spark):
    h = spark.createDataFrame([(1, "a", "x" * 40, 0.5, 1, 1), (1, "b", "x" * 2000, 0.9, 1, 2), (1, "c", "x" * 10, 0.7, 1, 3)], "query int, id string, text string, score double, chapter_index int, start_paragraph int")
    kept = X.within_budget(h, 90)
    assert kept._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert sorted((r.rank, r.id, r.tokens) for r in kept.collect()) == [(1, "c", 15), (2, "a", 60)]


def _plan(spark, name):
    """The plan of a query, made after what it writes on the way."""
    from inkmill.plans.queries import QUERIES

    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_citation_check_assembles_its_blocks_once(spark):
    assert "ArrowEvalPython" not in _plan(spark, "citation_check")


SEARCHED = ["answer_parse", "dedupe", "refusals", "retrieve_filtered", "answer_repair", "context_full_text", "merge_adjacent", "rescore", "context_stats", "prompt_text"]


@pytest.mark.parametrize("name", SEARCHED)
def test_queries_on_hits_neither_search_again_nor_pair_blocks(spark, name):
    plan = _plan(spark, name)
    assert not any(x in plan for x in ("MapInArrow", "NestedLoop", "CartesianProduct"))


def test_rescore_makes_its_keywords_once(spark):
    assert _plan(spark, "rescore").count("regexp_extract_all") == 2


def test_questions_are_picked_before_their_vectors(spark):
    from inkmill.plans import queries as Q

    d = "/root/testdata/sf0.001"
    live = Q._usable(spark, d).select("vec_row", "novel", "version", F.col("chunk_id").alias("id"), "embedding")
    assert Q._asked(spark, d, live)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_blocks_without_texts_are_those_with_them(spark):
    rng = random.Random(7)
    rows = [{"id": f"s{i}", "ch": i // 12, "start": 3 * (i % 12), "end": 3 * (i % 12) + 2, "text": "x" * rng.randint(0, 400) if i % 9 else None, "score": rng.random()} for i in range(60)]
    h = hits(spark, *rows).withColumn("scene_row", F.substring("id", 2, 9).cast("bigint"))
    want = X.assembled(h, rescore=False).drop("members")
    kept = X.within_budget(X.merged(X.deduplicated(X.sized(h))))
    assert "text" not in kept.columns and any(len(r.members) > 1 for r in kept.collect())
    got = X.with_texts(kept, h.select("scene_row", "text"))
    assert sorted(map(str, got.drop("size").select(*want.columns).collect())) == sorted(map(str, want.collect()))


FREE = ["answer_parse", "answer_repair", "refusals", "merge_adjacent", "context_stats", "context_blocks"]


@pytest.mark.parametrize("name", FREE)
def test_no_text_is_gathered_for_results_without_texts(spark, name):
    assert "text, text#" not in _plan(spark, name)


@pytest.mark.parametrize("name", ["context_full_text", "prompt_text"])
def test_texts_are_looked_up_for_blocks_alone(spark, name):
    assert "characters" not in _plan(spark, name)  # hits are scored before


def test_what_is_found_is_placed_by_one_join(spark):
    # What is found, the store, the questions, and the scenes by their keys and by their rows.
    assert _plan(spark, "dedupe").count("FileScan parquet") == 5
