"""From questions to scenes: understanding, hydration of hits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.operators.vectors import top_k_of_each
from inkmill.sources.tables import materialise

# Words that decide the kind of answer, by falling priority.
UNSUPPORTED = ["写代码", "编程", "java", "python", "c++", "天气", "股票", "汇率", "现实", "今天", "新闻", "哈利波特", "三体", "金庸", "翻译", "英语", "总结全文"]
CHARACTER = ["谁", "关系", "性格", "外貌", "长相", "身份", "父亲", "母亲", "师傅", "徒弟", "主角", "配角", "妻子", "丈夫", "兄弟", "姐妹"]
TIMELINE = ["什么时候", "时间", "多久", "哪一年", "何时", "几点", "年代", "岁月", "之前", "之后", "顺序", "先", "后"]
LOCATION = ["在哪里", "在哪", "地点", "位置", "去哪", "位于", "何处", "城市", "地方", "方位"]
SAID, LAST_CHAPTER, THIS_CHAPTER = "他说了什么", "上一章", "这一章"


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def answer_policy(question: Column) -> Column:
    """UNSUPPORTED, CHARACTER, TIMELINE, LOCATION or FACT; null and blank questions are UNSUPPORTED."""
    q = F.lower(F.trim(question))
    kinds = F.when(F.coalesce(q, F.lit("")).rlike(r"^\s*$") | _any(q, UNSUPPORTED), "UNSUPPORTED")
    return kinds.when(_any(q, CHARACTER), "CHARACTER").when(_any(q, TIMELINE), "TIMELINE").when(_any(q, LOCATION), "LOCATION").otherwise("FACT")


def chapter_range(question: Column, current: Column) -> tuple[Column, Column]:
    """First and last chapter a question names relative to the current one, null if none; nothing comes before 0."""
    at = F.when(F.contains(question, F.lit(LAST_CHAPTER)), F.greatest(current - 1, F.lit(0))).when(F.contains(question, F.lit(THIS_CHAPTER)), current)
    return at, at


def asked_role(question: Column) -> Column:
    return F.when(F.contains(question, F.lit(SAID)), "dialogue")


def plain_name(name: Column, anywhere: bool = True) -> Column:
    """A work's name without ``.txt``, anywhere or only at its end."""
    return F.regexp_replace(name, r"\.txt" if anywhere else r"\.txt$", "")


_KEY = ["novel", "version", "id"]


def hydrate(hits: DataFrame, scenes: DataFrame) -> DataFrame:
    """Hits (``novel, version, id`` and more) with the scene of that key; hits without one, or with a null key, drop out.

    Of several scenes with one key the one with the smallest ``scene_row`` (unique) counts. Rows are picked by their
    keys alone, so the texts of all other scenes stay out of the shuffle.
    """
    asked = hits.select(*_KEY).distinct()
    first = scenes.select(*_KEY, "scene_row").join(asked, _KEY, "left_semi").groupBy(*_KEY).agg(F.min("scene_row").alias("scene_row"))
    return hits.join(first, _KEY).join(scenes.drop(*_KEY), "scene_row")


def unhydrated(hits: DataFrame, scenes: DataFrame) -> DataFrame:
    """The hits ``hydrate`` drops."""
    return hits.join(scenes.select("novel", "version", "id"), ["novel", "version", "id"], "left_anti")


def retrieved(store: DataFrame, scenes: DataFrame, questions: DataFrame, k: int = 5, size: int = 64) -> DataFrame:
    """The ``k`` most similar scenes of each question, with ``query, question, hit_score`` and the columns of the scene.

    ``store`` has ``vec_row, novel, version, id, embedding``; ``questions`` has ``query, question, embedding`` and may have
    ``novel`` and ``version``, which limit the search before the best are taken (null or blank ones do not). Vectors
    without a scene drop out after it; a question without hits has no row. The search runs once, here; its result is small.
    """
    within = tuple(c for c in ("novel", "version") if c in questions.columns)
    asked = questions.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in within})
    rows = store.select(F.col("vec_row").alias("row"), "embedding", *within)
    found = materialise(top_k_of_each(rows, asked, k, size, within).select("query", F.col("row").alias("vec_row"), F.col("score").alias("hit_score")), "found")
    # What is found is joined by narrow rows, once; of several scenes with one key the first counts, as in ``hydrate``.
    first = scenes.select(*_KEY, "scene_row").groupBy(*_KEY).agg(F.min("scene_row").alias("scene_row"))
    placed = found.join(store.select("vec_row", *_KEY), "vec_row").join(first, _KEY).drop(*_KEY)
    # Texts come last, so they are shuffled once.
    return placed.join(questions.select("query", "question"), "query").join(scenes, "scene_row")


def within_chapters(scenes: DataFrame, first: int | None = None, last: int | None = None, role: str | None = None) -> DataFrame:
    """Optional filters by chapter range and role; what is None does not filter."""
    for on, cond in ((first, F.col("chapter_index") >= F.lit(first)), (last, F.col("chapter_index") <= F.lit(last)), (role, F.col("metadata.role") == F.lit(role))):
        scenes = scenes.where(cond) if on is not None else scenes
    return scenes
