"""Queries of the core operators: each takes (session, folder) and reads whole tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.operators import answers as A
from inkmill.operators import chapters as C
from inkmill.operators import context as X
from inkmill.operators import crawl as W
from inkmill.operators import paragraphs as P
from inkmill.operators import retrieval as R
from inkmill.operators import scenes as S
from inkmill.operators import validation as V
from inkmill.operators import vectors as E
from inkmill.sources.tables import materialise, table

INSTRUCTION = "Answer only from the context."
#: Every row whose id is divisible by this is a query against all rows.
ASK_EVERY = 100
TOP = 20


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def _id(frame: DataFrame) -> DataFrame:
    return frame.withColumnRenamed("doc", "doc_id")


def paragraphs(s, d):
    return _id(P.paragraphs(_docs(s, d)))


def paragraphs_ingest(s, d):
    return _id(P.paragraphs(_docs(s, d), "ingest"))


def markdown_types(s, d):
    return _id(P.typed(P.paragraphs(_docs(s, d)))).select("doc_id", "para_index", "para_type", "is_anchor")


def paragraph_kind(s, d):
    return _id(P.with_kind(P.typed(P.paragraphs(_docs(s, d))))).select("doc_id", "para_index", "kind")


def chapter_titles(s, d):
    p = P.paragraphs(_docs(s, d))
    return _id(p.where(C.is_title(F.col("content")))).select("doc_id", "para_index", "content")


def chapters_split(s, d):
    return _id(C.chapters(P.paragraphs(_docs(s, d))))


def chapters_ingest(s, d):
    return _id(C.chapters(P.paragraphs(_docs(s, d), "ingest"), "ingest"))


def segments(s, d):
    return _id(S.segments(_docs(s, d)))


def segments_base(s, d):
    return _id(S.segments(_docs(s, d), absorb=False))


def scenes(s, d):
    return _id(S.scenes(_docs(s, d)))


def scenes_ingest(s, d):
    return _id(S.scenes(_docs(s, d), "ingest", "v1-ingestion"))


def scene_limit(s, d):
    """The first three scenes of every document: the limit is the feature."""
    return _id(S.first_scenes(S.scenes(_docs(s, d)), 3)).select("doc_id", "chapter_index", "scene", "start_para", "end_para")


def _scenes(s, d) -> DataFrame:
    return table(s, d, "scenes")


def scene_prefix_context(s, d):
    w = Window.partitionBy("novel", "version", "chapter_index").orderBy("start_paragraph", "scene_row")
    return _scenes(s, d).select("scene_row", T.trim_ascii(F.coalesce(T.tail(F.lag("text").over(w), 200), F.lit(""))).alias("prefix_context"))


def scene_quality(s, d):
    body = F.regexp_replace("text", r"\n\z", "")
    return _scenes(s, d).select("scene_row", F.length("text").alias("n_chars"), F.when(F.substring(body, -1, 1).isin(S.END_SIGNS), 1.0).otherwise(0.7).alias("quality"), F.coalesce(F.length("text") > 1800, F.lit(False)).alias("can_be_split"))


def length_validation(s, d):
    return V.length_violations(_scenes(s, d).select(F.col("scene_row").alias("id"), "chapter_title", "word_count"), 200, 1000).withColumnRenamed("id", "scene_row")


def validation_summary(s, d):
    return V.summary(length_validation(s, d))


def scene_versions(s, d):
    return _scenes(s, d).groupBy("novel", "version").agg(F.count(F.lit(1)).alias("n_scenes"), F.countDistinct("id").alias("n_ids"), F.max("chapter_index").alias("last_chapter"))


def l2_normalize(s, d):
    e = table(s, d, "embeddings").where(E.is_usable(F.col("embedding"), 64))
    return e.select("vec_id", F.transform(E.normalised(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


def _store(s, d) -> DataFrame:
    return E.latest(table(s, d, "vector_store"), "chunk_id", "stored_at", "vec_row")


def vector_latest(s, d):
    return _store(s, d).select("vec_row", "chunk_id", "novel", "version")


def vector_count(s, d):
    return _store(s, d).groupBy("novel").agg(F.count(F.lit(1)).alias("n"), F.sum(E.is_usable(F.col("embedding"), 64).cast("int")).alias("n_usable"))


def vector_delete(s, d):
    """The store without version v1 rows."""
    return E.delete(table(s, d, "vector_store"), version="v1").select("vec_row", "chunk_id")


def vector_upsert(s, d):
    """All stored rows as the table, the scenes' chunks at their latest as the rows that come in."""
    rows = table(s, d, "vector_store").select("chunk_id", F.col("vec_row").alias("version_row"))
    old = rows.groupBy("chunk_id").agg(F.min("version_row").alias("version_row"))
    new = _scenes(s, d).where("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.max("scene_row").alias("version_row"))
    return E.upsert(old.where("chunk_id is not null"), new, "chunk_id")


def _usable(s, d) -> DataFrame:
    return _store(s, d).where(E.is_usable(F.col("embedding"), 64))


def vector_topk(s, d):
    """The 10 vectors most similar to the first usable one: a top-k report."""
    store = _usable(s, d).select(F.col("vec_row").alias("row"), "embedding")
    q = store.orderBy("row").limit(1).collect()
    return E.top_k(store, q[0].embedding if q else [], 10).select(F.col("row").alias("vec_row"), F.round("score", 6).alias("score"))


def vector_topk_filtered(s, d):
    """The same among the vectors of the work of the first usable one."""
    store = _usable(s, d).where("novel is not null")
    q = store.orderBy("vec_row").limit(1).select("embedding", "novel").collect()
    own = store.where(E.matching(novel=q[0].novel) if q else F.lit(False)).select(F.col("vec_row").alias("row"), "embedding")
    return E.top_k(own, q[0].embedding if q else [], 10).select(F.col("row").alias("vec_row"), F.round("score", 6).alias("score"))


def vector_topk_batch(s, d):
    store = table(s, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding")
    asked = store.where(F.col("row") % ASK_EVERY == 0).select(F.col("row").alias("query"), "embedding")
    return E.top_k_of_each(store, asked, TOP).select("query", F.col("row").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def embed_texts(s, d):
    texts = _scenes(s, d).select(F.col("scene_row").alias("doc"), "text")
    return E.hashed_embedding(texts).select(F.col("doc").alias("scene_row"), F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def tokenizer_ids(s, d):
    texts = _scenes(s, d).select(F.col("scene_row").alias("doc"), "text")
    seen = texts.select(F.explode(F.split("text", "")).alias("token")).where("token <> ''").distinct()
    vocabulary = seen.select("token", (F.ascii("token") + 200).alias("id"))
    return E.character_ids(texts, vocabulary).select(F.col("doc").alias("scene_row"), "ids", "n")


def hydrate_join(s, d):
    hits = _store(s, d).select("vec_row", "novel", "version", F.col("chunk_id").alias("id"))
    return R.hydrate(hits, _scenes(s, d)).select("vec_row", "scene_row", "chapter_index", "start_paragraph")


def hydrate_missing(s, d):
    hits = _store(s, d).select("vec_row", "novel", "version", F.col("chunk_id").alias("id"))
    return R.unhydrated(hits, _scenes(s, d)).select("vec_row", "id")


def _questions(s, d) -> DataFrame:
    return _docs(s, d).select(F.col("doc").alias("doc_id"), F.explode(T.lines(F.col("text"))).alias("question")).where("question <> ''")


def question_understanding(s, d):
    """Policy, role and chapter range of every line of the documents, counted by outcome per document."""
    a, _ = R.chapter_range(F.col("question"), F.lit(10))
    q = _questions(s, d).select("doc_id", R.answer_policy(F.col("question")).alias("policy"), R.asked_role(F.col("question")).alias("role"), a.alias("chapter"))
    return q.groupBy("doc_id", "policy", "role", "chapter").agg(F.count(F.lit(1)).alias("n"))


def keywords(s, d):
    k = table(s, d, "documents").select("doc_id", T.keywords(F.col("title")).alias("keywords"))
    return k.select("doc_id", "keywords", F.size("keywords").alias("n"))


def token_count(s, d):
    return _scenes(s, d).select("scene_row", T.token_count(F.col("text")).alias("tokens"), T.web_token_estimate(F.col("text")).alias("web_tokens"))


_OF_SCENE = ["scene_row", "id", "novel", "version", "chapter_title", "chapter_index", "start_paragraph", "end_paragraph", "text", "word_count", "metadata.characters"]


def _asked(s, d, live: DataFrame) -> DataFrame:
    """Every hundredth scene asks with its chapter's title and its chunk's vector, if that is live."""
    key = ["novel", "version", "id"]
    row = F.struct(F.col("scene_row").alias("query"), F.coalesce("chapter_title", F.lit("")).alias("question"))
    # Few rows, so each is picked by its key before the vectors come in; of several with one key the first asks.
    rows = _scenes(s, d).where(F.col("scene_row") % ASK_EVERY == 0).groupBy(*key).agg(F.min(row).alias("row"))
    return live.join(rows, key).select("row.query", "row.question", "embedding", "novel", "version")


def _all_questions(s, d) -> DataFrame:
    """The questions, also those whose scene has no vector."""
    return _scenes(s, d).where(F.col("scene_row") % ASK_EVERY == 0).select(F.col("scene_row").alias("query"), F.coalesce("chapter_title", F.lit("")).alias("question"))


def _hits(s, d, filtered: bool = False) -> DataFrame:
    # Both are read several times.
    live = materialise(_usable(s, d).select("vec_row", "novel", "version", F.col("chunk_id").alias("id"), "embedding"), "live")
    asked = materialise(_asked(s, d, live), "asked")
    asked = asked if filtered else asked.drop("novel", "version")
    return R.retrieved(live, _scenes(s, d).select(*_OF_SCENE), asked, TOP).withColumn("score", F.col("hit_score"))


def retrieve(s, d):
    return _hits(s, d).select("query", "vec_row", "scene_row", F.round("hit_score", 6).alias("score"))


def retrieve_filtered(s, d):
    """Within the work and version of the scene that asks."""
    return _hits(s, d, True).select("query", "vec_row", "scene_row", F.round("hit_score", 6).alias("score"))


def rescore(s, d):
    return X.rescored(_hits(s, d)).select("query", "scene_row", F.round("score", 6).alias("score"))


def dedupe(s, d):
    return X.deduplicated(X.rescored(_hits(s, d))).select("query", "id", F.round("score", 6).alias("score"))


def merge_adjacent(s, d):
    return X.merged(X.deduplicated(X.sized(X.rescored(_hits(s, d))))).select("query", "id", "chapter_index", "start_paragraph", "end_paragraph", "chunk_type", "merged_ids", F.col("size").alias("n_chars"))


def _text_free(s, d) -> DataFrame:
    """The blocks with the sizes of their texts: once hits are scored, no text is sent or sorted."""
    return X.within_budget(X.merged(X.deduplicated(X.sized(X.rescored(_hits(s, d))))))


def _blocks(s, d) -> DataFrame:
    """The blocks with their texts: those of the blocks alone are looked up, not those of all hits carried along."""
    return X.with_texts(materialise(_text_free(s, d), "blocks"), _scenes(s, d))


def context_blocks(s, d):
    return _text_free(s, d).select("query", "rank", "id", "chapter_index", "start_paragraph", "tokens", F.round("score", 6).alias("score"))


def context_full_text(s, d):
    return X.full_text(_blocks(s, d))


def context_stats(s, d):
    # Counted three times, so written once, without texts.
    hits = materialise(X.sized(X.rescored(_hits(s, d))).drop("characters", "vec_row", "scene_row"), "hits")
    joined = X.merged(X.deduplicated(hits))
    return X.stage_counts(hits, joined, X.within_budget(joined))


def prompt_text(s, d):
    """A prompt for every question; those without hits have an empty context."""
    return A.prompts(_blocks(s, d), INSTRUCTION, questions=_all_questions(s, d))


def refusals(s, d):
    """What is said to the questions without context."""
    return A.with_refusals(_all_questions(s, d), _text_free(s, d)).select("query", "answer.answer", F.size("answer.citations").alias("n_citations"), "answer.confidence")


def _written(blocks: DataFrame) -> DataFrame:
    """``(query, raw)``: texts about the questions and their blocks in the forms answers come in, one of seven a question."""
    item = F.struct(F.col("rank"), F.col("id").alias("chunkId"), F.round("score", 6).alias("score"))
    g = blocks.groupBy("query").agg(F.first("question").alias("question"), F.sort_array(F.collect_list(item)).alias("b"))
    cite = F.transform("b", lambda x: F.struct(x["chunkId"].alias("chunkId"), x["score"].alias("score")))
    q = F.col("question")
    forms = [
        F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(q.alias("answer"), cite.alias("citations"), F.lit(0.9).alias("confidence"))), F.lit("\n```\nDone.")),
        F.concat(F.to_json(F.struct(q.alias("answer"), cite.alias("citations"))), F.lit(" tail")),
        F.to_json(F.struct(F.struct(q.alias("description")).alias("response"), F.lit(7.0).alias("confidence"))),
        F.to_json(F.struct(q.alias("content"))),
        F.to_json(F.struct(q.alias("message"), cite.alias("citations"))),
        F.to_json(F.struct(F.col("b")[0]["chunkId"].alias("chunk_id"), q.alias("text"))),
        F.lit("nothing"),
    ]
    raw = F.element_at(F.array(*forms), (F.floor(F.col("query") / ASK_EVERY) % len(forms) + 1).cast("int"))
    return g.select("query", raw.alias("raw"))


def answer_parse(s, d):
    """Answers in several forms read back; why the others have none."""
    return _written(_text_free(s, d)).select("query", A.parsed(F.col("raw")).alias("a"), A.failure(F.col("raw")).alias("failure")).select("query", "a.answer", F.size("a.citations").alias("n_citations"), "a.confidence", "failure")


def answer_repair(s, d):
    """Answers read as they are, with nulls, and repaired."""
    a = F.from_json(F.regexp_extract("raw", r"(?s)(\{.*\})", 1), A.ANSWER)
    got = _written(_text_free(s, d)).where(F.contains("raw", F.lit("{"))).select("query", A.repaired(a).alias("a"))
    return got.select("query", "a.answer", F.size("a.citations").alias("n_citations"), "a.confidence")


def citation_check(s, d):
    """Of the chunks that answers cite, those among the question's blocks; every hundredth scene's chunk is cited as well."""
    # Read for the texts and for the check.
    blocks = materialise(_text_free(s, d).select("query", "question", "rank", "id", "score"), "blocks")
    own = _scenes(s, d).select(F.col("scene_row").alias("query"), "id")
    read = _written(blocks).select("query", A.parsed(F.col("raw")).alias("answer")).join(own, "query")
    extra = F.array(F.struct(F.col("id").alias("chunkId"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("double").alias("score")))
    answers = read.select("query", F.struct(F.concat("answer.citations", extra).alias("citations")).alias("answer"))
    return A.checked_citations(answers, blocks).select("query", "n", "id", F.round("score", 6).alias("score"))


def rule_routing(s, d):
    pages = table(s, d, "crawl_chapters").select("crawl_id", "url")
    return W.routed(pages, table(s, d, "site_rules")).select("crawl_id", "rule_order", "domain")


def crawl_merge(s, d):
    return W.merged_works(table(s, d, "crawl_chapters"))


NAMES = """paragraphs paragraphs_ingest markdown_types paragraph_kind chapter_titles chapters_split chapters_ingest segments segments_base scenes scenes_ingest scene_limit scene_prefix_context scene_quality
length_validation validation_summary scene_versions l2_normalize vector_latest vector_count vector_delete vector_upsert vector_topk vector_topk_filtered vector_topk_batch embed_texts tokenizer_ids hydrate_join
hydrate_missing question_understanding keywords token_count retrieve retrieve_filtered rescore dedupe merge_adjacent context_blocks context_full_text context_stats prompt_text refusals answer_parse answer_repair citation_check rule_routing crawl_merge""".split()
QUERIES = {n: globals()[n] for n in NAMES}
