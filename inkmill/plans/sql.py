"""The same results in DuckDB's SQL, where SQL can say it."""

# Fixed values, stated here again so that a change of an operator's own shows: patterns of lines and titles, word lists.
_FENCE, _HEADER, _LIST_ITEM, _QUOTE, _SPEECH = r"^\s*```", r"^#{1,6}\s+", r"^(\s*[-*+]|\s*\d+\.)\s+", r"^>\s+", r'["“].*["”]'
_SPLIT_TITLE = r"^(?:\s*第[0-9零一二三四五六七八九十百千两]+[章回节卷].*|\s*Chapter\s*\d+.*)$"
_INGEST_TITLE = r"^\s*第\s*[0-9零一二三四五六七八九十百千万]+ *[章回].*$"
_PREFACE = "序章/前言"
_UNSUPPORTED = "写代码 编程 java python c++ 天气 股票 汇率 现实 今天 新闻 哈利波特 三体 金庸 翻译 英语 总结全文".split()
_CHARACTER = "谁 关系 性格 外貌 长相 身份 父亲 母亲 师傅 徒弟 主角 配角 妻子 丈夫 兄弟 姐妹".split()
_TIMELINE = "什么时候 时间 多久 哪一年 何时 几点 年代 岁月 之前 之后 顺序 先 后".split()
_LOCATION = "在哪里 在哪 地点 位置 去哪 位于 何处 城市 地方 方位".split()

_WS = r"[\t\n\x0b\f\r\x1c-\x1f \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"


def _lines(strip: str) -> str:
    ends = f"^(?:{strip})+|(?:{strip})+$"
    return rf"""
with cut as (select doc_id, regexp_split_to_array(text, '\r\n|\n|\r') as x from documents where text is not null),
line as (select doc_id, case when x[-1] = '' then x[:-2] else x end as x from cut),
para as (select doc_id, unnest(range(len(x)))::int as para_index, regexp_replace(unnest(x), '{ends}', '', 'g') as content from line)
"""


_SPLIT, _INGEST = _lines(_WS), _lines(r"[\x00-\x20]")
_TYPED = (
    _SPLIT
    + f""", fence as (select *, regexp_matches(content, '{_FENCE}') as f from para),
inside as (select *, coalesce(sum(f::int) over (partition by doc_id order by para_index rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as i from fence),
typed as (select doc_id, para_index, content, case when f or i then 'CODE_BLOCK' when regexp_matches(content, '{_HEADER}') then 'HEADER' when regexp_matches(content, '{_LIST_ITEM}') then 'LIST_ITEM'
  when regexp_matches(content, '{_QUOTE}') then 'QUOTE' else 'TEXT' end as para_type from inside)
"""
)


def _chapters(base: str, title: str, drop_first: bool) -> str:
    return (
        base
        + f""", t as (select *, {title} as is_title from para),
isle as (select *, sum(is_title::int) over (partition by doc_id order by para_index) as g from t),
c as (select *, {'g' if drop_first else 'g + (min(g) over (partition by doc_id) = 0)::int'} as chapter_index from isle {'where g > 0' if drop_first else ''})
select doc_id, chapter_index::int as chapter_index, case when arg_min(is_title, para_index) then arg_min(content, para_index) else '{_PREFACE}' end as chapter_title,
  min(para_index) as start_para, max(para_index) as end_para from c group by doc_id, chapter_index"""
    )


_TITLE = f"(content <> '' and length(content) <= 50 and regexp_matches(content, '{_SPLIT_TITLE}'))"
_ANY = lambda words: "(" + " or ".join(f"contains(q, '{w}')" for w in words) + ")"
_LATEST = "latest as (select * from vector_store where chunk_id is not null qualify row_number() over (partition by chunk_id order by stored_at desc nulls last, vec_row desc) = 1)"
_FINE = "coalesce(len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false)"
_COS = "round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9)"
_SCENE = "one as (select * from scenes qualify row_number() over (partition by novel, version, id order by scene_row) = 1)"
_HITS = f"""
with {_LATEST}, {_SCENE},
live as (select vec_row, novel, version, chunk_id as id, embedding::double[] as e from latest where {_FINE}),
askable as (select * from scenes where scene_row % 100 = 0 qualify row_number() over (partition by novel, version, id order by scene_row) = 1),
asked as (select s.scene_row as query, coalesce(s.chapter_title, '') as question, l.novel, l.version, l.e from live l join askable s using (novel, version, id)),
pairs as (select b.query, b.question, a.vec_row, a.novel, a.version, a.id, {_COS} as score from live a, asked b),
top as (select * from pairs qualify row_number() over (partition by query order by score desc, vec_row) <= 20),
hits as (select t.query, t.question, t.vec_row, s.scene_row, s.id, s.novel, s.version, s.chapter_title, s.chapter_index, s.start_paragraph, s.end_paragraph, s.text, s.word_count, s.metadata.characters as characters, t.score as hit_score
  from top t join one s using (novel, version, id)),
words as (select *, list_concat(regexp_extract_all(question, '[a-zA-Z0-9]+'), flatten([case when length(r) >= 2 then [substr(r, i, 2) for i in range(1, length(r))] when length(question) <= 2 then [r] else [] end
  for r in regexp_extract_all(question, '[一-龥]+')])) as kw from hits),
scored as (select *, round(greatest(0.6::double * hit_score
  + 0.2::double * least(0.1::double * len(list_filter(kw, lambda k: contains(coalesce(text, ''), k))), 1.0::double)
  + 0.2::double * least(0.1::double * coalesce(list_sum([len(list_filter(kw, lambda k: contains(c, k) or contains(k, c))) for c in coalesce(characters, [])]), 0), 1.0::double)
  - 0.0001::double * greatest(length(coalesce(text, '')) - 2000, 0), 0.0::double), 9) as score from words),
dedup as (select * from scored qualify row_number() over (partition by query, coalesce(id, chapter_index || '_' || start_paragraph) order by score desc, chapter_index, start_paragraph, id) = 1)
"""

ORACLES = {
    "paragraphs": _SPLIT + "select doc_id, para_index, content, content = '' as is_empty from para",
    "paragraphs_ingest": _INGEST + "select doc_id, para_index, content, content = '' as is_empty from para",
    "markdown_types": _TYPED + "select doc_id, para_index, para_type, para_type in ('CODE_BLOCK', 'HEADER') as is_anchor from typed",
    "paragraph_kind": _TYPED + f"""select doc_id, para_index, case when para_type in ('CODE_BLOCK', 'HEADER') then para_type when regexp_matches(content, '{_SPEECH}') then 'DIALOGUE' else 'NARRATION' end as kind from typed""",
    "chapter_titles": _SPLIT + f"select doc_id, para_index, content from para where {_TITLE}",
    "chapters_split": _chapters(_SPLIT, _TITLE, False),
    "chapters_ingest": _chapters(_INGEST, f"regexp_matches(content, '{_INGEST_TITLE}')", True),
    "scene_prefix_context": r"""
with p as (select scene_row, coalesce(lag(text) over (partition by novel, version, chapter_index order by start_paragraph nulls first, scene_row), '') as t from scenes)
select scene_row, regexp_replace(case when length(t) <= 200 then t else right(t, 200) end, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') as prefix_context from p""",
    "scene_quality": r"""
select scene_row, length(text)::int as n_chars, case when right(regexp_replace(text, '\n$', ''), 1) in ('。', '”', '！', '？', '.', '}') then 1.0::double else 0.7::double end as quality,
  coalesce(length(text) > 1800, false) as can_be_split from scenes""",
    "length_validation": """
with v as (select scene_row, coalesce(word_count, 0) as n, coalesce(chapter_title, '-') as t from scenes)
select scene_row, case when n = 0 then 'error' else 'warning' end as severity,
  case when n = 0 then 'empty' when n < 200 then 'too short: ' || n || ' < 200, chapter ' || t else 'too long: ' || n || ' > 1000, chapter ' || t end as message from v where n < 200 or n > 1000""",
    "validation_summary": "select case when coalesce(word_count, 0) = 0 then 'error' else 'warning' end as severity, count(*) as n from scenes where coalesce(word_count, 0) < 200 or word_count > 1000 group by 1",
    "scene_versions": "select novel, version, count(*) as n_scenes, count(distinct id) as n_ids, max(chapter_index) as last_chapter from scenes group by novel, version",
    "l2_normalize": f"""
with v as (select vec_id, embedding::double[] as e from embeddings where {_FINE})
select vec_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6)) as unit from v""",
    "vector_latest": f"with {_LATEST} select vec_row, chunk_id, novel, version from latest",
    "vector_count": f"with {_LATEST} select novel, count(*) as n, sum({_FINE}::int)::bigint as n_usable from latest group by novel",
    "vector_delete": "select vec_row, chunk_id from vector_store where version is distinct from 'v1'",
    "vector_upsert": """
with old as (select chunk_id, min(vec_row) as version_row from vector_store where chunk_id is not null group by 1),
new as (select id as chunk_id, max(scene_row) as version_row from scenes where id is not null group by 1)
select chunk_id, version_row from new union all select chunk_id, version_row from old where chunk_id not in (select chunk_id from new)""",
    "vector_topk": f"""
with {_LATEST}, live as (select vec_row, embedding::double[] as e from latest where {_FINE}), ask as (select e from live order by vec_row limit 1)
select vec_row, round(s, 6) as score from (select a.vec_row, {_COS} as s from live a, ask b order by s desc, vec_row limit 10)""",
    "vector_topk_filtered": f"""
with {_LATEST}, live as (select vec_row, novel, embedding::double[] as e from latest where {_FINE} and novel is not null), ask as (select e, novel from live order by vec_row limit 1)
select vec_row, round(s, 6) as score from (select a.vec_row, {_COS} as s from live a join ask b using (novel) order by s desc, vec_row limit 10)""",
    "vector_topk_batch": f"""
with live as (select vec_id, embedding::double[] as e from embeddings where {_FINE}),
p as (select b.vec_id as query, a.vec_id, {_COS} as s from live a, (select * from live where vec_id % 100 = 0) b)
select query, vec_id, row_number() over (partition by query order by s desc, vec_id)::int as rank, round(s, 6) as score from p qualify rank <= 20""",
    "embed_texts": """
with t as (select scene_row, text from scenes where length(text) > 1),
g as (select scene_row, unnest([substr(text, i, 2) for i in range(1, length(text))]) as pair from t),
b as (select scene_row, (('0x' || substr(md5(pair), 1, 8))::bigint % 64)::int as bucket, count(*)::double as n from g group by all),
v as (select scene_row, map_from_entries(list((bucket, n))) as m, sqrt(sum(n * n)) as z from b group by scene_row)
select scene_row, [round(coalesce(m[i], 0.0) / z, 6) for i in range(64)] as embedding from v""",
    "tokenizer_ids": """
select scene_row, list_concat(list_concat([101], [(ascii(c) + 200)::int for c in string_split(text[:510], '')]), [102]) as ids, (least(length(text), 510) + 2)::int as n from scenes where text <> ''
union all select scene_row, [101, 102] as ids, 2 as n from scenes where text = ''""",
    "hydrate_join": f"with {_LATEST}, {_SCENE} select l.vec_row, s.scene_row, s.chapter_index, s.start_paragraph from latest l join one s on l.novel = s.novel and l.version = s.version and l.chunk_id = s.id",
    "hydrate_missing": f"with {_LATEST} select vec_row, chunk_id as id from latest l where not exists (select 1 from scenes s where l.novel = s.novel and l.version = s.version and l.chunk_id = s.id)",
    "question_understanding": rf"""
with cut as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) as question from documents),
k as (select doc_id, question, lower(trim(question, ' ')) as q from cut where question <> ''),
a as (select doc_id, case when regexp_matches(q, '^\s*$') or {_ANY(_UNSUPPORTED)} then 'UNSUPPORTED' when {_ANY(_CHARACTER)} then 'CHARACTER' when {_ANY(_TIMELINE)} then 'TIMELINE' when {_ANY(_LOCATION)} then 'LOCATION' else 'FACT' end as policy,
  case when contains(question, '他说了什么') then 'dialogue' end as role, case when contains(question, '上一章') then 9 when contains(question, '这一章') then 10 end as chapter from k)
select doc_id, policy, role, chapter, count(*) as n from a group by all""",
    "keywords": """
with w as (select doc_id, case when title is null then [] else list_concat(regexp_extract_all(title, '[a-zA-Z0-9]+'), flatten([case when length(r) >= 2 then [substr(r, i, 2) for i in range(1, length(r))]
  when length(title) <= 2 then [r] else [] end for r in regexp_extract_all(title, '[一-龥]+')])) end as keywords from documents)
select doc_id, keywords, len(keywords)::int as n from w""",
    "token_count": """
with n as (select scene_row, coalesce(length(text), 0) as n, coalesce(len(regexp_extract_all(text, '[一-龥]')), 0) as han from scenes)
select scene_row, ceil(n * 1.5::double)::int as tokens, ceil(han * 0.6::double + (n - han) * 0.3::double)::int as web_tokens from n""",
    "retrieve": _HITS + "select query, vec_row, scene_row, round(hit_score, 6) as score from hits",
    "retrieve_filtered": _HITS.replace("from live a, asked b)", "from live a join asked b using (novel, version))").replace("a.vec_row, a.novel, a.version, a.id", "a.vec_row, novel, version, a.id") + "select query, vec_row, scene_row, round(hit_score, 6) as score from hits",
    "rescore": _HITS + "select query, scene_row, round(score, 6) as score from scored",
    "dedupe": _HITS + "select query, id, round(score, 6) as score from dedup",
    "rule_routing": """
select c.crawl_id, arg_min(r.rule_order, r.rule_order) as rule_order, arg_min(r.domain, r.rule_order) as domain
from crawl_chapters c left join site_rules r on contains(c.url, r.domain) and r.domain <> '' group by c.crawl_id""",
    "crawl_merge": r"""
with last as (select * from crawl_chapters where novel is not null qualify row_number() over (partition by novel, chapter_index order by coalesce(success, false) desc, crawl_id desc) = 1)
select novel, regexp_replace(novel, '[\\/:*?"<>|]', '_', 'g') || '.txt' as file_name,
  string_agg(coalesce(title, '') || chr(10) || chr(10) || case when coalesce(success, false) then coalesce(content, '') else '[Download Failed]' end || chr(10) || chr(10), '' order by chapter_index nulls first) as text,
  count(*) as n_chapters, sum((not coalesce(success, false))::int)::bigint as n_failed from last group by novel""",
}


def _folded(base: str, absorb: bool, profile: str) -> str:
    """Paragraphs with kind, chapter and the segment a recursive fold gives them."""
    ingest = profile == "ingest"
    title = f"regexp_matches(content, '{_INGEST_TITLE}')" if ingest else _TITLE
    types = "select doc_id, para_index, content, 'TEXT' as para_type from para" if ingest else "select * from typed"
    anchor = "p.kind in ('HEADER', 'CODE_BLOCK')"
    plain = "p.kind <> f.opened or f.size > 800"
    full = f"""case when {anchor} then p.kind = 'HEADER' or p.para_type <> f.last_type
      else (p.kind <> f.opened and not (f.last_kind in ('NARRATION', 'DIALOGUE') and ((f.opened = 'NARRATION' and p.kind = 'DIALOGUE' and f.last_size < 50) or (f.opened = 'DIALOGUE' and p.kind = 'NARRATION' and p.size < 50)))) or f.size > 800 end"""
    return (
        base.replace("with cut", "with recursive cut")
        + f""", titled as (select *, {title} as is_title from ({types})),
isle as (select *, sum(is_title::int) over (partition by doc_id order by para_index) as g from titled),
chap as (select *, ({'g' if ingest else 'g + (min(g) over (partition by doc_id) = 0)::int'})::int as chapter_index from isle {'where g > 0' if ingest else ''}),
named as (select doc_id, chapter_index, case when arg_min(is_title, para_index) then arg_min(content, para_index) else '{_PREFACE}' end as chapter_title from chap group by all),
p as (select doc_id, chapter_index, para_index, content, para_type, length(content) as size,
  case when para_type in ('HEADER', 'CODE_BLOCK') then para_type when regexp_matches(content, '{_SPEECH}') then 'DIALOGUE' else 'NARRATION' end as kind,
  row_number() over (partition by doc_id, chapter_index order by para_index) as rn from chap where content <> ''),
f as (
  select doc_id, chapter_index, para_index, rn, kind as opened, size, kind as last_kind, para_type as last_type, size as last_size, 0 as segment from p where rn = 1
  union all
  select p.doc_id, p.chapter_index, p.para_index, p.rn, case when {full if absorb else plain} then p.kind else f.opened end, case when {full if absorb else plain} then p.size else f.size + p.size end,
    p.kind, p.para_type, p.size, f.segment + ({full if absorb else plain})::int
  from f join p on p.doc_id = f.doc_id and p.chapter_index = f.chapter_index and p.rn = f.rn + 1),
seg as (select p.doc_id, p.chapter_index, f.segment, arg_min(p.kind, p.para_index) as seg_type, min(p.para_index) as start_para, max(p.para_index) as end_para, sum(p.size)::bigint as seg_len, count(*) as n_paras
  from p join f using (doc_id, chapter_index, para_index) group by all)
"""
    )


def _scene_sql(base: str, profile: str, version: str) -> str:
    most = "(case when f2.code then 800 when f2.talk / f2.held > 0.5 then 1500 else 1200 end)"
    cut = f"(f2.len >= {most})"
    return (
        _folded(base, True, profile)
        + f""", f2 as (
  select doc_id, chapter_index, segment, 0 as scene, seg_len as len, 1 as held, (seg_type = 'DIALOGUE')::int as talk, seg_type = 'CODE_BLOCK' as code from seg where segment = 0
  union all
  select s.doc_id, s.chapter_index, s.segment, f2.scene + {cut}::int, case when {cut} then 0 else f2.len end + s.seg_len, case when {cut} then 0 else f2.held end + 1,
    case when {cut} then 0 else f2.talk end + (s.seg_type = 'DIALOGUE')::int, (case when {cut} then false else f2.code end) or s.seg_type = 'CODE_BLOCK'
  from f2 join seg s on s.doc_id = f2.doc_id and s.chapter_index = f2.chapter_index and s.segment = f2.segment + 1),
body as (select p.doc_id, p.chapter_index, f2.scene, min(p.para_index) as start_para, max(p.para_index) as end_para, string_agg(p.content, chr(10) order by p.para_index) || chr(10) as text
  from p join f using (doc_id, chapter_index, para_index) join f2 using (doc_id, chapter_index, segment) group by all),
talk as (select f2.doc_id, f2.chapter_index, f2.scene, 1 - sum((seg_type = 'DIALOGUE')::int)::double / count(*) as density_score from f2 join seg using (doc_id, chapter_index, segment) group by all),
before as (select *, coalesce(lag(text) over (partition by doc_id, chapter_index order by scene), '') as t from body),
scene as (select substr(sha256(doc_id || '|{version}|' || chapter_index || '|' || start_para), 1, 24) as id, doc_id, chapter_index, scene::int as scene, start_para, end_para, text, length(text)::int as word_count, length(text) > 1800 as can_split, density_score,
  case when substr(text, length(text) - 1, 1) in ('。', '”', '！', '？', '.', '}}') then 1.0::double else 0.7::double end as quality_score,
  regexp_replace(case when length(t) <= 200 then t else right(t, 200) end, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') as prefix_context, '{version}' as version, chapter_title
  from before join talk using (doc_id, chapter_index, scene) join named using (doc_id, chapter_index))
"""
    )


_SEGMENT = "select doc_id, chapter_index, segment, seg_type, start_para, end_para, seg_len, n_paras from seg"
_BLOCKS = (
    _HITS.replace("\nwith latest", "\nwith recursive latest")
    + r""", o as (select *, novel || '|' || version as work, length(coalesce(text, '')) as size, row_number() over (partition by query order by novel || '|' || version, chapter_index, start_paragraph, id) as rn from dedup),
m as (
  select query, rn, work, chapter_index, end_paragraph, size, 0 as g from o where rn = 1
  union all
  select o.query, o.rn, o.work, o.chapter_index, o.end_paragraph,
    case when n.join then m.size + 7 + o.size else o.size end, m.g + (not n.join)::int
  from m join o on o.query = m.query and o.rn = m.rn + 1,
    lateral (select o.work = m.work and o.chapter_index = m.chapter_index and o.start_paragraph - m.end_paragraph between -5 and 2 and ceil(1.5::double * (m.size + 7 + o.size)) <= 900 as join) n),
mg as (select o.query, m.g, any_value(o.question) as question, list({'s': o.start_paragraph, 'id': o.id, 'e': o.end_paragraph, 't': coalesce(o.text, '')} order by o.start_paragraph, o.id, o.end_paragraph, o.text) as x, min(o.chapter_index) as chapter_index,
  min(o.chapter_title) as chapter_title, max(o.score) as score from o join m using (query, rn) group by o.query, m.g),
merged as (select query, question, x[1].id as id, chapter_index, chapter_title, x[1].s as start_paragraph, x[-1].e as end_paragraph, array_to_string([p.t for p in x], chr(10) || chr(10) || '---' || chr(10) || chr(10)) as text,
  case when len(x) > 1 then 'merged_scene' else 'scene' end as chunk_type, [p.id for p in x] as merged_ids, score from mg),
c as (select *, ceil(length(text) * 1.5::double)::int as tokens, row_number() over (partition by query order by score desc, id, chapter_index, start_paragraph) as rn from merged),
b as (
  select query, rn, (tokens <= 3000) as take, case when tokens <= 3000 then tokens else 0 end as used, (tokens <= 3000)::int as taken from c where rn = 1
  union all
  select c.query, c.rn, n.fits, b.used + case when n.fits then c.tokens else 0 end, b.taken + n.fits::int from b join c on c.query = b.query and c.rn = b.rn + 1,
    lateral (select b.taken < 5 and b.used + c.tokens <= 3000 as fits) n),
block as (select c.*, row_number() over (partition by query order by rn)::int as rank from c join b using (query, rn) where b.take)
"""
)
_IN_ORDER = "order by chapter_index, start_paragraph, id"
_ALL = ", question as (select scene_row as query, coalesce(chapter_title, '') as question from scenes where scene_row % 100 = 0)\n"
_WRITTEN = _BLOCKS + ", w as (select query, any_value(question) as question, count(*)::int as n, (query // 100) % 7 as form from block group by query)\n"
ORACLES |= {
    "segments": _folded(_TYPED, True, "split") + _SEGMENT,
    "segments_base": _folded(_TYPED, False, "split") + _SEGMENT,
    "scenes": _scene_sql(_TYPED, "split", "v1") + "select * from scene",
    "scenes_ingest": _scene_sql(_INGEST, "ingest", "v1-ingestion") + "select * from scene",
    "scene_limit": _scene_sql(_TYPED, "split", "v1") + "select doc_id, chapter_index, scene, start_para, end_para from scene qualify row_number() over (partition by doc_id order by chapter_index, start_para) <= 3",
    "merge_adjacent": _BLOCKS + "select query, id, chapter_index, start_paragraph, end_paragraph, chunk_type, merged_ids, length(text)::int as n_chars from merged",
    "context_blocks": _BLOCKS + "select query, rank, id, chapter_index, start_paragraph, tokens, round(score, 6) as score from block",
    "context_full_text": _BLOCKS + f"select query, string_agg('[' || id || '] ' || text || chr(10), '' {_IN_ORDER}) as context, sum(tokens)::bigint as total_tokens, count(*) as n_blocks from block group by query",
    "context_stats": _BLOCKS
    + """, h as (select query, count(*) as original, count(distinct coalesce(id, chapter_index || '_' || start_paragraph)) as deduplicated from hits group by query),
j as (select query, count(*) as merged from merged group by query),
k as (select query, count(*) as n, sum(tokens)::bigint as total from block group by query)
select h.query, original, deduplicated, merged, coalesce(n, 0) as final, coalesce(total, 0) as total_tokens, merged - coalesce(n, 0) as dropped from h join j using (query) left join k using (query)""",
    "prompt_text": _BLOCKS
    + _ALL
    + f""", n as (select *, row_number() over (partition by query {_IN_ORDER}) as i from block),
text as (select query, string_agg('[Block ' || i || ' - ' || id || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by i) as context from n group by query)
select query, question, '=== System Instruction ===' || chr(10) || 'Answer only from the context.' || chr(10) || chr(10) || '=== Context ===' || chr(10)
  || coalesce(context, '') || chr(10) || chr(10) || '=== User Question ===' || chr(10) || question as prompt from question left join text using (query)""",
    "refusals": _BLOCKS + _ALL + "select query, 'I cannot find any relevant information in the provided context to answer your question.' as answer, 0 as n_citations, 0.0::double as confidence from question where query not in (select query from block)",
    "answer_parse": _WRITTEN
    + """select query, case when form < 5 then question end as answer, case when form in (0, 1, 4) then n when form < 5 then 0 end as n_citations,
  case form when 0 then 0.9::double when 2 then 7.0::double when 5 then null when 6 then null else 0.8::double end as confidence, case form when 5 then 'chunk' when 6 then 'no answer' end as failure from w""",
    "answer_repair": _WRITTEN
    + """select query, case when form < 2 then question else '（未生成回答）' end as answer, case when form in (0, 1, 4) then n else 0 end as n_citations,
  case form when 0 then 0.9::double when 2 then 7.0::double else 0.0::double end as confidence from w where form < 6""",
    "citation_check": _WRITTEN
    + """, cited as (select query, (rank - 1)::int as n, id from block where (query // 100) % 7 in (0, 1, 4)
  union all select w.query, case when form in (0, 1, 4) then n else 0 end as n, s.id from w join scenes s on s.scene_row = w.query where form < 5 and s.id is not null)
select c.query, c.n, c.id, round(b.score, 6) as score from cited c join block b on b.query = c.query and b.id = c.id""",
}
