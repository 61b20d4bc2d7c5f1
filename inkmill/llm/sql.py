"""The same results in DuckDB's SQL, where SQL can say it."""

_P1 = r"""
with site as (
  select crawl_id, nullif(regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^(?:www|m)\.', ''), '') as site
  from crawl_chapters),
doc as (select scene_row, site, text from scenes join site using (crawl_id) where site is not null),
line as (
  select scene_row, site, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no
  from doc where text is not null),
norm as (
  select scene_row, site, line_no, regexp_replace(line, '[\s\x0b\x1c-\x1f\x{85}\p{Z}\p{Nd}\p{Cf}]', '', 'g') as line from line),
total as (select site, count(*) as documents from doc group by site),
freq as (
  select n.site, n.line from norm n join total t using (site) where n.line <> ''
  group by n.site, n.line, t.documents
  having count(distinct scene_row) >= 4 and count(distinct scene_row) >= 0.04 * t.documents),
cases as (select distinct scene_row, line_no::int as line_no from norm join freq using (site, line))
"""

# Exact nearest rows; the index is as good as exact where a collection is one cell, as at scale 0.01.
_P4 = """
with live as (select vec_row, embedding::double[] as e from vector_store where chunk_id is not null qualify row_number() over (partition by chunk_id order by stored_at desc nulls last, vec_row desc) = 1),
fine as (select vec_row, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from live where len(e) = 64 and len(list_filter(e, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(e, lambda x: x <> 0)) > 0),
near as (select a.vec_row as a, b.vec_row as b from fine a join fine b on a.vec_row <> b.vec_row
  qualify row_number() over (partition by a.vec_row order by round(list_dot_product(a.u, b.u), 12) desc, b.vec_row) <= 5)
select distinct least(a, b) as row_a, greatest(a, b) as row_b from near"""

ORACLES = {
    "p4_found": _P4,
    "p1_found": _P1 + "select scene_row, line_no from cases",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p1_clean": _P1
    + """, gone as (select scene_row, list(line_no) as gone from cases group by scene_row)
select s.scene_row,
  case when g.gone is null then s.text
  else array_to_string([p.x for p in list_transform(string_split(s.text, chr(10)), lambda x, i: {'x': x, 'i': i - 1}) if not list_contains(g.gone, p.i)], chr(10)) end as text,
  coalesce(len(g.gone), 0)::int as removed
from scenes s left join gone g using (scene_row)""",
}
