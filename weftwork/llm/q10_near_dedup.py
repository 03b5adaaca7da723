"""op10: classes of near-duplicate documents, by shingles of two words."""

from weftwork.llm import near_dedup
from weftwork.llm.common import table


def op10_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"), size=2, similarity=80)


ORACLE = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + least(len(w), 2) - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 2) + 2)) as i from worded where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as key from shingles group by 1
), owners as (
  select key, min(doc_id) as doc_id, any_value(n) as n from sizes group by 1
), own as (
  select o.doc_id, o.n, s.g from owners o join shingles s using (doc_id)
), links as (
  select a.doc_id as a, b.doc_id as b
  from own a join own b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways as (
  select a, b from links union all select b, a from links
), reached as (
  select doc_id as a, doc_id as b from owners
  union
  select r.a, l.b from reached r join both_ways l on r.b = l.a
), least_of as (
  select a, min(b) as component_id from reached group by 1
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept
from worded d left join sizes s on s.doc_id = d.doc_id left join owners o on o.key = s.key left join least_of c on c.a = o.doc_id
"""
