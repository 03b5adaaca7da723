"""op7: benchmark decontamination over all documents."""

from pyspark.sql import functions as F

from weftwork.llm import decontaminate
from weftwork.llm.common import table


def op7_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


ORACLE = r"""
with lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from items where len(w) > 0)
), places as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
  from lowered, (select distinct n from windows) where len(w) >= n
), hits as (
  select doc_id, i, p.n, item_id from (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g from places) p join windows using (n, g)
), covered as (
  select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(i, i + n)) as word from hits) group by 1
), named as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by 1
)
select l.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from lowered l left join covered c on c.doc_id = l.doc_id left join named n on n.doc_id = l.doc_id
"""
