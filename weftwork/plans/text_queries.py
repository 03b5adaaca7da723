"""Queries over tokens, vocabularies, limits and n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions import arrays, strings
from weftwork.operators import batching, graphs, limits, vocabulary
from weftwork.plans.tables import table

Q, O = {}, {}  # noqa: E741


def query(sql=None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def words():
    return F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != "")


TOK = r"""tok as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from
  (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '') as w from documents))"""
CNT = "cnt as (select word, count(*) as freq, min((doc_id * 1000000 + pos)) as fs from tok group by word)"


def _vocab(spark, sf_dir, min_freq=20, cap=500, order="first"):
    rows = vocabulary.tokens(table(spark, sf_dir, "documents"), "doc_id", words())
    counts = vocabulary.word_counts(rows, "word", "doc_id", "pos")
    return rows, vocabulary.vocabulary(counts, ["<PAD>", "<UNK>"], min_freq, cap, order)


@query(f"""with {TOK}, {CNT} select word, freq, 1 + row_number() over (order by fs) as idx from
  (select * from cnt where freq >= 20 order by fs limit 500)
  union all select '<PAD>', null, 0 union all select '<UNK>', null, 1""")
def vocab_first_seen(spark, sf_dir):
    return _vocab(spark, sf_dir)[1]


@query(f"""with {TOK}, {CNT} select word, freq, 1 + row_number() over (order by freq desc, word) as idx from
  (select * from cnt where freq >= 20 order by freq desc, word limit 300)
  union all select '<PAD>', null, 0 union all select '<UNK>', null, 1""")
def vocab_by_frequency(spark, sf_dir):
    return _vocab(spark, sf_dir, cap=300, order="freq")[1]


@query(f"""with {TOK}, {CNT}, voc as (select word, 1 + row_number() over (order by fs) as idx from (select * from cnt where freq >= 20 order by fs limit 500))
  select doc_id, count(*) as n_tokens, count(*) filter (where v.idx is null) as n_unknown, sum(coalesce(v.idx, 1))::bigint as sum_idx
  from tok left join voc v using (word) group by doc_id""")
def encode_unk(spark, sf_dir):
    rows, vocab = _vocab(spark, sf_dir)
    coded = vocabulary.encode(rows, "word", vocab.where("freq is not null"), unknown=1)
    return coded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("idx") == 1).alias("n_unknown"), F.sum("idx").alias("sum_idx"))


@query("""with voc as (select p_type as word, row_number() over (order by min(p_partkey)) - 1 as idx from part group by p_type)
  select p_partkey, p_type, idx::bigint as idx from part join voc on word = p_type""")
def encode_strict(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    vocab = vocabulary.vocabulary(vocabulary.word_counts(part, "p_type", "p_partkey"))
    return vocabulary.encode_strict(part, "p_type", vocab)


@query("""select vocab, word, count(*) as freq from (select 'brand' as vocab, p_brand as word from part union all select 'type', p_type from part
  union all select 'name', unnest(string_split(p_name, ' ')) from part) group by all""")
def vocab_sources(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name")
    rows = vocabulary.sources(part, brand=F.array("p_brand"), type=F.array("p_type"), name=F.split("p_name", " "))
    return rows.groupBy("vocab", "word").agg(F.count(F.lit(1)).alias("freq"))


@query("""select event_id, case event_type when 'click' then 'kwrd_' || event_type when 'view' then 'op_' || event_type when 'error' then 'sep_' || event_type end as word from events""")
def kos_words(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for x in ("click", "KEYWORD", "view", "OPERATOR", "error", "SEPARATOR", "signup", "IDENTIFIER", "purchase", "LITERAL")])
    events = table(spark, sf_dir, "events")
    return events.select("event_id", strings.kos_word(kind[F.col("event_type")], F.col("event_type")).alias("word"))


@query("""select o_orderkey, split_part(o_orderpriority, '-', 1) as major, case when instr(o_orderpriority, '-') > 0 then substr(o_orderpriority, instr(o_orderpriority, '-') + 1) end as minor,
  lower(trim(o_orderpriority, '5L')) as bare from orders""")
def major_minor(spark, sf_dir):
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", strings.major(p, "-").alias("major"), strings.minor(p, "-").alias("minor"), F.lower(F.btrim(p, F.lit("5L"))).alias("bare")
    )


@query(r"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '') as w from documents),
  k as (select doc_id, w, list_sort(list_distinct(w)) as kinds from d)
  select doc_id, len(kinds)::int as n_kinds, len(w)::int as n_words, list_sum(list_transform(w, lambda x: list_position(kinds, x) - 1))::bigint as sum_idx, list_position(kinds, w[1]) - 1 as first_idx from k""")
def subparts_reindex(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", words().alias("w"))
    # explode and join: an index lookup in an array per word would be quadratic in long texts
    kinds = rows.select("doc_id", arrays.sorted_kinds(F.col("w")).alias("kinds"))
    tok = rows.select("doc_id", F.posexplode("w").alias("pos", "word"))
    idx = kinds.select(F.col("doc_id").alias("_d"), F.posexplode("kinds").alias("idx", "_w"))
    joined = tok.join(idx, (F.col("doc_id") == F.col("_d")) & (F.col("word") == F.col("_w")))
    return joined.groupBy("doc_id").agg(
        (F.max("idx") + 1).alias("n_kinds"),
        F.count(F.lit(1)).cast("int").alias("n_words"),
        F.sum("idx").alias("sum_idx"),
        F.min_by("idx", "pos").alias("first_idx"),
    )


LINES = "lines as (select o_orderkey, any_value(o_totalprice) as total, count(l_orderkey) as n, max(l_quantity) as most, sum(l_quantity) as quantity from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)"


def _lines(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most"), F.sum("l_quantity").alias("quantity"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total")).join(item, "o_orderkey", "left")
    return rows.withColumn("n", F.coalesce("n", F.lit(0)))


def _limits():
    return [
        limits.Limit("#lines", F.col("n"), 2, 6),
        limits.Limit("max quantity", F.col("most"), None, 48),
        limits.Limit("sum quantity", F.col("quantity"), 10, None),
    ]


@query(f"with {LINES} select o_orderkey, n, quantity from lines where n between 2 and 6 and coalesce(most <= 48, true) and coalesce(quantity >= 10, true)")
def limit_filter(spark, sf_dir):
    return limits.kept(_lines(spark, sf_dir), _limits()).select("o_orderkey", "n", "quantity")


@query(f"""with {LINES}, v as (
  select o_orderkey, '#lines' as name, n::double as value, 6.0 as most from lines where n < 2 or n > 6
  union all select o_orderkey, 'max quantity', most, 48 from lines where most > 48 union all select o_orderkey, 'sum quantity', quantity, null from lines where quantity < 10)
  select o_orderkey, string_agg(name, ',' order by name) as names from v group by 1""")
def limit_reasons(spark, sf_dir):
    rows = limits.rejected(_lines(spark, sf_dir), _limits())
    return rows.select("o_orderkey", F.array_join(F.array_sort(F.col("violations.name")), ",").alias("names"))


@query(f"""with {LINES}, v as (
  select '#lines' as name, n::double as value, 6.0 as most from lines where n < 2 or n > 6
  union all select 'max quantity', most, 48 from lines where most > 48 union all select 'sum quantity', quantity, null from lines where quantity < 10),
  g as (select name || case when coalesce(value > most, false) then '+' else '-' end as reason, count(*) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as std from v group by 1)
  select reason, n, round(100 * n / sum(n) over (), 2) as percent, round(mean, 5) as mean, round(std, 5) as std, 0::bigint as n_inf, 0::bigint as n_nan from g""")
def reject_report(spark, sf_dir):
    found = limits.report(limits.with_violations(_lines(spark, sf_dir), _limits()))
    return found.select("reason", "n", "percent", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n_inf", "n_nan")


@query(f"""with {LINES} select o_orderkey, case when n < 2 or n > 6 then 'first' when coalesce(most > 48, false) or coalesce(quantity < 10, false) then 'second' else 'none' end as stage from lines""")
def staged_limits(spark, sf_dir):
    one, two, three = _limits()
    rows = limits.staged(_lines(spark, sf_dir), [[one], [two, three]])
    name = F.get("violations", F.lit(0))["name"]
    return rows.select("o_orderkey", F.when(name.isNull(), "none").when(name == "#lines", "first").otherwise("second").alias("stage"))


@query("""select l_returnflag, count(l_extendedprice) as n, round(avg(l_extendedprice), 4) as mean, round(coalesce(var_samp(l_extendedprice), 0), 1) as variance, 0::bigint as n_inf from lineitem group by 1""")
def online_mean_variance(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*limits.mean_variance(F.col("l_extendedprice")))
    return out.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round("variance", 1).alias("variance"), "n_inf")


DOCW = r"d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '') as w from documents)"


def _docw(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", words().alias("w"))


@query(f"with {DOCW} select doc_id, array_to_string(w[4:8], ' ') as part from d")
def token_slice(spark, sf_dir):
    rows = _docw(spark, sf_dir)
    return rows.select("doc_id", F.array_join(arrays.inclusive_slice(F.col("w"), F.lit(3), F.lit(7)), " ").alias("part"))


@query(f"with {DOCW} select doc_id, array_to_string(w[:2] || ['<MASK>'] || w[7:], ' ') as shown from d")
def mask_range(spark, sf_dir):
    shown = arrays.masked_range(F.col("w"), F.lit(2), F.lit(5), F.lit("<MASK>"))
    return _docw(spark, sf_dir).select("doc_id", F.array_join(shown, " ").alias("shown"))


@query(f"""with {DOCW} select doc_id, array_to_string(list_filter(w, lambda x: not list_contains(['the', 'of', 'and'], x)), ' ') as kept,
  list_filter(range(len(w)), lambda i: not list_contains(['the', 'of', 'and'], w[i + 1]))::varchar as places from d""")
def ignore_kinds(spark, sf_dir):
    rows, ignored = _docw(spark, sf_dir), ["the", "of", "and"]
    places = F.concat(F.lit("["), F.array_join(arrays.kept_positions(F.col("w"), ignored).cast("array<string>"), ", "), F.lit("]"))
    return rows.select("doc_id", F.array_join(arrays.compacted(F.col("w"), ignored), " ").alias("kept"), places.alias("places"))


EVT = """seqs as (select user_id, ts::date as day, list(event_type order by event_id) as s from events group by 1, 2)"""


def _sequences(spark, sf_dir):
    """The whole events of each user's days."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(arrays.collected(F.col("event_type"), F.col("event_id")).alias("s"))


@query(f"""with {EVT} select user_id, len(s)::int as n, array_to_string(list_sort(list(distinct array_to_string(s, ' '))), ';') as grams from seqs where len(s) between 2 and 6 group by 1, 2""")
def ngrams_exact(spark, sf_dir):
    return _grams(spark, sf_dir, "exact")


@query(f"""with {EVT}, g as (select distinct user_id, n, array_to_string(s[i : i + n - 1], ' ') as g from
  (select user_id, s, n, unnest(range(1, len(s) - n + 2)) as i from seqs, range(2, 7) t(n) where len(s) > n))
  select user_id, n::int as n, string_agg(g, ';' order by g) as grams from g group by 1, 2""")
def ngrams_partial(spark, sf_dir):
    return _grams(spark, sf_dir, "partial")


def _joined(grams):
    return F.array_join(F.array_sort(F.transform(grams, lambda g: F.array_join(g, " "))), ";")


def _grams(spark, sf_dir, kind):
    found = graphs.path_ngrams(_sequences(spark, sf_dir), "user_id", F.col("s"))
    return found.where(F.col("kind") == kind).select("user_id", "n", _joined(F.col("grams")).alias("grams"))


@query(f"""with {EVT}, e as (select user_id, len(s) as n, array_to_string(s, ' ') as g from seqs where len(s) between 2 and 3),
  p as (select user_id, 4 as n, array_to_string(s[i : i + 2], ' ') as g from (select user_id, s, unnest(range(1, len(s) - 1)) as i from seqs where len(s) > 3))
  select user_id, n::int as n, string_agg(distinct g, ';' order by g) as grams from (select * from e union all select * from p) group by 1, 2""")
def ngram_selection(spark, sf_dir):
    found = graphs.path_ngrams(_sequences(spark, sf_dir), "user_id", F.col("s"), 2, 6)
    return graphs.selected_ngrams(found, "user_id", 2, 3).select("user_id", "n", _joined(F.col("grams")).alias("grams"))


@query("""with c as (select conv_id, list_distinct(list(lower(trim(role, '_')))) as names from conversations group by 1)
  select conv_id, array_to_string(list_sort(list_filter(names, lambda x: not list_contains(['system', 'log', 'logger'], x))), ' ') as names from c""")
def symbol_target_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("name", strings.bare(F.col("role")))
    half = lambda r: F.collect_set(F.when(F.col("turn") % 2 == r, F.col("name")))
    rows = c.groupBy("conv_id").agg(half(0).alias("must"), half(1).alias("may"))
    names = F.filter(F.array_union("must", "may"), lambda x: ~x.isin("system", "log", "logger"))
    return rows.select("conv_id", F.array_join(F.array_sort(names), " ").alias("names"))


@query("""select doc_id, ('0x' || right(sha256('salt|' || doc_id || '|0'), 8))::bigint as seed from documents""")
def seed_from_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.seed_of(F.lit("salt"), F.col("doc_id").cast("string"), F.lit(0)).alias("seed"))


@query("""select p_partkey, rtrim(translate(base64(unhex(sha1(p_name))), '+/', '-_'), '=') as name_hash from part""")
def identity_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.identity_hash(F.col("p_name")).alias("name_hash"))


@query("""select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5('s|' || doc_id), doc_id) as r from documents) where r <= 5""")
def seeded_sample_bottomk(spark, sf_dir):
    return batching.bottom_k(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], 5, "s", "doc_id")


@query("""select event_id from events where substr(md5('b|' || event_id), 1, 8) < '40000000'""")
def bernoulli_sample(spark, sf_dir):
    return batching.sampled(table(spark, sf_dir, "events").select("event_id"), 0.25, "b", "event_id")
