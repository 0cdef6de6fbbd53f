"""The queries of this subpackage and, where SQL can express them, the DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, codes, decontamination, divergence, embeddings, language, licenses, mixing, packing, pii, simhash, substrings, toxicity
from tessella.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = language.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return cut.select("doc_id", "n_units", "n_removed", spans.alias("removed_spans"), "text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), with_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository, which only this query needs

    return corpus_pipeline.run(spark, sf_dir)


def _license_sql() -> str:
    pairs = ", ".join(f"({i}, '{label}', {str(base).lower()}, {len(w) - 1}, {p}, '{w[p]}', '{w[p + 1]}')" for i, label, base, w in licenses.templates() for p in range(len(w) - 1))
    return f"""
    with t(template, label, base, pairs, place, t0, t1) as (values {pairs}),
    d as (select row_number() over () as row_id, doc_id,
            list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as words
          from documents),
    p as (select row_id, unnest(range(0, greatest(len(words) - 1, 0))) as pos, words from d),
    h as (select row_id, template, label, base, pairs, pos - place as diagonal, bit_or(1::bigint << place) as places, min(pos) as start
          from (select row_id, pos, words[pos + 1] as w0, words[pos + 2] as w1 from p) g join t on w0 = t0 and w1 = t1 group by all),
    m as (select *, sum(case when diagonal - before <= (case when base then 0 else {licenses.DRIFT} end) then 0 else 1 end) over (partition by row_id, template order by diagonal) as grp
          from (select *, lag(diagonal) over (partition by row_id, template order by diagonal) as before from h) x),
    s as (select row_id, label, base, pairs, bit_count(bit_or(places)) as votes, min(start) as start from m group by row_id, template, label, base, pairs, grp),
    v as (select * from s where case when base then votes = pairs else votes / pairs >= {licenses.COVERAGE} end)
    select d.doc_id, len(any_value(d.words))::bigint as n_words, count(case when v.base then 1 end)::bigint as n_base,
      min(case when v.base then v.start end)::bigint as first_word, max(case when v.base then v.start end)::bigint as last_word,
      coalesce(string_agg(distinct case when v.base then v.label end, ',' order by case when v.base then v.label end), '') as base_labels,
      coalesce(string_agg(distinct v.label, ',' order by v.label), '') as labels,
      round(coalesce(max(v.votes::double / v.pairs), 0.0::double), 6) as score
    from d left join v using (row_id) group by d.row_id, d.doc_id
    """


_MIXING_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight from s),
r as (select *, source_size * 3 as cap, row_number() over o as rk,
        (sum(source_size) over () - coalesce(sum(source_size * 3) over (o rows between unbounded preceding and 1 preceding), 0))::bigint as lft,
        (sum(weight) over (o rows between current row and unbounded following))::bigint as rest
      from w window o as (order by source_size * 3 / weight, source is null, source)),
f as (select * from r where cap * rest >= lft * weight order by rk limit 1),
t as (select r.source, r.source_size, case when r.rk < f.rk then r.cap::double else (f.lft * r.weight)::double / f.rest end as target from r cross join f),
b as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then round(t.target)::bigint // t.source_size else 0 end as epochs,
        coalesce(sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * epochs + least(size, greatest(0, round(target)::bigint - epochs * source_size - before)))::bigint as taken from b
"""

_DECONTAMINATION_SQL = r"""
with dw as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
iw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
ik as (select item_id, w, least(len(w), 13) as k from iw where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[p + 1:p + k], ' ') as g from (select item_id, w, k, unnest(range(0, len(w) - k + 1)) as p from ik)),
dg as (select r, p, k, array_to_string(w[p + 1:p + k], ' ') as g from (select r, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) as p from dw cross join (select distinct k from ik))),
hit as (select r, p, dg.k, item_id from dg join win on dg.k = win.k and dg.g = win.g),
hw as (select r, count(distinct x) as n from (select r, unnest(range(p, p + k)) as x from hit) group by r),
hi as (select r, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by r)
select doc_id, len(w)::bigint as n_words, coalesce(hw.n, 0)::bigint as n_hit, coalesce(hi.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(hw.n, 0) > 0 and 20 * coalesce(hw.n, 0) >= len(w) as contaminated
from dw left join hw using (r) left join hi using (r)
"""

_CHAT_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(role || text)
    + length(regexp_replace(role || chr(10) || text, '\\|<turn>|<says>|</turn>|### Assistant:|### User:|### System:', '\0#', 'g')) - length(role || chr(10) || text) + 19 as chars from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""

_EMBEDDING_SQL = """
with recursive e as (select row_number() over () as r, vec_id, label, embedding,
    coalesce(label is not null and vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as fine from embeddings),
u as (select r, vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from e where fine),
l as (select a.r as a, b.r as b from u a join u b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v) and list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) >= 0.93),
reach(r, vec_id) as (select r, vec_id from e union select l.a, reach.vec_id from l join reach on l.b = reach.r)
select e.vec_id, (select count(*) from l where l.a = e.r)::bigint as n_links, (select min(reach.vec_id) from reach where reach.r = e.r) as component_id,
  e.vec_id is not distinct from (select min(reach.vec_id) from reach where reach.r = e.r) as kept
from e
"""



def _codes_sql() -> str:
    """Lloyd's rounds written out one after the other, each comparing every part with every entry."""
    rounds = "".join(
        f"""
    a{r} as materialized (select v.i, v.part, v.x, arg_min(c.entry, (list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + c.entry)) as entry,
        min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as error from v join c{r} c using (part) group by all),
    m{r} as (select part, entry, place, sum(x[place])::bigint as s, count(*) as n from (select *, unnest(range(1, len(x) + 1)) as place from a{r}) t group by all),
    c{r + 1} as materialized (select c.part, c.entry, coalesce(m.x, c.x) as x from c{r} c
        left join (select part, entry, list((s - ((s % n) + n) % n) // n order by place) as x from m{r} group by all) m using (part, entry)),"""
        for r in range(codes.ROUNDS + 1)
    )
    return f"""
    with e as materialized (select row_number() over (order by vec_id) as i, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::double)::bigint) as q from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    v as materialized (select i, part, q[part * len(q) // {codes.PARTS} + 1:(part + 1) * len(q) // {codes.PARTS}] as x from (select *, unnest(range({codes.PARTS})) as part from e) t),
    c0 as materialized (select part, i - 1 as entry, x from v where i <= {codes.ENTRIES}),{rounds}
    w as (select i, string_agg(lower(printf('%02x', entry)), '' order by part) as code, sum(error)::bigint as error from a{codes.ROUNDS} group by i),
    d as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from c{codes.ROUNDS})
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e join w using (i) cross join d
    """



_DIVERGENCE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents),
o as (select lang, source, term, count(*) as n, count(distinct r) as docs from (select r, lang, source, unnest(words) as term from d) t group by all),
k as (select lang, term, sum(n) as total from o group by all having sum(docs) >= 10),
g as (select distinct lang, source from d),
lk as (select lang, count(*) as v, sum(total) as nl from k group by all),
gk as (select lang, source, sum(n) as n from o join k using (lang, term) group by all),
dense as materialized (select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
    (1 + (1000000000::hugeint * (coalesce(o.n, 0) + 2)) // (coalesce(gk.n, 0) + 2 * lk.v))::hugeint as p, (1 + (1000000000::hugeint * (k.total + 2)) // (lk.nl + 2 * lk.v))::hugeint as q
  from g join k using (lang) join lk using (lang) left join gk using (lang, source) left join o using (lang, source, term)),
s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from dense where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from u
qualify part = 'pair' or rank <= 10
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_pii": op7_pii,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mixing": op9_mixing,
    "op10_chat_format": op10_chat_format,
    "op11_vector_codes": op11_vector_codes,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}
ORACLE_SQL = {
    "op3_license_scan": _license_sql(),
    "op4_embedding_near_dedup": _EMBEDDING_SQL,
    "op5_decontamination": _DECONTAMINATION_SQL,
    "op9_mixing": _MIXING_SQL,
    "op10_chat_format": _CHAT_SQL,
    "op11_vector_codes": _codes_sql(),
    "op13_source_divergence": _DIVERGENCE_SQL,
}
