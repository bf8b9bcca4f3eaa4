"""The queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.llm import alignment, bpe, decontaminate, jaccard, lines, pii, quality, sharding, substrings, toxicity, urls, variants, windows
from brickwork.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(
    """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
g as (select doc_id, p, substr(x, 2 * p + 1, 100) as s from (select doc_id, x, unnest(range(0, n - 49)) as p from d)),
f as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by s) as least from g) where least < doc_id),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as j from f),
runs as (select doc_id, count(*) as n, count(*) filter (where j > before + 1 or before is null) as spans
  from (select doc_id, j, lag(j) over (partition by doc_id order by j) as before from gone) group by doc_id),
byte as (select doc_id, j, substr(x, 2 * j + 1, 2) as b from (select doc_id, x, unnest(range(0, n)) as j from d)),
kept as (select doc_id, string_agg(b, '' order by j) as x from byte anti join gone using (doc_id, j) group by doc_id)
select doc_id, cast(d.n as bigint) as n_bytes, coalesce(runs.n, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept.x, ''))) as kept_sha256
from d left join runs using (doc_id) left join kept using (doc_id)"""
)
def op1_suffix_array_dedup(spark, sf_dir):
    return substrings.dedup(_table(spark, sf_dir, "documents"))


@query(
    r"""
with w as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark),
d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents),
wp as (select item_id, least(2, len(ws)) as n, q, array_to_string(ws[q + 1 : q + least(2, len(ws))], ' ') as g
  from (select item_id, ws, unnest(range(0, len(ws) - least(2, len(ws)) + 1)) as q from w where len(ws) > 0)),
dp as (select doc_id, n, p, array_to_string(ws[p + 1 : p + n], ' ') as g
  from (select doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) as p from d cross join (select unnest([1, 2]) as n))),
hit as (select distinct doc_id, item_id, p - q as shift from wp join dp using (n, g)),
laid as (select doc_id, item_id, least(20, len(w.ws)) as size,
    list_transform(range(0, len(w.ws)), lambda j: case when j + shift >= 0 and d.ws[j + shift + 1] = w.ws[j + 1] then 1 else 0 end) as same
  from hit join w using (item_id) join d using (doc_id)),
shares as (select doc_id, item_id, max(list_max(list_transform(range(0, len(same) - size + 1), lambda i: list_sum(same[i + 1 : i + size]) / size))) as share from laid group by all),
good as (select * from shares where share >= 0.8),
best as (select doc_id, count(*) as n_items, max(share) as share, arg_min(item_id, {'a': -share, 'b': item_id}) as item_id from good group by doc_id)
select doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items, item_id, coalesce(share, 0.0::double) as share
from documents left join best using (doc_id)"""
)
def op2_decontamination(spark, sf_dir):
    return decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query()
def op3_personal_data(spark, sf_dir):
    model = pii.train(pii.labelled_table(spark))
    found = pii.find(_table(spark, sf_dir, "documents"), model)
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@query(
    r"""
with recursive p as (select page_id, url, html, lower(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')) as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
nf as (select url as a, 'http://' || regexp_replace(host, '^(?:www\.|m\.)', '')
    || regexp_replace(regexp_replace(path, '(?:/index)?\.html?$', ''), '/+$', '')
    || case when q <> '' then '?' || q else '' end as b
  from (select *, regexp_replace(regexp_replace('&' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&(?:utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') as q from p)
  where contains(url, '://')),
e as (select a, b from nf union select b, a from nf),
reach as (select a as n, a as m from e union select n, e.b from reach join e on m = e.a),
node as (select distinct a as url, lower(regexp_extract(a, '^(?s:.*?)://([^/?#]*)', 1)) as host, regexp_extract(a, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from e),
rules as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) as r(v, h, s)),
ruled as (select x.url, arg_max(v, length(h || s)) as v, max_by(h || s, length(h || s)) as rule
  from (select url, host, path from node union select url, host, path from p) x join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by x.url),
spread as (select n from reach left join ruled on m = url group by n having bool_or(v = 'block') and not coalesce(bool_or(v = 'allow'), false))
select page_id, host, path, rule, coalesce(v, case when n is not null then 'block' else 'allow' end) as verdict
from p left join ruled using (url) left join spread on p.url = n"""
)
def op4_redirect_equivalence(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"))


@query()
def op5_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = labels.where(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.train(docs, known)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query(
    r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, j, list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from (select doc_id, unnest(ls) as s, unnest(range(0, len(ls))) as j from d)),
s as (select distinct doc_id, j, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i + 1 : i + 5], ' ') end as g
  from (select doc_id, j, ws, unnest(range(0, greatest(len(ws) - 4, least(len(ws), 1)))) as i from l)),
k as (select doc_id, j, md5(string_agg(g, chr(10) order by g)) as h, count(*) as n from s group by all),
c as (select *, row_number() over (partition by h order by doc_id, j) as r from k),
f as (select s.* from s join c using (doc_id, j) where r = 1),
p as (select a.doc_id as d1, a.j as j1, b.doc_id as d2, b.j as j2, count(*) as m from f a join f b using (g) where (a.doc_id, a.j) < (b.doc_id, b.j) group by all),
near as (select distinct d2 as doc_id, j2 as j from p join c x on d1 = x.doc_id and j1 = x.j join c y on d2 = y.doc_id and j2 = y.j where m >= 0.8 * (x.n + y.n - m)),
gone as (select doc_id, j from c where r > 1 union select doc_id, j from near),
a as (select doc_id, count(*) as n, list(j::int order by j) as js from gone group by doc_id)
select doc_id, len(ls)::bigint as n_lines, coalesce(n, 0)::bigint as n_removed, coalesce(array_to_string(js, ','), '') as removed from d left join a using (doc_id)"""
)
def op6_line_similarity(spark, sf_dir):
    found = lines.decisions(_table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.transform("removed", lambda n: n.cast("string")), ","))


@query(
    r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (select doc_id, i, array_to_string(ws[i + 1 : i + 35], ' ') as g from (select doc_id, ws, unnest(range(0, len(ws) - 34)) as i from d)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as c from g) where c > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as j from r),
word as (select doc_id, unnest(ws) as w, unnest(range(0, len(ws))) as j from d),
kept as (select doc_id, string_agg(w, ' ' order by j) as t, count(*) as n from word anti join gone using (doc_id, j) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)"""
)
def op7_window_doubling(spark, sf_dir):
    return windows.dedup(_table(spark, sf_dir, "documents"))


@query(
    r"""
with d as (select doc_id, source, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
g as (select doc_id, i, array_to_string(ws[i + 1 : i + 5], ' ') as g from (select doc_id, ws, unnest(range(0, len(ws) - 4)) as i from d)),
r as (select doc_id, unnest(range(i, i + 5)) as j from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1),
n as (select doc_id, count(distinct j) as n from r group by doc_id),
m as (select d.doc_id, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines, coalesce(n.n, 0)::bigint as n_repeat_words from d left join n using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, 100 * n_symbols > 10 * word_chars as symbols_failed,
    100 * n_dup_lines > 30 * n_lines as lines_failed from m),
u as (select source, unnest(['base', 'symbols', 'lines']) as rule, unnest([base_failed, symbols_failed, lines_failed]) as failed from b where source is not null),
h as (select source, rule, count(*)::double as n, sum(failed::int)::double as f from u group by source, rule),
s as (select rule, sum(f) / sum(n) as mean, sum(n) as n, count(*) as hosts, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2, 0) as spread from h group by rule),
p as (select rule, mean, mean * (1 - mean) as within, spread - mean * (1 - mean) * hosts / n as between from s),
w as (select rule, mean, case when between > 1e-12 and within > between then within / between - 1 when between >= within and within > 0 then 0 else 1e12 end as k from p),
bad as (select distinct source from h join w using (rule) where (f + k * mean) / (n + k) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.source is null as kept
from b left join bad on b.source = bad.source"""
)
def op8_host_rules(spark, sf_dir):
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    r"""
with recursive d as (select doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
c as (select t, min(doc_id) as class_id, count(*) as n_copies, any_value(ws) as ws from d group by t),
s as (select distinct class_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i + 1 : i + 5], ' ') end as g
  from (select class_id, ws, unnest(range(0, greatest(len(ws) - 4, least(len(ws), 1)))) as i from c)),
n as (select class_id, count(*) as n from s group by class_id),
common as (select g from s group by g having count(*) > 1),
p as (select a.class_id as a, b.class_id as b, count(*) as k from s a join s b using (g) where a.class_id < b.class_id and g in (select g from common) group by all),
l as (select a, b from p join n x on a = x.class_id join n y on b = y.class_id where k >= 0.8 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
reach as (select a as x, a as y from e union select x, b from reach join e on y = a),
grp as (select x, min(y) as group_id from reach group by x),
deg as (select a, count(*) as n_links from e group by a)
select doc_id, c.class_id, n_copies, coalesce(n_links, 0)::bigint as n_links, coalesce(group_id, c.class_id) as group_id
from d join c using (t) left join deg on a = c.class_id left join grp on x = c.class_id"""
)
def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.join(_table(spark, sf_dir, "documents")).drop("rid", "_keeper")


@query()
def op10_byte_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"))


@query()
def op11_identity_alignment(spark, sf_dir):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return alignment.digests(_table(spark, sf_dir, "documents")).select(*columns)


@query()
def op12_hypergeometric_shards(spark, sf_dir):
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(data) + 16).cast("long").alias("size")
    rows = _table(spark, sf_dir, "documents").select("doc_id", size, F.crc32(data).alias("text_crc32"))
    return sharding.shuffle(rows, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query()
def op13_spelling_variants(spark, sf_dir):
    return variants.group(variants.vocabulary(_table(spark, sf_dir, "documents")))
