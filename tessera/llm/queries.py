"""The queries of this subpackage, with production parameters and whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, html_extract, line_dedup, mixing, ngram_join, pieces, quality, repair, simhash, toxicity, url_filter, whitening
from tessera.llm.shared import table


#: Shares of all tokens, by the domain that a document's language is.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labelled table names."""
    named = labels.select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(named, "doc_id", "left_semi")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = mixing.mixing_rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS, columns=["doc_id"])
    return rated.select("doc_id", F.col("_tokens").alias("tokens"), F.col("_domains").alias("domains"), F.col("_posteriors").alias("posteriors"), F.col("_rate").alias("rate"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(table(spark, sf_dir, "documents"), least=1)
    return cut.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages.select("page_id", "url", url_filter.fetched_on().alias("fetched")), url_filter.listed_hosts(pages))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repaired(repair.damaged(table(spark, sf_dir, "conversations"))))


#: Words as in text.py: lowered, ASCII letters, digits and underscores and everything outside ASCII.
_SHINGLES = r"""
words as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') as w from documents),
sets as (
    select doc_id, w, list_sort(list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s from words)
"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": "with recursive"
    + _SHINGLES
    + """,
classes as (select s, min(doc_id) as rep, count(*) as cnt, len(s) as n from sets where len(s) > 0 group by s),
grams as (select rep, n, unnest(s) as g from classes),
common as (select a.rep as x, b.rep as y, a.n as nx, b.n as ny, count(*) as c from grams a join grams b on a.g = b.g and a.rep <> b.rep group by all),
link as (select x, y from common where c >= 0.8 * (nx + ny - c)),
reach as (select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x),
least as (select x, least(x, min(y)) as g from reach group by x),
links as (select x, sum(cnt) as links from link join classes on y = rep group by x)
select d.doc_id, coalesce(c.rep, d.doc_id) as class_id, coalesce(l.g, c.rep, d.doc_id) as group_id, cast(len(d.s) as bigint) as n_grams,
    cast(coalesce(c.cnt - 1 + coalesce(k.links, 0), 0) as bigint) as n_links
from sets d left join classes c on d.s = c.s left join least l on c.rep = l.x left join links k on c.rep = k.x
""",
}

ORACLES["op4_line_dedup"] = r"""
with pieces as (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
tokens as (select doc_id, i, line, list_sort(list_distinct(regexp_extract_all(lower(line), '[0-9a-z_\x{80}-\x{10FFFF}]+'))) as s from pieces),
big as (select * from tokens where len(s) >= 1),
sets as (select s, min((doc_id, i)) as f, row_number() over (order by min((doc_id, i))) as k, len(s) as n from big group by s),
grams as (select k, n, unnest(s) as g from sets),
df as (select g, count(*) as c from grams group by g),
ranked as (select k, n, g, row_number() over (partition by k order by c, g) as p from grams join df using (g)),
pre as (select k, n, g from ranked where p <= n - ceil(0.8 * n - 1e-9) + 1),
cand as (select distinct a.k as x, b.k as y from pre a join pre b on a.g = b.g and a.k < b.k and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n),
alike as (select distinct y from cand join sets a on a.k = x join sets b on b.k = y
    where len(list_intersect(a.s, b.s)) >= 0.8 * (a.n + b.n - len(list_intersect(a.s, b.s))) - 1e-9),
gone as (select b.doc_id, b.i from big b join sets using (s) left join alike on y = k where y is not null or (b.doc_id, b.i) <> f),
kept as (select t.doc_id, count(*) as n_lines, count(g.i) as n_removed, string_agg(t.line, chr(10) order by t.i) filter (g.i is null) as text
    from tokens t left join gone g on t.doc_id = g.doc_id and t.i = g.i group by t.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
    cast(case when coalesce(d.text, '') = '' then 0 else k.n_lines end as bigint) as n_lines, cast(coalesce(k.n_removed, 0) as bigint) as n_removed
from documents d left join kept k using (doc_id)
"""

ORACLES["op7_url_filters"] = r"""
with own as (select page_id, url, date '2024-01-01' + cast(coalesce(page_id, 0) % 366 as integer) as fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)', 1)), '\.$', '') as host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages),
hosts as (select distinct host, parts[1] as part, cast('0x' || substr(md5(host), 1, 4) as integer) as m from own where host <> ''),
made as (
    select 'domain' as kind, host as pattern, 'add' as action, date '2024-01-01' + (m // 8) % 250 as dated from hosts where m % 8 in (0, 1)
    union all select 'domain', host, 'remove', date '2024-01-01' + (m // 8) % 250 + 60 from hosts where m % 8 = 0
    union all select 'prefix', host || '/' || part, 'add', date '2024-01-01' + (m // 8) % 250 + n from hosts, (values (0), (120)) v(n) where m % 8 = 2 and part is not null
    union all select 'prefix', host || '/' || part, 'remove', date '2024-01-01' + (m // 8) % 250 + 90 from hosts where m % 8 = 2 and part is not null
    union all select 'domain', 'cheap-pills.example.com', 'add', date '2024-01-01'
    union all select 'domain', 'example.org', 'add', date '2024-11-01'),
latest as (select kind, pattern, dated, max(action) as action from made group by all),
spans as (select *, lead(dated) over (partition by kind, pattern order by dated) as until from latest),
asked as (
    select distinct url, fetched, 'domain' as kind, array_to_string(string_split(host, '.')[i:], '.') as pattern
    from own, lateral (select unnest(range(1, greatest(2, len(string_split(host, '.'))))) as i) where host <> ''
    union select distinct url, fetched, 'prefix', host || '/' || array_to_string(parts[1:i], '/')
    from own, lateral (select unnest(range(1, len(parts) + 1)) as i) where host <> ''),
best as (select a.url, a.fetched, min((-length(pattern), pattern, dated)) as hit from asked a join spans s using (kind, pattern)
    where s.action = 'add' and a.fetched >= s.dated and (s.until is null or a.fetched < s.until) group by all)
select o.page_id, o.url, o.fetched, b.hit is not null as blocked, b.hit[2] as rule, b.hit[3] as since
from own o left join best b on o.url = b.url and o.fetched = b.fetched
"""

#: A step of the recursion takes a row, after up to two inserts; costs and audits are compared as they are, whole.
ORACLES["op13_conversation_repair"] = r"""
with recursive own as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
coded as (select k, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(k, ''), lambda x: ascii(x)::ubigint)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)::ubigint[]), lambda d, y: xor(d >> 1, 3988292384::ubigint * (d & 1))))) % 20 as z from (select distinct k from own)),
ids as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
damaged as (select c, turn, case when z = 4 then 'user' else role end as role, case when z = 1 then '' when z = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when z = 3 then [0, 1] else [0] end) from own join coded using (k) join ids on own.conv_id is not distinct from ids.conv_id where z <> 0),
seen as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as e, left(role, 1) as f,
    row_number() over (partition by c, role, text order by turn nulls first) > 1 as again from damaged),
numbered as (select *, row_number() over (partition by c order by turn nulls first, role, text, again) as i from seen),
marked as (select *, case when e = '' then 'b' when again then 'd' when right(e, 1) in ('.', '!', '?') then 'f' else 't' end as fault,
    lag(f) over (partition by c order by i) || f not in ('su', 'ua', 'au') as illegal from numbered),
inserted(state, letters, now) as (values (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)),
moves(now, f, after) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits as (
    select now, 'D' as edit, null as f, 3 as cost, now as after from (values (0), (1), (2), (3)) v(now)
    union all select now, 'K', f, 0, after from moves union all select now, 'R', null, 2, after from moves where f <> 's'),
dp as (
    select c, 0::bigint as i, 0 as state, 0::bigint as cost, '' as audit from ids
    union all
    select c, i, state, best.cost, best.audit from (
        select d.c, m.i, x.after as state, min({'cost': d.cost + 2 * length(n.letters) + x.cost + (case when m.fault = 't' and x.edit <> 'D' then 1 else 0 end), 'audit': d.audit || n.letters || x.edit}) as best
        from dp d join marked m on m.c = d.c and m.i = d.i + 1 join inserted n on n.state = d.state
        join edits x on x.now = n.now and (x.edit <> 'K' or x.f = m.f) and (x.edit = 'D' or m.fault not in ('b', 'd')) group by all)),
closed(state, letters) as (values (0, ''), (1, 'II'), (2, 'I'), (3, '')),
size as (select c, max(i) as n from dp group by c),
answer as (select c, min({'cost': cost + 2 * length(letters), 'audit': audit || letters}) as best from dp join size using (c) join closed using (state) where i = n group by c),
letters as (select c, unnest(string_split(best.audit, '')) as x, unnest(range(1, length(best.audit) + 1)) as p from answer where best.audit <> ''),
placed as (select *, count(*) filter (x <> 'I') over w as i, count(*) filter (x <> 'D') over w as o, count(*) filter (x <> 'D') over (partition by c) as m
    from letters window w as (partition by c order by p)),
repaired as (select p.c, string_agg((case when x = 'K' then r.role when (o - m % 2) % 2 = 1 then 'user' else 'assistant' end) || ':' || (case when x = 'I' then '' else r.text end), chr(10) order by p) as whole
    from placed p left join marked r on r.c = p.c and r.i = p.i where x <> 'D' group by p.c),
told as (select c, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (illegal) as illegal from marked group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    best.cost as cost, best.audit as audit, sha256(coalesce(whole, '')) as repaired_sha256
from ids join answer using (c) left join told using (c) left join repaired using (c)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
