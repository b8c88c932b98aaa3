"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelsight.llm import (centroid_clustering, chat_format, decontamination, fingerprints, html_extraction, language_id,
                           line_dedup, ngram_join, packing, sharding, spelling_variants, token_counts, warc)

QueryFn = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_archive(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"),
                                  memo_words=600_000).drop("ids")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_digest(chat_format.with_probe(_table(spark, sf_dir, "conversations")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_with_edits(token_counts.with_probe_edits(_table(spark, sf_dir, "documents")),
                                         tokenizer_file("byte_bpe_50k.tiktoken"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster_report(_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(_table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_warc, op2_packing, op3_line_dedup, op4_chat_format, op5_language_id, op6_sharding, op7_fingerprints,
    op8_decontamination, op9_token_counts, op10_ngram_join, op11_centroid_clustering,
    op12_spelling_variants, op13_html_extraction)}

# ------------------------------------------------------------------ oracle SQL

_OP1 = """
with p as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), f as (
    select hex, min(page_id) as first from p group by hex
), b as (
    select p.page_id, p.html, f.first, cast(unhex(p.hex) as bit)::varchar as bits from p join f using (hex)
)
select page_id, strlen(html)::bigint as payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(bits, (5 * i + 1)::int, 1)::int + 8 * substr(bits, (5 * i + 2)::int, 1)::int
          + 4 * substr(bits, (5 * i + 3)::int, 1)::int + 2 * substr(bits, (5 * i + 4)::int, 1)::int
          + substr(bits, (5 * i + 5)::int, 1)::int, 1)), 'string_agg', '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id = first then null else first end as refers_to
from b
"""

_CONTROL_LENGTH = " + ".join(
    f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)} * 2" for c in chat_format.CONTROL)

_OP4 = f"""
with r as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g as (
    select conv_id, count(*) as n_turns,
        string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t) as said,
        coalesce(string_agg(t, '' order by turn, role, t) filter (where role = 'assistant'), '') as learned,
        sum({len(chat_format.START)} + length(role) + 1 + length(t) + {len(chat_format.STOP)}
            + length(t) - length(replace(t, '{chat_format.ESCAPE}', ''))
            + {_CONTROL_LENGTH}) as formatted_chars
    from r group by conv_id
)
select conv_id, n_turns::bigint as n_turns, sha256(said) as turns_sha256, length(learned)::bigint as loss_chars,
    sha256(learned) as loss_sha256, formatted_chars::bigint as formatted_chars
from g
"""

_OP10 = """
with recursive w as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents
), s as (
    select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
        else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
        end) as shingle from w
), n as (
    select w.doc_id, count(s.shingle) as n from w left join s using (doc_id) group by w.doc_id
), inner_links as (
    select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b using (shingle)
    where a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from inner_links join n x on x.doc_id = a join n y on y.doc_id = b
    where 100 * common >= 75 * (x.n + y.n - common)
), edges as (
    select a, b from links union all select b, a from links
), reach(doc_id, other) as (
    select doc_id, doc_id from n
    union select r.doc_id, e.b from reach r join edges e on e.a = r.other
)
select n.doc_id, n.n::bigint as n_shingles, min(r.other) as component_id
from n join reach r on r.doc_id = n.doc_id group by n.doc_id, n.n
"""

_ROUNDS, _CLUSTERS = centroid_clustering.ROUNDS, centroid_clustering.CLUSTERS
_FLOOR_MEAN = "((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*))::bigint"


def _nearest_sql(round_: int) -> str:
    return f"""a{round_} as materialized (
    select r, cluster, d from (
        select x.r, c.cluster, sum((x.v - c.v) * (x.v - c.v))::bigint as d,
            row_number() over (partition by x.r order by sum((x.v - c.v) * (x.v - c.v)), c.cluster) as place
        from x join c{round_} c using (j) group by x.r, c.cluster) where place = 1
)"""


def _means_sql(round_: int) -> str:
    return f"""c{round_ + 1} as materialized (
    select c.cluster, c.j, coalesce(m.v, c.v) as v from c{round_} c left join (
        select a.cluster, x.j, {_FLOOR_MEAN} as v from a{round_} a join x using (r) group by a.cluster, x.j) m
    on m.cluster = c.cluster and m.j = c.j
)"""


_OP11 = f"""
with kept as materialized (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda y: floor(1024 * y::double)::bigint) as v
    from embeddings where len(embedding) = {centroid_clustering.DIMENSIONS}
        and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0
), x as materialized (
    select r, unnest(v) as v, generate_subscripts(v, 1) as j from kept
), c0 as materialized (
    select cluster, unnest(v) as v, generate_subscripts(v, 1) as j from (
        select (row_number() over (order by sha256('3:' || vec_id), v) - 1)::int as cluster, v from kept
        where vec_id is not null) where cluster < {_CLUSTERS}
), {", ".join(f"{_nearest_sql(i)}, {_means_sql(i)}" for i in range(_ROUNDS))}, {_nearest_sql(_ROUNDS)}, inertia as (
    select cluster, sum(d)::bigint as own from a{_ROUNDS} group by cluster
), said as (
    select cluster, sha256(string_agg(v::varchar, ',' order by j)) as hex from c{_ROUNDS} group by cluster
)
select k.vec_id, a.cluster, a.d as distance, i.own as cluster_inertia,
    (select sum(own)::bigint from inertia) as inertia, s.hex as centroid_sha256
from a{_ROUNDS} a join kept k using (r) join inertia i using (cluster) join said s using (cluster)
"""

_OP12 = """
with recursive t as (
    select list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as crc
), r as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\\x{00C0}-\\x{00FF}]+')) as run from documents
), d as (
    select doc_id, run, count(*) as k, list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda x: ord(x)) as codes
    from r where length(run) >= 7 group by doc_id, run
), h as (
    select run, k, xor(list_reduce(flatten(list_transform(codes, lambda o: case when o < 128 then [o] else [195, o - 64] end)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h from d, t
), v as materialized (
    select word, sum(k)::bigint as n from (
        select case when h % 31 <> 0 then run else left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) end as word, k
        from h) where length(word) >= 7 group by word having sum(k) >= 2
), cut as materialized (
    select word, n, i, left(word, i - 1) as a, substr(word, i + 1) as b from (
        select word, n, unnest(range(1, length(word) + 1))::int as i from v)
), near as materialized (
    select x.word, y.word as other, y.n as m from cut x join cut y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
    union select x.word, y.word, y.n from cut x join v y on y.word = x.a || x.b
    union select y.word, x.word, x.n from cut x join v y on y.word = x.a || x.b
), f as materialized (
    select v.word, v.n, coalesce(c.n_near, 0)::bigint as n_near, case when c.m >= 10 * v.n then c.other end as form,
        case when c.m >= 10 * v.n then c.m end as form_n
    from v left join (select word, count(*) as n_near, max(m) as m, arg_min(other, (-m, other)) as other from near group by word) c using (word)
), up(word, root, form) as (
    select word, word, form from f
    union all select up.word, f.word, f.form from up join f on f.word = up.form
)
select f.word, f.form, up.root, f.n, f.n_near, f.form_n from f join up using (word) where up.form is null
"""

#: The other operators rest on tokenizers, hashes, models or random draws that
#: SQL cannot express; the tests compare them with brute force.
ORACLES: dict[str, str] = {"op1_warc": _OP1, "op4_chat_format": _OP4, "op10_ngram_join": _OP10,
                           "op11_centroid_clustering": _OP11, "op12_spelling_variants": _OP12}
