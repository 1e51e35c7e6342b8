"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import additive_ann, jaccard_join, line_dedup, media, mixing, quality, secrets, tokenize, url_filter, warc
from larkspur.llm.storage import table


def piece_model_path() -> str:
    """LARKSPUR_PIECE_MODEL, or the installed package of public vocabularies."""
    if path := os.environ.get("LARKSPUR_PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUALITY_FROM = 0.3  # the score from which a text is kept


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
LISTED_HOSTS = ["ads-track.example.com", "adult-x.example.net", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com"]


def listed_urls(pages: DataFrame) -> DataFrame:
    """A list of hosts and canonical URLs: LISTED_HOSTS, some of the pages' own URLs (by hash, one of 256), and many that no page has (one for each 16 URLs)."""
    spark = pages.sparkSession
    host, path = url_filter.canonical_host(url_filter.host_of(F.col("url"))), url_filter.canonical_path(url_filter.path_of(F.col("url")))
    own = pages.select(F.concat(host, path).alias("key")).distinct().withColumn("hash", F.md5("key"))
    hosts = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string")
    return hosts.unionAll(own.where("hash like '00%' and key != ''").select("key")).unionAll(own.where("hash like '1%'").select(F.concat("key", F.lit("/~old"))))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, listed_urls(pages))


_RULES_SQL = " union all ".join(f"select '{t}' as rule, '{v}' as verdict, '{t.partition('/')[0]}' as on_host, '/{t.partition('/')[2]}' as on_path" for v, t in URL_RULES)
_LISTED_SQL = ", ".join(f"'{u}'" for u in LISTED_HOSTS)
OP2_SQL = rf"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
rules as ({_RULES_SQL}),
urls as (select distinct host, path from parts),
ruled as (
  select u.host, u.path, max_by(r.rule, length(r.rule)) as rule, max_by(r.verdict, length(r.rule)) as verdict
  from urls u join rules r on (u.host = r.on_host or ends_with(u.host, '.' || r.on_host)) and starts_with(u.path, r.on_path)
  group by u.host, u.path),
canonical as (
  select host, path, regexp_replace(regexp_replace(host, '^.*@|:\d*$', '', 'g'), '^www\.', '') as h,
         regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '') as p
  from urls),
list as (
  select unnest([{_LISTED_SQL}]) as key
  union select h || p from canonical where md5(h || p) like '00%' and h || p <> ''
  union select h || p || '/~old' from canonical where md5(h || p) like '1%'),
asked as (
  select host, path, unnest(flatten(list_transform(range(0, greatest(len(string_split(h, '.')) - 2, 0) + 1),
        lambda i: [array_to_string(string_split(h, '.')[i + 1:], '.'), array_to_string(string_split(h, '.')[i + 1:], '.') || p]))) as key
  from canonical),
listed as (select distinct host, path from asked where key in (select key from list))
select parts.page_id, parts.host, parts.path, ruled.rule,
       coalesce(ruled.verdict, case when listed.host is not null then 'block' else 'allow' end) as verdict
from parts left join ruled on parts.host = ruled.host and parts.path = ruled.path
left join listed on parts.host = listed.host and parts.path = listed.path
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_archives(warc.record_types(pages))
    return warc.read_archives(manifest, pages.schema["page_id"].dataType).drop("url", "payload")


OP3_SQL = """
with rows as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
firsts as (select digest, min(page_id) as first from rows where n >= 100 group by digest)
select page_id, cast(n as bigint) as payload_bytes, rows.digest as payload_digest,
       case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first then first end as refers_to
from rows left join firsts on rows.digest = firsts.digest
"""


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"))
    f = media.features(stored)
    feature = F.concat_ws(
        ";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("seconds="), "n_samples", F.lit("/"), "sample_rate"), F.concat(F.lit("table="), F.coalesce("table_frames", F.lit(-1))),
        F.concat(F.lit("bad="), "bad_checksums"), F.concat(F.lit("skipped="), "skipped_bytes"), F.concat(F.lit("seek="), F.md5(F.concat_ws(",", "frame_offsets"))),
    )
    return f.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


# The stored form, byte by byte in hexadecimal: an ID3v2 tag with the text's length, a frame of 144 bytes with the Xing table,
# then frames of 648 bytes: header, checksum and nine bytes of side information (fixed values of this format), 576 bytes of the payload, 57 of padding.
OP4_SQL = """
with docs as (select doc_id, encode(coalesce(text, '')) as t from documents),
sized as (select doc_id, t, octet_length(t) as n, greatest(1, (octet_length(t) + 575) // 576) as k from docs),
payloads as (select *, hex(t) || repeat('FF', k * 576 - n) as p, hex(encode(cast(n as varchar))) as digits from sized),
tagged as (select *, '006E5F627974657300' || digits as body from payloads),
framed as (select *, '54585858' || printf('%08X', length(body) // 2) || '0000' || body as tag, (144.0 / (144 + k * 648)) as head from tagged),
media as (
  select *, '494433030000' || printf('%08X', length(tag) // 2) || tag
    || 'FFF348C0' || repeat('00', 9) || '58696E67' || '00000007' || printf('%08X', k) || printf('%08X', 144 + k * 648)
    || array_to_string(list_transform(range(100), lambda i: printf('%02X', least(255, cast(floor(256 * (head + (1 - head) * i / 100)) as integer)))), '') || repeat('00', 144 - 13 - 16 - 100)
    || array_to_string(list_transform(range(k), lambda i: 'FFF2D8C0E1F0000000000000000000' || p[i * 1152 + 1:i * 1152 + 1152] || repeat('00', 57)), '') as m
  from framed),
crc as (
  select list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs)
select doc_id, cast(n as bigint) as n_bytes, cast(k * 576 as bigint) as payload_bytes, sha256(unhex(p)) as payload_sha256,
       xor(list_reduce(list_prepend(4294967295, list_transform(range(32), lambda i: cast('0x' || p[length(p) - 63 + 2 * i:length(p) - 62 + 2 * i] as bigint))),
           lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) as tail_crc32,
       cast(length(m) // 2 as bigint) as media_bytes, sha256(unhex(m)) as media_sha256,
       'frames=' || k || ';seconds=' || k * 576 || '/16000;table=' || k || ';bad=0;skipped=0;seek='
         || md5(array_to_string(list_transform(range(k), lambda i: length(m) // 2 - (k - i) * 648), ',')) as feature
from media, crc
"""


def op5_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
with rows as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, x.vec_id, list_distance(q.v, x.v) as score from rows q, rows x where q.vec_id % 100 = 0 and q.vec_id <> x.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs) where rank <= 10
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch")


# The exponent has a closed form for a repetition limit: the ratio of the largest and smallest share to the power of 1 - a.
OP6_SQL = """
with docs as (
  select doc_id, source, coalesce('s' || source, 'n') as s, coalesce(cast(doc_id as varchar), '') as k, md5(coalesce(text, '')) as t,
         coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0) as n_tokens
  from documents),
totals as (select s, sum(n_tokens) as n, count(*) as c from docs group by s),
shares as (select s, n, c, n / sum(n) over () as p from totals where n > 0),
a as (select case when max(p) <= 2.0 * min(p) then 0.0 else 1.0 - ln(2.0) / ln(max(p) / min(p)) end as a from shares),
weighed as (select s, n, c, pow(p, a) as w from shares, a),
dealt as (select s, n, c, cast(round(w / sum(w) over () * (max(n / w) over () * sum(w) over ())) as bigint) as quota from weighed),
plan as (select s, quota // n as whole, quota % n as rest, cast(ceil(sqrt(c)) as bigint) as nb from dealt
         union all select s, 1, 0, 1 from totals where n = 0),
placed as (
  select d.*, p.whole, p.rest, cast('0x' || substr(md5('17|' || d.s || '|' || d.k || '|' || d.t), 1, 8) as bigint) % p.nb as b
  from docs d join plan p on d.s = p.s),
blocks as (select s, b, whole, rest, sum(n_tokens) as t from placed group by s, b, whole, rest),
reached as (
  select *, rest - (sum(t) over (partition by s order by md5('18|' || s || '|' || whole || '|' || b), b rows unbounded preceding) - t) as room
  from blocks),
edge as (
  select s, b, case when rest > 0 and room >= t then -1 when room > 0 then room else 0 end as room from reached),
cut as (
  select p.s, p.b, p.k, p.t, e.room,
         sum(sum(p.n_tokens)) over (partition by p.s, p.b order by md5('19|' || p.whole || '|' || p.k || '|' || p.t), p.k rows unbounded preceding) as upto
  from placed p join edge e on p.s = e.s and p.b = e.b where e.room > 0 group by p.s, p.b, p.k, p.t, p.whole, e.room),
times as (
  select p.doc_id, p.source, p.n_tokens,
         p.whole + case when e.room = -1 or (e.room > 0 and c.upto <= e.room) then 1 else 0 end as times
  from placed p join edge e on p.s = e.s and p.b = e.b
  left join cut c on p.s = c.s and p.b = c.b and p.k = c.k and p.t = c.t)
select doc_id, source, cast(n_tokens as bigint) as n_tokens, cast(unnest(range(1, cast(times as bigint) + 1)) as integer) as epoch from times
"""


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


# Equal sets are one class; classes that share a shingle are compared, and links followed to their ends.
OP7_SQL = r"""
with words as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select rid, doc_id, case when len(w) = 0 then [] else list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s
  from words),
classes as (select row_number() over () as c, s, len(s) as n from (select distinct s from sets where len(s) > 0)),
shingles as (select c, n, unnest(s) as g from classes),
links as (
  select a.c as x, b.c as y from shingles a join shingles b on a.g = b.g and a.c < b.c and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges as (select x, y from links union all select y, x from links),
reached as (
  with recursive r(c, o) as (select c, c from classes union select r.c, e.y from r join edges e on r.o = e.x)
  select c, min(o) as root from r group by c),
rooted as (select rid, doc_id, len(sets.s) as n, root from sets left join classes on sets.s = classes.s left join reached using (c))
select doc_id, cast(n as bigint) as n_shingles, case when root is null then doc_id else min(doc_id) over (partition by root) end as component_id from rooted
"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, owner="source", repository=F.concat_ws("/", "source", "lang"))


# A match's place: the lengths of the matches before it and of the texts between them.
def _matches_sql(kind: int, pattern: str, group: int, where: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  select rid, {kind} as kind, s as start, s + length(m) as stop, v as value from (
    select rid, m, v, cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as s
    from (select rid, unnest(ms) as m, unnest(vs) as v, unnest(range(1, len(ms) + 1)) as i, ms, pieces
          from (select rid, regexp_extract_all(t, '{pattern}') as ms, regexp_extract_all(t, '{pattern}', {group}) as vs, string_split_regex(t, '{pattern}') as pieces from docs)))
  where {where}"""


_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN_SQL = "(" + "|".join(_EITHER(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OP8_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce('s' || source, 'n') as owner, concat_ws('/', source, lang) as repository from documents),
base as ({" union all ".join((
    _matches_sql(0, _ASSIGN_SQL, 2, "length(v) >= 6"), _matches_sql(1, "AKIA[A-Z0-9]+", 0, "length(v) >= 20"), _matches_sql(2, "[0-9a-f]+", 0, "length(v) >= 24"),
))}),
tokens as ({_matches_sql(3, "[A-Za-z0-9+/_-]{28,}", 0, "regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')")}),
held as (
  select * from base union all
  select * from tokens t where not exists (select 1 from base b where b.rid = t.rid and b.start < t.stop and t.start < b.stop)),
measured as (
  select value, -sum(c / n * log2(c / n)) as entropy
  from (select value, length(value) as n, ch, cast(count(*) as double) as c from (select value, unnest(string_split(value, '')) as ch from (select distinct value from held)) group by value, ch) group by value),
found as (select h.*, entropy >= {secrets.LIVE_ENTROPY} as live, owner, repository from held h join measured using (value) join docs using (rid) where kind < 3 or entropy >= 4.0),
owners as (select value, count(distinct owner) as n_owners, count(distinct owner || '|' || repository) as n_repositories from found group by value),
told as (
  select rid, kind, start, stop, n_owners >= {secrets.COPIED_OWNERS} or n_repositories >= {secrets.COPIED_REPOSITORIES} as copied,
         live and n_owners = 1 and n_repositories < {secrets.COPIED_REPOSITORIES} as live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop as span
  from found join owners using (value)),
summed as (
  select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         string_agg(span, ',' order by start, kind) filter (kind < 3) as base, string_agg(span, ',' order by start, kind) filter (kind < 3 or live) as spans,
         count(*) filter (live) as n_live, count(*) filter (copied) as n_copied
  from told group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from docs left join summed using (rid)
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.round_trip_digests(table(spark, sf_dir, "documents"), piece_model_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), short=True).select("doc_id", "n_lines", "n_kept", "text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_nbsvm": op1_quality_nbsvm,
        "op2_url_filter": op2_url_filter,
        "op3_warc": op3_warc,
        "op4_mpeg_audio": op4_mpeg_audio,
        "op5_additive_ann": op5_additive_ann,
        "op6_mixing": op6_mixing,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_secrets": op8_secrets,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_line_dedup": op10_line_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op3_warc": OP3_SQL, "op4_mpeg_audio": OP4_SQL, "op5_additive_ann": OP5_SQL, "op6_mixing": OP6_SQL, "op7_ngram_jaccard": OP7_SQL, "op8_secrets": OP8_SQL}
