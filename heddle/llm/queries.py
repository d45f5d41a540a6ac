"""The thin queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, lexical, line_dedup, lm, mixing, ngram_join, quality, sharding, token_counts, topk, toxicity
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("key", "slots")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out(F.col("doc_id"))), grammar, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True, keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.pair_neighbours(table(spark, sf_dir, "conversations")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs), keep=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_jaccard_join, op3_mixing, op4_sharding, op5_exact_top_k, op6_toxicity, op7_bpe_round_trip, op8_chat_formatting, op9_quality_rules, op10_lm_scoring, op11_cross_tokenizer_alignment, op12_line_dedup, op13_ranked_lexical_search)}

#: Words of a text, in DuckDB.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: crc32 by its rule: a table of 256 remainders, made bit by bit, then one step a byte.
CRC_TABLE = "(select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(3988292384::bigint, c // 2) else c // 2 end)) as crc)"
CRC = "xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint)), lambda c, v: xor(c // 256, crc[xor(c % 256, v) + 1])))"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Terms of a text for search.
TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end)) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b using (s) group by 1, 2),
e as (select o.a, o.b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o.o >= 85 * (x.n + y.n - o.o)),
r as (select doc_id as node, doc_id as root from n union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as root from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.root, d.doc_id) as component_id
from documents d left join n using (doc_id) left join c on c.node = d.doc_id""",
    "op3_mixing": rf"""
with b as (select doc_id, text, len({WORDS}) as size, coalesce('s' || source, '~') as key, source, md5('11:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) as h from documents),
s as (select key, sum(size)::bigint as source_size, (row_number() over (order by key) - 1) % 3 + 1 as w from b group by 1),
r as (select *, source_size * 3 as cap, row_number() over (order by source_size * 3 / w, key) as n from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by n rows between unbounded preceding and 1 preceding), 0))::double / (sum(w) over () - coalesce(sum(w) over (order by n rows between unbounded preceding and 1 preceding), 0))::double as level from r),
v as (select coalesce(arg_min(level, n), 0) as level from l where level * w <= cap),
t as (select l.key, l.source_size, least(cap::double, v.level * w) as target from l, v),
p as (select b.key, b.doc_id, b.size, t.source_size, t.target, b.source, xx, sum(size) over (partition by b.key order by b.h rows unbounded preceding) - size as start from (select *, 1 as xx from b) b join t on t.key = b.key),
n as (select key, target, ceil(floor(target) / 1024)::bigint as n from t),
f as (select key, n, sum(n) over (order by key) - n as a, sum(n) over () as total from n where n > 0),
g as (select key, unnest(range(a::bigint, (a + n)::bigint)) as v, case when total > 1 then ceil(log2(total))::int else 0 end as bits from f),
h as (select key, coalesce(list_sum(list_transform(range(bits), lambda b: ((v >> b) % 2) << (bits - 1 - b))), 0)::bigint as slot from g),
k as (select key, slot, row_number() over (partition by key order by slot) - 1 as rank from h)
select doc_id, size, source_size, target, source, (select slot from k where k.key = p.key and k.rank = p.start // 1024 and p.size > 0 and p.start < floor(p.target)) as first_slot, (select sum(greatest(0, least(e * source_size + start + size, floor(target)) - (e * source_size + start)))::bigint from (values (0), (1), (2)) x(e)) as taken from p""",
    "op5_exact_top_k": """
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) z where rank <= 10""",
    "op8_chat_formatting": r"""
with t as (select conv_id // 2 as pair_id, conv_id % 2 as side, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by pair_id, side order by turn nulls first, role, text) - 1 as i, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as r from t),
k as (select pair_id, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from n group by 1),
f as (select a.pair_id, min(a.i) as i from n a join n b on a.pair_id = b.pair_id and a.i = b.i and a.side = 0 and b.side = 1 where a.role <> b.role or a.text <> b.text group by 1),
c as (select k.*, case when least(n0, n1) = 0 then 0 else coalesce(f.i, least(n0, n1)) end as m from k left join f using (pair_id)),
p as (select c.pair_id, m, n0, n1, coalesce(string_agg(n.r, '' order by n.i) filter (n.side = 0 and n.i < m), '') as prompt from c join n using (pair_id) group by 1, 2, 3, 4),
q as (select n.*, p.m, length(p.prompt) + coalesce(sum(length(n.r)) over (partition by n.pair_id, n.side order by n.i rows between unbounded preceding and 1 preceding), 0) as pos from n join p using (pair_id) where n.i >= p.m),
d as (select pair_id, side, string_agg(r, '' order by i) as txt, string_agg((pos + length(role) + 5)::bigint || '-' || (pos + length(r) - 1)::bigint, ';' order by i) filter (role = 'assistant') as mask from q group by 1, 2)
select p.pair_id, m as n_common, prompt, n0 as n_chosen, case when n0 > 0 then coalesce(a.txt, '') end as chosen, case when n0 > 0 then coalesce(a.mask, '') end as chosen_mask,
  n1 as n_rejected, case when n1 > 0 then coalesce(b.txt, '') end as rejected, case when n1 > 0 then coalesce(b.mask, '') end as rejected_mask
from p left join d a on a.pair_id = p.pair_id and a.side = 0 left join d b on b.pair_id = p.pair_id and b.side = 1""",
    "op9_quality_rules": rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
m as (select k, doc_id, len(w) as n, length(array_to_string(w, '')) as chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
t as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select k, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from (select k, i, count(*) over (partition by k, g) as c from t) x where c > 1) y group by 1)
select doc_id, m.n::bigint as n_words, chars as word_chars, symbols as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
  m.n < 50 or 100 * coalesce(r.n, 0) > 50 * m.n as base_failed,
  not (m.n < 50 or 100 * coalesce(r.n, 0) > 50 * m.n or 10 * symbols > m.n or 2 * (len(lines) - len(list_distinct(lines))) > len(lines) or chars < 2 * m.n or chars > 15 * m.n) as kept
from m left join r using (k)""",
    "op4_sharding": f"""
with recursive d as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
j as (select n, coalesce(doc_id, 0)::hugeint as k, -1::bigint as was, -1::bigint as b, 0::bigint as j from d
  union all select n, k2, b, j, floor((j + 1)::double * (2147483648::double / (k2 // 8589934592 + 1)::double))::bigint
  from (select *, ((k // 4294967296 * 2862933555777941757 % 4294967296) * 4294967296 + k % 4294967296 * 2862933555777941757 + 1) % 18446744073709551616 as k2 from j where j < 9) z),
e as (select n, max(b) filter (b < 8) as shard, max(b) as grown from j group by 1),
c as (select d.n, doc_id, octet_length(encode(text)) + 1 as size, case when text = '' then 0 else {CRC} end as text_crc32, shard::int as shard, grown::int as grown_shard from d join e using (n), {CRC_TABLE} t)
select doc_id, size, text_crc32, shard, grown_shard, 'key' as law, row_number() over (partition by shard order by substr(md5(concat_ws(':', doc_id::varchar, text_crc32::varchar)), 1, 3), doc_id nulls first, text_crc32, size) - 1 as slot from c""",
    "op12_line_dedup": rf"""
with d as (select row_number() over () as k, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select k, doc_id, i, l[i] as line, translate(trim(l[i], {BLANKS}), '{UPPER}', '{LOWER}') as key from (select *, unnest(range(1, len(l) + 1)) as i from d)),
m as (select key, max(doc_id) as top from x where length(key) >= 40 group by 1 having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (doc_id < top) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (top is null or doc_id = top), '')) as kept_sha256
from x left join m using (key) group by k, doc_id""",
    "op13_ranked_lexical_search": rf"""
with d as (select row_number() over () as k, doc_id, {TERMS} as w from documents),
n as (select k, doc_id, w, len(w) as n from d where len(w) > 0),
g as (select count(*) as docs, sum(n)::bigint as terms from n),
f as (select k, term, count(*) as tf from (select k, unnest(w) as term from n) group by 1, 2),
v as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, g group by 1, docs),
q as (select item_id, term, count(*) as times from (select item_id, unnest({TERMS}) as term from benchmark) group by 1, 2),
s as (select item_id, doc_id, k, sum(times * v.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score from q join f using (term) join v using (term) join n using (k), g group by 1, 2, 3)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) z where rank <= 10""",
}
