"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlink.llm import decontam, jaccard, licenses, mixing, sharding, substrings, token_shards, topk, toxicity, unigram
from cairnlink.llm.shared import new_folder, table

#: Folder of the public tokenizers' vocabulary files; only the driver reads it.
TOKENIZERS = "/opt/tokenizers"


def word_count(text: str = "text"):
    """Number of runs of other characters than space and the controls 9 to 13; 0 for null."""
    return F.when(F.col(text).isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))).cast("long")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    mixed = mixing.mix(docs, content=("size",))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark_overlaps(docs, table(spark, sf_dir, "benchmark")).where(~decontam.is_clean())
    return marked.select("doc_id", F.explode("overlaps").alias("x")).select("doc_id", "x.item_id", F.col("x.first").alias("first_word"), F.col("x.end").alias("end_word"), F.col("x.matched").alias("n_matched"))


def op3_token_shards(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_shards.write_shards(table(spark, sf_dir, "documents"), new_folder(spark, "shards"), f"{tokenizers}/byte_bpe_50k.tiktoken")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard.link_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", "class_id", "links", "text_links", "copies")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("_text")
    )
    placed = sharding.shard_rows(slim, 40, content=("doc_id", "_text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & whole)
    scaled = fit.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return topk.top_k(scaled, F.col("vec_id") % 50 == 0, 5)


OP7_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.count_tokens(docs, f"{tokenizers}/piece_bpe_32k.model").select("doc_id", "n_tokens")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagger = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score_texts(docs, tagger)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_token_shards": op3_token_shards,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_top_k": op7_top_k,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
with item as (select item_id, unnest(w) as word, unnest(range(len(w))) as j, len(w) as n, least(20, len(w)) as span from (select item_id, {_PLAIN} as w from benchmark)),
need as (select *, span - case when span >= 8 then span // 5 else 0 end as least_same from item),
doc as materialized (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos, len(w) as size from (select doc_id, {_PLAIN} as w from documents)),
lane as materialized (select doc_id, item_id, pos - j as off, any_value(size) as size, any_value(n) as n, any_value(span) as span, any_value(least_same) as least_same from doc join need using (word) group by all having count(*) >= any_value(least_same)),
place as (select *, unnest(range(greatest(0, -off), least(n, size - off))) as j from lane),
same as (select p.*, (d.word = i.word)::int as hit from place p join doc d on d.doc_id = p.doc_id and d.pos = p.off + p.j join item i on i.item_id = p.item_id and i.j = p.j),
summed as (select *, sum(hit) over (partition by doc_id, item_id, off order by j) as upto, max(j) over (partition by doc_id, item_id, off) as last from same),
good as (select a.doc_id, a.item_id, a.off, a.span, min(a.j) as low, max(a.j + a.span - 1) as high from summed a join summed b on b.doc_id = a.doc_id and b.item_id = a.item_id and b.off = a.off and b.j = a.j + a.span - 1
    where b.upto - a.upto + a.hit >= a.least_same group by all),
found as (select g.doc_id, g.item_id, g.off, g.off + g.low as first_word, g.off + g.high + 1 as end_word, cast(sum(s.hit) as bigint) as n_matched from good g join same s on s.doc_id = g.doc_id and s.item_id = g.item_id and s.off = g.off and s.j between g.low and g.high group by all)
select doc_id, item_id, first_word, end_word, n_matched from found qualify row_number() over (partition by doc_id, item_id order by n_matched desc, first_word, off) = 1
"""

OP4_SQL = f"""
with recursive text as materialized (select text, min(doc_id) as t, count(*) as copies, {_PLAIN} as w from documents group by text),
shingle as materialized (select distinct t, s from (select t, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from text)),
size as materialized (select t, count(*) as n from shingle group by t),
shared as (select a.t as a, b.t as b, count(*) as c from shingle a join shingle b on a.s = b.s and a.t < b.t group by all),
link as materialized (select a, b from shared join size x on x.t = a join size y on y.t = b where 5 * c >= 4 * (x.n + y.n - c)),
edge as materialized (select a, b from link union all select b, a from link),
reach as (select t, t as root from size union select e.b, r.root from reach r join edge e on e.a = r.t),
class as (select t, min(root) as class_id from reach group by t),
per as (select e.a as t, count(*) as text_links, sum(copies) as links from edge e join text x on x.t = e.b group by e.a)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, cast(case when c.t is null then 0 else coalesce(p.links, 0) + x.copies - 1 end as bigint) as links, coalesce(p.text_links, 0) as text_links, x.copies
from documents d join text x on d.text is not distinct from x.text left join class c on c.t = x.t left join per p on p.t = x.t
"""

OP5_SQL = r"""
with word as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from word)),
again as (select doc_id, i from win qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select doc_id, list(distinct j) as g from (select doc_id, unnest(range(i, i + 20)) as j from again) group by doc_id),
tagged as (select word.doc_id, w, coalesce(g, []) as g from word left join gone using (doc_id)),
kept as (select doc_id, w, g, case when len(g) = 0 then w else list(w[j] order by j) filter (not list_contains(g, j)) end as k from (select *, unnest(case when len(g) = 0 then [0] else range(1, len(w) + 1) end) as j from tagged) group by doc_id, w, g)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(g) as bigint) as n_removed, sha256(array_to_string(coalesce(k, []), ' ')) as kept_sha256 from kept
"""

ORACLES: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_top_k": OP7_SQL,
}
