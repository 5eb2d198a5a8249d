"""One query for each operator, over its whole table, and SQL for those that SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import ann, bpe, language, line_dedup, near_dup, packing, periodic_runs, quality, resampling, sharding, suffix_dedup, token_counts, topk

#: Tokens of a sequence, and of a text that is over the limit.
SEQUENCE, LIMIT = 2048, 4096


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(_documents(spark, sf_dir), path), path)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), 20, whole=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"), 10)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir), width=4, percent=80)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rows = sharding.shards(docs, sharding.text_dims(docs), n_shards=8)
    return rows.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).withColumn("held_out", held_out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(_documents(spark, sf_dir))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0, F.lit(False))
    rows = quality.score(docs, quality.fit(docs, labels.where(~held_out)))
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document or so, by a hash of its id, repeats a block of its own words up to its end."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    w = F.regexp_extract_all(F.col("text"), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    hit = F.coalesce((F.col("h") % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = rows.withColumn("w", F.when(hit, w)).withColumn("n", F.size("w").cast("long")).withColumn("a", F.col("g") % F.col("n"))
    rest = F.col("n") - F.col("a")
    rows = rows.withColumn("p", 1 + F.floor(rest / (3 + F.col("g") % 8)))
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int")))
    planted = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), again), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(hit, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.collapse_runs(_with_planted_runs(_documents(spark, sf_dir)))

    def better(a, b):
        first = a["length"] * b["period"] - b["length"] * a["period"]
        return F.when(first > 0, -1).when(first < 0, 1).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])

    best = F.get(F.array_sort("runs", lambda a, b: F.signum(better(a, b)).cast("int")), F.lit(0))
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_topk, op3_token_counts, op4_ann, op5_suffix_dedup, op6_packing, op7_near_dup, op8_sharding, op9_language, op10_line_dedup,
        op11_quality, op12_periodic_runs, op13_resampling,
    )
}

ORACLE = {
    "op2_topk": """
with v as (
  select distinct vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as c
  from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pairs as (
  select q.vec_id as query_id, v.vec_id,
    cast(list_sum([p[1] * p[2] for p in list_zip(q.c, v.c)]) as bigint) as score
  from v q join v on q.vec_id % 20 = 0 and v.vec_id <> q.vec_id and len(q.c) = len(v.c)
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
where rank <= 20""",
    "op7_near_dup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w
  from documents
), grams as (
  select distinct doc_id, unnest(case when len(w) >= 4 then [w[i:i+3] for i in range(1, len(w) - 2)]
    when len(w) > 0 then [w] else [] end) as g
  from words
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), links as (
  select a.doc_id as u, b.doc_id as v
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(node, root) as (
  select doc_id, doc_id from words
  union
  select l.v, r.root from reach r join links l on l.u = r.node where r.root < l.v
), found as (
  select node, min(root) as root from reach group by node
)
select w.doc_id, coalesce(s.n, 0) as n_shingles, f.root as component_id, f.root = w.doc_id as kept
from words w left join sizes s using (doc_id) join found f on f.node = w.doc_id""",
    "op13_resampling": r"""
with table256 as (
  select [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
    for i in range(256)] as tab
), docs as (
  select row_number() over () as row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), wanted as (
  select unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
  from benchmark
), said as (
  select row, unnest(w) as word from docs
), bytes as (
  select word, [cast('0x' || h as bigint) for h in regexp_extract_all(hex(encode(word)), '..')] as b
  from (select word from said union select word from wanted)
), hashed as (
  select word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket
  from bytes, table256
), corpus as (
  select bucket, count(*) as s from said join hashed using (word) group by bucket
), target as (
  select bucket, count(*) as t from wanted join hashed using (word) group by bucket
), totals as (
  select (select count(*) from said) as total_s, (select count(*) from wanted) as total_t
), gain as (
  select bucket, cast(floor(1000 * ln(cast((coalesce(t, 0) + 1) * (total_s + 10000) as double)
    / cast((coalesce(s, 0) + 1) * (total_t + 10000) as double))) as bigint) as gain
  from corpus full join target using (bucket), totals
), weights as (
  select row, sum(gain) as weight from said join hashed using (word) join gain using (bucket) group by row
), noise as (
  select row, doc_id, len(w) as n, coalesce(weight, 0) as weight,
    cast('0x' || substr(sha256('2024:' || cast(doc_id as varchar)), 1, 8) as bigint) as h
  from docs left join weights using (row)
), scored as (
  select row, doc_id, n, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) as bigint) as score from noise
), ranked as (
  select row, row_number() over (order by score desc, doc_id) as rank, count(*) over () as able
  from scored where n >= 20 and score is not null
)
select doc_id, cast(n as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
  cast(case when rank <= able * 10 // 100 then rank end as bigint) as rank
from scored left join ranked using (row)""",
}
