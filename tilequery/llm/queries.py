"""The registered queries of this package, each over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequery.llm import align, langid, lines, nearest, packing, pitmanyor, private, repeats, sharding, sketch, tiling, toxicity, whitening
from tilequery.llm.folds import fold
from tilequery.llm.registry import QUERIES, SQL, query, table

SHARDS = 16

_UNIT = "(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':{s}'), 1, 12))::bigint + 0.5)"
_SHARD = "list_position([{all}], list_max([{all}])) - 1"


def _shard_sql(n: int) -> str:
    # equal weights: the smallest -ln(u) is the largest u
    return _SHARD.format(all=", ".join(_UNIT.format(s=s) for s in range(n)))


_SHARDING_SQL = f"""
with bits as (select list_transform(range(256), lambda n: list_reduce([n::bigint, 1, 2, 3, 4, 5, 6, 7, 8],
                     lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) tab),
d as (select doc_id, text, coalesce(strlen(text), 0) + 1 size, ({_shard_sql(SHARDS)})::integer shard, ({_shard_sql(SHARDS + 1)})::integer grown_shard
      from documents),
c as (select d.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) text_crc32
      from d, bits)
select doc_id, size, text_crc32, 'key' law, shard, row_number() over (partition by shard order by doc_id) - 1 slot, grown_shard from c
"""


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its class of lines within two edits, and whether it stays."""
    return lines.line_classes(table(spark, sf_dir, "documents")).drop("row")


@query("op2_sharding", _SHARDING_SQL)
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 by its key, its slot there, and its shard of 17."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign_shards(keyed, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    slots = sharding.number_slots(placed, ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's words to 60 % or more in tiles of five words or more, with the item."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word passages that start earlier elsewhere."""
    kept = repeats.drop_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    from public_tokenizers import path

    return packing.pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for every twentieth, by inner product."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents: three-word shingles, similarity of 85 % or more."""
    return sketch.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two folds of three; ``und`` only without letters."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.filter(~held_out))
    found = model.predict(docs, reject=False) if model else docs.select("doc_id", F.lit(langid.UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two folds of three."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a Pitman-Yor model of six folds of seven, and under an add-one unigram."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = pitmanyor.score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and those that labelers, reliabilities and classifier add."""
    return private.personal_data(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 16 leading components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of the byte-level and the piece tokenizer meet in every document."""
    from public_tokenizers import path

    return align.token_links(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def all_queries():
    return QUERIES, SQL
