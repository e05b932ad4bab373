"""One query per operator over its whole table, and SQL where SQL can state it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import (
    bagminhash,
    decontaminate,
    language,
    license_scan,
    periodic_runs,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    sharding,
    spelling,
    token_counts,
    token_store,
    voronoi,
)
from demandlens.llm.common import table
from demandlens.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

#: Bytes of text in a shard of the sharding query.
SHARD_BYTES = 1 << 20
END_ID = 2


@functools.cache
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    store = token_store.TokenStore(spark, shared_dir(spark, "token-store"))
    store.write(docs, vocabulary("byte_bpe_50k.json"), END_ID)
    runs = store.locate(docs).unionByName(store.null_runs())
    return store.read(runs).withColumnRenamed("doc_key", "doc_id")


def op2_voronoi_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = voronoi.integer_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    found = voronoi.top_k(vectors, F.col("id") % 50 == 0, 5)
    return found.withColumnRenamed("id", "vec_id")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"),
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        count(3).alias("n_random"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and whether decoding them gives the text."""
    model = vocabulary("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = docs.withColumn("ids", sentencepiece_codec.encode(F.col("text"), model))
    plain = F.replace("text", F.lit("▁"), F.lit(" "))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        (sentencepiece_codec.decode(F.col("ids"), model) == plain).alias("is_round_trip"),
    )


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(F.col("key").alias("doc_id"), "item_id", "score", "full_score")


def op6_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    found = bagminhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "class_size", "is_kept")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every text; null texts have none."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = license_scan.licenses(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.array_join(found, ",").alias("licenses"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~held_out(F.col("doc_id"))))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        language.identify(F.col("text"), model).alias("found"),
    ).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.is_ambiguous"
    )


def held_out(doc_id):
    """A third of the ids; rows without an id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = vocabulary("piece_bpe_32k.model")
    return docs.select("doc_id", token_counts.token_count(F.col("text"), model).alias("n_tokens"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shards(table(spark, folder, "documents"), SHARD_BYTES)
    return placed.select(F.col("key").alias("doc_id"), "n_bytes", "shard", "depth", "shard_bytes")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.counted_words(table(spark, folder, "documents"), misspell=True)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Trusted texts are those labelled as good and not as toxic."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = table(spark, folder, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0")
    found = quality_rules.judge(docs, quality_rules.learn(docs, good.select("doc_id")))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "score",
    )


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.scan(table(spark, folder, "documents"), plant=True)
    return found.select(
        F.col("key").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli",
        "runs_sha256", "collapsed_sha256", "n_words",
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def all_queries() -> dict[str, Query]:
    own = (
        op1_token_store, op2_voronoi_top_k, op3_secret_scan, op4_sentencepiece,
        op5_decontamination, op6_bagminhash, op7_license_scan, op8_language_id,
        op9_token_counts, op10_sharding, op11_spelling_variants,
        op12_quality_rules, op13_periodic_runs, pipeline,
    )
    return {q.__name__: q for q in own}


def all_statements() -> dict[str, str]:
    licence_lines = ", ".join(
        f"('{text}', '{name}')" for text, name in sorted(_single_sentences().items())
    )
    return {
        "op2_voronoi_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored)
WHERE rank <= 5""",
        "op7_license_scan": f"""
WITH known(sentence, license) AS (VALUES {licence_lines}),
pieces AS (
    SELECT doc_id, text, unnest(regexp_split_to_array(coalesce(text, ''),
        '[.!?;]+[")'']*\\s|:\\s*\\n|\\n|[.!?;:]\\s*$')) AS piece
    FROM documents
), found AS (
    SELECT doc_id, text, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
    FROM pieces LEFT JOIN known
        ON sentence = trim(regexp_replace(lower(piece), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))
    GROUP BY doc_id, text
)
SELECT doc_id, coalesce(licenses, '') AS licenses FROM found""",
        "op10_sharding": f"""
WITH rows AS (
    SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
        lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)),
            60, '0') AS bits
    FROM documents
), each AS (SELECT *, substr(bits, 1, depth) AS shard FROM rows, range(0, 41) t(depth)
), sums AS (
    SELECT depth, shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n
    FROM each GROUP BY ALL
), leaf AS (
    SELECT e.doc_id, e.n_bytes, e.shard, e.depth, s.shard_bytes,
        row_number() OVER (PARTITION BY e.doc_id ORDER BY e.depth) AS place
    FROM each e JOIN sums s ON e.depth = s.depth AND e.shard = s.shard
    WHERE s.shard_bytes <= {SHARD_BYTES} OR s.n = 1
)
SELECT doc_id, n_bytes, shard, CAST(depth AS INTEGER) AS depth, shard_bytes
FROM leaf WHERE place = 1""",
    }


def _single_sentences() -> dict[str, str]:
    """Known sentences that are a licence by themselves; the SQL knows only these."""
    rules = license_scan.RULES
    return {
        license_scan.normalised(s): rules[k] for k, s in license_scan.SENTENCES.items() if k in rules
    }
