"""The opN_ queries: each applies its operator with production parameters to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutoffs.llm.common import remainder, table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.decontam import report

    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm import tokenfile

    shards = tokenfile.write(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return tokenfile.documents(shards)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = langid.train(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    out = langid.predict(docs, field)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.hmm import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), modulus=5, held=1)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.sharding import interleave

    out = interleave(table(spark, sf_dir, "documents"), shards=8, seed=42, stratum="source")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.quality import rules

    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.linededup import clean

    return clean(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.filteraudit import audit

    return audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.superminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=5, similarity=0.85)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutoffs.llm.negatives import hard_negatives, vectors

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


#: Scores as sums of products, ranks by windows.
OP13_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
v AS (SELECT vec_id, label, list_transform(x, lambda c: floor(256 * c::DOUBLE)) AS v FROM r),
s AS (SELECT a.vec_id AS a, a.label AS la, c.vec_id AS c, c.label AS lc, list_dot_product(a.v, c.v)::BIGINT AS s FROM v a, v c WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c AS p, s AS ps FROM s WHERE la = lc AND a <> c QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5),
n AS (SELECT a, p, ps, c, s, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, c) AS k FROM p JOIN s USING (a) WHERE la <> lc AND 100 * s BETWEEN 30 * ps AND 90 * ps)
SELECT a AS anchor_id, p AS positive_id, k::INT AS rank, c AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE k <= 10"""

#: The audit in one pass of SQL: smaller ids by a window over equal texts, orders by recursion.
OP11_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
k AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS m, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM f),
n AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM k GROUP BY ALL),
o(o, step, own, past) AS (SELECT '', 0, 0, 0 UNION ALL SELECT o || substr('ABCDE', i + 1, 1), step + 1, 1 << i, past | own FROM o, range(5) r(i) WHERE ((past | own) & (1 << i)) = 0 AND step < 5),
p AS (SELECT x.o AS filter_order, y.step, y.own, y.past FROM o x JOIN o y ON x.step = 5 AND y.step > 0 AND left(x.o, y.step) = y.o),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN (m & (own | past)) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN (m & own) > 0 AND (m & past) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN (m & own) > 0 AND (m & past) > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN m = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN (m & own) > 0 AND (m & past) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN (m & own) > 0 AND (m & past) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM n, p GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": OP11_SQL, "op13_hard_negatives": OP13_SQL}
