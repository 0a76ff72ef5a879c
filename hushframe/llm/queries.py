"""The registered queries of the corpus operators; their SQL is in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_texts
from .chat_format import digests, format_windows, read_back
from .collocations import mine_collocations
from .common import count_words, written
from .exact_dedup import exact_groups
from .langid import held_out, learn_profiles, predict_languages
from .line_dedup import dedup_lines
from .mixing import mix
from .quality import judge_quality
from .secrets import KINDS, find_secrets, listed
from .simhash import near_components
from .sql import PATTERN_RULES, SITE_RULES, SQL
from .topk import top_k
from .url_filter import Rule, judge_urls, site_rule
from .vector_codes import compress

BPE_FILE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(~held_out()).select("lang", "text"))
    found = predict_languages(docs, written(profiles, "profiles"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=3, most=3)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [site_rule(action, host, path) for host, path, action in SITE_RULES]
    rules += [Rule(name, action, regex, tokens) for name, action, regex, tokens in PATTERN_RULES]
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"select * from values (-1L, 0, 'user', '{said}'), (-1L, 1, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return digests(read_back(format_windows(conversations)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, with_digests=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )


def turns_of_weights(sources: DataFrame) -> DataFrame:
    """Weights 5, 2, 1, repeating, over the sources by code point, null last. The table has a row for each source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), F.pmod(place, F.lit(3)) + 1))


def quality_of(labels: DataFrame) -> DataFrame:
    """Documents labelled good count four times, others labelled once; those without a label count twice (see ``mix_all``)."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 4.0).when(F.col("quality") == 0, 1.0).otherwise(2.0).alias("quality"))


def mix_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, turns_of_weights, count_words(F.col("text")), quality_of(labels), unlabelled=2.0)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"), longest=4, least=30, top=2000, scale=2_000_000, covered=80)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_simhash, op3_url_filters, op4_chat_format, op5_bpe, op6_line_dedup, op7_secrets, op8_mix, op9_top_k,
        op10_exact_dedup, op11_quality_rules, op12_collocations,
        op13_vector_codes,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
