"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import alignment, chat, extraction, media, neardup, pii, ranking, secrets, urls, warc
from tidemill.llm.decontam import contaminated
from tidemill.llm.mixing import mix_sources
from tidemill.llm.neardup import near_duplicates
from tidemill.llm.toxicity import toxicity
from tidemill.llm.work import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, [*urls.HOST_RULES, *urls.read_rules()]).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    return media.digest(media.media_features(stored, with_payload=True))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.store_pieces(chat.fold_events(chat.as_events(turns.union(more)))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_archive_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, kinds: tuple[str, ...], *more: Column) -> DataFrame:
    """From (doc_id, spans): how many there are of each base kind, the base spans' hash, all spans as text; and more columns."""
    spans = F.col("spans")
    counts = [F.size(of_kinds(spans, kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(told(of_kinds(spans, *kinds)), 256).alias("base_sha256"), told(spans).alias("spans"), *more)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")  # in percent, as the spans are listed
    return digest(found, pii.BASE, scores.alias("scores"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"))
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = alignment.with_link_counts(settled(aligned.withColumn("groups_sha256", groups).drop("groups")))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_source_mixing, op3_toxicity, op4_minhash_neardup, op5_media_jpeg,
        op6_decontamination, op7_chat_format, op8_warc, op9_pii, op10_secrets,
        op11_html_extraction, op12_ranked_search, op13_token_alignment,
    )
}

#: The others can't be said in SQL: learned scores, a knapsack, JPEG, BM25 retrieval, decoded keys, a parser's events, tokenizers.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": urls.sql(),
    "op4_minhash_neardup": neardup.SQL,
    "op7_chat_format": chat.SQL,
    "op8_warc": warc.SQL,
    "op9_pii": pii.sql(),
    "op12_ranked_search": ranking.SQL,
}
