"""The registered query of each operator, with production parameters over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversations, decontamination, flac, jaccard, langid, merkle, mixing, phrases, pii, suffixes, toxicity, warc
from .shared import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("### Assistant: </turn> ok").alias("text"))
    messages = rows.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digest(chat.read_back(chat.format_chats(messages).select("conv_id", "formatted", "loss_role")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, ranked = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.taken(mixed, ranked)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.stored_features(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    return langid.identify(documents, documents.filter(~held_out)).withColumn("held_out", held_out)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


_ALL = (
    op1_chat_formatting, op2_mixing, op3_decontamination, op4_pii, op5_warc,
    op6_toxicity, op7_flac, op8_jaccard_join, op9_language_id, op10_suffix_dedup,
    op11_merkle, op12_conversation_repair, op13_phrase_fingerprint,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op1_chat_formatting": chat.SQL, "op3_decontamination": decontamination.SQL, "op5_warc": warc.SQL, "op8_jaccard_join": jaccard.SQL, "op10_suffix_dedup": suffixes.SQL, "op11_merkle": merkle.SQL, "op12_conversation_repair": conversations.SQL}
