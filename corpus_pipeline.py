"""A training corpus from documents: five stages, each a table of what the one before kept.

1. toxicity: documents that the clause grammar rejects go.
2. n-gram Jaccard join: of each group of near copies (five words, 0.8) the document of the least id stays.
3. decontamination: documents that hold too much of a benchmark item go.
4. PII: spans of personal data are replaced by their kind in brackets.
5. mixing: how many words the mix takes of each document.

All stages take whole tables, also empty ones. Columns they don't need may have any name or be missing, and go through
unchanged until the last stage. A null in any column is no error.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm import decontamination, jaccard, mixing, pii, toxicity
from shopflow.llm.shared import materialize, release, table, with_key, without, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose clauses score under the threshold, with all their columns.

    Null and empty texts match nothing and stay. Repeated rows are judged alike. Without labels the known words decide.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id, rows without an id last; of repeated rows one.

    Null, empty and wordless texts are near nothing and stay. Rows of one id and different texts are different documents. Groups of thousands are linked
    through one typical document each; ties in that go to the greater set id and change no group.
    """
    return jaccard.one_of_each(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the documents of which five per cent of the words or more are benchmark text.

    Texts without words stay. An empty benchmark drops nothing.
    """
    rows = with_key(docs)
    keyed = rows.select(F.col("_row_key").alias("doc_id"), "text")
    found = decontamination.report(decontamination.contamination(keyed, table(spark, sf_dir, "benchmark")))
    return without(rows, found.filter("contaminated").withColumnRenamed("doc_id", "_row_key"), key="_row_key").drop("_row_key")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, spans of personal data replaced by their kind in brackets, overlapping ones by the first's; n_chars follows.

    Null texts stay null. Candidates are found once and kept with their rows between training and replacing.
    """
    found = materialize(pii.with_rows(docs), "candidates", compression="zstd")
    out = pii.redact(found, pii.train(found))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per doc_id and source: its size, its source's size and target, and the words that the stored mix takes of it.

    A null source is one of its own; null and empty texts have size 0. The order of rows changes nothing.
    """
    return mixing.taken(*mixing.mix_sources(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: No SQL expresses the learned stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage wrote for itself goes when its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = written()
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, mark, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
