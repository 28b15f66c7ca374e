"""A training-data pipeline over ``documents`` from five of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``documents``:

1. quality rules: documents that fail a base rule or the likelihood ratio go;
2. near duplicates: of each group linked by five-word shingles at 0.8, the one
   with the least id stays (rows with equal id and text are one document);
3. decontamination: documents that overlap a benchmark item go;
4. secret scans: spans are replaced by a mark, and n_chars follows the text;
5. SentencePiece: ids of each text, and digests of ids and of the decoded text.

Rows are told apart by id and text, so an id that two texts share is decided
for each of them; rows with equal id and text are one document (ties), of which one
stays. Null ids and texts follow the operators: a null text has no words and
goes in stage 1; a null id is an id like any other. Texts of any length are taken
whole. An empty table gives an empty one. Columns that ``documents`` has beside
its own pass through the first four stages unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm import circulant_minhash, quality_rules, secret_scan, sentencepieces, spaced_seeds
from vintage.llm.common import materialize, table

#: Names of a row's identity while stages are joined; no table has them.
_ROW = ["__id_is_null", "__id", "__text_hash"]


def _identity(doc_id, text_hash) -> list:
    return [x.alias(n) for x, n in zip((doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), text_hash), _ROW)]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("*", *_identity(F.col("doc_id"), F.xxhash64("text")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passed(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = circulant_minhash.near_duplicates(docs, size=5).where("kept").select(*_identity(F.col("doc_id"), F.col("text_hash"))).distinct()
    return _identified(docs).join(kept, _ROW, "left_semi").dropDuplicates([*_ROW, "text"]).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = spaced_seeds.contaminated(docs, table(spark, sf_dir, "benchmark")).select(*_identity(F.col("doc_id"), F.col("text_hash"))).distinct()
    return _identified(docs).join(found, _ROW, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepieces.encode(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("sentencepiece", encoding),
]

#: The stages hash, train and segment in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
