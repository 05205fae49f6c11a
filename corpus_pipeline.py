"""Training text from documents: quality, toxicity, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes what a stage
returns as Parquet in the shared folder and rereads it for the next, and then deletes the stage's own tables.

What holds for every stage: a null text is judged as the empty text and stays null in what is kept; a null doc_id is kept like any
other; rows that share a doc_id are judged each by its own text; rows repeated whole are judged alike, and near
copies of each other; texts of any length are taken whole; an empty table gives an empty one; columns beyond those of
documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, common, decontaminate, quality, simhash, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Folds held out from learning, as in the registered queries.
QUALITY_FOLDS, QUALITY_HELD, QUALITY_LEAST = 5, 0, 0.3
TOXICITY_FOLDS, TOXICITY_HELD, TOXICITY_MOST = 3, 1, 0.7


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. A score at the threshold stays; without enough labels all do.

    Null, empty and very long texts are scored like any other; ties and repeated rows score equally; null ids are never learned from.
    """
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, _labels(spark, sf_dir), common.crc_fold(F.col("doc_id"), QUALITY_FOLDS) != QUALITY_HELD)
    return quality.score(docs, model).where(F.col("score") >= QUALITY_LEAST).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity classifier rejects. A score at the threshold goes; without labels of both kinds all stay.

    Null and empty texts match nothing and stay; very long texts are gone through whole; ties and repeated rows score equally.
    """
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, _labels(spark, sf_dir), common.crc_fold(F.col("doc_id"), TOXICITY_FOLDS) != TOXICITY_HELD)
    return toxicity.score(docs, model).where(F.col("score") < TOXICITY_MOST).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row, a number of its own for each row, fixed by being stored."""
    return common.cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: that with the smallest doc_id, a null one last.

    Ties of doc_id go by a hash of the text, and rows repeated whole by their order in the stored table, so of repeated rows one
    stays. Rows are told apart by number: another text of a dropped row's id stays. Texts without words, null ones among
    them, are copies of each other. A component of any size is pre-aggregated before its rows meet.
    """
    docs = _numbered(docs)
    prints = common.cut(simhash.fingerprints(docs.select(F.col("row").alias("doc_id"), "text")), "prints")
    groups = simhash.components(prints).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    first = docs.select("row", order.alias("first")).join(groups, "row").groupBy("component_id").agg(F.min("first").alias("first"))
    return docs.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs, and no others that share their doc_id.

    Null and empty texts have no words and stay; very long texts are searched whole; repeated rows go or stay together; null or
    empty items have no windows.
    """
    docs = _numbered(docs)
    found = decontaminate.contamination(docs.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.where("contaminated").select(F.col("doc_id").alias("row")), "row", "left_anti").select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids (binary, little-endian unsigned 32-bit), their number, and digests of them and of what they decode to.

    A null or empty text has no tokens; a very long one is encoded whole; ties and repeated rows give a row each.
    """
    import public_tokenizers

    made = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", near_copies_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE encoding and decoding", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; what each stage's docstring says of nulls, long texts, ties and repeated rows holds of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = common.made()
        kept = common.cut(stage(spark, docs, sf_dir), name.split()[0].lower())
        common.drop_since(before, kept)
        common.drop_scratch(docs)
        docs = kept
    return docs


#: Learned models, SimHash and BPE merges can't be put in SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
