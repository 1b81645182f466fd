"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and
returns a DataFrame; all but the last return the columns of documents. `run` writes what each stage
returns as Parquet to the checkpoint folder and hands that to the next.

Defined results: an empty table passes through all stages as an empty one. Null text counts as
empty. Documents without an id are never dropped as duplicates. Columns beyond those of documents
are left behind by the first stage, whatever their names. Rows that share an id are rows of their
own in all stages but the second, where an id that a lower one replaces goes with all its rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, table
from granary.llm.gam import fit_quality, quality_column
from granary.llm.mixing import mix_sources
from granary.llm.packing import pack_documents, public_vocabulary
from granary.llm.partenum import JoinSettings, jaccard_components
from granary.llm.queries import learnable, n_words, quality_weights
from granary.llm.secret_ledger import redact
from granary.operators.dedup import located
from granary.operators.filters import bloom, without
from granary.plans.session import discard, scratch

#: Setting of the session: a folder for the ledger of scanned texts, kept from run to run.
LEDGER = "spark.granary.secretLedger"
#: Sources, with one number each, are broadcast if there are so many at most.
SOURCES = 1 << 18

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document stays if the classifier gives it at least this score.
KEEP = 0.5

#: Near duplicates: five words, similarity 0.8 or more.
NEAR = JoinSettings(words=5, percent=80, spare=0.2, few=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (8) rejects go."""
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels"), 4, 2))
    return docs.withColumn("__score", quality_column(model, F.col("text"))).where(F.col("__score") >= KEEP).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the n-gram Jaccard join (5) links, the document with the least id stays."""
    groups = jaccard_components(docs, settings=NEAR, from_files=_from_files(docs))
    return without(docs.select(*COLUMNS), ["doc_id"], groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the secret scan (6) finds is masked. Where the session names a ledger, the scan takes it and adds to it."""
    masked = redact(docs, flag="__redacted", ledger_path=spark.conf.get(LEDGER, None))
    return masked.withColumn("n_chars", F.when(F.col("__redacted"), F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def _from_files(docs: DataFrame) -> bool:
    """Whether rows can be named by their places in the files read, as those of the stage before can."""
    try:
        return bool(docs.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix (9) takes it: once an epoch, not at all if it isn't taken.

    Rows are told apart by their place, so rows that share an id, or have none, are mixed one by one.
    Documents without a word have nothing to take and go. Most rows of a source are taken equally
    often; only the others, by a filter of their places, meet what is known of them.
    """
    docs = located(docs, _from_files(docs))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), "__file", "__row")
    weighted, weight = quality_weights(sized, table(spark, sf_dir, "labels"))
    mix = mix_sources(weighted, F.col("size"), weight, carry=("__file", "__row"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("__copies")
    mix = checkpointed(mix.select(F.col("source").alias("__source"), "__file", "__row", copies))
    often = mix.groupBy("__source", "__copies").agg(F.count(F.lit(1)).alias("n")).groupBy("__source").agg(F.max_by("__copies", F.struct("n", "__copies")).alias("__often"))
    often = checkpointed(often)
    often = F.broadcast(often) if often.count() <= SOURCES else often
    others = mix.join(often.withColumnRenamed("__source", "__other"), F.col("__source").eqNullSafe(F.col("__other"))).where("__copies <> __often")
    others = checkpointed(others.select(F.col("__file").alias("__at_file"), F.col("__row").alias("__at_row"), "__copies"))
    docs = docs.join(often, F.col("source").eqNullSafe(F.col("__source")))
    held = bloom(others, ["__at_file", "__at_row"])
    attached, place = held.attach(docs, F.col("__file"), F.col("__row")), (F.col("__file"), F.col("__row"))
    usual = attached.where(~held.maybe(*place)).select(*COLUMNS, F.col("__often").alias("__copies"))
    rest = held.detach(attached.where(held.maybe(*place))).join(others, (F.col("__file") == F.col("__at_file")) & (F.col("__row") == F.col("__at_row")), "left")
    rows = usual.unionByName(rest.select(*COLUMNS, F.coalesce("__copies", "__often").alias("__copies"))).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences (3)."""
    return pack_documents(docs, public_vocabulary)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: A fitted classifier and a tokenizer decide here, which SQL can't express; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                discard(spark, before)  # what the last stage read, and no other will
            before = path
    return docs
