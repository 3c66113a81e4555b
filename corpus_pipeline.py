"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next one's docs.  All stages but the
last return the columns of documents and only drop or repeat rows:

1. quality classifier: documents that importance resampling rejects go;
2. quality rules: documents that fail the rules go;
3. near duplicates: one document of each component of 5-word Jaccard 0.8 stays;
4. source mix: documents are emitted as often as their source's rate says;
5. packing: pieces of token sequences with their place.

Cases: a null or empty text weighs 0 for the classifier and has no words, so it
fails the rules' base; given to a later stage alone it is near no other, has size 0 for
the mix and packs as its end token.  A very long text is read whole by every stage
and cut into pieces by the last only.  A null id draws as one and is never a
copy by its id; of rows that repeat an id one stays after the third stage, of
copies under several ids the smallest, and the mix draws rows of equal id alike.
A null source is one of its own.  Without good labels the classifier keeps all.
Empty documents give an empty result with the same columns.  Further columns, whatever
their names, travel through the first four stages; the last returns its own.

No SQL twin: the classifier's model, the components and the packing plan are
not expressible in SQL.  tests/llm/test_pipeline.py checks every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import importance, minhash, mixing, packing, rules
from ledgerline.llm.text import whole_row
from ledgerline.session import materialize, ship_package

#: Words of a shingle and least similarity (%) of the near-duplicate stage; op3 has its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship_package(spark)
    model = importance.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return importance.weigh(docs, model).where("kept").select("row.*")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component; of rows that repeat it, one."""
    ship_package(spark)
    copies = minhash.near_duplicates(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT).where("NOT kept").select(
        F.col("doc_id").alias("gone"), F.lit(True).alias("copy"))
    twice = docs.groupBy(F.col("doc_id").alias("gone")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND gone IS NOT NULL")
    gone = copies.union(twice.select("gone", F.lit(False))).groupBy("gone").agg(F.max("copy").alias("copy"))
    gone = materialize(gone, "pipeline-gone")
    marked = docs.select(whole_row(docs), F.col("doc_id").alias("id")).join(gone, F.col("id") == F.col("gone"), "left")
    once = marked.where("gone IS NULL").select("row.*")
    return once.unionByName(marked.where("NOT copy").dropDuplicates(["id"]).select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.emit(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequence and offset."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
