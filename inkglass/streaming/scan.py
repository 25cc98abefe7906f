"""New documents against a stored corpus, as a stream.

A document's scan needs no other document, so the stream keeps no state: a
stateless sentence and fingerprint stage, a stream-static join with the index,
and one append a micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import arrow
from inkglass.functions import text as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def new_documents(spark: SparkSession, folder: str, files_each: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder)


def shared_points(docs: DataFrame, fingerprints: DataFrame, mode: str = "md5") -> DataFrame:
    """(doc_id, sentence_index, entry_id, position) of points that a sentence
    shares with the corpus; no aggregation, so it appends."""
    rows = docs.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_index", "s")).select("doc_id", "sentence_index", T.normalize_sentence(F.col("s")).alias("n"))
    rows = arrow.with_points(rows, "n", mode, ["doc_id", "sentence_index"]).select("doc_id", "sentence_index", F.explode("points").alias("p"))
    rows = rows.select("doc_id", "sentence_index", F.col("p.hash").alias("hash"), F.col("p.position").alias("position"))
    return rows.join(fingerprints.select("hash", "entry_id").distinct(), "hash").select("doc_id", "sentence_index", "entry_id", "position")


def run(docs: DataFrame, fingerprints: DataFrame, out: str, checkpoint: str):
    """Starts the scan; each batch is written once under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return shared_points(docs, fingerprints).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
