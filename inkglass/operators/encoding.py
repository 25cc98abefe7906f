"""Vectors of texts by an injected encoder, each text encoded once.

Vectors lie in a table by the hash of their text and the model's name. A run
encodes what the table lacks, found by an anti-join; a task opens its encoder
once. A run that is lost midway leaves nothing that a later one counts on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.session import ship

#: Opens an encoder in a task: texts to one vector of the model's dimension each.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]
SCHEMA = "model string, hash string, vector array<float>"


def _encode(open_: Encoder, model: str, dimension: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for whole in batches:
            encode = encode or open_()
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                v = np.asarray(encode(part.column(1).to_pylist()), np.float32)
                if v.shape != (part.num_rows, dimension):
                    raise ValueError(f"{model} gave {v.shape}, not {(part.num_rows, dimension)}")
                if not np.isfinite(v).all():
                    raise ValueError(f"{model} gave vectors that are not finite")
                yield pa.record_batch([pa.array([model] * part.num_rows, pa.string()), part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dimension).cast(pa.list_(pa.float32()))], names=["model", "hash", "vector"])

    return run


def encoded(rows: DataFrame, path: str, open_: Encoder, model: str, dimension: int, batch: int = 64) -> DataFrame:
    """``rows`` (id, text, ...) with ``vector``, unit length or zero; null where
    the text is null. Texts that the table at ``path`` has for ``model`` are
    not encoded again, equal texts once."""
    spark = rows.sparkSession
    ship(spark)
    hashed = rows.withColumn("_hash", F.sha2("text", 256))
    try:
        have = spark.read.schema(SCHEMA).parquet(path).where(F.col("model") == model)
        have.limit(1).count()
    except AnalysisException:  # there is none yet
        have = spark.createDataFrame([], SCHEMA)
    new = hashed.where("text is not null").select(F.col("_hash").alias("hash"), "text").dropDuplicates(["hash"]).join(have.select("hash"), "hash", "left_anti")
    if not new.isEmpty():
        new.mapInArrow(_encode(open_, model, dimension, batch), SCHEMA).write.mode("append").parquet(path)
        have = spark.read.schema(SCHEMA).parquet(path).where(F.col("model") == model)
    all_ = have.dropDuplicates(["hash"])  # two runs at once may both have encoded a text
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("vector", lambda x: F.when(F.col("_norm") < 1e-8, F.lit(0.0)).otherwise(x / F.col("_norm")).cast("float"))
    units = all_.withColumn("_norm", norm).select(F.col("hash").alias("_of"), unit.alias("vector"))
    return hashed.join(units, F.col("_hash") == F.col("_of"), "left").drop("_hash", "_of")
