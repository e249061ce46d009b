"""Vectors of texts from a model of the caller, in Arrow batches on the executors."""

from collections.abc import Callable
from hashlib import md5

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Arrays = dict[str, np.ndarray]


def save_arrays(spark: SparkSession, arrays: Arrays, folder: str) -> None:
    """Store the named arrays of a model, one row each, in a folder that Spark reaches."""
    rows = [(name, list(a.shape), str(a.dtype), a.tobytes()) for name, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, kind string, data binary").write.parquet(folder)


def load_arrays(spark: SparkSession, folder: str, most_bytes: int = 1 << 28) -> Arrays:
    """The arrays of ``save_arrays``. A model above ``most_bytes`` is an error: every executor holds it whole."""
    rows = spark.read.parquet(folder)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"the model has {size} bytes, more than {most_bytes}")
    return {r.name: np.frombuffer(bytes(r.data), r.kind).reshape(r.shape) for r in rows.collect()}


def model_vectors(df: DataFrame, column: str, arrays: Arrays,
                  predict: Callable[[Arrays, np.ndarray], np.ndarray], batch: int = 64) -> DataFrame:
    """Add ``embedding array<double>``, the row of ``predict(arrays, texts)`` for each text.

    The arrays go to every executor once and each Python worker keeps them; texts come whole, in batches of ``batch``
    rows. Null reads as the empty text; an empty table gives no rows; other columns stay, an old ``embedding`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(arrays)

    def make():
        held = shared.value
        return lambda texts: np.asarray(predict(held, texts), np.float64)

    vector = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)
    return df.withColumn("embedding", vector(F.coalesce(F.col(column), F.lit(""))))


def mean_word_rows(arrays: Arrays, texts: np.ndarray) -> np.ndarray:
    """Mean of the rows of ``arrays['rows']`` that a text's words hash to; zeros without words.

    Words are cut at ASCII white space and compared with A-Z in lower case; the first four hex digits of a word's MD5,
    modulo the number of rows, give its row.
    """
    table, known = arrays["rows"], {}
    out = np.zeros((len(texts), table.shape[1]))
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        for word in words:
            if word not in known:
                known[word] = int(md5(word).hexdigest()[:4], 16) % len(table)
        if words:
            counts = np.bincount([known[w] for w in words], minlength=len(table))
            out[k] = counts @ table / len(words)
    return out
