"""Text vectors and similarity."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.vectors import cosine_similarity, l2_norm

EPS = 1e-8


def text_vectorizer(df: DataFrame, column: str, dimensions: int = 1024) -> PipelineModel:
    """Word counts weighted by rarity, fitted on ``df``."""
    return Pipeline(stages=[
        Tokenizer(inputCol=column, outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_vector")]).fit(df)


def embed_text(df: DataFrame, column: str, model: PipelineModel | None = None,
               dimensions: int = 1024) -> DataFrame:
    """Add ``n_tokens`` and ``embedding array<float>``, the mean of the text's weighted word vectors.

    The vector is not brought to length 1, so its norm (the importance) tells texts apart: rare words and few
    of them weigh more. Similarity divides by the norms itself. Any other array column can stand in.
    """
    df = df.withColumn(column, F.coalesce(column, F.lit("")))
    fitted = model or text_vectorizer(df, column, dimensions)
    n = F.greatest(F.size("_words"), F.lit(1))
    mean = F.transform(vector_to_array("_vector"), lambda x: (x / n).cast("float"))
    return (fitted.transform(df)
            .withColumn("n_tokens", F.aggregate(vector_to_array("_counts"), F.lit(0.0), lambda a, x: a + x).cast("long"))
            .withColumn("embedding", mean).drop("_words", "_counts", "_vector"))


def importance(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("importance", l2_norm(F.col(column)))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """Cosine similarity of the listed ``left_id, right_id`` pairs."""
    left = vectors.select(F.col(key).alias("left_id"), F.col("embedding").alias("_a"))
    right = vectors.select(F.col(key).alias("right_id"), F.col("embedding").alias("_b"))
    return (pairs.join(left, "left_id").join(right, "right_id")
            .withColumn("similarity", cosine_similarity(F.col("_a"), F.col("_b"))).drop("_a", "_b"))


def most_similar(probes: DataFrame, corpus: DataFrame, k: int = 10, threshold: float = -1.0,
                 probe_key: str = "probe_id", key: str = "vec_id", block: int = 512, tile: int = 8_192) -> DataFrame:
    """The ``k`` corpus vectors most similar to each probe, at or above ``threshold``.

    Every probe meets every vector, in blocks of about ``block`` probes and tiles of about ``tile`` vectors: one group of
    work for each pair of them, which keeps its own best ``k`` per probe, and the final ranking sees only those. Both sides
    are tables from start to end. For large sets of probes ``vector_index`` compares a part of the corpus only.
    """
    asked = probes.select(F.col(probe_key).alias("probe"), F.col("embedding").alias("unit")).filter("unit is not null")
    rows = corpus.select(F.col(key).alias("key"), F.col("embedding").alias("unit")).filter("unit is not null")
    blocks, tiles = (max(1, -(-df.count() // size)) for df, size in ((asked, block), (rows, tile)))
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    cell = ["tile", "block"]
    left = asked.withColumn("block", dealt("probe", blocks)).withColumn("tile", numbered(tiles)).repartition(blocks * tiles, *cell)
    right = rows.withColumn("tile", dealt("key", tiles)).withColumn("block", numbered(blocks)).repartition(blocks * tiles, *cell)
    names = (probe_key, probes.schema[probe_key].dataType), (key, corpus.schema[key].dataType)
    return ranked(left.groupBy(*cell).cogroup(right.groupBy(*cell)), k, threshold, *names)


def ranked(groups, k: int, threshold: float, probe: tuple, key: tuple) -> DataFrame:
    """Best ``k`` per probe over cogroups of ``probe, unit`` and ``key, unit``; ties by key."""
    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list = [(), (), ()]
        if a.num_rows and b.num_rows:
            vectors = [t.column("unit").combine_chunks() for t in (a, b)]
            width = max(pc.max(v.value_lengths()).as_py() for v in vectors)
            scores = np.matmul(*[m if n == 0 else m.T for n, m in enumerate(unit_rows(v, width) for v in vectors)])
            keys = np.array(b.column("key").to_pylist())
            order = np.argsort(keys, kind="stable")
            top = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
            value = np.take_along_axis(scores, top, 1)
            row, at = np.nonzero(value >= threshold)
            names = a.column("probe").to_pylist()
            found = [[names[r] for r in row], keys[top[row, at]].tolist(), value[row, at]]
        return pa.table([pa.array(found[0], a.schema.field("probe").type), pa.array(found[1], b.schema.field("key").type),
                         pa.array(found[2], pa.float64())], names=[probe[0], key[0], "similarity"])

    near = groups.applyInArrow(best, f"{probe[0]} {probe[1].simpleString()}, {key[0]} {key[1].simpleString()}, similarity double")
    order = W.partitionBy(probe[0]).orderBy(F.desc("similarity"), key[0])
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of length one; what is missing of ``width`` components is zero, a null component too."""
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.arange(len(column)), n)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), EPS)
