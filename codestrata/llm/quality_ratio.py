"""Quality rules and a hashed n-gram log-likelihood ratio, in built-in functions only."""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 16_384
#: Log ratios are kept as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Scores of labelled documents are counted in bins of a thousandth, clamped at both ends.
BIN, EDGE = 1_000, 8_192
#: Added to the count of every bucket: a bucket with fewer grams than this says little.
PRIOR = 4
#: Trusted documents are cut in as many parts by checksum of the id; the last one is left to the threshold.
PARTS = 4
#: Characters of a word's ending.
ENDING = 3
LEAST_WORDS = 50


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def gram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of each word and of each pair of neighbouring word endings.

    Whole words say which vocabulary a text has; pairs of endings are few enough to be counted well in small
    corpora and tell prose from marks, capitals and listings.
    """
    bucket = lambda gram: F.pmod(F.crc32(gram), F.lit(buckets)).cast("int")
    n = F.size(words)
    pairs = lambda ends: F.zip_with(F.slice(ends, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ends, F.lit(2), n),
                                    lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, lambda w: bucket(w)),
                    let(F.transform(words, lambda w: F.substring(w, -ENDING, ENDING)), pairs))


def repeated_words(words: Column, window: int = 3) -> Column:
    """Number of words inside windows of three words that stand in the text twice or more.

    Windows are sorted by hash and place; neighbours with one hash are repeats, and the gaps between their
    places say how many words they cover together.
    """
    n = F.size(words)
    part = lambda at: F.slice(words, F.lit(at), F.greatest(n - window + 1, F.lit(0)))
    # Words are hashed one after the other: joining them first would make two texts for every window.
    hashed = F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3),
                        lambda ab, c: F.xxhash64(ab, c))

    def places(sorted_: Column) -> Column:
        same = lambda x, i: (F.get(sorted_, i - 1)["h"].eqNullSafe(x["h"]) | F.get(sorted_, i + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(F.filter(sorted_, same), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def count(h: Column) -> Column:
        rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(rows, places), covered))

    return let(hashed, count)


def base_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` and the words, ``_w``.

    Lines are the parts between line feeds; one with a word that equals an earlier line is a repeat.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))
    counted = docs.select(
        F.col(id_column).alias("doc_id"), text_words(text).alias("_w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")).alias("n_dup_lines"))
    n = F.col("n_words")
    return counted.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        let(F.col("_w"), repeated_words).alias("n_repeat_words"), "_w").withColumn(
        "base_failed", (n < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * n))


def gram_counts(docs: DataFrame, buckets: int, text_column: str = "text") -> DataFrame:
    """``bucket, n`` over all whole texts: at most one row per bucket and task crosses the exchange."""
    grams = docs.select(text_words(F.col(text_column)).alias("_w")).select(
        F.explode(let(F.col("_w"), lambda w: gram_buckets(w, buckets))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(target: DataFrame, raw: DataFrame, buckets: int) -> DataFrame:
    """One row, ``weights``: of each bucket ln(target share / raw share) in millionths.

    The raw counts are scaled to the target's size, and both are raised by ``PRIOR``.
    """
    every = F.broadcast(raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")))
    counts = every.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").join(
        raw.select("bucket", F.col("n").alias("r")), "bucket", "left").na.fill(0, ["t", "r"])
    # Bounded: one number for each of a fixed number of buckets.
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))).alias("c"),
                        F.sum("t").alias("ts"), F.greatest(F.sum("r"), F.lit(1)).alias("rs"))
    expected = lambda x: x["r"] * F.col("ts") / F.col("rs")
    return listed.select(F.transform("c", lambda x: F.round(F.log(
        (x["t"] + PRIOR) / (expected(x) + PRIOR)) * UNIT).cast("long")).alias("weights"))


def model(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, id_column: str = "doc_id",
          text_column: str = "text") -> list[int]:
    """Log ratio of every bucket between trusted documents and all documents.

    Trusted are the documents whose labels all say ``quality = 1``; all but
    those spared for the threshold make the target. Every document counts in the raw corpus. The
    result has one number per bucket; ids that are null are left out before the exchange.
    """
    good = trusted(labels, id_column).filter("quality = 1").filter(~spared(F.col(id_column))).select(id_column)
    # One plan at every size: a broadcast of the trusted ids would grow with the corpus.
    texts = docs.select(id_column, text_column).join(good.hint("shuffle_hash"), id_column, "left_semi")
    target = gram_counts(texts, buckets, text_column)
    return log_ratios(target, gram_counts(docs, buckets, text_column), buckets).first()["weights"]


def spared(doc_id: Column) -> Column:
    """Documents that the target leaves to the threshold, by checksum of the id."""
    return F.crc32(doc_id.cast("string")) % PARTS == PARTS - 1


def trusted(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One quality per id, the lowest of its labels; ids and labels that are null are left out."""
    return (labels.filter(F.col(id_column).isNotNull() & F.col("quality").isNotNull())
            .groupBy(id_column).agg(F.min("quality").alias("quality")))


def ratio_score(words: Column, weights: list[int]) -> Column:
    """Mean log ratio of the grams of a text; 0 without words."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded into one literal
    def mean(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
        return F.coalesce(F.try_divide(total, F.size(grams).cast("long") * F.lit(UNIT)), F.lit(0.0))
    return let(gram_buckets(words, len(weights)), mean)


def threshold(scored: DataFrame, labels: DataFrame) -> float | None:
    """Score from which documents are kept: the cut with the best balanced accuracy on labelled documents.

    Documents that fail the base rules or made the target take no part. Scores are counted by bin, so a fixed number of
    rows decides; a cut lies halfway between a bin and the occupied bin before it, and the lowest of equally good ones
    wins. None without labels of both kinds, or if no cut is better than keeping all.
    """
    known = trusted(labels).filter((F.col("quality") != 1) | spared(F.col("doc_id")))
    bins = (scored.filter("not base_failed").join(known, "doc_id")
            .select(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(F.col("score") * BIN))).alias("bin"), "quality")
            .groupBy("bin").agg(F.count_if(F.col("quality") == 1).alias("good"),
                                F.count_if(F.col("quality") != 1).alias("bad")))
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    cuts = bins.select(
        ((F.col("bin") + F.lag("bin").over(W.orderBy("bin")) + 1) / (2 * BIN)).alias("cut"),
        F.sum("good").over(before).alias("lost"), F.sum("bad").over(before).alias("cut_bad"),
        F.sum("good").over(every).alias("goods"), F.sum("bad").over(every).alias("bads"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    merit = wide("cut_bad") * F.col("goods") - wide("lost") * F.col("bads")
    best = cuts.withColumn("merit", merit).filter("merit > 0").orderBy(F.col("merit").desc(), "cut").first()
    return None if best is None else best["cut"]


def rate(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score`` of every document.

    Words are runs without ASCII white space. ``score`` is the mean, over all words and pairs of neighbouring word
    endings, of the log ratio between two multinomials over hash buckets: that of the trusted documents and that of the
    whole corpus. A document is kept if it passes the base rules and its score reaches the threshold found on the
    labelled documents; without labels of both kinds the base rules alone decide.

    Three passes over the texts, one of which exchanges those of the target's checksums to meet the trusted ids. The
    counts per bucket are bounded by ``buckets``. Null and empty texts have no words and fail; an unlabelled document is judged like any other;
    repeated rows are rated each; conflicting labels count as the lowest; an empty table gives no rows; other columns
    are ignored.
    """
    weights = model(docs, labels, buckets, id_column, text_column)
    scored = stored(base_rules(docs, id_column, text_column).withColumn("score", ratio_score(F.col("_w"), weights)).drop("_w"))
    cut = threshold(scored, labels.select(F.col(id_column).alias("doc_id"), "quality"))
    good = F.lit(True) if cut is None else F.col("score") >= cut
    return scored.withColumn("kept", ~F.col("base_failed") & good)
