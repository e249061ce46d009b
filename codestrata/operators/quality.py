"""Source-quality operators: duplicates, complexity, coupling, health."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, rules
from ..functions.numbers import py_round
from ..functions.paths import line_span, split_lines
from ..sources.schemas import REFACTOR_SUGGESTION, conform
from . import graph
from .grouping import skew_join
from .history import FILE
from .python_source import with_sha

# Decision words of the lexical measure, matched as whole ASCII words.
DECISION_WORDS = ("if", "elif", "for", "while", "except", "assert", "case", "and", "or")


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select(*FILE, F.posexplode(split_lines(F.col("content")))).select(
        *FILE, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def duplicate_blocks(files: DataFrame, min_lines: int = 5) -> DataFrame:
    """Runs of ``min_lines`` consecutive lines found at two or more places.

    Windows are cut and hashed inside each file row, so only two hashes and a location per
    window are shuffled; a block copied everywhere is counted before the exchange.
    """
    lines = split_lines(F.col("content"))
    hashes = files.select(*FILE, F.transform(lines, lambda line: F.xxhash64(line)).alias("_lines"),
                          F.transform(lines, lambda line: F.xxhash64(F.lit("second"), line)).alias("_others"))
    n = F.size("_lines")
    starts = F.when(n >= min_lines, F.sequence(F.lit(0), n - min_lines))
    # Two line hashes with different starts, so that one collision of lines does not pass both.
    keys = F.transform(starts, lambda i: F.struct(
        F.xxhash64(F.slice("_lines", i + 1, min_lines)).alias("h1"),
        F.xxhash64(F.slice("_others", i + 1, min_lines)).alias("h2")))
    placed = (hashes.select(*FILE, F.posexplode(keys).alias("start", "_key"))
              .select(*FILE, "start", "_key.h1", "_key.h2"))
    return (placed.groupBy("repo_id", "h1", "h2")
            .agg(F.count(F.lit(1)).alias("occurrences"),
                 F.min(F.struct("file_path", "start")).alias("_first"))
            .filter(F.col("occurrences") >= 2)
            .select("repo_id", "h1", "h2", "occurrences", F.col("_first.file_path").alias("file_path"),
                    (F.col("_first.start") + 1).alias("line_no")))


def _with_source(spans: DataFrame, texts: DataFrame, key, name: str = "code_snippet") -> DataFrame:
    """Add the text of each span ``first..last``; ``texts``: the key columns and ``content``.

    The spans of one text are listed first, so every text is joined and split once however many
    spans it has. The list is bounded by the lines of that one text.
    """
    key = [key] if isinstance(key, str) else list(key)
    others = [c for c in spans.columns if c not in key]
    listed = spans.groupBy(*key).agg(F.collect_list(F.struct(*others)).alias("_spans"))
    split = skew_join(texts, listed.hint("merge"), key).withColumn("_lines", split_lines(F.col("content"))).drop("content")
    filled = F.transform("_spans", lambda s: s.withField(
        name, line_span(F.col("_lines"), s["first"], s["last"])))
    # The generator takes the expression itself: on a column the optimizer would add a size
    # filter below, with the split copied into its loop.
    kept = [c for c in split.columns if c not in ("_spans", "_lines")]
    return split.select(*kept, F.inline(filled)).drop("first", "last")


def with_snippet(blocks: DataFrame, files: DataFrame, min_lines: int = 5) -> DataFrame:
    """Add the text of each block, read at its first location."""
    line = F.col("line_no")
    spans = blocks.withColumn("first", line).withColumn("last", line + (min_lines - 1))
    return _with_source(spans, files.select(*FILE, "content"), FILE)


def _suggestion(rows: DataFrame, kind: str, description: Column, impact: str, effort: Column | str,
                snippet: Column, change: Column) -> DataFrame:
    effort = F.lit(effort) if isinstance(effort, str) else effort
    return conform(rows.select(
        *FILE, F.lit(kind).alias("suggestion_type"), description.alias("description"),
        F.lit(impact).alias("impact"), effort.alias("effort_estimate"),
        snippet.alias("code_snippet"), change.alias("suggested_changes")), REFACTOR_SUGGESTION)


def duplicate_suggestions(files: DataFrame, min_lines: int = 5) -> DataFrame:
    """The description prints the number of places, worded as lines."""
    rows = with_snippet(duplicate_blocks(files, min_lines), files, min_lines)
    text = F.concat(F.lit("Found duplicate code block of "), F.col("occurrences").cast("string"),
                    F.lit(" lines"))
    return _suggestion(rows, "duplication", text, V.DUPLICATION_IMPACT, "Medium",
                       F.col("code_snippet"), F.lit(V.DUPLICATION_CHANGE))


def file_complexity(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Mean over functions, classes and methods; 0 for a file without any."""
    scored = (blocks.filter(F.col("kind").isin("function", "class", "method"))
              .groupBy("content_sha").agg(F.avg("complexity").alias("_mean")))
    return (skew_join(with_sha(files).select(*FILE, "content_sha"), scored.hint("merge"), ["content_sha"], "left")
            .select(*FILE, F.coalesce("_mean", F.lit(0.0)).alias("complexity")))


def blob_complexity(blocks: DataFrame, blobs: DataFrame) -> DataFrame:
    """Complexity of every stored file version, ready for ``history.attach_complexity``."""
    scored = (blocks.filter(F.col("kind").isin("function", "class", "method"))
              .groupBy("content_sha").agg(F.avg("complexity").alias("_mean")))
    keyed = blobs.withColumn("content_sha", F.coalesce("content_sha", F.sha2("content", 256)))
    versions = keyed.select("repo_id", "commit_hash", "file_path", "content_sha")
    return (skew_join(versions, scored.hint("merge"), ["content_sha"], "left")
            .select("repo_id", "commit_hash", "file_path",
                    F.coalesce("_mean", F.lit(0.0)).alias("complexity")))


def module_complexity(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Sum over top-level functions; 0 for a file without any."""
    scored = (blocks.filter(F.col("kind") == "function")
              .groupBy("content_sha").agg(F.sum("complexity").alias("_sum")))
    return (skew_join(with_sha(files).select(*FILE, "content_sha"), scored.hint("merge"), ["content_sha"], "left")
            .select(*FILE, F.coalesce("_sum", F.lit(0).cast("long")).cast("double").alias("complexity")))


def complexity_suggestions(blocks: DataFrame, files: DataFrame, threshold: float = 10.0,
                           include_methods: bool = False) -> DataFrame:
    kinds = ["function", "method"] if include_methods else ["function"]
    heavy = blocks.filter(F.col("kind").isin(*kinds) & (F.col("complexity") > threshold)).select(
        "content_sha", "name", F.col("lineno").alias("first"), F.col("endline").alias("last"), "complexity")
    rows = _with_source(heavy, with_sha(files).select(*FILE, "content_sha", "content"), "content_sha")
    text = F.concat(F.lit("Function '"), F.col("name"), F.lit("' has high cyclomatic complexity ("),
                    F.col("complexity").cast("string"), F.lit(")"))
    return _suggestion(rows, "complexity", text, V.COMPLEXITY_IMPACT, "High",
                       F.col("code_snippet"), rules.complexity_advice(F.col("complexity")))


def cycle_suggestions(cycles: DataFrame) -> DataFrame:
    """One dependency suggestion per cycle of ``graph.circular_dependencies``."""
    rows = cycles.withColumn("file_path", F.get("cycle", F.lit(0)))
    text = F.concat(F.lit("Found circular dependency between "), F.array_join("cycle", ", "))
    return _suggestion(rows, "dependency", text, V.CYCLE_IMPACT, "High",
                       F.lit(None).cast("string"), F.lit(V.CYCLE_CHANGE))


def coupling_suggestions(coupled: DataFrame) -> DataFrame:
    """One dependency suggestion per node of ``graph.high_coupling``."""
    rows = coupled.withColumn("file_path", F.col("node"))
    text = F.concat(F.lit("Module has high coupling ("), F.col("in_degree").cast("string"),
                    F.lit(" incoming, "), F.col("out_degree").cast("string"),
                    F.lit(" outgoing dependencies)"))
    return _suggestion(rows, "dependency", text, V.COUPLING_IMPACT, "Medium",
                       F.lit(None).cast("string"), F.lit(V.COUPLING_CHANGE))


def refactor_analysis(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """All suggestions for a set of files: duplicate blocks, complex functions, import cycles, high coupling.

    Cycles are those of imports that resolve to files of the repository; coupling counts all imports.
    """
    edges = graph.import_edges(blocks, files)
    cycles = graph.circular_dependencies(graph.resolve_imports(edges, files))
    return (duplicate_suggestions(files).unionByName(complexity_suggestions(blocks, files))
            .unionByName(cycle_suggestions(cycles)).unionByName(coupling_suggestions(graph.high_coupling(edges))))


def _by_type(values: dict, kind: Column) -> Column:
    chain = F
    for name, value in values.items():
        chain = chain.when(kind == name, F.lit(value))
    return chain


def code_health(suggestions: DataFrame, files: DataFrame) -> DataFrame:
    """100 minus twenty times the weighted suggestions per file, at least 0; 100 without files."""
    count = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"))
    weight = _by_type(V.SUGGESTION_WEIGHT, F.col("suggestion_type"))
    issues = suggestions.groupBy("repo_id").agg(
        F.sum(weight).alias("_issues"), F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("n_files", F.lit(0).cast("long"))
    score = F.greatest(F.lit(0.0), 100 - F.try_divide(F.coalesce("_issues", F.lit(0.0)), n) * 20)
    return count.join(issues, "repo_id", "full").select(
        "repo_id", n.alias("n_files"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_suggestions"),
        F.when(n == 0, F.lit(100.0)).otherwise(py_round(score, 2)).alias("overall_health"))


def prioritize(suggestions: DataFrame) -> DataFrame:
    """Suggestions in order of work: dependency, complexity, duplication, then by file.

    A range-partitioned sort, so a repository may hold any number of them.
    """
    return (suggestions.withColumn("priority", _by_type(V.SUGGESTION_PRIORITY, F.col("suggestion_type")))
            .orderBy("repo_id", F.desc("priority"), "file_path", "description"))


def lexical_complexity(content: Column) -> Column:
    """1 + number of decision words, for text without a parser."""
    words = "|".join(DECISION_WORDS)
    return (F.regexp_count(content, F.lit(f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")) + 1).cast("long")
