"""Block scoring of Python sources: the one job that needs a parser.

Counting rule per block: 1, plus one for each branch, loop, handler, assertion, conditional
expression, comprehension and comprehension filter, extra boolean operand, match case other than
the bare default, and else part of a loop or try. Nested functions and classes count for
themselves only. A class takes the whole mean of its methods plus one.
"""

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.schemas import CODE_BLOCKS
from .grouping import skew_join

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LEAVES = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop, ast.Name, ast.Constant)
_COLUMNS = CODE_BLOCKS.names


def _loop(node) -> int:
    return 1 + bool(node.orelse)


def _is_default(case) -> bool:
    return isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None


_POINTS = {
    ast.If: lambda n: 1, ast.IfExp: lambda n: 1, ast.Assert: lambda n: 1, ast.ExceptHandler: lambda n: 1,
    ast.For: _loop, ast.AsyncFor: _loop, ast.While: _loop,
    ast.Try: lambda n: int(bool(n.orelse)), ast.TryStar: lambda n: int(bool(n.orelse)),
    ast.BoolOp: lambda n: len(n.values) - 1, ast.comprehension: lambda n: 1 + len(n.ifs),
    ast.Match: lambda n: sum(not _is_default(c) for c in n.cases),
}


def _rows(sha: str, text: str) -> list[tuple]:
    """One pass over the tree; every scope collects the points of its own body."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows = [(sha, "module", "", 1, len(text.splitlines()), 0, 0, 0, False)]
    scopes = []  # [node, kind, points, scopes directly in its body]
    todo = [(child, "top", None, True) for child in tree.body]
    while todo:
        node, place, owner, direct = todo.pop()
        score = _POINTS.get(type(node))
        if isinstance(node, _LEAVES):
            continue
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            if isinstance(node, ast.ClassDef):
                kind, inside = ("class", "class") if place == "top" else ("inner_class", "nested")
            else:
                kind, inside = {"top": "function", "class": "method"}.get(place, "inner"), "nested"
            scope = [node, kind, 1, []]
            scopes.append(scope)
            if direct and owner is not None:
                owner[3].append(scope)
            todo.extend((child, inside, scope, True) for child in node.body)
            continue
        if score is not None and owner is not None:
            owner[2] += score(node)
        if isinstance(node, ast.Import):
            rows += [(sha, "import", a.name, node.lineno, node.end_lineno, 0, 0, 0, False) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            if node.module:
                rows.append((sha, "import", node.module, node.lineno, node.end_lineno, 0, 0, 0, False))
        else:
            todo.extend((child, place, owner, False) for child in ast.iter_child_nodes(node))
    for node, kind, points, members in scopes:
        if isinstance(node, ast.ClassDef):
            methods = [m for m in members if isinstance(m[0], _FUNCTIONS)]
            if methods:
                points = sum(m[2] for m in methods) // len(methods) + 1
            plain = sum(isinstance(m[0], ast.FunctionDef) for m in methods)
            rows.append((sha, kind, node.name, node.lineno, node.end_lineno, 0, plain, points, False))
        else:
            rows.append((sha, kind, node.name, node.lineno, node.end_lineno, len(node.args.args), 0, points,
                         isinstance(node, ast.AsyncFunctionDef)))
    return rows


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [r for sha, text in zip(batch["content_sha"], batch["content"]) for r in _rows(sha, text)]
        yield pd.DataFrame(rows, columns=_COLUMNS)


def with_sha(files: DataFrame) -> DataFrame:
    """Add the content hash; tables that store it already are left as they are."""
    if "content_sha" in files.columns:
        return files
    return files.withColumn("content_sha", F.sha2("content", 256))


def score_blocks(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Blocks and imports of every distinct content, one row each; unparsable text gives none.

    ``known``: blocks scored by an earlier run. Their contents are skipped, so append the result.
    One row is chosen per hash without moving texts; only the chosen texts are then moved, each once, and spread
    over all shuffle partitions, because parsing costs far more than their size suggests. Parsing is the
    dear part: store the result and hand the stored table to the operators that read blocks.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_sha(files).filter(F.col("content").isNotNull())
    place = F.struct(*[c for c in files.columns if c not in ("content", "content_sha")])
    chosen = keyed.groupBy("content_sha").agg(F.min(place).alias("_place"))
    if known is not None:
        chosen = chosen.join(known.select("content_sha"), "content_sha", "left_anti")
    distinct = skew_join(keyed.select("content_sha", "content", place.alias("_place")), chosen.hint("merge"),
                         ["content_sha", "_place"], "left_semi")
    return distinct.select("content_sha", "content").repartition(tasks, "content_sha").mapInPandas(_score, CODE_BLOCKS)
