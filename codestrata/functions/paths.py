"""Path, line and address expressions."""

from pyspark.sql import Column, functions as F

from .fixed_values import SOURCE_EXTENSIONS

# Every line boundary Python's str.splitlines knows.
LINE_BREAK = "\\r\\n|[\\n\\u000b\\u000c\\r\\u001c-\\u001e\\u0085\\u2028\\u2029]"


def is_source(path: Column) -> Column:
    return path.contains(".") & F.element_at(F.split(path, "\\."), -1).isin(*SOURCE_EXTENSIONS)


def subsystem(path: Column) -> Column:
    """First path segment; ``root`` for a file without a folder."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("root"))


def component(path: Column) -> Column:
    """Second path segment, null when there is none."""
    return F.get(F.split(path, "/"), F.lit(1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_folder(path: Column) -> Column:
    """Name of the innermost folder, null for a file without one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def directory(path: Column) -> Column:
    """Everything before the last ``/``; empty text for a file without a folder."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def under_path(path: Column, prefix: str) -> Column:
    """The path itself or anything below it."""
    clean = prefix.rstrip("/")
    return (path == clean) | path.startswith(clean + "/")


def dotted_name(path: Column) -> Column:
    """``a/b/c.py`` -> ``a.b.c``; ``a/b/__init__.py`` -> ``a.b``."""
    return F.replace(F.regexp_replace(path, "(/__init__)?\\.py$", ""), F.lit("/"), F.lit("."))


def split_lines(content: Column) -> Column:
    """Array of lines without their breaks; no empty last entry after a final break."""
    # The one-element array binds the split once for the three places that read it.
    whole = F.transform(F.array(F.split(content, LINE_BREAK)), lambda lines: F.when(
        F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines))
    return F.get(whole, F.lit(0))


def line_count(content: Column) -> Column:
    return F.size(split_lines(content)).cast("long")


def line_span(lines: Column, first: Column, last: Column) -> Column:
    """Text of the lines ``first`` to ``last``, both counted from 1 and included."""
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def block_source(content: Column, first: Column, last: Column) -> Column:
    return line_span(split_lines(content), first, last)


def parse_repo_url(url: Column) -> Column:
    """``struct(owner, repo)`` of a hosted repository address, null when it is none."""
    clean = F.regexp_replace(F.regexp_replace(url, "\\.git$", ""), "/$", "")
    pattern = "(?i)^https://github\\.com/([^/]+)/([^/]+)$"
    return F.when(clean.rlike(pattern), F.struct(
        F.regexp_extract(clean, pattern, 1).alias("owner"),
        F.regexp_extract(clean, pattern, 2).alias("repo")))
