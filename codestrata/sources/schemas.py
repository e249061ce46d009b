"""Canonical tables and result records."""

from pyspark.sql import DataFrame, types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


COMMITS = _schema("""
    repo_id string, commit_hash string, parent_hash string, committed_at timestamp,
    author_name string, author_email string, author string, message string""")
FILE_CHANGES = _schema("""
    repo_id string, commit_hash string, file_path string, insertions long, deletions long,
    lines long, complexity_before double, complexity_after double""")
BLOBS = _schema("repo_id string, commit_hash string, file_path string, content_sha string, content string")
SOURCE_FILES = _schema("repo_id string, file_path string, content string")
HEAD_FILES = _schema("repo_id string, file_path string")
IMPORT_EDGES = _schema("repo_id string, src string, dst string, type string")
CODE_BLOCKS = _schema("""
    content_sha string, kind string, name string, lineno int, endline int,
    n_args int, n_methods int, complexity int, is_async boolean""")

# Result records, keyed by repository.
CHANGE_METRICS = _schema("""
    repo_id string, commit_hash string, file_path string, lines_added long, lines_deleted long,
    complexity_before double, complexity_after double, change_type string""")
REFACTOR_SUGGESTION = _schema("""
    repo_id string, file_path string, suggestion_type string, description string, impact string,
    effort_estimate string, code_snippet string, suggested_changes string""")
MODULE_NODE = _schema("repo_id string, id string, name string, type string, size long, color string").add(
    "position", _schema("x double, y double, z double"))
MODULE_CONNECTION = _schema("repo_id string, source string, target string, strength double, type string")
SUBSYSTEM_HEALTH = _schema("""
    repo_id string, name string, status string, complexity_trend string, last_updated timestamp""")
REFACTOR_ALERT = _schema("""
    repo_id string, file_path string, reason string, severity string,
    suggested_action string, estimated_effort string""")
CODEBASE_METRICS = _schema("""
    repo_id string, total_files long, total_commits long, average_complexity double,
    technical_debt_ratio double, code_quality_score double, last_analyzed timestamp""")
RESOURCE_PREDICTION = _schema("""
    repo_id string, resource_type string, predicted_need long, confidence_score double, timeframe string""")
RISK_AREA = _schema("""
    repo_id string, area_name string, risk_level string, potential_impact string,
    mitigation_strategy string""")
MAINTENANCE_PREDICTION = _schema("""
    repo_id string, maintenance_type string, predicted_frequency long, timeframe string,
    confidence_score double""")
COMPLEXITY_PREDICTION = _schema("""
    repo_id string, component string, predicted_complexity double, trend string,
    confidence_score double""")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, cast to its types; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
