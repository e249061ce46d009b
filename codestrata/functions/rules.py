"""Rule texts and categories, first matching branch wins."""

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed_values as V


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_keyword_match(text: Column, table, default: str | None) -> Column:
    """Name of the first group in ``table`` with a word inside ``text``."""
    chain = F
    for name, words in table:
        chain = chain.when(contains_any(text, words), F.lit(name))
    return chain.otherwise(F.lit(default))


def author_label(name: Column, email: Column) -> Column:
    return F.concat(name, F.lit(" <"), email, F.lit(">"))


def mentions_refactor(message: Column) -> Column:
    return F.lower(message).contains("refactor")


def mentions_fix(message: Column) -> Column:
    return F.lower(message).contains("fix")


def is_maintenance(message: Column) -> Column:
    return contains_any(F.lower(message), V.MAINTENANCE_KEYWORDS)


def refactoring_kind(message: Column) -> Column:
    """Pattern key of a refactor message, null when none of the keywords occur."""
    return first_keyword_match(F.lower(message), V.REFACTORING_KEYWORDS, None)


def commit_type(message: Column) -> Column:
    return first_keyword_match(F.lower(message), V.COMMIT_TYPE_KEYWORDS, "other")


def change_type(insertions: Column, deletions: Column, is_new: Column, is_deleted: Column) -> Column:
    """addition, deletion, refactor (both sides changed, ratio 0.7 to 1.3) or modification."""
    both = (F.coalesce(insertions, F.lit(0)) != 0) & (F.coalesce(deletions, F.lit(0)) != 0)
    ratio = F.try_divide(insertions.cast("double"), deletions.cast("double"))
    return (F.when(is_new, F.lit("addition"))
            .when(is_deleted, F.lit("deletion"))
            .when(both & ratio.between(0.7, 1.3), F.lit("refactor"))
            .otherwise(F.lit("modification")))


def subsystem_status(score: Column, frequency: Column, fixes: Column, touches: Column) -> Column:
    return (F.when(score > 0.7, F.lit("critical"))
            .when(score > 0.5, F.lit("warning"))
            .when((frequency > 5) & (fixes < touches * 0.1), F.lit("healthy"))
            .otherwise(F.lit("stable")))


def size_trend(last: Column, first: Column, touches: Column) -> Column:
    return (F.when(touches < 3, F.lit("stable"))
            .when(last > first * 1.2, F.lit("increasing"))
            .when(last < first * 0.8, F.lit("decreasing"))
            .otherwise(F.lit("stable")))


def needs_refactor(score: Column, complexity: Column, frequency: Column) -> Column:
    return (score > 0.6) | (complexity > 20) | (frequency > 10)


def alert_severity(score: Column, complexity: Column) -> Column:
    return F.when((score > 0.8) | (complexity > 30), F.lit("high")).otherwise(F.lit("medium"))


def refactor_reason(score: Column, complexity: Column, frequency: Column) -> Column:
    joined = F.concat_ws("; ",
                         F.when(score > 0.7, F.lit(V.REASON_HOTSPOT)),
                         F.when(complexity > 20, F.lit(V.REASON_COMPLEXITY)),
                         F.when(frequency > 10, F.lit(V.REASON_FREQUENCY)))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(V.REASON_DEFAULT))


def refactor_action(score: Column, complexity: Column) -> Column:
    return (F.when((score > 0.8) & (complexity > 25), F.lit(V.ACTION_RESTRUCTURE))
            .when(score > 0.6, F.lit(V.ACTION_PATTERNS))
            .when(complexity > 15, F.lit(V.ACTION_EXTRACT))
            .otherwise(F.lit(V.ACTION_MINOR)))


def refactor_effort(complexity: Column) -> Column:
    return (F.when(complexity > 30, F.lit("high")).when(complexity > 15, F.lit("medium"))
            .otherwise(F.lit("low")))


def risk_level(risk: Column) -> Column:
    return F.when(risk > 0.8, F.lit("high")).otherwise(F.lit("medium"))


def risk_impact(complexity: Column, frequency: Column) -> Column:
    return (F.when((complexity > 25) & (frequency > 15), F.lit(V.IMPACT_HIGH))
            .when((complexity > 15) | (frequency > 10), F.lit(V.IMPACT_MODERATE))
            .otherwise(F.lit(V.IMPACT_LOW)))


def mitigation(risk: Column) -> Column:
    return (F.when(risk > 0.8, F.lit(V.MITIGATION_HIGH)).when(risk > 0.6, F.lit(V.MITIGATION_MEDIUM))
            .otherwise(F.lit(V.MITIGATION_LOW)))


def complexity_advice(complexity: Column) -> Column:
    return F.concat_ws("\n",
                       F.when(complexity > 20, F.lit(V.ADVICE_20)),
                       F.when(complexity > 15, F.lit(V.ADVICE_15)),
                       F.when(complexity > 10, F.lit(V.ADVICE_10)))


def impact_level(lines: Column, delta: Column, files: Column) -> Column:
    return (F.when((lines > 500) | (delta > 20) | (files > 10), F.lit("high"))
            .when((lines > 100) | (delta > 5) | (files > 3), F.lit("medium"))
            .otherwise(F.lit("low")))


def impact_description(level: Column) -> Column:
    return (F.when(level == "high", F.lit(V.IMPACT_TEXT["high"]))
            .when(level == "medium", F.lit(V.IMPACT_TEXT["medium"]))
            .otherwise(F.lit(V.IMPACT_TEXT["low"])))


def lead_summary(message: Column) -> Column:
    """Subject of the message: all up to the first blank line, in one line."""
    return F.regexp_replace(F.regexp_extract(message, r"(?s)\A(.*?)(?:\n[ \t]*\n.*)?\z", 1), r"[ \t\r]*\n[ \t\r]*", " ")


def purpose(kind: Column, summary: Column, components: Column) -> Column:
    """Sentence for the commit type; ``components`` is an array of names."""
    names = F.array_join(components, ", ")
    holes = {"{summary}": summary, "{components}": names}
    chain = F
    for name, text in V.PURPOSE_TEXT.items():
        pieces = text.replace("{", "\x00{").replace("}", "}\x00").split("\x00")
        chain = chain.when(kind == name, F.concat(*[holes.get(p, F.lit(p)) for p in pieces]))
    return chain.otherwise(summary)


def importance_text(message: Column, change_labels: Column) -> Column:
    """Message, a space, then the space-joined ``"{type} in {path}"`` labels."""
    return F.concat(message, F.lit(" "), F.array_join(change_labels, " "))
