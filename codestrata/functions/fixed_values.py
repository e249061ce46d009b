"""Names, thresholds and texts that results must carry exactly."""

# File endings counted as source code.
SOURCE_EXTENSIONS = ("py", "js", "java", "cpp", "c", "ts", "rb", "go")

# Message keywords, matched as substrings of the lower-case message.
MAINTENANCE_KEYWORDS = ("fix", "bug", "patch", "repair")
COMMIT_TYPE_KEYWORDS = (
    ("feature", ("add", "feature", "implement")),
    ("bugfix", ("fix", "bug", "issue")),
    ("refactor", ("refactor", "clean", "restructure")),
    ("performance", ("optimize", "performance", "speed")),
    ("security", ("security", "vulnerability", "secure")),
)
REFACTORING_KEYWORDS = (
    ("extract_method", ("extract", "split")),
    ("rename", ("rename",)),
    ("move", ("move",)),
    ("inline", ("inline",)),
)

# Story texts. {summary} and {components} are filled per commit.
PURPOSE_TEXT = {
    "feature": "This change introduces {summary} to {components}, affecting the system's functionality.",
    "bugfix": "This fixes {summary} in {components} by implementing necessary corrections.",
    "refactor": "This refactors {components} by {summary}, improving code maintainability and readability.",
    "performance": "This improves performance of {components} by {summary}, resulting in better system performance.",
    "security": "This enhances security by {summary} in {components}, protecting against potential security vulnerabilities.",
}
IMPACT_TEXT = {
    "high": "This change has significant system-wide impact, affecting multiple "
            "components and requiring careful testing and deployment.",
    "medium": "This change has moderate impact on the system, affecting some "
              "key components but with manageable risk.",
    "low": "This change has minimal system impact, affecting isolated components "
           "with low risk of side effects.",
}

# Refactor alert texts.
REASON_HOTSPOT = "High change frequency indicates instability"
REASON_COMPLEXITY = "High complexity score suggests need for simplification"
REASON_FREQUENCY = "Frequent modifications suggest poor design"
REASON_DEFAULT = "Code quality improvement opportunity"
ACTION_RESTRUCTURE = "Consider major restructuring or decomposition"
ACTION_PATTERNS = "Implement design patterns to reduce coupling"
ACTION_EXTRACT = "Extract methods and simplify logic"
ACTION_MINOR = "Apply minor refactoring improvements"

# Risk texts.
IMPACT_HIGH = "High impact on system stability and development velocity"
IMPACT_MODERATE = "Moderate impact on maintainability"
IMPACT_LOW = "Low impact but worth monitoring"
MITIGATION_HIGH = "Prioritize refactoring and add comprehensive tests"
MITIGATION_MEDIUM = "Implement monitoring and gradual improvement"
MITIGATION_LOW = "Regular code reviews and documentation"

# Refactor suggestion texts and weights.
DUPLICATION_IMPACT = "Code duplication increases maintenance burden and risk of inconsistent updates"
DUPLICATION_CHANGE = "Consider extracting this code into a shared function or utility"
COMPLEXITY_IMPACT = "High complexity makes code harder to understand and maintain"
CYCLE_IMPACT = "Circular dependencies make code harder to maintain and test"
CYCLE_CHANGE = "Consider restructuring these modules to break the dependency cycle"
COUPLING_IMPACT = "High coupling makes the codebase more rigid and harder to change"
COUPLING_CHANGE = "Consider splitting this module into smaller, more focused modules"
ADVICE_20 = "Consider breaking this function into smaller, more focused functions"
ADVICE_15 = "Look for opportunities to simplify conditional logic"
ADVICE_10 = "Consider extracting complex conditions into well-named helper functions"
SUGGESTION_WEIGHT = {"duplication": 1.0, "complexity": 1.5, "dependency": 2.0}
SUGGESTION_PRIORITY = {"duplication": 1, "complexity": 2, "dependency": 3}

# Model feature order.
FEATURE_NAMES = (
    "lines_changed_sum", "lines_changed_mean", "lines_changed_std",
    "insertions_sum", "insertions_mean", "deletions_sum", "deletions_mean",
    "commit_frequency_sum", "author_count_max", "change_rate",
    "insertion_deletion_ratio", "change_volatility", "author_diversity",
)
BASIC_FEATURE_NAMES = (
    "lines_changed", "commit_frequency", "complexity",
    "change_rate", "insertion_deletion_ratio",
)
