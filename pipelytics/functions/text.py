"""Reading pipeline descriptions and prompts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .recovery import any_of

# Patterns of each step type, in the order that settles ties.
STEP_PATTERNS = {
    "sql_extraction": (
        r"extract.*(?:from|postgresql|mysql|redshift|snowflake)",
        r"(?:read|fetch|get).*(?:database|table|sql)",
        r"query.*(?:database|table)",
    ),
    "sql_transformation": (
        r"(?:transform|aggregate|join|calculate).*(?:sql|database)",
        r"(?:group by|sum|count|avg)",
        r"create.*(?:table|view|materialized)",
    ),
    "python_processing": (
        r"(?:process|clean|filter|merge).*(?:data|dataframe|pandas)",
        r"(?:apply|transform).*(?:function|logic|rules)",
        r"feature.*(?:engineering|extraction)",
    ),
    "data_validation": (
        r"(?:validate|check|verify).*(?:data|quality|schema)",
        r"(?:test|assert).*(?:data|values)",
        r"quality.*(?:check|assurance)",
    ),
    "api_integration": (
        r"(?:call|fetch|post).*(?:api|rest|endpoint)",
        r"(?:http|webhook|service).*(?:request|call)",
        r"integrate.*(?:external|third.party)",
    ),
    "notification": (
        r"(?:send|notify|alert).*(?:email|slack|teams)",
        r"(?:report|dashboard|summary)",
        r"notification.*(?:success|failure|completion)",
    ),
    "ml_inference": (
        r"(?:predict|score|inference).*(?:model|ml)",
        r"(?:machine learning|neural network|algorithm)",
        r"apply.*(?:model|prediction)",
    ),
    "file_operations": (
        r"(?:upload|download|copy|move).*(?:file|s3|gcs|azure)",
        r"(?:csv|parquet|json|avro).*(?:read|write|convert)",
        r"file.*(?:processing|handling|operations)",
    ),
}
STEP_WORDS = {
    "sql_extraction": ("extract", "read", "fetch", "select"),
    "python_processing": ("process", "transform", "clean"),
    "data_validation": ("validate", "check", "verify"),
}
DEFAULT_STEP = "python_processing"
TABLE_PATTERNS = (
    r"(?:table|from)\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"([a-zA-Z_][a-zA-Z0-9_]*)\s+table",
    r"(?:into|to)\s+([a-zA-Z_][a-zA-Z0-9_]*)",
)
DATABASES = ("postgresql", "mysql", "redshift", "snowflake", "bigquery", "s3", "mongodb")
FILE_FORMATS = ("csv", "parquet", "json", "avro", "orc")
CONNECTIONS = {
    "postgresql": "postgres_default",
    "postgres": "postgres_default",
    "mysql": "mysql_default",
    "redshift": "redshift_default",
    "snowflake": "snowflake_default",
    "bigquery": "bigquery_default",
    "mongodb": "mongodb_default",
    "s3": "aws_default",
    "gcs": "google_cloud_default",
    "azure": "azure_default",
}
ACTION_WORDS = ("extract", "transform", "load", "validate", "process", "send", "notify")
OBJECT_WORDS = ("data", "table", "file", "report", "email", "api")
CONSUMING_WORDS = ("process", "transform", "validate", "clean")
NOTIFYING_WORDS = ("notify", "send", "email", "alert")
STAGES = {
    "extract": ("extract", "pull", "fetch", "download", "read"),
    "transform": ("transform", "process", "clean", "filter", "aggregate"),
    "load": ("load", "save", "write", "upload", "store"),
    "train": ("train", "model", "ml", "machine learning"),
    "validate": ("validate", "test", "check", "verify"),
    "notify": ("notify", "alert", "email", "slack"),
}
PYTHON_STAGES = ("transform", "train")
FALLBACK_STAGES = (
    ("extract_data", "data_extraction", "Extract data from source", ("extract", "read", "fetch", "get")),
    ("process_data", "data_processing", "Process and transform data",
     ("transform", "process", "clean", "validate")),
    ("load_data", "data_loading", "Load data to destination", ("load", "save", "store", "insert")),
    ("notify", "notification", "Send notification", ("email", "notify", "alert", "send")),
)
DATA_WORDS = ("data", "process", "etl", "transform")
MODEL_WORDS = ("model", "train", "ml", "machine learning")
DATA_CHAIN = (
    ("extract_data", "Extract data from source"),
    ("transform_data", "Transform and clean data"),
    ("load_data", "Load data to destination"),
)
MODEL_CHAIN = (
    ("prepare_data", "Prepare training data"),
    ("train_model", "Train ML model"),
    ("evaluate_model", "Evaluate model performance"),
)
DEFAULT_OPERATOR = "PythonOperator"
STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "a", "an",
)
SQL_WORDS = (
    "select", "from", "where", "join", "group by", "having", "order by", "insert", "update",
    "delete", "create table", "alter table", "sql", "query",
)
PYTHON_WORDS = (
    "python", "def ", "class ", "import ", "from ", "__init__", "function", "lambda", "return",
    "if __name__", "pip install",
)
REASONING_WORDS = (
    "analyze", "reason", "explain", "why", "because", "compare", "evaluate", "assess", "conclude",
    "infer",
)
SQL_MODEL = "sqlcoder-7b"
CODE_MODELS = ("deepseek-coder-7b", "wizardcoder-7b", "codellama-7b")
REASONING_MODEL = "phi3-mini"
PREFERRED_MODELS = (
    "llama3-8b", "phi3-mini", "codellama-7b", "deepseek-coder-7b", "wizardcoder-7b", "sqlcoder-7b",
)
MODEL_FOR_TASK = {
    "sql_generation": "codellama:7b",
    "python_code": "codellama:7b",
    "general_reasoning": "llama3:8b",
    "documentation": "phi3:mini",
    "testing": "codellama:7b",
    "data_analysis": "llama3:8b",
    "pipeline_optimization": "phi3:mini",
    "error_debugging": "codellama:7b",
}
DEFAULT_TASK_MODEL = "phi3:mini"
TOKENS_PER_WORD = 1.3
# White space in the Unicode sense, spelled out because regex dialects differ on \s.
SPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}]+"
)
STEP_BREAK = r"[.;]\s+"
WORD = r"\b[a-zA-Z]+\b"


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs anywhere in the text, also inside a longer word."""
    return any_of([text.contains(w) for w in words])


def literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def steps(text: Column) -> Column:
    """Sentences of a description as ``array<struct<idx, step>>``; blank ones leave a gap in idx."""
    parts = F.transform(
        F.split(text, STEP_BREAK), lambda s, i: F.struct(i.alias("idx"), stripped(s).alias("step"))
    )
    return F.filter(parts, lambda p: p["step"] != "")


def spaced_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def step_type(step: Column) -> Column:
    """The type with the most matching patterns, else one found by single words."""
    low = F.lower(step)
    scored = [
        F.struct(
            sum((low.rlike(p).cast("int") for p in patterns[1:]), low.rlike(patterns[0]).cast("int")).alias("hits"),
            F.lit(-i).alias("order"),
            F.lit(name).alias("name"),
        )
        for i, (name, patterns) in enumerate(STEP_PATTERNS.items())
    ]
    best = F.greatest(*scored)
    by_word = None
    for name, words in STEP_WORDS.items():
        by_word = (
            F.when(has_any(low, words), name) if by_word is None
            else by_word.when(has_any(low, words), name)
        )
    return F.when(best["hits"] > 0, best["name"]).otherwise(by_word.otherwise(DEFAULT_STEP))


def first_found(text: Column, words: Sequence[str]) -> Column:
    """The first word of the list that occurs in the text, or null."""
    out = F.when(text.contains(words[0]), words[0])
    for w in words[1:]:
        out = out.when(text.contains(w), w)
    return out


def table_name(step: Column) -> Column:
    return F.coalesce(
        *[F.nullif(F.regexp_extract(step, f"(?i){p}", 1), F.lit("")) for p in TABLE_PATTERNS]
    )


def connection_id(database: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(CONNECTIONS.items())])
    return F.try_element_at(entries, database)


def step_id(step: Column, idx: Column) -> Column:
    """First action word, first object word and the position counted from 1."""
    words = F.regexp_extract_all(F.lower(step), F.lit(WORD), F.lit(0))
    pick = lambda known: F.get(F.filter(words, lambda w: w.isin(*known)), F.lit(0))
    action, thing = pick(ACTION_WORDS), F.coalesce(pick(OBJECT_WORDS), F.lit("data"))
    number = (idx + 1).cast("string")
    return F.when(action.isNotNull(), F.concat_ws("_", action, thing, number)).otherwise(
        F.concat(F.lit("task_"), number)
    )


def route(prompt: Column, available: Sequence[str]) -> Column:
    """The model for a prompt, given the models that are up."""
    low = F.lower(prompt)
    code = next((m for m in CODE_MODELS if m in available), None)
    general = next((m for m in PREFERRED_MODELS if m in available), None)
    general = general or next(iter(available), "none")
    rules = [
        (SQL_WORDS, SQL_MODEL if SQL_MODEL in available else None),
        (PYTHON_WORDS, code),
        (REASONING_WORDS, REASONING_MODEL if REASONING_MODEL in available else None),
    ]
    hits = [F.when(has_any(low, words), model) for words, model in rules if model]
    return F.coalesce(*hits, F.lit(general))


def recommended(task_type: Column, available: Sequence[str]) -> Column:
    """The model for a kind of task, or the closest one that is available."""
    substitute = next((m for m in (DEFAULT_TASK_MODEL, "phi3") if m in available), None)
    substitute = substitute or next(iter(available), DEFAULT_TASK_MODEL)
    usable = {k: m for k, m in MODEL_FOR_TASK.items() if m in available}
    unlisted = DEFAULT_TASK_MODEL if DEFAULT_TASK_MODEL in available else substitute
    known = F.create_map(
        *[F.lit(x) for k in MODEL_FOR_TASK for x in (k, usable.get(k, substitute))]
    )
    return F.coalesce(F.try_element_at(known, task_type), F.lit(unlisted))


def word_count(text: Column) -> Column:
    parts = F.split(text, SPACE)
    n = F.size(parts)
    # Space at an end leaves an empty part there.
    blank_first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    blank_last = F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return n - blank_first - blank_last
