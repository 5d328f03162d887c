"""Getting a workflow out of a model's loosely formatted JSON answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .recovery import any_of

# Repairs in the order in which they apply, field patterns and defaults.
REPAIRS = (
    (r"\n\n", "\n"),
    (r",\s*\n\s*\}", "\n}"),
    (r",\s*\n\s*\]", "\n]"),
    (r"\}\s*\n\s*\{", "},\n{"),
    (r"\bhallmark:\s*(['\"])", '"operator": $1'),
    (r"\bid:\s*(['\"])", '"id": $1'),
    (r"\bdescription:\s*(['\"])", '"description": $1'),
    (r"\bupstream_dependencies:\s*\[", '"upstream_dependencies": ['),
    (r"'([^']*)'", '"$1"'),
)
FIELD_PATTERNS = {
    "dag_id": r'"dag_id":\s*"([^"]*)"',
    "description": r'"description":\s*"([^"]*)"',
    "schedule_interval": r'"schedule_interval":\s*"([^"]*)"',
}
FIELD_DEFAULTS = {
    "dag_id": "generated_pipeline",
    "description": "AI-generated DAG",
    "schedule_interval": "@daily",
}
TASK_PATTERN = r'"id":\s*"([^"]*)"[^}]*"operator":\s*"([^"]*)"[^}]*"description":\s*"([^"]*)"'
BLOCK_PATTERN = r'\{[^{}]*(?:"id"|id:)[^{}]*\}'
BLOCK_ID = r"""(?:"id"|id):\s*['"]?([^'"]*)['"]?"""
BLOCK_OPERATOR = r"""(?:"operator"|hallmark):\s*['"]?([^'"]*)['"]?"""
BLOCK_DESCRIPTION = r"""(?:"description"|description):\s*['"]([^'"]*)['"]"""
DEFAULT_OPERATOR = "PythonOperator"
DATA_WORDS = ("extract", "etl", "data")
DEFAULT_CHAIN = (
    ("extract_data", "Extract data from source"),
    ("validate_data", "Validate data quality"),
    ("load_data", "Load data to destination"),
)
OPEN_FENCE, CLOSE_FENCE = r"^\s*```[A-Za-z]*\s*", r"\s*```\s*$"

TASK_TYPE = (
    "struct<id:string,operator:string,description:string,upstream_dependencies:array<string>>"
)
WORKFLOW_TYPE = (
    "struct<dag_id:string,description:string,schedule_interval:string,"
    f"tasks:array<{TASK_TYPE}>>"
)


def without_fences(text: Column) -> Column:
    """The text without a code fence around it; a lone closing fence is left alone."""
    opened = text.rlike(OPEN_FENCE)
    body = F.regexp_replace(F.regexp_replace(text, OPEN_FENCE, ""), CLOSE_FENCE, "")
    return F.when(opened, body).otherwise(text)


def repaired(text: Column) -> Column:
    for pattern, replacement in REPAIRS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def as_workflow(text: Column) -> Column:
    return F.from_json(text, WORKFLOW_TYPE)


def task(id_: Column, operator: Column, description: Column, upstream: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        id_.alias("id"), operator.alias("operator"), description.alias("description"),
        (none if upstream is None else upstream).alias("upstream_dependencies"),
    )


def found_field(text: Column, name: str) -> Column:
    pattern = FIELD_PATTERNS[name]
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(
        FIELD_DEFAULTS[name]
    )


def task_triples(text: Column) -> Column:
    """Tasks whose id, operator and description follow each other."""
    part = lambda i: F.regexp_extract_all(text, F.lit(TASK_PATTERN), F.lit(i))
    return F.transform(
        F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")),
        lambda z: task(z["a"], z["b"], z["c"]),
    )


def task_blocks(text: Column) -> Column:
    """Braced pieces of text that hold a task id."""
    found = F.regexp_extract_all(text, F.lit(BLOCK_PATTERN), F.lit(0))
    return F.filter(found, lambda b: b.rlike(BLOCK_ID))


def loose_task(block: Column) -> Column:
    """A task from whatever fields a block has."""
    name = F.regexp_extract(block, BLOCK_ID, 1)
    operator = F.when(
        block.rlike(BLOCK_OPERATOR), F.regexp_extract(block, BLOCK_OPERATOR, 1)
    ).otherwise(DEFAULT_OPERATOR)
    description = F.when(
        block.rlike(BLOCK_DESCRIPTION), F.regexp_extract(block, BLOCK_DESCRIPTION, 1)
    ).otherwise(F.concat(F.lit("Task: "), name))
    return task(name, operator, description)


def default_tasks(text: Column) -> Column:
    """A fixed chain if the text is about data work, else nothing."""
    chain = F.array(
        *[task(F.lit(n), F.lit(DEFAULT_OPERATOR), F.lit(d)) for n, d in DEFAULT_CHAIN]
    )
    data_work = any_of([F.lower(text).contains(w) for w in DATA_WORDS])
    return F.when(data_work, chain).otherwise(F.array().cast(f"array<{TASK_TYPE}>"))


def chained(tasks: Column) -> Column:
    """Tasks without upstream, other than the first, wait for the task before them."""
    return F.transform(
        tasks,
        lambda t, i: F.struct(
            t["id"].alias("id"), t["operator"].alias("operator"),
            t["description"].alias("description"),
            F.when(
                (i > 0) & (F.coalesce(F.size(t["upstream_dependencies"]), F.lit(0)) <= 0),
                F.array(F.get(tasks, i - 1)["id"]),
            ).otherwise(t["upstream_dependencies"]).alias("upstream_dependencies"),
        ),
    )
