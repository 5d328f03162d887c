"""Reading error messages: kind, cause and remedy, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds in the order in which they are tried. The first entry is
# a list of exception classes, the second a list of words in the message.
ERROR_KINDS = {
    "import_error": (("ImportError", "ModuleNotFoundError"), ("no module named",)),
    "memory_error": (("MemoryError",), ("out of memory",)),
    "connection_error": ((), ("connection", "timeout")),
    "permission_error": ((), ("permission denied", "access denied")),
    "resource_error": ((), ("resource", "limit exceeded")),
    "data_error": ((), ("data", "format")),
}
UNKNOWN = "unknown"
MODULE_PATTERNS = (
    r"No module named '([^']+)'",
    r"No module named ([^\s]+)",
    r"ImportError: cannot import name '([^']+)'",
)
DEFAULT_MEMORY, FALLBACK_MEMORY = "2Gi", "8Gi"
DEFAULT_CPU, MAX_CPU = 1, 8


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def error_type(error_class: Column, message: Column) -> Column:
    """The first kind whose class or words fit."""
    low = F.lower(message)
    out = None
    for kind, (classes, words) in ERROR_KINDS.items():
        fits = any_of([low.contains(w) for w in words])
        if classes:
            fits = F.coalesce(error_class.isin(*classes), F.lit(False)) | F.coalesce(fits, F.lit(False))
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise(UNKNOWN)


def missing_module(message: Column) -> Column:
    """Root package of the module that could not be imported, or null."""
    hits = [F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in MODULE_PATTERNS]
    return F.nullif(F.split_part(F.coalesce(*hits), F.lit("."), F.lit(1)), F.lit(""))


def grown_memory(memory: Column) -> Column:
    """Twice the memory in the same unit; sizes in other units become a fixed size."""
    memory = F.coalesce(memory, F.lit(DEFAULT_MEMORY))

    def doubled(suffix: str) -> Column:
        number = F.substring(memory, F.lit(1), F.length(memory) - len(suffix)).try_cast("bigint")
        return F.concat((number * 2).cast("string"), F.lit(suffix))

    return (
        F.when(memory.endswith("Gi"), doubled("Gi"))
        .when(memory.endswith("G"), doubled("G"))
        .otherwise(FALLBACK_MEMORY)
    )


def grown_cpu(cpu: Column) -> Column:
    return F.least(F.coalesce(cpu, F.lit(DEFAULT_CPU)) * 2, F.lit(MAX_CPU))


def fix_plan(kind: Column, message: Column, memory: Column, cpu: Column) -> Column:
    """Suggestion, confidence, whether it can run unattended, command and new settings.

    The command is a label for whoever acts on the plan; nothing is run here.
    """
    module, more_memory = missing_module(message), grown_memory(memory)
    more_cpu = grown_cpu(cpu).cast("string")

    def advice(text, confidence, unattended, command=None, setting=None):
        none = F.lit(None)
        return F.struct(
            (F.lit(text) if isinstance(text, str) else text).alias("suggested_fix"),
            F.lit(confidence).alias("confidence"),
            F.lit(unattended).alias("auto_fixable"),
            (none.cast("string") if command is None else command).alias("fix_command"),
            (
                none.cast("map<string,string>")
                if setting is None
                else F.create_map(F.lit(setting[0]), setting[1])
            ).alias("adjustment"),
        )

    return (
        F.when(
            (kind == "import_error") & module.isNotNull(),
            advice(
                F.concat(F.lit("Install missing package: "), module), 0.9, True,
                F.concat(F.lit("pip install "), module),
            ),
        )
        .when(
            kind == "import_error",
            advice("Check import paths and package installation", 0.5, False),
        )
        .when(
            kind == "memory_error",
            advice(
                F.concat(F.lit("Increase memory allocation to "), more_memory), 0.8, True,
                setting=("memory", more_memory),
            ),
        )
        .when(
            kind == "connection_error",
            advice("Implement exponential backoff retry", 0.7, True, F.lit("retry_with_backoff")),
        )
        .when(
            kind == "permission_error",
            advice("Check file permissions and ownership", 0.6, False),
        )
        .when(
            kind == "resource_error",
            advice(
                F.concat(F.lit("Increase CPU allocation to "), more_cpu, F.lit(" cores")), 0.7, True,
                setting=("cpu", more_cpu),
            ),
        )
        .otherwise(advice("Manual intervention required", 0.1, False))
    )
