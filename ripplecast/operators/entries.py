"""Entry points of a code base: by annotation, by flag, by convention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of entry points that annotations make.
ENTRY_ANNOTATIONS = {
    "RequestMapping": "HTTP_API",
    "GetMapping": "HTTP_API",
    "PostMapping": "HTTP_API",
    "PutMapping": "HTTP_API",
    "DeleteMapping": "HTTP_API",
    "PatchMapping": "HTTP_API",
    "Scheduled": "SCHEDULED_TASK",
    "EventListener": "EVENT_LISTENER",
    "JmsListener": "MESSAGE_CONSUMER",
    "KafkaListener": "MESSAGE_CONSUMER",
    "RabbitListener": "MESSAGE_CONSUMER",
    "Path": "HTTP_API",
    "Endpoint": "ACTUATOR",
}


def annotation_entry(annotation: Column) -> Column:
    """The entry type of an annotation's simple name; null if it makes none."""
    out = F.lit(None).cast("string")
    for name, kind in ENTRY_ANNOTATIONS.items():
        out = F.when(annotation == name, kind).otherwise(out)
    return out


def entry_methods(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """methods with entry_type: API flag or HTTP annotation, other annotation, or a controller's by name."""
    by_annotation = annotation_entry(F.col("annotation"))
    kind = (
        F.when(F.col("is_api") | (by_annotation == "HTTP_API"), "HTTP_API").when(by_annotation.isNotNull(), by_annotation)
        .when(F.lower("class_name").endswith("controller"), "CONTROLLER_BY_CONVENTION")
    )
    return methods.join(classes.select("class_id", "class_name"), "class_id").withColumn("entry_type", kind).filter("entry_type is not null")


def root_types(methods: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """methods with root_type: entry type, NO_STATIC_CALLER or INTERMEDIATE."""
    entry = entry_methods(methods, classes).select("method_id", "entry_type")
    called = edges.select(F.col("callee_id").alias("method_id"), F.lit(True).alias("called")).distinct()
    rows = methods.join(entry, "method_id", "left").join(called, "method_id", "left")
    return rows.withColumn("root_type", F.coalesce("entry_type", F.when(F.col("called"), "INTERMEDIATE").otherwise("NO_STATIC_CALLER")))


def inherited_api(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """methods with is_api taken, for overriding ones, from the method of the implemented interface."""
    top = methods.groupBy(F.col("class_id").alias("implements_id"), "method_name", "parameters").agg(F.bool_or("is_api").alias("api"))
    rows = methods.join(classes.select("class_id", "implements_id"), "class_id")
    keys = ["implements_id", "method_name", "parameters"]
    on = [rows[k] == top[k] for k in keys] + [rows["annotation"] == "Override"]
    return rows.join(top, on, "left").select("method_id", F.coalesce("api", "is_api").alias("is_api"))


def recommendations(coverage: Column, depth_limited: Column | None = None, entry_points: Column | None = None, with_callers: Column | None = None, unresolved: Column | None = None) -> Column:
    """Codes of advice from coverage statistics; COMPLETE if there is none."""
    none = F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            F.when(coverage < 30, "LOW_COVERAGE"), F.when(unresolved > 0, "RESOLVE_INTERFACES") if unresolved is not None else none,
            F.when(depth_limited > 0, "RAISE_DEPTH") if depth_limited is not None else none,
            F.when((entry_points == 0) & (with_callers > 0), "NO_ENTRY_POINTS") if entry_points is not None and with_callers is not None else none,
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("COMPLETE"))).otherwise(found)
