"""Impact of changes over objects of four kinds: statements, fields, classes and methods.

A relation a pair of kinds says what one object's change touches in one step; the fixpoint goes
over all of them at once, round by round, with what is new only.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import graph

KINDS = ("statement", "field", "class", "method")
ACCESSOR_NOTES = ["Data", "Getter", "Setter"]


def overridden(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(method_id, above_id): methods marked as overriding, and those of the same name and parameters in any class or
    interface above, over super classes, interfaces and interfaces of super classes."""
    up = classes.select(F.col("class_id").alias("src"), F.explode(F.array_compact(F.array("extends_id", "implements_id"))).alias("dst"))
    above = graph.closure(up.distinct()).select(F.col("src").alias("class_id"), F.col("dst").alias("above_class"))
    own = methods.filter("annotation = 'Override'").select("class_id", "method_name", "parameters", "method_id").join(above, "class_id")
    tops = methods.select(F.col("class_id").alias("above_class"), "method_name", "parameters", F.col("method_id").alias("above_id"))
    return own.join(tops, ["above_class", "method_name", "parameters"]).select("method_id", "above_id").distinct()


def same_class(fields: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(object_id, impacted): each field with each method of its class, for the classes given; a field is in one class.

    There are many more pairs than fields, so what is put together is made distinct and dealt by it before the pairs are made, not after.
    """
    own = fields.select("class_id", F.col("field_id").alias("object_id")).distinct().join(classes.distinct(), "class_id")
    return own.join(methods.select("class_id", F.col("method_id").alias("impacted")).distinct(), "class_id").select("object_id", "impacted")


def relations(methods: DataFrame, classes: DataFrame, fields: DataFrame, statements: DataFrame, calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(src_kind, src, dst_kind, dst): one step of impact.

    statement -> method: the method that it is linked to. class -> method: callers of its methods; class -> field:
    fields of its type. field -> method: methods that use it, by an accessor only where its class has generated
    ones. method -> method: its callers, and the callers of the methods above that it overrides.
    """
    callers = calls.select(F.col("callee_id").alias("called"), F.col("caller_id").alias("dst"))
    noted = F.arrays_overlap(F.from_json("annotations", "array<struct<name string>>")["name"], F.array(*map(F.lit, ACCESSOR_NOTES)))
    owners = classes.select("class_id", F.coalesce(noted, F.lit(False)).alias("has_accessors"))
    parts = [
        ("statement", "method", statements.filter("linked_method_id IS NOT NULL").select(F.col("stmt_id").alias("src"), F.col("linked_method_id").alias("dst"))),
        ("class", "method", methods.select(F.col("class_id").alias("src"), F.col("method_id").alias("called")).join(callers, "called").select("src", "dst")),
        ("class", "field", classes.select(F.col("class_name").alias("field_type"), F.col("class_id").alias("src")).join(fields, "field_type").select("src", F.col("field_id").alias("dst"))),
        ("field", "method", fields.select("field_id", "class_id").join(owners, "class_id").join(uses, "field_id").filter("has_accessors OR NOT via_accessor").select(F.col("field_id").alias("src"), F.col("method_id").alias("dst"))),
        ("method", "method", callers.select(F.col("called").alias("src"), "dst")),
        ("method", "method", overridden(methods, classes).select(F.col("method_id").alias("src"), F.col("above_id").alias("called")).join(callers, "called").select("src", "dst")),
    ]
    tagged = [rows.select(F.lit(a).alias("src_kind"), F.col("src").cast("long").alias("src"), F.lit(b).alias("dst_kind"), F.col("dst").cast("long").alias("dst")) for a, b, rows in parts]
    return reduce(DataFrame.union, tagged).distinct()


def reached(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(kind, id, round) of all that start (kind, id) reaches over steps, with the round in which it was first met.

    A round joins what is new with the steps of its kind and drops what is known; an object that many others
    touch is met once, so a round has no more rows than there are objects.
    """
    steps = written(steps)
    found = fresh = graph.round_rows(start.select("kind", "id").distinct().withColumn("round", F.lit(0)))
    for n in count(1):
        met = fresh.select(F.col("kind").alias("src_kind"), F.col("id").alias("src")).join(steps, ["src_kind", "src"]).select(F.col("dst_kind").alias("kind"), F.col("dst").alias("id")).distinct()
        fresh = graph.round_rows(met.join(found, ["kind", "id"], "left_anti").withColumn("round", F.lit(n)))
        if fresh.isEmpty():
            return found
        found = graph.round_rows(found.union(fresh)) if n % 8 == 0 else found.union(fresh)
