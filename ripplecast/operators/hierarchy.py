"""Class hierarchy analysis: which methods an interface call can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

SIGNATURE = ["method_name", "parameters"]


def implementing_methods(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(interface_method, implementing_method): methods of one signature in an interface and in the classes below it."""
    below = graph.closure(classes.filter("implements_id IS NOT NULL").select(F.col("implements_id").alias("src"), F.col("class_id").alias("dst")))
    of = lambda kind: methods.join(classes.filter(F.col("class_type") == kind).select("class_id"), "class_id").select("class_id", *SIGNATURE, "method_id")
    tops = of("Interface").withColumnRenamed("method_id", "interface_method").join(below.select(F.col("src").alias("class_id"), "dst"), "class_id").drop("class_id")
    own = of("Class").select(F.col("class_id").alias("dst"), *SIGNATURE, F.col("method_id").alias("implementing_method"))
    return tops.join(own, ["dst", *SIGNATURE]).select("interface_method", "implementing_method")


def concrete_methods(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(called, concrete): a class's method stands for itself, an interface's for those that implement it."""
    self_ = methods.join(classes.filter("class_type = 'Class'").select("class_id"), "class_id").select(F.col("method_id").alias("called"), F.col("method_id").alias("concrete"))
    return self_.union(implementing_methods(methods, classes))
