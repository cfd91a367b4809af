"""Queries on whole Java projects written from the facts: layouts that a line pattern cannot read, super classes, name lookup.

The sources are rendered from class and method facts, so the SQL of each query is over the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..registry import query
from ..sources import java


def parameters(of: str, note: str, by: str) -> Column:
    """SQL text: the parameter list of a method fact, names a and b, each behind note, by between them."""
    return F.expr(f"""CASE {of} WHEN '' THEN '' WHEN 'String,Map<String,Integer>' THEN '{note}String a,{by}{note}Map<String,Integer> b' WHEN 'int,List<String>' THEN '{note}int a,{by}{note}List<String> b' ELSE '{note}' || {of} || ' a' END""")


def project(f: Facts) -> java.Source:
    """A file a class; methods in five layouts by their id, class headers and fields in three by the class's."""
    m = f.method_f
    layout = F.col("method_id") % 5
    body = (
        F.when(layout == 0, F.concat(F.lit("    public String "), "method_name", F.lit("("), parameters("parameters", "", ""), F.lit(") { return \"}\" + '\"' + '\\''; }\n")))
        .when(layout == 1, F.concat(F.lit('    @GetMapping(value = {"/a", "/b)"}, name = "x")\n    @Cached\n    public Long '), "method_name", F.lit("("), parameters("parameters", '@PathVariable("id") ', " "), F.lit(") throws IOException, Other {\n        char open = '{';\n        return null;\n    }\n")))
        .when(layout == 2, F.concat(F.lit("    private static <T extends Comparable<T>> Map<String, List<T>> "), "method_name", F.lit("(\n        "), parameters("parameters", "final ", "\n        "), F.lit(')\n    {\n        int[] some = {1, 2};\n        String text = """\n          class Fake { void no() { "\n          """;\n        return null;\n    }\n')))
        .when(layout == 3, F.concat(F.lit("    /* { */ abstract void "), "method_name", F.lit("("), parameters("parameters", "", " /* ) */ "), F.lit("); // }\n")))
        .otherwise(F.concat(F.lit("    protected java.util.List<String>[] "), "method_name", F.lit("("), parameters("parameters", '@A(@B(x = "(")) final ', ""), F.lit(")\n    {\n        if (a < 1) { run(new Thing() { void inner() { } }); }\n        class Local { void hidden() { } }\n    }\n")))
    )
    bodies = m.select("class_id", "method_id", body.alias("body")).groupBy("class_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(method_id, body))), x -> x.body), '')").alias("bodies"))
    header = F.col("class_id") % 3
    head = (
        F.when(header == 0, F.concat(F.lit("public class "), "class_name", F.lit(" extends Base implements One, Two {\n")))
        .when(header == 1, F.concat(F.lit('@RequestMapping(value = "/{id}", path = {"a", "b"})\n@Data\npublic abstract class '), "class_name", F.lit("\n    extends Base<Map<String, ? extends Key>, Long>\n    implements One<Two, Three>\n{\n")))
        .otherwise(F.concat(F.lit("final class "), "class_name", F.lit("<T extends Comparable<T> & Other, U> implements a.b.One<T>, Two // {\n{\n")))
    )
    fields = (
        F.when(header == 0, F.lit("    private char open = '{', close = '}';\n    private int[] some = {1, 2};\n"))
        .when(header == 1, F.lit('    @Value("${a.b}") protected static final Map<String, List<Long>> all = new HashMap<String, List<Long>>() {\n        { put("}", null); }\n    };\n    long n[];\n'))
        .otherwise(F.lit("    Runnable task = () -> { int hidden = 1; };\n    static { int hidden = 2; }\n    { int other; }\n"))
    )
    rows = f.class_f.join(bodies, "class_id", "left")
    text = F.concat(F.lit("/** { */\npackage "), "package_name", F.lit(";\nimport com.base.*;\n\n"), head, fields, F.coalesce("bodies", F.lit("")), F.lit("}\n"))
    return java.Source(rows.select(F.col("filepath").alias("path"), text.alias("text")))


SHOWN = "replace(parameters, 'Map<String,Integer>', 'Map<String, Integer>')"


@query("M07_project_methods", f"""SELECT c.filepath AS path, m.method_name, {SHOWN} AS parameters, CASE m.method_id % 5 WHEN 0 THEN 'String' WHEN 1 THEN 'Long' WHEN 2 THEN 'Map<String, List<T>>' WHEN 3 THEN 'void' ELSE 'java.util.List<String>[]' END AS return_type,
  CAST(CASE m.method_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN contains(parameters, ',') THEN 9 ELSE 8 END WHEN 3 THEN 0 ELSE 4 END AS INT) AS more_lines, CAST(CASE m.method_id % 5 WHEN 1 THEN 2 ELSE 0 END AS INT) AS note_lines,
  m.method_id % 5 = 2 AS is_static, m.method_id % 5 = 3 AS is_abstract, CASE m.method_id % 5 WHEN 2 THEN 'T extends Comparable<T>' END AS type_parameters, CASE m.method_id % 5 WHEN 1 THEN 'GetMapping,Cached' ELSE '' END AS notes
  FROM {{method_f}} m JOIN {{class_f}} c ON c.class_id = m.class_id""")
def m07_project(f: Facts) -> DataFrame:
    """Methods of sources with annotated and multi-line parameters, braces in characters, texts and comments, and types inside of methods."""
    rows = project(f).methods
    return rows.select("path", "method_name", "parameters", "return_type", (F.col("end_line") - F.col("start_line")).alias("more_lines"), (F.col("start_line") - F.col("first_line")).alias("note_lines"), "is_static", "is_abstract", "type_parameters", F.array_join("annotations", ",").alias("notes"))


@query("M02_project_types", """SELECT filepath AS path, class_name, CASE class_id % 3 WHEN 0 THEN 'Base' WHEN 1 THEN 'Base<Map<String, ? extends Key>, Long>' END AS extends_class, CASE class_id % 3 WHEN 0 THEN 'One,Two' WHEN 1 THEN 'One' ELSE 'a . b . One,Two' END AS implements,
  CASE class_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'public,abstract' ELSE 'final' END AS modifiers, CASE class_id % 3 WHEN 1 THEN '[{"name":"RequestMapping","value":"value = \\"/{{id}}\\" , path = { \\"a\\" , \\"b\\" }"},{"name":"Data"}]' ELSE '[]' END AS annotations,
  CAST(CASE class_id % 3 WHEN 1 THEN 7 ELSE 5 END AS INT) AS start_line FROM {class_f}""")
def m02_project(f: Facts) -> DataFrame:
    """Types with their braces on other lines, type parameters, modifiers, and annotations with values as JSON."""
    return project(f).types.select("path", "class_name", "extends_class", F.array_join("implements", ",").alias("implements"), F.array_join("modifiers", ",").alias("modifiers"), F.to_json("notes").alias("annotations"), "start_line")


@query("M04_project_fields", """SELECT filepath AS path, v.field_type, v.field_name, v.is_static, v.notes FROM {class_f} JOIN (VALUES (0, 'char', 'open', false, ''), (0, 'int[]', 'some', false, ''), (1, 'Map<String, List<Long>>', 'all', true, 'Value'), (1, 'long[]', 'n', false, ''),
  (2, 'Runnable', 'task', false, '')) v(kind, field_type, field_name, is_static, notes) ON class_id % 3 = v.kind""")
def m04_project(f: Facts) -> DataFrame:
    """Fields with arrays, lambdas and anonymous classes as values, and blocks of code beside them."""
    return project(f).fields.select("path", "field_type", "field_name", "is_static", F.array_join("annotations", ",").alias("notes"))


def family(f: Facts) -> java.Source:
    """A file a class, which extends another one by name and import; its method probe calls each method name with each number of
    arguments that any class declares, on itself and on super."""
    arity = F.expr("CASE parameters WHEN '' THEN 0 WHEN 'Long' THEN 1 WHEN 'java.lang.Long' THEN 1 ELSE 2 END")
    own = F.concat(F.lit("    void "), "method_name", F.lit("("), parameters("parameters", "", " "), F.lit(") { }\n"))
    bodies = f.method_f.select("class_id", own.alias("own")).groupBy("class_id").agg(F.array_join(F.array_sort(F.collect_set("own")), "").alias("bodies"))
    given = F.expr("CASE arity WHEN 0 THEN '' WHEN 1 THEN 'id' ELSE 'text, n' END")
    asked = f.method_f.select("method_name", arity.alias("arity")).distinct().select(F.concat(F.lit("        "), "method_name", F.lit("("), given, F.lit(");\n        super."), "method_name", F.lit("("), given, F.lit(");\n")).alias("asked"))
    asked = asked.agg(F.array_join(F.array_sort(F.collect_list("asked")), "").alias("asked"))
    above = f.class_f.select(F.col("class_id").alias("extends_id"), F.col("class_name").alias("parent"), F.col("package_name").alias("parent_package"))
    rows = f.class_f.join(bodies, "class_id", "left").join(above, "extends_id", "left").crossJoin(F.broadcast(asked))
    text = F.concat(
        F.lit("package "), "package_name", F.lit(";\n"), F.coalesce(F.concat(F.lit("import "), "parent_package", F.lit("."), "parent", F.lit(";\n")), F.lit("")), F.lit("class "), "class_name", F.coalesce(F.concat(F.lit("\n    extends "), "parent"), F.lit("")),
        F.lit("\n{\n"), F.coalesce("bodies", F.lit("")), F.lit("    void probe(Long id, String text, int n) {\n"), "asked", F.lit("    }\n}\n"),
    )
    return java.Source(rows.select(F.col("filepath").alias("path"), text.alias("text")))


@query("M10_inherited_calls", f"""WITH RECURSIVE up AS (SELECT class_id, class_id AS above, 0 AS distance FROM {{class_f}} UNION ALL SELECT u.class_id, c.extends_id, u.distance + 1 FROM up u JOIN {{class_f}} c ON c.class_id = u.above WHERE c.extends_id IS NOT NULL),
  own AS (SELECT DISTINCT class_id, method_name, parameters, CASE parameters WHEN '' THEN 0 WHEN 'Long' THEN 1 WHEN 'java.lang.Long' THEN 1 ELSE 2 END AS arity, CASE parameters WHEN 'Long' THEN 1 WHEN 'String,Map<String,Integer>' THEN 1 ELSE 0 END AS score FROM {{method_f}}),
  asked AS (SELECT c.class_id, c.filepath, a.method_name, a.arity, s.target FROM {{class_f}} c, (SELECT DISTINCT method_name, arity FROM own) a, (VALUES (NULL), ('super')) s(target)),
  fits AS (SELECT a.class_id, a.method_name, a.arity, a.target, u.above, u.distance, o.parameters, row_number() OVER (PARTITION BY a.class_id, a.method_name, a.arity, a.target ORDER BY u.distance, o.score DESC, o.parameters) AS nth
    FROM asked a JOIN up u ON u.class_id = a.class_id AND (a.target IS NULL OR u.distance > 0) JOIN own o ON o.class_id = u.above AND o.method_name = a.method_name AND o.arity = a.arity)
  SELECT a.filepath AS path, a.method_name, a.target, f.package_name || '.' || f.class_name AS callee_class, {SHOWN.replace('parameters', 'x.parameters', 1)} AS parameters, CAST(x.distance AS INT) AS distance, CASE WHEN x.distance = 0 THEN 'OWN' WHEN x.distance > 0 THEN 'INHERITED' ELSE 'UNKNOWN' END AS how
  FROM asked a LEFT JOIN fits x ON x.class_id = a.class_id AND x.method_name = a.method_name AND x.arity = a.arity AND x.target IS NOT DISTINCT FROM a.target AND x.nth = 1 LEFT JOIN {{class_f}} f ON f.class_id = x.above""")
def m10_inherited(f: Facts) -> DataFrame:
    """Calls without a target and on super by the nearest super class that declares the method, overloads by their parameter types."""
    return family(f).resolved_calls.select("path", "method_name", "target", "callee_class", "parameters", "distance", "how")


def lookups(f: Facts) -> java.Source:
    """Files in which each step of the lookup of names decides: also second types of one name in many files, nested types, and imports of packages."""
    other = f.class_f.select((F.col("class_id") - 1).alias("class_id"), F.col("class_name").alias("other"), F.col("package_name").alias("other_package"))
    first = f.class_f.groupBy("package_name").agg(F.min("class_name").alias("sibling"))
    rows = f.class_f.join(other, "class_id", "left").join(first, "package_name")
    shared = F.when(F.col("class_id") % 4 == 0, F.lit("class Shared { }\n")).otherwise(F.lit(""))
    whole = F.when((F.col("class_id") % 4 == 3) & F.col("other_package").isNotNull(), F.concat(F.lit("import "), "other_package", F.lit(".*;\n"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("package "), "package_name", F.lit(";\nimport com.lib.Given;\n"), whole, F.lit("class "), "class_name", F.lit(" {\n    Given kept;\n    static class Inner { }\n    void probe(Given taken, List<Given> many) {\n        Given made = null;\n        taken.a(); made.b(); kept.c(); Given.d(); Inner.e();\n        "),
        "sibling", F.lit(".f(); "), F.coalesce("other", F.lit("Nowhere")), F.lit(".g(); Shared.h(); "), F.coalesce("other", F.lit("Nowhere")), F.lit(".Inner.i(); Missing.j(); many.k();\n    }\n}\n"), shared,
    )
    return java.Source(rows.select(F.col("filepath").alias("path"), text.alias("text")))


@query("M13_lookup_steps", """WITH c AS (SELECT a.*, b.class_name AS other, b.package_name AS other_package, min(a.class_name) OVER (PARTITION BY a.package_name) AS sibling FROM {class_f} a LEFT JOIN {class_f} b ON b.class_id = a.class_id + 1),
  s AS (SELECT package_name, count(*) AS n FROM {class_f} WHERE class_id % 4 = 0 GROUP BY package_name), t AS (SELECT count(*) AS n, min(package_name) AS p FROM {class_f} WHERE class_id % 4 = 0),
  asked AS (SELECT filepath AS path, v.method_name, v.how, v.full_name FROM c LEFT JOIN s own ON own.package_name = c.package_name LEFT JOIN s whole ON whole.package_name = c.other_package AND c.class_id % 4 = 3 CROSS JOIN t,
    LATERAL (VALUES ('a', 'PARAMETER', 'com.lib.Given'), ('b', 'LOCAL', 'com.lib.Given'), ('c', 'FIELD', 'com.lib.Given'), ('d', 'IMPORT', 'com.lib.Given'), ('e', 'FILE', c.package_name || '.Inner'),
      ('f', CASE WHEN c.sibling = c.class_name THEN 'FILE' ELSE 'SIBLING' END, c.package_name || '.' || c.sibling),
      ('g', CASE WHEN c.other IS NULL THEN 'EXTERNAL' WHEN c.other_package = c.package_name THEN 'SIBLING' ELSE 'UNIQUE' END, coalesce(c.other_package || '.' || c.other, c.package_name || '.Nowhere')),
      ('h', CASE WHEN c.class_id % 4 = 0 THEN 'FILE' WHEN own.n > 0 THEN 'SIBLING' WHEN t.n = 1 THEN 'UNIQUE' WHEN whole.n > 0 THEN 'IMPORTED' ELSE 'UNKNOWN' END,
        CASE WHEN c.class_id % 4 = 0 OR own.n > 0 THEN c.package_name WHEN t.n = 1 THEN t.p WHEN whole.n > 0 THEN c.other_package END || '.Shared'),
      ('i', CASE WHEN c.other IS NULL THEN 'UNKNOWN' ELSE 'NESTED' END, c.other_package || '.Inner'), ('j', 'EXTERNAL', c.package_name || '.Missing'), ('k', 'PARAMETER', c.package_name || '.List')) v(method_name, how, full_name))
  SELECT path, method_name, how, full_name AS callee_class FROM asked""")
def m13_steps(f: Facts) -> DataFrame:
    """How the name before a call was found, step by step; several types of one name without a choice stay unknown."""
    return lookups(f).resolved_calls.select("path", "method_name", "how", "callee_class")
