"""Queries on sources (S*, M*, C07, C14, C24, C34, G17): texts are made of class facts, a file a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions import names as N
from ..registry import query
from ..session import new_folder, written
from ..sources import diffs, folders, java, mappers


def diff_texts(f: Facts) -> DataFrame:
    text = F.concat(
        F.lit("diff --git a/x b/x\n--- a/"), "filepath", F.lit("\n+++ b/"), "filepath", F.lit("\n@@ -10,4 +"), (F.col("class_id") + 20).cast("string"),
        F.lit(",5 @@\n context\n-old one\n+new one\n+  // comment\n+\n+import x;\n+new two\n context\n@@ -50,2 +70,1 @@\n-gone\n-* doc\n rest\n"),
    )
    return f.class_f.select(F.col("class_id").alias("diff"), text.alias("text"))


LINES = """SELECT class_id AS diff, filepath AS path, '+' AS op, CAST(class_id + 21 AS INT) AS line_no, 'new one' AS content FROM {class_f} UNION ALL SELECT class_id, filepath, '+', CAST(class_id + 25 AS INT), 'new two' FROM {class_f}
  UNION ALL SELECT class_id, filepath, '-', 11, 'old one' FROM {class_f} UNION ALL SELECT class_id, filepath, '-', 50, 'gone' FROM {class_f}"""


@query("S02_diff_scan", f"SELECT path, count(*) FILTER (op = '+') AS added, count(*) FILTER (op = '-') AS removed FROM ({LINES}) x GROUP BY path")
def s02(f: Facts) -> DataFrame:
    return diffs.changed_lines(diff_texts(f)).groupBy("path").agg(F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))


@query("S03_hunk_lines", LINES)
def s03(f: Facts) -> DataFrame:
    return diffs.changed_lines(diff_texts(f))


def mapper_texts(f: Facts) -> DataFrame:
    text = F.concat(
        F.lit('<mapper namespace="'), "package_name", F.lit("."), "class_name", F.lit('"><sql id="cols">a, b</sql><select id="one" resultType="R">SELECT <include refid="cols"/> FROM t <where><if test="x">id = #{id}</if></where></select>'),
        F.lit('<delete id="gone">DELETE FROM t</delete><insert id="many">INSERT INTO t VALUES <foreach collection="l">(#{x})</foreach></insert></mapper>'),
    )
    return f.class_f.select(F.col("filepath").alias("path"), F.when(F.col("class_id") % 10 == 9, "<broken>").otherwise(text).alias("text"))


FULL = """SELECT package_name || '.' || class_name || '.' || id AS full_method, kind AS sql_type, sql AS sql_content, dyn AS is_dynamic_sql FROM {class_f},
  (VALUES ('one', 'SELECT', 'SELECT a, b FROM t WHERE id = #{{id}}', true), ('gone', 'DELETE', 'DELETE FROM t', false), ('many', 'INSERT', 'INSERT INTO t VALUES FOREACH (#{{x}})', true)) v(id, kind, sql, dyn) WHERE class_id % 10 <> 9"""


@query("S07_mapper_scan", FULL)
def s07(f: Facts) -> DataFrame:
    return mappers.statements(mapper_texts(f)).select("full_method", "sql_type", "sql_content", "is_dynamic_sql")


@query("C14_statement_text", "SELECT full_method, length(sql_content) AS n, is_dynamic_sql FROM (" + FULL + ") x WHERE sql_type = 'SELECT' OR sql_type = 'INSERT'")
def c14(f: Facts) -> DataFrame:
    """Texts that are put together from includes, conditions and loops."""
    return s07(f).filter("sql_type IN ('SELECT', 'INSERT')").select("full_method", F.length("sql_content").alias("n"), "is_dynamic_sql")


def nested_mapper_texts(f: Facts) -> DataFrame:
    """Fragments that include fragments, three deep, and one that includes what is not there."""
    text = F.concat(
        F.lit('<mapper namespace="n'), F.col("class_id").cast("string"), F.lit('"><sql id="a">x, y</sql><sql id="b"><include refid="a"/>, z</sql><sql id="c">id, <include refid="b"/></sql>'),
        F.lit('<select id="all">SELECT <include refid="c"/> FROM t'), F.col("class_id").cast("string"), F.lit("</select></mapper>"),
    )
    return f.class_f.select(F.col("filepath").alias("path"), text.alias("text"))


@query("G17_include_expansion", "SELECT 'n' || CAST(class_id AS STRING) || '.all' AS full_method, 'SELECT id, x, y, z FROM t' || CAST(class_id AS STRING) AS sql_content FROM {class_f}")
def g17(f: Facts) -> DataFrame:
    return mappers.statements(nested_mapper_texts(f)).select("full_method", "sql_content")


def java_lines(f: Facts) -> java.Source:
    text = F.concat(
        F.lit("package "), "package_name", F.lit(";\nimport com.base.Store;\nimport static com.base.Util.help;\n\n/** doc */\n@Service\npublic class "), "class_name",
        F.lit(" extends Base implements One, Two<X> {\n    private Store store;\n    static int count = 0;\n\n    public "), "class_name", F.lit("(Store s) {\n        this.store = s;\n    }\n\n    @Override\n    public List<String> load(Map<String, Integer> m, final long id) {\n"),
        F.lit('        Helper h = new Helper();\n        store.find(id); // store.skip(1)\n        h.run("x.y(z)");\n        store.find(2);\n        return own(id);\n    }\n\n    private List<String> own(long id) { return null; }\n}\n'),
    )
    return java.Source(f.class_f.select(F.col("filepath").alias("path"), text.alias("text")))


@query("S04_java_facts", "SELECT filepath AS path, 1 AS classes, 2 AS imports, 2 AS fields, 3 AS methods FROM {class_f}")
def s04(f: Facts) -> DataFrame:
    s = java_lines(f)
    n = lambda rows, name: rows.groupBy("path").agg(F.count("*").cast("int").alias(name))
    return n(s.classes, "classes").join(n(s.imports, "imports"), "path").join(n(s.fields, "fields"), "path").join(n(s.methods, "methods"), "path")


@query("M02_class_facts", "SELECT class_name, package_name, 'Class' AS class_type, 'Base' AS extends_class, 'One,Two' AS implements, 7 AS start_line FROM {class_f}")
def m02(f: Facts) -> DataFrame:
    return java_lines(f).classes.select("class_name", "package_name", "class_type", "extends_class", F.array_join("implements", ",").alias("implements"), "start_line")


@query("M03_import_facts", "SELECT filepath AS path, line_no, import_path, is_static FROM {class_f}, (VALUES (2, 'com.base.Store', false), (3, 'com.base.Util.help', true)) v(line_no, import_path, is_static)")
def m03(f: Facts) -> DataFrame:
    return java_lines(f).imports.select("path", "line_no", "import_path", "is_static")


@query("M04_field_facts", "SELECT filepath AS path, field_type, field_name, is_static FROM {class_f}, (VALUES ('Store', 'store', false), ('int', 'count', true)) v(field_type, field_name, is_static)")
def m04(f: Facts) -> DataFrame:
    return java_lines(f).fields.select("path", "field_type", "field_name", "is_static")


@query("M07_method_facts", """SELECT filepath AS path, coalesce(name, class_name) AS method_name, parameters, start_line, end_line, notes FROM {class_f},
  (VALUES (NULL, 'Store', 11, 13, ''), ('load', 'Map<String, Integer>,long', 16, 22, 'Override'), ('own', 'long', 24, 24, '')) v(name, parameters, start_line, end_line, notes)""")
def m07(f: Facts) -> DataFrame:
    return java_lines(f).methods.select("path", "method_name", "parameters", "start_line", "end_line", F.array_join("annotations", ",").alias("notes"))


@query("M09_created_objects", "SELECT filepath AS path, 17 AS line_no, 'Helper' AS class_name FROM {class_f}")
def m09(f: Facts) -> DataFrame:
    return java_lines(f).created


CALLED = """SELECT filepath AS path, 'load' AS caller, coalesce(callee, package_name || '.' || coalesce(simple, class_name)) AS callee_class, method_name, lines FROM {class_f},
  (VALUES ('com.base.Store', NULL, 'find', '18,20'), (NULL, 'Helper', 'run', '19'), (NULL, NULL, 'own', '21')) v(callee, simple, method_name, lines)"""


@query("M15_invocation_map", CALLED)
def m15(f: Facts) -> DataFrame:
    return java_lines(f).invocations.select("path", "caller", "callee_class", "method_name", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def nested_lines(f: Facts) -> java.Source:
    """A second layout: nested types, enums, several declarations on a line, overloads, chained calls, a block comment with code in it."""
    text = F.concat(
        F.lit("package "), "package_name", F.lit(";\nimport com.base.Store;\nimport com.base.*;\n/* a comment\n   class Fake { int no; }\n*/\n@Data\npublic class "), "class_name",
        F.lit(" {\n    private String name; private int size;\n    private Store store = new Store();\n    enum Color { RED, GREEN(2), BLUE; }\n    enum Size {\n        SMALL,\n        LARGE(10);\n        private int n;\n    }\n"),
        F.lit("    static class Item {\n        Helper helper;\n        Helper pick(int i) { return helper; }\n        String label(String s, Long n) { return s; }\n        String label(String s) { return s; }\n    }\n    public "), "class_name",
        F.lit("(String name) { this.name = name; }\n    public String run(Item item, int count) {\n        String text = item.pick(count).open(\"a\", true).trim();\n        item.label(text, (Long) count);\n        item.label(name);\n"),
        F.lit("        int n = item.helper.size + store.total;\n        Store.reset(1);\n        Color.valueOf(text);\n        tidy(new Item(), x -> x, n + 1);\n        return item.pick(3 + n).open(text, false);\n    }\n"),
        F.lit("    void tidy(Item a, Object b, int c) { }\n    String getName() { return name; }\n}\nclass Helper {\n    int size;\n    Helper open(String s, boolean b) { return this; }\n    Helper trim() { return null; }\n}\n"),
    )
    return java.Source(f.class_f.select(F.col("filepath").alias("path"), text.alias("text")))


def answers(columns: str, rows: str) -> str:
    return f"SELECT filepath AS path, {', '.join('v.' + c for c in columns.split(', '))} FROM {{class_f}}, (VALUES {rows}) v({columns})"


@query("M01_top_types", "SELECT filepath AS path, package_name, class_name FROM {class_f}")
def m01(f: Facts) -> DataFrame:
    """The first top-level type of each file; nested and later ones are not it."""
    return nested_lines(f).classes.filter("is_first").select("path", "package_name", "class_name")


@query("M05_enum_constants", answers("class_name, line_no, field_name", "('Color', 11, 'RED'), ('Color', 11, 'GREEN'), ('Color', 11, 'BLUE'), ('Size', 13, 'SMALL'), ('Size', 14, 'LARGE')"))
def m05(f: Facts) -> DataFrame:
    return nested_lines(f).enum_constants.select("path", "class_name", "line_no", "field_name")


@query("M06_constructors", "SELECT filepath AS path, class_name AS method_name, class_name AS return_type, 'String' AS parameters, 23 AS start_line FROM {class_f}")
def m06(f: Facts) -> DataFrame:
    return nested_lines(f).methods.filter("is_constructor").select("path", "method_name", "return_type", "parameters", "start_line")


@query("C34_end_lines", """SELECT filepath AS path, coalesce(name, class_name) AS method_name, start_line, end_line FROM {class_f}, (VALUES ('pick', 19, 19), ('label', 20, 20), ('label', 21, 21), (NULL, 23, 23), ('run', 24, 33), ('tidy', 34, 34), ('getName', 35, 35),
  ('open', 39, 39), ('trim', 40, 40)) v(name, start_line, end_line)""")
def c34(f: Facts) -> DataFrame:
    """Ends by the last brace that a method's body reaches."""
    return nested_lines(f).methods.select("path", "method_name", "start_line", "end_line")


@query("M08_local_types", "SELECT filepath AS path, coalesce(scope, class_name) AS class_name, name, type, rank FROM {class_f}, (VALUES (NULL, 'item', 'Item', 1), (NULL, 'count', 'int', 1), (NULL, 'text', 'String', 2), (NULL, 'n', 'int', 2), (NULL, 'name', 'String', 1), (NULL, 'a', 'Item', 1), (NULL, 'b', 'Object', 1), (NULL, 'c', 'int', 1), ('Item', 'i', 'int', 1), ('Item', 's', 'String', 1), ('Item', 's', 'String', 1), ('Item', 'n', 'Long', 1), ('Helper', 's', 'String', 1), ('Helper', 'b', 'boolean', 1)) v(scope, name, type, rank)")
def m08(f: Facts) -> DataFrame:
    """Parameters and local variables of each method, with their types."""
    return nested_lines(f).symbols.filter("rank < 3").select("path", "class_name", "name", "type", "rank")


@query("M10_invocations", """SELECT filepath AS path, line_no, method_name, coalesce(full_name, package_name || '.' || coalesce(simple, class_name)) AS callee_class FROM {class_f},
  (VALUES (25, 'pick', NULL, 'Item'), (26, 'label', NULL, 'Item'), (27, 'label', NULL, 'Item'), (29, 'reset', 'com.base.Store', NULL), (30, 'valueOf', NULL, 'Color'), (31, 'tidy', NULL, NULL), (32, 'pick', NULL, 'Item')) v(line_no, method_name, full_name, simple)""")
def m10(f: Facts) -> DataFrame:
    """Qualified, static and same-class calls by the class that they go to."""
    return nested_lines(f).resolved_calls.select("path", "line_no", "method_name", "callee_class")


@query("M13_name_resolution", "SELECT filepath AS path, line_no, target, how FROM {class_f}, (VALUES (25, 'item', 'PARAMETER'), (26, 'item', 'PARAMETER'), (27, 'item', 'PARAMETER'), (29, 'Store', 'IMPORT'), (30, 'Color', 'FILE'), (31, NULL, 'OWN'), (32, 'item', 'PARAMETER')) v(line_no, target, how)")
def m13(f: Facts) -> DataFrame:
    """How the name before each call was found."""
    return nested_lines(f).resolved_calls.select("path", "line_no", "target", "how")


@query("M11_chained_selectors", answers("line_no, position, owner, method_name", "(25, 0, 'Item', 'pick'), (25, 1, 'Helper', 'open'), (25, 2, 'Helper', 'trim'), (32, 0, 'Item', 'pick'), (32, 1, 'Helper', 'open')"))
def m11(f: Facts) -> DataFrame:
    return nested_lines(f).chains.select("path", "line_no", "position", "owner", "method_name")


@query("M12_member_uses", "SELECT filepath AS path, line_no, coalesce(own, class_name) AS owner, field_name FROM {class_f}, (VALUES (28, 'Item', 'helper'), (28, 'Store', 'total'), (23, NULL, 'name')) v(line_no, own, field_name)")
def m12(f: Facts) -> DataFrame:
    return nested_lines(f).member_uses.select("path", "line_no", "owner", "field_name")


@query("M14_argument_types", answers("line_no, method_name, types", "(25, 'pick', 'int'), (25, 'open', 'String,Boolean'), (26, 'label', 'String,Long'), (27, 'label', 'String'), (29, 'reset', 'Int'), (30, 'valueOf', 'String'), (31, 'tidy', 'Item,unknown,String'), (32, 'pick', 'String'), (32, 'open', 'String,Boolean')"))
def m14(f: Facts) -> DataFrame:
    return nested_lines(f).argument_types.select("path", "line_no", "method_name", "types")


@query("M16_accessor_find", "SELECT filepath AS path, class_name, method_name, field_name, field_type FROM {class_f}, (VALUES ('setName', 'name', 'String'), ('getSize', 'size', 'int'), ('setSize', 'size', 'int'), ('getStore', 'store', 'Store'), ('setStore', 'store', 'Store')) v(method_name, field_name, field_type)")
def m16(f: Facts) -> DataFrame:
    """Accessors that annotations generate, by the field that they stand for."""
    return nested_lines(f).accessors


def importing_lines(f: Facts) -> java.Source:
    """Files that import each other as the facts say: named, static (of a member) and by wildcard."""
    own = f.import_f.groupBy("class_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_wildcard"), F.concat(F.lit("import "), "import_path", F.lit(".*;"))).when(F.col("class_id") % 3 == 0, F.concat(F.lit("import static "), "import_path", F.lit(".help;"))).otherwise(F.concat(F.lit("import "), "import_path", F.lit(";"))))), "\n").alias("imports"))
    text = F.concat(F.lit("package "), "package_name", F.lit(";\n"), "imports", F.lit("\npublic class "), "class_name", F.lit(" {\n}\n"))
    return java.Source(f.class_f.join(own, "class_id").select(F.col("filepath").alias("path"), text.alias("text")))


@query("S06_import_closure", """WITH RECURSIVE d AS (SELECT DISTINCT c.filepath AS path, t.filepath AS needed FROM {import_f} i JOIN {class_f} c ON c.class_id = i.class_id JOIN {class_f} t ON CASE WHEN i.is_wildcard THEN t.package_name = i.import_path ELSE t.package_name || '.' || t.class_name = i.import_path END),
  r AS (SELECT path, needed FROM d UNION SELECT r.path, d.needed FROM r JOIN d ON d.path = r.needed) SELECT path, count(*) AS files FROM r WHERE path <> needed GROUP BY path""")
def s06(f: Facts) -> DataFrame:
    """The files that each file's imports lead to."""
    return importing_lines(f).import_reach


def project_folder(f: Facts) -> str:
    """A folder tree with a text a class, some of them test sources."""
    path = new_folder(f.spark, "project")
    folder = F.when(F.col("class_id") % 6 == 5, "src/test/java").when(F.col("class_id") % 4 == 2, "src/main/resources/mapper").otherwise("src/main/java")
    rows = f.class_f.select(folder.alias("folder"), F.concat(F.lit("class "), "class_name").alias("value"))
    for kind in ("src/main/java", "src/test/java", "src/main/resources/mapper"):
        rows.filter(F.col("folder") == kind).select("value").write.text(f"{path}/{kind}")
    return path


TREE = "CASE WHEN class_id % 6 = 5 THEN 'src/test/java' WHEN class_id % 4 = 2 THEN 'src/main/resources/mapper' ELSE 'src/main/java' END"


@query("S01_project_files", f"SELECT folder, count(*) AS classes FROM (SELECT {TREE} AS folder FROM {{class_f}}) x WHERE folder NOT LIKE '%src/test%' GROUP BY folder")
def s01(f: Facts) -> DataFrame:
    """A project folder listed with all below it, without test sources, and what its files hold."""
    files = folders.project_files(f.spark, project_folder(f), "*.txt")
    lines = files.select(F.regexp_extract("path", "/(src/[a-z/]+)/[^/]+$", 1).alias("folder"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("folder").agg(F.count("*").alias("classes"))


@query("S08_mapper_files", "SELECT count(*) FILTER (class_id % 6 <> 5) AS classes FROM {class_f} WHERE class_id % 4 = 2")
def s08(f: Facts) -> DataFrame:
    """Files that any of three globs finds, each once."""
    files = folders.by_globs(f.spark, project_folder(f), ["*.txt", "**/mapper/*", "src/main/resources/*/*.txt"]).filter(F.col("path").contains("/mapper/"))
    return files.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).filter("line <> ''").agg(F.count("*").alias("classes"))


@query("S12_catalogue", "SELECT tag_old AS baseline, tag_new AS version FROM {task_f} WHERE status = 'completed' GROUP BY tag_old, tag_new")
def s12(f: Facts) -> DataFrame:
    """Baselines and versions by the folders on disk."""
    path = new_folder(f.spark, "results")
    f.task_f.filter("status = 'completed'").select("tag_old", "tag_new", "task_id").repartition("tag_old", "tag_new").write.partitionBy("tag_old", "tag_new").parquet(path)
    return folders.catalogue(f.spark, path, "tag_old", "tag_new").toDF("baseline", "version")


@query("X06_unlisted_folders", """SELECT DISTINCT baseline, version FROM (SELECT tag_old AS baseline, tag_new AS version FROM {task_f} WHERE status = 'completed' UNION ALL SELECT tag_old, 'lost' || CAST(task_id % 7 AS STRING) FROM {task_f} WHERE status = 'pending') d
  WHERE NOT EXISTS (SELECT 1 FROM {task_f} t WHERE t.tag_old = d.baseline AND t.tag_new = d.version)""")
def x06_folders(f: Facts) -> DataFrame:
    """Versions that have a folder of results but no task."""
    path = new_folder(f.spark, "results")
    lost = f.task_f.filter("status = 'pending'").select("tag_old", F.concat(F.lit("lost"), (F.col("task_id") % 7).cast("string")).alias("tag_new"), "task_id")
    rows = f.task_f.filter("status = 'completed'").select("tag_old", "tag_new", "task_id").union(lost)
    rows.repartition("tag_old", "tag_new").write.partitionBy("tag_old", "tag_new").parquet(path)
    return folders.catalogue(f.spark, path, "tag_old", "tag_new").join(f.task_f.select("tag_old", "tag_new").distinct(), ["tag_old", "tag_new"], "left_anti").toDF("baseline", "version")


@query("C24_body_lines", """SELECT method_id, CASE WHEN body IS NULL OR body = '' THEN 0 WHEN json_valid(body) THEN json_array_length(body) ELSE 1 END AS lines, CASE WHEN body IS NULL OR body = '' THEN NULL WHEN json_valid(body) THEN body ->> '$[0]' ELSE body END AS first
  FROM (SELECT method_id, CASE method_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '["' || method_name || '() {{","}}"]' ELSE 'plain ' || method_name END AS body FROM {method_f}) x""")
def c24(f: Facts) -> DataFrame:
    """A stored body as lines: a JSON list, else the text as one line."""
    made = F.expr("""CASE method_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '["' || method_name || '() {","}"]' ELSE 'plain ' || method_name END""")
    lines = N.body_lines(F.col("body"))
    return f.method_f.select("method_id", made.alias("body")).select("method_id", F.size(lines).cast("long").alias("lines"), F.try_element_at(lines, F.lit(1)).alias("first"))


@query("C07_overload_variants", "SELECT method_id, CASE parameters WHEN '' THEN 1 WHEN 'Long' THEN 3 WHEN 'java.lang.Long' THEN 2 WHEN 'int,List<String>' THEN 6 ELSE 4 END AS variants FROM {method_f}")
def c07(f: Facts) -> DataFrame:
    return f.method_f.select("method_id", F.size(N.overload_variants(N.split_types(F.col("parameters")))).alias("variants"))


PLACES = ["app/mapper", "app/orderMapper", "resources/sql", "resources/mapper", "app/java", "app/generated"]
PLACE = "CASE class_id % 6 " + " ".join(f"WHEN {n} THEN '{p}'" for n, p in enumerate(PLACES)) + " END"


def placed_folder(f: Facts) -> str:
    """A folder tree with each class in one of PLACES."""
    path = new_folder(f.spark, "placed")
    for n, place in enumerate(PLACES):
        f.class_f.filter(F.col("class_id") % len(PLACES) == n).select(F.col("class_name").alias("value")).write.text(f"{path}/{place}")
    return path


def held_lines(files: DataFrame) -> DataFrame:
    """(folder, class_name): the lines of files in PLACES."""
    folder = F.regexp_extract("path", f"/({'|'.join(PLACES)})/[^/]+$", 1)
    return files.select(folder.alias("folder"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("class_name")).filter("class_name <> ''")


@query("S08_by_three_globs", f"SELECT {PLACE} AS folder, class_name FROM {{class_f}} WHERE class_id % 6 < 4")
def s08_globs(f: Facts) -> DataFrame:
    """Files that any of three globs finds, each once: every glob finds some that no other does, and one folder meets two."""
    return held_lines(folders.by_globs(f.spark, placed_folder(f), ["**/mapper/*", "**/*Mapper/*", "resources/**/*.txt"]))


@query("S01_with_ignored", f"SELECT {PLACE} AS folder, class_name FROM {{class_f}} WHERE class_id % 6 NOT IN (2, 5)")
def s01_ignored(f: Facts) -> DataFrame:
    """A project's files without those that an ignore list names."""
    return held_lines(folders.project_files(f.spark, placed_folder(f), "*.txt", ["**/generated/*", "sql/*.txt"]))


FULL_TAG = "CASE WHEN max_depth % 2 = 0 THEN md5(git_url) || left(md5(tag_new), 8) ELSE tag_new END"


@query("J21_tags_of_folders", f"""WITH t AS (SELECT status, {FULL_TAG} AS tag FROM {{task_f}}), s AS (SELECT status, tag, CASE WHEN length(tag) = 40 THEN left(tag, 8) ELSE tag END AS short FROM t)
  SELECT short AS folder, coalesce((SELECT min(k.tag) FROM s k WHERE k.short = d.short AND k.status <> 'pending'), short) AS full_tag FROM (SELECT DISTINCT short FROM s) d""")
def j21_folders(f: Facts) -> DataFrame:
    """Result folders, which have short names, with the full tag of a task that has started; without one, the name itself."""
    path = new_folder(f.spark, "tags")
    tags = f.task_f.select("task_id", "status", F.expr(FULL_TAG).alias("tag")).withColumn("short", N.short_tag(F.col("tag")))
    tags.select("short", "task_id").repartition("short").write.partitionBy("short").parquet(path)
    full = tags.filter("status <> 'pending'").groupBy("short").agg(F.min("tag").alias("full"))
    found = folders.catalogue(f.spark, path, "short").select(F.col("short").cast("string"))
    return found.join(full, "short", "left").select(F.col("short").alias("folder"), F.coalesce("full", "short").alias("full_tag"))
