"""Facts of Java sources: declarations as spans of tokens between matched brackets, names resolved by joins.

Members of a type are the segments whose innermost brace is the type's own, so it does not matter
how a declaration is laid out: annotations with values, signatures over several lines, braces on
lines of their own, arrays and anonymous classes as initial values, brackets in characters, strings
and comments. Local and anonymous types are part of the code around them. It is no compiler: types
of expressions are known for names, literals, casts, new objects and chains of calls.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.lookup import first_per_key
from ..session import written
from .javatokens import WORD, angles, cut, lexed, plain, simple

# Words of the language and annotations with a meaning.
MODIFIERS = ["public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "transient", "volatile", "sealed"]
NOT_CALLS = ["if", "for", "while", "switch", "catch", "return", "synchronized", "super", "this", "new", "try", "assert", "throw"]
NOT_TYPES = ["public", "private", "protected", "return", "new", "throw", "else", "package", "import", "case", "goto", "assert", "yield", "do", "break", "continue", "instanceof"]
BEFORE_CALLS = ["return", "else", "throw", "assert", "do", "case", "yield", "instanceof"]
BASIC_TYPES = ["string", "int", "integer", "boolean", "long", "byte", "short", "float", "double", "char"]
ACCESSOR_NOTES = ["Data", "Getter", "Setter"]
LOCAL = rf"^(?:final |@\S+ )*({WORD}(?: \. {WORD})*(?: < [^=;(){{}}]*>)?(?: \[ \])*) ({WORD})(?: \[ \])* (?:=(?! =)|:(?! :)|;)"


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of Java files below folder, without test sources."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(folder)
    return files.filter(~F.col("path").contains("src/test") & ~F.col("path").contains(".git/")).select("path", F.decode("content", "UTF-8").alias("text"))


#: SQL over an array `tokens` of a declaration: those outside of parentheses, and of these all but annotations and their parentheses.
FLAT = "filter(tokens, x -> x.round = 0)"
WORDS = "filter(flat, (x, i) -> NOT (x.kind = 'note' OR (x.t = '(' AND x.noted) OR (x.t = ')' AND i > 0 AND get(flat, i - 1).noted)))"
#: Annotations as (name, value), the value as written, null without one.
NOTES = """transform(filter(flat, x -> x.kind = 'note'), n -> struct(substring(n.t, 2) AS name, CASE WHEN n.next = '(' THEN array_join(transform(filter(tokens, x -> x.pos > n.pos
  AND x.pos < array_min(transform(filter(flat, y -> y.t = ')' AND y.pos > n.pos), y -> y.pos)) AND NOT (x.round = 0 AND x.t = '(')), x -> x.t), ' ') END AS value))"""
IS_MODIFIER = f"array_contains(array({', '.join(repr(m) for m in MODIFIERS)}), x)"


def _joined(*, by: str = " ") -> Column:
    """The group's tokens in order."""
    return F.expr(f"array_join(transform(array_sort(collect_list(struct(pos, t))), x -> x.t), '{by}')")


class Source:
    """Facts of sources (path, text). Tokens and declarations are computed once and written to the shared folder."""

    def __init__(self, files: DataFrame):
        self.files = files

    @cached_property
    def tokens(self) -> DataFrame:
        return written(lexed(self.files))

    def _together(self, *names: str) -> None:
        """Computes tables that do not need each other at the same time, as their jobs are small."""
        _ = self.tokens  # which all of them need
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(lambda n: getattr(self, n), names))

    @cached_property
    def types(self) -> DataFrame:
        """(path, open, type_kind, class_name, outer, package_name, extends_class, implements, modifiers, annotations, notes, start_line,
        end_line, is_first); open is the type's brace, outer the type around, null for top-level ones; package_name is the file's."""
        # the brace itself is inside of the type, all before it is outside
        first = F.min(F.when(F.col("t") != "{", F.struct("pos", "enc.type.name"))).alias("first")
        rows = self.tokens.filter("in_head").groupBy("path", "seg").agg(self._tokens().alias("tokens"), first, F.max(F.when(F.col("t") == "{", F.col("enc"))).alias("own"), F.first("end").alias("end"), F.first("head").alias("head")).filter("own.type IS NOT NULL AND own.pos = end.pos")
        rows = rows.withColumn("flat", F.expr(FLAT)).withColumn("shown", F.expr(WORDS)).withColumn("words", F.expr("shown.t")).withColumn("levels", F.expr(angles("words")))
        # places of the clauses that follow, outside of type arguments; the end where there is none
        clause = lambda w: F.expr(f"coalesce(array_min(filter(transform(words, (x, i) -> CASE WHEN x = '{w}' AND levels[i] = 0 THEN i + 1 END), p -> p IS NOT NULL)), size(words) + 1)")
        rows = rows.withColumns({"extends_at": clause("extends"), "implements_at": clause("implements"), "end_at": F.least(clause("permits"), clause("{"))})
        part = lambda a, b: F.expr(f"slice(words, {a} + 1, greatest({b} - {a} - 1, 0))")
        rows = rows.withColumns({"extended": part("extends_at", "least(implements_at, end_at)"), "implemented": part("implements_at", "end_at")})
        rows = rows.select(
            "path", F.col("end.pos").alias("open"), F.col("head.t").alias("type_kind"), F.col("head.name").alias("class_name"), F.col("first.name").alias("outer"), F.expr("get(shown, 0).line_no").alias("start_line"), F.col("end.close_line").alias("end_line"),
            F.nullif(plain(F.array_join("extended", " ")), F.lit("")).alias("extends_class"), F.expr(f"CASE WHEN size(implemented) > 0 THEN transform({cut('implemented')}, x -> trim(regexp_replace(x, '<.*', ''))) END").alias("implements"),
            F.expr(f"filter(words, x -> {IS_MODIFIER})").alias("modifiers"), F.expr(NOTES).alias("notes"),
            (F.row_number().over(Window.partitionBy("path").orderBy("seg")) == 1).alias("is_first"),
        )
        return written(rows.join(self.packages, "path").withColumn("annotations", F.col("notes.name")))

    @staticmethod
    def _tokens() -> Column:
        one = F.struct("pos", "t", "kind", "line_no", "round", F.coalesce((F.col("t") == "(") & (F.col("prev_kind") == "note"), F.lit(False)).alias("noted"), "next")
        return F.array_sort(F.collect_list(one))

    @cached_property
    def _top(self) -> DataFrame:
        """Texts of the segments outside of any brace."""
        top = self.tokens.filter(F.col("enc").isNull() & ~F.col("in_head") & (F.col("t") != ";")).groupBy("path", "seg")
        return written(top.agg(_joined().alias("line"), F.min("line_no").alias("line_no")))

    @cached_property
    def packages(self) -> DataFrame:
        """(path, package_name); unknown without a declaration."""
        found = F.regexp_extract("line", r"^(?:@.* )?package ([^@]+)$", 1)
        named = self._top.groupBy("path").agg(F.max(F.when(found != "", F.replace(found, F.lit(" "), F.lit("")))).alias("package_name"))
        return written(self.files.select("path").join(named, "path", "left").select("path", F.coalesce("package_name", F.lit("unknown")).alias("package_name")))

    @cached_property
    def imports(self) -> DataFrame:
        """(path, line_no, import_path, is_static, is_wildcard)"""
        pattern = r"^import (static )?([^*]+?)( \. \*)?$"
        part = lambda i: F.regexp_extract("line", pattern, i)
        return self._top.filter(F.col("line").rlike(pattern)).select("path", "line_no", F.replace(part(2), F.lit(" "), F.lit("")).alias("import_path"), (part(1) != "").alias("is_static"), (part(3) != "").alias("is_wildcard"))

    @property
    def classes(self) -> DataFrame:
        """types with class_type, the kind as a capitalised word."""
        return self.types.withColumn("class_type", F.initcap("type_kind"))

    @cached_property
    def members(self) -> DataFrame:
        """Segments right inside a type: (path, seg, type, open, tokens, words, texts, notes, end); type is its kind and name, open its brace."""
        own = self.tokens.filter(F.col("enc.type").isNotNull() & ~F.col("in_head") & (~F.col("t").isin("{", "}", ";") | (F.col("round") > 0)))
        rows = own.groupBy("path", "seg", F.col("enc.type").alias("type"), F.col("enc.pos").alias("open")).agg(self._tokens().alias("tokens"), F.first("end").alias("end"))
        return written(rows.withColumn("flat", F.expr(FLAT)).withColumn("words", F.expr(WORDS)).withColumn("texts", F.expr("words.t")).withColumn("notes", F.expr(NOTES)).drop("flat"))

    @cached_property
    def methods(self) -> DataFrame:
        """(path, class_name, method_name, return_type, parameters, names, type_parameters, modifiers, start_line, first_line, end_line, annotations, notes, is_static,
        is_abstract, is_constructor, body_open, body_close); names are the parameters as (name, type).

        start_line is the declaration's first word, first_line counts its annotations in. Without a body, as in
        interfaces, a method ends at its semicolon. Constructors are methods that return their class.
        """
        rows = self.members.selectExpr("*", "array_position(texts, '(') AS paren", "array_position(texts, '=') AS equals", "type.name AS class_name").filter("paren > 1 AND (equals = 0 OR paren < equals) AND end.t <> '}' AND get(words, int(paren) - 2).kind = 'word'")
        rows = rows.selectExpr("*", "get(texts, int(paren) - 2) AS method_name", "slice(texts, 1, greatest(int(paren) - 2, 0)) AS before")
        rows = rows.selectExpr("*", f"filter(before, x -> {IS_MODIFIER}) AS modifiers", f"filter(before, x -> NOT {IS_MODIFIER}) AS rest")
        # a method's own type parameters come first
        close = f"array_position(transform(rest, (x, i) -> x = '>' AND get({angles('rest')}, i) = 0), true)"
        rows = rows.selectExpr("*", f"CASE WHEN get(rest, 0) = '<' THEN int({close}) ELSE 0 END AS own_at").selectExpr("*", "slice(rest, own_at + 1, size(rest)) AS returned")
        rows = rows.withColumn("type_parameters", F.when(F.col("own_at") > 2, plain(F.expr("array_join(slice(rest, 2, greatest(own_at - 2, 0)), ' ')")))).withColumn("is_constructor", (F.size("returned") == 0) & (F.col("method_name") == F.col("class_name")))
        typed = F.expr(f"size(returned) > 0 AND get(returned, size(returned) - 1) <> ',' AND size({cut('returned')}) = 1") & ~F.get("returned", 0).isin([*NOT_TYPES, ",", "."])
        rows = rows.filter(F.col("is_constructor") | typed)
        inner = "transform(filter(tokens, x -> x.pos > get(words, int(paren) - 1).pos AND x.pos < get(words, int(paren)).pos AND x.round = 1 AND x.kind <> 'note' AND x.t NOT IN ('(', ')', 'final')), x -> x.t)"
        rows = rows.selectExpr("*", f"{inner} AS taken").selectExpr("*", f"{cut('taken')} AS each")
        # a dimension may follow the name
        pattern = rf"^(.+?)((?: \.\.\.)?) ({WORD}(?: \. this)?)((?: \[ \])*)$"
        one = lambda p: F.struct(F.regexp_extract(p, pattern, 3).alias("name"), plain(F.concat(F.regexp_extract(p, pattern, 1), F.regexp_extract(p, pattern, 4))).alias("type"))
        rows = rows.withColumn("names", F.filter(F.transform("each", one), lambda p: ~p["name"].isin("", "this")))
        rows = rows.withColumn("has_body", F.col("end.t") == "{")
        return written(
            rows.select(
                "path", "class_name", F.col("open").alias("type_open"), "method_name", F.when(F.col("is_constructor"), F.col("class_name")).otherwise(plain(F.array_join("returned", " "))).alias("return_type"),
                F.array_join("names.type", ",").alias("parameters"), "names", "type_parameters", "modifiers", F.expr("get(words, 0).line_no").alias("start_line"), F.expr("get(tokens, 0).line_no").alias("first_line"),
                F.when(F.col("has_body"), F.coalesce("end.close_line", F.lit(2**31 - 1))).otherwise(F.col("end.line_no")).alias("end_line"), F.col("notes.name").alias("annotations"), "notes",
                F.array_contains("modifiers", "static").alias("is_static"), (F.array_contains("modifiers", "abstract") | ((F.col("type.kind") == "interface") & ~F.col("has_body"))).alias("is_abstract"), "is_constructor",
                F.col("end.pos").alias("body_open"), F.when(F.col("has_body"), F.coalesce("end.close", F.lit(2**31 - 1))).otherwise(F.col("end.pos")).alias("body_close"),
            )
        )

    @cached_property
    def enum_constants(self) -> DataFrame:
        """(path, class_name, line_no, field_name): public static fields of type ENUM, up to the first semicolon of an enum."""
        own = self.tokens.filter("enc.type.kind = 'enum' AND round = 0 AND NOT in_head").withColumn("class_name", F.col("enc.type.name"))
        before = Window.partitionBy("path", "enc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        own = own.withColumn("ended", F.coalesce(F.max(F.col("t") == ";").over(before), F.lit(False)))
        named = own.filter(~F.col("ended") & (F.col("kind") == "word") & (F.col("prev").isin("{", ",", ")") | (F.col("prev_kind") == "note")))
        return named.select("path", "class_name", "line_no", F.col("t").alias("field_name"))

    @cached_property
    def fields(self) -> DataFrame:
        """(path, class_name, line_no, field_type, field_name, is_static, modifiers, annotations): the first name of each declaration."""
        stop = f"array_position(transform(texts, (x, i) -> x = '=' OR (x = ',' AND get({angles('texts')}, i) = 0)), true)"
        rows = self.members.selectExpr("*", "array_position(texts, '(') AS paren", "array_position(texts, '=') AS equals", "type.name AS class_name")
        rows = rows.filter("(paren = 0 OR (equals > 0 AND equals < paren)) AND (end.t = ';' OR (end.t = '{' AND equals > 0))").selectExpr("*", f"int({stop}) AS stop")
        rows = rows.selectExpr("*", f"filter(slice(texts, 1, CASE WHEN stop > 0 THEN stop - 1 ELSE size(texts) END), x -> NOT {IS_MODIFIER}) AS named")
        pattern = rf"^({WORD}.*?) ({WORD})((?: \[ \])*)$"
        rows = rows.withColumn("head", F.array_join("named", " ")).filter(F.col("head").rlike(pattern) & ~F.get("named", 0).isin(NOT_TYPES))
        part = lambda i: F.regexp_extract("head", pattern, i)
        ended = self.tokens.filter("enc.type.kind = 'enum' AND t = ';' AND round = 0").groupBy("path", F.col("enc.pos").alias("open")).agg(F.min("seg").alias("constants_end"))
        rows = rows.join(ended, ["path", "open"], "left").filter("type.kind <> 'enum' OR seg > constants_end")
        rows = rows.select("path", "class_name", F.get("words", 0)["line_no"].alias("line_no"), plain(F.concat(part(1), part(3))).alias("field_type"), part(2).alias("field_name"), F.array_contains("texts", "static").alias("is_static"),
                           F.expr(f"filter(texts, x -> {IS_MODIFIER})").alias("modifiers"), F.col("notes.name").alias("annotations"))
        return written(rows)

    @property
    def code(self) -> DataFrame:
        """Tokens in braces that open no type: all that stands in bodies of methods, and what stands in other blocks and values of fields."""
        return self.tokens.filter("enc IS NOT NULL AND enc.type IS NULL")

    def in_method(self, rows: DataFrame) -> DataFrame:
        """rows (with path and pos) inside a method's body, with its class_name, caller and body_open."""
        own = self.methods.select("path", "class_name", F.col("method_name").alias("caller"), "body_open", "body_close")
        return rows.join(own, "path").filter("pos > body_open AND pos < body_close").drop("body_close")

    @cached_property
    def runs(self) -> DataFrame:
        """Dotted names: (path, pos, names, text, line_no, next, next_pos, prev, prev_kind), of the last word where both ends differ."""
        parts = self.code.filter("kind = 'word' OR t = '.'").groupBy("path", "run").agg(
            F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("r"), F.max(F.struct("pos", "line_no", "next", "next_pos")).alias("last"), F.min(F.struct("pos", "prev", "prev_kind")).alias("first")
        )
        rows = parts.select("path", F.array_join("r.t", "").alias("text"), F.expr("filter(r.t, x -> x <> '.')").alias("names"), "last.*", F.col("first.prev").alias("prev"), F.col("first.prev_kind").alias("prev_kind"))
        return written(self.in_method(rows.filter("next = '(' OR size(names) > 1 OR prev = 'new'")))

    @cached_property
    def calls(self) -> DataFrame:
        """(path, class_name, caller, body_open, pos, line_no, target, method_name, at): target is what stands before the last dot, if any; at is the call's parenthesis."""
        declared = (F.col("prev_kind") == "word") & ~F.col("prev").isin(BEFORE_CALLS)
        rows = self.runs.filter((F.col("next") == "(") & ~F.col("text").startswith(".") & (F.coalesce("prev", F.lit("")) != "new") & ~F.coalesce(declared, F.lit(False)))
        name = F.element_at("names", -1)
        rows = rows.select("path", "class_name", "caller", "body_open", "pos", "line_no", F.nullif(F.array_join(F.slice("names", 1, F.size("names") - 1), "."), F.lit("")).alias("target"), name.alias("method_name"), F.col("next_pos").alias("at"))
        return rows.filter(~F.col("method_name").isin(NOT_CALLS) & ~F.col("method_name").rlike("^[A-Z]"))

    @property
    def created(self) -> DataFrame:
        """(path, line_no, class_name) of each `new X`."""
        rows = self.tokens.filter("prev = 'new' AND kind = 'word'").select("path", "run", "line_no")
        names = self.tokens.join(rows.select("path", "run"), ["path", "run"]).filter("kind = 'word'").groupBy("path", "run").agg(F.expr("filter(transform(array_sort(collect_list(struct(pos, t))), x -> x.t), x -> x RLIKE '^[A-Z]')").alias("names"))
        first = F.get("names", 0)
        return rows.join(names, ["path", "run"]).select("path", "line_no", first.alias("class_name")).filter("class_name IS NOT NULL")

    @cached_property
    def symbols(self) -> DataFrame:
        """(path, body_open, class_name, name, type, rank): parameters (1), locals (2) by method, fields (3) by class."""
        parameters = self.methods.select("path", "body_open", "class_name", F.explode("names").alias("p")).select("path", "body_open", "class_name", "p.name", "p.type", F.lit(1).alias("rank"))
        lines = self.code.groupBy("path", "stmt").agg(F.min("pos").alias("pos"), _joined().alias("line")).filter(F.col("line").rlike(LOCAL))
        part = lambda i: F.regexp_extract("line", LOCAL, i)
        local = self.in_method(lines).filter(~F.substring_index(part(1), " ", 1).isin(NOT_TYPES)).select("path", "body_open", "class_name", part(2).alias("name"), plain(part(1)).alias("type"), F.lit(2).alias("rank"))
        none = F.lit(None).cast("int")
        return written(parameters.union(local).union(self.fields.select("path", none, "class_name", "field_name", "field_type", F.lit(3))))

    def typed(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (with path, body_open, class_name) with the type and rank of the column `name`: a parameter, else a local of
        the method, else a field of the class; null where there is none."""
        here = self.symbols.filter("rank < 3").select("path", "body_open", F.col("name").alias(name), "type", "rank")
        field = self.symbols.filter("rank = 3").select("path", "class_name", F.col("name").alias(name), F.col("type").alias("field_type"))
        first = first_per_key(here, ["path", "body_open", name], [F.asc("rank"), F.asc("type")])
        found = rows.join(first, ["path", "body_open", name], "left").join(field.dropDuplicates(["path", "class_name", name]), ["path", "class_name", name], "left")
        return found.withColumn("rank", F.when(F.col("type").isNull() & F.col("field_type").isNotNull(), 3).otherwise(F.col("rank"))).withColumn("type", F.coalesce("type", "field_type")).drop("field_type")

    def named(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (with path) with full_name and how, for the simple class name in the column `name`, by the first step that
        knows it: an IMPORT, a type of the FILE, a SIBLING in the package, the UNIQUE type of that name, one whose package
        is IMPORTED as a whole, a type NESTED in the one before the dot; null and UNKNOWN where several types have the name
        and none of the steps chooses; else EXTERNAL, as no source declares it."""
        full = F.concat_ws(".", "package_name", "class_name")
        scope = lambda kind, of: F.concat(F.lit(f"{kind} "), of)
        places = F.array(scope("file", F.col("path")), F.when(F.col("outer").isNull(), scope("package", F.col("package_name"))), scope("type", F.col("outer")), F.lit("any"))
        declared = self.types.select(F.explode(F.array_compact(places)).alias("scope"), F.col("class_name").alias("simple"), full.alias("full_name"))
        imports = self.imports.filter("NOT is_static")
        imported = imports.filter("NOT is_wildcard").select(scope("import", F.col("path")).alias("scope"), F.substring_index("import_path", ".", -1).alias("simple"), F.col("import_path").alias("full_name"))
        known = declared.union(imported).groupBy("scope", "simple").agg(F.min("full_name").alias("found"), F.count("*").alias("n"))
        whole = imports.filter("is_wildcard").groupBy("path").agg(F.collect_set(scope("package", F.col("import_path"))).alias("whole"))
        asked = rows.select("path", F.col(name).alias("asked")).filter("asked IS NOT NULL").distinct().join(self.packages, "path").join(whole, "path", "left")
        asked = asked.withColumn("simple", F.substring_index("asked", ".", -1)).withColumn("before", F.try_element_at(F.split("asked", r"\."), F.lit(-2)))
        one = lambda rank, how, of, when=True: F.when(F.lit(when), F.struct(F.lit(rank).alias("rank"), F.lit(how).alias("how"), of.alias("scope")))
        direct = lambda c: F.when(F.col("before").isNull(), c)
        steps = F.array(direct(one(1, "IMPORT", scope("import", F.col("path")))), F.when(F.col("before").isNotNull(), one(2, "NESTED", scope("type", F.col("before")))), direct(one(3, "FILE", scope("file", F.col("path")))),
                        direct(one(4, "SIBLING", scope("package", F.col("package_name")))), one(5, "UNIQUE", F.lit("any")))
        wild = F.transform(F.coalesce("whole", F.array().cast("array<string>")), lambda x: one(6, "IMPORTED", x))
        tried = asked.select("path", "asked", "simple", F.explode(F.concat(F.array_compact(steps), wild)).alias("s")).select("path", "asked", "simple", "s.*")
        hits = tried.join(known, ["scope", "simple"])
        best = F.min(F.when((F.col("how") != "UNIQUE") | (F.col("n") == 1), F.struct("rank", "how", "found")))
        hits = hits.groupBy("path", "asked").agg(best.alias("best"), F.max(F.when(F.col("scope") == "any", F.col("n"))).alias("n_known"))
        answers = asked.join(hits, ["path", "asked"], "left")
        outside = F.when(F.col("n_known").isNull(), F.when(F.col("before").isNull(), F.concat_ws(".", "package_name", "asked")).otherwise(F.col("asked")))
        how = F.coalesce("best.how", F.when(F.col("n_known") > 1, F.lit("UNKNOWN")).otherwise(F.lit("EXTERNAL")))
        return rows.join(answers.select("path", F.col("asked").alias(name), how.alias("named_how"), F.coalesce("best.found", outside).alias("full_name")), ["path", name], "left")

    @cached_property
    def parents(self) -> DataFrame:
        """(src, dst): types and their super classes by full name."""
        own = self.types.select("path", F.concat_ws(".", "package_name", "class_name").alias("src"), simple(F.col("extends_class")).alias("parent")).filter("parent IS NOT NULL")
        return self.named(own, "parent").filter("full_name IS NOT NULL").select("src", F.col("full_name").alias("dst")).distinct()

    def found_above(self, calls: DataFrame) -> DataFrame:
        """(path, at, body_open, declared_in, distance, parameters) of calls with full_name: the nearest class from full_name (at distance
        0) upwards that declares a method of that name and number of parameters; of several there, the one whose parameter types
        fit best. Calls on `super` begin one class higher. Each round takes what is left one class up."""
        declared = self.methods.join(self.packages, "path").select(F.concat_ws(".", "package_name", "class_name").alias("full_name"), "method_name", F.size("names").alias("arity"), "parameters", F.col("names.type").alias("takes"), F.col("start_line").alias("at_line"))
        key, out = ["path", "at", "body_open"], []
        left = calls.select(*key, "full_name", "method_name", (F.coalesce("target", F.lit("")) == "super").alias("skip"), F.array("full_name").alias("seen"))
        left = left.join(self.arguments, ["path", "at"], "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>"))).withColumn("arity", F.size("types"))
        for distance in count():
            fits = left.filter("NOT skip").join(declared, ["full_name", "method_name", "arity"]).withColumn("score", fit(F.col("types"), F.col("takes")))
            best = first_per_key(fits, key, [F.desc("score"), F.asc("at_line"), F.asc("parameters")])
            best = best.select(*key, F.col("full_name").alias("declared_in"), F.lit(distance).alias("distance"), "parameters")
            tried = written(left.join(best, key, "left"))
            out.append(tried.filter("declared_in IS NOT NULL").select(*best.columns))
            left = tried.filter("declared_in IS NULL").drop("declared_in", "distance", "parameters")
            if left.isEmpty():
                return reduce(DataFrame.union, out)
            # a cycle of classes ends where a call is back at a class
            up = left.withColumnRenamed("full_name", "src").join(self.parents, "src").filter(~F.array_contains("seen", F.col("dst")))
            left = written(up.select(*key, F.col("dst").alias("full_name"), "method_name", "types", "arity", F.lit(False).alias("skip"), F.array_append("seen", F.col("dst")).alias("seen")))

    @cached_property
    def argument_texts(self) -> DataFrame:
        """(path, at, arguments): of each parenthesis in code, the texts between its commas, tokens joined by spaces; inner parentheses
        show what is right inside them."""
        shown = F.when(F.col("t").startswith("'"), "''").when(F.col("kind") == "text", '""').otherwise(F.col("t"))
        direct = self.code.filter(F.col("paren").isNotNull() & ~F.col("t").isin("(", ")") & (F.col("curly") == F.col("paren.curly"))).select("path", F.col("paren.pos").alias("at"), "pos", shown.alias("t"))
        joined = _joined()
        inner = direct.groupBy("path", "at").agg(joined.alias("text"))
        # a parenthesis stands in the one around the token before it
        opened = self.code.filter("next = '(' AND t <> ')' AND paren IS NOT NULL").select("path", F.col("paren.pos").alias("around"), F.col("next_pos").alias("pos"))
        opened = opened.join(inner.withColumnRenamed("at", "pos"), ["path", "pos"], "left").select("path", F.col("around").alias("at"), "pos", F.concat(F.lit("("), F.coalesce("text", F.lit("")), F.lit(")")).alias("t"))
        texts = direct.union(opened).groupBy("path", "at").agg(joined.alias("text"))
        safe = F.replace(F.col("text"), F.lit("->"), F.lit("::"))  # an arrow is no end of type arguments
        return texts.select("path", "at", F.split(safe, r" ?,(?![^<(]*>)(?![^()]*\)) ?").alias("arguments"))

    @cached_property
    def arguments(self) -> DataFrame:
        """(path, at, types): argument types of the calls of methods; those of calls whose arguments are not known are unknown."""
        sites = self.runs.filter("next = '('").select("path", "class_name", "body_open", F.col("next_pos").alias("at"))
        each = sites.join(self.argument_texts, ["path", "at"]).select("path", "class_name", "body_open", "at", F.posexplode("arguments").alias("place", "argument"))
        known, a = self.typed(each, "argument"), F.col("argument")
        cast, made = r"^\(([A-Z]\w*)(?: <.*)?\) ?[\w(\"]", r"^new ([A-Z]\w*)"
        kind = (
            F.when(a.isin("true", "false"), "Boolean").when(a.rlike(r"^\d+$"), "Int").when(a.rlike(r"::|\?"), "unknown").when(a.rlike(cast), F.regexp_extract(a, cast, 1)).when(a.rlike(made), F.regexp_extract(a, made, 1))
            .when(a == '""', "String").when(a == "''", "char").when(a.rlike(r"[-+*/%<>=&|]"), "String").otherwise(F.coalesce(simple(F.col("type")), F.lit("unknown")))
        )
        return known.withColumn("kind", kind).groupBy("path", "at").agg(F.expr("transform(array_sort(collect_list(struct(place, kind))), x -> x.kind)").alias("types"))

    @cached_property
    def resolved_calls(self) -> DataFrame:
        """calls with callee_class, how, parameters (of the method chosen, for calls within the class) and distance.

        The target's type is that of a PARAMETER, LOCAL or FIELD, or of a class by name (see `named`). Calls without a
        target, on `this` and on `super` go to the nearest super class that declares a method of that name and number of
        parameters, OWN at distance 0, else INHERITED; of several there, the one whose parameter types fit best. Where none
        does, the callee is unknown.
        """
        self._together("types", "members", "packages")
        self._together("methods", "fields")
        self._together("runs", "symbols")
        within = F.col("target").isNull() | F.col("target").isin("this", "super")
        columns = ["path", "class_name", "caller", "body_open", "at", "pos", "line_no", "target", "method_name", "how", "callee_class", "parameters", "distance", "full_name"]

        def own() -> DataFrame:
            rows = self.calls.filter(within).join(self.packages, "path").withColumn("full_name", F.concat_ws(".", "package_name", "class_name"))
            rows = rows.join(self.found_above(rows), ["path", "at", "body_open"], "left").withColumnRenamed("declared_in", "callee_class")
            how = F.when(F.col("distance") == 0, "OWN").when(F.col("distance") > 0, "INHERITED").otherwise("UNKNOWN")
            return rows.withColumn("how", how).select(*columns)

        def others() -> DataFrame:
            rows = self.typed(self.calls.filter(~within), "target").withColumn("asked", simple(F.coalesce("type", "target")))
            how = F.when(F.col("rank") == 1, "PARAMETER").when(F.col("rank") == 2, "LOCAL").when(F.col("rank") == 3, "FIELD").otherwise(F.col("named_how"))
            none = {"parameters": F.lit(None).cast("string"), "distance": F.lit(None).cast("int")}
            return written(self.named(rows, "asked").withColumns({"how": how, "callee_class": F.col("full_name"), **none}).select(*columns))

        with ThreadPoolExecutor(2) as pool:
            return reduce(DataFrame.union, [part.result() for part in [pool.submit(own), pool.submit(others)]])

    @property
    def declarations(self) -> DataFrame:
        """resolved_calls with declared_in, the class at or above the callee's that declares the method, its distance and the
        parameters of the overload that fits best, also for calls on other classes; null where no source declares it."""
        calls = self.resolved_calls.drop("parameters", "distance")
        return calls.join(self.found_above(calls.filter("full_name IS NOT NULL")), ["path", "at", "body_open"], "left")

    @property
    def invocations(self) -> DataFrame:
        """(path, class_name, caller, callee_class, method_name, lines): call sites merged."""
        return self.resolved_calls.groupBy("path", "class_name", "caller", "callee_class", "method_name").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))

    @property
    def chains(self) -> DataFrame:
        """(path, caller, line_no, position, owner, method_name): calls on results of calls; owner is the class that the call
        before returns, null where that method is not known. Position 0 is the first call of the chain."""
        later = self.runs.filter((F.col("next") == "(") & F.col("text").startswith(".") & (F.col("prev") == ")") & (F.size("names") == 1))
        # the closing parenthesis before the dot knows where it was opened
        closed = self.tokens.filter("t = ')'").select("path", F.col("paren.pos").alias("at"), F.col("next_pos").alias("dot"))
        dots = self.tokens.filter("t = '.'").select("path", F.col("pos").alias("dot"), F.col("next_pos").alias("pos"))
        links = written(later.join(dots, ["path", "pos"]).join(closed, ["path", "dot"]).select("path", "at", F.col("next_pos").alias("then"), F.element_at("names", 1).alias("next_name"), F.col("line_no").alias("next_line")).distinct())
        sites = self.typed(self.calls.join(links.select("path", "at").distinct(), ["path", "at"], "left_semi"), "target")
        now = sites.select("path", "caller", "body_open", "at", "line_no", F.lit(0).alias("position"), simple(F.coalesce("type", "target", "class_name")).alias("owner"), "method_name")
        returns = self.methods.groupBy(F.col("class_name").alias("owner"), "method_name").agg(F.min("return_type").alias("returned"))
        out = []
        for position in count(1):
            out.append(now := written(now))
            if now.isEmpty():
                break
            step = now.join(returns, ["owner", "method_name"], "left").join(links, ["path", "at"])
            now = step.select("path", "caller", "body_open", F.col("then").alias("at"), F.col("next_line").alias("line_no"), F.lit(position).alias("position"), simple(F.col("returned")).alias("owner"), F.col("next_name").alias("method_name"))
        return reduce(DataFrame.union, out).select("path", "caller", "line_no", "position", "owner", "method_name")

    @property
    def member_uses(self) -> DataFrame:
        """(path, caller, line_no, owner, field_name): references `name.field` to members of a typed name's class."""
        names = F.when(F.col("next") == "(", F.slice("names", 1, F.size("names") - 1)).otherwise(F.col("names"))
        rows = self.runs.filter(~F.col("text").startswith(".") & (F.coalesce("prev", F.lit("")) != "new")).withColumn("names", names).filter("size(names) > 1")
        rows = rows.select("*", F.get("names", 0).alias("target"), F.get("names", 1).alias("field_name")).filter(F.col("target").rlike("^[a-z]") & F.col("field_name").rlike("^[a-z]"))
        owner = F.when(F.col("target") == "this", F.col("class_name")).otherwise(simple(F.col("type")))
        return self.typed(rows, "target").select("path", "caller", "line_no", owner.alias("owner"), "field_name").filter("owner IS NOT NULL")

    @property
    def argument_types(self) -> DataFrame:
        """(path, caller, line_no, pos, method_name, types): of calls with arguments. Literals, casts, new objects and typed names have
        types; a binary operation counts as String; the rest is unknown."""
        rows = self.runs.filter((F.col("next") == "(") & (F.coalesce("prev", F.lit("")) != "new")).withColumn("method_name", F.element_at("names", -1)).filter(~F.col("method_name").isin(NOT_CALLS))
        return rows.withColumn("at", F.col("next_pos")).join(self.arguments, ["path", "at"]).select("path", "caller", "line_no", "pos", "method_name", F.array_join("types", ",").alias("types"))

    @property
    def accessors(self) -> DataFrame:
        """(path, class_name, method_name, field_name, field_type): getters and setters that a class's annotations generate and it does not declare."""
        own = self.fields.select("path", "class_name", "field_name", "field_type").join(self.types.select("path", "class_name", F.col("annotations").alias("notes")), ["path", "class_name"])
        has = lambda *names: F.arrays_overlap("notes", F.array(*map(F.lit, names)))
        name = F.concat(F.upper(F.substring("field_name", 1, 1)), F.expr("substring(field_name, 2)"))
        made = F.explode(F.array_compact(F.array(F.when(has("Data", "Getter"), F.concat(F.lit("get"), name)), F.when(has("Data", "Setter"), F.concat(F.lit("set"), name)))))
        rows = own.select("path", "class_name", made.alias("method_name"), "field_name", "field_type")
        return rows.join(self.methods.select("path", "class_name", "method_name"), ["path", "class_name", "method_name"], "left_anti")

    @property
    def _import_steps(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(path, needed) of named and static imports, (path, package_name) of those by wildcard, (package_name, needed) of each package's files."""
        types = self.types.filter("outer IS NULL").select(F.col("path").alias("needed"), "package_name", F.concat_ws(".", "package_name", "class_name").alias("full_name"))
        # a static import names a member of the type
        named = self.imports.filter("NOT is_wildcard").select("path", F.when(F.col("is_static"), F.regexp_replace("import_path", "\\.\\w+$", "")).otherwise(F.col("import_path")).alias("full_name"))
        whole = self.imports.filter("is_wildcard").select("path", F.col("import_path").alias("package_name"))
        return named.join(types, "full_name").select("path", "needed"), whole, types.select("package_name", "needed")

    @property
    def import_closure(self) -> DataFrame:
        """(path, needed, distance): files that a file's imports lead to, named, static and by wildcard, step by step."""
        named, whole, members = self._import_steps
        direct = named.union(whole.join(members, "package_name").select("path", "needed"))
        return graph.closure(direct.distinct().toDF("src", "dst")).toDF("path", "needed", "distance")

    @property
    def import_reach(self) -> DataFrame:
        """(path, files): how many other files a file's imports lead to, for files that have such; pairs are not made.

        A package is a node between those that take it in whole and its files, so there is an edge an import and one a file.
        """
        named, whole, members = self._import_steps
        file, package = lambda c: F.concat(F.lit("f:"), c), lambda c: F.concat(F.lit("p:"), c)
        edges = named.select(file("path"), file("needed")).union(whole.select(file("path"), package("package_name"))).union(members.join(whole, "package_name", "left_semi").select(package("package_name"), file("needed")))
        counts = graph.reach_counts(written(edges.distinct().toDF("src", "dst")), F.col("node").startswith("f:"))
        return counts.filter("n > 0").select(F.expr("substring(node, 3)").alias("path"), F.col("n").alias("files"))


def fit(given: Column, takes: Column) -> Column:
    """How well argument types fit parameter types: one for each that occurs, less its distance; the last place of equal ones counts."""
    last = lambda x: F.size(given) - F.array_position(F.reverse(given), x).cast("int")
    each = F.transform(takes, lambda x, i: F.when(F.array_contains(given, simple(x)), 1 - F.abs(i - last(simple(x)))).otherwise(0))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)
