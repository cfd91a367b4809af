"""Columns on names, signatures, tags and labels of code facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of short tags and the branches in their order.
SHORT_TAG = "(?i)^SHA[0-9a-f]{4}_[\\w.\\-]{11}$"
SHORT_TAG_INSIDE = "(?i)(SHA[0-9a-f]{4}_[\\w.\\-]{11})"
COMMIT_HASH = "(?i)^[0-9a-f]{40}$"
CHANGE_TYPES = ["ADDED", "MODIFIED", "DELETED", "UNCHANGED"]
BOXED = {"int": "Integer", "long": "Long", "double": "Double", "float": "Float", "boolean": "Boolean", "char": "Character", "byte": "Byte", "short": "Short"}


def short_tag(tag: Column) -> Column:
    """A short readable tag; applying it twice changes nothing. Null gives the empty text."""
    inside = F.regexp_extract(tag, SHORT_TAG_INSIDE, 1)
    return (
        F.when(tag.isNull() | (tag == ""), "")
        .when(tag.rlike(SHORT_TAG) | (F.length(tag) <= 11), tag)
        .when(inside != "", inside)
        .when(tag.rlike(COMMIT_HASH), F.substring(tag, 1, 8))
        .otherwise(F.concat(F.lit("SHA"), F.substring(F.sha2(tag, 256), 1, 4), F.lit("_"), F.right(tag, F.lit(11))))
    )


def signature(name: Column, types: Column) -> Column:
    """name(type,type) from a name and an array of types."""
    return F.concat(name, F.lit("("), F.array_join(types, ","), F.lit(")"))


def split_types(text: Column) -> Column:
    """Types of a parameter list, cut at commas outside <...>; no types for an empty list.

    Pieces between commas are joined again while more < than > have been seen.
    """
    depth = lambda s: F.length(F.regexp_replace(s, "[^<]", "")) - F.length(F.regexp_replace(s, "[^>]", ""))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, piece: Column) -> Column:
        size = F.size(state["out"])
        joined = F.when(
            (state["depth"] > 0) & (size > 0),
            F.concat(F.slice(state["out"], 1, F.greatest(size - 1, F.lit(0))), F.array(F.concat(F.element_at(state["out"], -1), F.lit(","), piece))),
        ).otherwise(F.concat(state["out"], F.array(piece)))
        return F.struct((state["depth"] + depth(piece)).alias("depth"), joined.alias("out"))

    types = F.aggregate(F.split(text, ","), start, add, lambda s: s["out"])
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(types, F.trim))


def types_of_signature(sig: Column) -> Column:
    """Types between the first ( and the last )."""
    return split_types(F.regexp_extract(sig, "(?s)\\((.*)\\)", 1))


def simple_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def package_name(qualified: Column) -> Column:
    """What stands before the last dot; a name without dots has none."""
    return F.when(F.instr(qualified, ".") > 0, F.regexp_replace(qualified, "\\.[^.]*$", "")).otherwise("")


def types_match(a: Column, b: Column) -> Column:
    """Whether two type lists are equal, each pair in full or by simple name."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (simple_name(x) == simple_name(y))), lambda same: same)


def similarity(a: Column, b: Column) -> Column:
    """+1 for each type of a found in b, less the distance of their places (the last place counts for repeats)."""
    last = lambda xs, x: F.size(xs) + 1 - F.array_position(F.reverse(xs), x)
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0).cast("long"), lambda s, x: s + 1 - F.abs(last(a, x) - last(b, x)))


def boxed_switch(name: Column) -> Column:
    """int and Integer swapped, and so on; other names unchanged."""
    pairs = BOXED | {v: k for k, v in BOXED.items()}
    out = name
    for k, v in pairs.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def literal_type(literal: Column) -> Column:
    return F.when(F.lower(literal).isin("true", "false"), "Boolean").when(literal.rlike("^[0-9]+$"), "Int").otherwise("String")


def canonical_basic(name: Column) -> Column:
    """int as it is, other basic types with a capital."""
    return F.when(name == "int", name).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))


def change_type(text: Column) -> Column:
    return F.when(F.upper(text).isin(CHANGE_TYPES), F.upper(text)).otherwise("UNKNOWN")


def api_paths(base: Column, paths: Column, verb: Column) -> Column:
    """[VERB]base/path for each path, with single slashes between."""
    trim = lambda s: F.regexp_replace(s, "^/+|/+$", "")
    return F.transform(paths, lambda p: F.concat(F.lit("["), verb, F.lit("]/"), F.array_join(F.filter(F.array(trim(base), trim(p)), lambda s: s != ""), "/")))


def decoded_list(text: Column) -> Column:
    """A JSON array of strings, or the text itself as the only element."""
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(text, "array<string>"), F.array(text)))


def without_thinking(text: Column, depth: int = 6) -> Column:
    """Thinking blocks removed from the inside out, up to depth levels; then left tags, blank lines over two and outer space."""
    inner = "(?s)<think>(?:(?!</?think>).)*</think>"
    for _ in range(depth):
        text = F.regexp_replace(text, inner, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "</?think>", ""), "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def short_label(label: Column) -> Column:
    """Parameter lists of 30 characters or more become dashes."""
    params = F.regexp_extract(label, "\\(([^()]*)\\)$", 1)
    head = F.regexp_extract(label, "^(.*)\\([^()]*\\)$", 1)
    dashes = F.array_join(F.transform(F.filter(F.split(params, "\\s*,\\s*"), lambda p: F.trim(p) != ""), lambda _: F.lit("—")), ", ")
    return F.when(F.length(params) < 30, label).otherwise(F.concat(head, F.lit("("), dashes, F.lit(")")))


#: The sign before a label's documentation, and how much of both is shown (the sign counts twice).
DOC_SIGN, DOC_SHOWN = "  \U0001f4dd", 42


def tree_label(label: Column) -> Column:
    """A node's label for a tree: parameters, from the last opening bracket to the end, as short_label has them, and the
    documentation behind its sign cut off with dots. What follows the sign is no parameter list."""
    at = F.instr(label, DOC_SIGN)
    main, doc = F.when(at > 1, F.left(label, at - 1)).otherwise(label), F.when(at > 1, F.substring(label, at, F.length(label))).otherwise(F.lit(""))
    inside = F.when(main.contains("("), F.substring_index(main, "(", -1))
    params = F.when(inside.endswith(")"), F.left(inside, F.length(inside) - 1))
    dashes = F.array_join(F.transform(F.filter(F.split(params, "\\s*,\\s*"), lambda p: F.trim(p) != ""), lambda _: F.lit("\u2014")), ", ")
    short = F.when(F.length(params) >= 30, F.concat(F.left(main, F.length(main) - F.length(inside)), dashes, F.lit(")"))).otherwise(main)
    return F.concat(short, F.when(F.length(doc) > DOC_SHOWN, F.concat(F.left(doc, F.lit(DOC_SHOWN)), F.lit("..."))).otherwise(doc))


def cut(text: Column, most: int = 100, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def display_width(text: Column) -> Column:
    """Code points, those above U+1F000 twice."""
    return F.char_length(text) + F.char_length(F.regexp_replace(text, "[^\\x{1F001}-\\x{10FFFF}]", ""))


def first_lines(lines: Column, most: int = 3) -> Column:
    """The first numbers, and how many more there are."""
    head = F.array_join(F.transform(F.slice(lines, 1, most), lambda x: x.cast("string")), ", ")
    return F.when(F.size(lines) > most, F.concat(head, F.lit("...(+"), (F.size(lines) - most).cast("string"), F.lit(")"))).otherwise(head)


def project_of_url(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "/", -1), "\\.git$", "")


def version_path(root: Column, project: Column, old: Column, new: Column, name: Column) -> Column:
    return F.concat_ws("/", root, F.concat_ws("_", project, short_tag(old)), short_tag(new), name)


def overload_variants(types: Column, most: int = 1000) -> Column:
    """All type lists that a call with these argument types may mean: each as it is, unknown, boxed or
    unboxed, or as a common implementation's interface. At most `most` of them, as the limit is the feature."""
    wider = {"ArrayList": "List", "LinkedList": "List", "HashMap": "Map", "LinkedHashMap": "Map", "HashSet": "Set", "TreeMap": "Map"}

    def choices(t: Column) -> Column:
        out = F.array(t, F.lit("null"), boxed_switch(t))
        for own, top in wider.items():
            out = F.when(t == own, F.array(t, F.lit("null"), F.lit(top))).otherwise(out)
        return F.array_distinct(out)

    start = F.array(F.array().cast("array<string>"))
    grow = lambda lists, t: F.slice(F.flatten(F.transform(lists, lambda a: F.transform(choices(t), lambda c: F.concat(a, F.array(c))))), 1, most)
    return F.aggregate(types, start, grow)


def body_lines(body: Column) -> Column:
    """A stored body as lines: a JSON list of them, else the text as one line; none for a null or empty body."""
    read = F.from_json(body, "array<string>")
    return F.when(body.isNull() | (body == ""), F.array().cast("array<string>")).otherwise(F.coalesce(read, F.array(body)))
