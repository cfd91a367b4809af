"""Java sources as rows of tokens: one lexer pattern, brackets of a file matched by their level, neighbours and segments by their places in it.

A token knows its line, its levels of braces and parentheses, its neighbours, and the brace and
the parenthesis right around it. Tokens are numbered in three ways: by segment (up to a semicolon
or brace outside of parentheses), by statement (up to any of these, also behind `for (`, `try (` and
arrows) and by name (words joined by dots). Comments and white space are left out; strings, text
blocks and characters are one token each, whatever they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the language.
TYPE_KINDS = ["class", "interface", "enum", "record", "@interface"]
WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"
LEXEME = "|".join(
    [
        r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""', r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*", r"\n",
        rf"@(?!interface\b){WORD}(?:\.{WORD})*", r"@interface\b", WORD, r"\d[\w.]*", "->", "::", r"\.\.\.", r"\S",
    ]
)


def matched(codes: np.ndarray, opening: str, closing: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code of a file: the open brackets before it (a closing one has the level of its opening one), the place of the
    innermost opening bracket around it (for brackets their own), and for opening ones the place where they are closed; -1: none."""
    up, down = codes == ord(opening), codes == ord(closing)
    level = np.cumsum(up) - up - np.cumsum(down)
    inner, close = np.full((2, len(codes)), -1)
    last, begin, now = {}, 0, -1
    for i in np.flatnonzero(up | down).tolist():
        inner[begin:i] = now
        k = int(level[i])
        if up[i]:
            last[k] = inner[i] = now = i
        else:
            inner[i], now = last.get(k, -1), last.get(k - 1, -1)
            if inner[i] >= 0:
                close[inner[i]] = i
        begin = i + 1
    inner[begin:] = now
    return level, inner, close


#: Of each file's tokens but comments and line breaks: where they stand, their numbers, and the places of tokens that they lead to; -1: none.
PLACED = [
    "pos", "line_no", "curly", "round", "prev_pos", "next_pos", "seg", "stmt", "run", "end_pos", "end_line", "close", "close_line", "head_pos", "name_pos",
    "brace", "kind_pos", "type_pos", "around", "around_curly",
]


def among(codes: str) -> np.ndarray:
    """For each code, whether it is one of these."""
    return np.isin(np.arange(256), np.frombuffer(codes.encode(), np.uint8))


ENDS, BRACES, WORDS, NAMES, KINDS = map(among, (";{}", "{}", "wfki", "wfk", "ki"))


def placed(c: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays of PLACED for a file's codes (see `coded`) and lines.

    A segment's head is its first word for a kind of type that a name follows; a brace opens a type if its segment has a head. A
    token is right inside a type if its innermost brace opens one and all braces around it do.
    """
    (curly, brace, close), (level, around, _) = matched(c, "{", "}"), matched(c, "(", ")")
    pos = np.flatnonzero(c != ord(" "))
    n, none = len(pos), np.full(1, -1)
    before, after = np.concatenate([none, pos[:-1]])[:n], np.concatenate([pos[1:], none])[:n]
    at, prev, follows = c[pos], np.where(before >= 0, c[before], 0), np.where(after >= 0, c[after], 0)
    ends, outer = ENDS[at], level[pos] == 0
    last, splits = ends & outer, ends | (at == ord("(")) & (prev == ord("f")) | (at == ord(">"))
    seg, stmt = np.cumsum(last) - last, np.cumsum(splits) - splits
    run = np.cumsum(~(WORDS[at] & (prev == ord(".")) | (at == ord(".")) & WORDS[prev]))
    end = np.concatenate([pos[last], none])[seg]
    heads = np.flatnonzero(KINDS[at] & outer & (prev != ord(".")) & NAMES[follows])
    of_seg = np.full(int(seg[-1]) + 1 if n else 0, -1)
    of_seg[seg[heads][::-1]] = heads[::-1]
    head = of_seg[seg]
    head_pos, name_pos = np.where(head >= 0, pos[head], -1), np.where(head >= 0, after[head], -1)
    # by place in the file, as braces are named by theirs
    by_place = np.full((3, len(c)), -1)
    by_place[:, pos] = (at == ord("{")) & outer & (head >= 0), head_pos, name_pos
    own = brace[pos]
    opens, begins = by_place[0, pos], (own >= 0) & (by_place[0, own] == 1)
    ended = (at == ord("}")) & begins
    types = np.cumsum(opens) - (np.cumsum(ended) - ended)
    typed = begins & (types == curly[pos] + BRACES[at])
    closed = np.where((end >= 0) & (c[end] == ord("{")), close[end], -1)
    return (
        pos, line[pos], curly[pos], level[pos], before, after, seg, stmt, run, end, line[end], closed, line[closed], head_pos, name_pos,
        own, np.where(typed, by_place[1, own], -1), np.where(typed, by_place[2, own], -1), around[pos], curly[around[pos]],
    )


def coded(t: Column) -> Column:
    """A character for each token: brackets, dots and semicolons as they are, a space for comments and line breaks, > for an arrow,
    f for the words before the parentheses that part statements, k and i (@interface) for kinds of types, w for other words."""
    one = lambda x: (
        F.when(x.isin("{", "}", "(", ")", ";", "."), x).when(skipped(x), " ").when(x == "->", ">").when(x.isin("for", "try"), "f").when(x == "@interface", "i")
        .when(x.isin(TYPE_KINDS), "k").when(x.rlike(rf"^{WORD}"), "w").otherwise("x")
    )
    return F.array_join(F.transform(t, one), "")


def skipped(t: Column) -> Column:
    return t.startswith("//") | t.startswith("/*") | (t == "\n")


def kind_of(t: Column) -> Column:
    kind = (
        F.when(t.rlike("^[\"']"), "text").when(t.startswith("@") & (F.length(t) > 1) & (t != "@interface"), "note").when(t.rlike(rf"^(?:@interface$|{WORD})"), "word")
        .when(t.rlike(r"^\d"), "number").otherwise("mark")
    )
    return F.when(t.isNotNull(), kind)


def places(codes: Column, breaks: Column) -> Column:
    """A struct column of the arrays of PLACED, from a code for each of a file's tokens and the line breaks that each holds."""

    @F.arrow_udf(", ".join(f"{n} array<int>" for n in PLACED))
    def found(codes: pa.Array, breaks: pa.Array) -> pa.Array:
        files = []
        for code, n in zip(codes.to_pylist(), breaks, strict=True):
            n = n.values.to_numpy().astype(np.int64)
            c = np.frombuffer(code.encode(), np.uint8)
            files.append(placed(c, np.cumsum(n) - n + 1) if len(c) else [c] * len(PLACED))
        offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in files)]), pa.int32())
        flat = [np.concatenate([x[i] for x in files] or [np.empty(0)]).astype(np.int32) for i in range(len(PLACED))]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat], PLACED)

    return found(codes, breaks)


def lexed(files: DataFrame) -> DataFrame:
    """(path, pos, line_no, t, kind, curly, round, prev, prev_kind, next, next_pos, seg, stmt, run, end, head, in_head, enc, paren) of (path, text).

    kind is word, note (an annotation's name), number, text or mark. curly and round count the open
    brackets before a token; a closing bracket has the level of its opening one. end is the segment's
    last token (t, pos, line_no) with the place and line of its closing brace; in_head tells the segments
    that declare a type. enc is the innermost brace (pos, type: kind and name of the type that it opens),
    paren the innermost parenthesis (pos, curly); for brackets both are their own opening. Types in the
    code of methods open none.

    A file's text goes to one task before it is cut. Places and numbers are found while a file is a row, so that no row
    of a token is sorted or moved to know those around it.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.filter("text IS NOT NULL").repartition(tasks, "path").select("path", F.regexp_extract_all("text", F.lit(LEXEME), F.lit(0)).alias("t"))
    breaks = F.transform("t", lambda x: F.when(x.contains("\n"), F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).otherwise(0))
    rows = rows.select("path", "t", places(coded(F.col("t")), breaks).alias("p"))
    texts = {"t": "pos", "prev": "prev_pos", "next": "next_pos", "end_t": "end_pos", "head_t": "head_pos", "head_name": "name_pos", "type_kind": "kind_pos", "type_name": "type_pos"}
    shown = [F.transform(f"p.{place}", lambda i: F.when(i >= 0, F.get("t", i))).alias(name) for name, place in texts.items()]
    rows = rows.select("path", F.explode(F.arrays_zip(*shown, *(f"p.{n}" for n in PLACED))).alias("x")).select("path", "x.*")
    known = lambda place, c: F.when(F.col(place) >= 0, c)
    end = known("end_pos", F.struct(F.col("end_t").alias("t"), F.col("end_pos").alias("pos"), F.col("end_line").alias("line_no"), known("close", F.col("close")).alias("close"), known("close", F.col("close_line")).alias("close_line")))
    enc = F.struct(F.col("brace").alias("pos"), known("kind_pos", F.struct(F.col("type_kind").alias("kind"), F.col("type_name").alias("name"))).alias("type"))
    paren = F.struct(F.col("around").alias("pos"), F.col("around_curly").alias("curly"))
    t = F.col("t")
    return rows.select(
        "path", "pos", "line_no", "t", kind_of(t).alias("kind"), "curly", "round", "prev", kind_of(F.col("prev")).alias("prev_kind"), "next", known("next_pos", F.col("next_pos")).alias("next_pos"), "seg", "stmt", "run", end.alias("end"),
        known("head_pos", F.struct(F.col("head_t").alias("t"), F.col("head_name").alias("name"))).alias("head"), ((F.col("head_pos") >= 0) & (F.col("end_t") == "{")).alias("in_head"),
        F.when(F.col("curly") + t.isin("{", "}").cast("int") > 0, enc).alias("enc"), F.when(F.col("round") + t.isin("(", ")").cast("int") > 0, paren).alias("paren"),
    )


def angles(texts: str) -> str:
    """SQL: for each of an array of tokens, the open angle brackets before it; a closing one has the level of its opening one."""
    closing = "CAST(x = '>' AS INT)"
    step = f"struct(a.d + CAST(x = '<' AS INT) - {closing} AS d, array_append(a.levels, a.d - {closing}) AS levels)"
    return f"aggregate({texts}, struct(0 AS d, CAST(array() AS array<int>) AS levels), (a, x) -> {step}, a -> a.levels)"


def cut(texts: str) -> str:
    """SQL: the parts of an array of tokens between its commas outside of angle brackets, tokens joined by spaces."""
    marked = f"transform({texts}, (x, i) -> CASE WHEN x = ',' AND get({angles(texts)}, i) = 0 THEN '\\u0001' ELSE x END)"
    return f"filter(transform(split(array_join({marked}, ' '), '\\u0001'), x -> trim(x)), x -> x <> '')"


def plain(text: Column) -> Column:
    """A type's tokens, joined by spaces, as it is written: List<Map<String, ? extends X>>."""
    return F.regexp_replace(F.regexp_replace(text, r" ?([<>\[\].]) ?", "$1"), " ?, ?", ", ")


def simple(type_: Column) -> Column:
    """A type without arguments and dimensions."""
    return F.regexp_replace(type_, r"[<\[].*|\.\.\.$", "")
