"""Secrets in texts, and who owns them: candidates judged by how widely they are copied.

Three base patterns give spans that always stay: assignments to secret-like names, access
key ids, and long hexadecimal runs. The method looks further: private key blocks, tokens with a
provider's prefix, passwords in URLs, bearer tokens, long mixed strings, and bare strings
that a base pattern caught somewhere else in the corpus (kind `known`). For each candidate
value it counts, over the whole corpus, the distinct owners (`source`) and repositories
(`doc_id`) that hold it. A value is a copied example if at least W owners and as many
repositories hold it, and looks live otherwise: many repositories of one owner are still that
owner's. W is calibrated on the corpus: one more than the owners that WIDE_QUANTILE of all
values stay within, and FEWEST_WIDE at least. Found strings become spans where they look live
and overlap no span of an earlier kind. Values travel as 64-bit hashes, counted by (value,
owner, repository) and then by value, so one widely copied value adds a row for each
distinct holder before the final count only.

Spans count code points, the end exclusive; kinds are ordered as in KINDS.

Defined results: a null or empty text has no spans; a null source or doc_id counts as one
owner or repository of its own; repeated rows count once; an empty table gives no rows;
other columns are not read. Matches that overlap within one kind are taken leftmost first.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, stored

KINDS = ["assign", "access", "hex", "keyblock", "provider", "url", "bearer", "mixed", "known"]
FEWEST_WIDE = 3
WIDE_QUANTILE = 0.99
MIN_MIXED = 24
MIN_BITS = 3.5

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as [0-9a-f]+ with shorter ones dropped: runs are maximal
KEYBLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----")
PROVIDER = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[spr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}"
    r"|eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,1000}"
)
URL = re.compile(r"://[^\s/:@]{1,255}:([^\s/@]{3,255})@")
BEARER = re.compile(r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,}=*)")
STRING = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")


def entropy(s: str) -> float:
    return -sum(k / len(s) * math.log2(k / len(s)) for k in map(s.count, set(s)))


class _Taken:
    """Stretches of a text that spans cover; they never overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start), self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """Takes a stretch if all of it is free."""
        at = bisect_right(self.starts, start)
        if (at and self.ends[at - 1] > start) or (at < len(self.starts) and self.starts[at] < end):
            return False
        self.starts.insert(at, start), self.ends.insert(at, end)
        return True


def candidates(text: str | None) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, base) by start, then kind."""
    if not text:
        return []
    found = [("assign", m.start(), m.end(), m[2], True) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m[0], True) for m in ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []
    found += [("hex", m.start(), m.end(), m[0], True) for m in HEX.finditer(text)]
    taken = _Taken([f[1:3] for f in found])

    def more(kind: str, pattern: re.Pattern, group: int = 0, sign: str = "") -> None:
        if sign in text:
            found.extend((kind, m.start(group), m.end(group), m[group], False) for m in pattern.finditer(text) if taken.add(m.start(group), m.end(group)))

    more("keyblock", KEYBLOCK, sign="PRIVATE KEY-----")
    more("provider", PROVIDER)
    more("url", URL, 1, "://")
    more("bearer", BEARER, 1, "earer ")
    for m in STRING.finditer(text):
        s = m[0]
        if s.isalpha() or not any(map(str.isdigit, s)) or not any(map(str.isalpha, s)):
            continue
        mixed = len(s) >= MIN_MIXED and any(map(str.isupper, s)) and any(map(str.islower, s)) and entropy(s) >= MIN_BITS
        if taken.add(m.start(), m.end()):
            found.append(("mixed" if mixed else "known", m.start(), m.end(), s, False))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def value_hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode(), 0) - (1 << 63)


def found_in(text_col: str = "text"):
    """A column: array of candidate spans."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,value:long,base:boolean>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e, "value": value_hash(v), "base": b} for k, s, e, v, b in candidates(t)] for t in texts], dtype=object)

    return find(F.col(text_col))


def wide_from(owned: DataFrame, quantile: float = WIDE_QUANTILE, fewest: int = FEWEST_WIDE) -> int:
    """The number of owners from which a value is a copied example; owned: a row a value that a base pattern caught.

    Only (owners, values) pairs reach the driver: a row for each distinct number of owners.
    """
    counts = sorted((r["owners"], r["n"]) for r in owned.filter("as_base").groupBy("owners").agg(F.count("*").alias("n")).collect())
    within, total = 0, sum(n for _, n in counts)
    for owners, n in counts:
        within += n
        if within >= quantile * total:
            return max(fewest, owners + 1)
    return fewest


def owned_spans(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, spans, n_copied) for rows of (rid, doc_id, source, found).

    Each span has kind, start, end, base, owners, repositories and live; n_copied counts the candidates that are copied examples.
    """
    each = rows.filter(F.size("found") > 0).select("rid", "doc_id", "source", F.explode("found").alias("f")).select("rid", "doc_id", "source", "f.*")
    held = each.groupBy("value", "source", "doc_id").agg(F.bool_or("base").alias("base"))
    held = held.groupBy("value", "source").agg(F.count("*").alias("n"), F.bool_or("base").alias("base"))
    owned = materialize(held.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.bool_or("base").alias("as_base")))
    wide = wide_from(owned)
    copied = (F.col("owners") >= wide) & (F.col("repositories") >= wide)
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"), "end", "kind", "base", "owners", "repositories", (~copied).alias("live"))
    real = each.join(owned, "value").filter("kind <> 'known' or as_base")
    judged = real.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(judged.schema["spans"].dataType)
    return rows.select("rid", "doc_id").join(judged, "rid", "left").select(
        "rid", "doc_id", F.coalesce(F.filter("spans", lambda s: s["base"] | s["live"]), none).alias("spans"),
        F.coalesce(F.size(F.filter("spans", lambda s: ~s["live"])), F.lit(0)).alias("n_copied"),
    )


def written(spans, keep=lambda s: F.lit(True)):
    return F.array_join(F.transform(F.filter(spans, keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, digest of the base spans, and all spans as text."""
    spans = F.col("spans")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", found_in().alias("found")))
    return owned_spans(rows).select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(written(spans, lambda s: s["base"]), 256).alias("base_sha256"), written(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"), F.col("n_copied").cast("long"),
    )


def hidden(text: str | None, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str | None:
    """text with each stretch of the spans replaced by mark."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with secrets replaced in the text, and its length in code points where there is such a column."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([hidden(t, [] if s is None else list(zip(s, e, strict=True))) for t, s, e in zip(texts, starts, ends, strict=True)], dtype=object)

    rows = stored(docs.select(F.monotonically_increasing_id().alias("rid"), found_in(text_col).alias("found"), F.struct("*").alias("row")))
    spans = owned_spans(rows.select("rid", "row.doc_id", "row.source", "found")).filter(F.size("spans") > 0).select("rid", "spans")
    joined = rows.select("rid", "row").join(spans, "rid", "left")
    text = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(hide(F.col("row")[text_col], F.col("spans.start"), F.col("spans.end")))
    done = joined.select("row", "spans", text.alias("hidden"))
    columns = [
        F.col("hidden").alias(c) if c == text_col
        else F.when(F.col("spans").isNull(), F.col("row")[c]).otherwise(F.char_length("hidden").cast(docs.schema[c].dataType)).alias(c) if c == length_col
        else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return done.select(*columns)
