"""Models, searches and page extraction on small inputs, against brute force or held-out results."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplecast.llm import brown, decontaminate, htmlmain, langid, queries, secretscan, simhash
from ripplecast.llm.common import id_bucket

from ..conftest import SF
from .data import documents, prose, rows


def test_language_is_found_in_held_out_rows(spark):
    got = queries.op3_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    held = got.filter("held_out")
    assert held.count() > 10 and held.filter("lang_pred = lang").count() >= 0.95 * held.count()


def segmentations(word, pieces, p):
    """Sum over all ways to cut word."""
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in pieces:
                total[end] += total[start] * p[pieces.index(word[start:end]) + 1]
        if word[end - 1] not in pieces:
            total[end] += total[end - 1] * p[0]
    return total[-1]


def test_forward_algorithm():
    import numpy as np

    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    rng = np.random.default_rng(1)
    p = langid.pieces_with_zero(rng.dirichlet(np.ones(len(pieces) + 1), 2).T)
    words = ["▁" + w for w in ["a", "abab", "bca", "aaba", "c", "abcab"]]
    got = langid.Lattice(pieces).score(words, p)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(segmentations(w, pieces, p[:, k])))
        assert langid.Lattice(pieces).long_score(w, p) == pytest.approx(row)


def test_expected_uses_of_pieces():
    """Against all segmentations, weighted by their probability; words of any length, and pieces of tiny probability."""
    import numpy as np

    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    lattice = langid.Lattice(pieces)
    for low in (1.0, 1e-100):
        p = np.random.default_rng(2).dirichlet(np.ones(len(pieces) + 1)) * np.where(np.arange(8) == 3, low, 1.0)
        p = np.append(p, 0.0)
        words, counts = ["▁abab", "▁bca", "▁a", "▁aaba", "▁bbb"], np.array([3.0, 1.0, 2.0, 5.0, 4.0])
        want, likely = np.zeros(9), 0.0
        for w, c in zip(words, counts):
            ways = [([], 1.0, 0)]
            done = []
            while ways:
                used, q, at = ways.pop()
                if at == len(w):
                    done.append((used, q))
                    continue
                for end in range(at + 1, len(w) + 1):
                    if w[at:end] in pieces:
                        ways.append(([*used, pieces.index(w[at:end]) + 1], q * p[pieces.index(w[at:end]) + 1], end))
                if w[at] not in pieces:
                    ways.append(([*used, 0], q * p[0], at + 1))
            total = sum(q for _, q in done)
            likely += c * math.log(total)
            for used, q in done:
                for u in used:
                    want[u] += c * q / total
        got, alone = np.zeros(9), np.zeros(9)
        assert lattice.expected(words, counts, p, got) == pytest.approx(likely)
        assert got == pytest.approx(want)
        assert sum(lattice.long_expected(w, c, p, alone) for w, c in zip(words, counts)) == pytest.approx(likely)
        assert alone == pytest.approx(want)


def test_language_training_raises_the_likelihood(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = langid.letter_pieces(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    model = langid.train(docs, pieces, steps=4, tolerance=0)
    assert len(model.likelihoods) == 4 and model.likelihoods == sorted(model.likelihoods)
    assert langid.words_of("Ab²c½ dⅧe 漢字_一x9") == ["ab", "c", "d", "e", "漢字", "一x"]
    long = documents(spark, [(1, "ab" * 50 + " abc " * 9, "xx", None, 1, 1, 1, "", ""), (2, "ö" * 90, "yy", None, 1, 1, 1, "", "")])
    own = langid.train(long, pieces)
    assert {r.lang: r.p.lang_pred for r in long.select("lang", langid.predicted(own).alias("p")).collect()} == {"xx": "xx", "yy": "yy"}


def test_language_of_odd_rows(spark):
    model = langid.train(documents(spark), langid.letter_pieces(__import__("public_tokenizers").path("piece_bpe_32k.model")))
    docs = documents(spark)
    got = docs.select("text", langid.predicted(model).alias("p")).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.p.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.p.score <= 1
    none = langid.train(documents(spark, []), ["▁", "a"])
    assert {r.p.lang_pred for r in docs.select(langid.predicted(none).alias("p")).collect()} == {"und"}


@pytest.mark.parametrize("some", [None, []])
def test_class_model_base(spark, monkeypatch, some):
    monkeypatch.setattr(brown, "HEAD_WORDS", 30)
    monkeypatch.setattr(brown, "EXCHANGED", 10)
    docs = documents(spark, some)
    got = brown.scored(docs, id_bucket("doc_id", 7) == 2).collect()
    held = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", (id_bucket("doc_id", 7) == 2).alias("h")).collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    own = rows() if some is None else some
    counts = Counter(w for r in own if not held[r[0], r[1]] for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in own:
        ws = tokens(r[1])
        want.append((-1 if r[0] is None else r[0], held[r[0], r[1]], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 3)))
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == Counter(want)
    assert all(r.score < 0 for r in got)


def test_class_model_score_token_by_token(spark, monkeypatch):
    """Scores, class bigrams and likelihoods from plain counts over the classes that were learned."""
    import numpy as np

    monkeypatch.setattr(brown, "HEAD_WORDS", 60)
    monkeypatch.setattr(brown, "EXCHANGED", 20)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 5_000)
    held = id_bucket("doc_id", 7) == 2
    texts = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", held.alias("h")).collect()]
    m = brown.fit(docs.filter(~held), brown.word_counts(docs.filter(~held)), k=6)
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    unit = lambda w: m.vocabulary.index.get(w, 1 + m.vocabulary.own + brown.suffix_unit(w) if w not in m.vocabulary.index else 0)
    counts, bigrams, size, types = Counter(), np.zeros((6, 6)), np.zeros(6), np.zeros(6)
    for _, t, h in texts:
        if not h:
            before = 0
            for w in tokens(t):
                counts[w] += 1
                c = m.classes[unit(w)]
                bigrams[before, c] += 1
                before = c
    for w, n in counts.items():
        size[m.classes[unit(w)]] += n
        types[m.classes[unit(w)]] += 1
    assert m.classes[0] == 0 and (m.classes[1:] > 0).all()
    assert m.likelihoods == sorted(m.likelihoods) and len(m.likelihoods) > 1
    part = lambda x: sum(v * math.log(v) for v in np.ravel(x) if v)
    assert m.likelihoods[-1] == pytest.approx(part(bigrams) - part(bigrams.sum(axis=0)) - part(bigrams.sum(axis=1)))
    prior = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + 6)
    monkeypatch.setattr(brown, "fit", lambda *_: m)
    got = {r.doc_id: r.score for r in brown.scored(docs, held).collect()}
    for doc_id, t, _ in texts:
        want, before = 0.0, 0
        for w in tokens(t):
            c = m.classes[unit(w)]
            want += math.log10((bigrams[before, c] + brown.TRANSITION * prior[c]) / (bigrams[before].sum() + brown.TRANSITION))
            want += math.log10((counts[w] + brown.EMISSION) / (size[c] + brown.EMISSION * (types[c] + 1)))
            before = c
        assert got[doc_id] == pytest.approx(want, rel=1e-9), doc_id


def test_class_model_is_a_distribution(spark):
    """Known words and one unknown a class sum to 1 after any class; held-out texts score better than by unigrams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 20_000)
    got = brown.scored(docs, id_bucket("doc_id", 7) == 2)
    s = got.filter("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert s.m > s.b
    counts = brown.word_counts(docs)
    m = brown.fit(docs, counts)
    assert (10**m.log_transition).sum(axis=1) == pytest.approx(1, abs=1e-6)


def plain_matches(text, item, k=5):
    words, own = ((x or "").encode().lower().split() for x in (text, item))
    bag = lambda ws: Counter(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1)))
    best = 0
    for i in range(max(1, len(words) - len(own) + 1) if words else 0):
        if own:
            a, b = bag(words[i : i + len(own)]), bag(own)
            best = max(best, (a & b).total() / (a | b).total())
    return best


def test_decontamination_against_all_windows(spark):
    rng = random.Random(4)
    items = [prose(100 + i, rng.choice([3, 5, 9, 30, 60])) for i in range(12)] + ["", None]
    docs = [(i, t, "en", "s", 1, 1, 1, "", "") for i, t in enumerate(["", None, "short"])]
    for i in range(60):
        words = rng.choice(items[:12]).split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) - 2 if len(words) > 3 else 1)
            words[at : at + 1] = rng.choice([["changed"], [], [words[at], "put"]])
        docs.append((10 + i, f"{prose(i, 20)}\n{' '.join(words).upper()} {prose(i + 99, 9)}", "en", "s", 1, 1, 1, "", ""))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.report(documents(spark, docs), bench).collect()}
    assert got == {d[0]: {i for i, item in enumerate(items) if plain_matches(d[1], item) >= 0.8} for d in docs}
    clean = decontaminate.keep_clean(documents(spark, docs), bench)
    assert clean.columns == documents(spark).columns and {r.doc_id for r in clean.collect()} == {d for d, m in got.items() if not m}
    assert decontaminate.keep_clean(documents(spark), bench.limit(0)).count() == len(rows())


@pytest.mark.parametrize("part", [2000, 3])
def test_benchmark_ids_of_any_kind(spark, part):
    """Null and text ids count; a text shorter than its item is compared as a whole; parts find what one part finds."""
    items = [(None, prose(1, 50)), ("b", prose(2, 60)), ("a", prose(2, 60)), ("c", prose(3, 7)), (None, None), ("d", ""), ("e", prose(5, 40)), ("f", prose(6, 30))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = documents(spark, [(i, t, *[None] * 7) for i, t in enumerate([f"x {prose(1, 50)} y", prose(2, 60), " ".join(prose(5, 40).split()[:38]), " ".join(prose(6, 30).split()[:20]), "", None])])
    got = {r.row.doc_id: sorted((m.item or "", round(m.similarity, 3)) for m in r.found) for r in decontaminate.matched(docs, bench, part=part).collect()}
    assert got == {0: [("", 1.0)], 1: [("a", 1.0), ("b", 1.0)], 2: [("e", round(34 / 36, 3))], 3: [], 4: [], 5: []}
    best = {r.doc_id: r.best_item for r in decontaminate.report(docs, bench).collect()}
    assert best == {0: None, 1: "a", 2: "e", 3: None, 4: None, 5: None}


def test_blocks_list_few_unrelated_items_and_all_within_their_radius():
    import numpy as np

    rng = np.random.default_rng(5)
    hashes = [rng.integers(0, 2**64, 40, np.uint64) for _ in range(300)]
    index = decontaminate.Index(44, list(range(300)), hashes)
    _, item = index.listed(rng.integers(0, 2**16, (500, decontaminate.BLOCKS)).astype(np.uint16))
    assert len(item) / (500 * 300) < 0.05
    for bits in (1, 20, 35):
        prints = index.prints.copy()
        for row in prints:
            for b in rng.choice(decontaminate.BITS, bits, replace=False):
                row[b // 16] ^= np.uint16(1 << int(b % 16))
        assert {(i, i) for i in range(300)} <= set(zip(*(x.tolist() for x in index.candidates(prints)), strict=True))
    # windows that share 36 of 40 shingles with an item: similarity 36 / 44
    near = np.concatenate([decontaminate.majority(decontaminate.spread(np.r_[h[:36], rng.integers(0, 2**64, 4, np.uint64)]).sum(axis=0, dtype=np.int64)[None, :], 40) for h in hashes])
    found = set(zip(*(x.tolist() for x in index.candidates(near)), strict=True))
    assert sum((i, i) in found for i in range(300)) >= 297


ARTICLE = "<article><header><h1>T &amp; x</h1></header><p>one\n two<br>three<div class='share'>no</div><p>four<aside>no</aside><section id=comments>no</section></article>"
PAGES = [
    ("http://a.b/1", f"<html><head><title>no</title></head><body><nav>no</nav><div class='ad'>no</div>{ARTICLE}<footer>no</footer><script>var t='</p>'</script>", "T & x\none two three\nfour"),
    ("http://a.b/2", None, ""), ("http://a.b/3", "", ""), (None, "plain &#x41;&nbsp;text", "plain A text"), ("http://a.b/4", "<p>open <b>bo</b>ld</p><!-- no --><form>no</form>tail", "open bold\ntail"),
]


def test_pages(spark):
    same = "<div>please read this notice about our site and its many rules</div>"
    open_pages = [(f"http://h/{i}", f"<p>{prose(i, 30)}</p>{same}", prose(i, 30)) for i in range(5)]
    all_pages = [*PAGES, *open_pages, ("http://other/1", same, "please read this notice about our site and its many rules")]
    df = spark.createDataFrame([(i if i else None, u, h, 1, "x", "y") for i, (u, h, _) in enumerate(all_pages)], "page_id long, url string, html string, rid long, text string, hits string")
    got = htmlmain.extract(df).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter((i if i else None, u, t, len(t)) for i, (u, _, t) in enumerate(all_pages))
    assert htmlmain.extract(df.limit(0)).count() == 0


def repeated_by_suffix_array(streams, run, needed):
    """Which tokens of each stream lie in substrings of at least run tokens that as many distinct streams hold: by a sorted suffix array."""
    suffixes = sorted((tuple(s[i:]), k, i) for k, s in enumerate(streams) for i in range(len(s)))
    lcp = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    hit = [[False] * len(s) for s in streams]
    for at, (suffix, k, i) in enumerate(suffixes):
        longest = 0
        # the best group around this suffix: spread to both sides, always to the nearer one
        low, high, depth, pages = at, at, len(suffix), {k}
        while True:
            if len(pages) >= needed:
                longest = depth
                break
            left = min(depth, lcp(suffixes[low - 1][0], suffix)) if low else -1
            right = min(depth, lcp(suffixes[high + 1][0], suffix)) if high + 1 < len(suffixes) else -1
            depth = max(left, right)
            if depth < run:
                break
            low, high = (low - 1, high) if left >= right else (low, high + 1)
            pages.add(suffixes[low if left >= right else high][1])
        if longest >= run:
            hit[k][i : i + longest] = [True] * longest
    return hit


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_a_host_against_a_suffix_array(spark, seed):
    rng = random.Random(seed)
    shared = [prose(50 + i, rng.randrange(6, 30)) for i in range(4)]
    pages = [[rng.choice(shared) if rng.random() < 0.5 else prose(1000 * seed + 10 * p + b, rng.randrange(4, 25)) for b in range(5)] for p in range(8)]
    pages.append(list(pages[0]))  # a copy counts once
    df = spark.createDataFrame([(i, "http://h/x", "".join(f"<p>{b}</p>" for b in p)) for i, p in enumerate(pages)], "page_id long, url string, html string")
    distinct = [[w for b in p for w in b.split()] for p in {tuple(p): p for p in pages}.values()]
    hit = repeated_by_suffix_array(distinct, 8, 3)
    want = {}
    for i, p in enumerate(pages):
        marks, at, kept = hit[distinct.index([w for b in p for w in b.split()])], 0, []
        for b in p:
            n = len(b.split())
            if sum(marks[at : at + n]) < 0.7 * n:
                kept.append(b)
            at += n
        want[i] = "\n".join(kept)
    got = {r.page_id: r.text for r in htmlmain.extract(df, min_pages=3, share=0.1).collect()}
    assert got == want and len(set(want.values())) > 1


def test_broken_markup_takes_time_in_proportion():
    import time

    for broken in ("<a b ", '<a "', "<!x", "<div>", "<div></b>", "<a '\"", "<"):
        started = time.process_time()
        htmlmain.blocks(broken * 60_000)
        assert time.process_time() - started < 5, broken


def stored_folders(spark):
    import os

    return set(os.listdir(spark.conf.get("spark.checkpoint.dir")))


def test_pipeline_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF).cache()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {r.doc_id for r in seen[-1].collect()}
        seen.append(out)
    good, alone, clean, hidden, packed = seen[1:]
    assert 0 < clean.count() <= alone.count() <= good.count() < docs.count() and hidden.count() == clean.count()
    own = alone.select(simhash.fingerprint_of().alias("fp")).collect()
    prints = [r.fp % 2**64 for r in own]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert secretscan.digest(hidden).filter("n_assign + n_access + n_hex > 0").count() == 0
    before = stored_folders(spark)
    ran = corpus_pipeline.run(spark, SF)
    assert [x for x in stored_folders(spark) - before if x.startswith("table-")] == []
    key = lambda df: Counter(tuple(r) for r in df.select("doc_id", "piece", "length", "ids_crc32").collect())
    assert key(ran) == key(packed)


def test_pipeline_takes_odd_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0, name
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    assert all(stage(spark, documents(spark, []), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
