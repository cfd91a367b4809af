"""Small documents with every odd case the operators must treat."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, n long, spans string, row string"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


def texts() -> list[str | None]:
    base = prose(1, 120)
    return [
        None, "", " \t\n", "one", "two words", base, base, base.upper(), base + " more", base.replace("alpha", "omega", 1), prose(2, 300), prose(3, 40) + "\n" + prose(3, 40),
        "Ünïcode ß Σίσυφος 漢字 " * 5, "x" * 70_000, prose(4, 30_000), "a b c\x0bd\x0ce", "²½ 123 ___", "🙂 🙃", "tok\u0000en", prose(5, 60),
    ]


def rows(ids=True):
    """The last two rows repeat earlier ones; one id is null."""
    out = [(i if i != 3 else None, t, [None, "en", "de"][i % 3], None if i == 2 else f"s{i % 4}", len(t) if t is not None else None, 1, 2, "x", "y") for i, t in enumerate(texts())]
    return [*out, out[5], out[3]]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3).cache()
