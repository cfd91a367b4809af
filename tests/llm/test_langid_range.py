"""Probabilities far below a double's range."""

import numpy as np
import pytest
from ripplecast.llm import langid


@pytest.mark.parametrize("letters", [30, 38, 40, 41, 300])
def test_unseen_word_in_a_known_text(spark, letters):
    pieces = [langid.MARK, "▁alpha", "▁bravo"]
    n = np.full((4, 2), langid.SMOOTHING)
    n[2, 1] = n[3, 0] = 1e10
    model = langid.Model(pieces, ["de", "en"], langid.pieces_with_zero(n / n.sum(axis=0)), [])
    docs = spark.createDataFrame([("alpha " * 50 + "漢" * letters,), ("漢" * letters + " bravo" * 50,)], "text string")
    got = docs.select(langid.predicted(model).alias("p")).select("p.*").collect()
    assert [r.lang_pred for r in got] == ["en", "de"] and all(r.score == pytest.approx(1) for r in got)
    word = langid.MARK + "漢" * letters
    assert langid.Lattice(pieces).score([word], model.p)[0] == pytest.approx((letters + 1) * np.log(n[0] / n.sum(axis=0)))
