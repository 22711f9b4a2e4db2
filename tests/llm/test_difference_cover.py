"""The difference-cover sort against plain sorting and brute force."""

import random
from collections import Counter

import pytest

pytest.importorskip("stillwater.llm.queries")

from stillwater.llm import difference_cover
from stillwater.llm.common import Scratch


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_order_equals_plain_sorting(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 25))) for _ in range(12)] + ["abab" * 6, "abab" * 6, "a"]
    rows = [(s, p, ord(c)) for s, t in enumerate(texts) for p, c in enumerate(t)]
    df = spark.createDataFrame(rows, "seq long, pos int, sym long")
    got = sorted((r.rank, texts[r.seq][r.pos :]) for r in difference_cover.suffix_order(df, Scratch(spark, "t")).collect())
    assert [t for _, t in got] == sorted(t[p:] for t in texts for p in range(len(t)))


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcd ") for _ in range(120))
    texts = [base, base[10:70] + "x" * 30, "y" + base[40:], "z" * 50, "short", ""]
    size = 20
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    want = {(s, i) for s, t in enumerate(texts) for i in range(len(t) - size + 1) if seen[t[i : i + size]] > 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    got = {(r.seq, r.pos) for r in difference_cover.repeated_windows(docs, size, Scratch(spark, "t")).collect()}
    assert got == want
