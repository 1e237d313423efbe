import random

import pytest

EXTRA = "rank int, n int, bands string, rest string"  # names that the operators use inside
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def sentence(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and ids, copies and near copies."""
    rng = random.Random(3)
    base, passage = sentence(rng, 300), sentence(rng, 90)
    words = base.split()
    near = [" ".join(w if rng.random() > 0.01 else "zz" for w in words) for _ in range(4)]
    far = [" ".join(w if rng.random() > 0.06 else sentence(rng, 1) for w in words) for _ in range(6)]
    texts = [base, base, *near, *far, None, "", "   \n\t ", "one", "one two three", "12345 678", "Ünï çödé 漢字 text", "a" * 1500, "ab" * 900, "x " * 700]
    texts += [sentence(rng, 40) + " " + passage + " " + sentence(rng, 30) for _ in range(3)]
    texts += [sentence(rng, 25000), "<|endoftext|> and <|endoftext|>", "two  spaces   and\n\nlines \t end  "]
    texts += [sentence(rng, rng.randint(1, 120)) for _ in range(20)]
    rows = [(k, t, "en" if k % 3 else None, "s", len(t or ""), k, 1, "b", "r") for k, t in enumerate(texts)]
    rows += [rows[0], rows[20], (5, sentence(rng, 50), "en", None, None, None, None, None, None), (None, base, None, None, None, None, None, None, None), (None, None, "de", "s", 0, 0, 0, "", "")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [tuple(r) for r in df.collect()]
