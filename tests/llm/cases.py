"""Documents with everything that may go wrong, under clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, copy int, n_words long, class long, row long, host string, bin_id string, piece long, x string, often string, label int"
WORDS = [a + b for a in "ka lo mi nu re so ta vi wo xe".split() for b in "bar den fir gol hum jat kel".split()]


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_rows():
    near = prose(1, 80)
    texts = [
        (None, None, None, None), (None, prose(9), "en", "a"), (1, None, "en", "a"), (2, "", "fr", None), (3, " \n\t\x0b ", None, "a"), (4, "one two", "en", "b"), (4, "one two", "en", "b"), (4, "other text", "en", "b"),
        (5, near, "en", "a"), (6, near, "en", "a"), (7, near + " extra", "de", "c"), (8, near.upper(), "en", "a"), (9, "!!! ??? 12 ...", "en", "a"), (10, "x" * 200_000, "en", "a"), (11, prose(2, 30_000), "en", "a"),
        (12, "a\0b <|endoftext|> \U0001F600 日本語    é ퟿ \U000e0001", "ja", "a"), (13, "line\n" * 500, "en", "a"), (14, "<|assistant|> It's 'quoted' <|end|>", "en", "a"),
    ]
    texts += [(20, "same row again and again and so on", "en", "hot")] * 40
    texts += [(100 + i, prose(100 + i), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(30)]
    return [(i, t, lang, s, len(t) if t else None, 0.5, "h", 7, 1, 2, 3, "z", "b", 4, "x", "y", 1) for i, t, lang, s in texts]


def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark, rows):
    """(doc_id, text, source) rows as documents."""
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
