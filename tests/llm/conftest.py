import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A small corpus with every awkward case: nulls, empty and long texts, repeated rows and ids, a clashing column."""
    import numpy as np

    rng = np.random.default_rng(4)
    vocab = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    base = [say(rng.integers(20, 90)) for _ in range(40)]
    passage = say(60)
    rows = []
    for k, text in enumerate(base):
        rows.append((k, text, "en", "a"))
        words = text.split()
        if k % 3 == 0:  # near copy
            words[int(rng.integers(len(words)))] = "changed"
            rows.append((100 + k, " ".join(words), "en", "b"))
        if k % 5 == 0:  # exact copy, other case
            rows.append((200 + k, text.upper(), "fr", "a"))
        if k % 7 == 0:
            rows.append((300 + k, say(10) + " " + passage + " " + say(15), "de", None))
    rows += [(400, None, "en", "a"), (401, "", None, "a"), (402, "  \n\t ", "en", None), (403, "one two three", "en", "c"), (404, "one TWO three", "en", "c"), (405, "x" * 700, "en", "c"), (406, say(6000), "en", "c"),
             (407, "über <|endoftext|> Straße 漢字 " * 12, "de", "c"), (408, "über <|endoftext|> Straße 漢字 " * 12, "de", "c"), (409, "... !!! 123", "en", "c"), (None, base[0], "en", "a"), (0, base[0], "en", "a"), (410, "dup row", None, "c"), (410, "dup row", None, "c")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n int")
