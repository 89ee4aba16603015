import re

import pytest

UPPER = {i: i + 32 for i in range(65, 91)}
ALNUM, SOLID = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
# names that operators use for columns of their own
CLASHING = "n_words n_hit score predicted size place link shard slot node component gram copies target passes cut source_size file ids".split()


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(UPPER))


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empties, one very long text, one very long word, ties, repeats, other alphabets."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    base = " ".join(f"t{i}" for i in range(120))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Two words"), (6, long), (6, long), (7, "a" * 300_000),
        (8, base), (9, base), (9, base), (10, base.replace("t60 ", "other ")), (11, base + " tail"), (None, base), (None, None),
        (12, "É日本語 Ünder THE MIT License, mail a.b@c-d.org or +49 (0)30 1234567"), (13, "x\x00y <|endoftext|> it's  'r\n\n z"),
        (14, base.replace("t10 ", "q ").replace("t50 ", "r ").replace("t90 ", "s ")),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with nulls in other columns and with extra columns whose names clash."""
    rows = [(d, t, None if i % 3 else "en", [None, "b", "a", "é", "b"][i % 5], None, *["x"] * len(CLASHING)) for i, (d, t) in enumerate(odd_rows)]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    """A table without rows."""
    return odd.filter("doc_id < -5")
