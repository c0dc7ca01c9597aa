import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n):
    syllables = "an er th on in re at nd st en le ti sh wh".split()
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, shared passages, and extra columns with names used inside."""
    r = random.Random(5)
    passage, plain = prose(r, 60), prose(r, 80)
    texts = [
        (1, plain), (2, plain), (3, plain + " more"), (4, None), (5, ""), (6, "  \n\t "), (7, "one two three"),
        (8, prose(r, 30) + " " + passage + " " + prose(r, 20)), (9, passage + "\n" + prose(r, 50)), (10, prose(r, 9000)),
        (None, "a null id has words as well"), (None, None), (12, prose(r, 50)), (12, prose(r, 50)), (13, prose(r, 60)),
        (14, "the " * 200), (15, "\u00e9\u00e8 \U0001f600 ß İ Ünï\u0301"), (16, "<|endoftext|> it's 42"), (17, passage + " " + passage),
    ]
    rows = [(i, t, None if i == 3 else "en", "src0", len(t) if t else None, 0.5, "x", 1, "k") for i, t in texts]
    rows.append(rows[-3])  # a repeated row
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp int, row string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text):
    return WORD.findall(text or "")
