import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, h int, word string"


def make_texts():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "été", "ünder", "中文", "x1", "the", "of", "and", "zeta\n", "eta"]
    text = lambda n: " ".join(r.choice(words) + (str(r.randint(0, 60)) if r.random() < 0.6 else "") for _ in range(n))
    passage, base = text(30), text(120)
    texts = [None, "", " \n ", "word", text(12), text(13), base, base, base + " tail", base.replace("the", "thy", 2), text(400)]
    texts += [text(40) + " " + passage + " " + text(r.randint(0, 40)) for _ in range(8)]
    texts += ["a " * 60, "same same same " * 40, "q" * 3000, text(6000), "a <|endoftext|> b", "\t\x0b\x0c tabs\r\n", "😀 emoji " * 20]
    texts += [
        'password: "hunter2hunter" and token=abc',
        "AKIA" + "ABCDEFGHIJKLMNOP" + " secret = " + "A1b2C3d4E5" * 4,
        "ASIA" + "ABCDEFGHIJKLMNOP" + " near " + "Zz9+/" * 8 + " see https://host.example/a?b=1",
        "Zz9+/" * 8 + " alone " + "w " * 300 + "ASIA" + "ABCDEFGHIJKLMNOP",
        "deadbeef" * 4 + " api-key api_key='zzzzzz' passwd:12345 password: token: abcdefghi",
    ]
    return texts


@pytest.fixture(scope="session")
def rows():
    texts = make_texts()
    out = [(3 * i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "clash", 1, "w") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Rows repeated, and a null id."""
    return spark.createDataFrame([rows[6], rows[6], rows[10], (None, rows[11][1], None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], i % 2 if i % 9 else None, 0) for i, r in enumerate(rows)], "doc_id bigint, quality int, toxic int")
