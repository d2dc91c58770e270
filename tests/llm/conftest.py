import random

import pytest

WORDS = {
    "en": "the of and to in is that for was with on as are this be at have from or by one had not but what all were when we there can an your which their said".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas sur faire plus dire me on mon lui nous comme mais pouvoir avec tout".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, p string, component string, row int"


def prose(rng, lang, n):
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n // 2 + 1)]
    return " ".join(rng.choice(WORDS[lang]) if rng.random() < 0.5 else rng.choice(stems) for _ in range(n))


def build():
    """Documents with exact and near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    texts = {}
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        texts[i] = (prose(rng, lang, rng.randint(3, 260)), lang)
    passage = prose(rng, "en", 70)
    for i in range(60, 70):  # near copies: one to four words of 200 changed
        words = (texts[60][0] if i > 60 else prose(rng, "en", 200)).split()
        for _ in range(i - 60 if i < 65 else 12):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        texts[i] = (" ".join(words), "en")
    for i in range(70, 75):  # exact copies but for case and white space
        texts[i] = (texts[7][0].upper().replace(" ", "\t\n" if i % 2 else "  "), "en")
    for i in range(75, 80):  # a passage inside
        texts[i] = (prose(rng, "en", 40) + " " + passage + " " + prose(rng, "en", 40), "en")
    texts[80], texts[81], texts[82], texts[83] = (None, None), ("", "en"), (" \t\n ", "en"), ("one two", "en")
    texts[84], texts[85] = ("one two", "en"), (prose(rng, "en", 9000), "en")
    rows = [(i, t, lang, f"src{i % 3}", len(t or ""), -i, "x", None, 1) for i, (t, lang) in texts.items()]
    return [*rows, rows[5], (None, texts[5][0], "en", None, 3, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return build()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
