import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, shard int, fp string, n string, copies string, block string, token_ids string, fingerprint string, _row string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Values of the extra columns, whose names the operators use themselves.
EXTRA = ("size!", "h!", 77, "fp!", "n!", "copies!", "block!", "ids!", "print!", "row!")

SYLLABLES = {
    "en": "the of and th er on an re he in ed nd ha at en es or nt ea ti",
    "de": "der die und sch ein ich en zu ge be auf mit ung ver ach ä ö ü ß ie",
    "fr": "le la de et que les des qu ou é è à ait eau oi ent tion un une ç",
    "es": "el la de que y los del se por con ñ ción ado í ó as un para ar er",
}


def prose(r, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(words))


def documents():
    """Small documents with every edge case: nulls, blanks, copies, near copies, one long text, repeated rows."""
    r = random.Random(1)
    rows = []
    for i in range(160):
        lang = r.choice(list(SYLLABLES))
        rows.append([i, prose(r, lang, r.randint(20, 120)), lang, r.choice(["src1", "src2", "src3", "SRC", "é", None])])
    for i, source in ((160, 3), (161, 3), (162, 10)):
        rows.append([i, rows[source][1], rows[source][2], "src1"])
    rows.append([163, rows[20][1] + " tail", "en", "src2"])
    rows += [[164, None, "en", "src1"], [165, "", "en", "src1"], [166, " \n\t ", None, None], [167, None, None, None], [168, "one two", "en", "src3"], [169, "12345 67890 !!", "en", "src2"]]
    rows.append([170, prose(r, "de", 30_000), "de", "src3"])
    rows.append([171, "日本語 テキスト 😀 " * 30 + "𝒳 café naïve", None, "src3"])
    rows.append([None, prose(r, "fr", 40), "fr", "src1"])
    rows.append([None, None, None, None])
    rows.append(list(rows[5]))  # a repeated row
    rows.append([5, "another text of the same id " * 5, "en", "src2"])
    return [(*row, len(row[1]) if row[1] is not None else None, *EXTRA) for row in rows]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
