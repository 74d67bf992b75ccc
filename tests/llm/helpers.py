"""Tables with everything odd in them, and plain Python versions of the contracts."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, _spans int, component_id long, `a.b` string"


def odd_docs(spark):
    long_line = "word%d " * 40
    rows = [
        (1, None, None, "s", None),
        (2, "", "en", None, 0),
        (3, "same text here for two of them\nand Another Line of it\r\n\tand Another Line of it", "en", "s", 10),
        (4, "same text here for two of them\nand another line of it", "en", "s", 10),
        (4, "same text here for two of them\nand another line of it", "en", "s", 10),
        (5, "x" * 3000, "en", "s", 3000),
        (6, "é ß 漢字 🎉 ▁  \u0001", "fr", "s", 5),
        (7, " ".join(long_line % tuple(range(i, i + 40)) for i in range(60)), "en", "s", 1),
        (8, " ".join(long_line % tuple(range(i, i + 40)) for i in range(60)) + " end", "en", "s", 1),
        (None, "a row without an id but with words", "en", "s", 1),
        (9, "mail a.b@mail1.example.com or +1 (543) 555-9258, 42.144.35.254; 4709559030084884 4709559030084884.", "en", "s", 1),
    ]
    rows = [(i, t, lang, source, n, "row", 7, -1, "dot") for i, t, lang, source, n in rows]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", ascii_lower(text or ""))


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def generated(spark, n=60, seed=3):
    """Near copies, copies and unlike documents."""
    import random

    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows, base = [], []
    for i in range(n):
        if i % 5 == 0 or not base:
            base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))]
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    return spark.createDataFrame(rows, "doc_id long, text string")
