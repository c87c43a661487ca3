"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("key long, length long, rank long, cell long, root long, node long, count long, value string, "
         "run int, words array<string>, ids string, score string, u long, v long, label int, first long")


def words(n, seed, stock=400):
    rng = random.Random(seed)
    return " ".join(rng.choice("aeiou") + f"w{rng.randrange(stock)}" + rng.choice(["", "", ".", ",", "!"])
                    for _ in range(n))


def texts():
    base, shared = words(300, 1), words(80, 2)
    rows = [
        None, "", " \t\n\x0b ", "one", "two words", base, base, base + " tail",
        base.replace("aw", "bw", 2), words(60, 3) + "\n" + shared + "\n" + words(70, 4),
        words(90, 5) + " " + shared, shared, "A b C d İ ΣΑΣ don't 'S <|endoftext|> \x1c x",
        "中文字" * 40, "ab1" * 50, "\U0001f642 café café " * 9, "x" * 3000,
        words(9000, 6, 5000), "line one here\nline one here\n\nline two\nline one here", "same " * 400,
    ]
    return list(enumerate(rows, 1)) + [(6, base), (None, "no key " + words(60, 7)), (None, None)]


def table(spark, rows=None):
    full = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if t is None else len(t))
            for i, t in (texts() if rows is None else rows)]
    return spark.createDataFrame(full, SCHEMA)


def clashing(spark, docs):
    """The same rows with more columns, named like what operators make."""
    return docs.selectExpr("*", *[f"cast(null as {f.split(' ')[1]}) {f.split(' ')[0]}" for f in EXTRA.split(", ")])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def repeated_keys():
    """Keys that several rows share, with equal and with different texts of equal length."""
    a, b, c = words(60, 21), words(60, 22), words(60, 23)
    size = min(map(len, (a, b, c)))
    a, b, c = a[:size], b[:size], c[:size]
    return [(1, a), (5, a), (5, b), (7, a), (7, a), (9, b), (9, c), (9, c), (None, a), (11, None), (11, "")]
