import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, band long, y int, target string, keys string, z string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones; rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, 1, 2, 3, "t", "k", "z") for i, t in rows], SCHEMA)


def odd_rows():
    """Null, empty, blank, very long and repeated texts, a null doc_id and a repeated row."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "naïve", "x1", "#tag", "it's", "don't", "ZETA", "中文", "🙂"]
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(60_000))
    base = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(80))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, base), (6, base), (7, base + " tail word"), (8, "two words"), (9, "two words"), (10, "a" * 400), (11, "line one\nline one\nother"), (12, "  lead  double   spaces \n x  y\x1c z ")]
    rows += [(None, base), (13, "solo text here that is its own"), (13, "solo text here that is its own")]
    return rows
