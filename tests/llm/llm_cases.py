"""Small tables with the awkward rows that every operator must take."""

import random

SF = "/root/testdata/sf0.001"

WORDS = [a + b for a in "ba de fi go ku lo mi nu pa re si to".split() for b in "lan mer nik tor vus xel".split()]
DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHING = ["score", "size", "key", "line", "kept", "a", "b", "node", "component", "chunk", "shard", "copies", "row", "y", "tokens", "target", "w"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows():
    long = prose(6000, 1)
    same = prose(80, 2)
    near = same.replace(same.split()[40], "changed", 1)
    lines = "\n".join(prose(12, 100 + i) for i in range(6))
    return [
        (1, same, "en", "s1"), (2, same, "en", "s1"), (3, near, "de", "s2"), (4, None, None, None), (5, "", "en", "s1"),
        (6, "   \n\t ", "fr", None), (7, "one two three", "en", "s3"), (8, "one two three", "en", "s3"), (9, long, "en", "s1"),
        (9, long, "en", "s1"), (10, lines, "es", "s2"), (11, lines + "\n" + prose(12, 300), "es", "s2"), (None, same, "en", "s1"),
        (None, None, "en", "s2"), (12, "x" * 30000, "en", "s1"), (13, "ÄÖ 猫 🙂 naïve " * 40, "de", "é"), (14, prose(60, 5) + "\n" + same, "en", "s2"),
        (15, "ABC\r\ndef\x0b\x1c g", "en", "s1"),
    ]


def edge_docs(spark, clashing=True):
    rows = [(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in edge_rows()]
    df = spark.createDataFrame(rows, DOC_COLUMNS)
    if clashing:
        for c in CLASHING:
            df = df.selectExpr("*", f"'clash' AS {c}")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOC_COLUMNS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
