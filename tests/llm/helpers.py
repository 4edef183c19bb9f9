"""Rows that every operator must take, and small reference versions."""

import re
from collections import defaultdict

LONG = "lorem ipsum dolor " * 20000
DOCS = [(1, "The cat sat on the mat. The end", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "en", "b", 9), (5, "The cat sat on the mat. The end", "en", "a", 5), (5, "The cat sat on the mat. The end", "en", "a", 5),
        (None, "no id here", "en", "c", 3), (7, "one", "de", "", 1), (8, " \t\n ", "en", "a", 2), (9, "über Größe naïve 你好 🙂 end.", "de", None, 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "score double, held_out boolean, parts string, rid long, bucket int, size long, part int, length long, code long, label string, kind string"


def docs(spark, clash=False, empty=False):
    df = spark.createDataFrame([] if empty else DOCS, SCHEMA)
    if clash:
        df = df.selectExpr("*", *(f"cast(null as {t.split()[1]}) as {t.split()[0]}" for t in CLASH.split(", ")))
    return df


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def groups(n, linked):
    """Sets of indices connected by pairs for which linked(i, j)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(n):
        out[find(i)].append(i)
    return list(out.values())
