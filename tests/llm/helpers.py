"""Small documents with what real tables hold: nulls, blanks, copies, long texts."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = "the of and to in is that it was for on are as with his they at be this from".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    words = [pick.choice(VOCABULARY) + pick.choice(["", "a", "er", "ing", "x"]) for _ in range(n)]
    return " ".join(words)


def documents() -> list[tuple]:
    """Ids with copies, near copies, shared passages and odd texts."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(2, 30)
    texts = {
        0: base,
        1: base,
        2: " ".join(near),
        3: prose(3, 50) + "\n" + shared,
        4: shared + "\t" + prose(4, 40),
        5: prose(5, 10) + " " + shared + " " + shared,
        6: None,
        7: "",
        8: " \t\n ",
        9: "12 34 56",
        10: "one",
        11: "One",
        12: "two words",
        13: prose(6, 6000),
        14: "  leading  and   double \u2581 marks\u00a0here ",
        15: "Ünïcode ﬁle \u0085 naïve 日本語 \U0001f600 </s>[INST]",
        16: prose(7, 25),
        17: prose(7, 25),
    }
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 2}", len(t or "")) for i, t in texts.items()]
    rows.append((18, prose(8, 30), None, None, None))
    rows.append((None, prose(9, 30), None, None, None))
    rows.append(rows[3])  # a repeated row
    return rows


def frame(spark, rows=None, clash: dict[str, str] | None = None):
    """The documents, with extra columns named like outputs."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    for name, value in (clash or {}).items():
        docs = docs.withColumn(name, F.lit(value))
    return docs
