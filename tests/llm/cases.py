"""Awkward documents, alike for all operators."""

import random

WORDS = "the of and ink stone river lamp door cold seven green walk under paper light salt Über naïve grün año 東京 x1 42 end".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text): null and empty texts, null ids, copies, near copies, repeated rows, a very long text, odd white space."""
    passage = prose(1, 60)
    rows = [(i, prose(100 + i, 20 + i)) for i in range(20)]
    rows += [(30, None), (31, ""), (32, "   \t\n "), (None, prose(5, 40)), (None, None)]
    rows += [(40, prose(103, 23)), (41, prose(103, 23)), (41, prose(103, 23)), (42, prose(103, 23) + " ")]
    rows += [(50, prose(7, 30) + " " + passage), (51, passage + " " + prose(8, 30)), (52, "a\u00a0b\x0bc\rd " + passage.upper())]
    rows += [(60, prose(9, 20000)), (61, "x" * 50000), (62, "one"), (63, "one"), (64, "!!! ??? ...")]
    return rows


def frame(spark, rows=None):
    """Documents with further columns whose names operators use inside."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(i, t, "c", 1, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, chunk string, fingerprint int, slice int").repartition(3)


def key(row) -> tuple:
    return tuple((x is None, str(x)) for x in row)
