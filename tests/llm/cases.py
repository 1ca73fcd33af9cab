"""Awkward documents: nulls everywhere, empty and very long texts, copies, near copies, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, row string, set_id string, place int, kind string, value string, m int"
WORDS = ["ab", "bc", "cd", "de", "ef", "fg", "gh", "hi", "über", "été", "日本", "X9", "a-b", "c.d", "0", "zz", "Q", "ok", "no", "yes"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


def documents(seed: int = 0) -> list[tuple]:
    """(doc_id, text, lang, source) rows."""
    passage, line = prose(60, 1001), prose(38, 1002)
    long = prose(30_000, 1003)
    rows = [
        (1, None, None, None),
        (2, "", "en", None),
        (3, " \n\t ", None, "a"),
        (4, long, "en", "b"),
        (5, long + " " + prose(5, 5), "en", "b"),
        (6, "one two three", "en", "a"),
        (7, "One TWO  three", "en", "c"),
        (8, "!!! ... ???", "en", "c"),
        (None, prose(50, 8), "en", "a"),
        (9, prose(50, 9), None, "a"),
        (9, prose(50, 9), None, "a"),  # a repeated row
        (10, "x" * 5000, "en", "a"),
        (11, "\x00\x01 a\x0bb \x0c c\x1fd", "en", "b"),
    ]
    for k in range(20):
        rows.append((100 + k, prose(30 + k, 200 + k), ("en", "de", "fr")[k % 3], "abcd"[k % 4]))
    for k in range(12):  # a family around one text, and what only shares a passage
        words = prose(120, 300).split()
        words[k * 9] = f"new{k}"
        rows.append((200 + k, " ".join(words), "en", "a"))
        rows.append((300 + k, prose(90, 400 + k) + " " + passage + " " + prose(40, 500 + k), "de", "b"))
    for k in range(6):
        rows.append((400 + k, prose(120, 300), "en", "a"))  # exact copies of one text
        rows.append((500 + k, line + " " + prose(20 * k, 600 + k) + " " + line, "fr", None))
    random.Random(seed).shuffle(rows)
    return rows


def frame(spark, rows: list[tuple], partitions: int = 3):
    """With columns that clash with names in use, also with ``text`` itself but for case."""
    wide = [(*r, len(r[1] or ""), 7, 7, "r", "s", 7, "k", "v", 7) for r in rows]
    out = spark.createDataFrame(wide, SCHEMA).repartition(partitions)
    return out.toDF(*["Text" if c == "value" else "DOC_ID" if c == "m" else c for c in out.columns])


def empty(spark):
    return frame(spark, [])
