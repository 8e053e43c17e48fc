"""Tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "alpha river stone under seven quiet lantern meadow copper winter garden thunder marble silver canyon ember willow harbor velvet comet".split()


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 9) % len(WORDS)] + chr(97 + (state >> 17) % 26))
    return " ".join(out)


ROWS = [
    (1, prose(1, 120), "en", "a"), (2, prose(2, 80), "en", "a"), (3, prose(1, 120), "en", "b"), (4, None, "en", None), (5, "", None, "a"), (6, " \n\t ", "de", "a"), (7, "x", "fr", "a"),
    (8, prose(3, 9000), "en", "a"), (9, prose(1, 120) + " tail", "de", "a"), (None, prose(4, 60), "en", "a"), (2, prose(2, 80), "en", "a"), (10, "Ünïcode ß 漢字 🎉 don't  stop\r\nnow\x0bthere", "de", None), (11, "a b c", None, "c"), (12, "a b c", None, "c"),
]
