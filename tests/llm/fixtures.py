"""Small awkward inputs shared by the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_W = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def sentence(seed, n):
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(_W[(x >> 8) % len(_W)])
    return " ".join(out)


PASSAGE = "this very passage is shared by several of the documents and has rather more than fifty bytes in it"


def documents():
    """(doc_id, text) with nulls, empty and long texts, copies, repeated rows and odd characters."""
    rows = [
        (1, sentence(1, 60)),
        (2, None),
        (3, ""),
        (4, "x"),
        (5, "é" * 70 + " naïve 東京 \U0001f600 text"),
        (6, sentence(6, 40) + PASSAGE + sentence(66, 40)),
        (7, sentence(7, 10) + PASSAGE + "é" + sentence(77, 30)),
        (8, sentence(8, 3) + PASSAGE[3:] + PASSAGE[:70]),
        (9, sentence(1, 60)),
        (9, sentence(1, 60)),
        (9, "another text under the same number"),
        (None, sentence(8, 50)),
        (12, "\t\n  \r\n "),
        (13, sentence(13, 9000)),
        (14, sentence(13, 9000)[4000:20000]),
        (15, "<|endoftext|>x<|im_end|><\\|im_start|>\\n"),
        (-3, sentence(3, 25)),
        (20, "a" * 600),
        (21, "b" * 20 + "a" * 400),
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)


SF = "/root/testdata/sf0.001"
