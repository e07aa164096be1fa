"""Documents with the awkward cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, name string"

A = "the cat sat on the mat and looked at the dog in the yard all day long until the night came down"
B = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def rows():
    texts = [
        (0, A), (1, A.replace(" ", "  ")), (2, A + " ."), (3, None), (4, ""), (5, " \n\t "), (6, B), (7, B.upper()), (8, "short"),
        (9, "x " * 30_000), (10, "😀 mail me@x.org or +1 (058) 555-3468, card 4111 1111 1111 1111, ip 10.0.0.1 😀"), (11, B), (12, "é" * 5000), (13, "<|endoftext|> a"),
        (None, "no id here"), (14, "You idiot, you are worthless"), (14, "You idiot, you are worthless"),
    ]
    return [(i, t, "en" if i != 12 else None, "src0", None if t is None else len(t), 0.5, "x") for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
