"""Small tables with the awkward cases that every operator meets: nulls, empty and long texts, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket int, score double, keep string"


def awkward(seed: int = 5, words=("a", "b", "é", "cc", "don't")) -> list[tuple]:
    rnd = random.Random(seed)

    def text(n):
        return " ".join(rnd.choice(words) for _ in range(n))
    texts = [text(rnd.randrange(0, 60)) for _ in range(50)]
    texts += [None, "", " ", "\n\t", "a " * 400, " a\n" * 150, text(3000), "x" * 5000, "漢" * 300, "á <|endoftext|> b"]
    texts += [texts[5], texts[7] + " " + texts[9], (texts[9] + texts[8])[20:] + "x " + texts[3]]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[4]), (None, texts[4]), (None, None), (None, "a" * 100)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 7, 9, 0.5, "x") for i, t in rows], SCHEMA)


def key(i):
    """An id with null as larger than every other."""
    return 2**62 if i is None else i
