"""Plain versions that the operators are held against."""

import random


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def prose(seed, n_words, alphabet="ab cd ef gh ij kl mn op qr st uv wx yz é ß".split()):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(n_words))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, _own string, anchor int, fp string, fits int"


def documents(spark, rows):
    """Rows (doc_id, text) with the other columns of documents, and some whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "f", 2) for i, t in rows], DOCS)


ODD_TEXTS = [None, "", " \n\t", "x", "ab cd", "é" * 700, "a" * 5000, " \x1c\x00 \U0001f44d\U0001f3fd Σας <|endoftext|>it's"]
