import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in zip(ids, texts, langs)], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def noise(n, seed=1):
    rnd = random.Random(seed)
    letters = [*"abcdeiostrnlTHE  \n\n\t'.,;-_0123456789éèçñ×÷œßÅ—’  世界😀ªº²½\x1c\x85", "'s", "'ll", " the", " of", "  ", "\r\n", "é"]
    return ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(n)]


#: Cases that every operator must take.
ODD = [None, "", " ", "\n", "a", "ab ab", "x" * 30_000, "word " * 9_000, "same text here, in two rows", "same text here, in two rows"]
