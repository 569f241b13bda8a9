"""Small tables with every awkward case: null, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, "
          "fp string, score string, bucket string, word string, kept string, c string, n_words string")


def sentence(rng, n):
    return " ".join("".join(rng.choice(["an", "ther", "on", "ing", "eau", "sch", "ción", "re"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def rows(count=60, seed=1):
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(count)]
    for i in range(0, count, 7):
        texts[i] = texts[i][: len(texts[i]) // 2] + " " + passage + " " + texts[i][len(texts[i]) // 2:]
    for i in range(1, count, 9):
        texts[i] = texts[0]
    for i in range(2, count, 11):
        words = texts[3].split()
        words[len(words) // 2] = f"changed{i}"
        texts[i] = " ".join(words)
    texts += [None, "", " \n\t ", "x", "aaaa" * 60, "aaaa" * 60, "漢字 🙂 é" * 30, sentence(rng, 4_000), "The the THE"]
    return list(enumerate(texts))


def frame(spark, pairs):
    clash = ("clash",) * 7
    return spark.createDataFrame([(i, t, ["en", "de", None][(i or 0) % 3], "src", 0, *clash) for i, t in pairs], SCHEMA)
