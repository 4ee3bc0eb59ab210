"""Rows with everything that goes wrong."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "node long, text_key string, row long, score string, place int, key binary, _row int, _id int, _gone int")
LABELS = "doc_id long, quality int, toxic int, text string"
ITEMS = "item_id long, text string, items int"


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "of", "an", "er", "ing", "tion", "ö", "ñá", "re", "st", "ly", "Ou"]
    out = []
    for i in range(words):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
        out.append(word + ("." if i % 9 == 8 else "") + ("\n" if i % 23 == 22 else " "))
    return "".join(out).strip()


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.random()}"
    return " ".join(words)


def corpus_rows() -> list[tuple]:
    rng = random.Random(5)
    base = [prose(rng, n) for n in (120, 200, 80, 300, 40, 25)]
    texts: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    texts += [(100 + i, edited(rng, base[1], k)) for i, k in enumerate((1, 3, 4, 5, 9, 30))]
    texts += [(200 + i, base[0]) for i in range(40)]  # copies: a third of all rows
    texts += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one"), (305, "two words")]
    texts += [(5, base[5]), (5, base[5]), (5, base[4]), (None, base[2]), (None, "no id, but words enough to see")]
    texts += [(400, "again and again and " * 60), (401, "again and again and " * 59), (402, "x" * 5000)]
    texts += [(403, "\n".join([base[3].split("\n")[0]] * 3 + [prose(rng, 30)])), (404, prose(rng, 6000))]
    texts += [(405, base[3].replace(".", "!", 2)), (406, "SHOUT!! " * 30), (407, "a | b | c | " * 20)]
    return [(i, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, len(t) if t else None,
             k, str(k), k, "s", 1, b"k", 7, 8, 9) for k, (i, t) in enumerate(texts)]
