"""Hard rows that the operators are tested on."""

import random

WORDS = ["the", "of", "and", "Reed", "stone", "river", "Ästhetik", "élan", "x1", "blue", "cart", "lamp", "moss", "tide", "quill", "42"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + (draw.choice("abcdefgh") * 2 if draw.random() < 0.7 else "") for _ in range(n))


def hard_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, repeated rows, copies, shared passages."""
    base, passage = prose(1, 300), prose(2, 120)
    changed = base.split(" ")
    changed[40] = "changed"
    rows = [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, " \n\t ", "en", "b"),
        (3, "word", "de", "a"),
        (4, "two words", "en", None),
        (5, "two words", "en", "b"),
        (6, base, "en", "a"),
        (7, base, "en", "a"),
        (8, " ".join(changed), "en", "b"),
        (9, base.upper(), "en", "c"),
        (10, prose(3, 100) + " " + passage + " " + prose(4, 100), "de", "c"),
        (11, prose(5, 90) + " " + passage + " " + prose(6, 50), "de", "c"),
        (12, passage, None, "c"),
        (13, "ab " * 400, "fr", "a"),
        (14, "1234 !!! ### 5678", "fr", "a"),
        (15, prose(7, 40_000), "fr", "d"),
        (16, "null\x00byte " + passage[:450] + "\x00\x00", "en", "d"),
        (None, "no id at all", "en", None),
        (None, "no id at all", "en", None),
        (6, base, "en", "a"),
        (7, prose(8, 50), "en", "a"),
    ]
    return rows + [(100 + i, prose(50 + i, 60), "en", "e") for i in range(20)]
