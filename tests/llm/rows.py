"""Small tables with every odd case that the operators have to take."""

import random

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "n_words", "kept", "component_id", "_of", "_gone", "rank", "class_id"]
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, "
    "component_id string, _of string, _gone string, rank string, class_id string"
)


def prose(seed: int, words: int, stock: int = 400) -> str:
    draw = random.Random(seed)
    names = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 7))) for _ in range(stock)]
    return " ".join(draw.choice(names) for _ in range(words))


def odd_documents() -> list[tuple]:
    """Nulls in each column, empty and blank texts, a very long one, repeated rows, copies and near copies."""
    base = prose(1, 120).split()
    near = base[:60] + ["changed"] + base[61:]
    texts = [
        (1, " ".join(base), "en", "a"), (1, " ".join(base), "en", "a"), (2, None, "en", "a"), (None, " ".join(base), "en", "a"),
        (3, "", "de", "b"), (4, " \n\t ", None, "b"), (5, prose(5, 30_000), "en", None), (6, " ".join(near), "en", "a"),
        (7, " ".join(base).upper(), "en", "a"), (8, "one two three", "en", "c"), (9, "ONE two  three", "en", "c"), (10, "x", "en", "c"),
        (None, None, None, None), (11, "ünïcödé " * 80 + "ᲀ İ Σ end", "xx", "d"), (12, "a\x1cb   c d <|endoftext|> e", "en", "d"),
        (13, "&&& $$$ " * 90, "en", "a"), (14, "line one here\n" * 40, "en", "a"),
    ]
    for i in range(40):
        texts.append((100 + i, prose(100 + i, 60 + 7 * i), "en", "a" if i % 3 else "b"))
    return [(i, t, lang, source, len(t or ""), "w", "k", "c", "o", "g", "r", "i") for i, t, lang, source in texts]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
