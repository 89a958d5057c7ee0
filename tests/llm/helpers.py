"""Texts for edge cases, and a table with them."""

import random

ODD = [None, "", "   \n\t ", "!!", "a", "ÄÖ 日本語 한글 😀", "x" * 5000, "Tie tie tie.\nTie tie tie.", "Tie tie tie.\nTie tie tie."]


def prose(seed: int, n: int, words: str = "the of and river stone light under morning walked slowly toward house with great care while birds sang above quiet fields") -> str:
    rng, pool = random.Random(seed), words.split()
    return " ".join(rng.choice(pool) + rng.choice(["", "", "", "s", "ing", ","]) + (str(rng.randint(0, 99)) if rng.random() < 0.1 else "") for _ in range(n))


def table(spark, texts, **extra):
    """documents with clashing extra columns; ids from 0, a null id and a repeated row at the end."""
    rows = [(i, t, "en", "s", 0, "own", 1.5) for i, t in enumerate(texts)] + [(None, "No id here.", "en", "s", 0, "own", 1.5), (0, texts[0], "en", "s", 0, "own", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double")
