import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, class string, h long, block2 int, ids string, rank double"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ra", "li", "no", "ve", "du", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def document(i, text, source="s0"):
    return (i, text, "en", source, None if text is None else len(text), "k", "c", 1, 2, "x", 0.5)


@pytest.fixture(scope="session")
def dirty(spark):
    """Nulls, empty, blank and very long texts, near and exact copies, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 8, 40, 120, 300)]
    rows = [document(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i, t in enumerate(base[2:]):
        words = t.split()
        for k in range(6):
            changed = list(words)
            for j in range(k * len(words) // 60):
                changed[(7 * j + k) % len(words)] = "zz" + str(k)
            rows.append(document(100 + 10 * i + k, " ".join(changed), None if k == 1 else "s1"))
    rows += [document(200, base[3].upper().replace(" ", "\t ")), document(200, base[3]), document(200, base[3])]
    rows += [document(300, None), document(301, ""), document(302, " \n\t "), document(None, base[3]), document(None, None), document(-7, "é " * 20 + "日本 ▁x <|endoftext|> \0 ok")]
    rows.append(document(400, sentence(rng, 30000)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
