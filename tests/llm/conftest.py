import random

import pytest

from wicketworks.llm.common import ready


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared lines and passages, long, short, empty and null ones."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    line, passage = sentence(12), " ".join(sentence(12) for _ in range(8))
    texts = ["\n".join(" ".join(sentence(rng.randint(4, 12)) for _ in range(4)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts += [t + "\n" + line for t in texts[:8]] + [t[:50] + passage + t[50:] for t in texts[8:20]]
    for t in texts[20:30]:  # chains of near copies
        for _ in range(4):
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
            texts.append(t)
    texts += [texts[3], texts[3], "", None, "   \n ", "!!! 123", "one two", "one two", texts[5].upper(), texts[30] * 40, "ab " * 3000]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(llm, corpus):
    rows = [(*r, i, "x") for i, r in enumerate(corpus)]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3)
