import random

import pytest
from samples import prose


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and very long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "one"), (3, "two Words"), (4, " \n\t "), (5, "ümläut 漢字 🙂 \x00 end"), (None, "no id at all here"), (None, None)]
    base = prose(rng, 60)
    rows += [(10 + i, base) for i in range(25)]
    for i in range(25):
        words = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
        rows.append((40 + i, " ".join(words)))
    passage = prose(rng, 30, 10_000)
    rows += [(100 + i, prose(rng, rng.randint(0, 40)) + " " + passage + "\n" + prose(rng, rng.randint(0, 20))) for i in range(15)]
    rows += [(200, prose(rng, 30_000)), (201, "z" * 100_000), (202, "repeat me " * 2_000)]
    rows += [(300, "same id"), (300, "same id"), (301, prose(rng, 20)), (301, prose(rng, 20))]
    rows += [(400 + i, "\n".join(prose(rng, 8, 50) for _ in range(5))) for i in range(10)]
    rng.shuffle(rows)
    return rows
