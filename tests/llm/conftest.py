import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=120, seed=1):
    """Texts with exact and near copies, white-space variants, shared passages, junk, nulls, repeated rows and ids, and one very long text."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    make = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, base = make(70), make(90).split(" ")
    out = []
    for i in range(n):
        kind = i % 12
        if kind < 4:
            t = make(r.randint(1, 160))
        elif kind == 4:
            t = make(r.randint(0, 30)) + "\n" + passage + "\n" + make(r.randint(0, 30))
        elif kind == 5:
            t = passage
        elif kind in (6, 7, 8):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif kind == 9:
            t = "\t".join(base) + "  " * r.randint(0, 2)
        elif kind == 10:
            t = r.choice(["", " \n ", "a", "A b", "a B", "x x x " * 30, "one two three"])
        else:
            t = " ".join(make(3).upper() + "!!" for _ in range(20))
        out.append((i, t))
    out += [(None, "null id text"), (None, passage), (7, None), (8, out[8][1]), (8, out[8][1]), (9, "another row of nine"), (5000, " ".join(make(40) for _ in range(400)))]
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    # extra columns with the names that operators use inside
    for c in ("row", "node", "owner", "key", "group", "start", "n", "label", "score"):
        df = df.withColumn(c, df.doc_id)
    return df.repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
