import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, fp string, score string, kept string"


def rows(seed=3, n=60):
    """Documents of two made-up languages with copies, near copies, nulls, an empty and a very long text, and repeated rows."""
    r = random.Random(seed)
    words = {"xx": ["bado", "kelu", "mira", "tosu", "venna", "quor"], "yy": ["zhyn", "wroth", "ghule", "fyrd", "thwaek", "skaeg"]}
    out = []
    for i in range(n):
        lang = r.choice(["xx", "yy"])
        out.append((i, " ".join(r.choice(words[lang]) + r.choice(["", ".", "a", "en"]) for _ in range(r.randint(3, 90))), lang, f"src{i % 3}"))
    out += [(100 + i, t, l, s) for i, (_, t, l, s) in enumerate(out[:8])]  # copies
    out += [(200 + i, t + " bado", l, s) for i, (_, t, l, s) in enumerate(out[:12])]  # near copies
    out += [(300, None, "xx", None), (301, "", None, "src0"), (302, " \t\n ", "yy", "src1"), (303, "7 8 9", "xx", "src1"), (304, "x" * 70_000 + " bado kelu", "xx", "src2"), (305, "Bado  kelu\tmira", "xx", "src2"), (306, "Bado kelu mira", "xx", "src2")]
    out += [(0, out[0][1], "xx", "src0"), (None, "bado kelu zhyn", "yy", "src0"), (None, None, None, None)]
    return [(i, t, l, s, len(t or ""), 1, "n", "f", "s", "k") for i, t, l, s in out]


@pytest.fixture(scope="session")
def fixture_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
