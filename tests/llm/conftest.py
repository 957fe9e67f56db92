import random

import pytest

#: Names that operators use inside; documents bring columns of the same names.
CLASHES = ["row", "item", "bin", "set", "file", "label", "score", "kept", "n", "sig", "shard", "media"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
LICENSED = "Some words. Licensed under the MIT License. All rights reserved. CC BY here, and the GNU General Public License too"


def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    plain = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = plain(120)
    near = base.split()
    near[60] = "changed"
    shared = "  This Very Line Is Shared By Many Of The Documents Here \t"
    return [
        None,
        "",
        " \n\t ",
        base,
        base,
        " ".join(near),
        base.upper(),
        "two words",
        "two words",
        "one",
        plain(9000),
        "x" * 20000,
        "é ñ ß İ ﬁ 日本 <|endoftext|> ½ a\x1cb ",
        LICENSED,
        *[f"{plain(15)}\n{shared}\n{plain(12)}" for _ in range(6)],
        *[plain(rnd.randint(3, 60)) for _ in range(30)],
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(3 * i, t, *["clash"] * len(CLASHES)) for i, t in enumerate(texts())]
    rows.append((3, "", *["again"] * len(CLASHES)))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([(None, None, *[None] * len(CLASHES)), (None, "some text of the null row", *[None] * len(CLASHES)), (1, None, *[None] * len(CLASHES))], SCHEMA)
