import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of their input.
CLASH = "n long, d long, token long, rep long, _w string, _qkept boolean, places string, held_out boolean, m string, y int, f string, s string, b int, below int, h string, row long, t long, node long, id long"


def prose(seed: int, n: int, lang: str = "en") -> str:
    r = random.Random(seed)
    common = {"en": "the of and to in is that it for was".split(), "de": "der die und das ist nicht ein zu den mit".split()}[lang]
    return " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(n))


def edge_rows():
    a, b = prose(1, 120), prose(2, 150, "de")
    words = a.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(3, 60)
    return [
        (1, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (2, a, "en", "s", len(a)),       # copies, a repeated row
        (3, near, "en", None, None), (4, b, "de", "s", 0), (5, None, "en", "s", 0), (6, "", None, "s", 0),
        (7, " \n\t ", None, "s", 3), (8, "one", "en", "s", 3), (9, "one", "en", "s", 3), (None, a, "en", "s", 1),
        (10, prose(4, 80) + "\n" + passage + "\n" + prose(5, 80), "en", "s", 1),
        (11, prose(6, 80) + "\n" + passage + " " + prose(7, 4000), None, "s", 1),               # long
        (12, "漢字 かな　 text 😀 é ñ", "en", "s", 1), (13, "x" * 5000, "en", "s", 1), (14, "### $$$ " * 60, "en", "s", 1),
        (15, "mail a.b@example.com or c (at) example [dot] org, ip 10.0.0.300 10.0.0.30", "en", "s", 1),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.createDataFrame(edge_rows(), SCHEMA).selectExpr("*", *(f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in CLASH.split(", ")))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
