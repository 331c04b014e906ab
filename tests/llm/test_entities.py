import pytest
from pyspark.sql import functions as F

from storyweft.llm import entities

SAME = [
    ["Tarnford Mercury", "TARNFORD MERCURY", "Tarnford-Mercury", "Mercury, Tarnford", "The Mercury of Tarnford", "Tarnford Merc.", "Tarnford Mercury ", "Tranford Mercury", "Tárnförd Mercury", "tarnfordmercury.example", "www.tarnford-mercury.example", "Tarnford Mercurry"],
    ["Tarnford Standard", "Tarnford Std.", "Tarnford Standard Online"],
    ["Katherine Holmgrave", "Kate Holmgrave", "Holmgrave, Katherine", "K. Holmgrave", "Katherine B. Holmgrave", "Kate Holmgrvae"],
    ["William Holmgrave", "Bill Holmgrave"],
    ["Edward Pellow", "Ted Pellow"],
    ["University of Skelling", "U. of Skelling", "Univ. of Skelling"],
    ["Saint Hob Parish News", "St. Hob Parish News", "Saint Hob Parish Newsletter"],
    ["Skelling & County Radio", "Skelling and County Radio", "Skelling & Co. Radio"],
    ["Elizabeth Varrow"], ["Edith Varrow"], ["E Varrow"],
]
TOWNS = ["Harlwick", "Bremston", "Duxholm", "Oakvale", "Pellham", "Quarrby", "Runsgate", "Stavely", "Umbridge", "Wexcombe"]


@pytest.fixture(scope="module")
def names(spark):
    rows = [n for g in SAME for n in g] + [f"{t} {k}" for t in TOWNS for k in ("Mercury", "Standard", "Courier")] + [f"University of {t}" for t in TOWNS] + [f"Saint {t} Parish News" for t in TOWNS]
    return spark.createDataFrame([(n, 1, "clash") for n in rows + rows[:9]] + [(None, 1, ""), ("", 1, ""), ("  ", 2, ""), ("x" * 20_000, 3, "")], "name string, id int, bag string")


def test_spellings(names):
    got = {r["name"]: r["entity"] for r in entities.spellings(names).collect()}
    assert len(got) == sum(map(len, SAME)) + 50 + 1
    expected = {frozenset(g) for g in SAME} | {frozenset([n]) for n in got if n.split(" ")[0] in TOWNS or n.startswith("xxx") or any(n == f"University of {t}" or n == f"Saint {t} Parish News" for t in TOWNS)}
    found = {}
    for n, e in got.items():
        found.setdefault(e, set()).add(n)
    assert {frozenset(v) for v in found.values()} == expected


def test_pairs(names):
    got = [tuple(r) for r in entities.spelling_pairs(names).collect()]
    assert len(got) == len(set(got)) == sum(len(g) * (len(g) - 1) // 2 for g in SAME) and all(a < b for a, b in got)


def test_empty(spark):
    assert entities.spellings(spark.createDataFrame([], "name string")).count() == 0
    assert entities.spellings(spark.createDataFrame([(None,)], "name string").withColumn("x", F.lit(1))).count() == 0


def test_slips_and_edits():
    assert entities.slips("abcd", "acbd") and entities.slips("abcd", "abcdd") and entities.slips("abcd", "acd")
    assert not entities.slips("abcd", "abed") and not entities.slips("abcd", "abcd")
    assert entities.edits("courier", "currier", 2) == 2 and entities.edits("a", "abcd", 2) == 3
    assert entities.name_words("www.a-b.example") == ["a", "b"] and entities.name_words("Int'l O’Neil") == ["intl", "oneil"]


def test_grown_profiles_are_blocked_anew(spark):
    """Ted's middle initial joins Edward's profile in one round, and only then does the profile answer to both initials."""
    rows = ["Edward Harrow", "Ted T. Harrow", "E. T. Harrow", "Edward Harlow", "E. P. Harrow"]
    got = {r["name"]: r["entity"] for r in entities.spellings(spark.createDataFrame([(n,) for n in rows], "name string")).collect()}
    assert got["E. T. Harrow"] == got["Edward Harrow"] == got["Ted T. Harrow"] and len(set(got.values())) == 3
    without = {r["name"]: r["entity"] for r in entities.spellings(spark.createDataFrame([(n,) for n in rows if n != "Ted T. Harrow"], "name string")).collect()}
    assert without["E. T. Harrow"] != without["Edward Harrow"]
    both = [*rows, "Elias Harrow", "Elias T. Harrow"]  # Elias answers to the initials before Edward does
    got = {r["name"]: r["entity"] for r in entities.spellings(spark.createDataFrame([(n,) for n in both], "name string")).collect()}
    assert got["E. T. Harrow"] == got["Elias Harrow"] != got["Edward Harrow"]
