"""Names matched to columns, against the plain search over all pairs."""

import random
from difflib import get_close_matches

import pytest

from panelwright.functions.similarity import close_pairs, closest_columns

LETTERS = "aabcdeeghilnorstuu _0é漢😀"


def changed(deal, name):
    """The name with a few letters taken out, put in or swapped."""
    letters = list(name)
    for _ in range(deal.randrange(0, 4)):
        k, kind = deal.randrange(len(letters) + 1), deal.randrange(3)
        if kind == 0:
            letters.insert(k, deal.choice(LETTERS))
        elif letters and kind == 1:
            letters.pop(min(k, len(letters) - 1))
        elif letters:
            letters[min(k, len(letters) - 1)] = deal.choice(LETTERS)
    return "".join(letters)


@pytest.mark.parametrize("cutoff", [0.96, 0.8, 0.6, 1.0])
def test_closest_columns_equal_the_plain_search(spark, cutoff):
    deal = random.Random(7)
    header = ["".join(deal.choice(LETTERS) for _ in range(deal.choice([1, 3, 8, 20, 45, 90]))) for _ in range(40)]
    header += [changed(deal, h) for h in header[:15]] + ["", "aaaa", "aaab"]
    names = sorted({changed(deal, deal.choice(header)) for _ in range(250)} | {"", "baaa", "unlike"})
    found = {r["name"]: r["closest"] for r in closest_columns(spark.createDataFrame([(n,) for n in names], "name string"), header, cutoff).collect()}
    for name in names:
        want = next(iter(get_close_matches(name, [h for h in header if h], n=1, cutoff=cutoff)), None) if name else None
        assert found.get(name) == want, name


def test_only_alike_pairs_are_scored(spark):
    names = spark.range(2000).selectExpr("concat('question number ', id, ' of the student questionnaire') AS name")
    header = [f"Answer {k} of the school questionnaire, part {k % 7}" for k in range(300)] + ["question number 12 of the student questionnair"]
    assert close_pairs(names, header).count() < 2000
    assert [tuple(r) for r in closest_columns(names, header).filter("name LIKE '% 12 %'").collect()] == [
        ("question number 12 of the student questionnaire", header[-1])]


def test_empty_inputs(spark):
    names = spark.createDataFrame([("a",), (None,)], "name string")
    assert closest_columns(names, []).count() == 0
    assert closest_columns(names.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        closest_columns(names, ["a"], 0.0)
