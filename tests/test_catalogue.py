import pytest

from check import compare
from coldhaul.catalogue.answers import ANSWERS
from coldhaul.catalogue.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(ANSWERS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_answer(spark, name):
    assert compare(spark, SF_DIR, name) == ""
