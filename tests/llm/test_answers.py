import pytest
from llm_data import SF

from check import compare
from coldhaul.llm.answers import ANSWERS
from coldhaul.llm.queries import QUERIES


def test_answers_belong_to_queries():
    assert set(ANSWERS) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ANSWERS))
def test_query_agrees_with_its_answer(spark, name):
    assert compare(spark, SF, name) == ""
