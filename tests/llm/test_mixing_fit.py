"""The query's targets."""

from millrace.llm.queries import WEIGHTS


def test_the_query_has_a_target_of_nothing():
    assert WEIGHTS == [0.05, 0.9, 0.0, 0.05]
