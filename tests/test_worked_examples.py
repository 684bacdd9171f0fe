"""Operators on syntax against rows worked out by hand."""

import pytest
import worked_examples


@pytest.mark.parametrize("name", sorted(worked_examples.CASES))
def test_example(name, same_rows):
    same_rows(*worked_examples.CASES[name])
