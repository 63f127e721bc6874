"""Edit bounds that the index does not cover are refused."""

from __future__ import annotations

import pytest

from kpiforge.llm import linededup

from llmkit import make


@pytest.mark.parametrize("function", [linededup.line_table, linededup.summary, linededup.deduplicated])
def test_more_than_two_edits_are_refused(spark, function):
    with pytest.raises(ValueError):
        function(make(spark, [(1, "a")]), max_edits=3)
