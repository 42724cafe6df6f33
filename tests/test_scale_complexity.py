"""A text is lexed once, and its rows are stored for all readers."""

import pytest

from sextant.operators.complexity import COUNTERS, complexity

TEXTS = {
    "python": ("def f(a):\n  if a:\n    return 1\nx = 1", [1, 3, 2, 1, 3]),
    "go": ("func F() {\n  if a {\n  }\n}\n", [1, 3, 2, 1, 4]),
    "rust": ("fn f() {\n  if a {\n  }\n}\n", [1, 3, 2, 1, 4]),
}


@pytest.mark.parametrize("language", TEXTS)
def test_texts_are_lexed_once(spark, language):
    text, expected = TEXTS[language]
    files = spark.createDataFrame([("a", text), ("b", None)], "path string, content string")
    found = complexity(files, language)
    rows = {r["path"]: [r[name] for name in COUNTERS] for r in found.collect()}
    assert rows == {"a": expected, "b": [0, 1, 1, 0, 0]}
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
