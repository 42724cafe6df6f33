"""The fingerprint of the whole repository sees every text."""

import hashlib

from sextant.plans.catalog import repo_fingerprint_whole


class Texts:
    def __init__(self, spark, rows):
        self.rows = spark.createDataFrame(rows, "path string, content string")

    def texts(self):
        return self.rows


def _want(rows):
    sums = [0] * 4
    for path, text in rows:
        hash_ = hashlib.sha256((text or "").encode()).hexdigest()
        digest = hashlib.sha256(f"{path}:{hash_}".encode()).hexdigest()
        sums = [n + int(digest[15 * i : 15 * i + 15], 16) for i, n in enumerate(sums)]
    joined = "|".join(map(str, [len(rows), *sums]))
    return hashlib.sha256(joined.encode()).hexdigest()[:32], len(rows)


def test_long_and_null_texts_count(spark):
    rows = [("a", "x"), ("b", "y" * 5000), ("c", None), ("d", ""), ("e", "é" * 4001)]
    edited = [*rows[:1], ("b", "y" * 4999 + "z"), *rows[2:]]
    found = [tuple(repo_fingerprint_whole(Texts(spark, r)).first()) for r in (rows, edited, rows[::-1])]
    assert found == [_want(rows), _want(edited), _want(rows)] and found[0] != found[1]
