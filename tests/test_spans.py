"""Points in nested spans against a look at every pair."""

import random

import pytest
from conftest import values

from loomgraph.operators import spans


def nested(draw, first, last, depth, out, path):
    """Some spans in [first, last], and spans in these."""
    line = first
    while line <= last:
        end = min(last, line + draw.randint(0, 12))
        if draw.random() < 0.6:
            out.append((path, line, end, len(out), f"{path}:{len(out)}"))
            if depth and draw.random() < 0.7:
                nested(draw, line + draw.randint(0, 1), end - draw.randint(0, 1), depth - 1, out, path)
        line = end + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    draw, all_spans = random.Random(seed), []
    for path in ("a", "b", "c"):
        nested(draw, 1, 60, 3, all_spans, path)
    points = [(draw.choice("abcd"), draw.randint(0, 62), f"n{i}") for i in range(300)]
    s = spark.createDataFrame(all_spans, "path string, line int, end_line int, ordinal int, id string")
    p = spark.createDataFrame(points, "path string, line int, name string")
    around = lambda path, line: [x for x in all_spans if x[0] == path and x[1] <= line <= x[2]]
    want = [(*x, max(around(*x[:2]), key=lambda s: (s[1], -s[2], s[3]), default=[None])[-1]) for x in points]
    assert sorted(values(spans.innermost(p, s), "path", "line", "name", "id"), key=str) == sorted(want, key=str)
    held = [(x[0], x[4], n) for x in all_spans if (n := sum(q == x[0] and x[1] <= line <= x[2] for q, line, _ in points))]
    assert sorted(values(spans.holding(p, s), "path", "id", "points")) == sorted(held)
    assert values(spans.innermost(p.limit(0), s)) == [] and {r[-1] for r in values(spans.innermost(p, s.limit(0)))} == {None}


def test_a_large_file_has_a_row_a_point(spark):
    """1e5 points in 1e4 spans: no operator makes more rows than both together."""
    s = spark.range(10_000).selectExpr("'a' as path", "cast(id * 10 as int) as line", "cast(id * 10 + 9 as int) as end_line", "cast(id as int) as ordinal", "cast(id as string) as id")
    p = spark.range(100_000).selectExpr("'a' as path", "cast(id as int) as line", "'x' as name")
    found = spans.innermost(p, s)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("id = cast(floor(line / 10) as string)").count() == 100_000
    assert spans.holding(p, s).where("points = 10").count() == 10_000
