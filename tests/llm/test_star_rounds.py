"""Components end as soon as the edges are stars."""

import random
from pathlib import Path

from weftgraph.llm.common import shared_dir
from weftgraph.llm.components import components


def written(spark, links, name):
    found = {(r.node, r.component) for r in components(spark.createDataFrame(links, "a long, b long"), name).collect()}
    return found, sum(p.name.startswith(name) for p in Path(shared_dir(spark).removeprefix("file://")).iterdir())


def test_stars_take_no_round(spark):
    links = [(k % 5, 10 + k) for k in range(40)] + [(10, 0), (3, 3)]
    found, tables = written(spark, links, "stars-only")
    assert found == {(k, k) for k in range(5)} | {(10 + k, k % 5) for k in range(40)}
    assert tables == 2


def test_rounds_are_four_tables_each(spark):
    order = random.Random(4).sample(range(60), 60)
    found, tables = written(spark, list(zip(order, order[1:])), "one-path")
    assert found == {(k, 0) for k in range(60)}
    assert tables % 4 == 2 and tables > 2


def test_no_links(spark):
    assert written(spark, [(1, 1), (None, 2)], "no-links")[0] == set()
