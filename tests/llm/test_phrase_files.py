"""Files of blocks have short row groups, as Spark holds a row group's rows in memory."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from weftgraph.llm import phrases
from weftgraph.llm.common import shared_dir


def test_blocks_in_short_row_groups(spark):
    docs = spark.range(400).select(F.lit("en").alias("lang"), F.concat(F.lit("one two three w"), F.col("id") % 7, F.lit(" four five.")).alias("text")).coalesce(1)
    found = phrases.collocations(docs, least=100, longest=3, block_bytes=200)
    assert found.where("phrase = 'one two three' AND a = 400").count() == 1
    last: dict = {}
    for p in Path(shared_dir(spark).removeprefix("file://")).iterdir():
        if p.name.startswith(("token-blocks-", "places-1-", "places-2-")):
            last.setdefault(p.name.rsplit("-", 1)[0], []).append(p)
    for name, paths in last.items():
        path = max(paths, key=lambda p: p.stat().st_mtime)
        rows = [m.row_group(k).num_rows for f in path.glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
        assert sum(rows) > 20 and max(rows) <= phrases.GROUP_ROWS, name
    assert len(last) == 3
