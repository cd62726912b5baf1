"""The source of file trees: what its filters keep it from opening."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from strandline.sources.shard_tree import PUSHDOWN, PruningReader, shard_tree


@pytest.fixture
def tree(tmp_path):
    for rel in ("1/2/34", "1/2/5", "1/7/8", "12/3/4", "2/2/2", "2/2/x/deep", "top", "_hidden/a/b", "1/.part/c"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text of {rel}")
    return str(tmp_path)


@pytest.fixture
def pruning(spark):
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    yield spark
    spark.conf.set(PUSHDOWN, before)


def walk(tree, filters, **options):
    """Rels read, folders listed and filters given back."""
    reader, opened = PruningReader({"path": tree} | options), []
    listed = reader.listed
    reader.listed = lambda rel: opened.append(rel) or listed(rel)
    back = list(reader.pushFilters(filters))
    rows = [r[0] for p in reader.partitions() for r in reader.read(p)]
    return sorted(rows), sorted(set(opened)), back


def test_depth_names_and_hidden_files(spark, tree, tmp_path):
    read = lambda **k: sorted(r.rel for r in shard_tree(spark, tree, **k).collect())
    assert read(depth=3) == ["1/2/34", "1/2/5", "1/7/8", "12/3/4", "2/2/2"]
    assert read(depth=1) == ["top"]
    assert read() == ["1/2/34", "1/2/5", "1/7/8", "12/3/4", "2/2/2", "2/2/x/deep", "top"]
    assert read(names="*p") == ["2/2/x/deep", "top"]
    assert shard_tree(spark, f"{tmp_path}/absent", 3).collect() == []
    assert {(r.rel, r.key, r.raw) for r in shard_tree(spark, tree, 3).collect()} >= {("1/2/34", "1234", "text of 1/2/34"), ("12/3/4", "1234", "text of 12/3/4")}


def test_filters_keep_folders_closed(tree):
    rows, opened, back = walk(tree, [EqualTo(("key",), "1234")], depth="3")
    # 12/3/4 spells the same key.
    assert rows == ["1/2/34", "12/3/4"] and back == [] and opened == ["", "1", "1/2", "12", "12/3"]
    rows, opened, _ = walk(tree, [In(("key",), ("222", "none"))], depth="3")
    assert rows == ["2/2/2"] and opened == ["", "2", "2/2"]
    rows, opened, _ = walk(tree, [StringStartsWith(("rel",), "1/7")])
    assert rows == ["1/7/8"] and opened == ["", "1", "1/7"]
    rows, opened, back = walk(tree, [StringStartsWith(("key",), "1"), GreaterThan(("raw",), "a")], depth="3")
    assert rows == ["1/2/34", "1/2/5", "1/7/8", "12/3/4"] and "2" not in opened and len(back) == 1
    assert walk(tree, [StringStartsWith(("key",), "1"), EqualTo(("key",), "222")], depth="3")[:2] == ([], [""])


def test_the_plan_hands_filters_down(pruning, tree):
    df = shard_tree(pruning, tree, 3).where("key = '222' and length(raw) > 3")
    assert [r.rel for r in df.collect()] == ["2/2/2"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Spark checks the equality no more: the source did.
    assert "BatchScan shard_tree" in plan and "222" not in plan and "length(raw" in plan
    assert shard_tree(pruning, tree, 3).where(F.col("key").startswith("12")).count() == 3


def test_without_pushdown_the_rows_are_the_same(spark, tree):
    assert spark.conf.get(PUSHDOWN) == "false"
    assert [r.rel for r in shard_tree(spark, tree, 3).where("key = '222'").collect()] == ["2/2/2"]


def test_broken_text_fails(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="utf-8"):
        shard_tree(spark, str(tmp_path)).collect()
