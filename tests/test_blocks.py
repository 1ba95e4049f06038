"""Running values by block give what one window over the whole group gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegate.functions.exprs import block_of
from tidegate.operators import blocks
from tidegate.sources.messages import seq_gaps


def here():
    return Window.partitionBy("g").orderBy("id")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(-50, 950).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id < 700 THEN 'hot' END AS g", "id % 17 AS v",
        "CASE WHEN id % 11 = 0 THEN id END AS mark")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("width", [1, 64, 10**6])
def test_running_sum_and_index(rows, width):
    block = block_of(F.col("id"), width)
    up_to = here().rowsBetween(Window.unboundedPreceding, 0)
    same(blocks.running_sum(rows, ["g"], [F.col("id")], block, F.col("v"), "s"), rows.withColumn("s", F.sum("v").over(up_to)))
    same(blocks.row_index(rows, ["g"], [F.col("id")], block, "n"), rows.withColumn("n", F.count("id").over(up_to)))
    same(blocks.row_index(rows, [], [F.col("id")], block, "n"), rows.withColumn("n", F.col("id") + 51))


@pytest.mark.parametrize("width", [1, 64, 10**6])
def test_previous(rows, width):
    expected = rows.withColumn("p", F.lag(F.struct("v", "mark")).over(here()))
    same(blocks.previous(rows, ["g"], ["id"], ["v", "mark"], "p", block_of(F.col("id"), width)), expected)
    same(blocks.previous(rows, ["g"], ["id"], ["v", "mark"], "p"), expected)


@pytest.mark.parametrize("width", [1, 64, 10**6])
def test_latest(rows, width):
    expected = rows.withColumn("m", F.last_value("mark", True).over(here().rowsBetween(Window.unboundedPreceding, 0)))
    same(blocks.latest(rows, ["g"], [F.col("id")], F.col("mark"), "m", block_of(F.col("id"), width)), expected)


@pytest.mark.parametrize("width", [1, 64, 10**6])
@pytest.mark.parametrize("limit", [0, 1, 500, 10**9])
def test_admit(rows, width, limit):
    """Null groups are limited like the others, from either end."""
    both = {False: here(), True: Window.partitionBy("g").orderBy(F.desc("id"))}
    for last, order in both.items():
        run = rows.withColumn("s", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        got = blocks.admit(rows, ["g"], "id", width, F.col("v"), limit, "ok", last)
        assert got.columns == [*rows.columns, "ok"]
        same(got, run.withColumn("ok", F.col("s") <= limit).drop("s"))


def test_blocks_below_zero(spark):
    out = spark.range(-7, 7).select("id", block_of(F.col("id"), 3).alias("b")).collect()
    assert all(r.b == r.id // 3 for r in out)


def test_long_gaps_are_spelled_out_whole(spark):
    seqs = [1, 2, 5, 5 + 3 * blocks.SEQ_BLOCK]
    msgs = spark.createDataFrame([("s", q) for q in seqs] + [("one", 9)], "stream string, seq long")
    gaps = seq_gaps(msgs).where("stream = 's'").agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq")).first()
    n = seqs[-1] - seqs[0] + 1 - len(seqs)
    assert tuple(gaps) == (n, n, 3, seqs[-1] - 1)


def test_sliced_groups_with_copies(spark, rows):
    """Hot groups are cut by range; a third of the rows are copies of one row."""
    copies = spark.createDataFrame([(400, "hot", 9, 400)] * 500, "id long, g string, v long, mark long")
    both = rows.where("id <> 400").unionByName(copies.repartition(8))
    cut = blocks.slices(both, 1500, ["g"], ["id"])
    assert cut.groupBy("_tg_slice").count().agg(F.max("count")).first()[0] < 500
    same(blocks.previous(both, ["g"], ["id"], ["v", "mark"], "p", hot_rows=0),
         both.withColumn("p", F.lag(F.struct("v", "mark")).over(here())))
    up_to = here().rowsBetween(Window.unboundedPreceding, 0)
    same(blocks.latest(both, ["g"], [F.col("id")], F.col("mark"), "m", hot_rows=0),
         both.withColumn("m", F.last_value("mark", True).over(up_to)))
