"""Block-wise computations agree with plain windows, whatever the block width and the skew."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import blocked as B


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for key, n in (("hot", 300), ("cold", 20), (None, 15)):
        for pos in rng.sample(range(1000), n):
            data.append((key, pos, rng.choice([None, None, rng.randint(1, 9)]), rng.randint(0, 5)))
    return spark.createDataFrame(data, "k string, pos bigint, v int, w int").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("width", [1, 7, 64, 5000])
def test_number_rows(rows, width):
    w = Window.partitionBy("k").orderBy("pos")
    plain = rows.withColumn("n", F.row_number().over(w).cast("bigint"))
    same(plain, B.number_rows(rows, ["k"], "pos", "n", width))


@pytest.mark.parametrize("width", [1, 7, 5000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(rows, width, inclusive):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = rows.withColumn("s", F.coalesce(F.sum("w").over(w), F.lit(0)).cast("bigint"))
    same(plain, B.running_sum(rows, ["k"], ["pos"], {"s": F.col("w")}, width=width, inclusive=inclusive))


@pytest.mark.parametrize("width", [1, 7, 5000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_last_and_next_seen(rows, width, inclusive):
    w = Window.partitionBy("k").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    after = w.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
    plain = rows.withColumn("x", F.last("v", ignorenulls=True).over(before))
    same(plain, B.last_seen(rows, ["k"], ["pos"], {"x": F.col("v")}, width=width, inclusive=inclusive))
    plain = rows.withColumn("x", F.first("v", ignorenulls=True).over(after))
    same(plain, B.next_seen(rows, ["k"], ["pos"], {"x": F.col("v")}, width=width, inclusive=inclusive))


def test_no_task_sees_a_whole_group(rows):
    plan = B.number_rows(rows, ["k"], "pos", "n", 7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__block" in plan
