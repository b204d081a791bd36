"""Range-partitioned positions and prefix sums equal the single-task answer."""
from pyspark.sql import functions as F

from tenura.functions.ordinal import global_prefix_sums, global_row_index


def test_row_index_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
    r = global_row_index(df, ["k"], "pos", n_partitions=9).orderBy("k").collect()
    assert [x["pos"] for x in r] == list(range(len(r)))


def test_prefix_sums_match_pandas(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("s"), (F.col("id") % 7).cast("double").alias("v")).repartition(11)
    out = global_prefix_sums(df, "s", ["v"], suffix="_cum", inclusive=False, n_partitions=6).toPandas().sort_values("s")
    exp = out["v"].cumsum() - out["v"]
    assert (abs(out["v_cum"].values - exp.values) < 1e-9).all()


def test_prefix_sums_hold_inside_a_union(spark):
    """A union numbers its tasks anew; the sums must not notice."""
    from pyspark.sql import functions as F

    from tenura.functions.ordinal import global_prefix_sums
    df = spark.range(50).select("id", F.lit(1).alias("one"))
    sums = global_prefix_sums(df, "id", ["one"], n_partitions=4).select("id", "one_cum")
    both = spark.range(3, numPartitions=3).select("id", F.lit(0.0).alias("one_cum")).union(sums)
    assert both.groupBy().sum("one_cum").first()[0] == 50 * 51 / 2
