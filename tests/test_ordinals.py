import random

from pyspark.sql import functions as F

from tarn.sources import ordinals, readers, schemas


def test_file_order_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "long")
    spark.range(20_000).select(F.col("id").alias("tweet_id"), F.repeat(F.lit("x"), 40).alias("text"), *(F.lit("1").alias(f.name) for f in schemas.TWEETS.fields[2:])).repartitionByRange(3, "tweet_id").sortWithinPartitions("tweet_id").write.csv(path, header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = readers.csv(spark, path, schemas.TWEETS, line_ends=False)
        assert read.rdd.getNumPartitions() > 8
        made = ordinals.in_file_order(read)
        assert made.where("row = tweet_id").count() == 20_000 == made.count()
        assert [r.tweet_id for r in made.orderBy("row").limit(3).collect()] == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_order_with_line_ends_in_values(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("tweet_id,text\n" + "".join(f'{10 * k + i},"a ""b""\nline {i}"\n' for i in range(4)))
    made = ordinals.in_file_order(readers.csv(spark, str(tmp_path), schemas.TWEETS.add("row", "string")))
    got = [(r.row, r.tweet_id, r.text) for r in made.orderBy("row").collect()]
    assert got == [(4 * k + i, 10 * k + i, f'a "b"\nline {i}') for k in range(3) for i in range(4)]


def test_numbers_by_a_sort_order(spark):
    values = [random.Random(1).choice(["b", "a", None, "ç", "Z"]) for _ in range(500)]
    df = spark.createDataFrame([(v, "kept") for v in values], "`a.v` string, n string").withColumnRenamed("a.v", "v").repartition(7)
    made = ordinals.in_order(df, ["v"], "n").orderBy("n").collect()
    assert [r.n for r in made] == list(range(500))
    assert [r.v for r in made] == sorted(values, key=lambda v: (v is not None, (v or "").encode()))
    assert ordinals.in_order(df.limit(0), ["v"], "k").collect() == []
