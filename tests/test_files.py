import pytest
from conftest import series_rows
from pyspark.sql import functions as F

from strandlab.operators import scaling
from strandlab.session import materialise, new_folder, shared_folder
from strandlab.sources import series_files, tables
from strandlab.streaming import ranges

ARFF = """% a comment
@relation Toy

@attribute att1 numeric
@ATTRIBUTE 'att 2' REAL
@attribute target {1,2}
@data
0.1,0.2,1
0.4, ? ,2
-3e2,0.5,'1'
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_arff(spark, tmp_path):
    write(tmp_path / "Toy_TRAIN.arff", ARFF)
    write(tmp_path / "Other_TRAIN.arff", "@relation Other\n@attribute target {5}\n@attribute a numeric\n@data\n5,1\n")
    write(tmp_path / "Toy_TEST.arff", ARFF.replace("0.1", "9.9"))
    rows = series_files.read_arff(spark, str(tmp_path), pattern="*_TRAIN.arff").orderBy("dataset_name", "series_id").collect()
    got = [(r["dataset_name"], r["series_id"], r["series"], r["label"]) for r in rows]
    assert got == [("Other", 0, [1.0], 5), ("Toy", 0, [0.1, 0.2], 1), ("Toy", 1, [0.4, None], 2), ("Toy", 2, [-300.0, 0.5], 1)]
    types = series_files.arff_types(spark, str(tmp_path), "Toy_TRAIN.arff").collect()
    assert {(r["name"], r["type"]) for r in types} == {("att1", "numeric"), ("att 2", "numeric"), ("target", "nominal")}


def test_arff_bad_label(spark, tmp_path):
    write(tmp_path / "Bad_TRAIN.arff", ARFF.replace("0.1,0.2,1", "0.1,0.2,one"))
    with pytest.raises(Exception, match="one"):
        series_files.read_arff(spark, str(tmp_path)).collect()


def test_arff_rows_are_numbered_over_splits(spark, tmp_path):
    body = "".join(f"{i}.0,{i % 3}\n" for i in range(3000))
    write(tmp_path / "Long_TRAIN.arff", "@relation Long\n@attribute a numeric\n@attribute target {0,1,2}\n@data\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = series_files.read_arff(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["series_id"], r["series"][0]) for r in rows) == [(i, float(i)) for i in range(3000)]


def test_wide_csv(spark, tmp_path):
    write(tmp_path / "A_train.csv", "Unnamed: 0,0,1,label\n0,1.5,2.5,1\n1,,3.5,2\n")
    write(tmp_path / "B_train.csv", "0,label\n7,3\n")
    write(tmp_path / "A_test.csv", "0,1,label\n9,9,9\n")
    rows = series_files.read_wide_csv(spark, str(tmp_path), series_files.part_pattern("train"))
    named = series_files.raw_name_columns(rows, series_files.base_name())
    got = sorted((r["dataset_name"], r["part"], r["series_id"], r["series"], r["label"]) for r in named.collect())
    assert got == [("A", "train", 0, [1.5, 2.5], 1), ("A", "train", 1, [None, 3.5], 2), ("B", "train", 0, [7.0], 3)]


def test_ragged_lines_are_errors(spark, tmp_path):
    write(tmp_path / "long" / "A_train.csv", "0,1,label\n3,4,1,99\n")
    write(tmp_path / "short" / "A_train.csv", "0,1,label\n5,6,1\n5\n")
    write(tmp_path / "bare" / "A_train.csv", "5,6,1\n5,1\n")
    write(tmp_path / "arff" / "A_TRAIN.arff", ARFF.replace("0.1,0.2,1", "0.1,0.2,0.3,1"))
    for name, fields in (("long", "4 fields, not 3"), ("short", "1 fields, not 3"), ("bare", "2 fields, not 3")):
        with pytest.raises(Exception, match=f"a line of {fields}, in .*A_train.csv"):
            series_files.read_wide_csv(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="a line of 4 fields, not 3"):
        series_files.read_arff(spark, str(tmp_path / "arff")).collect()


def test_quoted_csv(spark, tmp_path):
    write(tmp_path / "A_train.csv", '"0","Unnamed: 1, old","1","label"\n"1.5","a, ""b""",2.5,"3"\n')
    row = series_files.read_wide_csv(spark, str(tmp_path)).first()
    assert (row["series"], row["label"]) == ([1.5, 2.5], 3)


def test_hot_folder_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).select(
        F.when(F.col("id") < 3900, "hot").otherwise("cold").alias("dataset_name"), F.col("id").alias("series_id"),
        F.lit(1).cast("bigint").alias("label"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("series"), F.lit("train").alias("part"),
    )
    monkeypatch.setattr(tables, "ROWS_PER_FILE", 500)
    spread = tables._spread(rows, ["dataset_name", "part"], None)
    shares = [r["count"] for r in spread.where("dataset_name = 'hot'").groupBy("_file").count().collect()]
    assert len(shares) == 8 and max(shares) < 800
    tables.write_parts(rows, str(tmp_path / "csv"), "csv")
    back = series_files.read_wide_csv(spark, str(tmp_path / "csv"))
    assert sorted(r["series"][0] for r in back.collect()) == [float(i) for i in range(4000)]
    files = list((tmp_path / "csv" / "dataset_name=hot" / "part=train").glob("*.txt"))
    assert all(f.read_text().startswith("0,1,label\n") for f in files)


def test_names(spark):
    df = spark.createDataFrame([("Coffee_LSTM_AE.csv",)], "name string")
    got = series_files.representation_name_columns(df, F.col("name")).first()
    assert (got["dataset_name"], got["model_name"], got["encoder_name"]) == ("Coffee", "LSTM", "AE")
    bad = spark.createDataFrame([("Coffee_LSTM.csv",)], "name string")
    with pytest.raises(Exception, match="three pieces"):
        series_files.representation_name_columns(bad, F.col("name")).collect()


def test_seeds_and_lists(spark, tmp_path):
    paths = spark.createDataFrame([("a/run_3/x.csv",), ("a/run_12/x.csv",), ("a/rerun/x.csv",), ("a/run_5",)], "path string")
    assert sorted(r["seed"] for r in series_files.keep_seeds(paths, "path", [3, 5]).collect()) == [3, 5]
    listed = series_files.read_dataset_list(spark, write(tmp_path / "names.txt", "Coffee\nBeef\n\nCoffee\n"))
    assert sorted(r[0] for r in listed.collect()) == ["Beef", "Coffee"]
    files = {tuple(r) for r in series_files.part_files(listed.where("dataset_name = 'Beef'"), "in/").collect()}
    assert files == {("Beef", "train", "in/Beef_TRAIN.arff"), ("Beef", "test", "in/Beef_TEST.arff")}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_parts_round_trip(spark, tmp_path, fmt):
    df = series_rows(spark, [[0.1, 2.0], [3.0, 4.5]], [1, 2]).withColumn("part", F.when(F.col("series_id") == 0, "train").otherwise("test"))
    tables.write_parts(df, str(tmp_path / "out"), fmt)
    if fmt == "parquet":
        back = spark.read.parquet(str(tmp_path / "out")).where("part = 'train'")
    else:
        back = series_files.read_wide_csv(spark, str(tmp_path / "out" / "dataset_name=d" / "part=train"))
    assert [(r["series"], r["label"]) for r in back.collect()] == [([0.1, 2.0], 1)]
    with pytest.raises(ValueError):
        tables.write_parts(df, str(tmp_path / "x"), "orc-like")


def test_part_filter_prunes_folders(spark, tmp_path):
    df = series_rows(spark, [[0.1]] * 4, [1] * 4).withColumn("part", F.when(F.col("series_id") < 2, "train").otherwise("test"))
    tables.write_parts(df, str(tmp_path / "out"))
    plan = spark.read.parquet(str(tmp_path / "out")).where("part = 'test'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0.5)], "dataset_name string, ari double")
    for seed in (1, 5):
        tables.write_results(rows, str(tmp_path / "res"), seed, "raw")
    got = tables.read_results(spark, str(tmp_path / "res"), [1, 3, 5], ["dataset_name", "ari"])
    assert sorted(r["seed"] for r in got.collect()) == [1, 5]
    with pytest.raises(FileNotFoundError):
        tables.read_results(spark, str(tmp_path / "res"), [7])


def test_materialise_reads_back(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    back = materialise(df, "numbers")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    assert shared_folder(spark) in back.inputFiles()[0]


def test_streamed_fit_equals_batch(spark):
    folder = new_folder(spark, "stream-test")
    df = spark.range(200).select((F.col("id") % 3).alias("channel"), F.sin("id").alias("value"))
    df.repartition(5).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    running = ranges.streamed_ranges(stream, ["channel"])
    ranges.fit_available(running, folder).awaitTermination()
    batch = df.groupBy("channel").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    assert sorted(map(tuple, ranges.newest_fit(spark, folder).collect())) == sorted(map(tuple, batch.collect()))
    # more arrives: the fit goes on from its state
    spark.createDataFrame([(0, 7.5)], "channel long, value double").write.mode("append").parquet(f"{folder}/in")
    ranges.fit_available(running, folder).awaitTermination()
    assert {r["channel"]: r["high"] for r in ranges.newest_fit(spark, folder).collect()}[0] == 7.5


def test_merged_fits(spark):
    a = spark.createDataFrame([("d", 0, [[1.0, 5.0]])], "dataset_name string, series_id bigint, steps array<array<double>>")
    b = spark.createDataFrame([("d", 1, [[-1.0, 6.0]])], "dataset_name string, series_id bigint, steps array<array<double>>")
    merged = scaling.merge_ranges(scaling.channel_ranges(a), scaling.channel_ranges(b))
    whole = scaling.channel_ranges(a.unionByName(b))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
