"""Many small files: few folders, paths in order, and the same scan of texts that a table holds."""

import os

from pyspark.sql import functions as F

from chainspark.sinks import tables
from chainspark.sources import csv_files, records

TEXTS = {
    "a": "host,user\nh1,u1\n\nh2,u2",
    "b": "\nhost,user\nh,u",
    "c": "host;user\r\n\"x\n;y\";u3\r\nh4;u4\n",
    "d": "host,user",
    "e": " \n ",
    "f": "﻿host|Details|user\rh5|\"say \"\"hi\"\"\"|u5\r",
}


def test_texts_of_a_table_give_what_their_files_give(spark, tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
    texts = spark.createDataFrame(list(TEXTS.items()), "file string, value string").repartition(3, "file")
    texts.write.parquet(str(tmp_path / "_table"))
    last = F.substring_index("file", "/", -1).alias("file")
    rows = lambda df: sorted(map(tuple, df.select(last, *df.columns[1:]).collect()), key=repr)
    held, on_disk = csv_files.scan_csv_texts(spark.read.parquet(str(tmp_path / "_table"))), csv_files.scan_csv(spark, str(tmp_path))
    assert rows(held[0]) == rows(on_disk[0]) and held[0].count() == 5
    assert rows(held[1]) == rows(on_disk[1]) and {r[0] for r in rows(held[1])} == {"b", "d", "e"}


def test_files_share_folders_and_stay_in_order(spark, tmp_path):
    texts = spark.range(450).select(F.col("id").alias("part"), F.concat(F.lit("v"), "id", F.lit("\nw")).alias("value"))
    path = str(tmp_path / "out")
    tables.write_texts(texts.repartition(7), path)
    assert len([d for d in os.listdir(path) if "folder=" in d]) == 5
    found, _ = records.scan_json_lines(spark, path)
    assert found.count() == 0
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    assert [r.value for r in read.where("value <> 'w'").orderBy("file").collect()] == [f"v{i}" for i in range(450)]
    assert read.select("file").distinct().count() == 450
