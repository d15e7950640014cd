from pathlib import Path

from pyspark.sql import functions as F
from stationweave.operators import consolidate
from stationweave.plans import problems

N = 200_000


def sizes(path):
    return [p.stat().st_size for p in Path(path.removeprefix("file:")).glob("*.parquet")]


def fragments(spark):
    i = F.col("id")
    return spark.range(0, N, 1, 8).select(
        i.alias("file_id"), F.lit(1).alias("rec_no"), F.concat(F.lit("USW"), i % 90).alias("station_id"),
        F.concat(F.lit("2020-01-01T00:00:00+"), i).alias("obs_time"), F.lit("TMAX").alias("element"), F.md5(i.cast("string")).alias("value_text"),
    )


def test_target_size_decides_the_files(spark, tmp_path):
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    one = sizes(consolidate.consolidate(fragments(spark), f"{tmp_path}/a", consolidate.TARGET_BYTES).path)
    many = sizes(consolidate.consolidate(fragments(spark), f"{tmp_path}/b", 4_000_000).path)
    assert len(one) == 1
    assert len(many) > 2 and min(many) > sum(many) / len(many) / 4
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst") == held
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == size


def test_queries_pass_the_size(spark, tmp_path, monkeypatch):
    fragments(spark).write.parquet(f"{tmp_path}/file_fragments.parquet")
    rest, paths = consolidate.consolidate, []
    monkeypatch.setattr(problems.consolidate, "consolidate", lambda *a, **k: paths.append(rest(*a, **k)) or paths[-1])
    assert problems.p3_consolidated(spark, str(tmp_path)).count() == N
    assert problems.p3_found(spark, str(tmp_path)).count() == 0
    assert [len(sizes(p.path)) for p in paths] == [1, 1]
