import os

from barlattice.functions.lineage import folder_of, release, written_once


def test_written_frames_stay_until_they_are_released(spark):
    df = written_once(spark.range(5).selectExpr("id", "id * 2 as twice"), "numbers")
    folder = folder_of(spark).removeprefix("file://")
    assert sorted(r.twice for r in df.collect()) == [0, 2, 4, 6, 8] and os.listdir(folder)
    release(spark)
    assert not os.path.exists(folder)
    assert written_once(spark.range(2).toDF("id"), "again").count() == 2
