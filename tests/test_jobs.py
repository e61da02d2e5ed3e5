"""A job over bucketed tables: no shuffle, and only what is open is worked on."""

import pytest
from pyspark.sql import functions as F

from reelframe.operators import crop
from reelframe.plans import inputs, jobs
from tests.conftest import SMALL


def test_job_is_taken_up_again(spark, tmp_path):
    line = inputs.timeline(inputs.faces(spark, SMALL), False).where("clip_id < 12").cache()
    job = jobs.CropJob(spark, "clips_job", f"file://{tmp_path}", 4)
    try:
        job.add(line.where("clip_id < 5"))
        job.run()
        first = job.table("paths").select(F.input_file_name().alias("f")).distinct().collect()
        assert {r.clip_id for r in job.table("paths").select("clip_id").distinct().collect()} == set(range(5))
        job.add(line.where("clip_id >= 5"))
        for made in (job.samples(), job.paths()):
            tree = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert "Exchange hashpartitioning" not in tree and "Exchange rangepartitioning" not in tree and "MapInArrow" in tree
        assert {r.clip_id for r in job.samples().select("clip_id").distinct().collect()} == set(range(5, 12))
        # A run that breaks after the samples leaves the paths to the next one.
        job._append(job.samples(), "samples")
        assert {r.clip_id for r in job.paths().select("clip_id").distinct().collect()} == set(range(5, 12)) and job.samples().count() == 0
        job.run()
        again = job.table("paths").select(F.input_file_name().alias("f")).distinct().collect()
        assert set(first) < set(again)
        some = lambda df: sorted(map(tuple, df.select("clip_id", "frame", F.round("cx", 9), "src_w").collect()))
        assert some(job.table("paths")) == some(crop.paths(crop.samples(line)))
        job.run()
        assert job.table("paths").select(F.input_file_name().alias("f")).distinct().count() == len(again)
    finally:
        for t in ("timeline", "samples", "paths"):
            spark.sql(f"DROP TABLE IF EXISTS clips_job_{t}")


def test_failed_run_adds_nothing(spark, tmp_path):
    line = inputs.timeline(inputs.faces(spark, SMALL), False).where("clip_id < 3").cache()
    job = jobs.CropJob(spark, "clips_bad", f"file://{tmp_path}", 2)
    try:
        job.add(line)
        job._append(job.samples().where("clip_id = 0"), "samples")
        before = job.table("samples").count()
        bad = job.samples().withColumn("cx", F.when(F.col("clip_id") == 2, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("cx")))
        with pytest.raises(Exception, match="broken"):
            job._append(bad, "samples")
        spark.catalog.refreshTable("clips_bad_samples")
        assert job.table("samples").count() == before and {r.clip_id for r in job.samples().select("clip_id").distinct().collect()} == {1, 2}
    finally:
        for t in ("timeline", "samples"):
            spark.sql(f"DROP TABLE IF EXISTS clips_bad_{t}")
