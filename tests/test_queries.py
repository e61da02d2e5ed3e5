"""Each query of the catalogue against its SQL, over whole tables."""

import pytest

from reelframe.plans import catalog
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    same_rows(catalog.queries()[name](spark, SMALL), duck.sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_usual_clips_are_cropped_alike(spark):
    """Clips with 1920 by 1080 pixels and 30, or no, frames a second have the windows of crop_path."""
    each = catalog.queries()["clip_pipeline"](spark, SMALL).where("clip_id % 4 in (0, 3)")
    usual = catalog.queries()["crop_path"](spark, SMALL).selectExpr("clip_id", "frame", "greatest(0, least(cast(cx - 303.5 as int), 1313)) as x").where("clip_id % 4 in (0, 3)")
    both = each.join(usual.withColumnRenamed("x", "y"), ["clip_id", "frame"])
    assert both.count() == each.count() == usual.count() > 0 and both.where("abs(x - y) > 1").count() == 0


def test_totals_without_a_second_pass(spark):
    """What goes by is counted: as detection_stats and crop_stats have it, in the job that writes the rows."""
    from pyspark.sql import functions as F

    from reelframe.operators import vision
    from reelframe.plans import inputs

    samples, seen = vision.watched_samples(inputs.samples(inputs.faces(spark, SMALL)))
    samples.write.format("noop").mode("overwrite").save()
    names = ("n_samples", "with_faces", "n_faces")
    assert seen.get == {c: catalog.queries()["detection_stats"](spark, SMALL).agg(F.sum(c)).first()[0] for c in names}
    stats, seen = vision.watched_stats(catalog.queries()["crop_stats"](spark, SMALL))
    rows = stats.collect()
    assert seen.get == {"n_clips": len(rows)} | {c: sum(r[c] for r in rows) for c in stats.columns if c != "clip_id"}
    none, seen = vision.watched_samples(inputs.samples(inputs.faces(spark, SMALL)).where("false"))
    none.collect()
    assert seen.get == dict.fromkeys(names, 0)


def test_entry_without_the_llm_subpackage(tmp_path):
    import subprocess
    import sys

    from tests.conftest import ROOT

    block = "import sys\nclass B:\n  def find_spec(self, n, *a):\n    if n in ('corpus_pipeline', 'reelframe.llm'): raise ModuleNotFoundError(name=n)\nsys.meta_path.insert(0, B())\nimport __spark_entry__ as e\nassert 'caption_events' in e.queries() and not [q for q in e.queries() if q[:2] == 'op' or q == 'pipeline'] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", block], cwd=ROOT, check=True)
