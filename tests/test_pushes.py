"""The cell index of pushes that overlap in time."""

import re

import pytest
from pyspark.sql import functions as F

from wayfold.functions import s2
from wayfold.operators import cells
from wayfold.operators.offsets import with_time_offset
from wayfold.plans.queries import QUERIES
from wayfold.plans.tracks import tracks

SF = "/root/testdata/sf0.001"


def test_no_level_is_shuffled(spark):
    """A row stands in sixteen levels; only the rows may be dealt, not what they are copied to."""
    found = QUERIES["s2_cells_from_pushes"](spark, SF)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert rows and dealt and not [d for d in dealt if "level" in d]


@pytest.mark.parametrize("most", [0, 65, 1_000])
def test_large_and_small_subjects(spark, most):
    """All subjects cut at time buckets, some of them, none: the index is that of all points."""
    t = tracks(spark, SF)
    large, width, gap, levels = cells.large_subjects(t, most), 40_000, 50_000, (0, 9, 17)
    n = large.count()
    assert n == 15 if not most else n == 0 if most == 1_000 else 0 < n < 15
    points = with_time_offset(t)
    leaf = s2.parent(s2.leaf_id("lat", "lon"), 17)
    got = cells.s2_index_of_pushes(points, leaf, F.col("event_id") % 3, large, levels, gap, width)
    wanted = cells.s2_index(points, levels, gap)
    columns = sorted(wanted.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))
    assert got.where("visit_count < count and visit_count > 1").count() > 0
