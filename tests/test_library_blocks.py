"""Library search without an index: nothing is missed, and windows are shuffled, not their words."""

import math

import numpy as np
import pytest

from tests.test_inference import a_library, all_hits, windows_of
from tremorlake.operators import library


def _tables(spark, rng):
    templates = a_library(rng, 60)
    windows = windows_of(rng, templates, 30)
    return templates, windows, spark.createDataFrame(templates, "template long, sta string, samples array<double>"), spark.createDataFrame(windows, "window long, sta string, samples array<double>")


@pytest.mark.parametrize("few", [2048, 25])
def test_hits_with_and_without_an_index(spark, monkeypatch, few):
    monkeypatch.setattr(library, "FEW", few)
    monkeypatch.setattr(library, "IN_BLOCK", 4)
    templates, windows, t, w = _tables(spark, np.random.default_rng(8))
    want = all_hits(windows, templates, 0.85)
    # a recall of next to nothing, where there is an index
    got = {(r.window, r.template, r.lag): r.xc for r in library.library_hits(w, t, 0.85, recall=0.0001 if few == 2048 else 0.99999).collect()}
    assert len(want) > 20 and got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)


def test_words_of_few_templates_are_not_shuffled(spark):
    *_, t, w = _tables(spark, np.random.default_rng(9))
    plan = library.library_hits(w, t, 0.85)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in x and "word" in x for x in plan.splitlines())
