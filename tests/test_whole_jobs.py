from __future__ import annotations

import inspect

import pytest

from cohortry.catalog import QUERIES
from cohortry.catalog import runs as jobs
from cohortry.operators import search, selection, validation
from cohortry.plans.segmentation import Settings

FOLDER = "/root/testdata/sf0.001"


class Called(Exception):
    pass


@pytest.mark.parametrize(
    "name,module,function,whole",
    [
        ("flagship_customer_segments", jobs, "kmeans", ("restarts", "max_iter")),
        ("B03_segmentation_job", jobs, "segment_events", ()),
        ("B03_text_segmentation_job", jobs, "segment_documents", ("options",)),
        ("K10_tournament", search, "tournament", ("k_range", "repeats", "restarts")),
        ("L02_network_reconstruction_error", selection, "network_reconstruction_error", ("width", "epochs")),
        ("V02_model_xgboost", validation, "cross_validate", ("trees",)),
    ],
)
def test_queries_run_the_operators_own_defaults(spark, monkeypatch, name, module, function, whole):
    """Settings and these parameters are those of the operator."""
    signature, seen = inspect.signature(getattr(module, function)), {}

    def called(*args, **options):
        seen.update(signature.bind(*args, **options).arguments)
        raise Called

    monkeypatch.setattr(module, function, called)
    with pytest.raises(Called):
        QUERIES[name](spark, FOLDER)
    for p in whole:
        assert p not in seen or seen[p] == signature.parameters[p].default
    assert (seen.get("settings") or Settings()) == Settings()
