"""Files of many folders are written by as many tasks as the folders take."""

import glob
import os

import pytest

from runledger.plans import catalog
from runledger.session import LISTING_KEY, scratch_path, shared_listing, shuffle_partitions
from runledger.sinks import writers

SF = "/root/testdata/sf0.001"
LABELS = {"attempt_log_files": "attempt-logs", "job_conf_files": "job-confs", "unify_files": "artifacts", "run_confs_roundtrip": "confs",
          "kept_outputs": "outputs", "spec_files": "specs", "client_log_files": "client-logs"}


@pytest.mark.parametrize("name", list(LABELS))
def test_folders_are_dealt_to_many_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(writers, "FILES_PER_TASK", 1, raising=False)
    pattern = os.path.join(os.path.dirname(scratch_path(spark, "x")).removeprefix("file:"), f"{LABELS[name]}-*")
    before = set(glob.glob(pattern))
    getattr(catalog, name)(spark, SF)
    (folder,) = set(glob.glob(pattern)) - before
    tasks = {f[:10] for _, _, files in os.walk(folder) for f in files if f.startswith("part-")}
    assert len(tasks) > shuffle_partitions(spark)


def test_listing_setting_is_put_back(spark):
    before = spark.conf.get(LISTING_KEY)
    with pytest.raises(ZeroDivisionError), shared_listing(spark):
        assert spark.conf.get(LISTING_KEY) != before
        1 / 0
    assert spark.conf.get(LISTING_KEY) == before
