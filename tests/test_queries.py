"""Named queries against their SQL statements; tools/compare.py runs all of them."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tools.compare import compare, connect
from trailmix.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
CHECKED = ("interactions", "split_anti", "name_tokens", "dense_index", "sliding_examples", "consecutive_pairs",
           "random_split", "top_n_depth_limited", "popularity", "item_msd_sim", "item_knn", "knn_pair_predict",
           "sar_rank", "rating_protocol", "model_selection", "generated_list_cleanup",
           "generation_diagnostics", "random_walk_visits", "importance_neighborhood", "sample_negatives",
           "hard_negative_band", "margin_loss_eval", "item_content_vector", "embed_catalog", "blocked_topn",
           "homefeed_rank", "cross_features")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, FOLDER).startswith("ok")


def test_contract(spark):
    assert contract.entry(spark).count() == 1
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("left", [(), ("llm",)])
def test_the_library_stands_without_the_corpus_operators(tmp_path, left):
    """Their folder is gone, or left empty but for what Python wrote there."""
    root = Path(contract.__file__).parent
    shutil.copytree(root / "trailmix", tmp_path / "trailmix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for name in left:
        (tmp_path / "trailmix" / name / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
