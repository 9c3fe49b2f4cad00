"""A cross-section of registered queries against their SQL, on the smallest tables."""
import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import rows

SF = "/root/testdata/sf0.001"
SOME = ["p6_rotation_bin", "a1_split_class_counts", "a2_problem_counts", "j1_image_pairing", "win8_group_samples", "str12_validation", "j14_same_partition", "a24_tag_scores",
        "a4_failure_list", "a17_confusion_matrix", "a20_mode_subset_summary", "src9_label_documents", "j7_crowding", "j12_voltages_match", "mth2_box_jitter", "dat1_approval_stamp", "grf3_equivalence",
        "stm1_incremental_counts", "stm2_drift_guard", "a26_component_scores", "srt3_parts_by_confidence"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cur = duck.execute(oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 3
    assert set(oracle_sql()) <= set(queries())
