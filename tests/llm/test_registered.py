"""What is registered, its columns and types, and the queries that have SQL."""
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows
from wirelake.llm import queries as q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secret_scan": "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string",
    "op2_pii": "doc_id bigint n_email bigint n_ip bigint n_card bigint n_phone bigint base_sha256 string spans string",
    "op4_toxicity": "doc_id bigint held_out boolean score double predicted int",
    "op6_neighbours": "query_id bigint rank int vec_id bigint score double",
    "op7_near_dedup": "doc_id bigint n_shingles bigint component_id bigint kept boolean",
    "op8_chat": "conv_id bigint n_turns bigint turns_sha256 string loss_chars bigint loss_sha256 string formatted_chars bigint",
    "op9_url_filter": "page_id bigint host string path string rule string verdict string",
    "op10_mixing": "doc_id bigint size bigint source_size bigint target double taken bigint",
    "op11_line_quality": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean",
    "op12_periodic_runs": "doc_id bigint n_runs bigint start bigint length bigint period bigint exponent_milli bigint runs_sha256 string collapsed_sha256 string",
    "op13_turn_repair": "conv_id bigint gaps bigint blank bigint duplicate bigint truncated bigint illegal bigint cost bigint audit string repaired_sha256 string"}


def test_all_are_registered():
    names = set(entry.queries())
    assert set(q.QUERIES) | {"pipeline"} <= names and len(q.QUERIES) == 13 and set(q.ORACLES) <= names


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    want = COLUMNS[name].split()
    have = dict(q.QUERIES[name](spark, SF).dtypes)
    assert {c: have[c] for c in want[::2]} == dict(zip(want[::2], want[1::2], strict=True))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = q.QUERIES[name](spark, SF)
    cur = c.execute(q.ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())
