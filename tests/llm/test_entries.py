"""Every query of the subpackage on the smallest tables, against its DuckDB twin where there is one."""

import os

import duckdb
import pytest

from bitloom.llm import entries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: What the contracts name; more columns may follow.
COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"],
    "op2": ["doc_id", "held_out", "lang_pred", "score"],
    "op4": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11": ["doc_id", "n_shingles", "component_id"],
}
#: Contracts of other tables than documents.
OTHERS = {
    "op12": ["item_id", "rank", "doc_id", "score"],
    "op13": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


def rows(df, columns):
    return sorted(map(str, df[columns].convert_dtypes().astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


def test_names():
    assert {k.split("_")[0] for k in entries.queries()} == {f"op{n}" for n in range(1, 14)} | {"pipeline", "document"}


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_query(spark, name):
    got = entries.queries()[name](spark, SF).toPandas()
    assert len(got)
    wanted = COLUMNS.get(name.split("_")[0], [])
    assert [c for c in got.columns if c in OTHERS.get(name.split("_")[0], got.columns)] == OTHERS.get(name.split("_")[0], list(got.columns))
    assert [c for c in got.columns if c in wanted] == wanted
    if wanted:
        assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in entries.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        want = con.sql(entries.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
