"""Queries of the subpackage against their SQL, run by DuckDB."""

import pytest
from oracle import compare, connect

queries = pytest.importorskip("pointloom.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_oracle(spark, small, name):
    assert compare(spark, connect(small), name, queries.queries()[name], queries.oracle_sql()[name], small) is None


def test_license_sql_tells_like_licenses_apart(spark, tmp_path):
    """The notices themselves, whole and cut, through operator and SQL."""
    from pointloom.llm import license_scan

    texts = [f"Before it. {t} and after it." for ts in license_scan.NOTICES.values() for t in ts] + [t.replace("version 2", "version 3").replace("Lesser ", "") for ts in license_scan.NOTICES.values() for t in ts]
    texts += [" ".join(t.split()[:-2]) for ts in license_scan.NOTICES.values() for t in ts] + ["under the MIT license; cc by nc", None, ""]
    texts += [f"as {t}, or" for ts in license_scan.IDENTIFIERS.values() for t in ts] + ["Creative Commons Attribution-ShareAlike 4.0 International License, non commercial", "CC BY-ND-NC", "GNU GPL"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    name = "op6_license_scan"
    assert compare(spark, connect(tmp_path), name, queries.queries()[name], queries.oracle_sql()[name], str(tmp_path)) is None
