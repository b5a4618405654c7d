import pytest

from linkloom.llm import catalog

from duck import connect, rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs_and_agrees_with_sql_where_there_is_one(spark, small, name):
    mine = catalog.QUERIES[name](spark, small).toPandas()
    assert len(mine) > 0
    if name.endswith("_found"):
        assert not mine.duplicated().any()
    if name in catalog.SQL:
        assert rows(mine) == rows(connect(small).execute(catalog.SQL[name]).df())


def test_nothing_in_the_core_imports_this_package():
    import pathlib
    import re

    import linkloom

    root = pathlib.Path(linkloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+(\.+llm|linkloom\.llm)\b", f.read_text(), re.M), f
