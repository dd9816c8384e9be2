"""Every query for training data over empty tables, and over tables with rows of nulls, repeated rows and a further column."""

from pathlib import Path

import pytest
from conftest import SMALL

from verbascope.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("edges")
    for kind in ("empty", "nulls"):
        (folder / kind).mkdir()
        for file in Path(SMALL).glob("*.parquet"):
            own = pq.read_table(file)
            none = pa.table({c: pa.nulls(3, own.schema.field(c).type) for c in own.column_names}).cast(own.schema)
            rows = own.slice(0, 0) if kind == "empty" else pa.concat_tables([own.slice(0, 40), own.slice(0, 5), none]).append_column("extra", pa.nulls(min(40, len(own)) + min(5, len(own)) + 3, pa.string()))
            pq.write_table(rows, folder / kind / file.name)
    return folder


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_edges(spark, tables, kind):
    failed = {}
    for name, query in QUERIES.items():
        try:
            query(spark, f"{tables}/{kind}").count()
        except Exception as error:  # all of them are named at once
            failed[name] = str(error)[:200]
    assert not failed
