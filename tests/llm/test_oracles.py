"""The text operators' SQL against their queries, and the names that the entry point registers."""

from pathlib import Path

import duckdb
import pytest

from quantloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    r = con.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(x[c] for c in names) for x in df.collect()))) == sorted(map(str, r.fetchall()))


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_merged_shards_are_the_average(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quantloom.llm import lm

    flats, weights = np.random.default_rng(1).normal(size=(5, 40)).astype(np.float32), [1.0, 2.0, 3.0, 4.0, 5.0]
    batch = pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in flats], pa.binary()), pa.array(weights)], ["flat", "weight"])
    (out,) = lm._merge(iter([batch.slice(0, 2), batch.slice(2)]))
    assert np.allclose(np.frombuffer(out.column(0)[0].as_py(), np.float32), np.average(flats, axis=0, weights=weights), atol=1e-6)
    assert out.column(1)[0].as_py() == 15.0 and not list(lm._merge(iter([])))
    monkeypatch.setattr(lm, "MERGED", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert np.isfinite(lm.fit(docs, rounds=2).flat()).all()
