"""Compare a registered query with its SQL in DuckDB, as sorted rows."""

import duckdb


def same_rows(spark, queries, oracles, name, sf="0.001"):
    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(oracles[name])
    names = sorted(c[0] for c in want.description)
    index = {c[0]: k for k, c in enumerate(want.description)}
    want = sorted([tuple(r[index[c]] for c in names) for r in want.fetchall()], key=repr)
    got = queries[name](spark, d)
    assert sorted(got.columns) == names
    got = sorted([tuple(r[c] for c in names) for r in got.collect()], key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
    return got
