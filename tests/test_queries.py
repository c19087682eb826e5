"""Every registered query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from vitrine.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v if isinstance(v, (int, bool)) or v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(SQL[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in answer.fetchall()), key=repr)
    assert got == want


def test_components_and_suggestions_by_plain_search(spark):
    """Their SQL would be too slow over all words: the groups of merge_pairs' rows, found one by one."""
    near = {}
    for r in QUERIES["merge_pairs"](spark, DIR).collect():
        near.setdefault(r.id1, set()).add(r.id2)
        near.setdefault(r.id2, set()).add(r.id1)
    want, groups = {}, {}
    for start in sorted(near):
        open_ = [] if start in want else [start]
        while open_:
            x = open_.pop()
            if x not in want:
                want[x] = start
                groups.setdefault(start, []).append(x)
                open_ += near[x]
    assert {r.tag_id: r.group_id for r in QUERIES["merge_components"](spark, DIR).collect()} == want
    names = {r.id: r.name for r in QUERIES["tag_counts"](spark, DIR).collect()}
    listed = [sorted(g, key=lambda i: (len(names[i]), names[i], i)) for g in groups.values() if 2 <= len(g) <= 15]
    listed.sort(key=lambda g: (-len(g), g[0]))
    got = sorted(QUERIES["merge_suggestions"](spark, DIR).collect(), key=lambda r: int(r.id.rsplit("-", 1)[1]))
    assert [(r.target_id, r.sources) for r in got] == [(g[0], ",".join(names[i] for i in g[1:])) for g in listed]


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
