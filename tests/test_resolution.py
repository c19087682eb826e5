"""Merge suggestions against the plain all-pairs rule."""

import itertools
import random

from vitrine.operators import graph, resolution, spelling

NAMES = [("smart_phone", None), ("smartphone", None), ("cat", "猫"), ("cats", None), ("kitty", "猫"), ("mountain_lake", None), ("mountain_view_lake", None), ("boardx", "開発ボードA"), ("boardy", "開発ボードB"), ("tree", None), ("tres", None), ("abcdefgh", None), ("abcdxfgy", None), ("zebra", "しま")]


def features(spark):
    rows = [(i, n, ja, False, 50 - i, "descriptive" if n == "zebra" else "basic") for i, (n, ja) in enumerate(NAMES, 1)] + [(99, "animal", None, True, 5, "basic"), (98, "unused", None, False, 0, "basic")]
    return resolution.featured(spark.createDataFrame(rows, "id long, name string, name_ja string, is_category boolean, count long, kind string"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_candidates_lose_nothing(spark):
    tags = features(spark)
    got = {(r.rank1, r.rank2) for k in (1, 3) for r in resolution.edit_candidates(tags, k).collect()}
    rows = {r["rank"]: r for r in tags.collect()}
    for a, b in itertools.combinations(sorted(rows), 2):
        d = distance(rows[a].name, rows[b].name)
        if rows[a].kind == rows[b].kind and d <= 3:
            assert (a, b) in got, (rows[a].name, rows[b].name)


def test_spelling_loses_nothing(spark):
    draw = random.Random(5)
    names = {"".join(draw.choices("abc", k=draw.randint(4, 23))) for _ in range(60)}
    for name in sorted(names):
        at = draw.randrange(len(name))
        names |= {name[:at] + name[at + 1 :], name[:at] + "bca" + name[at:], name[:at] + "é" + name[at + 1 :]}
    names = sorted(x for x in names if len(x.encode()) >= 4)
    rows = [(i, x, "basic" if i % 7 else "descriptive") for i, x in enumerate(names)]
    got = {(r.rank1, r.rank2) for r in resolution.spelled(spark.createDataFrame(rows, "rank int, name string, kind string")).collect()}
    for (i, x, k), (j, y, m) in itertools.combinations(rows, 2):
        a, b = len(x.encode()), len(y.encode())
        if k == m and abs(a - b) <= 3 and abs(len(x) - len(y)) <= 3:
            d = distance(x, y)
            if d == 1 or d <= 3 and max(a, b) >= 8:
                assert (i, j) in got, (x, y)


def test_pairs_take_the_first_rule(spark):
    found = {(r.id1, r.id2): (r.rule, r.reason) for r in resolution.pairs(features(spark)).collect()}
    assert found[3, 5] == ("a", "同一日本語表記 (猫)")
    assert found[3, 4] == ("b", "単数形・表記統一 (cat)")
    assert found[6, 7] == ("c", "共通キーフレーズ (mountain, lake)")
    assert found[8, 9] == ("d", "類似日本語表記 (開発ボード)")
    assert found[1, 2] == ("e", "類似スペル (編集距離 1)")
    assert found[10, 11][0] == "e" and found[12, 13][0] == "e"
    assert not any(14 in k for k in found)


def test_suggestions(spark):
    tags = features(spark)
    extra = spark.createDataFrame([(10, 12), (14, 1)], "id1 long, id2 long")
    found = resolution.pairs(tags, extra)
    assert {(r.id1, r.id2) for r in found.where("rule = 'llm'").collect()} == {(10, 12)}
    media = spark.createDataFrame([(1, "t1"), (2, ""), (3, "t3")], "id long, thumbnail_path string")
    links = spark.createDataFrame([(1, 3), (1, 4), (2, 5), (3, 6)], "media_id long, tag_id long")
    got = {r.target.name: r for r in resolution.suggestions(tags, found, media, links).collect()}
    cats = got["cat"]
    assert [s.name for s in cats.sources] == ["cats", "kitty"]
    assert (cats.total_images_count, cats.sample_thumbnails, cats.confidence) == (2, ["t1"], "high")
    assert cats.reason == "単数形・表記統一 (cat) / 同一日本語表記 (猫)"
    assert got["tree"].id == "group-sug-0"


def test_groups_over_fifteen_are_dropped(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 16)], "id1 long, id2 long")
    assert resolution.groups(chain).where("group_id = 1").count() == 16


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_close_names_are_all_there_once(spark):
    draw = random.Random(7)
    names = {"".join(draw.choices("abcd", k=draw.randint(5, 19))) for _ in range(150)}
    for name in sorted(names):
        chars = list(name)
        for _ in range(draw.randint(1, 4)):
            at = draw.randrange(len(chars))
            chars[at : at + 1] = draw.choice([[], [draw.choice("abcd")], [chars[at], "d"]])
        names.add("".join(chars[:19]))
    rows = [(i, x, "basic" if i % 5 else "descriptive") for i, x in enumerate(sorted(x for x in names if len(x) >= 5))]
    want = sorted((i, j, distance(x, y)) for (i, x, k), (j, y, m) in itertools.combinations(rows, 2) if k == m and max(len(x), len(y)) >= 8 and distance(x, y) <= 3)
    assert len(want) > 100
    tags = spark.createDataFrame(rows, "rank int, name string, kind string")
    for block in (1000, 90, 60):
        assert sorted(tuple(r) for r in spelling.close_names(tags, block=block).collect()) == want
    linked = spelling.close_names(tags, connected=True, block=60)
    whole = {r.node: r.component for r in graph.components(spark.createDataFrame([w[:2] for w in want], "a long, b long")).collect()}
    assert {r.node: r.component for r in graph.components(linked, "rank1", "rank2").collect()} == whole
    assert spelling.close_names(tags.limit(0)).count() == 0


def test_exploded_rows_are_never_broadcast(spark, tmp_path):
    """The planner takes what names explode into for as few bytes as the names."""
    features(spark).write.parquet(str(tmp_path / "tags"))
    tags = spark.read.parquet(str(tmp_path / "tags"))
    assert "Broadcast" not in resolution.deletion_candidates(tags, 3)._jdf.queryExecution().executedPlan().toString()
    plan = resolution.edit_candidates(tags, 3)._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "part#" in line for line in plan.splitlines())


def test_linked_connects_what_pairs_do(spark):
    draw = random.Random(3)
    names = sorted({"".join(draw.choices("ab", k=draw.randint(9, 12))) for _ in range(40)})
    rows = [(i, n, None, False, 1, "basic") for i, n in enumerate(names, 1)]
    tags = resolution.featured(spark.createDataFrame(rows, "id long, name string, name_ja string, is_category boolean, count long, kind string"))
    groups = [{tuple(r) for r in resolution.groups(f(tags)).collect()} for f in (resolution.pairs, resolution.linked)]
    assert groups[0] == groups[1] and groups[0]
    assert resolution.linked(tags).count() < resolution.pairs(tags).count() / 2
