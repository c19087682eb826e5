"""Changes of tables, and scans."""

import pytest

from vitrine import schema
from vitrine.operators import ingest, mutations
from vitrine.operators.mutations import Catalog

TAGS = [(1, "animal", None, True, "basic"), (2, "cat", "猫", False, "basic"), (3, "cats", None, False, "basic"), (4, "wet_cat", None, False, "descriptive"), (5, "lone", None, False, "basic")]


@pytest.fixture
def cat(spark):
    media = spark.createDataFrame([(i, f"/m/d/{i}.jpg", "d", "t" if i % 2 else "", 10 + i // 3, f"h{i // 3}", 100, ["completed", "pending", "failed"][i % 3], "e" if i % 3 == 2 else None, 1, 1) for i in range(1, 7)], schema.MEDIA)
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4)], schema.MEDIA_TAGS)
    return Catalog(media, spark.createDataFrame(TAGS, schema.TAGS), links)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_merge_moves_links_once_and_drops_orphans(spark, cat):
    out = mutations.merge_tags(cat, spark.createDataFrame([(3, 2), (2, 2)], "source long, target long"))
    assert rows(out.media_tags, "media_id", "tag_id") == [(1, 1), (1, 2), (2, 2), (3, 2), (3, 4)]
    assert rows(out.tags, "id") == [(1,), (2,), (4,)]


def test_merge_can_lose_its_target(spark, cat):
    out = mutations.merge_tags(cat, spark.createDataFrame([(5, 9)], "source long, target long"))
    assert rows(out.tags, "id") == [(1,), (2,), (3,), (4,)]


def test_upserts(spark, cat):
    pairs = spark.createDataFrame([("Cats", "ねこ"), ("Blue Sky", ""), ("", "x"), ("animal", "動物"), ("blue-sky", "空")], "en string, ja string")
    keep = mutations.upsert_tags(cat.tags, pairs)
    assert rows(keep.where("id IN (1, 2) OR id > 5"), "id", "name", "name_ja", "is_category") == [(1, "animal", "動物", True), (2, "cat", "猫", False), (6, "blue_sky", "空", False)]
    replaced = mutations.upsert_tags(cat.tags, pairs, labels="replace")
    assert rows(replaced.where("id = 2"), "name_ja") == [("ねこ",)]
    blank = mutations.upsert_tags(cat.tags, spark.createDataFrame([("cat", "")], "en string, ja string"), labels="blank")
    assert rows(blank.where("id = 2"), "name_ja") == [("",)]
    cats = mutations.upsert_categories(cat.tags, spark.createDataFrame([(" Cats ",), ("new",)], "name string"))
    assert rows(cats.where("is_category"), "id", "name") == [(1, "animal"), (3, "cats"), (6, "new")]


def test_single_tag_changes(spark, cat):
    with pytest.raises(ValueError):
        mutations.get_or_create_tag(cat.tags, " !! ")
    assert rows(mutations.get_or_create_tag(cat.tags, "Wet Cats", "濡"), "id", "name_ja")[3] == (4, "濡")
    with pytest.raises(ValueError):
        mutations.rename_tag(cat.tags, 2, "cats", None)
    assert rows(mutations.rename_tag(cat.tags, 2, "Kitty", None).where("id = 2"), "name") == [("Kitty",)]
    out = mutations.remove_tag(cat, 3, 4)
    assert (4,) not in rows(out.tags, "id") and (5,) in rows(out.tags, "id")
    added = mutations.add_tag(cat, 6, "Blue")
    assert (6, 6) in rows(added.media_tags, "media_id", "tag_id")


def test_resets_and_folders(spark, cat):
    assert rows(mutations.reset_failed(cat.media).where("analysis_status = 'pending'"), "id", "analysis_error") == [(1, None), (2, None), (4, None), (5, None)]
    assert mutations.reset_all(cat).media_tags.count() == 0
    out = mutations.remove_folder(cat, "/m/d")
    assert out.media.count() == 0 and out.media_tags.count() == 0 and out.tags.count() == 5
    some = mutations.reset_media(cat.media, spark.createDataFrame([(3,)], "id long"))
    assert rows(some.where("id = 3"), "analysis_status") == [("pending",)]
    done = mutations.mark_results(cat.media, spark.createDataFrame([(1, None), (4, "bad")], "media_id long, error string"))
    assert rows(done.where("id IN (1, 4)"), "id", "analysis_status", "analysis_error") == [(1, "completed", None), (4, "failed", "bad")]


def test_suggestion_mapping(spark):
    s = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4, 5]), ("c", [6, 7])], "id string, members array<long>")
    d = spark.createDataFrame([("a", True, False, 2, [3]), ("b", True, True, None, None), ("c", True, False, None, [7])], "id string, accepted boolean, rejected boolean, master long, excluded array<long>")
    assert rows(mutations.suggestion_mapping(s, d), "source", "target") == [(1, 2)]


def test_scan_states(spark):
    old = [(1, "a", "completed", 5, "t"), (2, "b", "completed", 5, ""), (3, "c", "completed", 4, "t"), (4, "d", "pending", 5, "t"), (5, "e", "pending", 5, ""), (6, "f", "failed", 5, "t")]
    media = spark.createDataFrame([(i, p, "d", t, 1, "h", m, s, "err" if s == "failed" else None, 1, 1) for i, p, s, m, t in old], schema.MEDIA)
    listing = spark.createDataFrame([(p, "d", 2, "n", 5, "new") for p in "abcdefg"] + [("g", "d", 2, "n", 5, "new")], "file_path string, parent_folder string, file_size long, file_hash string, file_modified_at long, thumbnail_path string")
    got = dict(rows(ingest.transitions(media, listing), "file_path", "action"))
    assert got == {"a": "keep", "b": "thumb", "c": "update", "d": "skip", "e": "update", "f": "update", "g": "insert"}
    out = {r.file_path: r for r in ingest.scanned(media, listing, 9).collect()}
    assert out["b"].thumbnail_path == "new" and out["b"].file_size == 1
    assert out["c"].analysis_status == "pending" and out["c"].file_size == 2
    assert out["f"].analysis_status == "pending" and out["f"].analysis_error == "err"
    assert out["g"].id == 7 and out["g"].analysis_status == "pending"


def test_moves_pair_one_to_one(spark, cat):
    listing = spark.createDataFrame([("/m/n/a.jpg", "n", 11, "h1", 1), ("/m/n/b.jpg", "n", 11, "h1", 1), ("/m/d/1.jpg", "d", 10, "h0", 1), ("/m/n/b.jpg", "n", 11, "h1", 1)], "file_path string, parent_folder string, file_size long, file_hash string, file_modified_at long")
    assert rows(ingest.moves(cat.media, listing), "id", "new_path") == [(3, "/m/n/a.jpg"), (4, "/m/n/b.jpg")]
    out = ingest.synced(cat, listing, 5)
    assert rows(out.media, "id") == [(1,), (3,), (4,)]
    assert rows(out.tags, "id") == [(1,), (2,), (3,), (4,)]


def test_duplicates(spark, cat):
    assert rows(ingest.donors(cat.media), "id", "donor_id") == [(4, 3)]
    assert rows(ingest.leaders(cat.media), "id", "leader_id") == [(1, 1)]
    out = ingest.copied(cat)
    assert {(4, 3), (4, 4)} <= set(rows(out.media_tags, "media_id", "tag_id"))


def test_seeds_and_migration(spark):
    old = spark.createDataFrame([(1, "food"), (2, "x")], "id long, name string")
    seeded = schema.seeded_tags(schema.migrated_tags(old))
    assert seeded.count() == 13 and rows(seeded.where("name = 'food'"), "id", "is_category") == [(1, True)]
    assert schema.seeded_settings(spark.createDataFrame([("tag_granularity", "balanced")], schema.SETTINGS)).count() == 22
    assert rows(mutations.set_setting(schema.empty(spark, schema.SETTINGS), "a", "b"), "key", "value") == [("a", "b")]
    f = mutations.add_folder(schema.empty(spark, schema.SCAN_FOLDERS), "/x", 1)
    assert mutations.add_folder(f, "/x", 2).count() == 1


def test_the_next_copy_leads_after_a_failure(spark):
    from pyspark.sql import functions as F

    from vitrine.operators import ingest
    from vitrine.operators.mutations import Catalog

    rows = [(1, "h", "pending"), (2, "h", "pending"), (3, "h", "pending"), (4, None, "pending"), (5, "g", "pending"), (6, "g", "pending"), (7, "d", "completed"), (8, "d", "pending")]
    media = spark.createDataFrame(rows, "id long, file_hash string, analysis_status string").withColumn("file_size", F.lit(1)).withColumn("analysis_error", F.lit(None).cast("string"))
    links = spark.createDataFrame([(7, 70)], "media_id long, tag_id long")
    asked = []

    def analyse(lead):
        ids = sorted(r.id for r in lead.select("id").collect())
        asked.append(ids)
        results = [(i, "broken" if i in (1, 5, 6) else None) for i in ids if i != 4]
        return spark.createDataFrame(results, "media_id long, error string"), spark.createDataFrame([(i, 10 * i) for i in ids], "media_id long, tag_id long")

    out = ingest.analysed(Catalog(media=media, tags=spark.range(0), media_tags=links), analyse)
    assert asked == [[1, 4, 5], [2, 6]]
    assert {r.id: (r.analysis_status, r.analysis_error) for r in out.media.collect()} == {
        1: ("failed", "broken"), 2: ("completed", None), 3: ("completed", None), 4: ("failed", "no answer"), 5: ("failed", "broken"), 6: ("failed", "broken"), 7: ("completed", None), 8: ("completed", None),
    }
    assert sorted(map(tuple, out.media_tags.select("media_id", "tag_id").collect())) == [(2, 20), (3, 20), (7, 70), (8, 70)]
