"""Facets, the tag tree and the search language."""

import json

import pytest
from pyspark.sql import functions as F

from vitrine.operators import filters
from vitrine.plans import search

MEDIA = [(1, "/lib/a_b/x.JPG", "a_b"), (2, "/lib/axb/y.gif", "axb"), (3, "/LIB/a_b/z.mp4", "a_b"), (4, "C:\\lib\\a_b\\w.png", "a_b"), (5, "/lib/a_bc/v.webm", "a_bc")]


def ids(spark, condition, rows=MEDIA, schema="id long, file_path string, parent_folder string"):
    return [r.id for r in spark.createDataFrame(rows, schema).where(condition).orderBy("id").collect()]


def test_three_prefix_rules_differ(spark):
    assert ids(spark, filters.under_folder("/lib/a_b/")) == [1, 2, 3]  # _ is a wildcard, case is folded
    assert ids(spark, filters.under_folder("/lib/a_b", strict=True)) == [1]
    assert ids(spark, filters.queued_under(["/lib/a_b"])) == [1, 2, 3, 5]  # no separator
    assert ids(spark, filters.inside("/lib/a_b")) == [1]
    assert ids(spark, filters.queued_under([])) == [1, 2, 3, 4, 5]
    assert ids(spark, filters.under_folder("C:\\lib")) == [4]


def test_types_and_extensions(spark):
    assert ids(spark, filters.media_type_is("image")) == [1, 2, 4]
    assert ids(spark, filters.media_type_is("video")) == [3, 5]
    assert ids(spark, filters.media_type_is("sound")) == [1, 2, 3, 4, 5]
    assert ids(spark, filters.has_extension([".Jpg", "webm"])) == [1, 5]


@pytest.mark.parametrize("name,target,want", [("documents", "text_heavy", True), ("text_heavy", "document", True), ("party", "art", True), ("carpet", "animal", True), ("風景写真", "landscape", True), ("food", "tech", False), ("Cats", "cat", True), ("x", "unknown", False), ("smartphone", "illustration", True)])
def test_category_match(spark, name, target, want):
    assert spark.range(1).select(filters.category_matches(F.lit(name), target)).first()[0] is want


TAGS = [(1, [("Cat", "猫"), ("dog", None)]), (2, [("bird", "鳥")]), (3, [])]
SCHEMA = "id long, tags array<struct<name:string,name_ja:string>>"


def tagged(spark, tree=None, flat=None):
    return ids(spark, filters.tag_filter(tree, flat), TAGS, SCHEMA)


def test_tag_tree(spark):
    t = search.tag
    assert tagged(spark, json.dumps(t("cAT"))) == [1]
    assert tagged(spark, json.dumps(t("猫"))) == [1]
    assert tagged(spark, json.dumps(t(""))) == [1]  # a tag without a label
    assert tagged(spark, json.dumps({"type": "not", "child": t("cat")})) == [2, 3]
    assert tagged(spark, json.dumps({"type": "and", "children": []})) == [1, 2, 3]
    assert tagged(spark, json.dumps({"type": "or", "children": []})) == []
    assert tagged(spark, "", ["cat"]) == [1, 2, 3]
    assert tagged(spark, "{broken", ["cat"]) == [1, 2, 3]
    assert tagged(spark, '{"type":"xor"}', ["cat"]) == [1, 2, 3]
    assert tagged(spark, None, ["cat", "DOG"]) == [1]
    assert tagged(spark) == [1, 2, 3]


def test_search_language():
    t = search.tag
    assert search.parsed("") is None
    assert search.parsed("#a") == t("a")
    assert search.parsed("a b") == {"type": "and", "children": [t("a"), t("b")]}
    assert search.parsed("a OR b c") == {"type": "or", "children": [t("a"), {"type": "and", "children": [t("b"), t("c")]}]}
    assert search.parsed("NOT (a OR #b)") == {"type": "not", "child": {"type": "or", "children": [t("a"), t("b")]}}
    assert search.parsed('"red car" a') == {"type": "and", "children": [t("red car"), t("a")]}
    assert search.parsed("(a OR b") == {"type": "or", "children": [t("a"), t("b")]}
    assert search.parsed("a AND") == t("a")
    assert search.parsed("OR") is None
    assert search.parsed("and") == t("and")


def test_groups_and_text():
    g = search.Group
    tree = search.from_groups([g("or", ["a", "b"]), g("not", ["c", "d"]), g("and", ["e"]), g("and", [])])
    assert search.text_of(tree) == "(#a OR #b) AND NOT (#c OR #d) AND #e"
    assert search.parsed(search.text_of(tree)) == tree
    assert search.from_groups([]) is None
    assert search.combined("a OR b", ["x y", "z"]) == '(a OR b) AND "x y" AND #z'
    assert search.combined("", ["z"]) == "#z"
