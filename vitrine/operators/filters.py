"""Facets of the media query as Columns, and the boolean tag tree compiled to one."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import scalar as S

#: Target category -> parts of the normalised name, parts of the raw name.
CATEGORY_PARTS: dict[str, tuple[list[str], list[str]]] = {
    "screenshot": (["screenshot"], ["スクリーンショット"]),
    "document": (["document", "text"], ["書類", "文書"]),
    "landscape": (["landscape", "scenery"], ["風景", "自然"]),
    "food": (["food", "dish"], ["料理", "食べ物"]),
    "character": (["character"], ["キャラクター"]),
    "animal": (["animal", "pet"], ["動物", "ペット"]),
    "person": (["person", "people", "human"], ["人物", "顔写真"]),
    "item_product": (["item", "product", "goods"], ["商品", "雑貨"]),
    "item": (["item", "product", "goods"], ["商品", "雑貨"]),
    "product": (["item", "product", "goods"], ["商品", "雑貨"]),
    "art_illustration": (["art", "illustration"], ["イラスト"]),
    "art": (["art", "illustration"], ["イラスト"]),
    "illustration": (["art", "illustration"], ["イラスト"]),
    "text_heavy": (["text", "doc"], ["文字"]),
    "tech": (["tech", "code"], ["技術"]),
    "other": (["other"], ["その他"]),
}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def parent_is(folder: str) -> Column:
    return F.col("parent_folder") == folder


def under_folder(folder: str, strict: bool = False) -> Column:
    """Below a scan folder: a LIKE prefix without regard to ASCII case, wildcards in it alive.

    strict: a plain prefix in which % and _ mean themselves.
    """
    bare = folder.replace("\\", "/").rstrip("/")
    path = S.forward_slashes("file_path")
    if strict:
        return path.startswith(bare + "/") | (path == bare)
    low = bare.translate(str.maketrans(S.UPPER, S.LOWER))
    return S.ascii_lower(path).like(low + "/%") | (path == bare)


def queued_under(folders: list[str]) -> Column:
    """The scan queue's prefix test: no separator is added, so /a/b takes /a/bc too; no folders, all."""
    if not folders:
        return F.lit(True)
    path = S.ascii_lower("file_path")
    low = str.maketrans(S.UPPER, S.LOWER)
    forms = [(f, f.replace("\\", "/").translate(low), f.replace("/", "\\").replace("\\", "\\\\").translate(low)) for f in folders]
    return _any([path.like(a + "%") | path.like(b + "%") | parent_is(f) for f, a, b in forms])


def inside(folder: str) -> Column:
    """Below a folder by whole path components, for its removal."""
    bare = folder.rstrip("/") or "/"
    return (F.col("file_path") == bare) | F.col("file_path").startswith(bare if bare == "/" else bare + "/")


def status_is(status: str) -> Column:
    return F.lower("analysis_status") == status.lower()


def media_type_is(kind: str) -> Column:
    suffixes = {"image": S.FILTER_IMAGES, "video": S.FILTER_VIDEOS}.get(kind)
    return F.lit(True) if suffixes is None else has_extension(suffixes)


def has_extension(extensions: list[str]) -> Column:
    path = S.ascii_lower("file_path")
    return _any([path.like("%." + e.lstrip(".").lower()) for e in extensions])


def category_matches(name: Column, target: str) -> Column:
    """Equal after normalisation or but for ASCII case, or holds one of the target's parts."""
    norm, want = S.normalize_tag(name), S.normalize_tag(F.lit(target))
    out = (norm == want) | S.ascii_equal(name, F.lit(target))
    for key, (english, japanese) in CATEGORY_PARTS.items():
        out = out | ((want == key) & (S.any_of(norm, english) | S.any_of(name, japanese)))
    return out


def in_categories(targets: list[str], categories: str | Column = "categories") -> Column:
    one = lambda target: F.exists(S.col(categories), lambda c: category_matches(c, target))
    return _any([one(t) for t in targets])


def has_tag(value: str, tags: str | Column = "tags") -> Column:
    """Some tag's name equals value but for ASCII case, or its label is value (no label: '')."""
    return F.exists(S.col(tags), lambda t: S.ascii_equal(t["name"], F.lit(value)) | (F.coalesce(t["name_ja"], F.lit("")) == value))


def compiled(node: dict, tags: str | Column = "tags") -> Column:
    """A tree of tag, and, or and not nodes as one Column. An empty and is true, an empty or false."""
    kind = node["type"]
    if kind == "tag":
        return has_tag(node["value"], tags)
    if kind == "and":
        return _all([compiled(c, tags) for c in node["children"]])
    if kind == "or":
        return _any([compiled(c, tags) for c in node["children"]])
    if kind == "not":
        return ~compiled(node["child"], tags)
    raise ValueError(f"no such node: {kind}")


def tag_filter(tree: str | None, flat: list[str] | None, tags: str | Column = "tags") -> Column:
    """The tree if one is given, even a blank or broken one (which filters nothing); else all of flat."""
    if tree is not None:
        try:
            return compiled(json.loads(tree), tags)
        except (ValueError, KeyError, TypeError):
            return F.lit(True)
    return _all([has_tag(v, tags) for v in flat or []])


def unanalyzed() -> Column:
    return (F.size("tags") == 0) & (F.size("categories") == 0)


def tag_list(tags: DataFrame, kind: str = "all", search: str = "") -> DataFrame:
    """Free tags of a kind whose name or label holds the search text, case aside."""
    out = tags.where(~F.col("is_category"))
    if kind != "all":
        out = out.where(F.col("tag_kind") == kind)
    if search:
        held = F.lower("name").contains(search.lower()) | F.coalesce(F.lower("name_ja").contains(search.lower()), F.lit(False))
        out = out.where(held)
    return out
