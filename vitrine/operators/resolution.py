"""Merge suggestions: pairs of alike tags by five rules, their components, ranked groups.

No rule compares all pairs: each has keys on which alike tags must meet, so each is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.operators.graph import components
from vitrine.operators.spelling import close_names
from vitrine.sources.shared import written

LEAST, MOST = 2, 15
WORDY = 19
#: Rows that may be broadcast, by their count; with more of them joins shuffle.
BROADCAST_ROWS = 1_000_000
DEFAULT_REASON = "類似タググループ"


def featured(counts: DataFrame) -> DataFrame:
    """Free tags in use with their rank in the list, normalised name, words and trimmed label."""
    free = counts.where(~F.col("is_category") & (F.col("count") > 0))
    order = Window.orderBy(F.desc("count"), F.coalesce("name_ja", "name"), "id")
    ja = S.trim("name_ja")
    return free.select("id", "name", "name_ja", "count", "kind", F.row_number().over(order).alias("rank"), S.normalize_tag("name").alias("norm"), S.tag_words("name").alias("words"), F.when(ja != "", ja).alias("ja"))


def _paired(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows of one kind that share keys, the earlier in rank first."""
    keys = [*on, "kind"]
    left = a.select(*[F.col(c).alias(f"{c}1") if c not in keys else F.col(c) for c in a.columns])
    right = b.select(*[F.col(c).alias(f"{c}2") if c not in keys else F.col(c) for c in b.columns])
    return left.join(right, keys).where("rank1 < rank2")


def _segments(n: Column, k: int) -> Column:
    """k + 1 segments of a length-n name: (place, begin, length)."""
    parts = k + 1
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("place"), F.floor(i * n / parts).cast("int").alias("begin"), (F.floor((i + 1) * n / parts) - F.floor(i * n / parts)).cast("int").alias("size")))


def _shorter(names: Column) -> Column:
    """All texts that lack one character of a list's texts."""
    without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))
    return F.array_distinct(F.flatten(F.transform(F.filter(names, lambda s: s != ""), without)))


def deletion_candidates(tags: DataFrame, k: int, least: int = 0) -> DataFrame:
    """(rank1, rank2) of names within k edits, one of them of `least` characters or more: what the edits
    leave is found in both by deleting k characters at most, and has least - k or more. More pairs may come."""
    n = F.length("name")
    rows = tags.select("rank", "kind", F.array("name").alias("level0"), (n - (least - k)).alias("may")).where("may >= 0")
    for i in range(1, k + 1):
        rows = rows.withColumn(f"level{i}", F.when(F.col("may") >= i, _shorter(F.col(f"level{i - 1}"))).otherwise(F.array().cast("array<string>")))
    rows = rows.select("rank", F.explode(F.concat(*[f"level{i}" for i in range(k + 1)])).alias("left"), "kind").select("rank", F.xxhash64("kind", "left").alias("left"))
    a, b = rows.toDF("rank1", "left"), rows.toDF("rank2", "left")
    # the planner takes exploded rows for as few as the tags they come from, and would broadcast them
    return a.join(b.hint("merge"), "left").where("rank1 < rank2").select("rank1", "rank2").distinct()


def edit_candidates(tags: DataFrame, k: int, others: DataFrame | None = None) -> DataFrame:
    """(rank1, rank2) of names within k edits, and more: one of k + 1 segments of one name stands in
    the other, shifted by k at most. others: pairs with one of these are enough."""
    n = F.length("name")
    of = tags if others is None else others
    own = of.select("rank", "kind", n.alias("n"), "name", F.explode(_segments(n, k)).alias("s")).select(F.col("rank").alias("ra"), "kind", "n", F.col("s.place").alias("place"), F.col("name").substr(F.col("s.begin") + 1, F.col("s.size")).alias("part"))
    probes = tags.select("rank", "kind", "name", F.explode(F.sequence(F.greatest(n - k, F.lit(1)), n + k)).alias("n"))
    probes = probes.join(of.select("kind", n.alias("n")).distinct(), ["kind", "n"], "left_semi")
    probes = probes.select("rank", "kind", "name", "n", F.explode(_segments(F.col("n"), k)).alias("s"))
    probes = probes.select("rank", "kind", "name", "n", "s", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("shift"))
    begin = F.col("s.begin") + F.col("shift")
    probes = probes.where((begin >= 0) & (begin + F.col("s.size") <= F.length("name")))
    probes = probes.select(F.col("rank").alias("rb"), "kind", "n", F.col("s.place").alias("place"), F.col("name").substr(begin + 1, F.col("s.size")).alias("part")).distinct()
    met = own.join(probes.hint("merge"), ["kind", "n", "place", "part"]).where("ra <> rb")
    return met.select(F.least("ra", "rb").alias("rank1"), F.greatest("ra", "rb").alias("rank2")).distinct()


def spelled(long: DataFrame, connected: bool = False) -> DataFrame:
    """(rank1, rank2, dist) of names one edit apart, or three where one has eight bytes or more, each pair once.

    Names of bytes only and at most WORDY long meet block against block, or by what a deletion leaves where both
    have fewer than eight; pairs with a longer one, whose segments are long, or one with wider characters meet by segments.
    connected: of the first, stars that connect what the pairs do.
    """
    n, size = F.length("name"), F.octet_length("name")
    plain = (size == n) & (n <= WORDY)
    words, others, five = long.where(plain), long.where(~plain), size >= 5
    met = deletion_candidates(words.where(n < 8), 1).union(edit_candidates(long, 1, others)).union(edit_candidates(long.where(five), 3, others.where(five))).distinct()
    names = long.select("rank", "name")
    got = met.join(names.toDF("rank1", "name1"), "rank1").join(names.toDF("rank2", "name2"), "rank2")
    got = got.withColumn("dist", F.levenshtein("name1", "name2", 3))
    a, b = F.octet_length("name1"), F.octet_length("name2")
    got = got.where((F.abs(a - b) <= 3) & ((F.col("dist") == 1) | (F.col("dist").between(0, 3) & (F.greatest(a, b) >= 8))))
    return close_names(words, connected).unionByName(got.select("rank1", "rank2", "dist"))


def _spelt(tags: DataFrame) -> DataFrame:
    return tags.select("rank", "kind", "name").where(F.octet_length("name") >= 4)


def _counted(rows: DataFrame) -> DataFrame:
    """rows (a table that has been written), to be broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def identified(found: DataFrame, tags: DataFrame) -> DataFrame:
    """found with ids (id1, id2) for ranks (rank1, rank2)."""
    ids, rest = _counted(tags.select("rank", "id")), [c for c in found.columns if c not in ("rank1", "rank2")]
    return found.join(ids.toDF("rank1", "id1"), "rank1").join(ids.toDF("rank2", "id2"), "rank2").select("id1", "id2", *rest)


def rule_pairs(tags: DataFrame, rule: str) -> DataFrame:
    """(rank1, rank2, reason) of one rule, a to e; tags as from featured()."""
    slim = tags.select("rank", "kind", "name", "norm", "words", "ja")
    if rule == "a":
        got = _paired(slim, slim, ["ja"]).where("ja IS NOT NULL")
        reason = F.concat(F.lit("同一日本語表記 ("), "ja", F.lit(")"))
    elif rule == "b":
        got = _paired(slim, slim, ["norm"])
        reason = F.concat(F.lit("単数形・表記統一 ("), "norm", F.lit(")"))
    elif rule == "c":
        words = slim.withColumn("word", F.explode(F.array_distinct("words")))
        got = _paired(words, words, ["word"]).dropDuplicates(["rank1", "rank2"]).withColumn("common", S.common_words("words1", "words2"))
        got = got.where((F.size("common") >= 2) | ((F.size("common") == 1) & (F.octet_length(F.get("common", F.lit(0))) >= 7)))
        reason = F.concat(F.lit("共通キーフレーズ ("), F.array_join("common", ", "), F.lit(")"))
    elif rule == "d":
        long = slim.where(F.length("ja") >= 4).withColumn("head", F.substring("ja", 1, 4))
        got = _paired(long, long, ["head"])
        reason = F.concat(F.lit("類似日本語表記 ("), S.common_prefix("ja1", "ja2"), F.lit(")"))
    elif rule == "e":
        got = spelled(_spelt(tags))
        reason = F.concat(F.lit("類似スペル (編集距離 "), F.col("dist").cast("string"), F.lit(")"))
    else:
        raise ValueError(f"no such rule: {rule}")
    return got.select("rank1", "rank2", reason.alias("reason"))


def pairs(tags: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(id1, id2, rule, reason): the first rule of each pair. extra: pairs (id1, id2) told by a model."""
    rules = None
    for rule in "abcd":
        got = rule_pairs(tags, rule).withColumn("rule", F.lit(rule))
        rules = got if rules is None else rules.unionByName(got)
    first = written(rules.groupBy("rank1", "rank2").agg(F.min(F.struct("rule", "reason")).alias("first")).select("rank1", "rank2", "first.rule", "first.reason"), "first-pairs")
    # spelling gives each pair once and by far the most, so they are not grouped
    spelt = rule_pairs(tags, "e").join(_counted(first.select("rank1", "rank2")), ["rank1", "rank2"], "left_anti")
    out = identified(first.unionByName(spelt.withColumn("rule", F.lit("e"))), tags).select("id1", "id2", "rule", "reason")
    if extra is not None:
        kinds = tags.select("id", "kind")
        told = extra.where("id1 <> id2").join(kinds.toDF("id1", "k1"), "id1").join(kinds.toDF("id2", "k2"), "id2").where("k1 = k2")
        key = lambda d: d.select(F.least("id1", "id2").alias("x"), F.greatest("id1", "id2").alias("y"))
        new = key(told).distinct().join(key(out), ["x", "y"], "left_anti")
        out = out.unionByName(new.select(F.col("x").alias("id1"), F.col("y").alias("id2"), F.lit("llm").alias("rule"), F.lit("LLM同義語判定").alias("reason")))
    return out


def linked(tags: DataFrame) -> DataFrame:
    """(id1, id2) that connect whatever the pairs of the rules connect: where spelling makes many pairs, stars instead."""
    edges = spelled(_spelt(tags), connected=True).select("rank1", "rank2")
    for rule in "abcd":
        edges = edges.union(rule_pairs(tags, rule).select("rank1", "rank2"))
    return identified(edges, tags)


def groups(found: DataFrame) -> DataFrame:
    """(tag_id, group_id) of all components of pairs."""
    return components(found, "id1", "id2").select(F.col("node").alias("tag_id"), F.col("component").alias("group_id"))


def summary(reasons: Column) -> Column:
    n = F.size(reasons)
    return F.when(n > 3, F.concat(F.array_join(F.slice(reasons, 1, 3), " / "), F.lit(" など他"), (n - 3).cast("string"), F.lit("件"))).when(n > 0, F.array_join(reasons, " / ")).otherwise(DEFAULT_REASON)


def suggestions(tags: DataFrame, found: DataFrame, media: DataFrame, media_tags: DataFrame) -> DataFrame:
    """Groups of 2 to 15 tags, largest first: id, target, sources, reason, samples and image count.

    The target has the shortest name in bytes; ties go by name, then id. Groups of equal size are
    ordered by the target's id.
    """
    members = groups(found)
    told = found.select(F.col("id1").alias("tag_id"), "reason").union(found.select(F.col("id2").alias("tag_id"), "reason"))
    why = told.join(members, "tag_id").groupBy("group_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    size = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(LEAST, MOST))
    kept = members.join(size, "group_id")
    item = F.struct(F.octet_length("name").alias("bytes"), "name", "id", "name_ja", "count", "kind")
    listed = kept.join(tags, F.col("tag_id") == F.col("id")).groupBy("group_id", "n").agg(F.array_sort(F.collect_list(item)).alias("items"))
    used = kept.join(media_tags, "tag_id").join(media.select(F.col("id").alias("media_id"), "thumbnail_path"), "media_id")
    thumb = F.when(F.col("thumbnail_path") != "", F.col("thumbnail_path"))
    images = used.groupBy("group_id").agg(F.countDistinct("media_id").alias("total_images_count"), F.slice(F.array_sort(F.collect_set(thumb)), 1, 5).alias("sample_thumbnails"))
    out = listed.join(why, "group_id").join(images, "group_id", "left")
    order = Window.orderBy(F.desc("n"), F.col("items")[0]["id"])
    return out.select(
        F.concat(F.lit("group-sug-"), (F.row_number().over(order) - 1).cast("string")).alias("id"),
        F.col("items")[0].alias("target"),
        F.slice("items", 2, MOST).alias("sources"),
        F.transform("items", lambda x: x["id"]).alias("members"),
        summary(F.col("reasons")).alias("reason"),
        F.lit("high").alias("confidence"),
        F.coalesce("sample_thumbnails", F.array().cast("array<string>")).alias("sample_thumbnails"),
        F.coalesce("total_images_count", F.lit(0)).cast("long").alias("total_images_count"),
    )
