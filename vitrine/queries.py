"""Registered queries of the catalogue engine and, beside each, its SQL for DuckDB.

Each query runs an operator over the whole derived catalogue. Arrays are compared as joined text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.operators import analysis, catalog, filters, ingest, mutations, reports, resolution
from vitrine.plans import derived, search
from vitrine.plans.sql_catalog import CATALOG
from vitrine.sources import json_files, settings
from vitrine.sources.shared import written
from vitrine.schema import SETTINGS, empty, migrated_tags, seeded_settings, seeded_tags
from vitrine.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_catalog: bool = True):
    """Registers a query, and SQL that follows the catalogue's table expressions."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            SQL[name] = (CATALOG + (", " if body.startswith("x1 AS") else "\n") + body) if with_catalog else body
        return f

    return add


TAG_COLUMNS = "id, name, name_ja, is_category, count, kind"


@query("tag_counts", f"SELECT {TAG_COLUMNS}, CAST(row_number() OVER (ORDER BY is_category DESC, count DESC, coalesce(name_ja, name), id) AS BIGINT) AS place FROM counts")
def tag_counts(spark, d):
    cat = derived.catalog(spark, d)
    counts = catalog.tag_counts(cat.tags, cat.media_tags)
    w = catalog.Window.orderBy(F.desc("is_category"), F.desc("count"), F.coalesce("name_ja", "name"), "id")
    return counts.withColumn("place", F.row_number().over(w).cast("long"))


@query("tag_by_name", f"SELECT {TAG_COLUMNS} FROM counts WHERE name = 'animal'")
def tag_by_name(spark, d):
    cat = derived.catalog(spark, d)
    return catalog.tag_by_name(cat.tags, cat.media_tags, "animal")


@query("orphan_tags", "SELECT id, name FROM counts WHERE NOT is_category AND count = 0")
def orphan_tags(spark, d):
    cat = derived.catalog(spark, d)
    return catalog.orphan_tags(cat.tags, cat.media_tags).select("id", "name")


@query("parent_folders", "SELECT DISTINCT parent_folder FROM media WHERE parent_folder <> ''")
def parent_folders(spark, d):
    return catalog.parent_folders(derived.media(spark, d))


@query("media_by_tag", "SELECT id, file_path FROM media WHERE id IN (SELECT media_id FROM media_tags WHERE tag_id = 13)")
def media_by_tag(spark, d):
    cat = derived.catalog(spark, d)
    return catalog.media_by_tag(cat.media, cat.media_tags, 13).select("id", "file_path")


ITEM_SQL = "SELECT id, file_path, analysis_status, array_to_string(categories, ',') AS categories, array_to_string(tags, ',') AS tags FROM items WHERE "
AFOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _items(spark, d, **facets) -> DataFrame:
    cat = derived.catalog(spark, d)
    got = catalog.get_media(cat.media, cat.tags, cat.media_tags, catalog.MediaQuery(**facets))
    return got.select("id", "file_path", "analysis_status", F.array_join("categories", ",").alias("categories"), F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("tags"))


@query("media_items", ITEM_SQL + "TRUE")
def media_items(spark, d):
    return _items(spark, d)


@query("media_filter_parent", ITEM_SQL + "parent_folder = 'fr'")
def media_filter_parent(spark, d):
    return _items(spark, d, parent_folder="fr")


@query("media_filter_folder", ITEM_SQL + "lower(file_path) LIKE '/lib/src1/%' OR file_path = '/Lib/SRC1'")
def media_filter_folder(spark, d):
    return _items(spark, d, scan_folder="\\Lib\\SRC1")


@query("media_filter_status", ITEM_SQL + "lower(analysis_status) = 'failed'")
def media_filter_status(spark, d):
    return _items(spark, d, status="FAILED")


@query("media_filter_type", ITEM_SQL + "regexp_matches(lower(file_path), '[.](mp4|mkv|avi|mov|webm|flv|wmv)$')")
def media_filter_type(spark, d):
    return _items(spark, d, media_type="video")


@query("media_filter_ext", ITEM_SQL + "lower(file_path) LIKE '%.jpg' OR lower(file_path) LIKE '%.gif'")
def media_filter_ext(spark, d):
    return _items(spark, d, extensions=[".JPG", "gif"])


@query("media_filter_category", ITEM_SQL + "len(list_filter(categories, lambda c: contains(c, 'text') OR contains(c, 'doc') OR c = 'food' OR contains(c, 'dish'))) > 0")
def media_filter_category(spark, d):
    return _items(spark, d, categories=["text_heavy", "Food"])


def _has(value: str) -> str:
    low = value.lower()
    return f"(len(list_filter(tags, lambda t: lower(t) = '{low}')) > 0 OR list_contains(labels, '{value}'))"


TREE = {"type": "and", "children": [{"type": "or", "children": [{"type": "tag", "value": "Oneneneron"}, {"type": "tag", "value": "tion"}, {"type": "tag", "value": ""}]}, {"type": "not", "child": {"type": "tag", "value": "ecb7ed1"}}]}


@query("media_filter_tree", ITEM_SQL + f"({_has('Oneneneron')} OR {_has('tion')} OR {_has('')}) AND NOT {_has('ecb7ed1')}")
def media_filter_tree(spark, d):
    return _items(spark, d, tree=json.dumps(TREE), tags=["ignored beside a tree"])


@query("media_filter_tree_broken", ITEM_SQL + "parent_folder = 'en'")
def media_filter_tree_broken(spark, d):
    return _items(spark, d, tree="", tags=["ignored"], parent_folder="en")


@query("media_filter_flat", ITEM_SQL + "len(list_filter(tags, lambda t: t LIKE 'standard%')) >= 0 AND list_contains(labels, '') AND list_contains(labels, '6b86b20')")
def media_filter_flat(spark, d):
    return _items(spark, d, tags=["", "6b86b20"])


@query("media_filter_combined", ITEM_SQL + "parent_folder = 'en' AND lower(analysis_status) = 'completed' AND regexp_matches(lower(file_path), '[.](jpg|jpeg|png|webp|bmp|gif)$') AND len(list_filter(categories, lambda c: contains(c, 'item') OR contains(c, 'product') OR contains(c, 'goods') OR contains(c, 'screenshot'))) > 0")
def media_filter_combined(spark, d):
    return _items(spark, d, parent_folder="en", status="completed", media_type="image", categories=["item", "screenshots"])


@query("search_language", ITEM_SQL + f"({_has('tion')} OR {_has('')}) AND NOT {_has('ecb7ed1')}")
def search_language(spark, d):
    """The parsed text query, as a tree."""
    return _items(spark, d, tree=json.dumps(search.parsed('(#tion OR "") NOT #ecb7ed1')))


@query("unanalyzed_media", "SELECT id, file_path FROM items WHERE len(categories) = 0 AND len(tags) = 0")
def unanalyzed_media(spark, d):
    cat = derived.catalog(spark, d)
    return catalog.get_media(cat.media, cat.tags, cat.media_tags, catalog.MediaQuery(status="unanalyzed")).select("id", "file_path")


@query("card_preview", "SELECT id, array_to_string(tags[1:3], ',') AS preview, CAST(greatest(len(tags) - 3, 0) AS BIGINT) AS more FROM items")
def card_preview(spark, d):
    cat = derived.catalog(spark, d)
    got = catalog.card_preview(catalog.media_items(cat.media, cat.tags, cat.media_tags))
    return got.select("id", F.array_join("preview", ",").alias("preview"), F.col("more").cast("long").alias("more"))


SUGGEST = "SELECT id, name, count, kind FROM counts WHERE NOT is_category AND (contains(lower(name), 'tion') OR coalesce(contains(lower(name_ja), 'tion'), FALSE))"


@query("suggested_tags", SUGGEST + " ORDER BY count DESC, coalesce(name_ja, name), id LIMIT 12")
def suggested_tags(spark, d):
    cat = derived.catalog(spark, d)
    return catalog.suggested_tags(catalog.tag_counts(cat.tags, cat.media_tags), " TION ", limit=12).select("id", "name", "count", "kind")


@query("tag_list", "SELECT id, name, tag_kind FROM tags WHERE NOT is_category AND tag_kind = 'descriptive' AND contains(lower(name), 'a')")
def tag_list(spark, d):
    return filters.tag_list(derived.tags(spark, d), "descriptive", "A").select("id", "name", "tag_kind")


@query("category_facet", "SELECT name FROM tags WHERE is_category")
def category_facet(spark, d):
    return catalog.category_facet(derived.tags(spark, d))


@query("group_media", "SELECT tag_id % 40 AS group_id, count(DISTINCT media_id) AS media FROM media_tags GROUP BY 1")
def group_media(spark, d):
    cat = derived.catalog(spark, d)
    return catalog.media_in_group(cat.media_tags, cat.tags.select((F.col("id") % 40).alias("group_id"), F.col("id").alias("tag_id")))


@query("resolved_names", """
x1 AS (SELECT id, name, name_ja, row_number() OVER (ORDER BY count DESC, coalesce(name_ja, name), id) AS r FROM counts WHERE NOT is_category),
x2 AS (SELECT ' #' || name || ' (' || coalesce(name_ja, '') || ')' AS name FROM x1 UNION SELECT name_ja FROM x1 WHERE name_ja IS NOT NULL),
x3 AS (SELECT n.name, ltrim(trim(n.name), '#') AS whole, trim(split_part(ltrim(trim(n.name), '#'), '(', 1)) AS part FROM x2 n)
SELECT x3.name, arg_min(x1.id, r) AS tag_id FROM x3 JOIN x1 ON x1.name = part OR x1.name = whole OR x1.name_ja = whole GROUP BY x3.name""")
def resolved_names(spark, d):
    cat = derived.catalog(spark, d)
    free = cat.tags.where("NOT is_category")
    names = free.select(F.concat(F.lit(" #"), "name", F.lit(" ("), F.coalesce("name_ja", F.lit("")), F.lit(")")).alias("name")).union(free.where("name_ja IS NOT NULL").select("name_ja")).distinct()
    return catalog.resolved_names(names, catalog.tag_counts(cat.tags, cat.media_tags))


NORM = """CASE WHEN {s} LIKE '%ies' AND strlen({s}) > 4 THEN left({s}, length({s}) - 3) || 'y'
 WHEN {s} LIKE '%s' AND NOT {s} LIKE '%ss' AND strlen({s}) > 3 THEN left({s}, length({s}) - 1) ELSE {s} END"""


def _norm(x: str) -> str:
    return NORM.format(s=f"regexp_replace(translate(lower(trim({x})), ' -', '__'), '[^a-z0-9_]', '', 'g')")


@query("normalize_tags", f"SELECT id, {_norm('name')} AS norm FROM tags UNION ALL SELECT 1000000 + p_partkey, {_norm('p_name')} FROM part")
def normalize_tags(spark, d):
    part = derived.table(spark, d, "part")
    return derived.tags(spark, d).select("id", S.normalize_tag("name").alias("norm")).union(part.select(1000000 + F.col("p_partkey"), S.normalize_tag("p_name")))


@query("tag_words", "SELECT id, array_to_string(list_filter(regexp_split_to_array(name, '[_-]'), lambda w: strlen(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "], w)), ',') AS words FROM tags")
def tag_words(spark, d):
    return derived.tags(spark, d).select("id", F.array_join(S.tag_words("name"), ",").alias("words"))


@query("path_parts", "SELECT id, lower(regexp_extract(file_path, '[.]([^./]+)$', 1)) AS ext, regexp_extract(file_path, '[^/]+$') AS name, regexp_matches(lower(file_path), '[.](jpg|jpeg|png|webp|bmp|mp4|mkv|avi|mov|webm|gif)$') AS supported, regexp_matches(lower(file_path), '[.](mp4|webm|mov|avi|mkv|flv|wmv)$') AS video FROM media")
def path_parts(spark, d):
    return derived.media(spark, d).select("id", S.extension("file_path").alias("ext"), S.file_name("file_path").alias("name"), S.is_supported("file_path").alias("supported"), S.is_video("file_path").alias("video"))


@query("tag_labels", "SELECT id, CASE WHEN name_ja IS NULL THEN name ELSE name || ' (' || name_ja || ')' END AS descriptor, CASE WHEN coalesce(trim(name_ja), '') = '' THEN name ELSE name_ja || '(' || name || ')' END AS display FROM tags")
def tag_labels(spark, d):
    return derived.tags(spark, d).select("id", S.tag_descriptor("name", "name_ja").alias("descriptor"), S.display_tag("name", "name_ja").alias("display"))


MODELS = [("ollama", m, f) for m in ("qwen3-vl:4b", "llama3.2-vision:11b", "llava:34b", "my-custom-model:12b", "no-size-here", "vision-large", "x-1.5b", "b-600b-7b") for f in (False, True)] + [("Gemini", "flash", False), ("my-gpt", "a:1b", False)]


@query("model_routing", f"""
SELECT provider, model, force, size, kind, CAST(CASE WHEN kind = 'LIGHT' THEN 8192 ELSE 12288 END AS INTEGER) AS ctx FROM (
SELECT *, CASE WHEN force THEN 'DETAILED' WHEN regexp_matches(lower(provider), 'gemini|google|openai|gpt|claude|anthropic') THEN 'DETAILED'
 WHEN size IS NOT NULL THEN CASE WHEN size >= 10 THEN 'DETAILED' ELSE 'LIGHT' END
 WHEN regexp_matches(lower(model), 'large|giant|pro') THEN 'DETAILED' ELSE 'LIGHT' END AS kind FROM (
SELECT *, list_filter(list_transform(regexp_extract_all(lower(model), '([0-9.]+)b', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda v: v > 0 AND v < 500)[1] AS size
FROM (VALUES {', '.join(str((a, b, c)) for a, b, c in MODELS)}) t(provider, model, force)))""", with_catalog=False)
def model_routing(spark, d):
    rows = spark.createDataFrame(MODELS, "provider string, model string, force boolean")
    kind = S.prompt_type("provider", "model", "force")
    return rows.select("provider", "model", "force", S.parameter_size("model").alias("size"), kind.alias("kind"), S.context_size(kind, F.lit("atomic")).alias("ctx"))


@query("duplicate_donors", """
x1 AS (SELECT file_size, file_hash, min(id) AS donor_id FROM media WHERE analysis_status = 'completed' AND file_hash <> '' GROUP BY ALL)
SELECT m.id, donor_id FROM media m JOIN x1 USING (file_size, file_hash) WHERE analysis_status = 'pending' AND m.id <> donor_id""")
def duplicate_donors(spark, d):
    return ingest.donors(derived.media(spark, d))


@query("duplicate_tag_copy", """
x1 AS (SELECT file_size, file_hash, min(id) AS donor_id FROM media WHERE analysis_status = 'completed' AND file_hash <> '' GROUP BY ALL),
x2 AS (SELECT m.id, donor_id FROM media m JOIN x1 USING (file_size, file_hash) WHERE analysis_status = 'pending' AND m.id <> donor_id)
SELECT media_id, tag_id FROM media_tags UNION SELECT x2.id, tag_id FROM x2 JOIN media_tags ON media_id = donor_id""")
def duplicate_tag_copy(spark, d):
    return ingest.copied(derived.catalog(spark, d)).media_tags


@query("duplicate_leaders", """
x1 AS (SELECT file_size, file_hash FROM media WHERE analysis_status = 'completed'),
x2 AS (SELECT * FROM media m WHERE analysis_status = 'pending' AND NOT EXISTS (SELECT 1 FROM x1 WHERE x1.file_size = m.file_size AND x1.file_hash = m.file_hash))
SELECT id, min(id) OVER (PARTITION BY file_size, file_hash) AS leader_id FROM x2""")
def duplicate_leaders(spark, d):
    return ingest.leaders(derived.media(spark, d))


@query("scan_transition", """
SELECT l.file_path, CASE WHEN m.id IS NULL THEN 'insert' WHEN analysis_status = 'completed' AND l.file_modified_at = m.file_modified_at AND m.thumbnail_path = '' THEN 'thumb'
 WHEN analysis_status = 'completed' AND l.file_modified_at = m.file_modified_at THEN 'keep'
 WHEN analysis_status = 'pending' AND l.file_modified_at = m.file_modified_at AND m.thumbnail_path <> '' THEN 'skip' ELSE 'update' END AS action
FROM listing l LEFT JOIN media m USING (file_path)""")
def scan_transition(spark, d):
    media = derived.media(spark, d)
    return ingest.transitions(media, derived.listing(media)).select("file_path", "action")


@query("scan_upsert", """
x1 AS (SELECT l.*, m.id, m.analysis_status AS st, m.thumbnail_path AS ot, m.file_modified_at AS om FROM listing l LEFT JOIN media m USING (file_path)),
x2 AS (SELECT max(id) AS top FROM media)
SELECT top + row_number() OVER (ORDER BY file_path) AS id, file_path, 'pending' AS analysis_status, thumbnail_path, file_modified_at FROM x1, x2 WHERE id IS NULL
UNION ALL SELECT m.id, m.file_path,
 CASE WHEN x1.id IS NULL OR (st = 'completed' AND x1.file_modified_at = om) OR (st = 'pending' AND x1.file_modified_at = om AND ot <> '') THEN m.analysis_status ELSE 'pending' END,
 CASE WHEN x1.id IS NULL OR (st IN ('completed', 'pending') AND x1.file_modified_at = om AND ot <> '') THEN m.thumbnail_path ELSE x1.thumbnail_path END,
 coalesce(x1.file_modified_at, m.file_modified_at) FROM media m LEFT JOIN x1 ON x1.id = m.id""")
def scan_upsert(spark, d):
    media = derived.media(spark, d)
    return ingest.scanned(media, derived.listing(media), 1800000000).select("id", "file_path", "analysis_status", "thumbnail_path", "file_modified_at")


MOVES = """
x1 AS (SELECT id, file_path, file_size, file_hash, row_number() OVER (PARTITION BY file_size, file_hash ORDER BY id) AS rn FROM media WHERE file_path NOT IN (SELECT file_path FROM listing)),
x2 AS (SELECT file_path AS new_path, file_size, file_hash, row_number() OVER (PARTITION BY file_size, file_hash ORDER BY file_path) AS rn FROM listing WHERE file_path NOT IN (SELECT file_path FROM media)),
x3 AS (SELECT id, file_path AS old_path, new_path FROM x1 JOIN x2 USING (file_size, file_hash, rn))"""


@query("move_matches", MOVES + " SELECT id, old_path, new_path FROM x3")
def move_matches(spark, d):
    media = derived.media(spark, d)
    return ingest.moves(media, derived.listing(media)).select("id", "old_path", "new_path")


@query("sync_result", MOVES + " SELECT m.id, coalesce(new_path, file_path) AS file_path FROM media m LEFT JOIN x3 ON x3.id = m.id WHERE new_path IS NOT NULL OR file_path IN (SELECT file_path FROM listing)")
def sync_result(spark, d):
    cat = derived.catalog(spark, d)
    return ingest.synced(cat, derived.listing(cat.media), 1800000000).media.select("id", "file_path")


@query("cleanup_links", "SELECT media_id, tag_id FROM media_tags WHERE media_id IN (SELECT id FROM media WHERE file_path IN (SELECT file_path FROM listing))")
def cleanup_links(spark, d):
    cat = derived.catalog(spark, d)
    return ingest.cleaned(cat, derived.listing(cat.media))[0].media_tags


@query("pending_queue", "SELECT id FROM media WHERE analysis_status = 'pending' AND lower(file_path) LIKE '/lib/src1%'")
def pending_queue(spark, d):
    """No separator is added: src1 takes src10 to src19 too."""
    return ingest.pending(derived.media(spark, d), ["/lib/src1"]).select("id")


@query("reset_folder", """
x1 AS (SELECT id, lower(file_path) LIKE '/lib/src2%' AS hit, analysis_status AS st, analysis_error AS er FROM media)
SELECT id, CASE WHEN hit THEN 'pending' ELSE st END AS analysis_status, CASE WHEN NOT hit THEN er END AS analysis_error, (SELECT count(*) FROM media_tags WHERE media_id = x1.id AND NOT hit) AS links FROM x1""")
def reset_folder(spark, d):
    out = mutations.reset_folder(derived.catalog(spark, d), "/lib/src2")
    n = out.media_tags.groupBy(F.col("media_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return out.media.join(n, "id", "left").select("id", "analysis_status", "analysis_error", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query("reset_failed", "SELECT id, CASE WHEN analysis_status = 'failed' THEN 'pending' ELSE analysis_status END AS analysis_status FROM media")
def reset_failed(spark, d):
    return mutations.reset_failed(derived.media(spark, d)).select("id", "analysis_status")


@query("remove_folder", "SELECT media_id, tag_id FROM media_tags WHERE media_id NOT IN (SELECT id FROM media WHERE file_path LIKE '/lib/src3/%')")
def remove_folder(spark, d):
    return mutations.remove_folder(derived.catalog(spark, d), "/lib/src3").media_tags


MERGED = """
x1 AS (SELECT id AS source, id - id % 5 AS target FROM tags WHERE NOT is_category AND id % 5 BETWEEN 1 AND 2 AND id - id % 5 > 12),
x2 AS (SELECT DISTINCT media_id, coalesce(target, tag_id) AS tag_id FROM media_tags LEFT JOIN x1 ON source = tag_id)"""


def _merged(spark, d):
    cat = derived.catalog(spark, d)
    i = F.col("id")
    mapping = cat.tags.where(~F.col("is_category") & (i % 5).between(1, 2) & (i - i % 5 > 12)).select(i.alias("source"), (i - i % 5).alias("target"))
    return mutations.merge_tags(cat, mapping)


@query("merge_links", MERGED + " SELECT media_id, tag_id FROM x2")
def merge_links(spark, d):
    return _merged(spark, d).media_tags


@query("merge_tags", MERGED + " SELECT id, name FROM tags WHERE id NOT IN (SELECT source FROM x1) AND (is_category OR id IN (SELECT tag_id FROM x2))")
def merge_tags(spark, d):
    return _merged(spark, d).tags.select("id", "name")


#: For each rule, pairs that hold all that it can link.
MET = {
    "a": "SELECT a.r AS r1, b.r AS r2 FROM x1 a JOIN x1 b ON a.kind = b.kind AND a.ja = b.ja AND a.r < b.r",
    "b": "SELECT a.r AS r1, b.r AS r2 FROM x1 a JOIN x1 b ON a.kind = b.kind AND a.norm = b.norm AND a.r < b.r",
    "c": "SELECT DISTINCT a.r AS r1, b.r AS r2 FROM (SELECT r, kind, unnest(words) AS w FROM x1) a JOIN (SELECT r, kind, unnest(words) AS w FROM x1) b ON a.kind = b.kind AND a.w = b.w AND a.r < b.r",
    "d": "SELECT a.r AS r1, b.r AS r2 FROM x1 a JOIN x1 b ON a.kind = b.kind AND left(a.ja, 4) = left(b.ja, 4) AND a.r < b.r",
    "e": "SELECT a.r AS r1, b.r AS r2 FROM x1 a JOIN x1 b ON a.kind = b.kind AND a.r < b.r AND abs(strlen(a.name) - strlen(b.name)) <= 3 AND levenshtein(a.name, b.name) <= 3",
}

RULE = """
x1 AS (SELECT id, name, kind, trim(name_ja) AS ja, {norm} AS norm, row_number() OVER (ORDER BY count DESC, coalesce(name_ja, name), id) AS r,
 list_filter(regexp_split_to_array(name, '[_-]'), lambda w: strlen(w) >= 3 AND NOT list_contains([{stop}], w)) AS words FROM counts WHERE NOT is_category AND count > 0),
met AS ({met}),
x2 AS (SELECT a.id AS id1, b.id AS id2, a.name AS n1, b.name AS n2, a.ja AS j1, b.ja AS j2, a.norm AS norm, b.norm AS norm2, list_filter(a.words, lambda w: list_contains(b.words, w)) AS common,
 levenshtein(a.name, b.name) AS dist FROM met JOIN x1 a ON a.r = r1 JOIN x1 b ON b.r = r2),
x3 AS (SELECT id1, id2, CASE WHEN j1 = j2 AND j1 <> '' THEN 'a' WHEN norm = norm2 THEN 'b' WHEN len(common) >= 2 OR (len(common) = 1 AND strlen(common[1]) >= 7) THEN 'c'
 WHEN length(j1) >= 4 AND length(j2) >= 4 AND left(j1, 4) = left(j2, 4) THEN 'd'
 WHEN strlen(n1) >= 4 AND strlen(n2) >= 4 AND abs(strlen(n1) - strlen(n2)) <= 3 AND (dist = 1 OR (dist <= 3 AND greatest(strlen(n1), strlen(n2)) >= 8)) THEN 'e' END AS rule, j1, norm, common, j2, dist FROM x2),
x4 AS (SELECT id1, id2, rule, CASE rule WHEN 'a' THEN '同一日本語表記 (' || j1 || ')' WHEN 'b' THEN '単数形・表記統一 (' || norm || ')' WHEN 'c' THEN '共通キーフレーズ (' || array_to_string(common, ', ') || ')'
 WHEN 'd' THEN '類似日本語表記 (' || left(j1, CAST(list_max(list_filter(range(0, length(j1) + 1), lambda k: left(j1, CAST(k AS INTEGER)) = left(j2, CAST(k AS INTEGER)) AND k <= length(j2))) AS INTEGER)) || ')' ELSE '類似スペル (編集距離 ' || dist || ')' END AS reason FROM x3 WHERE rule IS NOT NULL)""".replace("{norm}", _norm("name")).replace("{stop}", ", ".join(f"'{w}'" for w in S.STOP_WORDS))


def _featured(spark, d):
    cat = derived.catalog(spark, d)
    tags = written(resolution.featured(catalog.tag_counts(cat.tags, cat.media_tags)), "tags")
    return cat, tags


@query("merge_pairs", RULE.replace("{met}", " UNION ".join(MET.values())) + " SELECT id1, id2, rule, reason FROM x4")
def merge_pairs(spark, d):
    return resolution.pairs(_featured(spark, d)[1])


for _rule, _where in {
    "a": "j1 = j2 AND j1 <> ''",
    "b": "norm = norm2",
    "c": "len(common) >= 2 OR (len(common) = 1 AND strlen(common[1]) >= 7)",
    "d": "length(j1) >= 4 AND length(j2) >= 4 AND left(j1, 4) = left(j2, 4)",
    "e": "strlen(n1) >= 4 AND strlen(n2) >= 4 AND abs(strlen(n1) - strlen(n2)) <= 3 AND (dist = 1 OR (dist <= 3 AND greatest(strlen(n1), strlen(n2)) >= 8))",
}.items():

    @query(f"merge_rule_{_rule}", RULE.replace("{met}", MET[_rule]) + f" SELECT id1, id2 FROM x2 WHERE {_where}")
    def merge_rule(spark, d, rule=_rule):
        tags = _featured(spark, d)[1]
        return resolution.identified(resolution.rule_pairs(tags, rule).select("rank1", "rank2"), tags)


@query("merge_components")
def merge_components(spark, d):
    return resolution.groups(resolution.linked(_featured(spark, d)[1]))


@query("merge_suggestions")
def merge_suggestions(spark, d):
    cat, tags = _featured(spark, d)
    members = written(resolution.groups(resolution.linked(tags)), "members")
    listed = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= resolution.MOST)
    # larger groups are no suggestions, so pairs and their reasons are needed in the others alone
    few = written(tags.join(members.join(listed, "group_id").select(F.col("tag_id").alias("id")), "id", "left_semi").select(tags.columns), "listed-tags")
    found = written(resolution.pairs(few), "pairs")
    got = resolution.suggestions(few, found, cat.media, cat.media_tags)
    return got.select("id", F.col("target.id").alias("target_id"), F.array_join(F.transform("sources", lambda x: x["name"]), ",").alias("sources"), "reason", F.array_join("sample_thumbnails", ",").alias("samples"), "total_images_count")


@query("analysis_parse", """
SELECT doc_id AS media_id, CASE WHEN doc_id % 12 = 4 THEN 'empty_response' WHEN doc_id % 12 BETWEEN 5 AND 10 THEN 'parse_error' END AS error,
 CAST(CASE WHEN doc_id % 12 IN (0, 2, 11) THEN 1 WHEN doc_id % 12 = 1 THEN 2 WHEN doc_id % 12 = 3 THEN 0 END AS INTEGER) AS n_tags FROM documents""", with_catalog=False)
def analysis_parse(spark, d):
    got = analysis.decoded(derived.responses(spark, d))
    return got.select("media_id", "error", F.when(F.col("error").isNull(), F.size("result.tags")).alias("n_tags"))


def _decoded(spark, d):
    """Decoded once and written: filters and unions over it would else repeat the decoding."""
    return written(analysis.decoded(derived.responses(spark, d)), "decoded")


@query("analysis_tags", """
WITH r AS (SELECT doc_id AS media_id, doc_id % 12 AS k, 'token' || (doc_id % 50) AS t FROM documents)
SELECT media_id, 'category' AS kind, CASE k WHEN 0 THEN 'animal' WHEN 1 THEN 'food' WHEN 3 THEN 'tech' ELSE 'other' END AS en, CAST(NULL AS VARCHAR) AS ja FROM r WHERE k IN (0, 1, 3, 11)
UNION ALL SELECT media_id, 'basic', t, CASE k WHEN 0 THEN 'x' WHEN 1 THEN '' WHEN 2 THEN 'z' ELSE 'q' END FROM r WHERE k IN (0, 1, 2, 11)
UNION ALL SELECT media_id, 'basic', 'red_car', 'y' FROM r WHERE k = 1
UNION ALL SELECT media_id, 'descriptive', 'wet_' || t, 'w' FROM r WHERE k = 2""", with_catalog=False)
def analysis_tags(spark, d):
    return analysis.tag_rows(_decoded(spark, d))


@query("analysis_upsert", """
x1 AS (SELECT 'token' || k AS name, CASE WHEN k % 12 = 1 THEN NULL ELSE '' END AS dummy FROM range(0, 50) g(k)),
x2 AS (SELECT DISTINCT CASE WHEN d.doc_id % 12 = 1 AND g.n = 2 THEN 'red_car' ELSE 'token' || (d.doc_id % 50) END AS name,
 CASE d.doc_id % 12 WHEN 0 THEN 'x' WHEN 1 THEN CASE WHEN g.n = 2 THEN 'y' END WHEN 2 THEN 'z' ELSE 'q' END AS ja
 FROM documents d JOIN (VALUES (1), (2)) g(n) ON g.n = 1 OR d.doc_id % 12 = 1 WHERE d.doc_id % 12 IN (0, 1, 2, 11)),
x3 AS (SELECT name, min(ja) AS ja FROM x2 GROUP BY name)
SELECT id, name, name_ja, is_category, tag_kind FROM tags
UNION ALL SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY name), name, ja, FALSE, 'basic' FROM x3""")
def analysis_upsert(spark, d):
    rows = analysis.tag_rows(_decoded(spark, d)).where("kind = 'basic'")
    return mutations.upsert_tags(derived.tags(spark, d), rows)


SERIES = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS series_key, ts, event_id, CAST(floor(value) AS BIGINT) AS current FROM events),
m AS (SELECT *, CASE WHEN lag(current) OVER w IS NULL OR current < lag(current) OVER w THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY series_key ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY series_key ORDER BY ts, event_id) AS BIGINT) AS series FROM m)"""


@query("progress_series", SERIES + " SELECT series_key, series, count(*) AS n, min(current) AS low, max(current) AS high FROM s GROUP BY ALL", with_catalog=False)
def progress_series(spark, d):
    rows = progress.with_series(derived.progress_events(spark, d), order=("ts", "event_id"))
    return rows.groupBy("series_key", "series").agg(F.count(F.lit(1)).alias("n"), F.min("current").alias("low"), F.max("current").alias("high"))


@query("progress_eta", SERIES + """,
b AS (SELECT *, current - first_value(current) OVER w AS done, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS el FROM s WINDOW w AS (PARTITION BY series_key, series ORDER BY ts, event_id))
SELECT event_id, series, round(CASE WHEN done > 0 AND el > 0.5 THEN el / done END, 3) AS sec_per_item,
 CAST(floor(CASE WHEN done > 0 AND el > 0.5 THEN el / done END * greatest(0, 1000 - current + 1) + 0.5) AS BIGINT) AS eta_sec FROM b""", with_catalog=False)
def progress_eta(spark, d):
    rows = progress.with_eta(derived.progress_events(spark, d), order=("ts", "event_id"))
    return rows.select("event_id", "series", F.round("sec_per_item", 3).alias("sec_per_item"), "eta_sec")


ROWS = """
WITH r AS (SELECT event_type AS cond, CAST(user_id % 3 AS VARCHAR) AS "group", CAST(event_id % 40 AS VARCHAR) AS image, event_id AS rep, CAST(floor(value * 100) AS BIGINT) AS ms, event_id % 6 AS tc, event_id % 7 <> 0 AS ok,
 CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'empty_response' ELSE 'parse_error' END END AS why FROM events)"""


@query("prompt_summary", ROWS + """
SELECT cond, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failed, round(count(*) FILTER (WHERE NOT ok) / count(*), 6) AS failed_share, count(*) FILTER (WHERE why = 'empty_response') AS empty,
 count(*) FILTER (WHERE ok AND tc < 3) AS under3, list_sort(list(tc) FILTER (WHERE ok))[CAST(floor(count(*) FILTER (WHERE ok) / 2) AS BIGINT) + 1] AS median_tags,
 min(tc) FILTER (WHERE ok) AS min_tags, max(tc) FILTER (WHERE ok) AS max_tags, round(avg(ms) / 1000, 4) AS mean_sec FROM r GROUP BY cond""", with_catalog=False)
def prompt_summary(spark, d):
    got = reports.prompt_summary(derived.prompt_rows(spark, d))
    return got.select("cond", "n", "failed", F.round("failed_share", 6).alias("failed_share"), "empty", "under3", "median_tags", "min_tags", "max_tags", "mean_sec")


CONDS = ["click", "error", "purchase", "signup", "view"]


@query("prompt_pivot", ROWS + ' SELECT "group", ' + ", ".join(f"round(avg(CASE WHEN tc < 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE cond = '{c}'), 6) AS {c}" for c in CONDS) + ' FROM r WHERE ok GROUP BY "group"', with_catalog=False)
def prompt_pivot(spark, d):
    return reports.few_tags_pivot(derived.prompt_rows(spark, d), CONDS)


@query("prompt_failures", ROWS + " SELECT cond, why AS fail_reason, count(*) AS n FROM r WHERE NOT ok GROUP BY ALL", with_catalog=False)
def prompt_failures(spark, d):
    return reports.failures(derived.prompt_rows(spark, d))


@query("prompt_vocabulary", """
WITH t AS (SELECT event_type AS cond, unnest(range(0, event_id % 6)) AS k, event_id AS i FROM events WHERE event_id % 7 <> 0),
s AS (SELECT event_type AS cond, event_id % 40 AS image, list_sort(list_distinct(list_transform(range(0, event_id % 6), lambda k: (event_id * 7 + k * k) % 11))) AS tags FROM events WHERE event_id % 7 <> 0),
g AS (SELECT cond, image, tags, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.cond, CASE WHEN a.tags = b.tags THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END AS w,
 CASE WHEN len(a.tags) + len(b.tags) = 0 THEN 1.0 ELSE len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) END AS score
 FROM g a JOIN g b ON a.cond = b.cond AND a.image = b.image AND a.tags <= b.tags),
m AS (SELECT cond, round(sum(score * w) / sum(w), 6) AS mean_jaccard FROM p WHERE w > 0 GROUP BY cond)
SELECT cond, vocabulary, mean_jaccard FROM (SELECT cond, count(DISTINCT (i * 7 + k * k) % 11) AS vocabulary FROM t GROUP BY cond) LEFT JOIN m USING (cond)""", with_catalog=False)
def prompt_vocabulary(spark, d):
    return reports.agreement(derived.prompt_rows(spark, d))


LOG = """
WITH l AS (SELECT event_id AS line_no, CASE WHEN event_id % 50 = 0 THEN ' ' ELSE '[2024-01-01 00:00:00] [' || CASE WHEN event_id % 13 = 0 THEN 'ERROR' WHEN event_id % 7 = 0 THEN 'DEBUG' ELSE 'INFO' END || '] ' || event_type || ' by ' || user_id END AS value FROM events)"""


@query("log_tail", LOG + ", t AS (SELECT * FROM l WHERE trim(value) <> '' ORDER BY line_no DESC LIMIT 1000) SELECT count(*) AS lines, count(*) FILTER (WHERE contains(value, '[ERROR]')) AS errors, min(line_no) AS first_line FROM t", with_catalog=False)
def log_tail(spark, d):
    return reports.log_tail(derived.log_lines(spark, d))


@query("log_filter", LOG + " SELECT line_no, value FROM l WHERE contains(lower(value), 'click') AND contains(value, '[ERROR]')", with_catalog=False)
def log_filter(spark, d):
    return reports.log_filter(derived.log_lines(spark, d), "CLICK", ["ERROR"])


@query("log_levels", LOG + " SELECT coalesce(nullif(regexp_extract(value, '^\\[[^\\]]*\\] \\[([A-Z]+)\\]', 1), ''), 'none') AS level, count(*) AS n FROM l GROUP BY 1", with_catalog=False)
def log_levels(spark, d):
    rows = reports.parsed_log(derived.log_lines(spark, d))
    return rows.groupBy(F.coalesce("level", F.lit("none")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("download_chunks", """
WITH l AS (SELECT user_id AS stream, event_id AS line_no, CASE event_id % 4 WHEN 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS c, event_id % 9 = 0 AS broken FROM events),
k AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY stream ORDER BY line_no), 0) AS completed FROM l WHERE NOT broken)
SELECT stream, line_no, completed, round(least(100.0, completed / 500.0 * 100), 6) AS percent FROM k""", with_catalog=False)
def download_chunks(spark, d):
    e = derived.table(spark, d, "events")
    body = F.concat(F.lit('{"status":"pulling","total":500'), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(',"completed":'), F.floor("value").cast("string"))), F.lit("}"))
    lines = e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 9 == 0, '{"status":').otherwise(body).alias("value"))
    return json_files.decoded_chunks(lines).select("stream", "line_no", "completed", F.round("percent", 6).alias("percent"))


@query("settings_map", "SELECT 22 AS n, 'atomic' AS granularity, 50 AS most", with_catalog=False)
def settings_map(spark, d):
    table = seeded_settings(empty(spark, SETTINGS))
    made = settings.as_map(table)
    return made.select(F.size("settings").alias("n"), F.col("settings")["tag_granularity"].alias("granularity"), F.col("settings")["ext_llm_max_batch_items"].cast("int").alias("most"))


@query("video_frames", "SELECT id, unnest([least(greatest(t - 2.0, 0.0), 60.0), least(greatest(t, 0.0), 60.0), least(greatest(t + 2.0, 0.0), 60.0)]) AS seconds, unnest([0, 1, 2]) AS frame FROM (SELECT id, CAST(id % 70 AS DOUBLE) AS t FROM media)")
def video_frames(spark, d):
    media = derived.media(spark, d).select("id", (F.col("id") % 70).cast("double").alias("timestamp"), F.lit(60.0).alias("duration"))
    return analysis.video_frames(media).select("id", "seconds", "frame")


# changes of single rows and of whole tables


@query("set_setting", "SELECT r_name AS key, CASE WHEN r_name = 'ASIA' THEN 'x' ELSE CAST(r_regionkey AS VARCHAR) END AS value FROM region", with_catalog=False)
def set_setting(spark, d):
    own = derived.table(spark, d, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return mutations.set_setting(own, "ASIA", "x")


@query("add_folder", """
SELECT CAST(n_nationkey AS BIGINT) AS id, '/' || n_name AS path, CAST(0 AS BIGINT) AS created_at FROM nation
UNION ALL SELECT CAST(max(n_nationkey) + 1 AS BIGINT), '/new', CAST(7 AS BIGINT) FROM nation""", with_catalog=False)
def add_folder(spark, d):
    own = derived.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("/"), "n_name").alias("path"), F.lit(0).cast("long").alias("created_at"))
    return mutations.add_folder(mutations.add_folder(own, "/new", 7), "/new", 8)


@query("orphans_collected", "SELECT id, name FROM tags WHERE is_category OR id IN (SELECT tag_id FROM media_tags)")
def orphans_collected(spark, d):
    return mutations.without_orphans(derived.catalog(spark, d)).tags.select("id", "name")


@query("category_upsert", """
x1 AS (SELECT DISTINCT name FROM (SELECT name FROM tags WHERE id % 7 = 0 UNION ALL SELECT lower(p_brand) FROM part)),
x2 AS (SELECT name FROM x1 WHERE name NOT IN (SELECT name FROM tags))
SELECT id, name, name_ja, is_category OR name IN (SELECT name FROM x1) AS is_category, tag_kind FROM tags
UNION ALL SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY name), name, NULL, TRUE, 'basic' FROM x2""")
def category_upsert(spark, d):
    own = derived.catalog(spark, d).tags
    names = own.where("id % 7 = 0").select(F.concat(F.lit(" "), F.upper("name")).alias("name")).union(derived.table(spark, d, "part").select("p_brand"))
    return mutations.upsert_categories(own, names)


UPSERTED = """
x1 AS (SELECT name, min(ja) AS ja FROM (SELECT name, CASE WHEN id % 3 = 0 THEN {blank} ELSE 'new' || id END AS ja FROM tags WHERE id % 4 = 0 AND regexp_matches(name, '^[a-z]*[a-rt-z]$')
 UNION ALL SELECT replace(lower(p_brand), '#', '') || 'x', p_type FROM part) GROUP BY name)
SELECT id, t.name, {label} AS name_ja, is_category, tag_kind FROM tags t LEFT JOIN x1 USING (name)
UNION ALL SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY name), name, ja, FALSE, '{kind}' FROM x1 WHERE name NOT IN (SELECT name FROM tags)"""


def _upserted(spark, d, kind, labels):
    own = derived.catalog(spark, d).tags
    new = own.where("id % 4 = 0 AND name RLIKE '^[a-z]*[a-rt-z]$'").select(F.col("name").alias("en"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("new"), "id")).alias("ja"))
    brands = derived.table(spark, d, "part").select(F.concat(F.regexp_replace(F.lower("p_brand"), "#", ""), F.lit("x")), F.col("p_type"))
    return mutations.upsert_tags(own, new.union(brands), kind, labels)


@query("tag_upsert_replace", UPSERTED.format(blank="NULL", label="coalesce(ja, name_ja)", kind="basic"))
def tag_upsert_replace(spark, d):
    return _upserted(spark, d, "basic", "replace")


@query("tag_upsert_blank", UPSERTED.format(blank="''", label="coalesce(ja, name_ja)", kind="basic"))
def tag_upsert_blank(spark, d):
    return _upserted(spark, d, "basic", "blank")


@query("tag_upsert_descriptive", UPSERTED.format(blank="NULL", label="coalesce(name_ja, ja)", kind="descriptive"))
def tag_upsert_descriptive(spark, d):
    return _upserted(spark, d, "descriptive", "keep")


@query("add_tag", "SELECT media_id, tag_id FROM media_tags UNION SELECT 1, (SELECT max(id) + 1 FROM tags)")
def add_tag(spark, d):
    return mutations.add_tag(derived.catalog(spark, d), 1, " Zzunheard ").media_tags


@query("remove_tag", """
x1 AS (SELECT media_id, tag_id FROM media_tags WHERE NOT (media_id = 1 AND tag_id = 2))
SELECT media_id, tag_id FROM x1""")
def remove_tag(spark, d):
    return mutations.remove_tag(derived.catalog(spark, d), 1, 2).media_tags


@query("rename_tag", "SELECT id, CASE WHEN id = 13 THEN 'renamed' ELSE name END AS name, CASE WHEN id = 13 THEN 'label' ELSE name_ja END AS name_ja FROM tags")
def rename_tag(spark, d):
    return mutations.rename_tag(derived.catalog(spark, d).tags, 13, "renamed", "label").select("id", "name", "name_ja")


@query("reset_selected", "SELECT id, CASE WHEN id % 3 = 0 THEN 'pending' ELSE analysis_status END AS analysis_status, CASE WHEN id % 3 <> 0 THEN analysis_error END AS analysis_error FROM media")
def reset_selected(spark, d):
    own = derived.media(spark, d)
    return mutations.reset_media(own, own.where("id % 3 = 0").select("id")).select("id", "analysis_status", "analysis_error")


@query("reset_all", "SELECT id, 'pending' AS analysis_status, CAST(NULL AS VARCHAR) AS analysis_error, CAST(0 AS BIGINT) AS links FROM media")
def reset_all(spark, d):
    cat = mutations.reset_all(derived.catalog(spark, d))
    links = cat.media_tags.groupBy(F.col("media_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return cat.media.join(links, "id", "left").select("id", "analysis_status", "analysis_error", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query("mark_results", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' WHEN id % 3 = 1 THEN 'completed' ELSE analysis_status END AS analysis_status,
 CASE WHEN id % 3 = 0 THEN 'broken ' || id WHEN id % 3 = 2 THEN analysis_error END AS analysis_error FROM media""")
def mark_results(spark, d):
    own = derived.media(spark, d)
    error = F.when(F.col("id") % 3 == 0, F.concat(F.lit("broken "), "id"))
    return mutations.mark_results(own, own.where("id % 3 < 2").select(F.col("id").alias("media_id"), error.alias("error"))).select("id", "analysis_status", "analysis_error")


@query("replaced_links", "SELECT media_id, tag_id FROM media_tags WHERE media_id % 4 <> 0 UNION SELECT id, 13 + id % 5 FROM media WHERE id % 4 = 0")
def replaced_links(spark, d):
    cat = derived.catalog(spark, d)
    done = cat.media.where("id % 4 = 0").select(F.col("id").alias("media_id"))
    return mutations.replaced_links(cat.media_tags, done.withColumn("tag_id", 13 + F.col("media_id") % 5), done)


@query("suggestion_mapping", """
x1 AS (SELECT id, id - id % 6 AS master FROM tags WHERE id > 12 AND id - id % 6 > 12)
SELECT id AS source, master AS target FROM x1 WHERE id <> master AND (master // 6) % 3 = 0 AND id % 6 <> 4""")
def suggestion_mapping(spark, d):
    own = derived.catalog(spark, d).tags.where("id > 12 AND id - id % 6 > 12").select((F.col("id") - F.col("id") % 6).alias("master"), "id")
    groups = own.groupBy(F.col("master").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("members"))  # six tags a group
    third = F.floor(F.col("id") / 6) % 3
    decisions = groups.select("id", (third != 1).alias("accepted"), (third == 2).alias("rejected"), F.col("id").alias("master"), F.filter("members", lambda m: m % 6 == 4).alias("excluded"))
    return mutations.suggestion_mapping(groups, decisions)


@query("seeded_tags", """
SELECT id, name, name_ja, is_category, tag_kind FROM tags WHERE id NOT IN (3, 5)
UNION ALL SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY name), name, name_ja, TRUE, 'basic' FROM tags WHERE id IN (3, 5)""")
def seeded_tags_query(spark, d):
    return seeded_tags(derived.catalog(spark, d).tags.where("id NOT IN (3, 5)"))


@query("migrated_tags", "SELECT id, name, CAST(NULL AS VARCHAR) AS name_ja, FALSE AS is_category, 'basic' AS tag_kind FROM tags")
def migrated_tags_query(spark, d):
    return migrated_tags(derived.catalog(spark, d).tags.select("id", "name"))


@query("tag_rollup", "SELECT name, count, name_ja, kind FROM counts WHERE NOT is_category AND count > 0")
def tag_rollup(spark, d):
    cat = derived.catalog(spark, d)
    return reports.tag_rollup(catalog.media_items(cat.media, cat.tags, cat.media_tags))


@query("shown_tag", "SELECT id, name FROM counts WHERE name = 'animal' OR name_ja = 'animal' ORDER BY is_category DESC, count DESC, coalesce(name_ja, name), id LIMIT 1")
def shown_tag(spark, d):
    cat = derived.catalog(spark, d)
    return catalog.shown_tag(catalog.tag_counts(cat.tags, cat.media_tags), "animal").select("id", "name")


@query("localized", """
SELECT n_name AS key, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'e' || n_nationkey END, CASE WHEN n_nationkey % 3 = 0 THEN 'j' || n_nationkey END,
 CASE WHEN n_nationkey % 5 = 0 THEN 'd' END, n_name) AS text FROM nation""", with_catalog=False)
def localized(spark, d):
    k, own = F.col("n_nationkey"), derived.table(spark, d, "nation")
    keys = own.select(F.col("n_name").alias("key"), F.when(k % 5 == 0, "d").alias("default"))
    one = lambda lang, m, c: own.where(k % m == 0).select(F.lit(lang).alias("lang"), F.col("n_name").alias("key"), F.concat(F.lit(c), k.cast("string")).alias("text"))
    return catalog.localized(keys, one("en", 2, "e").union(one("ja", 3, "j")), "en")


@query("failed_media", "SELECT id FROM media WHERE analysis_status = 'failed'")
def failed_media(spark, d):
    return catalog.failed(derived.media(spark, d))
