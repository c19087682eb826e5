"""The derived catalogue in SQL for DuckDB: the same rules as derived.py."""

from __future__ import annotations

from vitrine.plans.derived import ERROR, EXTENSIONS
from vitrine.schema import CATEGORIES

_EXT = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
_CATS = ", ".join(f"({i}, '{n}', '{ja}')" for i, (n, ja) in enumerate(CATEGORIES.items(), 1))

#: Common table expressions, to be followed by more of them or a SELECT.
CATALOG = f"""
WITH media AS (
    SELECT d.doc_id AS id,
           '/lib/' || source || '/' || lang || '/doc_' || d.doc_id || '.' || ({_EXT})[CAST(d.doc_id % 12 + 1 AS INTEGER)] AS file_path,
           lang AS parent_folder,
           CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE '/thumbs/' || sha256(CAST(d.doc_id AS VARCHAR)) || '.jpg' END AS thumbnail_path,
           n_chars AS file_size, sha256(text) AS file_hash, 1700000000 + d.doc_id * 60 AS file_modified_at,
           CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS analysis_status,
           CASE WHEN quality = 0 THEN '{ERROR}' END AS analysis_error
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), toks AS (
    SELECT DISTINCT doc_id AS media_id, token
    FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents)
    WHERE length(token) >= 10
), vocab AS (
    SELECT token, count(*) AS n FROM toks GROUP BY token
), tag_names AS (
    SELECT token AS name, 0 AS block, -n AS less FROM vocab
    UNION ALL SELECT token || 's', 1, -n FROM vocab v WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM vocab w WHERE w.token = v.token || 's')
    UNION ALL SELECT DISTINCT replace(lower(p_type) || '_' || p_name, ' ', '_'), 2, 0 FROM part
), tag_places AS (
    SELECT name, block, row_number() OVER (ORDER BY block, less, name) AS k FROM tag_names
), tags AS (
    SELECT CAST(id AS BIGINT) AS id, name, name_ja, TRUE AS is_category, 'basic' AS tag_kind FROM (VALUES {_CATS}) c(id, name, name_ja)
    UNION ALL SELECT 12 + k, name, CASE WHEN block = 0 AND k % 11 <= 1 THEN substr(sha256(CAST(k // 11 AS VARCHAR)), 1, 6) ||
                CASE WHEN (k // 11) % 2 = 1 THEN CAST(k % 11 AS VARCHAR) ELSE '' END END, FALSE, CASE WHEN block = 2 THEN 'descriptive' ELSE 'basic' END FROM tag_places
), media_tags AS (
    SELECT media_id, id AS tag_id FROM (SELECT media_id, token AS name FROM toks UNION SELECT media_id, token || 's' FROM toks WHERE media_id % 3 = 0) x
    JOIN tags USING (name) WHERE NOT is_category AND tag_kind = 'basic'
    UNION ALL SELECT id, 1 + id % 12 FROM media WHERE analysis_status = 'completed'
    UNION ALL SELECT m.id, t.id FROM media m JOIN tags t ON m.id % 29 = t.id % 29 AND t.tag_kind = 'descriptive' AND t.id % 5 <> 0
), counts AS (
    SELECT t.id, t.name, t.name_ja, t.is_category, count(mt.media_id) AS count, t.tag_kind AS kind
    FROM tags t LEFT JOIN media_tags mt ON mt.tag_id = t.id GROUP BY ALL
), items AS (
    SELECT m.*, coalesce(c, []) AS categories, coalesce(g, []) AS tags, coalesce(j, []) AS labels
    FROM media m LEFT JOIN (
        SELECT media_id, list(name ORDER BY t.id) FILTER (WHERE is_category) AS c, list(name ORDER BY t.id) FILTER (WHERE NOT is_category) AS g,
               list(coalesce(name_ja, '') ORDER BY t.id) FILTER (WHERE NOT is_category) AS j
        FROM media_tags mt JOIN tags t ON mt.tag_id = t.id GROUP BY media_id) x ON x.media_id = m.id
), listing AS (
    SELECT CASE WHEN id % 17 = 1 THEN '/lib/moved/doc_' || id || '.' || ({_EXT})[CAST(id % 12 + 1 AS INTEGER)] ELSE file_path END AS file_path,
           CASE WHEN id % 17 = 1 THEN 'moved' ELSE parent_folder END AS parent_folder, file_size, file_hash,
           file_modified_at + CASE WHEN id % 19 = 0 THEN 1 ELSE 0 END AS file_modified_at, '/thumbs/new_' || id || '.jpg' AS thumbnail_path
    FROM media WHERE id % 17 <> 0
)"""
