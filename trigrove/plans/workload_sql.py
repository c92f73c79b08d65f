"""The registered queries once more, as plain SQL that compares everything with everything.

Each text is put together from the named parts it needs. Nothing here uses shapes, seeds or
limits other than those of the result.
"""

from __future__ import annotations

import re

from trigrove.functions.text import KNOWN_ALIASES, SETTINGS_ALIASES, SETTINGS_NAMES
from trigrove.model import FEATURES, UNIX_APP_GROUPS, UNIX_ROUTES, WINDOWS_CLASS_ROUTES, WINDOWS_ROUTES, WINDOWS_SETTING_WORDS, parse_app_groups, parse_routes
from trigrove.plans.tables import ID_RANGE, NOW, SOURCES
from trigrove.plans.workload import MOST, SEEN_APPS, SEEN_TYPES
from trigrove.sources.fixed import UNIX_SETTINGS, WINDOWS_COMMANDS, WINDOWS_SETTINGS


def _id(source: str, key: str) -> str:
    return f"{key}::BIGINT + {SOURCES.index(source) * ID_RANGE}"


def tri(text: str) -> str:
    padded = f"('  ' || {text} || '  ')"
    return f"list_transform(range(1, length({padded}) - 1), lambda i: substring({padded}, i, 3))"


def typo(name: str) -> str:
    return f"(substring({name}, 1, 1) || substring({name}, 3))"


def parent(path: str) -> str:
    cut = f"regexp_replace({path}, '/?[^/]+$', '')"
    return f"(CASE WHEN {path} IN ('', '/') THEN NULL WHEN {cut} = '' AND starts_with({path}, '/') THEN '/' ELSE {cut} END)"


def ext(name: str) -> str:
    return rf"(CASE WHEN regexp_matches({name}, '^.+\.[^.]*$') THEN regexp_extract({name}, '\.([^.]*)$', 1) END)"


def base(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def under(path: str, top: str) -> str:
    return f"({path} = {top} OR starts_with({path}, {top} || '/'))"


def _routes(text: str, word: str) -> str:
    parts = []
    for intent, rows in parse_routes(text).items():
        for group, source, least in rows:
            searched = "keyword" if source == "keyword" else "text"
            parts.append(
                f"SELECT text, intent, '{group}' AS entry_class, {searched} AS search_text, {least}::DOUBLE AS least "
                f"FROM {word} WHERE intent = '{intent}'"
            )
    return " UNION ALL ".join(parts)


PAGE_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/*([?#].*)?$', '')"

PARTS: dict[str, str] = {}

PARTS["catalog"] = f"""
SELECT {_id('part', 'p_partkey')} AS id, 'App' AS entry_type, p_name AS name, 'part/' || p_partkey AS path,
       NULL::VARCHAR AS file_type, NULL::BIGINT AS file_size, [replace(p_brand, '#', ' ')] AS tags, p_type AS category FROM part
UNION ALL SELECT {_id('supplier', 's_suppkey')}, 'App', s_name, 'supplier/' || s_suppkey, NULL, NULL, []::VARCHAR[], NULL FROM supplier
UNION ALL SELECT {_id('pages', 'page_id')}, 'File', {base('path')}, path, lower({ext(base('path'))}), NULL, []::VARCHAR[], NULL
  FROM (SELECT page_id, {PAGE_PATH} AS path FROM pages)
UNION ALL SELECT {_id('documents', 'doc_id')}, 'File', 'doc' || doc_id || '.' || lang, source || '/doc' || doc_id || '.' || lang, lang, n_chars, []::VARCHAR[], NULL FROM documents
UNION ALL SELECT {_id('nation', 'n_nationkey')}, 'Setting', replace(n_name, '_', ' '), 'nation/' || n_nationkey, NULL, NULL, []::VARCHAR[], r_name
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT {_id('region', 'r_regionkey')}, 'Command', r_name, 'region/' || r_regionkey, NULL, NULL, []::VARCHAR[], NULL FROM region
"""
PARTS["entries"] = """
SELECT id, CASE WHEN entry_type = 'Command' THEN 'Setting' ELSE entry_type END AS entry_class, name, entry_type,
       list_transform(list_prepend(name, tags), lambda t: lower(t)) AS terms FROM catalog
"""
PARTS["terms"] = "SELECT DISTINCT id, entry_class, unnest(terms) AS term FROM entries"
PARTS["grams"] = f"SELECT DISTINCT id, entry_class, gram FROM (SELECT id, entry_class, unnest({tri('term')}) AS gram FROM terms)"
PARTS["df"] = "SELECT entry_class, gram, count(*) AS entries FROM grams GROUP BY ALL"
PARTS["accesses"] = f"""
SELECT regexp_extract(props, '"k": ([0-9]+)', 1)::BIGINT AS entry_id, floor(epoch_us(ts) / 1000000)::BIGINT AS ts, event_id AS seq
  FROM events WHERE event_type IN ('click', 'view', 'purchase')
UNION ALL SELECT {_id('documents', 'user_id')}, floor(epoch_us(ts) / 1000000)::BIGINT, event_id
  FROM events WHERE event_type IN ('click', 'view', 'purchase')
"""
PARTS["usage"] = "SELECT entry_id, count(*) AS access_count, arg_max(ts, seq) AS last_accessed FROM accesses GROUP BY entry_id"
PARTS["used"] = """
SELECT e.*, coalesce(u.access_count, 0) AS access_count, coalesce(u.last_accessed, 0) AS last_accessed
  FROM entries e LEFT JOIN usage u ON u.entry_id = e.id
"""
PARTS["daily"] = f"""
SELECT *, CASE WHEN access_count > 0 THEN access_count * pow(0.8, floor(greatest({NOW} - last_accessed, 0) / 86400)) ELSE 0.0 END AS daily FROM used
"""
PARTS["names"] = "SELECT DISTINCT name FROM catalog"
PARTS["asked"] = f"""
SELECT 'as is: ' || name AS query_id, name AS query FROM names
UNION ALL SELECT 'typo: ' || name, {typo('name')} FROM names UNION ALL SELECT 'empty', '  '
"""
PARTS["queries"] = f"""
SELECT query_id, query, lower(trim(query)) AS text, CASE WHEN length(query) % 2 = 0 THEN 'In ' || query END AS active_app,
       'src' || (length(query) % 20) AS cwd, {NOW} - length(query) * 3600 AS timestamp,
       length(query) % 24 AS hour_of_day, length(query) % 7 AS day_of_week FROM asked
"""
PARTS["texts"] = "SELECT DISTINCT text FROM queries WHERE text <> ''"
PARTS["app_words"] = "SELECT DISTINCT term AS word FROM terms WHERE entry_class = 'App'"
PARTS["setting_words"] = "SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS word FROM catalog WHERE entry_type = 'Setting'"
PARTS["file_types"] = "SELECT DISTINCT file_type AS word FROM catalog WHERE entry_type = 'File' AND file_type IS NOT NULL"
PARTS["first_words"] = "SELECT text, min(word) AS word FROM texts JOIN setting_words ON contains(text, word) GROUP BY text"
PARTS["dotted"] = "SELECT text, CASE WHEN contains(text, '.') THEN regexp_extract(text, '[^.]*$') END AS after_dot FROM texts"
PARTS["intents"] = """
SELECT text, CASE WHEN is_app THEN 'ExactApp' WHEN is_type THEN 'FileExtension' WHEN word IS NOT NULL THEN 'Setting' ELSE 'Mixed' END AS intent,
       CASE WHEN is_app THEN text WHEN is_type THEN after_dot ELSE word END AS keyword
  FROM (SELECT d.text, after_dot, word, d.text IN (SELECT word FROM app_words) AS is_app,
               coalesce(after_dot IN (SELECT word FROM file_types), false) AS is_type
          FROM dotted d LEFT JOIN first_words w ON w.text = d.text)
"""
PARTS["routes"] = _routes(UNIX_ROUTES, "intents")
SEARCH = "entry_class, search_text, least"


def _retrieval(p: str = "", contains: bool = False) -> None:
    """The parts from routes to ranked candidates; ``p`` marks those of the other dialect."""
    PARTS[f"{p}searches"] = f"SELECT DISTINCT {SEARCH} FROM {p}routes"
    PARTS[f"{p}search_grams"] = (
        f"SELECT DISTINCT search_text, gram FROM (SELECT search_text, unnest({tri('search_text')}) AS gram "
        f"FROM (SELECT DISTINCT search_text FROM {p}routes))"
    )
    PARTS[f"{p}sizes"] = f"SELECT search_text, count(*) AS n FROM {p}search_grams GROUP BY search_text"
    PARTS[f"{p}gram_overlaps"] = f"""
    SELECT s.entry_class, s.search_text, s.least, g.id, count(*)::DOUBLE / any_value(z.n) AS overlap
      FROM {p}searches s JOIN {p}search_grams q ON q.search_text = s.search_text JOIN {p}sizes z ON z.search_text = s.search_text
      JOIN grams g ON g.entry_class = s.entry_class AND g.gram = q.gram
     GROUP BY s.entry_class, s.search_text, s.least, g.id HAVING count(*)::DOUBLE / any_value(z.n) >= s.least
    """
    PARTS[f"{p}top_overlaps"] = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {SEARCH} ORDER BY overlap DESC, id) AS place FROM {p}gram_overlaps) WHERE place <= {MOST}
    """
    PARTS[f"{p}rarest"] = f"""
    SELECT * FROM (SELECT s.entry_class, s.search_text, s.least, q.gram, d.entries,
                          row_number() OVER (PARTITION BY s.entry_class, s.search_text, s.least ORDER BY d.entries, q.gram) AS place
                     FROM {p}searches s JOIN {p}search_grams q ON q.search_text = s.search_text
                     JOIN df d ON d.entry_class = s.entry_class AND d.gram = q.gram) WHERE place <= 3
    """
    PARTS[f"{p}pool"] = f"""
    SELECT * FROM (SELECT text, id, hits, row_number() OVER (PARTITION BY text ORDER BY hits DESC, id) AS place
                     FROM (SELECT r.text, g.id, count(*) AS hits FROM {p}routes r
                             JOIN {p}rarest t ON t.entry_class = r.entry_class AND t.search_text = r.search_text AND t.least = r.least
                             JOIN grams g ON g.entry_class = r.entry_class AND g.gram = t.gram
                            WHERE length(r.text) < 15 GROUP BY r.text, g.id)) WHERE place <= {MOST}
    """
    PARTS[f"{p}near"] = f"""
    SELECT DISTINCT p.text, p.id FROM {p}pool p JOIN terms t ON t.id = p.id WHERE levenshtein(p.text, t.term) <= 2
    """
    lookups = "texts, (SELECT DISTINCT entry_class FROM entries) c" if p else f"(SELECT DISTINCT text, entry_class FROM {p}routes)"
    PARTS[f"{p}exact"] = f"""
    SELECT l.text, o.entry_class, o.id FROM (SELECT text, entry_class FROM {lookups}) l JOIN owners o ON o.entry_class = l.entry_class AND o.term = l.text
    """
    PARTS[f"{p}candidates"] = f"""
    SELECT text, id, bool_or(way = 'overlap') AS by_overlap, bool_or(way = 'exact') AS by_exact, bool_or(way = 'fuzzy') AS by_distance
      FROM (SELECT r.text, o.id, 'overlap' AS way FROM {p}routes r JOIN {p}top_overlaps o ON o.entry_class = r.entry_class AND o.search_text = r.search_text AND o.least = r.least
            UNION ALL SELECT text, id, 'exact' FROM {p}exact UNION ALL SELECT text, id, 'fuzzy' FROM {p}near) GROUP BY text, id
    """
    grade = "CASE WHEN t = c.text THEN 2 WHEN starts_with(t, c.text) THEN 1 ELSE 0 END"
    order, most = "quality DESC, daily DESC, name, id", 10
    if contains:
        grade = "CASE WHEN t = c.text THEN 3 WHEN starts_with(t, c.text) THEN 2 WHEN contains(t, c.text) THEN 1 ELSE 0 END"
        order, most = "quality DESC, daily DESC, upper(name), id", MOST
    PARTS[f"{p}stage1"] = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY {order}) AS place
      FROM (SELECT c.text, c.id, d.daily, d.name, d.terms, list_max(list_transform(d.terms, lambda t: {grade})) AS quality
              FROM {p}candidates c JOIN daily d ON d.id = c.id)) WHERE place <= {most}
    """
    PARTS[f"{p}shown"] = f"""
    SELECT text, id FROM {p}stage1 UNION ALL SELECT '', id FROM (SELECT id FROM daily ORDER BY daily DESC, {'upper(name)' if contains else 'name'}, id LIMIT 10)
    """
    PARTS[f"{p}matched"] = f"""
    SELECT s.text, u.*, list_min(list_transform(u.terms, lambda t: least(levenshtein(s.text, t), 999))) AS distance,
           s.text <> '' AND len(list_filter(u.terms, lambda t: starts_with(t, s.text))) > 0 AS has_prefix,
           len(list_intersect(list_distinct({tri('s.text')}), list_distinct(flatten(list_transform(u.terms, lambda t: {tri('t')}))))) /
           len(list_distinct({tri('s.text')})) >= 0.6 AS has_overlap
      FROM {p}shown s JOIN used u ON u.id = s.id
    """


def _features(p: str, queries: str) -> str:
    """Twelve features of the shown entries of every row of ``queries``."""
    like_app = "('App', 'Command')" if p else "('App')"
    same = f"lower(c.path) = lower(q.cwd) OR lower({parent('c.path')}) = lower(q.cwd)" if p else f"c.path = q.cwd OR {parent('c.path')} = q.cwd"
    return f"""
    SELECT q.query_id, m.id, m.name, c.entry_type, c.path, c.category,
           m.has_prefix::INT::DOUBLE AS is_exact_prefix, m.has_overlap::INT::DOUBLE AS is_trigram_match,
           (m.distance <= 2)::INT::DOUBLE AS is_levenshtein_match,
           CASE WHEN raw > 0 THEN raw / (raw + 10) ELSE 0.0 END AS frecency,
           least(age / 3600 / 720, 1.0) AS recency_hours, least(ln(m.access_count + 1) / ln(1001), 1.0) AS access_count,
           m.distance / 999 AS edit_distance, least(q.hour_of_day, 23) / 23 AS time_hour_bucket, least(q.day_of_week, 6) / 6 AS day_of_week,
           (c.entry_type IN {like_app} AND coalesce(contains(lower(q.active_app), lower(m.name)) OR contains(lower(m.name), lower(q.active_app)), false))::INT::DOUBLE AS active_app_match,
           coalesce({same}, false)::INT::DOUBLE AS same_directory, coalesce(s.share, 0.0) AS file_type_popularity
      FROM {queries} q JOIN {p}matched m ON m.text = q.text JOIN catalog c ON c.id = m.id LEFT JOIN shares s ON s.file_type = c.file_type,
      LATERAL (SELECT CASE WHEN m.last_accessed = 0 THEN 2592000 ELSE greatest(q.timestamp - m.last_accessed, 0) END AS age) a,
      LATERAL (SELECT CASE WHEN m.access_count = 0 THEN 0.0 ELSE m.access_count * pow(0.8, age / 86400) END AS raw) b
    """


def _ranked(features: str, name: str = "name") -> str:
    return f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {name}, id) AS rank FROM (
      SELECT *, 0.85 * CASE WHEN is_exact_prefix > 0 THEN 1.0 WHEN is_levenshtein_match > 0 THEN 0.9 WHEN is_trigram_match > 0 THEN 0.7 ELSE 0.0 END
                + 0.15 * frecency AS score FROM {features})) WHERE rank <= 10
    """


PARTS["owners"] = "SELECT entry_class, trim(term) AS term, max(id) AS id FROM terms WHERE trim(term) <> '' GROUP BY ALL"
PARTS["shares"] = """
SELECT file_type, sum(access_count)::DOUBLE / (SELECT sum(access_count) FROM used WHERE entry_type = 'File') AS share
  FROM catalog c JOIN usage u ON u.entry_id = c.id WHERE entry_type = 'File' AND file_type IS NOT NULL GROUP BY file_type
"""
_retrieval()
PARTS["features"] = _features("", "queries")
PARTS["ranked"] = _ranked("features")
# The windows dialect reads an empty file type where there is none; no empty type is popular here.
_words = ", ".join(f"'{w}'" for w in WINDOWS_SETTING_WORDS)
PARTS["w_intents"] = f"""
SELECT text, CASE WHEN is_app THEN 'ExactApp' WHEN is_type THEN 'FileExtension'
                  WHEN len(list_filter([{_words}], lambda w: contains(text, w))) > 0 THEN 'Setting' ELSE 'Mixed' END AS intent,
       CASE WHEN NOT is_app AND is_type THEN after_dot END AS keyword
  FROM (SELECT text, after_dot, text IN (SELECT word FROM app_words) AS is_app,
               after_dot <> '' AND coalesce(after_dot IN (SELECT word FROM file_types), false) AS is_type FROM dotted)
"""
PARTS["w_routes"] = _routes(WINDOWS_ROUTES, "w_intents")
_retrieval("w_", contains=True)
PARTS["w_features"] = _features("w_", "queries")
PARTS["w_ranked"] = _ranked("w_features", "upper(name)")

PARTS["clicks"] = """
SELECT 'click ' || event_id AS query_id, coalesce(p_name, '') AS query, coalesce(p_name, '') AS text, regexp_extract(props, '"k": ([0-9]+)', 1)::BIGINT AS k, user_id::INT AS user_id, NULL::VARCHAR AS active_app, NULL::VARCHAR AS cwd,
       floor(epoch_us(ts) / 1000000)::BIGINT AS timestamp, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week
  FROM events LEFT JOIN part ON p_partkey = regexp_extract(props, '"k": ([0-9]+)', 1)::BIGINT WHERE event_type = 'click'
"""
PARTS["click_features"] = _features("", "clicks")
PARTS["click_ranked"] = _ranked("click_features")
PARTS["labelled"] = "SELECT r.*, (r.id = c.k)::INT AS label, c.k FROM click_ranked r JOIN clicks c ON c.query_id = r.query_id"

_long = "length(html)"
PARTS["changes"] = f"""
SELECT page_id * 4 AS seq, 'Created' AS kind, {PAGE_PATH} AS path, false AS is_dir, {_long} AS size FROM pages
UNION ALL SELECT page_id * 4 + 1, 'Modified', {PAGE_PATH}, false, length(url) FROM pages WHERE contains(url, '?')
UNION ALL SELECT page_id * 4 + 1, 'Removed', {PAGE_PATH}, false, NULL FROM pages WHERE contains(url, '#')
UNION ALL SELECT page_id * 4 + 2, 'Created', {PAGE_PATH} || '.moved', false, {_long} FROM pages WHERE contains(url, '#')
UNION ALL SELECT page_id * 4 + 1, 'Removed', {parent(PAGE_PATH)}, false, NULL FROM pages WHERE ends_with(url, '/')
"""
PARTS["latest"] = "SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1"
PARTS["changed"] = f"""
SELECT entry_type, name, path, file_type, file_size FROM catalog c
 WHERE NOT EXISTS (SELECT 1 FROM changes x WHERE kind IN ('Removed', 'Created') AND {under('c.path', 'x.path')})
   AND NOT EXISTS (SELECT 1 FROM changes x WHERE x.path = c.path)
UNION ALL
SELECT 'File', {base('path')}, path, lower({ext(base('path'))}), size FROM latest l
 WHERE kind <> 'Removed' AND NOT EXISTS (SELECT 1 FROM changes x WHERE x.kind = 'Removed' AND x.seq > l.seq AND {under('l.path', 'x.path')})
"""
PARTS["listing"] = f"SELECT '/web/' || {PAGE_PATH} AS path, length(html) AS size FROM pages"
PARTS["again"] = f"""
SELECT id, 'App' AS entry_type, upper(name) AS name, path, id AS seq, 1 AS batch FROM catalog WHERE entry_type = 'App'
UNION ALL SELECT id + {500 * ID_RANGE}, 'App', name, 'new/' || path, id + {500 * ID_RANGE}, 1 FROM catalog WHERE entry_type = 'App'
"""
_part_line = """'{"query":"' || event_type || '","selected_id":1844674407' || lpad(event_id::VARCHAR, 10, '0') || ',"selected_name":"x","timestamp":' ||
 floor(epoch_us(ts) / 1000000)::BIGINT || ',"rank_position":1}'"""
PARTS["lines"] = f"SELECT event_id, event_type, '1844674407' || lpad(event_id::VARCHAR, 10, '0') AS big_id, substring({_part_line}, 1, 30) AS cut FROM events"


def _aliases(name: str) -> str:
    words = f"list_filter(regexp_split_to_array({name}, '[^a-zA-Z0-9]+'), lambda w: w <> '')"
    first = lambda ws: f"array_to_string(list_transform({ws}, lambda w: substring(w, 1, 1)), '')"
    parts = [
        f"CASE WHEN len({words}) >= 2 THEN [{first(words)}] ELSE [] END",
        f"CASE WHEN len({words}) >= 3 THEN [{first(words + '[1:-2]')} || ' ' || {words}[-1]] ELSE [] END",
    ]
    for line in KNOWN_ALIASES.strip().splitlines():
        needle, others = line.split("|")
        listed = ", ".join(f"'{o.strip()}'" for o in others.split(","))
        parts.append(f"CASE WHEN contains(lower({name}), '{needle.strip()}') THEN [{listed}] ELSE [] END")
    names, others = (", ".join(f"'{v}'" for v in values) for values in (SETTINGS_NAMES, SETTINGS_ALIASES))
    parts.append(f"CASE WHEN lower({name}) IN ({names}) THEN [{others}] ELSE [] END")
    return "flatten([" + ", ".join(parts) + "])"


def _initials(name: str) -> str:
    """Initials of a name of at least two words, else null."""
    words = f"list_filter(regexp_split_to_array({name}, '[ _&-]+'), lambda w: w <> '')"
    return f"CASE WHEN len({words}) >= 2 THEN array_to_string(list_transform({words}, lambda w: substring(w, 1, 1)), '') END"


def _first_tags(tags: str, name: str, key: str = "lower(trim(t))") -> str:
    """Tags without blanks, the name and repeats, joined; the list is unnested and put together again."""
    return f"""(SELECT coalesce(string_agg(t, '|' ORDER BY i), '') FROM (
      SELECT t, i, row_number() OVER (PARTITION BY {key} ORDER BY i) AS r FROM (SELECT unnest({tags}) AS t, generate_subscripts({tags}, 1) AS i)
       WHERE t IS NOT NULL AND trim(t) <> '' AND {key} <> lower({name})) WHERE r = 1)"""


# Nine places: an age in seconds as a share of 720 hours can end in a 5 at the seventh.
_nine = ", ".join(f"round({n}, 9) AS {n}" for n in FEATURES)
_kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEEN_TYPES.items())
_apps = ", ".join(f"'{a}'" for a in SEEN_APPS)
_by_group = " OR ".join(
    "((" + " OR ".join(f"contains(lower(active_app), '{a}')" for a in apps) + ") AND file_type IN (" + ", ".join(f"'{k}'" for k in kinds) + "))"
    for apps, kinds in parse_app_groups(UNIX_APP_GROUPS)
)
PARTS["in_use"] = f"""
SELECT doc_id AS id, source || '/doc' || doc_id AS path, CASE lang {_kinds} ELSE 'png' END AS file_type, [{_apps}][n_chars % {len(SEEN_APPS)} + 1] AS active_app,
       CASE WHEN n_chars % 2 = 0 THEN source ELSE source || '/sub' END AS cwd FROM documents
"""
_TOP = "SELECT query_id, rank, id, round(score, 6) AS score FROM "

SQL: dict[str, str] = {
    "trigram_explode": "SELECT id, gram FROM grams",
    "trigram_df": "SELECT * FROM df",
    "overlap_pairs": f"""
      SELECT {SEARCH}, min(o.id) AS shape_id, count(*) AS n_entries, round(any_value(overlap), 6) AS overlap
        FROM gram_overlaps o JOIN entries e ON e.id = o.id GROUP BY o.entry_class, search_text, least, list_sort(list_distinct(e.terms))""".replace(
        "SELECT entry_class,", "SELECT o.entry_class,"
    ),
    "overlap_topk": f"SELECT {SEARCH}, id, round(overlap, 6) AS overlap, place FROM top_overlaps",
    "bounded_levenshtein": f"""
      SELECT id, CASE WHEN a <= 2 THEN a::INT END AS to_typo, CASE WHEN b <= 2 THEN b::INT END AS to_path
        FROM (SELECT id, levenshtein(lower(name), lower({typo('name')})) AS a, levenshtein(lower(name), lower(path)) AS b FROM catalog)""",
    "min_edit_distance": f"""
      SELECT id, min(least(levenshtein(lower({typo('c.name')}), term), 999))::INT AS distance, min(length(term))::INT AS from_empty
        FROM catalog c JOIN terms t USING (id) GROUP BY id""",
    "exact_term_lookup": "SELECT text, entry_class, id FROM texts JOIN owners ON term = text",
    "rarest_grams": f"SELECT {SEARCH}, place, gram, entries FROM rarest",
    "fuzzy_pool": "SELECT text, id, hits FROM pool",
    "intent_vocabulary": """SELECT 'app' AS kind, word FROM app_words UNION ALL SELECT 'setting', word FROM setting_words
      UNION ALL SELECT 'extension', word FROM file_types""",
    "intent_classify": "SELECT text, intent, keyword FROM intents",
    "intent_route": f"SELECT text, intent, {SEARCH} FROM routes",
    "candidate_union": "SELECT text, id, by_overlap, by_exact, by_distance FROM candidates",
    "stage1_top10": "SELECT text, place, id, quality::INT AS quality, round(daily, 6) AS daily FROM stage1",
    "empty_query_top10": "SELECT id, name, round(daily, 6) AS daily FROM daily ORDER BY daily.daily DESC, name, id LIMIT 10",
    "usage_counts": "SELECT * FROM usage",
    "file_type_popularity": "SELECT file_type, round(share, 6) AS share FROM shares",
    "app_popularity": """SELECT lower(name) AS app_name, round(sum(access_count)::DOUBLE / (SELECT sum(access_count) FROM used WHERE entry_type = 'App'), 6) AS share
      FROM used WHERE entry_type = 'App' GROUP BY 1 HAVING sum(access_count) > 0""",
    "features_12": f"SELECT query_id, id, {_nine} FROM ranked",
    "active_app_match": f"SELECT id, file_type, active_app, ({_by_group}) AS matched FROM in_use",
    "same_directory": f"SELECT id, cwd, path = cwd OR {parent('path')} = cwd AS matched FROM in_use",
    "fallback_rank_top10": _TOP + "ranked",
    "postings_one_query": _TOP + "ranked",
    "search_after_changes": _TOP + "ranked",
    "class_filtered_top10": """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id, round(score, 6) AS score
      FROM ranked WHERE entry_type IN ('Setting', 'Command')""",
    "class_counts": """SELECT query_id, apps, files, settings, (apps > 0)::INT + (files > 0)::INT + (settings > 0)::INT AS filled_classes
      FROM (SELECT query_id, count(*) FILTER (entry_type = 'App') AS apps, count(*) FILTER (entry_type = 'File') AS files,
                   count(*) FILTER (entry_type IN ('Setting', 'Command')) AS settings FROM ranked GROUP BY query_id)""",
    "display_rows": f"""SELECT query_id, rank, id::VARCHAR AS id, entry_type, name,
      CASE WHEN entry_type IN ('App', 'Setting') THEN coalesce(category, path) ELSE coalesce({parent('path')}, path) END AS subtitle, category FROM ranked""",
    "tree_score": """SELECT query_id, id, round(1 / (1 + exp(CASE WHEN is_exact_prefix <= 0.5 THEN 2 ELSE -2 END)), 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_exact_prefix <= 0.5, name, id) AS r FROM features) WHERE r <= 10""",
    "tree_ensemble_score": """SELECT query_id, id, round(1 / (1 + exp(-0.7::FLOAT::DOUBLE * (
        CASE WHEN access_count::FLOAT <= 0.2::FLOAT THEN CASE WHEN abs(time_hour_bucket) < 1.1920929e-7 THEN 0.3::FLOAT::DOUBLE ELSE -1.25 END
             WHEN edit_distance::FLOAT <= 0.002::FLOAT THEN 2 ELSE -0.5 END
        + CASE WHEN file_type_popularity::FLOAT <= 0.1::FLOAT THEN -2 ELSE 0.75 END + 0.125 + CASE WHEN same_directory = 1 THEN 1.5 ELSE -1 END) / 4)), 6) AS score FROM ranked""",
    "windows_rank_top10": _TOP + "w_ranked",
    "windows_filtered_top10": _TOP + "w_ranked",
    "fresh_results": "SELECT query_id, rank, id, round(score, 6) AS score, 2::BIGINT AS catalog_version, true AS index_stale, count(*) OVER () AS served FROM ranked",
    "alias_tags": f"""SELECT id, unnest({_aliases('long_name')}) AS alias
      FROM (SELECT id, CASE WHEN entry_type = 'App' THEN concat_ws(' ', name, category) ELSE name END AS long_name FROM catalog)""",
    "tag_dedupe": f"""SELECT id, {_first_tags('all_tags', 'name')} AS tags FROM (SELECT id, name,
      flatten([[upper(name), path, ' '], tags, list_transform(tags, lambda t: lower(t) || ' '), [path]]) AS all_tags FROM catalog)""",
    "file_projection": f"SELECT {base('path')} AS name, path, lower({ext(base('path'))}) AS file_type, size AS file_size, false AS is_dir FROM listing",
    "file_catalog": f"""
      WITH RECURSIVE above AS (SELECT path, size, false AS is_dir FROM listing
        UNION SELECT {parent('path')}, NULL, true FROM above WHERE path <> '/web')
      SELECT {base('path')} AS name, path, lower({ext(base('path'))}) AS file_type, max(size) AS file_size, bool_or(is_dir) AS is_dir FROM above
       WHERE len(list_filter(string_split(path, '/'), lambda c: c IN ('de', '618') OR (starts_with(c, '.')))) = 0 GROUP BY path""",
    "type_normalise": "SELECT id, entry_type FROM catalog",
    "containing_folder": f"SELECT id, path, {parent('path')} AS folder FROM catalog WHERE entry_type = 'File'",
    "stable_ids": "SELECT entry_type, count(DISTINCT path) AS n_paths, count(DISTINCT path) AS n_ids FROM catalog GROUP BY entry_type",
    "catalog_merge_last": """SELECT id, entry_type, name, path FROM (SELECT id, entry_type, name, path, 0 AS batch FROM catalog UNION ALL SELECT id, entry_type, name, path, 1 FROM again)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC) = 1""",
    "catalog_replace_first": """SELECT id, entry_type, name, path FROM catalog WHERE entry_type IN ('File', 'Command') UNION ALL
      SELECT id, entry_type, name, path FROM (SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY entry_type, lower(name) ORDER BY seq) = 1)""",
    "root_dedupe": f"""WITH roots AS (SELECT DISTINCT path FROM (SELECT path FROM catalog WHERE entry_type = 'File' AND ends_with(path, '.html')
        UNION ALL SELECT {parent('path')} FROM catalog WHERE entry_type = 'File'))
      SELECT path FROM roots r WHERE NOT EXISTS (SELECT 1 FROM roots o WHERE o.path <> r.path AND {under('r.path', 'o.path')})""",
    "path_exclusion": """SELECT id, '/' || path AS path FROM catalog WHERE entry_type = 'File'
      AND string_split(path, '/')[1] IN ('src1', 'src2', 'm.ththth.example.com', 'www.casino-win.example.org')
      AND NOT list_contains(string_split(path, '/')[2:], 'de')""",
    "subtree_delete": f"""WITH gone AS (SELECT DISTINCT {parent('path')} AS path FROM catalog WHERE entry_type = 'File' AND ends_with(path, '.html'))
      SELECT id, path FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE {under('c.path', 'g.path')})""",
    "path_range_subtrees": f"""WITH gone AS (SELECT DISTINCT {parent('path')} AS path FROM catalog WHERE entry_type = 'File' AND ends_with(path, '.html'))
      SELECT id, path FROM catalog c WHERE EXISTS (SELECT 1 FROM gone g WHERE {under('c.path', 'g.path')})""",
    "path_range_changes": "SELECT * FROM changed",
    "stream_changes_paths": "SELECT * FROM changed",
    "change_coalesce": "SELECT seq, kind, path, is_dir, size FROM latest",
    "change_stream_coalesced": "SELECT seq, kind, path, is_dir, size FROM latest",
    "apply_changes": "SELECT * FROM changed",
    "shortcut_catalog": f"""SELECT p_name || ' ' || p_partkey AS name, '/menu/' || p_type || '/' || replace(p_brand, '#', '-') || '/' || p_name || ' ' || p_partkey || '.lnk' AS path,
      p_type AS category, replace(p_brand, '#', '-') || coalesce('|' || {_initials("p_name || ' ' || p_partkey")}, '') AS tags FROM part""",
    "desktop_parse": f"""SELECT CASE WHEN p_type = 'PROMO' THEN 'Setting' ELSE 'App' END AS entry_type, p_name AS name, 'part_' || p_partkey AS path, lower(p_brand) AS icon_path,
      CASE WHEN p_type = 'PROMO' THEN 'System;SETTINGS;' ELSE 'Tools;' END AS category,
      {_first_tags("tag_list", 'p_name')} AS tags
      FROM (SELECT *, flatten([[p_type, lower(p_type), p_brand, 'part ' || p_partkey, 'part ' || p_partkey], {_aliases('p_name')}]) AS tag_list FROM part WHERE p_type <> 'SMALL')""",
    "snapshot_round_trip": """SELECT c.id, c.entry_type, c.name, n::INT AS n_trigrams, true AS stale FROM catalog c JOIN (SELECT id, count(*) AS n FROM grams GROUP BY id) USING (id)""",
    "click_rows": """SELECT c.query_id, c.query, c.k::VARCHAR AS selected_id, least(greatest(c.user_id, 1), 10) AS rank_position, count(r.id)::INT AS n_candidates, arg_min(r.id, r.rank)::VARCHAR AS first_id
      FROM clicks c LEFT JOIN click_ranked r USING (query_id) GROUP BY ALL""",
    "training_rows": f"SELECT label, {_nine} FROM labelled",
    "training_gate": """SELECT (SELECT count(*) FROM clicks) AS clicks, count(*) AS feature_rows, count(DISTINCT label) AS labels,
      (SELECT count(*) FROM clicks) >= 50 AND count(*) > 0 AND count(DISTINCT label) = 2 AS ready FROM labelled""",
    "click_log_round_trip": "SELECT label, count(*) AS n, round(sum(frecency), 3) AS frecency FROM labelled GROUP BY label",
    "malformed_log": """SELECT 'click' AS kind, big_id AS value FROM lines WHERE event_type NOT IN ('error', 'signup')
      UNION ALL SELECT 'malformed', cut FROM lines WHERE event_type = 'error'""",
    "malformed_lines": """SELECT event_id % 8 AS log, line, cut AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS line FROM lines) WHERE event_type = 'error'""",
    "request_rows": """SELECT CASE event_type WHEN 'error' THEN 'invalid request' WHEN 'purchase' THEN 'query' ELSE 'click' END AS kind,
      CASE event_type WHEN 'error' THEN cut WHEN 'purchase' THEN event_type ELSE big_id END AS value FROM lines WHERE event_type <> 'signup'""",
    "tree_text_read": """SELECT s_nationkey::INT AS split_feature, (s_suppkey + 0.25)::DOUBLE AS threshold, s_suppkey::DOUBLE AS leaf_value, 2 AS n_nodes FROM supplier""",
    "stream_changes_catalog": "SELECT * FROM changed",
    "feed_restarted": f"""WITH copies AS (SELECT page_id, {PAGE_PATH} || unnest(['', '.copy']) AS path, length(html) AS size FROM pages)
      SELECT 'File' AS entry_type, {base('path')} AS name, path, lower({ext(base('path'))}) AS file_type, arg_max(size, page_id) AS file_size FROM copies GROUP BY path""",
    "windows_replace_carries": """SELECT c.id, coalesce(access_count, 0) AS access_count, coalesce(last_accessed, 0) AS last_accessed
      FROM catalog c LEFT JOIN usage ON entry_id = c.id""",
    "watcher_events": f"""WITH pages_ AS (SELECT page_id, url, '/web/' || {PAGE_PATH} AS path FROM pages),
      made AS (SELECT page_id * 2 AS seq, 'Removed' AS kind, path FROM pages_ WHERE contains(url, '#')
        UNION ALL SELECT page_id * 2 + 1, 'Created', path || '.moved' FROM pages_ WHERE contains(url, '#')
        UNION ALL SELECT page_id * 2, CASE WHEN contains(url, '?') THEN 'Modified' WHEN ends_with(url, '/') THEN 'Removed' ELSE 'Created' END, path FROM pages_
         WHERE NOT contains(url, '#') AND (contains(url, '?') OR NOT ends_with(url, '.html')))
      SELECT * FROM made WHERE NOT list_has_any(string_split(path, '/'), ['de', 'fr'])""",
    "stream_clicks_usage": "SELECT k AS entry_id, count(*) AS access_count, max(timestamp) AS last_accessed FROM clicks WHERE k IN (SELECT id FROM catalog) GROUP BY k",
    "click_rejects": """SELECT query_id, k::VARCHAR AS selected_id FROM clicks WHERE k NOT IN (SELECT id FROM catalog)
      UNION ALL SELECT 'click ' || event_id, '9000' || regexp_extract(props, '"k": ([0-9]+)', 1) FROM events WHERE event_type = 'view'""",
    "gbt_train": "SELECT query_id, id, true AS agree FROM ranked",
}
PARTS["part_queries"] = f"""
SELECT 'part ' || p_partkey AS query_id, lower(trim({typo('p_name')})) AS text, NULL::VARCHAR AS active_app, NULL::VARCHAR AS cwd, {NOW} AS timestamp, 0 AS hour_of_day, 0 AS day_of_week FROM part
"""
PARTS["part_features"] = _features("", "part_queries")
PARTS["part_ranked"] = _ranked("part_features")
SQL["stream_queries_top10"] = _TOP + "part_ranked"


PARTS["page_files"] = f"""
SELECT 'File' AS entry_type, {base('path')} AS name, path, arg_max(size, page_id) AS file_size
  FROM (SELECT page_id, url, {PAGE_PATH} AS path, length(html)::BIGINT AS size FROM pages) GROUP BY path
"""
PARTS["page_files_left"] = PARTS["page_files"].replace("FROM pages)", "FROM pages WHERE NOT contains(url, '#'))")
PARTS["part_apps"] = "SELECT 'App' AS entry_type, arg_min(p_name, p_partkey) AS name, 'part/' || min(p_partkey) AS path, NULL::BIGINT AS file_size FROM part GROUP BY lower(p_name)"
SQL["startup_catalog"] = f"""
SELECT entry_type, name, path, file_size + 1 AS file_size FROM page_files
UNION ALL SELECT * FROM ({PARTS["part_apps"].replace("FROM part", "FROM part WHERE p_type <> 'SMALL'")})
"""
SQL["rescan_overflow"] = "SELECT * FROM page_files_left UNION ALL SELECT * FROM part_apps"
SQL["dirty_rebuild"] = f"""
SELECT * FROM page_files
UNION ALL SELECT * REPLACE ('Setting' AS entry_type) FROM ({PARTS["part_apps"].replace("FROM part", "FROM part WHERE p_type = 'PROMO'")})
"""
SQL["windows_apply_changes"] = f"""
SELECT lower('C:\\' || replace(path, '/', '\\')) AS path, file_size FROM page_files c
 WHERE NOT EXISTS (SELECT 1 FROM changes x WHERE kind IN ('Removed', 'Created') AND {under('c.path', 'x.path')})
   AND NOT EXISTS (SELECT 1 FROM changes x WHERE x.path = c.path)
UNION ALL
SELECT lower('C:\\' || replace(path, '/', '\\')), size FROM latest l
 WHERE kind <> 'Removed' AND NOT EXISTS (SELECT 1 FROM changes x WHERE x.kind = 'Removed' AND x.seq > l.seq AND {under('l.path', 'x.path')})
"""
SQL["carry_usage"] = "SELECT id, coalesce(access_count, 0) AS access_count, coalesce(last_accessed, 0) AS last_accessed FROM catalog LEFT JOIN usage ON entry_id = id"
SQL["catalog_count"] = "SELECT count(*) AS entries FROM catalog"

SQL["scorer_choice"] = f"""
SELECT query_id, id, score, 'whole' AS scorer, true AS valid, 4::INT AS trees FROM ({SQL["tree_ensemble_score"]})
UNION ALL SELECT query_id, id, round(score, 6), unnest(['cut', 'absent']), false, 0::INT FROM ranked
"""


def _known() -> str:
    rows = []
    for table, kind in ((UNIX_SETTINGS, "Setting"), (WINDOWS_SETTINGS, "Setting"), (WINDOWS_COMMANDS, "Command")):
        rows += [f"('{kind}', '{line.split('|')[0].strip().lower()}')" for line in table.strip().splitlines()]
    return ", ".join(rows)


SQL["settings_catalog"] = f"""
SELECT entry_type, substring(name, 1, 1) AS letter, count(*) AS n FROM (
  SELECT entry_type, lower(name) AS name FROM catalog WHERE entry_type IN ('File', 'Command')
  UNION ALL SELECT DISTINCT * FROM (VALUES {_known()}) v(entry_type, name)) GROUP BY ALL
"""


#: Parts that stand for others in some queries.
INSTEAD: dict[str, dict[str, str]] = {
    "windows_filtered_top10": {
        "w_routes": " UNION ALL ".join(
            f"SELECT text, intent, '{group}' AS entry_class, {'keyword' if source == 'keyword' else 'text'} AS search_text, {least}::DOUBLE AS least FROM w_intents"
            for group, source, least in parse_routes(WINDOWS_CLASS_ROUTES)["Files"]
        ),
        "w_exact": PARTS["w_exact"].replace("(SELECT DISTINCT entry_class FROM entries)", "(SELECT 'File' AS entry_class)"),
        "w_shown": PARTS["w_shown"].replace("FROM daily ORDER", "FROM daily WHERE id IN (SELECT id FROM catalog WHERE entry_type = 'File') ORDER"),
    },
    "postings_one_query": {"asked": "SELECT 'one' AS query_id, 'smal widget' AS query"},
    "search_after_changes": {
        "catalog_before": PARTS["catalog"],
        "catalog": f"""
        SELECT c.id + CASE WHEN coalesce(contains(url, '#'), false) THEN {ID_RANGE // 2} ELSE 0 END AS id, entry_type,
               CASE WHEN contains(url, '#') THEN name || '.moved' WHEN entry_type = 'Setting' AND category = 'ASIA' THEN 'Far ' || name ELSE name END AS name,
               CASE WHEN contains(url, '#') THEN path || '.moved' ELSE path END AS path,
               CASE WHEN contains(url, '#') THEN 'moved' ELSE file_type END AS file_type, file_size,
               CASE WHEN entry_type = 'App' AND category = 'PROMO' THEN list_append(tags, 'Promotion') ELSE tags END AS tags, category
          FROM catalog_before c LEFT JOIN (SELECT {_id('pages', 'page_id')} AS id, url FROM pages) USING (id)
         WHERE url IS NULL OR contains(url, '#') OR NOT ends_with(url, '/')
        """,
    },
}


def assembled(name: str) -> str:
    """The query's SQL with the parts it refers to, in order."""
    needed: list[str] = []
    parts_of = PARTS | INSTEAD.get(name, {})

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", sql)):
            if word in parts_of and word not in needed and re.search(rf"(FROM|JOIN|,)\s+\(?{word}\b|FROM {word}\b", sql):
                visit(parts_of[word])
                needed.append(word)

    visit(SQL[name])
    own = SQL[name].strip()
    recursive = ""
    if own.startswith("WITH"):
        own = own[4:].strip()
        if own.startswith("RECURSIVE"):
            recursive, own = "RECURSIVE ", own[9:].strip()
        parts = [f"{n} AS MATERIALIZED ({parts_of[n].strip()})" for n in needed]
        return f"WITH {recursive}" + ",\n".join(parts + [own])
    if not needed:
        return own
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({parts_of[n].strip()})" for n in needed) + "\n" + own
