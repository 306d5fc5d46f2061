"""SQL for DuckDB of the queries that SQL expresses, composed of named expressions."""

from __future__ import annotations

from gridmark.functions.layout import CASCADE
from gridmark.operators.runs import CSV_PROMPT, FORMAT_PROMPT

ORACLES: dict[str, str] = {}

_SLICES = ("front_25", "middle_50", "back_25")
_SCORES = ("weighted_score", "character_accuracy", "cell_accuracy", *_SLICES)

# Expressions. Each takes SQL expressions and gives one.


def plain(g: str) -> str:
    return f"array_to_string(list_transform({g}, lambda r: array_to_string(r, ',')), chr(10))"


def csv(g: str) -> str:
    return f"({plain(g)} || chr(10))"


def widest(g: str) -> str:
    return f"coalesce(list_max(list_transform({g}, lambda r: len(r))), 0)"


def latex(g: str) -> str:
    rows = f"array_to_string(list_transform({g}, lambda r: array_to_string(r, ' & ') || ' \\\\' || chr(10) || '\\hline' || chr(10)), '')"
    return f"('\\begin{{tabular}}{{|' || array_to_string(list_transform(range({widest(g)}), lambda k: 'c'), '|') || '|}}' || chr(10) || '\\hline' || chr(10) || {rows} || '\\end{{tabular}}' || chr(10))"


def latex_grid(p: str) -> str:
    lines = f"list_transform(string_split(replace(replace({p}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: trim(l))"
    kept = f"list_filter({lines}, lambda l: l <> '' AND NOT starts_with(l, '\\begin{{tabular}}') AND NOT starts_with(l, '\\end{{tabular}}'))"
    bare = f"list_filter(list_transform({kept}, lambda l: trim(regexp_replace(trim(replace(l, '\\hline', '')), '\\\\\\\\$', ''))), lambda l: l <> '')"
    return f"CASE WHEN contains({p}, '\\begin{{tabular}}') THEN list_transform({bare}, lambda l: list_transform(string_split(l, '&'), lambda c: trim(c))) END"


def csv_grid(t: str) -> str:
    return f"list_transform(string_split(rtrim({t}, chr(10)), chr(10)), lambda l: string_split(l, ','))"


def same_shape(a: str, b: str) -> str:
    return f"coalesce(list_transform({a}, lambda r: len(r)) = list_transform({b}, lambda r: len(r)), false)"


def matches(a: str, b: str) -> str:
    return f"len(list_filter(list_zip(flatten({a}), flatten({b})), lambda z: z[1] = z[2]))"


def cells(g: str) -> str:
    return f"len(flatten({g}))"


def cell_accuracy(a: str, b: str) -> str:
    return f"(CASE WHEN {same_shape(a, b)} THEN {matches(a, b)} / CAST(greatest({cells(b)}, 1) AS DOUBLE) ELSE 0.0::DOUBLE END)"


def char_accuracy(a: str, b: str) -> str:
    return f"(1.0::DOUBLE - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b}), 1) AS DOUBLE))"


def error_type(p: str, t: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'structure_error' WHEN len({p}) < len({t}) AND {p} = {t}[1:len({p})] THEN 'truncation' WHEN NOT {same_shape(p, t)} THEN 'structure_error' ELSE 'value_error' END"


def slice_score(k: int) -> str:
    front = "greatest(1, CAST(round_even(len(t) * 0.25, 0) AS INTEGER))"
    back = f"least(len(t), greatest({front}, CAST(round_even(len(t) * 0.75, 0) AS INTEGER)))"
    a, b = [("0", front), (front, back), (back, "len(t)")][k]
    return f"(CASE WHEN p IS NOT NULL AND len(p) > 0 AND len(p) >= {b} AND {b} > {a} THEN {cell_accuracy(f'p[{a} + 1:{b}]', f't[{a} + 1:{b}]')} ELSE 0.0::DOUBLE END)"


# Named steps.

GRID = """tok AS (
  SELECT n_nationkey AS nk, n_name AS station, r_name AS river, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS VARCHAR) AS token
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
mp AS (SELECT nk, station, river, y, map_from_entries(list({'k': m * 100 + d, 'v': token})) AS t FROM tok GROUP BY nk, station, river, y),
grid AS (SELECT nk, station, river, y, station || '_' || y || '_' || river AS name, 'flow_' || substr(sha1(station || '_' || y || '_' || river), 1, 12) AS sample_id,
  list_concat([['D/M', '1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12']],
    list_transform(range(1, 32), lambda d: list_concat([CAST(d AS VARCHAR)], list_transform(range(1, 13), lambda m: coalesce(t[m * 100 + d], ''))))) AS g FROM mp)"""


def pred(name: str = "pred", a: int = 31, b: int = 1) -> str:
    text = latex("g")
    changed = latex("list_transform(g, lambda r, i: CASE WHEN i = 6 THEN list_transform(r, lambda c, j: CASE WHEN j = 4 THEN '7' || c ELSE c END) ELSE r END)")
    ragged = f"array_to_string(list_transform(string_split({text}, chr(10)), lambda l, i: CASE WHEN i = 9 THEN regexp_replace(l, ' & [^&]*$', ' \\\\\\\\') ELSE l END), chr(10))"
    return f"""{name} AS (SELECT nk, y, sample_id, 'img/' || name || '.jpg' AS image_path, {csv('g')} AS target_csv, nk * 10000 + y AS pos,
  CASE (nk * {a} + y * {b}) % 6 WHEN 0 THEN {text} WHEN 1 THEN {changed} WHEN 2 THEN {latex('g[1:27]')} WHEN 3 THEN {ragged} WHEN 4 THEN {csv('g')}
  ELSE replace({text}, chr(10), ' ') END AS prediction FROM grid),
{name}_p AS (SELECT *, {latex_grid('prediction')} AS p, {csv_grid('target_csv')} AS t FROM {name})"""


def scored(name: str = "pred") -> str:
    a, b = f"CASE WHEN p IS NULL THEN prediction ELSE {plain('p')} END", f"CASE WHEN p IS NULL THEN target_csv ELSE {plain('t')} END"
    slices = ", ".join(f"{slice_score(k)} AS {s}" for k, s in enumerate(_SLICES))
    return f"""{name}_t AS (SELECT *, {a} AS ta, {b} AS tb FROM {name}_p),
{name}_c AS (SELECT sample_id, pos, {char_accuracy('ta', 'tb')} AS character_accuracy, {cell_accuracy('p', 't')} AS cell_accuracy, {error_type('p', 't')} AS error_type, {slices} FROM {name}_t),
{name}_s AS (SELECT *, 0.3::DOUBLE * character_accuracy + 0.7::DOUBLE * cell_accuracy AS weighted_score FROM {name}_c)"""


def structure(name: str) -> str:
    ok = same_shape("p", "t")
    return f"""{name}_m AS (SELECT sample_id, image_path, {ok} AS structure_correct, CAST(CASE WHEN {ok} THEN {matches('p', 't')} ELSE 0 END AS BIGINT) AS correct_cells, CAST({cells('t')} AS BIGINT) AS total_cells,
  CASE WHEN {ok} THEN 'correct' ELSE 'incorrect' END AS label FROM {name}_p),
{name}_x AS (SELECT *, CASE WHEN structure_correct THEN correct_cells / CAST(greatest(total_cells, 1) AS DOUBLE) ELSE 0.0::DOUBLE END AS cell_accuracy FROM {name}_m)"""


COMPARED = """cmp AS (SELECT sample_id, coalesce(nullif(b.image_path, ''), a.image_path) AS image_path, b.structure_correct AS before_structure, a.structure_correct AS after_structure,
  b.label || ' -> ' || a.label AS transition, b.cell_accuracy AS before_cell, a.cell_accuracy AS after_cell, a.cell_accuracy - b.cell_accuracy AS cell_delta,
  a.correct_cells - b.correct_cells AS correct_delta, b.total_cells FROM old_x b JOIN pred_x a USING (sample_id))"""
SUMMARY = "(SELECT count(*) AS samples, count(*) FILTER (structure_correct) AS structure_count, count(*) FILTER (structure_correct) / CAST(greatest(count(*), 1) AS DOUBLE) AS structure_accuracy, CAST(sum(correct_cells) AS BIGINT) AS correct_cells, CAST(sum(total_cells) AS BIGINT) AS total_cells, sum(correct_cells) / CAST(greatest(sum(total_cells), 1) AS DOUBLE) AS cell_accuracy FROM {0})"
DIRTY = """dirty AS (SELECT sample_id, list_concat(list_transform(g, lambda r: list_concat(r, [' ', '.'])), [list_transform(range(15), lambda k: '.'), ['']]) AS g FROM grid)"""
RUNS = "r AS (SELECT event_id AS pos, 'e' || event_id AS sample_id, event_type AS prediction, user_id FROM events)"

BOTH = f"WITH {GRID}, {pred()}, {pred('old', 17, 3)}, {structure('pred')}, {structure('old')}, {COMPARED}"
ONE = f"WITH {GRID}, {pred()}"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def add(**sql: str) -> None:
    ORACLES.update(sql)


add(
    daily_cells=f"WITH {GRID} SELECT station, CAST(y AS INTEGER) AS y, CAST(m AS INTEGER) AS m, CAST(d AS INTEGER) AS d, token FROM tok",
    grid_csv_text=f"WITH {GRID} SELECT sample_id, {csv('g')} AS csv FROM grid",
    grid_latex_text=f"WITH {GRID} SELECT sample_id, {latex('g')} AS latex FROM grid",
    normalize_targets=f"WITH {GRID}, {DIRTY}, n AS (SELECT sample_id, g, list_transform(list_filter(g, lambda r: len(list_filter(r, lambda c: trim(c) NOT IN ('', '.'))) > 0), lambda r: r[1:13]) AS n FROM dirty) SELECT sample_id, {plain('n')} AS csv, CAST(len(list_filter(g, lambda r: len(list_filter(r, lambda c: trim(c) <> '')) > 0)) AS INTEGER) AS rows_not_blank FROM n",
    header_text=f"WITH {GRID} SELECT sample_id, 'd|m,' || array_to_string(g[1][2:], ',') AS header FROM grid",
    parse_latex=f"{ONE} SELECT sample_id, CAST(coalesce(len(p), -1) AS INTEGER) AS n_rows, coalesce({plain('p')}, 'none') AS csv FROM pred_p",
    parse_target=f"{ONE} SELECT sample_id, CAST(len(t) AS INTEGER) AS n_rows, CAST({cells('t')} AS BIGINT) AS n_cells, array_to_string(t[2], '|') AS second FROM pred_p",
    pretty_latex=f"{ONE}, z AS (SELECT sample_id, prediction AS x, array_to_string(list_filter(list_transform(string_split(replace(prediction, '\\hline', chr(10) || '\\hline' || chr(10)), chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)) || chr(10) AS z FROM pred) SELECT sample_id, md5(CASE WHEN contains(x, '\\begin{{tabular}}') THEN z ELSE rtrim(x, chr(10) || ' ') || chr(10) END) AS digest FROM z",
    exploded_cells=f"WITH {GRID}, {DIRTY}, e AS (SELECT sample_id, unnest(g) AS r, generate_subscripts(g, 1) AS i FROM dirty), c AS (SELECT r, i, unnest(r) AS c, generate_subscripts(r, 1) AS j FROM e) SELECT CASE WHEN i = 1 THEN 'header' WHEN j = 1 AND len(list_filter(r, lambda x: trim(x) <> '')) > 0 THEN 'index' WHEN len(list_filter(r, lambda x: trim(x) <> '')) = 0 THEN 'separator' ELSE 'data' END AS cell_type, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars FROM c GROUP BY 1",
    table_shapes=f"{ONE} SELECT CAST(len(p) AS INTEGER) AS n_rows, CAST({widest('p')} AS INTEGER) AS n_cols, count(*) AS n FROM pred_p WHERE p IS NOT NULL GROUP BY 1, 2",
    zero_stats=f"WITH {GRID}, z AS (SELECT CAST(len(list_filter(flatten(g), lambda c: c = '')) AS BIGINT) AS z FROM grid), s AS (SELECT list_sort(list(z)) AS s FROM z) SELECT s[1] AS least, s[len(s) // 2 + 1] AS middle, s[CAST(floor(len(s) * 0.9::DOUBLE) AS BIGINT) + 1] AS tenth, s[len(s)] AS greatest, CAST(len(list_filter(s, lambda x: x >= 250)) AS BIGINT) AS high FROM s",
    score_samples=f"{ONE}, {scored()} SELECT sample_id, error_type, {rounded(*_SCORES)} FROM pred_s",
    score_summary=f"{ONE}, {scored()} SELECT count(*) AS samples, " + ", ".join(f"round(coalesce(avg({n}), 0), 6) AS {n}" for n in _SCORES) + " FROM pred_s",
    error_histogram=f"{ONE}, {scored()} SELECT error_type, count(*) AS n FROM pred_s GROUP BY 1",
    position_slices=f"{ONE}, {scored()} " + " UNION ALL ".join(f"SELECT '{s}' AS slice, round(avg({s}), 6) AS score FROM pred_s" for s in _SLICES),
    edit_distances="SELECT a.p_partkey, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance, round(1.0::DOUBLE - levenshtein(a.p_name, b.p_name) / CAST(greatest(length(a.p_name), length(b.p_name), 1) AS DOUBLE), 6) AS character_accuracy FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    compare_samples=f"{BOTH} SELECT * REPLACE (round(before_cell, 6) AS before_cell, round(after_cell, 6) AS after_cell, round(cell_delta, 6) AS cell_delta) FROM cmp",
    run_summary=f"{BOTH} SELECT * REPLACE (round(structure_accuracy, 6) AS structure_accuracy, round(cell_accuracy, 6) AS cell_accuracy) FROM {SUMMARY.format('pred_x')}",
    compare_summary=f"{BOTH} SELECT a.structure_count - b.structure_count AS structure_count, round(a.structure_accuracy - b.structure_accuracy, 6) AS structure_accuracy, a.correct_cells - b.correct_cells AS correct_cells, round(a.cell_accuracy - b.cell_accuracy, 6) AS cell_accuracy FROM {SUMMARY.format('pred_x')} a, {SUMMARY.format('old_x')} b",
    structure_transitions=f"{BOTH} SELECT transition, count(*) AS n FROM cmp GROUP BY 1",
    id_parity=f"WITH {RUNS}, b AS (SELECT sample_id FROM r WHERE pos % 7 <> 0), a AS (SELECT sample_id FROM r WHERE pos % 5 <> 0) SELECT sample_id, 'before' AS side FROM b WHERE sample_id NOT IN (SELECT sample_id FROM a) UNION ALL SELECT sample_id, 'after' FROM a WHERE sample_id NOT IN (SELECT sample_id FROM b)",
    duplicate_ids="SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
    last_of_each=f"WITH {RUNS} SELECT user_id, pos, prediction FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1",
)
_BUCKET = "CASE WHEN structure_correct THEN 'structure_correct__' ELSE 'structure_error__' END || CASE WHEN structure_correct AND correct_cells = total_cells THEN 'cell_correct' ELSE 'cell_error' END"
add(
    classify_outputs=f"{BOTH} SELECT sample_id, {_BUCKET} AS bucket FROM pred_x",
    bucket_counts=f"{BOTH}, c AS (SELECT {_BUCKET} AS bucket FROM pred_x), n AS (SELECT unnest(['structure_correct__cell_correct', 'structure_correct__cell_error', 'structure_error__cell_correct', 'structure_error__cell_error']) AS bucket) SELECT n.bucket, count(c.bucket) AS n FROM n LEFT JOIN c ON n.bucket = c.bucket GROUP BY 1",
    pick_examples=f"""WITH {GRID}, {pred()}, {pred('old', 17, 3)}, {scored()}, {scored('old')},
b AS (SELECT sample_id, round(o.weighted_score, 6) AS base_score, round(p.weighted_score, 6) AS other_score FROM old_s o JOIN pred_s p USING (sample_id)),
improved AS (SELECT * FROM b ORDER BY other_score - base_score DESC, sample_id LIMIT 1), best AS (SELECT * FROM b ORDER BY (base_score + other_score) / 2 DESC, sample_id LIMIT 1),
fail AS (SELECT * FROM b WHERE base_score < 1 AND other_score < 1 ORDER BY (base_score + other_score) / 2, sample_id LIMIT 1), success AS (SELECT * FROM b WHERE base_score = 1 AND other_score = 1 ORDER BY sample_id LIMIT 1)
SELECT 'improved' AS example, * FROM improved UNION ALL SELECT 'both_fail', * FROM (SELECT * FROM fail UNION ALL SELECT * FROM improved WHERE NOT EXISTS (SELECT 1 FROM fail))
UNION ALL SELECT 'both_success', * FROM (SELECT * FROM success UNION ALL SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM success))""",
    delta_histogram=f"{BOTH}, e AS (SELECT min(cell_delta) AS lo, max(cell_delta) AS hi FROM cmp) SELECT CAST(CASE WHEN hi = lo THEN 6 ELSE least(floor((cell_delta - lo) / (hi - lo) * 11) + 1, 11) END AS INTEGER) AS bin, count(*) AS n FROM cmp, e GROUP BY 1",
    sample_ids="SELECT s_suppkey, 'flow_' || substr(sha1(s_name), 1, 12) AS sample_id, trim(regexp_replace(s_name, '[^A-Za-z0-9_-]', '_', 'g'), '_') AS label FROM supplier",
    station_meta=f"WITH {GRID} SELECT sample_id, replace(station, 'NATION_', 'N') AS station, CAST(y AS VARCHAR) AS year, river || CASE WHEN nk % 2 = 0 THEN '' ELSE '_low' END AS river FROM grid",
    image_meta="SELECT s_suppkey, 'page_' || s_suppkey || '_table2' AS stable_name, s_name || '_x' AS title_text, '19' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS year FROM supplier",
    normalize_names="""WITH n AS (SELECT s_suppkey, 'page1table2' || replace(s_name, '_', '') || (['澴潭', '', '涢水安陆', 'ab', '(涢水随州)'])[s_suppkey % 5 + 1] AS k FROM supplier)
SELECT s_suppkey, k AS key, regexp_replace(k, '^page\\d+table\\d+', '') AS title FROM n""",
)
_MATCH = """n AS (SELECT n_nationkey AS k, replace(n_name, '_', '') AS s, replace(r_name, ' ', '') AS v, CASE WHEN n_nationkey % 3 = 1 THEN 'X' ELSE '' END || replace(r_name, ' ', '') || replace(n_name, '_', '') AS t, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS copies FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT *, length(s) / length(t) AS ss, length(v) / length(t) AS rs, length(v || s) / length(t) AS cs FROM n),
m AS (SELECT *, unnest(range(1, copies + 1)) AS copy, cs * 70 + ss * 45 + rs * 25 + CASE WHEN v || s = t THEN 30 ELSE 20 END + 20 + 10 + 5 AS score FROM c),
pairs AS (SELECT CAST(k AS BIGINT) AS csv_pos, CAST(k * 10 + copy AS BIGINT) AS image_pos, round(score, 4) AS score, round(ss, 4) AS station_similarity, round(rs, 4) AS river_similarity, round(cs, 4) AS combined_similarity FROM m),
images AS (SELECT CAST(k * 10 + copy AS BIGINT) AS image_pos, CASE WHEN k % 3 = 1 THEN 'X' ELSE '' END || r_name || n_name || '站' AS title_text FROM m JOIN nation ON n_nationkey = k JOIN region ON n_regionkey = r_regionkey),
alls AS (SELECT CAST(n_nationkey AS BIGINT) AS csv_pos, i.image_pos, coalesce(p.score, 0) AS score, coalesce(p.station_similarity, 0) AS station_similarity, coalesce(p.river_similarity, 0) AS river_similarity, coalesce(p.combined_similarity, 0) AS combined_similarity FROM nation CROSS JOIN images i LEFT JOIN pairs p ON p.csv_pos = n_nationkey AND p.image_pos = i.image_pos),
ranked AS (SELECT *, row_number() OVER c AS rank, lead(score) OVER c AS second, first_value(csv_pos) OVER i AS image_first, nth_value(score, 2) OVER i AS image_second FROM alls
  WINDOW c AS (PARTITION BY csv_pos ORDER BY score DESC, image_pos), i AS (PARTITION BY image_pos ORDER BY score DESC, csv_pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
resolved AS (SELECT csv_pos, image_pos, score, station_similarity, river_similarity, combined_similarity, CASE WHEN image_first = csv_pos AND score >= 95 AND score - coalesce(second, 0) >= 8 AND score - coalesce(image_second, 0) >= 8 THEN 'confirmed' ELSE 'needs_review' END AS match_status,
  round(score - coalesce(second, 0), 4) AS csv_margin, round(score - coalesce(image_second, 0), 4) AS image_margin FROM ranked WHERE rank = 1)"""
_FREE = "(SELECT image_pos, title_text FROM images WHERE image_pos NOT IN (SELECT image_pos FROM resolved WHERE match_status = 'confirmed'))"
add(
    match_candidates=f"WITH {_MATCH} SELECT * FROM pairs",
    match_resolution=f"WITH {_MATCH} SELECT * FROM resolved",
    top_candidates=f"WITH {_MATCH} SELECT csv_pos, CAST(rank AS INTEGER) AS rank, image_pos, score FROM ranked WHERE rank <= 3",
    match_audit=f"WITH {_MATCH} SELECT (SELECT count(*) FROM resolved) AS csv_count, (SELECT count(*) FROM images) AS image_count, (SELECT count(*) FROM resolved WHERE match_status = 'confirmed') AS confirmed_count, (SELECT count(*) FROM resolved WHERE match_status <> 'confirmed') AS needs_review_count, (SELECT count(*) FROM {_FREE}) AS unmatched_image_count",
    unmatched_images=f"WITH {_MATCH} SELECT * FROM {_FREE}",
    swift_manifest=f"{ONE} SELECT sample_id, '<image>OCR with format: ' AS query, md5(target_csv) AS response, image_path AS image FROM pred",
    latex_responses=f"{ONE}, x AS (SELECT sample_id, list_filter(t, lambda r: len(list_filter(r, lambda c: trim(c) NOT IN ('', '.'))) > 0) AS t FROM pred_p), w AS (SELECT sample_id, t, list_max(list_transform(t, lambda r: list_max(list_transform(r, lambda c, i: CASE WHEN trim(c) IN ('', '.') THEN 0 ELSE i END)))) AS w FROM x), f AS (SELECT sample_id, list_transform(t, lambda r: r[1:w]) AS t FROM w) SELECT sample_id, '<image>OCR with format: ' AS query, md5({latex('t')}) AS response FROM f",
    backfill=f"{ONE}, x AS (SELECT sample_id, pos, list_filter(t, lambda r: len(list_filter(r, lambda c: trim(c) NOT IN ('', '.'))) > 0) AS t FROM pred_p), w AS (SELECT sample_id, pos, t, list_max(list_transform(t, lambda r: list_max(list_transform(r, lambda c, i: CASE WHEN trim(c) IN ('', '.') THEN 0 ELSE i END)))) AS w FROM x), f AS (SELECT sample_id, pos, list_transform(t, lambda r: r[1:w]) AS t FROM w) SELECT sample_id, md5(CASE WHEN pos % 2 = 0 THEN 'there' ELSE {latex('t')} END) AS target, pos % 2 <> 0 AS updated FROM f",
    refresh_targets=f"{ONE} SELECT sample_id, md5(upper(target_csv)) AS target FROM pred",
    shard_assign=f"WITH {RUNS}, h AS (SELECT sample_id, row_number() OVER (ORDER BY pos) - 1 AS k FROM r ORDER BY pos LIMIT 9001) SELECT sample_id, CAST(k % 4 AS INTEGER) AS shard_id, k // 4 + 1 AS index FROM h",
    shard_all=f"WITH {RUNS}, h AS (SELECT sample_id, row_number() OVER (ORDER BY pos) - 1 AS k FROM r) SELECT sample_id, CAST(k % 4 AS INTEGER) AS shard_id, k // 4 + 1 AS index FROM h",
    resume_pending=f"WITH {RUNS} SELECT sample_id FROM r WHERE pos % 3 <> 0",
    upsert_runs=f"WITH {RUNS} SELECT sample_id, CASE WHEN pos % 3 = 0 THEN upper(prediction) ELSE prediction END AS prediction, CASE WHEN pos % 2 = 0 THEN pos ELSE pos + (SELECT max(pos) + 1 FROM r WHERE pos % 2 = 0) END AS place FROM r WHERE pos % 2 = 0 OR pos % 3 = 0",
    merge_shards=f"WITH {RUNS} SELECT pos, sample_id, CASE WHEN pos % 3 < 2 THEN prediction END AS prediction FROM r",
    limit_head=f"WITH {RUNS} SELECT pos, sample_id FROM r ORDER BY pos LIMIT 100",
    prompt_build="""WITH o AS (SELECT conv_id, turn, role, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
p AS (SELECT conv_id, i, CASE WHEN x = '' THEN role || ':' ELSE role || ': ' || x || '<|im_end|>' END AS one, CASE WHEN x = '' THEN role || ':' ELSE role || ': ' || x || CASE WHEN i % 2 = 0 THEN '<|im_end|>' ELSE '</s>' END END AS two, CASE WHEN x = '' THEN role ELSE role || x || '<|im_end|>' END AS mpt FROM o)
SELECT conv_id, md5('sys<|im_end|>' || chr(10) || string_agg(one, '' ORDER BY i)) AS single, md5('sys<|im_end|>' || string_agg(two, '' ORDER BY i)) AS two, md5('sys<|im_end|>' || string_agg(mpt, '' ORDER BY i)) AS mpt FROM p GROUP BY conv_id""",
    box_clamp="WITH b AS (SELECT CAST(greatest(0, least(CAST(l_partkey % 300 - 50 AS INTEGER), 180)) AS INTEGER) AS x1, CAST(greatest(0, least(l_suppkey % 90, 100)) AS INTEGER) AS y1, CAST(greatest(0, least(trunc(l_partkey % 200 + l_quantity), 180)) AS INTEGER) AS x2, CAST(greatest(0, least(l_linenumber * 30, 100)) AS INTEGER) AS y2 FROM lineitem) SELECT x2 > x1 AND y2 > y1 AS valid, count(*) AS n, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(y1) AS BIGINT) AS y1, CAST(sum(x2) AS BIGINT) AS x2, CAST(sum(y2) AS BIGINT) AS y2 FROM b GROUP BY 1",
    reading_order="SELECT l_orderkey, l_linenumber AS line, l_quantity AS left FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(trunc(l_quantity) AS INTEGER), l_partkey) = 1",
    page_totals="WITH p AS (SELECT CAST(user_id AS VARCHAR) AS pdf_path, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 11 = 0 THEN 'skipped' ELSE 'ok' END AS status, event_id % 4 AS t, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS c FROM events) SELECT pdf_path, count(*) AS pages, count(*) FILTER (status = 'ok') AS ok_pages, CAST(coalesce(sum(t) FILTER (status = 'ok'), 0) AS BIGINT) AS table_count, CAST(coalesce(sum(c) FILTER (status = 'ok'), 0) AS BIGINT) AS title_ocr_success_count FROM p GROUP BY 1",
    failure_counts="SELECT count(*) AS failures, count(*) FILTER (event_id % 5 < 3) AS title_failures FROM events",
    page_ids="WITH s AS (SELECT s_suppkey, unnest(range(1, least(s_nationkey, 5) + 1)) AS k FROM supplier) SELECT s_suppkey, CAST(k AS INTEGER) AS page_number, 'page_' || lpad(CAST(k AS VARCHAR), 4, '0') AS page_name FROM s",
    skip_existing="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    path_keys="SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '逐日平均流量表' ELSE '逐日平均水位表' END AS keyword, '19' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS year FROM supplier",
    title_clean="WITH p AS (SELECT p_partkey, '12' || p_name || ' ：流量/表 （x）*_' || p_brand || '._' AS t FROM part) SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(trim(t), '（', '('), '）', ')'), ' ', ''), '[\\\\/:*?\"<>|]', '_', 'g'), '_+', '_', 'g'), '[._]+$', ''), 1, 20) AS clean, trim(rtrim(substr(regexp_extract(t, '^(.*?)流量', 1), 3), ' _-:：,，.。')) AS prefix, replace(replace(replace(replace(t, '/', '_'), ' ', '_'), '（', '('), '）', ')') AS stem, substr(t, 1, 10) || chr(10) || '...' AS clipped FROM p",
    calendar_days="SELECT CAST(month(o_orderdate) AS INTEGER) AS m, count(*) FILTER (day(o_orderdate) <= ([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[month(o_orderdate)]) AS valid, count(*) AS n FROM orders GROUP BY 1",
)
_POOLS = f"{GRID}, pool AS (SELECT CAST(m - 1 AS INTEGER) AS month, row_number() OVER (PARTITION BY m ORDER BY station || '_' || y || '_' || river, d) - 1 AS pos, token FROM tok)"
add(
    value_pools=f"WITH {_POOLS} SELECT month, pos, token FROM pool",
    spike_pools=f"WITH {_POOLS}, s AS (SELECT month, CAST(CASE WHEN month < 6 THEN left(token, 2) ELSE left(token, 1) END AS BIGINT) AS v FROM pool), a AS (SELECT *, max(v) OVER (PARTITION BY month) AS top FROM s) SELECT month, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM a WHERE v >= 20 OR top < 20 GROUP BY 1",
    split_map="WITH n AS (SELECT count(*) AS n FROM customer), i AS (SELECT unnest(range(n)) AS index, n FROM n), r AS (SELECT index, n, row_number() OVER (ORDER BY sha1('20260408:' || index)) - 1 AS k FROM i) SELECT index, CASE WHEN k < round_even(n * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM r",
    layout_cells=f"WITH {GRID}, e AS (SELECT unnest(range(len(g))) AS i FROM grid), c AS (SELECT i, unnest(range(13)) AS j FROM e) SELECT CAST(i AS INTEGER) AS row_index, CAST(j AS INTEGER) AS col_index, CASE WHEN i = 0 THEN 'header' WHEN j = 0 THEN 'index' ELSE 'data' END AS cell_type, CAST(round_even(60 + j * (2040 / 13.0::DOUBLE), 0) AS INTEGER) AS x0, CAST(CASE WHEN i = 0 THEN 35 ELSE 105 + (i - 1) * 25 END AS INTEGER) AS y0, CAST(round_even(60 + j * (2040 / 13.0::DOUBLE) + 2040 / 13.0::DOUBLE, 0) AS INTEGER) AS x1, CAST(CASE WHEN i = 0 THEN 105 ELSE 105 + i * 25 END AS INTEGER) AS y1, count(*) AS n FROM c GROUP BY ALL",
    grid_lines="WITH s AS (SELECT s_suppkey, s_suppkey % 5 AS r, s_nationkey % 4 AS c FROM supplier), l AS (SELECT s_suppkey, 60 AS x0, 35 AS y0, 60 + c * 50 AS x1, 35 AS y1 FROM s UNION SELECT s_suppkey, 60, 105, 60 + c * 50, 105 FROM s UNION SELECT s_suppkey, 60 + k * 50, 35, 60 + k * 50, 105 + greatest(r - 1, 0) * 25 FROM (SELECT s_suppkey, r, unnest(range(c + 1)) AS k FROM s)) SELECT s_suppkey, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM l",
    numeric_tokens="SELECT p_partkey, (p_partkey % 16 + 1) IN (1, 2, 3, 5, 6, 7, 9, 10, 14, 16) AS ok FROM part",
    decode_text="SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '流量' || chr(10) || '1' || chr(10) || '2' ELSE '流量' || chr(10) || '1' END AS text, CASE WHEN s_suppkey % 2 = 0 THEN 'utf-8-sig' ELSE 'gb18030' END AS encoding FROM supplier",
    csv_edge_cases="SELECT s_suppkey, CAST(([3, 1, 1, 0, 1, 3, 1])[s_suppkey % 7 + 1] AS INTEGER) AS n_rows, (['a|b//c', 'x|y,z', 'q\"r|s', '', '|', 'a/b/c', 'xy'])[s_suppkey % 7 + 1] AS cells FROM supplier",
)


# Queries of files, jobs and hooks, and of layouts.


def uniform(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(CAST('0x' || substr(sha1({text}), 1, 12) AS BIGINT) / {16**12}.0::DOUBLE)"


_PRETTY = "array_to_string(list_filter(list_transform(string_split(replace(prediction, '\\hline', chr(10) || '\\hline' || chr(10)), chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)) || chr(10)"
_PRETTY = f"CASE WHEN contains(prediction, '\\begin{{tabular}}') THEN {_PRETTY} ELSE rtrim(prediction, chr(10) || ' ') || chr(10) END"
_STEM = "replace(replace(image_path, 'img/', ''), '.jpg', '')"
_REGIME = "CASE WHEN 100 * {0} <= 45 THEN 'normal' WHEN 100 * {0} <= 70 THEN 'zero_heavy' WHEN 100 * {0} <= 85 THEN 'zero_with_spikes' ELSE 'calendar_tail_focus' END"
add(
    jsonl_lines="SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey FROM supplier",
    json_documents="SELECT count(*) AS n, max(s_name) AS last, true AS is_null FROM supplier",
    csv_sink="SELECT s_name || ',' || CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE '' END || ',' || s_suppkey AS line FROM supplier",
    csv_folder=f"WITH {GRID} SELECT name AS stem, md5({csv('g')}) AS digest, 'utf-8-sig' AS encoding, name = (SELECT min(name) FROM grid) AS is_first FROM grid",
    image_folder="SELECT s_name AS stem, CAST(strlen(s_name) AS INTEGER) AS size FROM supplier",
    raw_outputs=f"{ONE} SELECT sample_id, md5(prediction) AS digest, {_STEM} || '.txt' AS file FROM pred",
    latex_exports=f"{ONE} SELECT sample_id, md5({_PRETTY}) AS digest FROM pred",
    score_job=f"{ONE}, {scored()} SELECT count(*) AS samples, round(avg(weighted_score), 6) AS weighted_score, round(avg(cell_accuracy), 6) AS cell_accuracy, CAST(count(DISTINCT error_type) AS INTEGER) AS error_types FROM pred_s",
    compare_job=f"{BOTH} SELECT sample_id, image_path, transition, round(cell_delta, 6) AS cell_delta, total_cells FROM cmp",
    compare_files=f"{BOTH} SELECT transition AS line, count(*) AS n FROM cmp GROUP BY 1 UNION ALL SELECT 'old', structure_count FROM {SUMMARY.format('old_x')} UNION ALL SELECT 'new', structure_count FROM {SUMMARY.format('pred_x')} UNION ALL SELECT 'delta', a.structure_count - b.structure_count FROM {SUMMARY.format('pred_x')} a, {SUMMARY.format('old_x')} b",
    classify_job=f"{BOTH}, c AS (SELECT sample_id, {_BUCKET} AS bucket FROM pred_x) SELECT {_STEM} AS stem, bucket, count(*) OVER (PARTITION BY bucket) AS n, md5(prediction) AS digest FROM pred JOIN c USING (sample_id)",
    generate_job="WITH n AS (SELECT count(*) AS n FROM supplier), v AS (SELECT n, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT) AS v FROM n) SELECT 'val' AS split, v AS n, v AS ids FROM v UNION ALL SELECT 'train', n - v, n - v FROM v",
    infer_job=f"WITH {RUNS} SELECT sample_id, CASE WHEN pos % 3 = 0 THEN 'old' ELSE CAST(length(prediction) AS VARCHAR) END AS prediction, CASE WHEN pos % 3 = 0 THEN 'none' ELSE 'local' END AS backend FROM r",
    report_lines="SELECT unnest(['# Report', '## Setup', '- suppliers: `' || (SELECT count(*) FROM supplier) || '`', '## Runs', '| run | score | characters | cells | cut off | wrong shape | right shape |', '|-|-|-|-|-|-|-|', '| base | 0.2500 | 0.5000 | 0.1250 | 1 | 0 | 0 |', '| new | 0.7500 | 0.5000 | 0.1250 | 1 | 0 | 0 |', 'Score of new less that of base: +0.5000.']) AS line",
    failure_log="""SELECT '{"s_suppkey":' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ',"details":"' || s_name || '"' ELSE '' END || ',"reason":"' || CASE WHEN s_suppkey % 3 = 0 THEN 'invalid_box' ELSE 'empty_title_roi' END || '"}' AS line FROM supplier""",
    page_driver="SELECT count(*) AS input, count(*) FILTER (s_suppkey % 7 <> 0) AS done, count(*) FILTER (s_suppkey % 7 = 0) AS failed, 'ValueError: no table' AS reason, CAST(sum(s_suppkey % 4) FILTER (s_suppkey % 7 <> 0) AS BIGINT) AS tables FROM supplier WHERE s_suppkey % 5 <> 0",
    stale_files="SELECT 'page_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '_t' || s_suppkey % 3 AS stem FROM supplier WHERE s_suppkey % 3 <> 1 OR s_suppkey = 1",
    inference_payload=f"WITH {RUNS}, h AS (SELECT sample_id, prediction, row_number() OVER (ORDER BY pos) - 1 AS k FROM r) SELECT sample_id, k // 3 + 1 AS index, CAST(k % 3 AS INTEGER) AS shard_id, CAST(3 AS INTEGER) AS num_shards, upper(prediction) AS prediction, prediction AS target_csv, 'index,sample_id,image_path,prediction,backend,query_mode,query,device,dtype,shard_id,num_shards,target_csv' AS fields FROM h",
    single_image="SELECT CAST(0 AS BIGINT) AS pos, 'b.c' AS sample_id, 'a/b.c.jpg' AS image_path",
    output_paths="WITH n AS (SELECT count(*) AS n FROM nation) SELECT CAST(k AS INTEGER) AS k, 'm/eval/checkpoint-' || k AS checkpoint, 'out/flow_real_' || CASE WHEN k = 0 THEN 'all' ELSE 'first' || k END || '_local.shard' || k || 'of' || n || '.jsonl' AS shard, 'out/' || k || '_local.json' AS image, 'base/eval/checkpoint-0' AS base FROM n, range(25) t(k) WHERE k < n",
    shard_arguments="SELECT CAST(a AS INTEGER) AS shard, CAST(b AS INTEGER) AS shards, (a IS NULL) <> (b IS NULL) OR coalesce(b < 1 OR a < 0 OR a >= b, false) AS refused FROM (SELECT unnest([NULL, -1, 0, 1, 2, 3]) AS a), (SELECT unnest([NULL, 0, 1, 3]) AS b)",
    score_text="SELECT p_partkey, printf('%.4f', p_size / 7::DOUBLE) AS score FROM part",
    ocr_tokens="""WITH e AS (SELECT s_suppkey, s_suppkey % 4 + 1 AS boxes, least(s_suppkey % 4 + 1, 3) AS n FROM supplier),
i AS (SELECT s_suppkey, n, unnest(range(n)) AS i FROM e), t AS (SELECT *, CASE i WHEN 0 THEN 'a' WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'b' END ELSE 'c' END AS text FROM i)
SELECT s_suppkey, CAST(n AS INTEGER) AS entries, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY i) - 1 AS INTEGER) AS at, text, CAST(s_suppkey + i - 2 AS DOUBLE) AS "left", CAST(i * 10 + 100 AS DOUBLE) AS top, CAST(s_suppkey + i + 5 AS DOUBLE) AS "right", CAST(i * 10 + 108 AS DOUBLE) AS bottom FROM t WHERE text <> ''""",
    real_manifest=f"""WITH {_MATCH} SELECT 's' || csv_pos AS sample_id, n_name AS station_name, CAST(1990 + csv_pos AS VARCHAR) AS year, 'i' || image_pos AS image_path, 'h,x' || chr(10) || '1,' || csv_pos || chr(10) AS target_csv,
  md5('\\begin{{tabular}}{{|c|c|}}' || chr(10) || '\\hline' || chr(10) || 'h & x \\\\' || chr(10) || '\\hline' || chr(10) || '1 & ' || csv_pos || ' \\\\' || chr(10) || '\\hline' || chr(10) || '\\end{{tabular}}' || chr(10)) AS latex,
  score AS match_score, match_status, 'test' AS split, 'real' AS source, 'utf-8-sig' AS csv_encoding FROM resolved JOIN nation ON n_nationkey = csv_pos""",
    manifest_again="SELECT s_suppkey, s_name, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'blur' ELSE 'none' END AS kind FROM supplier",
    predict_hook="SELECT p_partkey, CAST(length(p_name) AS VARCHAR) AS prediction FROM part",
    page_errors="SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 5 ELSE -1 END AS INTEGER) AS half, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'KeyError: 1' END AS error FROM part",
    resolve_query=f"SELECT role, CASE role WHEN 'system' THEN 'own' WHEN 'user' THEN '{FORMAT_PROMPT}' ELSE '{CSV_PROMPT}' END AS query FROM (SELECT DISTINCT role FROM conversations)",
    regime_mix=f"SELECT {_REGIME.format(uniform(chr(39) + 's' + chr(39), 'event_id'))} AS data_regime, count(*) AS n FROM events GROUP BY 1",
)
_PROFILE = """p AS (SELECT s_suppkey, s_suppkey % 3 AS third, (s_suppkey * 17) % 320 AS top FROM supplier), i AS (SELECT *, unnest(range(300)) AS i FROM p), dark AS (SELECT *, (i * i * 7 + s_suppkey * 13) % 130 AS n FROM i),
cut AS (SELECT s_suppkey, third, top, max(CASE WHEN n >= 200 * 0.6::DOUBLE AND i >= greatest(top - 80, 0) AND i < least(top + 8, 300) THEN i END) + 1 AS above,
  """ + ", ".join(f"min(CASE WHEN n >= 200 * {share}::DOUBLE AND i >= CAST(floor(300 * {start}::DOUBLE) AS INTEGER) THEN i END) + 1 AS c{k}" for k, (share, start) in enumerate(CASCADE)) + " FROM dark GROUP BY ALL)"
_METHOD = "CASE " + " ".join(f"WHEN c{k} IS NOT NULL THEN 'line_fallback_{share:.2f}_{start:.2f}'" for k, (share, start) in enumerate(CASCADE)) + " END"
_FIRST = "coalesce(c0, c1, c2, c3, c4)"
_DIRECT = "CASE WHEN third <> 0 THEN coalesce(above, greatest(top - 6, 1)) END"
_SEED = "CAST(index + 7 AS VARCHAR)"
add(
    cut_lines=f"WITH {_PROFILE} SELECT s_suppkey, CAST(above AS INTEGER) AS above, CAST(c0 AS INTEGER) AS below, CAST({_FIRST} AS INTEGER) AS cascade, {_METHOD} AS method FROM cut",
    crop_cut=f"WITH {_PROFILE}, x AS (SELECT 'on' AS variant, {_DIRECT} AS c FROM cut UNION ALL SELECT 'off', coalesce({_DIRECT}, {_FIRST}) FROM cut) SELECT count(*) AS input, count(c) AS cropped, count(*) - count(c) AS failed, variant FROM x GROUP BY variant",
    anchor_select="""WITH i AS (SELECT s_suppkey, unnest(range(s_suppkey % 7 + 1)) AS i FROM supplier),
t AS (SELECT *, (['平均', '年统计', '日期', '平', '均', '最低', 'z'])[(s_suppkey * (i + 1) + s_suppkey // 7 + i * i) % 7 + 1] AS text, (s_suppkey * 37 + i * 53) % 300 AS top, (s_suppkey * 11 + i * 29) % 150 AS "left" FROM i),
f AS (SELECT s_suppkey, count(*) FILTER (text = '平均') AS n, arg_min(top, top * 10 + i) FILTER (text = '年统计') AS year_top, max("left" + 30) FILTER (text IN ('平均', '年统计', '日期', '最低')) AS edge FROM t GROUP BY 1),
a AS (SELECT t.*, f.n, f.year_top, coalesce(f.edge, 160) + 12 AS edge, row_number() OVER (PARTITION BY s_suppkey ORDER BY text <> '平均', top, i) AS place FROM t JOIN f USING (s_suppkey)),
c AS (SELECT *, CASE WHEN n >= 2 AND text = '平均' AND abs(top - year_top) > 24 THEN 1 WHEN n > 0 AND place = 1 THEN 2
  WHEN n = 0 AND text IN ('平', '均') AND "left" + 30 <= edge AND "left" <= edge - 24 AND coalesce(top < year_top - 24, true)
    AND EXISTS (SELECT 1 FROM t o WHERE o.s_suppkey = a.s_suppkey AND o.text IN ('日期', '最低', '年统计') AND o.top - a.top BETWEEN 12 AND 120) THEN 3 END AS rule FROM a),
best AS (SELECT * FROM c WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY rule, top, i) = 1)
SELECT s.s_suppkey, b.text, CAST(b.top AS DOUBLE) AS top, CASE WHEN rule = 3 THEN 'weak_average_anchor' WHEN rule IS NULL THEN NULL WHEN n >= 2 OR coalesce(b.top < year_top - 24, false) THEN 'average_anchor' ELSE 'average_anchor_fallback' END AS method
FROM supplier s LEFT JOIN best b USING (s_suppkey)""",
    synthetic_tables=f"""WITH {_POOLS}, high AS (SELECT month, pos, token, max(CAST(token AS DOUBLE)) OVER (PARTITION BY month) AS top FROM pool),
both_pools AS (SELECT 'pool' AS kind, month, pos, token FROM pool UNION ALL SELECT 'spike', month, row_number() OVER (PARTITION BY month ORDER BY pos) - 1, token FROM high WHERE CAST(token AS DOUBLE) >= 20 OR top < 20),
sizes AS (SELECT kind, month, count(*) AS size FROM both_pools GROUP BY 1, 2),
n AS (SELECT unnest(range((SELECT count(*) FROM supplier))) AS index), m AS (SELECT unnest(range(12)) AS month), dd AS (SELECT unnest(range(1, 32)) AS day),
r AS (SELECT index, {_REGIME.format(uniform("'regime'", _SEED))} AS data_regime, 6 + CAST(floor({uniform("'quiet count'", _SEED)} * 5) AS INTEGER) AS q, 1 + CAST(floor({uniform("'wild count'", _SEED)} * 3) AS INTEGER) AS w FROM n),
rm AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY {uniform("'quiet'", _SEED, 'month')}) <= q AND data_regime IN ('zero_heavy', 'zero_with_spikes') AS quiet, row_number() OVER (PARTITION BY index ORDER BY {uniform("'wild'", _SEED, 'month')}) <= w AND data_regime = 'zero_with_spikes' AS wild FROM r, m),
c AS (SELECT *, {uniform("'cell'", _SEED, 'day', 'month')} AS u, {uniform("'spike'", _SEED, 'day', 'month')} AS s, {uniform("'place'", _SEED, 'day', 'month')} AS at FROM rm, dd),
k AS (SELECT *, CASE WHEN day > ([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[month + 1] OR data_regime = 'normal' AND u < 0.005 THEN '' WHEN data_regime = 'zero_with_spikes' AND s < CASE WHEN quiet THEN 0.08 WHEN wild THEN 0.25 ELSE 0 END THEN 'spike'
  WHEN u < CASE data_regime WHEN 'zero_heavy' THEN CASE WHEN quiet THEN 0.95 ELSE 0.65 END WHEN 'zero_with_spikes' THEN CASE WHEN quiet THEN 1 ELSE 0.55 END WHEN 'calendar_tail_focus' THEN CASE WHEN day >= 29 THEN 0.65 ELSE 0.2 END ELSE 0 END THEN '0' ELSE 'pool' END AS kind FROM c),
v AS (SELECT k.index, k.data_regime, k.day, k.month, CASE WHEN k.kind = '' THEN '' ELSE coalesce(b.token, '0') END AS v FROM k LEFT JOIN sizes z ON z.kind = k.kind AND z.month = k.month LEFT JOIN both_pools b ON b.kind = k.kind AND b.month = k.month AND b.pos = CAST(floor(k.at * z.size) AS BIGINT)),
days AS (SELECT index, data_regime, day, day || ',' || string_agg(v, ',' ORDER BY month) AS line, count(*) FILTER (v = '0') AS zeros, count(*) FILTER (v = '') AS blanks FROM v GROUP BY index, data_regime, day)
SELECT index, 'flow_' || substr(sha1('flow_v1_' || lpad(CAST(index AS VARCHAR), 5, '0')), 1, 12) AS sample_id, data_regime, CAST(sum(zeros) AS INTEGER) AS zeros, CAST(sum(blanks) AS INTEGER) AS blanks,
  md5('D/M,1,2,3,4,5,6,7,8,9,10,11,12' || chr(10) || string_agg(line, chr(10) ORDER BY day) || chr(10)) AS digest FROM days GROUP BY index, data_regime""",
)
