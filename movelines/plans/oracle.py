"""DuckDB SQL for the queries: one chain of named steps, of which each query takes what it needs."""

from __future__ import annotations

import re

from ..functions import moves as m
from . import fixtures as f

# Written out here, and not taken from the functions that the queries test.
EVENTS = {"Rated UltraBullet game": "UltraBullet", "Rated Correspondence game": "Correspondence", "Rated Classical game": "Classical", "Rated Rapid game": "Rapid", "Rated Bullet game": "Bullet", "Rated Blitz game": "Blitz"}
SLOW = ["Blitz", "Rapid", "Classical", "Correspondence"]
CLASSES = [(1000, "under_1000"), (1200, "1000_1200"), (1400, "1200_1400"), (1600, "1400_1600"), (1800, "1600_1800"), (2000, "1800_2000"), (2200, "2000_2200"), (2500, "2200_2500")]
RESULTS = ["1-0", "0-1", "1/2-1/2", "*"]
DOTTED = {"dotted": r"[0-9+]*\.", "dotted_space": r"[0-9+]*\. "}
READABLE = r"^(?:[KQRBN][a-h]?[1-8]?x?[a-h][1-8]|(?:[a-h]x)?[a-h][1-8](?:=?[QRBN])?|[O0]-[O0](?:-[O0])?)[+#]?$"
MATING = r"[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?#"

MIN_GAMES = 2
MAX_PLY = 30
SLICE = "year, month, event, rating_class"
COUNTS = ["white_wins", "draws", "black_wins", "total_games"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _pick(values, index: str) -> str:
    return f"({_list(values)})[CAST(({index}) AS INT) + 1]"


def _case(pairs, other="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"


def _tokens(numbers: str, drop: bool) -> str:
    text = r"regexp_replace(regexp_replace(regexp_replace(coalesce(movetext, ''), '\{[^}]*\}', '', 'g'), '\([^)]*\)', '', 'g'), '\$\d+', '', 'g')"
    if numbers == "inline":
        text = rf"regexp_replace({text}, '\d+\.{{1,3}}\s*', '', 'g')"
    if numbers in DOTTED:
        text = f"regexp_replace({text}, {_q(DOTTED[numbers])}, '', 'g')"
    out = rf"string_split(trim(regexp_replace({text}, '\s+', ' ', 'g')), ' ')"
    if numbers == "token":
        out = rf"list_filter({out}, lambda t: NOT regexp_matches(t, '^\d+\.+$'))"
    keep = f" AND t NOT IN ({', '.join(map(_q, RESULTS))})" if drop else ""
    return f"list_filter(list_transform({out}, lambda t: rtrim(t, '?!')), lambda t: t <> ''{keep})"


def _state(moves: str, ply: str) -> str:
    side = lambda odd: f"coalesce(array_to_string(list_sort(list_filter({moves}[1:{ply} - 1], lambda x, i: i % 2 = {odd})), ' '), '')"
    return f"{side(1)} || '|' || {side(0)} || '|' || CASE WHEN {ply} % 2 = 1 THEN 'w' ELSE 'b' END"


def _path(moves: str, ply: str) -> str:
    return f"coalesce(array_to_string({moves}[1:{ply} - 1], ' '), '')"


def _key(state: str) -> str:
    return f"CAST('0x' || substr(md5({state}), 1, 15) AS BIGINT)"


START = _key("'||w'")
_rating = _case([("elo_band IS NULL", "NULL"), *((f"elo_band < {b}", _q(x)) for b, x in CLASSES)], "'over_2500'")
_outcome = "CASE result WHEN '1-0' THEN 'white_wins' WHEN '0-1' THEN 'black_wins' WHEN '1/2-1/2' THEN 'draws' END"
_value = "CASE WHEN {0} LIKE '#%' THEN CASE WHEN {0} LIKE '#-%' THEN -1 ELSE 1 END * CASE abs(CAST(substr({0}, 2) AS INT)) WHEN 0 THEN 600.0 WHEN 1 THEN 500.0 WHEN 2 THEN 400.0 WHEN 3 THEN 300.0 ELSE 200.0 END ELSE TRY_CAST({0} AS DOUBLE) END"


def _mean(value: str, weight: str = "1") -> str:
    """In whole millionths, half away from zero."""
    s, n = f"sum(CAST(round({value} * 1000000) AS BIGINT) * {weight})", f"(sum({weight}) FILTER ({value} IS NOT NULL))"
    return f"CAST(CASE WHEN {s} < 0 THEN -1 ELSE 1 END * ((2 * abs({s}) + {n}) // (2 * {n})) AS DOUBLE) / 1000000::DOUBLE"


def _evals(text: str, moves: str) -> str:
    found = rf"list_transform(regexp_extract_all(regexp_replace(coalesce({text}, ''), '\{{\s*\}}', '{{ [%eval NA] }}', 'g'), '\[%eval (#?-?[0-9]+(?:\.[0-9]+)?|NA)\]', 1), lambda e: nullif(e, 'NA'))"
    return f"CASE WHEN len({moves}) > 0 AND {moves}[-1] LIKE '%#' AND len({found}) = len({moves}) - 1 THEN list_append({found}, CASE WHEN len({moves}) % 2 = 1 THEN '#0' ELSE '#-0' END) ELSE {found} END"


def _edge_step(state) -> str:
    return f"""SELECT game_id, CAST(ply AS INT) AS ply, {_key('parent_state')} AS parent_key, parent_state, {_key('child_state')} AS child_key, move_san, white_score, elo_band, mean_elo, year, month, event
        FROM (SELECT *, {state('mv', 'ply')} AS parent_state, {state('mv', '(ply + 1)')} AS child_state, mv[ply] AS move_san FROM (SELECT *, unnest(generate_series(1, least(len(mv), {MAX_PLY}))) AS ply FROM parsed))"""


def _stat_step(source: str, least: int, where: str = "TRUE") -> str:
    return f"""SELECT *, (white_wins + 0.5 * draws) / total AS white_score_avg FROM (SELECT event, elo_band, parent_key, move_san, min(parent_state) AS parent_state, min(child_key) AS child_key, min(ply) AS ply,
        count(*) FILTER (white_score = 1.0) AS white_wins, count(*) FILTER (white_score = 0.5) AS draws, count(*) FILTER (white_score = 0.0) AS black_wins, count(*) AS total
        FROM {source} WHERE {where} GROUP BY event, elo_band, parent_key, move_san) WHERE total >= {least}"""


def _counted(by: str, source: str = "games") -> str:
    return f"SELECT {by}, count(*) AS games FROM {source} GROUP BY ALL"


STEPS: dict[str, str] = {
    "plies": f"SELECT l_orderkey AS k, l_partkey, l_linenumber, CAST(floor(l_quantity) AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(f.PLY_ORDER)}) AS p FROM lineitem",
    "body": f"""SELECT k, string_agg(t, ' ' ORDER BY p) AS body FROM (SELECT k, p,
        CASE WHEN p % 2 = 1 THEN CAST((p + 1) // 2 AS VARCHAR) || '. ' ELSE CAST(p // 2 AS VARCHAR) || '... ' END
        || CASE WHEN k % 97 = 0 AND p = 3 THEN 'Zz9' WHEN p % 2 = 1 THEN {_pick(f.WHITE_MOVES, 'l_partkey % 4')} ELSE {_pick(f.BLACK_MOVES, 'l_partkey % 4')} END
        || CASE WHEN l_linenumber = 7 THEN '?!' ELSE '' END || CASE WHEN p = 1 AND k % 31 = 0 THEN ' $1 (1. b3)' ELSE '' END
        || CASE WHEN k % 3 = 0 THEN ' {{ [%eval ' || CASE WHEN q > 40 THEN '#' || CAST(q - 45 AS VARCHAR) ELSE CAST(q - 24 AS VARCHAR) || '.25' END || '] }}' ELSE ' {{ [%clk 0:03:00] }}' END AS t FROM plies) GROUP BY k""",
    "raw": f"""SELECT *, CASE WHEN body IS NOT NULL THEN CASE WHEN Result IS NULL THEN body ELSE body || ' ' || Result END END AS movetext FROM (SELECT 'https://lichess.org/' || CAST(o_orderkey AS VARCHAR) AS Site, {_pick(f.EVENT_NAMES, 'o_orderkey % 7')} AS Event,
        'c' || CAST(o_custkey AS VARCHAR) AS White, 'c' || CAST(o_custkey * 7 % 1500 AS VARCHAR) AS Black,
        CASE WHEN o_orderkey % 50 = 49 THEN '*' WHEN o_orderstatus = 'O' THEN '1-0' WHEN o_orderstatus = 'F' THEN '0-1' WHEN o_orderstatus = 'P' THEN '1/2-1/2' END AS Result,
        CASE WHEN o_custkey % 40 = 0 THEN 'GM' END AS WhiteTitle, CAST(NULL AS VARCHAR) AS BlackTitle,
        CASE WHEN o_orderkey % 23 <> 0 THEN CAST(800 + o_custkey * 37 % 1900 AS INT) END AS WhiteElo, CAST(800 + (o_custkey * 37 + o_orderkey) % 1900 AS INT) AS BlackElo,
        CAST(o_orderkey % 17 - 8 AS INT) AS WhiteRatingDiff, CAST(8 - o_orderkey % 17 AS INT) AS BlackRatingDiff, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS UTCDate, '12:00:00' AS UTCTime,
        {_pick('ABCDE', 'o_orderkey % 5')} || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS ECO, {_pick(f.OPENINGS, 'o_orderkey % 3')} AS Opening,
        CASE WHEN o_orderkey % 4 = 0 THEN 'Time forfeit' ELSE 'Normal' END AS Termination, {_pick(f.TIME_CONTROLS, 'o_orderkey % 5')} AS TimeControl,
        CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, body FROM orders LEFT JOIN body ON o_orderkey = k)""",
    "games": rf"""SELECT *, CAST(floor(mean_elo / 100) * 100 AS INT) AS elo_band FROM (SELECT Site AS site, White AS white, Black AS black, Result AS result, WhiteTitle AS white_title, BlackTitle AS black_title, WhiteElo AS white_elo, BlackElo AS black_elo,
        WhiteRatingDiff AS white_rating_diff, BlackRatingDiff AS black_rating_diff, UTCDate AS utc_date, UTCTime AS utc_time, ECO AS eco, Opening AS opening, Termination AS termination, TimeControl AS time_control, movetext,
        {_case((f"Event = {_q(a)}", _q(b)) for a, b in EVENTS.items())} AS event, year, month, replace(Site, 'https://lichess.org/', '') AS game_id,
        CAST(round_even((WhiteElo + BlackElo) / 2.0, 0) AS INT) AS mean_elo, CASE Result WHEN '1-0' THEN 1.0::DOUBLE WHEN '0-1' THEN 0.0::DOUBLE WHEN '1/2-1/2' THEN 0.5::DOUBLE END AS white_score,
        CAST(len(regexp_extract_all(movetext, '\d+\.\s')) AS INT) AS move_count, split_part(Opening, ':', 1) AS opening_family, substr(ECO, 1, 1) AS eco_class, contains(movetext, '[%eval') AS has_eval,
        TRY_CAST(regexp_extract(TimeControl, '^(\d+)\+(\d+)$', 1) AS INT) AS base_time, TRY_CAST(regexp_extract(TimeControl, '^(\d+)\+(\d+)$', 2) AS INT) AS increment
        FROM raw WHERE Event IN ({', '.join(map(_q, EVENTS))}))""",
    "toks": f"SELECT *, {_tokens('token', True)} AS mv FROM games",
    "inline": f"SELECT *, {_tokens('inline', True)} AS mv FROM games",
    "parsed": f"SELECT * EXCLUDE (mv, bad), CASE WHEN bad > 0 THEN mv[1:bad - 1] ELSE mv END AS mv, bad > 0 AS failed FROM (SELECT *, coalesce(list_position(list_transform(mv, lambda t: regexp_matches(t, {_q(READABLE)})), false), 0) AS bad FROM toks)",
    "booked": f"SELECT *, {' OR '.join(f'array_to_string(mv[1:{len(x.split())}], chr(32)) = {_q(x)}' for x in f.BOOK)} AS in_set, {' OR '.join(f'array_to_string(mv[1:{len(x.split())}], chr(32)) = {_q(x)}' for x in f.OTHER_BOOK)} AS in_other FROM inline",
    "evald": f"SELECT *, list_transform(evals, lambda e: {_value.format('e')}) AS vals FROM (SELECT *, {_evals('movetext', 'mv')} AS evals FROM inline)",
    "linecounts": f"""SELECT {SLICE}, line, count(*) FILTER (outcome = 'white_wins') AS white_wins, count(*) FILTER (outcome = 'draws') AS draws, count(*) FILTER (outcome = 'black_wins') AS black_wins, count(*) AS total_games
        FROM (SELECT year, month, event, {_rating} AS rating_class, mv[1:40] AS line, {_outcome} AS outcome FROM inline WHERE elo_band IS NOT NULL) WHERE outcome IS NOT NULL GROUP BY ALL""",
    "lines": f"SELECT {SLICE}, {', '.join(f'line[{k + 1}] AS {c}' for k, c in enumerate(m.move_columns(20)))}, {', '.join(COUNTS)} FROM linecounts",
    "lines10": f"SELECT {SLICE}, {', '.join(m.move_columns(10))}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTS)} FROM lines GROUP BY ALL",
    "rolled": f"SELECT {SLICE}, {', '.join(m.move_columns(10))}, " + ", ".join(f"CAST(sum({c}) OVER (PARTITION BY {SLICE}, {', '.join(m.move_columns(10)[: k + 1])}) AS BIGINT) AS {p.lower()}_{c}" for k, p in enumerate(m.move_columns(10)) for c in COUNTS) + " FROM lines10",
    "shared": f"SELECT {SLICE}, {', '.join(m.move_columns(10))}, " + ", ".join((f"{p.lower()}_total_games / " + (f"{m.move_columns(10)[k - 1].lower()}_total_games" if k else f"sum(b10_total_games) OVER (PARTITION BY {SLICE})")) + f" AS {p.lower()}_pct" for k, p in enumerate(m.move_columns(10))) + " FROM rolled",
    "prefixes": f"SELECT {SLICE}, ply, coalesce(array_to_string(line[1:ply], ' '), '') AS prefix, coalesce(array_to_string(line[1:greatest(ply - 1, 0)], ' '), '') AS parent_prefix, CASE WHEN ply > 0 THEN line[ply] END AS move, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTS)} FROM (SELECT *, unnest(generate_series(0, least(len(line), 20))) AS ply FROM linecounts) GROUP BY ALL",
    "treed": f"SELECT a.*, a.total_games / b.total_games AS share FROM prefixes a JOIN prefixes b ON a.year = b.year AND a.month = b.month AND a.event = b.event AND a.rating_class = b.rating_class AND b.ply = a.ply - 1 AND b.prefix = a.parent_prefix",
    "tree": f"""SELECT {SLICE}, CAST(ply AS INT) AS ply, prefix, parent_prefix, move, {', '.join(COUNTS)}, round(share, 6) AS move_share, round(line_share, 6) AS line_share FROM treed JOIN
        (SELECT q.year, q.month, q.event, q.rating_class, q.of AS prefix, product(t.share) AS line_share FROM (SELECT {SLICE}, prefix AS of, array_to_string(string_split(prefix, ' ')[1:i], ' ') AS prefix FROM (SELECT *, unnest(generate_series(CASE WHEN ply % 2 = 1 THEN 1 ELSE 2 END, ply, 2)) AS i FROM treed)) q
        JOIN treed t USING (year, month, event, rating_class, prefix) GROUP BY ALL) USING (year, month, event, rating_class, prefix)""",
}

_E20 = m.eval_columns(10)
STEPS |= {
    "lineevals": f"""SELECT line, {', '.join(_E20)}, {', '.join(f"CAST(sum(CASE WHEN outcome = '{r}' THEN n ELSE 0 END) AS BIGINT) AS {r}" for r in COUNTS[:3])}, CAST(sum(n) AS BIGINT) AS total_games FROM (
        SELECT mv[1:20] AS line, {_outcome} AS outcome, count(*) AS n, {', '.join(f'{_mean(f"vals[{k + 1}]")} AS {c}' for k, c in enumerate(_E20))} FROM evald WHERE {_outcome} IS NOT NULL GROUP BY mv[1:20], {_outcome}) GROUP BY ALL""",
    "lineprefixes": f"SELECT CAST(ply AS INT) AS ply, array_to_string(line[1:ply], ' ') AS prefix, ([{', '.join(_E20)}])[ply] AS v, {', '.join(COUNTS)} FROM (SELECT *, unnest(generate_series(1, len(line))) AS ply FROM lineevals)",
    "pevals": f"SELECT prefix, {_mean('v')} AS numeric_eval, count(*) AS games FROM (SELECT array_to_string(mv[1:i], ' ') AS prefix, vals[i] AS v FROM (SELECT *, unnest(generate_series(1, least(len(mv), 40))) AS i FROM evald WHERE len(mv) = len(evals) AND len(mv) > 0)) GROUP BY prefix",
    "edges": _edge_step(_state),
    "stats": _stat_step("edges", MIN_GAMES),
    "graph": "SELECT event, elo_band, parent_key, child_key, move_san, right(parent_state, 1) AS side, ply, total, white_score_avg, parent_state FROM stats WHERE elo_band IS NOT NULL AND child_key IS NOT NULL",
    "priors": f"SELECT event, elo_band, CAST(n AS BIGINT) AS start_games, CASE WHEN n < 100 THEN 0.5 ELSE s / n END AS prior FROM (SELECT event, elo_band, sum(CASE WHEN parent_key = {START} THEN white_score_avg * total ELSE 0.0 END) AS s, sum(CASE WHEN parent_key = {START} THEN total ELSE 0 END) AS n FROM stats WHERE elo_band IS NOT NULL GROUP BY ALL)",
    "forced": "SELECT event, elo_band, parent_key, sum(total::DOUBLE * total) / (sum(total::DOUBLE) * sum(total::DOUBLE)) AS forcingness FROM graph GROUP BY ALL",
    "leaves": "SELECT graph.*, (30.0 * prior + white_score_avg * total) / (30.0 + total) AS leaf_value, coalesce(forcingness, 0.0) AS cf FROM graph JOIN priors USING (event, elo_band) LEFT JOIN (SELECT event, elo_band, parent_key AS child_key, forcingness FROM forced) USING (event, elo_band, child_key)",
}


def _valued(source: str, known: str | None, perspective: str, weight: float) -> str:
    sign = "" if perspective == "white" else "-"
    v = "coalesce(value, leaf_value)" if known else "leaf_value"
    join = f" LEFT JOIN (SELECT event AS e2, elo_band AS b2, parent_key AS k2, value FROM {known}) ON event = e2 AND elo_band = b2 AND child_key = k2" if known else ""
    order = "ORDER BY s DESC, move_san"
    return f"""SELECT event, elo_band, parent_key, min(parent_state) AS parent_state, min(side) AS side, CASE WHEN min(side) = '{perspective[0]}' THEN first(v {order}) ELSE sum(v * total) / sum(total) END AS value,
        CASE WHEN min(side) = '{perspective[0]}' THEN first(move_san {order}) END AS best_move, CASE WHEN min(side) = '{perspective[0]}' THEN first(cf {order}) END AS forcingness
        FROM (SELECT *, {v} AS v, round({sign}({v}) + {weight} * cf, 9) AS s FROM {source}{join}) GROUP BY event, elo_band, parent_key"""


def _levels(name: str, perspective: str, weight: float) -> None:
    for ply in range(MAX_PLY, 0, -1):
        known = f"{name}_{ply + 1}" if ply < MAX_PLY else None
        STEPS[f"{name}_{ply}"] = _valued(f"(SELECT * FROM leaves WHERE ply = {ply})", known, perspective, weight)
    STEPS[name] = " UNION ALL ".join(f"SELECT * FROM {name}_{p}" for p in range(1, MAX_PLY + 1))


_levels("repw", "white", 0.0)
_levels("repb", "black", 0.0)
_levels("repf", "white", 0.2)

_FIRST_EVAL = "CASE WHEN t LIKE '#%' THEN CASE WHEN t LIKE '#-%' THEN -10000.0 ELSE 10000.0 END ELSE TRY_CAST(t AS DOUBLE) * 100 END"
STEPS |= {
    "nexts": """SELECT r.event, r.elo_band, r.parent_key, r.side, coalesce(r.best_move, p.move_san) AS move, CASE WHEN r.best_move IS NOT NULL THEN o.child_key ELSE p.child_key END AS child_key FROM repw r
        JOIN (SELECT event, elo_band, parent_key, first(move_san ORDER BY total DESC, move_san) AS move_san, first(child_key ORDER BY total DESC, move_san) AS child_key FROM graph GROUP BY ALL) p USING (event, elo_band, parent_key)
        LEFT JOIN graph o ON o.event = r.event AND o.elo_band = r.elo_band AND o.parent_key = r.parent_key AND o.move_san = r.best_move""",
    "walk": f"""SELECT DISTINCT event, elo_band, {START} AS at, CAST('' AS VARCHAR) AS line, 0 AS n FROM nexts UNION ALL
        SELECT w.event, w.elo_band, s.child_key, w.line || CASE WHEN w.line = '' THEN '' ELSE ' ' END || CASE WHEN s.side = 'w' THEN CAST(w.n // 2 + 1 AS VARCHAR) || '. ' ELSE '' END || s.move, w.n + 1
        FROM walk w JOIN nexts s ON w.event = s.event AND w.elo_band = s.elo_band AND w.at = s.parent_key WHERE w.n < 12""",
    "steps": "SELECT DISTINCT g.event, g.elo_band, g.parent_key, g.child_key FROM graph g JOIN repw r USING (event, elo_band, parent_key) WHERE (r.side = 'w' AND g.move_san = r.best_move) OR (r.side <> 'w' AND g.total >= 3)",
    "reach": f"""SELECT event, elo_band, parent_key, parent_state, 0 AS depth FROM repw WHERE parent_key = {START} UNION
        SELECT c.event, c.elo_band, c.parent_key, c.parent_state, a.depth + 1 FROM reach a JOIN steps s ON a.event = s.event AND a.elo_band = s.elo_band AND a.parent_key = s.parent_key
        JOIN repw c ON c.event = s.event AND c.elo_band = s.elo_band AND c.parent_key = s.child_key WHERE a.depth < 16""",
    "gevals": f"""SELECT state, 10 + count(*) % 10 AS depth, CAST(round(avg(cp)) AS BIGINT) AS cp FROM (SELECT {_state('mv', '(i + 1)')} AS state, {_FIRST_EVAL} AS cp FROM (SELECT *, evals[i] AS t FROM (SELECT p.mv, e.evals, unnest(generate_series(1, least(len(p.mv), len(e.evals), 30))) AS i FROM parsed p JOIN evald e USING (game_id)))) WHERE cp IS NOT NULL GROUP BY state""",
    "entries": """SELECT state, depth, cp, CAST(NULL AS VARCHAR) AS engine_best_uci, CAST(NULL AS VARCHAR) AS evaluated_at FROM gevals UNION ALL
        SELECT state, depth + 7, cp - 120, 'e2e4', '2024-01-01 00:00:00' FROM gevals WHERE length(state) % 3 = 0 UNION ALL SELECT '||w', 20, -150, 'd2d4', '2024-01-01 00:00:00'""",
    "cache": "SELECT state, depth, cp, engine_best_uci, evaluated_at FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY depth DESC, evaluated_at DESC NULLS LAST, cp NULLS LAST, engine_best_uci NULLS LAST) AS n FROM entries) WHERE n = 1",
    "annw": "SELECT r.*, cp AS eval_cp, depth AS eval_depth, engine_best_uci, cp >= -100 AS is_safe FROM repw r LEFT JOIN cache ON parent_state = state",
    "annb": "SELECT r.*, cp AS eval_cp, depth AS eval_depth, engine_best_uci, cp <= 100 AS is_safe FROM repb r LEFT JOIN cache ON parent_state = state",
}

_SHOWN = "SELECT event, elo_band, parent_key, parent_state, side, round(value, 6) AS value, best_move, round(forcingness, 6) AS forcingness FROM "
_FLAGS = "SELECT event, elo_band, parent_key, best_move, eval_cp, eval_depth, engine_best_uci, is_safe FROM "
_MV10 = ", ".join(m.move_columns(10))
_USER_STATE = "coalesce(array_to_string(mv0[greatest(ply - 1, 1):ply], ' '), '')"


def _product(side: str, k: int) -> str:
    return " * ".join(f"{side}{j}_pct" for j in range(1, k + 1))


def _stats_of(source: str) -> str:
    return f"SELECT event, elo_band, parent_key, move_san, parent_state, child_key, ply, white_wins, draws, black_wins, total, white_score_avg FROM ({source})"


QUERIES: dict[str, str] = {
    "partition_catalog": "SELECT DISTINCT year, month, event FROM games",
    "select_partitions": "SELECT year, month, event, count(*) AS games FROM games WHERE year BETWEEN 1993 AND 1996 AND event IN ('Rapid', 'Blitz') GROUP BY ALL",
    "pending_partitions": "SELECT DISTINCT year, month, event FROM games WHERE month > 6",
    "limit_per_partition": "SELECT year, month, event, game_id FROM (SELECT *, row_number() OVER (PARTITION BY year, month, event ORDER BY game_id) AS n FROM games) WHERE n <= 5",
    "write_partitioned_roundtrip": "SELECT year, month, event, count(*) AS games, sum(white_score) AS score FROM games GROUP BY ALL",
    "run_summary": f"SELECT *, round(failed_games * 100.0 / games, 2) AS failure_pct FROM (SELECT year, month, event, count(*) AS games, CAST(sum(least(len(mv), {MAX_PLY})) AS BIGINT) AS edges, count(*) FILTER (failed) AS failed_games FROM parsed GROUP BY GROUPING SETS ((year, month, event), ()))",
    "pipeline_white": _SHOWN + "repw",
    "pipeline_black": _SHOWN + "repb",
    "clean_games": "SELECT site, white, black, result, white_title, black_title, white_elo, black_elo, white_rating_diff, black_rating_diff, utc_date, utc_time, eco, opening, termination, time_control, movetext, event, year, month, game_id, mean_elo, elo_band, white_score, move_count, opening_family, eco_class, has_eval, base_time, increment FROM games",
    "event_mix": _counted("event"),
    "elo_histogram": _counted("elo_band"),
    "result_mix": _counted("result, white_score"),
    "move_count_histogram": _counted("move_count"),
    "family_mix": _counted("opening_family"),
    "eco_class_mix": _counted("eco_class, has_eval"),
    "time_control_mix": _counted("time_control, base_time, increment"),
    "rating_class_mix": _counted(f"{_rating} AS rating_class"),
    "analysis_subset": f"SELECT game_id, event, white_elo, black_elo FROM games WHERE month = 12 AND has_eval AND event IN ({', '.join(map(_q, SLOW))}) AND white_elo >= 1500 AND black_elo >= 1500",
    "tokens": "SELECT game_id, coalesce(array_to_string(mv, ' '), '') AS moves FROM toks",
    "tokens_keep_result": f"SELECT game_id, coalesce(array_to_string({_tokens('inline', False)}, ' '), '') AS moves FROM games",
    "wide_moves": f"SELECT game_id, {', '.join(f'mv[{k + 1}] AS {c}' for k, c in enumerate(m.move_columns(20)))} FROM toks",
    "opening_set_split": "SELECT in_set, count(*) AS games FROM booked GROUP BY ALL",
    "truncate_by_opening": "SELECT game_id, coalesce(array_to_string(mv[1:CASE WHEN in_other THEN 2 WHEN in_set THEN 6 ELSE 4 END], ' '), '') AS moves FROM booked",
    "parse_failures": "SELECT year, month, event, count(*) AS games, count(*) FILTER (failed) AS failed_games FROM parsed GROUP BY ALL",
    "eval_alignment": "SELECT CAST(len(mv) AS INT) AS n_moves, CAST(len(evals) AS INT) AS n_evals, count(*) AS games FROM evald GROUP BY ALL",
    "explorer_lines": "SELECT * FROM lines",
    "explorer_pivot": f"SELECT {SLICE}, coalesce(array_to_string(line, ' '), '') AS line, {', '.join(COUNTS)} FROM linecounts",
    "lines_b10": "SELECT * FROM lines10",
    "line_rollup": "SELECT * FROM rolled",
    "move_share": f"SELECT {SLICE}, {_MV10}, {', '.join(f'round({c.lower()}_pct, 6) AS {c.lower()}_move_pct' for c in m.move_columns(10))} FROM shared",
    "line_share": f"SELECT {SLICE}, {_MV10}, {', '.join(f'round({_product(s, k)}, 6) AS {s}{k}_line_pct' for s in 'wb' for k in range(1, 11))} FROM shared",
    "prefix_tree": "SELECT * FROM tree",
    "top_moves": f"SELECT {SLICE}, parent_prefix, move, total_games, move_share, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {SLICE}, parent_prefix ORDER BY total_games DESC, move) AS n FROM tree) WHERE n <= 3",
    "eval_strings": "SELECT game_id, coalesce(array_to_string(list_transform(evals, lambda e: coalesce(e, 'NA')), ' '), '') AS evals FROM evald",
    "eval_mates": rf"SELECT game_id, evals[-1] AS last_eval, {_value.format('evals[-1]')} AS last_value, CAST(len(evals) AS INT) AS n_evals FROM (SELECT game_id, {_evals('movetext', 'mv')} AS evals FROM (SELECT *, {_tokens('inline', True)} AS mv FROM (SELECT game_id, regexp_replace(movetext, ' \{{[^}}]*\}} (1-0|0-1|1/2-1/2|\*)$', '# \1') AS movetext FROM games WHERE has_eval)))",
    "eval_value": f"SELECT *, {_value.format('eval')} AS value FROM (SELECT eval, count(*) AS n FROM (SELECT unnest(evals) AS eval FROM evald) GROUP BY eval)",
    "wide_evals": f"SELECT game_id, {', '.join(f'vals[{k + 1}] AS {c}' for k, c in enumerate(m.eval_columns(20)))} FROM evald",
    "line_evals": f"SELECT coalesce(array_to_string(line, ' '), '') AS line_text, {', '.join(COUNTS)}, {', '.join(_E20)} FROM lineevals",
    "eval_rollup_leaf": f"SELECT ply, prefix, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTS)}, {_mean('v')} AS mean_eval FROM lineprefixes GROUP BY ply, prefix",
    "eval_rollup_game": f"SELECT ply, prefix, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTS)}, {_mean('v', 'total_games')} AS mean_eval FROM lineprefixes GROUP BY ply, prefix",
    "prefix_evals": "SELECT * FROM pevals",
    "prefix_evals_wide": f"SELECT prefix, numeric_eval, {', '.join(f'w[{k + 1}] AS {c}' for k, c in enumerate(m.move_columns(20)))} FROM (SELECT *, string_split(prefix, ' ') AS w FROM pevals)",
    "position_edges": "SELECT * FROM edges",
    "position_edges_path": _edge_step(_path),
    "position_edges_supplied": f"SELECT game_id, CAST(ply AS INT) AS ply, {_key('parent_state')} AS parent_key, parent_state, {_key('child_state')} AS child_key, move_san, white_score, elo_band, mean_elo, year, month, event FROM (SELECT *, {_USER_STATE.replace('ply', '(ply - 1)')} AS parent_state, {_USER_STATE} AS child_state, mv[ply] AS move_san FROM (SELECT p.*, t.mv AS mv0, unnest(generate_series(1, least(len(p.mv), {MAX_PLY}))) AS ply FROM parsed p JOIN (SELECT game_id, mv FROM toks) t USING (game_id)))",
    "edges_ply_cap": f"SELECT ply, count(*) AS rows, CAST(sum(total) AS BIGINT) AS games FROM ({_stat_step('edges', MIN_GAMES, 'ply <= 4')}) GROUP BY ply",
    "ply_convergence": "SELECT ply, count(*) AS edges, count(DISTINCT parent_key) AS positions, round(count(*) / count(DISTINCT parent_key), 1) AS games_per_position FROM edges GROUP BY ply",
    "first_moves": f"SELECT move_san, count(*) AS games, round(avg(white_score), 4) AS mean_score FROM edges WHERE parent_key = {START} GROUP BY move_san ORDER BY games DESC, move_san LIMIT 15",
    "position_stats": _stats_of(_stat_step("edges", 1)),
    "position_stats_min": _stats_of(_stat_step("edges", 10)),
    "stats_coverage": "SELECT count(*) AS rows, count(DISTINCT parent_key) AS positions FROM stats",
    "rows_per_event": "SELECT event, count(*) AS rows FROM stats GROUP BY event",
    "top_first_moves": f"SELECT event, elo_band, CAST(n AS INT) AS rank, move_san, white_score_avg, total FROM (SELECT *, row_number() OVER (PARTITION BY event, elo_band ORDER BY white_score_avg DESC, move_san) AS n FROM stats WHERE parent_key = {START}) WHERE n <= 3",
    "slice_priors": "SELECT event, elo_band, start_games, round(prior, 6) AS prior FROM priors",
    "leaf_values": "SELECT event, elo_band, parent_key, move_san, round(leaf_value, 6) AS leaf_value FROM leaves",
    "forcingness": "SELECT event, elo_band, parent_key, round(forcingness, 6) AS forcingness FROM forced",
    "repertoire_white": _SHOWN + "repw",
    "repertoire_black": _SHOWN + "repb",
    "repertoire_forcing": _SHOWN + "repf",
    "induction_rounds": _SHOWN + "repw",
    "recommended_first_moves": f"SELECT event, elo_band, best_move, round(value, 6) AS value FROM repw WHERE parent_key = {START} AND best_move IS NOT NULL",
    "largest_slice": "SELECT event, elo_band, count(*) AS positions FROM repw GROUP BY ALL ORDER BY positions DESC, event, elo_band LIMIT 1",
    "best_lines": "SELECT event, elo_band, first(line ORDER BY n DESC) AS line, CAST(max(n) AS INT) AS plies FROM walk GROUP BY event, elo_band",
    "reachable": "SELECT event, elo_band, parent_key, parent_state, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY ALL",
    "reachable_states": "SELECT DISTINCT parent_state AS state FROM reach",
    "pending_evals": "SELECT DISTINCT parent_state AS state FROM reach LEFT JOIN cache ON parent_state = state WHERE coalesce(depth_, 0) < 18".replace("LEFT JOIN cache", "LEFT JOIN (SELECT state, depth AS depth_ FROM cache)").replace("AS state FROM reach", "AS state FROM (SELECT parent_state FROM reach)").replace("ON parent_state = state", "c ON parent_state = c.state"),
    "merge_evals": "SELECT state, depth, cp, engine_best_uci, evaluated_at FROM cache",
    "evals_from_games": "SELECT state, depth, cp FROM gevals",
    "annotate_white": _FLAGS + "annw",
    "annotate_black": _FLAGS + "annb",
    "safety_summary": """SELECT *, round(evaluated * 100.0 / positions, 2) AS evaluated_pct, round(safe * 100.0 / evaluated, 2) AS safe_pct, round(unsafe * 100.0 / evaluated, 2) AS unsafe_pct, round(safe * 100.0 / positions, 2) AS safe_of_all_pct, round(unsafe * 100.0 / positions, 2) AS unsafe_of_all_pct
        FROM (SELECT count(*) AS positions, count(eval_cp) AS evaluated, count(*) FILTER (is_safe) AS safe, count(*) FILTER (NOT is_safe) AS unsafe FROM annw)""",
    "unsafe_first_moves": f"SELECT event, elo_band, best_move, round(value, 6) AS value, eval_cp, engine_best_uci FROM annw WHERE parent_key = {START} AND NOT is_safe",
    "worst_positions": "SELECT event, elo_band, parent_key, parent_state, eval_cp, best_move FROM annw WHERE eval_cp IS NOT NULL ORDER BY eval_cp, event, elo_band, parent_key LIMIT 15",
}
STEPS |= {
    "evsteps": """SELECT event_type, value, strftime(ts, '%a') AS day, lead(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS child FROM events""",
    "evedges": """SELECT day AS event, 0 AS elo_band, event_type AS parent_key, child AS child_key, child AS move_san, CASE WHEN n % 2 = 1 THEN 'w' ELSE 'b' END AS side, total, s / total AS avg_, event_type AS parent_state FROM
        (SELECT day, event_type, child, count(*) AS total, sum(CASE WHEN value > (SELECT avg(value) FROM events) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM evsteps WHERE child IS NOT NULL GROUP BY ALL)
        JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)""",
    "evleaves": """SELECT e.*, (30.0 * 0.5 + avg_ * total) / (30.0 + total) AS leaf_value, coalesce(cf, 0.0) AS cf FROM evedges e LEFT JOIN (SELECT event AS e2, parent_key AS k2, sum(total::DOUBLE * total) / (sum(total::DOUBLE) * sum(total::DOUBLE)) AS cf FROM evedges GROUP BY ALL) ON event = e2 AND child_key = k2""",
}
QUERIES["induction_cycles"] = "SELECT event, elo_band, parent_key, parent_state, side, round(value, 6) AS value, best_move, round(forcingness, 6) AS forcingness FROM (" + _valued("evleaves", None, "white", 0.0) + ")"

STEPS |= {
    "alltypes": "SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events) UNION ALL VALUES ('start', 1), ('end', 2)",
    "evall": """SELECT event_type, value, day, coalesce(child, 'end') AS child FROM evsteps UNION ALL SELECT 'end', value, day, 'close' FROM evsteps WHERE child IS NULL UNION ALL
        SELECT 'start', value, strftime(ts, '%a'), event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events) WHERE i = 1""",
    "tailedges": """SELECT day AS event, 0 AS elo_band, event_type AS parent_key, child AS child_key, child AS move_san, CASE WHEN n % 2 = 1 THEN 'w' ELSE 'b' END AS side, total, s / total AS avg_, event_type AS parent_state FROM
        (SELECT day, event_type, child, count(*) AS total, sum(CASE WHEN value > (SELECT avg(value) FROM events) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM evall GROUP BY ALL) JOIN alltypes USING (event_type)""",
    "tailleaves": """SELECT e.*, (30.0 * 0.5 + avg_ * total) / (30.0 + total) AS leaf_value, coalesce(cf, 0.0) AS cf FROM tailedges e LEFT JOIN (SELECT event AS e2, parent_key AS k2, sum(total::DOUBLE * total) / (sum(total::DOUBLE) * sum(total::DOUBLE)) AS cf FROM tailedges GROUP BY ALL) ON event = e2 AND child_key = k2""",
    "tailend": _valued("(SELECT * FROM tailleaves WHERE parent_key = 'end')", None, "white", 0.0),
    "tailrest": _valued("(SELECT * FROM tailleaves WHERE parent_key <> 'end')", "tailend", "white", 0.0),
}
QUERIES["induction_tails"] = _SHOWN + "(SELECT * FROM tailend UNION ALL SELECT * FROM tailrest)"
_BRACED = r"regexp_replace(regexp_replace(movetext, '\{ \[%eval ([^\]]*)\] \}', '{eval \1}', 'g'), '\{ \[%clk [^}]*\}', '{}', 'g')"
QUERIES |= {
    "tokens_dotted": f"SELECT game_id, coalesce(array_to_string({_tokens('dotted', True)}, ' '), '') AS moves, coalesce(array_to_string({_tokens('dotted_space', True)}, ' '), '') AS moves_spaced FROM games",
    "strip_clocks": r"SELECT game_id, regexp_replace(movetext, ' ?\[%clk \d+:\d+:\d+\] ?', '', 'g') AS movetext FROM games",
    "eval_braces": rf"""SELECT game_id, coalesce(array_to_string(regexp_extract_all(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), 'eval ', ''), '{{}}', '{{NA}}'), '(\d+\. {MATING}) \{{NA\}}', '\1 {{#0}}', 'g'), '({MATING}) \{{NA\}}', '\1 {{#-0}}', 'g'), '\{{([^}}]+)\}}', 1), ' '), '') AS evals
        FROM (SELECT game_id, regexp_replace({_BRACED}, ' \{{\}} (1-0|0-1|1/2-1/2|\*)$', '# {{}} \1') AS text FROM games)""",
    "edge_folder_scan": "SELECT event, count(*) AS edges, CAST(sum(ply) AS BIGINT) AS plies FROM edges GROUP BY event",
    "stats_sink_roundtrip": "SELECT event, elo_band, count(*) AS rows, CAST(sum(total) AS BIGINT) AS games FROM stats GROUP BY ALL",
}

# ---- states at several depths, and states by path --------------------------------------

QUERIES["select_slice"] = f"""SELECT year, month, event, elo_band, rating_class, game_id FROM (SELECT *, {_rating} AS rating_class FROM games)
    WHERE month = 6 AND (elo_band, rating_class) IN ((1500, '1400_1600'), (1500, '2200_2500'), (2300, '2200_2500'))"""


def _weighed(moves: str, ply: str) -> str:
    """The state before a ply: what each side's moves weigh, and who moves."""
    own = lambda odd: f"CAST(coalesce(list_sum(list_transform({moves}[1:{ply} - 1], lambda x, i: CASE WHEN i % 2 <> {odd} THEN 0 WHEN x IN ('c4', 'c5') THEN 2 ELSE 1 END)), 0) AS VARCHAR)"
    return f"({own(1)} || '|' || {own(0)} || '|' || CASE WHEN {ply} % 2 = 1 THEN 'w' ELSE 'b' END)"


def _repertoire(name: str, edges: str, start: str, side: str, perspective: str, level: str, levels: int, reach: int) -> None:
    """Steps of a repertoire over other states: level grows by 1 to `reach` with each move."""
    STEPS[f"{name}edges"] = edges
    STEPS[f"{name}stats"] = _stat_step(f"{name}edges", MIN_GAMES)
    STEPS[f"{name}graph"] = f"SELECT event, elo_band, parent_key, child_key, move_san, {side} AS side, {level} AS level, total, white_score_avg, parent_state FROM {name}stats WHERE elo_band IS NOT NULL AND child_key IS NOT NULL"
    at = f"parent_key = {_key(chr(39) + start + chr(39))}"
    STEPS[f"{name}priors"] = f"SELECT event, elo_band, CASE WHEN n < 100 THEN 0.5 ELSE s / n END AS prior FROM (SELECT event, elo_band, sum(CASE WHEN {at} THEN white_score_avg * total ELSE 0.0 END) AS s, sum(CASE WHEN {at} THEN total ELSE 0 END) AS n FROM {name}stats WHERE elo_band IS NOT NULL GROUP BY ALL)"
    STEPS[f"{name}leaves"] = f"""SELECT g.*, (30.0 * prior + white_score_avg * total) / (30.0 + total) AS leaf_value, coalesce(cf, 0.0) AS cf FROM {name}graph g JOIN {name}priors USING (event, elo_band)
        LEFT JOIN (SELECT event, elo_band, parent_key AS child_key, sum(total::DOUBLE * total) / (sum(total::DOUBLE) * sum(total::DOUBLE)) AS cf FROM {name}graph GROUP BY ALL) USING (event, elo_band, child_key)"""
    for k in range(levels, -1, -1):
        after = [f"SELECT * FROM {name}_{j}" for j in range(k + 1, min(k + reach, levels) + 1)]
        STEPS[f"{name}_{k}"] = _valued(f"(SELECT * FROM {name}leaves WHERE level = {k})", f"({' UNION ALL '.join(after)})" if after else None, perspective, 0.0)
    STEPS[name] = " UNION ALL ".join(f"SELECT * FROM {name}_{k}" for k in range(levels + 1))
    QUERIES[f"repertoire_{name}"] = _SHOWN + name


# a state's level is all that was played: at most two a ply
_repertoire("supplied", _edge_step(_weighed), "0|0|w", "right(parent_state, 1)", "white", "CAST(split_part(parent_state, '|', 1) AS INT) + CAST(split_part(parent_state, '|', 2) AS INT)", 2 * MAX_PLY, 2)
_repertoire("path", _edge_step(_path), "", "CASE WHEN ply % 2 = 1 THEN 'w' ELSE 'b' END", "black", "ply", MAX_PLY, 1)

QUERIES |= {
    "manifest_catalog": "SELECT year, month, event, CASE WHEN month <= 3 AND drawn > 0 THEN drawn ELSE n END AS rows FROM (SELECT year, month, event, count(*) AS n, count(*) FILTER (white_score = 0.5) AS drawn FROM games GROUP BY ALL)",
    "manifest_pending": "SELECT DISTINCT year, month, event FROM games WHERE (year, month, event) NOT IN (SELECT (year, month, event) FROM parsed WHERE year < 1996 AND len(mv) > 0)",
    "position_stats_months": QUERIES["position_stats_min"],
    "ply_convergence_months": "SELECT year, ply, count(*) AS edges, count(DISTINCT parent_key) AS positions FROM edges GROUP BY ALL",
    "merge_evals_stored": QUERIES["merge_evals"],
}

_RECURSIVE = {"walk", "reach"}


def _sql(text: str) -> str:
    """The query with the steps that it needs before it, each computed once."""
    needed: dict[str, None] = {}

    def visit(sql: str, own: str = "") -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+\(*(\w+)", sql)):
            if word in STEPS and word != own and word not in needed:
                visit(STEPS[word], word)
                needed[word] = None

    visit(text)
    if not needed:
        return text
    steps = ",\n".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({STEPS[n]})" for n in needed)
    return f"WITH {'RECURSIVE ' if _RECURSIVE & set(needed) else ''}{steps}\n{text}"


def oracle_sql() -> dict[str, str]:
    return {name: _sql(text) for name, text in QUERIES.items()}
