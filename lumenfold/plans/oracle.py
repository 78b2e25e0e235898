"""DuckDB SQL for the queries, put together from common table expressions."""

from __future__ import annotations

from lumenfold.functions import naming
from lumenfold.functions.scene import FOOD, GREEN, MISC, MONO, NIGHT, PEOPLE, SCREENSHOT, SCREENSHOT_NAME, SKY, SUNSET, WARM
from lumenfold.sources.gazetteer import GAZETTEER

DAY = "86400000"
HAVERSINE = "(2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians({2} - {0}) / 2) ** 2 + cos(radians({0})) * cos(radians({2})) * sin(radians({3} - {1}) / 2) ** 2))))"


def haversine(*places: str) -> str:
    return HAVERSINE.format(*places)


def _case(key: str, table: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items()) + f" ELSE {other} END"


def _holiday(d: str) -> str:
    fixed = " ".join(f"WHEN month({d}) = {m} AND day({d}) = {k} THEN '{n}'" for (m, k), n in naming.FIXED_HOLIDAYS.items())
    mondays = " ".join(
        f"WHEN month({d}) = {m} AND dayofweek({d}) = 1 AND ceil(day({d}) / 7) = {nth} THEN {name}"
        for m, nth, name in ((1, 2, "'成人の日'"), (7, 3, "'海の日'"), (9, 3, "'敬老の日'"), (10, 2, f"CASE WHEN year({d}) >= 2020 THEN 'スポーツの日' ELSE '体育の日' END"))
    )
    equinoxes = " ".join(
        f"WHEN month({d}) = {m} AND day({d}) = floor({base} + 0.242194::DOUBLE * (year({d}) - 1980) - floor((year({d}) - 1980) / 4)) THEN '{name}'" for m, base, name in ((3, "20.8431::DOUBLE", "春分の日"), (9, "23.2488::DOUBLE", "秋分の日"))
    )
    emperor = f"WHEN year({d}) BETWEEN 1989 AND 2018 AND month({d}) = 12 AND day({d}) = 23 OR year({d}) >= 2020 AND month({d}) = 2 AND day({d}) = 23 THEN '天皇誕生日'"
    return f"CASE {fixed} {emperor} WHEN year({d}) >= 2016 AND month({d}) = 8 AND day({d}) = 11 THEN '山の日' {mondays} {equinoxes} END"


_BITS = "('0x' || substr({0}, 1, 8))::BIGINT * 4294967296::HUGEINT + ('0x' || substr({0}, 9, 8))::BIGINT"
_FAR = f"((floor(ms / {DAY}.0)::BIGINT + u) % 10 < 3)"
_SCENE = [
    (SCREENSHOT, f"CASE WHEN named AND flat THEN 0.95 WHEN named THEN 0.85 WHEN flat THEN 0.65 END"),
    (NIGHT, "CASE WHEN brightness < 0.12 THEN 0.8 WHEN brightness < 0.22 THEN 0.66 WHEN iso >= 1600 AND brightness < 0.4 THEN 0.6 END"),
    (SUNSET, "CASE WHEN warm AND aspect >= 1.2 AND warmth > 0.12 AND brightness BETWEEN 0.3 AND 0.78 AND colorfulness > 25 THEN 0.6 END"),
    (SKY, "CASE WHEN blue_top_ratio > 0.4 AND brightness > 0.55 AND edge_density < 0.15 THEN least(0.85, 0.6 + (blue_top_ratio - 0.4)) END"),
    (GREEN, "CASE WHEN green_ratio > 0.35 AND saturation > 0.3 THEN least(0.85, 0.6 + (green_ratio - 0.35)) END"),
    (FOOD, "CASE WHEN warmth > 0.05 AND saturation > 0.4 AND colorfulness > 40 AND edge_density < 0.35 THEN 0.56 END"),
    (MONO, "CASE WHEN saturation < 0.12 AND camera_make IS NOT NULL AND edge_density < 0.5 AND brightness > 0.1 THEN 0.7 END"),
    (PEOPLE, "CASE WHEN aspect < 1 AND f_number < 2.8 AND warm AND saturation > 0.15 AND saturation < 0.6 THEN 0.56 END"),
    (WARM, "CASE WHEN warmth > 0.15 THEN 0.5 END"),
]


def _hue(r: str, g: str, b: str) -> str:
    return f"(CASE WHEN {r} = {g} AND {g} = {b} THEN 0 WHEN {r} >= {g} AND {r} >= {b} THEN 60.0 * ({g} - {b}) / ({r} - least({g}, {b})) WHEN {g} >= {b} THEN 60.0 * (({b} - {r}) / ({g} - least({r}, {b})) + 2) ELSE 60.0 * (({r} - {g}) / ({b} - least({r}, {g})) + 4) END)"


def _linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE (({c} / 255 + 0.055) / 1.055) ** 2.4 END)"


def _bent(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116 END)"


#: Name: (names it needs, its SQL).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT event_id AS e, user_id AS u, event_type, epoch_us(ts) // 1000 AS ms, json_extract_string(props, '$.k')::INT AS k FROM events"),
    "photos": (("ev",), f"""SELECT u AS library_id, 'p' || lpad(e::VARCHAR, 9, '0') || '-' || n AS id,
      CASE WHEN e % 41 = 0 THEN 'scre shot ' || e || '.png' ELSE 'IMG_' || e || '.jpg' END AS name,
      CASE WHEN e % 97 <> 0 THEN ms + 400 * n END AS taken_at,
      CASE WHEN e % 7 = 0 THEN NULL WHEN {_FAR} THEN 26.212::DOUBLE + ((e * 7919) % 2001 - 1000) * 1e-5::DOUBLE ELSE 35.646::DOUBLE + (u % 40) * 0.01::DOUBLE + ((e * 7919) % 201 - 100) * 1e-5::DOUBLE END AS lat,
      CASE WHEN e % 7 = 0 THEN NULL WHEN {_FAR} THEN 127.681::DOUBLE + ((e * 104729) % 2001 - 1000) * 1e-5::DOUBLE ELSE 139.653::DOUBLE - (u % 25) * 0.01::DOUBLE + ((e * 104729) % 201 - 100) * 1e-5::DOUBLE END AS lon,
      substr(md5((CASE WHEN e % 50 = 0 THEN u ELSE -e END)::VARCHAR), 1, 15) || (n + 1) AS phash,
      k / 100.0::DOUBLE AS brightness, (e * 31) % 100 / 100.0::DOUBLE AS saturation, (e * 17) % 60 / 100.0::DOUBLE AS edge_density,
      ((e * 13) % 60 - 30) / 100.0::DOUBLE AS warmth, ((e * 7) % 90)::DOUBLE AS colorfulness, (e * 19) % 100 / 100.0::DOUBLE AS blue_top_ratio,
      (e * 23) % 100 / 100.0::DOUBLE AS green_ratio, CASE WHEN e % 40 = 1 THEN 0.0001 ELSE 0.04 END AS luma_variance,
      CASE e % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.75 END AS aspect,
      CASE WHEN e % 11 <> 0 THEN CASE WHEN u % 2 = 0 AND e % 3 = 0 THEN 'Canon' ELSE 'Apple' END END AS camera_make,
      CASE WHEN e % 11 <> 0 THEN CASE WHEN u % 2 = 0 AND e % 3 = 0 THEN 'EOS R6' ELSE 'iPhone 15' END END AS camera_model,
      CASE WHEN e % 11 <> 0 THEN CASE WHEN e % 2 = 0 THEN 1.8 ELSE 4.0 END END AS f_number,
      CASE WHEN e % 11 <> 0 THEN 100 * (1 + e % 25) END AS iso, '#' || substr(md5('c' || e), 1, 6) AS top_hex
      FROM (SELECT *, unnest(CASE WHEN event_type = 'click' AND e % 3 = 0 THEN [0, 1, 2, 3] ELSE [0] END) AS n FROM ev)"""),
    "hinted": (("photos",), f"""SELECT *, regexp_matches(name, '{SCREENSHOT_NAME}') AS named,
      camera_make IS NULL AND edge_density > 0.3 AND brightness > 0.75 AND saturation < 0.25 AS flat,
      0.5 * least(1, greatest(0, edge_density)) + 0.3 * (1 - least(1.0, abs(brightness - 0.5) * 2)) + 0.2 * least(1, greatest(0, colorfulness / 100)) AS score,
      (hue + 360) % 360 <= 45 OR (hue + 360) % 360 >= 330 AS warm
      FROM (SELECT *, {_hue('r', 'g', 'b')} AS hue FROM (SELECT *, ('0x' || substr(top_hex, 2, 2))::INT::DOUBLE AS r, ('0x' || substr(top_hex, 4, 2))::INT::DOUBLE AS g, ('0x' || substr(top_hex, 6, 2))::INT::DOUBLE AS b FROM photos))"""),
    "scenes": (("hinted",), f"""SELECT *, CASE WHEN scene_confidence >= 0.55 AND scene NOT IN ('{MISC}', '{PEOPLE}') THEN scene END AS label FROM (
      SELECT *, CASE {' '.join(f"WHEN ({v}) IS NOT NULL THEN '{k}'" for k, v in _SCENE)} ELSE '{MISC}' END AS scene, coalesce({', '.join(f'({v})' for _, v in _SCENE)}, 0.4)::DOUBLE AS scene_confidence FROM hinted)"""),
    "living": (("scenes",), f"SELECT * FROM scenes WHERE label IS DISTINCT FROM '{SCREENSHOT}'"),
    "homes": (("living",), "SELECT * FROM home_of(living)"),
    "gazetteer": ((), "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {y}::DOUBLE, {x}::DOUBLE)" for k, (n, y, x) in enumerate(GAZETTEER)) + ") t(ord, name, lat, lon)"),
    "spots": (("photos",), "SELECT library_id, lat, lon, count(*) AS weight FROM photos WHERE lat IS NOT NULL GROUP BY ALL"),
    "near": (("spots",), f"SELECT a.library_id, a.weight, b.weight AS weight2 FROM spots a JOIN spots b USING (library_id) WHERE {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500"),
    "guarded": (("photos",), "SELECT library_id, id, taken_at, ('0x' || substr(phash, 1, 8))::BIGINT AS hi, ('0x' || substr(phash, 9, 8))::BIGINT AS lo FROM photos WHERE luma_variance >= 0.0008"),
    "hashes": (("guarded",), "SELECT library_id, hi, lo, min(id) AS rep FROM guarded GROUP BY ALL"),
    "dup_edges": (("hashes",), """SELECT library_id, rep AS a, id AS b FROM guarded JOIN hashes USING (library_id, hi, lo) WHERE id <> rep
      UNION ALL SELECT x.library_id, x.rep, y.rep FROM hashes x JOIN hashes y ON x.library_id = y.library_id AND x.rep < y.rep AND bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 5"""),
    "burst_edges": (("guarded",), """SELECT x.library_id, x.id AS a, y.id AS b FROM guarded x JOIN guarded y ON x.library_id = y.library_id AND y.taken_at - x.taken_at BETWEEN 0 AND 3000
      AND (x.taken_at < y.taken_at OR x.id < y.id) AND bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 10"""),
    "both_ways": (("dup_edges", "burst_edges"), "SELECT library_id, a, b FROM dup_edges UNION SELECT library_id, b, a FROM dup_edges UNION SELECT library_id, a, b FROM burst_edges UNION SELECT library_id, b, a FROM burst_edges"),
    "reached": (("both_ways",), "SELECT library_id, a AS id, a AS other FROM both_ways UNION SELECT r.library_id, r.id, w.b FROM reached r JOIN both_ways w ON w.library_id = r.library_id AND w.a = r.other"),
    "burst_members": (("reached",), "SELECT library_id, id, min(other) AS burst FROM reached GROUP BY ALL"),
    "burst_groups": (("burst_members", "scenes"), """SELECT library_id, burst, count(*) AS n, arg_min(id, (-score, id)) AS cover_id, min(taken_at) AS start, max(taken_at) AS "end",
      CASE WHEN count(taken_at) = count(*) AND count(*) >= 3 AND coalesce(max(gap), 0) <= 3000 THEN 'burst' ELSE 'dup' END AS subtype
      FROM (SELECT s.*, burst, taken_at - lag(taken_at) OVER (PARTITION BY library_id, burst ORDER BY taken_at NULLS LAST, id) AS gap FROM scenes s JOIN burst_members USING (library_id, id)) GROUP BY library_id, burst"""),
}


def _sessions(rows: str) -> str:
    return f"""SELECT *, max(fresh) OVER (PARTITION BY library_id ORDER BY taken_at, id) AS session_start FROM (
      SELECT *, CASE WHEN coalesce(taken_at - lag(taken_at) OVER (PARTITION BY library_id ORDER BY taken_at, id) > 14400000, true) THEN taken_at END AS fresh FROM {rows} WHERE taken_at IS NOT NULL)"""


def _days(rows: str) -> str:
    return f"""SELECT library_id, floor(session_start / {DAY}.0)::BIGINT AS day, min(taken_at) AS start, max(taken_at) AS "end", count(*) AS n,
      count(*) FILTER (counted) AS n_counted, max({haversine('home_lat', 'home_lon', 'lat', 'lon')}) AS furthest FROM {rows} GROUP BY 1, 2"""


def _runs(rows: str) -> str:
    return f"""SELECT *, max(fresh) OVER (PARTITION BY library_id ORDER BY day) AS run FROM (
      SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY library_id ORDER BY day) > 64800000, true) THEN start END AS fresh FROM {rows})"""


def _homes(rows: str) -> str:
    return f"""SELECT library_id, best.lat AS home_lat, best.lon AS home_lon FROM (
      SELECT library_id, arg_min(struct_pack(n := n, lat := lat, lon := lon), (-n, cell)) AS best FROM (
        SELECT library_id, floor(lat / (1000 / 111320.0::DOUBLE) + 0.5)::BIGINT || ':' || floor(lon / (1000 / (111320.0::DOUBLE * greatest(0.01, abs(cos(radians(lat)))))) + 0.5)::BIGINT AS cell, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon
        FROM {rows} WHERE lat IS NOT NULL GROUP BY ALL) GROUP BY 1) WHERE best.n >= 3"""


CTES["homes"] = (("living",), _homes("living"))
CTES |= {
    "sessions": (("photos",), _sessions("photos")),
    "all_homes": (("photos",), _homes("photos")),
    "all_sessions": (("photos", "all_homes"), _sessions("(SELECT *, true AS counted FROM photos LEFT JOIN all_homes USING (library_id))")),
    "all_days": (("all_sessions",), _days("all_sessions")),
    "all_runs": (("all_days",), _runs("all_days")),
    "counted": (("living", "homes", "burst_groups"), "SELECT l.*, home_lat, home_lon, coalesce(l.id = g.cover_id, true) AS counted FROM living l LEFT JOIN burst_members m USING (library_id, id) LEFT JOIN burst_groups g ON g.library_id = l.library_id AND g.burst = m.burst LEFT JOIN homes h ON h.library_id = l.library_id"),
    "event_sessions": (("counted",), _sessions("counted")),
    "event_runs": (("event_sessions",), _runs(f"({_days('event_sessions')})")),
    "event_days": (("event_runs",), """SELECT library_id, day, start, "end", n_counted, CASE WHEN is_trip THEN 'trip' ELSE 'day' END AS event_kind, CASE WHEN is_trip THEN run ELSE start END AS event FROM event_runs JOIN (
      SELECT library_id, run, count(*) >= 2 AND sum(n_counted) >= 20 AND coalesce(max(furthest) > 30000, true) AS is_trip FROM event_runs GROUP BY 1, 2) USING (library_id, run)"""),
    "events_of": (("event_days",), "SELECT library_id, event_kind, event, sum(n_counted)::BIGINT AS n_counted, count(*) - 1 AS nights FROM event_days GROUP BY 1, 2, 3"),
    "in_events": (("event_days",), f"SELECT s.library_id, s.id, d.event_kind, d.event FROM event_sessions s JOIN event_days d ON d.library_id = s.library_id AND d.day = floor(s.session_start / {DAY}.0)::BIGINT"),
    "points": (("living",), "SELECT library_id, lat, lon, min((coalesce(taken_at, 4611686018427387904), id)) AS point, count(*) AS weight FROM living WHERE lat IS NOT NULL GROUP BY ALL"),
    "reach": (("points",), f"SELECT a.library_id, a.point AS p, b.point AS q, b.weight FROM points a JOIN points b USING (library_id) WHERE {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500"),
    "cores": (("reach",), "SELECT library_id, p FROM reach GROUP BY ALL HAVING sum(weight) >= 3"),
    "core_links": (("cores",), "SELECT r.library_id, r.p, r.q FROM reach r JOIN cores a ON a.library_id = r.library_id AND a.p = r.p JOIN cores b ON b.library_id = r.library_id AND b.p = r.q"),
    "core_reached": (("core_links",), "SELECT library_id, p, p AS q FROM cores UNION SELECT c.library_id, c.p, l.q FROM core_reached c JOIN core_links l ON l.library_id = c.library_id AND l.p = c.q"),
    "core_names": (("core_reached",), "SELECT library_id, p, min(q) AS cluster FROM core_reached GROUP BY ALL"),
    "clusters": (("core_names",), "SELECT r.library_id, r.p, min(c.cluster) AS cluster FROM reach r JOIN core_names c ON c.library_id = r.library_id AND c.p = r.q GROUP BY ALL"),
    "places_of": (("clusters", "points"), "SELECT l.library_id, l.id, c.cluster[2] AS place FROM living l JOIN points t USING (library_id, lat, lon) JOIN clusters c ON c.library_id = t.library_id AND c.p = t.point"),
    "dates": ((), f"SELECT strftime(d, '%Y-%m-%d') AS day, {_holiday('d')} AS holiday, {_case('month(d)', naming.SEASON_OF_MONTH, 'NULL')} AS season FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)"),
    "paints": ((), f"""SELECT *, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM (
      SELECT *, CASE WHEN hue < 0 THEN hue + 360 ELSE hue END AS h, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS s, greatest(r, g, b) / 255 AS v,
      {_bent('x')} AS fx, {_bent('y')} AS fy, {_bent('z')} AS fz, '#' || printf('%02x%02x%02x', r::INT, g::INT, b::INT) AS hex FROM (
      SELECT *, {_hue('r', 'g', 'b')} AS hue, (0.4124564::DOUBLE * lr + 0.3575761::DOUBLE * lg + 0.1804375::DOUBLE * lb) / 0.95047::DOUBLE AS x, 0.2126729::DOUBLE * lr + 0.7151522::DOUBLE * lg + 0.072175::DOUBLE * lb AS y, (0.0193339::DOUBLE * lr + 0.119192::DOUBLE * lg + 0.9503041::DOUBLE * lb) / 1.08883::DOUBLE AS z FROM (
      SELECT *, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM (SELECT p_partkey, ((p_partkey * 7) % 256)::DOUBLE AS r, ((p_partkey * 31) % 256)::DOUBLE AS g, ((p_partkey * 101) % 256)::DOUBLE AS b FROM part))))"""),
}


_RANK = "list_position(['trip', 'place', 'day', 'scene', 'burst', 'screenshot', 'device', 'monthly'], {0})"
_SUMS = "count(*) AS n, min(taken_at) AS date_start, max(taken_at) AS date_end, arg_min(id, (-score, id)) AS cover_id"


def _month_day(ms: str) -> str:
    return f"month({ms}) || '月' || day({ms}) || '日'"


_START = "(DATE '1970-01-01' + floor(coalesce(date_start, 0) / 86400000.0)::INT)"
_TITLE = f"""CASE kind
  WHEN 'trip' THEN CASE WHEN place_known THEN place_name || '、' || CASE WHEN nights > 0 THEN nights || '泊' || (nights + 1) || '日の旅' ELSE '日帰り旅' END ELSE 'はじめての場所への旅' END
  WHEN 'place' THEN CASE WHEN place_home THEN 'いつもの場所' WHEN place_known THEN place_name || 'あたり' ELSE 'はじめての場所' END
  WHEN 'day' THEN coalesce({_holiday(_START)}, {_month_day(_START)}) || 'のおでかけ'
  WHEN 'burst' THEN CASE WHEN subtype = 'dup' THEN 'にたものコレクション' ELSE 'そっくりさんフォト（' || n || '枚）' END
  WHEN 'scene' THEN {_case("scene_label", naming.SCENE_TITLES, "'いろいろな写真'")}
  WHEN 'screenshot' THEN 'スクショ整理' WHEN 'device' THEN device_model || 'で撮った写真'
  ELSE CASE WHEN year IS NOT NULL THEN year || '年' || month || '月のこと' ELSE 'いつかの写真たち' END END"""
_EMOJI = f"""CASE kind WHEN 'trip' THEN CASE WHEN place_known THEN '🚅' ELSE '🧭' END WHEN 'place' THEN CASE WHEN place_home THEN '🏠' ELSE '📍' END
  WHEN 'day' THEN {_case(f"month({_START})", naming.SEASON_EMOJI, "NULL")} WHEN 'burst' THEN CASE WHEN subtype = 'dup' THEN '🖇️' ELSE '👯' END
  WHEN 'scene' THEN {_case("scene_label", naming.SCENE_EMOJI, "'🗂️'")} WHEN 'screenshot' THEN '📱' WHEN 'device' THEN '📷' ELSE '🗓️' END"""

CTES |= {
    "assigned": (("scenes", "burst_members", "in_events", "places_of", "homes"), """SELECT s.*, b.burst, e.event_kind, e.event, p.place, h.home_lat, h.home_lon FROM scenes s
      LEFT JOIN burst_members b ON b.library_id = s.library_id AND b.id = s.id LEFT JOIN in_events e ON e.library_id = s.library_id AND e.id = s.id
      LEFT JOIN places_of p ON p.library_id = s.library_id AND p.id = s.id LEFT JOIN homes h ON h.library_id = s.library_id"""),
    "members": (("assigned",), f"""SELECT *, event_kind AS kind, event_kind || ':' || event AS draft FROM assigned WHERE event IS NOT NULL
      UNION ALL SELECT *, 'place', 'place:' || place FROM assigned WHERE place IS NOT NULL UNION ALL SELECT *, 'burst', 'burst:' || burst FROM assigned WHERE burst IS NOT NULL
      UNION ALL SELECT *, CASE label WHEN '{SCREENSHOT}' THEN 'screenshot' ELSE 'scene' END, CASE label WHEN '{SCREENSHOT}' THEN 'screenshot:' ELSE 'scene:' END || label FROM assigned WHERE label IS NOT NULL
      UNION ALL SELECT *, 'device', 'device:' || camera_model FROM assigned WHERE camera_model IS NOT NULL"""),
    "summed": (("members",), f"""SELECT library_id, kind, draft, {_SUMS}, any_value(home_lat) AS home_lat, any_value(home_lon) AS home_lon,
      coalesce(CASE WHEN kind = 'trip' THEN avg(lat) FILTER ({haversine('home_lat', 'home_lon', 'lat', 'lon')} > 30000) END, avg(lat)) AS mid_lat,
      coalesce(CASE WHEN kind = 'trip' THEN avg(lon) FILTER ({haversine('home_lat', 'home_lon', 'lat', 'lon')} > 30000) END, avg(lon)) AS mid_lon FROM members GROUP BY 1, 2, 3"""),
    "nearest": (("summed", "gazetteer"), f"SELECT library_id, draft, arg_min(g.name, (m, g.ord)) AS near_name, min(m) AS near_meters FROM (SELECT s.library_id, s.draft, g, {haversine('s.mid_lat', 's.mid_lon', 'g.lat', 'g.lon')} AS m FROM summed s, gazetteer g WHERE mid_lat IS NOT NULL AND kind IN ('trip', 'place', 'day')) GROUP BY 1, 2"),
    "known": (("nearest", "events_of", "burst_groups"), f"""SELECT s.*, e.n_counted, e.nights, b.subtype, coalesce(near_meters <= CASE s.kind WHEN 'trip' THEN 8000 ELSE 1500 END, false) AS place_known, near_name AS place_name,
      coalesce(s.kind IN ('trip', 'place', 'day') AND {haversine('home_lat', 'home_lon', 'mid_lat', 'mid_lon')} <= 1000, false) AS place_home,
      (SELECT count(DISTINCT camera_model) FROM photos p WHERE p.library_id = s.library_id) AS n_models
      FROM summed s LEFT JOIN nearest n ON n.library_id = s.library_id AND n.draft = s.draft LEFT JOIN events_of e ON e.library_id = s.library_id AND s.draft = e.event_kind || ':' || e.event
      LEFT JOIN burst_groups b ON b.library_id = s.library_id AND s.draft = 'burst:' || b.burst"""),
    "large": (("known",), """SELECT *, CASE WHEN kind IN ('trip', 'burst', 'screenshot') THEN 'high' WHEN kind = 'day' THEN CASE WHEN n_counted >= 8 THEN 'high' ELSE 'med' END WHEN kind = 'place' AND NOT place_known THEN 'low' ELSE 'med' END AS confidence,
      CASE WHEN kind = 'scene' THEN substr(draft, 7) END AS scene_label, CASE WHEN kind = 'device' THEN substr(draft, 8) END AS device_model FROM known
      WHERE CASE kind WHEN 'trip' THEN true WHEN 'day' THEN n_counted >= 5 WHEN 'place' THEN n >= 5 AND (place_known OR place_home) WHEN 'burst' THEN n >= 3 WHEN 'device' THEN n >= 30 AND n_models >= 2 ELSE n >= 6 END"""),
    "alike": (("large",), f"""SELECT p.library_id, a, b, kind_b FROM (SELECT x.library_id, x.draft AS a, y.draft AS b, y.kind AS kind_b, count(*) AS common FROM members x JOIN members y ON x.library_id = y.library_id AND x.id = y.id AND {_RANK.format('x.kind')} < {_RANK.format('y.kind')} GROUP BY ALL) p
      JOIN large q ON q.library_id = p.library_id AND q.draft = p.a JOIN large r ON r.library_id = p.library_id AND r.draft = p.b WHERE common / (q.n + r.n - common) > 0.8"""),
}
_GONE = "alike"
for _level, _kind in enumerate(("place", "day", "scene", "burst", "screenshot", "device")):
    _before = f"UNION SELECT library_id, draft FROM gone{_level - 1}" if _level else ""
    _not = f"AND NOT EXISTS (SELECT 1 FROM gone{_level - 1} g WHERE g.library_id = s.library_id AND g.draft = s.a)" if _level else ""
    CTES[f"gone{_level}"] = ((_GONE,), f"SELECT library_id, b AS draft FROM alike s WHERE kind_b = '{_kind}' {_not} {_before}")
    _GONE = f"gone{_level}"
CTES |= {
    "kept": ((_GONE,), f"SELECT * FROM large WHERE (library_id, draft) NOT IN (SELECT (library_id, draft) FROM {_GONE})"),
    "in_kept": (("kept",), "SELECT m.* FROM members m JOIN kept k ON k.library_id = m.library_id AND k.draft = m.draft"),
    "rest": (("in_kept",), """SELECT *, 'monthly:' || coalesce(year, 0) || ':' || coalesce(month, 0) AS draft FROM (SELECT *, year(DATE '1970-01-01' + floor(taken_at / 86400000.0)::INT) AS year, month(DATE '1970-01-01' + floor(taken_at / 86400000.0)::INT) AS month FROM assigned)
      WHERE (library_id, id) NOT IN (SELECT (library_id, id) FROM in_kept)"""),
    "everyone": (("rest",), "SELECT library_id, id, draft, kind, taken_at, label FROM in_kept UNION ALL SELECT library_id, id, draft, 'monthly', taken_at, label FROM rest"),
    "merged": (("everyone",), f"""SELECT library_id, draft, kind, n, cover_id, date_start, date_end, nights, subtype, place_known, place_home, place_name, confidence, scene_label, device_model, NULL::BIGINT AS year, NULL::BIGINT AS month FROM kept
      UNION ALL SELECT library_id, draft, 'monthly', n, cover_id, date_start, date_end, NULL, NULL, false, false, NULL, 'low', NULL, NULL, year, month FROM (SELECT library_id, draft, year, month, {_SUMS} FROM rest GROUP BY ALL)"""),
    "tags": (("merged",), """SELECT library_id, draft, string_agg(label, ',' ORDER BY k) AS scene_tags FROM (SELECT e.library_id, e.draft, e.label, row_number() OVER (PARTITION BY e.library_id, e.draft ORDER BY count(*) DESC, e.label) AS k
      FROM everyone e JOIN merged m ON m.library_id = e.library_id AND m.draft = e.draft WHERE e.label IS NOT NULL AND e.label IS DISTINCT FROM m.scene_label GROUP BY 1, 2, 3) WHERE k <= 3 GROUP BY 1, 2"""),
    "album_photos": (("merged",), """SELECT e.library_id, m.kind || '-' || m.cover_id AS album_id, e.id, CASE WHEN e.id = m.cover_id THEN 0 ELSE 1 END AS shown, CASE WHEN m.kind = 'place' THEN 0 ELSE coalesce(e.taken_at, 4611686018427387904) END::BIGINT AS turn
      FROM everyone e JOIN merged m ON m.library_id = e.library_id AND m.draft = e.draft"""),
    "albums": (("tags",), f"""SELECT m.library_id, row_number() OVER (PARTITION BY m.library_id ORDER BY {_RANK.format('kind')}, date_end DESC NULLS LAST, kind || '-' || cover_id)::INTEGER AS rank, kind || '-' || cover_id AS album_id, kind,
      {_TITLE} AS title, {_EMOJI} AS emoji, confidence, n, cover_id, coalesce(scene_tags, '') AS scene_tags, date_start, date_end
      FROM merged m LEFT JOIN tags t ON t.library_id = m.library_id AND t.draft = m.draft"""),
}


def _dated(ms: str) -> str:
    return _month_day(f"(DATE '1970-01-01' + floor({ms} / 86400000.0)::INT)")


#: The seconds of a burst with one decimal, ties of the exact binary value upward: the value times ten is exact as a decimal.
_SECONDS = "printf('%.1f', floor(((date_end - date_start) / 1000)::DOUBLE::DECIMAL(38, 20) * 10 + 0.5) / 10)"
_SPAN = f"CASE WHEN date_start IS NOT NULL AND date_start <> date_end THEN {_dated('date_start')} || '〜' || {_dated('date_end')} || 'の' ELSE '' END"
CTES["album_reasons"] = (("merged",), f"""SELECT library_id, kind || '-' || cover_id AS album_id, CASE kind
  WHEN 'trip' THEN {_SPAN} || CASE WHEN nights > 0 THEN nights || '泊' || (nights + 1) || '日ぶんの' ELSE '日帰りの' END || 'おでかけっぽい' || n || '枚を、ひとつの旅としてまとめたよ。'
  WHEN 'day' THEN CASE WHEN date_start IS NOT NULL THEN {_dated('date_start')} || '・' ELSE '' END || CASE WHEN place_known THEN place_name || 'あたりで' ELSE '' END || '近い時間に撮った' || n || '枚を、その日のできごととしてまとめたよ。'
  WHEN 'place' THEN CASE WHEN place_home THEN 'いつもよく撮っている場所の' || n || '枚をあつめたよ。' ELSE CASE WHEN place_known THEN place_name || 'の近く' ELSE '同じ場所' END || 'で撮った' || n || '枚をまとめたよ。' END
  WHEN 'burst' THEN CASE WHEN subtype = 'dup' THEN 'そっくりな写真が' || n || '枚。見比べやすいようにまとめて、いちばん良い1枚を表紙にしたよ。'
    ELSE CASE WHEN date_end > date_start THEN {_SECONDS} || '秒のあいだの' ELSE '' END || '連写' || n || '枚。いちばんくっきりした1枚を表紙にしたよ。' END
  WHEN 'scene' THEN {_case("scene_label", naming.SCENE_PHRASES, "'雰囲気の似た写真を'")} || n || '枚みつけたよ。' || CASE WHEN scene_label IN ('{"', '".join(naming.UNSURE_SCENES)}') THEN '（自信ひかえめ）' ELSE '' END
  WHEN 'screenshot' THEN 'カメラで撮っていない、スクショや書類っぽい写真を' || n || '枚あつめたよ。'
  WHEN 'device' THEN coalesce(device_model, 'このカメラ') || 'で撮った写真を' || n || '枚あつめたよ。'
  ELSE CASE WHEN year IS NOT NULL THEN year || '年' || month || '月に撮った、どのアルバムにも入らなかった' || n || '枚をここにまとめておいたよ。' ELSE '撮影日時がわからなかった' || n || '枚を、ここにまとめておいたよ。' END END AS reason FROM merged""")


def _channel(at: int) -> str:
    return f"('0x' || substr(h, 8 * j + {2 * at + 1}, 2))::INT::DOUBLE"


CTES |= {
    # the rasters of `pixel_stats`, a row for each pixel; 4 pixels are a digest
    "dots": ((), f"""SELECT p_partkey, 4 * (i - 1) + j AS n, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM (
      SELECT p_partkey, i, md5(p_partkey || ':' || i % 97) AS h FROM part, range(1, 1025) t(i)), range(4) u(j)"""),
    "toned": (("dots",), """SELECT *, n % 64 AS x, n // 64 AS y, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255 AS gray, top - low AS span,
      CASE WHEN top = low THEN 0 WHEN top = sr THEN ((60 * ((sg - sb) / (top - low))) + 360) % 360 WHEN top = sg THEN 60 * ((sb - sr) / (top - low) + 2) ELSE 60 * ((sr - sg) / (top - low) + 4) END AS hue
      FROM (SELECT *, greatest(sr, sg, sb) AS top, least(sr, sg, sb) AS low FROM (SELECT *, r / 255 AS sr, g / 255 AS sg, b / 255 AS sb FROM dots))"""),
    "sobel": (("toned",), """SELECT p_partkey, avg(CASE WHEN sqrt(gx * gx + gy * gy) > 0.15 THEN 1.0 ELSE 0.0 END) AS edge_density FROM (
      SELECT p_partkey, x, y, (ne - nw) + 2 * (e - w) + (se - sw) AS gx, (sw - nw) + 2 * (s - o) + (se - ne) AS gy FROM (
        SELECT p_partkey, x, y, lag(gray, 65) OVER line AS nw, lag(gray, 64) OVER line AS o, lag(gray, 63) OVER line AS ne, lag(gray, 1) OVER line AS w,
          lead(gray, 1) OVER line AS e, lead(gray, 63) OVER line AS sw, lead(gray, 64) OVER line AS s, lead(gray, 65) OVER line AS se FROM toned WINDOW line AS (PARTITION BY p_partkey ORDER BY n))
      WHERE x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 62) GROUP BY 1"""),
    "eighths": (("toned",), """SELECT p_partkey, sum(CASE WHEN cell > mean THEN (1::HUGEINT << (63 - place)::INT) ELSE 0 END)::HUGEINT AS bits FROM (
      SELECT *, avg(cell) OVER (PARTITION BY p_partkey) AS mean FROM (SELECT p_partkey, 8 * (y // 8) + x // 8 AS place, avg(gray) AS cell FROM toned GROUP BY 1, 2)) GROUP BY 1"""),
    "pixel_means": (("toned", "sobel", "eighths"), """SELECT p_partkey, round(avg(gray) + 1e-9, 6) AS brightness, round(stddev_pop(gray), 6) AS contrast, round(var_pop(gray), 6) AS luma_variance, round((avg(r) - avg(b)) / 255, 6) AS warmth,
      round(avg(CASE WHEN gray > 0.85 THEN 1.0 ELSE 0.0 END), 6) AS highlights, round(avg(CASE WHEN top = 0 THEN 0 ELSE span / top END), 6) AS saturation,
      round(sqrt(var_pop(r - g) + var_pop((r + g) / 2 - b)) + 0.3 * sqrt(avg(r - g) ** 2 + avg((r + g) / 2 - b) ** 2), 4) AS colorfulness,
      round(avg(CASE WHEN hue BETWEEN 190 AND 250 AND span / top > 0.2 AND top > 0.4 THEN 1.0 ELSE 0.0 END) FILTER (y < 32), 6) AS blue_top_ratio,
      round(avg(CASE WHEN hue BETWEEN 70 AND 160 AND span / top > 0.25 AND top > 0.15 THEN 1.0 ELSE 0.0 END), 6) AS green_ratio,
      any_value(round(edge_density, 6)) AS edge_density, any_value(printf('%08x%08x', (bits // 4294967296)::BIGINT, (bits % 4294967296)::BIGINT)) AS ahash
      FROM toned JOIN sobel USING (p_partkey) JOIN eighths USING (p_partkey) GROUP BY p_partkey"""),
}


CTES |= {
    # the cosine transform of 32 x 32 means, as two joins with a table of cosines; a bit for each coefficient over the median of all but the first
    "cosines": ((), "SELECT k, n, cos((2 * n + 1) * k * pi() / 64) AS c FROM range(8) a(k), range(32) b(n)"),
    "boxes": (("toned",), "SELECT p_partkey, (x // 2)::BIGINT AS x, (y // 2)::BIGINT AS y, avg(gray) AS cell FROM toned GROUP BY 1, 2, 3"),
    "half_turned": (("boxes", "cosines"), "SELECT p_partkey, y, k AS v, sum(cell * c) AS held FROM boxes JOIN cosines ON n = x GROUP BY 1, 2, 3"),
    "turned": (("half_turned",), "SELECT p_partkey, k * 8 + v AS place, sum(held * c) AS coefficient FROM half_turned JOIN cosines ON n = y GROUP BY 1, 2"),
    "pixel_hashes": (("turned",), """SELECT p_partkey, printf('%08x%08x', sum(bit) FILTER (place < 32)::BIGINT, sum(bit) FILTER (place >= 32)::BIGINT) AS phash FROM (
      SELECT p_partkey, place, CASE WHEN coefficient > middle THEN 1::BIGINT << (31 - place % 32)::INT ELSE 0 END AS bit
      FROM turned JOIN (SELECT p_partkey, list_sort(list(coefficient))[32] AS middle FROM turned WHERE place > 0 GROUP BY 1) USING (p_partkey)) GROUP BY 1"""),
    # density clusters by the Hamming distance of all pairs
    "hash_reach": (("guarded",), """SELECT x.library_id, x.rep AS p, y.rep AS q, y.n FROM (SELECT library_id, hi, lo, min(id) AS rep FROM guarded GROUP BY ALL) x
      JOIN (SELECT library_id, hi, lo, min(id) AS rep, count(*) AS n FROM guarded GROUP BY ALL) y ON x.library_id = y.library_id AND bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 8"""),
    "hash_cores": (("hash_reach",), "SELECT library_id, p FROM hash_reach GROUP BY ALL HAVING sum(n) >= 4"),
    "hash_links": (("hash_cores",), "SELECT r.library_id, r.p, r.q FROM hash_reach r JOIN hash_cores a ON a.library_id = r.library_id AND a.p = r.p JOIN hash_cores b ON b.library_id = r.library_id AND b.p = r.q"),
    "hash_reached": (("hash_links",), "SELECT library_id, p, p AS q FROM hash_cores UNION SELECT c.library_id, c.p, l.q FROM hash_reached c JOIN hash_links l ON l.library_id = c.library_id AND l.p = c.q"),
    "hash_clusters": (("hash_reached",), """SELECT r.library_id, r.p AS rep, min(c.cluster) AS cluster FROM hash_reach r
      JOIN (SELECT library_id, p, min(q) AS cluster FROM hash_reached GROUP BY ALL) c ON c.library_id = r.library_id AND c.p = r.q GROUP BY ALL"""),
    "shops": ((), "SELECT s_suppkey AS ord, s_name AS name, 35.6::DOUBLE + (s_suppkey * 7919 % 1000) * 0.0005::DOUBLE AS lat, 139.4::DOUBLE + (s_suppkey * 104729 % 1009) * 0.0005::DOUBLE AS lon FROM supplier"),
    # what `exif_tags` writes into its files
    "tagged": (("ev",), """SELECT e AS event_id, CASE WHEN e % 31 = 0 THEN ms // 1000 * 1000 + 86400000 WHEN e % 13 = 0 THEN NULL WHEN e % 23 = 0 THEN epoch_ms(TIMESTAMP '2024-02-02 01:02:01') ELSE ms // 1000 * 1000 END AS taken_at,
      CASE WHEN e % 7 <> 0 THEN round((e * 7 % 90 + (e * 11 % 60) / 60.0::DOUBLE + ((e * 13 % 6000) / 100.0::DOUBLE) / 3600) * CASE WHEN e % 3 = 0 THEN -1 ELSE 1 END, 9) END AS lat,
      CASE WHEN e % 7 <> 0 THEN round((e * 17 % 180 + (e * 19 % 60) / 60.0::DOUBLE + ((e * 23 % 6000) / 100.0::DOUBLE) / 3600) * CASE WHEN e % 4 = 0 THEN -1 ELSE 1 END, 9) END AS lon,
      CASE WHEN e % 11 <> 0 THEN CASE WHEN e % 3 = 0 THEN 'Canon' ELSE 'Apple' END END AS make, CASE WHEN e % 11 <> 0 THEN 'Model ' || (e % 170) END AS model, 1 + e % 8 AS orientation,
      CASE WHEN e % 29 = 0 THEN 0.0::DOUBLE ELSE floor((10 + e % 50) / 10.0::DOUBLE * 100 + 0.5) / 100 END AS f_number, CASE WHEN e % 17 <> 0 THEN 100 * (1 + e % 25) END AS iso,
      floor((e * 37 % 5000)::DOUBLE / (1 + e % 7) * 100 + 0.5) / 100 AS focal_length, CASE WHEN e % 19 <> 0 THEN round(1.0::DOUBLE / (1 + e % 4000), 9) END AS exposure, (1000 + e % 5000)::DOUBLE AS pixel_width, (500 + e % 3000)::DOUBLE AS pixel_height FROM ev"""),
}


def with_ctes(names: tuple[str, ...], select: str) -> str:
    """`select` after all common table expressions that it needs, each once."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                need(other)
            order.append(name)

    for name in names:
        need(name)
    out = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + select
    return out
