"""The registered queries as SQL for an independent engine."""

from __future__ import annotations

from wayfold import config as C
from wayfold.config import ACTIVITIES, SPARSE, TALLY_ORDER
from wayfold.functions import names
from wayfold.functions.activity import MEAN_SPEEDS, NAME_PATTERNS
from wayfold.functions.geo import RADIUS
from wayfold.functions.num import ewma_alpha
from wayfold.plans.queries import BOXES, DAY, HOUR, SAMPLE_NAMES, SPLIT
from wayfold.plans.tracks import DUCK

ORDERED = "PARTITION BY subject_id ORDER BY unix_s, event_id"
LAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
TIMED = f"""timed AS (SELECT *, CAST(CASE WHEN step IS NULL OR step > {DAY} THEN 1 WHEN step < 0 THEN 0 ELSE step END AS BIGINT) AS time_offset
  FROM (SELECT *, unix_s - lag(unix_s) OVER ({ORDERED}) AS step FROM tracks))"""
NAME = "CASE WHEN activity = '' THEN 'Unknown' ELSE activity END"


def on_tracks(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE tracks AS ({DUCK}), " + ", ".join([TIMED, *ctes]) + " " + body


def metres(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"({2 * RADIUS} * asin(sqrt(least({h}, 1.0))))"


def trunc(x: str, places: int) -> str:
    return f"CAST(trunc(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30,15)) * {10**places}) AS DOUBLE) / {10**places}"


def sql_code(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN {k}" for k, a in enumerate(ACTIVITIES)) + " ELSE -1 END"


def accumulated(source: str, keys: str, gap: int) -> str:
    """The accumulator by counting gaps over whole keys."""
    tally = ", ".join(f"CAST(sum(CASE WHEN name = '{a}' THEN time_offset ELSE 0 END) AS BIGINT) AS am_{a.lower()}" for a in TALLY_ORDER)
    best = "greatest(" + ", ".join(f"am_{a.lower()}" for a in TALLY_ORDER) + ")"
    mode = "CASE " + " ".join(f"WHEN am_{a.lower()} = {best} AND {best} > 0 THEN '{a}'" for a in TALLY_ORDER) + " ELSE 'Unknown' END"
    return f"""SELECT *, {mode} AS activity_mode FROM (
      SELECT {keys}, count(*) AS count, 1 + count(*) FILTER (unix_s - seen > {gap}) AS visit_count, min(unix_s) AS first_s, max(unix_s) AS last_s,
        CAST(sum(time_offset) AS BIGINT) AS total_offset_s, {tally}
      FROM (SELECT *, {NAME} AS name, max(unix_s) OVER (PARTITION BY {keys} ORDER BY unix_s, event_id {LAST}) AS seen FROM {source}) GROUP BY {keys})"""


RAW = """raw AS (SELECT event_id, subject_id, unix_s, lon, CASE WHEN event_id % 19 = 0 THEN 'Other' ELSE 'Feature' END AS type,
  CASE WHEN event_id % 53 = 0 THEN 'LineString' ELSE 'Point' END AS geometry_type, CASE WHEN event_id % 23 = 0 THEN 95.0 ELSE lat END AS lat,
  CASE WHEN event_id % 29 = 0 THEN '' ELSE subject_id END AS name, CASE WHEN event_id % 31 <> 0 THEN device_id END AS device_id,
  CASE WHEN event_id % 41 = 0 THEN 5 ELSE 0 END AS apart, CASE WHEN event_id % 37 <> 0 THEN accuracy END AS accuracy FROM tracks),
judged AS (SELECT event_id, CASE WHEN type <> 'Feature' THEN 'not a feature' WHEN geometry_type <> 'Point' THEN 'not a point' WHEN lat > 90 THEN 'bad latitude'
  WHEN name = '' THEN 'no name' WHEN device_id IS NULL THEN 'no device' WHEN apart > 1 THEN 'times differ' WHEN accuracy IS NULL THEN 'no accuracy' END AS invalid_reason FROM raw)"""

ACTIVE = f"active AS (SELECT *, {sql_code('activity')} AS code FROM timed WHERE {sql_code('activity')} > 0)"
IDLE = f"idle AS (SELECT * FROM timed WHERE {sql_code('activity')} <= 0)"
MOVES = f"""stepped AS (SELECT *, lag(code) OVER w AS pcode, lag(unix_s) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(elevation) OVER w AS pelev
  FROM active WINDOW w AS ({ORDERED})),
marked AS (SELECT *, CASE WHEN pt IS NULL OR unix_s - pt > {SPARSE.move_gap_s}
    OR (NOT (pcode BETWEEN 1 AND 3 AND code BETWEEN 1 AND 3) AND NOT (pcode BETWEEN 1 AND 3 AND code = 4) AND abs(pcode - code) > 1) THEN 1 ELSE 0 END AS starts FROM stepped),
seg AS (SELECT *, CAST(sum(starts) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM marked),
inner_ AS (SELECT *, CASE WHEN starts = 0 THEN CASE WHEN unix_s - pt > {DAY} THEN 1 ELSE unix_s - pt END END AS s,
  CASE WHEN starts = 0 THEN {metres("plon", "plat", "lon", "lat")} END AS m, CASE WHEN starts = 0 AND unix_s > pt THEN elevation - round(pelev) END AS climb FROM seg),
made AS (SELECT subject_id, segment, count(*) AS raw_point_count, min(unix_s) AS start_s, max(unix_s) AS end_s, max(unix_s) - min(unix_s) AS duration_s,
  {trunc("avg(accuracy)", 0)} AS accuracy_mean, {trunc("median(accuracy)", 0)} AS accuracy_median, {trunc("min(speed)", 2)} AS speed_reported_min, {trunc("max(speed)", 2)} AS speed_reported_max,
  {trunc("min(round(elevation))", 0)} AS elevation_min, {trunc("max(round(elevation))", 0)} AS elevation_max, round(sum(m)) AS distance_traversed_m,
  arg_min(lon, unix_s * 100000000 + event_id) AS lon1, arg_min(lat, unix_s * 100000000 + event_id) AS lat1, arg_max(lon, unix_s * 100000000 + event_id) AS lon2, arg_max(lat, unix_s * 100000000 + event_id) AS lat2,
  floor(coalesce(sum(climb) FILTER (climb > 0), 0)) AS elevation_gain_m, floor(coalesce(sum(-climb) FILTER (climb < 0), 0)) AS elevation_loss_m,
  avg(m / s) FILTER (s > 0) AS calc_mean, avg(speed) AS speed_mean, {", ".join(f"sum(CASE WHEN activity = '{a}' THEN time_offset ELSE 0 END) AS w{k}" for k, a in enumerate(ACTIVITIES))}
  FROM inner_ GROUP BY subject_id, segment HAVING count(*) >= 2)"""
RANKED = "list_sort(list_filter([{'w': -w1, 'k': 1}, {'w': -w2, 'k': 2}, {'w': -w3, 'k': 3}, {'w': -w4, 'k': 4}, {'w': -w5, 'k': 5}, {'w': -w0, 'k': 0}], lambda x: true))"
STAYS = f"""numbered AS (SELECT *, row_number() OVER ({ORDERED}) AS r FROM idle),
        walk AS (SELECT subject_id, event_id, unix_s, lon, lat, accuracy, elevation, r, 0 AS stay, lon AS sx, lat AS sy, 1 AS sn FROM numbered WHERE r = 1
          UNION ALL SELECT n.subject_id, n.event_id, n.unix_s, n.lon, n.lat, n.accuracy, n.elevation, n.r, CASE WHEN brk THEN w.stay + 1 ELSE w.stay END,
            CASE WHEN brk THEN n.lon WHEN w.sn < 602 THEN w.sx + n.lon ELSE w.sx END, CASE WHEN brk THEN n.lat WHEN w.sn < 602 THEN w.sy + n.lat ELSE w.sy END, CASE WHEN brk THEN 1 ELSE least(w.sn + 1, 602) END
          FROM (SELECT w.*, n.r AS nr, n.unix_s - w.unix_s > {SPARSE.stay_gap_s} OR {metres("w.sx / w.sn", "w.sy / w.sn", "n.lon", "n.lat")} > {SPARSE.stay_radius_m} AS brk FROM walk w JOIN numbered n ON n.subject_id = w.subject_id AND n.r = w.r + 1) w
          JOIN numbered n ON n.subject_id = w.subject_id AND n.r = w.nr)"""


def teleports(source: str) -> str:
    """CTEs that end in tele_walk: which rows of source are kept."""
    return f"""tele_rows AS (SELECT *, row_number() OVER ({ORDERED}) AS r FROM {source}),
        tele_walk AS (SELECT subject_id, event_id, r, true AS kept, unix_s AS at_s, lon AS alon, lat AS alat FROM tele_rows WHERE r = 1
          UNION ALL SELECT subject_id, event_id, r, ok, CASE WHEN ok THEN unix_s ELSE at_s END, CASE WHEN ok THEN lon ELSE alon END, CASE WHEN ok THEN lat ELSE alat END FROM (
            SELECT n.*, w.at_s, w.alon, w.alat, n.unix_s - w.at_s > {SPARSE.teleport_window_s} OR NOT (m > {SPARSE.teleport_distance_m} AND (n.unix_s = w.at_s OR m / (n.unix_s - w.at_s) > n.speed * (1 + {SPARSE.teleport_factor} / n.time_offset))) AS ok
            FROM (SELECT w.*, {metres("w.alon", "w.alat", "n.lon", "n.lat")} AS m, n.r AS nr FROM tele_walk w JOIN tele_rows n ON n.subject_id = w.subject_id AND n.r = w.r + 1) w JOIN tele_rows n ON n.subject_id = w.subject_id AND n.r = w.nr))"""


# The public curve of hierarchical cells, in its own words: place and next orientation by 4 * orientation + quadrant.
CURVE_PLACE = [0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0]
CURVE_NEXT = [1, 0, 3, 0, 0, 2, 1, 1, 2, 1, 2, 3, 3, 3, 0, 2]
FLAT = lambda t: f"CASE WHEN {t} >= 0 THEN 0.5 * sqrt(1 + 3 * {t}) ELSE 1 - 0.5 * sqrt(1 - 3 * {t}) END"
GROUNDED = "lower(activity) NOT LIKE 'fly%' AND speed <= 67.06 AND elevation < 8848"


def celled(source: str, levels: str, where: str = "true") -> str:
    """Rows of source with level and cell_key, as CTEs that end in celled."""
    return f"""s2xyz AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM {source} WHERE {where}),
s2face AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END WHEN z < 0 THEN 5 ELSE 2 END AS face FROM s2xyz),
s2uv AS (SELECT *, CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
  CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM s2face),
s2ij AS (SELECT *, CAST(least(greatest(floor(({FLAT("u")}) * 1073741824), 0), 1073741823) AS BIGINT) AS si, CAST(least(greatest(floor(({FLAT("v")}) * 1073741824), 0), 1073741823) AS BIGINT) AS sj FROM s2uv),
s2pos AS (SELECT *, list_reduce([CAST(face & 1 AS BIGINT)] || [CAST(29 - b AS BIGINT) for b in range(17)],
  lambda s, b: ((s >> 2) * 4 + {CURVE_PLACE}[(s & 3) * 4 + ((si >> b) & 1) * 2 + ((sj >> b) & 1) + 1]) * 4 + {CURVE_NEXT}[(s & 3) * 4 + ((si >> b) & 1) * 2 + ((sj >> b) & 1) + 1]) >> 2 AS pos FROM s2ij),
celled AS (SELECT * EXCLUDE (x, y, z, face, u, v, si, sj, pos), rtrim(lpad(lower(to_hex(CAST(CAST(face AS HUGEINT) * 2305843009213693952
    + CAST(pos >> (2 * (17 - level)) AS HUGEINT) * CAST(pow(2, 61 - 2 * level) AS HUGEINT) + CAST(pow(2, 60 - 2 * level) AS HUGEINT) AS UBIGINT))), 16, '0'), '0') AS cell_key
  FROM s2pos, (SELECT CAST(unnest({levels}) AS INTEGER) AS level))"""


def plausible(code: str, v: str) -> str:
    return f"CASE {code} WHEN 0 THEN {v} < 0.23 WHEN 1 THEN {v} > 0 AND {v} < 1.78 WHEN 2 THEN {v} >= 1.2 AND {v} < 5.56 WHEN 3 THEN {v} >= 1.2 AND {v} < 25.29 WHEN 4 THEN {v} >= 0.23 AND {v} < 44.7 WHEN 5 THEN {v} >= 44.7 ELSE true END"


def nearest(v: str) -> str:
    rows = ", ".join(f"{{'g': abs({v} - {m}::DOUBLE), 'k': {k}}}" for k, m in enumerate((-0.207, 1.2, 3.35, 5.36, 13.9, 67.06)))
    return f"CASE WHEN list_sort([{rows}])[1].g < 100 THEN list_sort([{rows}])[1].k ELSE 0 END"


def weights_of(rows: str) -> str:
    """Weights by activity code in a list of (t, c, w), heaviest first, ties to the smaller code."""
    each = ", ".join(f"{{'nw': -coalesce(list_sum([x.w for x in {rows} if x.c = {c}]), 0), 'c': {c}}}" for c in range(-1, 6))
    return f"list_sort([{each}])"


def improved(source: str, settings=SPARSE) -> str:
    """The activity machine as a recursion over each subject's rows; CTEs that end in better (source's columns, activity replaced, acceleration)."""
    alpha = "(1 - exp(-5 / 60.0 / 0.5))"
    gap, keep = settings.improver_reset_s, settings.improver_interval_s
    fits = lambda ranked, v: f"list_filter({ranked}, lambda x: x.nw < 0 AND x.c >= 0 AND {plausible('x.c', v)})[1].c"
    empty = "CAST([] AS STRUCT(t BIGINT, c INTEGER, w DOUBLE)[])"
    tick = lambda rate, now: f"CASE WHEN {rate} IS NULL THEN {now} ELSE {rate} + {alpha} * ({now} - {rate}) END"
    return f"""im_rows AS (SELECT *, row_number() OVER ({ORDERED}) AS r, {sql_code('activity')} AS code,
    coalesce(unix_s - lag(unix_s) OVER ({ORDERED}) > {gap} OR device_id IS DISTINCT FROM lag(device_id) OVER ({ORDERED}), true) AS fresh FROM {source}),
im_walk AS (SELECT DISTINCT subject_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS srate, CAST(NULL AS DOUBLE) AS crate, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py,
    CAST(NULL AS BIGINT) AS first_t, CAST(NULL AS BIGINT) AS last_t, CAST(0 AS DOUBLE) AS last_speed, -1 AS act, CAST(0 AS DOUBLE) AS accel, {empty} AS rep, {empty} AS can FROM im_rows
  UNION ALL SELECT subject_id, r, event_id, CASE WHEN moving THEN srate2 ELSE srate END, CASE WHEN moving THEN crate2 ELSE crate END, CASE WHEN moving THEN lon ELSE px END, CASE WHEN moving THEN lat ELSE py END,
    first_t, CASE WHEN moving THEN unix_s ELSE last_t END, CASE WHEN moving THEN safe ELSE last_speed END, CASE WHEN moving THEN proposal ELSE act END, CASE WHEN moving THEN (safe - last_speed) / o ELSE accel END,
    CASE WHEN moving THEN rep2 ELSE rep END, CASE WHEN moving THEN list_filter(list_append(can, {{'t': unix_s, 'c': proposal, 'w': CAST(time_offset AS DOUBLE)}}), lambda x: unix_s - x.t <= {keep}) ELSE can END
  FROM (SELECT *, CAST(CASE WHEN heading < 0 AND speed < 0 AND (code = 0 OR slow < 0.23) THEN 0 WHEN code >= 0 AND {plausible('code', 'slow')} THEN code
      WHEN code < 0 THEN CASE WHEN ranked[1].c = 1 AND NOT ({plausible('1', 'safe')}) AND {plausible('4', 'slow')} THEN 4 ELSE coalesce({fits('ranked', 'safe')}, {fits('canon', 'safe')}, {nearest('safe')}) END
      WHEN greatest(rate, calc) > 44.7 THEN 5 ELSE coalesce({fits('canon', 'calc')}, {nearest('calc')}) END AS INTEGER) AS proposal
    FROM (SELECT *, CASE WHEN unix_s - first_t > {keep} THEN least(rate, calc) ELSE least(rate, safe) END AS slow, {weights_of('rep2')} AS ranked, {weights_of('can')} AS canon
      FROM (SELECT *, srate2 / 100 AS rate, coalesce(crate2, 0) / 100 AS calc
        FROM (SELECT *, {tick('srate', 'snow')} AS srate2, CASE WHEN px IS NULL THEN crate ELSE {tick('crate', 'cnow')} END AS crate2,
            list_filter(list_append(rep, {{'t': unix_s, 'c': code, 'w': CAST(o AS DOUBLE)}}), lambda x: unix_s - x.t <= {keep}) AS rep2
          FROM (SELECT *, floor(safe * 100 + 0.5) / greatest(1, o) AS snow, CASE WHEN moving AND px IS NOT NULL THEN floor({metres("px", "py", "lon", "lat")} / o * 100 + 0.5) / greatest(1, o) END AS cnow
            FROM (SELECT *, o <> 0 AS moving, greatest(speed, 0) AS safe
              FROM (SELECT n.*, CASE WHEN fresh OR w.last_t IS NULL THEN n.time_offset ELSE n.unix_s - w.last_t END AS o, CASE WHEN NOT fresh THEN w.srate END AS srate, CASE WHEN NOT fresh THEN w.crate END AS crate,
                  CASE WHEN NOT fresh THEN w.px END AS px, CASE WHEN NOT fresh THEN w.py END AS py, CASE WHEN fresh THEN n.unix_s ELSE coalesce(w.first_t, n.unix_s) END AS first_t, CASE WHEN NOT fresh THEN w.last_t END AS last_t,
                  CASE WHEN fresh THEN 0 ELSE w.last_speed END AS last_speed, CASE WHEN fresh THEN -1 ELSE w.act END AS act, CASE WHEN fresh THEN 0 ELSE w.accel END AS accel,
                  CASE WHEN fresh THEN {empty} ELSE w.rep END AS rep, CASE WHEN fresh THEN {empty} ELSE w.can END AS can
                FROM im_walk w JOIN im_rows n ON n.subject_id = w.subject_id AND n.r = w.r + 1)))))))),
better AS (SELECT * EXCLUDE (act, accel, activity), {[*ACTIVITIES, "Unknown"]}[CASE WHEN act < 0 THEN 7 ELSE act + 1 END] AS activity, accel AS acceleration
  FROM (SELECT s.*, w.act, w.accel FROM {source} s JOIN im_walk w ON w.subject_id = s.subject_id AND w.event_id = s.event_id AND w.r > 0))"""


def improved_by_windows(source: str, settings=SPARSE) -> str:
    """The older activity machine as a recursion; CTEs that end in ow_walk (subject_id, r, event_id, act)."""
    keep, reset = settings.improver_interval_s, settings.improver_reset_s
    empty = "CAST([] AS STRUCT(t BIGINT, c INTEGER, w DOUBLE, s DOUBLE, k DOUBLE)[])"
    total = lambda c: f"list_sum([x.{c} for x in win])"
    return f"""ow_rows AS (SELECT *, row_number() OVER ({ORDERED}) AS r, {sql_code('activity')} AS code FROM {source}),
ow_walk AS (SELECT DISTINCT subject_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS last_t, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py, CAST(NULL AS BIGINT) AS checked, -1 AS act, {empty} AS win FROM ow_rows
  UNION ALL SELECT subject_id, r, event_id, CASE WHEN same THEN last_t ELSE unix_s END, CASE WHEN same THEN px ELSE lon END, CASE WHEN same THEN py ELSE lat END, CASE WHEN due THEN unix_s ELSE checked END,
    CAST(CASE WHEN NOT due THEN act WHEN top > 0 THEN top WHEN pace <= 0.23 THEN 0 WHEN pace <= 1.78 THEN 1 WHEN pace <= 5.56 THEN 2 WHEN pace <= 11.76 THEN 3 WHEN pace <= 67.06 THEN 4 ELSE 5 END AS INTEGER), win
  FROM (SELECT *, NOT same AND (checked IS NULL OR unix_s - checked > {keep}) AS due, list_filter({weights_of('win')}, lambda x: x.c >= 0)[1].c AS top, ({total('s')} / {total('w')} + {total('k')} / {total('w')}) / 2 AS pace
    FROM (SELECT * EXCLUDE (win), CASE WHEN same THEN win ELSE list_append(win, {{'t': unix_s, 'c': code, 'w': o, 's': speed * o, 'k': CASE WHEN len(win) = 0 THEN greatest(speed, 0) * o ELSE {metres("px", "py", "lon", "lat")} / o * o END}}) END AS win
      FROM (SELECT * EXCLUDE (win), CASE WHEN same THEN win ELSE list_filter(win, lambda x: unix_s - x.t <= {keep}) END AS win, CAST(CASE WHEN last_t IS NULL THEN 1 ELSE least(unix_s - last_t, {keep}) END AS DOUBLE) AS o
        FROM (SELECT *, last_t IS NOT NULL AND unix_s - last_t <= 1 AS same
          FROM (SELECT n.*, CASE WHEN NOT again THEN last_t END AS last_t, CASE WHEN NOT again THEN px END AS px, CASE WHEN NOT again THEN py END AS py, CASE WHEN NOT again THEN checked END AS checked, CASE WHEN again THEN -1 ELSE act END AS act, CASE WHEN again THEN {empty} ELSE win END AS win
            FROM (SELECT n AS n, w.* EXCLUDE (subject_id, r, event_id), w.last_t IS NULL OR n.unix_s - w.last_t > {reset} AS again FROM ow_walk w JOIN ow_rows n ON n.subject_id = w.subject_id AND n.r = w.r + 1)))))))"""


ALL_LEVELS = "[0] || range(3, 18)"
FAULTS = """CASE WHEN event_id % 43 = 0 THEN 'not readable' WHEN event_id % 47 = 0 THEN 'unknown type' WHEN event_id % 59 = 0 THEN 'no place' WHEN event_id % 67 = 0 THEN 'no features' WHEN event_id % 23 = 0 THEN 'not a point'
  WHEN event_id % 19 = 0 THEN 'no properties' WHEN event_id % 29 = 0 THEN 'name not text' WHEN event_id % 31 = 0 THEN 'device not text' WHEN event_id % 37 = 0 OR event_id % 61 = 0 THEN 'times differ' WHEN event_id % 41 = 0 THEN 'accuracy not a number' ELSE 'valid' END"""
TURNS = f"""turns AS (SELECT *, lag(b) OVER w AS pb, lag(m) OVER w AS pm, row_number() OVER w AS k FROM (SELECT subject_id, segment, unix_s, event_id, plon AS x1, plat AS y1, lon AS x2, lat AS y2, m,
  degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) AS b FROM inner_ WHERE starts = 0)
  WINDOW w AS (PARTITION BY subject_id, segment ORDER BY unix_s, event_id))"""


AWAY = """CASE WHEN p[lo].x = p[hi].x AND p[lo].y = p[hi].y THEN sqrt(pow(p[i].x - p[lo].x, 2) + pow(p[i].y - p[lo].y, 2))
    ELSE abs((p[i].x - p[lo].x) * (p[hi].y - p[lo].y) - (p[i].y - p[lo].y) * (p[hi].x - p[lo].x)) / sqrt(pow(p[hi].x - p[lo].x, 2) + pow(p[hi].y - p[lo].y, 2)) END"""
KEPT = f"""paths AS (SELECT subject_id, segment, list({{'x': lon, 'y': lat}} ORDER BY unix_s, event_id) AS p, CASE WHEN sum(m) < 500 THEN 0.05 ELSE 0.1 END AS tolerance FROM inner_ GROUP BY ALL HAVING count(*) >= 2),
kept AS (SELECT *, CAST(1 AS BIGINT) AS lo, CAST(len(p) AS BIGINT) AS hi FROM paths
  UNION ALL SELECT subject_id, segment, p, tolerance, CASE WHEN part = 0 THEN lo ELSE -best.k END, CASE WHEN part = 0 THEN -best.k ELSE hi END
  FROM (SELECT *, unnest([0, 1]) AS part FROM (SELECT *, list_sort([{{'d': {AWAY}, 'k': -i}} for i in range(lo, hi + 1)], 'DESC')[1] AS best FROM kept WHERE hi - lo >= 2) WHERE best.d > tolerance))"""


def crosses(a: str, b: str) -> str:
    """Whether two steps cross properly, by the sides on which their ends lie."""
    side = lambda p, q, n: f"(({p}.x2 - {p}.x1) * ({q}.y{n} - {p}.y1) - ({p}.y2 - {p}.y1) * ({q}.x{n} - {p}.x1))"
    return f"{side(a, b, 1)} * {side(a, b, 2)} < 0 AND {side(b, a, 1)} * {side(b, a, 2)} < 0"


HALVES = "CASE WHEN lon >= -113.0 AND lon < -112.5 AND lat >= 47.0 AND lat < 47.25 THEN CASE WHEN lat - 47.0 < (lon + 113.0) / 2 THEN 'low' ELSE 'high' END END"


def ticked(minutes: int) -> str:
    """The average by a clock of an hour, tick by tick."""
    alpha = f"(1 - exp(-{HOUR} / 60.0 / {minutes}))"
    return f"round(list_reduce(rates, lambda a, x: a + {alpha} * (x - a)) * {DAY}, 6) AS rate_{minutes}m"


BOX_ROWS = ", ".join(f"('{d}', '{k}', {a}, {b}, {c}, {e})" for d, k, a, b, c, e in BOXES)
FROM_MAX = lambda low: f"CASE WHEN speed > {C.DRIVING_TOP} THEN 'Fly' WHEN speed > {C.CYCLING_MAX} THEN 'Automotive' WHEN speed > {(C.RUNNING_MEAN + C.RUNNING_MAX) / 2} THEN 'Bike' WHEN speed > {C.WALKING_MAX} THEN 'Running' {low} ELSE 'Walking' END"
QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
ALIAS = "CASE " + " ".join(f"WHEN regexp_matches(name, {QUOTED(p)}) THEN '{a}'" for a, p in names.ALIASES) + " ELSE name END"
WINDOWED = ", ".join(f"CAST(sum(CASE WHEN {NAME} = '{a}' THEN time_offset ELSE 0 END) OVER w AS BIGINT) AS am_{a.lower()}" for a in TALLY_ORDER)
CANYON = SPARSE.canyon_distance_m

WHOLE_PARTS = f"""SELECT subject_id, 'quarantined' AS made, count(*) * 2 AS n, CAST(NULL AS DOUBLE) AS total FROM base JOIN judged USING (event_id) WHERE invalid_reason IS NOT NULL GROUP BY 1
  UNION ALL SELECT subject_id, 'stored', count(*), sum(accuracy) FROM tracks GROUP BY 1
  UNION ALL SELECT subject_id, 'snaps', count(*), NULL FROM tracks WHERE event_id % 10 = 0 GROUP BY 1
  UNION ALL SELECT subject_id, 'improved', count(*), CAST(sum(time_offset) AS DOUBLE) FROM better GROUP BY 1
  UNION ALL SELECT subject_id, 'moves', count(*), sum(distance_traversed_m) FROM made WHERE distance_traversed_m >= 100 AND NOT ({trunc('calc_mean', 2)} > 10 * {trunc('speed_mean', 2)}) GROUP BY 1
  UNION ALL SELECT subject_id, 'stays', count(*), CAST(sum(long_s) AS DOUBLE) FROM (SELECT subject_id, max(unix_s) - min(unix_s) AS long_s FROM walk GROUP BY subject_id, stay HAVING count(*) >= 2 AND max(unix_s) - min(unix_s) > 120) GROUP BY 1
  UNION ALL SELECT subject_id, 's2', count(*), CAST(sum(visit_count) AS DOUBLE) FROM ({accumulated("celled", "subject_id, level, cell_key", HOUR)}) GROUP BY 1
  UNION ALL SELECT subject_id, 'areas', count(*), CAST(sum(visit_count) AS DOUBLE) FROM ({accumulated("placed", "subject_id, dataset, area_key", DAY)}) GROUP BY 1
  UNION ALL SELECT subject_id, 'subjects', count(*), CAST(sum(total_offset_s) AS DOUBLE) FROM ({accumulated("better", "subject_id", 0)}) GROUP BY 1"""
#: The whole ingest order: what is stored takes the place of tracks, and each step reads the one before.
WHOLE = f"WITH RECURSIVE base AS ({DUCK}), " + ", ".join([
    RAW.replace("FROM tracks", "FROM base"),
    f"tracks AS (SELECT * REPLACE ({trunc('accuracy', 0)} AS accuracy) FROM base WHERE event_id IN (SELECT event_id FROM judged WHERE invalid_reason IS NULL))",
    TIMED, "cleaned AS (SELECT * FROM timed WHERE accuracy > 0 AND accuracy < 100 AND speed < 343 AND elevation > -330 AND elevation < 12801.6)", teleports("cleaned"),
    "kept AS (SELECT c.* FROM cleaned c JOIN tele_walk w ON w.subject_id = c.subject_id AND w.event_id = c.event_id AND w.kept)", improved("kept"),
    ACTIVE.replace("FROM timed", "FROM better"), IDLE.replace("FROM timed", "FROM better"), MOVES, STAYS, celled("better", ALL_LEVELS, GROUNDED),
    f"placed AS (SELECT * FROM better JOIN (VALUES {BOX_ROWS}) b(dataset, area_key, x1, x2, y1, y2) ON lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2 WHERE {GROUNDED})",
]) + " " + WHOLE_PARTS

ORACLES = {
    "subject_last_index": on_tracks(accumulated("timed", "subject_id", 0)),
    "time_offset": on_tracks("SELECT event_id, subject_id, unix_s, time_offset FROM timed"),
    "validate_split": on_tracks("SELECT * FROM judged", RAW),
    "invalid_reasons": on_tracks("SELECT invalid_reason, count(*) AS n FROM judged WHERE invalid_reason IS NOT NULL GROUP BY 1", RAW),
    "dedupe_tracks": on_tracks("SELECT subject_id, count(*) AS n FROM (SELECT * FROM tracks UNION SELECT * FROM tracks) GROUP BY 1"),
    "sanitize_truncate": on_tracks(f"SELECT event_id, {trunc('accuracy', 0)} AS accuracy, {trunc('speed', 3)} AS speed, {trunc('elevation / 7', 2)} AS elevation, {trunc('heading', 1)} AS heading FROM tracks"),
    "alias_names": f"""WITH n AS (SELECT unnest([{", ".join(map(QUOTED, SAMPLE_NAMES))}]) AS name UNION ALL SELECT c_name FROM customer), a AS (SELECT name, {ALIAS} AS alias FROM n)
        SELECT name, alias, CASE WHEN alias = '' THEN '_' ELSE translate(alias, {QUOTED(names.ILLEGAL)}, '{"_" * len(names.ILLEGAL)}') END AS subject_id FROM a""",
    "clean_stateless": on_tracks("SELECT event_id, subject_id, accuracy, round(speed, 6) AS speed, elevation FROM tracks WHERE accuracy > 0 AND accuracy < 100 AND speed < 343 AND elevation > -330 AND elevation < 12801.6"),
    "grounded": on_tracks("SELECT event_id, subject_id, activity FROM tracks WHERE lower(activity) NOT LIKE 'fly%' AND speed <= 67.06 AND elevation < 8848"),
    "whitelist_semi": on_tracks("SELECT event_id, subject_id FROM tracks WHERE subject_id IN (SELECT 'u' || c_custkey FROM customer WHERE c_acctbal > 0)"),
    "unseen_anti": on_tracks(f"SELECT event_id, format('{{}}_{{}}_{{:010d}}', subject_id, device_id, unix_s) AS snap_key FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM tracks s WHERE s.unix_s < {SPLIT} AND s.subject_id = t.subject_id AND s.device_id = t.device_id AND s.unix_s = t.unix_s)"),
    "activity_from_string": on_tracks(f"""SELECT event_id, CASE {" ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in NAME_PATTERNS)} ELSE 'Unknown' END AS inferred, code
        FROM (SELECT event_id, {sql_code("activity")} AS code, concat_ws(' ', 'is', lower(activity), CASE WHEN event_id % 5 = 0 THEN 'cycling' WHEN event_id % 7 = 0 THEN 'still' END) AS x FROM tracks)"""),
    "infer_speed_max": on_tracks(f"SELECT event_id, {FROM_MAX(f'''WHEN speed < {C.WALKING_MIN} THEN 'Stationary' ''')} AS inferred, {FROM_MAX('')} AS inferred_active FROM tracks"),
    "infer_speed_closest": on_tracks(f"""SELECT event_id, CASE WHEN gap < 100 THEN name ELSE 'Stationary' END AS inferred FROM (SELECT event_id, name, abs(speed * 4 - mean) AS gap,
        row_number() OVER (PARTITION BY event_id ORDER BY abs(speed * 4 - mean), k) AS r FROM tracks, (VALUES {", ".join(f"({k}, '{n}', {m})" for k, (n, m) in enumerate(MEAN_SPEEDS))}) v(k, name, mean)) WHERE r = 1"""),
    "reasonable_activity": on_tracks("SELECT event_id, CASE activity WHEN 'Stationary' THEN speed < 0.23 WHEN 'Walking' THEN speed > 0 AND speed < 1.78 WHEN 'Running' THEN speed >= 1.2 AND speed < 5.56 WHEN 'Bike' THEN speed >= 1.2 AND speed < 25.29 WHEN 'Automotive' THEN speed >= 0.23 AND speed < 44.7 WHEN 'Fly' THEN speed >= 44.7 ELSE true END AS reasonable FROM tracks"),
    "acceleration": on_tracks(f"SELECT event_id, round(CASE WHEN time_offset <> 0 THEN (greatest(speed, 0) - greatest(coalesce(lag(speed) OVER ({ORDERED}), 0), 0)) / time_offset END, 6) + 0.0 AS acceleration FROM timed"),
    "mode_tracker_window": on_tracks(f"SELECT event_id, {WINDOWED} FROM timed WINDOW w AS (PARTITION BY subject_id ORDER BY unix_s RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)"),
    "sliding_sums": on_tracks(f"""SELECT event_id, round(sum(m) OVER w, 4) + 0.0 AS sum_metres, round(sum(c) OVER w, 4) + 0.0 AS sum_change, round(sum(t) OVER w, 4) + 0.0 AS sum_turn
        FROM (SELECT *, CASE WHEN speed >= 0 THEN speed * time_offset ELSE 0 END AS m, CASE WHEN speed >= 0 AND ps >= 0 THEN speed - ps ELSE 0 END AS c, CASE WHEN heading >= 0 AND ph >= 0 THEN least(abs(heading - ph), 360 - abs(heading - ph)) ELSE 0 END AS t
          FROM (SELECT *, lag(speed) OVER ({ORDERED}) AS ps, lag(heading) OVER ({ORDERED}) AS ph FROM timed)) WINDOW w AS (PARTITION BY subject_id ORDER BY unix_s RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)"""),
    "top2_modes": on_tracks(f"""SELECT event_id, r[1].a AS mode1, CAST(-r[1].w AS BIGINT) AS weight1, r[2].a AS mode2, CAST(-r[2].w AS BIGINT) AS weight2 FROM (SELECT event_id,
        list_sort([{", ".join("{'w': -am_" + a.lower() + f", 'k': {k - 1}, 'a': '{a}'" + "}" for k, a in enumerate(TALLY_ORDER))}]) AS r
        FROM (SELECT event_id, {WINDOWED} FROM timed WINDOW w AS (PARTITION BY subject_id ORDER BY unix_s RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)))"""),
    "urban_canyon": on_tracks(f"""SELECT event_id, subject_id FROM (SELECT *, count(*) OVER c AS n, max(unix_s) OVER c - min(unix_s) OVER c AS span,
        {metres("lon", "lat", "avg(lon) OVER b", "avg(lat) OVER b")} AS mb, {metres("lon", "lat", "avg(lon) OVER a", "avg(lat) OVER a")} AS ma FROM tracks
        WINDOW c AS ({ORDERED} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), b AS ({ORDERED} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS ({ORDERED} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
        WHERE NOT (n = 11 AND span <= {SPARSE.canyon_window_s} AND coalesce(mb, 0) > greatest({CANYON}, 10 * speed) AND coalesce(ma, 0) > greatest({CANYON}, 10 * speed))"""),
    "unbacktrack": on_tracks(f"""SELECT event_id, subject_id, device_id FROM (SELECT *, min(counts) OVER p AS lo, max(counts) OVER p AS hi FROM (SELECT t.*, coalesce(t.unix_s > k.first_s AND t.unix_s < k.last_s, false) AS inside,
          CASE WHEN NOT coalesce(t.unix_s > k.first_s AND t.unix_s < k.last_s, false) OR row_number() OVER (PARTITION BY t.subject_id, t.device_id ORDER BY t.event_id) = 1 THEN t.unix_s END AS counts
          FROM tracks t LEFT JOIN known k USING (subject_id, device_id)) WINDOW p AS (PARTITION BY subject_id, device_id ORDER BY event_id {LAST}))
        WHERE NOT inside AND NOT coalesce(unix_s > lo AND unix_s < hi, false)""", f"known AS (SELECT subject_id, device_id, min(unix_s) AS first_s, max(unix_s) AS last_s FROM tracks WHERE unix_s < {SPLIT} GROUP BY ALL)"),
    "device_windows": on_tracks("SELECT subject_id, device_id, min(unix_s) AS first_s, max(unix_s) AS last_s FROM tracks GROUP BY ALL"),
    "visit_sessions": on_tracks(f"SELECT subject_id, device_id, count, visit_count FROM ({accumulated('timed', 'subject_id, device_id', 6 * HOUR)})"),
    "session_window_visits": on_tracks(f"""SELECT subject_id, min(unix_s) AS start_s, max(unix_s) AS end_s, count(*) AS n FROM (SELECT *, sum(new) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS g FROM
        (SELECT *, CASE WHEN unix_s - lag(unix_s) OVER ({ORDERED}) <= {6 * HOUR} THEN 0 ELSE 1 END AS new FROM tracks)) GROUP BY subject_id, g"""),
    "grid_cells": on_tracks(accumulated("gridded", "subject_id, level, cell_key", HOUR), """gridded AS (SELECT t.*, CAST(level AS INTEGER) AS level, CAST(CAST(floor(floor(lat * 100) / (100 // n)) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(floor(lon * 100) / (100 // n)) AS BIGINT) AS VARCHAR) AS cell_key
        FROM timed t, (VALUES (0, 1), (1, 10), (2, 100)) v(level, n) WHERE lower(activity) NOT LIKE 'fly%' AND speed <= 67.06 AND elevation < 8848)"""),
    "admin_polygons": on_tracks("SELECT CASE WHEN lat - 47.0 < (lon + 113.0) / 2 THEN 'low' ELSE 'high' END AS area_key, count(*) AS n FROM tracks WHERE lon >= -113.0 AND lon < -112.5 AND lat >= 47.0 AND lat < 47.25 GROUP BY 1"),
    "admin_index_boxes": on_tracks(accumulated("placed", "subject_id, dataset, area_key", DAY), f"""placed AS (SELECT * FROM timed JOIN (VALUES {BOX_ROWS}) b(dataset, area_key, x1, x2, y1, y2) ON lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2
        WHERE lower(activity) NOT LIKE 'fly%' AND speed <= 67.06 AND elevation < 8848)"""),
    "admin_hierarchy": """WITH p AS (SELECT c_acctbal, upper(substr(r_name, 1, 3)) AS c3, n_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        k AS (SELECT c_acctbal, 'countries' AS dataset, c3 AS area_key FROM p UNION ALL SELECT c_acctbal, 'provinces', c3 || '-' || n_name FROM p UNION ALL SELECT c_acctbal, 'cities', c3 || '-' || n_name || '-' || city FROM p WHERE city <> '')
        SELECT dataset, area_key, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM k GROUP BY ALL""",
    "act_split": on_tracks(f"SELECT event_id, CASE WHEN {sql_code('activity')} > 0 THEN 'move' ELSE 'stay' END AS route FROM tracks"),
    "moves_segments": on_tracks("SELECT event_id, subject_id, segment FROM seg", ACTIVE, MOVES),
    "moves_stats": on_tracks(f"""SELECT subject_id, segment, raw_point_count, start_s, end_s, duration_s, accuracy_mean, accuracy_median, speed_reported_min, speed_reported_max, elevation_min, elevation_max, distance_traversed_m,
        round({metres("lon1", "lat1", "lon2", "lat2")}) AS distance_absolute_m, elevation_gain_m, elevation_loss_m FROM made""", ACTIVE, MOVES),
    "move_rates": on_tracks(f"""SELECT t.subject_id, t.segment, round(turned / total, 4) AS bearing_delta_rate, round(coalesce(crossed, 0) / total, 4) AS self_crossing_rate
        FROM (SELECT subject_id, segment, sum(m) AS total, coalesce(sum(abs(pb - b) * (pm + m)), 0) AS turned FROM turns GROUP BY ALL) t
        LEFT JOIN (SELECT a.subject_id, a.segment, sum(a.m + b.m) AS crossed FROM turns a JOIN turns b ON a.subject_id = b.subject_id AND a.segment = b.segment AND a.k < b.k
          WHERE {crosses("a", "b")} GROUP BY ALL) c ON c.subject_id = t.subject_id AND c.segment = t.segment WHERE total > 0""", ACTIVE, MOVES, TURNS),
    "simplified_points": on_tracks("""SELECT subject_id, segment, len(p) AS raw_point_count, row_number() OVER (PARTITION BY subject_id, segment ORDER BY i) - 1 AS position, round(p[i].x, 9) AS lon, round(p[i].y, 9) AS lat
        FROM (SELECT DISTINCT subject_id, segment, p, unnest([lo, hi]) AS i FROM kept)""", ACTIVE, MOVES, KEPT),
    "moves_speeds": on_tracks(f"""SELECT subject_id, segment, {", ".join(f"{trunc(f'{f}(m / s) FILTER (s > 0)', 2)} AS speed_calculated_{n}" for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")))},
        {trunc("avg(speed)", 2)} AS speed_reported_mean, {trunc("median(speed)", 2)} AS speed_reported_median, {trunc("avg(round(elevation))", 0)} AS elevation_mean, {trunc("median(round(elevation))", 0)} AS elevation_median
        FROM inner_ GROUP BY subject_id, segment HAVING count(*) >= 2""", ACTIVE, MOVES),
    "moves_filtered": on_tracks(f"SELECT subject_id, segment, distance_traversed_m FROM made WHERE distance_traversed_m >= 100 AND NOT ({trunc('calc_mean', 2)} > 10 * {trunc('speed_mean', 2)})", ACTIVE, MOVES),
    "moves_activity": on_tracks(f"""SELECT subject_id, segment, CASE WHEN a.k > 0 AND b.k > 0 AND b.w < 0 AND -a.w < -b.w * 1.61 THEN
          CASE WHEN a.k <= 3 AND b.k <= 3 AND abs(a.k - b.k) < 2 THEN names[least(a.k, b.k) + 1] ELSE names[greatest(a.k, b.k) + 1] END
          WHEN lead IS NOT NULL THEN names[lead.k + 1] ELSE {FROM_MAX('').replace("speed", "speed_mean")} END AS activity,
        end_s = (SELECT max(unix_s) FROM active x WHERE x.subject_id = m.subject_id) AND NOT coalesce((SELECT max(unix_s) FROM idle i WHERE i.subject_id = m.subject_id) - end_s > {SPARSE.move_gap_s}, false) AS is_open
        FROM (SELECT *, r[1] AS a, r[2] AS b, list_filter(r, lambda x: x.k > 0 AND x.w < 0)[1] AS lead, {list(ACTIVITIES)} AS names FROM (SELECT *, {RANKED} AS r FROM made)) m""", ACTIVE, IDLE, MOVES),
    "stays_stats": on_tracks(f"""SELECT subject_id, min(unix_s) AS start_s, max(unix_s) AS end_s, max(unix_s) - min(unix_s) AS duration_s, count(*) AS raw_point_count,
          {trunc("avg(accuracy)", 0)} AS accuracy_mean, {trunc("median(accuracy)", 0)} AS accuracy_median, {trunc("min(elevation)", 0)} AS elevation_min, {trunc("max(elevation)", 0)} AS elevation_max, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat
        FROM walk GROUP BY subject_id, stay HAVING count(*) >= 2 AND max(unix_s) - min(unix_s) > 120""", IDLE, STAYS),
    "stays_extent": on_tracks(f"""SELECT * EXCLUDE (n, stay), end_s = max(end_s) OVER (PARTITION BY subject_id) AS is_open FROM (SELECT subject_id, min(unix_s) AS start_s, max(unix_s) AS end_s,
          {trunc("CAST(6371000.0 AS DOUBLE) * 6371000.0 * radians(max(lon) - min(lon)) * (sin(radians(max(lat))) - sin(radians(min(lat))))", 0)} AS area_m2,
          {trunc("min(accuracy)", 0)} AS accuracy_min, {trunc("max(accuracy)", 0)} AS accuracy_max, {trunc("avg(elevation)", 0)} AS elevation_mean, {trunc("median(elevation)", 0)} AS elevation_median, count(*) AS n, stay
        FROM walk GROUP BY subject_id, stay) QUALIFY n >= 2""", IDLE, STAYS),
    "teleport_filter": on_tracks("SELECT event_id, subject_id FROM tele_walk WHERE kept", teleports("timed")),
    "ewma_speed": on_tracks(f"SELECT subject_id, round(list_reduce(list(speed ORDER BY unix_s, event_id), lambda a, x: a + CAST({ewma_alpha(1.0)!r} AS DOUBLE) * (x - a)), 6) AS rate FROM tracks GROUP BY 1"),
    "monthly_store_counts": on_tracks("SELECT subject_id, ym, count(*) AS n FROM (SELECT subject_id, strftime(to_timestamp(unix_s) AT TIME ZONE 'UTC', '%Y-%m') AS ym FROM tracks UNION ALL SELECT 'o' || o_orderstatus, strftime(o_orderdate, '%Y-%m') FROM orders) GROUP BY ALL"),
    "last_push": on_tracks("SELECT event_id, subject_id, received_at FROM (SELECT *, max(received_at) OVER (PARTITION BY subject_id) AS newest FROM (SELECT *, unix_s // 86400 * 86400 AS received_at FROM tracks)) WHERE received_at = newest"),
    "freshest_per_subject": on_tracks("SELECT subject_id, event_id, unix_s, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY unix_s DESC, event_id DESC) AS r FROM tracks) WHERE r = 1"),
    "push_limit": on_tracks(f"SELECT event_id, subject_id FROM (SELECT *, row_number() OVER ({ORDERED}) AS r FROM tracks) WHERE r <= 10"),
    "union_sources": on_tracks("SELECT event_id, subject_id, activity FROM tracks WHERE activity IN ('Bike', 'Fly') UNION ALL SELECT event_id, subject_id, activity FROM tracks WHERE activity = 'Bike'"),
    "notes_json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events",
    "feature_collection_explode": on_tracks("SELECT event_id, subject_id, device_id, unix_s, round(speed, 6) AS speed, round(lon, 6) AS lon, round(lat, 6) AS lat FROM tracks"),
    "metrics_export": on_tracks(f"SELECT 'points' AS measurement, subject_id, device_id, {NAME} AS activity, unix_s AS time_s, round(lon, 6) AS lon, round(lat, 6) AS lat, accuracy, round(speed, 6) AS speed, heading, elevation, CAST(CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS INTEGER) AS battery_state FROM tracks"),
    "tile_accumulate": on_tracks("""SELECT CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS tile_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793) / 2 * 4096) AS BIGINT) AS tile_y,
        count(*) AS point_count, max(speed) AS max_speed, max(elevation) AS max_elevation, CAST(sum(time_offset) AS BIGINT) AS sum_offset, round(avg(accuracy), 6) AS mean_accuracy FROM timed GROUP BY 1, 2"""),
    "merge_index": on_tracks(accumulated("timed", "subject_id", 6 * HOUR)),
    "continuous_rows": on_tracks(f"SELECT event_id, coalesce(lag(device_id) OVER ({ORDERED}) = device_id, false) AS continuous FROM tracks"),
    "ring_window": on_tracks(f"SELECT event_id, first(event_id) OVER w AS head, count(*) OVER w AS n, round(avg(speed) OVER w, 6) AS mean_speed FROM tracks WINDOW w AS ({ORDERED} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"),
    "sorted_tracks": on_tracks("SELECT event_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY device_id, unix_s, accuracy, event_id) AS INTEGER) AS place FROM tracks"),
    "snap_keys": on_tracks("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'k' || event_id ELSE format('{}_{}_{:010d}', subject_id, device_id, unix_s) END AS snap_key, CASE WHEN event_id % 6 = 0 THEN 'bucket' ELSE '' END AS bucket FROM tracks WHERE event_id % 4 = 0 OR event_id % 6 = 0"),
    "windowed_activity": on_tracks(f"SELECT event_id, subject_id, {[*ACTIVITIES, 'Unknown']}[CASE WHEN act < 0 THEN 7 ELSE act + 1 END] AS activity FROM ow_walk WHERE r > 0", "cleaned AS (SELECT * FROM timed WHERE accuracy > 0 AND accuracy < 100 AND speed < 343 AND elevation > -330 AND elevation < 12801.6)", improved_by_windows("cleaned")),
    "improved_activity": on_tracks("SELECT event_id, subject_id, activity, round(acceleration, 6) AS acceleration FROM better", "cleaned AS (SELECT * FROM timed WHERE accuracy > 0 AND accuracy < 100 AND speed < 343 AND elevation > -330 AND elevation < 12801.6)", improved("cleaned")),
    "full_pipeline": WHOLE,
    "s2_cells": on_tracks(accumulated("celled", "subject_id, level, cell_key", HOUR), celled("timed", ALL_LEVELS, GROUNDED)),
    "s2_cells_from_pushes": on_tracks(accumulated("celled", "subject_id, level, cell_key", HOUR), celled("timed", ALL_LEVELS, GROUNDED)),
    "s2_rollup_check": on_tracks("""SELECT d.cell_key, d.n AS n_direct, r.n AS n_rolled FROM (SELECT cell_key, count(*) AS n FROM celled WHERE level = 10 GROUP BY 1) d
        FULL JOIN (SELECT a.cell_key, count(*) AS n FROM celled a JOIN celled b USING (event_id) WHERE a.level = 10 AND b.level = 17 GROUP BY 1) r USING (cell_key)""", celled("timed", "[10, 17]")),
    "s2_polygons": on_tracks("""SELECT cell_key, corner, round(degrees(atan2(y, x)), 9) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 9) AS lat FROM (SELECT cell_key, corner,
          CASE face WHEN 0 THEN 1 WHEN 1 THEN -u WHEN 2 THEN -u WHEN 3 THEN -1 ELSE v END AS x, CASE face WHEN 0 THEN u WHEN 1 THEN 1 WHEN 4 THEN -1 WHEN 5 THEN u ELSE -v END AS y, CASE face WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN 1 WHEN 5 THEN -1 ELSE -u END AS z
        FROM (SELECT DISTINCT cell_key, corner, face, CASE WHEN s >= 0.5 THEN (4 * s * s - 1) / 3 ELSE (1 - 4 * (1 - s) * (1 - s)) / 3 END AS u, CASE WHEN t >= 0.5 THEN (4 * t * t - 1) / 3 ELSE (1 - 4 * (1 - t) * (1 - t)) / 3 END AS v
          FROM (SELECT cell_key, face, CAST(c.corner AS INTEGER) AS corner, ((si >> 17) + di) / 8192.0::DOUBLE AS s, ((sj >> 17) + dj) / 8192.0::DOUBLE AS t
            FROM celled JOIN s2ij USING (event_id), (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(corner, di, dj))))""", celled("timed", "[13]")),
    "level_dump": on_tracks("SELECT * FROM (" + accumulated("celled", "subject_id, level, cell_key", HOUR) + ")", celled("timed", "[8]", "subject_id = 'u7'")),
    "ingest_messages": on_tracks(f"SELECT {FAULTS} AS reason, count(*) AS n FROM tracks GROUP BY 1"),
    "ingest_points": on_tracks(f"SELECT subject_id, device_id, unix_s, round(lon, 6) AS lon, round(lat, 6) AS lat, {trunc('accuracy', 0)} AS accuracy, CAST(7 AS BIGINT) AS received_at FROM tracks WHERE {FAULTS} = 'valid'"),
    "snap_images": on_tracks("""SELECT event_id, k AS snap_key, 'bucket/' || k AS img_s3, CASE WHEN event_id % 5 <> 0 THEN 'FFD8FF' || hex(subject_id) END AS image
        FROM (SELECT *, format('{}_{}_{:010d}', subject_id, device_id, unix_s) AS k FROM tracks WHERE event_id % 4 = 0)"""),
    "gyro_presence": on_tracks("""SELECT event_id, round(g, 9) AS gyro_sum, g < 0.01 AS still FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0
        THEN abs((event_id % 13 - 6) / 5000.0::DOUBLE) + abs((event_id % 13 - 6) / 7000.0::DOUBLE) + abs((event_id % 13 - 6) / 11000.0::DOUBLE) END AS g FROM tracks)"""),
    "level_registry": on_tracks("""SELECT CAST(n AS INTEGER) AS level, CAST(event_id % n AS VARCHAR) AS cell_key, CASE WHEN n <> 2 THEN count(*) END AS count, CASE WHEN n <> 2 THEN max(unix_s) END AS last_s, CASE WHEN n = 2 THEN round(max(speed), 6) END AS fastest
        FROM tracks, (VALUES (100), (10), (2)) v(n) GROUP BY n, event_id % n"""),
    "ingest_meters": on_tracks(f"""SELECT subject_id, CAST(list_sum(counts) AS BIGINT) AS count, round(list_sum(counts) / (len(counts) * {HOUR}.0) * {DAY}, 6) AS mean_rate, {ticked(60)}, {ticked(300)}, {ticked(900)}
        FROM (SELECT subject_id, counts, [x / {HOUR}.0::DOUBLE for x in counts] AS rates FROM (SELECT subject_id, list(coalesce(n, 0) ORDER BY tick) AS counts FROM (SELECT subject_id, unnest(generate_series(first, last)) AS tick FROM
          (SELECT subject_id, min(unix_s) // {HOUR} AS first, (SELECT max(unix_s) + {HOUR} FROM tracks) // {HOUR} AS last FROM tracks GROUP BY 1)) LEFT JOIN (SELECT subject_id, unix_s // {HOUR} AS tick, count(*) AS n FROM tracks GROUP BY ALL) USING (subject_id, tick) GROUP BY 1))"""),
    "last_known_points": on_tracks(f"""SELECT a.subject_id, count, visit_count, first_s, last_s, activity_mode, t.event_id, round(t.lon, 6) AS lon, round(t.lat, 6) AS lat FROM ({accumulated("timed", "subject_id", 0)}) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY unix_s DESC, event_id DESC) AS r FROM tracks) t ON t.subject_id = a.subject_id AND r = 1"""),
    "areas_dump": on_tracks(accumulated("placed", "subject_id, dataset, area_key", DAY), f"""placed AS (SELECT * FROM timed JOIN (VALUES {BOX_ROWS}) b(dataset, area_key, x1, x2, y1, y2) ON lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2
        WHERE subject_id = 'u7' AND dataset = 'counties')"""),
    "area_geometry": on_tracks(f"SELECT event_id, {HALVES} AS area_key, CASE WHEN {HALVES} IS NOT NULL THEN CAST(3 AS INTEGER) END AS corners FROM tracks"),
}
