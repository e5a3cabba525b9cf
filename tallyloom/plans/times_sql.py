"""SQL that reads times in mixed spellings: what p1's operator is compared with."""

from __future__ import annotations

_C = "([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?"
_T = r"( ?(?:[-+][0-9]{1,2}(?::?[0-9]{2})?(?:\[[^\]]*\])?|[A-Za-z/_+\-0-9]*[A-Za-z][A-Za-z/_+\-0-9:]*|\[[^\]]*\]))?"
#: Each spelling of a date and time: its pattern, and the fields in the order of its groups.
SPELLINGS = [
    (rf"([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:(?:T| ){_C}{_T})?", "y m d h i s f tail"),
    (rf"([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})T([0-9]{{2}})([0-9]{{2}})(?:([0-9]{{2}})(?:[.,]([0-9]+))?)?{_T}", "y m d h i s f tail"),
    (rf"([0-9]{{4}})-([0-9]{{3}})(?:T{_C}{_T})?", "y j h i s f tail"),
    (rf"([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}})(?: (?:(上午|下午) ?)?{_C}{_T})?", "y m d p h i s f tail"),
    (rf"(?:[A-Za-z]{{3,9}}, ?)?([0-9]{{1,2}})[ -]([A-Za-z]{{3,9}})[ -]([0-9]{{4}})(?: {_C}{_T})?", "d b y h i s f tail"),
    (rf"([A-Za-z]{{3,9}}) ([0-9]{{1,2}}), ([0-9]{{4}})(?:,? {_C}(?: (AM|PM|am|pm|Am|Pm))?{_T})?", "b d y h i s f p tail"),
    (rf"([0-9]{{4}})年([0-9]{{1,2}})月([0-9]{{1,2}})日(?: ?(?:(上午|下午) ?)?{_C}{_T})?", "y m d p h i s f tail"),
    (rf"([0-9]{{4}})年([0-9]{{1,2}})月([0-9]{{1,2}})日 ?(?:(上午|下午) ?)?([0-9]{{1,2}})时(?:([0-9]{{1,2}})分(?:([0-9]{{1,2}})秒)?)?{_T}", "y m d p h i s tail"),
]
_FIELDS = "y m d j b p h i s f tail".split()
_MONTHS = "january february march april may june july august september october november december".split()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _select(number: int, pattern: str, fields: str) -> str:
    names = fields.split()
    parts = ", ".join(f"g.{f} AS {f}" if f in names else f"'' AS {f}" for f in _FIELDS)
    groups = "[" + ", ".join(map(_quoted, names)) + "]"
    return f"SELECT {number} AS spelling, src, row_id, z, {parts} FROM (SELECT *, regexp_extract(v, {_quoted('^(?:' + pattern + ')$')}, {groups}) AS g FROM given WHERE regexp_full_match(v, {_quoted(pattern)}))"


_MONTH = "CASE " + " ".join(f"WHEN lower(b) IN ('{m[:3]}', '{m}'{', ' + repr('sept') if m == 'september' else ''}) THEN {i}" for i, m in enumerate(_MONTHS, 1)) + " ELSE 0 END"
_BLANKS = "chr(32) || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288)"


def _zone(column: str) -> str:
    """Offset in seconds, or null, of a text like ``UTC+8`` or ``-0330``."""
    pattern = r"^(?:utc|gmt)?\s*([+-])\s*([0-9]{1,2})(?::?([0-9]{2}))?$"
    sign, hours, minutes = (f"regexp_extract({column}, '{pattern}', {k})" for k in (1, 2, 3))
    value = f"(TRY_CAST({hours} AS INT) * 3600 + coalesce(TRY_CAST({minutes} AS INT), 0) * 60) * CASE WHEN {sign} = '-' THEN -1 ELSE 1 END"
    return f"CASE WHEN regexp_matches({column}, '{pattern}') AND TRY_CAST({hours} AS INT) <= 23 AND coalesce(TRY_CAST({minutes} AS INT), 0) <= 59 THEN {value} END"


def instants(given: str) -> str:
    """CTEs up to ``instant`` (src, row_id, utc_us, unit_us) for ``given``, a SELECT of src, row_id, v, z.

    Zone names are those with a slash, UTC and GMT; a local time counts if
    exactly one instant shows it on the zone's clocks.
    """
    union = " UNION ALL ".join(_select(k, p, f) for k, (p, f) in enumerate(SPELLINGS))
    unit = lambda u: f"n >= 1767225600::HUGEINT * {u} AND n < 1798761600::HUGEINT * {u}"
    return f"""stamped AS ({given}),
given AS (SELECT src, row_id, translate(trim(v, {_BLANKS}), '０１２３４５６７８９：／－，．＋−', '0123456789:/-,.+-') AS v, lower(translate(trim(z, {_BLANKS}), '０１２３４５６７８９：／－，．＋−', '0123456789:/-,.+-')) AS z FROM stamped),
numbers AS (SELECT src, row_id, CAST(split_part(v, '.', 1) AS HUGEINT) AS n, split_part(v, '.', 2) AS f, length(split_part(v, '.', 1)) AS digits FROM given WHERE regexp_full_match(v, '[0-9]{{10,19}}(\\.[0-9]+)?')),
counted AS (SELECT src, row_id, CASE WHEN {unit(1)} THEN n * 1000000 + TRY_CAST(left(f || '000000', 6) AS INT) WHEN {unit(1000)} THEN n * 1000 + TRY_CAST(left(f || '000', 3) AS INT) WHEN {unit(1000000)} THEN n WHEN {unit(1000000000)} THEN n // 1000 END AS utc_us,
  CAST(pow(10, greatest(0, 6 - length(f) - digits + 10)) AS BIGINT) AS unit_us FROM numbers),
spelt AS ({union}),
parts AS (SELECT *, CASE WHEN b <> '' THEN {_MONTH} WHEN j <> '' THEN 1 ELSE CAST(m AS INT) END AS mo, CASE WHEN j <> '' THEN 1 ELSE CAST(d AS INT) END AS da, CAST(y AS INT) AS ye,
  CASE WHEN h = '' THEN 0 WHEN p = '' THEN CAST(h AS INT) WHEN CAST(h AS INT) BETWEEN 1 AND 12 THEN CAST(h AS INT) % 12 + CASE WHEN lower(p) IN ('pm', '下午') THEN 12 ELSE 0 END ELSE 99 END AS ho,
  CASE WHEN i = '' THEN 0 ELSE CAST(i AS INT) END AS mi, CASE WHEN s = '' THEN 0 ELSE CAST(s AS INT) END AS se, CAST(left(f || '000000', 6) AS BIGINT) AS mu,
  CASE WHEN s <> '' THEN CAST(pow(10, greatest(0, 6 - length(f))) AS BIGINT) WHEN i <> '' THEN 60000000 WHEN h <> '' THEN 3600000000 ELSE 86400000000 END AS unit_us,
  lower(trim(regexp_extract(tail, '^([^\\[]*)', 1))) AS head, lower(regexp_extract(tail, '\\[([^\\]]*)', 1)) AS bracket FROM spelt),
dated AS (SELECT *, TRY(make_date(ye, mo, da)) + CASE WHEN j <> '' THEN CAST(j AS INT) - 1 ELSE 0 END AS day FROM parts WHERE ye >= 1 AND ho <= 23 AND mi <= 59 AND se <= 59 AND mo BETWEEN 1 AND 12 AND da BETWEEN 1 AND 31),
local AS (SELECT *, CAST(day AS TIMESTAMP) + to_hours(ho) + to_minutes(mi) + to_seconds(se) AS l FROM dated WHERE day IS NOT NULL AND year(day) = ye AND (j <> '' OR month(day) = mo)),
names AS (SELECT lower(name) AS key, min(name) AS name FROM pg_timezone_names() WHERE name LIKE '%/%' OR name IN ('UTC', 'GMT') GROUP BY 1 UNION ALL SELECT 'z', 'UTC'),
zoned AS (SELECT *, {_zone('head')} AS head_off, (SELECT name FROM names WHERE key = head) AS head_name, {_zone('bracket')} AS br_off, (SELECT name FROM names WHERE key = bracket) AS br_name, {_zone('z')} AS z_off, (SELECT name FROM names WHERE key = z) AS z_name FROM local),
chosen AS (SELECT src, row_id, l, mu, unit_us, CASE WHEN head_name IS NOT NULL OR head_off IS NOT NULL THEN head_off WHEN br_name IS NOT NULL OR br_off IS NOT NULL THEN br_off ELSE z_off END AS off,
  CASE WHEN head_name IS NOT NULL OR head_off IS NOT NULL THEN head_name WHEN br_name IS NOT NULL OR br_off IS NOT NULL THEN br_name ELSE z_name END AS zone
  FROM zoned WHERE head = '' OR head_name IS NOT NULL OR head_off IS NOT NULL OR (head LIKE '%/%' AND left(head, 1) NOT IN ('+', '-'))),
fixed AS (SELECT src, row_id, epoch_us(l) - CAST(off AS BIGINT) * 1000000 + mu AS utc_us, unit_us FROM chosen WHERE zone IS NULL AND off IS NOT NULL),
probes AS (SELECT src, row_id, l, mu, unit_us, zone, unnest([-86400000000, 86400000000]) AS near FROM chosen WHERE zone IS NOT NULL),
offsets AS (SELECT DISTINCT src, row_id, l, mu, unit_us, zone, epoch_us(timezone(zone, make_timestamptz(epoch_us(l) + near))) - epoch_us(l) - near AS o FROM probes),
shown AS (SELECT src, row_id, mu, unit_us, epoch_us(l) - o AS u FROM offsets WHERE timezone(zone, make_timestamptz(epoch_us(l) - o)) = l),
once AS (SELECT src, row_id, min(u) + min(mu) AS utc_us, min(unit_us) AS unit_us FROM shown GROUP BY 1, 2 HAVING count(*) = 1),
instant AS (SELECT src, row_id, CAST(utc_us AS BIGINT) AS utc_us, unit_us FROM counted WHERE utc_us IS NOT NULL UNION ALL SELECT src, row_id, CAST(utc_us AS BIGINT), unit_us FROM fixed UNION ALL SELECT src, row_id, CAST(utc_us AS BIGINT), unit_us FROM once)"""


GIVEN = "SELECT 'model_usage' AS src, row_id, started_at AS v, recorded_tz AS z FROM model_usage UNION ALL SELECT 'saved_query', row_id, since, tz FROM saved_query"
P1 = f"WITH {instants(GIVEN)} SELECT src, row_id, utc_us FROM instant"
