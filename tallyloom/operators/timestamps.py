"""Mixed spellings, precisions and zones of times to one UTC instant.

Every value is reduced to a mask of character classes (digit ``9``, letter
``a``, anything else itself).  A mask is matched against the grammar below
once; the match says at which offsets the fields stand, so that all values of
a mask are cut and converted together as one matrix of code points.  Local
times become instants through transition tables built on the driver from one
version of the tz database and sent to the tasks.
"""

from __future__ import annotations

import datetime as dt
import importlib.metadata
import os
import re
import zoneinfo
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.columns import fresh_name

#: Blanks around a value, and spellings folded before the mask is made.
BLANKS = " \t\r\n\u00a0\u3000"
FOLD_FROM = "０１２３４５６７８９：／－，．＋−"
FOLD_TO = "0123456789:/-,.+-"
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: English month names by their first three letters.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
MONTH_NAMES = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
#: Halves of the day.
HALVES = {"am": 0, "a.m.": 0, "上午": 0, "pm": 12, "p.m.": 12, "下午": 12}

#: Up to this year the tables hold every change; the years from it on are read as years before it with the same calendar.
HORIZON_YEAR = 2100
#: A bare number counts in the unit that puts it into this year.
NUMBER_YEAR = 2026
NO_ZONE = -1
NONE = np.iinfo(np.int64).min
#: Rows that a task converts at once.
BLOCK_ROWS = 65_536

_CLOCK = r"(?P<H>9{1,2})(?::(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?)?"
_CLOCK24 = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_TAIL = r"(?P<tail> ?(?:[-+]9{1,2}(?::?99)?(?:\[[^\]]*\])?|[a/_+\-9]*a[a/_+\-9:]*|\[[^\]]*\]))?"
#: The grammar over masks.  Groups: y year, m month, b month by name, d day, j day of the year, H M S clock,
#: f fraction, p half of the day, tail zone or offset, n number.
GRAMMAR = [
    re.compile(x)
    for x in (
        r"(?P<n>9{10,19})(?:\.(?P<f>9+))?",
        rf"(?P<y>9999)-(?P<m>99)-(?P<d>99)(?:(?:(?P<t>a)| ){_CLOCK24}{_TAIL})?",
        rf"(?P<y>9999)(?P<m>99)(?P<d>99)(?P<t>a)(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_TAIL}",
        rf"(?P<y>9999)-(?P<j>999)(?:(?P<t>a){_CLOCK24}{_TAIL})?",
        rf"(?P<y>9999)/(?P<m>9{{1,2}})/(?P<d>9{{1,2}})(?: (?P<p>上午|下午) ?{_CLOCK24}{_TAIL}| {_CLOCK24.replace('?P<H>', '?P<H2>').replace('?P<M>', '?P<M2>').replace('?P<S>', '?P<S2>').replace('?P<f>', '?P<f2>')}{_TAIL.replace('?P<tail>', '?P<tail2>')})?",
        rf"(?:(?P<w>a{{3,9}}), ?)?(?P<d>9{{1,2}})[ -](?P<b>a{{3,9}})[ -](?P<y>9999)(?: {_CLOCK24}{_TAIL})?",
        rf"(?P<b>a{{3,9}}) (?P<d>9{{1,2}}), (?P<y>9999)(?:,? {_CLOCK24}(?: (?P<p>aa))?{_TAIL})?",
        rf"(?P<y>9999)年(?P<m>9{{1,2}})月(?P<d>9{{1,2}})日(?: ?(?:(?P<p>上午|下午) ?)?{_CLOCK24}{_TAIL})?",
        rf"(?P<y>9999)年(?P<m>9{{1,2}})月(?P<d>9{{1,2}})日 ?(?:(?P<p>上午|下午) ?)?(?P<H>9{{1,2}})时(?:(?P<M>9{{1,2}})分(?:(?P<S>9{{1,2}})秒)?)?{_TAIL}",
    )
]


# --- zones -----------------------------------------------------------------


def tzdb_version() -> str:
    """The version of the tz database that the tables are built from."""
    for root in zoneinfo.TZPATH:
        path = os.path.join(root, "tzdata.zi")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                return file.readline().removeprefix("# version").strip()
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


def _written_transitions(name: str) -> list[int]:
    """The instants (epoch seconds) at which the zone's file states a change."""
    raw = None
    for root in zoneinfo.TZPATH:
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, "rb") as file:
                raw = file.read()
            break
    if raw is None:
        import importlib.resources

        package, _, leaf = name.rpartition("/")
        at = "tzdata.zoneinfo" + ("." + package.replace("/", ".") if package else "")
        raw = importlib.resources.files(at).joinpath(leaf).read_bytes()
    if raw[:4] != b"TZif" or raw[4:5] < b"2":
        return []
    counts = np.frombuffer(raw, ">i4", 6, 20)  # isutc, isstd, leap, time, type, char
    skip = 44 + counts[3] * 5 + counts[4] * 6 + counts[5] + counts[2] * 8 + counts[1] + counts[0]
    n = int(np.frombuffer(raw, ">i4", 6, int(skip) + 20)[3])
    return np.frombuffer(raw, ">i8", n, int(skip) + 44).tolist()


def _offset(zone: zoneinfo.ZoneInfo, at: int) -> int:
    moment = dt.datetime.fromtimestamp(at, dt.timezone.utc).astimezone(zone)
    return int(moment.utcoffset().total_seconds())


_YEAR_ONE = -62_135_510_400


@lru_cache(maxsize=None)
def _zone_table(name: str, until: int = HORIZON_YEAR) -> tuple[np.ndarray, np.ndarray]:
    """Change instants and the offsets before the first, and after each, change."""
    zone = zoneinfo.ZoneInfo(name)
    written = [t for t in _written_transitions(name) if t > _YEAR_ONE]
    low = min([0, *written]) - 1
    first = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    last = int(dt.datetime(until, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    at = max([first, *written]) + 1
    now, ruled, month = _offset(zone, at), [], 30 * 86_400
    if any(_offset(zone, at + k * month) != now for k in range(1, 13)):
        while at < last:
            then = _offset(zone, at + month)
            if then != now:
                a, b = at, at + month
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if _offset(zone, mid) == now else (a, mid)
                ruled.append(b)
                now = then
            at += month
    times, offsets = [], [_offset(zone, low)]
    for t in [*written, *ruled]:
        after = _offset(zone, t)
        if after != offsets[-1]:
            times.append(t)
            offsets.append(after)
    return np.array(times, np.int64), np.array(offsets, np.int64)


class Zones:
    """Zone names of one version of the tz database, with tables made on first use.

    ``tables`` is filled on the driver for every name that the data can hold,
    so tasks never read zone files of their own.
    """

    def __init__(self, names: list[str] | None = None):
        self.version = tzdb_version()
        known = sorted(names or (n for n in zoneinfo.available_timezones() if n not in ("localtime", "posixrules", "Factory")))
        self.by_name = {n.casefold(): i for i, n in enumerate(known)}
        self.tables = [_zone_table(n) for n in known]
        self.fixed: dict[int, int] = {}
        self._resolved: dict[str, int] = {}

    _SPELLING = re.compile(r"(?:utc|gmt)?\s*([+\-])\s*(\d{1,2})(?::?(\d{2}))?")

    def resolve(self, text: str | None) -> int:
        """The number of the zone that a text names, or ``NO_ZONE``."""
        if text is None:
            return NO_ZONE
        found = self._resolved.get(text)
        if found is None:
            found = self._resolve(text)
            if len(self._resolved) < 100_000:
                self._resolved[text] = found
        return found

    def _resolve(self, text: str) -> int:
        name = text.strip(BLANKS).casefold()
        if name == "z":
            name = "utc"
        if name in self.by_name:
            return self.by_name[name]
        match = self._SPELLING.fullmatch(name.translate(_FOLD))
        if not match:
            return NO_ZONE
        hours, minutes = int(match[2]), int(match[3] or 0)
        if hours > 23 or minutes > 59:
            return NO_ZONE
        seconds = (hours * 60 + minutes) * 60 * (-1 if match[1] == "-" else 1)
        if seconds not in self.fixed:
            self.fixed[seconds] = len(self.tables)
            self.tables.append((np.zeros(0, np.int64), np.array([seconds], np.int64)))
        return self.fixed[seconds]

    def to_utc(self, local: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Instants of local seconds, and which of them the zone's clocks showed exactly once."""
        out, good = np.zeros_like(local), np.zeros(len(local), bool)
        if len(local) and local.max() >= _HORIZON:
            # The rules that a zone's file states for ever depend on a year's calendar only.
            far = np.flatnonzero(local >= _HORIZON)
            shift = _same_calendar(local[far])
            near = local.copy()
            near[far] -= shift
            out, good = self.to_utc(near, zone)
            out[far] += shift
            return out, good
        for z in np.unique(zone):
            if z == NO_ZONE:
                continue
            at = np.flatnonzero(zone == z)
            times, offsets = self.tables[z]
            if len(times) == 0:
                out[at], good[at] = local[at] - offsets[0], True
                continue
            before, after = offsets[:-1], offsets[1:]
            begin, end = times + np.minimum(before, after), times + np.maximum(before, after)
            k = np.searchsorted(end, local[at], side="right")
            inside = (k < len(times)) & (local[at] >= begin[np.minimum(k, len(times) - 1)])
            out[at], good[at] = local[at] - offsets[k], ~inside
        return out, good


_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_HORIZON = int(dt.datetime(HORIZON_YEAR - 1, 1, 1, tzinfo=dt.timezone.utc).timestamp())


def _same_calendar(local: np.ndarray) -> np.ndarray:
    """Seconds from a year with the same calendar before the horizon to the year of each local time."""
    year = (local // 86_400).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970
    begin = lambda y: (np.asarray(y) - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
    kinds = lambda y: (begin(y) + 4) % 7 * 2 + (begin(np.asarray(y) + 1) - begin(y) == 366)
    known = np.arange(HORIZON_YEAR - 40, HORIZON_YEAR - 2)
    of_kind = np.zeros(14, np.int64)
    of_kind[kinds(known)] = known
    return (begin(year) - begin(of_kind[kinds(year)])) * 86_400


@lru_cache(maxsize=1)
def all_zones() -> Zones:
    return Zones()


# --- parsers ---------------------------------------------------------------


class MaskParser:
    """The field offsets of one mask."""

    def __init__(self, spans: dict[str, tuple[int, int]]):
        self.spans = spans

    @property
    def unit(self) -> int:
        """Microseconds of the finest part that the mask writes, 1 at least."""
        digits = 0 if "f" not in self.spans else self.spans["f"][1] - self.spans["f"][0]
        if "n" in self.spans:
            a, b = self.spans["n"]
            digits += b - a - 10  # ten digits are the seconds of 2026
        elif "S" not in self.spans:
            return 60_000_000 if "M" in self.spans else 3_600_000_000 if "H" in self.spans else 86_400_000_000
        return 10 ** max(0, 6 - digits)

    def number(self, codes: np.ndarray, field: str, default: int = 0) -> np.ndarray:
        if field not in self.spans:
            return np.full(len(codes), default, np.int64)
        a, b = self.spans[field]
        return _digits(codes[:, a:b])

    def texts(self, codes: np.ndarray, field: str) -> np.ndarray:
        a, b = self.spans[field]
        return np.ascontiguousarray(codes[:, a:b]).view(f"U{b - a}").ravel()

    def parse(self, codes: np.ndarray, row_zone: np.ndarray, zones: Zones, number_year: int = NUMBER_YEAR) -> tuple[np.ndarray, np.ndarray]:
        """Microseconds since 1970 and which rows denote one instant."""
        if "n" in self.spans:
            return self._number(codes, number_year)
        n, good = len(codes), np.ones(len(codes), bool)
        year, day = self.number(codes, "y"), self.number(codes, "d", 1)
        if "j" in self.spans:
            ordinal = self.number(codes, "j")
            leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
            good &= (year >= 1) & (ordinal >= 1) & (ordinal <= 365 + leap)
            days = _days(np.where(good, year, 2000), np.ones(n, np.int64)) + ordinal - 1
        else:
            month = self._month(codes)
            good &= (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
            y, m = np.where(good, year, 2000), np.where(good, month, 1)
            length = _days(y + (m == 12), m % 12 + 1) - _days(y, m)
            good &= day <= length
            days = _days(y, m) + day - 1
        hour = self.number(codes, "H")
        if "p" in self.spans:
            half = _mapped(self.texts(codes, "p"), lambda s: HALVES.get(s.casefold(), -1))
            good &= (half >= 0) & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + np.maximum(half, 0)
        minute, second = self.number(codes, "M"), self.number(codes, "S")
        good &= (hour <= 23) & (minute <= 59) & (second <= 59)
        if "t" in self.spans:
            good &= _mapped(self.texts(codes, "t"), lambda s: int(s in "Tt")) == 1
        micro = _fraction(codes[:, slice(*self.spans["f"])], 6) if "f" in self.spans else np.zeros(n, np.int64)
        zone = row_zone
        if "tail" in self.spans:
            named = _mapped(self.texts(codes, "tail"), lambda s: _tail_zone(s, zones))
            good &= named != _NOT_A_TAIL
            zone = np.where(named >= 0, named, row_zone)
        local = days * 86_400 + hour * 3_600 + minute * 60 + second
        utc, once = zones.to_utc(local, zone)
        return utc * 1_000_000 + micro, good & once

    def _month(self, codes: np.ndarray) -> np.ndarray:
        if "b" not in self.spans:
            return self.number(codes, "m")

        def month(name: str) -> int:
            low = name.casefold()
            return MONTHS.get(low, MONTH_NAMES.get(low, 9 if low == "sept" else 0))

        return _mapped(self.texts(codes, "b"), month)

    def _number(self, codes: np.ndarray, number_year: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.spans["n"]
        whole = np.zeros(len(codes), np.uint64)
        for k in range(a, b):
            whole = whole * np.uint64(10) + (codes[:, k] - 48).astype(np.uint64)
        out, good = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        begin, end = (int(dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc).timestamp()) for y in (number_year, number_year + 1))
        for unit in (1, 1_000, 1_000_000, 1_000_000_000):
            hit = (whole >= np.uint64(begin * unit)) & (whole < np.uint64(end * unit))
            if not hit.any():
                continue
            value = whole[hit].astype(np.int64)
            micro = value // (unit // 1_000_000) if unit >= 1_000_000 else value * (1_000_000 // unit)
            if "f" in self.spans and unit < 1_000_000:
                digits = 6 if unit == 1 else 3
                micro = micro + _fraction(codes[hit][:, slice(*self.spans["f"])], digits)
            out[hit], good[hit] = micro, True
        return out, good


_NOT_A_TAIL = -2


def _tail_zone(tail: str, zones: Zones) -> int:
    """The zone of what follows the clock; an offset counts before a bracketed name."""
    text = tail.strip(BLANKS)
    head, bracket, rest = text.partition("[")
    if head:
        found = zones.resolve(head)
        if found != NO_ZONE or head[0] in "+-":
            return found if found != NO_ZONE else _NOT_A_TAIL
        return NO_ZONE if "/" in head else _NOT_A_TAIL
    return zones.resolve(rest.rstrip("]")) if bracket else NO_ZONE


def _digits(codes: np.ndarray) -> np.ndarray:
    value = np.zeros(len(codes), np.int64)
    for k in range(codes.shape[1]):
        value = value * 10 + (codes[:, k].astype(np.int64) - 48)
    return value


def _fraction(codes: np.ndarray, digits: int) -> np.ndarray:
    kept = codes[:, :digits]
    return _digits(kept) * 10 ** (digits - kept.shape[1])


def _mapped(texts: np.ndarray, of) -> np.ndarray:
    values, back = np.unique(texts, return_inverse=True)
    return np.array([of(str(v)) for v in values], np.int64)[back]


def _days(year: np.ndarray, month: np.ndarray) -> np.ndarray:
    """Days from 1970-01-01 to the first of a month of the Gregorian calendar."""
    return ((year - 1970) * 12 + month - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)


@lru_cache(maxsize=4096)
def parser_for(mask: str) -> MaskParser | None:
    """The parser of a mask; ``None`` if no value of that mask is a time."""
    for rule in GRAMMAR:
        if match := rule.fullmatch(mask):
            return MaskParser({k.rstrip("2"): match.span(k) for k in match.groupdict() if match[k] is not None})
    return None


# --- operator --------------------------------------------------------------


def shape_mask(value: Column) -> Column:
    """The mask of character classes of a folded value."""
    return F.translate(value, DIGITS + LETTERS, "9" * 10 + "a" * 52)


def folded(value: Column) -> Column:
    return F.translate(F.btrim(value, F.lit(BLANKS)), FOLD_FROM, FOLD_TO)


def instants(values: list[str], masks: pa.Array, row_zone: np.ndarray, zones: Zones, number_year: int = NUMBER_YEAR) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds of each value, ``NONE`` where it denotes no single instant, and the unit each is written to."""
    out, units = np.full(len(values), NONE, np.int64), np.ones(len(values), np.int64)
    coded = masks.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary)), side="right")
    begin = int(np.searchsorted(codes[order], 0))
    for mask, end in zip(coded.dictionary.to_pylist(), ends):
        rows, begin = order[begin:end], end
        parser = parser_for(mask)
        if parser is None:
            continue
        text = np.array([values[i] for i in rows], f"U{len(mask)}")
        matrix = text.view(np.uint32).reshape(len(rows), len(mask))
        micro, good = parser.parse(matrix, row_zone[rows], zones, number_year)
        out[rows[good]] = micro[good]
        units[rows] = parser.unit
    return out, units


def normalise_times(df: DataFrame, value: str, zone: str | None, keep: list[str], out: str = "utc_us", unit: str | None = None, number_year: int = NUMBER_YEAR, tzdb: str | None = None) -> DataFrame:
    """One row for each row of ``df`` whose ``value`` denotes exactly one instant.

    Returns the ``keep`` columns and ``out`` (long, microseconds since 1970 in
    UTC, finer digits dropped).  ``zone`` names the column with the zone beside
    the value, or is ``None``.  ``unit`` adds a column of that name: the
    microseconds of the finest part that the value writes.  Bare numbers count
    in the unit that puts them into ``number_year``.  ``tzdb`` is the version
    of the tz database that the result must rest on (see ``tzdb_version``);
    with any other one at hand this is an error.  Nulls, empty texts, words, times that do not
    exist, local times shown twice or never and values without any zone give no
    row; repeated rows give repeated results.  Any other column of ``df`` is
    left out before the data leaves the JVM.
    """
    if tzdb is not None and tzdb != all_zones().version:
        raise ValueError(f"the tz database here is version {all_zones().version}, not {tzdb}")
    v, z, m = (fresh_name([*keep, out, *([unit] if unit else [])], n) for n in ("value", "zone", "mask"))
    text = folded(F.col(value).cast("string"))
    source = df.where(F.col(value).isNotNull()).select(
        *[F.col(k) for k in keep], text.alias(v), (F.col(zone).cast("string") if zone else F.lit(None).cast("string")).alias(z)
    )
    # A value without a digit is no time; it never leaves the JVM.
    source = source.where(F.col(v).rlike("[0-9]")).withColumn(m, shape_mask(F.col(v)))
    kept = [source.schema[k] for k in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` bigint" + (f", `{unit}` bigint" if unit else "")
    sent = source.sparkSession.sparkContext.broadcast(all_zones())  # about 600 zones, under 4 MB

    def convert(batches):
        zones = sent.value
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from block(held, zones)
                held, rows = [], 0
        if rows:
            yield from block(held, zones)

    def block(held, zones):
        table = pa.Table.from_batches(held)
        named = table.column(z).combine_chunks().dictionary_encode()
        ids = np.array([zones.resolve(t) for t in named.dictionary.to_pylist()] + [NO_ZONE], np.int64)
        row_zone = ids[named.indices.fill_null(len(ids) - 1).to_numpy(zero_copy_only=False)]
        micro, units = instants(table.column(v).to_pylist(), table.column(m).combine_chunks(), row_zone, zones, number_year)
        good = pa.array(micro != NONE)
        result = table.select(keep).append_column(out, pa.array(micro))
        if unit:
            result = result.append_column(unit, pa.array(units))
        yield from result.filter(good).to_batches()

    return source.mapInArrow(convert, schema)


def undetermined_times(df: DataFrame, value: str, zone: str | None, key: list[str]) -> DataFrame:
    """The rows of ``df`` with a value that denotes no single instant: ``key``, ``value`` and its mask.

    ``key`` must identify a row.  Nulls are not listed.
    """
    found = normalise_times(df, value, zone, key, "__utc_us").select(*key)
    rest = df.where(F.col(value).isNotNull()).join(found, key, "left_anti")
    return rest.select(*key, F.col(value), shape_mask(folded(F.col(value))).alias("mask"))
