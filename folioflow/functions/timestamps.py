"""Mixed timestamp formats and zones to one UTC instant.

A value is reduced to its shape mask (every digit ``9``, every run of letters ``A``, other
characters kept). Each distinct mask is mapped to a grammar once per worker; all values
of a mask are then cut into fields and converted as numpy columns. Wall times go through
zone transition tables built from one named version of the time-zone database.

Defined results: null, blank, meaningless or impossible values, and wall times whose zone
is unknown, give null. Fields not written are zero. Digits past the microsecond are cut.
A wall time that occurs twice is the earlier instant, a skipped one has the offset that
held before the change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Month names as the editors write them, by locale language.
MONTHS = [
    "january jan januar janvier enero janeiro gennaio gen januari sty stycznia",
    "february feb februar février fevrier févr febrero fevereiro febbraio februari lut lutego",
    "march mar märz marz mars marzo março marco maart marca",
    "april apr avril avr abril abr aprile kwi kwietnia",
    "may mai mayo maio maggio mag mei maj maja",
    "june jun juni juin junio junho giugno giu czerwca",
    "july jul juli juillet julio julho luglio lug lipca",
    "august aug août aout agosto ago augusti augustus sierpnia",
    "september sep sept septembre septiembre setembro set settembre września",
    "october oct oktober okt octobre octubre outubro out ottobre ott października",
    "november nov novembre noviembre novembro listopada",
    "december dec dezember dez décembre decembre déc diciembre dic dezembro dicembre grudnia",
]
MONTH = {name: i + 1 for i, names in enumerate(MONTHS) for name in names.split()}
# The regions that write the month before the day.
MONTH_FIRST = ("US",)

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_AMPM = r"(?:\s?(?P<p>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s?(?P<z>[A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?))?(?:\[(?P<zone>[\w/+-]+)\])?"
#: (kind, pattern of masks, pattern of values)
GRAMMARS = [
    ("iso", r"9{4}-9{2}-9{2}(?:\W*$|[A ]9.*)", rf"(?P<Y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})(?:[Tt ]{_TIME}{_ZONE})?"),
    ("basic", r"9{8}(?:A9{6}A?|9{6})", r"(?P<Y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt]?(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?P<z>Z)?"),
    ("epoch", r"-?9{10}|9{13}|9{16}", r"(?P<e>-?\d+)"),
    ("numeric", r"9{1,2}([/.-])9{1,2}\1(?:9{4}|9{2})(?:,? 9.*)?", rf"(?P<n1>\d{{1,2}})[/.-](?P<n2>\d{{1,2}})[/.-](?P<Y>\d{{4}}|\d{{2}})(?:,?\s{_TIME}{_AMPM})?"),
    ("yearfirst", r"9{4}([/.])9{1,2}\1.*", rf"(?P<Y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})(?:\s{_TIME}{_AMPM})?"),
    ("cjk", r"9{4}A9{1,2}A9{1,2}A.*", rf"(?P<Y>\d{{4}})[年년]\s?(?P<m>\d{{1,2}})[月월]\s?(?P<d>\d{{1,2}})[日일](?:\s?{_TIME})?"),
    ("mail", r"(?:A, )?9{1,2} A 9{4} 9.*[+-]9{4}", rf"(?:[^\W\d_]+, )?(?P<d>\d{{1,2}}) (?P<mon>[^\W\d_]+) (?P<Y>\d{{4}}) {_TIME} (?P<z>[+-]\d{{4}}|[A-Z]{{1,5}})"),
    ("dayfirst", r"9{1,2}\.? (?:A )?A (?:A )?9{4}.*", rf"(?P<d>\d{{1,2}})\.? (?:de )?(?P<mon>[^\W\d_]+)\.?,? (?:de )?(?P<Y>\d{{4}})(?:,? {_TIME}{_AMPM})?"),
    ("monthfirst", r"A\.? 9{1,2}, 9{4}.*", rf"(?P<mon>[^\W\d_]+)\.? (?P<d>\d{{1,2}}), (?P<Y>\d{{4}})(?:,? {_TIME}{_AMPM})?"),
]
_GRAMMARS = [(k, re.compile(m), re.compile(v)) for k, m, v in GRAMMARS]
MAX_LENGTH = 128  # no form above gives a longer date with any zone's name; longer values are no case


def mask_column(c: Column) -> Column:
    """The shape mask as a JVM expression."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\p{Nd}", "9"), r"\p{L}+", "A")


def shape_mask(value: str) -> str:
    return re.sub(r"[^\W\d_]+", "A", re.sub(r"\d", "9", value))


class ZoneTable:
    """Transitions of one zone: ``until`` is the last wall second (exclusive) at which
    ``offset[i]`` is in use under the rule for doubled and skipped times."""

    FIRST, LAST = datetime(1840, 1, 1, tzinfo=UTC), datetime(2100, 1, 1, tzinfo=UTC)  # from before the first transition of any zone

    def __init__(self, name: str):
        from zoneinfo import ZoneInfo

        zone = ZoneInfo(name)

        def at(t: datetime) -> tuple[int, str]:
            x = t.astimezone(zone)
            return int(x.utcoffset().total_seconds()), x.tzname()

        t, step = self.FIRST, timedelta(days=10)
        now = at(t)
        offsets, until, self.named = [now[0]], [], {now[1]: now[0]}
        while t < self.LAST:
            nxt = t + step
            then = at(nxt)
            if then != now:
                lo, hi = t, nxt
                while hi - lo > timedelta(seconds=1):
                    mid = lo + (hi - lo) // 2
                    mid = mid.replace(microsecond=0)
                    if mid in (lo, hi):
                        break
                    lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
                until.append(int(hi.timestamp()) + max(now[0], then[0]))
                offsets.append(then[0])
                self.named[then[1]] = then[0]
            t, now = nxt, then
        self.until, self.offset = np.array(until, dtype=np.int64), np.array(offsets, dtype=np.int64)

    def offsets(self, wall_s: np.ndarray) -> np.ndarray:
        return self.offset[np.searchsorted(self.until, wall_s, side="right")]


_tables: dict[str, ZoneTable | None] = {}


def zone_table(name: str) -> ZoneTable | None:
    if name not in _tables:
        try:
            _tables[name] = ZoneTable(name)
        except Exception:  # an unknown name
            _tables[name] = None
    return _tables[name]


# Zones whose rules change often, which tell versions apart.
PROBES = ("Europe/Berlin", "America/New_York", "America/Sao_Paulo", "America/Mexico_City", "Africa/Cairo", "Africa/Casablanca", "Asia/Tehran", "Asia/Gaza", "Australia/Sydney", "Pacific/Fiji")


def zone_version() -> str:
    """Version of the zone database that this process reads."""
    import zoneinfo

    for folder in zoneinfo.TZPATH:
        for file in ("tzdata.zi", "+VERSION"):
            try:
                with open(f"{folder}/{file}") as f:
                    return f.readline().replace("# version", "").strip()
            except OSError:
                continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:  # no version is told: the tables themselves tell it
        import hashlib

        tables = [zone_table(z) for z in PROBES]
        return "digest " + hashlib.sha256(b"".join(t.until.tobytes() + t.offset.tobytes() for t in tables if t)).hexdigest()[:16]


_by_mask: dict[str, int] = {}


def grammar_of(mask: str) -> int:
    """Index of the grammar of a mask, -1 for none; worked out once per mask."""
    if mask not in _by_mask:
        if len(_by_mask) > 100_000:
            _by_mask.clear()
        _by_mask[mask] = next((i for i, (_, m, _) in enumerate(_GRAMMARS) if m.fullmatch(mask)), -1)
    return _by_mask[mask]


def _int(s: pd.Series | None, n: int, default: int = 0) -> np.ndarray:
    return np.full(n, default, dtype=np.int64) if s is None else s.fillna(str(default)).replace("", str(default)).astype("int64").to_numpy()


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1)
    months = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d <= after - first)


def to_utc_us(dates: pd.Series, zones: pd.Series, locales: pd.Series) -> pd.Series:
    """Microseconds since 1970-01-01 UTC as nullable integers, column by column."""
    out = np.zeros(len(dates), dtype=np.int64)
    good = np.zeros(len(dates), dtype=bool)
    text = dates.fillna("").str.strip()
    masks = text.where(text.str.len() <= MAX_LENGTH, "").str.replace(r"\d", "9", regex=True).str.replace(r"[^\W\d_]+", "A", regex=True)
    zones, locales = zones.to_numpy(dtype=object), locales.fillna("").to_numpy(dtype=object)
    for mask, where in masks.groupby(masks).indices.items():
        g = grammar_of(mask)
        if g < 0:
            continue
        kind, _, pattern = _GRAMMARS[g]
        f = text.iloc[where].str.extract(f"^(?:{pattern.pattern})$")
        col = lambda k: f[k] if k in f.columns else None  # noqa: B023, E731
        n = len(where)
        if kind == "epoch":
            ok = f["e"].notna().to_numpy()
            e = _int(f["e"], n)
            unit = {10: 1_000_000, 13: 1000, 16: 1}[len(mask.lstrip("-"))]
            out[where], good[where] = e * unit, ok
            continue
        ok = f["Y"].notna().to_numpy()
        y = _int(f["Y"], n)
        y = np.where(f["Y"].fillna("").str.len().to_numpy() == 2, y + 2000, y)
        if kind == "numeric":
            a, b = _int(f["n1"], n), _int(f["n2"], n)
            first = np.array([str(x).replace("_", "-").rpartition("-")[2].upper() in MONTH_FIRST for x in locales[where]], dtype=bool)
            m, d = np.where(first, a, b), np.where(first, b, a)
        else:
            d = _int(f["d"], n)
            m = f["mon"].str.lower().map(MONTH).fillna(0).astype("int64").to_numpy() if "mon" in f.columns else _int(f["m"], n)
        day, valid = _days(y, m, d)
        H, M, S = (_int(col(k), n) for k in "HMS")
        if (p := col("p")) is not None:
            p = p.str.lower().to_numpy(dtype=object)
            has = np.array([isinstance(x, str) for x in p], dtype=bool)
            ok &= ~has | ((H >= 1) & (H <= 12))
            H = np.where(has, H % 12 + np.where(p == "p", 12, 0), H)
        ok &= valid & (H < 24) & (M < 60) & (S < 60)
        us = _int(None if (s := col("f")) is None else s.fillna("").str.ljust(9, "0").str[:6], n)
        wall = day * 86400 + H * 3600 + M * 60 + S
        z = np.full(n, None, dtype=object) if (s := col("z")) is None else s.to_numpy(dtype=object)
        named = np.full(n, None, dtype=object) if (s := col("zone")) is None else s.to_numpy(dtype=object)
        offset = np.zeros(n, dtype=np.int64)
        files = zones[where]
        kinds = pd.DataFrame({"z": [x if isinstance(x, str) else "" for x in z], "n": [x if isinstance(x, str) else "" for x in named], "f": [x if isinstance(x, str) else "" for x in files]})
        for (zz, nn, ff), at in kinds.groupby(["z", "n", "f"]).indices.items():
            if zz[:1] in ("+", "-") and zz:
                digits = zz[1:].replace(":", "").ljust(4, "0")
                h, mi = int(digits[:2]), int(digits[2:])
                offset[at] = (h * 3600 + mi * 60) * (-1 if zz[0] == "-" else 1)
                if h > 18 or mi > 59:
                    ok[at] = False
                continue
            if zz.upper() == "Z":
                continue
            t = zone_table(nn or ff) if nn or ff else None
            if t is None:
                if zz.upper() not in ("UTC", "GMT", "UT"):
                    ok[at] = False
            elif zz and zz.upper() in t.named:
                offset[at] = t.named[zz.upper()]
            elif zz.upper() in ("UTC", "UT"):
                offset[at] = 0
            else:
                offset[at] = t.offsets(wall[at])
        out[where] = (wall - offset) * 1_000_000 + us
        good[where] = ok
    return pd.Series(out, dtype="Int64").where(pd.Series(good))


def normalise_dates(records: DataFrame, version: str | None = None) -> DataFrame:
    """``records(record_kind, record_id, date, zone, locale)`` → ``(record_kind, record_id,
    utc_us)``, one row per record whose date denotes one instant.

    Repeated rows give one row. ``version`` pins the zone database: a worker that reads
    another version fails instead of mixing two.
    """
    version = version or zone_version()

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if zone_version() != version:
            raise ValueError(f"zone database {zone_version()} here, {version} on the driver")
        for b in batches:
            b = b.reset_index(drop=True)
            b["utc_us"] = to_utc_us(b["date"], b["zone"], b["locale"])
            b = b[b["utc_us"].notna()]
            yield b[["record_kind", "record_id", "utc_us"]]

    asked = records.select("record_kind", "record_id", "date", "zone", "locale").where(F.length(F.trim("date")) > 0)
    return asked.mapInPandas(convert, "record_kind string, record_id bigint, utc_us bigint").dropDuplicates(["record_kind", "record_id"])
