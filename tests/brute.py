"""Plain Python versions of the data-quality operators, row by row, for comparison."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone
from itertools import groupby
from zoneinfo import ZoneInfo

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def ipv4(x) -> bool:
    return isinstance(x, str) and bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", x)) and all(str(int(o)) == o and int(o) < 256 for o in x.split("."))


def whole(x, lo, hi=10**18) -> bool:
    return isinstance(x, str) and x.isascii() and x.isdigit() and lo <= int(x) <= hi


def json_int(x, lo, hi) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and lo <= x <= hi


def header(text: str) -> tuple[list[str], str]:
    out, now, i = [], "", 0
    while i < len(text):
        if text[i] == "\\":
            now += text[i : i + 2]
            i += 2
            continue
        if text[i] == "|":
            out.append(now)
            now = ""
        else:
            now += text[i]
        i += 1
    return out, now


def stamp_exists(s: str) -> bool:
    m = re.fullmatch(r"([A-Za-z]{3}) +(\d{1,2}) (\d\d):(\d\d):(\d\d)", s)
    try:
        datetime(2024, MONTHS.index(m[1].lower()) + 1, int(m[2]), int(m[3]), int(m[4]), int(m[5]))
        return True
    except ValueError:
        return False


def csv_cells(t: str) -> list[str] | None:
    cells, i = [], 0
    while True:
        if t[i : i + 1] == '"':
            now, i = "", i + 1
            while True:
                j = t.find('"', i)
                if j < 0:
                    return None
                now += t[i:j]
                i = j + 1
                if t[i : i + 1] == '"':
                    now, i = now + '"', i + 1
                else:
                    break
            if i < len(t) and t[i] != ",":
                return None
        else:
            j = t.find(",", i)
            now = t[i:] if j < 0 else t[i:j]
            if '"' in now:
                return None
            i = len(t) if j < 0 else j
        cells.append(now)
        if i >= len(t):
            return cells
        i += 1


def frame_reason(codec: str | None, raw: bytes | None) -> str | None:
    try:
        t = (raw or b"").decode().strip()
    except UnicodeDecodeError:
        return "value"
    if not t:
        return "columns"
    if codec == "json":

        def no(x):
            raise ValueError(x)

        try:
            v = json.loads(t, parse_constant=no)
        except ValueError:
            return "quoting"
        for o in v if isinstance(v, list) else [v]:
            for k, x in o.items() if isinstance(o, dict) else ():
                if x is None:
                    continue
                if k in ("src_ip", "dst_ip", "src", "dst") and not ipv4(x):
                    return "value"
                if k in ("src_port", "dst_port", "dpt", "dstPort") and not json_int(x, 0, 65535):
                    return "value"
                if k == "status_code" and not json_int(x, 100, 599):
                    return "value"
        return None
    if codec == "csv":
        c = csv_cells(t)
        if c is None:
            return "quoting"
        if len(c) != 9:
            return "columns"
        good = ipv4(c[0]) and whole(c[1], 0, 65535) and ipv4(c[2]) and whole(c[3], 0, 65535) and whole(c[6], 0)
        return None if good else "value"
    if codec == "cef":
        m = re.match(r"(?s)([^|]*?\s)?CEF:(.*)", t)
        if not m:
            return "columns"
        h, rest = header(m[2])
        if len(h) < 7:
            return "columns"
        ext = "|".join([*h[7:], rest])
        kv = {a[1]: a[2].strip() for a in re.finditer(r"(?:^|\s)([A-Za-z][\w.]*)=(.*?)(?=\s+[A-Za-z][\w.]*=|$)", ext, re.S)}
        ok = h[6] in ("Unknown", "Low", "Medium", "High", "Very-High") or whole(h[6], 0, 10)
        ok = ok and all(ipv4(kv[k]) for k in ("src", "dst") if k in kv) and all(whole(kv[k], 0, 65535) for k in ("dpt", "dstPort", "src_port", "dst_port") if k in kv)
        s = re.search(r"[A-Za-z]{3} [ \d]?\d \d\d:\d\d:\d\d", m[1] or "")
        return None if ok and (not s or stamp_exists(s[0])) else "value"
    if codec == "leef":
        m = re.match(r"(?s)([^|]*?\s)?LEEF:(.*)", t)
        h, rest = header(m[2]) if m else ([], "")
        need = {"1.0": 5, "2.0": 6}.get(h[0] if h else "")
        if not need or len(h) < need:
            return "columns"
        code = "x09" if need == 5 else h[5]
        delim = chr(int(code.split("x")[1], 16)) if re.fullmatch(r"0?x[0-9A-Fa-f]{2,4}", code) else code or "\t"
        kv = dict(a.split("=", 1) for a in "|".join([*h[need:], rest]).split(delim) if "=" in a)
        kv = {k: v.strip() for k, v in kv.items()}
        ok = all(ipv4(kv[k]) for k in ("src", "dst") if k in kv) and all(whole(kv[k], 0, 65535) for k in ("dstPort", "dpt") if k in kv)
        return None if ok and ("sev" not in kv or whole(kv["sev"], 1, 10)) else "value"
    if codec == "syslog":
        m = re.match(r"(?s)<([^<>]*)>(.*)", t)
        if m and re.match(r"\d{1,3}( |$)", m[2]):
            p = m[2].split(" ", 6)
            if len(p) == 7 and p[6].startswith("["):
                if not re.match(r'(?:\[[^\s=\]"]+(?: [^\s=\]"]+="(?:[^"\\\]]|\\.)*")*\])+(?: |$)', p[6]):
                    return "quoting"
            elif len(p) < 7 or not re.match(r"-( |$)", p[6]):
                return "columns"
            w = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(\.\d+)?(Z|[+-](\d\d):(\d\d))", p[1])
            try:
                datetime(*map(int, w.groups()[:6]))
                time_ok = not w[9] or (int(w[9]) < 24 and int(w[10]) < 60)
            except (ValueError, AttributeError):
                time_ok = p[1] == "-"
        else:
            w = m and re.match(r"([A-Za-z]{3} +\d{1,2} \d\d:\d\d:\d\d) (\S+)", m[2])
            if not w:
                return "columns"
            time_ok = stamp_exists(w[1])
        return None if whole(m[1], 0, 191) and time_ok else "value"
    return None


ABBR = {"est": -300, "edt": -240, "cst": -360, "cdt": -300, "pst": -480, "pdt": -420, "cet": 60, "cest": 120, "utc": 0, "gmt": 0, "z": 0, "bst": 60, "aest": 600}
EPOCH = datetime(1970, 1, 1)


def us(x: datetime) -> int:
    return (x - EPOCH) // timedelta(microseconds=1)


def local_instants(naive: datetime, zone: str) -> list[int]:
    out = set()
    for fold in (0, 1):
        u = naive.replace(tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc)
        if u.astimezone(ZoneInfo(zone)).replace(tzinfo=None, fold=0) == naive:
            out.add(us(u.replace(tzinfo=None)))
    return sorted(out)


def unit(n: int) -> int:
    return n * 10**6 if abs(n) < 10**10 else n * 1000 if abs(n) < 10**13 else n if abs(n) < 10**16 else n // 1000


def instant(text: str | None, zone: str, order: str, recv: int) -> int | None:
    t = (text or "").strip().lower()
    if re.fullmatch(r"\d{9,11}(\.\d+)?|\d{13}|\d{16}|\d{19}", t):
        a, _, b = t.partition(".")
        return unit(int(a)) + int(b[:6].ljust(6, "0") or 0)
    clock = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)? ?(?P<ap>am|pm)? ?(?P<z>z|[a-z]{3,5}|[+-]\d\d:?\d\d)?$"
    mon = r"(?P<mo>[a-zä]{3})"
    for form in (
        r"(?P<y>\d{4})[-/](?P<m>\d\d)[-/](?P<d>\d\d)[t ]" + clock,
        (r"(?P<m>\d\d)[./](?P<d>\d\d)" if order == "mdy" else r"(?P<d>\d\d)[./](?P<m>\d\d)") + r"[./](?P<y>\d{4}) " + clock,
        r"(?:[a-z]{3} )?" + mon + r" +(?P<d>\d{1,2})(?: (?P<y>\d{4}))? " + clock,
        r"(?:[a-z]{3}, )?(?P<d>\d{1,2})(?:\. | |/)" + mon + r"[ /](?P<y>\d{4})[ :]" + clock,
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)t?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?P<f>)(?P<ap>)(?P<z>z)?$",
    ):
        if m := re.match(form, t):
            break
    else:
        return None
    g = m.groupdict()
    names = dict(zip(MONTHS, range(1, 13))) | {"mär": 3, "mai": 5, "okt": 10, "dez": 12}
    month = int(g["m"]) if g.get("m") else names.get(g["mo"])
    h = int(g["h"])
    if g["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"] == "pm")
    there = datetime(1970, 1, 1) + timedelta(microseconds=recv)
    years = [int(g["y"])] if g.get("y") else range(there.year - 8, there.year + 9)
    found = []
    for y in years:
        try:
            naive = datetime(y, month, int(g["d"]), h, int(g["mi"]), int(g["s"] or 0), int((g["f"] or "")[:6].ljust(6, "0")))
        except (ValueError, TypeError):
            continue
        z = g["z"]
        if not z:
            found += local_instants(naive, zone)
        elif z[0] in "+-":
            x = z[1:].replace(":", "")
            found.append(us(naive) - (1 if z[0] == "+" else -1) * (int(x[:2]) * 60 + int(x[2:])) * 60 * 10**6)
        else:
            found.append(us(naive) - ABBR[z] * 60 * 10**6)
    return min(found, key=lambda u: (abs(u - recv), u), default=None)


def json_type(v) -> str:
    return "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def drift(files, lines) -> set[tuple]:
    """Unique candidates only: ties between equal sets are not told apart here."""
    held = defaultdict(lambda: defaultdict(set))
    for file_id, payload in lines:
        o = json.loads(payload)
        for k, v in o.items():
            if v is not None:
                held[file_id][k].add((json_type(v), json.dumps(v, sort_keys=True)))
    out = set()
    for _, g in groupby(sorted(files), key=lambda x: x[0]):
        ids = [f for _, _, f in g]
        for a, b in zip(ids, ids[1:]):
            x, y = held[a], held[b]
            kind = lambda s: sorted(s)[0][0]
            gone, new = sorted(set(x) - set(y)), sorted(set(y) - set(x))
            for k in set(x) & set(y):
                if kind(x[k]) != kind(y[k]):
                    out.add((b, "retyped", k, k, kind(x[k]), kind(y[k])))
            for k in list(gone):
                twin = next((n for n in new if y[n] == x[k]), None)
                if twin:
                    gone.remove(k)
                    new.remove(twin)
                    out.add((b, "renamed", k, twin, kind(x[k]), kind(y[twin])))
            out |= {(b, "removed", k, "", kind(x[k]), "") for k in gone} | {(b, "added", "", k, "", kind(y[k])) for k in new}
    return out


def sessions(events, gap_us: int) -> set[tuple]:
    """events: (event_id, ts, username, host)."""
    by = defaultdict(list)
    for _, ts, user, host in {e[0]: e for e in events}.values():
        u = (user or "").strip().lower()
        owner = ("user", u) if u not in ("", "-") else ("device", host) if host and host.strip() else None
        if owner and ts is not None:
            by[owner].append(ts)
    out = set()
    for owner, times in by.items():
        times.sort()
        at = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > gap_us:
                out.add((*owner, times[at], times[i - 1], times[i - 1] - times[at], i - at))
                at = i
    return out


def late(events, period: int, lateness: int) -> set[tuple]:
    """events: (id, tenant, ts, arrival)."""
    first = {}
    for e in events:
        if e[0] not in first or e[3] < first[e[0]][3]:
            first[e[0]] = e
    n = defaultdict(lambda: [0, 0, 0, 0])
    for _, tenant, ts, arrival in first.values():
        hour = unit(ts) // period * period
        c = n[tenant, hour]
        c[0] += arrival < hour + period
        c[1] += arrival < hour + period + lateness
        c[2] += arrival >= hour + period + lateness
        c[3] += arrival >= hour + period
    return {(*k, *c[:3]) for k, c in n.items() if c[3]}


def is_date(s: str) -> bool:
    try:
        date.fromisoformat(s)
        return True
    except ValueError:
        return False
