"""The memory ladder against a plain one, library by library, and its sequences against unsplit ones."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import memories as M
from heliograph.operators import spans as R

NOW = dt.datetime(2024, 6, 15, 10, 0)
SCHEMA = "owner long, pos long, id string, date_taken timestamp_ntz, tz_offset_s int, gps_lat double, gps_lon double, country string, folder string, tags array<string>"
DAY = dt.timedelta(days=1)
HOUSE, CITIES = (48.2, 16.3), [("it", "Italy/Lazio/Rome", 41.9, 12.5), ("it", "Italy/Lazio/Ostia", 41.7, 12.3), ("fr", "France/Paris", 48.8, 2.3), (None, "", 40.0, 20.0), ("IT", "Italy/Tuscany/Siena", 43.3, 11.3)]


def library(rnd, owner, settled=True):
    """Photos at home over a year, trips, a busy day, and photos of this day in earlier years."""
    out = []

    def add(t, where=None, folder="/lib/misc", tags=(), country=None, offset=None):
        lat, lon = where or (None, None)
        out.append([owner, len(out), f"{owner}-{len(out)}", t, offset if offset is not None else rnd.choice([0, 3600, -7200]), lat, lon, country, folder, list(tags)])

    if settled:
        for d in range(0, 400, 9):
            add(dt.datetime(2023, 1, 1, 12) + d * DAY, (HOUSE[0] + rnd.random() * 0.05, HOUSE[1]), tags=["People/Ann Lee"] if d % 2 else [])
    t = dt.datetime(2023, 2, 3, 8)
    for trip in range(5):
        stay = rnd.randrange(1, 4)
        for code, place, lat, lon in rnd.sample(CITIES, stay):
            for k in range(rnd.choice([4, 14, 18, 40])):
                t += dt.timedelta(seconds=rnd.choice([20, 59, 60, 61, 4000, 15000]))
                tags = ([f"Places/{place}"] if place and rnd.random() < 0.95 else []) + rnd.sample(["People/Ann Lee", "People/Bob Ray", "People/Ann Zed", "People/Me", "Mood"], 2)
                add(t, (lat, lon), f"/lib/trip{trip}", tags, code)
        t += dt.timedelta(hours=rnd.choice([47, 49, 300]))
        if settled and rnd.random() < 0.5:
            add(t, HOUSE)
    for year in (2014, 2019, 2022, 2023):
        for k in range(rnd.choice([3, 10, 25, 90])):
            add(dt.datetime(year, 6, rnd.choice([15, 15, 15, 17]), 1) + k * dt.timedelta(seconds=rnd.choice([30, 700])), folder=f"/lib/{rnd.choice(['Party', 'party', 'Zoo'])}/{year}" if year < 2022 else "/x/Party", tags=["People/Ann Lee"])
    for k in range(60):
        add(dt.datetime(2024, 6, 2, 9) + k * dt.timedelta(seconds=100), folder="/lib/now")
        add(dt.datetime(2021, 3, 4, 9) + k * dt.timedelta(seconds=100), folder="/lib/then")
    add(None, tags=["People/Ann Lee"])
    add(None, HOUSE)
    rnd.shuffle(out)
    for i, r in enumerate(out):
        r[1] = i
    return [tuple(r) for r in out]


# the plain ladder -------------------------------------------------------------------------------------------------------------


def fold(rows):
    out, last = [], None
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        if last is None or (r[3] - last).total_seconds() >= 60:
            out.append(r)
            last = r[3]
    return out


def local(r):
    return r[3] + dt.timedelta(seconds=r[4])


def whole_days(a, b):
    return math.floor((b - a) / DAY)


def place(r):
    best = []
    for t in r[9]:
        s = [x for x in t.split("/") if x]
        if len(s) > 1 and s[0].lower() == "places" and len(s) - 1 > len(best):
            best = s[1:]
    return best


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def plain_trips(rows):
    geo = sorted((r for r in rows if r[3] and r[5] is not None), key=lambda r: (r[3], r[1]))
    if len(geo) < 5:
        return []
    cells = {}
    for r in geo:
        cells.setdefault((math.floor(r[5] / 0.1), math.floor(r[6] / 0.1)), []).append(r)
    span, days = whole_days(geo[0][3], geo[-1][3]), len({local(r).date() for r in geo})
    homes = set()
    for (y, x), rs in cells.items():
        if whole_days(min(r[3] for r in rs), max(r[3] for r in rs)) >= min(180, max(30, span // 2)) and len({local(r).date() for r in rs}) >= min(30, max(10, days // 4)):
            homes |= {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    middle = sorted(r[5] for r in geo)[len(geo) // 2], sorted(r[6] for r in geo)[len(geo) // 2]
    out, now = [], []
    for r in geo:
        at_home = (math.floor(r[5] / 0.1), math.floor(r[6] / 0.1)) in homes if homes else km(middle, r[5:7]) <= 50
        if at_home or (now and (r[3] - now[-1][3]).total_seconds() > 48 * 3600):
            out.append(now)
            now = []
        if not at_home:
            now.append(r)
    return [x for x in [*out, now] if x]


def label(rows):
    counts = {}
    for r in rows:
        if r[7]:
            counts[r[7]] = counts.get(r[7], 0) + 1
    parts = [p for p in map(place, rows) if p]
    shared = list(parts[0]) if parts else []
    for p in parts:
        n = 0
        while n < min(len(shared), len(p)) and shared[n].lower() == p[n].lower():
            n += 1
        shared = shared[:n]
    if counts:
        top = max(counts, key=counts.get)
        if counts[top] / sum(counts.values()) >= 0.9:
            return shared[-1] if len(shared) >= 2 else top
    if len(counts) >= 2:
        names = sorted(counts, key=lambda c: (-counts[c], c))
        return f"{len(names)} countries" if len(names) > 3 else " & ".join(names) if len(names) == 2 else f"{names[0]}, {names[1]} & {names[2]}"
    return shared[-1] if shared else next(iter(counts), None)


def people(rows):
    counts = {}
    for r in rows:
        for t in r[9]:
            if t.startswith("People/") and t not in ("People/Me", "People/Hidden"):
                counts[t] = counts.get(t, 0) + 1
    names = [t[7:] for t in sorted(counts, key=lambda t: (-counts[t], t[7:].lower()))[:3]]
    firsts = [n.split()[0] for n in names]
    out = []
    for n, f in zip(names, firsts, strict=True):
        same = [m for m in names if m.split()[0].lower() == f.lower()]
        out.append(f"{f} {n.split()[-1][0]}." if len(same) > 1 and len({m.split()[-1][0] for m in same}) == len(same) else f)
    return None if not out else out[0] if len(out) == 1 else ", ".join(out[:-1]) + " & " + out[-1]


def title(where, who):
    return f"{where} with {who}" if where and who else f"A trip to {where}" if where else f"A trip with {who}" if who else "A trip"


def segments(rows):
    if len({r[7].upper() for r in rows if r[7]}) >= 2:
        keyed = [(r[7].lower(), r[7].upper()) if r[7] else (None, None) for r in rows]
    else:
        ps = list(map(place, rows))
        depth = next((d for d in (1, 2) if len({p[d].lower() for p in ps if len(p) > d}) >= 2), None)
        if depth is None:
            return []
        keyed = [("-".join(p[: depth + 1]).lower(), p[depth]) if len(p) > depth else (None, None) for p in ps]
    out = []
    for r, (k, name) in zip(rows, keyed, strict=True):
        if not out or out[-1][0] != k:
            out.append((k, name, []))
        out[-1][2].append(r)
    return [s for s in out if s[0] is not None]


def memory(mid, kind, name, rows, score, cover, years=None):
    return {"mid": mid, "kind": kind, "title": name, "rows": rows, "score": score, "cover": cover, "years": years}


def calendar(rows, day):
    out = []
    same = [r for r in rows if r[3] and (local(r).month, local(r).day) == (day.month, day.day)]
    k = fold([r for r in same if local(r).year != day.year])
    if len(k) >= 10:
        out.append(memory(f"onThisDay-{day}", "onThisDay", "On this day", k, 50 + 5 * len({local(r).year for r in k}), len(k) // 2))
    for m in M.MILESTONES:
        k = fold([r for r in same if local(r).year == day.year - m])
        if len(k) >= 10:
            out.append(memory(f"yearsAgo-{m}-{day}", "yearsAgo", f"On this day in {day.year - m}", k, 45 if m >= 10 else 40 if m >= 5 else 35, len(k) // 2, m))
    return out


def born(rows, contacts, day):
    out, seen = [], []
    for r in rows:
        seen += [t for t in r[9] if t.lower().startswith("people/") and t not in seen]
    for t in seen:
        c = next((c for c in contacts if f"{c[1]} {c[2]}".strip().lower() == t[7:].lower()), None)
        if t == "People/Hidden" or c is None or c[3:] != (day.month, day.day):
            continue
        mine = [r for r in rows if t in r[9]]
        k = [r for r in mine if r[3] is None] + fold([r for r in mine if r[3]])
        out.append(memory(f"birthday-{t}", "birthday", f"Happy birthday, {t[7:]}", k, 100, len(k) - 1))
    return out


def finished(m):
    ids = [r[2] for r in m["rows"]]
    cover = ids[m["cover"]]
    if len(ids) > 75:
        step = len(ids) / 75
        ids = [ids[int(i * step)] for i in range(75)]
        cover = cover if cover in ids else ids[37]
    times = [r[3] for r in m["rows"] if r[3]]
    return (m["mid"], m["kind"], m["title"], len(m["rows"]), min(times), max(times), float(m["score"]), m["years"], tuple(ids), cover)


def plain(rows, run, contacts, seen=(), surfaced=()):
    today, month = run.today, lambda r: (local(r).year, local(r).month)
    out = calendar(rows, today)
    for f in sorted({r[8] for r in rows}):
        k = fold([r for r in rows if r[8] == f and r[3]])
        if len(k) >= 15 and month(k[-1]) != (today.year, today.month):
            out.append(memory(f"folder-{f}", "folderEvent", f.split("/")[-1], k, 10 + min(whole_days(k[0][3], k[-1][3]), 14), len(k) // 3))
    days = {}
    for r in rows:
        if r[3]:
            days.setdefault(local(r).date(), []).append(r)
    need = max(15, int(sum(map(len, days.values())) / len(days) * 3))
    for d, rs in days.items():
        if len(rs) >= need and (d.year, d.month) != (today.year, today.month):
            k = fold(rs)
            out.append(memory(f"density-{d.year}-{d.month}-{d.day}", "photoDensity", "A busy day", k, 8, len(k) // 2))
    for rs in plain_trips(rows):
        k = fold(rs)
        if len(k) < 15 or month(k[-1]) == (today.year, today.month):
            continue
        n, s = max(1, whole_days(k[0][3], k[-1][3])), local(k[0])
        key = f"{s.year}-{s.month}-{s.day}"
        out.append(memory(f"trip-{key}", "trip", title(label(k), people(k)), k, 20 + 1.5 * n, len(k) // 3))
        for code, name, part in segments(k) if n >= 5 else []:
            d = max(1, whole_days(part[0][3], part[-1][3]))
            if len(part) >= 15 and d >= 2 and len(part) < len(k) and len(part) <= len(k) * 0.85:
                out.append(memory(f"subtrip-{key}-{code}", "trip", title(name, people(part)), part, 15 + 1.2 * d, len(part) // 3))
    out += born(rows, contacts, today)
    best = {}
    for m in out:
        if m["kind"] == "folderEvent" and (m["title"].lower() not in best or len(m["rows"]) > len(best[m["title"].lower()]["rows"])):
            best[m["title"].lower()] = m
    out = [m for m in out if m["kind"] != "folderEvent" or best[m["title"].lower()] is m]
    state, scored = np.array([X.seed_state(run.seed)], dtype=np.uint64), []
    for i, m in enumerate(out):
        state, z = X.splitmix(state)
        s = m["score"] + 12.0 * (int(z[0]) & ((1 << 53) - 1)) * 2.0**-53
        p = m["mid"].split("-")
        cluster = "trip-" + "-".join(p[1:4]) if p[0] == "subtrip" else m["mid"]
        s -= 30 if any(x == m["mid"] and t > dt.datetime(2023, 12, 15, 10) for x, t in seen) else 0
        s -= 25 if any(x == cluster and t > run.now - 3 * DAY for x, t in surfaced) else 0
        scored.append((-s, i, cluster, m))
    used, chosen = set(), []
    for _, _, cluster, m in sorted(scored, key=lambda x: x[:2]):
        if cluster not in used and len(chosen) < 10:
            used.add(cluster)
            chosen.append(m)
    return [finished(m) for m in chosen], {m["mid"] for m in out}


CONTACTS = [("a", "Ann", "Lee", 6, 15), ("b", "Bob", "Ray", 6, 18), ("c", "", "", 6, 15)]
COLUMNS = ["mid", "kind", "title", "n", "first", "last", "score", "years_ago", "photos", "cover"]


def as_tuple(r):
    return tuple(tuple(r[c]) if c == "photos" else r[c] for c in COLUMNS)


@pytest.mark.parametrize("seed", range(3))
def test_ladder_is_the_plain_one(spark, seed):
    rnd = random.Random(seed)
    libraries = {o: library(rnd, o, settled=o != 2) for o in range(3)}
    libraries[3] = [(3, 0, "3-0", None, 0, None, None, None, None, [])]
    run = M.Run(NOW, 3600, f"2024-06-15/{seed}", "People/Me", ("People/Hidden",))
    seen = [("trip-2023-2-3", NOW - DAY), ("onThisDay-2024-06-15", NOW - 300 * DAY)]
    surfaced = [("folder-/lib/then", NOW - DAY), ("onThisDay-2024-06-15", NOW - 2 * DAY), ("density-2021-3-4", NOW - 4 * DAY)]
    photos = spark.createDataFrame([r for rows in libraries.values() for r in rows], SCHEMA)
    contacts = spark.createDataFrame(CONTACTS, "contact string, given string, family string, month int, day int")
    frame = lambda rows, name: spark.createDataFrame([(o, *r) for o in libraries for r in rows], f"owner long, {name} string, at timestamp_ntz")
    got = M.generate(photos, run, contacts, frame(seen, "mid"), frame(surfaced, "cluster")).collect()
    kinds = set()
    for o in range(3):
        want, every = plain(libraries[o], run, CONTACTS, seen, surfaced)
        kinds |= {m.split("-")[0] for m in every}
        assert [as_tuple(r) for r in sorted((r for r in got if r.owner == o), key=lambda r: r["rank"])] == want
    assert {"onThisDay", "yearsAgo", "folder", "density", "trip", "birthday"} <= kinds and not [r for r in got if r.owner == 3]


def test_horizon_is_the_plain_one(spark):
    rnd = random.Random(8)
    libraries = {o: library(rnd, o) for o in range(2)}
    run = M.Run(NOW, 9 * 3600, "s", hidden=("People/Hidden",))
    photos = spark.createDataFrame([r for rows in libraries.values() for r in rows], SCHEMA)
    contacts = spark.createDataFrame(CONTACTS, "contact string, given string, family string, month int, day int")
    got = sorted((r.owner, r.valid_from, r.valid_to, *as_tuple(r)) for r in M.scheduled(photos, run, contacts, ("yearsAgo-1-2024-06-17",)).collect())
    want = []
    for o, rows in libraries.items():
        for i in range(1, 8):
            day = run.today + i * DAY
            start = dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=9)
            want += [(o, start, start + DAY, *finished(m)) for m in calendar(rows, day) + born(rows, CONTACTS, day) if m["mid"] != "yearsAgo-1-2024-06-17"]
    assert got == sorted(want) != []


@pytest.mark.parametrize("parts", [1, 7])
def test_runs_are_those_of_one_window(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]), i, rnd.choice(["a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, v string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(str, R.runs(df, "k", ["i"], ["v"], lambda prev, first: first | ~prev("v").eqNullSafe(F.col("v"))).select("k", "i", "v", "run").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = [], {}
    for k, i, v in rows:
        prev, n = last.get(k, (0, 0))
        n += prev != v or n == 0
        last[k] = v, n
        want.append(f"Row(k={k!r}, i={i}, v={v!r}, run={n})")
    assert got == sorted(want)


def test_empty_library(spark):
    photos = spark.createDataFrame([], SCHEMA)
    assert M.generate(photos, M.Run(NOW)).count() == M.scheduled(photos, M.Run(NOW)).count() == 0
