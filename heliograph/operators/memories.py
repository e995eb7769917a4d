"""The whole memory ladder of many libraries as one plan.

Every generator (this day in other years, round years ago, folders, busy days, trips and their parts, birthdays) only says which group a photo is in. All
groups then share one fold of 60 seconds, one count, one ranking by the day's jitter, one selection and one sampling. A library is an ``owner``; libraries are
worked on together. Sequences are split by range (``spans``, ``ranked``), so a library or folder that holds most photos spreads over tasks; what comes
together in one place are a library's candidates, not its photos.

photos(owner, pos, id, date_taken, tz_offset_s, gps_lat, gps_lon, country, folder, tags): pos orders a library as it was listed, date_taken is UTC, the day of a
photo is that of its own offset. Undated photos count for birthdays only, those without a position aren't part of trips. Photos of one instant and
group are one, the first listed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import text as X
from heliograph.operators import edits as E
from heliograph.operators import geo as G
from heliograph.operators import sequences as S
from heliograph.operators import spans as R
from heliograph.operators import tags as T
from heliograph.session import ensure_checkpoint_dir, settled

C = F.col
#: Fixed values of the rules.
LEAST, LEAST_CALENDAR, FOLD_SECONDS, GAP_SECONDS, MOST_PHOTOS, SELECTED = 15, 10, 60, 48 * 3600, 75, 10
MILESTONES = (1, 2, 3, 5, 10, 15, 20)
CELL, HOME_KM = 0.1, 50.0
JITTER, SEEN, SURFACED = 12.0, 30.0, 25.0
HORIZON = 7
#: Kinds in the order in which they draw their jitter.
KINDS = ("onThisDay", "yearsAgo", "folderEvent", "photoDensity", "trip", "birthday")


@dataclass(frozen=True)
class Run:
    """What a run depends on besides the photos. People: hidden and own tag paths; links from a tag's path to a contact's id, or None where it is nobody's."""

    now: dt.datetime  #: UTC
    offset_s: int = 0
    seed: str = ""
    me: str = ""
    hidden: tuple[str, ...] = ()
    links: dict[str, str | None] = field(default_factory=dict)

    @property
    def today(self) -> dt.date:
        return (self.now + dt.timedelta(seconds=self.offset_s)).date()


def days_between(a: Column, b: Column) -> Column:
    """Whole days from one instant to another."""
    return F.floor(F.timestamp_diff("MICROSECOND", a, b) / F.lit(86_400_000_000)).cast("long")


def dated(photos: DataFrame) -> DataFrame:
    """The photos with a date, with t (UTC), lt (local time) and day."""
    lt = C("date_taken") + F.make_dt_interval(secs=C("tz_offset_s"))
    return photos.where("date_taken is not null").withColumns({"t": C("date_taken"), "lt": lt, "day": F.to_date(lt)})


def _group(kind: str, key: Column, at: Column | None = None, years: int | None = None) -> Column:
    """A photo's place in a group; ``at`` orders the groups of a kind."""
    at = F.lit(0) if at is None else at
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), at.cast("long").alias("at"), F.lit(years).cast("int").alias("years_ago"))


def calendar_groups(days: list[dt.date]) -> Column:
    """The groups of a photo by its local day, for each of the given days."""
    own, out = F.date_format("day", "MM-dd"), []
    for i, d in enumerate(days):
        same, year, base = own == F.lit(d.strftime("%m-%d")), F.year("day"), 100 * i
        out.append(F.when(same & (year != d.year), _group("onThisDay", F.lit(d.isoformat()), F.lit(base))))
        out += [F.when(same & (year == d.year - m), _group("yearsAgo", F.lit(f"{m}-{d.isoformat()}"), F.lit(base + m), m)) for m in MILESTONES]
    return F.array_compact(F.array(*out))


def busy_days(photos: DataFrame) -> DataFrame:
    """owner, day, seen (the place of its first photo) of the days with at least three times the library's average, and 15 photos."""
    days = photos.groupBy("owner", "day").agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    need = days.groupBy("owner").agg(F.floor(F.sum("n").cast("double") / F.count("*") * 3.0).alias("need"))
    return days.join(need, "owner").where(C("n") >= F.greatest(F.lit(LEAST), C("need"))).select("owner", "day", "seen")


def home(geo: DataFrame) -> DataFrame:
    """geo (read several times) with ``home``: in a cell (or next to one) that is used over a long span and on many days or, in a library without such a cell, within 50 km of its median position."""
    g = geo.withColumns({"cy": F.floor(C("gps_lat") / F.lit(CELL)).cast("long"), "cx": F.floor(C("gps_lon") / F.lit(CELL)).cast("long")})
    by = lambda *k: g.groupBy(*k).agg(days_between(F.min("t"), F.max("t")).alias("span"), F.countDistinct("day").alias("days"))
    need = by("owner").select("owner", F.least(F.lit(180), F.greatest(F.lit(30), F.expr("span div 2"))).alias("least_span"), F.least(F.lit(30), F.greatest(F.lit(10), F.expr("days div 4"))).alias("least_days"))
    primary = by("owner", "cy", "cx").join(need, "owner").where("span >= least_span and days >= least_days").select("owner", "cy", "cx").checkpoint()  # a few cells of each library, asked three times
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cells = primary.select("owner", "cy", "cx", F.explode(ring).alias("r")).select("owner", (C("cy") + C("r.i")).alias("cy"), (C("cx") + C("r.j")).alias("cx"), F.lit(True).alias("in_cell")).distinct()
    settled = primary.select("owner", F.lit(True).alias("settled")).distinct()

    # the value at n // 2 of each axis, by one range sort of the libraries without a home cell
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), C(a).alias("v")) for a in ("gps_lat", "gps_lon")]))
    loose = g.join(settled, "owner", "left_anti").select("owner", axes.alias("x")).select("owner", "x.axis", "x.v")
    r = E.ranked(loose, C("owner"), C("axis"), C("v"))
    lo = r.groupBy("owner", "axis").agg((F.min("rank") + F.expr("count(*) div 2")).alias("rank"))
    half = r.join(lo, ["owner", "axis", "rank"])
    pick = lambda a: F.max(F.when(C("axis") == a, C("v"))).alias(f"home_{a}")
    middle = half.groupBy("owner").agg(pick("gps_lat"), pick("gps_lon"))
    j = g.join(cells, ["owner", "cy", "cx"], "left").join(settled, "owner", "left").join(middle, "owner", "left")
    near = G.haversine(C("home_gps_lat"), C("home_gps_lon"), C("gps_lat"), C("gps_lon")) <= HOME_KM
    return j.withColumn("home", F.when(C("settled"), C("in_cell").isNotNull()).otherwise(F.coalesce(near, F.lit(False)))).select(*geo.columns, "home")


def trips(photos: DataFrame) -> DataFrame:
    """owner, pos, id, t, lt of located photos away from home, with ``run``: a new one starts after a photo at home or a gap of more than 48 hours. Libraries with fewer than five located photos have none."""
    ensure_checkpoint_dir(photos.sparkSession)
    geo = photos.where("gps_lat is not null and gps_lon is not null").select("owner", "pos", "id", "t", "lt", "day", "gps_lat", "gps_lon")
    geo = settled(geo)
    enough = geo.groupBy("owner").agg(F.count("*").alias("n")).where("n >= 5").select("owner")
    h = settled(home(geo.join(enough, "owner", "left_semi")).select("owner", "pos", "id", "t", "lt", "home"))  # so dealing by range, which samples first, reads it twice, not its joins
    r = R.runs(h, "owner", ["t", "pos"], ["t", "home"], lambda prev, first: first | prev("home") | R.gap_over("t", prev("t"), GAP_SECONDS))
    return r.where("not home").select("owner", "pos", "id", "t", "lt", "run")


def folded(rows: DataFrame) -> DataFrame:
    """rows(owner, g, t, pos, id) that the fold of 60 seconds keeps within each group."""
    firsts = rows.withColumn("k", F.struct("owner", "g")).groupBy("k", "t").agg(F.min_by(F.struct("pos", "id"), "pos").alias("p"))
    kept = S.dedup_anchored(firsts, "k", "t", FOLD_SECONDS)
    return kept.join(firsts, ["k", "t"]).select("k.owner", "k.g", "t", "p.pos", "p.id")


def place_parts(tags: Column) -> Column:
    """The segments below Places of the longest such tag, the first of equal ones."""
    of = F.transform(F.filter(tags, lambda t: F.lower(T.namespace(t)) == "places"), lambda t: F.filter(F.split(t, "/"), lambda s: s != ""))
    longest = F.array_max(F.transform(of, F.size))
    return F.coalesce(F.slice(F.get(F.filter(of, lambda p: F.size(p) == longest), F.lit(0)), F.lit(2), F.lit(1 << 20)), F.array().cast("array<string>"))


def part_depth(kept: DataFrame) -> DataFrame:
    """owner, g, by: 0 where a trip has several countries, else the first depth (1 or 2) at which it has several places, else null."""
    parts = place_parts(C("tags"))
    at = lambda d: F.lower(F.get(C("parts"), F.lit(d)))
    several = kept.withColumn("parts", parts).groupBy("owner", "g").agg(F.countDistinct(F.upper("country")).alias("codes"), *[F.countDistinct(at(d)).alias(f"d{d}") for d in (1, 2)])
    return several.select("owner", "g", F.when(C("codes") >= 2, 0).when(C("d1") >= 2, 1).when(C("d2") >= 2, 2).alias("by"))


def trip_parts(kept: DataFrame) -> DataFrame:
    """owner, g, t, pos, id, label, key, run of the rows of kept(owner, g, t, pos, id, country, tags) that lie in a part of their trip.

    A part is a stretch of photos of one country where the trip has several, else of one place at the first depth at which it has several.
    """
    k = kept.withColumns({"code": F.upper("country"), "parts": place_parts(C("tags"))})
    several = part_depth(kept).where("by is not null")
    by_place = F.when(F.size("parts") > C("by"), F.lower(F.array_join(F.slice("parts", F.lit(1), C("by") + 1), "-")))
    j = k.join(several, ["owner", "g"]).withColumns({"key": F.when(C("by") == 0, F.lower("code")).otherwise(by_place), "label": F.when(C("by") == 0, C("code")).otherwise(F.get(C("parts"), C("by")))})
    j = j.withColumn("of", F.struct("owner", "g")).select("of", "owner", "g", "t", "pos", "id", "label", "key")
    r = R.runs(j, "of", ["t", "pos"], ["key"], lambda prev, first: first | ~prev("key").eqNullSafe(C("key")))
    return r.where("key is not null").drop("of")


def birthdays(photos: DataFrame, contacts: DataFrame, run: Run, days: list[dt.date]) -> DataFrame:
    """owner, g, date_taken, pos, id of the photos of people whose contact has a birthday on one of the days.

    contacts(contact, given, family, month, day). A tag's link decides first, then the contact of the same name, the least id of several.
    """
    tagged = photos.select("owner", "pos", "id", "date_taken", F.explode(F.array_distinct("tags")).alias("path")).where(F.lower(T.namespace(C("path"))) == "people")
    named = F.trim(F.concat_ws(" ", "given", "family"))
    known = contacts.withColumn("name", F.lower(F.when(named == "", "(No name)").otherwise(named)))
    auto = known.groupBy("name").agg(F.min_by(F.struct("contact", "month", "day"), "contact").alias("auto"))
    links = photos.sparkSession.createDataFrame([(k, v) for k, v in run.links.items()] or [("", None)], "path string, linked string").withColumn("has", F.lit(True))
    manual = contacts.select(C("contact").alias("linked"), F.struct("contact", "month", "day").alias("manual"))
    people = tagged.select("path").distinct().where(~C("path").isin(list(run.hidden)))
    people = people.join(F.broadcast(links), "path", "left").join(manual, "linked", "left").join(auto, F.lower(T.display_name(C("path"))) == C("name"), "left")
    people = people.select("path", F.when(C("has"), C("manual")).otherwise(C("auto")).alias("c")).where("c is not null")
    hits = F.array_compact(F.array(*[F.when((C("c.month") == d.month) & (C("c.day") == d.day), F.lit(i)) for i, d in enumerate(days)]))
    some = people.select("path", F.explode(hits).alias("i"))
    # the paths of people with a birthday are a week's share of the contacts; Spark broadcasts them if they are small
    rows = tagged.join(some, "path")
    seen = rows.groupBy("owner", "path").agg(F.min("pos").alias("seen"))
    rows = rows.join(seen, ["owner", "path"])
    return rows.select("owner", _group("birthday", C("path"), C("seen") + C("i") * F.lit(1 << 40)).alias("g"), "date_taken", "pos", "id")


def _scores(kind: Column, years_ago: Column, years: Column, first: Column, last: Column) -> Column:
    days = days_between(first, last)
    milestone = F.when(years_ago >= 10, 45.0).when(years_ago >= 5, 40.0).otherwise(35.0)
    return (
        F.when(kind == "onThisDay", F.lit(50.0) + F.lit(5.0) * years).when(kind == "yearsAgo", milestone).when(kind == "folderEvent", F.lit(10.0) + F.least(days, F.lit(14)))
        .when(kind == "photoDensity", F.lit(8.0)).when(kind == "trip", F.lit(20.0) + F.lit(1.5) * F.greatest(days, F.lit(1))).otherwise(F.lit(100.0))
    )


def _cover(kind: Column, n: Column) -> Column:
    return F.when(kind == "birthday", n - 1).when(kind.isin("folderEvent", "trip"), F.floor(n / 3)).otherwise(F.floor(n / 2))


def _candidates(kept: DataFrame, attributes: DataFrame, run: Run) -> tuple[DataFrame, DataFrame]:
    """(candidates, rows of their photos) of the kept rows of all groups; attributes(owner, pos, lt, country, tags, folder) are those of the photos.

    Columns of candidates: owner, g, part, kind, at, sub, mid, title, n, first, last, score, years_ago.
    """
    kind = C("g.kind")
    month = lambda x: F.date_format(x, "yyyy-MM")
    k = kept.join(attributes.select("owner", "pos", "lt", "country", "tags"), ["owner", "pos"])
    every = k.groupBy("owner", "g").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.max_by("lt", F.struct("t", "pos")).alias("last_lt"), F.min_by("lt", F.struct("t", "pos")).alias("first_lt"), F.countDistinct(F.when(kind == "onThisDay", F.year("lt"))).alias("years"))
    current = F.lit(run.today.strftime("%Y-%m"))
    enough = F.when(kind == "birthday", C("n") >= 1).when(kind.isin("onThisDay", "yearsAgo"), C("n") >= LEAST_CALENDAR).when(kind == "photoDensity", C("n") >= 1).otherwise(C("n") >= LEAST)
    fresh = kind.isin("folderEvent", "trip") & (month("last_lt") == current)
    good = every.where(enough & ~F.coalesce(fresh, F.lit(False)))
    day = F.concat_ws("-", F.year("first_lt"), F.month("first_lt"), F.dayofmonth("first_lt"))
    own_day = F.to_date("g.key")
    busy = F.concat_ws("-", F.year(own_day), F.month(own_day), F.dayofmonth(own_day))
    mid = F.when(kind == "folderEvent", F.concat(F.lit("folder-"), "g.key")).when(kind == "photoDensity", F.concat(F.lit("density-"), busy)).when(kind == "trip", F.concat(F.lit("trip-"), day)).otherwise(F.concat(kind, F.lit("-"), "g.key"))
    title = F.when(kind == "onThisDay", "On this day").when(kind == "yearsAgo", F.concat(F.lit("On this day in "), F.year("first_lt").cast("string"))).when(kind == "folderEvent", T.display_name(C("g.key"))).when(kind == "photoDensity", "A busy day").when(kind == "birthday", F.concat(F.lit("Happy birthday, "), T.display_name(C("g.key"))))
    at = F.when(kind == "trip", F.unix_micros(C("first").cast("timestamp"))).otherwise(C("g.at"))
    score = _scores(kind, C("g.years_ago"), C("years"), C("first"), C("last"))
    names = ["owner", "g", "part", "kind", "at", "sub", "mid", "title", "n", "first", "last", "score", "years_ago"]
    whole = good.select("owner", "g", F.lit("").alias("part"), kind.alias("kind"), at.alias("at"), F.lit(0).cast("long").alias("sub"), mid.alias("mid"), title.alias("title"), "n", "first", "last", score.alias("score"), C("g.years_ago").alias("years_ago"))
    # parts of trips of five days or more
    parents = good.where((kind == "trip") & (days_between(C("first"), C("last")) >= 5)).select("owner", "g", C("n").alias("all"), F.concat(F.lit("subtrip-"), day).alias("pid"), at.alias("at"))
    stretches = trip_parts(k.join(parents.select("owner", "g"), ["owner", "g"], "left_semi")).withColumn("part", C("run").cast("string"))
    p = stretches.groupBy("owner", "g", "part", "run").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.first("key").alias("key"), F.min_by("label", F.struct("t", "pos")).alias("label"))
    days = F.greatest(days_between(C("first"), C("last")), F.lit(1))
    p = p.where((C("n") >= LEAST) & (days >= 2)).join(parents, ["owner", "g"]).where((C("n") < C("all")) & (C("n") <= C("all") * F.lit(0.85)))
    parts = p.select("owner", "g", "part", F.lit("trip").alias("kind"), "at", C("run").alias("sub"), F.concat("pid", F.lit("-"), "key").alias("mid"), C("label").alias("title"), "n", "first", "last", (F.lit(15.0) + F.lit(1.2) * days).alias("score"), F.lit(None).cast("int").alias("years_ago"))
    rows = kept.select("owner", "g", F.lit("").alias("part"), "t", "pos", "id").unionByName(stretches.select("owner", "g", "part", "t", "pos", "id"))
    return whole.select(names).unionByName(parts.select(names)), rows


def _with_undated(kept: DataFrame, born: DataFrame) -> DataFrame:
    """Undated photos of birthdays pass the fold."""
    return kept.unionByName(born.where("date_taken is null").select("owner", "g", C("date_taken").alias("t"), "pos", "id"))


def one_title_per_folder(candidates: DataFrame) -> DataFrame:
    """Of folder events of one title (whatever the case) that with the most photos stays, the first of equal ones."""
    w = Window.partitionBy("owner", "kind", F.lower("title")).orderBy(F.desc("n"), "at", "mid")
    return candidates.withColumn("__r", F.when(C("kind") == "folderEvent", F.row_number().over(w)).otherwise(1)).where("__r = 1").drop("__r")


def select(candidates: DataFrame, run: Run, seen: DataFrame | None = None, surfaced: DataFrame | None = None, most: int = SELECTED) -> DataFrame:
    """The best candidates of each library with ``rank``: by score and the day's jitter, less what was seen or has surfaced of late, one per cluster.

    seen(owner, mid, at) and surfaced(owner, cluster, at), at in UTC. A window holds a library's candidates.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), C("kind"))
    c = one_title_per_folder(candidates)
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(order, "at", "sub", "mid")) - 1)
    c = c.withColumns({"s": C("score") + X.nth_draw(run.seed, C("place"), JITTER), "cluster": X.cluster_key(C("mid"))})
    local = run.now + dt.timedelta(seconds=run.offset_s)
    ago = lambda months, days: F.add_months(F.lit(local.date()), -months).cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(-days)) + F.make_dt_interval(secs=F.lit((local - dt.datetime.combine(local.date(), dt.time())).total_seconds() - run.offset_s))
    for table, key, loss, since in ((seen, "mid", SEEN, ago(6, 0)), (surfaced, "cluster", SURFACED, ago(0, 3))):
        if table is not None:
            hit = table.groupBy("owner", key).agg(F.max("at").alias("__at"))
            c = c.join(hit.select("owner", key, "__at"), ["owner", key], "left").withColumn("s", C("s") - F.when(C("__at") > since, loss).otherwise(0.0)).drop("__at")
    best = c.withColumn("__r", F.row_number().over(Window.partitionBy("owner", "cluster").orderBy(F.desc("s"), "place"))).where("__r = 1").drop("__r")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("s"), "place"))).where(C("rank") <= most).drop("s", "cluster", "place")


def sampled(rows: DataFrame, chosen: DataFrame, most: int = MOST_PHOTOS) -> DataFrame:
    """chosen(owner, g, part, kind, n, ...) with photos (ids in order; of more than ``most``, those at int(i * (n / most))) and cover.

    The cover is moved to the middle of the sample only where the sample lacks it. Places come from a range sort, so a large group stays spread.
    """
    j = rows.join(chosen.select("owner", "g", "part", "kind", "n"), ["owner", "g", "part"])
    r = E.ranked(j, C("owner"), C("g"), C("part"), C("t").asc_nulls_first(), C("pos"))
    lo = r.groupBy("owner", "g", "part").agg(F.min("rank").alias("lo"))
    r = r.join(lo, ["owner", "g", "part"]).withColumn("i", C("rank") - C("lo"))
    step = C("n").cast("double") / F.lit(float(most))
    near = F.ceil(C("i") / step)
    slot = F.get(F.filter(F.array(near - 1, near, near + 1), lambda s: (s >= 0) & (s < most) & (F.floor(s.cast("double") * step) == C("i"))), F.lit(0))
    r = r.withColumns({"slot": F.when(C("n") <= most, C("i")).otherwise(slot), "covers": C("i") == _cover(C("kind"), C("n"))})
    kept = r.where("slot is not null or covers")
    g = kept.groupBy("owner", "g", "part").agg(F.array_sort(F.collect_list(F.when(C("slot").isNotNull(), F.struct("slot", "id")))).alias("s"), F.max(F.when(C("covers"), C("slot"))).alias("at"), F.max(F.when(C("covers"), C("id"))).alias("c"))
    ids = F.transform("s", lambda x: x["id"])
    out = g.select("owner", "g", "part", ids.alias("photos"), F.when(C("at").isNotNull(), C("c")).otherwise(F.get(ids, F.floor(F.size("s") / 2).cast("int"))).alias("cover"))
    return chosen.join(out, ["owner", "g", "part"])


def trip_labels(rows: DataFrame) -> DataFrame:
    """owner, g, part, label: where each trip of rows(owner, g, part, t, pos, country, tags) went.

    A country with at least nine tenths of the photos gives way to the deepest place that all share, if that is below the country; up to three countries are
    named, more are counted; without countries, the deepest shared place.
    """
    by = ["owner", "g", "part"]
    counts = rows.where("country <> ''").groupBy(*by, "country").agg(F.count("*").alias("n"), F.min(F.struct("t", "pos")).alias("seen"))
    named = counts.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("sum"), F.max("n").alias("most"), F.min_by("country", F.struct((-C("n")).alias("o"), "seen")).alias("top"), F.array_sort(F.collect_list(F.struct((-C("n")).alias("o"), "country"))).alias("all"))
    p = rows.withColumn("parts", place_parts(C("tags"))).where("size(parts) > 0")
    level = p.select(*by, F.posexplode("parts").alias("d", "x")).groupBy(*by, "d").agg(F.min(F.lower("x")).alias("lo"), F.max(F.lower("x")).alias("hi"), F.count("*").alias("have"))
    whole = p.groupBy(*by).agg(F.count("*").alias("all_have"), F.min_by("parts", F.struct("t", "pos")).alias("shown"))
    stop = level.join(whole, by).groupBy(*by).agg(F.min(F.when((C("lo") != C("hi")) | (C("have") < C("all_have")), C("d"))).alias("stop"), F.max("d").alias("deep"), F.first("shown").alias("shown"))
    deepest = stop.select(*by, F.coalesce("stop", C("deep") + 1).alias("depth"), F.get(C("shown"), F.coalesce("stop", C("deep") + 1) - 1).alias("leaf"))
    leaf = F.when(C("depth") >= 1, C("leaf"))
    every = F.transform("all", lambda x: x["country"])
    several = F.when(C("k") > 3, F.concat(C("k").cast("string"), F.lit(" countries"))).when(C("k") >= 2, X.join_names(every))
    label = F.when(C("most") / C("sum") >= 0.9, F.when(C("depth") >= 2, leaf).otherwise(C("top"))).otherwise(F.coalesce(several, leaf, C("top")))
    return rows.select(*by).distinct().join(named, by, "left").join(deepest, by, "left").select(*by, label.alias("label"))


def people_suffix(rows: DataFrame, run: Run, most: int = 3) -> DataFrame:
    """owner, g, part, people: the most frequent people of each trip, without oneself and hidden ones, by first names."""
    by = ["owner", "g", "part"]
    p = rows.select(*by, "t", "pos", F.posexplode("tags").alias("i", "path")).where(F.lower(T.namespace(C("path"))) == "people").where(~C("path").isin([*run.hidden, *([run.me] if run.me else [])]))
    n = p.groupBy(*by, "path").agg(F.count("*").alias("n"), F.min(F.struct("t", "pos", "i")).alias("seen")).withColumn("name", T.display_name(C("path")))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.collate("name", "UNICODE_CI_AI"), "seen")
    top = n.withColumn("r", F.row_number().over(w)).where(C("r") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"])
    return top.groupBy(*by).agg(names.alias("names")).select(*by, X.join_names(X.short_names(C("names"))).alias("people"))


def _titled(chosen: DataFrame, rows: DataFrame, attributes: DataFrame, run: Run) -> DataFrame:
    """Trips get their titles; only those that were chosen."""
    by = ["owner", "g", "part"]
    t = rows.join(chosen.where("kind = 'trip'").select(*by), by, "left_semi").join(attributes.select("owner", "pos", "country", "tags"), ["owner", "pos"])
    j = chosen.join(trip_labels(t), by, "left").join(people_suffix(t, run), by, "left")
    place = F.when(C("part") == "", C("label")).otherwise(C("title"))
    return j.withColumn("title", F.when(C("kind") == "trip", X.trip_title(place, C("people"))).otherwise(C("title"))).drop("label", "people")


def _groups(photos: DataFrame, run: Run) -> DataFrame:
    """owner, g, t, pos, id of the photos in each group of today's run, birthdays apart."""
    d = dated(photos)
    current = F.date_trunc("month", "day") == F.lit(run.today.replace(day=1))
    j = d.join(busy_days(d).where(~current), ["owner", "day"], "left")
    density = F.when(C("seen").isNotNull(), _group("photoDensity", C("day"), C("seen")))
    one = F.concat(calendar_groups([run.today]), F.array_compact(F.array(F.when(C("folder").isNotNull(), _group("folderEvent", C("folder"))), density)))
    rows = j.select("owner", F.explode(one).alias("g"), "t", "pos", "id")
    return rows.unionByName(trips(d).select("owner", _group("trip", C("run")).alias("g"), "t", "pos", "id"))


def _attributes(photos: DataFrame) -> DataFrame:
    lt = C("date_taken") + F.make_dt_interval(secs=C("tz_offset_s"))
    return photos.select("owner", "pos", lt.alias("lt"), "country", "tags")


COLUMNS = ["owner", "rank", "mid", "kind", "title", "n", "first", "last", "score", "years_ago", "photos", "cover"]


def generate(photos: DataFrame, run: Run, contacts: DataFrame | None = None, seen: DataFrame | None = None, surfaced: DataFrame | None = None) -> DataFrame:
    """Each library's memories of the day: COLUMNS. ``n`` counts the photos after the fold, ``photos`` holds at most MOST_PHOTOS of them."""
    rows = _groups(photos, run)
    born = None if contacts is None else birthdays(photos, contacts, run, [run.today])
    if born is not None:
        rows = rows.unionByName(born.where("date_taken is not null").select("owner", "g", C("date_taken").alias("t"), "pos", "id"))
    kept = folded(rows)
    kept = settled(kept if born is None else _with_undated(kept, born))
    attributes = _attributes(photos)
    candidates, members = _candidates(kept, attributes, run)
    chosen = settled(select(settled(candidates), run, seen, surfaced))
    return sampled(members, _titled(chosen, members, attributes, run)).select(COLUMNS)


def scheduled(photos: DataFrame, run: Run, contacts: DataFrame | None = None, hidden: tuple[str, ...] = (), days: int = HORIZON) -> DataFrame:
    """The memories of the calendar for the coming days, without selection, with the window (UTC) in which each is valid: valid_from, valid_to and COLUMNS but rank."""
    ahead = [run.today + dt.timedelta(days=i) for i in range(1, days + 1)]
    d = dated(photos)
    some = d.where(F.date_format("day", "MM-dd").isin([x.strftime("%m-%d") for x in ahead]))
    rows = some.select("owner", F.explode(calendar_groups(ahead)).alias("g"), "t", "pos", "id")
    born = None if contacts is None else birthdays(photos, contacts, run, ahead)
    if born is not None:
        rows = rows.unionByName(born.where("date_taken is not null").select("owner", "g", C("date_taken").alias("t"), "pos", "id"))
    kept = folded(rows)
    kept = settled(kept if born is None else _with_undated(kept, born))
    candidates, members = _candidates(kept, _attributes(photos), run)
    chosen = candidates.where(~C("mid").isin(list(hidden))).checkpoint()
    out = sampled(members, chosen)
    i = F.when(C("kind") == "birthday", F.floor(C("g.at") / F.lit(1 << 40))).otherwise(F.floor(C("g.at") / 100))
    start = F.lit(str(dt.datetime.combine(ahead[0], dt.time()) - dt.timedelta(seconds=run.offset_s))).cast("timestamp_ntz") + F.make_dt_interval(days=i.cast("int"))
    return out.select("owner", start.alias("valid_from"), (start + F.make_dt_interval(days=F.lit(1))).alias("valid_to"), *[c for c in COLUMNS if c not in ("owner", "rank")])
