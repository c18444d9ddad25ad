"""Mixed timestamp formats and time zones to one UTC instant per entry.

Every entry gets all its valid readings: both orders of a numeric date, the
wall clock of its station and UTC, every meaning of a zone's letters, both
sides of an autumn hour.  What the station's own sheet says (order, zone) makes
a reading ``TRUST`` times likelier beforehand.  Per source the formats form a
mixture: expectation-maximisation alternates between the posterior of each
reading (its prior, times the weight of its format in the source, times the
likelihood of the delay until the entry was written) and the weights and delays
those posteriors imply.  The most probable reading is taken; where no reading
reaches ``sure`` the entry is marked ambiguous.

Entries whose readings have the same formats, delay classes and priors behave
alike, so the iterations run on counts of such signatures, a small table per
source whatever the number of entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few, staged
from firnline.functions.times import days_j2k_to_us, delta_time_to_us, tai2000_to_utc_us

# fixed values: zone abbreviations and their offsets in minutes; several where the letters are shared
ABBREVIATIONS = {
    "UTC": [0], "GMT": [0], "Z": [0], "WET": [0], "WEST": [60], "BST": [60], "CET": [60], "MEZ": [60], "CEST": [120], "MESZ": [120],
    "EET": [120], "EEST": [180], "MSK": [180], "IST": [330, 120, 60], "JST": [540], "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780],
    "AKST": [-540], "AKDT": [-480], "PST": [-480], "PDT": [-420], "MST": [-420], "MDT": [-360], "CST": [-360, 480], "CDT": [-300], "EST": [-300], "EDT": [-240],
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_TIME = r"[T ]+(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?\s*(Z|[-+]\d{2}:?\d{2}|[-+]\d{2}|[A-Za-z]{2,5})?$"
YEAR_FIRST = r"^(\d{4})([-/.]?)(\d{2})\2(\d{2})" + _TIME
ORDINAL = r"^(\d{4})()-?(\d{3})()" + _TIME
YEAR_LAST = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TIME
NAMED = r"^(\d{1,2})([ -])([A-Za-z]{3})[a-z]*\2(\d{4})" + _TIME
PATTERNS = {"ymd": YEAR_FIRST, "ordinal": ORDINAL, "year_last": YEAR_LAST, "named": NAMED}
DELAY_CLASSES = (60, 600, 3600, 6 * 3600, 86400, 10 * 86400, 100 * 86400)  # upper ends in seconds
ROUNDS = 50  # most rounds; they end when no posterior moves by a thousandth
TRUST = 1e6  # odds of a reading that agrees with the sheet of its station
LIKE_OWN = 10.0  # odds of letters that mean the station's zone in the other half of the year
UNLIKELY = 1e-12  # of an instant behind the writing of its entry
POOLED = 20.0  # entries of all sources that stand beside a source's own delays


def _delay_class(us: Column, written: Column) -> Column:
    d = (written - us) / 1e6
    out = F.when(written.isNull(), F.lit(-2)).when(d < -1, F.lit(-1))
    for i, end in enumerate(DELAY_CLASSES):
        out = out.when(d < end, F.lit(i))
    return out.otherwise(F.lit(len(DELAY_CLASSES)))


def readings(log: DataFrame, stations: DataFrame) -> DataFrame:
    """``(log_id, instrument, written_us, grain_us, r)``: ``r`` holds every valid reading ``(fmt, us, prior)`` of the entry.

    Each text is matched to its form once and taken apart by one replacement;
    no shuffle.  Entries without any reading are left out.
    """
    st = stations.select("station_id", "zone", F.lower("date_order").alias("date_order")).dropDuplicates(["station_id"])
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = lambda ts: F.timestamp_diff("MICROSECOND", epoch, ts)
    t = F.trim(F.regexp_replace("time_text", "[\\u00a0\\ufeff]", " "))
    base = log.where("log_id is not null").select("log_id", "instrument", "station_id", "delta_time", "days_J2k", "Day", "Second", "Micsec", micros(F.col("written_at").cast("timestamp_ntz")).alias("written_us"), t.alias("t"))
    base = base.join(broadcast_if_few(st), "station_id", "left")
    form = F.when(F.coalesce(F.col("t"), F.lit("")) == "", "number").when(F.col("t").rlike(r"^\d{9,19}(\.\d{1,9})?$"), "count")
    for name, pattern in PATTERNS.items():
        form = form.when(F.col("t").rlike(pattern), name)
    keep = ["log_id", "instrument", "written_us", "zone", "date_order"]
    barrier = lambda df, cols, **new: df.select(*cols, F.inline(F.array(F.struct(*[v.alias(k) for k, v in new.items()]))))
    base = barrier(base, [*keep, "t", "delta_time", "days_J2k", "Day", "Second", "Micsec"], form=form.otherwise("none"))
    # the pieces of a calendar text, one replacement per text
    glue = "\u0001".join(f"${i}" for i in (1, 3, 4, 5, 6, 7, 8, 9, 10))
    pieces = F.lit(None).cast("string")
    for name, pattern in PATTERNS.items():
        pieces = F.when(F.col("form") == name, F.regexp_replace("t", pattern, glue)).otherwise(pieces)
    numbers = ["delta_time", "days_J2k", "Day", "Second", "Micsec"]
    base = barrier(base, [*keep, "form", "t", *numbers], p=F.split(pieces, "\u0001", -1))
    base = base.select(*keep, "form", "t", *numbers, *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("a", "b", "c", "h", "mi", "s", "f", "ap", "z"))])

    reading = lambda fmt, us, prior: F.struct(fmt.alias("fmt"), us.cast("bigint").alias("us"), prior.cast("double").alias("prior"))
    sure = F.lit(1.0)
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < 1e12)
    kind = F.when(usable("delta_time"), "delta_time").when(usable("days_J2k"), "days_J2k").when(F.col("Day").isNotNull() & F.col("Second").isNotNull(), "tai")
    us = F.when(kind == "delta_time", delta_time_to_us(F.col("delta_time"))).when(kind == "days_J2k", days_j2k_to_us(F.col("days_J2k")))
    us = us.when(kind == "tai", tai2000_to_utc_us(F.col("Day"), F.col("Second"), F.coalesce("Micsec", F.lit(0))))
    number, number_grain = F.array(reading(kind, us, sure)), F.when(kind == "days_J2k", 10).otherwise(1)

    # counts since 1970: seconds to nanoseconds, told apart by their digits
    whole = F.element_at(F.split("t", r"\.", 2), 1)
    digits = F.length(whole)
    unit = F.when(digits <= 11, 0).when(digits <= 14, 3).when(digits <= 16, 6).otherwise(9)
    frac = F.length("t") - digits - F.when(F.length("t") > digits, 1).otherwise(0)
    us = (F.col("t").try_cast("decimal(38,9)") * F.pow(F.lit(10.0), 6 - unit).cast("decimal(18,3)")).try_cast("decimal(38,6)").try_cast("bigint")
    count, count_grain = F.array(reading(F.concat(F.lit("count"), unit.cast("string")), us, sure)), F.greatest(F.pow(F.lit(10.0), 6 - unit - frac), F.lit(1.0))

    # calendar forms
    num = lambda c: F.col(c).try_cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower("b"))
    order = lambda name, y, m, d, prior: F.struct(F.lit(name).alias("o"), y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"), prior.cast("double").alias("prior"))
    said = lambda o: F.when(F.col("date_order") == o, TRUST).otherwise(1.0)
    orders = (
        F.when(F.col("form") == "ymd", F.array(order("ymd", num("a"), num("b"), num("c"), sure)))
        .when(F.col("form") == "ordinal", F.array(order("ordinal", num("a"), F.lit(1), num("b"), sure)))
        .when(F.col("form") == "named", F.array(order("named", num("c"), month, num("a"), sure)))
        .when(F.col("form") == "year_last", F.array(order("dmy", num("c"), num("b"), num("a"), said("dmy")), order("mdy", num("c"), num("a"), num("b"), said("mdy"))))
    )
    hour = F.when(F.lower("ap") == "pm", num("h") % 12 + 12).when(F.lower("ap") == "am", num("h") % 12).otherwise(num("h"))
    sub = F.rpad(F.col("f"), 6, "0").substr(1, 6).try_cast("bigint")
    clock = (hour.cast("bigint") * 3600 + num("mi").cast("bigint") * 60 + F.coalesce(num("s"), F.lit(0))) * 1_000_000 + F.coalesce(sub, F.lit(0))
    clock = F.when((hour <= 24) & (num("mi") <= 59), clock)
    grain = F.when(F.col("s") == "", 60_000_000).when(F.length("f") == 0, 1_000_000).otherwise(F.greatest(F.pow(F.lit(10.0), 6 - F.length("f")), F.lit(1.0)))
    midnight = lambda o: micros(F.call_function("try_make_timestamp_ntz", o["y"], o["m"], F.when(o["o"] == "ordinal", 1).otherwise(o["d"]), F.lit(0), F.lit(0), F.lit(0))) + F.when(o["o"] == "ordinal", (o["d"].cast("bigint") - 1) * 86_400_000_000).otherwise(0)
    possible = F.filter(orders, lambda o: o["m"].between(1, 12) & o["d"].between(1, 366))
    grain = F.when(F.col("form") == "number", number_grain).when(F.col("form") == "count", count_grain).otherwise(grain).cast("bigint")
    # each branch is evaluated for the rows of its form alone
    plain = F.when(F.col("form") == "number", number).when(F.col("form") == "count", count)
    at = F.transform(possible, lambda o: F.struct(o["o"].alias("o"), (midnight(o) + clock).alias("at"), o["prior"].alias("prior")))
    cal = barrier(base, ["log_id", "instrument", "written_us", "zone"], z=F.upper("z"), grain_us=grain, plain=plain, local=F.filter(at, lambda o: o["at"].isNotNull()))

    # offset written out; letters: every meaning they have; nothing: the wall clock of the station (on both sides of an autumn hour) or UTC
    to_utc = lambda us: micros(F.convert_timezone(F.col("zone"), F.lit("UTC"), F.timestamp_add("MICROSECOND", us, epoch)))
    to_wall = lambda us: micros(F.convert_timezone(F.lit("UTC"), F.col("zone"), F.timestamp_add("MICROSECOND", us, epoch)))
    known = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    off = F.col("z").rlike(r"^[-+]")
    mins = F.substring("z", 2, 2).try_cast("int") * 60 + F.coalesce(F.when(F.length("z") > 3, F.right(F.col("z"), F.lit(2)).try_cast("int")), F.lit(0))
    offs = F.when(~off & (F.col("z") != ""), F.try_element_at(known, F.col("z")))
    u0 = lambda o: F.struct(o["o"].alias("o"), o["at"].alias("at"), F.when(F.col("zone").isNotNull() & ~off, to_utc(o["at"])).alias("u0"), o["prior"].alias("prior"))
    cal = barrier(cal, ["log_id", "instrument", "written_us", "grain_us", "plain", "zone", "z"], mins=F.when(off, F.when(F.col("z").startswith("-"), -mins).otherwise(mins)), offs=offs, local=F.transform("local", u0))
    steps = F.array(*[F.lit(h * 1_800_000_000) for h in (-2, -1, 1, 2)])

    def wall(o: Column) -> Column:
        fold = F.filter(F.transform(steps, lambda h: o["u0"] + h), lambda u: to_wall(u) == o["at"])
        tag = lambda u: F.when(u < o["u0"], "+wall_early").when(u > o["u0"], "+wall_late").otherwise("+wall")
        own = F.transform(F.concat(F.array(o["u0"]), fold), lambda u: reading(F.concat(o["o"], tag(u)), u, o["prior"] * TRUST))
        utc = F.array(reading(F.concat(o["o"], F.lit("+utc")), o["at"], o["prior"]))
        return F.when(o["u0"].isNull(), F.array(reading(F.concat(o["o"], F.lit("+unzoned")), o["at"], o["prior"]))).when(o["u0"] == o["at"], own).otherwise(F.concat(own, utc))

    def lettered(o: Column) -> Column:
        own = F.round((o["at"] - o["u0"]) / 60_000_000).cast("int")
        odds = lambda m: F.when(m == own, TRUST).when(F.abs(m - own) == 60, LIKE_OWN).otherwise(1.0)
        return F.transform("offs", lambda m: reading(F.concat(o["o"], F.lit("+"), F.col("z"), m.cast("string")), o["at"] - m.cast("bigint") * 60_000_000, o["prior"] * odds(m)))

    def signed(o: Column) -> Column:
        return F.array(reading(F.concat(o["o"], F.lit("+offset")), o["at"] - F.col("mins").cast("bigint") * 60_000_000, o["prior"]))

    every = F.flatten(F.transform("local", lambda o: F.when(F.col("mins").isNotNull(), signed(o)).when(F.col("offs").isNotNull(), lettered(o)).otherwise(wall(o))))
    # behind a barrier, or the condition would make all readings a second time
    got = barrier(cal, ["log_id", "instrument", "written_us", "grain_us"], r=F.filter(F.coalesce("plain", F.array_distinct(every)), lambda r: r["us"].isNotNull()))
    return got.where(F.size("r") > 0)


def mixture(entries: list[tuple[list[tuple[str, int, float]], int]], pooled: dict[int, float]) -> list[tuple[int, float]]:
    """(number of the best reading, its posterior) for each kind of entry of one source.

    ``entries`` are ``(readings, how many entries have them)`` with readings
    ``(format, delay class, prior)``; ``pooled`` is the share of each delay
    class among all sources.  Ties go to the first reading.
    """
    ends = (0, *DELAY_CLASSES, 1000 * 86400)
    width = {i: float(ends[i + 1] - ends[i]) for i in range(len(DELAY_CLASSES) + 1)}
    post = [[q / sum(p for *_, p in r) for *_, q in r] for r, _ in entries]
    for _ in range(ROUNDS):
        formats, delays = Counter(), Counter()
        for (r, n), p in zip(entries, post):
            for (fmt, late, _), q in zip(r, p):
                formats[fmt] += n * q
                if late >= 0:
                    delays[late] += n * q
        total = sum(delays.values()) + POOLED

        def like(late: int) -> float:
            if late < 0:
                return 1.0 if late == -2 else UNLIKELY
            return (delays[late] + POOLED * (pooled.get(late, 0.0) + 1e-4)) / total / width[late]

        moved, new = 0.0, []
        for (r, _), p in zip(entries, post):
            q = [prior * (formats[fmt] + 0.5) * like(late) for fmt, late, prior in r]
            q = [x / sum(q) for x in q]
            moved = max(moved, max(abs(x - y) for x, y in zip(p, q)))
            new.append(q)
        post = new
        if moved < 0.001:
            break
    return [(max(range(len(p)), key=lambda i: (p[i], -i)), max(p)) for p in post]


def resolve(log: DataFrame, stations: DataFrame, *, sure: float = 0.9) -> DataFrame:
    """One row per readable entry: ``log_id, instrument, us, fmt, grain_us, posterior, ambiguous``.

    ``us`` is microseconds since 1970 UTC, ``grain_us`` the precision it was
    written in.  Entries that give no instant (null, empty or unreadable text
    and no number) have no row.  An entry of an unknown station or zone is read
    as UTC; a missing ``written_at`` tells nothing.  Repeated rows give a row
    each; entries without instrument form one source.

    Only counts of signatures are shuffled; the verdict on a signature is
    joined back to the entries that have several readings.
    """
    cand = readings(log, stations)
    late = lambda r: _delay_class(r["us"], F.col("written_us"))
    part = lambda r: F.regexp_replace(r["fmt"], "_(early|late)$", "")  # noqa: E731  # one component for both sides of an autumn hour
    sig = F.array_join(F.transform("r", lambda r: F.concat_ws("|", part(r), late(r).cast("string"), r["prior"].cast("string"))), ";")
    cand = staged(cand.select("log_id", "instrument", "grain_us", "r", sig.alias("sig")).withColumn("key", F.xxhash64("sig")), "entries")
    several = F.size("r") > 1
    pick = lambda i: F.get("r", i)
    certain = cand.where(~several).select("log_id", "instrument", pick(F.lit(0))["us"].alias("us"), pick(F.lit(0))["fmt"].alias("fmt"), "grain_us", F.lit(1.0).alias("posterior"), F.lit(False).alias("ambiguous"))
    counts = staged(cand.groupBy("instrument", "key", "sig").agg(F.count("*").alias("n")), "signatures")
    known = counts.where(~F.col("sig").contains(";")).groupBy(F.element_at(F.split("sig", r"\|"), 2).cast("int").alias("late")).agg(F.sum("n").alias("n")).where("late >= 0").collect()  # a row per delay class
    n_known = sum(r.n for r in known) or 1
    pooled = {r.late: r.n / n_known for r in known}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for who, keys, kinds, ns in zip(d.instrument, d["keys"], d.sigs, d.ns):
                told = [[x.split("|") for x in k.split(";")] for k in kinds]
                entries = [([(fmt, int(late), float(prior)) for fmt, late, prior in t], int(n)) for t, n in zip(told, ns)]
                out += [(who, int(k), i, p) for k, e, (i, p) in zip(keys, entries, mixture(entries, pooled)) if len(e[0]) > 1]
            yield pd.DataFrame(out, columns=["instrument", "key", "i", "posterior"])

    # one row per source: its signatures, which are few whatever the number of its entries
    per = counts.groupBy("instrument").agg(F.collect_list(F.struct("key", "sig", "n")).alias("s")).select("instrument", F.col("s.key").alias("keys"), F.col("s.sig").alias("sigs"), F.col("s.n").alias("ns"))
    verdict = staged(per.mapInPandas(judge, "instrument string, key bigint, i int, posterior double"), "verdicts")
    v = broadcast_if_few(verdict.select(F.coalesce("instrument", F.lit("\0")).alias("who"), F.col("key").alias("k"), "i", "posterior"), 200_000)
    open_ = cand.where(several).join(v, (F.coalesce("instrument", F.lit("\0")) == F.col("who")) & (F.col("key") == F.col("k")))
    best = open_.select("log_id", "instrument", pick(F.col("i"))["us"].alias("us"), pick(F.col("i"))["fmt"].alias("fmt"), "grain_us", "posterior", (F.col("posterior") < sure).alias("ambiguous"))
    return certain.unionByName(best)


def within(instants: DataFrame, seconds: float = 1.0) -> DataFrame:
    """``(log_id_a, log_id_b)`` of entries of one instrument at most ``seconds`` apart, a < b.

    Equi-join on (instrument, time bucket): an entry meets its own bucket and
    the next one, so each pair is met once.  Entries of a null instrument pair
    with none.
    """
    w = int(seconds * 1_000_000)
    rows = instants.where("instrument is not null").select("log_id", "instrument", "us", F.floor(F.col("us") / w).alias("k"))
    left = rows.select(F.col("log_id").alias("l"), "instrument", F.col("us").alias("lu"), "k", F.col("k").alias("lk"))
    right = rows.select(F.col("log_id").alias("r"), "instrument", F.col("us").alias("ru"), F.col("k").alias("rk"), F.explode(F.array("k", F.col("k") - 1)).alias("k"))
    pairs = left.join(right, ["instrument", "k"]).where((F.abs(F.col("lu") - F.col("ru")) <= w) & (F.col("l") != F.col("r")))
    pairs = pairs.where((F.col("rk") > F.col("lk")) | (F.col("l") < F.col("r")))
    return pairs.select(F.least("l", "r").alias("log_id_a"), F.greatest("l", "r").alias("log_id_b"))
