"""Quantities recorded in different units: find the unit of every value, convert to one.

Units are named by the value itself, by the record's note or by the source's
header, in many spellings.  The distinct words and phrases of all three are
mapped to a small lexicon: a character n-gram inverted index proposes lexicon
entries, a weighted edit distance verifies them, and the resulting alias
dictionary is joined back to the statements and, through them, to all rows.
What the value states outranks the note, and the note the header; of a header
the narrowest dated statement that covers the day holds.  Texts that contradict
themselves, and values beside a word that is no known unit, stay unresolved.
Values for which nothing is stated get the unit whose distribution of
logarithms, seen in their pass (or, for short passes, their source), fits best
in view of the units of the source's other passes.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.common import broadcast_if_few, staged

# fixed values: public names of units and of the three quantities
UNIT_NAMES = {
    "m": ["m", "metre", "metres", "meter", "meters", "si", "metern"],
    "mm": ["mm", "millimetre", "millimetres", "millimeter", "millimeters"],
    "cm": ["cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter"],
    "ft": ["ft", "feet", "foot"],
    "db": ["db", "decibel", "decibels"],
    "cdb": ["cdb", "centibel"],
    "lin": ["lin", "linear", "linear power", "linear power ratio"],
    "km": ["km", "kilometre", "kilometres", "kilometer", "kilometers"],
    "dm": ["dm", "decimetre", "decimetres", "decimeter", "decimeters"],
    "um": ["um", "µm", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers"],
    "in": ["inch", "inches", "zoll"],
    "yd": ["yd", "yard", "yards"],
}
FIELD_NAMES = {
    "Freeboard": ["fb", "freeboard"],
    "SSHA_interp": ["ssha", "ssh", "ssha_interp", "sea surface height", "sea surface height anomaly"],
    "Sig0_1": ["s0", "sig", "sig0", "sig0_1", "sigma0", "sigma zero", "sigma nought", "backscatter"],
    "*height": ["height", "heights", "length", "lengths"],
}
TO_COMMON = {"m": 1.0, "mm": 0.001, "cm": 0.01, "ft": 0.3048, "db": 1.0, "cdb": 0.01, "km": 1000.0, "dm": 0.1, "um": 1e-6, "in": 0.0254, "yd": 0.9144}
BESIDE_VALUE = {"in": "inch", '"': "inch", "'": "foot", "′": "foot", "″": "inch"}  # spellings that name a unit only beside a value
HEIGHTS = ("Freeboard", "SSHA_interp")
CHOICES = {"Freeboard": ("m", "mm", "cm", "ft"), "SSHA_interp": ("m", "mm", "cm", "ft"), "Sig0_1": ("db", "cdb", "lin")}
STATED = {f: (*c, "km", "dm", "um", "in", "yd") if f in HEIGHTS else c for f, c in CHOICES.items()}  # the rarer ones are never inferred
COMMON = {"Freeboard": "m", "SSHA_interp": "m", "Sig0_1": "db"}
MISSING = ("", "n/a", "na", "nan", "--", "-", "null", "none", "-9999", "-9999.0")
# a number: digits in groups of three with blanks, points, commas or apostrophes between them, or without groups
_GROUPED = r"\d{1,3}(?:[ '\u2019\u202f]\d{3})+(?!\d)(?:[.,]\d+)?|\d{1,3}(?:,\d{3})+\.\d+|\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:,\d{3}){2,}(?![.,\d])|\d{1,3}(?:\.\d{3}){2,}(?![.,\d])"
NUMBER = rf"^\s*([-+\u2212]?(?:{_GROUPED}|\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][-+]?\d+)?)\s*(.*?)\s*$"
GRAM = 3
ONE_DAY = timedelta(days=1)
UNRESOLVED = "unresolved"
ACCEPT = 0.2  # most weighted edit distance per character
EXACT_BELOW = 4  # shorter spellings must match exactly
_TOKEN = re.compile(r"[^\W\d_][\w]*")


# no phrase with more words, or longer by more than the difference an alias may have, can spell an entry
MOST_WORDS = max(e.count(" ") + 1 for names in (UNIT_NAMES, FIELD_NAMES) for es in names.values() for e in es)
LONGEST = max(len(e) for names in (UNIT_NAMES, FIELD_NAMES) for es in names.values() for e in es)
LENGTHS_APART = 3


def spans(text: str, most: int = MOST_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, phrase) of every run of up to ``most`` words, lower case."""
    low = text.lower()
    words = [(m.start(), m.end()) for m in _TOKEN.finditer(low)]
    out = []
    for i in range(len(words)):
        for j in range(i, min(i + most, len(words))):
            if j > i and re.search(r"[^\s_-]", low[words[j - 1][1] : words[j][0]]):
                break
            out.append((words[i][0], words[j][1], " ".join(low[a:b] for a, b in words[i : j + 1])))
    return out


def edit_cost(a: str, b: str) -> float:
    """Weighted edit distance: look-alikes, vowels and doubled or plural letters cost less."""
    close = {frozenset(p) for p in ("o0", "l1", "i1", "il", "ae", "eo", "ei", "rn", "sz", "ck", "uv")}
    prev = [0.0]
    for ch in b:
        prev.append(prev[-1] + (0.5 if ch in "s. _" else 1.0))
    for i, x in enumerate(a, 1):
        cur = [prev[0] + (0.5 if x in "s. _" else 1.0)]
        for j, y in enumerate(b, 1):
            sub = 0.0 if x == y else 0.5 if frozenset((x, y)) in close else 1.0
            drop = 0.5 if (i > 1 and a[i - 2] == x) or x in "s. _" else 1.0
            add = 0.5 if (j > 1 and b[j - 2] == y) or y in "s. _" else 1.0
            best = min(prev[j - 1] + sub, prev[j] + drop, cur[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, 2.0 if i < 2 else best, prev[j - 1] + sub)
            cur.append(best)
        prev = cur
    return prev[-1]


def _grams(c: str) -> str:
    return f"transform(sequence(1, greatest(1, length({c}) + 2 - {GRAM} + 1)), i -> substring(concat('^', {c}, '$'), i, {GRAM}))"


def alias_dictionary(phrases: DataFrame) -> DataFrame:
    """``(phrase, kind, name)`` of distinct phrases that spell a unit or a field of the lexicon."""
    spark = phrases.sparkSession
    lex = [(s, "unit", u) for u, ss in UNIT_NAMES.items() for s in ss] + [(s, "field", f) for f, ss in FIELD_NAMES.items() for s in ss]
    lexicon = spark.createDataFrame(lex, "entry string, kind string, name string")
    index = lexicon.withColumn("g", F.explode(F.expr(_grams("entry"))))
    asked = phrases.select("phrase").distinct().where(F.length("phrase").between(1, LONGEST + LENGTHS_APART))
    hits = asked.withColumn("g", F.explode(F.array_distinct(F.expr(_grams("phrase")))))
    cand = hits.join(F.broadcast(index), "g").groupBy("phrase", "entry", "kind", "name").agg(F.count("*").alias("shared"))
    cand = cand.where(F.abs(F.length("phrase") - F.length("entry")) <= LENGTHS_APART).where(F.col("shared") * 3 >= F.length("entry") - 1)
    # a phrase spells an entry of as many words
    cand = cand.where(F.regexp_count("phrase", F.lit(" ")) == F.regexp_count("entry", F.lit(" ")))
    cost = F.pandas_udf(lambda p, e: pd.Series([edit_cost(a, b) for a, b in zip(p, e)], dtype="float64"), T.DoubleType())
    cand = cand.withColumn("cost", F.when(F.col("phrase") == F.col("entry"), 0.0).otherwise(cost("phrase", "entry")))
    ok = (F.col("cost") == 0) | ((F.length("entry") >= EXACT_BELOW) & (F.col("cost") <= ACCEPT * F.length("entry")))
    return cand.where(ok).groupBy("phrase").agg(F.min_by(F.struct("kind", "name"), F.struct("cost", "name")).alias("m")).select("phrase", "m.kind", "m.name")


_CLAUSE = re.compile(r"[;,]|\s/\s|\.\s+(?=[A-Z])|\n")  # a point ends a clause only before a capital: units are abbreviated too
_FACTOR = re.compile(r"(?<![\w.])x?\s*(1/1000?|0\.0+1|1e-0?[23])(?![\w.]*\d)|\b(hundredths?|thousandths?)\b")
_UNTIL = re.compile(r"\b(?:until|through|bis|up to)\s+(\d{4}-\d\d-\d\d)")
_SINCE = re.compile(r"\b(?:from|since|ab)\s+(\d{4}-\d\d-\d\d)")


def _scaled(unit: str, before: str) -> str:
    """The unit times a factor written ``before`` it (behind the unit named before)."""
    f = _FACTOR.search(before)
    if not f:
        return unit
    small = (f[1] or f[2]).startswith(("1/1000", "0.001", "1e-3", "1e-03", "thousandth"))
    return {("m", True): "mm", ("m", False): "cm", ("db", False): "cdb"}.get((unit, small), unit)


def read_statement(text: str, known: dict[str, tuple[str, str]]) -> list[tuple[str | None, str, str | None, str | None]]:
    """(field or None, unit, first day, last day) a note, header or value suffix states."""
    low = text.lower()
    shown = text if len(text) == len(low) else low
    cuts = [0, *[m.end() for m in _CLAUSE.finditer(shown)], len(low)]
    out: list[tuple[str | None, str, str | None, str | None]] = []
    dated: list[str | None] = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        clause = low[a:b]
        found = [(s, e, known[p]) for s, e, p in spans(clause) if p in known]
        found.sort(key=lambda t: (t[0] - t[1], t[0]))
        took: list[tuple[int, int, tuple[str, str]]] = []
        for s, e, k in found:
            if all(e <= s2 or s >= e2 for s2, e2, _ in took):
                took.append((s, e, k))
        took.sort()
        units, last = [], 0
        for s, e, (kind, n) in took:
            if kind == "unit":
                units.append((s, _scaled(n, clause[last:s])))
                last = e
        fields = [(s, n) for s, _, (kind, n) in took if kind == "field"]
        until, since = _UNTIL.search(clause), _SINCE.search(clause)
        span = (since[1] if since else None, until[1] if until else None)
        if not units:
            continue
        if not fields:
            targets = dated if (until or since) and dated else [None]
            out += [(f, u, *span) for f in targets for u in dict.fromkeys(u for _, u in units)]
            continue
        for i, (s, f) in enumerate(fields):
            end = fields[i + 1][0] if i + 1 < len(fields) else len(clause)
            after = [u for p, u in units if s < p < end]
            before = [u for p, u in units if p < s] if len(fields) == 1 else []
            out += [(f, u, *span) for u in dict.fromkeys(after or before)]  # several units of one field contradict each other
        if until or since:
            dated = [f for _, f in fields]
    return out


def statements(texts: DataFrame) -> DataFrame:
    """``(text, field, unit, first_day, last_day)`` of distinct texts; ``field`` null where none is named."""

    def explode(batches):
        for d in batches:
            rows = [(t, p) for t in d.text for p in {p for _, _, p in spans(t)}]
            yield pd.DataFrame(rows, columns=["text", "phrase"])

    texts = texts.where("text is not null and length(trim(text)) > 0").distinct()
    words = staged(texts.mapInPandas(explode, "text string, phrase string"), "phrases")
    known = words.join(alias_dictionary(words), "phrase").groupBy("text").agg(F.collect_set(F.struct("phrase", "kind", "name")).alias("known"))

    def read(batches):
        for d in batches:
            rows = []
            for t, known in zip(d.text, d.known):
                rows += [(t, *r) for r in read_statement(t, {k["phrase"]: (k["kind"], k["name"]) for k in known})]
            yield pd.DataFrame(rows, columns=["text", "field", "unit", "first_day", "last_day"], dtype=object)

    return staged(known.mapInPandas(read, "text string, field string, unit string, first_day string, last_day string"), "statements")


def _per_field(st: DataFrame) -> DataFrame:
    """``(text, field, said)``: what a text says of each field, generic statements (heights, or no field) where none names it.

    ``said`` is a set of (unit, first_day, last_day).
    """
    told = []
    for f, units in STATED.items():
        rank = F.when(F.col("field") == f, 0).when(F.col("field") == "*height", 1 if f in HEIGHTS else None).when(F.col("field").isNull(), 2)
        told.append(F.struct(F.lit(f).alias("target"), F.when(F.col("unit").isin([*units]), rank).alias("rank")))
    rows = st.select("text", F.struct("unit", "first_day", "last_day").alias("s"), F.inline(F.array(*told))).where("rank is not null")
    sets = rows.groupBy("text", "target", "rank").agg(F.collect_set("s").alias("said"))
    return sets.groupBy("text", "target").agg(F.min_by("said", "rank").alias("said")).withColumnRenamed("target", "field")


def timeline(said: list[tuple[str, str | None, str | None]]) -> list[tuple[str, str, str | None]]:
    """``(first day, day behind the last, unit)`` without overlaps from ``(unit, first day, last day)``.

    Of the statements that cover a day the narrowest holds, so that a dated one
    outranks an undated one; where equally narrow ones differ the unit is None.
    """
    low, high = date.min, date.max

    def day(text: str | None, otherwise: date) -> date:
        try:
            return date.fromisoformat(text) if text else otherwise
        except ValueError:
            return otherwise

    spans_ = [(day(a, low), min(day(b, high), high - ONE_DAY) + ONE_DAY, u) for u, a, b in said]
    edges = sorted({e for a, b, _ in spans_ for e in (a, b)})
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        here = [(q - p, u) for p, q, u in spans_ if p <= a and b <= q]
        if here:
            best = {u for width, u in here if width == min(here)[0]}
            out.append((a.isoformat(), b.isoformat(), best.pop() if len(best) == 1 else None))
    return out


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def _common(unit: str) -> Column:
    """``number`` of the unit in column ``unit`` in metres or dB."""
    ratio = F.when(F.col("number") > 0, 10 * F.log10("number"))
    return F.when(F.col(unit) == "lin", ratio).otherwise(F.col("number") * F.try_element_at(_map(TO_COMMON), F.col(unit)))


def normalise(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per value of Freeboard, SSHA_interp and Sig0_1 that is not missing.

    Columns ``rec_id, field_name, raw, number, unit, stated_by, common`` with
    ``stated_by`` in value / note / source / inferred / unresolved and
    ``common`` in metres or dB (null for a linear ratio that is not positive).
    ``unresolved`` values have neither unit nor ``common``: the text that
    decides names several units, or the value stands beside words that name
    none.  Missing spellings, nulls and texts that hold no number give no row;
    repeated rows count each; a record of an unknown source is judged without
    header, and a source listed twice has the header that sorts first.
    """
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.floor((F.col("Day") * 86400.0 + F.col("Second") - 34) / 86400).cast("int"))
    day = F.coalesce(day, F.date_add(F.lit("2000-01-01").cast("date"), F.floor("days_J2k").cast("int")))
    text = {f: F.trim(F.regexp_replace(F.col(f), "[\\u00a0\\s]+", " ")) for f in CHOICES}
    long = records.select(
        "rec_id", "source_id", "abs_orbit", day.cast("string").alias("day"), "note", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), t.alias("raw")) for f, t in text.items()])).alias("v")
    ).select("rec_id", "source_id", "abs_orbit", "day", "note", "v.field", "v.raw")
    long = long.where(F.col("raw").isNotNull() & ~F.lower("raw").isin(*MISSING))
    bare = F.col("raw").rlike(r"^[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?$")  # most values
    digits = F.regexp_extract("raw", NUMBER, 1)
    grouped = digits.rlike(rf"^[-+\u2212]?(?:{_GROUPED})(?:[eE]|$)")
    # the last of several kinds of sign is the decimal one; one kind alone, repeated, only groups
    whole = F.regexp_replace(digits, r"[ '\u2019\u202f]", "")
    lone = whole.rlike(r"^[^.,]*[.,]\d*(?:[eE].*)?$")
    grouped_text = F.when(lone, F.regexp_replace(whole, ",", ".")).when(whole.rlike(r",.*\."), F.regexp_replace(whole, ",", "")).when(whole.rlike(r"\..*,"), F.regexp_replace(F.regexp_replace(whole, r"\.", ""), ",", "."))
    grouped_text = grouped_text.otherwise(F.regexp_replace(whole, "[.,]", ""))
    num = F.when(bare, F.col("raw")).otherwise(F.regexp_replace(F.when(grouped, grouped_text).otherwise(F.regexp_replace(digits, ",", ".")), "\u2212", "-")).try_cast("double")
    beside = _map_text(BESIDE_VALUE)
    suffix = F.regexp_extract("raw", NUMBER, 2)
    suffix = F.when(bare, "").otherwise(F.coalesce(F.try_element_at(beside, F.lower(suffix)), suffix))
    long = long.withColumns({"number": num, "suffix": suffix}).where("number is not null and number <> -9999")
    long = staged(long, "values")

    texts = long.select(F.explode(F.array("suffix", "note")).alias("text")).unionByName(sources.select(F.col("header_text").alias("text")))
    st = staged(_per_field(statements(texts)), "units")
    # a value or note without dates: its one unit, or null where it names several
    plain = st.withColumn("u", F.array_distinct(F.transform("said", lambda s: s["unit"]))).where(~F.exists("said", lambda s: s["first_day"].isNotNull() | s["last_day"].isNotNull()))
    plain = plain.select("text", "field", F.when(F.size("u") == 1, F.get("u", F.lit(0))).otherwise(UNRESOLVED).alias("u"))
    by_value = broadcast_if_few(plain.select(F.col("text").alias("suffix"), "field", F.col("u").alias("u_value")))
    by_note = broadcast_if_few(plain.select(F.col("text").alias("note_key"), "field", F.col("u").alias("u_note")))

    def lines(batches):
        for d in batches:
            rows = [(i, f, *t) for i, f, said in zip(d.source_id, d.field, d.said) for t in timeline([(x["unit"], x["first_day"], x["last_day"]) for x in said])]
            yield pd.DataFrame(rows, columns=["source_id", "field", "d0", "d1", "u_source"], dtype=object)

    head = sources.groupBy("source_id").agg(F.min("header_text").alias("text")).join(st, "text").select("source_id", "field", "said")
    head = head.mapInPandas(lines, f"source_id {dict(sources.dtypes)['source_id']}, field string, d0 string, d1 string, u_source string")
    head = staged(head.select("source_id", "field", "d0", "d1", F.coalesce("u_source", F.lit(UNRESOLVED)).alias("u_source")), "headers")

    # values without note get keys that match nothing and spread evenly
    key = F.coalesce("note", F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("rec_id"), F.lit(512)).cast("string")))
    rows = long.withColumn("note_key", key).join(by_value, ["suffix", "field"], "left").join(by_note, ["note_key", "field"], "left")
    # one header row per source, field and day at most: the spans of a timeline do not overlap
    h = broadcast_if_few(head).alias("h")
    # a record of unknown day has the header's unit only if that never changed
    day_fits = F.when(F.col("r.day").isNull(), (F.col("h.d0") == date.min.isoformat()) & (F.col("h.d1") == date.max.isoformat())).otherwise((F.col("r.day") >= F.col("h.d0")) & (F.col("r.day") < F.col("h.d1")))
    on = (F.col("r.source_id") == F.col("h.source_id")) & (F.col("r.field") == F.col("h.field")) & day_fits
    rows = rows.alias("r").join(h, on, "left")
    rows = rows.select("r.rec_id", "r.source_id", "r.abs_orbit", "r.field", "r.raw", "r.number", "suffix", "u_value", "u_note", "u_source")
    # words beside a value that name no unit of its field
    odd = F.col("u_value").isNull() & F.col("suffix").rlike(r"\p{L}")
    stated = F.when(odd, UNRESOLVED).otherwise(F.coalesce("u_value", "u_note", "u_source"))
    rows = staged(rows.withColumn("stated", stated).drop("suffix"), "stated")

    unknown = staged(_inferred(rows), "inferred")
    rows = rows.join(broadcast_if_few(unknown), ["source_id", "abs_orbit", "field"], "left")
    default = F.when(F.col("field").isin(*HEIGHTS), "m").otherwise("db")
    unit = F.nullif(F.coalesce("stated", "guess", default), F.lit(UNRESOLVED))
    by = F.when(F.col("stated") == UNRESOLVED, UNRESOLVED).when(F.col("u_value").isNotNull(), "value").when(F.col("u_note").isNotNull(), "note").when(F.col("u_source").isNotNull(), "source").otherwise("inferred")
    rows = rows.withColumns({"unit": unit, "stated_by": by}).withColumn("common", _common("unit"))
    return rows.select("rec_id", F.col("field").alias("field_name"), "raw", "number", "unit", "stated_by", "common")


def _map_text(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _inferred(rows: DataFrame, least: int = 8) -> DataFrame:
    """``(source_id, abs_orbit, field, guess)`` for passes with values of no stated unit.

    The reference distribution of each field is that of all stated values in
    the common unit; another unit only shifts its logarithms, and a power
    ratio has a tenth of the decibels as logarithm.
    """
    log = lambda c: F.log10(F.when(F.abs(c) > 0, F.abs(c)))
    said = F.col("stated").isNotNull()
    parts = {"l": F.when(~said, log(F.col("number"))), "c": F.when(said, _common("stated"))}
    parts["k"] = log(parts["c"])
    # one pass: counts, sums and sums of squares of what is open, stated, and the logarithm of what is stated
    sums = rows.select("source_id", "abs_orbit", "field", *[v.alias(k) for k, v in parts.items()]).groupBy("source_id", "abs_orbit", "field")
    sums = staged(sums.agg(*[f.alias(k + n) for k in parts for n, f in (("n", F.count(k)), ("s", F.sum(k)), ("q", F.sum(F.col(k) * F.col(k))))]), "passes")
    mean = lambda k: F.sum(f"{k}s") / F.nullif(F.sum(f"{k}n"), F.lit(0))
    dev = lambda k: F.sqrt(F.greatest(F.sum(f"{k}q") / F.nullif(F.sum(f"{k}n"), F.lit(0)) - mean(k) * mean(k), F.lit(0.0)))
    # how far the mean and the deviation of a stated pass ordinarily lie from those of all
    own = lambda k: F.when(F.col(f"{k}n") >= least, F.col(f"{k}s") / F.col(f"{k}n"))
    spread = lambda k: F.when(F.col(f"{k}n") >= least, F.sqrt(F.greatest(F.col(f"{k}q") / F.col(f"{k}n") - own(k) * own(k), F.lit(0.0))))
    wide = lambda c: F.greatest(F.coalesce(F.stddev(c), F.lit(0.1)), F.lit(0.01))
    figures = {"lm": mean("k"), "ls": dev("k"), "cm": mean("c"), "cs": dev("c"), "lmw": wide(own("k")), "lsw": wide(spread("k")), "cmw": wide(own("c") / 10), "csw": wide(spread("c") / 10)}
    ref = sums.groupBy("field").agg(*[v.alias(k) for k, v in figures.items()]).where("lm is not null")
    known = F.create_map(*[x for f, units in CHOICES.items() for x in (F.lit(f), F.array(*[F.lit(u) for u in units]))])
    ref = ref.withColumn("u", F.explode(known[F.col("field")]))
    lin = F.col("u") == "lin"
    factor = F.try_element_at(_map(TO_COMMON), F.col("u"))
    pick = lambda a, b: F.when(lin, a).otherwise(b)
    ref = ref.select("field", "u", pick(F.col("cm") / 10, F.col("lm") - F.log10(factor)).alias("rm"), pick(F.col("cs") / 10, F.col("ls")).alias("rs"), pick(F.col("cmw"), F.col("lmw")).alias("mw"), pick(F.col("csw"), F.col("lsw")).alias("sw"))
    sums = sums.where("ln > 0").select("source_id", "abs_orbit", "field", F.col("ln").alias("n"), F.col("ls").alias("s"), F.col("lq").alias("q"))
    whole = sums.groupBy("source_id", "field").agg(F.sum("n").alias("wn"), F.sum("s").alias("ws"), F.sum("q").alias("wq"))
    own_ = sums.join(whole, ["source_id", "field"])
    few = F.col("n") < least
    n = F.greatest(F.when(few, F.col("wn")).otherwise(F.col("n")), F.lit(1))
    m = F.when(few, F.col("ws")).otherwise(F.col("s")) / n
    sd = F.sqrt(F.greatest(F.when(few, F.col("wq")).otherwise(F.col("q")) / n - m * m, F.lit(0.0)))
    fit = own_.withColumns({"m": m, "sd": sd}).join(F.broadcast(ref), "field")  # one row per field and unit
    # twice the negative logarithm of a Student likelihood of three degrees of freedom: a few spikes do not decide
    far = lambda v, r, w: 4 * F.log1p(F.pow((F.col(v) - F.col(r)) / F.col(w), 2) / 3)
    fit = fit.withColumn("miss", far("m", "rm", "mw") + far("sd", "rs", "sw"))
    # the units of a source's passes are a mixture: a first reading of all passes gives its weights, which then count in each
    keys = ["source_id", "abs_orbit", "field"]
    fits = staged(fit.groupBy(*keys).agg(F.collect_list(F.struct("miss", "u")).alias("fits")).withColumn("first", F.array_min("fits")["u"]), "fits")
    weight = fits.groupBy("source_id", "field", "first").agg(F.count("*").cast("double").alias("k"))
    counted = lambda df, *by: df.groupBy(*by, "first").agg(F.sum("k").alias("k")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("first", "k"))).alias("w"))
    near, all_ = counted(weight, "source_id", "field"), counted(weight, "field").withColumnRenamed("w", "v")
    judged = fits.join(broadcast_if_few(near), ["source_id", "field"]).join(F.broadcast(all_), "field")  # one row per field
    # a pass does not speak for itself; where its source has few others, the passes of all sources count a little
    count = lambda m, u: F.coalesce(F.try_element_at(F.col(m), u), F.lit(0.0)) - F.when(u == F.col("first"), 1.0).otherwise(0.0)
    n_all = F.greatest(F.aggregate(F.map_values("v"), F.lit(0.0), lambda a, x: a + x) - 1, F.lit(1.0))
    total = lambda f: f["miss"] - 2 * F.log(F.greatest(count("w", f["u"]) + count("v", f["u"]) / n_all, F.lit(0.02)))
    best = F.array_min(F.transform("fits", lambda f: F.struct(total(f).alias("miss"), f["u"].alias("u"))))
    return judged.select(*keys, best["u"].alias("guess"))
