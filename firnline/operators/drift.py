"""Schemas that drift between files: rescue-column ingestion and a change report.

``ingest`` enforces a target schema on JSON records: a value of the very kind a
column holds goes into the typed column, everything else (unknown fields, other
kinds, nulls) is kept as JSON in ``rescued``, so that nothing is lost.
``promote`` replays rescued values of approved fields, also under other names
and of other kinds, into typed columns.  ``changes`` reads the ingested table
and compares each file of a stream with the one before it.  ``consistent``
ingests all records into one table and replays the renamed and retyped fields
that ``changes`` found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few, staged
from firnline.operators.ranks import rank_within

# fixed values: names of the value types in a report, by the variant type's first word
KINDS = {"BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "text", "BOOLEAN": "boolean", "ARRAY": "list", "OBJECT": "object"}
NAMES = ("integer", "number", "text", "boolean", "list", "object")
HOLDS = {"integer": ("tinyint", "smallint", "int", "bigint"), "number": ("float", "double"), "text": ("string",), "boolean": ("boolean",), "list": ("array<",)}
COEXIST_SHARE = 0.01  # fields found together in more of their files than this hold different quantities
MAGNITUDE = 0.45  # most distance of mean decimal logarithms of one quantity
LENGTHS = 0.3  # the same of the lengths of lists
MINIMA = 4  # hash minima that compare vocabularies, and as many for the shapes of their words


def _kind(v: Column) -> Column:
    """Kind of a variant; null for JSON null."""
    words = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.try_element_at(words, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def _holds(sql_type: str) -> str:
    for kind, types in HOLDS.items():
        if sql_type.lower().startswith(types):
            return kind
    raise ValueError(f"no kind of JSON value fits {sql_type}")


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.lit(None).cast("map<string,string>")


def ingest(records: DataFrame, target: dict[str, str], *, payload: str = "payload", rescued: str = "rescued") -> DataFrame:
    """Typed columns of ``target`` (name -> SQL type) next to the record's own columns, and ``rescued``.

    A field of the payload becomes the typed column if its value is of the
    kind the column holds (integers, numbers with a fraction, text, booleans,
    lists) and casts; otherwise the column is null and the value stays in
    ``rescued`` (JSON object, null when nothing was rescued), nulls included.
    A payload that repeats a name is rescued whole, one that is no JSON object
    under the key ``_text``.  Columns of the record that clash with a target
    name are kept as ``record_<name>``.
    """
    keep = [F.col(c).alias(f"record_{c}" if c in target or c == rescued else c) for c in records.columns if c != payload]
    m = F.from_json(F.col(payload), "map<string,variant>")
    base = records.select(*keep, m.alias("_m"), F.col(payload).alias("_raw"))
    want = _literal_map({f: _holds(t) for f, t in target.items()})
    once = F.size(F.array_distinct(F.map_keys("_m"))) == F.size("_m")
    # the kind is looked at only where the name is one of the target
    fits = F.when(once, F.map_filter("_m", lambda k, v: F.coalesce(F.try_element_at(want, k) == _kind(v), F.lit(False)))) if target else F.lit(None).cast("map<string,variant>")
    base = base.withColumn("_fits", fits)
    if target:
        # all fitting values are cast in one step, as the fields of one object
        fields = ", ".join(f"`{f}`: {t}" for f, t in target.items())
        base = base.withColumn("_t", F.try_variant_get(F.to_variant_object(F.coalesce("_fits", F.create_map().cast("map<string,variant>"))), "$", f"struct<{fields}>"))
        base = base.select("*", "_t.*").drop("_t")
        held = sum((F.col(f"`{f}`").isNotNull().cast("int") for f in target), F.lit(0))
        # what did not cast after all (a number out of range) is rescued too
        failed = F.filter(F.array(*[F.when(F.col(f"`{f}`").isNull(), F.lit(f)) for f in target]), lambda x: x.isNotNull())
        odd = F.map_filter("_m", lambda k, v: ~F.map_contains_key("_fits", k) | F.array_contains(failed, k))
        rest = F.when(F.col("_fits").isNull(), F.col("_m")).when(held == F.size("_fits"), F.map_filter("_m", lambda k, v: ~F.map_contains_key("_fits", k))).otherwise(odd)
    else:
        rest = F.col("_m")
    typed = base.withColumn("_left", rest)
    whole = F.when(F.col("_m").isNull() & F.col("_raw").isNotNull(), F.to_json(F.create_map(F.lit("_text"), F.col("_raw"))))
    return typed.withColumn(rescued, F.coalesce(whole, F.when(F.size("_left") > 0, F.to_json("_left")))).drop("_m", "_raw", "_fits", "_left")


def promote(df: DataFrame, approved: dict[str, tuple[str, list[str]]], *, rescued: str = "rescued") -> DataFrame:
    """Replay rescued values of approved fields: name -> (SQL type, other names it went by).

    An existing typed value stays; otherwise the first rescued name whose value
    casts (numbers written as text, integers among numbers, anything as text)
    fills it.  Replayed values leave ``rescued``; the others stay as they are.
    """
    out = df.withColumn("_m", F.from_json(F.col(rescued), "map<string,variant>"))
    tries: dict[str, list[tuple[str, Column]]] = {}
    for name, (kind, others) in approved.items():
        got = lambda n: F.try_element_at("_m", F.lit(n))
        value = lambda n, k=kind: F.coalesce(F.try_variant_get(got(n), "$", k), F.try_variant_get(got(n), "$", "string").try_cast(k)) if not k.startswith("array") else F.try_variant_get(got(n), "$", k)
        tries[name] = [(n, value(n)) for n in dict.fromkeys([name, *others])]
    used = []
    for name, (kind, _) in approved.items():
        have = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)
        first = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in tries[name]])
        out = out.withColumn(f"_from_{name}", F.when(have.isNull(), first)).withColumn(f"_new_{name}", F.coalesce(have, *[v for _, v in tries[name]]))
        used.append(F.col(f"`_from_{name}`"))
    left = F.map_filter("_m", lambda k, v: ~F.array_contains(F.coalesce(F.filter(F.array(*used), lambda x: x.isNotNull()), F.array().cast("array<string>")), k)) if used else F.col("_m")
    out = out.withColumn("_left", left).withColumn(rescued, F.when(F.size("_left") > 0, F.to_json("_left")))
    for name in approved:
        out = out.drop(name, f"_from_{name}").withColumnRenamed(f"_new_{name}", name)
    return out.drop("_m", "_left")


_SUMS = ("n", "nn", "sl", "nl", "nc", "sc")
_HASHES = tuple(f"{h}{i}" for h in "hg" for i in range(MINIMA))


def _figures(kind: Column, s: Column, num: Column) -> dict[str, Column]:
    """What adds up over the values of a field: counts, logarithms, list lengths, minima of hashes of words and of their shapes."""
    log = F.log10(F.when(F.abs(num) > 0, F.abs(num)))
    listed = F.when(kind.isin("list", "object"), s)
    text = F.when(kind == "text", s)
    shape = F.regexp_replace(F.regexp_replace(text, r"\d+", "9"), r"\p{L}+", "a")
    out = {"nn": F.count(num), "sl": F.sum(log), "nl": F.count(log), "nc": F.count(listed), "sc": F.sum(F.length(listed) - F.length(F.replace(listed, F.lit(","), F.lit(""))))}
    return out | {f"{h}{i}": F.min(F.xxhash64(F.lit(i), v)) for h, v in (("h", text), ("g", shape)) for i in range(MINIMA)}


def field_profile(ingested: DataFrame, target: dict[str, str], *, rescued: str = "rescued") -> DataFrame:
    """``file_id, key, kind`` (of more than half of the values, else null) and figures of the values that add up.

    Typed columns are aggregated as they are, one row per file, and turned into
    rows per field afterwards; only rescued values are taken apart.
    """
    rows = ingested.where("file_id is not null")
    kinds = {f: _holds(t) for f, t in target.items()}
    numeric = lambda f: F.col(f"`{f}`").try_cast("double") if kinds[f] in ("integer", "number", "text") else F.lit(None).cast("double")
    as_text = lambda f: F.to_json(f"`{f}`") if kinds[f] == "list" else F.col(f"`{f}`").cast("string")
    wanted = {f: {"n": F.count(f"`{f}`")} | {k: v for k, v in _figures(F.lit(kinds[f]), as_text(f), numeric(f)).items() if k in _SUMS or kinds[f] == "text"} for f in target}
    parts = []
    if target:
        wide = rows.groupBy("file_id").agg(*[v.alias(f"{k}_{i}") for i, f in enumerate(target) for k, v in wanted[f].items()])
        value = lambda k, i, f: F.col(f"{k}_{i}") if k in wanted[f] else F.lit(None).cast("bigint")
        named = [F.struct(F.lit(f).alias("key"), F.lit(kinds[f]).alias("kind"), *[value(k, i, f).cast("double" if k == "sl" else "bigint").alias(k) for k in (*_SUMS, *_HASHES)]) for i, f in enumerate(target)]
        parts.append(wide.select("file_id", F.inline(F.array(*named))).where("n > 0"))
    loose = rows.where(F.col(rescued).isNotNull()).select("file_id", F.explode(F.from_json(F.col(rescued), "map<string,variant>")).alias("key", "v")).where("key <> '_text'")
    s = F.try_variant_get("v", "$", "string")
    loose = loose.select("file_id", "key", F.inline(F.array(F.struct(_kind(F.col("v")).alias("kind"), s.alias("s")))))
    # of an object the first number counts, of a text the number it spells
    num = F.when(F.col("kind") == "object", F.regexp_extract("s", r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0)).when(~F.coalesce(F.col("kind").isin("list", "boolean"), F.lit(False)), F.col("s")).try_cast("double")
    loose = loose.groupBy("file_id", "key", "kind").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in _figures(F.col("kind"), F.col("s"), num).items()])
    parts.append(loose.select("file_id", "key", "kind", *[F.col(k).cast("double" if k == "sl" else "bigint") for k in (*_SUMS, *_HASHES)]))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    of = {k: F.sum(F.when(F.col("kind") == k, F.col("n"))) for k in NAMES}
    per = every.groupBy("file_id", "key").agg(
        F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))).alias("n"), *[v.alias(f"n_{k}") for k, v in of.items()], *[F.sum(k).alias(k) for k in _SUMS[1:]], *[F.min(k).alias(k) for k in _HASHES]
    )
    top = F.coalesce(*[F.when(F.col(f"n_{k}") * 2 > F.col("n"), F.lit(k)) for k in NAMES])
    return per.select("file_id", "key", top.alias("kind"), *_SUMS, *_HASHES)


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partners of each file, best score first; a name has one partner, and one that loses it takes the next best."""
    for d in batches:
        out = []
        for file_id, scores, before, after in zip(d.file_id, d.score, d.a, d.b):
            gone, come = set(), set()
            for _, a, b in sorted(zip((-x for x in scores), before, after)):
                if a not in gone and b not in come:
                    gone.add(a)
                    come.add(b)
                    out.append((file_id, a, b))
        yield pd.DataFrame(out, columns=["file_id", "a", "b"])


def changes(ingested: DataFrame, files: DataFrame, target: dict[str, str], *, profile: DataFrame | None = None) -> DataFrame:
    """``(file_id, change, field_before, field_after)`` of each file against the one before it in its stream.

    ``ingested`` is the written result of ``ingest`` with ``target``; it is read
    twice.  Files without
    records are passed over; null payloads and payloads that are no JSON object
    hold no fields.  A field without majority kind in either file is not
    retyped.  A removed and an added field of one file are a rename when they
    practically never occur together anywhere, hold the same kind of value, and
    agree in magnitude, length or vocabulary; names decide between several
    partners.  Empty inputs give an empty result.  ``profile`` is the staged
    ``field_profile`` of the same table, if there is one already.
    """
    prof = profile if profile is not None else staged(field_profile(ingested, target), "profile")
    # one row per file with its fields, next to those of the file before it; ranks keep a hot stream out of one task
    own = prof.groupBy("file_id").agg(F.collect_list(F.struct("key", "kind")).alias("fields"))
    order = files.where("file_id is not null and stream_id is not null").groupBy("file_id").agg(F.min(F.struct("stream_id", "acquired_at")).alias("o")).select("file_id", "o.stream_id", "o.acquired_at")
    seq = rank_within(own.join(order, "file_id"), ["stream_id"], ["acquired_at", "file_id"], "rn")
    seq = staged(seq.select("file_id", "stream_id", "rn", "fields"), "files")
    old = seq.select("stream_id", (F.col("rn") + 1).alias("rn"), F.col("fields").alias("was"))
    pair = seq.join(old, ["stream_id", "rn"])
    keys = lambda c: F.transform(c, lambda f: f["key"])
    kinds = lambda c: F.map_from_arrays(keys(c), F.transform(c, lambda f: f["kind"]))
    pair = pair.select("file_id", F.array_except(keys("was"), keys("fields")).alias("gone"), F.array_except(keys("fields"), keys("was")).alias("come"), "fields", kinds("was").alias("had"))
    new_kind = F.filter("fields", lambda f: f["kind"] != F.try_element_at("had", f["key"]))
    diff = staged(pair.select("file_id", "gone", "come", keys(new_kind).alias("retyped")).where("size(gone) + size(come) + size(retyped) > 0"), "changes")
    both = diff.select("file_id", F.explode("gone").alias("a"), "come").select("file_id", "a", F.explode("come").alias("b"))

    # evidence over all files: how often two names stand together, and what their values look like
    moves = staged(both.groupBy("a", "b").agg(F.count("*").alias("moves")), "moves")
    some = broadcast_if_few(moves.select("a", "b"))
    # names of a file meet the few pairs that moved somewhere; no name is a key of a shuffle
    together = seq.select(F.explode(keys("fields")).alias("a"), keys("fields").alias("names")).join(some, "a").where(F.array_contains("names", F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("both_files"))
    per_name = staged(prof.groupBy("key").agg(F.count("*").alias("files"), *[F.sum(k).alias(k) for k in _SUMS], *[F.min(k).alias(k) for k in _HASHES]), "names")
    na = per_name.select(F.col("key").alias("a"), F.struct("*").alias("x"))
    nb = per_name.select(F.col("key").alias("b"), F.struct("*").alias("y"))
    ev = moves.join(together, ["a", "b"], "left").join(na, "a").join(nb, "b")
    apart = F.coalesce("both_files", F.lit(0)) <= COEXIST_SHARE * F.least("x.files", "y.files")
    share = lambda s, k: F.coalesce(F.col(f"{s}.{k}"), F.lit(0)) / F.greatest(F.col(f"{s}.n"), F.lit(1))
    mean = lambda s: F.col(f"{s}.sl") / F.nullif(F.col(f"{s}.nl"), F.lit(0))
    size = lambda s: F.log10(1 + F.col(f"{s}.sc") / F.nullif(F.col(f"{s}.nc"), F.lit(0)))
    numeric = (share("x", "nn") > 0.5) & (share("y", "nn") > 0.5)
    listed = (F.coalesce(F.col("x.sc"), F.lit(0)) > 0) & (F.coalesce(F.col("y.sc"), F.lit(0)) > 0)
    texts = ~numeric & ~listed & (share("x", "nn") <= 0.5) & (share("y", "nn") <= 0.5)
    same = lambda h: sum((F.col(f"x.{h}{i}") == F.col(f"y.{h}{i}")).cast("int") for i in range(MINIMA)) / MINIMA
    vocab = F.greatest(F.coalesce(same("h"), F.lit(0.0)), 0.5 * F.coalesce(same("g"), F.lit(0.0)))
    far, longer = F.abs(mean("x") - mean("y")), F.abs(size("x") - size("y"))
    like = F.when(numeric, F.when(far <= MAGNITUDE, 1 - far)).when(listed, F.when(longer <= LENGTHS, 1 - longer)).when(texts & (vocab > 0), vocab)
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    name = 1 - F.levenshtein(norm(F.col("a")), norm(F.col("b"))) / F.greatest(F.length(norm(F.col("a"))), F.length(norm(F.col("b"))), F.lit(1))
    ev = ev.where(apart & like.isNotNull()).select("a", "b", (like + name + F.least(F.log1p("moves") / 5, F.lit(0.6))).alias("score"))
    cand = both.join(broadcast_if_few(staged(ev, "evidence")), ["a", "b"]).groupBy("file_id").agg(F.collect_list(F.struct("score", "a", "b")).alias("c"))  # names of one file
    ren = staged(cand.select("file_id", "c.score", "c.a", "c.b").mapInPandas(_matched, "file_id bigint, a string, b string"), "renames")

    empty = F.lit("")
    out = ren.select("file_id", F.lit("renamed").alias("change"), F.col("a").alias("field_before"), F.col("b").alias("field_after"))
    taken = ren.groupBy("file_id").agg(F.collect_list("a").alias("left"), F.collect_list("b").alias("joined"))
    rest = diff.join(taken, "file_id", "left")
    none = F.array().cast("array<string>")
    line = lambda change, names, before: F.transform(names, lambda k: F.struct(F.lit(change).alias("change"), (k if before else empty).alias("field_before"), (k if not before else empty).alias("field_after")))
    retyped = F.transform("retyped", lambda k: F.struct(F.lit("retyped").alias("change"), k.alias("field_before"), k.alias("field_after")))
    lines = F.concat(line("removed", F.array_except("gone", F.coalesce("left", none)), True), line("added", F.array_except("come", F.coalesce("joined", none)), False), retyped)
    return out.unionByName(rest.select("file_id", F.inline(lines)))


def families(counts: list[tuple[str, str | None, int]], renames: list[tuple[str, str]], taken: list[str]) -> dict[str, tuple[str, list[str]]]:
    """Column -> (SQL type, names it went by), from ``(name, kind, values)`` and pairs of names of one quantity.

    A column bears the name most values stand under and the type of its
    commonest kind; integers with numbers beside them are doubles, and lists
    and objects are JSON text.  Names Spark cannot tell apart, or that
    ``taken`` holds, get a number.
    """
    root = {n: n for n, _, _ in counts}

    def top(n: str) -> str:
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in sorted(renames):
        root[max(top(a), top(b))] = min(top(a), top(b))
    per_name: dict[str, dict[str, int]] = {}
    per_kind: dict[str, dict[str, int]] = {}
    for name, kind, n in counts:
        names = per_name.setdefault(top(name), {})
        names[name] = names.get(name, 0) + n
        if kind is not None:
            kinds = per_kind.setdefault(top(name), {})
            kinds[kind] = kinds.get(kind, 0) + n
    out, used = {}, {t.lower() for t in taken}
    for r in sorted(per_name, key=lambda r: (-sum(per_name[r].values()), r)):
        names = sorted(per_name[r], key=lambda n: (-per_name[r][n], n))
        kinds = per_kind.get(r, {})
        kind = min(kinds, key=lambda k: (-kinds[k], k)) if kinds else "text"
        if kind == "integer" and "number" in kinds:
            kind = "number"
        column = base = re.sub(r"\W", "_", names[0]) or "_"
        i = 2
        while column.lower() in used:
            column, i = f"{base}_{i}", i + 1
        used.add(column.lower())
        out[column] = ({"integer": "bigint", "number": "double", "boolean": "boolean"}.get(kind, "string"), names)
    return out


def consistent(records: DataFrame, files: DataFrame, target: dict[str, str], *, payload: str = "payload", rescued: str = "rescued", most: int = 500) -> DataFrame:
    """Every record once, in one table: a typed column per quantity under whatever name and kind it stood, and ``rescued``.

    A first ingestion with ``target`` shows which fields there are and which
    were renamed; the records are then ingested into the commonest name and
    kind of each quantity, and the other names and kinds are replayed.  Values
    that do not cast, second values of one quantity in one record and payloads
    that are no JSON object stay in ``rescued``, as do fields beyond the
    ``most`` commonest quantities.  Records of unknown files are kept.
    """
    first = staged(ingest(records, target, payload=payload, rescued=rescued), "ingested")
    prof = staged(field_profile(first.withColumnRenamed("record_file_id", "file_id") if "file_id" in target else first, target, rescued=rescued), "profile")
    renamed = changes(first, files, target, profile=prof).where("change = 'renamed'").select("field_before", "field_after").distinct().collect()  # pairs of names
    counts = prof.groupBy("key", "kind").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).collect()
    fields = families([(r.key, r.kind, r.n) for r in counts], [tuple(r) for r in renamed], [*records.columns, rescued])
    fields = dict(list(fields.items())[:most])
    # a column named like none of its fields is filled by the replay alone
    table = staged(ingest(records, {c: t for c, (t, names) in fields.items() if c in names}, payload=payload, rescued=rescued), "ingested")
    return promote(table, {c: (t, [n for n in names if n != c]) for c, (t, names) in fields.items()}, rescued=rescued)
