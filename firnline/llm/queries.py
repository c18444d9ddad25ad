"""Queries of the llm problems (p4, p8, p9, p10) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from firnline.common import staged, table
from firnline.llm.containers import CAPACITY, fill, filling
from firnline.llm.leaks import find_leaks
from firnline.llm.percentiles import merge, percentiles, sketch
from firnline.llm.spam import find_spam

PROBS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of x, y, z per tile and day of acquired_at, and per tile (day null) joined from the days' sketches."""
    pts = table(spark, sf, "tile_points", ["tile", "acquired_at", "x", "y", "z"])
    long = pts.select("tile", F.to_date("acquired_at").cast("string").alias("day"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in "xyz"])).alias("v"))
    long = long.select("tile", "day", "v.field", "v.value")
    parts = staged(sketch(long, ["tile", "day", "field"], "value"), "part_sketches")
    days = staged(merge(parts, ["tile", "day", "field"]), "day_sketches")
    tiles = merge(days, ["tile", "field"])
    daily = percentiles(days, ["tile", "day", "field"], PROBS)
    whole = percentiles(tiles, ["tile", "field"], PROBS).withColumn("day", F.lit(None).cast("string"))
    return daily.unionByName(whole)


def p4_overall(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each column as a whole, and whether their exact rank lies within the bound of the sketch."""
    pts = table(spark, sf, "tile_points", ["x", "y", "z"])
    long = pts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in "xyz"])).alias("v")).select("v.field", "v.value")
    long = long.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    got = staged(percentiles(merge(staged(sketch(long, ["field"], "value"), "part_sketches"), ["field"]), ["field"], PROBS), "overall")
    probs = F.array(*[F.struct(F.lit(k).alias("percentile"), F.lit(p).alias("p"), F.col(k).alias("q")) for k, p in PROBS.items()])
    asked = got.select("field", "n", "max_rank_error", F.inline(probs))  # seven rows per column
    ranks = long.join(F.broadcast(asked), "field").groupBy("field", "percentile").agg(F.count(F.when(F.col("value") < F.col("q"), 1)).alias("below"), F.count(F.when(F.col("value") <= F.col("q"), 1)).alias("upto"))
    rank = F.ceil(F.col("p") * F.col("n") - 1e-9)
    within = rank.between(F.col("below") + 1 - F.col("max_rank_error"), F.col("upto") + F.col("max_rank_error"))
    return asked.join(ranks, ["field", "percentile"]).select("field", "percentile", "n", within.alias("within_bound"), (F.col("max_rank_error") <= 0.05 * F.col("n")).alias("bound_is_narrow"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return fill(table(spark, sf, "documents", ["doc_id", "text"]))


def p8_filling(spark: SparkSession, sf: str) -> DataFrame:
    return filling(fill(table(spark, sf, "documents", ["doc_id", "text"])))


def p8_layout(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers: every document in them once, none too full, none divided without need, little space unused."""
    placed = staged(fill(table(spark, sf, "documents", ["doc_id", "text"])), "placed")
    docs = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.countDistinct("first_token").alias("starts"))
    docs = docs.agg(F.count("*").alias("documents"), F.min((F.col("pieces") == F.greatest(F.ceil(F.col("tokens") / CAPACITY), F.lit(1))) & (F.col("starts") == F.col("pieces"))).alias("divided_only_if_longer"))
    full = filling(placed).select((F.col("fullest") <= CAPACITY).alias("none_too_full"), (F.col("containers") <= F.ceil(F.col("tokens") / CAPACITY * 1.01) + 1).alias("little_unused"))
    return docs.crossJoin(full)  # one row each


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents", ["doc_id", "text"]), table(spark, sf, "eval_items", ["item_id", "text"]))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_spam(table(spark, sf, "documents", ["doc_id", "text"])).select("doc_id")


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with any stuffed text and the share it takes."""
    return find_spam(table(spark, sf, "documents", ["doc_id", "text"]), threshold=0.0)


def queries() -> dict:
    return {"p4_percentiles": p4_percentiles, "p4_overall": p4_overall, "p8_containers": p8_containers, "p8_filling": p8_filling, "p8_layout": p8_layout, "p9_found": p9_found, "p10_found": p10_found, "p10_shares": p10_shares}


def _said_sql(c: str) -> str:
    """Words of a subtitle text folded in SQL, for texts in Latin script: furniture off, look-alikes to one letter, no other signs."""
    s = f"replace(replace(regexp_replace(lower({c}), '[^\\x00-\\x7f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    number = "[o0-9]{1,3}:[o0-9]{2}(?::[o0-9]{2})?[.,][o0-9]{2,3}"
    for pattern, to in (
        (f"(?m)^(?:[^\\S\\n]*\\d+\\.?[^\\S\\n]*(?:\\n[^\\S\\n]*)?)?{number}[^\\S\\n]*(?:,|\\W{{1,6}})[^\\S\\n]*[o0-9]{{1,3}}:[^\\n]*$", ""),
        ("\\{\\d*\\}\\{\\d*\\}|\\{[^{}\\n]*\\}", " "),
        ("</?[a-z0-9]+(?:\\s[^<>]*)?/?>", " "),
        ("\\[[^\\[\\]\\n]*(?:\\n[^\\[\\]\\n]+){0,3}\\]|\\([^()\\n]*(?:\\n[^()\\n]+){0,3}\\)|\\*[^*\\n]+\\*", " "),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return s


def _folded_sql(said: str) -> str:
    s = f"translate(regexp_replace({said}, '[^a-z0-9\\s|]', '', 'g'), 'l10et5|', 'iiocfs ')"
    return f"replace(replace(replace(replace({s}, 'h', 'ii'), 'm', 'rn'), 'w', 'vv'), 'ss', '')"


def _leaks_sql() -> str:
    """p9 by an equi-join of word runs: every run of twelve words of an item against all runs of as many folded words of a document."""
    heads = "Read the passage and answer the question below[.]|Choose the best continuation of the text[.]|True or false[?]"
    words = lambda e: f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda w: w <> '')"
    fold = _folded_sql(_said_sql("raw"))
    return f"""with item as (select item_id, {words(f"regexp_replace(text, '^\\s*({heads})', '')")} as raws from eval_items),
word as (select item_id, i, {fold} as folded from (select item_id, unnest(list_filter(raws, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) as raw, generate_subscripts(list_filter(raws, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')), 1) as i from item)),
run as (select item_id, string_agg(nullif(folded, ''), ' ') over w as run, count(nullif(folded, '')) over w as k, count(*) over w as n, folded, first_value(folded) over w as head from word window w as (partition by item_id order by i rows 11 preceding)),
pattern as (select distinct item_id, run, k from run where n = 12 and folded <> '' and head <> ''),
said as (select doc_id, {words(_folded_sql(_said_sql('text')))} as ws from documents where text is not null),
gram as (select doc_id, k, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as run from said, (select distinct k from pattern)),
hit as (select distinct doc_id, item_id from gram join pattern using (k, run))
select d.doc_id, h.item_id from (select doc_id from documents) d join hit h using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    # exact percentiles: the sketches hold whole groups of fewer than 4,096 values exactly
    quantiles = ", ".join(f"list_sort(list(v))[greatest(1, ceil({p} * count(*) - 1e-9))::bigint] as {n}" for n, p in PROBS.items())
    one = " union all ".join(f"select tile, strftime(acquired_at, '%Y-%m-%d') as day, '{c}' as field, {c} as v from tile_points where {c} is not null and not isnan({c})" for c in "xyz")
    select = f"count(*)::bigint as n, {quantiles}, 0::bigint as max_rank_error from p"
    probs = ", ".join(f"('{k}')" for k in PROBS)
    overall = f"select field, percentile, count(*)::bigint as n, true as within_bound, true as bound_is_narrow from ({one}), (values {probs}) k(percentile) group by field, percentile".replace("tile, strftime(acquired_at, '%Y-%m-%d') as day, ", "")
    layout = "select count(*)::bigint as documents, true as divided_only_if_longer, true as none_too_full, true as little_unused from documents where doc_id is not null"
    return {"p8_layout": layout, "p9_found": _leaks_sql(), "p4_overall": overall, "p4_percentiles": f"with p as ({one}) select tile, day, field, {select} group by tile, day, field union all select tile, null, field, {select} group by tile, field"}
