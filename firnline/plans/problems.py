"""Queries of the general data problems (p1, p2, p3, p5, p6, p7) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.common import scratch, staged, table
from firnline.functions import geodesy, times
from firnline.operators.drift import changes, consistent, ingest
from firnline.operators.instants import resolve, within
from firnline.operators.nearby import points_in_sites
from firnline.operators.spikes import flag_all, readings
from firnline.operators.units import COMMON, normalise
from firnline.streaming.compaction import compact_files, fingerprinted, repeated, settled

# fixed values: fills of the products, and what an instrument on Earth can report
FILL = 3.4028235e38
FILL_F32 = 3.4028234663852886e38
NO_DATA = -9999.0
HEIGHT_M = (-500.0, 9000.0)
PEAKINESS = (0.0, 1000.0)


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value in its common unit, with the unit it came in and who stated it."""
    cols = ["rec_id", "source_id", "abs_orbit", "Day", "Second", "days_J2k", "note", "Freeboard", "SSHA_interp", "Sig0_1"]
    got = normalise(table(spark, sf, "cs2_records", cols), table(spark, sf, "cs2_sources"))
    return got.withColumn("common", F.round(F.col("common").cast("decimal(30,12)"), 6).cast("double") + 0.0)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    common = F.create_map(*[F.lit(x) for kv in COMMON.items() for x in kv])
    return p1_values(spark, sf).where(F.col("unit") != common[F.col("field_name")]).select("rec_id", "field_name", "unit")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "atl06_segments", ["point_id", "epsg", "x", "y", "latitude", "longitude"])
    return points_in_sites(points, table(spark, sf, "survey_sites"))


def p5_instants(spark: SparkSession, sf: str) -> DataFrame:
    """One UTC instant per entry, how it was read and how sure that is."""
    got = resolve(table(spark, sf, "time_log"), table(spark, sf, "stations"))
    utc = F.timestamp_add("MICROSECOND", F.col("us"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return got.select("log_id", "instrument", utc.alias("instant_utc"), "us", "ambiguous")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return within(resolve(table(spark, sf, "time_log"), table(spark, sf, "stations")))


def p6_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every flagged reading with its reason."""
    atl = table(spark, sf, "atl06_segments", ["point_id", "rgt", "cycle_number", "beam", "delta_time", "segment_id", "h_li"])
    cs2 = table(spark, sf, "cs2_records", ["rec_id", "source_id", "abs_orbit", "rec_seq", "Elev_1", "Peakiness"])
    fills = (FILL, FILL_F32, NO_DATA)
    base = readings(atl, row_id="point_id", value="h_li", source=["rgt", "beam"], within=["cycle_number"], order=["delta_time", "segment_id"], fills=fills)
    for field in ("Elev_1", "Peakiness"):
        base = base.unionByName(readings(cs2, row_id="rec_id", value=field, source=["source_id"], within=["abs_orbit"], order=["rec_seq"], fills=fills))
    found = flag_all(base, {"h_li": HEIGHT_M, "Elev_1": HEIGHT_M, "Peakiness": PEAKINESS})
    return found.select(F.col("rid").alias("row_id"), F.col("field").alias("field_name"), "reason")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_flags(spark, sf).select("row_id", "field_name")


def p6_runs_and_limits(spark: SparkSession, sf: str) -> DataFrame:
    """The cases that need no model: stuck runs and impossible readings."""
    return p6_flags(spark, sf).where("reason <> 'spike'")


# fields of the products as their first files have them
TARGET = {
    "segment_id": "bigint", "delta_time": "double", "h_li": "double", "latitude": "double", "longitude": "double", "rgt": "bigint", "sigma_geo_r": "double", "n_fit_photons": "bigint",
    "atl06_quality_summary": "bigint", "Day": "bigint", "Second": "bigint", "Micsec": "bigint", "Lat": "double", "Lon": "double", "Elev_1": "double", "Peakiness": "double", "N_avg": "bigint",
    "Corrections_flag": "bigint", "Linear_Wfm_Multiplier": "bigint", "Waveform": "array<bigint>",
}


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of the fields, read from the table that rescue-column ingestion makes of all records."""
    records = staged(ingest(table(spark, sf, "raw_records", ["file_id", "payload"]), TARGET), "ingested")
    return changes(records, table(spark, sf, "granule_files", ["file_id", "stream_id", "acquired_at"]), TARGET)


def p3_table(spark: SparkSession, sf: str) -> DataFrame:
    """All raw records in one table, renamed and retyped fields under one name and type."""
    return consistent(table(spark, sf, "raw_records"), table(spark, sf, "granule_files", ["file_id", "stream_id", "acquired_at"]), TARGET)


def p3_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Steady fields and two renamed and retyped quantities of the consistent table."""
    t = p3_table(spark, sf)
    return t.select("rec_id", "file_id", "rec_no", "Day", "Second", "Micsec", "segment_id", "rgt", F.col("Peakiness").alias("peakiness"), F.col("N_avg").alias("n_avg"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "granule_files", ["file_id", "stream_id"])


def _compacted(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "raw_records").schema
    work = scratch(spark, "compaction")
    # a glob, so that a table of one file and a table of many are both taken
    return compact_files(spark, f"{sf}/raw_records.parque[t]", schema, f"{work}/table", f"{work}/log", prepare=fingerprinted)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated(_compacted(spark, sf), _files(spark, sf))


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    """The consolidated records, each content of a stream once."""
    return settled(_compacted(spark, sf), _files(spark, sf)).select("rec_id", "file_id", "rec_no", "stream_id", "payload")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_values": p1_values, "p3_found": p3_found, "p3_table": p3_table, "p3_quantities": p3_quantities, "p7_found": p7_found, "p7_records": p7_records, "p2_found": p2_found, "p5_found": p5_found, "p5_instants": p5_instants, "p6_found": p6_found, "p6_flags": p6_flags, "p6_runs_and_limits": p6_runs_and_limits}


def _projected(lat: str, lon: str) -> tuple[str, str]:
    """x and y of the polar stereographic projection of column ``epsg`` in SQL."""
    e = repr(geodesy.WGS84_E)
    sign = "case epsg when 3413 then 1.0 when 3031 then -1.0 end"
    p = f"radians({lat} * ({sign}))"
    rho = f"(case epsg when 3413 then {geodesy._rho_scale(70.0)!r} when 3031 then {geodesy._rho_scale(71.0)!r} end) * tan(pi() / 4 - {p} / 2) / power((1 - {e} * sin({p})) / (1 + {e} * sin({p})), {e} / 2)"
    d = f"radians({lon} - (case epsg when 3413 then -45.0 when 3031 then 0.0 end))"
    return f"{rho} * sin({d})", f"-({sign}) * {rho} * cos({d})"


def _units_sql(every: bool = False) -> str:
    """p1 by plain pattern matching: every spelling of the test tables, headers by their wording, the rest by pass medians."""
    names = {"m": "'m','meter','metres'", "mm": "'mm','millimetres'", "cm": "'cm','centimetre'", "ft": "'ft','feet'", "db": "'db','decibel'", "cdb": "'cdb','1/100 db','x0.01 db'", "lin": "'lin','linear'"}
    unit = lambda e: "case " + " ".join(f"when lower(trim({e}, ' .()')) in ({v}) then '{k}'" for k, v in names.items()) + " end"
    first = lambda *p: "coalesce(" + ", ".join(f"nullif(regexp_extract(note, '{q}', 1), '')" for q in p) + ")"
    note = {
        "Freeboard": first("FB=([^ ]+)", "fb ([^,]+),", "^([^ ]+) for freeboard", "Freeboard in (.+?) /"),
        "SSHA_interp": first("SSH=([^ ]+)", "ssha ([^,;]+), s0", "([^ ]+) for ssha", "SSHA in (.+?) /"),
        "Sig0_1": first("SIG=(.+)$", "s0 (.+)$", "backscatter (.+)$", "sigma0 (.+)$"),
    }
    mm = "h like 'packed units%' or h like 'scale_factor 0.001%' or h like 'Heights in millimetres%' or (h like 'until 2014-06-30 heights in mm%' and day <= '2014-06-30')"
    metre = "h like '%[m]%' or h like '%metres%' or h like '%=m%' or h like '%meters%' or h like '%SI%' or h like '%(m)%' or h like '%unit m%' or h like '%in m%' or h like 'heights m%'"
    head = {
        "Freeboard": f"case when {mm} or h like 'Freeboard (mm)%' then 'mm' when h like 'lengths in cm%' then 'cm' when h like 'freeboard in feet%' then 'ft' when {metre} then 'm' end",
        "SSHA_interp": f"case when {mm} then 'mm' when h like 'lengths in cm%' then 'cm' when {metre} then 'm' end",
        "Sig0_1": "case when h like '%1e-2 dB%' or h like '%0.01 to Sig0_1%' or h like '%hundredths%' then 'cdb' when h like '%linear power%' then 'lin' when h like '%dB%' or h like '%decibel%' then 'db' end",
    }
    guess = {
        "Freeboard": "case when med > 100 then 'mm' when med > 8 then 'cm' when med > 0.7 then 'ft' else 'm' end",
        "SSHA_interp": "case when med > 35 then 'mm' when med > 3 then 'cm' when med > 0.23 then 'ft' else 'm' end",
        "Sig0_1": "case when med > 100 then 'cdb' else 'db' end",
    }
    parts = []
    for f in COMMON:
        parts.append(
            f"""select rec_id, '{f}' as field_name, coalesce(uv, un, uh, {guess[f]}) as unit, trim(regexp_replace({f}, '[\\s\\x{{00a0}}]+', ' ', 'g')) as raw, v as number, case when uv is not null then 'value' when un is not null then 'note' when uh is not null then 'source' else 'inferred' end as stated_by from (select *, median(abs(v)) filter (coalesce(uv, un, uh) is null) over (partition by source_id, abs_orbit) as med
from (select rec_id, source_id, abs_orbit, {f}, v, {unit('suffix')} as uv, {unit(note[f])} as un, {head[f]} as uh from (select rec_id, source_id, abs_orbit, {f}, note, header_text as h, (date '2000-01-01' + floor((Day * 86400.0 + Second - 34) / 86400)::integer)::date::varchar as day,
try_cast(replace(regexp_extract({f}, '^[ ]*([-+]?[0-9.,]+([eE][-+]?[0-9]+)?)', 1), ',', '.') as double) as v, regexp_replace({f}, '^[ ]*[-+]?[0-9.,]+([eE][-+]?[0-9]+)?[ ]*', '') as suffix
from cs2_records left join cs2_sources using (source_id) where {f} is not null and lower(trim({f})) not in ('', 'n/a', 'nan', '--')) where v is not null and v <> -9999))"""
        )
    union = " union all ".join(parts)
    if not every:
        return f"select rec_id, field_name, unit from ({union}) where unit <> case field_name when 'Sig0_1' then 'db' else 'm' end"
    factor = "case unit when 'mm' then 0.001::double when 'cm' then 0.01::double when 'ft' then 0.3048::double when 'cdb' then 0.01::double else 1.0::double end"
    return f"select rec_id, field_name, raw, number, unit, stated_by, round(case when unit = 'lin' then case when number > 0 then 10 * log10(number) end else number * {factor} end::decimal(30,12), 6)::double + 0.0 as common from ({union})"


def _instants_sql(every: bool = False) -> str:
    """p5 with one pattern per form of the test tables and the zone tables of the SQL engine."""
    tai = "(Day::bigint * 86400 + Second)"
    leaps = " + ".join(f"(case when {tai} >= {d * 86400 + n} then 1 else 0 end)" for d, n in times.LEAPS_2000)
    local = lambda f, e="t": f"epoch_us(timezone(zone, strptime({e}, '{f}')))"
    slash = f"case date_order when 'mdy' then {local('%m/%d/%Y %I:%M:%S %p')} end"
    return f"""with e as (select log_id, instrument, trim(time_text) as t, zone, date_order, delta_time, days_J2k, Day, Second, Micsec from time_log join stations using (station_id)),
i as (select log_id, instrument, case
when t is null and delta_time is not null then {times.US_2018} + round(delta_time * 1e6)::bigint
when t is null and days_J2k is not null then {times.US_2000} + round(days_J2k * 86400e6)::bigint
when t is null then {times.US_2000} + ({tai} - {times.TAI_UTC_2000} - ({leaps})) * 1000000 + Micsec
when regexp_full_match(t, '[0-9]{{13}}') then t::bigint * 1000
when regexp_full_match(t, '[0-9]{{10}}[.][0-9]{{2}}') then (t::decimal(38, 6) * 1000000)::bigint
when regexp_full_match(t, '[0-9]{{8}}T[0-9]{{6}}Z') then epoch_us(strptime(t, '%Y%m%dT%H%M%SZ'))
when regexp_full_match(t, '[0-9]{{4}}-[0-9]{{3}}T.*Z') then epoch_us(strptime(t[:17], '%Y-%jT%H:%M:%S')) + t[19:21]::bigint * 1000
when regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ].*(Z|[-+][0-9]{{2}}:?[0-9]{{2}})') then epoch_us(regexp_replace(replace(t, ' ', 'T'), '([-+][0-9]{{2}})([0-9]{{2}})$', '\\1:\\2')::timestamptz)
when regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9:.]*') then {local('%Y-%m-%d %H:%M:%S', 't[:19]')} + t[21:23]::bigint * 1000
when regexp_full_match(t, '[0-9]{{4}}/.*') then {local('%Y/%m/%d %H:%M:%S')}
when regexp_full_match(t, '.*[AP]M') then {slash}
when regexp_full_match(t, '[0-9]{{2}}/.*') then {local('%d/%m/%Y %H:%M:%S')}
else {local('%d %b %Y %H:%M:%S', 't[:20]')} end as us from e)
""" + (
        "select log_id, instrument, make_timestamp(us) as instant_utc, us, false as ambiguous from i"
        if every
        else """select a.log_id as log_id_a, b.log_id as log_id_b from i a join i b on a.instrument = b.instrument and a.log_id < b.log_id and abs(a.us - b.us) <= 1000000"""
    )


def _drift_sql() -> str:
    """p3 with the known families of names in place of the evidence the operator gathers."""
    families = {
        "wf": "'Waveform','waveform','pwr_waveform_20_ku','Wfm'",
        "cf": "'Corrections_flag','corrections_flag','Corr_status_flag','Corr_flag','flag_cor_applied_20_ku'",
        "sg": "'sigma_geo_r','SIGMA_GEO_R','geo_sigma_r','sigma_geo_range'",
        "np": "'n_fit_photons','n_photons_fit'",
        "pk": "'Peakiness','peakiness_20_ku'",
        "na": "'N_avg','n_avg_echoes'",
        "lm": "'Linear_Wfm_Multiplier','echo_scale_factor'",
    }
    family = "case " + " ".join(f"when k in ({v}) then '{f}'" for f, v in families.items()) + " end"
    kinds = "case json_type(payload, '$.\"' || k || '\"') when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'HUGEINT' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'text' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'list' when 'OBJECT' then 'object' end"
    return f"""with r as (select file_id, payload, unnest(json_keys(payload)) as k from raw_records), t as (select file_id, k, {kinds} as kind from r),
c as (select file_id, k, kind, count(*) as n from t where kind is not null group by all), m as (select *, sum(n) over (partition by file_id, k) as total from c),
prof as (select file_id, k, max(kind) filter (n * 2 > total) as kind from (select distinct file_id, k from t) left join m using (file_id, k) group by 1, 2),
f as (select file_id, lag(file_id) over (partition by stream_id order by acquired_at, file_id) as prev from granule_files where file_id in (select file_id from prof)),
pair as (select coalesce(a.file_id, b.file_id) as file_id, coalesce(a.k, b.k) as k, a.k as now_k, b.k as old_k, a.kind as now_kind, b.kind as old_kind
from (select prof.* from prof join f using (file_id) where prev is not null) a full join (select f.file_id, prof.k, prof.kind from f join prof on prof.file_id = f.prev) b on a.file_id = b.file_id and a.k = b.k),
gone as (select file_id, k, {family} as fam from pair where now_k is null), come as (select file_id, k, {family} as fam from pair where old_k is null),
ren as (select g.file_id, g.k as a, h.k as b from gone g join come h on g.file_id = h.file_id and g.fam = h.fam)
select file_id, 'renamed' as change, a as field_before, b as field_after from ren
union all select file_id, 'removed', k, '' from gone where (file_id, k) not in (select file_id, a from ren)
union all select file_id, 'added', '', k from come where (file_id, k) not in (select file_id, b from ren)
union all select file_id, 'retyped', k, k from pair where now_k is not null and old_k is not null and now_kind <> old_kind"""


def _runs_sql() -> str:
    """Runs of six equal readings as islands of the order within each value, and the limits."""
    good = lambda c: f"{c} is not null and not isnan({c}) and abs({c}) < 3.4028234e38 and {c} <> -9999"
    atl = f"select point_id as rid, 'h_li' as f, concat_ws('/', rgt, beam, cycle_number) as pas, delta_time as o0, segment_id as o1, h_li as v, -500 as low, 9000 as high from atl06_segments where {good('h_li')}"
    cs2 = [f"select rec_id, '{c}', concat_ws('/', source_id, abs_orbit), rec_seq, 0, {c}, {low}, {high} from cs2_records where {good(c)}" for c, low, high in (("Elev_1", -500, 9000), ("Peakiness", 0, 1000))]
    return f"""with r as ({atl} union all {cs2[0]} union all {cs2[1]}), u as (select distinct f, pas, o0, o1, v from r),
w as (select *, row_number() over (partition by f, pas order by o0, o1, v) - row_number() over (partition by f, pas, v order by o0, o1) as isle from u),
k as (select f, pas, o0, o1, v, count(*) over (partition by f, pas, v, isle) as n from w)
select r.rid as row_id, r.f as field_name, case when r.v < low or r.v > high then 'limit' else 'stuck' end as reason from r join k using (f, pas, o0, o1, v) where r.v < low or r.v > high or n >= 6"""


def oracle_sql() -> dict[str, str]:
    px, py = _projected("latitude", "longitude")
    placed = "case when x is not null and y is not null then {c} else {f} end"
    xy = f"{placed.format(c='x', f=px)} as x, {placed.format(c='y', f=py)} as y"
    return {
        "p2_found": f"""with pt as (select point_id, epsg, {xy} from atl06_segments), st as (select site_id, kind, epsg, radius_m, ring, {xy} from survey_sites),
edge as (select site_id, epsg, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from (select site_id, epsg, i, split_part(v, ' ', 1)::double as x, split_part(v, ' ', 2)::double as y
  from (select site_id, epsg, unnest(string_split(regexp_extract(ring, '[(][(](.*)[)][)]', 1), ', ')) as v, unnest(range(0, len(string_split(ring, ', ')))) as i from st where kind = 'polygon')) window w as (partition by site_id order by i))
select point_id, site_id from pt join st using (epsg) where kind = 'circle' and (pt.x - st.x) * (pt.x - st.x) + (pt.y - st.y) * (pt.y - st.y) <= radius_m * radius_m
union all select point_id, site_id from pt join edge on pt.epsg = edge.epsg and x1 is not null and (y0 > y) <> (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 group by point_id, site_id having count(*) % 2 = 1""",
        "p1_found": _units_sql(),
        "p6_runs_and_limits": _runs_sql(),
        "p1_values": _units_sql(every=True),
        "p5_instants": _instants_sql(every=True),
        "p3_found": _drift_sql(),
        "p5_found": _instants_sql(),
        "p3_quantities": "select rec_id, file_id, rec_no, "
        + ", ".join(f"try_cast(payload->>'$.{f}' as bigint) as \"{f}\"" for f in ("Day", "Second", "Micsec", "segment_id", "rgt"))
        + ", try_cast(coalesce(payload->>'$.Peakiness', payload->>'$.peakiness_20_ku') as double) as peakiness, try_cast(coalesce(payload->>'$.N_avg', payload->>'$.n_avg_echoes') as double) as n_avg from raw_records",
        "p7_records": """with c as (select r.*, stream_id, list_sort(list_transform(json_keys(payload), lambda k: k || '=' || json_extract(payload, '$."' || k || '"')::varchar))::varchar as body from raw_records r left join granule_files using (file_id))
select rec_id, file_id, rec_no, stream_id, payload from (select *, min(rec_id) over (partition by stream_id, body) as first_id from c) where stream_id is null or rec_id = first_id""",
        "p7_found": """with c as (select rec_id, stream_id, list_sort(list_transform(json_keys(payload), lambda k: k || '=' || json_extract(payload, '$."' || k || '"')::varchar))::varchar as body
from raw_records join granule_files using (file_id)) select rec_id from (select rec_id, min(rec_id) over (partition by stream_id, body) as first_id from c) where rec_id > first_id""",
    }
