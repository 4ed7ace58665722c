"""Expected results as DuckDB SQL over the test tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

FOREVER = ("1970-01-01 00:00:00", "2100-01-01 00:00:00")
SPAN = ("2024-01-03 00:00:00", "2024-01-25 12:30:00")

# --- the domain tables -----------------------------------------------------------------

CARRIER = """carrier(cid, cname) AS (VALUES
 (1,'coal'),(2,'lignite'),(3,'oil'),(4,'gas'),(5,'nuclear'),(6,'solar'),(7,'hydro'),
 (8,'biomass'),(9,'biogas'),(10,'onwind'),(11,'offwind'),(12,'electricity'),
 (13,'pumped_storage'),(14,'other_renewable'),(15,'other_conventional'))"""

BASE_FACTOR = """('lignite',0.82),('gas',0.49),('coal',0.82),('hydro',0.024),('solar',0.048),
 ('nuclear',0.012),('onwind',0.011),('offwind',0.012),('biomass',0.230),('biogas',0.230)"""
FACTOR = f"""factor(cname, f) AS (SELECT c, f::DOUBLE FROM (VALUES {BASE_FACTOR},
 ('other_conventional',0.5355),('other_renewable',0.0925),('pumped_storage',0.0925)) v(c, f))"""

META = """meta(mid, identifier, unit, consumption, local, cname) AS (VALUES
 (1,'evse_cluster','kw',true,true,'electricity'),
 (2,'haus_harbig','kw',true,true,'electricity'),
 (3,'haus_fleming','kw',true,true,'electricity'),
 (4,'production_of_chp','kw',false,true,'biogas'),
 (5,'total_load','kw',true,true,'electricity'),
 (6,'grid_reference_smard','kw',true,true,'electricity'),
 (7,'production_of_pv','kw',false,true,'solar'),
 (8,'brown coal','mwh',true,false,'lignite'),
 (9,'hard coal','mwh',true,false,'coal'),
 (10,'other conventional fuel','mwh',true,false,'other_conventional'),
 (11,'natural gas','mwh',true,false,'gas'),
 (12,'biomass','mwh',true,false,'biomass'),
 (13,'hydropower','mwh',true,false,'hydro'),
 (14,'windoffshore','mwh',true,false,'offwind'),
 (15,'windonshore','mwh',true,false,'onwind'),
 (16,'photovoltaic','mwh',true,false,'solar'),
 (17,'other renewables','mwh',true,false,'other_renewable'),
 (18,'pumped storage','mwh',true,false,'pumped_storage'),
 (19,'trafo_out_1_power_watts_15_min_mean','w',true,true,'electricity'),
 (20,'trafo_out_2_power_watts_15_min_mean','w',true,true,'electricity'),
 (21,'smard_market_price','eur/mwh',NULL,NULL,NULL))"""

SAMPLE = """sample AS (
 SELECT event_id AS id, CAST((event_id + user_id) % 21 + 1 AS INTEGER) AS mid, ts AS tm,
  CASE WHEN (event_id + user_id) % 21 + 1 IN (1,2,3,4,5,6,7,19,20) THEN value - 5.0
       ELSE value END AS v
 FROM events)"""


def weighed(rows: str) -> str:
    """Rows with a weight in hours, from ``rows`` that hold mid and tm."""
    return f"""SELECT *, least(0.25, coalesce(
   date_diff('microsecond', lag(tm) OVER same_series, tm),
   date_diff('microsecond', tm, lead(tm) OVER same_series)) / 3.6e9) AS h
  FROM ({rows}) WINDOW same_series AS (PARTITION BY mid ORDER BY tm)"""


def power(name: str, who: str, span: tuple[str, str]) -> str:
    """A CTE of weighed samples with energy e, for series where ``who`` holds."""
    chosen = f"""SELECT s.tm, s.v, m.* FROM sample s JOIN meta m ON m.mid = s.mid
   WHERE ({who}) AND s.tm >= TIMESTAMP '{span[0]}' AND s.tm <= TIMESTAMP '{span[1]}'"""
    return f"{name} AS (SELECT *, v * h AS e FROM ({weighed(chosen)}))"


LOAD = "lower(m.identifier) = 'total_load'"
PRODUCER = "m.consumption = false"
LOCAL_PRODUCER = "m.consumption = false AND m.local = true"
GRID = "lower(m.identifier) = 'grid_reference_smard'"
PRICE = "lower(m.identifier) = 'smard_market_price'"
CONSUMER = """m.consumption = true AND m.local = true
 AND lower(m.identifier) NOT IN ('total_load', 'grid_reference_smard')"""


def bucket(interval: str, tm: str = "tm") -> str:
    return f"time_bucket(INTERVAL '{interval}', {tm})"


def mix(interval: str, span: tuple[str, str]) -> str:
    """CTEs for the carrier shares of the grid mix."""
    return f"""mix_rows AS (
  SELECT {bucket(interval, 's.tm')} AS b, m.cname, s.v FROM sample s JOIN meta m ON m.mid = s.mid
  WHERE m.consumption = true AND m.local = false AND m.cname IS NOT NULL
   AND s.tm BETWEEN TIMESTAMP '{span[0]}' AND TIMESTAMP '{span[1]}'),
 mix_total AS (SELECT b, sum(v) AS whole FROM mix_rows GROUP BY b),
 mix AS (SELECT r.b, r.cname, sum(r.v) / any_value(w.whole) AS share
  FROM mix_rows r JOIN mix_total w ON w.b = r.b GROUP BY r.b, r.cname)"""


def with_tables(*ctes: str) -> str:
    return "WITH " + ",\n".join([CARRIER, FACTOR, META, SAMPLE, *ctes]) + "\n"


def one_row(value: str, name: str, unit: str | None, span: tuple[str, str], source: str) -> str:
    shown = f"'{unit}'" if unit else "CAST(NULL AS VARCHAR)"
    return f"""SELECT round({value}, 4) AS value, '{name}' AS name, {shown} AS unit,
 TIMESTAMP '{span[0]}' AS from_timestamp, TIMESTAMP '{span[1]}' AS to_timestamp FROM {source}"""


# --- buckets and weights ---------------------------------------------------------------

for _name, _interval in {
    "7min": "7 minutes",
    "15min": "15 minutes",
    "1hour": "1 hour",
    "5hour": "5 hours",
}.items():
    ORACLE[f"time_bucket_{_name}"] = (
        f"SELECT event_id, time_bucket(INTERVAL '{_interval}', ts) AS bucket FROM events"
    )
for _name, _interval in {
    "1day": "1 day",
    "2day": "2 days",
    "1week": "7 days",
    "3week": "21 days",
    "1month": "1 month",
    "3month": "3 months",
    "5month": "5 months",
    "1year": "12 months",
    "2year": "24 months",
}.items():
    ORACLE[f"time_bucket_{_name}"] = (
        f"SELECT o_orderkey, time_bucket(INTERVAL '{_interval}', o_orderdate) AS bucket FROM orders"
    )

for _suffix, _span in {"": FOREVER, "_ranged": SPAN}.items():
    _rows = f"""SELECT id, mid, tm FROM sample
   WHERE tm BETWEEN TIMESTAMP '{_span[0]}' AND TIMESTAMP '{_span[1]}'"""
    _sql = f"""{with_tables()} SELECT id, mid AS meta_id, tm AS series_timestamp,
 h AS hours FROM ({weighed(_rows)})"""
    ORACLE[f"sample_hours{_suffix}"] = _sql
    ORACLE[f"sample_hours_chunked{_suffix}"] = _sql

ORACLE["neighbours"] = f"""{with_tables()} SELECT id, mid AS meta_id, tm AS series_timestamp,
 max(tm) OVER (PARTITION BY mid ORDER BY tm ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before,
 max(tm) OVER (PARTITION BY mid ORDER BY tm ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS after
FROM sample"""

ORACLE["grid_mix_shares"] = f"""{with_tables(mix('1 hour', FOREVER))}
SELECT b AS bucket, cname AS carrier_name, round(share, 6) AS share FROM mix"""

# --- series and registry ---------------------------------------------------------------

for _suffix, _span in {"": FOREVER, "_ranged": SPAN}.items():
    ORACLE[f"series_scan{_suffix}"] = f"""{with_tables()}
SELECT s.id, s.tm AS timestamp, s.v AS value, s.tm AS created_at, s.tm AS updated_at
FROM sample s WHERE s.mid = (SELECT mid FROM meta m WHERE {LOAD})
 AND s.tm BETWEEN TIMESTAMP '{_span[0]}' AND TIMESTAMP '{_span[1]}'"""
ORACLE["resample_mean"] = f"""{with_tables()}
SELECT {bucket('1 hour')} AS bucket, round(avg(v), 9) AS mean_value
FROM sample WHERE mid = 21 GROUP BY 1"""
ORACLE["resample_mean_ranged"] = f"""{with_tables()}
SELECT {bucket('1 day')} AS bucket, round(avg(v), 9) AS mean_value FROM sample
WHERE mid = 8 AND tm BETWEEN TIMESTAMP '{SPAN[0]}' AND TIMESTAMP '{SPAN[1]}' GROUP BY 1"""

LISTED = """SELECT CAST(m.mid AS INTEGER) AS id, m.identifier, m.unit, m.cname AS carrier,
 CAST(m.consumption AS VARCHAR) AS consumption, m.identifier AS description,
 CAST(m.local AS VARCHAR) AS local, min(s.tm) AS min_timestamp, max(s.tm) AS max_timestamp
FROM meta m LEFT JOIN sample s ON s.mid = m.mid"""
ORACLE["list_series"] = f"{with_tables()} {LISTED} GROUP BY ALL"
ORACLE["list_series_page"] = f"{with_tables()} {LISTED} GROUP BY ALL ORDER BY id LIMIT 8 OFFSET 8"
ORACLE["list_series_after"] = ORACLE["list_series_page"]
ORACLE["get_series"] = f"{with_tables()} {LISTED} WHERE m.mid = 21 GROUP BY ALL"
ORACLE["series_with_samples"] = f"""{with_tables()}
SELECT CAST(m.mid AS INTEGER) AS id, m.identifier, m.unit, m.cname AS carrier,
 CAST(m.consumption AS VARCHAR) AS consumption, m.identifier AS description,
 CAST(m.local AS VARCHAR) AS local
FROM meta m WHERE EXISTS (SELECT 1 FROM sample s WHERE s.mid = m.mid)"""
ORACLE["series_extent"] = f"""{with_tables()}
SELECT mid AS meta_id, min(tm) AS min_timestamp, max(tm) AS max_timestamp FROM sample GROUP BY 1"""

# --- indicators ------------------------------------------------------------------------

RATIO = """CASE WHEN coalesce((SELECT sum(e) FROM made), 1.0) <> 0
 THEN coalesce((SELECT sum(e) FROM used), 1.0) / coalesce((SELECT sum(e) FROM made), 1.0)
 ELSE coalesce((SELECT sum(e) FROM used), 1.0) END"""


def totals(span: tuple[str, str], suffix: str) -> None:
    used, made = power("used", LOAD, span), power("made", PRODUCER, span)
    ratio = f"(SELECT {RATIO} AS r)"
    ORACLE[f"total_consumption{suffix}"] = with_tables(used) + one_row(
        "coalesce(sum(e), 0)", "total_consumption", "kwh", span, "used"
    )
    ORACLE[f"total_production{suffix}"] = with_tables(made) + one_row(
        "coalesce(sum(e), 0)", "total_production", "kwh", span, "made"
    )
    ORACLE[f"self_consumption{suffix}"] = with_tables(used, made) + one_row(
        "least(r, 1.0)", "self_consumption", None, span, ratio
    )
    ORACLE[f"autarky{suffix}"] = with_tables(used, made) + one_row(
        "CASE WHEN r = 0 THEN 1.0 ELSE least(1.0 / r, 1.0) END", "autarky", None, span, ratio
    )
    hourly = f"""hourly AS (SELECT {bucket('1 hour')} AS b, sum(greatest(e, 0)) AS e
  FROM made GROUP BY 1),
 quote AS (SELECT {bucket('1 hour', 's.tm')} AS b, m.identifier, m.unit, avg(s.v) AS p
  FROM sample s JOIN meta m ON m.mid = s.mid
  WHERE {PRICE} AND s.tm BETWEEN TIMESTAMP '{span[0]}' AND TIMESTAMP '{span[1]}' GROUP BY ALL)"""
    ORACLE[f"cost_savings{suffix}"] = with_tables(made, hourly) + one_row(
        "coalesce(sum(hourly.e * quote.p / 1000), 0)",
        "cost_savings",
        "EUR",
        span,
        "hourly JOIN quote ON quote.b = hourly.b",
    )


totals(FOREVER, "")
totals(SPAN, "_ranged")
ORACLE["total_consumption_chunked"] = ORACLE["total_consumption"]


def drawn(interval: str, by: str) -> str:
    return f"""drawn AS (SELECT {bucket(interval)} AS b, {by} AS k, sum(e) AS e,
  sum(greatest(e, 0)) AS clamped FROM grid GROUP BY ALL)"""


def by_bucket(interval: str, span: tuple[str, str], suffix: str) -> None:
    grid = power("grid", GRID, span)
    made = power("made", LOCAL_PRODUCER, span)
    shares = mix(interval, span)

    split = "mix LEFT JOIN drawn ON drawn.b = mix.b"
    ORACLE[f"grid_consumption{suffix}"] = f"""{with_tables(grid, drawn(interval, 'unit'), shares)}
SELECT drawn.b AS bucket, round(drawn.e, 7) AS bucket_consumption, drawn.k AS consumption_unit,
 round(mix.share, 7) AS carrier_proportion, mix.cname AS carrier_name FROM {split}"""
    ORACLE[f"local_production{suffix}"] = f"""{with_tables(made)}
SELECT {bucket(interval)} AS bucket, round(sum(greatest(e, 0)), 7) AS bucket_consumption,
 unit AS consumption_unit, CAST(1 AS DOUBLE) AS carrier_proportion, cname AS carrier_name
FROM made WHERE cname IS NOT NULL GROUP BY ALL"""
    ORACLE[f"consumption_by_carrier{suffix}"] = f"""
{with_tables(grid, made, drawn(interval, 'unit'), shares)}
SELECT drawn.b AS bucket, mix.cname AS carrier_name, round(mix.share * drawn.e, 7) AS value,
 'kwh' AS unit, false AS local FROM mix JOIN drawn ON drawn.b = mix.b
UNION ALL
SELECT {bucket(interval)}, cname, round(sum(greatest(e, 0)), 7), 'kwh', true
FROM made GROUP BY {bucket(interval)}, cname, unit"""
    ORACLE[f"local_consumption{suffix}"] = f"""{with_tables(power('used', CONSUMER, span))}
SELECT {bucket(interval)} AS bucket, identifier AS consumer_name, cname AS carrier_name,
 round(sum(greatest(CASE lower(unit) WHEN 'w' THEN v / 1000 ELSE v END * h, 0)), 7) AS value,
 'kWh' AS unit FROM used GROUP BY bucket, identifier, cname"""

    one = f"""one AS (SELECT {bucket(interval)} AS b, made.cname, made.identifier,
  sum(greatest(e, 0)) * factor.f AS x FROM made JOIN factor ON factor.cname = made.cname
  GROUP BY 1, 2, 3, factor.f)"""
    two = f"""two AS (SELECT drawn.b, mix.cname, drawn.clamped * mix.share AS x, factor.f
  FROM {split} JOIN factor ON factor.cname = mix.cname)"""
    emitted = "'kgco2eq' AS unit"
    ORACLE[f"scope_one_emissions{suffix}"] = f"""{with_tables(made, one)}
SELECT b AS bucket, round(x, 7) AS value, cname AS carrier_name, {emitted} FROM one"""
    second = with_tables(grid, drawn(interval, "cname"), shares, two)
    ORACLE[f"scope_two_emissions{suffix}"] = f"""{second}
SELECT b AS bucket, round(x, 7) AS value, cname AS carrier_name, {emitted} FROM two"""
    if not suffix:
        ORACLE["scope_two_emissions_weighted"] = f"""{second}
SELECT b AS bucket, round(x * f, 7) AS value, cname AS carrier_name, {emitted} FROM two"""
    both = with_tables(grid, made, drawn(interval, "cname"), shares, one, two)
    ORACLE[f"total_co2_emissions{suffix}"] = both + one_row(
        "coalesce((SELECT sum(x) FROM one), 0) + coalesce((SELECT sum(x) FROM two), 0)",
        "total_co2_emissions",
        "kgco2eq",
        span,
        "(SELECT 1)",
    )

    pairs = f"""made_by AS (SELECT {bucket(interval)} AS b, cname, sum(greatest(e, 0)) AS p
  FROM made GROUP BY ALL),
 pair AS (SELECT made_by.b, made_by.cname, made_by.p, mix.share, factor.f
  FROM made_by JOIN mix ON mix.b = made_by.b JOIN factor ON factor.cname = mix.cname),
 saving AS (SELECT b, sum(p * share * f) AS would, avg(p * f) AS did FROM pair GROUP BY b)"""
    saved = one_row("coalesce(sum(would - did), 0)", "co2_savings", "kgco2eq", span, "saving")
    ORACLE[f"co2_savings{suffix}"] = with_tables(made, shares, pairs) + saved
    if not suffix:
        own = """own AS (SELECT made_by.b, sum(p * f) AS x FROM made_by
  JOIN factor ON factor.cname = made_by.cname GROUP BY made_by.b)"""
        ORACLE["co2_savings_own_factors"] = with_tables(made, shares, pairs, own) + one_row(
            "coalesce(sum(saving.would - coalesce(own.x, 0)), 0)",
            "co2_savings",
            "kgco2eq",
            span,
            "saving LEFT JOIN own ON own.b = saving.b",
        )
        ORACLE["co2_savings_chunked"] = ORACLE["co2_savings"]

    cost = f"""spent AS (SELECT {bucket(interval)} AS b, sum(greatest(e, 0)) AS e
  FROM grid GROUP BY 1),
 quote AS (SELECT {bucket(interval, 's.tm')} AS b, avg(s.v) / 1000 AS p
  FROM sample s JOIN meta m ON m.mid = s.mid WHERE {PRICE} GROUP BY 1)"""
    ORACLE[f"total_grid_electricity_cost{suffix}"] = with_tables(grid, cost) + one_row(
        "coalesce(sum(spent.e * quote.p), 0)",
        "total_grid_electricity_cost",
        "EUR",
        span,
        "spent JOIN quote ON quote.b = spent.b",
    )


by_bucket("1 month", FOREVER, "_monthly")
for _name in ["grid_consumption_monthly", "local_production_monthly"]:
    del ORACLE[_name]
by_bucket("1 hour", FOREVER, "")
by_bucket("1 day", SPAN, "_ranged")

# --- emission factors ------------------------------------------------------------------

PART_CARRIER = """CASE WHEN p_size % 16 < 15 THEN
  (SELECT cname FROM carrier WHERE cid = p_size % 16 + 1) ELSE 'fusion' END"""
REQUEST = f"""request AS (SELECT {PART_CARRIER} AS carrier, p_retailprice / 1000 AS factor,
  'kgco2eq/kwh' AS unit, p_brand || '/' || p_size AS source,
  CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS source_url FROM part)"""
ALL_FACTOR = """all_factor AS (
  SELECT cname AS carrier, f AS factor, 'kgco2eq/kwh' AS unit, 'IPCC' AS source,
   CAST(NULL AS VARCHAR) AS source_url FROM factor
  UNION ALL SELECT * FROM request WHERE carrier IN (SELECT cname FROM carrier))"""
FACTORS = with_tables(REQUEST, ALL_FACTOR)

ORACLE["emission_factors"] = f"{FACTORS} SELECT * FROM all_factor"
ORACLE["add_emission_factors"] = f"""{FACTORS}
SELECT CAST(cid AS INTEGER) AS carrier, factor, unit, source, source_url
FROM request JOIN carrier ON cname = request.carrier"""
ORACLE["appended_ids"] = f"""{FACTORS}
SELECT count(*) AS rows, count(*) AS ids, 1 AS first, CAST(count(*) AS INTEGER) AS last
FROM all_factor"""
ORACLE["rejected_emission_factors"] = f"""{FACTORS}
SELECT * FROM request WHERE carrier NOT IN (SELECT cname FROM carrier)"""
ORACLE["emission_factors_by_source"] = f"""{FACTORS}
SELECT * FROM all_factor WHERE source = 'Brand#12/19'"""
ORACLE["emission_factors_by_carrier"] = f"{FACTORS} SELECT * FROM all_factor WHERE carrier = 'gas'"
ORACLE["emission_factor_seed"] = f"""{with_tables(REQUEST)},
 known AS (SELECT c, f::DOUBLE AS f FROM (VALUES {BASE_FACTOR}) v(c, f)
  UNION ALL SELECT carrier, factor FROM request WHERE carrier IN (SELECT cname FROM carrier)),
 mean AS (
  SELECT 'other_conventional' AS carrier_name, avg(f) AS factor FROM known
   WHERE c IN ('gas', 'lignite', 'coal', 'nuclear')
  UNION ALL SELECT n, avg(f) FROM known, (VALUES ('other_renewable'), ('pumped_storage')) r(n)
   WHERE c IN ('solar', 'hydro', 'biomass', 'biogas', 'onwind', 'offwind') GROUP BY n)
SELECT CAST(cid AS INTEGER) AS carrier, carrier_name, round(factor, 6) AS factor,
 'kgco2eq/kwh' AS unit, 'IPCC' AS source, CAST(NULL AS VARCHAR) AS source_url
FROM mean JOIN carrier ON cname = carrier_name"""
ORACLE["source_fallback"] = f"""{FACTORS}
SELECT p_partkey, p_brand || '/' || p_size AS source,
 CASE WHEN EXISTS (SELECT 1 FROM all_factor a WHERE a.source = p_brand || '/' || p_size)
  THEN p_brand || '/' || p_size ELSE 'IPCC' END AS used_source FROM part"""

PART_FACTOR = """part_factor AS (SELECT request.carrier AS cname, request.factor AS f
  FROM request JOIN carrier ON carrier.cname = request.carrier)"""


def many_factors() -> None:
    """Every part as a factor: all rows count in scope two and savings, distinct in one."""
    grid, made = power("grid", GRID, FOREVER), power("made", LOCAL_PRODUCER, FOREVER)
    pairs = f"""made_by AS (SELECT {bucket('1 hour')} AS b, cname, sum(greatest(e, 0)) AS p
  FROM made GROUP BY ALL),
 saving AS (SELECT made_by.b, sum(p * share * f) AS would, avg(p * f) AS did
  FROM made_by JOIN mix ON mix.b = made_by.b JOIN part_factor ON part_factor.cname = mix.cname
  GROUP BY made_by.b)"""
    ORACLE["co2_savings_many_factors"] = with_tables(
        REQUEST, PART_FACTOR, made, mix("1 hour", FOREVER), pairs
    ) + one_row("sum(would - did)", "co2_savings", "kgco2eq", FOREVER, "saving")
    ORACLE["scope_one_emissions_many_factors"] = f"""{with_tables(REQUEST, PART_FACTOR, made)}
SELECT b AS bucket, round(e * f, 4) AS value, cname AS carrier_name, 'kgco2eq' AS unit
FROM (SELECT {bucket('1 month')} AS b, identifier, cname, sum(greatest(e, 0)) AS e
 FROM made GROUP BY ALL) JOIN (SELECT DISTINCT * FROM part_factor) USING (cname)"""
    drawn_by = f"""drawn AS (SELECT {bucket('1 month')} AS b, sum(greatest(e, 0)) AS e
  FROM grid GROUP BY 1)"""
    ctes = with_tables(REQUEST, PART_FACTOR, grid, mix("1 month", FOREVER), drawn_by)
    ORACLE["scope_two_emissions_many_factors"] = f"""{ctes}
SELECT drawn.b AS bucket, round(drawn.e * mix.share, 4) AS value, mix.cname AS carrier_name,
 'kgco2eq' AS unit
FROM mix LEFT JOIN drawn ON drawn.b = mix.b JOIN part_factor ON part_factor.cname = mix.cname"""


many_factors()

# --- registering and ingest ------------------------------------------------------------

INPUT = f"""input AS (SELECT
  CASE WHEN p_size > 25 THEN upper(p_name || ' ' || p_brand) ELSE p_name || ' ' || p_brand END
   AS identifier, p_type AS unit, {PART_CARRIER} AS cname, p_retailprice > 1000 AS consumption,
  p_name AS description,
  CASE p_size % 3 WHEN 1 THEN true WHEN 2 THEN false END AS local, p_partkey AS place FROM part)"""
IMPORTED = """imported AS (
  SELECT lower(identifier) AS identifier, lower(unit) AS unit, CAST(cid AS INTEGER) AS carrier,
   consumption, description, coalesce(local, false) AS local, place
  FROM input JOIN carrier ON carrier.cname = input.cname
  QUALIFY row_number() OVER (PARTITION BY lower(identifier), lower(unit) ORDER BY place) = 1),
 numbered AS (SELECT *, CAST(21 + row_number() OVER (ORDER BY unit <> 'economy', place) AS INTEGER) AS id
  FROM imported)"""
BASIC = """basic AS (SELECT CAST(mid AS INTEGER) AS id, identifier, unit, CAST(cid AS INTEGER) AS carrier, consumption,
  identifier AS description, local FROM meta LEFT JOIN carrier ON carrier.cname = meta.cname)"""
INPUTS = with_tables(INPUT, IMPORTED, BASIC)

ORACLE["register_series"] = f"""{INPUTS}
SELECT id, identifier, unit, CAST(carrier AS VARCHAR) AS carrier,
 CAST(consumption AS VARCHAR) AS consumption, description, CAST(local AS VARCHAR) AS local,
 0 AS microgrid_id FROM (SELECT * FROM basic UNION ALL BY NAME SELECT * EXCLUDE (place) FROM numbered)"""
ORACLE["resolve_series"] = f"""{INPUTS}
SELECT lower(i.identifier) AS identifier, lower(i.unit) AS unit, k.identifier AS registered
FROM input i LEFT JOIN imported k ON k.unit = 'economy' AND k.unit = lower(i.unit)
 AND k.identifier = lower(i.identifier)"""
ORACLE["add_series"] = f"""{INPUTS}
SELECT CAST(21 + row_number() OVER (ORDER BY place) AS INTEGER) AS id, identifier, unit, CAST(cid AS VARCHAR) AS carrier,
 CAST(consumption AS VARCHAR) AS consumption, description, CAST(local AS VARCHAR) AS local,
 0 AS microgrid_id, input.cname AS carrier_name
FROM input LEFT JOIN carrier ON carrier.cname = input.cname"""
ORACLE["append_series"] = f"""{INPUTS}
SELECT id, identifier, unit, CAST(carrier AS VARCHAR) AS carrier,
 CAST(consumption AS VARCHAR) AS consumption, description, CAST(local AS VARCHAR) AS local,
 0 AS microgrid_id, 'true' AS stamped FROM (
 SELECT * FROM basic UNION ALL BY NAME
 SELECT CAST(21 + row_number() OVER (ORDER BY place) AS INTEGER) AS id,
  identifier || ' ' || place AS identifier, unit, CAST(cid AS INTEGER) AS carrier, consumption,
  description, local FROM input LEFT JOIN carrier ON carrier.cname = input.cname)"""
ORACLE["append_factors"] = f"""{FACTORS}
SELECT carrier, factor, unit, source, source_url, 'true' AS stamped
FROM request WHERE carrier IN (SELECT cname FROM carrier)"""
ORACLE["refused_series"] = f"""{INPUTS},
 sent AS (SELECT lower(identifier) AS identifier, lower(unit) AS unit, count(*) AS sent
  FROM input GROUP BY 1, 2),
 held AS (SELECT identifier, unit FROM imported WHERE unit = 'economy'
  UNION ALL SELECT identifier, unit FROM basic)
SELECT identifier, unit, sent,
 (SELECT count(*) FROM held h WHERE h.identifier = s.identifier AND h.unit = s.unit) AS held
FROM sent s WHERE sent > 1 OR (identifier, unit) IN (SELECT (identifier, unit) FROM held)"""

ORACLE["unpivot_import"] = " UNION ALL ".join(
    f"SELECT l_shipdate AS time, '{c}' AS \"column\", "
    + (f"{c} AS value" if c != "l_returnflag" else "CAST(0 AS DOUBLE) AS value")
    + " FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
)
ORACLE["lenient_numbers"] = """SELECT event_id,
 CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events"""
ORACLE["parse_times"] = """SELECT o_orderkey, o_orderdate - INTERVAL 2 HOUR AS series_timestamp
FROM orders"""
ORACLE["point_files"] = ORACLE["ingest_points"] = f"""{with_tables()}
SELECT s.mid AS meta_id, e.ts AS series_timestamp, e.value AS series_value
FROM events e JOIN sample s ON s.id = e.event_id
WHERE e.event_type NOT IN ('error', 'signup')"""

ORACLE["wide_files"] = " UNION ALL ".join(
    f"SELECT l_shipdate - INTERVAL 2 HOUR AS series_timestamp, '{shown}' AS \"column\", {c} AS value FROM lineitem"
    for c, shown in {"l_quantity": "l_quantity", "l_tax": "l tax"}.items()
)
ORACLE["technology_files"] = " UNION ALL ".join(
    f"""SELECT p_name AS technology, p_brand AS parameter, p_retailprice AS value, p_type AS unit,
 {year} AS year FROM part WHERE p_size % 2 = {year % 2}"""
    for year in (2020, 2025)
)
ORACLE["result_lines"] = f"""{with_tables()}
SELECT CAST(id AS VARCHAR) AS id, strftime(tm, '%Y-%m-%dT%H:%M:%S.%f') AS at, 'Z' AS zone
FROM sample WHERE mid = 5"""

SHIPPED = """shipped AS (SELECT l_linenumber AS mid, l_shipdate AS tm, l_quantity AS v FROM lineitem),
 stored AS (SELECT DISTINCT CAST(o_orderpriority[1] AS INTEGER) AS mid, o_orderdate AS tm FROM orders)"""
ORACLE["ingest_duplicates"] = f"""WITH {SHIPPED}
SELECT s.mid AS meta_id, s.tm AS series_timestamp, count(*) AS copies,
 bool_or(k.mid IS NOT NULL) AS stored
FROM shipped s LEFT JOIN stored k ON k.mid = s.mid AND k.tm = s.tm
GROUP BY 1, 2 HAVING count(*) > 1 OR bool_or(k.mid IS NOT NULL)"""
ORACLE["ingest_new_only"] = f"""WITH {SHIPPED}
SELECT mid AS meta_id, tm AS series_timestamp, min(v) AS series_value FROM shipped s
WHERE NOT EXISTS (SELECT 1 FROM stored k WHERE k.mid = s.mid AND k.tm = s.tm) GROUP BY 1, 2"""
ORACLE["unnest_arrays"] = """
SELECT o_orderdate AS series_timestamp, o_totalprice AS series_value,
 CAST(o_custkey AS INTEGER) AS meta_id FROM orders
UNION ALL SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP), CAST(0 AS DOUBLE), 0 FROM orders"""
ORACLE["market_prices"] = """
SELECT date_trunc('millisecond', ts) AS series_timestamp, value AS series_value FROM events
WHERE event_type <> 'error' AND date_trunc('day', ts) > TIMESTAMP '2024-01-04'
 AND date_trunc('day', ts) < TIMESTAMP '2024-01-21'
 AND date_trunc('day', ts) IN (SELECT date_trunc('day', ts) FROM events WHERE event_type = 'purchase')"""
ORACLE["price_increment"] = f"""{with_tables()}
SELECT tm AS series_timestamp, v AS series_value FROM sample WHERE mid = 21 AND tm > (
 SELECT max(tm) FROM sample WHERE mid = 21
  AND tm BETWEEN TIMESTAMP '{SPAN[0]}' AND TIMESTAMP '{SPAN[1]}')"""
ORACLE["technology_filter"] = """SELECT p_name AS technology, p_brand AS parameter,
 p_retailprice AS value, p_type AS unit FROM part WHERE p_brand = 'Brand#12' AND p_type = 'ECONOMY'"""

# --- streams ---------------------------------------------------------------------------

for _name in ["stream_prices", "stream_prices_watermarked"]:
    ORACLE[_name] = f"""{with_tables()}
SELECT mid AS meta_id, tm AS series_timestamp, v AS series_value FROM sample"""
ORACLE["stream_resample"] = f"""{with_tables()}
SELECT mid AS meta_id, {bucket('1 hour')} AS bucket, round(avg(v), 9) AS mean_value
FROM sample GROUP BY 1, 2"""
ORACLE["stream_resample_windowed"] = ORACLE["stream_resample"]

for _name in [
    "total_consumption", "total_production", "self_consumption", "autarky", "cost_savings",
    "consumption_by_carrier", "local_consumption", "scope_one_emissions", "scope_two_emissions",
    "total_co2_emissions", "co2_savings", "total_grid_electricity_cost", "grid_consumption", "local_production",
]:
    ORACLE[f"{_name}_by_series"] = ORACLE[_name]

ORACLE["stream_unique"] = ORACLE["stream_prices"]
ORACLE["stream_resample_compacted"] = ORACLE["stream_resample"]
ORACLE["stream_sample_hours"] = f"""{with_tables()}
SELECT mid AS meta_id, tm AS series_timestamp, h AS hours, false AS late FROM ({weighed("SELECT * FROM sample")})"""

# Mix samples of even hours are zero; a missing share counts as 1 where energy is split.
for _name in ["consumption_by_carrier", "scope_two_emissions", "total_co2_emissions", "co2_savings"]:
    ORACLE[f"{_name}_without_mix"] = (
        ORACLE[_name]
        .replace("ELSE value END AS v", "WHEN (event_id + user_id) % 21 + 1 BETWEEN 8 AND 18 AND hour(ts) % 2 = 0 THEN 0.0 ELSE value END AS v")
        .replace("/ any_value(w.whole)", "/ nullif(any_value(w.whole), 0)")
        .replace("round(mix.share * drawn.e, 7)", "round(coalesce(mix.share, 1.0) * drawn.e, 7)")
    )

# --- tables kept beside the samples ------------------------------------------------------

for _name in [
    "total_consumption", "autarky", "cost_savings", "consumption_by_carrier", "scope_two_emissions",
    "co2_savings", "total_co2_emissions", "total_grid_electricity_cost",
]:
    ORACLE[f"{_name}_hourly"] = ORACLE[_name]
for _name in ["total_consumption", "consumption_by_carrier"]:
    ORACLE[f"{_name}_hourly_ranged"] = ORACLE[f"{_name}_ranged"]
ORACLE["series_extent_kept"] = ORACLE["series_extent"]
ORACLE["list_series_last_page"] = f"{with_tables()} {LISTED} GROUP BY ALL ORDER BY id LIMIT 8 OFFSET 16"

# --- large landed files ------------------------------------------------------------------

ORACLE["point_documents"] = ORACLE["ingest_points"]
ORACLE["load_export"] = " UNION ALL ".join(
    f"""SELECT {meta_id} AS meta_id, '{name}' AS identifier, 'kw' AS unit, {column}::DOUBLE AS series_value,
 TIMESTAMP '2020-01-01' + to_minutes(event_id) AS series_timestamp FROM events"""
    for meta_id, name, column in ((22, "value", "value"), (23, "user_id", "user_id"))
)
ORACLE["default_range"] = f"SELECT value, name, unit FROM ({ORACLE['total_consumption']})"
ORACLE["result_document"] = f"""{with_tables()}
SELECT id, tm AS "timestamp", v AS value FROM sample WHERE mid = 5"""
