"""Inputs of the registered queries, derived from the tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "fx_dem": """select cast(162007 - floor(o_orderkey/100) as int) as ilat, cast(25150 + o_orderkey % 100 as int) as ilon,
  cast((cast(round(o_totalprice*100) as bigint) % 400)/1e2 as double) as h from orders""",
    "fx_vp": """select cast(n_nationkey as bigint) as vp_id,
  (162007 - ((n_nationkey*11+3) % (select cast(floor(max(o_orderkey)/100)+1 as bigint) from orders)) + 5e-1)/3.6e3 as lat,
  (25150 + ((n_nationkey*29+7) % 100) + 5e-1)/3.6e3 as lon, cast(n_nationkey*15 as double) as heading from nation""",
    "fx_poi": """select p_partkey as poi_id, cast(p_partkey as int) as ord,
  case when p_partkey % 3 = 0 then concat('fr ', p_name) end as name_fr,
  case when p_partkey % 5 <> 0 then p_name end as name,
  case when p_partkey % 7 = 0 then null when p_partkey % 11 = 0 then 'n/a' else concat(cast(p_size*40 as varchar(20)), '.5') end as ele,
  (162007 - ((p_partkey*37+5) % (select cast(floor(max(o_orderkey)/100)+1 as bigint) from orders)) + 3e-1)/3.6e3 as lat,
  (25150 + ((p_partkey*53+1) % 100) + 7e-1)/3.6e3 as lon,
  case when p_partkey % 4 = 0 then 'peak' when p_partkey % 4 = 1 then 'saddle' when p_partkey % 4 = 2 then 'spring' end as kind from part""",
    # a raster as wide as a full window, rougher, with the same landmarks and viewpoints laid over its width
    "fx_wide_dem": " union all ".join(f"""select cast(162007 - 3*floor(o_orderkey/2048) - {k} as int) as ilat, cast(25150 + o_orderkey % 2048 as int) as ilon,
  cast((cast(round(o_totalprice*{100 + k}) as bigint) % 400)/5e1 as double) as h from orders""" for k in range(3)),
    "fx_wide_vp": """select cast(n_nationkey as bigint) as vp_id,
  (162007 - ((n_nationkey*11+3) % (select cast(3*floor(max(o_orderkey)/2048)+3 as bigint) from orders)) + 5e-1)/3.6e3 as lat,
  (25150 + ((n_nationkey*389+7) % 2048) + 5e-1)/3.6e3 as lon, cast(n_nationkey*15 as double) as heading from nation""",
    "fx_wide_poi": """select p_partkey as poi_id, cast(p_partkey as int) as ord, cast(null as varchar(20)) as name_fr, p_name as name, concat(cast(p_size*40 as varchar(20)), '.5') as ele,
  (162007 - ((p_partkey*37+5) % (select cast(3*floor(max(o_orderkey)/2048)+3 as bigint) from orders)) + 3e-1)/3.6e3 as lat,
  (25150 + ((p_partkey*53+1) % 2048) + 7e-1)/3.6e3 as lon from part""",
    # pixels of elevation files of 256 x 256, one cell for 65536 orders
    "fx_file_px": """select 44 as cell_lat, cast(6 + floor(o_orderkey/65536) as int) as cell_lon, cast(floor(o_orderkey/256) as int) % 256 as r, cast(o_orderkey % 256 as int) as c,
  cast(cast(round(o_totalprice*100) as bigint) % 4000 as double)/4e0 + 1e0 as h from orders""",
    "fx_position": """select c_custkey as device_id, case when c_custkey % 6 = 0 then null when c_custkey % 4 = 1 then -2e0 + (c_custkey*17 % 37)/1e1 else 41e0 + (c_custkey*17 % 71)/1e1 end as lat,
  case when c_custkey % 6 = 0 then null when c_custkey % 4 = 1 then -2e0 + (c_custkey*29 % 41)/1e1 else 3e0 + (c_custkey*29 % 83)/1e1 end as lon from customer""",
    "fx_cell": """select distinct cast(s_suppkey % 3 as int)+43 as cell_lat, cast(s_suppkey*7 % 5 as int)+5 as cell_lon from supplier""",
    "fx_orientation": """select event_id, user_id as device_id, ts, cast(cast(round(value*100) as bigint) % 3 as double)*45 as alpha,
  cast(60 + event_id % 2 * 30 as double) as beta, 0e0 as gamma, 0e0 as screen from events""",
    "fx_key": """select event_id as seq, user_id as device_id, ts, case event_type when 'click' then 'ArrowLeft' when 'view' then 'ArrowRight' when 'purchase' then 'ArrowUp' when 'signup' then 'ArrowDown' else 'Escape' end as code from events""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"from (\w+)", sql))}
    return spark.sql(re.sub(r"from (\w+)", r"from {\1}", sql), **tables)


def ctes(*names: str, kind: str = "") -> str:
    """The fixtures as the head of a SQL statement; kind: those of fx_<kind>_ under the plain names."""
    return "with " + ",\n".join(f"{n} as ({FIXTURES[n.replace('fx_', f'fx_{kind}_') if kind else n]})" for n in names)
