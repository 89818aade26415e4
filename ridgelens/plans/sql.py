"""The registered queries as DuckDB SQL on the same tables."""

from __future__ import annotations

from ridgelens.functions.grid import DELTA_Y, delta_x
from ridgelens.operators.labels import SCALE, TEXT_HEIGHT
from ridgelens.plans.fixtures import ctes

DX, DY = f"{delta_x()!r}::double", f"{DELTA_Y!r}::double"
PI = "3.141592653589793"


def _arc(c: str) -> str:
    return f"trunc({c}*3600::double)::int"


def _floor(c: str, n: int = 3600) -> str:
    return f"floor(({c})/{n}.0::double)::int"


def _window(lat: str, lon: str, size: int) -> str:
    a, b, h = _arc(lat), _arc(lon), size // 2
    return f"{a}-{h} as min_lat, {a}-{h}+{size - 1} as max_lat, {b}-{h} as min_lon, {b}-{h}+{size - 1} as max_lon"


def _place(size: int) -> str:
    return f"pos as (select device_id, lat, lon, {_window('lat', 'lon', size)} from fx_position where lat is not null and lon is not null)"


def _intent() -> str:
    return f"(43 <= {_floor('min_lat')} and {_floor('max_lat')} <= 46 and 5 <= {_floor('min_lon')} and {_floor('max_lon')} <= 9)"


CELLS = f"""(select distinct cell_lat, unnest(range({_floor('min_lon')}, {_floor('max_lon')}+1))::int as cell_lon from
  (select min_lon, max_lon, unnest(range({_floor('min_lat')}, {_floor('max_lat')}+1))::int as cell_lat from pos))"""

CLEAN = "poi as (select poi_id, ord, coalesce(name_fr, name) as name, trunc(try_cast(ele as double)+0.5::double)::int as elevation, lat, lon from fx_poi where coalesce(name_fr, name) is not null)"


def _pairs(size: int, variant: str) -> str:
    """poi in view of fx_vp with both pixels."""
    d = f"({size // 2 - 1}/3600.0::double)"
    view = f"select v.vp_id, v.lat as vp_lat, v.lon as vp_lon, v.heading, p.*, {_window('v.lat', 'v.lon', size)} from fx_vp v join poi p on p.lat > v.lat-{d} and p.lat < v.lat+{d} and p.lon > v.lon-{d} and p.lon < v.lon+{d}"
    half = "0.5::double" if variant == "web" else "0.0::double"
    if variant == "exact":
        at = f"{_arc('vp_lat')} as vlat, {_arc('vp_lon')} as vlon, {_arc('lat')} as plat, {_arc('lon')} as plon"
    else:
        at = f"max_lat-{size // 2} as vlat, min_lon+{size // 2} as vlon, max_lat-trunc(((vp_lat+{d})-lat)*3600::double+{half})::int as plat, min_lon+trunc((lon-(vp_lon-{d}))*3600::double+{half})::int as plon"
    return f"{CLEAN},\nseen as ({view}),\npairs as (select *, {at} from seen),\nup as (select pairs.*, a.h as vh, b.h as ph from pairs left join fx_dem a on a.ilat = vlat and a.ilon = vlon left join fx_dem b on b.ilat = plat and b.ilon = plon)"


LINES = """ends as (select vp_id, poi_id, vlat, vlon, plat, plon, vh, ph, abs(plon-vlon) as a, abs(plat-vlat) as b, greatest(abs(plon-vlon), abs(plat-vlat)) as n from up),
steps as (select *, unnest(range(0, n+1)) as k from ends),
cells as (select *, (vlat + sign(plat-vlat) * case when n = 0 then 0 else floor((2*k*b+n)/(2.0::double*n)) end)::int as ilat, (vlon + sign(plon-vlon) * case when n = 0 then 0 else floor((2*k*a+n)/(2.0::double*n)) end)::int as ilon from steps)"""

SIGHT = f"""{LINES},
far as (select c.*, d.h, sqrt((plon-vlon)::double*(plon-vlon) + (plat-vlat)::double*(plat-vlat)) as dist, sqrt((c.ilon-vlon)::double*(c.ilon-vlon) + (c.ilat-vlat)::double*(c.ilat-vlat)) as own from cells c left join fx_dem d on d.ilat = c.ilat and d.ilon = c.ilon),
tested as (select vp_id, poi_id, case when n = 0 then false when k = 0 then true when own > dist * 0.94::double then true
  else (h - ((ph - (vh + 2.0::double)) * ((plon-vlon)*(ilon-vlon) + (plat-vlat)*(ilat-vlat))::double / dist / dist + (vh + 2.0::double))) / own < 0.1::double end as clear from far),
lines as (select vp_id, poi_id, count(*) as n_cells, case when not bool_and(clear) then false when count(*) filter (where clear is null) = 0 then true end as visible from tested group by vp_id, poi_id)"""

# squares of 4 x 4 blocks decide stretches of lines by their top and bottom; what lies between the first and last open one is cut into blocks
WORK = f"""{LINES},
b as (select vp_id, poi_id, greatest(n, 1) as m, vh + 2.0::double as eye, ph - vh - 2.0::double as rise, greatest(sqrt((plon-vlon)::double*(plon-vlon) + (plat-vlat)::double*(plat-vlat)), 1.0::double) as d, k, {_floor('ilat', 16)} as bi, {_floor('ilon', 16)} as bj, {_floor('ilat', 64)} as ci, {_floor('ilon', 64)} as cj from cells),
pyramid as (select {_floor('ilat', 64)} as ci, {_floor('ilon', 64)} as cj, max(h) as top, min(h) as bottom, count(*) = 4096 as whole from fx_dem group by 1, 2),
sq as (select vp_id, poi_id, m, eye, rise, d, d/m as u, rise/m as rate, abs(rise)*0.5::double/d as far, ci, cj, min(k) as lo, max(k) as hi, greatest(min(k), 1) as k1 from b group by vp_id, poi_id, m, eye, rise, d, ci, cj),
st as (select sq.*, case when hi = 0 or k1*u - 0.5::double > d*0.94::double or (whole and top + far + 0.000001::double < least(eye + rate*k1, eye + rate*hi) + (k1*u - 0.5::double)*0.1::double) then 1
  when whole and bottom - far - 0.000001::double >= eye + rate*k1 + (k1*u + 0.5::double)*0.1::double and k1*u + 0.5::double < d*0.94::double then 0 end as state from sq left join pyramid using (ci, cj)),
hull as (select vp_id, poi_id, case when coalesce(min(state), 1) = 1 then min(lo) filter (where state is null) end as lo, max(hi) filter (where state is null) as hi from st group by vp_id, poi_id)
select vp_id, poi_id, count(distinct (bi, bj)) as n_blocks, count(distinct (bi, bj)) filter (where k between lo and hi) as n_open from b join hull using (vp_id, poi_id) group by vp_id, poi_id"""

SLOPES = """slope as (select c.ilat, c.ilon, c.h, w.h-e.h as gx, n.h-s.h as gy from fx_dem c join fx_dem w on w.ilat = c.ilat and w.ilon = c.ilon-1 join fx_dem e on e.ilat = c.ilat and e.ilon = c.ilon+1
  join fx_dem n on n.ilon = c.ilon and n.ilat = c.ilat+1 join fx_dem s on s.ilon = c.ilon and s.ilat = c.ilat-1)"""
GREY = "trunc(greatest(0.0::double, -(gx+gy-60.0::double)/sqrt(3.0::double)/sqrt(gx*gx+gy*gy+3600.0::double))*255.9::double)::int"

KNOWN = "known as (select * from up where vh is not null and ph is not null)"
DIST = "sqrt((plon-vlon)::double*(plon-vlon) + (plat-vlat)::double*(plat-vlat) + (ph-vh)*(ph-vh))"


def _r(c: str, name: str) -> str:
    return f"round({c}, 6) + 0.0::double as {name}"


def _rank(source: str) -> str:
    return f"ranks as (select *, row_number() over (partition by vp_id order by prom desc nulls last, ord) as nth from (select *, case when {DIST} > 0 then (ph-vh)/{DIST} end as prom from {source}))"


def _project(alpha: str, beta: str, source: str) -> str:
    """A camera that turns by alpha and leans by beta: gamma = screen = 0."""
    return f"""turned as (select *, (plon-vlon)*{DX} as x0, (plat-vlat)*{DY} as y0, ph-vh-2.0::double as z0, -radians({alpha}) as al, -radians({beta}) as be from {source}),
one as (select *, x0*cos(al)-y0*sin(al) as x1, x0*sin(al)+y0*cos(al) as y1 from turned),
two as (select *, y1*cos(be)-z0*sin(be) as y2, -(y1*sin(be)+z0*cos(be)) as depth from one),
proj as (select *, x1/depth as u, y2/depth as v from two where depth > 1)"""


# upright camera turned by the heading
PROJECT = _project("heading", "90.0::double", "ranks")
# the same with a camera that leans, and a screen that is turned: all four angles
TILTED = f"""turned as (select *, (plon-vlon)*{DX} as x0, (plat-vlat)*{DY} as y0, ph-vh-2.0::double as z0, -radians(heading) as al, -radians(60+vp_id%3*15.0::double) as be, -radians(vp_id%4*10.0::double) as ga, radians(vp_id%2*90.0::double) as sc from ranks),
one as (select *, x0*cos(al)-y0*sin(al) as x1, x0*sin(al)+y0*cos(al) as y1 from turned),
two as (select *, y1*cos(be)-z0*sin(be) as y2, y1*sin(be)+z0*cos(be) as z2 from one),
three as (select *, z2*sin(ga)+x1*cos(ga) as x3, -(z2*cos(ga)-x1*sin(ga)) as depth from two),
proj as (select *, (x3*cos(sc)-y2*sin(sc))/depth as u, (x3*sin(sc)+y2*cos(sc))/depth as v, vp_id%2*90.0::double + degrees(atan2(sin(-ga)*cos(-be), sin(-be))) as inclination from three where depth > 1)"""
YAW = f"""flat as (select *, (plon-vlon)*{DX} as x0, (vlat-plat)*{DY} as y0, radians(heading) as al from known),
yaw as (select *, (x0*cos(al)+y0*sin(al))/depth as u, (ph-vh)/depth as v from (select *, -(y0*cos(al)-x0*sin(al)) as depth from flat) where depth > 0),
ranks as (select *, row_number() over (partition by vp_id order by v desc nulls last, ord) as nth from yaw)"""


def _thin(source: str, slot: str, near: str) -> str:
    """Greedy thinning: labels in order, with the slots kept so far."""
    return f"""slots as (select *, row_number() over (partition by vp_id order by nth) as i, {slot} as slot from {source}),
fold(vp_id, i, held, shown) as (select vp_id, 0::bigint, []::double[], null::boolean from (select distinct vp_id from slots)
  union all select f.vp_id, s.i, case when len(list_filter(f.held, lambda q: abs(q-s.slot) < {near})) > 0 then f.held else list_append(f.held, s.slot) end, len(list_filter(f.held, lambda q: abs(q-s.slot) < {near})) = 0
  from fold f join slots s on s.vp_id = f.vp_id and s.i = f.i+1),
thinned as (select slots.*, fold.shown from slots join fold using (vp_id, i))"""


WEB_SLOT, WEB_NEAR = f"{SCALE!r}::double*(v*cos({PI}::double/4)-u*sin({PI}::double/4))", repr(0.8 * TEXT_HEIGHT) + "::double"
SDL_SLOT, SDL_NEAR = f"{SCALE!r}::double*(u-v)/1.4142135623730951::double", repr(TEXT_HEIGHT) + "::double"
BASE, FULL = ctes("fx_vp", "fx_poi", "fx_dem"), ctes("fx_vp", "fx_poi", "fx_dem", kind="wide")
ORIENTED = ctes("fx_orientation")


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


TEXT = "case when elevation is null then name else name || ' (' || elevation || 'm)' end"
SQL: dict[str, str] = {
    "window_range": f"{ctes('fx_position')}, {_place(2048)} select device_id, min_lat, max_lat, min_lon, max_lon, {', '.join(f'{_floor(c)} as cell_{c}' for c in ('min_lat', 'max_lat', 'min_lon', 'max_lon'))} from pos",
    "coverage_predicate": f"{ctes('fx_position')}, {_place(2048)} select device_id, {_intent()} as intent, (43 <= {_floor('min_lat')} and 5 <= {_floor('min_lon')} and floor((43+2047)/3600.0) <= 46 and floor((5+2047)/3600.0) <= 9) as compat from pos",
    "viewpoint_resolve": f"{ctes('fx_position')}, {_place(2048)}, ok as (select p.device_id, p.lat, p.lon, coalesce({_intent()}, false) as use_geoloc from fx_position p left join pos using (device_id)) select device_id, use_geoloc, case when use_geoloc then lat else 44.3950846::double end as lat, case when use_geoloc then lon else 6.7669714::double end as lon, case when use_geoloc then 0.0::double else 170.0::double end as heading from ok",
    "cell_requirement": f"{ctes('fx_position')}, {_place(2048)} select * from {CELLS}",
    "coverage_gap": f"{ctes('fx_position', 'fx_cell')}, {_place(6144)} select * from {CELLS} c where not exists (select 1 from fx_cell f where f.cell_lat = c.cell_lat and f.cell_lon = c.cell_lon)",
    "poi_load": f"{ctes('fx_poi')}, n as (select *, floor(ord/100.0)::int as doc, (row_number() over (partition by floor(ord/100.0) order by ord) - 1)::int as pos from fx_poi) select doc, pos as ord, coalesce(name_fr, name) as name, lat, lon, trunc(try_cast(ele as double)+0.5::double)::int as elevation, (ele is not null and try_cast(ele as double) is null) as bad_elevation from n where coalesce(name_fr, name) is not null",
    "poi_rejects": f"{ctes('fx_poi')}, n as (select *, floor(ord/100.0)::int as doc, (row_number() over (partition by floor(ord/100.0) order by ord) - 1)::int as pos from fx_poi) select doc, pos as ord, 'no name' as reason from n where doc % 7 <> 3 and coalesce(name_fr, name) is null union all select distinct doc, null::int as ord, 'no document of features' as reason from n where doc % 7 = 3",
    "dem_ingest": f"{ctes('fx_file_px')} select 3600*(cell_lat+1) - 1 - r as ilat, 3600*cell_lon + c as ilon, h from fx_file_px",
    "dem_catalogue": f"{ctes('fx_position')} select device_id, floor(lat)::int as cell_lat, floor(lon)::int as cell_lon from fx_position where lat is not null and lon is not null",
    "poi_extract": f"{ctes('fx_poi')} select poi_id as node_id, name, name_fr, kind as natural, lat, lon, ele from fx_poi where kind in ('peak', 'saddle') and lat between 44.98::double and 45.01::double and lon between 6.99::double and 7.01::double",
    "poi_in_view": f"{BASE}, {_pairs(64, 'exact')} select vp_id, poi_id from pairs",
    "poi_pixel": f"{BASE}, {_pairs(64, 'web')} select vp_id, poi_id, " + ", ".join(f"trunc((lon-(vp_lon-(31/3600.0::double)))*3600::double+{h})::int as {n}_x, trunc(((vp_lat+(31/3600.0::double))-lat)*3600::double+{h})::int as {n}_y" for n, h in (("web", "0.5::double"), ("sdl", "0.0::double"))) + " from pairs",
    "pixel_address": f"""{ctes('fx_poi')}, {CLEAN}, g as (select poi_id, {_arc('lat')} as i, {_arc('lon')} as j from poi), c as (select *, {_floor('i')} as cell_lat, {_floor('j')} as cell_lon from g), t as (select *, (cell_lat+1)*3600-1-i as r, j-cell_lon*3600 as q from c)
select poi_id, cell_lat, cell_lon, {_floor('q', 1024)} as tile_x, {_floor('r', 1024)} as tile_y, {_floor('q', 1024)}+{_floor('r', 1024)}*4 as tile_index, r-{_floor('r', 1024)}*1024 as row, q-{_floor('q', 1024)}*1024 as col,
{_r(f"cell_lat+1-({_floor('r', 1024)}+1)*(1024/3600.0::double)", 'box_lat')}, {_r(f"cell_lon+{_floor('q', 1024)}*(1024/3600.0::double)", 'box_lon')}, {_r(f"cell_lat+1-{_floor('r', 1024)}*(1024/3600.0::double)", 'box_lat_hi')}, {_r(f"cell_lon+({_floor('q', 1024)}+1)*(1024/3600.0::double)", 'box_lon_hi')} from t""",
    "poi_height": f"{ctes('fx_poi', 'fx_dem')}, {CLEAN}, g as (select poi_id, {_arc('lat')} as ilat, {_arc('lon')} as ilon from poi) select g.*, d.h from g left join fx_dem d on d.ilat = g.ilat and d.ilon = g.ilon",
    "window_mosaic": f"{ctes('fx_vp', 'fx_dem')}, w as (select vp_id, {_window('lat', 'lon', 64)} from fx_vp) select vp_id, max_lat-ilat as row, ilon-min_lon as col, ilat, ilon, h from w join fx_dem on ilat between min_lat and max_lat and ilon between min_lon and max_lon",
    "sight_line_cells": f"{BASE}, {_pairs(64, 'exact')}, {LINES} select vp_id, poi_id, k, ilat, ilon from cells",
    "line_of_sight": f"{BASE}, {_pairs(256, 'exact')}, {SIGHT} select * from lines",
    "sight_work": f"{BASE}, {_pairs(256, 'exact')}, {WORK}",
    "visible_poi": f"{BASE}, {_pairs(256, 'exact')}, {SIGHT} select vp_id, poi_id from lines where visible",
    "gradient": f"{ctes('fx_dem')}, {SLOPES} select ilat, ilon, {_r('gx', 'gx')}, {_r('gy', 'gy')} from slope",
    "gradient_arrow": f"{ctes('fx_dem')}, {SLOPES} select ilat, ilon, {_r('gx', 'gx')}, {_r('gy', 'gy')} from slope",
    "normals": f"{ctes('fx_dem')}, {SLOPES}, n as (select *, gx*{DY} as x, gy*{DX} as y, 2*{DX}*{DY} as z from slope), m as (select *, 127.0::double/sqrt(x*x+y*y+z*z) as f from n) select ilat, ilon, trunc(x*f)::tinyint as nx, trunc(y*f)::tinyint as ny, trunc(z*f)::tinyint as nz from m",
    "hillshade_nw": f"{ctes('fx_dem')}, {SLOPES} select ilat, ilon, {GREY} as grey from slope",
    "hillshade_relief": f"{ctes('fx_dem')}, {SLOPES}, n as (select *, gx*{DY} as x, gy*{DX} as y, 2*{DX}*{DY} as z from slope) select ilat, ilon, {_r('greatest(0.0::double, (-x+y+2*z)/sqrt(x*x+y*y+z*z)/sqrt(6.0::double))', 'light')} from n",
    "gradient_pyramid": f"{ctes('fx_dem')}, {SLOPES} select level, floor(ilat/(2.0::double**level))::int as row, floor(ilon/(2.0::double**level))::int as col, round(avg(gx), 12) + 0.0::double as gx, round(avg(gy), 12) + 0.0::double as gy from slope, (select unnest(range(1, 7))::int as level) group by 1, 2, 3",
    "poi_rank": f"{BASE}, {_pairs(128, 'web')}, {KNOWN}, {_rank('known')} select vp_id, poi_id, {_r('prom', 'prominence')}, nth from ranks",
    "poi_rank_depth": f"{BASE}, {_pairs(128, 'sdl')}, {KNOWN}, {YAW} select vp_id, poi_id, {_r('v', 'v')}, nth from ranks",
    "poi_project": f"{BASE}, {_pairs(128, 'web')}, {KNOWN}, {_rank('known')}, {PROJECT} select vp_id, poi_id, {_r('u', 'u')}, {_r('v', 'v')}, {_r(f'u*{SCALE!r}::double', 'sx')}, {_r(f'v*({4 / 3!r}::double*{SCALE!r}::double)', 'sy')}, 0.0::double as inclination from proj",
    "poi_project_tilted": f"{BASE}, {_pairs(128, 'web')}, {KNOWN}, {_rank('known')}, {TILTED} select vp_id, poi_id, {_r('u', 'u')}, {_r('v', 'v')}, {_r(f'u*({SCALE!r}::double/0.75::double)', 'sx')}, {_r(f'v*{SCALE!r}::double', 'sy')}, {_r('inclination', 'inclination')} from proj",
    "poi_project_yaw": f"{BASE}, {_pairs(128, 'sdl')}, {KNOWN}, {YAW} select vp_id, poi_id, {_r('u', 'u')}, {_r('v', 'v')} from ranks",
    "label_thin": _recursive(f"{BASE}, {_pairs(128, 'web')}, {KNOWN}, {_rank('known')}, {PROJECT}, {_thin('proj', WEB_SLOT, WEB_NEAR)} select vp_id, poi_id, nth, shown from thinned"),
    "label_thin_drop": _recursive(f"{BASE}, {_pairs(128, 'sdl')}, {KNOWN}, {YAW}, {_thin('ranks', SDL_SLOT, SDL_NEAR)} select vp_id, poi_id, nth from thinned where shown"),
    "label_text": f"{ctes('fx_poi')}, {CLEAN} select poi_id, {TEXT} as text from poi",
    "pose_latest": f"{ORIENTED} select device_id, max(ts) as ts, arg_max(alpha, (ts, event_id)) as alpha, arg_max(beta, (ts, event_id)) as beta, arg_max(gamma, (ts, event_id)) as gamma, arg_max(screen, (ts, event_id)) as screen from fx_orientation group by device_id",
    "pose_frames": f"{ORIENTED} select device_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as frame_start, arg_max(alpha, (ts, event_id)) as alpha, arg_max(beta, (ts, event_id)) as beta, arg_max(gamma, (ts, event_id)) as gamma, arg_max(screen, (ts, event_id)) as screen from fx_orientation group by 1, 2",
    "pose_changes": f"{ORIENTED}, l as (select *, lag((alpha, beta, gamma, screen)) over w as before, row_number() over w as n from fx_orientation window w as (partition by device_id order by ts, event_id)) select event_id, device_id, alpha, beta, gamma, screen from l where n = 1 or before is distinct from (alpha, beta, gamma, screen)",
    "pose_stream": f"{ORIENTED}, l as (select *, lag((alpha, beta, gamma, screen)) over w as before, row_number() over w as n from fx_orientation window w as (partition by device_id order by ts, event_id)) select event_id, device_id, alpha, beta, gamma, screen from l where n = 1 or before is distinct from (alpha, beta, gamma, screen)",
    "pose_from_keys": _recursive(f"""{ctes('fx_key')}, o as (select *, row_number() over (partition by device_id order by ts, seq) as i from fx_key),
s(device_id, i, seq, alpha, beta) as (select distinct device_id, 0::bigint, 0::bigint, 0.0::double, 90.0::double from o union all
  select o.device_id, o.i, o.seq, s.alpha + case code when 'ArrowLeft' then 5 when 'ArrowRight' then -5 else 0 end, case code when 'ArrowUp' then least(120.0::double, s.beta+5) when 'ArrowDown' then greatest(60.0::double, s.beta-5) else s.beta end from s join o on o.device_id = s.device_id and o.i = s.i+1)
select device_id, seq, alpha, beta from s where i > 0"""),
    "panorama_labels": _recursive(f"{BASE}, {_pairs(128, 'web')}, {SIGHT}, clear as (select up.* from up join lines using (vp_id, poi_id) where visible), {_rank('clear')}, {PROJECT}, {_thin('proj', WEB_SLOT, WEB_NEAR)} select vp_id, poi_id, {TEXT} as text, nth, {_r('u', 'u')}, {_r('v', 'v')}, {_r(f'u*{SCALE!r}::double', 'sx')}, {_r(f'v*({4 / 3!r}::double*{SCALE!r}::double)', 'sy')}, shown from thinned"),
    "labels_stream": _recursive(f"""{ctes('fx_vp', 'fx_poi', 'fx_dem', 'fx_orientation')}, {_pairs(64, 'web')}, {SIGHT}, clear as (select up.* from up join lines using (vp_id, poi_id) where visible), {_rank('clear')},
l as (select *, lag((alpha, beta, gamma, screen)) over w as before, row_number() over w as n from fx_orientation window w as (partition by device_id order by ts, event_id)),
changed as (select event_id, device_id, alpha, beta from l where n = 1 or before is distinct from (alpha, beta, gamma, screen)),
posed as (select r.* replace (c.event_id as vp_id), c.alpha, c.beta from ranks r join changed c on r.vp_id = c.device_id % 25), {_project('alpha', 'beta', 'posed')}, {_thin('proj', WEB_SLOT, WEB_NEAR)}
select vp_id as event_id, poi_id, {TEXT} as text, nth, {_r('u', 'u')}, {_r('v', 'v')}, {_r(f'u*{SCALE!r}::double', 'sx')}, {_r(f'v*({4 / 3!r}::double*{SCALE!r}::double)', 'sy')}, shown from thinned"""),
    "labels_written": _recursive(f"{BASE}, {_pairs(128, 'web')}, {SIGHT}, clear as (select up.* from up join lines using (vp_id, poi_id) where visible), {_rank('clear')}, {PROJECT}, {_thin('proj', WEB_SLOT, WEB_NEAR)} select vp_id, poi_id, {TEXT} as text, nth, {_r('u', 'u')}, {_r('v', 'v')}, {_r(f'u*{SCALE!r}::double', 'sx')}, {_r(f'v*({4 / 3!r}::double*{SCALE!r}::double)', 'sy')}, shown from thinned"),
    "panorama_full_window": _recursive(f"{FULL}, {_pairs(2048, 'web')}, {SIGHT}, clear as (select up.* from up join lines using (vp_id, poi_id) where visible), {_rank('clear')}, {PROJECT}, {_thin('proj', WEB_SLOT, WEB_NEAR)} select vp_id, poi_id, {TEXT} as text, nth, {_r('u', 'u')}, {_r('v', 'v')}, {_r(f'u*{SCALE!r}::double', 'sx')}, {_r(f'v*({4 / 3!r}::double*{SCALE!r}::double)', 'sy')}, shown from thinned"),
    "panorama_labels_drop": _recursive(f"{BASE}, {_pairs(128, 'sdl')}, {SIGHT}, known as (select up.* from up join lines using (vp_id, poi_id) where visible), {YAW}, {_thin('ranks', SDL_SLOT, SDL_NEAR)} select vp_id, poi_id, {TEXT} as text, nth, {_r('u', 'u')}, {_r('v', 'v')}, {_r(f'u*{SCALE!r}::double', 'sx')}, {_r(f'v*({4 / 3!r}::double*{SCALE!r}::double)', 'sy')}, shown from thinned where shown"),
    "relief_map": f"""{ctes('fx_vp', 'fx_dem')}, w as (select vp_id, {_window('lat', 'lon', 64)} from fx_vp), m as (select vp_id, max_lat-ilat as row, ilon-min_lon as col, h from w join fx_dem on ilat between min_lat and max_lat and ilon between min_lon and max_lon),
g as (select c.vp_id, c.row, c.col, w.h-e.h as gx, n.h-s.h as gy from m c join m w on w.vp_id = c.vp_id and w.row = c.row and w.col = c.col-1 join m e on e.vp_id = c.vp_id and e.row = c.row and e.col = c.col+1 join m n on n.vp_id = c.vp_id and n.col = c.col and n.row = c.row-1 join m s on s.vp_id = c.vp_id and s.col = c.col and s.row = c.row+1)
select vp_id, trunc(col/2.0)::int as px, trunc((63-row)/2.0)::int as py, arg_max({GREY}, (row, col)) as grey from g group by 1, 2, 3""",
    "relief_markers": f"{BASE}, {_pairs(64, 'sdl')} select vp_id, poi_id, name, floor((plon-min_lon)/2.0)::int as px, floor((plat-min_lat)/2.0)::int as py, ph as h from up",
}
