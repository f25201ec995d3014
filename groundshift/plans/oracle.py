"""DuckDB SQL for the derived views, as chained common table expressions."""

from __future__ import annotations

_BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")


def _nd(a: str, b: str) -> str:
    return f"cast(case when {a} + {b} <> 0 then greatest(-1.0::double, least(1.0::double, cast((({a}) - ({b})) / (({a}) + ({b})) as float)::double)) end as float)"


def median(band: str) -> str:
    return f"cast(median(cast({band} as double)) as float) as {band}"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "px": ((), """select l_orderkey || '-' || l_linenumber as scene_id, l_shipdate as ts,
        case when year(l_shipdate) < 1998 then 't1' when year(l_shipdate) > 1998 then 't2' end as epoch,
        cast((l_orderkey % 1600) // 40 as int) as "row", cast(l_orderkey % 40 as int) as col,
        cast(((l_orderkey // 1600) * 5 + l_linenumber * 3) % 12 as int) as scl,
        cast(0.02e0 + l_tax as float) as b02,
        cast(0.01e0 + l_discount + 0.04e0 * ((l_orderkey % 1600) * 5 % 7) as float) as b03,
        cast(0.02e0 + l_discount as float) as b04,
        cast(l_quantity * 0.008e0 * (0.2e0 + ((l_orderkey % 1600) * 7 % 13) / 8.0e0) * (case when year(l_shipdate) > 1998 and (l_orderkey % 1600) * 11 % 17 < 5 then 0.3e0 else 1.0e0 end) as float) as b08,
        cast(0.05e0 + ((l_orderkey % 1600) * 3 % 11) * 0.03e0 as float) as b11,
        cast(l_linenumber * 0.05e0 as float) as b12 from lineitem"""),
    "masked": (("px",), 'select scene_id, ts, epoch, "row", col, scl, valid, ' + ", ".join(f"case when valid then {b} end as {b}" for b in _BANDS) + " from (select *, coalesce(scl not in (0,1,2,3,8,9,10,11) and " + " and ".join(f"{b} is not null" for b in _BANDS) + ", false) as valid from px)"),
    "comp": (("masked",), 'select epoch, "row", col, ' + ", ".join(map(median, _BANDS)) + ' from masked where epoch is not null group by epoch, "row", col'),
    "idx": (("comp",), f'select *, {_nd("b08", "b04")} as ndvi, {_nd("b11", "b08")} as ndbi, {_nd("b03", "b11")} as mndwi, {_nd("(b11 + b04)", "(b08 + b02)")} as bsi from comp'),
    "cls": (("idx",), """select *, case when ndvi is null or ndbi is null or mndwi is null or bsi is null then 0 when mndwi > 0 then 5 when ndbi > ndvi and ndbi > 0 then 1
        when ndvi > cast(0.5 as float) then 2 when ndvi > cast(0.25 as float) then 3 when bsi > 0 then 4 else 0 end as class_id from idx"""),
    "spine": ((), 'select cast(i // 40 as int) as "row", cast(i % 40 as int) as col from range(1600) t(i)'),
    "lulc": (("cls", "spine"), """select e.epoch, s."row", s.col, coalesce(c.class_id, 0) as class_id from spine s cross join (values ('t1'), ('t2')) e(epoch)
        left join cls c on c.epoch = e.epoch and c."row" = s."row" and c.col = s.col"""),
    "pairs": (("lulc",), """select "row", col, max(case when epoch = 't1' then class_id end) as c1, max(case when epoch = 't2' then class_id end) as c2 from lulc group by "row", col"""),
    "frame": ((), "select cast(i // 5 + 1 as int) as c1, cast(i % 5 + 1 as int) as c2 from range(25) t(i)"),
    "trans": (("pairs", "frame"), "select f.c1, f.c2, count(p.c1) as pixels from frame f left join pairs p on p.c1 = f.c1 and p.c2 = f.c2 group by f.c1, f.c2"),
    "masks": (("pairs",), """select "row", col, case when ok then cast(c1 <> 1 and c2 = 1 as int) end as urban, case when ok then cast(c1 in (2, 3) and c2 not in (2, 3) as int) end as veg_loss,
        case when ok then cast((c1 = 5) <> (c2 = 5) as int) end as water_change, case when ok then cast(c1 = c2 as int) end as unchanged
        from (select *, c1 between 1 and 5 and c2 between 1 and 5 as ok from pairs)"""),
    "grid": (("masks",), """select cast(r * 10 + c as int) as cell_id, r as row_idx, c as col_idx, gain_ha, loss_ha, overlap_ha, valid_frac from (select cast("row" // 4 as int) as r, cast(col // 4 as int) as c,
        sum(case when urban = 1 then 1 else 0 end) * 100.0e0 / 10000.0e0 as gain_ha, sum(case when veg_loss = 1 then 1 else 0 end) * 100.0e0 / 10000.0e0 as loss_ha,
        sum(case when urban = 1 and veg_loss = 1 then 1 else 0 end) * 100.0e0 / 10000.0e0 as overlap_ha, avg(case when urban is not null then 1.0e0 else 0.0e0 end) as valid_frac from masks group by 1, 2)"""),
    "edges": (("grid",), "select a.cell_id as src, b.cell_id as dst from grid a join grid b on abs(a.row_idx - b.row_idx) <= 1 and abs(a.col_idx - b.col_idx) <= 1 and a.cell_id <> b.cell_id"),
    "gi": (("grid", "edges"), """select g.cell_id, g.loss_ha, z, coalesce(z > 0 and z >= 1.6448536269514715e0, false) as significant from grid g join
        (select n.src, (n.wx - t.mean * n.w) / nullif(sqrt(t.s2 * (t.n * n.w - n.w * n.w) / (t.n - 1)), 0) as z from
        (select e.src, sum(g.loss_ha) as wx, count(*)::double as w from (select * from edges union all select cell_id, cell_id from grid) e join grid g on g.cell_id = e.dst group by e.src) n,
        (select count(*)::double as n, avg(loss_ha) as mean, var_pop(loss_ha) as s2 from grid) t) x on x.src = g.cell_id"""),
    "scenes": ((), """select case when o_orderkey % 97 = 0 then 'S2' || u || '_' || d || '_' || o_orderkey else 'S2' || u || '_' || tile || '_' || d || '_' || o_orderkey end as id,
        'sentinel-2' || lower(u) as platform, case when o_orderkey % 97 <> 0 and o_orderkey % 5 <> 0 then tile end as mgrs, o_orderdate as datetime, baseline, o_totalprice % 100 as cloud,
        case o_orderstatus when 'F' then true when 'O' then false end as boa_flag, o_orderstatus <> 'P' as boa_present, case when o_orderkey % 2 = 0 then -0.1e0 else 0.0e0 end as "offset"
        from (select *, (['A', 'B', 'C'])[o_orderkey % 3 + 1] as u, (['44RKU', '44RLU', '43RGP', '43RGQ'])[o_custkey % 4 + 1] as tile, strftime(o_orderdate, '%Y%m%d') as d,
        (['05.11', '05.00', '02.12', '00.01', 'n/a'])[cast(substr(o_orderpriority, 1, 1) as int)] as baseline from orders)"""),
    "tiled": (("scenes",), """select *, coalesce(nullif(mgrs, ''), nullif(regexp_extract(id, '[0-9]{2}[A-Z]{3}', 0), '')) as tile, cast(datetime as date) as day, coalesce(try_cast(baseline as double), 0.0e0) as base_no,
        case lower(platform) when 'sentinel-2a' then 0 when 'sentinel-2b' then 1 when 'sentinel-2c' then 2 else 3 end as rank_no from scenes"""),
    "ranked": (("tiled",), """select *, row_number() over w as place, first_value(id) over w as kept_id, first_value(base_no) over w as kept_base from tiled
        window w as (partition by tile, day, case when tile is null or day is null then id end order by base_no desc, rank_no, id)"""),
    "epochs": (("scenes",), "select * from (select case when year(datetime) < 1998 then 't1' when year(datetime) > 1998 then 't2' end as epoch, month(datetime) as month, id, datetime from scenes) where epoch is not null"),
    "dem": (("spine",), 'select "row", col, 500.0e0 + sin("row" / 5.0e0) * 10 + col * 3 + ("row" * col % 7) as elevation from spine'),
    "grad": (("dem",), """select *, case when lag(elevation) over x is null then (lead(elevation) over x - elevation) / 30.0e0 when lead(elevation) over x is null then (elevation - lag(elevation) over x) / 30.0e0 else (lead(elevation) over x - lag(elevation) over x) / 60.0e0 end as dz_dx,
        case when lag(elevation) over y is null then (lead(elevation) over y - elevation) / 30.0e0 when lead(elevation) over y is null then (elevation - lag(elevation) over y) / 30.0e0 else (lead(elevation) over y - lag(elevation) over y) / 60.0e0 end as dz_dy
        from dem window x as (partition by "row" order by col), y as (partition by col order by "row")"""),
    "labels_ref": (("pairs",), """select "row" * 40 + col as id, "row", col, (col + 0.5e0) * 500 as x, ("row" + 0.5e0) * 500 as y, c2 as class_a, case when ("row" * 40 + col) % 11 = 0 then c2 % 5 + 1 else c2 end as class_b from pairs where ("row" * 40 + col) % 7 = 0"""),
    "ext": (("spine",), 'select "row", col, ("row" * 40 + col) * 13 % 10 < 4 as built, ("row" * 40 + col) % 26 as lossyear, ("row" * 40 + col) * 17 % 101 as treecover, ("row" * 40 + col) % 9 <> 0 as datamask from spine'),
    "conf": (("labels_ref", "frame"), "select f.c1 as truth, f.c2 as predicted, count(l.id) as n from frame f left join labels_ref l on l.class_b = f.c1 and l.class_a = f.c2 group by 1, 2"),
    "report": (("conf",), """select t.class_id, coalesce(hit / nullif(claimed, 0)::double, 0) as "precision", coalesce(hit / nullif(support, 0)::double, 0) as recall, support from
        (select truth as class_id, sum(n) as support, sum(case when truth = predicted then n else 0 end) as hit from conf group by 1) t join (select predicted as class_id, sum(n) as claimed from conf group by 1) p using (class_id)"""),
    "t2": (("lulc",), """select "row", col, class_id from lulc where epoch = 't2'"""),
    "flagged": (("px",), """select epoch, scene, band, v, flag from (select epoch, cast(split_part(scene_id, '-', 1) as bigint) % 50 as scene, cast(split_part(scene_id, '-', 1) as bigint) % 2 = 0 as flag, unnest(['b02', 'b03', 'b04']) as band, unnest([b02, b03, b04]) as v from px where epoch is not null)"""),
}


def query(select: str, *views: str) -> str:
    """select over the views that it names, with all that they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for v in views:
        visit(v)
    ctes = ", ".join(f"{v} as ({VIEWS[v][1]})" for v in order)
    return f"with recursive {ctes} {select}" if ctes else select
