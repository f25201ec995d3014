"""GeoPackage vector files: a reader and a writer on Python's own SQLite, for layers of driver size (areas, boundaries).

Layers of data size belong in Parquet with a ring column; this is the exchange format for small ones.
"""

from __future__ import annotations

import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession

LIMIT = 100_000


def wkb_polygon(ring: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", x, y) for x, y in ring)


def parse_wkb(data: bytes) -> list[tuple[float, float]]:
    """Points of a WKB point, line or polygon (its outer ring)."""
    order = "<" if data[0] == 1 else ">"
    kind = struct.unpack_from(order + "I", data, 1)[0]
    if kind == 1:
        return [struct.unpack_from(order + "dd", data, 5)]
    at = 9 if kind == 3 else 5
    n = struct.unpack_from(order + "I", data, at)[0]
    return [struct.unpack_from(order + "dd", data, at + 4 + 16 * i) for i in range(n)]


def write(df: DataFrame, path: str, layer: str, srid: int) -> None:
    """Rows (name, ring) as a GeoPackage polygon layer at a local path; refuses layers of data size."""
    rows = df.select("name", "ring").limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} rows: write Parquet instead")
    con = sqlite3.connect(path)
    con.executescript(f"""pragma application_id = 1196444487; pragma user_version = 10300;
        create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
        create table gpkg_contents (table_name text primary key, data_type text not null, identifier text, description text default '', last_change text, min_x double, min_y double, max_x double, max_y double, srs_id integer);
        create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
        insert into gpkg_spatial_ref_sys values ('EPSG:{srid}', {srid}, 'EPSG', {srid}, 'undefined', null);
        create table "{layer}" (fid integer primary key autoincrement, name text, geom blob);
        insert into gpkg_contents (table_name, data_type, identifier, srs_id) values ('{layer}', 'features', '{layer}', {srid});
        insert into gpkg_geometry_columns values ('{layer}', 'geom', 'POLYGON', {srid}, 0, 0);""")
    head = b"GP" + struct.pack("<BBi", 0, 1, srid)
    con.executemany(f'insert into "{layer}" (name, geom) values (?, ?)', [(r.name, head + wkb_polygon([(p.x, p.y) for p in r.ring])) for r in rows])
    con.commit()
    con.close()


def read(spark: SparkSession, path: str, layer: str) -> DataFrame:
    con = sqlite3.connect(path)
    srid = con.execute("select srs_id from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()[0]
    rows = con.execute(f'select name, geom from "{layer}" order by fid').fetchall()
    con.close()
    envelope = (0, 32, 48, 48, 64)
    parsed = [(name, srid, [(float(x), float(y)) for x, y in parse_wkb(g[8 + envelope[(g[3] >> 1) & 7] :])]) for name, g in rows]
    return spark.createDataFrame(parsed, "name string, srid int, ring array<struct<x:double,y:double>>")
