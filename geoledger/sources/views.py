"""Derived views over the driver's tables; one expression list serves Spark and the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Side of one square district in metres. Keys fill district after district, so that density stays the same at any scale.
DISTRICT = 80100


def _hash(a: int, b: int, c: int, key: str) -> str:
    k = f"(cast({key} as bigint) % 40009)"
    return f"(2 * (({k} * {k} * {a} + {k} * {b} + {c}) % 40009))"


def h1(key: str) -> str:
    return _hash(7919, 104729, 0, key)


def h2(key: str) -> str:
    return _hash(31, 7907, 17, key)


def _district(key: str, size: int) -> str:
    return f"cast(floor({key} / {size}) as bigint) * {DISTRICT}"


_X = f"{h1('c_custkey')} + {_district('c_custkey', 1500)}"
_BOX = {
    "id": "cast(c_custkey as bigint)", "xmin": _X, "ymin": h2("c_custkey"),
    "xmax": f"{_X} + 20 + c_custkey % 50", "ymax": f"{h2('c_custkey')} + 20 + (c_custkey * 31) % 50",
    "parcel_id": "case when c_custkey % 11 = 0 then null else cast(floor(c_custkey / 2) as bigint) end", "excluded": "c_custkey % 37 = 0", "animal_type": "c_mktsegment",
}
_COPY = _BOX | {"id": "-1 - cast(c_custkey as bigint)", "xmin": f"{_X} + 1", "ymin": f"{h2('c_custkey')} + 1"}
_PX = f"{h1('p_partkey * 3 + 1')} + {_district('p_partkey', 2000)}"
_TX = f"cast(p_partkey % 40 as bigint) * 2002 + {_district('p_partkey', 1600)}"
_TY = "cast(floor((p_partkey % 1600) / 40) as bigint) * 2002"


def _owner(key: str) -> str:
    return f"case when ({key}) % 13 = 0 then '' else concat(p_name, ' ', p_type, case when ({key}) % 3 = 0 then ' Family Trust, LLC' when ({key}) % 3 = 1 then ' & Sons Dairy' else ' Farms Inc.' end) end"


#: view -> [(table, columns, condition)], united in order
VIEWS: dict[str, list[tuple[str, dict[str, str], str]]] = {
    "building": [("customer", _BOX, "true"), ("customer", _COPY, "c_custkey % 50 = 0")],
    "permit": [
        (
            "part",
            {
                "id": "cast(p_partkey as bigint)", "rx": _PX, "ry": h2("p_partkey * 3 + 1"),
                "gx": f"case when p_size % 10 = 0 then null else {_PX} + p_size * 10 end", "gy": f"case when p_size % 10 = 0 then null else {h2('p_partkey * 3 + 1')} end",
                "status": "case when p_partkey % 3 = 0 then 'Historical' else 'Active' end", "program": "p_type", "population": "cast(p_size * 20 as bigint)",
            },
            "true",
        )
    ],
    "tile": [
        (
            "part",
            {
                "id": "cast(p_partkey as bigint)", "xmin": _TX, "ymin": _TY, "xmax": f"{_TX} + 2002", "ymax": f"{_TY} + 2002",
                "bucket": "case p_size % 8 when 0 then null when 1 then '0' when 2 then '1' when 3 then '1.25' when 4 then '1.75' when 5 then '3' when 6 then 'inf' else 'ex ante permit' end",
            },
            "true",
        )
    ],
    "tile_annotation": [("events", {"id": "event_id", "tile_id": "cast(floor(event_id / 6) as bigint)", "annotator": "cast(user_id % 4 as bigint)", "label": "event_type"}, "true")],
    "cafo_annotation": [("orders", {"building_id": "cast(o_custkey as bigint)", "is_cafo": "o_orderkey % 40 <> 0", "annotated_on": "o_orderdate", "phase": "cast(o_orderkey % 2 as int)"}, "true")],
    "construction_annotation": [("orders", {"building_id": "cast(o_custkey as bigint)", "built": "cast(year(o_orderdate) as int)", "destroyed": "case when o_orderstatus = 'F' then cast(year(o_orderdate) + 18 as int) end", "annotated": "o_orderkey"}, "true")],
    "type_annotation": [("orders", {"building_id": "cast(o_custkey as bigint)", "animal_type": "case o_orderstatus when 'F' then 'cattle' when 'O' then 'dairy' else 'poultry' end", "annotated": "cast(year(o_orderdate) as int)"}, "true")],
    "parcel": [("part", {"id": "cast(p_partkey as bigint)", "owner": _owner("p_partkey"), "number": "cast(floor(p_partkey / 3) as bigint)", "xmin": f"{_PX} + 100 - (p_partkey % 5) * 60", "ymin": f"{h2('p_partkey * 3 + 1')} - 200", "xmax": f"{_PX} + 600 - (p_partkey % 5) * 60", "ymax": f"{h2('p_partkey * 3 + 1')} + 300"}, "true")],
    "label_point": [("orders", {"id": "cast(o_orderkey as bigint)", "x": f"{h1('o_custkey')} + {_district('o_custkey', 1500)} + o_orderkey % 160 - 40", "y": f"{h2('o_custkey')} + (o_orderkey * 7) % 120 - 30"}, "true")],
    "owner_verdict": [("part", {"name": "concat(p_name, ' ', p_type, ' Farms Inc.')", "related": "concat(p_name, ' ', p_type, ' & Sons Dairy')", "matched": "p_size % 2 = 0"}, "true")],
    "rating": [("labels", {"id": "doc_id", "a": "quality = 1", "b": "toxic = 1"}, "true")],
    "county": [
        (
            "nation",
            {
                "id": "cast(n_nationkey as bigint)", "name": "n_name", "county_group": "cast(n_regionkey as bigint)", "xmin": "cast(n_nationkey % 5 as bigint) * 16020", "ymin": "cast(floor(n_nationkey / 5) as bigint) * 16020",
            },
            "true",
        )
    ],
    "urban_mask": [("region", {"id": "cast(r_regionkey as bigint)", "xmin": "cast(r_regionkey * 15000 as bigint)", "ymin": "cast(r_regionkey * 15000 as bigint)", "xmax": "cast(r_regionkey * 15000 + 12000 as bigint)", "ymax": "cast(r_regionkey * 15000 + 12000 as bigint)"}, "true")],
}


def _grid_corner(i: str, j: str) -> tuple[str, str]:
    """A corner of the counties' grid, moved by up to 1200 m inside the district."""
    moved = lambda a, b, m: f"(16020 * {a} + case when {a} in (0, 5) then 0 else (({a} * {m} + {b} * 91) % 7 - 3) * 400 end)"
    return moved(i, j, 37), moved(j, i, 53)


#: shape view -> (view, columns to build on, rings of corners): outlines counterclockwise, then holes clockwise
SHAPES: dict[str, tuple[str, dict[str, str], list[list[tuple[str, str]]]]] = {
    "building_shape": (  # an L with a court
        "building",
        {"x": "xmin", "y": "ymin", "w": "xmax - xmin", "h": "ymax - ymin", "u": "cast(floor((xmax - xmin) / 2) as bigint)", "v": "cast(floor((ymax - ymin) / 2) as bigint)"},
        [[("x", "y"), ("x + w", "y"), ("x + w", "y + v"), ("x + u", "y + v"), ("x + u", "y + h"), ("x", "y + h")], [("x + 2", "y + 2"), ("x + 2", "y + 6"), ("x + 6", "y + 6"), ("x + 6", "y + 2")]],
    ),
    "parcel_shape": (  # a slanted field with a notch
        "parcel",
        {"x": "xmin", "y": "ymin"},
        [[("x", "y + 240"), ("x + 260", "y"), ("x + 500", "y + 230"), ("x + 270", "y + 500"), ("x + 210", "y + 260")]],
    ),
    "county_shape": (
        "county",
        {"i": "cast(floor(xmin / 16020) as bigint)", "j": "cast(floor(ymin / 16020) as bigint)"},
        [[_grid_corner("i", "j"), _grid_corner("(i + 1)", "j"), _grid_corner("(i + 1)", "(j + 1)"), _grid_corner("i", "(j + 1)")]],
    ),
    "mask_shape": (  # a box without its corners
        "urban_mask",
        {"x": "xmin", "y": "ymin"},
        [[("x + 3000", "y"), ("x + 9000", "y"), ("x + 12000", "y + 3000"), ("x + 12000", "y + 9000"), ("x + 9000", "y + 12000"), ("x + 3000", "y + 12000"), ("x", "y + 9000"), ("x", "y + 3000")]],
    ),
    "tile_shape": ("tile", {"x": "xmin", "y": "ymin"}, [[("x", "y"), ("x + 2002", "y"), ("x + 2002", "y + 2002"), ("x", "y + 2002")]]),
}


def shapes(spark: SparkSession, sf_dir: str, name: str, where: str = "true") -> DataFrame:
    """``(id, polys)`` of a shape view, of the rows of its view that ``where`` names."""
    base, columns, rings = SHAPES[name]
    ring = lambda r: "array(" + ", ".join(f"named_struct('x', double({x}), 'y', double({y}))" for x, y in r) + ")"
    built = view(spark, sf_dir, base).where(where).selectExpr("id", *[f"{e} as {c}" for c, e in columns.items()])
    return built.selectExpr("id", f"array(array({', '.join(map(ring, rings))})) as polys")


def edges_sql(name: str) -> str:
    """SQL of the edges (id, ring, x1, y1, x2, y2) of a shape view; its own view is named beside it."""
    base, columns, rings = SHAPES[name]
    each = [f"[{k}, {r[i][0]}, {r[i][1]}, {r[(i + 1) % len(r)][0]}, {r[(i + 1) % len(r)][1]}]" for k, r in enumerate(rings) for i in range(len(r))]
    names = ", ".join(f"cast(e[{k + 1}] as {'bigint' if k == 0 else 'double'}) as {c}" for k, c in enumerate(["ring", "x1", "y1", "x2", "y2"]))
    built = f"select id, {', '.join(f'{e} as {c}' for c, e in columns.items())} from {base}"
    return f"{name.replace('_shape', '_edge')} as (select id, {names} from (select id, unnest([{', '.join(each)}]) as e from ({built})))"


def county_of(x: str, y: str) -> str:
    """The county (one of 25 boxes a district) that holds a point."""
    return f"cast(floor((({x}) % {DISTRICT}) / 16020) as bigint) + 5 * cast(floor(({y}) / 16020) as bigint)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = None
    for table, columns, condition in VIEWS[name]:
        one = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(condition).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])
        parts = one if parts is None else parts.unionByName(one)
    return parts


def view_sql(name: str) -> str:
    each = [f"select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table} where {condition}" for table, columns, condition in VIEWS[name]]
    return f"{name} as ({' union all '.join(each)})"


def with_views(names: list[str], sql: str, recursive: bool = False) -> str:
    if not names:
        return sql
    return f"with {'recursive ' if recursive else ''}{', '.join(view_sql(n) for n in names)}{sql}"
