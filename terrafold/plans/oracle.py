"""The star-schema library in DuckDB SQL: common table expressions that the queries' SQL twins build on."""

from __future__ import annotations

from ..sources.star import NATIONS, PARTS, REGIONS, SUPPLIERS, TIES


def x(k: str) -> str:
    return f"(((({k}) * 7919 + 17) % 4000) * 1000000 - 2000000000)"


def y(k: str) -> str:
    return f"(((({k}) * 104729 + 31) % 3000) * 1000000 - 1500000000)"


def tags(**kv: str) -> str:
    parts = ", ".join(f"{{'k': '{k}', 'v': CAST({v} AS VARCHAR)}}" for k, v in kv.items())
    return f"map_from_entries(list_filter([{parts}], lambda e: e.v IS NOT NULL))"


def number(v: str) -> str:
    return rf"TRY_CAST(NULLIF(regexp_extract({v}, '^[\x00-\x20]*(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))', 1), '') AS DOUBLE)"


def stored(v: str) -> str:
    return (
        rf"(regexp_full_match({v}, '-?(0|[1-9][0-9]*)(\.[0-9]{{1,3}})?') AND NOT regexp_full_match({v}, '-0(\.0*)?') "
        rf"AND coalesce(TRY_CAST(replace({v}, '.', '') AS BIGINT) BETWEEN -256 AND 1073741567, false))"
    )


def text(key: str, test: str) -> str:
    """A test of v, the value of a key, where it is no number; false where it is absent."""
    v = f"tags['{key}']"
    return f"coalesce(({test.replace('@', v)}) AND NOT {stored(v)}, false)"


def numeric(key: str, test: str) -> str:
    return f"coalesce({number(f"tags['{key}']")} {test}, false)"


_W = "((CAST(n_nationkey AS BIGINT) % 5) * 800000000 - 2000000000)"
_S = "((CAST(n_nationkey AS BIGINT) // 5) * 600000000 - 1500000000)"
_NODE = "0 AS type, {id} AS id, false AS is_area, {m} AS is_member, {w} AS is_waynode, {x} AS min_x, {y} AS min_y, {x} AS max_x, {y} AS max_y, {t} AS tags"


def node(number_: str, member: str, waynode: str, tag_map: str) -> str:
    return _NODE.format(id=number_, m=member, w=waynode, x=x(number_), y=y(number_), t=tag_map)


SEGMENT = "CASE WHEN c_custkey % 7 = 0 THEN 'no' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END"
SIZE = "CASE WHEN p_partkey % 13 = 0 THEN 'n/a' WHEN p_partkey % 5 = 0 THEN p_size || ' mm' ELSE CAST(p_size AS VARCHAR) END"
PRELUDE = f"""
WITH kept AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)),
way_nodes AS (
  SELECT CAST(l_orderkey AS BIGINT) AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {TIES}) - 1 AS INT) AS seq, l_partkey + {PARTS} AS node_id,
    {x(f"l_partkey + {PARTS}")} AS x, {y(f"l_partkey + {PARTS}")} AS y FROM kept
  UNION ALL
  SELECT n_nationkey + {NATIONS}, CAST(s AS INT), 0, CASE WHEN s IN (1, 2) THEN {_W} + 799000000 ELSE {_W} END, CASE WHEN s IN (2, 3) THEN {_S} + 599000000 ELSE {_S} END
  FROM nation, range(0, 5) r(s)),
inside AS (
  SELECT c_nationkey AS k, 0 AS p, CAST(c_custkey AS BIGINT) AS m_id, lower(c_mktsegment) AS role FROM customer
  UNION ALL SELECT s_nationkey, 1, s_suppkey + {SUPPLIERS}, 'supplier' FROM supplier
  UNION ALL SELECT n_nationkey, 2, n_nationkey + {NATIONS}, 'outer' FROM nation),
members AS (
  SELECT CAST(k AS BIGINT) AS rel_id, CAST(p * 1000000000 + m_id % 1000000000 AS INT) AS seq, CASE WHEN p = 2 THEN 1 ELSE 0 END AS m_type, m_id, role FROM inside
  UNION ALL SELECT n_regionkey + {REGIONS}, n_nationkey, 2, n_nationkey, 'nation' FROM nation),
ways AS (
  SELECT 1 AS type, CAST(o_orderkey AS BIGINT) AS id, false AS is_area, false AS is_member, w AS is_waynode, x1 AS min_x, y1 AS min_y, x2 AS max_x, y2 AS max_y,
    {tags(priority="o_orderpriority", status="o_orderstatus")} AS tags
  FROM orders JOIN (SELECT way_id, bool_or((node_id - {PARTS}) % 3 = 0) AS w, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM way_nodes GROUP BY 1) b ON way_id = o_orderkey),
areas AS (
  SELECT 1 AS type, n_nationkey + {NATIONS} AS id, true AS is_area, true AS is_member, false AS is_waynode, {_W} AS min_x, {_S} AS min_y, {_W} + 799000000 AS max_x, {_S} + 599000000 AS max_y,
    {tags(boundary="'administrative'", admin_level="'2'", name="n_name")} AS tags FROM nation),
nations AS (
  SELECT n_regionkey, 2 AS type, CAST(n_nationkey AS BIGINT) AS id, true AS is_area, true AS is_member, false AS is_waynode,
    least({_W}, x1) AS min_x, least({_S}, y1) AS min_y, greatest({_W} + 799000000, x2) AS max_x, greatest({_S} + 599000000, y2) AS max_y, {tags(type="'boundary'", name="n_name")} AS tags
  FROM nation LEFT JOIN (SELECT k, min({x("m_id")}) AS x1, min({y("m_id")}) AS y1, max({x("m_id")}) AS x2, max({y("m_id")}) AS y2 FROM inside WHERE p < 2 GROUP BY 1) b ON k = n_nationkey),
features AS (
  SELECT {node("CAST(c_custkey AS BIGINT)", "true", "false", tags(mktsegment=SEGMENT, name="c_name", acctbal="CAST(c_acctbal AS DECIMAL(15,2))"))} FROM customer
  UNION ALL SELECT {node(f"(s_suppkey + {SUPPLIERS})", "true", "false", tags(name="s_name", acctbal="CAST(s_acctbal AS DECIMAL(15,2))", supplier="'yes'"))} FROM supplier
  UNION ALL SELECT {node(f"(p_partkey + {PARTS})", "false", "p_partkey IN (SELECT l_partkey FROM kept)", tags(brand="p_brand", type="p_type", size=SIZE))} FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT * FROM ways UNION ALL SELECT * FROM areas
  UNION ALL SELECT * EXCLUDE (n_regionkey) FROM nations
  UNION ALL SELECT 2, r_regionkey + {REGIONS}, false, false, false, x1, y1, x2, y2, {tags(type="'collection'", name="r_name")}
    FROM region LEFT JOIN (SELECT n_regionkey AS k, min(min_x) AS x1, min(min_y) AS y1, max(max_x) AS x2, max(max_y) AS y2 FROM nations GROUP BY 1) b ON k = r_regionkey)
"""


def edges_sql(ring: list[tuple[int, int]]) -> str:
    rows = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(ring, ring[1:], strict=False))
    return f"poly(x1, y1, x2, y2) AS (SELECT CAST(a AS HUGEINT), CAST(b AS HUGEINT), CAST(c AS HUGEINT), CAST(d AS HUGEINT) FROM (VALUES {rows}) v(a, b, c, d))"


def turn(a: str, b: str, c: str, d: str, p: str, q: str) -> str:
    return f"sign((CAST({c} AS HUGEINT) - {a}) * (CAST({q} AS HUGEINT) - {b}) - (CAST({d} AS HUGEINT) - {b}) * (CAST({p} AS HUGEINT) - {a}))"


def located(points: str, key: str) -> str:
    """SQL of (key, loc) for points (key, x, y): 1 inside, 0 on the boundary, -1 outside of poly."""
    s = turn("x1", "y1", "x2", "y2", "p.x", "p.y")
    return (
        f"SELECT {key}, CASE WHEN bool_or(s = 0 AND p.x BETWEEN least(x1, x2) AND greatest(x1, x2) AND p.y BETWEEN least(y1, y2) AND greatest(y1, y2)) THEN 0 "
        f"WHEN sum(CASE WHEN (y1 <= p.y AND p.y < y2 AND s > 0) OR (y2 <= p.y AND p.y < y1 AND s < 0) THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE -1 END AS loc "
        f"FROM (SELECT p.*, x1, y1, x2, y2, {s} AS s FROM ({points}) p, poly) p GROUP BY {key}"
    )


SEGMENTS = """segments AS (SELECT way_id, x AS sx, y AS sy, nx, ny FROM
  (SELECT way_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM way_nodes WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE nx IS NOT NULL)"""
CROSSING = (
    f"{turn('x1', 'y1', 'x2', 'y2', 'sx', 'sy')} * {turn('x1', 'y1', 'x2', 'y2', 'nx', 'ny')} <= 0 AND "
    f"{turn('sx', 'sy', 'nx', 'ny', 'x1', 'y1')} * {turn('sx', 'sy', 'nx', 'ny', 'x2', 'y2')} <= 0 AND "
    "least(sx, nx) <= greatest(x1, x2) AND least(x1, x2) <= greatest(sx, nx) AND least(sy, ny) <= greatest(y1, y2) AND least(y1, y2) <= greatest(sy, ny)"
)
