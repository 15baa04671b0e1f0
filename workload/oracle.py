"""SQL for the registered queries, written from the analysis definitions for DuckDB.

Each statement is self-contained: common table expressions for the order-line view and for the
symbols it reads, then the analysis itself.
"""

from __future__ import annotations

import re

FACT = """fact AS (
  SELECT o.o_orderpriority AS Scenario, CAST(year(o.o_orderdate) AS INTEGER) AS t,
         cr.r_name AS R, sr.r_name AS RR, p.p_type AS G, p.p_brand AS ne,
         l.l_returnflag AS e, l.l_linestatus AS tech, c.c_mktsegment AS GHG,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(l.l_quantity AS DECIMAL(18,2)) AS qty,
         CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS net,
         CAST(l.l_discount AS DECIMAL(18,2)) AS disc, CAST(l.l_tax AS DECIMAL(18,2)) AS tax
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""


def _sym(dims: str, value: str, where: str = "TRUE") -> str:
    groups = ", ".join(d.split(" AS ")[0] for d in dims.split(", "))
    return f"SELECT Scenario, {dims}, {value} AS Value FROM fact WHERE {where} GROUP BY Scenario, {groups}"


PRICE = "CAST(sum(price) AS DOUBLE)"
QTY = "CAST(sum(qty) AS DOUBLE)"
TAX = "1.0 + round(CAST(sum(tax) AS DOUBLE) / count(*), 6)"

CTES = {
    "fact": FACT,
    "agy": _sym("G, R, t", PRICE),
    "agy_bt": _sym("G, R, t", "round(CAST(sum(net) AS DOUBLE), 4)"),
    "dpd": _sym("G, R, t", "round(CAST(sum(disc) AS DOUBLE) / count(*), 6)"),
    "sco2": _sym("t, G, R", QTY),
    "etotco2": _sym("G, R, t", QTY, "tech = 'F'"),
    "ei_t": _sym("e, G, R, t", PRICE),
    "ghgky": _sym("GHG, G, R, t", QTY),
    "ejoe": _sym("G, R", TAX, "G <> 'SMALL'"),
    "ejoe_e": _sym("e, R", TAX),
    "trad_t": _sym("G, R, RR, t", PRICE),
    "ee_sect": _sym("G, R, e, t", QTY),
    "ee_add": _sym("R, e, t", QTY, "tech = 'O'"),
    "expo_e": _sym("e, RR AS R, t", QTY),
    "aai": _sym("ne, G, R, t", PRICE),
    "e_aai": _sym("G, R, t", PRICE, "tech = 'F'"),
    "sd": _sym("G, R, t, tech, GHG", PRICE),
    "data": _sym("G AS Attribute, t AS Year, R AS Region", PRICE),
    "data_brand": _sym("ne AS Attribute, t AS Year, R AS Region", PRICE),
    "conv": (
        "SELECT * FROM (VALUES ('AFRICA', 0.08::DOUBLE), ('AMERICA', 0.20), ('ASIA', 0.05),"
        " ('EUROPE', 0.55)) v(R, f)"
    ),
    "rnames": (
        "SELECT * FROM (VALUES ('AFRICA', 'Africa'), ('AMERICA', 'America'), ('ASIA', 'Asia'),"
        " ('EUROPE', 'Europe')) v(code, name)"
    ),
    "gwp": (
        "SELECT * FROM (VALUES ('AUTOMOBILE', 28.0::DOUBLE), ('BUILDING', 265.0), ('FURNITURE', 6630.0),"
        " ('HOUSEHOLD', 23500.0), ('MACHINERY', 1300.0)) v(GHG, w)"
    ),
    "fuelmap": (
        "SELECT * FROM (VALUES ('ECONOMY', 'Diesel'), ('STANDARD', 'Diesel'), ('LARGE', 'Gasoline'),"
        " ('MEDIUM', 'Transport'), ('PROMO', 'Coke'), ('SMALL', 'Other')) v(G, fuel)"
    ),
    # Sector output by scenario and year, the frame behind the comparison operators.
    "large": "SELECT Scenario, t, sum(Value) AS v FROM agy WHERE G = 'LARGE' GROUP BY Scenario, t",
    "promo": (
        "SELECT Scenario, t, coalesce(sum(Value / f), 0.0) AS v FROM agy LEFT JOIN conv USING (R)"
        " WHERE G = 'PROMO' GROUP BY Scenario, t"
    ),
    # Trade of ASIA in LARGE goods.
    "impo": (
        "SELECT Scenario, t AS Year, RR AS Region, sum(Value) AS v FROM trad_t"
        " WHERE G = 'LARGE' AND R = 'ASIA' GROUP BY Scenario, t, RR"
    ),
    "expo": (
        "SELECT Scenario, t AS Year, R AS Region, sum(Value) AS v FROM trad_t"
        " WHERE G = 'LARGE' AND RR = 'ASIA' GROUP BY Scenario, t, R"
    ),
    "netimp": (
        "SELECT coalesce(i.Scenario, x.Scenario) AS Scenario, coalesce(i.Year, x.Year) AS Year,"
        " coalesce(i.Region, x.Region) AS Region, coalesce(i.v, 0) - coalesce(x.v, 0) AS v"
        " FROM impo i FULL JOIN expo x ON i.Scenario = x.Scenario AND i.Year = x.Year"
        " AND i.Region = x.Region"
    ),
}

DEPENDS = {
    "large": ["agy"], "promo": ["agy", "conv"], "impo": ["trad_t"], "expo": ["trad_t"],
    "netimp": ["impo", "expo"], "conv": [], "rnames": [], "gwp": [], "fuelmap": [], "fact": [],
}


def _sql(names: str, body: str) -> str:
    """``WITH`` the named expressions and what they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in DEPENDS.get(name, ["fact"]):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    ctes = ", ".join(CTES[n] if n == "fact" else f"{n} AS ({CTES[n]})" for n in ordered)
    return re.sub(r"\s*\n\s*", " ", f"WITH {ctes} {body}").strip()


REF = "'1-URGENT'"
SCENARIOS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
GENERATION = (
    "Coal", "Coal with CCS", "Oil", "Gas", "Gas with CCS", "Nuclear", "Bioenergy", "BECCS",
    "Hydro", "Wind", "Solar",
)
PRIMARY = ("Coal", "Oil", "Gas", "Bioenergy", "Nuclear", "Hydro", "Renewables")
EMISSIONS = (
    ("ECONOMY", "Fossil CO2"), ("STANDARD", "Process CO2"), ("LARGE", "AFOLU CO2"),
    ("MEDIUM", "BECCS"), ("PROMO", "DACCS"), ("SMALL", "Non-CO2"),
)


def _columns(col: str, pairs, value: str = "Value", digits: int = 2, agg: str = "sum") -> str:
    return ", ".join(
        f"round({agg}(CASE WHEN {col} = '{key}' THEN {value} END), {digits}) AS \"{name}\""
        for key, name in pairs
    )


def _same(names) -> list[tuple[str, str]]:
    return [(n, n) for n in names]


# Shares of liquid fuels after splitting transport, for one region.
def _shares(region: str) -> str:
    return f"""
      fuel_use AS (SELECT Scenario, t, fuel, sum(Value) AS v FROM e_aai JOIN fuelmap USING (G)
        WHERE R = '{region}' GROUP BY Scenario, t, fuel),
      raw_share AS (SELECT Scenario, t, fuel, v / sum(v) OVER (PARTITION BY Scenario, t) AS s FROM fuel_use),
      shares AS (SELECT Scenario, t, fuel, sum(s) AS s FROM (
          SELECT Scenario, t, fuel, s FROM raw_share WHERE fuel <> 'Transport'
          UNION ALL SELECT Scenario, t, 'Gasoline', 0.67::DOUBLE * s FROM raw_share WHERE fuel = 'Transport'
          UNION ALL SELECT Scenario, t, 'Diesel', 0.24::DOUBLE * s FROM raw_share WHERE fuel = 'Transport'
          UNION ALL SELECT Scenario, t, 'Kerosene', 0.09::DOUBLE * s FROM raw_share WHERE fuel = 'Transport'
        ) GROUP BY Scenario, t, fuel)"""


LIQUIDS_AMERICA = """
      fossil AS (SELECT Scenario, t, sum(Value) AS v FROM ei_all WHERE e = 'A' GROUP BY Scenario, t),
      fuels AS (
        SELECT Scenario, t, fuel, s * v AS v FROM shares JOIN fossil USING (Scenario, t)
          WHERE fuel <> 'Gasoline'
        UNION ALL SELECT Scenario, t, 'Gasoline', s * v * 0.9::DOUBLE FROM shares JOIN fossil USING (Scenario, t)
          WHERE fuel = 'Gasoline'
        UNION ALL SELECT Scenario, t, 'Ethanol', s * v * 0.1::DOUBLE FROM shares JOIN fossil USING (Scenario, t)
          WHERE fuel = 'Gasoline'
        UNION ALL SELECT Scenario, t, 'Biofuels', sum(Value) FROM ei_all WHERE e IN ('N', 'R')
          GROUP BY Scenario, t)"""
EI_ALL = (
    "ei_all AS (SELECT Scenario, t, e, CAST(sum(price) AS DOUBLE) AS Value FROM fact"
    " WHERE R = 'AMERICA' GROUP BY Scenario, t, e)"
)

STEEL_MATRIX = (
    # carrier coefficients of the three technologies
    (15.3, 0.0, 0.6),
    (1.1, 12.9, 1.7),
    (1.0, 3.6, 2.3),
)


def _fit(source: str, keys: str) -> str:
    """Exact constrained fit: the best of the free optimum (if feasible) and each edge optimum.

    ``source`` has the keys and b1, b2, b3. Along a line x = p + s d the squared residual is
    quadratic in s, minimal at -((Ap - b).Ad) / (Ad.Ad).
    """
    corners = [(0.4, 0.0, 0.6), (0.35, 0.05, 0.6), (0.0, 0.05, 0.95), (0.0, 0.0, 1.0)]
    a = STEEL_MATRIX

    def times(x):
        return [sum(a[i][j] * x[j] for j in range(3)) for i in range(3)]

    # Normal equations of the free optimum, with x1 eliminated.
    u = [a[i][1] - a[i][0] for i in range(3)]
    w = [a[i][2] - a[i][0] for i in range(3)]
    uu, uw, ww = (sum(p * q for p, q in zip(x, y)) for x, y in ((u, u), (u, w), (w, w)))
    det = uu * ww - uw * uw
    d1 = [f"(b{i + 1} - {a[i][0]!r}::DOUBLE)" for i in range(3)]
    ud = " + ".join(f"{u[i]!r}::DOUBLE * {d1[i]}" for i in range(3))
    wd = " + ".join(f"{w[i]!r}::DOUBLE * {d1[i]}" for i in range(3))
    free = (
        f"SELECT {keys}, b1, b2, b3, ({ww!r}::DOUBLE * ({ud}) - {uw!r}::DOUBLE * ({wd})) / {det!r}::DOUBLE AS x2,"
        f" ({uu!r}::DOUBLE * ({wd}) - {uw!r}::DOUBLE * ({ud})) / {det!r}::DOUBLE AS x3 FROM {source}"
    )
    branches = [
        f"SELECT {keys}, b1, b2, b3, 1 - x2 - x3 AS x1, x2, x3 FROM ({free})"
        " WHERE x2 BETWEEN 0 AND 0.05 AND x3 >= 0.6 AND x2 + x3 <= 1"
    ]
    for p, q in zip(corners, corners[1:] + corners[:1]):
        d = [q[j] - p[j] for j in range(3)]
        ap, ad = times(p), times(d)
        step = " + ".join(f"(b{i + 1} - {ap[i]!r}::DOUBLE) * {ad[i]!r}::DOUBLE" for i in range(3))
        s = f"least(greatest(({step}) / {sum(v * v for v in ad)!r}::DOUBLE, 0.0), 1.0)"
        point = ", ".join(f"{p[j]!r}::DOUBLE + {d[j]!r}::DOUBLE * s AS x{j + 1}" for j in range(3))
        branches.append(
            f"SELECT {keys}, b1, b2, b3, {point} FROM (SELECT *, {s} AS s FROM {source}"
            " WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL)"
        )
    residual = " + ".join(
        "pow(" + " + ".join(f"{a[i][j]!r}::DOUBLE * x{j + 1}" for j in range(3)) + f" - b{i + 1}, 2)"
        for i in range(3)
    )
    union = " UNION ALL ".join(branches)
    return (
        f"SELECT {keys}, x1, x2, x3 FROM (SELECT *, row_number() OVER (PARTITION BY {keys}"
        f" ORDER BY {residual}) AS rn FROM ({union})) WHERE rn = 1"
    )


# Steel frame: output in tonnes and energy per carrier, by scenario and year.
def _steel(region_filter: str) -> str:
    return f"""
      steel_out AS (SELECT Scenario, t, coalesce(sum(Value / f), 0.0) AS output FROM agy LEFT JOIN conv USING (R)
        WHERE G = 'PROMO' AND {region_filter} GROUP BY Scenario, t),
      steel_use AS (SELECT Scenario, t, sum(CASE WHEN e = 'A' THEN Value END) AS coal,
          sum(CASE WHEN e = 'N' THEN Value END) AS gas, sum(CASE WHEN e = 'R' THEN Value END) AS elec
        FROM ee_sect WHERE G = 'PROMO' AND {region_filter} GROUP BY Scenario, t),
      steel AS (SELECT u.Scenario, u.t, output, coal / (output / 1000) AS b1, gas / (output / 1000) AS b2,
          elec / (output / 1000) AS b3
        FROM steel_use u LEFT JOIN steel_out o ON u.Scenario = o.Scenario AND u.t = o.t)"""


ALL_SCOPES = f"""
  , {EI_ALL}, {_shares("AMERICA").strip()}, {LIQUIDS_AMERICA.strip()},
  burning AS (SELECT Scenario, t, sum(v * CASE fuel WHEN 'Coke' THEN 110.0::DOUBLE WHEN 'Diesel' THEN 70.2
      WHEN 'Gasoline' THEN 66.9 WHEN 'Kerosene' THEN 68.4 WHEN 'Ethanol' THEN 0.0
      WHEN 'Biofuels' THEN 0.0 WHEN 'Other' THEN 67.0 END) / sum(v) AS ef
    FROM fuels GROUP BY Scenario, t),
  scopes AS (SELECT o.Scenario, o.t,
      d.Value / (o.Value * coalesce(k.Value, 1.0)) AS s1,
      (d.Value + ed.Value / eo.Value * u.Value + cd.Value + cp.Value) / (o.Value * coalesce(k.Value, 1.0)) AS s12,
      (d.Value + ed.Value / eo.Value * u.Value + cd.Value + cp.Value) / (o.Value * coalesce(k.Value, 1.0)) + b.ef AS s123
    FROM agy_bt o
    LEFT JOIN sco2 d ON d.G = 'LARGE' AND d.R = 'ASIA' AND d.Scenario = o.Scenario AND d.t = o.t
    LEFT JOIN sco2 ed ON ed.G = 'ECONOMY' AND ed.R = 'ASIA' AND ed.Scenario = o.Scenario AND ed.t = o.t
    LEFT JOIN (SELECT Scenario, t, Value / 0.05 AS Value FROM agy WHERE G = 'ECONOMY' AND R = 'ASIA') eo
      ON eo.Scenario = o.Scenario AND eo.t = o.t
    LEFT JOIN ei_t u ON u.e = 'A' AND u.G = 'LARGE' AND u.R = 'ASIA' AND u.Scenario = o.Scenario AND u.t = o.t
    LEFT JOIN sco2 cd ON cd.G = 'SMALL' AND cd.R = 'ASIA' AND cd.Scenario = o.Scenario AND cd.t = o.t
    LEFT JOIN etotco2 cp ON cp.G = 'SMALL' AND cp.R = 'ASIA' AND cp.Scenario = o.Scenario AND cp.t = o.t
    LEFT JOIN ejoe k ON k.G = 'LARGE' AND k.R = 'ASIA' AND k.Scenario = o.Scenario
    LEFT JOIN burning b ON b.Scenario = o.Scenario AND b.t = o.t
    WHERE o.G = 'LARGE' AND o.R = 'ASIA')"""
SCOPE_SYMBOLS = "agy agy_bt sco2 etotco2 ei_t ejoe e_aai fuelmap"

ORACLE: dict[str, str] = {
    # --- sources
    "src_registry": """
        SELECT v.scenario, v."case", v.path, v.ord, o.n AS n_orders
        FROM (VALUES ('1-URGENT', 'ref', 'runs/urgent', 0), ('2-HIGH', 'high', 'runs/high', 1),
              ('3-MEDIUM', NULL, 'runs/medium', 2), ('9-NONE', NULL, NULL, 3)) v(scenario, "case", path, ord)
        LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) o
          ON o.o_orderpriority = v.scenario""",
    "src_load": """
        SELECT s.Scenario, s."Case", x.label, x.n, x.Value
        FROM (VALUES ('base', NULL), ('alt', 'high')) s(Scenario, "Case"),
        (SELECT o_orderstatus AS label, count(*) AS n,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS Value FROM orders GROUP BY 1
         UNION ALL
         SELECT CAST(s_nationkey AS VARCHAR), count(*),
           CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM supplier GROUP BY 1) x""",
    "src_stamp": """
        SELECT 'base' AS Scenario, 'ref' AS "Case", o_orderpriority, count(*) AS n
        FROM orders GROUP BY o_orderpriority""",
    "src_case": _sql("agy", """
        SELECT Scenario, 'high' AS "Case", t, round(sum(Value), 2) AS Value FROM agy WHERE Scenario < '3'
        GROUP BY Scenario, t"""),
    "src_drop_empty": """
        SELECT 'a' AS Scenario, 'orders' AS symbol, count(*) AS n FROM orders
        UNION ALL SELECT 'b', 'nation', count(*) FROM nation""",
    "src_schema_gate": """
        SELECT 'nation' AS symbol, true AS accepted, CAST(NULL AS VARCHAR) AS reason, 2 * count(*) AS n FROM nation
        UNION ALL SELECT 'region', false, 'different columns across scenarios', NULL
        UNION ALL SELECT 'customer', false, 'different columns across scenarios', NULL""",
    "src_min_columns": """
        SELECT 'nation' AS symbol, true AS accepted, CAST(NULL AS VARCHAR) AS reason, 2 * count(*) AS n FROM nation
        UNION ALL SELECT 'orders', false, 'fewer than two columns', NULL
        UNION ALL SELECT 'supplier', false, 'fewer than two columns', NULL""",
    "src_rename": _sql("fact", """
        SELECT t, G, R, CAST(sum(qty) AS DOUBLE) AS Value FROM fact GROUP BY t, G, R"""),
    "src_time_range": """
        SELECT o_orderpriority AS Scenario, CAST(year(o_orderdate) AS INTEGER) AS t, count(*) AS n
        FROM orders WHERE o_orderstatus <> 'P' AND year(o_orderdate) BETWEEN 1997 AND 1999
        GROUP BY 1, 2""",
    "src_reporting": _sql("data", """
        SELECT Scenario, Attribute, Year, Region, round(Value, 2) AS Value FROM data
        WHERE Year BETWEEN 1996 AND 2000"""),
    "meta_join": _sql("agy conv", """
        SELECT a.G, a.R, round(a.v, 2) AS Value, c.f AS factor
        FROM (SELECT G, R, sum(Value) AS v FROM agy GROUP BY G, R) a
        LEFT JOIN conv c ON c.R = a.R AND a.G IN ('ECONOMY', 'PROMO')"""),
    # --- filters and projections
    "fil_eq": _sql("sco2", "SELECT Scenario, G, R, t, round(Value, 2) AS Value FROM sco2 WHERE G = 'PROMO'"),
    "fil_isin": _sql("aai", """
        SELECT Scenario, ne, t, round(sum(Value), 2) AS Value FROM aai
        WHERE ne IN ('Brand#3', 'Brand#7', 'Brand#11', 'Brand#99') GROUP BY Scenario, ne, t"""),
    "fil_semi": _sql("aai", """
        SELECT Scenario, ne, t, round(sum(Value), 2) AS Value FROM aai
        WHERE ne IN (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 25)
        GROUP BY Scenario, ne, t"""),
    "fil_horizon": _sql("agy", "SELECT Scenario, G, R, t, round(Value, 2) AS Value FROM agy WHERE t <= 2000"),
    "fil_wildcard": _sql("agy", "SELECT Scenario, G, R, t, round(Value, 2) AS Value FROM agy WHERE G = 'PROMO'"),
    "fil_dims": _sql("ee_sect", """
        SELECT Scenario, G, R, e, t, round(Value, 2) AS Value FROM ee_sect WHERE G = 'PROMO' AND R = 'ASIA'"""),
    "fil_region_list": _sql("data", """
        SELECT Scenario, Attribute, Year, Region, round(Value, 2) AS Value FROM data
        WHERE Region IN ('ASIA', 'EUROPE')"""),
    "prj_drop": _sql("ei_t", "SELECT Scenario, G, R, t, round(Value, 2) AS Value FROM ei_t WHERE e = 'A'"),
    "prj_relabel": _sql("agy rnames", """
        SELECT Scenario, coalesce(name, R) AS R, t, round(sum(Value), 2) AS Value
        FROM agy LEFT JOIN rnames ON code = R GROUP BY 1, 2, 3"""),
    "prj_order": _sql("agy", """
        SELECT Scenario, t, round(sum(CASE WHEN G = 'LARGE' THEN Value END), 2) AS LARGE,
          CAST(NULL AS DOUBLE) AS NONE, round(sum(CASE WHEN G = 'SMALL' THEN Value END), 2) AS SMALL
        FROM agy GROUP BY Scenario, t"""),
    # --- scalars
    "sca_units": _sql("agy", """
        SELECT Scenario, t, round(sum(Value) * 0.001::DOUBLE, 5) AS thousands, round(sum(Value) * 10, 1) AS tens,
          round(sum(Value) / 3.6::DOUBLE * 1000, 0) AS twh FROM agy GROUP BY Scenario, t"""),
    "sca_try_divide": _sql("agy", """
        SELECT Scenario, G, t, round(sum(Value) / nullif(CASE WHEN G = 'SMALL' THEN 0 ELSE t - 1990 END, 0), 5)
          AS Value FROM agy GROUP BY Scenario, G, t"""),
    "sca_map": _sql("ghgky gwp", """
        SELECT Scenario, GHG, t, round(sum(Value) * max(CASE WHEN GHG <> 'MACHINERY' THEN w END), 1) AS Value
        FROM ghgky JOIN gwp USING (GHG) GROUP BY Scenario, GHG, t"""),
    "sca_key": _sql("sco2", """
        SELECT Scenario || '-' || CAST(t AS VARCHAR) AS bar, round(sum(Value), 2) AS Value
        FROM sco2 GROUP BY Scenario, t"""),
    "sca_split": _sql("e_aai fuelmap", """
        , f AS (SELECT Scenario, t, fuel, sum(Value) AS v FROM e_aai JOIN fuelmap USING (G)
          GROUP BY Scenario, t, fuel),
        b AS (SELECT * FROM (VALUES ('Transport', 'Gasoline', 0.67::DOUBLE), ('Transport', 'Diesel', 0.24),
          ('Transport', 'Kerosene', 0.09), ('Diesel', 'Diesel', 1.0), ('Gasoline', 'Gasoline', 1.0),
          ('Coke', 'Coke', 1.0), ('Other', 'Other', 1.0)) v(src, dst, w))
        SELECT Scenario, t, dst AS fuel, round(sum(v * w), 4) AS Value FROM f JOIN b ON src = fuel
        GROUP BY Scenario, t, dst"""),
    "sca_product": _sql("agy dpd", """
        SELECT a.Scenario, a.t, a.G, a.R, round(a.Value * d.Value, 8) AS Value
        FROM agy a JOIN dpd d ON a.Scenario = d.Scenario AND a.t = d.t AND a.G = d.G AND a.R = d.R"""),
    # --- joins
    "join_left": _sql("agy etotco2", """
        SELECT a.Scenario, a.t, round(a.v, 2) AS Value, round(b.v, 2) AS Emissions
        FROM (SELECT Scenario, t, sum(Value) AS v FROM agy GROUP BY Scenario, t) a
        LEFT JOIN (SELECT Scenario, t, sum(Value) AS v FROM etotco2 WHERE t <= 1998 GROUP BY Scenario, t) b
          ON a.Scenario = b.Scenario AND a.t = b.t"""),
    "join_conv": _sql("agy conv", """
        SELECT Scenario, R, t, round(Value / f, 3) AS Value FROM agy LEFT JOIN conv USING (R)
        WHERE G = 'PROMO'"""),
    "join_conv_report": _sql("agy conv", """
        SELECT Scenario, R, count(*) AS unmatched FROM agy ANTI JOIN conv USING (R)
        WHERE G = 'PROMO' GROUP BY Scenario, R"""),
    "join_factor": _sql("agy ejoe", """
        SELECT a.Scenario, a.R, a.G, a.t, round(coalesce(k.Value, 1.0), 8) AS factor,
          round(a.Value * coalesce(k.Value, 1.0), 8) AS Value
        FROM agy a LEFT JOIN ejoe k ON a.Scenario = k.Scenario AND a.R = k.R AND a.G = k.G"""),
    "lim_first": _sql("agy ejoe", """
        SELECT a.Scenario, a.R, a.G, a.t, round(k.f, 6) AS factor, round(a.Value, 6) AS Value
        FROM agy a LEFT JOIN (SELECT Scenario, R, min(Value) AS f FROM ejoe GROUP BY Scenario, R) k
          ON a.Scenario = k.Scenario AND a.R = k.R"""),
    "join_align": _sql("sco2 etotco2", """
        SELECT a.Scenario, a.t, a.R, round(a.Value + b.Value, 6) AS added, round(b.Value / a.Value, 6) AS ratio
        FROM sco2 a LEFT JOIN etotco2 b
          ON b.G = 'PROMO' AND b.t <= 1999 AND a.Scenario = b.Scenario AND a.t = b.t AND a.R = b.R
        WHERE a.G = 'PROMO'"""),
    # --- aggregations and reshape
    "agg_sum": _sql("agy", "SELECT Scenario, t, round(sum(Value), 2) AS Value FROM agy GROUP BY Scenario, t"),
    "agg_mean": _sql("dpd", "SELECT Scenario, t, round(avg(Value), 9) AS Value FROM dpd GROUP BY Scenario, t"),
    "agg_by_type": _sql("agy dpd", """
        SELECT a.Scenario, a.t, round(p, 9) AS price, round(o, 2) AS output
        FROM (SELECT Scenario, t, sum(Value) AS o FROM agy GROUP BY Scenario, t) a
        JOIN (SELECT Scenario, t, avg(Value) AS p FROM dpd GROUP BY Scenario, t) d
          ON a.Scenario = d.Scenario AND a.t = d.t"""),
    "agg_factor_mean": _sql("ejoe", """
        SELECT Scenario, G, round(avg(Value), 9) AS Value FROM ejoe GROUP BY Scenario, G"""),
    "agg_ndistinct": _sql("fact", """
        SELECT count(DISTINCT Scenario) AS Scenario, count(DISTINCT t) AS t, count(DISTINCT R) AS R,
          count(DISTINCT G) AS G, count(DISTINCT ne) AS ne FROM fact"""),
    "agg_dynamic": _sql("ee_sect", """
        SELECT Scenario, t, G, e, round(sum(Value), 2) AS Value FROM ee_sect WHERE R = 'ASIA'
        GROUP BY Scenario, t, G, e"""),
    "pivot_sum": _sql("agy", f"""
        SELECT Scenario, t, {_columns("G", _same(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")))}
        FROM agy GROUP BY Scenario, t"""),
    "pivot_mean": _sql("dpd", f"""
        SELECT t, {_columns("Scenario", _same(SCENARIOS), digits=9, agg="avg")} FROM dpd GROUP BY t"""),
    "pivot_auto": _sql("ee_sect", f"""
        SELECT Scenario, t, {_columns("R", _same(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")))}
        FROM ee_sect WHERE G = 'PROMO' AND e = 'A' GROUP BY Scenario, t"""),
    "unpivot": _sql("agy", """
        SELECT k.Scenario, k.t, n.G, round(x.v, 2) AS Value
        FROM (SELECT DISTINCT Scenario, t FROM agy) k, (VALUES ('LARGE'), ('SMALL'), ('NONE')) n(G)
        LEFT JOIN (SELECT Scenario, t, G, sum(Value) AS v FROM agy GROUP BY Scenario, t, G) x
          ON x.Scenario = k.Scenario AND x.t = k.t AND x.G = n.G"""),
    # --- comparison
    "cmp_index": _sql("large", """
        SELECT a.Scenario, a.t, round(a.v / b.v * 100, 6) AS Value FROM large a
        LEFT JOIN large b ON a.Scenario = b.Scenario AND b.t = (SELECT min(t) FROM large)"""),
    "cmp_index_years": _sql("large", """
        SELECT a.Scenario, a.t, round(a.v / b.v * 100, 6) AS Value FROM large a
        LEFT JOIN large b ON a.Scenario = b.Scenario AND b.t = 1996 WHERE a.t IN (1996, 1998, 2000)"""),
    "cmp_reldiff": _sql("large", f"""
        SELECT a.Scenario, a.t, round((a.v - b.v) / b.v * 100, 6) AS Value FROM large a
        LEFT JOIN large b ON a.t = b.t AND b.Scenario = {REF} WHERE a.Scenario <> {REF}"""),
    "cmp_index_reldiff": _sql("large", f"""
        , i AS (SELECT a.Scenario, a.t, a.v / b.v * 100 AS v FROM large a
          JOIN large b ON a.Scenario = b.Scenario AND b.t = 1995)
        SELECT a.Scenario, a.t, round((a.v - b.v) / b.v * 100, 6) AS Value FROM i a
        LEFT JOIN i b ON a.t = b.t AND b.Scenario = {REF} WHERE a.Scenario <> {REF}"""),
    "cmp_share": _sql("agy", """
        SELECT Scenario, t, G, round(sum(Value) / sum(sum(Value)) OVER (PARTITION BY Scenario, t) * 100, 6) AS Value
        FROM agy GROUP BY Scenario, t, G"""),
    "cmp_scendiff": _sql("data", f"""
        SELECT coalesce(a.Year, b.Year) AS Year, coalesce(a.Region, b.Region) AS Region,
          round(a.Value - b.Value, 2) AS Value, 'Difference between two scenarios' AS Scenario
        FROM (SELECT * FROM data WHERE Attribute = 'LARGE' AND Scenario = '2-HIGH') a
        FULL JOIN (SELECT * FROM data WHERE Attribute = 'LARGE' AND Scenario = {REF}) b
          ON a.Year = b.Year AND a.Region = b.Region"""),
    "srt_keys": _sql("sco2", """
        SELECT Scenario, t, round(sum(Value), 2) AS Value,
          CAST(dense_rank() OVER (ORDER BY Scenario DESC) - 1 AS INTEGER) AS ord,
          CAST(row_number() OVER (PARTITION BY Scenario ORDER BY t) AS INTEGER) AS position
        FROM sco2 GROUP BY Scenario, t"""),
    "srt_sink": _sql("agy", """
        SELECT Scenario, t, G, round(sum(Value), 2) AS Value,
          row_number() OVER (ORDER BY Scenario, t, G) AS position FROM agy GROUP BY Scenario, t, G"""),
    "srt_total_desc": _sql("agy", """
        SELECT G, round(sum(Value), 2) AS Value FROM agy GROUP BY G ORDER BY sum(Value) DESC, G LIMIT 3"""),
    "set_union_all": _sql("sco2 ei_t", """
        SELECT Scenario, t, G, round(sum(Value), 2) AS Value, CAST(NULL AS VARCHAR) AS e FROM sco2
          GROUP BY Scenario, t, G
        UNION ALL SELECT Scenario, t, NULL, round(sum(Value), 2), e FROM ei_t GROUP BY Scenario, t, e"""),
    "fit_mix": _sql("fact", f"""
        , cells AS (SELECT Scenario, t, ne, CAST(sum(price) AS DOUBLE) AS tot,
            CAST(sum(price) FILTER (e = 'A') AS DOUBLE) AS a, CAST(sum(price) FILTER (e = 'N') AS DOUBLE) AS n,
            CAST(sum(price) FILTER (e = 'R') AS DOUBLE) AS r FROM fact GROUP BY Scenario, t, ne),
        obs AS (SELECT Scenario, t, ne, 15 * a / tot AS b1, 6 * n / tot AS b2, 6 * r / tot AS b3 FROM cells),
        fit AS ({_fit("obs", "Scenario, t, ne")})
        SELECT o.Scenario, o.t, o.ne, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3
        FROM obs o LEFT JOIN fit f ON o.Scenario = f.Scenario AND o.t = f.t AND o.ne = f.ne"""),
    # --- parameter comparison
    "grt_global": _sql("promo", "SELECT Scenario, t, round(v, 3) AS Value FROM promo"),
    "grt_region": _sql("agy_bt", """
        SELECT Scenario, t, round(Value / 0.05::DOUBLE, 3) AS Value FROM agy_bt
        WHERE G = 'PROMO' AND R = 'ASIA' AND t <= 2000"""),
    "grt_price": _sql("dpd", """
        SELECT Scenario, t, round(avg(Value), 9) AS Value FROM dpd WHERE G = 'SMALL' GROUP BY Scenario, t"""),
    "grt_index": _sql("promo", f"""
        SELECT t, {_columns("Scenario", _same(SCENARIOS), value="v", digits=6, agg="max")}
        FROM (SELECT a.Scenario, a.t, a.v / b.v * 100 AS v FROM promo a
          JOIN promo b ON a.Scenario = b.Scenario AND b.t = 1995 WHERE a.t <= 2000) GROUP BY t"""),
    "grt_reldiff": _sql("promo", f"""
        SELECT a.Scenario, a.t, round((a.v - b.v) / b.v * 100, 6) AS Value FROM promo a
        LEFT JOIN promo b ON a.t = b.t AND b.Scenario = {REF} WHERE a.Scenario <> {REF}"""),
    # --- intensity
    "scope2": _sql("sco2 agy ei_t", """
        SELECT d.Scenario, d.t, round(d.Value / (o.Value / 0.05::DOUBLE) * u.Value, 4) AS Value
        FROM sco2 d
        LEFT JOIN agy o ON o.G = d.G AND o.R = d.R AND o.Scenario = d.Scenario AND o.t = d.t
        LEFT JOIN ei_t u ON u.e = 'A' AND u.G = 'MEDIUM' AND u.R = d.R AND u.Scenario = d.Scenario AND u.t = d.t
        WHERE d.G = 'ECONOMY' AND d.R = 'ASIA' AND d.t <= 2000"""),
    "ci_elec": _sql("sco2 data", """
        SELECT d.Scenario, d.t, round(d.v / g.v * 1000, 8) AS scope1
        FROM (SELECT Scenario, t, sum(Value) AS v FROM sco2 WHERE G = 'ECONOMY' GROUP BY Scenario, t) d
        JOIN (SELECT Scenario, Year, sum(Value) AS v FROM data WHERE Attribute = 'MEDIUM'
          GROUP BY Scenario, Year) g ON d.Scenario = g.Scenario AND d.t = g.Year"""),
    "ci_mass": _sql("sco2 agy_bt conv", """
        SELECT d.Scenario, d.t, round(d.v / o.v * 1000, 8) AS scope1
        FROM (SELECT Scenario, t, sum(Value) AS v FROM sco2 WHERE G = 'PROMO' GROUP BY Scenario, t) d
        JOIN (SELECT Scenario, t, sum(Value / f) AS v FROM agy_bt LEFT JOIN conv USING (R) WHERE G = 'PROMO'
          GROUP BY Scenario, t) o ON d.Scenario = o.Scenario AND d.t = o.t"""),
    "ci_energy": _sql("sco2 agy_bt ejoe", """
        SELECT d.Scenario, d.t, round(d.Value / (o.Value * coalesce(k.Value, 1.0)), 10) AS scope1
        FROM sco2 d JOIN agy_bt o ON o.G = d.G AND o.R = d.R AND o.Scenario = d.Scenario AND o.t = d.t
        LEFT JOIN ejoe k ON k.G = d.G AND k.R = d.R AND k.Scenario = d.Scenario
        WHERE d.G = 'SMALL' AND d.R = 'EUROPE'"""),
    "sci_scope1": _sql("sco2 etotco2 agy_bt conv", """
        SELECT d.Scenario, d.t, round((d.v + coalesce(p.v, 0)) / o.v * 1000, 8) AS scope1
        FROM (SELECT Scenario, t, sum(Value) AS v FROM sco2 WHERE G = 'PROMO' GROUP BY Scenario, t) d
        LEFT JOIN (SELECT Scenario, t, sum(Value) AS v FROM etotco2 WHERE G = 'PROMO' GROUP BY Scenario, t) p
          ON d.Scenario = p.Scenario AND d.t = p.t
        JOIN (SELECT Scenario, t, sum(Value / f) AS v FROM agy_bt LEFT JOIN conv USING (R) WHERE G = 'PROMO'
          GROUP BY Scenario, t) o ON d.Scenario = o.Scenario AND d.t = o.t
        WHERE d.t <= 2000"""),
    "sci_ghg": _sql("sco2 ghgky gwp agy_bt ejoe", """
        SELECT d.Scenario, d.t, round((d.v + coalesce(g.v, 0)) / (o.v * k.v), 8) AS scope1
        FROM (SELECT Scenario, t, sum(Value) AS v FROM sco2 WHERE G = 'MEDIUM' GROUP BY Scenario, t) d
        LEFT JOIN (SELECT Scenario, t, sum(Value * w / 1000) AS v FROM ghgky JOIN gwp USING (GHG)
          WHERE G = 'MEDIUM' GROUP BY Scenario, t) g ON d.Scenario = g.Scenario AND d.t = g.t
        JOIN (SELECT Scenario, t, sum(Value) AS v FROM agy_bt WHERE G = 'MEDIUM' GROUP BY Scenario, t) o
          ON d.Scenario = o.Scenario AND d.t = o.t
        JOIN (SELECT Scenario, avg(Value) AS v FROM ejoe WHERE G = 'MEDIUM' GROUP BY Scenario) k
          ON d.Scenario = k.Scenario"""),
    "sci_scope2": _sql("sco2 etotco2 agy agy_bt ei_t ejoe conv", """
        , s AS (SELECT Scenario, t, G, sum(Value) AS v FROM sco2 GROUP BY Scenario, t, G),
        p AS (SELECT Scenario, t, sum(Value) AS v FROM etotco2 WHERE G = 'SMALL' GROUP BY Scenario, t),
        eo AS (SELECT Scenario, t, sum(Value / f) AS v FROM agy LEFT JOIN conv USING (R) WHERE G = 'ECONOMY'
          GROUP BY Scenario, t),
        u AS (SELECT Scenario, t, sum(Value) AS v FROM ei_t WHERE e = 'A' AND G = 'LARGE' GROUP BY Scenario, t),
        o AS (SELECT Scenario, t, sum(Value) AS v FROM agy_bt WHERE G = 'LARGE' GROUP BY Scenario, t),
        k AS (SELECT Scenario, avg(Value) AS v FROM ejoe WHERE G = 'LARGE' GROUP BY Scenario)
        SELECT o.Scenario, o.t, round(d.v / (o.v * k.v), 8) AS scope1,
          round((d.v + ed.v / eo.v * u.v + cd.v + p.v) / (o.v * k.v), 8) AS scope12
        FROM o JOIN k ON o.Scenario = k.Scenario
        LEFT JOIN s d ON d.G = 'LARGE' AND d.Scenario = o.Scenario AND d.t = o.t
        LEFT JOIN s ed ON ed.G = 'ECONOMY' AND ed.Scenario = o.Scenario AND ed.t = o.t
        LEFT JOIN s cd ON cd.G = 'SMALL' AND cd.Scenario = o.Scenario AND cd.t = o.t
        LEFT JOIN eo ON eo.Scenario = o.Scenario AND eo.t = o.t
        LEFT JOIN u ON u.Scenario = o.Scenario AND u.t = o.t
        LEFT JOIN p ON p.Scenario = o.Scenario AND p.t = o.t"""),
    "sci_scope3": _sql(SCOPE_SYMBOLS, ALL_SCOPES + """
        SELECT Scenario, t, round(s1, 8) AS scope1, round(s12, 8) AS scope12, round(s123, 8) AS scope123
        FROM scopes"""),
    "sci_band": _sql(SCOPE_SYMBOLS, ALL_SCOPES + """
        SELECT Scenario, t, 'scope12' AS band, round(s1, 8) AS lower, round(s12, 8) AS upper FROM scopes
          WHERE s12 > s1
        UNION ALL SELECT Scenario, t, 'scope123', round(s12, 8), round(s123, 8) FROM scopes WHERE s123 > s12"""),
    # --- trade
    "trade_imports": _sql("impo rnames", """
        SELECT Scenario, Year, coalesce(name, Region) AS Region, round(v, 2) AS Value
        FROM impo LEFT JOIN rnames ON code = Region"""),
    "trade_exports": _sql("expo rnames", """
        SELECT Scenario, Year, coalesce(name, Region) AS Region, round(v, 2) AS Value
        FROM expo LEFT JOIN rnames ON code = Region WHERE Year <= 2000"""),
    "trade_net": _sql("netimp rnames", """
        SELECT Scenario, Year, coalesce(name, Region) AS Region, round(v, 2) AS Value
        FROM netimp LEFT JOIN rnames ON code = Region"""),
    "trade_region_list": _sql("trad_t rnames", """
        SELECT Scenario, Year, coalesce(name, RR) AS Region, round(v, 2) AS Value
        FROM (SELECT Scenario, t AS Year, RR, sum(Value) AS v FROM trad_t
          WHERE G = 'LARGE' AND R IN ('ASIA', 'EUROPE') GROUP BY Scenario, t, RR)
        LEFT JOIN rnames ON code = RR"""),
    "trade_wide": _sql("impo", """
        SELECT Scenario, Year, round(sum(v) FILTER (Region = 'AFRICA'), 2) AS Africa,
          round(sum(v) FILTER (Region = 'AMERICA'), 2) AS America,
          round(sum(v) FILTER (Region = 'ASIA'), 2) AS Asia,
          round(sum(v) FILTER (Region = 'EUROPE'), 2) AS Europe,
          round(sum(v) FILTER (Region = 'MIDDLE EAST'), 2) AS "MIDDLE EAST"
        FROM impo GROUP BY Scenario, Year"""),
    "trade_share": _sql("impo rnames", """
        SELECT Scenario, Year, coalesce(name, Region) AS Region,
          round(v / sum(v) OVER (PARTITION BY Scenario, Year) * 100, 6) AS Value
        FROM impo LEFT JOIN rnames ON code = Region"""),
    "trade_scendiff": _sql("expo rnames", f"""
        , s AS (SELECT Scenario, Year, Region, v / sum(v) OVER (PARTITION BY Scenario, Year) * 100 AS v FROM expo)
        SELECT coalesce(a.Year, b.Year) AS Year, coalesce(name, a.Region, b.Region) AS Region,
          round(a.v - b.v, 6) AS Value, 'Difference between two scenarios' AS Scenario
        FROM (SELECT * FROM s WHERE Scenario = '2-HIGH') a
        FULL JOIN (SELECT * FROM s WHERE Scenario = {REF}) b ON a.Year = b.Year AND a.Region = b.Region
        LEFT JOIN rnames ON code = coalesce(a.Region, b.Region)"""),
    "trade_scenario": _sql("impo", f"""
        , s AS (SELECT Scenario, Year, sum(v) AS v FROM impo GROUP BY Scenario, Year)
        SELECT a.Scenario, a.Year, round((a.v - b.v) / b.v * 100, 6) AS Value FROM s a
        LEFT JOIN s b ON a.Year = b.Year AND b.Scenario = {REF} WHERE a.Scenario <> {REF}"""),
    "trade_scenario_net": _sql("netimp", """
        SELECT Scenario, Year, round(-sum(v), 2) AS Value FROM netimp GROUP BY Scenario, Year"""),
    "trade_world_index": _sql("trad_t", f"""
        , s AS (SELECT Scenario, t AS Year, sum(Value) AS v FROM trad_t WHERE G = 'LARGE' GROUP BY Scenario, t),
        d AS (SELECT a.Scenario, a.Year, (a.v - b.v) / b.v * 100 AS v FROM s a
          JOIN s b ON a.Year = b.Year AND b.Scenario = {REF} WHERE a.Scenario <> {REF})
        SELECT a.Scenario, a.Year, round(a.v / b.v * 100, 3) AS Value FROM d a
        JOIN d b ON a.Scenario = b.Scenario AND b.Year = 1995"""),
    # --- reporting table
    "emis": _sql("data", f"""
        SELECT Scenario, Year, {_columns("Attribute", EMISSIONS, value="Value * 0.001::DOUBLE", digits=5)}
        FROM data WHERE Year <= 2000 GROUP BY Scenario, Year"""),
    "pemis_co2": _sql("data", """
        SELECT Scenario, Year, round(avg(Value), 3) AS Value FROM data WHERE Attribute = 'ECONOMY'
        GROUP BY Scenario, Year"""),
    "pemis_ghg": _sql("data", """
        SELECT Scenario, Year, round(avg(Value), 3) AS Value FROM data
        WHERE Attribute = 'LARGE' AND Year <= 2000 GROUP BY Scenario, Year"""),
    "pemis_wide": _sql("data", f"""
        SELECT Year, {_columns("Scenario", _same(SCENARIOS), digits=3, agg="avg")} FROM data
        WHERE Attribute = 'ECONOMY' GROUP BY Year"""),
    "snk_csv": _sql("data", """
        SELECT Scenario, Year, round(avg(Value), 3) AS Value FROM data WHERE Attribute = 'ECONOMY'
        GROUP BY Scenario, Year"""),
    "nrj": _sql("data_brand", f"""
        SELECT Scenario, Year, {_columns("Attribute", [(f"Brand#{i}", n) for i, n in enumerate(PRIMARY, 11)])}
        FROM data_brand WHERE Region IN ('ASIA', 'EUROPE')
          AND Attribute IN ({", ".join(f"'Brand#{i}'" for i in range(11, 18))}) GROUP BY Scenario, Year"""),
    "elec": _sql("data_brand", f"""
        SELECT Scenario, Year, {_columns("Attribute", [(f"Brand#{i}", n) for i, n in enumerate(GENERATION, 1)])}
        FROM data_brand WHERE Region = 'ASIA'
          AND Attribute IN ({", ".join(f"'Brand#{i}'" for i in range(1, 12))}) GROUP BY Scenario, Year"""),
    "gdp_scenario": _sql("data", """
        SELECT Scenario, Year, round(sum(Value * 0.001::DOUBLE), 5) AS Value FROM data
        WHERE Attribute = 'STANDARD' AND Region = 'EUROPE' GROUP BY Scenario, Year"""),
    "gdp_region": _sql("data rnames", """
        SELECT Scenario, Year, coalesce(name, Region) AS Region, round(sum(Value * 0.001::DOUBLE), 5) AS Value
        FROM data LEFT JOIN rnames ON code = Region WHERE Attribute = 'STANDARD' AND Year <= 2000
        GROUP BY 1, 2, 3"""),
    "data_global": _sql("data", """
        SELECT Scenario, Year, round(sum(Value), 2) AS Value FROM data WHERE Attribute = 'MEDIUM'
        GROUP BY Scenario, Year"""),
    "data_region": _sql("data", f"""
        SELECT Year, {_columns("Scenario", _same(SCENARIOS), agg="avg")} FROM data
        WHERE Attribute = 'MEDIUM' AND Region = 'AFRICA' GROUP BY Year"""),
    # --- energy balance
    "tec_by_energy": _sql("ee_sect", """
        SELECT Scenario, t AS Year, e, round(Value, 2) AS Value FROM ee_sect
        WHERE G = 'PROMO' AND R = 'ASIA' AND e <> 'R'"""),
    "tec_by_sector": _sql("ee_sect", """
        SELECT Scenario, t AS Year, G, round(Value, 2) AS Value FROM ee_sect
        WHERE R = 'ASIA' AND e = 'R' AND t <= 2000 AND G IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')"""),
    "tec_by_region": _sql("ee_sect", """
        SELECT Scenario, t AS Year, R, round(Value, 2) AS Value FROM ee_sect WHERE G = 'MEDIUM' AND e = 'R'"""),
    "tec_percent": _sql("ee_sect", """
        SELECT Scenario, t AS Year, e, round(Value / sum(Value) OVER (PARTITION BY Scenario, t) * 100, 6) AS Value
        FROM ee_sect WHERE G = 'MEDIUM' AND R = 'ASIA'"""),
    "tec_add": _sql("ee_sect ee_add ejoe_e", """
        SELECT Scenario, t AS Year, G, round(Value, 6) AS Value FROM ee_sect
        WHERE R = 'ASIA' AND e = 'N' AND G IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')
        UNION ALL SELECT a.Scenario, a.t, 'INTERNAL', round(a.Value * k.Value, 6) FROM ee_add a
        JOIN ejoe_e k ON k.e = 'N' AND k.R = a.R AND k.Scenario = a.Scenario WHERE a.R = 'ASIA' AND a.e = 'N'"""),
    "tec_carrier_list": _sql("ee_sect ee_add ejoe_e", """
        , k AS (SELECT Scenario, Value AS f FROM ejoe_e WHERE e = 'A' AND R = 'ASIA'),
        u AS (SELECT Scenario, t, G, Value FROM ee_sect
            WHERE R = 'ASIA' AND e = 'A' AND G IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')
          UNION ALL SELECT Scenario, t, 'INTERNAL', Value * f FROM ee_add JOIN k USING (Scenario)
            WHERE R = 'ASIA' AND e = 'A')
        SELECT Scenario, t AS Year, G, round(Value / 3.6::DOUBLE * 1000, 6) AS Value FROM u"""),
    "tec_labels": _sql("ee_sect", """
        SELECT Scenario, t AS Year, CASE e WHEN 'A' THEN 'electricity' ELSE 'coke' END AS e,
          round(Value, 2) AS Value
        FROM ee_sect WHERE R = 'ASIA' AND G = 'PROMO' AND e <> 'R'"""),
    "tec_labels_cement": _sql("ee_sect", """
        SELECT Scenario, t AS Year, CASE e WHEN 'A' THEN 'electricity' WHEN 'R' THEN 'oil'
            ELSE 'petroleum products' END AS e,
          round(Value, 2) AS Value
        FROM ee_sect WHERE R = 'ASIA' AND G = 'ECONOMY'"""),
    "tec_exports": _sql("ee_sect ee_add expo_e ejoe_e", """
        , k AS (SELECT Scenario, Value AS f FROM ejoe_e WHERE e = 'A' AND R = 'ASIA'),
        u AS (SELECT Scenario, t, G, Value FROM ee_sect
            WHERE R = 'ASIA' AND e = 'A' AND G IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')
          UNION ALL SELECT Scenario, t, 'INTERNAL', Value * f FROM ee_add JOIN k USING (Scenario)
            WHERE R = 'ASIA' AND e = 'A'
          UNION ALL SELECT Scenario, t, 'Exports', Value * f FROM expo_e JOIN k USING (Scenario)
            WHERE R = 'ASIA' AND e = 'A')
        SELECT Scenario, t AS Year, G, round(Value / 3.6::DOUBLE * 1000, 6) AS Value FROM u"""),
    # --- inputs, supply and demand
    "ne_inputs": _sql("aai", """
        SELECT Scenario, t, round(sum(Value) * 10, 2) AS Value FROM aai
        WHERE G = 'PROMO' AND ne = 'Brand#5' AND R = 'ASIA' AND t <= 2000 GROUP BY Scenario, t"""),
    "ne_inputs_bd": _sql("aai", """
        SELECT Scenario, t AS Year, ne, round(sum(Value) * 10, 2) AS Value FROM aai WHERE G = 'PROMO'
        GROUP BY Scenario, t, ne"""),
    "sd_1d": _sql("sd", """
        SELECT Scenario, t AS Year, round(avg(Value), 3) AS Value FROM sd
        WHERE G = 'PROMO' AND R = 'ASIA' AND tech = 'F' AND GHG IN ('AUTOMOBILE', 'BUILDING')
        GROUP BY Scenario, t"""),
    "sd_1d_reldiff": _sql("sd", f"""
        , m AS (SELECT Scenario, t, avg(Value) AS v FROM sd WHERE G = 'PROMO' AND R = 'ASIA'
          AND GHG <> 'MACHINERY' AND t IN (1996, 1998, 2000) GROUP BY Scenario, t)
        SELECT a.Scenario, a.t AS Year, round((a.v - b.v) / b.v * 100, 6) AS Value FROM m a
        LEFT JOIN m b ON a.t = b.t AND b.Scenario = {REF} WHERE a.Scenario <> {REF}"""),
    "sd_2d": _sql("sd", """
        SELECT Scenario, t AS Year, round(avg(CASE WHEN GHG = 'AUTOMOBILE' THEN Value END), 3) AS output,
          round(avg(CASE WHEN GHG = 'BUILDING' THEN Value END), 3) AS imports,
          round(-avg(CASE WHEN GHG = 'FURNITURE' THEN Value END), 3) AS exports,
          round(avg(CASE WHEN GHG = 'HOUSEHOLD' THEN Value END), 3) AS demand
        FROM sd WHERE G = 'PROMO' AND R = 'ASIA' AND GHG <> 'MACHINERY' AND t <= 2000 GROUP BY Scenario, t"""),
    # --- mixes
    "steel_intensity": _sql("agy ee_sect conv", f"""
        , {_steel("R = 'ASIA'").strip()}
        SELECT Scenario, t AS Year, round(b1, 8) AS COAL, round(b2, 8) AS GAS, round(b3, 8) AS ELEC FROM steel"""),
    "steel_mix": _sql("agy ee_sect conv", f"""
        , {_steel("TRUE").strip()}, fit AS ({_fit("steel", "Scenario, t")}),
        ccs AS (SELECT Scenario, t, tech, coalesce(sum(CAST(q AS DOUBLE) / f), 0.0) AS v
          FROM (SELECT Scenario, t, tech, R, sum(qty) AS q FROM fact GROUP BY Scenario, t, tech, R)
          LEFT JOIN conv USING (R) GROUP BY Scenario, t, tech),
        conventional AS (SELECT s.Scenario, s.t, output, x1, x2, x3 FROM steel s
          LEFT JOIN fit f ON f.Scenario = s.Scenario AND f.t = s.t)
        SELECT Scenario, t AS Year, 'BF-BOF' AS Technology, round(x1 * output, 1) AS Value FROM conventional
        UNION ALL SELECT Scenario, t, 'NG DRI-EAF', round(x2 * output, 1) FROM conventional
        UNION ALL SELECT Scenario, t, 'Scrap EAF', round(x3 * output, 1) FROM conventional
        UNION ALL SELECT Scenario, t, CASE tech WHEN 'F' THEN 'DRI-H2 CCS' ELSE 'DRI-EAF CCS' END, round(v, 1)
          FROM ccs"""),
    "steel_mix_wide": _sql("agy ee_sect conv", f"""
        , {_steel("TRUE").strip()}, fit AS ({_fit("steel", "Scenario, t")}),
        ccs AS (SELECT Scenario, t, coalesce(sum(CAST(q AS DOUBLE) / f) FILTER (tech = 'F'), 0.0) AS h2,
            coalesce(sum(CAST(q AS DOUBLE) / f) FILTER (tech = 'O'), 0.0) AS eaf,
            count(*) FILTER (tech = 'F') AS n_h2, count(*) FILTER (tech = 'O') AS n_eaf
          FROM (SELECT Scenario, t, tech, R, sum(qty) AS q FROM fact GROUP BY Scenario, t, tech, R)
          LEFT JOIN conv USING (R) GROUP BY Scenario, t)
        SELECT s.Scenario, s.t AS Year, round(x1 * output, 1) AS "BF-BOF", round(x2 * output, 1) AS "NG DRI-EAF",
          round(x3 * output, 1) AS "Scrap EAF", CASE WHEN n_h2 > 0 THEN round(h2, 1) END AS "DRI-H2 CCS",
          CASE WHEN n_eaf > 0 THEN round(eaf, 1) END AS "DRI-EAF CCS"
        FROM steel s LEFT JOIN fit f ON f.Scenario = s.Scenario AND f.t = s.t
        LEFT JOIN ccs c ON c.Scenario = s.Scenario AND c.t = s.t"""),
    "cement_mix": _sql("fact conv", """
        , p AS (SELECT Scenario, t, e, R, CAST(sum(price) AS DOUBLE) AS v FROM fact GROUP BY Scenario, t, e, R)
        SELECT Scenario, t AS Year, CASE e WHEN 'A' THEN 'CCS' ELSE 'NoCCS' END AS Technology,
          round(sum(v / f), 3) AS Value
        FROM p LEFT JOIN conv USING (R) WHERE e IN ('A', 'N') GROUP BY Scenario, t, e"""),
    "clinker_mix": _sql("fact", """
        , p AS (SELECT Scenario, t, CASE GHG WHEN 'FURNITURE' THEN 'Fly ash' WHEN 'HOUSEHOLD' THEN 'Steel slags'
            ELSE 'Clinker' END AS Technology, CAST(sum(price) AS DOUBLE) AS v
          FROM fact WHERE R = 'ASIA' AND GHG <> 'MACHINERY' GROUP BY 1, 2, 3)
        SELECT Scenario, t AS Year, Technology, round(v / 0.05::DOUBLE, 1) AS Value FROM p"""),
    "fuel_shares": _sql("e_aai fuelmap", f"""
        , {_shares("ASIA").strip()}
        SELECT Scenario, t, fuel, round(s, 6) AS share FROM shares"""),
    "liquids_mix": _sql("e_aai fuelmap", f"""
        , {EI_ALL}, {_shares("AMERICA").strip()}, {LIQUIDS_AMERICA.strip()}
        SELECT Scenario, t AS Year, fuel AS Technology, round(v, 2) AS Value FROM fuels"""),
    "liquids_region_list": _sql("e_aai fuelmap", f"""
        , {EI_ALL}, {_shares("AMERICA").strip()}, {LIQUIDS_AMERICA.strip()}
        SELECT Scenario, t AS Year, fuel AS Technology, round(v, 2) AS Value FROM fuels"""),
    # --- chart data
    "cht_stack": _sql("agy", """
        , s AS (SELECT Scenario, t AS Year, G, sum(Value) AS v,
            CASE G WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'PROMO' THEN 2 ELSE 9 END AS k
          FROM agy GROUP BY Scenario, t, G)
        SELECT Scenario, Year, G, round(v, 2) AS Value, round(coalesce(sum(v) OVER (PARTITION BY Scenario, Year
          ORDER BY k, G ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS bottom FROM s"""),
    "cht_stack_signed": _sql("netimp rnames", """
        , s AS (SELECT Scenario, Year, coalesce(name, Region) AS Region, -v AS v FROM netimp
          LEFT JOIN rnames ON code = Region),
        o AS (SELECT *, CASE Region WHEN 'Europe' THEN 0 WHEN 'Africa' THEN 1 WHEN 'America' THEN 2 ELSE 9 END AS k
          FROM s)
        SELECT Scenario, Year, Region, round(greatest(v, 0), 2) AS positive, round(least(v, 0), 2) AS negative,
          round(coalesce(sum(greatest(v, 0)) OVER w, 0), 2) AS bottom_positive,
          round(coalesce(sum(least(v, 0)) OVER w, 0), 2) AS bottom_negative
        FROM o WINDOW w AS (PARTITION BY Scenario, Year ORDER BY k, Region
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "cht_axis_mid": _sql("agy", """
        , b AS (SELECT Scenario, t, row_number() OVER (ORDER BY Scenario, t) - 1 AS pos
          FROM (SELECT DISTINCT Scenario, t FROM agy))
        SELECT Scenario, count(*) AS bars, avg(pos) AS position FROM b GROUP BY Scenario"""),
    "cht_legend_order": _sql("agy", """
        SELECT G, round(sum(Value), 2) AS Value FROM agy GROUP BY G ORDER BY sum(Value)"""),
    "cht_style": _sql("impo rnames", """
        SELECT Scenario, Year, coalesce(name, Region) AS Region, CASE Region WHEN 'AFRICA' THEN '#16824D'
            WHEN 'AMERICA' THEN '#5492C5' WHEN 'ASIA' THEN '#493B82' WHEN 'EUROPE' THEN '#679C82'
            ELSE '#999999' END AS color,
          '' AS hatch, coalesce(name, Region) AS legend, round(v, 2) AS Value
        FROM impo LEFT JOIN rnames ON code = Region"""),
}
