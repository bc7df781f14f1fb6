"""DuckDB text for the oracle: preprocessing, KNN imputation, quantile
scaling.  These mirror the Spark operators' semantics in plain SQL."""

from __future__ import annotations

from custlens.functions.scalars import ORDINAL_MAPS_LIBRARY
from custlens.plans.fixture import register_cte

# One-hot vocabulary observed in the provided test tables.
ONE_HOT_VOCAB_TESTDATA = {
    "CustomerType": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "FavoriteSeason": ["Automne", "Hiver", "Printemps", "Été"],
    "Region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "Gender": ["F", "M"],
}


PROC_COLUMNS = [
    "CustomerID", "Recency", "Frequency", "MonetaryTotal", "MonetaryAvg", "MonetaryStd", "MonetaryMin",
    "MonetaryMax", "CancelledTransactions", "TotalTransactions", "TotalQuantity", "UniqueProducts",
    "ReturnRatio", "CustomerTenureDays", "FirstPurchaseDaysAgo", "AvgDaysBetweenPurchases", "Age",
    "SupportTicketsCount", "SatisfactionScore", "AgeCategory", "SpendingCategory", "LoyaltyLevel",
    "ChurnRiskCategory", "BasketSizeCategory", "PreferredTimeOfDay", "Churn", "RegYear", "RegMonth",
    "RegDay", "RegWeekday", "IP_IsPrivate", "IP_FirstOctet", "AvgBasketValue",
    "CustomerType_AUTOMOBILE", "CustomerType_BUILDING", "CustomerType_FURNITURE", "CustomerType_HOUSEHOLD",
    "CustomerType_MACHINERY", "FavoriteSeason_Automne", "FavoriteSeason_Hiver", "FavoriteSeason_Printemps",
    "FavoriteSeason_Été", "Gender_F", "Gender_M", "Region_AFRICA", "Region_AMERICA", "Region_ASIA",
    "Region_EUROPE", "Region_MIDDLE EAST", "Country_encoded"]


def sel_rounded(cols: list[str], doubles: set[str], rename: dict | None = None, d: int = 6) -> str:
    """Select list with doubles rounded half-even (value-hash friendly)."""
    rename = rename or {}
    out = []
    for c in cols:
        name = qi(rename.get(c, c))
        out.append(f"round_even({qi(c)}, {d}) AS {name}" if c in doubles else f"{qi(c)} AS {name}")
    return ", ".join(out)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qi(c: str) -> str:
    return '"' + c + '"'


def sql_lookup(c: str, texts: dict[str, str], default: str) -> str:
    """The text of ``texts`` for a label, as the operators look it up."""
    return f"CASE {c} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in texts.items()) + f" ELSE {lit(default)} END"


_OCT = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_SQL_RE = rf"^{_OCT}(\.{_OCT}){{3}}$"


def sql_ip_private(c: str) -> str:
    o = [f"CAST(split_part({c}, '.', {i}) AS INTEGER)" for i in range(1, 5)]
    v4 = (f"({o[0]} = 0 OR {o[0]} = 10 OR {o[0]} = 127 OR ({o[0]} = 169 AND {o[1]} = 254)"
          f" OR ({o[0]} = 172 AND {o[1]} BETWEEN 16 AND 31)"
          f" OR ({o[0]} = 192 AND {o[1]} = 0 AND {o[2]} = 0 AND {o[3]} NOT IN (9, 10))"
          f" OR ({o[0]} = 192 AND {o[1]} = 0 AND {o[2]} = 2) OR ({o[0]} = 192 AND {o[1]} = 168)"
          f" OR ({o[0]} = 198 AND {o[1]} IN (18, 19)) OR ({o[0]} = 198 AND {o[1]} = 51 AND {o[2]} = 100)"
          f" OR ({o[0]} = 203 AND {o[1]} = 0 AND {o[2]} = 113) OR {o[0]} >= 240)")
    v6 = (f"(regexp_matches(lower({c}), '^fe[89ab][0-9a-f]:') OR regexp_matches(lower({c}), '^f[cd][0-9a-f]{{2}}:')"
          f" OR lower({c}) IN ('::1', '::'))")
    return (f"CAST(CASE WHEN regexp_matches({c}, '{IPV4_SQL_RE}') THEN (CASE WHEN {v4} THEN 1 ELSE 0 END)"
            f" WHEN contains({c}, ':') THEN (CASE WHEN {v6} THEN 1 ELSE 0 END) END AS BIGINT)")


def sql_first_octet(c: str) -> str:
    return f"TRY_CAST(trim(split_part({c}, '.', 1)) AS BIGINT)"


def sql_parse_date(c: str) -> str:
    t = f"trim({c})"
    return (f"CAST(CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime({t}, '%Y-%m-%d')"
            f" WHEN regexp_matches({t}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN coalesce(try_strptime({t}, '%d/%m/%Y'), try_strptime({t}, '%m/%d/%Y'))"
            f" WHEN regexp_matches({t}, '^\\d{{2}}/\\d{{2}}/\\d{{2}}$') THEN coalesce(try_strptime({t}, '%d/%m/%y'), try_strptime({t}, '%m/%d/%y'))"
            f" END AS DATE)")


def sql_ordinal(c: str, m: dict) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in m.items())
    return f"CAST(CASE {qi(c)} {whens} ELSE -1 END AS BIGINT)"


_PLAIN = ["CustomerID", "Recency", "Frequency", "MonetaryTotal", "MonetaryAvg", "MonetaryStd",
          "MonetaryMin", "MonetaryMax", "CancelledTransactions", "TotalTransactions",
          "TotalQuantity", "UniqueProducts", "ReturnRatio", "CustomerTenureDays",
          "FirstPurchaseDaysAgo", "AvgDaysBetweenPurchases", "Age"]


def _proc_sql() -> str:
    sel = [qi(c) for c in _PLAIN]
    sel.append("CAST(CASE WHEN SupportTicketsCount IN (-1, 999) THEN NULL ELSE SupportTicketsCount END AS BIGINT) AS SupportTicketsCount")
    sel.append("CAST(CASE WHEN SatisfactionScore IN (-1, 99) THEN NULL ELSE SatisfactionScore END AS BIGINT) AS SatisfactionScore")
    for c, m in ORDINAL_MAPS_LIBRARY.items():
        sel.append(f"{sql_ordinal(c, m)} AS {qi(c)}")
    sel.append("Churn")
    d = sql_parse_date("RegistrationDate")
    sel += [f"CAST(year({d}) AS BIGINT) AS RegYear", f"CAST(month({d}) AS BIGINT) AS RegMonth",
            f"CAST(day({d}) AS BIGINT) AS RegDay", f"CAST(isodow({d}) - 1 AS BIGINT) AS RegWeekday"]
    sel += [f"{sql_ip_private('LastLoginIP')} AS IP_IsPrivate",
            f"{sql_first_octet('LastLoginIP')} AS IP_FirstOctet"]
    sel.append("MonetaryTotal / NULLIF(CAST(Frequency AS DOUBLE), 0) AS AvgBasketValue")
    for c, vals in ONE_HOT_VOCAB_TESTDATA.items():
        for v in vals:
            sel.append(f"CAST(CASE WHEN {qi(c)} = {lit(v)} THEN 1 ELSE 0 END AS BIGINT) AS {qi(c + '_' + v)}")
    sel.append("CAST(avg(CAST(Churn AS DOUBLE)) OVER (PARTITION BY Country) AS DOUBLE) AS Country_encoded")
    return "proc AS (SELECT " + ",\n  ".join(sel) + "\nFROM cust)"


register_cte("proc", _proc_sql(), ["cust"])


def knn_impute_ctes(prefix: str, src: str, key: str, cols: list[str], k: int = 5,
                    donors: str | None = None) -> str:
    """CTEs ``{prefix}_out`` = src with cols imputed (fit = donors, default src)."""
    donors = donors or src
    n = len(cols)
    f = [f"f{i}" for i in range(n)]
    base = f"{prefix}_b AS (SELECT {key} AS k, " + ", ".join(
        f"CAST({qi(c)} AS DOUBLE) AS {f[i]}" for i, c in enumerate(cols)) + f" FROM {src})"
    don = f"{prefix}_d AS (SELECT {key} AS k, " + ", ".join(
        f"CAST({qi(c)} AS DOUBLE) AS {f[i]}" for i, c in enumerate(cols)) + f" FROM {donors})"
    recv = f"{prefix}_r AS (SELECT * FROM {prefix}_b WHERE " + " OR ".join(f"{x} IS NULL" for x in f) + ")"
    both = [f"(r.{x} IS NOT NULL AND d.{x} IS NOT NULL)" for x in f]
    nc = " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in both)
    ss = " + ".join(f"CASE WHEN {b} THEN (r.{x} - d.{x}) * (r.{x} - d.{x}) ELSE CAST(0 AS DOUBLE) END"
                    for b, x in zip(both, f))
    pairs = (f"{prefix}_p AS (SELECT r.k AS rk, d.k AS dk, ({nc}) AS nc, ({ss}) AS ss, "
             + ", ".join(f"r.{x} IS NULL AS m{i}, d.{x} AS v{i}" for i, x in enumerate(f))
             + f" FROM {prefix}_r r CROSS JOIN {prefix}_d d)")
    dist = (f"{prefix}_q AS (SELECT *, sqrt(ss * CAST({n} AS DOUBLE) / nc) AS dist FROM {prefix}_p WHERE nc > 0)")
    cands = " UNION ALL ".join(
        f"SELECT rk, dk, dist, {i} AS f, v{i} AS v FROM {prefix}_q WHERE m{i} AND v{i} IS NOT NULL"
        for i in range(n))
    cand = f"{prefix}_c AS ({cands})"
    top = (f"{prefix}_t AS (SELECT rk, f, avg(v) AS v FROM (SELECT *, row_number() OVER "
           f"(PARTITION BY rk, f ORDER BY dist, dk) AS rn FROM {prefix}_c) WHERE rn <= {k} GROUP BY rk, f)")
    means = f"{prefix}_m AS (SELECT " + ", ".join(f"avg({x}) AS {x}" for x in f) + f" FROM {prefix}_d)"
    piv = (f"{prefix}_v AS (SELECT rk, " + ", ".join(f"max(CASE WHEN f = {i} THEN v END) AS i{i}" for i in range(n))
           + f" FROM {prefix}_t GROUP BY rk)")
    out = (f"{prefix}_out AS (SELECT b.k AS {key}, "
           + ", ".join(f"coalesce(b.{x}, v.i{i}, m.{x}) AS {qi(cols[i])}" for i, x in enumerate(f))
           + f" FROM {prefix}_b b LEFT JOIN {prefix}_v v ON v.rk = b.k CROSS JOIN {prefix}_m m)")
    return ",\n".join([base, don, recv, pairs, dist, cand, top, means, piv, out])


# Clustering features / log columns (mirrors operators.features).
CF = ["Recency", "Frequency", "MonetaryTotal", "SatisfactionScore", "ReturnRatio",
      "UniqueProducts", "AvgDaysBetweenPurchases", "Age", "SupportTicketsCount"]
LOGC = ["Recency", "Frequency", "MonetaryTotal", "UniqueProducts", "AvgDaysBetweenPurchases"]


def _cluster_prep_sql() -> str:
    imp = knn_impute_ctes("ki", "cbase", "CustomerID", CF)
    base = "cbase AS (SELECT * FROM proc WHERE MonetaryTotal > 0)"
    bounds = "cw AS (SELECT " + ", ".join(
        f"quantile_cont({qi(c)}, 0.01) AS lo{i}, quantile_cont({qi(c)}, 0.99) AS hi{i}"
        for i, c in enumerate(CF)) + " FROM ki_out)"

    def clipped(i, c):
        return f"CASE WHEN {qi(c)} IS NULL THEN NULL ELSE least(greatest({qi(c)}, w.lo{i}), w.hi{i}) END"
    lg = []
    for i, c in enumerate(CF):
        e = clipped(i, c)
        lg.append(f"ln(1 + {e}) AS {qi(c)}" if c in LOGC else f"{e} AS {qi(c)}")
    logged = "cl AS (SELECT CustomerID, " + ", ".join(lg) + " FROM ki_out CROSS JOIN cw w)"
    rs = "crs AS (SELECT " + ", ".join(
        f"quantile_cont({qi(c)}, 0.5) AS med{i}, quantile_cont({qi(c)}, 0.75) - quantile_cont({qi(c)}, 0.25) AS iqr{i}"
        for i, c in enumerate(CF)) + " FROM cl)"
    scaled = "cscaled AS (SELECT CustomerID, " + ", ".join(
        f"({qi(c)} - s.med{i}) / (CASE WHEN s.iqr{i} = 0 THEN 1 ELSE s.iqr{i} END) AS {qi(c)}"
        for i, c in enumerate(CF)) + " FROM cl CROSS JOIN crs s)"
    return ",\n".join([base, imp, bounds, logged, rs, scaled])


register_cte("cscaled", _cluster_prep_sql(), ["proc"])

# Fixed centroids on scaled (MonetaryTotal, Recency, Frequency).
FIXED = [[0.5, -0.5, 0.5], [0.0, 0.0, 0.0], [-0.5, 0.5, -0.5], [-1.0, 1.0, -1.0]]


def _assign_sql() -> str:
    d2 = []
    for j, (m, r, f) in enumerate(FIXED):
        d2.append(f"(MonetaryTotal - ({m})) * (MonetaryTotal - ({m})) + (Recency - ({r})) * (Recency - ({r}))"
                  f" + (Frequency - ({f})) * (Frequency - ({f}))")
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS d{j}" for j, e in enumerate(d2))
    pick = ("CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1 "
            "WHEN d2 <= d3 THEN 2 ELSE 3 END")
    return (f"cassign0 AS (SELECT CustomerID, {cols} FROM cscaled),\n"
            f"cassign AS (SELECT CustomerID, CAST({pick} AS BIGINT) AS cluster, least(d0, d1, d2, d3) AS dist2 FROM cassign0)")


register_cte("cassign", _assign_sql(), ["cscaled"])

register_cte("cseg", """cseg AS (
  SELECT p.CustomerID, a.cluster, a.dist2, p.Frequency, p.MonetaryTotal, p.CustomerTenureDays,
         p.SatisfactionScore, p.Churn, p.Recency
  FROM proc p JOIN cassign a ON a.CustomerID = p.CustomerID)""", ["cassign"])

register_cte("clabels", """cids AS (SELECT CAST(range AS BIGINT) AS cluster FROM range(4)),
cprof AS (SELECT i.cluster, avg(s.MonetaryTotal) AS mon FROM cids i LEFT JOIN cseg s ON s.cluster = i.cluster GROUP BY i.cluster),
clabels AS (SELECT cluster, CASE row_number() OVER (ORDER BY mon DESC NULLS LAST, cluster)
  WHEN 1 THEN 'VIP' WHEN 2 THEN 'Fidele' WHEN 3 THEN 'Occasionnel' WHEN 4 THEN 'A Risque' END AS label FROM cprof)""",
             ["cseg"])
