"""Independent SQL (DuckDB dialect) for every registered query.

Tables ``lineitem orders customer supplier`` are views over the same Parquet
files the Spark queries read. The CTEs below restate the fixture definitions
here calls the library.
"""

from __future__ import annotations

YEAR = (873072000, 904608000)
RECENT = (901929600, 904608000)
CAPS = (30, 25, 20, 10)
SAMPLE_FRACTION = 0.5
SAMPLE_SEED = 10
COMPONENT = 1

BASE = f"""
ledger_raw AS (
  SELECT CAST(epoch(l.l_shipdate) AS BIGINT) + (l.l_orderkey % 24) * 3600 AS "timestamp",
         'a' || CAST(o.o_custkey AS VARCHAR) AS "from",
         'a' || CAST(l.l_partkey AS VARCHAR) AS "to",
         CAST(CASE WHEN l.l_discount = 0 THEN 0.0 ELSE l.l_extendedprice END AS DOUBLE) AS value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
graph AS (SELECT * FROM ledger_raw
          WHERE "timestamp" >= {YEAR[0]} AND "timestamp" < {YEAR[1]}),
ledger AS (SELECT * FROM graph WHERE value <> 0),
blacklist AS (SELECT 'a' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal < 0),
labelled AS (SELECT 'a' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_acctbal < 0),
label_set AS (SELECT id, 1 AS label FROM (SELECT id FROM labelled UNION SELECT id FROM blacklist)),
seeds AS (
  SELECT 'a' || CAST(c_custkey AS VARCHAR) AS seed_id,
         row_number() OVER (ORDER BY grp, c_custkey) AS seed_no
  FROM ((SELECT c_custkey, 0 AS grp FROM customer WHERE c_acctbal < 0
         ORDER BY c_custkey LIMIT 5)
        UNION ALL
        (SELECT c_custkey, 1 AS grp FROM customer
         WHERE 'a' || CAST(c_custkey AS VARCHAR) NOT IN (SELECT id FROM label_set)
         ORDER BY c_custkey LIMIT 1))),
gated AS (SELECT seed_id FROM seeds WHERE seed_id IN (SELECT id FROM label_set)),
adj AS (SELECT "from" AS a, "to" AS b FROM ledger WHERE "from" IS NOT NULL AND "to" IS NOT NULL
        UNION ALL
        SELECT "to" AS a, "from" AS b FROM ledger WHERE "from" IS NOT NULL AND "to" IS NOT NULL)"""


def _level(prev: str | None, cap: int | None) -> str:
    if prev is None:
        pairs = ("SELECT g.seed_id, adj.b AS id, min(adj.a) AS parent "
                 "FROM gated g JOIN adj ON adj.a = g.seed_id GROUP BY g.seed_id, adj.b")
    else:
        pairs = (f"SELECT f.seed_id, adj.b AS id, min(adj.a) AS parent "
                 f"FROM {prev} f JOIN adj ON adj.a = f.id WHERE adj.b <> f.parent "
                 f"GROUP BY f.seed_id, adj.b")
    if cap is None:
        return pairs
    return (f"SELECT seed_id, id, parent FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY seed_id ORDER BY id) AS rn FROM ({pairs})) WHERE rn <= {cap}")


def _levels(prefix: str, caps) -> str:
    out, prev = [], None
    for h, cap in enumerate(caps, start=1):
        name = f"{prefix}{h}"
        out.append(f"{name} AS ({_level(prev, cap)})")
        prev = name
    return ",\n".join(out)


HOPS = f"""
{_levels('c', CAPS)},
{_levels('u', (None,) * 4)},
khop_capped AS (
  SELECT seed_id, id, parent AS "originalAddress", 1 AS label FROM c1
  UNION ALL SELECT seed_id, id, parent, 2 FROM c2
  UNION ALL SELECT seed_id, id, parent, 3 FROM c3
  UNION ALL SELECT seed_id, id, parent, 4 FROM c4),
khop AS (
  SELECT seed_id, id, parent AS "originalAddress", 1 AS label FROM u1
  UNION ALL SELECT seed_id, id, parent, 2 FROM u2
  UNION ALL SELECT seed_id, id, parent, 3 FROM u3
  UNION ALL SELECT seed_id, id, parent, 4 FROM u4),
flagged AS (
  SELECT k.seed_id, k.id, k."originalAddress", k.label,
         k.id IN (SELECT id FROM blacklist) AS "isInBlackListResult"
  FROM khop k),
nf AS (SELECT DISTINCT seed_id, id, "isInBlackListResult" FROM flagged),
nflows AS (
  SELECT n.seed_id, n."isInBlackListResult", 'from' AS direction, l."timestamp", l.value
  FROM nf n JOIN ledger l ON l."from" = n.id
  UNION ALL
  SELECT n.seed_id, n."isInBlackListResult", 'to' AS direction, l."timestamp", l.value
  FROM nf n JOIN ledger l ON l."to" = n.id),
sflows AS (
  SELECT s.seed_id, 'from' AS direction, l."timestamp", l.value
  FROM seeds s JOIN ledger l ON l."from" = s.seed_id
  UNION ALL
  SELECT s.seed_id, 'to' AS direction, l."timestamp", l.value
  FROM seeds s JOIN ledger l ON l."to" = s.seed_id),
aflows AS (
  SELECT n.seed_id, n.id, 'from' AS direction, l."timestamp", l.value
  FROM (SELECT DISTINCT seed_id, id FROM flagged) n JOIN ledger l ON l."from" = n.id
  UNION ALL
  SELECT n.seed_id, n.id, 'to' AS direction, l."timestamp", l.value
  FROM (SELECT DISTINCT seed_id, id FROM flagged) n JOIN ledger l ON l."to" = n.id),
bn AS (SELECT DISTINCT seed_id, id FROM flagged WHERE "isInBlackListResult"),
recent AS (
  SELECT s.seed_id, x.total_amount, coalesce(x.tx_count, 0) AS tx_count
  FROM seeds s LEFT JOIN (
    SELECT seed_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
           count(*) AS tx_count
    FROM (SELECT b.seed_id, l.value FROM bn b JOIN ledger l ON l."from" = b.id
          WHERE l."timestamp" >= {RECENT[0]} AND l."timestamp" < {RECENT[1]}
          UNION ALL
          SELECT b.seed_id, l.value FROM bn b JOIN ledger l ON l."to" = b.id
          WHERE l."timestamp" >= {RECENT[0]} AND l."timestamp" < {RECENT[1]})
    GROUP BY seed_id) x ON x.seed_id = s.seed_id)"""

_HASH = ("CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST(g.\"timestamp\" AS VARCHAR), "
         "g.\"from\", g.\"to\", CAST(g.copy AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0").format(seed=SAMPLE_SEED)

EXPLORE = f"""
gseeds AS (SELECT * FROM seeds WHERE seed_id IN (SELECT seed_id FROM gated)),
star_rows AS (
  SELECT s.seed_id, g."timestamp", g."from", g."to", 0 AS sampled
  FROM gseeds s JOIN graph g ON g."from" = s.seed_id WHERE s.seed_no = 1
  UNION ALL
  SELECT s.seed_id, g."timestamp", g."from", g."to", 0
  FROM gseeds s JOIN graph g ON g."to" = s.seed_id WHERE s.seed_no = 1
  UNION ALL
  SELECT s.seed_id, g."timestamp", g."from", g."to", 0
  FROM gseeds s JOIN graph g ON g."from" = s.seed_id WHERE s.seed_no = 2
  UNION ALL
  SELECT s.seed_id, g."timestamp", g."from", g."to", 1
  FROM gseeds s JOIN (SELECT *, row_number() OVER (PARTITION BY "timestamp", "from", "to") - 1 AS copy FROM graph) g
    ON g."from" = s.seed_id
  WHERE s.seed_no = 3 AND {_HASH} < {SAMPLE_FRACTION}),
n1 AS (SELECT DISTINCT s.seed_id, g."to" AS id FROM gseeds s JOIN graph g ON g."from" = s.seed_id
       WHERE g."to" IS NOT NULL),
b2 AS (SELECT DISTINCT n.seed_id, g."to" AS id FROM n1 n JOIN graph g ON g."from" = n.id
       WHERE g."to" IS NOT NULL),
b3 AS (SELECT seed_id, id FROM (
         SELECT n.seed_id, g."to" AS id FROM b2 n JOIN graph g ON g."from" = n.id
         UNION SELECT n.seed_id, g."from" AS id FROM b2 n JOIN graph g ON g."to" = n.id
         UNION SELECT seed_id, id FROM b2) WHERE id IS NOT NULL),
b4 AS (SELECT seed_id, id FROM (
         SELECT n.seed_id, g."to" AS id FROM b3 n JOIN graph g ON g."from" = n.id
         UNION SELECT n.seed_id, g."from" AS id FROM b3 n JOIN graph g ON g."to" = n.id
         UNION SELECT seed_id, id FROM b3) WHERE id IS NOT NULL),
degrees AS (SELECT n.seed_id, g."from", count(*) AS number
            FROM n1 n JOIN graph g ON g."from" = n.id GROUP BY n.seed_id, g."from"),
vertices AS (SELECT DISTINCT id FROM (SELECT "from" AS id FROM graph UNION ALL
                                      SELECT "to" AS id FROM graph) WHERE id IS NOT NULL)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _trend(flows: str, keys: str, buckets: list[tuple[str, str]], lag_name: str) -> str:
    cols = ", ".join(f"strftime(make_timestamp(\"timestamp\" * 1000000), '{fmt}') AS \"{name}\""
                     for name, fmt in buckets)
    names = ", ".join(f'"{name}"' for name, _ in buckets)
    return f"""
SELECT *, "count" - {lag_name} AS growth FROM (
  SELECT *, lag("count") OVER (PARTITION BY {keys} ORDER BY {names}) AS {lag_name} FROM (
    SELECT {keys}, {cols},
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
           count(*) AS "count"
    FROM {flows} WHERE "timestamp" IS NOT NULL
    GROUP BY {keys}, {names}))"""


_DATETIME = "strftime(make_timestamp(l.\"timestamp\" * 1000000), '%Y-%m-%d %H:%M:%S')"
_NKEYS = 'seed_id, "isInBlackListResult", direction'

SQL: dict[str, str] = {
    "ledger_clean": _with(BASE) + 'SELECT "timestamp", "from", "to", value FROM ledger',
    "label_set": _with(BASE) + "SELECT id, label FROM label_set",
    "seed_lookup": _with(BASE) + "SELECT seed_id FROM gated",
    "hop1": _with(BASE, HOPS) + 'SELECT seed_id, id, parent AS "originalAddress", 1 AS label FROM u1',
    "hop2_out": _with(BASE, HOPS) + """
SELECT DISTINCT f.seed_id, f.id AS "originalAddress", l."to" AS id, 2 AS label
FROM u1 f JOIN ledger l ON l."from" = f.id
WHERE l."to" IS NOT NULL AND l."to" <> f.parent""",
    "hop2_in": _with(BASE, HOPS) + """
SELECT DISTINCT f.seed_id, f.id AS "originalAddress", l."from" AS id, 2 AS label
FROM u1 f JOIN ledger l ON l."to" = f.id
WHERE l."from" IS NOT NULL AND l."from" <> f.parent""",
    "hop2_frontier": _with(BASE, HOPS) + 'SELECT seed_id, id, parent AS "originalAddress", 2 AS label FROM u2',
    "khop_capped": _with(BASE, HOPS) + "SELECT * FROM khop_capped",
    "khop2_uncapped": _with(BASE, HOPS) + 'SELECT seed_id, id, parent AS "originalAddress", 2 AS label FROM u2',
    "khop4_uncapped": _with(BASE, HOPS) + """
SELECT seed_id, id, parent AS "originalAddress", 1 AS label FROM u1
UNION ALL SELECT seed_id, id, parent, 2 FROM u2
UNION ALL SELECT seed_id, id, parent, 3 FROM u3
UNION ALL SELECT seed_id, id, parent, 4 FROM u4""",
    "neighbours_flagged": _with(BASE, HOPS) + "SELECT * FROM flagged",
    "black_neighbours": _with(BASE, HOPS) + 'SELECT seed_id, id, label FROM flagged WHERE "isInBlackListResult"',
    "blacklist_ratio": _with(BASE, HOPS) + """
SELECT s.seed_id, coalesce(x.black_count, 0) AS black_count,
       coalesce(x.total_count, 0) AS total_count,
       CASE WHEN coalesce(x.total_count, 0) <> 0
            THEN CAST(x.black_count AS DOUBLE) / CAST(x.total_count AS DOUBLE) END AS ratio
FROM seeds s LEFT JOIN (
  SELECT seed_id, count(*) FILTER (WHERE id IN (SELECT id FROM blacklist)) AS black_count,
         count(*) AS total_count
  FROM u2 GROUP BY seed_id) x ON x.seed_id = s.seed_id""",
    "account_transactions": _with(BASE) + f"""
SELECT s.seed_id, l."timestamp", {_DATETIME} AS "time", l."from", l."to", l.value
FROM seeds s JOIN ledger l ON l."from" = s.seed_id
UNION ALL
SELECT s.seed_id, l."timestamp", {_DATETIME} AS "time", l."from", l."to", l.value
FROM seeds s JOIN ledger l ON l."to" = s.seed_id""",
    "neighbour_transactions": _with(BASE, HOPS) + f"""
SELECT n.seed_id, n.id, l."timestamp", {_DATETIME} AS "time", l."from", l."to", l.value
FROM (SELECT DISTINCT seed_id, id FROM flagged) n JOIN ledger l ON l."from" = n.id
UNION ALL
SELECT n.seed_id, n.id, l."timestamp", {_DATETIME} AS "time", l."from", l."to", l.value
FROM (SELECT DISTINCT seed_id, id FROM flagged) n JOIN ledger l ON l."to" = n.id""",
    "trend_daily": _with(BASE, HOPS) + _trend("nflows", _NKEYS, [("date", "%Y-%m-%d")],
                                              "yesterday_count"),
    "trend_hourly": _with(BASE, HOPS) + _trend("nflows", _NKEYS, [("hour", "%Y-%m-%d %H")],
                                               "lasthour_count"),
    "trend_monthly": _with(BASE, HOPS) + _trend("nflows", _NKEYS, [("month", "%Y-%m")],
                                                "lastmonth_count"),
    "account_daily": _with(BASE, HOPS) + _trend("sflows", "seed_id, direction",
                                                [("date", "%Y-%m-%d")], "yesterday_count"),
    "neighbour_account_daily": _with(BASE, HOPS) + _trend(
        "aflows", "seed_id, id, direction", [("date", "%Y-%m-%d")], "yesterday_count"),
    "account_hour_of_day": _with(BASE, HOPS) + _trend(
        "sflows", "seed_id, direction", [("date", "%Y-%m-%d"), ("hour", "%H")], "lasthour_count"),
    "recent_summary": _with(BASE, HOPS) + "SELECT seed_id, total_amount, tx_count FROM recent",
    "seed_report": _with(BASE, HOPS) + """
SELECT s.seed_id,
       coalesce(x.hop1_count, 0) AS hop1_count, coalesce(x.hop2_count, 0) AS hop2_count,
       coalesce(x.hop3_count, 0) AS hop3_count, coalesce(x.hop4_count, 0) AS hop4_count,
       coalesce(x.neighbour_count, 0) AS neighbour_count,
       coalesce(x.black_count, 0) AS black_count,
       CASE WHEN coalesce(x.neighbour_count, 0) <> 0
            THEN CAST(x.black_count AS DOUBLE) / CAST(x.neighbour_count AS DOUBLE) END AS ratio,
       r.total_amount, r.tx_count
FROM seeds s
LEFT JOIN (SELECT seed_id,
                  count(*) FILTER (WHERE label = 1) AS hop1_count,
                  count(*) FILTER (WHERE label = 2) AS hop2_count,
                  count(*) FILTER (WHERE label = 3) AS hop3_count,
                  count(*) FILTER (WHERE label = 4) AS hop4_count,
                  count(*) AS neighbour_count,
                  count(*) FILTER (WHERE "isInBlackListResult") AS black_count
           FROM flagged GROUP BY seed_id) x ON x.seed_id = s.seed_id
LEFT JOIN recent r ON r.seed_id = s.seed_id""",
    "star_vertices": _with(BASE, EXPLORE) + """
SELECT v.id, coalesce(ls.label, 0) AS label FROM (
  SELECT DISTINCT id FROM (
    SELECT "from" AS id FROM star_rows UNION ALL SELECT "to" FROM star_rows
    UNION ALL SELECT seed_id FROM gseeds WHERE seed_no <= 3) WHERE id IS NOT NULL) v
LEFT JOIN label_set ls ON ls.id = v.id""",
    "star_edges": _with(BASE, EXPLORE) + 'SELECT DISTINCT "from", "to" FROM star_rows',
    "star_sampled": _with(BASE, EXPLORE) + 'SELECT "from", "to" FROM star_rows WHERE sampled = 1',
    "hop_out_degree": _with(BASE, EXPLORE) + 'SELECT seed_id, "from", number FROM degrees',
    "multi_edge": _with(BASE, EXPLORE) + 'SELECT seed_id, "from", number FROM degrees WHERE number IN (2, 3)',
    "ball2": _with(BASE, EXPLORE) + "SELECT seed_id, id FROM b2",
    "ball3": _with(BASE, EXPLORE) + """
SELECT b.seed_id, b.id, coalesce(ls.label, 0) AS label FROM b3 b LEFT JOIN label_set ls ON ls.id = b.id""",
    "ball4": _with(BASE, EXPLORE) + """
SELECT b.seed_id, b.id, coalesce(ls.label, 0) AS label FROM b4 b LEFT JOIN label_set ls ON ls.id = b.id""",
    "ball4_edges": _with(BASE, EXPLORE) + """
SELECT DISTINCT seed_id, source, target FROM (
  SELECT b.seed_id, g."from" AS source, g."to" AS target FROM b3 b JOIN graph g ON g."from" = b.id
  UNION ALL
  SELECT b.seed_id, g."from" AS source, g."to" AS target FROM b3 b JOIN graph g ON g."to" = b.id)""",
    "ball_black_count": _with(BASE, EXPLORE) + """
SELECT s.seed_id, coalesce(x.n, 0) AS n FROM seeds s LEFT JOIN (
  SELECT b.seed_id, count(*) AS n FROM b4 b JOIN label_set ls ON ls.id = b.id
  WHERE ls.label = 1 GROUP BY b.seed_id) x ON x.seed_id = s.seed_id""",
    "all_vertices": _with(BASE, EXPLORE) + "SELECT id FROM vertices",
    "component_labelled": _with(BASE, EXPLORE) + f"""
SELECT c.id, c.component, ls.label
FROM (SELECT 'a' || CAST(c_custkey AS VARCHAR) AS id, c_nationkey AS component FROM customer) c
JOIN label_set ls ON ls.id = c.id
WHERE c.component = {COMPONENT} AND c.id IN (SELECT id FROM vertices)""",
}

SQL["account_transactions_typed"] = _with(BASE) + """
SELECT s.seed_id, l."timestamp", l."from", l."to", l.value,
       CAST(make_timestamp(l."timestamp" * 1000000) AS TIMESTAMP) AS at
FROM seeds s JOIN ledger l ON l."from" = s.seed_id OR l."to" = s.seed_id
UNION ALL
SELECT s.seed_id, l."timestamp", l."from", l."to", l.value, CAST(make_timestamp(l."timestamp" * 1000000) AS TIMESTAMP)
FROM seeds s JOIN ledger l ON l."from" = s.seed_id AND l."to" = s.seed_id"""
SQL["account_time_of_day"] = _with(BASE) + """
SELECT seed_id, strftime(epoch_ms(ts * 1000), '%H:%M:%S') AS time_of_day, count(*) AS count FROM (
  SELECT s.seed_id, l."timestamp" AS ts FROM seeds s JOIN ledger l ON l."from" = s.seed_id
  UNION ALL SELECT s.seed_id, l."timestamp" FROM seeds s JOIN ledger l ON l."to" = s.seed_id)
GROUP BY ALL"""
SQL["account_daily_exact"] = (
    "SELECT seed_id, direction, date, round(total_amount, 2) AS total_amount, count, yesterday_count, growth "
    f"FROM ({SQL['account_daily']})")
SQL["ledger_csv"] = SQL["ledger_clean"]
SQL["accounts_csv"] = _with(BASE) + "SELECT DISTINCT id FROM blacklist"
SQL["ledger_month"] = _with(BASE) + f"""
SELECT * FROM ledger_raw WHERE "timestamp" >= {RECENT[0]} AND "timestamp" < {RECENT[1]}"""
SQL["hub_sample"] = _with(BASE) + f"""
SELECT "from", count(*) AS rows FROM (
  SELECT g.* FROM (SELECT *, row_number() OVER (PARTITION BY "timestamp", "from", "to", value) - 1 AS copy FROM graph) g
  WHERE {_HASH} < {SAMPLE_FRACTION}) GROUP BY "from\""""

SQL["blacklist_percent"] = f"""
SELECT seed_id, CASE WHEN ratio IS NOT NULL THEN printf('%.2f%%', ratio * 100) END AS percent
FROM ({SQL["blacklist_ratio"]})"""
