"""DuckDB counterparts of the views, written independently of the Spark code."""

HOURS = """
hours AS (
  SELECT event_type AS spread_id, date_trunc('hour', ts) AS t,
         arg_min(value, ts) AS open, arg_max(value, ts) AS close, max(value) AS high, min(value) AS low,
         count(*)::DOUBLE AS volume, CAST(date_trunc('day', ts) AS DATE) AS session_date
  FROM events GROUP BY ALL)"""

HBARS = (
    HOURS.replace(", CAST(date_trunc('day', ts) AS DATE) AS session_date", "")
    + """,
hp AS (
  SELECT spread_id, t, CAST(t AS DATE) AS session_date, hour(t) AS slot, open, high, low, close AS x,
         round((open + close) / 2, 4) AS vw, volume AS cap, volume * 1000.0 AS bbl, volume * 7.0 + hour(t) AS oi,
         high AS leg1, low AS leg2,
         round(close - lag(close) OVER (PARTITION BY spread_id ORDER BY t), 4) AS d,
         row_number() OVER (PARTITION BY spread_id ORDER BY t) AS rn
  FROM hours)"""
)

DBARS = """
dbars AS (
  SELECT p_brand AS entity, CAST(l_shipdate AS DATE) AS session_date,
         avg(l_extendedprice / l_quantity) / 1.07 AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

CURVE = """
curve AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 1.07 AS value,
         count(*) AS n FROM orders GROUP BY ALL)"""

TRADES = """
trades AS (
  SELECT p_brand AS spread_id, l_returnflag || l_linestatus AS strategy_id,
         least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS entry_session,
         greatest(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS exit_session,
         l_extendedprice * (l_discount - l_tax) AS net, 0.001 * l_extendedprice AS cost,
         l_extendedprice * (l_discount - l_tax) + 0.001 * l_extendedprice AS gross,
         l_extendedprice * (l_discount - l_tax) - 0.001 * l_extendedprice AS net2,
         l_extendedprice * (l_discount - l_tax) - 2 * (0.001 * l_extendedprice) AS net3,
         CASE WHEN l_discount >= l_tax THEN 'LONG' ELSE 'SHORT' END AS direction,
         CAST(l_quantity AS INTEGER) AS holding_bars,
         CASE WHEN l_linenumber = 7 THEN 'MANDATORY_D4_EXIT' ELSE 'MAX_HOLD' END AS exit_reason,
         substr(p_brand, 1, 7) AS algebra_group, p_size % 3 + 1 AS complexity_tier,
         l_quantity AS relvol, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

CBARS = """
raw AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'HO' WHEN 'N' THEN 'CL' ELSE 'QS' END AS root,
         CASE l_returnflag WHEN 'A' THEN 503.0 WHEN 'N' THEN 15.1 ELSE 1.99 END::DOUBLE AS scale,
         CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS step, CAST(l_shipdate AS DATE) AS d,
         l_extendedprice AS e, l_quantity AS q FROM lineitem),
cb0 AS (
  SELECT root, step, d,
         round(arg_max(e / q / scale, {'q': q, 'e': e}), 10) AS open, round(avg(e / q / scale), 10) AS close,
         sum(q) AS vol, count(*)::DOUBLE AS events, sum(e / scale) AS value
  FROM raw GROUP BY ALL),
cbars AS (
  SELECT *, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH + step * INTERVAL 1 MONTH AS DATE) AS delivery,
         CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS risk_date,
         root || substr('FGHJKMNQUVXZ', month(date_trunc('quarter', d) + INTERVAL 3 MONTH + step * INTERVAL 1 MONTH), 1)
              || strftime(date_trunc('quarter', d) + INTERVAL 3 MONTH + step * INTERVAL 1 MONTH, '%y') AS security
  FROM cb0)"""


def calendar_cte(first: str, last: str) -> str:
    """Sessions per exchange between two date expressions, from weekday rules."""
    return f"""
cal_days AS (SELECT CAST(unnest(generate_series(({first})::TIMESTAMP - INTERVAL 40 DAY, ({last})::TIMESTAMP + INTERVAL 40 DAY, INTERVAL 1 DAY)) AS DATE) AS d),
cal_e AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM (
  SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
  SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
  SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (
  SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT DISTINCT year(d) AS y FROM cal_days)))))),
cal_p AS (SELECT d, month(d) AS mo, day(d) AS dy, isodow(d) AS dow, (day(d) - 1) // 7 + 1 AS nth, d - easter AS past_easter
  FROM cal_days JOIN cal_e ON year(d) = y),
cal_h AS (
  SELECT d, 'NYMEX' AS ex FROM cal_p WHERE (mo = 1 AND dow = 1 AND nth = 3) OR (mo = 2 AND dow = 1 AND nth = 3) OR past_easter = -2
    OR (mo = 5 AND dow = 1 AND dy > 24) OR (mo = 9 AND dow = 1 AND nth = 1) OR (mo = 11 AND dow = 4 AND nth = 4)
    OR (mo = 6 AND (dy = 19 OR (dy = 18 AND dow = 5) OR (dy = 20 AND dow = 1))) OR (mo = 7 AND (dy = 4 OR (dy = 3 AND dow = 5) OR (dy = 5 AND dow = 1)))
    OR (mo = 1 AND (dy = 1 OR (dy = 2 AND dow = 1))) OR (mo = 12 AND (dy = 25 OR (dy = 24 AND dow = 5) OR (dy = 26 AND dow = 1)))
  UNION ALL
  SELECT d, 'ICE' FROM cal_p WHERE past_easter IN (-2, 1) OR (mo = 5 AND dow = 1 AND nth = 1) OR (mo = 5 AND dow = 1 AND dy > 24) OR (mo = 8 AND dow = 1 AND dy > 24)
    OR (mo = 1 AND (dy = 1 OR (dy = 2 AND dow = 1))) OR (mo = 12 AND (dy = 25 OR (dy = 24 AND dow = 5) OR (dy = 26 AND dow = 1)))
    OR (mo = 12 AND ((dy = 26 AND dow BETWEEN 2 AND 5) OR (dy = 27 AND dow IN (1, 2))))),
sess AS (SELECT ex, d, row_number() OVER (PARTITION BY ex ORDER BY d) AS i
  FROM cal_days, (VALUES ('NYMEX'), ('ICE')) e(ex) WHERE isodow(d) <= 5 AND (d, ex) NOT IN (SELECT (d, ex) FROM cal_h))"""


REGISTRY = (
    calendar_cte("(SELECT min(risk_date) FROM cbars)", "(SELECT max(risk_date) FROM cbars)")
    + """,
reg0 AS (SELECT DISTINCT root, security, delivery, risk_date, CASE WHEN root IN ('QS', 'CO') THEN 'ICE' ELSE 'NYMEX' END AS ex FROM cbars),
reg1 AS (SELECT reg0.*, (SELECT max(i) FROM sess WHERE sess.ex = reg0.ex AND sess.d < reg0.risk_date) AS last_i FROM reg0),
reg AS (SELECT reg1.*, b.d AS blackout, f.d AS forced FROM reg1
  JOIN sess b ON b.ex = reg1.ex AND b.i = last_i - 2 JOIN sess f ON f.ex = reg1.ex AND f.i = last_i - 3)"""
)

# Contract economics of the four roots.
ECON = """
econ(root, k, size, bbl, tick, cost) AS (VALUES ('HO', 42.0::DOUBLE, 42000.0::DOUBLE, 1000.0::DOUBLE, 0.0001::DOUBLE, 6.7::DOUBLE),
  ('CL', 1.0, 1000.0, 1000.0, 0.01, 12.5), ('CO', 1.0, 1000.0, 1000.0, 0.01, 12.5), ('QS', 0.1342281879194631, 100.0, 745.0, 0.25, 27.5))"""

# Two bars a weekly session: ``d`` is the time of a bar, ``sd`` its session.
CURVE_BARS = """
raw AS (
  SELECT CASE WHEN l_returnflag = 'A' THEN 'HO' WHEN l_returnflag = 'R' THEN 'QS' WHEN l_partkey % 2 = 0 THEN 'CL' ELSE 'CO' END AS root,
         CASE WHEN l_returnflag = 'A' THEN 503.0 WHEN l_returnflag = 'R' THEN 1.99 ELSE 15.1 END::DOUBLE AS scale, l_linenumber % 4 AS step,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS sd, CASE WHEN isodow(l_shipdate) <= 3 THEN 0 ELSE 1 END AS slot, l_extendedprice AS e, l_quantity AS q FROM lineitem),
cb0 AS (
  SELECT root, step, sd, slot, round(arg_max(e / q / scale, {'q': q, 'e': e}), 10) AS open, round(avg(e / q / scale), 10) AS close, sum(q) AS vol, count(*)::DOUBLE AS events, sum(e / scale) AS value
  FROM raw GROUP BY ALL),
cp AS (SELECT *, make_date(year(sd), (month(sd) - 1) // 4 * 4 + 1, 1) AS p0 FROM cb0),
cbars AS (
  SELECT *, sd + slot * INTERVAL 12 HOUR AS d, CAST(p0 + INTERVAL 4 MONTH + step * INTERVAL 1 MONTH AS DATE) AS delivery, CAST(p0 + INTERVAL 4 MONTH - INTERVAL 1 DAY AS DATE) AS risk_date,
         root || substr('FGHJKMNQUVXZ', month(p0 + INTERVAL 4 MONTH + step * INTERVAL 1 MONTH), 1) || strftime(p0 + INTERVAL 4 MONTH + step * INTERVAL 1 MONTH, '%y') AS security
  FROM cp)"""

CURVE_PREPARED = f"""{CURVE_BARS}, {REGISTRY}, {ECON},
od AS (SELECT security, sd, sum(vol) * 10 + sum(events) AS oi FROM cbars GROUP BY ALL),
oi AS (SELECT security, sd, lag(oi) OVER (PARTITION BY security ORDER BY sd) AS oi1, lag(oi) OVER (PARTITION BY security ORDER BY sd) - lag(oi, 6) OVER (PARTITION BY security ORDER BY sd) AS oi5 FROM od),
prep AS (SELECT c.*, year(c.delivery) * 12 + month(c.delivery) - 1 AS di, r.blackout, r.forced, k, size, bbl, tick, cost, oi1, oi5,
  CASE WHEN events >= 3 THEN close * 0.999 END AS bid, CASE WHEN events >= 3 THEN close * 1.001 END AS ask, row_number() OVER (PARTITION BY c.root, c.d ORDER BY c.delivery) AS grank
  FROM cbars c JOIN reg r USING (root, security, delivery) JOIN econ USING (root) JOIN oi ON oi.security = c.security AND oi.sd = c.sd
  WHERE c.sd < r.blackout)"""

PREPARED = f"""{CBARS}, {REGISTRY}, {ECON},
oi AS (SELECT security, d, lag(vol * 10 + events) OVER (PARTITION BY security ORDER BY d) AS oi1,
  lag(vol * 10 + events) OVER (PARTITION BY security ORDER BY d) - lag(vol * 10 + events, 6) OVER (PARTITION BY security ORDER BY d) AS oi5 FROM cbars),
prep AS (SELECT c.*, year(c.delivery) * 12 + month(c.delivery) - 1 AS di, r.blackout, r.forced, k, size, bbl, tick, cost, oi1, oi5,
  CASE WHEN events >= 3 THEN close * 0.999 END AS bid, CASE WHEN events >= 3 THEN close * 1.001 END AS ask,
  row_number() OVER (PARTITION BY c.root, c.d ORDER BY c.delivery) AS grank
  FROM cbars c JOIN reg r USING (root, security, delivery) JOIN econ USING (root) JOIN oi ON oi.security = c.security AND oi.d = c.d
  WHERE c.d < r.blackout)"""


def _settlement(s) -> str:
    if {"QS", "CO"} <= {g.root for g in s.legs}:
        return "CROSS_MARKET_ASYNC_SETTLE"
    return "DEFERRED_SETTLE_RELATIONSHIP" if s.anchor_rank > 6 else "EXCHANGE_SETTLE"


def packages_cte(structures) -> str:
    """One explicit n-way join per structure."""
    from curvelab.config import ROOTS

    barrels = {r.root: r.contract_barrels for r in ROOTS}
    parts = []
    for s in structures:
        legs = list(enumerate(s.legs, start=1))
        joins = " ".join(
            f"JOIN prep l{i} ON l{i}.d = a.d AND l{i}.root = '{g.root}' AND {f'l{i}.grank = {g.rank}' if g.mode == 'rank' else f'l{i}.di = a.di + {g.offset}'}" for i, g in legs
        )

        def total(expr: str, weighted: bool = True) -> str:
            return " + ".join(
                "("
                + (f"{g.sign * g.price_weight} * l{i}.k * " if weighted else "")
                + expr.replace("@", f"l{i}").replace("#n", str(g.contracts)).replace("#s", str(g.sign))
                + ")"
                for i, g in legs
            )

        def least(expr: str, f: str = "least") -> str:
            return f"{f}(" + ", ".join(expr.replace("@", f"l{i}").replace("#n", str(g.contracts)) for i, g in legs) + ")"

        buy = " + ".join(
            f"({g.sign * g.price_weight} * l{i}.k * coalesce(l{i}.{'ask' if g.sign > 0 else 'bid'}, l{i}.close))" for i, g in legs
        )
        sell = " + ".join(
            f"({g.sign * g.price_weight} * l{i}.k * coalesce(l{i}.{'bid' if g.sign > 0 else 'ask'}, l{i}.close))" for i, g in legs
        )
        long = sum(g.contracts * barrels[g.root] for g in s.legs if g.sign > 0)
        short = sum(g.contracts * barrels[g.root] for g in s.legs if g.sign < 0)
        roll = " || ' | ' || ".join(f"l{i}.security" for i, _ in legs)
        parts.append(
            f"SELECT * EXCLUDE srank FROM (SELECT '{s.spread_id}' AS spread_id, '{s.family}' AS family, '{s.tenor_bucket}' AS tenor, '{_settlement(s)}' AS settlement,"
            f" '{s.group}' AS algebra_group, {s.tier} AS tier, a.d, {total('@.open')} AS s_open, {total('@.close')} AS s_close,"
            f" {buy} AS s_buy, {sell} AS s_sell, {least('@.vol / #n')} AS cap, {least('@.oi1 / #n')} AS oicap,"
            f" {total('@.cost * #n', False)} AS cost, {least('@.events')} AS events,"
            f" {total('#s * #n * @.open * @.size', False)} AS v_open, {total('#s * #n * @.close * @.size', False)} AS v_close,"
            f" {total('@.value / @.vol')} AS s_vwap, {least('(@.ask - @.bid) / @.tick', 'greatest')} AS ticks,"
            f" {float(min(long, short) or max(long, short))}::DOUBLE AS barrels, {least('@.risk_date')} AS risk_date,"
            f" {least('@.blackout')} AS blackout, {least('@.forced')} AS forced,"
            f" CAST(a.d AS DATE) < {least('@.forced')} AS entry_allowed, {roll} AS roll_id, l1.close * l1.k AS leg1, l2.close * l2.k AS leg2,"
            f" dense_rank() OVER (PARTITION BY a.d ORDER BY a.di) AS srank, {len(s.legs)} AS n_legs"
            f" FROM prep a {joins} WHERE a.root = '{s.anchor_root}') WHERE srank = {s.anchor_rank}"
        )
    return "pk AS (\n" + "\nUNION ALL\n".join(parts) + ")"


ADJUSTED = """
ad0 AS (SELECT *, lag(s_close) OVER w AS pc, coalesce(roll_id <> lag(roll_id) OVER w, false) AS rolled FROM pk WINDOW w AS (PARTITION BY spread_id ORDER BY d)),
ad1 AS (SELECT *, CASE WHEN rolled THEN pc - s_close ELSE 0 END AS gap, CASE WHEN NOT rolled THEN s_close - pc END AS chg FROM ad0),
adj AS (SELECT *, CASE WHEN CAST(d AS DATE) = CAST(lag(d) OVER (PARTITION BY spread_id ORDER BY d) AS DATE) THEN chg END AS intraday, CASE WHEN CAST(d AS DATE) <> CAST(lag(d) OVER (PARTITION BY spread_id ORDER BY d) AS DATE) THEN chg END AS overnight,
  s_close - coalesce(sum(gap) OVER (PARTITION BY spread_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS x,
  cap * barrels AS bbl, len(list_filter(generate_series(CAST(d AS DATE), risk_date - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda v: isodow(v) <= 5)) AS to_risk,
  row_number() OVER (PARTITION BY spread_id ORDER BY d) AS rn FROM ad1)"""
