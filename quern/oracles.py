"""DuckDB SQL that checks the queries; written apart from the operators, over the same tables.

``ids(table, key)`` gives a table's keys as column i, from which entities follow by formula. A number with an f at its
end is a float32 literal. Sums run over whole thousandths, which do not depend on any order.
"""

from __future__ import annotations

import re

ALL = {"customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "nation": "n_nationkey", "part": "p_partkey", "region": "r_regionkey"}


def ids(table: str) -> str:
    return f"(SELECT CAST({ALL[table]} AS BIGINT) AS i FROM {table})"


def duck(sql: str) -> str:
    """Float32 literals and integer casts spelled out."""
    sql = re.sub(r"(?<![\w.])(\d*\.?\d+)f\b", r"CAST(\1 AS FLOAT)", sql)
    return re.sub(r"\bI\[([^\]]*)\]", r"CAST(\1 AS INT)", re.sub(r"\bR\[([^\]]*)\]", r"CAST(\1 AS FLOAT)", sql))


def milli(x: str) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) * 1000) AS BIGINT)"


def total(x: str, name: str) -> str:
    return f"CAST(sum({x}) AS BIGINT) AS {name}"


def reasons(names: tuple) -> str:
    return ", ".join(f"count(CASE WHEN (mask & {1 << k}) <> 0 THEN 1 END) AS {n}" for k, n in enumerate(names))


def bits(*conditions: str) -> str:
    return " | ".join(f"(CASE WHEN {c} THEN {1 << k} ELSE 0 END)" for k, c in enumerate(conditions))


def d2(a: str, b: str) -> str:
    return f"(({a}x - {b}x) * ({a}x - {b}x) + ({a}y - {b}y) * ({a}y - {b}y))"


SMOKE = f"SELECT count(*) AS n, {total('CAST(floor((x*x + x*2.0e0 + 1.0e0) * 1000000) AS BIGINT)', 'checksum_micro')} FROM (SELECT (i % 1024 + 1)::DOUBLE * 0.001e0 AS x FROM {ids('orders')})"


def polynomial(degree: int = 15) -> str:
    power, c = 1.0, []
    for d in range(degree + 1):
        c.append((-1.0) ** d / (d + 1) * power)
        power *= 1e-5
    out = f"{c[-1]!r}::DOUBLE"
    for x in reversed(c[:-1]):
        out = f"({out} * x + {x!r}::DOUBLE)"
    return f"SELECT i, {out} AS y FROM (SELECT i, (i % 4096 + 1)::DOUBLE * 100.0e0 AS x FROM {ids('orders')})"


COST_TASKS = f"(SELECT i AS task_id, R[(17*i)%1600]*0.45f AS x, R[(31*i+13)%1600]*0.35f AS y, 150f+R[(19*i)%120]*3.5f AS deadline, 1f+R[i%7]*0.35f AS priority, 1 << I[i%8] AS skill, i%6=0 AS urgent FROM {ids('customer')})"
COST_RESOURCES = f"(SELECT i AS resource_id, R[(29*i+7)%1600]*0.42f AS x, R[(43*i+5)%1600]*0.38f AS y, R[R[(11*i)%101]/100f] AS load, 0.85f+R[i%6]*0.18f AS speed, R[(23*i)%90]*2f AS available, (1 << I[i%8]) | (1 << I[(i+3)%8]) | (1 << I[(i+5)%8]) AS mask FROM {ids('supplier')})".replace("R[R[(11*i)%101]/100f]", "CAST(R[(11*i)%101]/100f AS FLOAT)")
COST = f"""(SELECT task_id, resource_id, ok, CASE WHEN ok THEN 0.11f*d + 0.65f*CAST(d/speed AS FLOAT) + 31f*load + 7f*priority
    + (CASE WHEN urgent THEN 2.75f*late + 15f ELSE 0.85f*late END) + (CASE WHEN load > 0.82f THEN 115f WHEN load > 0.62f THEN 35f ELSE 0f END) + (CASE WHEN abs(tx-ry) > 410f THEN 22f ELSE 0f END) END AS cost
  FROM (SELECT *, fit AND late <= (CASE WHEN urgent THEN 80f ELSE 240f END) AS ok FROM (SELECT *, greatest(0f, available + CAST(d/speed AS FLOAT) - deadline) AS late, skill & mask <> 0 AND d <= (CASE WHEN urgent THEN 620f ELSE 980f END) AS fit
    FROM (SELECT t.task_id, r.resource_id, t.x AS tx, r.y AS ry, t.deadline, t.priority, t.skill, t.urgent, r.load, r.speed, r.available, r.mask, CAST(sqrt({d2('t.', 'r.')}) AS FLOAT) AS d FROM {COST_TASKS} t CROSS JOIN {COST_RESOURCES} r))))"""
COST_SUMMARY = f"SELECT count(*) AS pairs, count(CASE WHEN ok THEN 1 END) AS feasible_count, {total(milli('cost'), 'checksum_milli')} FROM {COST}"
COST_FEASIBLE = f"SELECT task_id, resource_id, cost FROM {COST} WHERE ok"

TRACKS = f"(SELECT i AS track_id, R[(37*i+11)%2000]*0.5f AS x0, R[(53*i+19)%2000]*0.5f AS y0, R[(37*i+11)%2000]*0.5f+R[(19*i)%61-30]*5f AS x1, R[(53*i+19)%2000]*0.5f+R[(23*i)%61-30]*4.5f AS y1, 4f+R[(7*i)%37]*0.65f AS speed FROM {ids('customer')})"
ZONES = f"(SELECT i AS zone_id, R[(59*i+7)%2000]*0.5f AS x, R[(71*i+29)%2000]*0.5f AS y, 28f+R[i%9]*14f AS radius, 1f+R[i%6]*0.45f AS severity FROM {ids('supplier')})"
SPATIAL = f"""(SELECT track_id, zone_id, code, CASE code WHEN 1 THEN severity*(4f+0.03f*speed) WHEN 2 THEN severity*(3f+0.02f*speed) WHEN 3 THEN severity*(1f+0.01f*speed) WHEN 4 THEN severity*(5f+0.04f*speed) ELSE 0f END AS score
  FROM (SELECT *, CASE WHEN a AND b THEN 3 WHEN a THEN 2 WHEN b THEN 1 WHEN seg > 0.000001f AND (x0+p*dx-x)*(x0+p*dx-x) + (y0+p*dy-y)*(y0+p*dy-y) <= radius*radius THEN 4 ELSE 0 END AS code
    FROM (SELECT *, CASE WHEN seg > 0.000001f THEN greatest(0f, least(1f, CAST(((x-x0)*dx + (y-y0)*dy)/seg AS FLOAT))) ELSE 0f END AS p
      FROM (SELECT t.*, z.*, x1-x0 AS dx, y1-y0 AS dy, (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS seg, (x0-x)*(x0-x)+(y0-y)*(y0-y) <= radius*radius AS a, (x1-x)*(x1-x)+(y1-y)*(y1-y) <= radius*radius AS b FROM {TRACKS} t CROSS JOIN {ZONES} z))))"""
SPATIAL_SUMMARY = f"SELECT code, count(*) AS events, {total(milli('score'), 'score_milli')} FROM {SPATIAL} GROUP BY code"
SPATIAL_EVENTS = f"SELECT track_id, zone_id, code, score FROM {SPATIAL} WHERE code > 0"
BEST_EVENTS = f"SELECT track_id, zone_id, code, score FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, zone_id) AS k FROM {SPATIAL} WHERE code > 0) WHERE k = 1"
TOP_EVENTS = f"SELECT track_id, zone_id, code, score FROM {SPATIAL} WHERE code > 0 ORDER BY score DESC, track_id, zone_id LIMIT 40"
BOX = f"""WITH p AS (SELECT x0 AS x, y0 AS y FROM {TRACKS} UNION ALL SELECT x1, y1 FROM {TRACKS} UNION ALL SELECT x - radius, y - radius FROM {ZONES} UNION ALL SELECT x + radius, y + radius FROM {ZONES}),
b AS (SELECT min(x)::DOUBLE AS a, max(x)::DOUBLE AS b, min(y)::DOUBLE AS c, max(y)::DOUBLE AS d FROM p)
SELECT a - (b - a) * 0.05e0 AS x_min, b + (b - a) * 0.05e0 AS x_max, c - (d - c) * 0.05e0 AS y_min, d + (d - c) * 0.05e0 AS y_max FROM b"""

CN_TASKS = f"(SELECT i AS task_id, R[(37*i+11)%2000]*0.5f AS x, R[(53*i+19)%2000]*0.5f AS y, (1 << I[i%8]) | (CASE WHEN i%5=0 THEN 1 << I[(i+3)%8] ELSE 0 END) AS need, I[1+(7*i)%8] AS demand, I[(13*i)%900] AS earliest, I[(13*i)%900+90+30*(i%6)] AS latest, I[i%8] AS zone, 0.15f+CAST(R[(29*i)%85]/100f AS FLOAT) AS risk FROM {ids('customer')})"
CN_RESOURCES = f"(SELECT i AS resource_id, R[(97*i+23)%2000]*0.5f AS x, R[(71*i+41)%2000]*0.5f AS y, (1 << I[i%8]) | (1 << I[(3*i+1)%8]) | (CASE WHEN i%4=0 THEN 1 << I[(i+5)%8] ELSE 0 END) AS mask, I[2+(5*i)%10] AS capacity, I[40*(i%6)] AS opens, I[1120+50*(i%5)] AS closes, (1 << I[(5*i+2)%8]) | (CASE WHEN i%9=0 THEN 1 << I[(i+3)%8] ELSE 0 END) AS forbid, 180f+R[i%7]*55f AS reach, 0.35f+CAST(R[(11*i)%65]/100f AS FLOAT) AS tolerance FROM {ids('supplier')})"
CANDIDATES = f"(SELECT i AS candidate_id, task_id, (53*i+3) % (SELECT count(*) FROM supplier) AS resource_id, I[(11*i+23*(i//17))%1300] AS start, I[20+(7*i+task_id)%100] AS duration FROM (SELECT i, (37*i+17) % (SELECT count(*) FROM customer) AS task_id FROM {ids('orders')}))"
CN = f"""(SELECT candidate_id, task_id, resource_id, start, duration, mask, 0f + (CASE WHEN mask & 1 <> 0 THEN 1200f ELSE 0f END) + (CASE WHEN mask & 2 <> 0 THEN 150f*R[demand-capacity] ELSE 0f END)
    + (CASE WHEN mask & 4 <> 0 THEN 3f*R[greatest(0, earliest-start)+greatest(0, finish-latest)] ELSE 0f END) + (CASE WHEN mask & 8 <> 0 THEN 2f*R[greatest(0, opens-start)+greatest(0, finish-closes)] ELSE 0f END)
    + (CASE WHEN mask & 16 <> 0 THEN 0.01f*(d2-reach*reach) ELSE 0f END) + (CASE WHEN mask & 32 <> 0 THEN 450f ELSE 0f END) + (CASE WHEN mask & 64 <> 0 THEN 700f*(risk-tolerance) ELSE 0f END) + (0.00025f*d2 + 0.05f*R[duration]) AS penalty
  FROM (SELECT *, {bits('(have & need) <> need', 'capacity < demand', 'start < earliest OR finish > latest', 'start < opens OR finish > closes', 'd2 > reach*reach', '(forbid & (1 << zone)) <> 0', 'risk > tolerance')} AS mask
    FROM (SELECT c.*, start + duration AS finish, t.need, t.demand, t.earliest, t.latest, t.zone, t.risk, r.mask AS have, r.capacity, r.opens, r.closes, r.forbid, r.reach, r.tolerance, {d2('t.', 'r.')} AS d2
      FROM {CANDIDATES} c JOIN {CN_TASKS} t USING (task_id) JOIN {CN_RESOURCES} r USING (resource_id))))"""
CN_ROWS = f"SELECT candidate_id, task_id, resource_id, start, duration, mask = 0 AS valid, CAST(bit_count(mask) AS INT) AS violations, mask, penalty FROM {CN}"
CN_NAMES = ("skill", "capacity", "task_window", "resource_window", "distance", "zone", "risk")
CN_SUMMARY = f"SELECT count(CASE WHEN mask = 0 THEN 1 END) AS valid_count, count(CASE WHEN mask <> 0 THEN 1 END) AS invalid_count, {total('bit_count(mask)', 'total_violations')}, {reasons(CN_NAMES)}, {total(milli('penalty::DOUBLE + 0.125e0*mask'), 'checksum_milli')} FROM {CN}"
OK = {
    "skill": "(r.mask & t.need) = t.need", "capacity": "r.capacity >= t.demand", "time_overlap": "greatest(t.earliest, r.opens) <= least(t.latest, r.closes)",
    "distance": f"{d2('t.', 'r.')} <= r.reach*r.reach", "zone": "(r.forbid & (1 << t.zone)) = 0", "risk": "t.risk <= r.tolerance",
}
PAIR_OK = " AND ".join(OK.values())
COMPATIBILITY = f"SELECT count(CASE WHEN {PAIR_OK} THEN 1 END) AS pairs_ok, {', '.join(f'avg(CASE WHEN {c} THEN 1 ELSE 0 END) AS {n}_fraction' for n, c in OK.items())} FROM {CN_TASKS} t CROSS JOIN {CN_RESOURCES} r"

AP_TASKS = f"(SELECT i AS task_id, R[(37*i+11)%4000]*0.25f AS x, R[(53*i+23)%4000]*0.25f AS y, (1 << I[i%8]) | (CASE WHEN i%7=0 THEN 1 << I[(i+3)%8] ELSE 0 END) AS need, I[1+i%5] AS demand, I[(13*i)%600] AS earliest, I[20+i%90] AS duration, I[(13*i)%600+20+i%90+120+(5*i)%220] AS latest, I[i%12] AS zone, 1f+CAST(R[(17*i)%100]/20f AS FLOAT) AS priority, CAST(R[(19*i)%100]/100f AS FLOAT) AS risk FROM {ids('customer')})"
AP_RESOURCES = f"(SELECT i AS resource_id, R[(31*i+7)%4000]*0.25f AS x, R[(47*i+29)%4000]*0.25f AS y, (1 << I[i%8]) | (1 << I[(i+2)%8]) | (1 << I[(i+5)%8]) | (CASE WHEN i%11=0 THEN 255 ELSE 0 END) AS have, I[2+i%7] AS capacity, I[(17*i)%500] AS opens, I[(17*i)%500+300+(13*i)%300] AS closes, (CASE WHEN i%5=0 THEN 1 << I[(i+1)%12] ELSE 0 END) | (CASE WHEN i%9=0 THEN 1 << I[(i+4)%12] ELSE 0 END) AS forbid, R[240+(7*i)%280] AS reach, 0.35f+CAST(R[(11*i)%65]/100f AS FLOAT) AS tolerance, CAST(R[(23*i)%100]/100f AS FLOAT) AS load FROM {ids('supplier')})"
AP = f"""(SELECT task_id, resource_id, mask, CASE WHEN mask = 0 THEN 0.035f*d2 + 40f*load + 75f*risk - 18f*priority + 0.1f*R[duration] END AS cost
  FROM (SELECT *, {bits('(have & need) <> need', 'capacity < demand', 'begins < opens OR begins + duration > closes OR begins + duration > latest', 'd2 > reach*reach', '(forbid & (1 << zone)) <> 0', 'risk > tolerance')} AS mask
    FROM (SELECT t.*, r.* EXCLUDE (x, y), {d2('t.', 'r.')} AS d2, earliest + I[trunc(17f*load)] AS begins FROM {AP_TASKS} t CROSS JOIN {AP_RESOURCES} r)))"""
AP_NAMES = ("skill", "capacity", "time", "distance", "zone", "risk")
AP_REASONS = f"SELECT count(CASE WHEN mask = 0 THEN 1 END) AS feasible, count(CASE WHEN mask <> 0 THEN 1 END) AS infeasible, {reasons(AP_NAMES)} FROM {AP}"
AP_RANKED = f"(SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY cost, resource_id) AS rank, resource_id, cost FROM {AP} WHERE mask = 0)"
AP_TOP = f"SELECT task_id, CAST(rank AS INT) AS rank, resource_id, cost FROM {AP_RANKED} WHERE rank <= 4"
AP_SUMMARY = f"""SELECT count(*) AS selected, count(CASE WHEN rank = 1 THEN 1 END) AS tasks_with_any, {total(f"{milli('cost')} * (task_id + 1) * (rank + 2)", 'checksum_milli')}, {total(f"CASE WHEN rank = 1 THEN {milli('cost')} END", 'best_cost_milli')},
  sum({milli('cost')})::DOUBLE / count(*) AS mean_cost_milli, count(*)::DOUBLE / (SELECT (SELECT count(*) FROM customer) * (SELECT count(*) FROM supplier)) AS reduction_ratio FROM {AP_RANKED} WHERE rank <= 4"""
AP_PADDED = f"SELECT t.i AS task_id, CAST(k.range AS INT) AS rank, coalesce(a.resource_id, -1) AS resource_id, coalesce(a.cost, 1e30::FLOAT) AS cost FROM {ids('customer')} t CROSS JOIN range(1, 5) k LEFT JOIN {AP_RANKED} a ON a.task_id = t.i AND a.rank = k.range"
AP_USAGE = f"SELECT resource_id, count(*) AS selected FROM {AP_RANKED} WHERE rank <= 4 GROUP BY resource_id"

LS_TASKS = f"(SELECT i AS task_id, R[(37*i+13)%4096]*0.2f AS x, R[(61*i+29)%4096]*0.2f AS y, (1 << I[i%8]) | (1 << I[(i+3)%8]) AS need, I[1+i%5] AS demand, 1f+CAST(R[(11*i)%100]/25f AS FLOAT) AS priority, CAST(R[(17*i+7)%100]/100f AS FLOAT) AS risk, (7*i+3) % (SELECT count(*) FROM supplier) AS old_resource FROM {ids('customer')})"
LS_RESOURCES = f"(SELECT i AS resource_id, R[(41*i+5)%4096]*0.2f AS x, R[(67*i+19)%4096]*0.2f AS y, (1 << I[i%8]) | (1 << I[(i+3)%8]) | (1 << I[(i+5)%8]) AS mask, I[2+i%7] AS capacity, R[110+(13*i)%240] AS reach, 0.25f+CAST(R[(23*i)%75]/100f AS FLOAT) AS tolerance, CAST(R[(31*i)%100]/100f AS FLOAT) AS load FROM {ids('supplier')})"
SOFT = "0.03f*{d} + 55f*{r}.load + 90f*t.risk - 20f*t.priority + 3f*R[t.demand]"
LS = f"""(SELECT *, new_cost - old_cost AS delta, mask = 0 AND new_cost - old_cost < CAST(-0.00001 AS FLOAT) AS improving
  FROM (SELECT m.move_id, m.task_id, t.old_resource, m.new_resource, {bits('(n.mask & t.need) <> t.need', 'n.capacity < t.demand', f"{d2('t.', 'n.')} > n.reach*n.reach", 't.risk > n.tolerance', 't.old_resource = m.new_resource')} AS mask,
    {SOFT.format(d=d2('t.', 'o.'), r='o')} AS old_cost, {SOFT.format(d=d2('t.', 'n.'), r='n')} AS new_cost
    FROM (SELECT i AS move_id, (37*i+11) % (SELECT count(*) FROM customer) AS task_id, (53*i+17+i//97) % (SELECT count(*) FROM supplier) AS new_resource FROM {ids('orders')}) m
    JOIN {LS_TASKS} t USING (task_id) JOIN {LS_RESOURCES} o ON o.resource_id = t.old_resource JOIN {LS_RESOURCES} n ON n.resource_id = m.new_resource))"""
LS_ROWS = f"SELECT move_id, task_id, old_resource, new_resource, mask = 0 AS valid, improving, mask, old_cost, new_cost, delta FROM {LS}"
LS_NAMES = ("skill", "capacity", "distance", "risk", "no_change")
LS_SUMMARY = f"""SELECT count(CASE WHEN mask = 0 THEN 1 END) AS valid_moves, count(CASE WHEN mask <> 0 THEN 1 END) AS invalid_moves, count(CASE WHEN improving THEN 1 END) AS improving_moves, {reasons(LS_NAMES)},
  coalesce((SELECT move_id FROM {LS} WHERE improving ORDER BY delta, move_id LIMIT 1), -1) AS best_move, coalesce(min(CASE WHEN improving THEN delta END)::DOUBLE, 0.0) AS best_delta,
  {total(f"{milli('delta')} * (move_id % 1021 + 1)", 'checksum_milli')}, {total(f"CASE WHEN mask = 0 THEN {milli('delta')} END", 'valid_delta_milli')} FROM {LS}"""

SC_TASKS = f"(SELECT i AS task_id, R[(37*i+11)%2048]*0.35f AS x, R[(59*i+23)%2048]*0.35f AS y, I[1+i%4] AS demand, 80f+R[(17*i)%180] AS base, 1f+CAST(R[(13*i)%100]/30f AS FLOAT) AS priority, 0.035f+CAST(R[(29*i+7)%70]/650f AS FLOAT) AS risk, 120f+R[(19*i)%90] AS latest FROM {ids('nation')})"
SC_RESOURCES = f"(SELECT i AS resource_id, R[(43*i+5)%2048]*0.35f AS x, R[(71*i+17)%2048]*0.35f AS y, I[7+i%8] AS capacity, 7f+CAST(R[(11*i)%55]/10f AS FLOAT) AS speed, 0.84f+CAST(R[(23*i)%15]/100f AS FLOAT) AS reliability, 0.28f+CAST(R[(31*i)%55]/100f AS FLOAT) AS tolerance, 20f+R[(7*i)%75] AS fixed FROM {ids('region')})"
PLAN = f"""(SELECT task_id, resource_id, demand, base, priority, risk, capacity, speed, reliability, tolerance, fixed, d2, greatest(latest, 25f+1.45f*CAST(CAST(sqrt(d2+1f) AS FLOAT)/(speed+0.001f) AS FLOAT)) AS latest
  FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY d2+15f*fixed + (CASE WHEN capacity >= demand+3 THEN 0f ELSE 1000000f END) + (CASE WHEN tolerance >= risk*1.4f THEN 0f ELSE 1000000f END), resource_id) AS k
    FROM (SELECT t.*, r.* EXCLUDE (x, y), {d2('t.', 'r.')} AS d2 FROM {SC_TASKS} t CROSS JOIN {SC_RESOURCES} r)) WHERE k = 1)"""
WORLDS = f"""(SELECT i AS scenario_id, CASE WHEN (17*i+5)%23=0 THEN (13*i+3) % (SELECT count(*) FROM region) END AS failed, CASE WHEN (19*i+7)%29=0 THEN (11*i+1) % (SELECT count(*) FROM nation) END AS spike,
  0.75f+CAST(R[(37*i+11)%60]/100f AS FLOAT)+(CASE WHEN (47*i+3)%17=0 THEN 0.65f ELSE 0f END) AS delay, 0.9f+CAST(R[(41*i+13)%55]/100f AS FLOAT) AS cost, 0.75f+CAST(R[(53*i+17)%60]/100f AS FLOAT)+(CASE WHEN (31*i+5)%19=0 THEN 0.55f ELSE 0f END) AS risk, CAST(R[(61*i+19)%100]/100f AS FLOAT) AS weather FROM {ids('orders')})"""
SC = f"""(SELECT scenario_id, any_value(failed) AS failed, any_value(spike) AS spike, any_value(delay) AS delay, any_value(cost) AS cost, any_value(risk) AS risk, any_value(weather) AS weather, CAST(bit_or(mask) AS INT) AS mask,
    CAST(sum(mask & 1) AS INT) AS failure_count, CAST(sum((mask >> 1) & 1) AS INT) AS capacity_count, CAST(sum((mask >> 2) & 1) AS INT) AS risk_count, CAST(sum((mask >> 3) & 1) AS INT) AS delay_count,
    list_reduce(list_prepend(any_value(weather)*120f, list(own ORDER BY task_id)), lambda a, b: a + b) AS score
  FROM (SELECT *, (base+fixed)*cost + 0.45f*travel + 140f*task_risk - 25f*priority + (CASE WHEN mask & 1 <> 0 THEN 2000f+100f*priority ELSE 0f END) + (CASE WHEN mask & 2 <> 0 THEN 350f*R[wanted-capacity] ELSE 0f END)
      + (CASE WHEN mask & 4 <> 0 THEN 500f*(task_risk-tolerance+0.05f) ELSE 0f END) + (CASE WHEN mask & 8 <> 0 THEN 40f*(travel-latest) ELSE 0f END) AS own
    FROM (SELECT *, {bits('coalesce(failed = resource_id, false) OR (reliability < 0.35f AND (task_id+resource_id+coalesce(failed, -1)+97)%17 = 0)', 'wanted > capacity', 'task_risk > tolerance', 'travel > latest')} AS mask
      FROM (SELECT s.*, p.* EXCLUDE (risk), CAST(CAST(sqrt(p.d2+1f) AS FLOAT)/(p.speed+0.001f) AS FLOAT)*s.delay AS travel, p.risk*s.risk AS task_risk, p.demand + (CASE WHEN s.spike = p.task_id THEN 3 ELSE 0 END) AS wanted FROM {WORLDS} s CROSS JOIN {PLAN} p))) GROUP BY scenario_id)"""
SC_ROWS = f"SELECT scenario_id, failed, spike, delay, cost, risk, weather, mask = 0 AS feasible, mask, failure_count + capacity_count + risk_count + delay_count AS violations, failure_count, capacity_count, risk_count, delay_count, score FROM {SC}"
SC_MEAN = f"(CAST(sum({milli('score')}) AS BIGINT) / count(*) / 1000.0e0)"
SC_SUMMARY = f"""SELECT count(CASE WHEN mask = 0 THEN 1 END) AS feasible_count, count(CASE WHEN mask <> 0 THEN 1 END) AS infeasible_count, {', '.join(f'count(CASE WHEN (mask & {1 << k}) <> 0 THEN 1 END) AS {n}_scenarios' for k, n in enumerate(('failure', 'capacity', 'risk', 'delay')))},
  {total('failure_count + capacity_count + risk_count + delay_count', 'total_violations')}, {SC_MEAN} AS mean_score, min(score)::DOUBLE AS best_score, max(score)::DOUBLE AS worst_score, {total(f"{milli('score')} * (scenario_id % 4093 + 1)", 'checksum_milli')},
  {SC_MEAN} + 0.25e0*max(score)::DOUBLE + 10000.0e0*(count(CASE WHEN mask <> 0 THEN 1 END) / count(*)) AS robustness FROM {SC}"""


def items(table: str) -> str:
    return f"(SELECT row_number() OVER (ORDER BY i) - 1 AS p, 20+(37*i+11)%180 AS value, 5+(19*i+7)%80 AS cost, 1+(23*i+3)%60 AS risk, (29*i+17)%1000 AS x, (43*i+31)%1000 AS y, (1 << I[(5*i+2)%6]) | (CASE WHEN i%11=0 THEN 1 << I[(i+3)%6] ELSE 0 END) | (CASE WHEN i%17=0 THEN 1 << I[(i+5)%6] ELSE 0 END) AS cover FROM {ids(table)})"


def combinations(table: str, k: int) -> str:
    """Ranks are positions in the ascending order of the members."""
    names = "abcd"[:k]
    joins = f"{items(table)} a" + "".join(f" JOIN {items(table)} {q} ON {p}.p < {q}.p" for p, q in zip(names, names[1:]))
    add = lambda c: " + ".join(f"{n}.{c}" for n in names)
    far = "greatest(0, {})".format(", ".join(d2(p + ".", q + ".") for i, p in enumerate(names) for q in names[i + 1 :]))
    return f"""WITH e AS (SELECT row_number() OVER (ORDER BY {', '.join(n + '.p' for n in names)}) - 1 AS rank, {add('value')} AS v, {add('cost')} AS c, {add('risk')} AS r, {' | '.join(n + '.cover' for n in names)} AS cover, {far} AS far FROM {joins}),
  m AS (SELECT rank, 100*v - 3*c - 7*r + 25*CAST(bit_count(cover) AS INT) + (CASE WHEN far <= 176400 THEN 50 ELSE 0 END) AS score, {bits(f'c > {55 * k}', f'r > {38 * k}', '(cover & 7) <> 7', 'far > 176400')} AS mask FROM e)
  SELECT count(CASE WHEN mask = 0 THEN 1 END) AS valid_count, count(CASE WHEN mask <> 0 THEN 1 END) AS invalid_count, {reasons(('budget', 'risk', 'coverage', 'spread'))}, CAST(coalesce(max(CASE WHEN mask = 0 THEN score END), 0) AS INT) AS best_score,
    coalesce((SELECT rank FROM m WHERE mask = 0 ORDER BY score DESC, rank LIMIT 1), -1) AS best_rank, {total('(rank + 1)*13 + mask*1000003 + score*97', 'checksum')} FROM m"""




# Graphs


def rows_of(table: str, name: str = "i") -> str:
    """0 .. n - 1 for a table of n rows."""
    return f"(SELECT unnest(range((SELECT count(*) FROM {table}))) AS {name})"


def drawn(table: str, degree: int, seed: int) -> str:
    """Edges of the random graph with a node for each row of a table: generator states in closed form, first distinct targets kept."""
    from quern.functions.scalars import lcg_steps

    steps = ", ".join(f"({k}, {a}, {c})" for k, (a, c) in enumerate(lcg_steps(4 * degree + 64)))
    return f"""(SELECT i AS src, t AS dst FROM (SELECT i, t, row_number() OVER (PARTITION BY i ORDER BY min(k)) AS o
  FROM (SELECT i, k, CAST(((a::HUGEINT * st + c) % 4294967296) % (SELECT count(*) FROM {table}) AS BIGINT) AS t
    FROM (SELECT i, xor({seed}, (2654435769 * (i + 1)) & 4294967295) AS st FROM {rows_of(table)}), (VALUES {steps}) j(k, a, c)) WHERE t <> i GROUP BY i, t) WHERE o <= {degree})"""


def weighted(edges: str) -> str:
    return f"""(SELECT edge_index, src, dst, 1 + xor(xor((src*1315423911) & 4294967295, (dst*2654435761) & 4294967295), (edge_index*97) & 4294967295) % 31 AS weight
  FROM (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge_index FROM {edges}))"""


def reached(edges: str, depth: str = "depth") -> str:
    """Depths from node 0 of all nodes reached."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {edges}), r(node, depth) USING KEY (node) AS (SELECT 0::BIGINT, 0::BIGINT UNION
  (SELECT DISTINCT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node LEFT JOIN recurring.r AS old ON old.node = e.dst WHERE old.node IS NULL)) SELECT node, {depth} FROM r"""


def nearest(edges: str) -> str:
    """Least distances from node 0."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, weight FROM {edges}), r(node, distance) USING KEY (node) AS (SELECT 0::BIGINT, 0::BIGINT UNION
  (SELECT e.dst, min(r.distance + e.weight) FROM r JOIN e ON e.src = r.node LEFT JOIN recurring.r AS old ON old.node = e.dst GROUP BY e.dst HAVING min(r.distance + e.weight) < coalesce(min(old.distance), 1000000000000))) SELECT node, distance FROM r"""


def labelled(edges: str) -> str:
    """Each node's smallest reachable node."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {edges}), r(node, label) USING KEY (node) AS (SELECT src, src FROM e GROUP BY src UNION
  (SELECT e.dst, min(r.label) FROM r JOIN e ON e.src = r.node JOIN recurring.r AS old ON old.node = e.dst GROUP BY e.dst HAVING min(r.label) < min(old.label))) SELECT node, label FROM r"""


PART_SUPPLIER = "(WITH p AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem) SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p)"
LAYERED = f"(SELECT src, (l + 1) * w + (p + l + k) % w AS dst FROM (SELECT l * w + p AS src, l, p, w, k FROM range(7) a(l), {rows_of('supplier', 'p')}, range(4) b(k), (SELECT count(*) AS w FROM supplier)))"
HISTOGRAM = f"WITH d AS (SELECT degree, count(*) AS nodes FROM (SELECT src, count(*) AS degree FROM {PART_SUPPLIER} GROUP BY src) GROUP BY degree) SELECT r.degree, coalesce(d.nodes, 0) AS nodes FROM (SELECT unnest(range((SELECT max(degree) + 1 FROM d))) AS degree) r LEFT JOIN d USING (degree)"
GRID_DEPTHS = f"SELECT y * 25 + x AS node, x + y AS depth FROM range(25) a(x), {rows_of('supplier', 'y')}"
MIXED = f"""(SELECT DISTINCT src, dst FROM (SELECT unnest([{{'a': v, 'b': x}}, {{'a': x, 'b': v}}]) AS e FROM (
    SELECT v, v + 1 AS x FROM n WHERE c % 3 = 0 AND p + 1 < own UNION ALL SELECT v - p, v FROM n WHERE c % 3 = 1 AND p > 0 AND p < own
    UNION ALL SELECT v, v - p + (p + 1) % own FROM n WHERE c % 3 = 2 AND p < own UNION ALL SELECT v, v + 2 FROM n WHERE c % 3 = 2 AND p + 2 < own) WHERE v <> x) q(e), (SELECT 1), LATERAL (SELECT e.a AS src, e.b AS dst))"""
MIXED_NODES = f"n AS (SELECT v, v // s AS c, v % s AS p, greatest(1, s - (v // s) % 5) AS own FROM (SELECT c.r * s + p.i AS v, s FROM range(5) c(r), {rows_of('supplier')} p, (SELECT count(*) AS s FROM supplier)))"
MIXED_EDGES = f"WITH {MIXED_NODES} SELECT src, dst FROM {MIXED}"
MIXED_LABELS = f"WITH {MIXED_NODES} SELECT v AS node, CASE WHEN p < own THEN v - p ELSE v END AS label FROM n"
DEGREE_STATS = f"SELECT count(*) AS node_count, CAST(sum(degree) AS BIGINT) AS edge_count, min(degree) AS min_out_degree, max(degree) AS max_out_degree, avg(degree) AS mean_out_degree, count(CASE WHEN degree = 0 THEN 1 END) AS zero_out_degree_count FROM (SELECT n.i, count(e.src) AS degree FROM (SELECT unnest(range(8 * (SELECT count(*) FROM supplier))) AS i) n LEFT JOIN {LAYERED} e ON e.src = n.i GROUP BY n.i)"


def profile(edges: str, nodes: str) -> str:
    return f"""WITH d AS ({reached(edges)}), o AS (SELECT d.node, d.depth, count(e.src) AS degree FROM d LEFT JOIN {edges} e ON e.src = d.node GROUP BY ALL),
  l AS (SELECT depth, count(*) AS size, sum(degree) AS visits FROM o GROUP BY depth)
  SELECT CAST(sum(size) AS BIGINT) AS reached_count, max(depth) AS max_distance, count(*) AS frontier_level_count, max(size) AS max_frontier_size, CAST(sum(visits) AS BIGINT) AS reached_edge_visits, CAST(max(visits) AS BIGINT) AS max_frontier_edge_visits,
    avg(size) AS mean_frontier_size, avg(visits) AS mean_frontier_edge_visits, sum(visits)::DOUBLE / sum(size)::DOUBLE AS mean_reached_out_degree, CASE WHEN max(depth) > 0 THEN max(size)::DOUBLE / max(depth) ELSE 0 END AS frontier_width_to_depth,
    (SELECT CAST(sum(coalesce(d.depth, -1) * (n.i + 1)) AS BIGINT) FROM {nodes} n LEFT JOIN d ON d.node = n.i) AS checksum FROM l"""


# Compressed rows, paths and histograms over given tables


def ends(edges: str) -> str:
    return f"(SELECT DISTINCT src AS i FROM {edges})"


def path_stats(edges: str) -> str:
    return f"""SELECT count(distance) AS reached_count, coalesce(max(distance), 0) AS max_finite_distance, CAST(sum(coalesce(distance, -1) * (i + 1)) AS BIGINT) AS checksum
  FROM {ends(edges)} n LEFT JOIN ({nearest(edges)}) d ON d.node = n.i"""


RANKED = "(SELECT DISTINCT l_partkey AS src, l_suppkey + (SELECT count(*) FROM part) AS dst FROM lineitem)"
CSR_OFFSETS = f"SELECT n.i AS node, CAST(count(e.src) AS BIGINT) AS \"offset\" FROM (SELECT unnest(range((SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + 1)) AS i) n LEFT JOIN {RANKED} e ON e.src < n.i GROUP BY n.i"
CSR_EDGES = f"SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_index, src, dst FROM {RANKED}"
CSR_DEGREES = "SELECT l_partkey AS node, count(*) AS degree FROM lineitem GROUP BY 1"
COMPONENT_INDEX = f"SELECT node, label, dense_rank() OVER (ORDER BY label) - 1 AS component_index FROM ({labelled(PART_SUPPLIER)})"


def binned(rows: str, x: str, where: str = "true", bins: int = 40) -> str:
    return f"""WITH v AS (SELECT CAST({x} AS DOUBLE) AS x FROM ({rows}) WHERE {where}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
  SELECT CAST(b AS INT) AS bin, count(x) AS n FROM (SELECT unnest(range({bins})) AS b) LEFT JOIN (SELECT x, least({bins - 1}, coalesce(floor((x - lo) / nullif(hi - lo, 0) * {bins}), 0)) AS k FROM v, e) ON k = b GROUP BY b"""


MOVE_HISTOGRAM = binned(LS_ROWS, "delta", "valid")
SCORE_HISTOGRAM = binned(SC_ROWS, "score")
