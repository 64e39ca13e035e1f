"""The sample parking tables as DuckDB views, written apart from the Spark code."""

# Cost in whole cents; a half cent rounds down when minutes % 3 = 2 (see lotline.functions.money).
COST = """
CASE WHEN {exit} IS NULL OR {price} IS NULL THEN NULL ELSE
  CAST((({minutes}) * CAST({price} * 100 AS BIGINT) + 30) // 60
       - CASE WHEN (({minutes}) * CAST({price} * 100 AS BIGINT)) % 60 = 30
               AND ({minutes}) % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) END
"""


def minutes(entry: str, exit_: str, free: str) -> str:
    return (f"greatest(0, CAST(floor((epoch_us({exit_}) - epoch_us({entry}) + 30000000)"
            f" / 60000000) AS BIGINT) - {free})")


def cents(entry: str, exit_: str, price: str, free: str) -> str:
    return COST.format(exit=exit_, price=price, minutes=minutes(entry, exit_, free))


def money(cents_sql: str) -> str:
    return f"CAST(({cents_sql}) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2))"


VIEWS: dict[str, str] = {
    "users": """
        SELECT c_custkey AS id, concat('+7', c_custkey + 9000000000) AS phone,
               CASE WHEN c_custkey % 10 >= 3 THEN concat('user', c_custkey, '@example.com') END AS email,
               'not-a-hash' AS password_hash, TIMESTAMP '2023-12-01 00:00:00' AS created_at,
               c_custkey % 20 = 0 AS is_blocked
        FROM customer""",
    "wallets": """
        SELECT c_custkey AS id, c_custkey AS user_id,
               CAST(c_acctbal AS DECIMAL(12,2)) AS balance, 'RUB' AS currency,
               TIMESTAMP '2023-12-01 00:00:00' AS updated_at
        FROM customer WHERE c_custkey % 50 <> 7""",
    "cars": """
        SELECT c_custkey * 3 + n AS id, c_custkey AS user_id, concat('P', c_custkey * 3 + n) AS plate_number,
               concat('Model ', (c_custkey * 3 + n) % 7) AS model,
               (c_custkey * 3 + n) % 10 <> 0 AS is_active,
               TIMESTAMP '2023-12-01 00:00:00' AS created_at
        FROM customer, (VALUES (0), (1), (2)) v(n)""",
    "parking_zones": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(NULL AS VARCHAR) AS description
        FROM region""",
    "parking_spots": """
        SELECT s_suppkey AS id, CAST(n_regionkey AS BIGINT) AS zone_id,
               concat('SP-', s_suppkey) AS spot_number,
               s_suppkey % 10 = 0 AS is_reserved, s_suppkey % 20 <> 0 AS is_active
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "access_levels": """
        SELECT CAST(id AS BIGINT) AS id, code, CAST(NULL AS VARCHAR) AS description
        FROM (VALUES (0, 'RESIDENT'), (1, 'EMPLOYEE'), (2, 'GUEST'), (3, 'VIP')) v(id, code)""",
    "user_access_levels": """
        SELECT user_id * 4 + access_level_id AS id, user_id, access_level_id,
               TIMESTAMP '2023-12-01 00:00:00' AS granted_at
        FROM (SELECT c_custkey AS user_id, c_custkey % 4 AS access_level_id
              FROM customer WHERE c_custkey % 10 < 3
              UNION ALL
              SELECT c_custkey, (c_custkey + 1) % 4 FROM customer WHERE c_custkey % 10 = 0) g""",
    "tariffs": """
        SELECT CAST(id AS BIGINT) AS id, name, CAST(price AS DECIMAL(10,2)) AS price_per_hour,
               CAST(free AS INTEGER) AS free_minutes, CAST(zone AS BIGINT) AS zone_id,
               CAST(level AS BIGINT) AS access_level_id
        FROM (VALUES (0, 'Standard', 100, 15, NULL, NULL), (1, 'Resident', 50, 30, NULL, 0),
                     (2, 'Employee', 30, 60, NULL, 1), (3, 'VIP', 200, 60, 3, 3))
             v(id, name, price, free, zone, level)""",
    "gates": """
        SELECT CAST(id AS BIGINT) AS id, name, type
        FROM (VALUES (0, 'Gate IN 1', 'entry'), (1, 'Gate IN 2', 'entry'),
                     (2, 'Gate OUT 1', 'exit'), (3, 'Gate OUT 2', 'exit')) v(id, name, type)""",
    "parking_sessions": f"""
        SELECT id, car_id, spot_id, tariff_id, entry_time, exit_time,
               {money(cents("entry_time", "exit_time", "price_per_hour", "free_minutes"))} AS total_cost,
               status
        FROM (SELECT event_id AS id, user_id * 3 + event_id % 3 AS car_id,
                     CASE WHEN event_id % 10 >= 3
                          THEN (event_id * 7) % (SELECT count(*) FROM supplier) END AS spot_id,
                     event_id % 4 AS tariff_id, ts AS entry_time,
                     CASE WHEN event_type NOT IN ('signup', 'error')
                          THEN ts + to_seconds(CAST(round(value * 600) AS BIGINT)) END AS exit_time,
                     CASE event_type WHEN 'signup' THEN 'active' WHEN 'error' THEN 'failed'
                          ELSE 'completed' END AS status
              FROM events) e
        JOIN (SELECT id AS tid, price_per_hour, free_minutes FROM tariffs) t ON t.tid = e.tariff_id""",
    "entry_logs": """
        SELECT event_id AS id, concat('P', user_id * 3 + event_id % 3) AS plate_number,
               event_id % 2 AS gate_id, ts AS attempt_time,
               CASE WHEN event_type = 'error' THEN 'denied' ELSE 'allowed' END AS result,
               CASE WHEN event_type = 'error' THEN
                    CASE event_id % 3 WHEN 0 THEN 'Insufficient balance'
                                      WHEN 1 THEN 'User is blocked' END END AS reason
        FROM events""",
    "wallet_transactions": """
        SELECT id * 3 AS id, car_id // 3 AS wallet_id, id AS session_id,
               CAST(-total_cost AS DECIMAL(12,2)) AS amount, 'parking_charge' AS operation_type,
               exit_time AS created_at, concat('Parking session ', id) AS comment
        FROM parking_sessions WHERE status = 'completed'
        UNION ALL
        SELECT event_id * 3 + 1, user_id, NULL, CAST(value AS DECIMAL(12,2)), 'topup', ts, NULL
        FROM events WHERE event_type = 'purchase'
        UNION ALL
        SELECT event_id * 3 + 2, user_id, NULL, -CAST(value AS DECIMAL(12,2)), 'adjustment', ts, NULL
        FROM events WHERE event_type = 'signup' AND event_id % 5 = 0""",
    "audit_logs": """
        SELECT event_id AS id, user_id, ['cars', 'tariffs', 'wallet'][event_id % 3 + 1] AS entity_type,
               user_id AS entity_id, ['create', 'update', 'delete'][event_id % 3 + 1] AS action,
               props AS details, ts AS created_at
        FROM events""",
}

NEEDS = {"parking_sessions": ("tariffs",), "wallet_transactions": ("parking_sessions",)}


def over(tables: str, query: str, recursive: bool = False, more: str = "") -> str:
    """``query`` over the named sample views, with their own inputs first."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in tables.split():
        add(name)
    views = [f"{name} AS ({VIEWS[name]})" for name in wanted]
    if more:
        views.append(more.strip())
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(views) + "\n" + query
