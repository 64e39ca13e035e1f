"""DuckDB SQL of the rules and batch jobs."""

from oracle_reports import REPORTS
from oracle_views import cents, minutes, money, over

ATTEMPTS = """attempts AS (
    SELECT event_id AS id, concat('P', user_id * 3 + event_id % 3) AS plate_number,
           event_id % 5 AS gate_id, ts AS attempt_time FROM events)"""

UUID = ("concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12))")

PROFILED = """
    SELECT a.id, a.plate_number, a.gate_id, a.attempt_time, c.id AS car_id, c.user_id,
           u.is_blocked, w.id AS wallet_id, {balance} AS balance
    FROM attempts a JOIN gates g ON g.id = a.gate_id AND g.type = 'entry'
    LEFT JOIN cars c ON c.plate_number = a.plate_number AND c.is_active
    LEFT JOIN users u ON u.id = c.user_id LEFT JOIN wallets w ON w.user_id = c.user_id"""

DECISION = """
    SELECT id, plate_number, gate_id, attempt_time, reason = 'Entry allowed' AS allowed, reason,
           car_id, user_id, CASE WHEN seen THEN wallet_id END AS wallet_id,
           CASE WHEN seen THEN CAST(balance AS DOUBLE) END AS balance
    FROM (SELECT *, car_id IS NOT NULL AND NOT coalesce(is_blocked, FALSE) AND wallet_id IS NOT NULL AS seen,
                 CASE WHEN car_id IS NULL THEN 'Car not found or inactive'
                      WHEN is_blocked THEN 'User is blocked'
                      WHEN wallet_id IS NULL THEN 'Wallet not found'
                      WHEN balance < 50 THEN concat('Insufficient balance: ',
                           CAST(CAST(balance AS DECIMAL(12,2)) AS VARCHAR), ' (minimum: 50.00)')
                      ELSE 'Entry allowed' END AS reason
          FROM profiled) p"""
ENTRY_TABLES = "gates cars users wallets"


def decided(balance: str, final: str, more: str = "") -> str:
    return (f"{ATTEMPTS}, profiled AS ({PROFILED.format(balance=balance)}), "
            f"decisions AS ({DECISION}){more}")


THEN = """w.balance + coalesce((SELECT sum(t.amount) FROM wallet_transactions t
          WHERE t.wallet_id = w.id AND t.created_at <= a.attempt_time), 0)"""

# Best tariff by class: level and zone, level, zone, all; cheapest first, then lowest key.
TARIFF_PICK = """
    SELECT r.id, r.user_id, r.zone_id, t.id AS tariff_id,
           CASE WHEN t.access_level_id IS NOT NULL AND t.zone_id IS NOT NULL THEN 'level and zone'
                WHEN t.access_level_id IS NOT NULL THEN 'level'
                WHEN t.zone_id IS NOT NULL THEN 'zone' WHEN t.id IS NOT NULL THEN 'all' END AS matched_by
    FROM requests r LEFT JOIN tariffs t
      ON (t.zone_id IS NULL OR t.zone_id = r.zone_id)
     AND (t.access_level_id IS NULL OR EXISTS (SELECT 1 FROM user_access_levels g
          WHERE g.user_id = r.user_id AND g.access_level_id = t.access_level_id))
    QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY
        CASE WHEN t.access_level_id IS NOT NULL THEN 0 ELSE 2 END
        + CASE WHEN t.zone_id IS NOT NULL THEN 0 ELSE 1 END, t.price_per_hour, t.id) = 1"""

# One exit after the other per user: room left in cents, cars whose latest session was closed.
SETTLE = f"""
exits AS (
    SELECT e.event_id AS id, e.user_id * 3 + e.event_id % 3 AS car_id, e.user_id,
           e.ts + INTERVAL 2 DAY AS exit_time,
           row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS step
    FROM events e),
stack AS (
    SELECT s.id, s.car_id, s.entry_time, t.price_per_hour AS price, t.free_minutes AS free,
           row_number() OVER (PARTITION BY s.car_id ORDER BY s.entry_time DESC, s.id DESC) AS depth
    FROM parking_sessions s JOIN tariffs t ON t.id = s.tariff_id WHERE s.status = 'active'),
start AS (
    SELECT DISTINCT x.user_id, w.id AS wallet_id,
           CAST((w.balance + 1000) * 100 AS BIGINT) AS room
    FROM exits x LEFT JOIN wallets w ON w.user_id = x.user_id),
played AS (
    SELECT user_id, wallet_id, room, CAST([] AS BIGINT[]) AS closed, CAST(0 AS BIGINT) AS step,
           CAST(NULL AS BIGINT) AS exit_id, CAST(NULL AS BIGINT) AS car_id,
           CAST(NULL AS BIGINT) AS session_id, CAST(NULL AS BIGINT) AS charge,
           CAST(NULL AS TIMESTAMP) AS exit_time, CAST(NULL AS VARCHAR) AS outcome
    FROM start
    UNION ALL
    SELECT user_id, wallet_id, CASE WHEN outcome = 'ok' THEN room - charge ELSE room END,
           CASE WHEN outcome = 'ok' THEN list_append(closed, car_id) ELSE closed END,
           step, exit_id, car_id, session_id, charge, exit_time, outcome
    FROM (SELECT q.*, CASE WHEN session_id IS NULL THEN 'none' WHEN exit_time < entry_time THEN 'early'
                           WHEN wallet_id IS NULL THEN 'wallet' WHEN charge > room THEN 'floor'
                           ELSE 'ok' END AS outcome
          FROM (SELECT p.user_id, p.wallet_id, p.room, p.closed, x.step, x.id AS exit_id, x.car_id,
                       s.id AS session_id, s.entry_time, x.exit_time,
                       {cents("s.entry_time", "x.exit_time", "s.price", "s.free")} AS charge
                FROM played p JOIN exits x ON x.user_id = p.user_id AND x.step = p.step + 1
                LEFT JOIN stack s ON s.car_id = x.car_id
                 AND s.depth = len([c FOR c IN p.closed IF c = x.car_id]) + 1) q) o)"""

OUTCOME_TEXT = """CASE outcome
    WHEN 'ok' THEN concat('Exit processed. Cost: ', CAST(CAST(charge * 0.01 AS DECIMAL(12,2)) AS VARCHAR),
         ', New balance: ', CAST(CAST(room * 0.01 - 1000 AS DECIMAL(12,2)) AS VARCHAR))
    WHEN 'none' THEN 'No active session found'
    WHEN 'early' THEN 'Error processing exit: new row for relation "parking_sessions" violates check constraint "exit_after_entry"'
    WHEN 'wallet' THEN 'Error processing exit: null value in column "wallet_id" of relation "wallet_transactions" violates not-null constraint'
    ELSE 'Error processing exit: new row for relation "wallets" violates check constraint "balance_check"' END"""
SETTLE_TABLES = "wallets tariffs parking_sessions"

TOPUPS = """topups AS (
    SELECT event_id AS id, user_id, CAST(CAST(value AS DECIMAL(12,2)) - 20 AS DECIMAL(12,2)) AS amount,
           ts AS created_at, CASE WHEN event_id % 2 = 0 THEN concat('note ', event_id % 7) END AS comment
    FROM events),
posted AS (SELECT t.*, w.id AS wallet_id, w.balance AS opening FROM topups t
           JOIN wallets w ON w.user_id = t.user_id WHERE t.amount > 0)"""

# First come, first served: an entry is taken if none of its keys is held by one taken before it.
IMPORT = """
requests AS (
    SELECT c_custkey % 10 AS request_no, c_custkey // 10 AS user_no, c_custkey % 10 = 9 AS dry_run,
           concat('+8', 1000000 + c_custkey * 3 % 1201) AS phone,
           CASE WHEN c_custkey % 6 = 0 THEN concat('user', c_custkey * 13 % 3001, '@example.com') END AS email,
           [x FOR x IN [CASE WHEN c_custkey % 3 <> 0 THEN concat('N', c_custkey * 5 % 1999) END,
                        CASE WHEN c_custkey % 4 = 1 THEN concat('P', c_custkey * 11 % 40009) END]
            IF x IS NOT NULL] AS plates
    FROM customer),
judged AS (
    SELECT r.*, CASE WHEN r.phone IN (SELECT phone FROM users) THEN 'phone already exists'
                     WHEN r.email IN (SELECT email FROM users WHERE email IS NOT NULL) THEN 'email already exists'
                     WHEN EXISTS (SELECT 1 FROM cars c WHERE list_contains(r.plates, c.plate_number))
                       THEN 'plate_number already exists' END AS problem
    FROM requests r),
ordered AS (
    SELECT *, row_number() OVER (ORDER BY request_no, user_no) AS n,
           list_concat([phone], plates, CASE WHEN email IS NULL THEN [] ELSE [email] END) AS keys
    FROM judged WHERE problem IS NULL AND NOT dry_run),
walk AS (
    SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS held, FALSE AS taken
    UNION ALL
    SELECT o.n, CASE WHEN list_has_any(w.held, o.keys) THEN w.held ELSE list_concat(w.held, o.keys) END,
           NOT list_has_any(w.held, o.keys)
    FROM walk w JOIN ordered o ON o.n = w.n + 1),
taken AS (SELECT o.* FROM ordered o JOIN walk w ON w.n = o.n AND w.taken),
final AS (
    SELECT j.*, coalesce(j.problem, CASE WHEN NOT j.dry_run AND t.n IS NULL
                                         THEN 'repeats an earlier entry' END) AS verdict
    FROM judged j LEFT JOIN taken t ON t.request_no = j.request_no AND t.user_no = j.user_no)"""

NEW_CARS = """batch AS (
    SELECT o_orderkey + 1000000000 AS id, o_custkey AS user_id,
           concat('P', o_orderkey * 7 % 50021) AS plate_number,
           CASE WHEN o_orderkey % 2 = 0 THEN 'Model X' END AS model FROM orders),
judged AS (
    SELECT b.*, CASE WHEN plate_number IN (SELECT plate_number FROM cars) THEN 'plate_number already exists'
                     WHEN row_number() OVER (PARTITION BY plate_number ORDER BY id) > 1
                     THEN 'repeats an earlier row of the batch' END AS error FROM batch b)"""

PATCHED = """patches AS (
    SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 END AS zone_id,
           CASE WHEN s_suppkey % 4 <> 0 THEN concat('SP-', s_suppkey // 2) END AS spot_number,
           CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 = 0 END AS is_active FROM supplier),
wanted AS (
    SELECT s.id, s.is_reserved, coalesce(p.zone_id, s.zone_id) AS zone_id,
           coalesce(p.spot_number, s.spot_number) AS spot_number,
           coalesce(p.is_active, s.is_active) AS is_active,
           (coalesce(p.zone_id, s.zone_id), coalesce(p.spot_number, s.spot_number))
             IS DISTINCT FROM (s.zone_id, s.spot_number) AS moved
    FROM parking_spots s JOIN patches p ON p.id = s.id),
probed AS (
    SELECT w.*, moved AND EXISTS (SELECT 1 FROM parking_spots o WHERE o.zone_id = w.zone_id
                                  AND o.spot_number = w.spot_number) AS held FROM wanted w),
judged AS (
    SELECT p.*, NOT held AND moved AND row_number() OVER (
               PARTITION BY zone_id, spot_number, held, moved ORDER BY id) > 1 AS repeated FROM probed p)"""

USER_DELETE = """asked AS (SELECT id FROM users WHERE id % 3 = 0),
verdicts AS (SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM cars c JOIN parking_sessions s ON s.car_id = c.id
                                            WHERE c.user_id = a.id)
                               THEN 'still referenced by parking_sessions' END AS error FROM asked a)"""

DIRTY = """dirty AS (
    SELECT c_custkey AS id,
           CASE WHEN c_custkey % 5 = 0 THEN '0123' WHEN c_custkey % 7 = 0 THEN NULL
                WHEN c_custkey % 11 = 0 THEN concat('+7', repeat('1', 20))
                ELSE concat('+7', c_custkey + 9000000000) END AS phone,
           CASE WHEN c_custkey % 3 = 0 THEN 'nobody' WHEN c_custkey % 4 = 0 THEN 'a@b'
                WHEN c_custkey % 4 = 1 THEN concat('u', c_custkey, '@example.com') END AS email,
           CASE WHEN c_custkey % 13 <> 0 THEN 'hash' END AS password_hash
    FROM customer)"""

# Per table: required columns, longest texts, other row rules, unique keys, references.
CHECKS = {
    "users": ("id phone password_hash created_at is_blocked", {"phone": 20, "email": 255, "password_hash": 255},
              {"phone format": r"NOT regexp_matches(phone, '^\+?[1-9][0-9]{1,14}$')",
               "email format": r"NOT regexp_matches(email, '^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$')"}, ["id", "phone", "email"], {}),
    "wallets": ("id user_id balance currency updated_at", {"currency": 3}, {"balance below -1000.00": "balance < -1000"},
                ["id", "user_id"], {"user_id": "users"}),
    "cars": ("id user_id plate_number is_active created_at", {"plate_number": 20, "model": 255}, {}, ["id", "plate_number"],
             {"user_id": "users"}),
    "access_levels": ("id code", {"code": 50}, {}, ["id", "code"], {}),
    "user_access_levels": ("id user_id access_level_id granted_at", {}, {}, ["id", "user_id, access_level_id"],
                           {"user_id": "users", "access_level_id": "access_levels"}),
    "parking_zones": ("id name", {"name": 255}, {}, ["id"], {}),
    "parking_spots": ("id zone_id spot_number is_reserved is_active", {"spot_number": 50}, {}, ["id", "zone_id, spot_number"],
                      {"zone_id": "parking_zones"}),
    "tariffs": ("id name price_per_hour free_minutes", {"name": 255},
                {"price_per_hour below 0": "price_per_hour < 0", "free_minutes below 0": "free_minutes < 0"}, ["id", "name"],
                {"zone_id": "parking_zones", "access_level_id": "access_levels"}),
    "gates": ("id name type", {"name": 255, "type": 10}, {"type not in domain": "type NOT IN ('entry', 'exit')"}, ["id"], {}),
    "parking_sessions": ("id car_id tariff_id entry_time status", {"status": 20},
                         {"status not in domain": "status NOT IN ('active', 'completed', 'failed')",
                          "exit_time before entry_time": "exit_time < entry_time"}, ["id"],
                         {"car_id": "cars", "spot_id": "parking_spots", "tariff_id": "tariffs"}),
    "wallet_transactions": ("id wallet_id amount operation_type created_at", {"operation_type": 20},
                            {"operation_type not in domain": "operation_type NOT IN ('topup', 'parking_charge', 'adjustment')"},
                            ["id"], {"wallet_id": "wallets", "session_id": "parking_sessions"}),
    "entry_logs": ("id plate_number gate_id attempt_time result", {"plate_number": 20, "result": 10},
                   {"result not in domain": "result NOT IN ('allowed', 'denied')"}, ["id"], {"gate_id": "gates"}),
    "audit_logs": ("id entity_type action created_at", {"entity_type": 50, "action": 20},
                   {"action not in domain": "action NOT IN ('create', 'update', 'delete')"}, ["id"], {"user_id": "users"}),
}


def quality_sql() -> str:
    parts = []
    for table, (required, lengths, others, unique, references) in CHECKS.items():
        rules = {f"{c} required": f"{c} IS NULL" for c in required.split()}
        rules |= {f"{c} longer than {n}": f"length({c}) > {n}" for c, n in lengths.items()} | others
        for rule, broken in rules.items():
            parts.append(f"SELECT '{table}' AS \"table\", 'row' AS kind, '{rule}' AS rule, "
                         f"count(*) FILTER (WHERE {broken}) AS rows FROM {table}")
        for keys in unique:
            whole = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
            parts.append(f"SELECT '{table}', 'unique', '{keys}', CAST(coalesce(sum(n), 0) AS BIGINT) FROM "
                         f"(SELECT count(*) AS n FROM {table} WHERE {whole} GROUP BY {keys} HAVING count(*) > 1) d")
        for column, parent in references.items():
            parts.append(f"SELECT '{table}', 'reference', '{column} -> {parent}', count(*) FROM {table} x "
                         f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {parent})")
    return over(" ".join(CHECKS), "\nUNION ALL\n".join(parts))


EXIT_REQUESTS = """asked AS (
    SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN concat('P', user_id * 3 + event_id % 3)
                                ELSE 'none' END AS plate_number,
           event_id % 5 AS gate_id, ts AS exit_time FROM events),
checked AS (
    SELECT a.*, c.id AS car_id,
           CASE WHEN g.id IS NULL THEN 'Gate not found' WHEN g.type <> 'exit' THEN 'Gate is not an exit gate'
                WHEN c.id IS NULL THEN 'Car not found' END AS error
    FROM asked a LEFT JOIN gates g ON g.id = a.gate_id LEFT JOIN cars c ON c.plate_number = a.plate_number)"""

CAR_PATCHES = """asked AS (
    SELECT c_custkey * 3 AS id, c_custkey % 5 <> 0 AS mine,
           concat(CASE WHEN c_custkey * 3 % 2 = 0 THEN 'Q' ELSE 'P' END, c_custkey * 3) AS plate,
           CASE WHEN c_custkey * 3 % 4 <> 0 THEN 'Model Y' END AS new_model FROM customer),
patched AS (
    SELECT cars.id, user_id, CASE WHEN mine THEN plate ELSE plate_number END AS plate_number,
           CASE WHEN mine THEN new_model ELSE model END AS model, coalesce(mine, false) AS done
    FROM cars LEFT JOIN asked ON asked.id = cars.id)"""


def audit_of(action: str, rows: str) -> str:
    """Audit rows of cars with their plate and model as details."""
    return f"""
SELECT {UUID} AS id, user_id, 'car' AS entity_type, car AS entity_id, '{action}' AS action, details,
       TIMESTAMP '2024-02-10 00:00:00' AS created_at
FROM (SELECT user_id, id AS car, CAST(to_json(struct_pack(plate_number := plate_number, model := model)) AS VARCHAR) AS details,
             md5(concat('audit|car|{action}|', id, '|2024-02-10 00:00:00')) AS h FROM {rows}) x"""


JOBS = {
    "A2_rows_of_keys": over("parking_sessions cars", """
SELECT id, car_id, spot_id, tariff_id, entry_time, exit_time, CAST(total_cost AS DOUBLE) AS total_cost, status
FROM parking_sessions WHERE car_id IN (SELECT id FROM cars WHERE NOT is_active)"""),
    "A4_occupancy_view": REPORTS["V1_parking_occupancy"],
    "A4_revenue_view": over("parking_sessions", """
SELECT CAST(CAST(entry_time AS DATE) AS VARCHAR) AS date, CAST(sum(total_cost) AS DOUBLE) AS revenue
FROM parking_sessions WHERE status = 'completed'
  AND CAST(entry_time AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-25' GROUP BY 1"""),
    "A8_revenue_of_stored_tables": REPORTS["Q04_revenue_by_day_and_tariff"],
    "C12_insert_ignore": over("cars", """
SELECT * FROM (SELECT min(id) AS id, plate_number FROM plated WHERE plate_number IS NOT NULL GROUP BY plate_number) p
WHERE NOT EXISTS (SELECT 1 FROM cars WHERE cars.plate_number = p.plate_number)
UNION ALL SELECT id, plate_number FROM plated WHERE plate_number IS NULL""", more="""
plated AS (SELECT o_orderkey + 1000000000 AS id, CASE WHEN (o_orderkey + 1000000000) % 9 <> 0
                  THEN concat('P', o_orderkey * 7 % 50021) END AS plate_number FROM orders)"""),
    "A5_requests_from_files": """
WITH asked AS (SELECT c_custkey AS k, c_custkey // 10 AS r, row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) - 1 AS n
               FROM customer)
SELECT r AS request_no, n AS user_no, concat('+8', k + 1000000) AS phone,
       CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS cars, false AS unreadable
FROM asked WHERE r % 11 <> 0 AND r % 7 <> 0
UNION ALL
SELECT DISTINCT r, NULL, NULL, 0, false FROM asked WHERE r % 11 <> 0 AND r % 7 = 0
UNION ALL
SELECT NULL, NULL, NULL, 0, true FROM (SELECT DISTINCT r FROM asked WHERE r % 11 = 0)""",
    "U6_wallets_of_new_users": over("users", f"""
SELECT {UUID} AS id, user_id, CAST(0 AS DOUBLE) AS balance, 'RUB' AS currency, created_at AS updated_at
FROM (SELECT id AS user_id, created_at, md5(concat('wallet|', id)) AS h FROM users) u"""),
    "E4_known_exits": over("gates cars", "SELECT id, car_id, exit_time FROM checked WHERE error IS NULL",
                           more=EXIT_REQUESTS),
    "E4_refused_exits": over("gates cars", """
SELECT id, plate_number, gate_id, exit_time, error FROM checked WHERE error IS NOT NULL""",
        more=EXIT_REQUESTS),
    "U1_parking_cost": over("parking_sessions tariffs", f"""
SELECT s.id, {minutes('s.entry_time', 's.exit_time', 't.free_minutes')} AS billable_minutes,
       CAST({money(cents('s.entry_time', 's.exit_time', 't.price_per_hour', 't.free_minutes'))} AS DOUBLE) AS cost
FROM parking_sessions s JOIN tariffs t ON t.id = s.tariff_id WHERE s.status = 'completed'"""),
    "U1_parking_cost_function": over("parking_sessions tariffs", f"""
SELECT s.id, CAST({money(cents('s.entry_time', 's.exit_time', 't.price_per_hour', 't.free_minutes'))} AS DOUBLE) AS cost
FROM parking_sessions s JOIN tariffs t ON t.id = s.tariff_id"""),
    "U2_user_balance": over("users wallets", """
SELECT u.id AS user_id, CAST(coalesce(w.balance, 0) AS DOUBLE) AS balance
FROM users u LEFT JOIN wallets w ON w.user_id = u.id"""),
    "U2_user_balance_function": over("users wallets", """
SELECT u.id AS user_id, CAST(coalesce(w.balance, 0) AS DOUBLE) AS balance
FROM users u LEFT JOIN (SELECT user_id, max(balance) AS balance FROM wallets GROUP BY user_id) w ON w.user_id = u.id"""),
    "U3_check_entry_function": over(ENTRY_TABLES, """
SELECT id, allowed, reason, car_id, user_id, wallet_id, balance FROM decisions""",
        more=decided("w.balance", "").replace("JOIN gates g ON g.id = a.gate_id AND g.type = 'entry'", "")),
    "E1_entry_decisions": over(ENTRY_TABLES, "SELECT * FROM decisions", more=decided("w.balance", "")),
    "E1_entry_logs": over(ENTRY_TABLES, f"""
SELECT {UUID} AS id, plate_number, gate_id, attempt_time,
       CASE WHEN allowed THEN 'allowed' ELSE 'denied' END AS result, reason
FROM (SELECT *, md5(concat('entry_log|', id)) AS h FROM decisions) d""", more=decided("w.balance", "")),
    "E1_gate_rejections": over("gates", """
SELECT a.*, CASE WHEN g.id IS NULL THEN 'Gate not found' ELSE 'Gate is not an entry gate' END AS error
FROM attempts a LEFT JOIN gates g ON g.id = a.gate_id
WHERE g.id IS NULL OR g.type <> 'entry'""", more=ATTEMPTS),
    "E2_decisions_at_time": over(ENTRY_TABLES + " wallet_transactions", "SELECT * FROM decisions",
                                 more=decided(THEN, "")),
    "E3_tariff_assignment": over("parking_sessions cars parking_spots tariffs user_access_levels",
                                 TARIFF_PICK, more="""
requests AS (SELECT s.id, c.user_id, p.zone_id FROM parking_sessions s JOIN cars c ON c.id = s.car_id
             LEFT JOIN parking_spots p ON p.id = s.spot_id)"""),
    "E4_exit_results": over(SETTLE_TABLES, f"""
SELECT exit_id AS id, car_id, outcome = 'ok' AS success, session_id,
       CASE WHEN outcome = 'ok' THEN CAST(CAST(charge * 0.01 AS DECIMAL(12,2)) AS DOUBLE) END AS cost,
       {OUTCOME_TEXT} AS message
FROM played WHERE step > 0""", recursive=True, more=SETTLE),
    "E4_closed_sessions": over(SETTLE_TABLES, """
SELECT s.id, s.car_id, s.spot_id, s.tariff_id, s.entry_time, p.exit_time,
       CAST(CAST(p.charge * 0.01 AS DECIMAL(12,2)) AS DOUBLE) AS total_cost, 'completed' AS status
FROM played p JOIN parking_sessions s ON s.id = p.session_id WHERE p.outcome = 'ok'""",
        recursive=True, more=SETTLE),
    "E4_charges": over(SETTLE_TABLES, f"""
SELECT {UUID} AS id, wallet_id, session_id, CAST(CAST(-charge * 0.01 AS DECIMAL(12,2)) AS DOUBLE) AS amount,
       'parking_charge' AS operation_type, exit_time AS created_at,
       concat('Parking session ', session_id) AS comment
FROM (SELECT *, md5(concat('charge|', session_id)) AS h FROM played WHERE outcome = 'ok') c""",
        recursive=True, more=SETTLE),
    "E4_debited_wallets": over(SETTLE_TABLES, """
SELECT w.id, w.user_id, CAST(w.balance - CAST(d.cents * 0.01 AS DECIMAL(12,2)) AS DOUBLE) AS balance,
       w.currency, d.at AS updated_at
FROM wallets w JOIN (SELECT wallet_id, CAST(sum(charge) AS BIGINT) AS cents, max(exit_time) AS at FROM played
                     WHERE outcome = 'ok' GROUP BY wallet_id) d ON d.wallet_id = w.id""",
        recursive=True, more=SETTLE),
    "E5_opened_sessions": over(ENTRY_TABLES + " tariffs user_access_levels", f"""
SELECT {UUID} AS id, car_id, CAST(NULL AS VARCHAR) AS spot_id, tariff_id, attempt_time AS entry_time,
       CAST(NULL AS TIMESTAMP) AS exit_time, CAST(NULL AS DOUBLE) AS total_cost, 'active' AS status
FROM (SELECT d.*, p.tariff_id, md5(concat('session|', d.id)) AS h
      FROM decisions d JOIN picked p ON p.id = d.id WHERE d.allowed) s""",
        more=decided("w.balance", "") + f""",
requests AS (SELECT id, user_id, CAST(NULL AS BIGINT) AS zone_id FROM decisions WHERE allowed),
picked AS ({TARIFF_PICK})"""),
    "J1_topup_transactions": over("wallets", """
SELECT id, wallet_id, CAST(NULL AS VARCHAR) AS session_id, CAST(amount AS DOUBLE) AS amount,
       'topup' AS operation_type, created_at, coalesce(comment, 'Wallet top-up') AS comment
FROM posted""", more=TOPUPS),
    "J1_topup_balances": over("wallets", """
SELECT w.id, w.user_id, CAST(w.balance + coalesce(p.added, 0) AS DOUBLE) AS balance, w.currency,
       coalesce(p.at, w.updated_at) AS updated_at
FROM wallets w LEFT JOIN (SELECT wallet_id, sum(amount) AS added, max(created_at) AS at
                          FROM posted GROUP BY wallet_id) p ON p.wallet_id = w.id""", more=TOPUPS),
    "J1_topup_new_balances": over("wallets", """
SELECT entity_id, created_at, CAST(opening + sum(amount) OVER (PARTITION BY entity_id ORDER BY created_at, id)
                       AS DOUBLE) AS new_balance, CAST(amount AS DOUBLE) AS amount
FROM (SELECT *, wallet_id AS entity_id FROM posted) p""", more=TOPUPS),
    "J1_topup_rejections": over("wallets", """
SELECT t.id, t.user_id, CAST(t.amount AS DOUBLE) AS amount, t.created_at, t.comment,
       CASE WHEN t.amount <= 0 THEN 'Amount must be positive' ELSE 'Wallet not found' END AS reason
FROM topups t LEFT JOIN wallets w ON w.user_id = t.user_id WHERE t.amount <= 0 OR w.id IS NULL""",
        more=TOPUPS),
    "J2_balances": over("wallets wallet_transactions", """
SELECT w.id AS wallet_id, CAST(w.balance AS DOUBLE) AS opening, count(t.id) AS operations,
       CAST(w.balance + coalesce(sum(t.amount), 0) AS DOUBLE) AS balance
FROM wallets w LEFT JOIN wallet_transactions t ON t.wallet_id = w.id GROUP BY w.id, w.balance"""),
    "J3_running_balances": over("wallets wallet_transactions", """
SELECT t.id, t.wallet_id, t.session_id, CAST(t.amount AS DOUBLE) AS amount, t.operation_type,
       t.created_at, t.comment,
       CAST(w.balance + sum(t.amount) OVER (PARTITION BY t.wallet_id ORDER BY t.created_at, t.id
            ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance_after
FROM wallet_transactions t JOIN wallets w ON w.id = t.wallet_id"""),
    "J3_ledger": over("wallets cars parking_sessions wallet_transactions", f"""
SELECT {UUID} AS id, wallet_id, session_id, amount, operation_type, created_at, comment
FROM (SELECT w.id AS wallet_id, s.id AS session_id, CAST(-s.total_cost AS DOUBLE) AS amount,
             'parking_charge' AS operation_type, s.exit_time AS created_at,
             concat('Parking session ', s.id) AS comment, md5(concat('charge|', s.id)) AS h
      FROM parking_sessions s JOIN cars c ON c.id = s.car_id JOIN wallets w ON w.user_id = c.user_id
      WHERE s.status = 'completed') x
UNION ALL
SELECT CAST(id AS VARCHAR), wallet_id, session_id, CAST(amount AS DOUBLE), operation_type, created_at, comment
FROM wallet_transactions WHERE operation_type <> 'parking_charge'"""),
    "J4_cost_reconciliation": over("parking_sessions tariffs wallet_transactions", f"""
SELECT coalesce(s.id, t.session_id) AS session_id, CAST(s.total_cost + s.id % 7 // 6 AS DOUBLE) AS stored_cost,
       CAST(s.rule_cost AS DOUBLE) AS rule_cost, CAST(t.charged AS DOUBLE) AS charged,
       CASE WHEN s.id IS NULL THEN 'charge without completed session' WHEN t.charged IS NULL THEN 'not charged'
            WHEN s.total_cost + s.id % 7 // 6 <> t.charged THEN 'charge differs'
            WHEN s.total_cost + s.id % 7 // 6 <> s.rule_cost THEN 'rule differs' ELSE 'equal' END AS verdict
FROM (SELECT p.*, {money(cents('entry_time', 'exit_time', 'price_per_hour', 'free_minutes'))} AS rule_cost
      FROM parking_sessions p JOIN (SELECT id AS tid, price_per_hour, free_minutes FROM tariffs) f
        ON f.tid = p.tariff_id WHERE status = 'completed') s
FULL JOIN (SELECT session_id + CASE WHEN session_id % 10 = 5 THEN 1000000000 ELSE 0 END AS session_id,
                  -sum(amount) AS charged FROM wallet_transactions
           WHERE operation_type = 'parking_charge' GROUP BY 1) t
  ON t.session_id = s.id"""),
    "J5_import_errors": over("users cars", """
SELECT request_no, user_no, phone, 'Integrity error (duplicate phone/email/plate)' AS error, verdict AS details
FROM final WHERE verdict IS NOT NULL""", recursive=True, more=IMPORT),
    "J5_import_summary": over("users cars", """
SELECT request_no, count(*) FILTER (WHERE verdict IS NULL) AS created_users,
       CAST(coalesce(sum(len(plates)) FILTER (WHERE verdict IS NULL), 0) AS BIGINT) AS created_cars,
       count(*) FILTER (WHERE verdict IS NOT NULL) AS failed_users
FROM final GROUP BY request_no""", recursive=True, more=IMPORT),
    "J5_imported_users": over("users cars", """
SELECT phone, email, len(plates) AS cars FROM final WHERE verdict IS NULL AND NOT dry_run""",
        recursive=True, more=IMPORT),
    "J6_inserted_cars": over("cars", "SELECT id, user_id, plate_number, model FROM judged WHERE error IS NULL",
                             more=NEW_CARS),
    "J6_rejected_cars": over("cars", "SELECT * FROM judged WHERE error IS NOT NULL", more=NEW_CARS),
    "J7_updated_spots": over("parking_spots", """
SELECT s.id, CASE WHEN j.held OR j.repeated OR j.id IS NULL THEN s.zone_id ELSE j.zone_id END AS zone_id,
       CASE WHEN j.held OR j.repeated OR j.id IS NULL THEN s.spot_number ELSE j.spot_number END AS spot_number,
       s.is_reserved,
       CASE WHEN j.held OR j.repeated OR j.id IS NULL THEN s.is_active ELSE j.is_active END AS is_active
FROM parking_spots s LEFT JOIN judged j ON j.id = s.id""", more=PATCHED),
    "J7_rejected_updates": over("parking_spots", """
SELECT id, CASE WHEN held THEN 'zone_id, spot_number already exists'
                ELSE 'repeats an earlier row of the batch' END AS error
FROM judged WHERE held OR repeated""", more=PATCHED),
    "J8_user_delete_verdicts": over("users cars parking_sessions", "SELECT * FROM verdicts", more=USER_DELETE),
    "J8_wallets_after_user_delete": over("users cars parking_sessions wallets", """
SELECT id, user_id FROM wallets WHERE user_id NOT IN (SELECT id FROM verdicts WHERE error IS NULL)""",
        more=USER_DELETE),
    "J8_sessions_after_zone_delete": over("parking_spots parking_sessions", """
SELECT s.id, CASE WHEN p.zone_id % 2 = 1 THEN NULL ELSE s.spot_id END AS spot_id
FROM parking_sessions s LEFT JOIN parking_spots p ON p.id = s.spot_id"""),
    "J9_audit_of_inserts": over("cars", f"""
SELECT {UUID} AS id, user_id, 'car' AS entity_type, entity_id, 'create' AS action, details, created_at
FROM (SELECT user_id, id AS entity_id, TIMESTAMP '2024-02-10 00:00:00' AS created_at,
             concat('{{"plate_number":"', plate_number, '","model":',
                    CASE WHEN model IS NULL THEN 'null' ELSE concat('"', model, '"') END, '}}') AS details,
             md5(concat('audit|car|create|', id, '|2024-02-10 00:00:00')) AS h
      FROM judged WHERE error IS NULL) x""", more=NEW_CARS),
    "B13_cars_after_updates": over("cars", "SELECT id, user_id, plate_number, model FROM patched", more=CAR_PATCHES),
    "B13_refused_car_updates": over("cars", "SELECT id, 'not the owner' AS error FROM asked WHERE NOT mine", more=CAR_PATCHES),
    "J9_audit_of_updates": over("cars", audit_of("update", "(SELECT * FROM patched WHERE done)"), more=CAR_PATCHES),
    "J9_audit_of_deletes": over("cars parking_sessions", audit_of("delete", """(SELECT * FROM cars
        WHERE id % 2 = 0 AND id NOT IN (SELECT car_id FROM parking_sessions))""")),
    "J10_defaults": """
SELECT c_custkey AS id, c_custkey AS user_id,
       CASE WHEN c_custkey % 3 <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) ELSE 0 END AS balance,
       CASE WHEN c_custkey % 4 = 0 THEN 'EUR' ELSE 'RUB' END AS currency,
       TIMESTAMP '2024-02-10 00:00:00' AS updated_at FROM customer""",
    "K1_user_violations": over("", r"""
SELECT id, array_to_string([x FOR x IN [
    CASE WHEN phone IS NULL THEN 'phone required' END,
    CASE WHEN password_hash IS NULL THEN 'password_hash required' END,
    CASE WHEN length(phone) > 20 THEN 'phone longer than 20' END,
    CASE WHEN NOT regexp_matches(phone, '^\+?[1-9][0-9]{1,14}$') THEN 'phone format' END,
    CASE WHEN NOT regexp_matches(email, '^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$') THEN 'email format' END]
    IF x IS NOT NULL], '; ') AS violations
FROM dirty""", more=DIRTY),
    "K2_duplicate_phones": over("", """
SELECT phone, count(*) AS rows FROM dirty WHERE phone IS NOT NULL GROUP BY phone HAVING count(*) > 1""",
        more=DIRTY),
    "K3_orphan_transactions": over("wallet_transactions wallets", """
SELECT id, wallet_id FROM wallet_transactions t
WHERE NOT EXISTS (SELECT 1 FROM wallets w WHERE w.id = t.wallet_id)"""),
    "K4_quality_report": quality_sql(),
    "B11_sessions_by_viewer": over("users cars parking_sessions", """
SELECT c.user_id AS viewer_id, s.id, s.car_id, s.spot_id, s.tariff_id, s.entry_time, s.exit_time,
       CAST(s.total_cost AS DOUBLE) AS total_cost, s.status
FROM parking_sessions s JOIN cars c ON c.id = s.car_id JOIN users u ON u.id = c.user_id"""),
    "B11_logs_of_one_user": over("entry_logs cars", """
SELECT l.* FROM entry_logs l JOIN cars c ON c.plate_number = l.plate_number WHERE c.user_id = 10"""),
    "B11_audit_of_one_user": over("audit_logs", "SELECT * FROM audit_logs WHERE false"),
    "B11_audit_of_administrators": over("audit_logs", "SELECT * FROM audit_logs"),
    "B11_cars_seen_with_administrators": over("users cars", """
SELECT users.id AS viewer_id, cars.* FROM users JOIN cars ON cars.user_id = users.id"""),
    "B11_cars_in_scopes": over("users cars", """
SELECT NULL::BIGINT AS scope_id, cars.* FROM cars WHERE EXISTS (SELECT 1 FROM users WHERE phone = '+79000000010')
UNION ALL
SELECT users.id AS scope_id, cars.* FROM cars JOIN users ON users.id = cars.user_id WHERE users.phone <> '+79000000010'"""),
    "B11_operations_of_one_user": over("wallet_transactions wallets", """
SELECT t.id, t.wallet_id, t.session_id, CAST(t.amount AS DOUBLE) AS amount, t.operation_type, t.created_at, t.comment
FROM wallet_transactions t JOIN wallets w ON w.id = t.wallet_id WHERE w.user_id = 10"""),
    "E5_double_active_cars": over("parking_sessions", """
SELECT car_id, count(*) AS active_sessions FROM parking_sessions WHERE status = 'active'
GROUP BY car_id HAVING count(*) > 1"""),
}
JOBS["E4_exit_results_in_phases"] = JOBS["E4_exit_results"]
JOBS["J3_running_balances_by_rows"] = JOBS["J3_running_balances"]
