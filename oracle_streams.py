"""DuckDB SQL of the streams, which have closed all their windows by the end of their input."""

from oracle_jobs import TARIFF_PICK
from oracle_views import cents, over


def tumbling(unit: str) -> str:
    return f"""
SELECT date_trunc('{unit}', entry_time) AS window_start,
       date_trunc('{unit}', entry_time) + INTERVAL 1 {unit} AS window_end,
       count(*) AS entries_count, count(DISTINCT car_id) AS unique_cars
FROM parking_sessions GROUP BY 1, 2"""


SLIDES = """slides AS (
    SELECT l.*, time_bucket(INTERVAL 10 MINUTE, attempt_time) - INTERVAL 10 MINUTE * k AS window_start
    FROM entry_logs l, (VALUES (0), (1), (2), (3), (4), (5)) v(k))"""

VISITS = """marked AS (
    SELECT *, CASE WHEN attempt_time - lag(attempt_time) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh
    FROM entry_logs WINDOW w AS (PARTITION BY plate_number ORDER BY attempt_time, id)),
numbered AS (
    SELECT *, sum(fresh) OVER (PARTITION BY plate_number ORDER BY attempt_time, id) AS visit FROM marked)"""

FLOW = f"""requests AS (SELECT id, id AS user_id, CAST(NULL AS BIGINT) AS zone_id FROM users),
picked AS ({TARIFF_PICK}),
passages AS (
    SELECT e.event_id AS id, e.user_id, e.ts AS moment,
           CASE WHEN event_type IN ('signup', 'error') THEN 'entry' WHEN event_type = 'purchase' THEN 'topup'
                ELSE 'exit' END AS kind,
           CASE WHEN event_type <> 'purchase' THEN e.user_id * 3 + e.event_id % 3 END AS car_id,
           CAST(round(value * 100) AS BIGINT) AS amount, t.price_per_hour AS price, t.free_minutes AS free,
           (e.user_id * 3 + e.event_id % 3) % 10 <> 0 AS car_active,
           row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, CAST(e.event_id AS VARCHAR)) AS step
    FROM events e JOIN picked p ON p.id = e.user_id JOIN tariffs t ON t.id = p.tariff_id),
flow AS (
    SELECT u.id AS user_id, u.is_blocked, w.id IS NOT NULL AS funded,
           CAST(coalesce(w.balance, 0) * 100 AS BIGINT) AS balance, CAST(0 AS BIGINT) AS step,
           CAST([] AS STRUCT(car BIGINT, sid BIGINT, entered TIMESTAMP, price DECIMAL(10,2), free INTEGER)[]) AS open,
           CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS car_id, CAST(NULL AS VARCHAR) AS kind,
           CAST(NULL AS TIMESTAMP) AS moment, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS BIGINT) AS session_id,
           CAST(NULL AS BIGINT) AS cents
    FROM users u LEFT JOIN wallets w ON w.user_id = u.id
    UNION ALL
    SELECT user_id, is_blocked, funded,
           CASE message WHEN 'Top-up posted' THEN balance + cents WHEN 'Exit processed' THEN balance - cents
                ELSE balance END,
           step,
           CASE message WHEN 'Entry allowed' THEN list_append(open, struct_pack(car := car_id, sid := id,
                             entered := moment, price := price, free := free))
                        WHEN 'Exit processed' THEN [s FOR s IN open IF s.sid <> session_id]
                        ELSE open END,
           id, car_id, kind, moment, message, session_id, cents
    FROM (SELECT q.*, CASE
              WHEN kind = 'topup' THEN CASE WHEN amount <= 0 THEN 'Amount must be positive'
                                            WHEN NOT funded THEN 'Wallet not found' ELSE 'Top-up posted' END
              WHEN kind = 'entry' THEN CASE WHEN NOT car_active THEN 'Car not found or inactive'
                                            WHEN is_blocked THEN 'User is blocked'
                                            WHEN NOT funded THEN 'Wallet not found'
                                            WHEN balance < 5000 THEN 'Insufficient balance'
                                            ELSE 'Entry allowed' END
              WHEN top.sid IS NULL THEN 'No active session found'
              WHEN NOT funded THEN 'wallet'
              WHEN balance - charge < -100000 THEN 'Error processing exit: new row for relation "wallets" violates check constraint "balance_check"'
              ELSE 'Exit processed' END AS message,
              CASE WHEN kind = 'entry' AND car_active AND NOT is_blocked AND funded AND balance >= 5000 THEN id
                   WHEN kind = 'exit' THEN top.sid END AS session_id,
              CASE WHEN kind = 'topup' THEN CASE WHEN amount > 0 AND funded THEN amount END
                   WHEN kind = 'exit' AND top.sid IS NOT NULL AND funded AND balance - charge >= -100000
                     THEN charge END AS cents
          FROM (SELECT f.user_id, f.is_blocked, f.funded, f.balance, f.open, p.step, p.id, p.car_id, p.kind,
                       p.moment, p.amount, p.price, p.free, p.car_active, f.top, {cents("f.top.entered", "p.moment", "f.top.price", "f.top.free")} AS charge
                FROM (SELECT g.*, n.car_id AS next_car,
                             [s FOR s IN g.open IF s.car = n.car_id][-1] AS top
                      FROM flow g JOIN passages n ON n.user_id = g.user_id AND n.step = g.step + 1) f
                JOIN passages p ON p.user_id = f.user_id AND p.step = f.step + 1) q) m)"""

STREAMS = {
    "X1_hourly_load_stream": over("parking_sessions", tumbling("hour")),
    "X1_daily_load_stream": over("parking_sessions", tumbling("day")),
    "X2_denials_stream": over("entry_logs", f"""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, result, reason, count(*) AS attempts_count
FROM slides GROUP BY window_start, result, reason""", more=SLIDES),
    "X2_denial_share_stream": over("entry_logs", f"""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS attempts_count,
       count(*) FILTER (WHERE result = 'denied') AS denied_count,
       CAST(count(*) FILTER (WHERE result = 'denied') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS denied_share
FROM slides GROUP BY window_start""", more=SLIDES),
    "X3_visits_stream": over("entry_logs", f"""
SELECT min(attempt_time) AS window_start, max(attempt_time) + INTERVAL 2 HOUR AS window_end, plate_number,
       count(*) AS attempts_count, count(*) FILTER (WHERE result = 'allowed') AS allowed_count
FROM numbered GROUP BY plate_number, visit""", more=VISITS),
    "X4_reads_without_repeats": over("entry_logs", "SELECT * FROM entry_logs"),
    "X5_gate_flow": over("users wallets tariffs user_access_levels", """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(id AS VARCHAR) AS id, CAST(car_id AS VARCHAR) AS car_id, kind, moment AS "at",
       message IN ('Entry allowed', 'Exit processed', 'Top-up posted') AS done, message,
       CAST(session_id AS VARCHAR) AS session_id, cents, CASE WHEN funded THEN balance END AS balance_cents
FROM flow WHERE step > 0""", recursive=True, more=FLOW),
}
