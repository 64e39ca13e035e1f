"""The thirteen tables: columns, keys, references, defaults and value domains."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
PRICE = T.DecimalType(10, 2)
WHEN = T.TimestampNTZType()
TEXT = T.StringType()
FLAG = T.BooleanType()
KEY = "key"  # placeholder: keys are strings (UUID) by default, any type works

# Fixed values of the business rules.
FLOOR_BALANCE = "-1000.00"
ENTRY_MINIMUM = "50.00"
DEFAULT_CURRENCY = "RUB"
PHONE_PATTERN = r"^\+?[1-9]\d{1,14}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"
GATE_TYPES = ("entry", "exit")
SESSION_STATUSES = ("active", "completed", "failed")
OPERATION_TYPES = ("topup", "parking_charge", "adjustment")
ENTRY_RESULTS = ("allowed", "denied")
AUDIT_ACTIONS = ("create", "update", "delete")

# Date column a stored table is partitioned by, for each time column.
DATE_OF = {"entry_time": "entry_date", "created_at": "created_date",
           "attempt_time": "attempt_date"}

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"
NOW = object()  # default "time of the batch"


@dataclass(frozen=True)
class Reference:
    column: str
    parent: str
    on_delete: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: dict
    required: tuple = ()
    unique: tuple = ()
    references: tuple = ()
    defaults: dict = field(default_factory=dict)
    domains: dict = field(default_factory=dict)
    lengths: dict = field(default_factory=dict)
    patterns: dict = field(default_factory=dict)
    minimums: dict = field(default_factory=dict)
    ordered: tuple = ()  # (earlier, later) timestamp pairs
    partition_by: tuple = ()  # layout advice for stored tables


TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec(
            "users",
            {"id": KEY, "phone": TEXT, "email": TEXT, "password_hash": TEXT,
             "created_at": WHEN, "is_blocked": FLAG},
            required=("id", "phone", "password_hash", "created_at", "is_blocked"),
            unique=(("phone",), ("email",)),
            defaults={"created_at": NOW, "is_blocked": False},
            lengths={"phone": 20, "email": 255, "password_hash": 255},
            patterns={"phone": PHONE_PATTERN, "email": EMAIL_PATTERN},
        ),
        TableSpec(
            "wallets",
            {"id": KEY, "user_id": KEY, "balance": MONEY, "currency": TEXT, "updated_at": WHEN},
            required=("id", "user_id", "balance", "currency", "updated_at"),
            unique=(("user_id",),),
            references=(Reference("user_id", "users", CASCADE),),
            defaults={"balance": "0.00", "currency": DEFAULT_CURRENCY, "updated_at": NOW},
            lengths={"currency": 3},
            minimums={"balance": FLOOR_BALANCE},
        ),
        TableSpec(
            "cars",
            {"id": KEY, "user_id": KEY, "plate_number": TEXT, "model": TEXT,
             "is_active": FLAG, "created_at": WHEN},
            required=("id", "user_id", "plate_number", "is_active", "created_at"),
            unique=(("plate_number",),),
            references=(Reference("user_id", "users", CASCADE),),
            defaults={"is_active": True, "created_at": NOW},
            lengths={"plate_number": 20, "model": 255},
        ),
        TableSpec(
            "access_levels",
            {"id": KEY, "code": TEXT, "description": TEXT},
            required=("id", "code"),
            unique=(("code",),),
            lengths={"code": 50},
        ),
        TableSpec(
            "user_access_levels",
            {"id": KEY, "user_id": KEY, "access_level_id": KEY, "granted_at": WHEN},
            required=("id", "user_id", "access_level_id", "granted_at"),
            unique=(("user_id", "access_level_id"),),
            references=(Reference("user_id", "users", CASCADE),
                        Reference("access_level_id", "access_levels", CASCADE)),
            defaults={"granted_at": NOW},
        ),
        TableSpec(
            "parking_zones",
            {"id": KEY, "name": TEXT, "description": TEXT},
            required=("id", "name"),
            lengths={"name": 255},
        ),
        TableSpec(
            "parking_spots",
            {"id": KEY, "zone_id": KEY, "spot_number": TEXT, "is_reserved": FLAG,
             "is_active": FLAG},
            required=("id", "zone_id", "spot_number", "is_reserved", "is_active"),
            unique=(("zone_id", "spot_number"),),
            references=(Reference("zone_id", "parking_zones", CASCADE),),
            defaults={"is_reserved": False, "is_active": True},
            lengths={"spot_number": 50},
        ),
        TableSpec(
            "tariffs",
            {"id": KEY, "name": TEXT, "price_per_hour": PRICE, "free_minutes": T.IntegerType(),
             "zone_id": KEY, "access_level_id": KEY},
            required=("id", "name", "price_per_hour", "free_minutes"),
            unique=(("name",),),
            references=(Reference("zone_id", "parking_zones", SET_NULL),
                        Reference("access_level_id", "access_levels", SET_NULL)),
            defaults={"free_minutes": 0},
            lengths={"name": 255},
            minimums={"price_per_hour": "0", "free_minutes": "0"},
        ),
        TableSpec(
            "gates",
            {"id": KEY, "name": TEXT, "type": TEXT},
            required=("id", "name", "type"),
            domains={"type": GATE_TYPES},
            lengths={"name": 255, "type": 10},
        ),
        TableSpec(
            "parking_sessions",
            {"id": KEY, "car_id": KEY, "spot_id": KEY, "tariff_id": KEY, "entry_time": WHEN,
             "exit_time": WHEN, "total_cost": MONEY, "status": TEXT},
            required=("id", "car_id", "tariff_id", "entry_time", "status"),
            references=(Reference("car_id", "cars", RESTRICT),
                        Reference("spot_id", "parking_spots", SET_NULL),
                        Reference("tariff_id", "tariffs", RESTRICT)),
            defaults={"entry_time": NOW, "status": "active"},
            domains={"status": SESSION_STATUSES},
            lengths={"status": 20},
            ordered=(("entry_time", "exit_time"),),
            partition_by=("status", "entry_date"),
        ),
        TableSpec(
            "wallet_transactions",
            {"id": KEY, "wallet_id": KEY, "session_id": KEY, "amount": MONEY,
             "operation_type": TEXT, "created_at": WHEN, "comment": TEXT},
            required=("id", "wallet_id", "amount", "operation_type", "created_at"),
            references=(Reference("wallet_id", "wallets", CASCADE),
                        Reference("session_id", "parking_sessions", SET_NULL)),
            defaults={"created_at": NOW},
            domains={"operation_type": OPERATION_TYPES},
            lengths={"operation_type": 20},
            partition_by=("created_date",),
        ),
        TableSpec(
            "entry_logs",
            {"id": KEY, "plate_number": TEXT, "gate_id": KEY, "attempt_time": WHEN,
             "result": TEXT, "reason": TEXT},
            required=("id", "plate_number", "gate_id", "attempt_time", "result"),
            references=(Reference("gate_id", "gates", RESTRICT),),
            defaults={"attempt_time": NOW},
            domains={"result": ENTRY_RESULTS},
            lengths={"plate_number": 20, "result": 10},
            partition_by=("attempt_date",),
        ),
        TableSpec(
            "audit_logs",
            {"id": KEY, "user_id": KEY, "entity_type": TEXT, "entity_id": KEY, "action": TEXT,
             "details": TEXT, "created_at": WHEN},
            required=("id", "entity_type", "action", "created_at"),
            references=(Reference("user_id", "users", SET_NULL),),
            defaults={"created_at": NOW},
            domains={"action": AUDIT_ACTIONS},
            lengths={"entity_type": 50, "action": 20},
            partition_by=("entity_type",),
        ),
    )
}


def struct_of(table: str, key_type: T.DataType | None = None) -> T.StructType:
    """Read schema of a table. Keys are strings unless ``key_type`` says otherwise."""
    key_type = key_type or TEXT
    return T.StructType([
        T.StructField(name, key_type if kind == KEY else kind, True)
        for name, kind in TABLES[table].columns.items()
    ])


def children_of(parent: str) -> list[tuple[str, Reference]]:
    """(table, reference) pairs that point at ``parent``."""
    return [(spec.name, ref) for spec in TABLES.values() for ref in spec.references
            if ref.parent == parent]


IMPORT_PAYLOAD = T.StructType([
    T.StructField("users", T.ArrayType(T.StructType([
        T.StructField("phone", TEXT),
        T.StructField("email", TEXT),
        T.StructField("password_hash", TEXT),
        T.StructField("cars", T.ArrayType(T.StructType([
            T.StructField("plate_number", TEXT),
            T.StructField("model", TEXT),
        ]))),
    ]))),
    T.StructField("dry_run", FLAG),
])
