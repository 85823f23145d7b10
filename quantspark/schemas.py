"""Schemas of stored tables, as DDL."""

from __future__ import annotations

BARS_CSV = ("timestamp", "open", "high", "low", "close", "volume")
REQUIRED_BAR_COLUMNS = BARS_CSV[:5]

AUDIT_VERSION = 1
#: Append-only tables, each partitioned by run_id (runs: by event).
AUDIT = {
    "runs": "run_id string, event string, ts_epoch_s double, config_json string",
    "decisions": "run_id string, seq long, ts_epoch_s double, strategy string, intent_json string, accepted int, reason string",
    "orders": "run_id string, seq long, ts_epoch_s double, broker string, order_id string, instrument_kind string, instrument_symbol string, side string, quantity double, order_type string, request_json string, status string",
    "order_status_events": "run_id string, seq long, ts_epoch_s double, broker string, order_id string, status string, filled double, remaining double, avg_fill_price double",
    "errors": "run_id string, seq long, ts_epoch_s double, where_text string, message string",
    "actions": "run_id string, seq long, ts_epoch_s double, actor string, payload_json string, accepted int, reason string",
}
