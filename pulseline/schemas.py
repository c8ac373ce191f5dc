"""Schemas of the presence and messaging tables, stanza schemas and code tables."""

from __future__ import annotations

# Schemas are DDL strings, as spark.read.schema() and createDataFrame() take them.
DEVICE = (
    "eid string, device_id string, status string, status_source string, awareness_intention int, last_seen timestamp, last_activity timestamp, inserted_at timestamp, "
    "ip_address string, app_version string, os string, supports_notifications boolean, supports_media boolean, last_received_version long, last_offset long, updated_at timestamp"
)
USER_AWARENESS = "eid string, awareness int, updated_at timestamp"
USER_STATE = "eid string, user_status string, online_device_ids array<string>, last_seen timestamp"
SUBSCRIBERS = "owner_id string, subscriber_id string, status string, blocked boolean, inserted_at timestamp, last_seen timestamp"
DEVICE_OFFSETS = "eid string, device_id string, partition_id int, offset long"
ACKS = DEVICE_OFFSETS
LOG = "eid string, partition_id int, offset long, from string, to string, payload binary, timestamp long"
QUEUE = "eid string, channel string, msg_id long, payload string, ts timestamp"
REVOKED = "jti string, exp timestamp"

IDENTITY = "struct<eid:string,connection_resource_id:string>"
AWARENESS = f"id string, from {IDENTITY}, to {IDENTITY}, type int, status int, location_sharing int, latitude double, longitude double, ttl int, details string, timestamp long, node long"
PING_PONG = f"id string, to {IDENTITY}, type int, timestamp long, details string"
LOGOUT = f"to {IDENTITY}, type int, status int, timestamp long, details string"
ERROR = "code int, error_origin int, details string, timestamp long"

# Codes on the wire.
STATUS_NAMES = {1: "ONLINE", 2: "OFFLINE", 3: "AWAY", 4: "BUSY", 5: "DND", 6: "TYPING", 7: "RECORDING", 8: "FORWARDED", 9: "DELIVERED", 10: "READ", 11: "RESUME"}
STANZA_TYPES = {1: "REQUEST", 2: "RESPONSE", 3: "ERROR"}
PING_TYPES = {1: "PING", 2: "PONG", 3: "ERROR"}
LOGOUT_STATUS = {1: "DISCONNECT", 2: "FAIL", 3: "SUCCESS", 4: "PENDING"}
ROUTES = {2: "awareness", 3: "ping_pong", 11: "error", 14: "logout"}
PING_REFRESH = 12
HIDDEN = 1

# Defaults in seconds, milliseconds and counts.
STALE_SECONDS = 600
REFRESH_SECONDS = 300
MAX_TICK_DELAY_SECONDS = 120
PONG_LIMIT = 5
INITIAL_MAX_MISSED = 6
DEFAULT_INTERVAL_MS = 10_000
RTT_HIGH_MS, RTT_LOW_MS = 500, 100
INTERVALS_MS = {"high": 2000, "medium": 1000, "low": 1000}
MAX_MISSED = {"high": 8, "medium": 5, "low": 3}
QUEUE_BOUND = 1000
