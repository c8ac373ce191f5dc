"""Wire codec: binary stanza frames to columns and back. Needs the protobuf runtime; the messages are built from FIELDS."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline import schemas as S

# Message fields on the wire, by number.
FIELDS = {
    "Identity": {1: "eid string", 2: "connection_resource_id string?"},
    "Awareness": {1: "id string", 2: "from Identity", 3: "to Identity", 4: "type int32", 5: "status int32", 6: "location_sharing int32", 7: "latitude double", 8: "longitude double", 9: "ttl int32", 10: "details string", 11: "timestamp int64", 12: "node int64"},
    "PingPong": {1: "id string", 2: "to Identity", 3: "type int32", 4: "timestamp int64", 5: "details string"},
    "Logout": {1: "to Identity", 2: "type int32", 3: "status int32", 4: "timestamp int64", 5: "details string"},
    "ErrorMessage": {1: "code int32", 2: "error_origin int32", 3: "details string", 4: "timestamp int64"},
    "Scheme": {1: "route int64", 2: "awareness Awareness", 3: "ping_pong PingPong", 8: "logout Logout", 9: "error ErrorMessage"},
}
PAYLOADS = {"awareness": S.AWARENESS, "ping_pong": S.PING_PONG, "logout": S.LOGOUT, "error": S.ERROR}
DECODED = "route long, kind string, " + ", ".join(f"{k} struct<{v}>" for k, v in PAYLOADS.items()) + ", problem string"


def available() -> bool:
    try:
        import google.protobuf  # noqa: F401
    except ImportError:
        return False
    return True


@lru_cache(maxsize=1)
def scheme():  # noqa: ANN201
    """The message class of an envelope; the payload members share one oneof."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = {"string": 9, "int32": 5, "int64": 3, "double": 1}
    file = descriptor_pb2.FileDescriptorProto(name="stanza.proto", package="stanza", syntax="proto3")
    for name, fields in FIELDS.items():
        message = file.message_type.add(name=name)
        if name == "Scheme":
            message.oneof_decl.add(name="payload")
        for number, spec in fields.items():
            field, kind = spec.rstrip("?").split()
            f = message.field.add(name=field, number=number, label=1)
            if kind in kinds:
                f.type = kinds[kind]
            else:
                f.type, f.type_name = 11, f".stanza.{kind}"
            if name == "Scheme" and number > 1:
                f.oneof_index = 0
        for f, spec in zip(message.field, fields.values(), strict=True):
            if spec.endswith("?"):
                message.oneof_decl.add(name=f"_{f.name}")
                f.oneof_index, f.proto3_optional = len(message.oneof_decl) - 1, True
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("stanza.Scheme"))


def _dict(message: object) -> dict:
    out = {}
    for f in message.DESCRIPTOR.fields:
        if f.message_type is not None or f.has_presence:
            out[f.name] = (_dict(getattr(message, f.name)) if f.message_type is not None else getattr(message, f.name)) if message.HasField(f.name) else None
        else:
            out[f.name] = getattr(message, f.name)
    return out


def _decode_one(frame: bytes) -> tuple:
    m = scheme()()
    try:
        m.ParseFromString(frame)
    except Exception as e:  # noqa: BLE001  the runtime's own error class differs by build
        return (None, None, *[None] * len(PAYLOADS), f"undecodable: {type(e).__name__}")
    kind = m.WhichOneof("payload")
    values = [_dict(getattr(m, k)) if k == kind else None for k in PAYLOADS]
    return (m.route, kind, *values, None if kind else "no payload")


def decode_frames(frames: DataFrame, column: str = "frame") -> DataFrame:
    """All columns of frames and the decoded route, kind, one struct a payload and problem (null if none).

    Null and empty frames are dropped. Undecodable ones stay as rows with a problem: split them off with quarantine().
    Works on streams too.
    """
    names = [c.split()[0] for c in ("route long", "kind string")] + [*PAYLOADS, "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_decode_one(bytes(x)) for x in batch[column]]
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    kept = frames.filter(F.coalesce(F.octet_length(column), F.lit(0)) > 0)
    kinds = ", ".join(f"`{c}` {t}" for c, t in frames.dtypes)
    return kept.mapInPandas(run, f"{kinds}, {DECODED}")


def served(decoded: DataFrame) -> DataFrame:
    """Frames whose route is handled, with their payload."""
    return decoded.filter("problem is null and ((route = 2 and awareness is not null) or (route = 3 and ping_pong is not null))")


def quarantine(decoded: DataFrame) -> DataFrame:
    """Frames that aren't: with the reason."""
    reason = F.coalesce("problem", F.concat(F.lit("route "), F.coalesce(F.col("route").cast("string"), F.lit("none"))))
    bad = F.col("problem").isNotNull() | ~F.coalesce(((F.col("route") == 2) & F.col("awareness").isNotNull()) | ((F.col("route") == 3) & F.col("ping_pong").isNotNull()), F.lit(False))
    return decoded.filter(bad).withColumn("reason", reason)


def encode_frames(stanzas: DataFrame) -> DataFrame:
    """stanzas(route, and any of the payload structs) with column frame; the first payload that isn't null is sent."""
    payloads = [k for k in PAYLOADS if k in stanzas.columns]

    def fill(message: object, value: object) -> None:
        for k, v in (value if isinstance(value, dict) else value.asDict()).items():
            if v is None or v != v:
                continue
            field = message.DESCRIPTOR.fields_by_name[k]
            if field.message_type is not None:
                getattr(message, k).SetInParent()
                fill(getattr(message, k), v)
            else:
                setattr(message, k, int(v) if field.type in (3, 5) else v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frames = []
            for row in batch.to_dict("records"):
                m = scheme()(route=int(row["route"]))
                for k in payloads:
                    if row[k] is not None:
                        getattr(m, k).SetInParent()
                        fill(getattr(m, k), row[k])
                        break
                frames.append(m.SerializeToString())
            yield batch.assign(frame=frames)

    kinds = ", ".join(f"`{c}` {t}" for c, t in stanzas.dtypes)
    return stanzas.mapInPandas(run, f"{kinds}, frame binary")
