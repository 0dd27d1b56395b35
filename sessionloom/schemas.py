"""Fixed schemas of stored tables; ``SCHEMA_VERSION`` goes into every manifest."""

from pyspark.sql import types as T

SCHEMA_VERSION = 1


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "binary": T.BinaryType()}


def _struct(required: str, optional: str = "") -> T.StructType:
    """Fields as ``name:type`` words; those of ``optional`` may be null."""
    fields = [(x, False) for x in required.split()] + [(x, True) for x in optional.split()]
    return T.StructType([T.StructField(n, _TYPES[t], null) for x, null in fields for n, t in [x.split(":")]])


RECORDS = _struct(
    "id:string harness:string session_id:string source_id:string source_path:string position:bigint captured_at:string status:string adapter_version:string raw:binary",
    "diagnostic:string",
)
EVENTS = _struct(
    "id:string record_id:string harness:string session_id:string source_id:string position:bigint sub_index:bigint kind:string payload_json:string",
    "parent_session_id:string native_id:string parent_id:string timestamp:string role:string text:string model:string tool_call_id:string",
)
SESSION = _struct("", "harness:string session_id:string records:bigint events:bigint first_timestamp:string last_timestamp:string")
FILE = _struct("", "path:string size:bigint sha256:string")
MANIFEST = T.StructType(
    [
        *_struct("", "schema_version:bigint collector_id:string batch_id:string created_at:string"),
        T.StructField("sessions", T.ArrayType(SESSION)),
        T.StructField("files", T.ArrayType(FILE)),
        T.StructField("replaces", T.ArrayType(T.StringType())),
    ]
)
#: Where an event stands among those of its session.
CHRONOLOGY = ("source_id", "position", "sub_index")
