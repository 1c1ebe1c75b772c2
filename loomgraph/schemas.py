"""DDL of the engine's relations.  Every table that has an order carries it in `ord`."""

FUNCTIONS = (
    "ord BIGINT, id STRING, name STRING, qualname STRING, file STRING, line_start INT, line_end INT, signature STRING, "
    "is_async BOOLEAN, is_method BOOLEAN, class_name STRING, decorators ARRAY<STRING>, kind STRING, synthetic BOOLEAN, "
    "used_self_attrs_read ARRAY<STRING>, used_self_attrs_written ARRAY<STRING>, params_types MAP<STRING, STRING>"
)
CALLS = "ord BIGINT, caller_id STRING, callee_id STRING, is_await BOOLEAN, call_type STRING, line INT, raw STRING"
SYMBOLS = "file STRING, module STRING, kind STRING, owner STRING, name STRING, target STRING"
STAGES = "ord BIGINT, id STRING, title STRING, description STRING, parent STRING, crosscut BOOLEAN"
FILE_STAGE = "file STRING, stage STRING, also ARRAY<STRING>"
MEMBERS = "stage STRING, ord BIGINT, qualname STRING, type STRING, file STRING, line_start INT, line_end INT, sha1 STRING, purpose STRING"
CARDS = (
    "file STRING, purpose STRING, role STRING, lifecycle STRING, description STRING, "
    "functions ARRAY<STRUCT<id: STRING, qualname: STRING, name: STRING, purpose: STRING, data_flow: STRING, relations: STRING>>"
)
REGISTERS = "ord BIGINT, id STRING, semantics STRING, stages ARRAY<STRING>"
REPLIES = "request_key STRING, reply STRING"
