"""Schemas of the tables that are read and written, as DDL."""

EVENT = (
    "session_id string, seq bigint, ts_wall timestamp, ts_mono_ns bigint, direction string, jsonrpc_method string, "
    "tool_name string, tool_args string, result string, server_id string, server_pid int, tags array<string>, "
    "decision string, block_reason string"
)
POD = "struct<namespace:string,pod_name:string,pod_uid:string,node_name:string>"
SYSCALL = (
    "ts_mono_ns bigint, pid int, tid int, comm string, syscall string, dest_ip string, dest_port int, allowlisted boolean, "
    f"path string, payload_excerpt binary, session_id string, cgroup_id decimal(20,0), pod_context {POD}, "
    "file_contents string, ts timestamp, node string, start_ts timestamp"
)
#: The event log file also holds audit records, which have a kind.
EVENT_OR_AUDIT = f"{EVENT}, kind string, reason string, syscall struct<ts_mono_ns:bigint,pid:int,tid:int,comm:string,syscall:string,dest_ip:string,dest_port:int,allowlisted:boolean,path:string,session_id:string>"
FRAME = "jsonrpc string, id string, method string, params string, result string, error string"
FEED = "op string, pod_uid string, source string, seq bigint, hash string, preview string, value string, variants array<struct<form:string,value:string>>"
LEG = "struct<lit:boolean,trigger_seq:bigint,detail:string,lit_at_ns:bigint>"
HIT = "struct<tainted_hash:string,preview:string,where_found:string,match_form:string>"
EVIDENCE = (
    "session_id string, trip_ts_ns bigint, verdict string, action string, variant string, confidence double, "
    f"legs struct<sensitive_source_touched:{LEG},untrusted_content_present:{LEG},external_sink_invoked:{LEG}>, "
    "sink_call struct<tool_name:string,server_id:string,args:string,seq:bigint,syscall:string,dest_ip:string,dest_port:int,pid:int,comm:string,path:string,payload_excerpt:string>, "
    f"value_overlap {HIT}, timeline array<struct<timeline_seq:int,ts_mono_ns:bigint,kind:string,label:string,ref:bigint>>, pod_context {POD}"
)
AUDIT = "kind string, reason string, ts_wall timestamp, session_id string, detail string"
OUTBOX = "id string, kind string, target string, payload string, status string"
#: Columns of an intermediate table that hold secrets or raw texts: no sink may have one of them.
NEVER_WRITTEN = {"value", "variants", "forms", "file_contents", "excerpt", "chunk", "chunks", "buffer"}
