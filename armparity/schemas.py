"""Record layouts of the call log and the gold corpus (fixed field names)."""

CALL = (
    "trace_id string, subagent string, provenance string, ts timestamp, model string, system_prompt_sha string, "
    "input struct<messages:array<string>,context_chunks:array<string>>, tools_offered array<string>, "
    "tool_calls array<struct<name:string,args:string>>, output struct<text:string,json:string>, "
    "usage struct<input_tokens:bigint,output_tokens:bigint,cached_tokens:bigint>, "
    "latency_ms struct<ttft:bigint,total:bigint>, status string, error string"
)
ITEM = (
    "item_id string, subagent string, customer string, domain string, provenance string, seed bigint, generator_version string, "
    "difficulty string, template_id string, core boolean, "
    "input struct<messages:array<string>,chunks:array<struct<chunk_id:string,text:string>>>, gold string, "
    "rubric array<struct<id:string,criterion:string>>, surface_source string"
)
CALL_REQUIRED = ("trace_id", "subagent", "model", "status")
ITEM_REQUIRED = ("item_id", "subagent", "gold")
#: Fixed values of two fields.
CALL_ALLOWED = {"status": ("ok", "error"), "provenance": ("synthetic", "customer")}
