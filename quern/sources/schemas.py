"""Explicit schemas of the JSON the engine reads. Nothing is inferred."""

from __future__ import annotations

VARIANT = "struct<type:string, query:string, description:string, onset_utc:string, onset_offset_seconds:bigint, onset_reasoning:string>"
METRIC = f"struct<metric_family:string, signal_layer:string, defining_labels:map<string,string>, variants:array<{VARIANT}>>"
LOG = "struct<name:string, count:bigint, description:string, cause:string, source:string, representative_attributes:map<string,string>, log_documents:array<struct<_index:string, _id:string, `@timestamp`:string>>>"
FRONTEND = "struct<description:string, route:string, deterministic:boolean, trigger_condition:string, symptom_type:string, source_file:string, source_line:bigint, calling_service:string, call_pattern:string, cause:string>"
TRACE = "struct<name:string, count:bigint, description:string, cause:string, call_chain:string, smoking_gun:array<string>, trace_documents:array<struct<traceID:string, `@timestamp`:string, user_action:string>>>"
INCIDENT = f"incident_time timestamp, feature_flag string, description string, mechanism string, interaction string, symptoms struct<metrics:array<{METRIC}>, logs:array<{LOG}>, frontend:array<{FRONTEND}>, traces:array<{TRACE}>>"

TOGGLE = "id string, category string, description string, day int, time string, action string, flag string, value string, wall_clock_utc timestamp"

VERDICT = (
    "mode string, nested struct<rubrics:array<struct<feature_flag:string, incident_time_within_10min:boolean, feature_flag_match:boolean, mechanism_match:boolean, score:int, "
    "symptoms:struct<metrics:array<struct<metric_family:string, family_match:boolean>>, logs:array<struct<body_match:boolean, service_name_match:boolean>>, traces:array<struct<call_chain_match:boolean, smoking_gun_match:boolean>>>>>>"
)

TRAJECTORY = (
    "steps array<struct<step_id:bigint, source:string, tool_calls:array<struct<tool_call_id:string, function_name:string, arguments:map<string,string>>>, "
    "observation:struct<results:array<struct<source_call_id:string, content:string>>>>>"
)

# Tag and field values keep their JSON type: a flag and the word for it are different things.
SPANS = (
    "traceID string, processes map<string,struct<serviceName:string>>, "
    "spans array<struct<spanID:string, processID:string, operationName:string, startTime:bigint, tags:array<struct<key:string, value:variant>>, logs:array<struct<fields:array<struct<key:string, value:variant>>>>>>"
)

AGENT = "struct<name:string, model_name:string, kwargs:struct<reasoning_effort:string>>"
TRIAL_CONFIG = f"agent {AGENT}, task struct<name:string, ref:string>"
BATCH_CONFIG = f"agents array<{AGENT}>"
CALL = "log_event_type string, model string, original_response string"
USAGE = "prompt_tokens bigint, completion_tokens bigint, cache_read_input_tokens bigint, cache_creation struct<ephemeral_5m_input_tokens:bigint, ephemeral_1h_input_tokens:bigint>"
RESPONSE = f"model string, usage struct<{USAGE.replace(' bigint', ':bigint').replace('cache_creation struct', 'cache_creation:struct')}>"
SCORE = "struct<trial_id:string, task_name:string, mode:string, reward:double, rca_accuracy:int, hallucinate_any:int>"
