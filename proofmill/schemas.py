"""Explicit schemas of every table. Nothing is inferred from data."""
from __future__ import annotations

ASSIGNMENT = "struct<name:string,label:string,config:map<string,string>,answer_path:string>"
CONFIG_FIELD = ("struct<key:string,kind:string,required:boolean,`min`:double,`max`:double,"
                "whole:boolean>")
PARAMETER = "struct<key:string,kind:string,`default`:double,`min`:double,`max`:double>"

CONTENT = ("name string; input string; expected_output string; model_output string; "
           f"assignments array<{ASSIGNMENT}>")

# DDL text, as `spark.read.schema` takes it
TABLES: dict[str, str] = {name: spec.replace(";", ",") for name, spec in {
    "datasets": "id string; name string; created_at timestamp",
    "dataset_rows": ("id string; dataset_id string; position int; input string; "
                     "expected_output string; model_output string"),
    "check_types": ("name string; category string; engine string; "
                    "engine_settings map<string,string>; comparison string; "
                    f"config_fields array<{CONFIG_FIELD}>"),
    "tests": ("id string; dataset_row_id string; name string; input string; "
              "expected_output string; model_output string; created_at timestamp"),
    "assignments": ("test_id string; label string; name string; config map<string,string>; "
                    "answer_path string"),
    "test_sets": "id string; name string; created_at timestamp",
    "set_entries": f"id string; test_set_id string; test_id string; {CONTENT}; snapshot_at timestamp",
    "test_plans": "id string; name string; created_at timestamp",
    "plan_links": "plan_id string; test_set_id string",
    "executions": ("id string; origin string; scope_id string; replayed_execution_id string; "
                   "batch_id string; batch_index int; created_at timestamp"),
    "runs": ("run_id string; test_id string; entry_id string; execution_id string; "
             "status string; error string; evaluated_output string; output_source string; "
             "batch_id string; batch_index int; skip_labels array<string>; "
             "created_at timestamp; executed_at timestamp"),
    "check_results": ("run_id string; batch_id string; entry_id string; batch_index int; "
                      "label string; test_type string; engine string; passed boolean; "
                      "score double; detail string; errored boolean"),
    "frozen_copies": f"id string; {CONTENT}; snapshot_at timestamp",
    "stat_tests": (f"id string; engine string; parameters array<{PARAMETER}>; "
                   "engine_settings map<string,string>"),
    "batches": ("id string; scope_kind string; scope_id string; engine string; "
                "parameters map<string,double>; times_requested int; "
                "waves_released int; looks array<int>; status string; created_at timestamp"),
    "comparisons": ("id string; batch_a string; batch_b string; engine string; "
                    "parameters map<string,double>; outcome string; created_at timestamp"),
}.items()}

# Fixed values
RUN_STATUSES = ("Pending", "Running", "Green", "Amber", "Red", "NotRan")
TERMINAL_STATUSES = ("Green", "Amber", "Red", "NotRan")
IN_FLIGHT_STATUSES = ("Pending", "Running")
EVALUATED_STATUSES = ("Green", "Amber", "Red")
BATCH_STATUSES = ("Pending", "Running", "Passed", "Failed", "Inconclusive", "NotRan",
                  "Incomplete", "Done")
COMPARISON_VERDICTS = ("better", "worse", "no_difference", "no_worse", "inconclusive", "none")
MAX_TIMES = 1000
MAX_RUNS = 10_000
POWER = 0.8
JUDGE_ENGINE = "llm_judge"
