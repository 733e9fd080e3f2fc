"""Read schemas. Fields missing from a log come back as NULL."""

from __future__ import annotations

ATTEMPT_DDL = (
    "episode_id string, problem_id string, model_id string, attempt int, max_attempts int, "
    "state string, exception_type string, stderr_excerpt string, stdout_excerpt string, "
    "feedback_tests_passed int, feedback_tests_total int, feedback_pass_rate double, "
    "delta_feedback_pass_rate double, runtime_ms int, memory_mb double, feedback_type string, "
    "previous_state string, dwell_time_current_state int, ordered_history array<string>, "
    "cumulative_state_counts map<string,int>, code_hash string, "
    "edit_distance_from_previous double, "
    "failing_input variant, expected_output variant, actual_output variant"
)

EPISODE_DDL = (
    "episode_id string, problem_id string, model_id string, max_attempts int, "
    f"trajectory array<struct<{ATTEMPT_DDL.replace(' ', ':').replace(',:', ',')}>>, "
    "final_hidden_tests_passed int, final_hidden_tests_total int, "
    "final_hidden_pass_rate double, final_outcome string, final_code_hash string, "
    "metadata struct<feedback_tests:int,hidden_tests:int,feedback_ratio:double,"
    "split_seed:bigint,episode_seed:bigint>"
)

PROBLEM_DDL = (
    "problem_id string, prompt string, entry_point string, "
    "tests array<struct<input:variant,expected:variant,test_id:string>>, metadata variant"
)
