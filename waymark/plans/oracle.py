"""Independent SQL for the catalog, run by another engine on the same tables."""

from __future__ import annotations

# --- fixed values, written out here so that the queries are not checked against their own lists ---
ALL_STATES = """
  SECURITY_VIOLATION EMPTY_OR_INCOMPLETE_CODE SYNTAX_ERROR IMPORT_ERROR TIMEOUT MEMORY_ERROR NAME_ATTRIBUTE_ERROR
  TYPE_VALUE_ERROR INDEX_KEY_ERROR ZERO_DIVISION_ERROR OUTPUT_FORMAT_ERROR WRONG_ALGORITHM PARTIAL_PASS NEAR_MISS
  ASSERTION_FAILURE FEEDBACK_PASS TERMINAL_UNRESOLVED""".split()
NOT_RUN = """
  SYNTAX_ERROR IMPORT_ERROR NAME_ATTRIBUTE_ERROR TYPE_VALUE_ERROR INDEX_KEY_ERROR ZERO_DIVISION_ERROR TIMEOUT
  MEMORY_ERROR EMPTY_OR_INCOMPLETE_CODE SECURITY_VIOLATION""".split()
RAN_AND_FAILED = "WRONG_ALGORITHM PARTIAL_PASS NEAR_MISS ASSERTION_FAILURE OUTPUT_FORMAT_ERROR".split()
ENDS = "FEEDBACK_PASS SECURITY_VIOLATION TERMINAL_UNRESOLVED".split()
NO_ERROR = "FEEDBACK_PASS TERMINAL_UNRESOLVED".split()
HEADER = "The submitted code failed its feedback tests. Measured facts follow."
# only the states that the tables give
OPENING = {
    "SYNTAX_ERROR": "The code could not be parsed.",
    "TYPE_VALUE_ERROR": "An operation met a value or type it cannot handle.",
    "WRONG_ALGORITHM": "The code ran, but every feedback test failed.",
    "PARTIAL_PASS": "The code ran, and some feedback tests failed.",
    "NEAR_MISS": "The code ran, and all feedback tests but one passed.",
    "TIMEOUT": "The code ran longer than allowed.",
    "SECURITY_VIOLATION": "The code tried something that is not permitted.",
}
CLOSING = {
    "SYNTAX_ERROR": "Return code that parses.",
    "TYPE_VALUE_ERROR": "Handle the inputs the task describes.",
    "WRONG_ALGORITHM": "Rethink the approach.",
    "PARTIAL_PASS": "Cover the failing cases too.",
    "NEAR_MISS": "Fix this one case and keep the rest.",
    "TIMEOUT": "Make the code faster.",
    "SECURITY_VIOLATION": "Use plain computation only.",
}
FIRST_PROMPT = "Write the Python function described below. Answer with one ```python block and nothing else."
NEXT_PROMPT = (
    "The last answer did not pass. Use the attempts and test results below to correct it. "
    "Answer with one ```python block and nothing else."
)
# ------------------------------------------------------------------------------------------------

BIND = """WITH r AS (
  SELECT user_id, event_id, event_type,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS rn
  FROM events),
c AS (
  SELECT user_id, event_id, event_type, CAST(floor(rn / 5.0) AS INT) AS chunk, rn % 5 AS pos FROM r),
m AS (
  SELECT concat('u', user_id, '-', chunk) AS episode_id,
         concat('p', CAST(floor(user_id / 2.0) AS INT), '-', chunk) AS problem_id,
         concat('m', user_id % 2) AS model_id, CAST(user_id % 3 AS INT) AS seed, pos, event_id,
         CASE event_type
           WHEN 'purchase' THEN 'FEEDBACK_PASS' WHEN 'signup' THEN 'NEAR_MISS'
           WHEN 'click' THEN 'PARTIAL_PASS' WHEN 'view' THEN 'WRONG_ALGORITHM'
           ELSE CASE WHEN event_id % 8 = 0 THEN 'SECURITY_VIOLATION'
                     WHEN event_id % 8 <= 3 THEN 'SYNTAX_ERROR'
                     WHEN event_id % 8 <= 5 THEN 'TYPE_VALUE_ERROR' ELSE 'TIMEOUT' END
         END AS state
  FROM c),
t AS (
  SELECT *, max(CASE WHEN state IN ('FEEDBACK_PASS', 'SECURITY_VIOLATION') THEN 1 ELSE 0 END)
              OVER (PARTITION BY episode_id ORDER BY pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done
  FROM m),
k AS (
  SELECT episode_id, problem_id, model_id, seed, pos, pos + 1 AS attempt, event_id, state,
         CAST(CASE state WHEN 'FEEDBACK_PASS' THEN 4 WHEN 'NEAR_MISS' THEN 3
                         WHEN 'PARTIAL_PASS' THEN 1 + event_id % 2 ELSE 0 END AS INT) AS passed,
         row_number() OVER (PARTITION BY episode_id ORDER BY pos DESC) AS back
  FROM t WHERE coalesce(done, 0) = 0),
attempts AS (
  SELECT episode_id, problem_id, model_id, seed, pos, attempt, 5 AS max_attempts, state, passed,
         4 AS total, passed / CAST(4 AS DOUBLE) AS feedback_pass_rate, event_id
  FROM k
  UNION ALL
  SELECT episode_id, problem_id, model_id, seed, pos + 1, 5, 5, 'TERMINAL_UNRESOLVED', passed,
         4, passed / CAST(4 AS DOUBLE), event_id
  FROM k WHERE back = 1 AND state NOT IN ('FEEDBACK_PASS', 'SECURITY_VIOLATION')),
outcomes AS (
  SELECT episode_id, problem_id, model_id, seed,
         CASE WHEN state = 'FEEDBACK_PASS' AND event_id % 5 <> 0 THEN 'FINAL_PASS'
              WHEN state IN ('SYNTAX_ERROR', 'TYPE_VALUE_ERROR', 'TIMEOUT', 'SECURITY_VIOLATION') THEN 'FINAL_ERROR'
              WHEN state = 'NEAR_MISS' AND event_id % 7 = 0 THEN 'FINAL_PASS'
              ELSE 'FINAL_FAIL' END AS final_outcome
  FROM k WHERE back = 1),
episodes AS (
  SELECT *, CASE final_outcome WHEN 'FINAL_PASS' THEN 1.0::DOUBLE WHEN 'FINAL_FAIL' THEN 0.5::DOUBLE
                               ELSE 0.0::DOUBLE END AS hidden_rate
  FROM outcomes),
seq AS (
  SELECT *, lag(state) OVER e AS prev_state, lead(state) OVER e AS next_state,
         lag(feedback_pass_rate) OVER e AS prev_rate
  FROM attempts WINDOW e AS (PARTITION BY episode_id ORDER BY pos)),
firsts AS (
  SELECT e.*, f.first_pos, n.n_real
  FROM episodes e
  LEFT JOIN (SELECT episode_id, min(pos) AS first_pos FROM attempts
             WHERE state = 'FEEDBACK_PASS' GROUP BY 1) f USING (episode_id)
  JOIN (SELECT episode_id, count(*) FILTER (state <> 'TERMINAL_UNRESOLVED') AS n_real
        FROM attempts GROUP BY 1) n USING (episode_id)),
islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY episode_id, state ORDER BY pos) AS island
  FROM attempts),
problem_values AS (
  SELECT model_id, problem_id,
         CAST(final_outcome = 'FINAL_PASS' AS INT)::DOUBLE AS final_pass,
         CAST(first_pos IS NOT NULL AS INT)::DOUBLE AS feedback_success,
         CAST(coalesce(first_pos >= 1, false) AS INT)::DOUBLE AS recovered,
         hidden_rate AS hidden_pass_rate
  FROM firsts),
long_values AS (
  SELECT model_id, problem_id, u.metric, u.value
  FROM (SELECT model_id, problem_id, unnest([
          {'metric': 'final_pass', 'value': final_pass},
          {'metric': 'feedback_success', 'value': feedback_success},
          {'metric': 'recovered', 'value': recovered},
          {'metric': 'hidden_pass_rate', 'value': hidden_pass_rate}]) AS u
        FROM problem_values)),
pairs AS (
  SELECT a.metric, a.problem_id, a.value AS value_a, b.value AS value_b, a.value - b.value AS diff
  FROM long_values a JOIN long_values b
    ON a.metric = b.metric AND a.problem_id = b.problem_id AND a.model_id = 'm0' AND b.model_id = 'm1'),
curve AS (
  SELECT s.seed, k.k, round_even(count(*) FILTER (s.first_pos < k.k) / count(*), 4) AS value
  FROM firsts s
  JOIN (SELECT seed, unnest(generate_series(1, max(n_real))) AS k FROM firsts GROUP BY seed) k
    ON s.seed = k.seed
  GROUP BY 1, 2),
headline AS (
  SELECT seed, 'feedback_success_rate' AS metric, count(first_pos) / count(*) AS value
  FROM firsts GROUP BY 1
  UNION ALL
  SELECT seed, 'hidden_pass_rate', count(*) FILTER (final_outcome = 'FINAL_PASS') / count(*)
  FROM firsts GROUP BY 1
  UNION ALL
  SELECT seed, concat('pass_at_', k), value FROM curve),
variance AS (
  SELECT metric, round_even(avg(value), 4) AS mean,
         round_even(coalesce(stddev_samp(value), 0.0), 4) AS std,
         round_even(min(value), 4) AS min, round_even(max(value), 4) AS max,
         count(*) AS n_seeds,
         concat(printf('%.3f', avg(value)), ' ± ', printf('%.3f', coalesce(stddev_samp(value), 0.0)))
           AS mean_pm_std
  FROM headline GROUP BY 1),
pass_k AS (
  SELECT k.k, round_even(count(*) FILTER (s.first_pos < k.k) / count(*), 4) AS feedback_pass_at_k,
         round_even(count(*) FILTER (s.final_outcome = 'FINAL_PASS') / count(*), 4) AS hidden_pass_rate
  FROM firsts s
  JOIN (SELECT unnest(generate_series(1, max(n_real))) AS k FROM firsts) k ON true
  GROUP BY 1),
moves AS (
  SELECT state AS source_state, next_state AS destination_state, count(*) AS count
  FROM seq WHERE next_state IS NOT NULL GROUP BY 1, 2),
probs AS (
  SELECT *, count / sum(count) OVER (PARTITION BY source_state) AS probability FROM moves),
draws AS (
  SELECT p.metric, g.rep,
         ('0x' || substr(md5(concat('0:', g.rep, ':', p.problem_id)), 1, 8))::BIGINT
           % count(*) OVER (PARTITION BY p.metric, g.rep) AS pick
  FROM pairs p CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS rep) g),
sorted_pairs AS (
  SELECT metric, diff, row_number() OVER (PARTITION BY metric ORDER BY diff, problem_id) - 1 AS i
  FROM pairs),
replicates AS (
  SELECT d.metric, d.rep, avg(s.diff) AS mean
  FROM draws d JOIN sorted_pairs s ON d.metric = s.metric AND d.pick = s.i
  GROUP BY 1, 2)
"""

_STATES = ", ".join(f"'{s}'" for s in ALL_STATES)
_IN = {
    "is_non_runnable": NOT_RUN,
    "is_runnable_failure": RAN_AND_FAILED,
    "is_terminal": ENDS,
}
_SP = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _members(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{_SP}+', ''), '{_SP}+$', '')"


def _policy(pos: str = "pos") -> str:
    return (
        f"[' Structured ', 'binary', 'error_category', 'RAW_TERMINAL', 'counterexample'][{pos} % 5 + 1]"
    )


def _texts(table: dict[str, str], state: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {state} {cases} END"


_ATTEMPT = (
    "a.episode_id, a.problem_id, a.model_id, a.pos, a.attempt, a.max_attempts, a.state, "
    "a.passed AS feedback_tests_passed, a.total AS feedback_tests_total, a.feedback_pass_rate, "
    "e.final_outcome, e.hidden_rate AS final_hidden_pass_rate"
)

ORACLE: dict[str, str] = {}


def _bound(name: str, sql: str) -> None:
    ORACLE[name] = BIND + sql


_bound("flatten_attempts", f"SELECT {_ATTEMPT} FROM attempts a JOIN episodes e USING (episode_id)")
ORACLE["json_roundtrip"] = ORACLE["flatten_attempts"]
_bound(
    "assemble_episodes",
    """SELECT e.episode_id, e.problem_id, e.model_id, e.final_outcome,
              string_agg(a.state, '>' ORDER BY a.pos) AS states
       FROM episodes e JOIN attempts a USING (episode_id) GROUP BY 1, 2, 3, 4""",
)
_bound(
    "real_attempts",
    """SELECT episode_id, problem_id, model_id, pos, attempt, max_attempts, state
       FROM attempts WHERE state <> 'TERMINAL_UNRESOLVED'""",
)
_bound(
    "truncate_and_sentinel",
    "SELECT episode_id, pos, attempt, state, passed AS feedback_tests_passed FROM attempts",
)
_bound(
    "dwell_counter",
    """SELECT episode_id, pos, state,
              row_number() OVER (PARTITION BY episode_id, state, island ORDER BY pos) AS dwell_time_current_state
       FROM islands""",
)
_bound(
    "ordered_history",
    """SELECT episode_id, pos, string_agg(state, '>') OVER (PARTITION BY episode_id ORDER BY pos
              ROWS UNBOUNDED PRECEDING) AS history FROM attempts""",
)
_bound(
    "cumulative_counts",
    """SELECT episode_id, pos, string_agg(concat(state, '=', n), ',' ORDER BY concat(state, '=', n)) AS counts
       FROM (SELECT a.episode_id, a.pos, b.state, count(*) AS n
             FROM attempts a JOIN attempts b ON a.episode_id = b.episode_id AND b.pos <= a.pos
             GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
_bound(
    "previous_state_delta",
    """SELECT episode_id, pos, prev_state AS previous_state,
              coalesce(feedback_pass_rate - prev_rate, 0.0) AS delta_feedback_pass_rate FROM seq""",
)
_bound(
    "state_classes",
    f"SELECT episode_id, pos, state, list_position([{_STATES}], state) - 1 AS priority, "
    + ", ".join(f"state IN {_members(v)} AS {k}" for k, v in _IN.items())
    + f", state NOT IN {_members(NO_ERROR)} AS is_error FROM attempts",
)
_bound(
    "pass_count_class",
    """SELECT episode_id, pos, passed, passed + pos % 3 AS total,
              CASE WHEN passed + pos % 3 = 0 THEN 'ASSERTION_FAILURE' WHEN passed = 0 THEN 'WRONG_ALGORITHM'
                   WHEN pos % 3 <= 1 THEN 'NEAR_MISS' ELSE 'PARTIAL_PASS' END AS class,
              CASE WHEN passed + pos % 3 = 0 THEN 0.0::DOUBLE
                   ELSE passed / CAST(passed + pos % 3 AS DOUBLE) END AS pass_rate
       FROM attempts""",
)
ORACLE["exception_class"] = """SELECT event_id, ['IMPORT_ERROR', 'IMPORT_ERROR', 'NAME_ATTRIBUTE_ERROR',
  'NAME_ATTRIBUTE_ERROR', 'NAME_ATTRIBUTE_ERROR', 'TYPE_VALUE_ERROR', 'TYPE_VALUE_ERROR',
  'INDEX_KEY_ERROR', 'INDEX_KEY_ERROR', 'ZERO_DIVISION_ERROR', 'MEMORY_ERROR',
  'TYPE_VALUE_ERROR'][event_id % 12 + 1] AS state FROM events"""
_bound(
    "final_outcome",
    f"""SELECT episode_id, pos, CASE WHEN state = 'FEEDBACK_PASS' THEN 'FINAL_PASS'
          WHEN state IN {_members(RAN_AND_FAILED)} THEN 'FINAL_FAIL' ELSE 'FINAL_ERROR' END AS outcome
        FROM attempts""",
)
_bound(
    "feedback_type",
    """SELECT episode_id, pos, CASE
         WHEN state IN ('FEEDBACK_PASS', 'SECURITY_VIOLATION') THEN 'NONE'
         WHEN pos % 5 = 1 THEN 'BINARY_FEEDBACK' WHEN pos % 5 = 2 THEN 'ERROR_CATEGORY_FEEDBACK'
         WHEN pos % 5 = 3 THEN 'RAW_TERMINAL_FEEDBACK'
         WHEN state IN ('WRONG_ALGORITHM', 'PARTIAL_PASS', 'NEAR_MISS') THEN 'COUNTEREXAMPLE_FEEDBACK'
         ELSE 'STRUCTURED_FEEDBACK' END AS feedback_type FROM attempts""",
)
_bound(
    "state_frequencies",
    """SELECT state, count(*) AS frequency, count(*) / sum(count(*)) OVER () AS percentage
       FROM attempts GROUP BY 1""",
)
_bound("transition_table", "SELECT * FROM probs")


def _cells(finish) -> str:
    seen = "(SELECT list(DISTINCT source_state) FROM probs)"
    to = "(SELECT list(DISTINCT destination_state) FROM probs)"
    cells = []
    for s in ALL_STATES:
        p = f"max(p.probability) FILTER (p.destination_state = '{s}')"
        cells.append(f"{finish(s, p, seen, to)} AS {s}")
    return (
        f"SELECT v.s AS source_state, {', '.join(cells)} "
        f"FROM (SELECT unnest([{_STATES}]) AS s) v LEFT JOIN probs p ON p.source_state = v.s GROUP BY 1"
    )


_bound(
    "transition_matrix",
    _cells(
        lambda s, p, seen, to: f"CASE WHEN list_contains({seen}, v.s) AND list_contains({to}, '{s}') "
        f"THEN {p} ELSE 0.0 END"
    ),
)
_bound(
    "transition_percent",
    _cells(lambda s, p, seen, to: f"CASE WHEN {p} > 0 THEN round_even({p} * 100, 1) END"),
)
_bound(
    "recovery_by_state",
    """SELECT s.state, count(*) AS episodes_with_state,
              count(*) FILTER (f.first_pos > s.pos) / count(*) AS feedback_recovery_rate_within_k,
              count(*) FILTER (f.final_outcome = 'FINAL_PASS') / count(*) AS hidden_success_rate_given_state,
              1.0 - count(*) FILTER (f.first_pos > s.pos) / count(*) AS unresolved_rate,
              CASE WHEN count(next_state) > 0
                   THEN count(*) FILTER (next_state = 'FEEDBACK_PASS') / count(next_state) ELSE 0.0 END
                AS one_step_recovery_rate,
              CASE WHEN count(next_state) > 0
                   THEN count(*) FILTER (next_state = s.state) / count(next_state) ELSE 0.0 END
                AS persistence_rate
       FROM seq s JOIN firsts f USING (episode_id)
       WHERE s.state NOT IN ('FEEDBACK_PASS', 'TERMINAL_UNRESOLVED') GROUP BY 1""",
)
_bound(
    "dwell_time_summary",
    """SELECT state, sum(len)::BIGINT AS attempt_count, median(len) AS median_dwell_time,
              avg(len) AS mean_dwell_time, max(len) AS max_observed_dwell
       FROM (SELECT episode_id, state, island, count(*) AS len FROM islands GROUP BY 1, 2, 3) GROUP BY 1""",
)
_bound(
    "regression_summary",
    f"""SELECT episode_id, problem_id, model_id, transitions, test_pass_regressions, runnability_regressions,
          CASE WHEN transitions > 0 THEN test_pass_regressions / transitions ELSE 0.0 END AS test_pass_regression_rate,
          CASE WHEN transitions > 0 THEN runnability_regressions / transitions ELSE 0.0 END AS runnability_regression_rate
        FROM (SELECT episode_id, problem_id, model_id, count(*) - 1 AS transitions,
                count(*) FILTER (feedback_pass_rate < prev_rate) AS test_pass_regressions,
                count(*) FILTER (prev_state IN {_members(RAN_AND_FAILED)}
                                 AND state IN {_members(NOT_RUN)}) AS runnability_regressions
              FROM seq GROUP BY 1, 2, 3)""",
)
_bound(
    "hidden_generalization",
    """SELECT CASE WHEN first_pos IS NULL THEN 'NO_FEEDBACK_PASS' ELSE 'FEEDBACK_PASS' END AS feedback_loop_group,
              count(*) AS episodes, count(*) FILTER (final_outcome = 'FINAL_PASS') AS hidden_pass_count,
              count(*) FILTER (final_outcome = 'FINAL_PASS') / count(*) AS hidden_success_rate
       FROM firsts GROUP BY 1""",
)
_bound(
    "recovery_source_states",
    """SELECT prev_state AS source_state, count(*) AS recoveries,
              round_even(count(*) / sum(count(*)) OVER (), 4) AS pct_of_recoveries
       FROM seq s JOIN firsts f ON s.episode_id = f.episode_id AND s.pos = f.first_pos
       WHERE prev_state IS NOT NULL GROUP BY 1""",
)
_bound(
    "recovery_by_attempt",
    """, hits AS (SELECT first_pos + 1 AS attempt, count(*) AS n FROM firsts WHERE first_pos IS NOT NULL GROUP BY 1)
       SELECT g.attempt, coalesce(n, 0) AS first_pass_count, g.attempt >= 2 AS is_recovery,
              CASE WHEN g.attempt >= 2 THEN round_even(coalesce(n, 0) / total, 4) ELSE 0.0 END AS pct_of_recoveries,
              round_even(sum(CASE WHEN g.attempt >= 2 THEN coalesce(n, 0) ELSE 0 END)
                         OVER (ORDER BY g.attempt) / total, 4) AS cumulative_pct_recoveries
       FROM (SELECT unnest(generate_series(1, max(attempt))) AS attempt FROM hits) g
       LEFT JOIN hits h ON h.attempt = g.attempt,
       (SELECT sum(n) FILTER (attempt >= 2) AS total FROM hits)""",
)
_bound("pass_at_k", "SELECT * FROM pass_k")
_bound(
    "success_rates",
    """SELECT count(*) AS episodes, count(first_pos) / count(*) AS feedback_success_rate,
              count(*) FILTER (final_outcome = 'FINAL_PASS') / count(*) AS hidden_pass_rate FROM firsts""",
)
_bound("per_problem_metrics", "SELECT * FROM problem_values")
_bound("headline_by_seed", "SELECT * FROM headline")
_bound("seed_variance", "SELECT * FROM variance")
_bound(
    "pass_at_k_error_bars",
    """SELECT p.*, coalesce(v.std, 0.0) AS std FROM pass_k p
       LEFT JOIN variance v ON v.metric = concat('pass_at_', p.k)""",
)
_bound("paired_runs", "SELECT * FROM pairs")
_bound("bootstrap_replicates", "SELECT * FROM replicates")
_bound(
    "paired_bootstrap",
    """SELECT metric, max(mean) FILTER (i = 5) AS ci_low, max(mean) FILTER (i = 194) AS ci_high,
              least(1.0, 2.0 * least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) / 200.0)::DOUBLE
                AS bootstrap_p
       FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean) - 1 AS i FROM replicates)
       GROUP BY 1""",
)
_bound(
    "mcnemar",
    """, d AS (SELECT metric, count(*) FILTER (value_a = 1 AND value_b = 0) AS only_a,
                      count(*) FILTER (value_a = 0 AND value_b = 1) AS only_b
               FROM pairs WHERE metric <> 'hidden_pass_rate' GROUP BY 1)
       SELECT metric, only_a, only_b, round(least(1.0, 2.0 * sum(exp(
                lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1)
                - (only_a + only_b) * ln(2.0)))), 6) AS p_value
       FROM (SELECT *, unnest(generate_series(0, least(only_a, only_b))) AS i FROM d)
       GROUP BY 1, 2, 3""",
)
_bound(
    "wilcoxon",
    """, z AS (SELECT metric, diff, abs(diff) AS size FROM pairs WHERE diff <> 0),
       ranks AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY size)
                          + (count(*) OVER (PARTITION BY metric, size) - 1) / 2.0::DOUBLE AS rk FROM z),
       ties AS (SELECT metric, sum(t * t * t - t)::DOUBLE AS tie_term
                FROM (SELECT metric, size, count(*)::DOUBLE AS t FROM z GROUP BY 1, 2) GROUP BY 1)
       SELECT metric, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END)::DOUBLE AS w_plus,
              sum(CASE WHEN diff < 0 THEN rk ELSE 0 END)::DOUBLE AS w_minus,
              count(*) AS n_nonzero, any_value(tie_term) AS tie_term
       FROM ranks JOIN ties USING (metric) GROUP BY 1""",
)

# --- resampling by a tree of binomial splits, three levels deep as there are at most eight values ----


def _hashed(x: str) -> str:
    """Two rounds of a multiplicative hash of a 32-bit number, then a last shift."""
    return (
        f"list_reduce([({x})::BIGINT, 1, 1, 0], lambda a, more: CASE WHEN more = 1 "
        "THEN (xor(a, a >> 16) * 73244475) & 4294967295 ELSE xor(a, a >> 16) END)"
    )


def _uniform(start: str, rep: str, lo: str, hi: str) -> str:
    h = _hashed(f"xor({start}, {rep})")
    for bound in (lo, hi):
        h = _hashed(f"xor({h}, {_hashed(bound)})")
    low = _hashed(f"xor({h}, 1)")
    return f"({h} * 2097152.0::DOUBLE + ({low} >> 11) + 0.5::DOUBLE) / 9007199254740992.0::DOUBLE"


def _tree(n_boot: int, metrics: str = "true") -> str:
    """CTE ``means``: metric, rep, mean."""
    out = f"""
, leaf AS (SELECT metric, diff, count(*) AS n, row_number() OVER (PARTITION BY metric ORDER BY diff) - 1 AS i
           FROM pairs WHERE {metrics} GROUP BY 1, 2),
root AS (SELECT metric, sum(n)::BIGINT AS n, count(*) AS d, ('0x' || substr(md5(metric), 1, 8))::BIGINT AS start FROM leaf GROUP BY 1),
t0 AS (SELECT metric, start, rep, 0::BIGINT AS lo, d AS hi, n AS m
       FROM root CROSS JOIN (SELECT unnest(generate_series(0, {n_boot - 1})) AS rep) g)"""
    for k in range(3):
        out += f""",
q{k} AS (SELECT t.metric, t.lo, t.hi, sum(leaf.n) FILTER (i < (t.lo + t.hi) // 2) / sum(leaf.n)::DOUBLE AS p
         FROM (SELECT DISTINCT metric, lo, hi FROM t{k} WHERE hi - lo > 1) t
         JOIN leaf ON leaf.metric = t.metric AND i >= t.lo AND i < t.hi GROUP BY 1, 2, 3),
k{k} AS (SELECT q.*, m, unnest(generate_series(0, m)) AS k
         FROM q{k} q JOIN (SELECT DISTINCT metric, lo, hi, m FROM t{k}) USING (metric, lo, hi)),
c{k} AS (SELECT metric, lo, hi, m, k, coalesce(sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1)
                + k * ln(p) + (m - k) * ln(1 - p))) OVER (PARTITION BY metric, lo, hi, m ORDER BY k
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS below FROM k{k}),
u{k} AS (SELECT t.*, {_uniform("start", "rep", "lo", "hi")} AS u FROM t{k} t WHERE hi - lo > 1),
h{k} AS (SELECT u.*, c.k FROM u{k} u ASOF JOIN c{k} c
         ON u.metric = c.metric AND u.lo = c.lo AND u.hi = c.hi AND u.m = c.m AND u.u > c.below),
t{k + 1} AS (SELECT metric, start, rep, lo, hi, m FROM t{k} WHERE hi - lo = 1
             UNION ALL SELECT metric, start, rep, lo, (lo + hi) // 2, k FROM h{k}
             UNION ALL SELECT metric, start, rep, (lo + hi) // 2, hi, m - k FROM h{k})"""
    return out + """,
means AS (SELECT t.metric, t.rep, sum(t.m * leaf.diff) / any_value(root.n) AS mean
          FROM t3 t JOIN leaf ON leaf.metric = t.metric AND leaf.i = t.lo JOIN root ON root.metric = t.metric GROUP BY 1, 2)"""


_bound("bootstrap_tree", _tree(200) + " SELECT metric, rep, mean FROM means")

# erfc by the series of erf whose terms are all positive; beyond 6 it is below 1e-16
_ERFC = """(1 - 2 / sqrt(pi()) * (SELECT sum(exp(2 * j * ln(2.0::DOUBLE) + (2 * j + 1) * ln(greatest(least({x}, 6.0), 1e-300)) - lgamma(2 * j + 2)
  + lgamma(j + 1) - least({x}, 6.0) * least({x}, 6.0))) FROM (SELECT unnest(generate_series(0, 250)) AS j) js))"""
_WILCOXON = f"""
, zd AS (SELECT metric, diff, abs(diff) AS size FROM pairs WHERE diff <> 0),
zr AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY size)
                 + (count(*) OVER (PARTITION BY metric, size) - 1) / 2.0::DOUBLE AS rk FROM zd),
zt AS (SELECT metric, sum(t * t * t - t)::DOUBLE AS tie_term
       FROM (SELECT metric, size, count(*)::DOUBLE AS t FROM zd GROUP BY 1, 2) GROUP BY 1),
zw AS (SELECT metric, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END)::DOUBLE AS w_plus,
              sum(CASE WHEN diff < 0 THEN rk ELSE 0 END)::DOUBLE AS w_minus, count(*)::DOUBLE AS n, any_value(tie_term) AS tie_term
       FROM zr JOIN zt USING (metric) GROUP BY 1),
zx AS (SELECT *, abs(least(w_plus, w_minus) - n * (n + 1) / 4)
              / sqrt(2 * (n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24) AS x FROM zw),
zp AS (SELECT metric, {_ERFC.format(x="x")} AS wilcoxon_p FROM zx)"""
# all differences here are tied, so "auto" takes the normal form
_bound(
    "wilcoxon_p_values",
    _WILCOXON + " SELECT metric, round(wilcoxon_p, 6) AS p_value, round(wilcoxon_p, 6) AS p_normal FROM zp",
)
_N_BOOT = 10_000
_COMPARED = f"""
, ci AS (SELECT metric, max(mean) FILTER (i = {int(0.025 * _N_BOOT)}) AS ci_low, max(mean) FILTER (i = {int(0.975 * _N_BOOT) - 1}) AS ci_high,
           least(1.0, 2.0 * least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) / {_N_BOOT}.0)::DOUBLE AS bootstrap_p
         FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean) - 1 AS i FROM means) GROUP BY 1),
avgs AS (SELECT metric, count(*) AS n, avg(value_a) AS mean_a, avg(value_b) AS mean_b FROM pairs GROUP BY 1),
disc AS (SELECT metric, count(*) FILTER (value_a = 1 AND value_b = 0) AS only_a,
                count(*) FILTER (value_a = 0 AND value_b = 1) AS only_b
         FROM pairs WHERE metric <> 'hidden_pass_rate' GROUP BY 1),
mc AS (SELECT metric, least(1.0, 2.0 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1)
                - (only_a + only_b) * ln(2.0)))) AS mcnemar_p
       FROM (SELECT *, unnest(generate_series(0, least(only_a, only_b))) AS i FROM disc WHERE only_a + only_b > 0) GROUP BY metric),
told AS (SELECT * FROM avgs LEFT JOIN ci USING (metric) LEFT JOIN zp USING (metric) LEFT JOIN mc USING (metric))"""


def _three(x: str, sign: str = "") -> str:
    """Three decimals, rounded half away from zero."""
    return f"printf('%{sign}.3f', round(({x})::DECIMAL(18, 9), 3)::DOUBLE)"


_bound(
    "compare_runs",
    _tree(_N_BOOT) + _WILCOXON + _COMPARED
    + f""" SELECT metric, round_even(mean_a, 4) AS m0_mean, round_even(mean_b, 4) AS m1_mean, round_even(mean_a - mean_b, 4) AS difference,
  concat('[', {_three("round_even(ci_low, 4)", "+")}, ', ', {_three("round_even(ci_high, 4)", "+")}, ']') AS ci_95,
  round_even(bootstrap_p, 4) AS bootstrap_p, round_even(wilcoxon_p, 4) AS wilcoxon_p, round_even(mcnemar_p, 4) AS mcnemar_p,
  CASE WHEN ci_low > 0 OR ci_high < 0 THEN 'yes' ELSE 'no' END AS significant FROM told""",
)
_bound(
    "compare_two_runs",
    _tree(_N_BOOT, "metric = 'hidden_pass_rate'") + _WILCOXON + _COMPARED
    + f""" SELECT metric, 'm0' AS label_a, 'm1' AS label_b, n AS n_paired_problems, round_even(mean_a, 4) AS mean_a,
  round_even(mean_b, 4) AS mean_b, round_even(mean_a - mean_b, 4) AS mean_difference,
  round_even(ci_low, 4) AS bootstrap_ci_low, round_even(ci_high, 4) AS bootstrap_ci_high,
  round_even(bootstrap_p, 4) AS bootstrap_p_value, round_even(wilcoxon_p, 4) AS wilcoxon_p_value, NULL::DOUBLE AS mcnemar_p_value,
  ci_low > 0 OR ci_high < 0 AS significant_at_95,
  concat('metric ''', metric, ''': mean of m0 ', {_three("mean_a")}, ', mean of m1 ', {_three("mean_b")}, '; m0 is ',
    CASE WHEN mean_a >= mean_b THEN 'ahead' ELSE 'behind' END, ' by ', {_three("abs(mean_a - mean_b)")},
    ', resampled interval ', {_three("ci_low")}, ' to ', {_three("ci_high")}, '; p from resampling ', {_three("bootstrap_p")},
    ', signed ranks ', {_three("wilcoxon_p")}) AS summary,
  NULL::VARCHAR AS error FROM told WHERE metric = 'hidden_pass_rate'""",
)
_counts = ", ".join(f"len(list_filter(hist, lambda x: x = '{s}'))::INT AS count_{s}" for s in ALL_STATES)
_bound(
    "transition_dataset",
    f""", h AS (SELECT s.*, i.dwell, list(s.state) OVER (PARTITION BY s.episode_id ORDER BY s.pos
                       ROWS UNBOUNDED PRECEDING) AS hist
              FROM seq s JOIN (SELECT episode_id, pos, row_number() OVER (
                  PARTITION BY episode_id, state, island ORDER BY pos) AS dwell FROM islands) i
                ON s.episode_id = i.episode_id AND s.pos = i.pos)
        SELECT h.episode_id, h.problem_id, h.model_id, h.state AS current_state, next_state, attempt,
               attempt / 5.0::DOUBLE AS attempt_normalized, dwell AS dwell_time_current_state,
               CASE WHEN h.state IN ('FEEDBACK_PASS', 'SECURITY_VIOLATION') THEN 'NONE'
                    WHEN h.state IN ('WRONG_ALGORITHM', 'PARTIAL_PASS', 'NEAR_MISS') THEN 'COUNTEREXAMPLE_FEEDBACK'
                    ELSE 'STRUCTURED_FEEDBACK' END AS feedback_type,
               feedback_pass_rate, coalesce(feedback_pass_rate - prev_rate, 0.0) AS delta_feedback_pass_rate,
               final_outcome,
               coalesce(hist[-3], 'START') AS history_1, coalesce(hist[-2], 'START') AS history_2,
               hist[-1] AS history_3, {_counts}
        FROM h JOIN episodes e USING (episode_id) WHERE next_state IS NOT NULL""",
)

# --- what the model fits read -------------------------------------------------

_TRANSITIONS = ORACLE["transition_dataset"].removeprefix(BIND).strip().removeprefix(",").strip()
_AT = _TRANSITIONS.rindex("SELECT h.episode_id")
_FOLDED = f""", {_TRANSITIONS[:_AT].strip()},
h_rows AS ({_TRANSITIONS[_AT:]}),
sized AS (SELECT episode_id, count(*) AS n FROM h_rows GROUP BY 1),
folds AS (SELECT episode_id, n, (row_number() OVER (ORDER BY n DESC, ('0x' || substr(md5(episode_id), 1, 15))::BIGINT, episode_id) - 1) % 5 AS fold
          FROM sized)"""
_bound("fold_assignment", _FOLDED + " SELECT episode_id, n AS n_transitions, fold FROM folds")
_HISTORY = ["history_1", "history_2", "history_3"]
_STATE_COUNTS = [f"count_{s}" for s in ALL_STATES]
_FEATURES = {
    "first_order": ["current_state"],
    "higher_order": ["current_state", *_HISTORY],
    "count_augmented": ["current_state", *_STATE_COUNTS],
    "duration_dependent": ["current_state", "dwell_time_current_state"],
    "full": [
        "current_state", "attempt", "attempt_normalized", "dwell_time_current_state", "feedback_type", "feedback_pass_rate",
        "delta_feedback_pass_rate", *_HISTORY, *_STATE_COUNTS,
    ],
}
_bound(
    "transition_vectors",
    _FOLDED + " UNION ALL ".join(
        f""" SELECT '{name}' AS feature_set, {len(cols)} AS n_features, count(*) AS n_vectors, sum(n)::BIGINT AS n_rows, """
        + ", ".join(f"sum(f{k})::BIGINT AS rows_fold_{k}" for k in range(5))
        + " FROM (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (fold = {k}) AS f{k}" for k in range(5))
        + f" FROM h_rows JOIN folds USING (episode_id) GROUP BY {', '.join(cols)}, next_state)"
        for name, cols in _FEATURES.items()
    ),
)
_bound(
    "class_weights",
    _FOLDED + """, left_out AS (SELECT unnest(generate_series(-1, 4)) AS out),
  per AS (SELECT out AS fold, next_state, count(*) AS n_rows
          FROM left_out, h_rows JOIN folds USING (episode_id) WHERE folds.fold <> out GROUP BY 1, 2)
  SELECT fold, next_state, n_rows, sum(n_rows) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * n_rows) AS weight FROM per""",
)
_bound(
    "recovery_weights",
    """, p AS (SELECT CASE WHEN next_state = 'FEEDBACK_PASS' THEN '1' ELSE '0' END AS passes, count(*) AS n_rows
               FROM seq WHERE next_state IS NOT NULL GROUP BY 1)
       SELECT passes, n_rows, sum(n_rows) OVER () / (count(*) OVER () * n_rows) AS weight FROM p""",
)
_bound(
    "first_order_table",
    """, classes AS (SELECT destination_state AS next_state, sum(count) AS size FROM moves GROUP BY 1),
       cells AS (SELECT s.current_state, c.next_state, coalesce(m.count, 0) AS n, coalesce(m.count, 0) / c.size AS share
                 FROM (SELECT DISTINCT source_state AS current_state FROM moves) s CROSS JOIN classes c
                 LEFT JOIN moves m ON m.source_state = s.current_state AND m.destination_state = c.next_state)
       SELECT current_state, next_state, n, share / sum(share) OVER (PARTITION BY current_state) AS probability FROM cells""",
)

# --- files and jobs ------------------------------------------------------------

for _name in ("jsonl_append", "jsonl_overwrite"):
    ORACLE[_name] = ORACLE["flatten_attempts"]
ORACLE["csv_roundtrip"] = ORACLE["transition_table"]
ORACLE["compare_job"] = ORACLE["compare_runs"]
ORACLE["malformed_lines"] = """WITH e AS (
  SELECT CAST(user_id // 20 AS INT) AS shard, event_id, concat('{"event_id":', event_id, ',"user_id":', user_id, ',"type":"', event_type, '"}') AS whole,
         row_number() OVER (PARTITION BY user_id // 20 ORDER BY event_id) AS line_number FROM events)
SELECT shard, line_number, substr(whole, 1, length(whole) - 1 - CAST(event_id % 3 AS INT)) AS line
FROM e WHERE event_id % 53 = 0 AND event_id % 41 <> 0"""
ORACLE["read_problems"] = """WITH p AS (SELECT *, unnest(generate_series(0, doc_id % 4)) AS i FROM documents)
SELECT concat('d/', doc_id) AS problem_id, sha256(text) AS prompt_sha256,
  CASE WHEN doc_id % 3 = 0 THEN concat('{', CASE WHEN lang IS NOT NULL THEN concat('"lang":"', lang, '"') ELSE '' END, '}') ELSE '{}' END AS metadata,
  CAST(i AS INT) AS test_pos, concat('[', i, ',', length(text), ']') AS input, CAST(i + doc_id AS VARCHAR) AS expected,
  CASE WHEN i % 2 = 0 THEN concat('t', i) END AS test_id FROM p"""
ORACLE["parse_mixed_tests"] = """WITH d AS (SELECT doc_id, length(text) AS n, doc_id % 5 AS k FROM documents)
SELECT doc_id, 0 AS test_pos, concat('[', n, ']') AS input, 'true' AS expected, NULL::VARCHAR AS test_id FROM d WHERE k = 0
UNION ALL SELECT doc_id, 0, concat('[', doc_id, ', "a"]'), concat('[', n, ', null]'), NULL FROM d WHERE k > 2
UNION ALL SELECT doc_id, 1, concat('[', doc_id, ']'), concat('{"n":', n, '}'), concat('t', doc_id % 3) FROM d WHERE k > 2
UNION ALL SELECT doc_id, 2, 'null', '[1,"ä"]', NULL FROM d WHERE k > 2
UNION ALL SELECT doc_id, 3, '[]', CAST(-(doc_id % 7 + 1) AS VARCHAR), NULL FROM d WHERE k > 2"""
ORACLE["json_safe_values"] = """SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN concat('{"a":"x","b":[', length(text), ',null]}') WHEN 1 THEN concat('"<object at ', doc_id, '>"')
    WHEN 2 THEN CAST(length(text) AS VARCHAR) ELSE concat('"{''a'': ', doc_id, '}"') END AS value,
  ['dict', 'str', 'number', 'str'][doc_id % 4 + 1] AS kind FROM documents"""


def _digest_of(report: str, sql: str, columns: dict[str, str]) -> str:
    """Rows and digest of a query's result; ``columns`` maps names to i(nteger), d(ouble) or s(tring)."""
    cells = [
        f"coalesce({f'CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)' if kind == 'd' else f'CAST({c} AS VARCHAR)'}, '~')"
        for c, kind in sorted(columns.items())
    ]
    return (
        f"SELECT '{report}' AS report, count(*) AS n_rows, "
        f"coalesce(sum(('0x' || substr(md5(concat_ws('|', {', '.join(cells)})), 1, 10))::BIGINT), 0)::VARCHAR AS digest FROM ({sql})"
    )


def _kinds(**kinds: str) -> dict[str, str]:
    return {c: kind for kind, names in kinds.items() for c in names.split()}


_BUNDLE = {
    "episodes": (
        "SELECT *, 5 AS max_attempts, hidden_rate AS final_hidden_pass_rate FROM episodes",
        _kinds(s="episode_id problem_id model_id max_attempts final_outcome", d="final_hidden_pass_rate"),
    ),
    "attempts": (
        f"SELECT {_ATTEMPT} FROM attempts a JOIN episodes e USING (episode_id)",
        _kinds(s="episode_id problem_id model_id pos attempt max_attempts state feedback_tests_passed feedback_tests_total final_outcome",
               d="feedback_pass_rate final_hidden_pass_rate"),
    ),
    "state_freq": ("state_frequencies", _kinds(s="state frequency", d="percentage")),
    "recovery": (
        "recovery_by_state",
        _kinds(s="state episodes_with_state", d="feedback_recovery_rate_within_k hidden_success_rate_given_state unresolved_rate "
               "one_step_recovery_rate persistence_rate"),
    ),
    "transitions": ("transition_table", _kinds(s="source_state destination_state count", d="probability")),
    "transition_matrix": ("transition_matrix", _kinds(s="source_state", d=" ".join(ALL_STATES))),
    "dwell": (
        "dwell_time_summary", _kinds(s="state attempt_count max_observed_dwell", d="median_dwell_time mean_dwell_time")),
    "regression": (
        "regression_summary",
        _kinds(s="episode_id problem_id model_id transitions test_pass_regressions runnability_regressions",
               d="test_pass_regression_rate runnability_regression_rate"),
    ),
    "hidden": ("hidden_generalization", _kinds(s="feedback_loop_group episodes hidden_pass_count", d="hidden_success_rate")),
    "pass_at_k": ("pass_at_k", _kinds(s="k", d="feedback_pass_at_k hidden_pass_rate")),
    "recovery_by_attempt": (
        "recovery_by_attempt", _kinds(s="attempt first_pass_count is_recovery", d="pct_of_recoveries cumulative_pct_recoveries")),
    "recovery_source_states": ("recovery_source_states", _kinds(s="source_state recoveries", d="pct_of_recoveries")),
    "hamsm_data": (
        "transition_dataset",
        _kinds(s="episode_id problem_id model_id current_state next_state attempt dwell_time_current_state feedback_type final_outcome "
               + " ".join([*_HISTORY, *_STATE_COUNTS]), d="attempt_normalized feedback_pass_rate delta_feedback_pass_rate"),
    ),
    # events carry no code, so there are no edits to summarise
    "edit_distance": ("SELECT 'x' AS state WHERE false", _kinds(s="state")),
    "fb_success": ("SELECT count(first_pos) / count(*) AS feedback_success_rate FROM firsts", _kinds(d="feedback_success_rate")),
    "hidden_pass": (
        "SELECT count(*) FILTER (final_outcome = 'FINAL_PASS') / count(*) AS hidden_pass_rate FROM firsts", _kinds(d="hidden_pass_rate")),
}


def _bundle(names) -> str:
    """Digests of bundle tables. A table that is a query of its own is put in whole."""
    parts = []
    for name in names:
        sql, columns = _BUNDLE[name]
        parts.append(_digest_of(name, ORACLE.get(sql, BIND + sql), columns))
    return "\nUNION ALL ".join(parts)


ORACLE["report_bundle_values"] = _bundle(_BUNDLE)
ORACLE["report_bundle_sizes"] = f"SELECT report, n_rows FROM ({_bundle(_BUNDLE)})"
ORACLE["analyze_job"] = _bundle(["state_freq", "recovery", "transitions", "dwell", "regression", "hidden", "pass_at_k", "hamsm_data"])

# --- text over documents and conversations -----------------------------------

ORACLE["code_hash"] = """SELECT doc_id, sha256(text) AS sha256,
  ('0x' || substr(sha256(concat(doc_id, ':42')), 1, 8))::BIGINT AS split_seed,
  nullif(substr(text, 1, 80), '') AS excerpt FROM documents"""

# The other engine's distance counts bytes; accented letters become single unused control characters.
_ACCENTS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = [i for i in range(1, 32) if i != 10][: len(_ACCENTS)]
_BYTES = " || ".join(f"chr({i})" for i in _CODES)
_EDITS = f"""WITH a AS (
  SELECT conv_id, turn, translate(text, '{_ACCENTS}', {_BYTES}) AS text
  FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM a),
edits AS (
  SELECT conv_id, turn, ['NEAR_MISS', 'PARTIAL_PASS', 'SYNTAX_ERROR'][turn % 3 + 1] AS state,
         CASE WHEN text = prev THEN 0.0::DOUBLE
              ELSE levenshtein(text, prev) / greatest(length(text), length(prev))::DOUBLE END AS d
  FROM p),
buckets AS (
  SELECT *, CASE WHEN d IS NULL THEN NULL WHEN d = 0 THEN 'identical' WHEN d < 0.05::DOUBLE THEN 'cosmetic'
                 WHEN d < 0.20::DOUBLE THEN 'targeted' WHEN d < 0.50::DOUBLE THEN 'rewrite'
                 ELSE 'full_replacement' END AS bucket
  FROM edits)
"""
ORACLE["edit_distance"] = (
    _EDITS + "SELECT conv_id, turn, d AS edit_distance_from_previous, bucket FROM buckets"
)
ORACLE["edit_distance_summary"] = (
    _EDITS
    + """SELECT state, count(*) AS count, round_even(avg(d), 4) AS mean, round_even(median(d), 4) AS median,
  round_even(min(d), 4) AS min, round_even(max(d), 4) AS max, """
    + ", ".join(
        f"count(*) FILTER (bucket = '{b}') AS {b}"
        for b in ("identical", "cosmetic", "targeted", "rewrite", "full_replacement")
    )
    + " FROM buckets WHERE d IS NOT NULL GROUP BY 1"
)

_NL = "chr(10)"
_BODY = f"concat('def f(x):', {_NL}, '    return x + ', doc_id % 7)"
_ANSWERS = f"""WITH answers AS (SELECT doc_id, text, CASE doc_id % 6
  WHEN 0 THEN concat(text, {_NL}, '```python', {_NL}, {_BODY}, {_NL}, '```', {_NL}, text)
  WHEN 1 THEN concat('```PY', {_NL}, {_NL}, {_BODY}, {_NL}, {_NL}, '```', text)
  WHEN 2 THEN concat(' ', {_NL}, text, chr(9), {_NL})
  WHEN 3 THEN concat(text, {_NL}, '```python', {_NL}, '```')
  WHEN 4 THEN concat('```', {_NL}, {_BODY}, {_NL}, '```', {_NL}, 'or', {_NL}, '```python', {_NL}, 'no', {_NL}, '```')
  ELSE concat('```python', {_NL}, 'def f(x):', {_NL}, '    pass  # ', doc_id % 7, {_NL}, '```', text) END AS answer
  FROM documents),
codes AS (SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN {_strip('text')} WHEN 3 THEN ''
  WHEN 5 THEN concat('def f(x):', {_NL}, '    pass  # ', doc_id % 7) ELSE {_BODY} END AS code FROM answers)
"""
_FENCE = r"(?is)```(?:python|py)?\s*\n(.*?)```"
ORACLE["extract_code"] = (
    _ANSWERS
    + f"""SELECT doc_id, {_strip(f"CASE WHEN regexp_matches(answer, '{_FENCE}') "
    f"THEN regexp_extract(answer, '{_FENCE}', 1) ELSE answer END")} AS code FROM answers"""
)
_ENTRY = "CASE WHEN doc_id % 5 = 0 THEN 'g' ELSE 'f' END"
_LINES = f"len(list_filter(string_split(code, {_NL}), lambda x: trim(x) <> ''))"
ORACLE["incomplete_code"] = (
    _ANSWERS
    + f"""SELECT doc_id, CASE WHEN code = '' THEN 'no code in the answer'
  WHEN NOT contains(code, concat('def ', {_ENTRY})) THEN concat('function not defined: ', {_ENTRY})
  WHEN {_LINES} > 4 THEN NULL
"""
    + "\n".join(
        rf"  WHEN regexp_matches(code, '(?i){p}') THEN 'placeholder found: {p}'"
        for p in (r"\bpass\b", "TODO", "NotImplementedError", "your code here", "placeholder")
    )
    + " END AS reason FROM codes"
)
ORACLE["policy_audit"] = """SELECT doc_id, [NULL, 'import os.path', 'from urllib.request import ...', 'call to eval',
  'attribute call .system', 'attribute access .environ', NULL, 'import sys'][doc_id % 8 + 1] AS blocked_operation
  FROM documents"""
ORACLE["scripted_lookup"] = """WITH u AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt
  FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT CAST(u.conv_id AS VARCHAR) AS problem_id, attempt, turn, texts[least(attempt, len(texts))] AS response
FROM u LEFT JOIN a USING (conv_id)"""
ORACLE["split_tests"] = """WITH p AS (
  SELECT concat('d/', doc_id) AS problem_id, CAST(doc_id % 9 + 2 AS INT) AS n,
         unnest(generate_series(0, doc_id % 9 + 1)) AS i FROM documents),
s AS (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY md5(concat(
              ('0x' || substr(sha256(concat(problem_id, ':42')), 1, 8))::BIGINT, ':', i))) AS r,
         least(greatest(3, round_even(n * 0.4::DOUBLE, 0)::INT), n - 1) AS take FROM p)
SELECT problem_id, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (r <= take) AS feedback,
       string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (r > take) AS hidden
FROM s GROUP BY 1"""
ORACLE["normalize_problems"] = """SELECT concat('d/', doc_id) AS problem_id, text AS prompt, 'solve' AS entry_point,
  CAST(doc_id % 9 + 1 AS INT) AS n_tests, 'd' AS dataset
  FROM documents WHERE doc_id % 9 >= 1 AND doc_id % 10 <> 9"""
ORACLE["parse_tests"] = """SELECT concat('d/', doc_id) AS task_id, CAST(i AS INT) AS test_pos,
  concat('[', i, ', "a"]') AS input, concat('[', i + doc_id, ', null]') AS expected
  FROM (SELECT doc_id, unnest(generate_series(0, doc_id % 9)) AS i FROM documents WHERE doc_id % 10 <> 9)"""
ORACLE["classify_results"] = """WITH t AS (
  SELECT event_id // 6 AS candidate_id, event_id % 6 AS pos, event_id % 5 AS v, concat('[', event_id, ']') AS input,
    CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'raise'
         WHEN event_type IN ('purchase', 'signup', 'view') THEN 'same'
         WHEN event_type = 'click' OR event_id % 4 <> 0 THEN 'wrong' ELSE 'type' END AS what
  FROM events),
w AS (
  SELECT *, ['3', '[0, 1]', '"01"', '{"a": 1, "b": 2}', 'true'][v + 1] AS expected,
    CASE what WHEN 'wrong' THEN ['4', '[9, 9]', '"10"', '{"a": 1}', '0'][v + 1]
              WHEN 'type' THEN ['"3"', '{"a": 1}', '[0, 1]', '[1]', 'null'][v + 1] END AS actual,
    min(CASE WHEN what IN ('raise', 'type') THEN pos END) OVER (PARTITION BY candidate_id) AS ended
  FROM t),
x AS (
  SELECT *, coalesce(ended, min(CASE WHEN what = 'wrong' THEN pos END) OVER (PARTITION BY candidate_id)) AS shown
  FROM w),
g AS (
  SELECT candidate_id, count(*) AS total, count(*) FILTER (what = 'same' AND pos < coalesce(ended, 99)) AS passed,
    max(what) FILTER (pos = ended) AS stop, max(input) FILTER (pos = shown) AS failing_input,
    max(expected) FILTER (pos = shown AND what <> 'raise') AS expected_output,
    max(actual) FILTER (pos = shown AND what <> 'raise') AS actual_output,
    max(v) FILTER (pos = ended) AS v
  FROM x GROUP BY 1)
SELECT candidate_id,
  CASE WHEN stop = 'raise' THEN 'INDEX_KEY_ERROR' WHEN stop = 'type' THEN 'OUTPUT_FORMAT_ERROR'
       WHEN failing_input IS NULL THEN 'FEEDBACK_PASS' WHEN passed = 0 THEN 'WRONG_ALGORITHM'
       WHEN passed >= total - 1 THEN 'NEAR_MISS' ELSE 'PARTIAL_PASS' END AS state,
  passed, total, passed / total AS pass_rate,
  CASE WHEN stop = 'raise' THEN 'KeyError' END AS exception_type,
  failing_input, expected_output, actual_output,
  CASE WHEN stop = 'type' THEN ['number', 'list', 'str', 'dict', 'number'][v + 1] END AS expected_format,
  CASE WHEN stop = 'type' THEN ['str', 'dict', 'list', 'list', 'null'][v + 1] END AS actual_format
FROM g"""

# --- messages and prompts ----------------------------------------------------

_n = f" || {_NL} || "


def _join(*parts: str) -> str:
    return "(" + _n.join(parts) + ")"


_CAT = "'Error category: ' || state"
_RAISE = [
    "'Exception type: ' || exc",
    "'Failing input: ' || event_id",
    "'Terminal message: ' || coalesce(err, 'None')",
]
_DETAIL = f"""CASE
  WHEN state = 'SYNTAX_ERROR' THEN {_join(_RAISE[0], "'Location: line None, column None'", _RAISE[2])}
  WHEN state = 'TYPE_VALUE_ERROR' THEN {_join(*_RAISE)}
  WHEN state IN ('WRONG_ALGORITHM', 'PARTIAL_PASS', 'NEAR_MISS') THEN {_join(
    "'Feedback tests passed: ' || passed || '/' || total", "'Failing input: ' || event_id",
    "'Expected output: ' || attempt", "'Actual output: None'")}
  WHEN state = 'TIMEOUT' THEN {_join("'Time limit: 2.0 seconds'", "'Terminal message: stopped'")}
  WHEN state = 'SECURITY_VIOLATION' THEN 'Blocked operation: import os' END"""
_bound(
    "feedback_text",
    f""", x AS (SELECT *, 'E' || event_id AS exc,
                  CASE WHEN event_id % 2 = 0 THEN 'line ' || event_id END AS err FROM attempts)
        SELECT episode_id, pos, '{HEADER}' || {_NL} || {_NL} || CASE
          WHEN pos % 5 = 1 THEN 'Result: failed.'
          WHEN pos % 5 = 2 THEN {_CAT}
          WHEN pos % 5 = 3 THEN {_CAT}{_n}'Terminal output:'{_n}coalesce(err, 'stopped')
          WHEN state IN ('FEEDBACK_PASS', 'TERMINAL_UNRESOLVED') THEN {_CAT}{_n}'stopped'
          ELSE {_join(_texts(OPENING, "state"), _CAT, _DETAIL, _texts(CLOSING, "state"))} END AS feedback
        FROM x""",
)
_TURN_FEEDBACK = f"""'{HEADER}' || {_NL} || {_NL} || {_join(
    _texts(OPENING, "state"), _CAT,
    "CASE WHEN state = 'SYNTAX_ERROR' THEN " + _join("'Exception type: SyntaxError'",
        "'Location: line ' || turn || ', column 1'", "'Terminal message: turn ' || turn")
    + " ELSE " + _join("'Feedback tests passed: 1/3'", "'Failing input: [1]'", "'Expected output: 2'",
        "'Actual output: 3'") + " END",
    _texts(CLOSING, "state"))}"""
_BLOCK = f"""'```python' || {_NL} || {_strip("text")} || {_NL} || '```' || {_NL} || feedback
  || CASE WHEN state = 'SYNTAX_ERROR' THEN {_NL} || 'Error output:' || {_NL} || 'turn ' || turn ELSE '' END
  || CASE WHEN turn % 2 = 1 THEN {_NL} || 'Program output:' || {_NL} || 'printed' ELSE '' END"""
_GAP = f" || {_NL} || {_NL} || "
ORACLE["repair_prompts"] = f"""WITH a AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n,
         ['NEAR_MISS', 'PARTIAL_PASS', 'SYNTAX_ERROR'][turn % 3 + 1] AS state
  FROM conversations WHERE role = 'assistant'),
f AS (SELECT *, n // 5 AS chunk, n % 5 + 1 AS attempt, {_TURN_FEEDBACK} AS feedback FROM a),
b AS (SELECT *, {_BLOCK} AS block FROM f),
h AS (SELECT *, string_agg('Attempt ' || attempt || ':' || {_NL} || block, {_NL} || {_NL}) OVER (
        PARTITION BY conv_id, chunk ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
      FROM b)
SELECT conv_id || '-' || chunk AS episode_id, CAST(conv_id AS VARCHAR) AS problem_id, 1 AS attempt,
       '{FIRST_PROMPT}' || {_NL} || {_NL} || 'Solve task ' || conv_id AS prompt
FROM h WHERE attempt = 1
UNION ALL
SELECT conv_id || '-' || chunk, CAST(conv_id AS VARCHAR), attempt + 1,
       '{NEXT_PROMPT}' || {_NL} || {_NL} || 'Task:' || {_NL} || 'Solve task ' || conv_id
       || CASE WHEN earlier IS NULL THEN '' ELSE {_NL} || {_NL} || '--- Prior attempts ---'{_GAP}earlier END
       {_GAP}'--- Last attempt ---'{_GAP}block
FROM h WHERE attempt < 5"""
