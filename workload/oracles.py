"""DuckDB SQL for the registered queries, over the same derived inputs."""

from __future__ import annotations

from harborline import config as c
from harborline.operators import prompts
from workload.fixtures import VIEWS


def _rnd(x: str, n: int) -> str:
    """Scale, round half-even, scale back."""
    return f"(round_even(({x}) * 1e{n}, 0) / 1e{n})"


def _exact(x: str, n: int) -> str:
    """Correctly rounded through decimal text."""
    return f"CAST(format('{{:.{n}f}}', {x}) AS DOUBLE)"


def _text(x: str, n: int) -> str:
    return f"format('{{:.{n}f}}', {x})"


def _money(x: str) -> str:
    return f"'$' || format('{{:,.0f}}', CAST({x} AS DOUBLE))"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quote(w)})" for w in words) + ")"


def _list(items) -> str:
    return "(" + ", ".join(_quote(i) for i in items) + ")"


_TICKET_LINK = "CASE " + " ".join(
    f"WHEN contains(lower(subject), {_quote(p)}) THEN {_quote(e)}" for p, e in c.TICKET_EVENT_LINKS
) + " END"

_METRICS = (
    ("api_calls", "api_calls", 0.40), ("active_users", "active_users", 0.30),
    ("content_entries_created", "content_entries", 0.20),
    ("workflows_triggered", "workflows", 0.10),
)

_EDGE = r"[^\p{L}\p{N}_]"
_FOREIGN = (
    r"regexp_matches(verbatim_comment, '[一-鿿]') "
    r"OR regexp_matches(verbatim_comment, '[àâäéèêëîïôùûüçñ¿¡]', 'i') "
    rf"OR regexp_matches(verbatim_comment, {_quote(f'(^|{_EDGE})(' + '|'.join(c.FOREIGN_WORDS) + f')($|{_EDGE})')}, 'i')"
)


def _change(name: str) -> str:
    return (
        f"CASE WHEN {name}_f = 0 THEN CASE WHEN {name}_s = 0 THEN 0.0 ELSE 1.0 END "
        f"ELSE ({name}_s - {name}_f) / {name}_f END"
    )


_FLAGS = {
    "exec_f": c.EXECUTIVE_WORDS, "budget_f": c.BUDGET_WORDS, "noshow_f": c.NO_SHOW_WORDS,
    "churn_f": c.CHURN_WORDS, "migr_f": c.MIGRATION_WORDS, "down_f": c.DOWNGRADE_WORDS,
    "merger_f": c.MERGER_WORDS, "rneg_f": c.RENEWAL_NEGATIVE, "rpos_f": c.RENEWAL_POSITIVE,
    "champ_f": c.CHAMPION_WORDS, "champr_f": c.CHAMPION_RISK_WORDS,
}


def _count_true(prefix: str, n: int) -> str:
    return "(" + " + ".join(f"CAST({prefix}{i} AS INT)" for i in range(n)) + ")"


def _occurrences(column: str, phrase: str) -> str:
    return f"(length({column}) - length(replace({column}, {_quote(phrase)}, ''))) // {len(phrase)}"


_marks = [f"{_any('t', words)} AS {name}" for name, words in _FLAGS.items()]
_marks += [f"contains(t, {_quote(w)}) AS comp{i}" for i, (w, _) in enumerate(c.COMPETITORS)]
_marks += [f"contains(t, {_quote(w)}) AS neg{i}" for i, w in enumerate(c.NOTE_NEGATIVE)]
_marks += [f"contains(t, {_quote(w)}) AS pos{i}" for i, w in enumerate(c.NOTE_POSITIVE)]
_names = [m.rsplit(" AS ", 1)[1] for m in _marks]
_competitors = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN comp{i} THEN {_quote(n)} END" for i, (_, n) in enumerate(c.COMPETITORS)
) + "], lambda x: x IS NOT NULL), ', ')"
_factors = "list_filter([" + ", ".join([
    "CASE WHEN k > 0 THEN 'Competitor evaluation: ' || competitors END",
    "CASE WHEN exec_f THEN 'Executive involvement detected' END",
    "CASE WHEN budget_f THEN 'Budget/pricing concerns raised' END",
    "CASE WHEN noshow_f THEN 'Missed meeting/QBR' END",
    "CASE WHEN churn_f THEN 'Churn/cancellation language detected' END",
    "CASE WHEN migr_f THEN 'Migration activity detected' END",
    "CASE WHEN down_f THEN 'Downgrade discussion' END",
    "CASE WHEN merger_f THEN 'M&A activity' END",
]) + "], lambda x: x IS NOT NULL)"

_DEP = "('v3.1.2', 'v3.2.0', 'v3.4.1')"
_numbers = "list_transform(string_split(replace({v}, 'v', ''), '.'), lambda x: TRY_CAST(x AS INT))"


def _below_fix(v: str) -> str:
    n = _numbers.format(v=v)
    return (
        f"(len(list_filter({n}, lambda x: x IS NULL)) = 0 AND {n} < [4, 2, 3])"
    )


def _product(v: str) -> str:
    return _rnd(
        f"least(1.0, CASE WHEN {v} IN {_DEP} THEN 0.5 ELSE 0.0 END::DOUBLE "
        f"+ CASE WHEN {v} = 'v4.0.0' THEN 0.3 ELSE 0.0 END::DOUBLE "
        f"+ (CASE WHEN {v} IN {_DEP} THEN 1 ELSE 0 END + CASE WHEN starts_with({v}, 'v3') THEN 1 ELSE 0 END) * 0.1::DOUBLE "
        f"+ least(0.3::DOUBLE, linked_tickets * 0.05::DOUBLE))", 3)


_signal_names = [s for s, _, _ in c.SIGNALS]
_total = " + ".join(f"{s} * {w}::DOUBLE" for s, w, _ in c.SIGNALS)

CTES = {
    **VIEWS,
    "acc": """
SELECT account_id, trim(account_name) AS account_name, arr, trim(plan_tier) AS plan_tier,
       trim(industry) AS industry, trim(csm_name) AS csm_name, trim(region) AS region, ord,
       contract_end_date, CAST(date_diff('day', DATE '2026-06-09', contract_end_date) AS INT) AS days_to_renewal,
       contract_end_date BETWEEN DATE '2026-05-10' AND DATE '2026-09-07' AS in_renewal_window
FROM fx_accounts""",
    "us": """
SELECT account_id, month, CAST(month || '-01' AS DATE) AS month_dt, ord, sdk_version,
       api_calls, active_users, content_entries_created,
       TRY_CAST(workflows_triggered AS DOUBLE) AS workflows_triggered
FROM fx_usage""",
    "up": """
SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY account_id) AS n,
       lag(api_calls) OVER w AS prev_api, lag(active_users) OVER w AS prev_users
FROM us WINDOW w AS (PARTITION BY account_id ORDER BY month_dt, ord)""",
    "uh": "SELECT account_id, max(n) AS n, arg_max(sdk_version, pos) AS latest_sdk, "
          "arg_max(month, pos) AS latest_month, arg_min(month, pos) AS first_month, "
          + ", ".join(
              f"avg({m}) FILTER (pos <= n // 2) AS {s}_f, avg({m}) FILTER (pos > n // 2) AS {s}_s"
              for m, s, _ in _METRICS) + " FROM up GROUP BY account_id",
    "ur": "SELECT *, " + ", ".join(f"{_change(s)} AS {s}_c" for _, s, _ in _METRICS) + " FROM uh",
    "uo": "SELECT *, " + " + ".join(f"{_rnd(f'{s}_c', 4)} * {w}::DOUBLE" for _, s, w in _METRICS)
          + " AS overall FROM ur",
    "tr": f"""
SELECT account_id, n AS months, latest_sdk, latest_month, first_month,
       CASE WHEN n >= 4 THEN {_rnd('overall', 4)} ELSE 0.0 END AS overall_change,
       CASE WHEN n < 4 THEN 'insufficient_data' WHEN overall IS NULL THEN 'stable'
            WHEN overall <= -0.4 THEN 'severe' WHEN overall <= -0.2 THEN 'moderate'
            WHEN overall <= -0.1 THEN 'mild' WHEN overall >= 0 THEN 'growing' ELSE 'stable'
            END AS decline_severity,
       CASE WHEN n >= 4 THEN latest_sdk ELSE 'unknown' END AS trend_sdk, """ + ", ".join(
        f"CASE WHEN n >= 4 THEN {_rnd(f'{s}_f', 1)} END AS {s}_first_avg, "
        f"CASE WHEN n >= 4 THEN {_rnd(f'{s}_s', 1)} END AS {s}_second_avg, "
        f"CASE WHEN n >= 4 THEN {_rnd(f'{s}_c', 4)} END AS {s}_change, "
        f"CASE WHEN n >= 4 THEN CASE WHEN {s}_c > 0.05 THEN 'up' WHEN {s}_c < -0.05 THEN 'down' ELSE 'flat' END END AS {s}_direction"
        for _, s, _ in _METRICS) + " FROM uo",
    "tu": """
SELECT *, CASE decline_severity WHEN 'mild' THEN 0.3 WHEN 'moderate' THEN 0.6
               WHEN 'severe' THEN least(1.0, 0.7::DOUBLE + abs(overall_change) * 0.5::DOUBLE)
               ELSE 0.0 END::DOUBLE AS usage_decline FROM tr""",
    "tk": f"""
SELECT ticket_id, account_id, created_date, trim(upper(priority)) AS priority,
       upper(left(trim(status), 1)) || lower(substring(trim(status), 2)) AS status,
       resolution_time_hours, subject, description, {_TICKET_LINK} AS event
FROM fx_tickets""",
    "tc": """
SELECT account_id, count(*) AS total_tickets,
       count(*) FILTER (created_date >= DATE '2026-03-11') AS recent_tickets,
       count(*) FILTER (created_date < DATE '2026-03-11') AS older_tickets,
       count(*) FILTER (priority = 'P1') AS p1_count,
       count(*) FILTER (priority = 'P2') AS p2_count,
       count(*) FILTER (priority = 'P1' AND created_date >= DATE '2026-03-11') AS recent_p1_count,
       count(*) FILTER (status IN ('Open', 'Escalated')) AS open_count,
       count(*) FILTER (status = 'Escalated') AS escalated_count,
       count(*) FILTER (description ILIKE '%recurring%') AS recurring_count,
       count(*) FILTER (description ILIKE '%blocking%') AS blocking_count,
       count(event) AS linked_tickets, avg(resolution_time_hours) AS hours
FROM tk GROUP BY account_id""",
    "ts": f"""
SELECT * EXCLUDE (hours),
       CASE WHEN older_tickets > 0
            THEN {_exact('(recent_tickets - older_tickets) / older_tickets::DOUBLE', 3)}
            WHEN recent_tickets = 0 THEN 0.0 ELSE 1.0 END AS volume_change,
       {_rnd('CASE WHEN hours <> 0 THEN hours END', 1)} AS avg_resolution_hours,
       {_rnd("least(1.0, least(1.0, p1_count * 0.3::DOUBLE) + 0.2::DOUBLE * recent_p1_count)", 3)} AS p1_tickets,
       {_rnd("least(1.0, least(1.0, open_count * 0.15::DOUBLE) + 0.1::DOUBLE * escalated_count)", 3)} AS open_tickets
FROM tc""",
    "np0": "SELECT account_id, score, trim(coalesce(verbatim_comment, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS verbatim_comment, ord FROM fx_nps",
    "np": f"""
SELECT *, CASE WHEN score BETWEEN 0 AND 6 THEN 'Detractor' WHEN score BETWEEN 7 AND 8 THEN 'Passive'
               WHEN score BETWEEN 9 AND 10 THEN 'Promoter' END AS nps_category,
       {_FOREIGN} AS is_non_english,
       CASE WHEN score >= 7 AND {_any('lower(verbatim_comment)', c.NPS_NEGATIVE)}
            THEN 'positive_score_negative_comment'
            WHEN score <= 4 AND {_any('lower(verbatim_comment)', c.NPS_POSITIVE)}
            THEN 'negative_score_positive_comment' END AS contradiction_type
FROM np0""",
    "ns": """
SELECT account_id, score AS nps_score, coalesce(nps_category, 'nan') AS nps_category,
       verbatim_comment AS comment, is_non_english, verbatim_comment <> '' AS has_comment,
       contradiction_type, contradiction_type IS NOT NULL AS contradiction_detected,
       CASE contradiction_type
         WHEN 'positive_score_negative_comment' THEN 'NPS ' || score || ' (Passive/Promoter) but comment contains risk signals'
         WHEN 'negative_score_positive_comment' THEN 'NPS ' || score || ' (Detractor) but comment is positive — possible misclick or survey fatigue'
         END AS contradiction_detail,
       CASE WHEN score <= 4 THEN 1.0 WHEN score <= 6 THEN 0.7 WHEN score <= 7 THEN 0.3
            WHEN score <= 8 THEN 0.1 ELSE 0.0 END::DOUBLE AS nps_detractor,
       CASE contradiction_type WHEN 'positive_score_negative_comment' THEN 0.8
            WHEN 'negative_score_positive_comment' THEN 0.3 ELSE 0.0 END::DOUBLE AS nps_deterioration
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ord DESC) AS rn FROM np) x
WHERE rn = 1""",
    "nm": "SELECT a, " + ", ".join(_marks) + ", "
          + " + ".join(_occurrences("t", p) for p in c.MISSED_QBR_PHRASES)
          + " AS missed FROM (SELECT true_account_id AS a, lower(raw_text) AS t FROM fx_notes) x",
    "na": "SELECT a AS account_id, count(*) AS note_count, CAST(sum(missed) AS BIGINT) AS missed_qbrs, "
          + ", ".join(f"bool_or({n}) AS {n}" for n in _names) + " FROM nm GROUP BY a",
    "nb": f"SELECT *, {_count_true('comp', len(c.COMPETITORS))} AS k, "
          f"{_count_true('neg', len(c.NOTE_NEGATIVE))} AS kn, "
          f"{_count_true('pos', len(c.NOTE_POSITIVE))} AS kp, {_competitors} AS competitors FROM na",
    "ni": f"""
SELECT *, {_factors} AS factors,
       CASE WHEN kn > kp THEN 'negative' WHEN kp > kn THEN 'positive' WHEN kn > 0 THEN 'mixed'
            ELSE 'neutral' END AS sentiment,
       CASE WHEN rneg_f THEN 'negative' WHEN rpos_f THEN 'positive'
            WHEN k > 0 OR budget_f THEN 'mixed' ELSE 'neutral' END AS renewal_signal,
       CASE WHEN champ_f THEN CASE WHEN champr_f THEN 'at_risk' ELSE 'active' END
            ELSE 'unknown' END AS champion_status FROM nb""",
    "nsig": """
SELECT *, least(1.0, k * 0.5::DOUBLE) AS competitor_mention,
       CAST(exec_f AS DOUBLE) AS executive_escalation, CAST(budget_f AS DOUBLE) AS budget_risk,
       CASE champion_status WHEN 'at_risk' THEN 0.7 ELSE 0.0 END::DOUBLE AS champion_loss,
       least(1.0, missed_qbrs * 0.4::DOUBLE) AS qbr_risk,
       CASE sentiment WHEN 'positive' THEN -0.1 WHEN 'mixed' THEN 0.2 WHEN 'negative' THEN 0.4
            ELSE 0.0 END::DOUBLE AS sentiment_modifier FROM ni""",
    "sg": f"""
SELECT acc.*, coalesce(tu.months, 0) AS months,
       coalesce(decline_severity, 'insufficient_data') AS decline_severity,
       coalesce(overall_change, 0.0) AS overall_change, coalesce(trend_sdk, 'unknown') AS trend_sdk,
       coalesce(latest_sdk, 'unknown') AS current_sdk,
       coalesce(total_tickets, 0) AS total_tickets, coalesce(p1_count, 0) AS p1_count,
       coalesce(open_count, 0) AS open_count, coalesce(recurring_count, 0) AS recurring_count,
       coalesce(linked_tickets, 0) AS linked_tickets, coalesce(volume_change, 0.0) AS volume_change,
       nps_score, coalesce(nps_category, 'No Response') AS nps_category, comment,
       coalesce(contradiction_detected, false) AS contradiction_detected, contradiction_detail,
       coalesce(note_count, 0) AS note_count, coalesce(competitors, '') AS competitors,
       coalesce(factors, []) AS factors, coalesce(sentiment, 'unknown') AS sentiment,
       coalesce(renewal_signal, 'unknown') AS renewal_signal, champion_status,
       coalesce(latest_sdk IN {_DEP}, false) AS is_deprecated_sdk,
       coalesce(latest_sdk = 'v4.0.0', false) AS is_risky_sdk,
       coalesce(usage_decline, 0.0) AS usage_decline,
       coalesce(competitor_mention, 0.0) AS competitor_mention,
       coalesce(p1_tickets, 0.0) AS p1_tickets, coalesce(nps_detractor, 0.3::DOUBLE) AS nps_detractor,
       coalesce(open_tickets, 0.0) AS open_tickets,
       coalesce(executive_escalation, 0.0) AS executive_escalation,
       coalesce(budget_risk, 0.0) AS budget_concern, coalesce(champion_loss, 0.0) AS champion_loss,
       coalesce(nps_deterioration, 0.2::DOUBLE) AS nps_deterioration,
       CASE WHEN trend_sdk IN {_DEP} THEN 1.0 WHEN trend_sdk = 'v4.0.0' THEN 0.6 ELSE 0.0 END::DOUBLE
         AS sdk_deprecation_risk,
       CASE WHEN latest_sdk IS NOT NULL THEN {_product('latest_sdk').replace('linked_tickets', 'coalesce(linked_tickets, 0)')}
            ELSE 0.0 END AS product_risk_impact,
       coalesce(qbr_risk, 0.0) AS missed_qbrs
FROM acc LEFT JOIN tu ON tu.account_id = acc.account_id
LEFT JOIN ts ON ts.account_id = acc.account_id LEFT JOIN ns ON ns.account_id = acc.account_id
LEFT JOIN nsig ON nsig.account_id = acc.account_id""",
    "s0": f"SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_total})) AS total FROM sg",
    "sc": f"""
SELECT *, {_rnd('total', 4)} AS risk_score,
       CASE WHEN total >= 0.65 THEN 'High' WHEN total >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_tier
FROM s0""",
    "br": " UNION ALL ".join(
        f"SELECT account_id, {i} AS ord, {_quote(s)} AS signal, {_quote(label)} AS label, "
        f"{_rnd(s, 3)} AS raw_score, {w}::DOUBLE AS weight, {_rnd(f'{s} * {w}::DOUBLE', 4)} AS contribution FROM sc"
        for i, (s, w, label) in enumerate(c.SIGNALS)),
    "sm": f"""
SELECT *, 'Decline: ' || decline_severity || ', Change: ' || {_text('overall_change * 100', 1)} || '%' AS usage_summary,
       'Total: ' || total_tickets || ', P1: ' || p1_count || ', Open: ' || open_count AS ticket_summary,
       'Score: ' || coalesce(CAST(nps_score AS VARCHAR), 'None') || ', Category: ' || nps_category AS nps_summary,
       '[' || array_to_string(list_transform(factors, lambda x: chr(39) || x || chr(39)), ', ') || ']' AS csm_intelligence,
       'SDK: ' || trend_sdk || ', Deprecated: ' || CASE WHEN is_deprecated_sdk THEN 'True' ELSE 'False' END AS product_risk_summary
FROM sc""",
}


def _with(sql: str) -> str:
    """The query behind the views it needs, in dependency order."""
    import re

    needed: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(CTES[name])

    need(sql)
    parts = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql


_COUNTS = (
    "total_tickets, recent_tickets, older_tickets, p1_count, p2_count, recent_p1_count, open_count, "
    "escalated_count, recurring_count, blocking_count, linked_tickets, volume_change, avg_resolution_hours"
)


def _detail(kind: str) -> str:
    return f"replace({_quote(c.VERSION_IMPACT_DETAILS[kind])}, '{{version}}', sdk_version)"


_IMPACTS = f"""
SELECT sdk_version, accounts, type, severity, detail FROM (
  SELECT latest_sdk AS sdk_version, count(*) AS accounts FROM uh GROUP BY latest_sdk) v,
LATERAL (
  SELECT 'sdk_deprecated' AS type, 'critical' AS severity, {_detail('sdk_deprecated')} AS detail, sdk_version IN {_DEP} AS hit
  UNION ALL SELECT 'sdk_risky_version', 'high', {_detail('sdk_risky_version')}, sdk_version = 'v4.0.0'
  UNION ALL SELECT 'rest_api_sunset', 'critical', {_detail('rest_api_sunset')}, starts_with(sdk_version, 'v3')
  UNION ALL SELECT 'breaking_change_impact', 'medium', {_detail('breaking_change_impact')}, sdk_version IN ('v4.0.0', 'v4.1.0')
  UNION ALL SELECT 'locale_fallback_bug', 'medium', {_detail('locale_fallback_bug')}, {_below_fix('sdk_version')}) i
WHERE hit"""
_EVENT_ROWS = ", ".join("(" + ", ".join(_quote(x) for x in e) + ")" for e in c.CHANGELOG_EVENTS)
_EVENTS = f"""
SELECT sdk_version, accounts, version AS event_version, date AS event_date, type AS event_type,
       title, affects, CASE WHEN severity IN ('critical', 'high', 'medium') THEN severity ELSE 'other' END AS severity_class
FROM (SELECT latest_sdk AS sdk_version, count(*) AS accounts FROM uh GROUP BY latest_sdk) v
JOIN (VALUES {_EVENT_ROWS}) e(version, date, type, title, affects, severity)
  ON (affects = 'all_v3_sdk' AND starts_with(sdk_version, 'v3'))
  OR (affects = 'sdk_below_4.2.0' AND sdk_version IN ('v3.1.2', 'v3.2.0', 'v3.4.1', 'v4.0.0', 'v4.1.0'))
  OR (affects = 'v4.0.0_v4.1.0' AND sdk_version IN ('v4.0.0', 'v4.1.0'))
  OR affects IN ('legacy_editor_users', 'workflow_users')"""


def _got(pattern: str, group: int = 1, column: str = "line", flags: str = "") -> str:
    p = _quote(pattern)
    f = f", '{flags}'" if flags else ""
    return (
        f"CASE WHEN regexp_matches({column}, {p}{f}) "
        f"THEN trim(regexp_extract({column}, {p}, {group}{f})) END"
    )


_ids = ", ".join(_got(p, 1, "raw_text", "i") for p in c.ACCOUNT_ID_PATTERNS)
_owner_full = ", ".join(
    f"CASE WHEN contains(lower(raw_text), {_quote(o.lower())}) OR contains(lower(raw_text), "
    f"{_quote((o.split()[0] + ' ' + o.split()[1][0] + '.').lower())}) THEN {_quote(o)} END"
    for o in c.OWNERS)
_owner_first = ", ".join(
    f"CASE WHEN regexp_matches(raw_text, {_quote(rf'(^|{_EDGE}){o.split()[0]}($|{_EDGE})')}, 'i') THEN {_quote(o)} END"
    for o in c.OWNERS)
_EXTRACT = f"""
SELECT ord, CAST(coalesce({_ids}) AS BIGINT) AS account_id,
       coalesce(pipe, talked,
         CASE WHEN lower(dash) NOT IN {_list(c.NAME_DASH_STOP)} THEN dash END,
         CASE WHEN lower(dated) NOT IN {_list(c.NAME_DATE_STOP)} AND length(dated) > 3 THEN dated END
       ) AS account_name_raw,
       coalesce({_got(c.DATE_ISO_PATTERN)}, {_got(c.DATE_SLASH_PATTERN)},
         {_got(c.DATE_WORD_PATTERN, 1)} || ' ' || {_got(c.DATE_WORD_PATTERN, 2)}) AS date_raw,
       coalesce({_owner_full}, {_owner_first}) AS csm_name
FROM (SELECT *, {_got(c.NAME_PIPE_PATTERN, 1, 'trim(line)')} AS pipe,
             {_got(c.NAME_TALKED_PATTERN, 1, 'trim(line)')} AS talked,
             {_got(c.NAME_DASH_PATTERN, 1, 'trim(line)')} AS dash,
             {_got(c.NAME_DATE_PATTERN, 1, 'trim(line)')} AS dated
      FROM (SELECT ord, raw_text, split_part(raw_text, chr(10), 1) AS line FROM fx_notes) a) b"""

_IN_VIEW = "sc WHERE days_to_renewal BETWEEN -30 AND 90"
_TIERS = """
SELECT t.risk_tier, count(account_id) AS accounts, CAST(coalesce(sum(arr), 0) AS DOUBLE) AS arr
FROM (VALUES ('High'), ('Medium'), ('Low')) t(risk_tier)
LEFT JOIN sc ON sc.risk_tier = t.risk_tier GROUP BY t.risk_tier"""
_SUMMARY = f"""
SELECT count(*) AS total_accounts, count(*) FILTER (risk_tier = 'High') AS high_risk_count,
       coalesce(sum(arr) FILTER (risk_tier = 'High'), 0) AS high_risk_arr,
       count(*) FILTER (risk_tier = 'Medium') AS medium_risk_count,
       coalesce(sum(arr) FILTER (risk_tier = 'Medium'), 0) AS medium_risk_arr,
       count(*) FILTER (risk_tier = 'Low') AS low_risk_count FROM {_IN_VIEW}"""
_EXPLAIN = f"""
SELECT account_id, '## Risk Assessment for ' || account_name || chr(10) || chr(10)
  || '**Risk Tier: ' || risk_tier || '** (Score: ' || {_text('risk_score', 2)} || '/1.0)' || chr(10) || chr(10)
  || '### Usage Analysis' || chr(10) || usage_summary || chr(10) || chr(10)
  || '### Support Ticket Analysis' || chr(10) || ticket_summary || chr(10) || chr(10)
  || '### NPS Analysis' || chr(10) || nps_summary || chr(10) || chr(10)
  || '### CSM Intelligence' || chr(10) || csm_intelligence || chr(10) || chr(10)
  || '### Product Risk Impact' || chr(10) || product_risk_summary || chr(10) || chr(10)
  || '---' || chr(10)
  || '*Note: Configure a text model for strategic analysis and recommendations.*' AS explanation
FROM sm"""
_PORTFOLIO = f"""
SELECT '## Portfolio Summary' || chr(10) || chr(10)
  || '- **' || total_accounts || '** accounts in the renewal window' || chr(10)
  || '- **' || high_risk_count || ' High Risk** accounts with **' || {_money('high_risk_arr')} || '** ARR at risk' || chr(10)
  || '- **' || medium_risk_count || ' Medium Risk** accounts with **' || {_money('medium_risk_arr')} || '** ARR at risk  ' || chr(10)
  || '- **' || low_risk_count || ' Low Risk** accounts on track for renewal' || chr(10) || chr(10)
  || '*Configure a text model for strategic portfolio insights.*' AS narrative
FROM ({_SUMMARY}) p"""



def _found(names) -> str:
    listed = ", ".join(f"CASE WHEN contains(raw_text, {_quote(n)}) THEN {_quote(n)} END" for n in names)
    return f"array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ', ')"


def _fields(columns: str) -> str:
    """Columns, split at top-level commas, as text joined by bars; NULL is a tilde."""
    parts, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return " || '|' || ".join(f"coalesce(CAST({x.strip()} AS VARCHAR), '~')" for x in parts)


def _prompt(template: str, **values: str) -> str:
    """A template filled in by SQL."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"coalesce({values[x]}, '')" if k % 2 else _quote(x) for k, x in enumerate(pieces))


_PAGE_HEADER = (
    f"account_name, risk_tier, {_text('risk_score', 3)}, {_money('arr')}, plan_tier, days_to_renewal, csm_name, region, decline_severity, "
    f"{_text('overall_change * 100', 1)} || '%', trend_sdk, usage_summary, ticket_summary, nps_summary, csm_intelligence, product_risk_summary"
)
_PROMPT_FRAME = len(prompts.NOTES_OVERVIEW_TASK) - len("{notes}")
_OVERVIEW = f"""
SELECT part, min(account_id) AS first_account_id, count(*) AS notes, true AS answered,
       coalesce(string_agg(name, '; ' ORDER BY account_id, ord) FILTER (WHERE name IS NOT NULL), '') AS high_risk_accounts,
       (sum(size) - 2 + {_PROMPT_FRAME})::BIGINT || ' characters' AS portfolio_themes,
       sum({_occurrences('raw_text', 'no show')})::BIGINT || ' missed meetings' AS urgent_actions
FROM (SELECT *, (2 * (before // 200000) + CASE WHEN (before + size - 1) // 200000 > before // 200000 THEN 1 ELSE 0 END)::BIGINT AS part,
             CASE WHEN regexp_matches(split_part(raw_text, chr(10), 1), '^2026-03-20 [|] .* [|] James O[.]$')
                  THEN regexp_extract(split_part(raw_text, chr(10), 1), '^2026-03-20 [|] (.*) [|] James O[.]$', 1) END AS name
      FROM (SELECT *, (coalesce(sum(size) OVER (ORDER BY account_id NULLS FIRST, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
            FROM (SELECT true_account_id AS account_id, ord, raw_text, length(raw_text) + 2 AS size FROM fx_notes WHERE raw_text IS NOT NULL) a) b) c
GROUP BY part"""

_RAW = {
    "accounts_window": "SELECT account_id, account_name, plan_tier, industry, csm_name, region, CAST(arr AS DOUBLE) AS arr, CAST(contract_end_date AS VARCHAR) AS contract_end_date, days_to_renewal FROM acc WHERE in_renewal_window",
    "usage_trend": "SELECT account_id, months, latest_sdk, latest_month, first_month, overall_change, decline_severity, trend_sdk, "
    + ", ".join(f"{s}_first_avg, {s}_second_avg, {s}_change, {s}_direction" for _, s, _ in _METRICS) + " FROM tu",
    "usage_mom": f"SELECT account_id, month, {_rnd('CASE WHEN prev_api > 0 THEN (api_calls - prev_api) / prev_api ELSE 0.0 END', 4)} AS api_calls_change, active_users - prev_users AS active_users_change FROM up WHERE pos > 1",
    "usage_risk": "SELECT account_id, decline_severity, usage_decline FROM tu",
    "usage_series": "SELECT account_id, month, CAST(month_dt AS VARCHAR) AS month_dt, api_calls, active_users, content_entries_created FROM up WHERE n >= 4",
    "ticket_metrics": f"SELECT account_id, {_COUNTS} FROM ts",
    "ticket_risk": "SELECT account_id, p1_tickets, open_tickets FROM ts",
    "ticket_subjects": "SELECT account_id, subject, count(*) AS tickets FROM tk WHERE subject IS NOT NULL GROUP BY account_id, subject",
    "ticket_topics": "SELECT ticket_id, account_id, event_type, subject, priority, status FROM ("
    + " UNION ALL ".join(
        f"SELECT *, {_quote(t)} AS event_type FROM tk WHERE {_any('(lower(coalesce(subject, chr(32))) || chr(32) || lower(coalesce(description, chr(32))))', ps)}"
        for t, ps in c.TICKET_TOPICS) + ") x",
    "ticket_changelog_links": "SELECT ticket_id, account_id, subject, event AS changelog_event, priority, status FROM tk WHERE event IS NOT NULL",
    "ticket_timeline": "SELECT account_id, ticket_id, CAST(CAST(created_date AS DATE) AS VARCHAR) AS created_date, priority, subject, CASE WHEN status = 'Resolved' THEN 'circle' ELSE 'x' END AS marker, CASE priority WHEN 'P1' THEN 'danger' WHEN 'P2' THEN 'warning' WHEN 'P3' THEN 'info' ELSE 'muted' END AS display_class FROM tk WHERE priority IN ('P1', 'P2', 'P3', 'P4')",
    "nps_bands": "SELECT ord, account_id, score, nps_category, is_non_english, length(verbatim_comment) AS comment_length FROM np",
    "nps_contradiction": "SELECT account_id, nps_score, nps_category, has_comment, is_non_english, contradiction_detected, contradiction_type, contradiction_detail FROM ns",
    "nps_risk": "SELECT account_id, nps_detractor, nps_deterioration FROM ns",
    "nps_histogram": "SELECT CAST(s AS INT) AS score, count(np.ord) AS answers, CASE WHEN s <= 6 THEN 'danger' WHEN s <= 8 THEN 'warning' ELSE 'success' END AS display_class FROM range(11) r(s) LEFT JOIN np ON np.score = s GROUP BY s",
    "sdk_latest_distribution": "SELECT latest_sdk AS sdk_version, count(*) AS accounts, CASE WHEN starts_with(latest_sdk, 'v3') THEN 'danger' WHEN latest_sdk = 'v4.0.0' THEN 'warning' WHEN latest_sdk = 'v4.1.0' THEN 'info' ELSE 'success' END AS display_class FROM uh GROUP BY latest_sdk",
    "version_impacts": _IMPACTS,
    "event_impacts": _EVENTS,
    "event_listing": f"""
SELECT version, date, type, title, affects, severity,
       CASE WHEN severity IN ('critical', 'high', 'medium') THEN severity ELSE 'other' END AS severity_class,
       CAST(coalesce(n, 0) AS BIGINT) AS accounts_hit
FROM (VALUES {_EVENT_ROWS}) e(version, date, type, title, affects, severity)
LEFT JOIN (SELECT event_version, title AS t, sum(accounts) AS n FROM ({_EVENTS}) h GROUP BY event_version, title) x
  ON x.event_version = e.version AND x.t = e.title""",
    "product_risk": "SELECT account_id, current_sdk, is_deprecated_sdk, is_risky_sdk, linked_tickets, sdk_deprecation_risk, product_risk_impact FROM sc",
    "note_extract": _EXTRACT,
    "note_intelligence": "SELECT account_id, sentiment, competitors, array_to_string(factors, '; ') AS risk_factors, exec_f AS executive_involved, budget_f AS budget_concern, renewal_signal, champion_status, missed_qbrs, note_count FROM ni",
    "note_signals": "SELECT account_id, competitor_mention, executive_escalation, budget_risk AS budget_concern_risk, champion_loss, qbr_risk AS missed_qbrs_risk, sentiment_modifier FROM nsig",
    "reconcile_id": f"SELECT x.ord, x.account_id AS account_id, acc.account_id AS matched_account_id, acc.account_name AS matched_account_name FROM ({_EXTRACT}) x JOIN acc ON acc.account_id = x.account_id WHERE x.account_id <> 0",
    "account_scores": "SELECT account_id, account_name, CAST(arr AS DOUBLE) AS arr, plan_tier, industry, region, csm_name, CAST(contract_end_date AS VARCHAR) AS contract_end_date, days_to_renewal, risk_score, risk_tier, " + ", ".join(_signal_names) + ", row_number() OVER (ORDER BY risk_score DESC, account_id) - 1 AS rank FROM sc",
    "account_scores_window": "SELECT account_id, risk_score, risk_tier, " + ", ".join(_signal_names) + " FROM sc WHERE in_renewal_window",
    "top_drivers": "SELECT account_id, CAST(driver_rank AS INT) AS driver_rank, signal, label, raw_score, weight, contribution FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY contribution DESC, ord) AS driver_rank FROM br WHERE contribution > 0) x WHERE driver_rank <= 5",
    "breakdown_long": "SELECT account_id, ord, signal, label, raw_score, weight, contribution, CASE WHEN contribution > 0.1 THEN 'danger' WHEN contribution > 0.05 THEN 'warning' ELSE 'info' END AS display_class FROM br WHERE contribution > 0",
    "tier_counts": "SELECT t.risk_tier, count(v.account_id) AS accounts FROM (VALUES ('High'), ('Medium'), ('Low')) t(risk_tier) LEFT JOIN (SELECT * FROM sc WHERE days_to_renewal BETWEEN -30 AND 90) v ON v.risk_tier = t.risk_tier GROUP BY t.risk_tier",
    "arr_by_tier": "SELECT t.risk_tier, CAST(coalesce(sum(v.arr), 0) AS DOUBLE) AS arr FROM (VALUES ('High'), ('Medium'), ('Low')) t(risk_tier) LEFT JOIN (SELECT * FROM sc WHERE days_to_renewal BETWEEN -30 AND 90) v ON v.risk_tier = t.risk_tier GROUP BY t.risk_tier",
    "tier_totals": _TIERS,
    "kpis": f"SELECT count(*) FILTER (risk_tier = 'High') AS high_risk_accounts, count(*) FILTER (risk_tier = 'Medium') AS medium_risk_accounts, CAST(coalesce(sum(arr) FILTER (risk_tier IN ('High', 'Medium')), 0) AS DOUBLE) AS arr_at_risk, CAST(sum(CAST(risk_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_risk_score FROM {_IN_VIEW}",
    "portfolio_summary": f"SELECT total_accounts, high_risk_count, CAST(high_risk_arr AS DOUBLE) AS high_risk_arr, medium_risk_count, CAST(medium_risk_arr AS DOUBLE) AS medium_risk_arr, low_risk_count FROM ({_SUMMARY}) p",
    "plan_tiers": f"SELECT DISTINCT plan_tier FROM {_IN_VIEW}",
    "view_counts": "SELECT count(*) AS accounts, count(*) FILTER (days_to_renewal BETWEEN -30 AND 90) AS accounts_in_window FROM sc",
    "risk_heatmap": "SELECT account_id, account_name || ' (' || left(risk_tier, 1) || ')' AS row_label, "
    + ", ".join(s for s, _ in c.HEATMAP_SIGNALS) + ", "
    + ", ".join(f"{_text(s, 2)} AS {s}_text" for s, _ in c.HEATMAP_SIGNALS)
    + f" FROM {_IN_VIEW} ORDER BY risk_score DESC, account_id LIMIT 20",
    "top_high_risk": "SELECT account_id, account_name, risk_score, CAST(arr AS DOUBLE) AS arr, plan_tier FROM sc WHERE risk_tier = 'High' ORDER BY risk_score DESC, account_id LIMIT 10",
    "risk_table": f"SELECT account_name AS \"Account\", risk_tier AS \"Risk\", {_text('risk_score', 3)} AS \"Score\", {_money('arr')} AS \"ARR\", plan_tier AS \"Plan\", days_to_renewal AS \"Days to Renewal\", csm_name AS \"CSM\", region AS \"Region\" FROM {_IN_VIEW}",
    "account_labels": f"SELECT account_id, account_name || ' (' || risk_tier || ') — Score: ' || {_text('risk_score', 3)} AS label FROM sc",
    "sdk_impact": f"SELECT account_id, account_name AS \"Account\", current_sdk AS \"SDK\", CASE WHEN is_deprecated_sdk THEN 'Deprecated' ELSE 'Risky' END AS \"Risk\", {_money('arr')} AS \"ARR\", days_to_renewal || ' days' AS \"Renewal\", linked_tickets AS \"Linked Tickets\" FROM sc WHERE is_deprecated_sdk OR is_risky_sdk",
    "arr_deprecated": "SELECT CAST(coalesce(sum(arr) FILTER (is_deprecated_sdk), 0) AS DOUBLE) AS arr_on_deprecated, count(*) FILTER (is_deprecated_sdk) AS accounts_on_deprecated FROM sc",
    "cohorts": "SELECT * FROM (SELECT 'silent_churn' AS cohort, account_id, risk_tier, risk_score FROM sc WHERE nps_score >= 7 AND decline_severity IN ('mild', 'moderate', 'severe') UNION ALL SELECT 'sdk_cluster', account_id, risk_tier, risk_score FROM sc WHERE is_deprecated_sdk UNION ALL SELECT 'contradiction', account_id, risk_tier, risk_score FROM sc WHERE contradiction_detected UNION ALL SELECT 'merger', account_id, risk_tier, risk_score FROM sc WHERE list_contains(factors, 'M&A activity') UNION ALL SELECT 'champion_at_risk', account_id, risk_tier, risk_score FROM sc WHERE champion_status = 'at_risk') x",
    "account_360": f"""
SELECT account_id, section, count(*) AS rows,
       sum(('0x' || substr(md5(t), 1, 15))::UBIGINT)::VARCHAR || ':' || sum(('0x' || substr(md5(t), 16, 15))::UBIGINT)::VARCHAR AS digest
FROM (SELECT account_id, 'account' AS section, {_fields("account_name, arr, plan_tier, industry, csm_name, region, contract_end_date, ord, days_to_renewal, in_renewal_window")} AS t FROM acc
      UNION ALL SELECT account_id, 'usage', {_fields("ord, month, month_dt, api_calls, active_users, content_entries_created, workflows_triggered, sdk_version")} FROM us
      UNION ALL SELECT account_id, 'tickets', {_fields("ticket_id, priority, status, resolution_time_hours, subject, description, (resolution_time_hours IS NULL OR coalesce(status IN ('Open', 'Escalated'), false))")} FROM tk
      UNION ALL SELECT account_id, 'nps', {_fields("ord, score, verbatim_comment, nps_category, is_non_english")} FROM np
      UNION ALL SELECT true_account_id, 'notes', {_fields("ord, raw_text")} FROM fx_notes) x
WHERE account_id IN (SELECT account_id FROM acc) GROUP BY account_id, section""",
    "read_all_inputs": f"""
SELECT input, count(*) AS rows,
       sum(('0x' || substr(md5(t), 1, 15))::UBIGINT)::VARCHAR || ':' || sum(('0x' || substr(md5(t), 16, 15))::UBIGINT)::VARCHAR AS digest
FROM (SELECT 'accounts' AS input, {_fields("account_id, account_name, plan_tier, arr, contract_end_date, in_renewal_window")} AS t FROM acc
      UNION ALL SELECT 'usage', {_fields("account_id, month, api_calls, workflows_triggered, sdk_version")} FROM us
      UNION ALL SELECT 'tickets', {_fields("ticket_id, account_id, priority, status, resolution_time_hours, subject")} FROM tk
      UNION ALL SELECT 'nps', {_fields("account_id, score, regexp_replace(verbatim_comment, '[' || chr(13) || chr(10) || ']', ' ', 'g'), nps_category")} FROM np
      UNION ALL SELECT 'csm_notes', t FROM (
        SELECT trim(regexp_replace(raw_text, '-{{2,}}', '- ', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM fx_notes) r WHERE length(t) >= 10
      UNION ALL SELECT 'changelog', version || ' ' || date || ' ' || title FROM (VALUES {_EVENT_ROWS}) e(version, date, type, title, affects, severity)) x
GROUP BY input""",
    "account_page": f"""
SELECT section, account_id, t AS text FROM (
  SELECT 'header' AS section, account_id, {_fields(_PAGE_HEADER)} AS t FROM sm
  UNION ALL SELECT 'breakdown', account_id, {_fields("place, signal, label, class")}
    FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY contribution DESC, ord) AS place,
                 CASE WHEN contribution > 0.1 THEN 'danger' WHEN contribution > 0.05 THEN 'warning' ELSE 'info' END AS class
          FROM br WHERE contribution > 0) b
  UNION ALL SELECT 'usage', account_id, {_fields("month, api_calls, active_users, content_entries_created")} FROM up WHERE n >= 4
  UNION ALL SELECT 'tickets', account_id, {_fields("ticket_id, priority, subject, marker, class")}
    FROM (SELECT *, CASE WHEN status = 'Resolved' THEN 'circle' ELSE 'x' END AS marker,
                 CASE priority WHEN 'P1' THEN 'danger' WHEN 'P2' THEN 'warning' WHEN 'P3' THEN 'info' ELSE 'muted' END AS class
          FROM tk WHERE priority IN ('P1', 'P2', 'P3', 'P4')) m
  UNION ALL SELECT 'notes', true_account_id, {_fields("ord, raw_text")} FROM fx_notes) x
WHERE account_id = (SELECT account_id FROM sm ORDER BY CAST({_text('risk_score', 3)} AS DOUBLE) DESC, account_id LIMIT 1)""",
    "unresolved_tickets": "SELECT resolution_time_hours IS NULL OR coalesce(status IN ('Open', 'Escalated'), false) AS is_unresolved, status, count(*) AS tickets FROM tk GROUP BY ALL",
    "filtered_view": """
SELECT show_all, risk_tier AS tier, plan_tier, count(*) AS accounts, CAST(sum(arr) AS DOUBLE) AS arr
FROM sc, (VALUES (true), (false)) v(show_all)
WHERE plan_tier IN ('BUILDING', 'MACHINERY') AND (show_all OR days_to_renewal BETWEEN -30 AND 90) GROUP BY ALL""",
    "note_prompts": f"""
SELECT account_id, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS note_count, CAST(length(prompt) AS INT) AS characters, md5(prompt) AS prompt_md5
FROM (SELECT acc.account_id, {_prompt(prompts.NOTE_TASK, account_name='account_name', account_id='CAST(acc.account_id AS VARCHAR)',
      plan_tier='plan_tier', arr=_money('arr'), contract_end='CAST(contract_end_date AS VARCHAR)', note_text='raw_text')} AS prompt
      FROM fx_notes JOIN acc ON acc.account_id = true_account_id) x""",
    "tickets_lenient": f"""
SELECT ticket_id, account_id, CAST(CAST(created_date AS DATE) AS VARCHAR) AS created_date, priority, status, subject,
       CASE WHEN account_id % 2 = 0 THEN description END AS description, NULL AS "column", NULL AS raw_text, NULL AS reason
FROM tk WHERE account_id % 50 <> 7
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'created_date', 'about ' || CAST(CAST(created_date AS DATE) AS VARCHAR), 'not a timestamp'
FROM tk WHERE account_id % 50 = 7""",
    "account_detail": f"SELECT account_id, account_name, risk_tier, {_text('risk_score', 3)} AS score, {_money('arr')} AS arr, plan_tier, days_to_renewal, csm_name, region, decline_severity, {_text('overall_change * 100', 1)} || '%' AS overall_change, trend_sdk AS sdk_version, total_tickets, p1_count, open_count, recurring_count, nps_score, nps_category, contradiction_detail, competitors, note_count, usage_summary, ticket_summary, nps_summary, csm_intelligence, product_risk_summary FROM sm",
    "enrich_notes_fallback": "SELECT account_id, sentiment, competitors, array_to_string(factors, '; ') AS risk_factors, exec_f AS executive_involved, budget_f AS budget_concern, renewal_signal, champion_status, missed_qbrs, note_count FROM ni WHERE account_id IN (SELECT account_id FROM acc)",
    "translate_comments": "SELECT account_id, ord, verbatim_comment AS translation, 'unknown' AS original_language, 'unknown' AS sentiment FROM np WHERE is_non_english",
    "notes_overview": _OVERVIEW,
    "enrich_notes_stored": f"""
SELECT ni.account_id,
       CASE WHEN failed THEN sentiment WHEN contains(raw_text, 'frustrated') THEN 'negative' ELSE 'positive' END AS sentiment,
       CASE WHEN failed THEN competitors ELSE {_found(['Strapi', 'Sanity'])} END AS competitors,
       CASE WHEN failed THEN array_to_string(factors, '; ') ELSE length(raw_text) || ' characters' END AS risk_factors,
       CASE WHEN failed THEN exec_f ELSE contains(raw_text, 'VP joined') END AS executive_involved,
       CASE WHEN failed THEN budget_f ELSE contains(raw_text, 'budget cut') END AS budget_concern,
       CASE WHEN failed THEN renewal_signal ELSE 'mixed' END AS renewal_signal,
       CASE WHEN failed THEN champion_status WHEN contains(raw_text, 'lost faith') THEN 'lost' ELSE 'active' END AS champion_status,
       CASE WHEN failed THEN missed_qbrs ELSE {_occurrences('raw_text', 'no show')} END AS missed_qbrs, note_count
FROM ni JOIN (SELECT *, contains(raw_text, 'merger planned') AS failed FROM fx_notes) x ON x.true_account_id = ni.account_id
WHERE ni.account_id IN (SELECT account_id FROM acc)""",
    "translate_comments_stored": """
SELECT account_id, ord, length(verbatim_comment) || ' characters: ' || left(verbatim_comment, 10) AS translation,
       'other' AS original_language, CASE WHEN contains(verbatim_comment, 'Too expensive') THEN 'negative' ELSE 'neutral' END AS sentiment,
       (SELECT count(DISTINCT verbatim_comment) FROM np WHERE is_non_english) AS asked, CAST(0 AS BIGINT) AS asked_again
FROM np WHERE is_non_english""",
    "silent_churn_stored": """
SELECT account_id, silent AS is_silent_churn, CASE WHEN silent THEN 0.75 ELSE 0.25 END::DOUBLE AS confidence,
       CASE WHEN silent THEN 'falling_use' ELSE 'none' END AS pattern_type,
       account_name || ': ' || coalesce(CAST(nps_score AS VARCHAR), 'N/A') AS evidence,
       'calls ' || CASE WHEN falls THEN 'fall' ELSE 'hold' END AS recommended_investigation
FROM (SELECT *, falls AND coalesce(nps_score >= 7, false) AS silent
      FROM (SELECT sc.account_id, account_name, nps_score, coalesce(api_calls_change < 0, false) AS falls
            FROM sc LEFT JOIN tu ON tu.account_id = sc.account_id) y) z""",
    "silent_churn": "SELECT account_id, false AS is_silent_churn, 0.0::DOUBLE AS confidence, 'analysis_unavailable' AS pattern_type, 'Text model not configured — manual review recommended' AS evidence, 'Configure a text model for automated silent churn detection' AS recommended_investigation FROM acc",
    "explanation_fallback": _EXPLAIN,
    "portfolio_fallback": _PORTFOLIO,
}

ORACLES = {name: _with(sql) for name, sql in _RAW.items()}
