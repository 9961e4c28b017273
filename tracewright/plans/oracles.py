"""The same rows as the queries give, in DuckDB's SQL. Patterns are written for RE2, which has no look-around."""

from __future__ import annotations

from tracewright.functions import fixed_values as V
from tracewright.functions.text import SPACES, spaced
from tracewright.operators.episodes import COLUMNS as EPISODE_COLUMNS
from tracewright.operators.summary import AXES
from tracewright.plans.fixtures import TRACE_LENGTH, narrated_sql, planted_text
from tracewright.plans.queries import EMAIL, LONG_TRACE, ODD, PHONE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(low: str, phrases) -> str:
    return f"regexp_matches({low}, {lit('(^|[^a-z0-9])(' + '|'.join(p.replace(' ', f'[{SPACES}]+') for p in phrases) + ')([^a-z0-9]|$)')})"


def score(low: str, phrases) -> str:
    return "(" + " + ".join(any_of(low, [p]) + "::INT" for p in phrases) + ")"


def rules(low: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(low, phrases)} THEN '{code}'" for code, phrases in table) + " ELSE 'unknown' END"


def parts(low: str, substrings) -> str:
    return "(" + " OR ".join(f"contains({low}, {lit(p)})" for p in substrings) + ")"


def case_of(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {default} END"


def trim_words(x: str, n: int) -> str:
    return f"CASE WHEN len(string_split({x}, ' ')) <= {n} THEN {x} ELSE rtrim(array_to_string(string_split({x}, ' ')[1:{n}], ' '), ',.;:') || '...' END"


def sentences(text: str) -> str:
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return rf"list_filter(list_transform(string_split(regexp_replace({flat}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' -')), lambda s: s <> '')"


def having(array: str, phrases) -> str:
    return f"list_filter({array}, lambda x: {any_of('lower(x)', phrases)})"


def duration(a: str, b: str) -> str:
    s = f"floor(epoch({b}::TIMESTAMP) - epoch({a}::TIMESTAMP))::BIGINT"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {b}::TIMESTAMP < {a}::TIMESTAMP THEN 'unknown' WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN {s} // 60 || 'm ' || {s} % 60 || 's' ELSE {s} // 3600 || 'h ' || ({s} // 60) % 60 || 'm' END"


def label(column: str) -> str:
    words = f"replace({column}, '_', ' ')"
    return case_of(column, V.LABELS, f"upper({words}[1]) || {words}[2:]")


W = "PARTITION BY trace_id ORDER BY msg_index"
FLAGS = f"""WITH {narrated_sql()},
flags AS (
  SELECT *, {score("lower(text)", V.DIFFICULTY)} AS difficulty_score, {any_of("lower(text)", V.SHIFT)} AS has_shift, {any_of("lower(text)", V.INTENTION)} AS has_intention,
         {any_of("lower(text)", V.OUTCOME)} AS has_outcome FROM narrated)"""
CANDIDATES = f"""{FLAGS},
spans AS (
  SELECT trace_id, msg_index, role = 'assistant' AND difficulty_score + has_shift::INT >= 2 AS is_candidate,
         coalesce(max(CASE WHEN role = 'assistant' AND has_intention THEN msg_index END) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), msg_index) AS start_index,
         coalesce(min(CASE WHEN role = 'assistant' AND has_outcome THEN msg_index END) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
                  max(CASE WHEN role = 'assistant' THEN msg_index END) OVER ({W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS end_index
  FROM flags),
candidates AS (SELECT trace_id, msg_index, start_index, end_index FROM spans WHERE is_candidate)"""
MERGED = f"""{CANDIDATES},
reach AS (
  SELECT *, max(end_index) OVER (PARTITION BY trace_id ORDER BY start_index, end_index, msg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM candidates),
islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_index > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY start_index, end_index, msg_index ROWS UNBOUNDED PRECEDING)::BIGINT AS episode_no FROM reach),
merged AS (SELECT trace_id, episode_no, min(start_index) AS start_index, max(end_index) AS end_index FROM islands WHERE episode_no <= 12 GROUP BY ALL)"""
KEYS = f"""{MERGED},
inside AS (SELECT m.*, s.episode_no, s.start_index, s.end_index FROM merged s JOIN narrated m ON m.trace_id = s.trace_id AND m.msg_index BETWEEN s.start_index AND s.end_index AND m.role = 'assistant'),
said AS (
  SELECT trace_id, episode_no, start_index, end_index, string_agg(text, chr(10) || chr(10) ORDER BY msg_index) AS combined, arg_min(timestamp, msg_index) AS start_time, arg_max(timestamp, msg_index) AS end_time
  FROM inside GROUP BY ALL),
cut AS (SELECT *, {sentences("combined")} AS s FROM said),
told AS (SELECT *, {having("s", V.DIFFICULTY)} AS d, {having("s", V.INTENTION)} AS i, {having("s", V.SHIFT)} AS h, {having("s", V.OUTCOME)} AS o FROM cut),
real AS (SELECT *, list_filter(d, lambda x: NOT {any_of("lower(x)", V.INTENTION)} OR {any_of("lower(x)", V.EVIDENCE)}) AS r FROM told),
named AS (SELECT *, coalesce(r[1], d[1], s[1], '') AS difficulty_sentence, coalesce(i[1], '') AS own_intention, coalesce(i[1], s[1], '') AS intention, coalesce(o[-1], '') AS outcome_sentence FROM real),
keys AS (SELECT *, coalesce({having("s[coalesce(list_position(s, difficulty_sentence), 0) + 1:]", V.SHIFT)}[1], h[1], '') AS shift_sentence FROM named)"""
L = "low"
CODES = f"""{KEYS},
low AS (SELECT *, lower(combined) AS low, {score("lower(combined)", V.DIFFICULTY)} AS n FROM keys),
one AS (
  SELECT *, {rules("lower(difficulty_sentence)", V.DIFFICULTY_RULES)} AS by_sentence, {rules(L, V.DIFFICULTY_RULES)} AS by_all, {rules(L, V.APPRAISAL_RULES)} AS appraisal,
         {rules(L, V.DETOUR_RULES)} AS detour, {rules(L, V.RESOLUTION_RULES)} AS resolution_mode, {any_of(L, V.SUCCESS)} AS success FROM low),
two AS (
  SELECT *, CASE WHEN by_sentence <> 'unknown' THEN by_sentence ELSE by_all END AS difficulty_type,
         CASE WHEN detour = 'unknown' OR (detour = 'premature_closure' AND n < 2) THEN 'direct_continuation' ELSE detour END AS detour_type,
         CASE WHEN success AND {any_of(L, V.UNRESOLVED)} THEN 'premature_success_claim' WHEN {any_of(L, V.NOT_RESOLVED)} THEN 'not_resolved' WHEN {any_of(L, V.UNVERIFIED)} THEN 'needs_verification'
              WHEN {any_of(L, V.PARTIAL)} THEN 'partially_resolved' WHEN {any_of(L, V.CAVEAT)} AND {any_of(L, V.COMPLETION)} THEN 'resolved_with_caveat'
              WHEN success AND n >= 3 AND NOT {parts(L, V.CONFIDENT_SUBSTRINGS)} THEN 'premature_success_claim' WHEN success THEN 'resolved_with_confidence'
              WHEN {any_of(L, V.UNCERTAIN)} THEN 'uncertain_but_proceeding' ELSE 'unknown' END AS outcome_claim FROM one),
three AS (
  SELECT *, CASE outcome_claim WHEN 'not_resolved' THEN 'failed_recovery' WHEN 'needs_verification' THEN 'partial_recovery' WHEN 'premature_success_claim' THEN 'overconfident_recovery' ELSE
         CASE WHEN {parts(L, V.REFLECTIVE_SUBSTRINGS)} THEN 'reflective_recovery' WHEN detour_type IN ('alternative_path', 'workaround', 'scope_narrowing', 'verification_shift') THEN 'detour_recovery'
              WHEN {parts(L, V.ITERATIVE_SUBSTRINGS)} THEN 'iterative_recovery' WHEN outcome_claim IN ('resolved_with_confidence', 'resolved_with_caveat') THEN 'smooth_recovery' ELSE 'unknown' END END AS recovery_pattern FROM two),
codes AS (
  SELECT *, CASE WHEN detour_type IN ('direct_continuation', 'unknown') THEN 'unknown' WHEN recovery_pattern IN ('overconfident_recovery', 'failed_recovery', 'avoidant_recovery') THEN 'no'
                 WHEN outcome_claim IN ('partially_resolved', 'needs_verification', 'resolved_with_caveat') THEN 'mixed' ELSE 'yes' END AS productive_detour FROM three)"""
TITLES = {c: c.replace("_", " ").title() for c in V.CODEBOOK["difficulty_type"]}
QUOTES = "list_transform(list_filter([difficulty_sentence, shift_sentence, outcome_sentence], lambda x: x <> ''), lambda x: " + trim_words("x", 30) + ")"
EPISODES = f"""{CODES},
quoted AS (SELECT *, {QUOTES} AS q FROM codes),
episodes AS (
  SELECT trace_id, episode_no, 'E' || lpad(episode_no::VARCHAR, 2, '0') AS episode_id,
         {case_of("difficulty_type", TITLES, "''")} || CASE WHEN difficulty_sentence <> '' THEN ': ' || {trim_words("difficulty_sentence", 8)} ELSE '' END AS title,
         start_index, end_index, start_time, end_time, {duration("start_time", "end_time")} AS duration_label, {trim_words("intention", 36)} AS initial_intention,
         {trim_words("difficulty_sentence", 40)} AS reported_difficulty, difficulty_type, appraisal,
         CASE WHEN own_intention <> '' THEN {trim_words("own_intention", 36)} ELSE {lit(V.NO_STRATEGY)} END AS strategy_before,
         CASE WHEN shift_sentence <> '' THEN {trim_words("shift_sentence", 36)} WHEN outcome_sentence <> '' THEN {trim_words("outcome_sentence", 36)} ELSE {lit(V.NO_SHIFT)} END AS strategy_after,
         detour_type, resolution_mode, recovery_pattern, outcome_claim, productive_detour,
         array_to_string(list_filter(q, lambda x, k: list_position(q, x) = k), ' | ') AS evidence_quotes,
         'The visible narrative frames this as ' || replace(difficulty_type, '_', ' ') || '; the appraisal is ' || replace(appraisal, '_', ' ') || ', with ' || replace(detour_type, '_', ' ') || ' and '
         || replace(recovery_pattern, '_', ' ') || '. The outcome claim reads as ' || replace(outcome_claim, '_', ' ') || '.' AS analyst_memo
  FROM quoted)"""
COUNTS = f"""{EPISODES},
stacked AS ({" UNION ALL ".join(f"SELECT trace_id, episode_no, '{a}' AS axis, {a} AS code FROM episodes" for a in AXES)}),
counts AS (SELECT trace_id, axis, code, count(*) AS n, min(episode_no) AS first_episode FROM stacked GROUP BY ALL)"""
RISKY = ", ".join(map(lit, V.RISKY_CLAIMS))
TONE = case_of("recovery_pattern", V.VIEW_TONES, "'unknown'")
PATTERNS = f"""{COUNTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id, axis ORDER BY n DESC, first_episode) AS place FROM counts),
top AS (SELECT trace_id, axis, string_agg(replace(code, '_', ' ') || ' (' || n || ')', ', ' ORDER BY place) AS said FROM ranked WHERE place <= 3 GROUP BY ALL),
risky AS (SELECT trace_id, string_agg(episode_id, ', ' ORDER BY episode_no) FILTER (outcome_claim IN ({RISKY})) AS ids FROM episodes GROUP BY 1),
patterns AS (
  SELECT t.trace_id, 'Main difficulty pattern: ' || max(said) FILTER (axis = 'difficulty_type') || '.' AS difficulty_style, 'Main detour pattern: ' || max(said) FILTER (axis = 'detour_type') || '.' AS detour_style,
         'Main recovery pattern: ' || max(said) FILTER (axis = 'recovery_pattern') || '.' AS recovery_style,
         CASE WHEN r.ids IS NOT NULL THEN 'Watch ' || r.ids || ': these episodes end with unresolved, unverifiable, or overconfident claims.'
              ELSE 'Outcome claims lean toward ' || max(said) FILTER (axis = 'outcome_claim') || '.' END AS risk_or_caveat
  FROM top t JOIN risky r ON r.trace_id = t.trace_id GROUP BY t.trace_id, r.ids)"""
RATED = f"""
rated AS (
  SELECT trace_id, count(*) AS n_episodes, arg_max({TONE}, {case_of(f"({TONE})", V.SEVERITY, "0")}) AS tone,
         CASE WHEN bool_or(outcome_claim = 'premature_success_claim') THEN 'overclaimed' WHEN bool_or(outcome_claim IN ({", ".join(map(lit, V.CANDID_CLAIMS))})) THEN 'candid' ELSE 'mixed' END AS honesty FROM episodes GROUP BY 1),
verdict AS (SELECT *, CASE WHEN honesty = 'overclaimed' THEN {lit(V.OVERCLAIMED_HEADLINE)} ELSE {case_of("tone", V.HEADLINES, "''")} END AS headline FROM rated)"""
CAPTURED = f"""
ends AS (SELECT trace_id, arg_min(start_time, episode_no) AS a, arg_max(end_time, episode_no) AS b FROM episodes GROUP BY 1),
captured AS (
  SELECT trace_id, CASE WHEN a[:10] = b[:10] THEN a[:10] || ' · ' || a[12:16] || '–' || b[12:16] || ' UTC' ELSE a[:10] || ' ' || a[12:16] || ' → ' || b[:10] || ' ' || b[12:16] || ' UTC' END AS captured,
         {duration("a", "b")} AS duration_total FROM ends)"""
DETAIL = "v.n_episodes || CASE WHEN v.n_episodes = 1 THEN ' difficulty episode. ' ELSE ' difficulty episodes. ' END || p.recovery_style || ' ' || p.risk_or_caveat"
UNMARKED = " ".join(V.PRIVACY_NOTES[k] for k in ("processing", "visible", "tools"))


def told(text: str, *values: str) -> str:
    """A text with %s as SQL that puts the values in."""
    parts = text.split("%s")
    return " || ".join([lit(parts[0])] + [f"{v} || {lit(part)}" for v, part in zip(values, parts[1:], strict=True)])


def report_sql() -> str:
    """The field report: none of these traces holds a secret, and all have the rules' engine."""
    t, nl = V.REPORT, "chr(10)"
    two = f"{nl} || {nl}"
    lines = (
        "'### ' || episode_id || ' - ' || title", f"'**Tone:** `' || {case_of('recovery_pattern', V.REPORT_TONES, lit('unknown'))} || '`'", "'**Intention:** ' || initial_intention", "'**Difficulty:** ' || reported_difficulty",
        "'**Shift:** ' || strategy_after", "'**Resolution mode:** `' || resolution_mode || '`'", "'**Outcome claim:** `' || outcome_claim || '`'", "'**Duration:** ' || duration_label",
    )
    ids = lambda v: f"coalesce(string_agg(episode_id, ', ' ORDER BY episode_no) FILTER (productive_detour = '{v}'), {lit(t['none_detected'])})"
    quoted = """array_to_string(list_transform(list_filter(string_split(evidence_quotes, ' | '), lambda q: q <> '')[1:2], lambda q: '"' || q || '"'), '; ')"""
    notes = [V.PRIVACY_NOTES[k] for k in ("processing", "visible", "tools", "none")]
    return f"""{PATTERNS},
n AS (SELECT trace_id, count(*) AS n FROM narrated GROUP BY 1),
sections AS (
  SELECT trace_id, count(*) AS n_episodes, '## Journey Timeline' || {two} || string_agg({f" || {nl} || ".join(lines)}, {two} ORDER BY episode_no) AS timeline,
         '## Detour Analysis' || {nl} || '- **Productive detours:** ' || {ids("yes")} || {nl} || '- **Mixed detours:** ' || {ids("mixed")} || {nl} || '- **Unproductive or risky detours:** ' || {ids("no")}
         || coalesce(string_agg({nl} || '- ' || episode_id || ': `' || detour_type || '`. ' || analyst_memo, '' ORDER BY episode_no) FILTER (detour_type <> 'direct_continuation'), '') AS detours,
         '## Outcome Claim Audit' || {nl} || string_agg('- **' || episode_id || ':** `' || outcome_claim || '`. Recovery: `' || recovery_pattern || '`. Evidence: '
         || CASE WHEN {quoted} <> '' THEN {quoted} ELSE {lit(t["no_short_quote"])} END || '.', {nl} ORDER BY episode_no) AS audit
  FROM episodes GROUP BY 1),
kinds AS (
  SELECT trace_id, difficulty_type, string_agg(episode_id, ', ' ORDER BY episode_no) AS ids, arg_min(string_split(evidence_quotes, ' | ')[1], episode_no) FILTER (evidence_quotes <> '') AS example FROM episodes GROUP BY 1, 2),
maps AS (
  SELECT trace_id, string_agg('- **' || {case_of("difficulty_type", TITLES, "''")} || '**: ' || ids || '. ' || coalesce('Example: "' || example || '"', {lit(t["no_quote"])}), {nl} ORDER BY difficulty_type) AS kinds FROM kinds GROUP BY 1),
filled AS (
  SELECT n.trace_id, n.n, s.n_episodes IS NOT NULL AS told, s.* EXCLUDE (trace_id), m.kinds, coalesce(p.difficulty_style, {lit(V.NO_PATTERNS["difficulty_style"])}) AS difficulty, coalesce(p.detour_style, {lit(V.NO_PATTERNS["detour_style"])}) AS detour,
         coalesce(p.recovery_style, {lit(V.NO_PATTERNS["recovery_style"])}) AS recovery, coalesce(p.risk_or_caveat, {lit(V.NO_PATTERNS["risk_or_caveat"])}) AS caveat
  FROM n LEFT JOIN sections s ON s.trace_id = n.trace_id LEFT JOIN maps m ON m.trace_id = n.trace_id LEFT JOIN patterns p ON p.trace_id = n.trace_id)
SELECT trace_id, array_to_string([{lit(t["title"])}, '**Trace:** Agent trace: ' || trace_id, '**Agent guess:** `unknown`', {lit("**Analysis scope:** " + V.SCOPE)}, '**Engine:** `{V.RULE_ENGINE}`', '## Executive Summary',
  CASE WHEN told THEN {told(t["summary"], "n", "n_episodes")} || ' ' || difficulty || ' ' || detour || ' ' || recovery || ' ' || caveat || ' ' || {lit(t["disclaimer"])} ELSE {told(t["bare"], "n")} END,
  CASE WHEN told THEN timeline ELSE {lit(t["no_timeline"])} END, CASE WHEN told THEN '## Difficulty Map' || {nl} || 'Main difficulties observed:' || {nl} || kinds ELSE {lit(t["no_map"])} END,
  CASE WHEN told THEN detours ELSE {lit(t["no_detours"])} END, '## Recovery Pattern', recovery || ' ' || difficulty || ' ' || detour, CASE WHEN told THEN audit ELSE {lit(t["no_claims"])} END,
  '## Privacy Notes' || {nl} || 'Redaction count: 0' || {" || ".join(f"{nl} || {lit('- ' + x)}" for x in notes)}], {two}) || {nl} AS report FROM filled"""


def view_sql() -> str:
    shown = [c for c in EPISODE_COLUMNS if c not in ("trace_id", "episode_no", "episode_id", "title", "start_index", "end_index", "start_time", "end_time", "duration_label")]
    value = lambda c: "list_filter(string_split(evidence_quotes, ' | '), lambda q: q <> '')" if c == "evidence_quotes" else c
    span = "{'start_index': start_index, 'end_index': end_index, 'start_time': start_time[12:19], 'end_time': end_time[12:19], 'duration_label': duration_label}"
    each = "{'episode_id': episode_id, 'title': title, 'message_span': " + span + "".join(f", '{c}': {value(c)}" for c in shown) + "}"
    bare = dict(zip(("tone", "headline", "detail", "honesty"), V.NO_EPISODE, strict=True))
    verdict = ", ".join(f"'{k}': coalesce({DETAIL if k == 'detail' else 'v.' + k}, {lit(bare[k])})" for k in bare)
    pattern = ", ".join(f"'{k}': coalesce(p.{k}, {lit(v)})" for k, v in V.NO_PATTERNS.items())
    notes = ", ".join(lit(V.PRIVACY_NOTES[k]) for k in ("processing", "visible", "tools", "none"))
    return f"""{PATTERNS}, {RATED}, {CAPTURED},
n AS (SELECT trace_id, count(*) AS n FROM narrated GROUP BY 1),
listed AS (
  SELECT trace_id, list({each} ORDER BY episode_no) AS e, arg_min(episode_id, episode_no) AS first_id,
         arg_min(episode_id, episode_no) FILTER ({case_of("recovery_pattern", V.VIEW_TONES, "'unknown'")} = 'risk') AS grave_id FROM episodes GROUP BY 1)
SELECT n.trace_id, to_json({{'trace_title': 'Agent trace: ' || n.trace_id, 'agent_type_guess': 'unknown', 'analysis_scope': {lit(V.SCOPE)}, 'engine': '{V.RULE_ENGINE}', 'captured': coalesce(c.captured, '—'),
  'narrative_message_count': n.n, 'redaction_count': 0, 'duration_total': coalesce(c.duration_total, '—'), 'verdict': {{{verdict}}}, 'overall_patterns': {{{pattern}}}, 'privacy_notes': [{notes}],
  'episodes': coalesce(l.e, []), 'model_status': '', 'first_selected': coalesce(CASE WHEN v.tone = 'risk' THEN grave_id END, first_id, ''), 'selected': coalesce(first_id, '')}})::VARCHAR AS view
FROM n LEFT JOIN listed l ON l.trace_id = n.trace_id LEFT JOIN verdict v ON v.trace_id = n.trace_id LEFT JOIN patterns p ON p.trace_id = n.trace_id LEFT JOIN captured c ON c.trace_id = n.trace_id"""


#: Numbers that the detector is sure of.
SURE = PHONE.removesuffix("[0-9]{4}") + f"[0-9]{{3}}[{ODD}]"


def figures_sql() -> str:
    stage = lambda run, name, k, source, text, n="0": f"SELECT '{run}' AS run, '{name}' AS stage, {k}::INTEGER AS ordinal, count(*)::BIGINT AS rows, coalesce(sum(strlen({text})), 0)::BIGINT AS bytes, coalesce(sum({n}), 0)::BIGINT AS redactions, true AS timed FROM {source}"
    sessions = [stage("sessions", "extract", 0, "narrated", "text"), stage("sessions", "redact", 1, "narrated", "text"), stage("sessions", "chart", 2, "said", "combined"), stage("sessions", "classify", 3, "episodes", "reported_difficulty")]
    spotted = "coalesce(list_sum(list_transform(found, lambda f: f.n)), 0)"
    documents = [stage("documents", "extract", 0, f"(SELECT {planted_text()} AS text FROM documents)", "text"), stage("documents", "redact", 1, "redacted", "text", spotted)]
    documents += [stage("documents", name, k, "(SELECT '' AS text WHERE false)", "text") for k, name in ((2, "chart"), (3, "classify"))]
    return redaction_steps().replace("WITH ", EPISODES + ", ", 1) + " " + " UNION ALL ".join(sessions + documents)


def two_pass_sql() -> str:
    notes = {k: V.PRIVACY_NOTES[k] for k in ("unavailable", "screened", "applied", "none")}
    return redaction_steps() + f""",
t AS (
  SELECT doc_id AS trace_id, contains(text, 'SLACK') AS failed, len(regexp_extract_all(text, {lit(SURE)})) AS phones, text, found FROM redacted),
u AS (
  SELECT trace_id, failed, CASE WHEN failed THEN text ELSE regexp_replace(text, {lit(SURE)}, '[REDACTED_PHONE]', 'g') END AS text,
         CASE WHEN failed OR phones = 0 THEN found ELSE list_append(found, {{'label': 'phone number', 'n': phones}}) END AS found FROM t)
SELECT trace_id, md5(text) AS text_md5, 1::BIGINT AS n_messages, coalesce(list_sum(list_transform(found, lambda f: f.n)), 0)::BIGINT AS redaction_count,
  {lit(UNMARKED)} || ' ' || CASE WHEN failed THEN {told(notes["unavailable"], "'RuntimeError'")} ELSE {lit(notes["screened"])} END || ' '
  || CASE WHEN len(found) > 0 THEN {told(notes["applied"], "array_to_string(list_transform(list_sort(found), lambda f: f.label || ' (' || f.n || ')'), ', ')")} ELSE {lit(notes["none"])} END AS privacy_notes
FROM u"""


def model_sql() -> str:
    name, status, note = V.MODELS["minicpm"], V.MODEL_STATUS, V.MODEL_NOTES
    produced, silent, failed = note["produced"] % name, note["unavailable"] % ("ValueError: " + V.ANSWER_ERRORS["json"].rstrip(".")), note["unavailable"] % "RuntimeError: no device"
    short = "'1 difficulty episode. Main recovery pattern: failed recovery (1). Watch E01: these episodes end with unresolved, unverifiable, or overconfident claims.'"
    by = lambda full, brief, rules: f"CASE k WHEN 0 THEN {full} WHEN 1 THEN {brief} ELSE {rules} END"
    said = f"CASE WHEN k < 2 THEN {lit(produced)} WHEN k = 2 THEN {lit(silent)} ELSE {lit(failed)} END"
    return f"""{PATTERNS}, {RATED},
f AS (SELECT trace_id, arg_min(start_index, episode_no) % 4 AS k FROM merged GROUP BY 1),
n AS (SELECT DISTINCT trace_id FROM narrated)
SELECT f.trace_id, CASE WHEN k < 2 THEN {lit(name)} ELSE '{V.RULE_ENGINE}' END AS engine, {by("'partial'", "'risk'", "v.tone")} AS tone, {by(lit(V.MODEL_HEADLINE), lit(V.HEADLINES["risk"]), "v.headline")} AS headline,
  {by("'Slow.'", short, DETAIL)} AS detail, {by("'mixed'", "'candid'", "v.honesty")} AS honesty, {by("'Mind.'", "'Watch E01: these episodes end with unresolved, unverifiable, or overconfident claims.'", "p.risk_or_caveat")} AS risk_or_caveat,
  CASE WHEN k < 2 THEN {lit(status[False])} ELSE {lit(status[True])} END || ' ' || {said} AS model_status, CASE WHEN k < 2 THEN 1 ELSE v.n_episodes END AS n_episodes, {said} AS model_note
FROM f JOIN verdict v ON v.trace_id = f.trace_id JOIN patterns p ON p.trace_id = f.trace_id"""


def redaction_steps() -> str:
    steps = [f"WITH r0 AS (SELECT doc_id, {planted_text()} AS text, []::STRUCT(label VARCHAR, n BIGINT)[] AS found FROM documents)"]
    for k, (label, pattern, new) in enumerate((x, spaced(p), n) for x, p, n in V.REDACTIONS):
        steps.append(f"r{k + 1} AS (SELECT doc_id, regexp_replace(text, {lit(pattern)}, {lit(new)}, 'g') AS text, list_append(found, {{'label': '{label}', 'n': len(regexp_extract_all(text, {lit(pattern)}))}}) AS found FROM r{k})")
    return ", ".join(steps) + f", redacted AS (SELECT doc_id, text, list_filter(found, lambda f: f.n > 0) AS found FROM r{len(V.REDACTIONS)})"


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
MESSY = r"chr(10) || ' ' || chr(9) || chr(10) || text || '  ' || chr(13) || chr(10) || text || chr(9) || chr(13) || '  indented ' || chr(13) || chr(10) || chr(10)"
CONVERSATION = "SELECT conv_id AS trace_id, turn, role AS raw_role, CASE WHEN lower(role) IN ('user', 'human', 'user_message') THEN 'user' ELSE 'assistant' END AS role, text FROM conversations"

ORACLES = {
    "outcome_audit": f"""{EPISODES} SELECT trace_id, episode_id, {label("outcome_claim")} AS claim, {case_of("outcome_claim", {c: v[0] for c, v in V.CLAIM_NOTES.items()}, "'unknown'")} AS tone,
  {case_of("outcome_claim", {c: v[1] for c, v in V.CLAIM_NOTES.items()}, "'—'")} AS note, nullif(string_split(evidence_quotes, ' | ')[-1], '') AS quote FROM episodes""",
    "ranked_clusters": f"""{EPISODES}, c AS (SELECT trace_id, difficulty_type, count(*) AS n, min(episode_no) AS first, string_agg(episode_id, ', ' ORDER BY episode_no) AS episode_ids FROM episodes GROUP BY 1, 2)
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, first) AS place, {label("difficulty_type")} AS label, n, episode_ids FROM c""",
    "trail_layout": f"""{EPISODES}, t AS (SELECT trace_id, episode_id, {TONE} AS tone, row_number() OVER (PARTITION BY trace_id ORDER BY episode_no) - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n FROM episodes)
SELECT trace_id, episode_id, tone, round({V.FRAME["left"]} + CASE WHEN n = 1 THEN {V.FRAME["width"] / 2}::DOUBLE ELSE i::DOUBLE / greatest(n - 1, 1) * {V.FRAME["width"]} END, 4) AS x,
  round({V.FRAME["base"]} - least(0.97::DOUBLE, greatest(0.06::DOUBLE, {case_of("tone", V.ELEVATION, "0.3")}::DOUBLE + (i % 2 * 2 - 1) * 0.015::DOUBLE)) * {V.FRAME["height"]}, 4) AS y FROM t""",
    "seconds_labels": """SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN '—' WHEN floor(value / 60) > 0 THEN floor(value / 60)::BIGINT || 'm ' || floor(value % 60 + 0.5)::BIGINT || 's'
  ELSE floor(value % 60 + 0.5)::BIGINT || 's' END AS label FROM events""",
    "message_roles": f"WITH c AS ({CONVERSATION}) SELECT trace_id, turn, raw_role, role, row_number() OVER (PARTITION BY trace_id ORDER BY turn) - 1 AS msg_index FROM c",
    "normalized_text": f"""WITH t AS (SELECT conv_id AS trace_id, turn, replace(replace({MESSY}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM conversations)
SELECT trace_id, turn, trim(array_to_string(list_transform(string_split(t, chr(10)), lambda l: rtrim(l, {BLANK})), chr(10)), chr(10)) AS text FROM t""",
    "regex_redaction": redaction_steps() + """
SELECT doc_id, text, array_to_string(list_transform(list_sort(found), lambda f: f.label || ': ' || f.n), ', ') AS notes, coalesce(list_sum(list_transform(found, lambda f: f.n)), 0)::BIGINT AS redaction_count FROM redacted""",
    "redaction_totals": redaction_steps() + ", u AS (SELECT unnest(found) AS f FROM redacted) SELECT f.label AS label, sum(f.n)::BIGINT AS n FROM u GROUP BY 1",
    "pii_span_merge": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '0:3:private_person,6:9:private_phone' WHEN 4 THEN '0:5:private_person,5:8:private_phone' WHEN 5 THEN '2:4:secret'
  ELSE '0:8:private_person' END AS spans FROM documents""",
    "pii_mask": f"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, {lit(PHONE)}, '[REDACTED_PHONE]', 'g'), {lit(EMAIL)}, '[REDACTED_EMAIL]', 'g')) AS text_md5,
  (len(regexp_extract_all(text, {lit(PHONE)})) + len(regexp_extract_all(text, {lit(EMAIL)})))::BIGINT AS pii_count FROM documents""",
    "signal_scores": f"{CANDIDATES} SELECT f.trace_id, f.msg_index, difficulty_score, has_shift, has_intention, has_outcome, is_candidate FROM flags f JOIN spans s ON s.trace_id = f.trace_id AND s.msg_index = f.msg_index",
    "candidate_spans": f"{CANDIDATES} SELECT * FROM candidates",
    "merged_spans": f"{MERGED} SELECT * FROM merged",
    "segmented_spans": f"{MERGED} SELECT * FROM merged",
    "streamed_episodes": f"{EPISODES} SELECT * FROM episodes",
    "device_choice": "SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'cpu' WHEN 3 THEN 'cuda' WHEN 4 THEN 'mps' ELSE CASE WHEN event_id % 3 = 0 THEN 'cuda' WHEN event_id % 2 = 0 THEN 'mps' ELSE 'cpu' END END AS device FROM events",
    "stage_figures": figures_sql(),
    "span_messages": f"{KEYS} SELECT trace_id, episode_no, msg_index, text FROM inside",
    "sentences": f"WITH {narrated_sql()}, s AS (SELECT trace_id, msg_index, {sentences("text || chr(10) || '- And more?  Yes! '")} AS s FROM narrated) SELECT trace_id, msg_index, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS sentence FROM s",
    "key_sentences": f"{KEYS} SELECT trace_id, episode_no, len(s) AS n_sentences, difficulty_sentence, intention, shift_sentence, outcome_sentence FROM keys",
    "episode_codes": f"{CODES} SELECT trace_id, episode_no, difficulty_type, appraisal, detour_type, resolution_mode, outcome_claim, recovery_pattern, productive_detour FROM codes",
    "episodes": f"{EPISODES} SELECT * FROM episodes",
    "code_counts": f"{COUNTS} SELECT * FROM counts",
    "pattern_summary": f"{PATTERNS} SELECT * FROM patterns",
    "session_verdict": f"{EPISODES}, {RATED} SELECT * FROM verdict",
    "field_report": report_sql(),
    "trace_files": f"SELECT *, 'episodes.json, field-report.md, narrative.md' AS names FROM ({report_sql()})",
    "view_model": view_sql(),
    "two_pass_redaction": two_pass_sql(),
    "model_analysis": model_sql(),
    "episodes_json": f"""{PATTERNS}, {RATED}, n AS (SELECT trace_id, count(*) AS n FROM narrated GROUP BY 1),
i AS (SELECT trace_id, '[' || string_agg('"' || episode_id || '"', ',' ORDER BY episode_no) || ']' AS ids, arg_min(start_time, episode_no) AS start_time, count(*) AS n FROM episodes GROUP BY 1)
SELECT n.trace_id, 'Agent trace: ' || n.trace_id AS trace_title, '{V.RULE_ENGINE}' AS engine, n.n::VARCHAR AS messages, CASE WHEN i.n = 1 THEN ids[2:-2] ELSE ids END AS episode_ids, start_time,
  coalesce(v.headline, {lit(V.NO_EPISODE[1])}) AS headline, coalesce(p.difficulty_style, {lit(V.NO_PATTERNS["difficulty_style"])}) AS difficulty_style, {lit(V.PRIVACY_NOTES["visible"])} AS note
FROM n LEFT JOIN i ON i.trace_id = n.trace_id LEFT JOIN verdict v ON v.trace_id = n.trace_id LEFT JOIN patterns p ON p.trace_id = n.trace_id""",
    "trace_titles": """SELECT event_id, ['Codex', 'Claude Code', 'Pi Agent', 'Agent', 'Agent'][event_id % 5 + 1] || CASE WHEN event_id % 4 = 0 THEN ' · mine ' || event_id || '.json'
  ELSE ' trace: run-' || event_id || CASE WHEN event_id % 3 = 0 THEN '.tar' ELSE '' END END AS title FROM events""",
    "difficulty_clusters": f"""{EPISODES} SELECT trace_id, difficulty_type, count(*) AS n, string_agg(episode_id, ', ' ORDER BY episode_no) AS episode_ids,
  arg_min(string_split(evidence_quotes, ' | ')[1], episode_no) FILTER (evidence_quotes <> '') AS example FROM episodes GROUP BY 1, 2""",
    "detour_groups": f"{EPISODES} SELECT trace_id, " + ", ".join(f"coalesce(string_agg(episode_id, ', ' ORDER BY episode_no) FILTER (productive_detour = '{v}'), '') AS {c}" for c, v in (("productive", "yes"), ("mixed", "mixed"), ("unproductive", "no"))) + " FROM episodes GROUP BY 1",
    "durations": f"WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS b, strftime(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), '%Y-%m-%dT%H:%M:%SZ') AS a FROM events) SELECT event_id, {duration('a', 'b')} AS duration_label FROM e",
    "capture_window": f"{EPISODES}, {CAPTURED} SELECT * FROM captured",
    "numbered_narrative": f"""WITH {narrated_sql()}, n AS (SELECT trace_id, count(*) AS n FROM narrated GROUP BY 1),
p AS (SELECT DISTINCT trace_id, unnest([0, n - 1] || list_transform(range(50), lambda i: floor(i * (n / 50.0::DOUBLE))::BIGINT)) AS pick FROM n)
SELECT m.trace_id, m.msg_index, '[' || m.msg_index || '] ' || role || ' ' || timestamp || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))[:320] AS line
FROM narrated m JOIN n ON n.trace_id = m.trace_id WHERE n <= 50 OR EXISTS (SELECT 1 FROM p WHERE p.trace_id = m.trace_id AND pick = msg_index)""",
    "redacted_narrative": f"""WITH RECURSIVE c AS ({CONVERSATION}), rules(k, pattern, new) AS (VALUES {", ".join(f"({k}, {lit(spaced(p))}, {lit(n)})" for k, (_, p, n) in enumerate(V.REDACTIONS))}),
m AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY turn) - 1 AS i, role, array_to_string(list_transform(string_split(text, chr(10)), lambda l: rtrim(l, {BLANK})), chr(10)) AS text FROM c),
r AS (SELECT 0 AS k, * FROM m UNION ALL SELECT r.k + 1, trace_id, i, role, regexp_replace(text, pattern, new, 'g') FROM r JOIN rules ON rules.k = r.k)
SELECT trace_id, trim(string_agg('## ' || lpad(i::VARCHAR, 4, '0') || ' ' || role || chr(10) || chr(10) || trim(text, chr(10)), chr(10) || chr(10) ORDER BY i), {BLANK}) || chr(10) AS narrative FROM r WHERE k = {len(V.REDACTIONS)} GROUP BY 1""",
    "split_scan": f"""WITH {narrated_sql()}, p AS (SELECT *, trace_id * {TRACE_LENGTH} + msg_index AS place FROM narrated)
SELECT place // {LONG_TRACE} AS log, (row_number() OVER (PARTITION BY place // {LONG_TRACE} ORDER BY place) - 1)::BIGINT AS msg_index, role, text, timestamp FROM p""",
    "document_scan": """
WITH m AS (
  SELECT conv_id AS trace_id, turn::BIGINT AS place, CASE WHEN lower(role) IN ('user', 'human', 'user_message') THEN 'user' ELSE 'assistant' END AS role, text FROM conversations WHERE conv_id % 4 < 2
  UNION ALL SELECT conv_id, 0, 'user', arg_min(text, turn) FROM conversations WHERE conv_id % 4 = 2 GROUP BY conv_id
  UNION ALL SELECT conv_id, 0, 'assistant', arg_min(text, turn) FROM conversations WHERE conv_id % 4 = 3 GROUP BY conv_id
  UNION ALL SELECT DISTINCT conv_id, 1000000 + k, 'assistant', odd FROM conversations, (VALUES (1, '7'), (2, 'None'), (3, 'True'), (4, 'two'), (5, 'nan')) o(k, odd) WHERE conv_id % 4 = 0)
SELECT trace_id, (row_number() OVER (PARTITION BY trace_id ORDER BY place) - 1)::BIGINT AS msg_index, role, text FROM m""",
    "parse_roundtrip": f"WITH {narrated_sql()} SELECT trace_id, msg_index, role, text, timestamp FROM narrated",
    "plain_text_blocks": f"""WITH b AS (
  SELECT conv_id AS trace_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS block, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, trim(text, {BLANK}) || chr(10) || 'and more' AS text FROM conversations
  UNION ALL SELECT DISTINCT conv_id, 0, 'assistant', 'before all' FROM conversations)
SELECT * FROM b""",
    "agent_sniff": """WITH r AS (SELECT event_id // 10 AS trace_id, event_id % 10 AS raw_index, CASE WHEN event_id % 10 < 5 THEN 6 ELSE event_id % 8 END AS shape FROM events),
a AS (SELECT trace_id, arg_min(CASE WHEN shape < 2 THEN 'codex' WHEN shape < 4 THEN 'claude_code' ELSE 'pi' END, raw_index) FILTER (shape < 6) AS agent FROM r GROUP BY 1)
SELECT trace_id, CASE trace_id % 7 WHEN 3 THEN 'codex' WHEN 5 THEN 'claude_code' ELSE coalesce(agent, 'unknown') END AS agent FROM a""",
    "model_apply": f"""{EPISODES}, t AS (SELECT trace_id, max(msg_index) AS last, trace_id % 5 = 4 AS echo FROM narrated WHERE trace_id % 5 <> 3 GROUP BY 1),
s AS (SELECT *, CASE WHEN echo THEN 0 ELSE least(2, last) END AS start_index, CASE WHEN echo THEN last ELSE least(9, last) END AS end_index FROM t)
SELECT s.trace_id, 'E01' AS episode_id, CASE WHEN echo THEN 'Difficulty episode' ELSE 'T' END AS title, start_index, end_index, a.timestamp AS start_time, b.timestamp AS end_time, {duration("a.timestamp", "b.timestamp")} AS duration_label,
       CASE WHEN echo THEN '' ELSE 'D' END AS reported_difficulty, CASE WHEN echo THEN 'unknown' ELSE 'compatibility_risk' END AS difficulty_type, 'unknown' AS appraisal,
       CASE WHEN echo THEN 'not_resolved' ELSE 'unknown' END AS outcome_claim, CASE WHEN echo THEN 'unknown' ELSE 'yes' END AS productive_detour, CASE WHEN echo THEN '' ELSE 'q1 | q2' END AS evidence_quotes
FROM s JOIN narrated a ON a.trace_id = s.trace_id AND a.msg_index = start_index JOIN narrated b ON b.trace_id = s.trace_id AND b.msg_index = end_index
UNION ALL SELECT trace_id, episode_id, title, start_index, end_index, start_time, end_time, duration_label, reported_difficulty, difficulty_type, appraisal, outcome_claim, productive_detour, evidence_quotes
FROM episodes WHERE trace_id % 5 = 3""",
    "progress_plan": """WITH n AS (SELECT conv_id AS trace_id, count(*) AS total, greatest(1, ceil(count(*) / 30.0))::BIGINT AS chunk FROM conversations GROUP BY 1),
c AS (SELECT *, unnest(range(1, ceil(total / chunk)::BIGINT + 1)) AS k FROM n), p AS (SELECT *, least(k * chunk, total) AS processed FROM c)
SELECT trace_id, 'redact' AS stage, CASE WHEN processed < total THEN 2 ELSE 3 END AS step, round_even(12 + 28 * (processed / total::DOUBLE), 0)::INT AS pct, processed, total FROM p
UNION ALL SELECT trace_id, stage, step, pct, total, total FROM n, (VALUES ('extract', 2, 12), ('chart', 4, 55), ('classify', 5, 62), ('synthesize', 5, 70)) s(stage, step, pct)""",
    "codebook_lookup": f"""{COUNTS}, book(axis, code, ordinal, meaning) AS (VALUES {", ".join(f"('{a}', '{c}', {k}, {lit(m)})" for a, codes in V.CODEBOOK.items() for k, (c, m) in enumerate(codes.items()))})
SELECT b.axis, b.code, b.ordinal, b.meaning, coalesce(sum(n), 0)::BIGINT AS n FROM book b LEFT JOIN counts c ON c.axis = b.axis AND c.code = b.code GROUP BY ALL""",
}
