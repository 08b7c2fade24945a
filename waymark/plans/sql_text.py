"""Longer pieces of the DuckDB texts: categories, event classes, rule windows."""

from __future__ import annotations

from waymark.plans.inputs import ROUTES, isin, names
from waymark.rulesets import fabrication as fab


def category_case(column: str) -> str:
    tests = [f"WHEN {column} IN ({names(v)}) THEN '{k}'" for k, v in fab.CATEGORY_STEPS.items()]
    tests += [f"WHEN starts_with(upper({column}), '{p}') THEN '{c}'" for p, c in fab.CATEGORY_PREFIXES]
    tests += [f"WHEN contains(upper({column}), '{w}') THEN '{c}'" for w, c in fab.CATEGORY_KEYWORDS]
    return "CASE " + " ".join(tests) + " ELSE 'UNKNOWN' END"


def block_case(column: str) -> str:
    tests = []
    for name, parts, starts in fab.BLOCKS:
        any_of = [f"contains(upper({column}), '{p}')" for p in parts]
        any_of += [f"starts_with(upper({column}), '{p}')" for p in starts]
        tests.append(f"WHEN {' OR '.join(any_of)} THEN '{name}'")
    return "CASE " + " ".join(tests) + " ELSE 'OTHER' END"


_LITHO = ("category = 'LITHO' AND NOT contains(upper(step), 'SPIN COAT') "
          "AND NOT contains(upper(step), 'COAT PHOTORESIST')")
_FLAG = {"exposes_resist": f"({_LITHO} AND contains(upper(step), 'EXPOSE'))",
         "develops_resist": f"({_LITHO} AND NOT contains(upper(step), 'EXPOSE') AND contains(upper(step), 'DEVELOP'))"}


def _suggested(event: str) -> str:
    hints, tests = fab.UNKNOWN_EVENTS[event], ["FALSE"]
    if "categories" in hints:
        tests.append(f"category IN ({names(hints['categories'])})")
    for group in hints.get("words", []):
        words = " AND ".join(f"list_contains(string_split_regex(upper(step), '\\s+'), '{w}')" for w in group)
        tests.append(f"(category IN ({names(hints['word_categories'])}) AND {words})")
    tests += [_FLAG[f] for f in hints.get("flags", [])]
    tests += [_suggested(e) for e in hints.get("events", [])]
    return "(" + " OR ".join(tests) + ")"


def event_test(event: str) -> str:
    """Membership of step (with its category) in an event class or milestone."""
    if event in fab.MILESTONE_WORDS:
        stem, others = fab.MILESTONE_WORDS[event]
        words = " OR ".join(f"contains(upper(step), '{o}')" for o in others)
        return f"(upper(step) IN ({names(fab.EXACT.events[event])}) OR (contains(upper(step), '{stem}') AND ({words})))"
    prefix = " OR ".join(f"starts_with(upper(step), '{p}')" for p in fab.EVENT_PREFIXES.get(event, [])) or "FALSE"
    listed = [n for n in fab.EXACT.events[event] if not n.endswith("*")]
    known = f"step IN ({names(listed)})" if listed else "FALSE"
    return (f"({prefix} OR CASE WHEN step IN ({names(fab.CATEGORISED)}) THEN {known} "
            f"ELSE {_suggested(event)} END)")


# canonical names with their category and one 0/1 column per event
CLASS_FLAGS = f"""c0 AS (SELECT user_id, ts, event_id, family, step_index,
  upper(trim(regexp_replace(step, '\\s+', ' ', 'g'))) AS step FROM j),
c1 AS (SELECT *, {category_case('step')} AS category FROM c0),
c AS (SELECT *, {', '.join(f"CASE WHEN {event_test(e)} THEN 1 ELSE 0 END AS is_{e.lower()}" for e in fab.BY_CLASS.events)}
  FROM c1)"""

_PART = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN"


def _near(flag: str, n: int) -> str:
    return f"coalesce(max({flag}) {_PART} {n} PRECEDING AND 1 PRECEDING), 0)"


def _ever(flag: str) -> str:
    return f"coalesce(max({flag}) {_PART} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


CLASS_VIOLATIONS = f"""cw AS (SELECT *, {_near('is_clean_surface', 12)} AS clean12, {_near('is_expose', 15)} AS expose15,
  {_near('is_develop', 15)} AS develop15, {_near('is_develop', 12)} AS develop12,
  {_near('is_implant_opener', 15)} AS opener15, {_near('is_deposit_or_fill', 6)} AS fill6,
  {_ever('is_passivation_deposited')} AS deposited, {_ever('is_passivation_cured')} AS cured,
  {_ever('is_sort_test')} AS sorted,
  CASE WHEN starts_with(step, 'ALIGN MASK LEVEL') THEN
    TRY_CAST(regexp_extract(step, '\\b(\\d+)\\s*$', 1) AS INT) END AS level FROM c),
cx AS (SELECT *, last_value(level IGNORE NULLS) {_PART} UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM cw),
cv AS (
  SELECT user_id, family, step_index, step, 'RULE_DEP_NO_CLEAN' AS rule FROM cx WHERE is_deposition = 1 AND clean12 = 0
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_METAL_ETCH_NO_LITHO' FROM cx
    WHERE is_metal_etch = 1 AND (expose15 = 0 OR develop15 = 0)
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_ETCH_NO_MASK' FROM cx
    WHERE is_patterned_etch = 1 AND develop12 = 0
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_IMPLANT_NO_MASK' FROM cx
    WHERE is_implant = 1 AND opener15 = 0
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_CMP_NO_DEP' FROM cx WHERE is_cmp = 1 AND fill6 = 0
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_LITHO_LEVEL_SKIP' FROM cx
    WHERE prior > 0 AND (level > prior + 1 OR level < prior)
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_PAD_OPEN_BEFORE_DEP' FROM cx
    WHERE is_pad_window_open = 1 AND (deposited = 0 OR cured = 0)
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_TEST_BEFORE_PASSIVATION' FROM cx
    WHERE is_electrical_test = 1 AND cured = 0
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_SHIP_BEFORE_TEST' FROM cx WHERE is_ship = 1 AND sorted = 0
  UNION ALL SELECT user_id, family, step_index, step, 'RULE_BACKSIDE_BEFORE_PASSIVATION' FROM cx
    WHERE is_backside_metal = 1 AND cured = 0)"""


def exact_violations(source: str = "j") -> str:
    flag = lambda event: f"CASE WHEN {isin('step', fab.EXACT.events[event])} THEN 1 ELSE 0 END"
    test = lambda event: isin("step", fab.EXACT.events[event])
    pick = lambda rule, where: (f"SELECT user_id, family, step_index, step, {i[rule]} AS rule_ord, '{rule}' AS rule "
                                f"FROM x WHERE {where}")
    i = {r.rule: n for n, r in enumerate(fab.EXACT.rules, 1)}
    parts = [
        pick("RULE_DEP_NO_CLEAN", f"{test('DEPOSITION')} AND clean12 = 0"),
        pick("RULE_METAL_ETCH_NO_LITHO", f"{test('METAL_ETCH')} AND (expose15 = 0 OR develop15 = 0)"),
        pick("RULE_ETCH_NO_MASK", f"{test('PATTERNED_ETCH')} AND develop12 = 0"),
        pick("RULE_LITHO_LEVEL_SKIP", "level > prior + 1 OR level < prior"),
        pick("RULE_IMPLANT_NO_MASK", f"{test('IMPLANT')} AND opener15 = 0"),
        pick("RULE_CMP_NO_DEP", f"{test('CMP')} AND fill6 = 0"),
        pick("RULE_PAD_OPEN_BEFORE_DEP", f"{test('PAD_WINDOW_OPEN')} AND (deposited = 0 OR cured = 0)"),
        pick("RULE_TEST_BEFORE_PASSIVATION", f"{test('ELECTRICAL_TEST')} AND cured = 0"),
        pick("RULE_SHIP_BEFORE_TEST", f"{test('SHIP')} AND shipped = 0 AND sorted = 0"),
        pick("RULE_BACKSIDE_BEFORE_PASSIVATION", f"{test('BACKSIDE_METAL')} AND cured = 0")]
    return f"""w AS (SELECT user_id, ts, event_id, family, step_index, step,
  {_near(flag('CLEAN_SURFACE'), 12)} AS clean12, {_near(flag('EXPOSE'), 15)} AS expose15,
  {_near(flag('DEVELOP'), 15)} AS develop15, {_near(flag('DEVELOP'), 12)} AS develop12,
  {_near(flag('IMPLANT_OPENER'), 15)} AS opener15, {_near(flag('DEPOSIT_OR_FILL'), 6)} AS fill6,
  {_ever(flag('PASSIVATION_DEPOSITED'))} AS deposited, {_ever(flag('PASSIVATION_CURED'))} AS cured,
  {_ever(flag('SORT_TEST'))} AS sorted, {_ever(flag('SHIP'))} AS shipped,
  CASE WHEN regexp_matches(step, '^ALIGN MASK LEVEL [0-9]+$') THEN CAST(substr(step, 18) AS INT) END AS level
  FROM {source}),
x AS (SELECT *, last_value(level IGNORE NULLS) {_PART} UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM w),
v AS ({' UNION ALL '.join(parts)})"""


def _first(test: str) -> str:
    return f"min(CASE WHEN {test} THEN step_index END)"


_BLOCK_TESTS = {
    "b1": "contains(up, 'INTERLAYER DIELECTRIC') OR contains(up, 'INTERLEVEL DIELECTRIC')",
    "b2": "contains(up, 'VIA') AND (contains(up, 'FILL') OR contains(up, 'ETCH'))",
    "b3": "up IN ('DEPOSIT METAL 1', 'DEPOSIT TOP METAL')",
    "b4": "starts_with(up, 'DEPOSIT PASSIVATION')",
    "b5": "up = 'DEPOSIT BACKSIDE METAL'", "b6": "up = 'SHIP LOT'",
    "sort_i": "up = 'WAFER SORT TEST'", "yield_i": "up = 'YIELD ANALYSIS'",
    "param_i": "up IN ('PARAMETRIC TEST', 'ELECTRICAL PARAMETRIC TEST')"}
_AHEAD = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND"

ADVISORY_SQL = f"""WITH {ROUTES},
a0 AS (SELECT *, upper(step) AS up, {category_case('step')} AS category FROM j),
a AS (SELECT *, CASE WHEN {event_test('EXPOSE')} THEN 1 ELSE 0 END AS expose,
  CASE WHEN {event_test('DEVELOP')} THEN 1 ELSE 0 END AS develop,
  CASE WHEN {event_test('CLEAN_SURFACE')} THEN 1 ELSE 0 END AS clean,
  {event_test('PATTERNED_ETCH')} AS etch, {event_test('IMPLANT')} AS implant,
  CASE WHEN starts_with(up, 'STRIP ') THEN 1 ELSE 0 END AS strip,
  CASE WHEN category = 'ANNEAL' OR contains(up, 'ANNEAL') OR contains(up, 'DRIVE IN') OR starts_with(up, 'RTA')
    OR contains(up, 'RAPID THERMAL') THEN 1 ELSE 0 END AS anneal,
  CASE WHEN starts_with(up, 'ALIGN MASK LEVEL ') THEN 1 ELSE 0 END AS align FROM a0),
b AS (SELECT *, coalesce(max(strip) {_AHEAD} 6 FOLLOWING), 0) AS strip6,
  coalesce(max(clean) {_AHEAD} 8 FOLLOWING), 0) AS clean8, coalesce(max(anneal) {_AHEAD} 12 FOLLOWING), 0) AS anneal12,
  count(*) OVER (PARTITION BY user_id) AS n,
  sum(align) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cycle FROM a),
y AS (SELECT user_id, cycle, max(expose) AS expose, max(develop) AS develop, min(step_index) AS step_index
  FROM b WHERE cycle > 0 GROUP BY 1, 2),
f AS (SELECT user_id, {', '.join(f'{_first(t)} AS {n}' for n, t in _BLOCK_TESTS.items())} FROM b GROUP BY 1),
p AS (SELECT user_id, k, i, lag(i) OVER (PARTITION BY user_id ORDER BY k) AS earlier FROM (
  {' UNION ALL '.join(f'SELECT user_id, {n} AS k, b{n} AS i FROM f WHERE b{n} IS NOT NULL' for n in range(1, 7))})),
o AS (SELECT user_id, 'SPEC_BAD_START' AS code, step_index FROM b WHERE step_index = 0 AND up <> 'RECEIVE WAFER LOT'
  UNION ALL SELECT user_id, 'SPEC_BAD_END', step_index FROM b WHERE step_index = n - 1 AND up <> 'SHIP LOT'
  UNION ALL SELECT user_id, 'SPEC_LITHO_FIRST_NOT_1', step_index FROM b WHERE align = 1 AND cycle = 1
    AND regexp_matches(trim(substr(up, 18)), '^[0-9]+$') AND TRY_CAST(trim(substr(up, 18)) AS INT) <> 1
  UNION ALL SELECT user_id, 'SPEC_ETCH_NO_STRIP', step_index FROM b WHERE etch AND strip6 = 0
  UNION ALL SELECT user_id, 'SPEC_ETCH_NO_CLEAN', step_index FROM b WHERE etch AND clean8 = 0
  UNION ALL SELECT user_id, 'SPEC_IMPLANT_NO_ANNEAL', step_index FROM b WHERE implant AND anneal12 = 0
  UNION ALL SELECT user_id, 'SPEC_LITHO_NO_DEVELOP', step_index FROM y WHERE develop = 0
  UNION ALL SELECT user_id, 'SPEC_LITHO_NO_EXPOSE', step_index FROM y WHERE develop = 1 AND expose = 0
  UNION ALL SELECT user_id, 'SPEC_BLOCK_ORDER', i FROM p WHERE earlier > i
  UNION ALL SELECT user_id, 'SPEC_TEST_ORDER', param_i FROM f WHERE param_i > sort_i
  UNION ALL SELECT user_id, 'SPEC_TEST_ORDER', yield_i FROM f WHERE yield_i < sort_i)
SELECT o.user_id, code, o.step_index, j.step FROM o JOIN j ON j.user_id = o.user_id AND j.step_index = o.step_index"""
