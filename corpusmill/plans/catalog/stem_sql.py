"""The stemmer as SQL, one common table expression per step."""

from __future__ import annotations

from corpusmill.functions.stemming import (
    DOUBLE, EXCEPTIONS, INVARIANT, R1_HEAD, R2_HEAD, SHORT_END, STEP2, STEP3, STEP4, VOWEL,
)


def _cut(word: str, suffix: str) -> str:
    return f"left({word}, length({word}) - {len(suffix)})"


def _like(word: str, pattern: str) -> str:
    return f"regexp_matches({word}, '{pattern}')"


def _cases(rules: list[tuple[str, str]]) -> str:
    """The outcome of the first suffix that the word x ends with."""
    return "CASE " + " ".join(f"WHEN ends_with(x, '{suffix}') THEN {outcome}" for suffix, outcome in rules) + " ELSE x END"


def _in_region(region: str, suffix: str) -> str:
    return _like("x", f"^{region}.*{suffix}$")


def _restored(stem: str) -> str:
    return (
        f"CASE WHEN {_like(stem, '(?:at|bl|iz)$')} THEN {stem} || 'e' WHEN {_like(stem, f'{DOUBLE}$')} THEN {_cut(stem, 'x')} "
        f"WHEN {_like(stem, SHORT_END)} AND NOT {_like(stem, f'^{R1_HEAD}.')} THEN {stem} || 'e' ELSE {stem} END"
    )


def _past(suffix: str) -> str:
    if suffix.startswith("eed"):
        return f"CASE WHEN {_in_region(R1_HEAD, suffix)} THEN {_cut('x', suffix)} || 'ee' ELSE x END"
    return f"CASE WHEN {_like(_cut('x', suffix), VOWEL)} THEN {_restored(_cut('x', suffix))} ELSE x END"


def _replaced(suffix: str, to: str) -> str:
    allowed = _in_region(R2_HEAD if suffix == "ative" else R1_HEAD, suffix)
    before = {"ogi": "l", "li": "[cdeghkmnrt]"}.get(suffix)
    if before:
        allowed += f" AND {_like('x', f'{before}{suffix}$')}"
    return f"CASE WHEN {allowed} THEN {_cut('x', suffix)} || '{to}' ELSE x END"


def _dropped(suffix: str) -> str:
    allowed = _in_region(R2_HEAD, suffix) + (f" AND {_like('x', '[st]ion$')}" if suffix == "ion" else "")
    return f"CASE WHEN {allowed} THEN {_cut('x', suffix)} ELSE x END"


_SHORTER = f"{_cut('x', 'ies')} || CASE WHEN length(x) > 4 THEN 'i' ELSE 'ie' END"
PLURAL = _cases([
    ("sses", f"{_cut('x', 'sses')} || 'ss'"), ("ies", _SHORTER), ("ied", _SHORTER), ("us", "x"), ("ss", "x"),
    ("s", f"CASE WHEN {_like('x', f'{VOWEL}.+s$')} THEN {_cut('x', 's')} ELSE x END"),
])
LATER = (
    _cases([(suffix, _past(suffix)) for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed")]),
    "regexp_replace(x, '^(.+[^aeiouy])[yY]$', '\\1i')",
    _cases([(suffix, _replaced(suffix, to)) for suffix, to in STEP2]),
    _cases([(suffix, _replaced(suffix, to)) for suffix, to in STEP3]),
    _cases([(suffix, _dropped(suffix)) for suffix in STEP4]),
    f"CASE WHEN ends_with(x, 'e') AND ({_in_region(R2_HEAD, 'e')} OR ({_in_region(R1_HEAD, 'e')} AND NOT {_like(_cut('x', 'e'), SHORT_END)})) "
    f"THEN {_cut('x', 'e')} WHEN {_like('x', 'll$')} AND {_in_region(R2_HEAD, 'l')} THEN {_cut('x', 'l')} ELSE x END",
)


def stems_sql(words: str, name: str = "stems") -> str:
    """Table ``name`` (term, stem) of the words that the query ``words`` gives as term."""
    steps = [
        f"""stem_0 AS MATERIALIZED (
  SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS x FROM ({words}) AS given
)""",
        f"stem_1 AS MATERIALIZED (SELECT term, {PLURAL} AS x FROM stem_0)",
        "stem_2 AS MATERIALIZED (SELECT term, x, x AS start FROM stem_1)",
    ]
    for at, step in enumerate(LATER):
        steps.append(f"stem_{at + 3} AS MATERIALIZED (SELECT term, start, {step} AS x FROM stem_{at + 2})")
    special = " ".join(f"WHEN '{word}' THEN '{stem}'" for word, stem in EXCEPTIONS.items())
    kept = ", ".join(f"'{word}'" for word in INVARIANT)
    steps.append(f"""{name} AS (
  SELECT term, CASE term {special} ELSE CASE WHEN length(term) <= 2 THEN term
    ELSE replace(CASE WHEN start IN ({kept}) THEN start ELSE x END, 'Y', 'y') END END AS stem
  FROM stem_{len(LATER) + 2}
)""")
    return ",\n".join(steps)
