"""Pieces of the SQL counterparts: the same rules once more, in the dialect of the checking engine."""

from __future__ import annotations

from ..functions import rules as R

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def prose(x: str) -> str:
    return f"replace(lower(trim(regexp_replace(nfc_normalize({x}), '{WS}+', ' ', 'g'))), 'ß', 'ss')"


def code(x: str) -> str:
    blanks = WS.replace(r"\t-\r", r"\t\x0b-\r")
    lines = rf"regexp_replace(nfc_normalize(replace({x}, chr(13) || chr(10), chr(10))), '{blanks}+(\n|$)', '\1', 'g')"
    return strip(rf"regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def sha_mod(x: str, modulus: int = 100) -> str:
    acc = "0"
    for i in range(8):
        acc = f"(({acc} * {(1 << 32) % modulus} + ('0x' || substr(sha256({x}), {8 * i + 1}, 8))::BIGINT) % {modulus})"
    return acc


def split(x: str) -> str:
    m = sha_mod(f"('split:' || {x})")
    return f"CASE WHEN {m} < 80 THEN 'train' WHEN {m} < 90 THEN 'validation' ELSE 'test' END"


def fold(x: str, salt: str = "fold-v1") -> str:
    m = f"(('0x' || substr(sha256('{salt}:' || {x}), 1, 8))::BIGINT % 100)"
    return f"CASE WHEN {m} < 5 THEN 'validation' WHEN {m} < 10 THEN 'test' ELSE 'train' END"


def labels(x: str, patterns) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches({x}, {q('(?i)' + p)}) THEN {q(name)} END" for name, p in patterns)
    return f"list_filter([{each}], lambda l: l IS NOT NULL)"


def hints(low: str, words) -> str:
    return "(" + " + ".join(f"contains({low}, {q(w)})::INT" for w in words) + ")"


def first_best(low: str, table: dict, otherwise: str) -> str:
    counts = {k: hints(low, v) for k, v in table.items()}
    most = "greatest(" + ", ".join(counts.values()) + ")"
    whens = " ".join(f"WHEN {v} = {most} THEN {q(k)}" for k, v in counts.items())
    return f"CASE WHEN {most} = 0 THEN {q(otherwise)} {whens} END"


def values(name: str, columns: dict[str, str], rows: list[tuple]) -> str:
    """A common table of fixed rows."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]"
        if isinstance(v, dict):
            return "MAP {" + ", ".join(f"{lit(k)}: {lit(x)}" for k, x in v.items()) + "}"
        return q(v)

    body = ",\n".join("(" + ", ".join(f"CAST({lit(v)} AS {t})" for v, t in zip(r, columns.values(), strict=True)) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


_CATEGORIES = (*R.CATEGORIES, "cooking")
_DIFFICULTIES = (*R.DIFFICULTIES, "extreme")
CAND = ("cand AS (SELECT doc_id AS ord, 'doc-' || doc_id AS id, text AS instruction, CASE n_chars % 8 " + " ".join(f"WHEN {i} THEN {q(c)}" for i, c in enumerate(_CATEGORIES))
        + " END AS category, CASE n_chars % 5 " + " ".join(f"WHEN {i} THEN {q(c)}" for i, c in enumerate(_DIFFICULTIES)) + " END AS difficulty, lang AS language FROM documents)")

_shown = lambda v: "(" + ", ".join(f"''{x}''" for x in v) + ")"
ERRORS = f"""list_filter([
 CASE WHEN coalesce(length({strip('instruction')}), 0) = 0 THEN 'instruction is required and must be a non-empty string' END,
 CASE WHEN category IS NULL OR category NOT IN {listed(R.CATEGORIES)} THEN 'category must be one of {_shown(R.CATEGORIES)}, got ' || coalesce('''' || category || '''', 'None') END,
 CASE WHEN difficulty IS NULL OR difficulty NOT IN {listed(R.DIFFICULTIES)} THEN 'difficulty must be one of {_shown(R.DIFFICULTIES)}, got ' || coalesce('''' || difficulty || '''', 'None') END], lambda e: e IS NOT NULL)"""

CONTENT_HASH = f"""sha256(to_json({{'category': coalesce(category, ''), 'code': '', 'context': '', 'difficulty': coalesce(difficulty, ''), 'expected_answer': '', 'files': '{{}}'::JSON,
 'instruction': {prose("coalesce(instruction, '')")}, 'language': coalesce(language, ''), 'test_command': '[]'::JSON, 'tests': '[]'::JSON}})::VARCHAR)"""
INSTRUCTION_HASH = f"sha256(to_json({{'category': coalesce(category, ''), 'difficulty': coalesce(difficulty, ''), 'instruction': {prose("coalesce(instruction, '')")}, 'language': coalesce(language, '')}})::VARCHAR)"
HASHED = f"hashed AS (SELECT *, {CONTENT_HASH} AS content_hash, {INSTRUCTION_HASH} AS instruction_hash FROM cand)"


def score_dims(status: str, code_col: str = "NULL::VARCHAR", files: str = "false", answer: str = "NULL::VARCHAR", context: str = "NULL::VARCHAR", tests: str = "false", command: str = "false", timed_out: str = "false", unsafe: str = "false", indicators: str = "0", reasoning: str = "50.0") -> dict[str, str]:
    full = lambda x: f"(coalesce(length({x}), 0) > 0)"
    size, low = f"length({strip("coalesce(instruction, '')")})", "lower(coalesce(instruction, ''))"
    ex = f"(category IS NOT NULL AND category IN {listed(R.EXECUTABLE)})"
    ans = f"length({strip(f"coalesce({answer}, '')")})"
    given = " + ".join(f"{full(c)}::INT" for c in ("instruction", "language", "category", "difficulty", context, answer, code_col)) + f" + ({tests})::INT"
    return {
        "completeness": f"(({given}) * 12.5)::DOUBLE",
        "instruction_clarity": f"(CASE WHEN contains({low}, 'lorem') OR contains({low}, 'placeholder') OR contains({low}, 'this is a test') OR {size} < 8 THEN 20 WHEN {size} < 40 THEN 60 WHEN {size} > 1200 THEN 50 ELSE 90 END)::DOUBLE",
        "answer_presence": f"(CASE WHEN {ans} = 0 THEN 0 WHEN {ans} < 5 THEN 40 ELSE 100 END)::DOUBLE",
        "code_presence": f"(CASE WHEN NOT {ex} OR {full(code_col)} OR {files} THEN 100 ELSE 0 END)::DOUBLE",
        "test_presence": f"(CASE WHEN NOT {ex} OR {tests} OR {command} THEN 100 WHEN {files} THEN 90 ELSE 0 END)::DOUBLE",
        "verification_result": f"(CASE WHEN NOT {ex} THEN 100 WHEN {status} = 'passed' THEN 100 WHEN {status} = 'not_required' THEN 80 WHEN {timed_out} THEN 0 WHEN {status} IS NULL THEN 0 ELSE 20 END)::DOUBLE",
        "difficulty_base": "(CASE difficulty " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in R.DIFFICULTY_BASE.items()) + " ELSE 60 END)::DOUBLE",
        "reasoning_quality": f"({reasoning})::DOUBLE",
        "security_indicator": f"(CASE WHEN {unsafe} THEN 0 ELSE greatest(90 - 40 * {indicators}, 10) END)::DOUBLE",
    }


def score_total(dims: dict[str, str]) -> str:
    names = {"difficulty_base": "difficulty"}
    total = " + ".join(f"({v})::DECIMAL(8,2) * {R.WEIGHTS[names.get(k, k)]}::DECIMAL(3,2)" for k, v in dims.items())
    return f"round_even(({total})::DOUBLE, 1)"


CURATED = f"""{CAND}, {HASHED}, checked AS (SELECT *, {ERRORS} AS errors FROM hashed),
scored AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'malformed_record' END AS early, CASE WHEN len(errors) = 0 THEN {score_total(score_dims("'not_required'"))} END AS score FROM checked),
judged AS (SELECT * REPLACE (coalesce(early, CASE WHEN score < {R.MIN_SCORE} THEN 'low_quality' END) AS early) FROM scored),
firsts AS (SELECT instruction_hash, min(ord) AS first_ord, arg_min(id, ord) AS first_id, arg_min(content_hash, ord) AS first_hash FROM judged WHERE early IS NULL GROUP BY instruction_hash),
paired AS (SELECT judged.*, CASE WHEN early IS NULL AND ord <> first_ord THEN CASE WHEN content_hash = first_hash THEN 'exact' ELSE 'near_instruction' END END AS duplicate_type, first_id FROM judged LEFT JOIN firsts USING (instruction_hash)),
curated AS (SELECT ord, id, category, difficulty, language, instruction, content_hash, score, 'not_required' AS status, coalesce(early, CASE WHEN duplicate_type IS NOT NULL THEN 'duplicate' END) AS reason, duplicate_type,
 CASE WHEN early = 'malformed_record' THEN array_to_string(errors, '; ') WHEN early = 'low_quality' THEN 'score ' || score || ' below threshold 30.0' WHEN duplicate_type IS NOT NULL THEN duplicate_type || ' duplicate of ' || first_id END AS detail,
 CASE WHEN early IS NULL AND duplicate_type IS NULL THEN {split('content_hash')} END AS split FROM paired)"""
