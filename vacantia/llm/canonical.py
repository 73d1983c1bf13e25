"""Freely typed values to the closest entry of a reference list: partition-based pigeonhole join, in SQL only.

Both sides are folded (full-width forms, accents, case, spacing and punctuation between word
parts; wording around a skill). A reference text is cut into EDITS + 1 segments; within EDITS
edits at least one of them stands unchanged in the typed text, at most EDITS places from its own
position, so candidates come from equality joins on (length, segment, text) alone. Candidates are
verified with the built-in levenshtein; what finds none is reported by an anti-join.

Defined results: null and blank values get no row; a value that means no entry gets -1; equally
close entries are decided by equal marks (# and +), then the shorter entry, then the smaller id.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame

EDITS = 5
#: Wording around a typed skill, in front and behind.
BEFORE = (
    "very good|good|excellent|strong|advanced|basic|solid|hands-on|experience with|experience in|knowledge of|knows|expert in|proficient in|"
    "notions de|connaissances en|conocimientos de|kenntnisse in|conhecimentos de|kennis van|experiencia con|erfahrung mit"
)
BEHIND = r"skills?|developer|experience|\(\d+\+? ?(?:yrs?|years?)\)|v ?\d+(?:\.\d+)*|\d+(?:\.\d+)*|/ ?(?:required|preferred|optional)"


def _fold_table() -> tuple[str, str]:
    """Single characters and what they fold to: full-width forms and accented Latin letters, by rule."""
    pairs = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(c):
            pairs[chr(c)] = base
    pairs |= dict.fromkeys("\u3000\u00a0\u202f\u2009", " ")
    # quotes and backslashes are written differently in SQL dialects; as punctuation they fall away later
    pairs = {k: v for k, v in pairs.items() if v not in "'\\"}
    return "".join(pairs), "".join(pairs.values())


def fold_sql(column: str) -> str:
    """SQL that folds a typed text to words: lower case, plain letters, one blank between words, wording around it removed."""
    source, target = _fold_table()
    text = f"lower(translate({column}, '{source}', '{target}'))"
    text = _replace(text, r"[\x{0300}-\x{036f}\x{200b}-\x{200d}\x{feff}]", "")
    text = _replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}#+)]+$", "")
    for _ in range(2):
        text = _replace(text, rf"^(?:{BEFORE})\s+", "")
        text = _replace(text, rf"[\s]+(?:{BEHIND})$", "")
        text = _replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}#+)]+$", "")
    return _replace(text, r"[^\p{L}\p{N}#+]+", " ")


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}' /*all*/)"


def _squash(words: str) -> str:
    return f"replace({words}, ' ', '')"


def spark_sql(sql: str) -> str:
    for mark, name in ((" /*all*/", ""), ("/*two*/", "$2 $1")):
        sql = sql.replace(mark, name)
    return sql.replace("\\", "\\\\")


def duckdb_sql(sql: str) -> str:
    for mark, name in ((" /*all*/", ", 'g'"), ("/*two*/", "\\2 \\1")):
        sql = sql.replace(mark, name)
    return sql


def _sides(typed: str, reference: str) -> str:
    """Common table expressions of both sides: typed (value, words, folded), names (entry_id, words) and entries (entry_id, r, n).

    An entry of two words also stands with the two exchanged.
    """
    real = _replace("value", r"[\s\x{00a0}\x{3000}\x{200b}\x{feff}]", "")
    return f"""
    typed AS (SELECT value, words, {_squash("words")} AS folded FROM (SELECT value, {fold_sql("value")} AS words FROM {typed} WHERE {real} <> '') w),
    names AS (SELECT entry_id, {fold_sql("name")} AS words FROM {reference}),
    entries AS (SELECT DISTINCT entry_id, r, length(r) AS n FROM (
      SELECT entry_id, {_squash("words")} AS r FROM names UNION ALL
      SELECT entry_id, {_squash(_replace("words", r"^(\S+) (\S+)$", "/*two*/"))} AS r FROM names) v WHERE r <> '')"""


_CLOSER = "((instr(t, '#') > 0) <> (instr(r, '#') > 0))"


def _final(best: str) -> str:
    return f"SELECT value, coalesce(b.entry_id, -1) AS entry_id FROM typed LEFT JOIN {best} b ON folded = b.t"


def match(typed: DataFrame, reference: DataFrame, edits: int = EDITS) -> DataFrame:
    """typed (value), distinct, against reference (entry_id, name): one row per non-blank value with entry_id or -1."""
    # at most a third of the entry may differ, so that short entries don't take in everything
    sql = f"""
    WITH {_sides("TYPED", "REFERENCE")},
    texts AS (SELECT DISTINCT folded AS t, length(folded) AS m FROM typed WHERE folded <> ''),
    parts AS (SELECT entry_id, r, n, seg, CAST(floor(seg * n / {edits + 1}) AS INT) AS at, CAST(floor((seg + 1) * n / {edits + 1}) AS INT) - CAST(floor(seg * n / {edits + 1}) AS INT) AS len
      FROM entries LATERAL VIEW explode(sequence(0, {edits})) s AS seg),
    sizes AS (SELECT DISTINCT n, seg, at, len FROM parts WHERE len > 0),
    keys AS (SELECT DISTINCT t, n, seg, substring(t, at + shift + 1, len) AS piece
      FROM texts JOIN sizes ON abs(m - n) <= {edits} LATERAL VIEW explode(sequence(-{edits}, {edits})) s AS shift
      WHERE at + shift >= 0 AND at + shift + len <= m),
    candidates AS (SELECT DISTINCT k.t, p.entry_id, p.r FROM keys k JOIN parts p ON k.n = p.n AND k.seg = p.seg AND k.piece = substring(p.r, p.at + 1, p.len)),
    verified AS (SELECT t, entry_id, r, levenshtein(t, r) AS d FROM candidates),
    best AS (SELECT t, min(struct(d, {_CLOSER} AS marks, length(r) AS n, entry_id)).entry_id AS entry_id FROM verified WHERE d <= least({edits}, length(r) / 3) GROUP BY t)
    {_final("best")}"""
    # braces of the patterns are doubled, as the frames come in by name
    text = spark_sql(sql).replace("{", "{{").replace("}", "}}").replace("TYPED", "{typed}").replace("REFERENCE", "{reference}")
    return typed.sparkSession.sql(text, typed=typed, reference=reference)


def match_oracle(typed_sql: str, reference_sql: str, edits: int = EDITS) -> str:
    """The same by brute force over all pairs of distinct folded texts, for DuckDB."""
    return duckdb_sql(
        f"""
    WITH {_sides(f"({typed_sql}) q", f"({reference_sql}) q")},
    texts AS (SELECT DISTINCT folded AS t FROM typed WHERE folded <> ''),
    near AS (SELECT t, entry_id, row_number() OVER (PARTITION BY t ORDER BY levenshtein(t, r), {_CLOSER}, length(r), entry_id) AS k
      FROM texts, entries WHERE levenshtein(t, r) <= least({edits}, length(r) / 3))
    {_final("(SELECT t, entry_id FROM near WHERE k = 1)")}"""
    )
