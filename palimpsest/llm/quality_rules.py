"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in SQL expression (no user function): a row's text is
split once, the counts are taken from the word and line arrays, and every rule
of the table becomes one integer comparison of the same projection.

Defined results: a null text counts as an empty one (all counts 0, not kept);
repeated rows each get their own row; extra columns are ignored by
``quality_rules(..., keep=())``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Frequent function words of four languages.
STOP_WORDS = (
    "a", "about", "also", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "for", "from",
    "had", "has", "have", "he", "her", "his", "if", "in", "into", "is", "it", "its", "more", "not", "of", "on", "one",
    "or", "other", "our", "she", "so", "some", "than", "that", "the", "their", "them", "there", "they", "this", "to",
    "was", "we", "were", "what", "when", "which", "who", "will", "with", "would", "you", "your",
    "aber", "als", "am", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine",
    "einem", "einen", "einer", "er", "es", "haben", "hat", "ich", "im", "ist", "mit", "nach", "nicht", "noch", "nur",
    "oder", "sich", "sie", "sind", "und", "von", "vor", "war", "wie", "wird", "zu", "zum", "zur",
    "al", "como", "con", "de", "del", "el", "en", "entre", "era", "esta", "este", "fue", "la", "las", "lo", "los",
    "no", "para", "pero", "por", "que", "se", "ser", "sin", "sobre", "son", "su", "sus", "una", "y",
    "au", "aux", "avec", "ce", "ces", "cette", "dans", "du", "elle", "est", "et", "il", "ils", "je", "le", "les",
    "leur", "mais", "ne", "nous", "ont", "ou", "par", "pas", "plus", "pour", "qui", "sa", "ses", "sont", "sur", "un",
    "une", "vous",
)

BLANKS = r"[\\x20\\x09-\\x0D]+"
BLANK_CHARS = r" \t\n\u000B\u000C\r"


@dataclass(frozen=True)
class Rule:
    """Fails a document if ``100 * part > limit * whole`` (or ``<``), once ``whole >= least``."""

    name: str
    part: str
    whole: str
    limit: int
    over: bool = True
    least: int = 1

    def sql(self) -> str:
        return f"({self.whole} >= {self.least} AND 100 * {self.part} {'>' if self.over else '<'} {self.limit} * {self.whole})"


#: The production table. Parts and wholes are counts of the projection below.
RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", 12),
    Rule("marks_per_word", "n_marks", "n_words", 40),
    Rule("long_mean_word", "word_chars", "n_words", 1600, least=10),
    Rule("short_mean_word", "word_chars", "n_words", 200, over=False, least=10),
    Rule("few_stop_words", "n_stop_words", "n_words", 1, over=False, least=60),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50, least=4),
)

_REPEATS = """
CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
  aggregate(
    transform(array(array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
      array_sort(transform(
        filter(s, (p, j) -> coalesce(p.h = get(s, j - 1).h, false) OR coalesce(p.h = get(s, j + 1).h, false)),
        p -> p.i)))[0],
    struct(-5 AS last, 0L AS n),
    (a, p) -> struct(p AS last, a.n + least(5, p - a.last) AS n),
    a -> a.n)
END
"""


def _projection(text: str) -> list[str]:
    """Select expressions, each layer as one list: arrays, hashes, counts."""
    t = f"coalesce({text}, '')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return [
        f"filter(split({t}, '{BLANKS}'), x -> x != '') AS _w",
        f"filter(split({t}, '\\\\n'), x -> translate(x, '{BLANK_CHARS}', '') != '') AS _l",
        f"CAST(length(translate({t}, '{BLANK_CHARS}', '')) AS LONG) AS word_chars",
        f"CAST(length({t}) - length(translate({t}, '#*$%&|<>', '')) AS LONG) AS n_symbols",
        f"CAST(length({t}) - length(translate({t}, '!', '')) AS LONG) AS n_marks",
    ], [
        "CAST(size(_w) AS LONG) AS n_words",
        "CAST(size(_l) AS LONG) AS n_lines",
        "CAST(size(_l) - size(array_distinct(_l)) AS LONG) AS n_dup_lines",
        f"CAST(size(filter(_w, x -> lower(x) IN ({stop}))) AS LONG) AS n_stop_words",
        "transform(array(transform(_w, x -> xxhash64(x))), v -> CASE WHEN size(v) < 6 THEN array() ELSE "
        "transform(sequence(0, size(v) - 5), i -> xxhash64(v[i], v[i + 1], v[i + 2], v[i + 3], v[i + 4])) END)[0] AS _h",
    ]


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules=RULES) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the failed rules of every document.

    ``keep`` columns are carried along. Windows are compared by a 64-bit hash of
    five 64-bit word hashes. A null text counts as an empty one.
    """
    carried = [f"`{c}`" for c in keep]
    first, second = _projection(f"`{text}`")
    counts = ["word_chars", "n_symbols", "n_marks"]
    a = docs.selectExpr(*carried, *first)
    b = a.selectExpr(*carried, *counts, *second)
    counts += ["n_words", "n_lines", "n_dup_lines", "n_stop_words"]
    c = b.selectExpr(*carried, *counts, f"transform(array(_h), h -> {_REPEATS})[0] AS n_repeat_words")
    failed = ", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in rules)
    base = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    d = c.selectExpr("*", f"{base} AS base_failed", f"filter(array({failed}), x -> x IS NOT NULL) AS failed_rules")
    return d.selectExpr("*", "NOT base_failed AND size(failed_rules) = 0 AS kept")


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    row = docs.selectExpr("struct(*) AS _row", f"`{text}` AS _text")
    return quality_rules(row, "_text", ("_row",), rules).where("kept").select("_row.*")


def oracle_sql(rules=RULES) -> str:
    """The same result in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    fails = " OR ".join(r.sql() for r in rules)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
a AS (SELECT doc_id,
        list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l,
        CAST(length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(x) - length(replace(x, '!', '')) AS BIGINT) AS n_marks
      FROM t),
b AS (SELECT doc_id, word_chars, n_symbols, n_marks, w,
        CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words
      FROM a),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
        FROM b, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM rep, unnest(range(0, 5)) AS v(k) GROUP BY doc_id),
c AS (SELECT b.* EXCLUDE (w), coalesce(cov.n, 0) AS n_repeat_words FROM b LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({fails}) AS kept
FROM c"""
