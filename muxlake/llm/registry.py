"""Queries of the operators and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from muxlake.llm import (
    op1_quality_crf,
    op2_decontamination,
    op3_token_files,
    op5_chat_collapse,
    op6_secret_scan,
    op7_ngram_join,
    op8_byte_bpe,
    op9_language_id,
    op10_quality_rules,
    op11_toxicity,
    op12_hard_negatives,
    op13_conversation_repair,
    op4_token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_crf": op1_quality_crf.query,
    "op2_decontamination": op2_decontamination.query,
    "op3_token_files": op3_token_files.query,
    "op4_token_counts": op4_token_counts.query,
    "op5_chat_collapse": op5_chat_collapse.query,
    "op6_secret_scan": op6_secret_scan.query,
    "op7_ngram_join": op7_ngram_join.query,
    "op8_byte_bpe": op8_byte_bpe.query,
    "op9_language_id": op9_language_id.query,
    "op10_quality_rules": op10_quality_rules.query,
    "op11_toxicity": op11_toxicity.query,
    "op12_hard_negatives": op12_hard_negatives.query,
    "op13_conversation_repair": op13_conversation_repair.query,
}

# Words as the contracts have them, as one regular expression of DuckDB.
_WORDS = r"regexp_extract_all({text}, '[^ \t\n\x0B\f\r]+')"


def _spans(rule: op6_secret_scan.Rule, scanned: str) -> str:
    """SQL of the list of a rule's spans: what stands between the matches gives their places."""
    q = scanned.replace("'", "''")
    keep = f"length(regexp_extract(m[k], '{rule.pattern.replace(chr(39), chr(39) * 2)}', {rule.group})) >= {rule.min_chars}"
    at = "CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT)"
    return (
        f"(SELECT list({{'s': {at}, 'o': {op6_secret_scan.RULES.index(rule)}, 'e': {at} + length(m[k]), 'k': '{rule.kind}'}} ORDER BY k) FILTER (WHERE {keep}) "
        f"FROM (SELECT regexp_extract_all(t, '{q}') AS m, regexp_split_to_array(t, '{q}') AS p) z, unnest(range(1, len(m) + 1)) u(k))"
    )


def _op6_sql() -> str:
    lists = ", ".join(f"coalesce({_spans(r, r.pattern)}, []) AS l_{r.kind}" for r in op6_secret_scan.RULES)
    listed = lambda x: f"array_to_string(list_transform({x}, lambda y: y.k || ':' || y.s || ':' || y.e), ',')"
    every = lambda rules: "list_sort(flatten([" + ", ".join(f"l_{r.kind}" for r in rules) + "]))"
    counts = ", ".join(f"CAST(len(l_{r.kind}) AS BIGINT) AS n_{r.kind}" for r in op6_secret_scan.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {lists} FROM d)
SELECT doc_id, {counts}, sha256({listed(every(op6_secret_scan.BASE))}) AS base_sha256, {listed(every(op6_secret_scan.RULES))} AS spans FROM f"""


#: Sets of five words, their pairs by a common one, and components by the smallest doc_id that is reached.
_OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="lower(coalesce(text, ''))")} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
c AS (SELECT doc_id, doc_id AS reached FROM g UNION SELECT c.doc_id, p.b FROM c JOIN p ON c.reached = p.a)
SELECT g.doc_id, (SELECT min(reached) FROM c WHERE c.doc_id = g.doc_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = g.doc_id) AS n_links FROM g"""

_OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k+7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) u(k)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twice, range(0, 8) r(j) GROUP BY doc_id),
raw AS (SELECT doc_id, host, x.l AS line, x.k AS k FROM (SELECT doc_id, host, string_split(t, chr(10)) AS s FROM d), LATERAL (SELECT unnest(s) AS l, generate_subscripts(s, 1) AS k) x),
lines AS (SELECT *, {_WORDS.format(text="lower(line)")} AS w FROM raw),
own AS (SELECT doc_id, host, line, k, len(w) AS n, array_to_string(w, ' ') AS h FROM lines WHERE len(w) > 0),
dup AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT doc_id, line, count(*) AS n FROM own GROUP BY doc_id, line) GROUP BY doc_id),
whole AS (SELECT doc_id, string_agg(h, chr(10) ORDER BY k) AS content FROM own GROUP BY doc_id),
often AS (SELECT host, h FROM own JOIN whole USING (doc_id) GROUP BY host, h HAVING count(DISTINCT content) > {op10_quality_rules.MAX_LINE_DOCS}),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM own SEMI JOIN often USING (host, h) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < {op10_quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {op10_quality_rules.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {op10_quality_rules.MIN_SHARE_LEFT} * n_words OR n_words - n_removed_words < {op10_quality_rules.MIN_WORDS_LEFT})) AS kept, n_removed_words FROM f"""

_OP5_SQL = f"""
WITH t AS (SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY turn, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
one AS (SELECT turns, min(conv_id) AS conv_id FROM t GROUP BY turns),
kept AS (SELECT * FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE len(b.turns) > len(a.turns) AND b.turns[1] IS NOT DISTINCT FROM a.turns[1] AND b.turns[1:len(a.turns)] = a.turns)),
r AS (SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, array_to_string(list_transform(turns, lambda y: '{op5_chat_collapse.TURN_START}' || coalesce(y.r, '') || chr(10) || coalesce(y.x, '') || '<|end|>' || chr(10)), '') AS s FROM kept)
SELECT conv_id, n_turns, CAST(length(s) AS BIGINT) AS n_chars, sha256(s) AS rendered_sha256 FROM r"""

#: SQL has no tokenizers, trained models or alignments; tests hold the other operators against libraries and brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_chat_collapse": _OP5_SQL,
    "op6_secret_scan": _op6_sql(),
    "op7_ngram_join": _OP7_SQL,
    "op10_quality_rules": _OP10_SQL,
    "op12_hard_negatives": op12_hard_negatives.ORACLE_SQL,
    "op13_conversation_repair": op13_conversation_repair.ORACLE_SQL,
}
