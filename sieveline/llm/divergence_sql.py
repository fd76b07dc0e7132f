"""The distribution-divergence query in DuckDB SQL, written from the operator's own parameters."""

from __future__ import annotations

from .divergence import CLASSES, COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS

_SPACE = r"[\x20\x09-\x0D]"


def _distance(counts: list[str], total: str, shares: list[str]) -> str:
    parts = []
    for c, q in zip(counts, shares):
        p, m = f"({c}::DOUBLE / {total})", f"(({c}::DOUBLE / {total} + {q}) / 2)"
        parts.append(f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END")
    return f"sqrt(greatest(({' + '.join(parts)}) / 2, 0))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    langs = sorted(COMMON_WORDS)
    removed = ["dense"]
    for pattern in CLASSES.values():
        removed.append(f"regexp_replace({removed[-1]}, {_quoted(pattern)}, '', 'g')")
    n_chars = len(CLASSES) + 1
    chars = [f"length({removed[i]}) - length({removed[i + 1]})" for i in range(n_chars - 1)] + [f"length({removed[-1]})"]
    counted = ", ".join([*(f"{c} AS c{i}" for i, c in enumerate(chars)), *(f"len(list_filter(low, lambda x: x = {_quoted(w)})) AS w_{g}_{i}" for g in langs for i, w in enumerate(COMMON_WORDS[g]))])
    sums = [f"sum(c{i}) AS s{i}" for i in range(n_chars)] + ["sum(n_words) AS sn"] + [f"sum(w_{g}_{i}) AS s_{g}_{i}" for g in langs for i in range(len(COMMON_WORDS[g]))]
    every, tests, char_names, word_names = [], [], [], []
    for g in langs:
        k = len(COMMON_WORDS[g])
        total = "(" + " + ".join(f"r_{g}.s{i}" for i in range(n_chars)) + ")"
        own = " + ".join(f"w_{g}_{i}" for i in range(k))
        own_sum = " + ".join(f"r_{g}.s_{g}_{i}" for i in range(k))
        dc = _distance([f"c{i}" for i in range(n_chars)], "greatest(word_chars, 1)", [f"(r_{g}.s{i}::DOUBLE / {total})" for i in range(n_chars)])
        dw = _distance([*(f"w_{g}_{i}" for i in range(k)), f"(n_words - ({own}))"], "greatest(n_words, 1)", [*(f"(r_{g}.s_{g}_{i}::DOUBLE / r_{g}.sn)" for i in range(k)), f"((r_{g}.sn - ({own_sum}))::DOUBLE / r_{g}.sn)"])
        every += [f"CASE WHEN long_enough AND r_{g}.lang IS NOT NULL THEN {dc} END AS dc_{g}", f"CASE WHEN long_enough AND r_{g}.lang IS NOT NULL THEN {dw} END AS dw_{g}"]
        tests.append(f"coalesce(dc_{g} <= {MAX_CHAR_DISTANCE[0]} + {MAX_CHAR_DISTANCE[1]} / sqrt(greatest(word_chars, 1)) AND dw_{g} <= {MAX_WORD_DISTANCE[0]} + {MAX_WORD_DISTANCE[1]} / sqrt(greatest(n_words, 1)), false)")
        char_names.append(f"dc_{g}")
        word_names.append(f"dw_{g}")
    joins = " ".join(f"LEFT JOIN refs r_{g} ON r_{g}.lang = '{g}'" for g in langs)
    base = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
 s AS (SELECT rid, doc_id, lang, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 g AS (SELECT rid, i, ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM s)),
 again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
 covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY rid),
 b AS (SELECT s.rid, doc_id, lang, len(ws) AS n_words, coalesce(array_to_string(ws, ''), '') AS dense, list_transform(ws, lambda x: lower(x)) AS low, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM s LEFT JOIN covered USING (rid)),
 f AS (SELECT doc_id, lang, n_words, length(dense) AS word_chars, length(dense) - length(regexp_replace(dense, '[#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
 length(dense) >= {MIN_CHARS} AND n_words >= {MIN_WORDS} AS long_enough, {counted} FROM b),
 refs AS (SELECT lang, {", ".join(sums)} FROM f WHERE NOT base_failed AND lang IN ({", ".join(_quoted(g) for g in langs)}) GROUP BY lang),
 m AS (SELECT f.doc_id, f.lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, long_enough, {", ".join(every)} FROM f {joins})
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND ((SELECT count(*) FROM refs) = 0 OR coalesce(lang NOT IN (SELECT lang FROM refs), false) OR NOT long_enough OR {" OR ".join(tests)}) AS kept,
 round(least({", ".join(char_names)}), 4) AS char_distance, round(least({", ".join(word_names)}), 4) AS word_distance FROM m"""
