"""Text rules as SQL, for the statements that queries are compared with."""

from stemline.functions.text import SUFFIXES


def _variants(suffix: str) -> str:
    """The spellings a stem may have had before ``suffix``, in order, for every ``token`` of ``v``."""
    stem, n = f"token[:-{len(suffix) + 1}]", len(suffix)
    plain = "regexp_matches({0}, '^[b-df-hj-np-tv-z]$')"
    last, before = f"{stem}[-1]", f"{stem}[-2]"
    doubled = f"length({stem}) >= 3 AND {last} = {before} AND {plain.format(last)}"
    dropped = f"{plain.format(last)} AND {last} NOT IN ('w', 'x', 'y') AND NOT {plain.format(before)}"
    kinds = (
        f"CASE WHEN {doubled} THEN {stem}[:-2] WHEN {dropped} THEN {stem} || 'e' END",
        f"CASE WHEN {last} = 'i' THEN {stem}[:-2] || 'y' END",
        stem,
        f"{stem} || 'e'",
    )
    return f"SELECT token AS word, unnest([0, 1, 2, 3]) + {SUFFIXES.index(suffix) * 4} AS i, unnest([{', '.join(kinds)}]) AS base FROM v WHERE token LIKE '%{suffix}' AND length(token) >= {n + 2}"


_CY = "SELECT token, unnest([1000, 1001]), unnest([token[:-3] || 't', token[:-3] || 'te']) FROM v WHERE token LIKE '%cy' AND length(token) >= 7"
#: ``stems``: ``word, base, place`` of what each ``token`` of a table ``v`` may be derived from, in the order to try.
STEMS = "raw AS (" + " UNION ALL ".join([*map(_variants, SUFFIXES), _CY]) + """),
stems AS (SELECT word, base, row_number() OVER (PARTITION BY word ORDER BY min(i)) - 1 AS place FROM raw WHERE base IS NOT NULL AND base <> word GROUP BY word, base)"""
