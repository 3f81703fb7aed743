"""DuckDB expressions that mean the same as the column functions of ``functions.text``."""

from quillspark.functions.text import STOPWORDS, UNCHANGED


def words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def camel(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]{{2,}})([A-Z][a-z])', '\1 \2', 'g')"


def raw_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({camel(f'coalesce({x}, {chr(39)}{chr(39)})')}), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


def unigrams(x: str) -> str:
    """A set: DuckDB's list_distinct keeps no order."""
    return f"list_distinct(list_filter({raw_tokens(x)}, lambda t: t NOT IN {words(STOPWORDS)}))"


def singular(t: str) -> str:
    return (
        f"CASE WHEN {t} IN {words(UNCHANGED)} OR length({t}) <= 3 THEN {t} WHEN {t} = 'statuses' THEN 'status' WHEN {t} LIKE '%ies' THEN left({t}, -3) || 'y' "
        f"WHEN regexp_matches({t}, '(sses|shes|ches|xes)$') THEN left({t}, -2) WHEN regexp_matches({t}, '(ss|us|is)$') THEN {t} WHEN {t} LIKE '%s' THEN left({t}, -1) ELSE {t} END"
    )


def singulars(tokens: str) -> str:
    return f"list_distinct(list_transform({tokens}, lambda t: {singular('t')}))"


def forms(tokens: str) -> str:
    return f"list_distinct(flatten(list_transform({tokens}, lambda t: [t, {singular('t')}])))"


def token_set(x: str) -> str:
    return forms(unigrams(x))


def segments(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda s: s <> '' AND NOT (s LIKE '{{%' AND s LIKE '%}}'))"


def word_stream(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
