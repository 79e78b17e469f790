"""Fragments of checking SQL used by several queries."""

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def ustrip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> '')"


def heading(e: str) -> str:
    t = ustrip(e)
    return (
        f"(regexp_matches({t}, '(?i)^(Chapter|章|第\\s*\\d+章|Part|部分|Section|节)\\s*\\d+')"
        f" OR regexp_matches({t}, '(?i)^(\\d+|[IVXLCDM]+|[A-Z])\\.\\s+')"
        f" OR (length({t}) < 100 AND right({t}, 1) NOT IN ('.', '!', '?', '。', '！', '？')"
        f" AND NOT regexp_matches(lower({t}), 'the|and|or|but|because')))"
    )


def clean_title(e: str) -> str:
    t = f"regexp_replace({ustrip(e)}, '(?i)^Page\\s*\\d+\\s*[:\\-]?\\s*', '')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    t = f"trim({t}, '•·-—–')"
    return f"concat(upper(substring({t}, 1, 1)), substring({t}, 2))"


def title_words(e: str) -> str:
    return f"list_sort(list_distinct({words(f'lower({e})')}))"
