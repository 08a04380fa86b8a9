"""Helpers that render the same fixed values as DuckDB SQL for the oracle queries."""

from __future__ import annotations

from packwright.params import (
    DELETED_CHARS,
    EOS_TOKEN,
    MIN_SUMMARY_CHARS,
    PRETOKEN_PATTERN,
    SKIPPED_SECTION_TITLES,
    SPACE_LIKE_CHARS,
    SUMMARY_INFIX,
    WS,
)


def lit(s: str) -> str:
    """SQL string literal; characters below 0x20 and the odd ones go through chr()."""
    parts, buf = [], []
    for ch in s:
        if ord(ch) < 0x20 or ch in "\x85\xa0　�":
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def clean_text(x: str) -> str:
    nl = "chr(10)"
    t = f"regexp_replace({x}, {nl} || {lit(WS + '+')}, {nl}, 'g')"
    t = f"regexp_replace({t}, {lit(WS + '+')} || {nl}, {nl}, 'g')"
    t = f"regexp_replace({t}, {nl} || {lit(WS + '+')} || {nl}, {nl} || {nl}, 'g')"
    t = f"regexp_replace({t}, {lit(chr(92) + 'A' + WS + '+')}, '', 'g')"
    t = f"regexp_replace({t}, {lit(WS + '+' + chr(92) + 'z')}, '', 'g')"
    return t


def cut_tail(x: str) -> str:
    def pos(marker: str, prefer_double: bool) -> str:
        single = f"instr({x}, {lit(marker + chr(10))})"
        if not prefer_double:
            return f"nullif({single}, 0)"
        double = f"instr({x}, {lit(marker + chr(10) + chr(10))})"
        return f"nullif(CASE WHEN {double} > 0 THEN {double} ELSE {single} END, 0)"

    cut = f"least({pos('References', True)}, {pos('External links', True)}, {pos('Charts', False)})"
    return f"(CASE WHEN {cut} IS NULL THEN {x} ELSE substring({x}, 1, {cut} - 1) END)"


def strip_controls(x: str) -> str:
    return f"translate({x}, {lit(SPACE_LIKE_CHARS + DELETED_CHARS)}, '  ')"


def normalise_text_end(x: str) -> str:
    e = EOS_TOKEN
    t = x
    for a, b in (("。。" + e, "。" + e), ("\n\n" + e, e), ("\n" + e, e), (e + e, e)):
        t = f"replace({t}, {lit(a)}, {lit(b)})"
    return t


def assemble_baike(title: str, summary: str, sections: str) -> str:
    t = clean_text(title)
    summ = (
        f"(CASE WHEN {summary} IS NULL OR {summary} = {t} OR length({summary}) < {MIN_SUMMARY_CHARS} "
        f"THEN '' ELSE {t} || {lit(SUMMARY_INFIX)} || {summary} || chr(10) END)"
    )
    skipped = ", ".join(lit(s) for s in SKIPPED_SECTION_TITLES)
    content = f"replace({clean_text('s.content')}, {lit(chr(0xa0) * 2)} || {t}, '')"
    piece = (
        f"{t} || '-' || s.title || (CASE WHEN suffix(s.title, chr(10)) OR prefix({content}, chr(10)) "
        f"THEN '' ELSE chr(10) END) || {content}"
    )
    body = (
        f"coalesce(array_to_string(list_transform(list_filter({sections}, lambda s: NOT list_contains([{skipped}], s.title)), "
        f"lambda s: {piece}), ''), '')"
    )
    return strip_controls(normalise_text_end(f"({summ} || {body} || {lit(EOS_TOKEN)})"))


def content_length(summary: str, sections: str) -> str:
    return (
        f"(coalesce(length({summary}), 0) + coalesce(list_sum(list_transform({sections}, "
        f"lambda s: length(s.title) + length(s.content))), 0))::BIGINT"
    )


def pretokens(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(PRETOKEN_PATTERN)}, 0)"
