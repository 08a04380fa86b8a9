"""Text rules as Column -> Column expressions (no UDFs; everything stays in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packwright.params import (
    DELETED_CHARS,
    EOS_TOKEN,
    MIN_SUMMARY_CHARS,
    SKIPPED_SECTION_TITLES,
    SPACE_LIKE_CHARS,
    SUMMARY_INFIX,
    WS,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text) -> Column:
    """Whitespace clean-up with the result of the five ordered rules (newline+ws ->
    newline, ws+newline -> newline, newline+ws+newline -> two newlines, strip leading,
    strip trailing), in two regex passes.

    The first two rules turn every maximal whitespace run that holds a newline into a
    single newline and leave other runs alone; after them the third rule can never
    match (no newline is followed by whitespace any more). So pass one rewrites
    ``ws* newline ws*`` to one newline, pass two strips both ends. ``WS`` is Python's
    Unicode whitespace set (Java's ``\\s`` is ASCII only)."""
    t = _c(text)
    t = F.regexp_replace(t, F.lit(WS + "*\n" + WS + "*"), F.lit("\n"))
    return F.regexp_replace(t, F.lit(r"\A" + WS + "+|" + WS + r"+\z"), F.lit(""))


def cut_tail(text) -> Column:
    """Keep the text before the earliest tail marker. For References and External links
    the double-newline variant is preferred when present anywhere; for Charts the
    single-newline form always wins (it is a prefix of the double form)."""
    t = _c(text)

    def pos(marker: str, prefer_double: bool) -> Column:
        single = F.instr(t, marker + "\n")
        if not prefer_double:
            return F.nullif(single, F.lit(0))
        double = F.instr(t, marker + "\n\n")
        return F.nullif(F.when(double > 0, double).otherwise(single), F.lit(0))

    cut = F.least(pos("References", True), pos("External links", True), pos("Charts", False))
    return F.when(cut.isNull(), t).otherwise(F.substring(t, F.lit(1), cut - F.lit(1)))


def strip_controls(text) -> Column:
    """NBSP and ideographic space -> space; delete 0x05, U+FFFD, 0x10, 0x08, 0x18."""
    return F.translate(_c(text), SPACE_LIKE_CHARS + DELETED_CHARS, " " * len(SPACE_LIKE_CHARS))


def normalise_text_end(text) -> Column:
    """Ordered end-of-text rewrites applied after the eos marker is appended."""
    t = _c(text)
    for a, b in (
        ("。。" + EOS_TOKEN, "。" + EOS_TOKEN),
        ("\n\n" + EOS_TOKEN, EOS_TOKEN),
        ("\n" + EOS_TOKEN, EOS_TOKEN),
        (EOS_TOKEN + EOS_TOKEN, EOS_TOKEN),
    ):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def assemble_baike(title, summary, sections, title_is_clean: bool = False) -> Column:
    """Encyclopedia article: cleaned title, optional summary paragraph, every kept
    section as ``title-section_title\\ncontent``; then eos and the end rewrites.

    Pass an already cleaned title column with ``title_is_clean`` (see
    :func:`with_baike_text`) so it is not re-cleaned inside the per-section lambda."""
    t = _c(title) if title_is_clean else clean_text(title)
    s = _c(summary)
    summary_part = (
        F.when(s.isNull() | (s == t) | (F.length(s) < MIN_SUMMARY_CHARS), F.lit(""))
        .otherwise(F.concat(t, F.lit(SUMMARY_INFIX), s, F.lit("\n")))
    )
    skipped = F.array(*[F.lit(x) for x in SKIPPED_SECTION_TITLES])

    def cleaned(sec: Column) -> Column:
        content = F.replace(clean_text(sec["content"]), F.concat(F.lit("\xa0\xa0"), t))
        return F.struct(sec["title"].alias("title"), content.alias("content"))

    def piece(sec: Column) -> Column:
        joiner = F.when(sec["title"].endswith("\n") | sec["content"].startswith("\n"), F.lit("")).otherwise(F.lit("\n"))
        return F.concat(t, F.lit("-"), sec["title"], joiner, sec["content"])

    kept = F.filter(_c(sections), lambda sec: ~F.array_contains(skipped, sec["title"]))
    body = F.array_join(F.transform(F.transform(kept, cleaned), piece), "")
    text = F.concat(summary_part, F.coalesce(body, F.lit("")), F.lit(EOS_TOKEN))
    return strip_controls(normalise_text_end(text))


def content_length(summary, sections) -> Column:
    """Summary length (0 when null) plus every section's title+content length."""
    secs = F.aggregate(
        F.coalesce(_c(sections), F.array().cast("array<struct<title:string,content:string>>")),
        F.lit(0).cast("bigint"),
        lambda acc, sec: acc + F.length(sec["title"]) + F.length(sec["content"]),
    )
    return F.coalesce(F.length(_c(summary)), F.lit(0)).cast("bigint") + secs


def assemble_wikipedia(title, text, eos: str = EOS_TOKEN) -> Column:
    return F.concat(_c(title), F.lit("\n"), cut_tail(text), F.lit(eos))


def assemble_plain(text, eos: str = EOS_TOKEN) -> Column:
    return F.concat(_c(text), F.lit(eos))


def prompt_text(instruction, input_) -> Column:
    """Instruction, plus newline and input when the input is not empty."""
    i, x = _c(instruction), _c(input_)
    return F.when(x != "", F.concat(i, F.lit("\n"), x)).otherwise(i)


def template_replace(text, pairs) -> Column:
    t = _c(text)
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def with_baike_text(df, out: str = "text", title: str = "title", summary: str = "summary",
                    sections: str = "sections"):
    """DataFrame form of :func:`assemble_baike`: the title is cleaned once per row."""
    d = df.withColumn("__clean_title", clean_text(title))
    return d.withColumn(out, assemble_baike("__clean_title", summary, sections, title_is_clean=True)).drop(
        "__clean_title")
