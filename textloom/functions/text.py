"""Text expressions as Spark columns.

Every function takes and returns a Column (or builds one from names) and stays inside
the JVM.  Positions are code points, counted from 0; ranges are half open.
Survey ids (SC-n) are given where a function implements one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space in texts with Unicode content, for a character class.
UNICODE_SPACE = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Dashes that match as a hyphen.
DASHES = "[\\u2010-\\u2015\\u2212]"
HEADER_JOIN = " > "
NEWLINE_SIGN, ELLIPSIS = "⏎", "…"
#: Fixed value: the sentence by which an answer declines.
REFUSAL = r"(?i)\bdo(?:es)? not contain (?:this|the|that) information\b"
#: Scores of labels.
LABEL_SCORES = {"yes": 1.0, "partial": 0.5, "no": 0.0}


def estimated_tokens(text: Column) -> Column:
    """SC-1: one token for every four characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4.0)).cast("int")


def tokens_of_length(length: Column) -> Column:
    """SC-1 for a length that is known without its text."""
    return F.ceil(length / F.lit(4.0)).cast("int")


def normalized(text: Column) -> Column:
    """SC-2: line ends to \\n, no blanks before them, at most two empty lines, one \\n at the end."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+(?=\n|\\z)", "")
    out = F.regexp_replace(out, "\n{4,}", "\n\n\n")
    return F.concat(F.regexp_replace(out, "\n+\\z", ""), F.lit("\n"))


def match_normalized(text: Column) -> Column:
    """SC-3: the form in which facts are looked up: hyphens, single blanks, lower case, a-b ranges."""
    out = F.regexp_replace(text, DASHES, "-")
    out = F.lower(unicode_trim(F.regexp_replace(out, f"[{UNICODE_SPACE}]+", " ")))
    return F.regexp_replace(out, "(\\d%?)\\s*(?:-|to)\\s*(?=\\d)", "$1-")


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\\z", "")


def unicode_rtrim(text: Column) -> Column:
    return F.regexp_replace(text, f"[{UNICODE_SPACE}]+\\z", "")


def leading_space(text: Column) -> Column:
    """SC-9: how many characters of white space a text starts with."""
    return F.length(text) - F.length(F.regexp_replace(text, f"^[{UNICODE_SPACE}]+", ""))


def slug(text: Column) -> Column:
    """SC-4: lower case, everything but a-z and 0-9 to single hyphens, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SC-5: SHA-256 of one text, or of several joined by |."""
    return F.sha2(parts[0] if len(parts) == 1 else F.concat_ws("|", *parts), 256)


def filled(template: str, text: Column) -> Column:
    """SC-6: a template with {text} replaced literally."""
    return F.replace(F.lit(template), F.lit("{text}"), text)


def header(path: Column, shown: Column) -> Column:
    """SC-7: the heading path before a section's text, or nothing."""
    return F.when(shown & (F.size(path) > 0), F.concat(F.array_join(path, HEADER_JOIN), F.lit("\n\n"))).otherwise(F.lit(""))


def between(text: Column, start: Column, stop: Column) -> Column:
    """SC-8: characters start..stop."""
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


def newlines_shown(text: Column) -> Column:
    """SC-10."""
    return F.replace(text, F.lit("\n"), F.lit(NEWLINE_SIGN))


def one_line(text: Column, width: int, escape_bars: bool = False) -> Column:
    """SC-11: on one line and at most ``width`` characters, with an ellipsis where cut."""
    flat = unicode_trim(F.regexp_replace(text, f"[{UNICODE_SPACE}]+", " "))
    if escape_bars:
        flat = F.replace(flat, F.lit("|"), F.lit("\\|"))
    short = F.concat(unicode_rtrim(F.substring(flat, 1, width - 1)), F.lit(ELLIPSIS))
    return F.when(F.length(flat) > width, short).otherwise(flat)


def mid_word(text: Column, at: Column) -> Column:
    """SC-12: a cut between two letters or digits."""
    return (at > 0) & F.substring(text, at, F.lit(2)).rlike("^[\\p{L}\\p{N}]{2}\\z")


def line_at(text: Column, at: Column) -> Column:
    """SC-14: the line a position is in."""
    return F.concat(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1), F.substring_index(F.substring(text, at + 1, F.length(text)), "\n", 1))


def cut_kind(text: Column, at: Column) -> Column:
    """SC-13: what a cut at ``at`` falls into; the first that applies."""
    before, after = F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1))
    line = F.regexp_replace(line_at(text, at), f"^[{UNICODE_SPACE}]+", "")
    tail = F.substring(text, F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2)))
    tail = F.regexp_replace(F.substring_index(tail, "\n", -1), " +\\z", "")
    edge = (at <= 0) | (at >= F.length(text))
    return (
        F.when(edge | (before == "\n") | (after == "\n"), F.lit("clean"))
        .when(line.startswith("|"), F.lit("table-row"))
        .when(line.startswith("- ") | line.startswith("* "), F.lit("list-item"))
        .when(line.startswith("#"), F.lit("heading"))
        .when(tail.rlike("[.?!]\\z"), F.lit("sentence-end"))
        .otherwise(F.lit("mid-sentence"))
    )


#: Characters shown on either side of a cut.
AROUND = 25
IN_WORD = "^[\\p{L}\\p{N}]{2}\\z"


def cut_kind_of(before: Column, after: Column, rest: Column) -> Column:
    """SC-13 for a cut inside a text, from its line up to it, what follows and the rest of its line (only looked at if the line begins at the cut)."""
    bare = F.regexp_replace(before, f"^[{UNICODE_SPACE}]+", "")
    line = F.when(F.length(bare) >= 2, bare).otherwise(F.regexp_replace(F.concat(before, rest), f"^[{UNICODE_SPACE}]+", ""))
    tail = F.regexp_replace(F.substring(before, F.greatest(F.length(before) - 1, F.lit(1)), F.lit(2)), " +\\z", "")
    return (
        F.when((before == "") | after.startswith("\n"), F.lit("clean"))
        .when(line.startswith("|"), F.lit("table-row"))
        .when(line.startswith("- ") | line.startswith("* "), F.lit("list-item"))
        .when(line.startswith("#"), F.lit("heading"))
        .when(tail.rlike("[.?!]\\z"), F.lit("sentence-end"))
        .otherwise(F.lit("mid-sentence"))
    )


def cut_context(text: Column, at: Column, width: int = 25) -> Column:
    """SC-15: the characters around a cut, with a bar at it and newlines shown."""
    start = F.greatest(at - width, F.lit(0))
    return newlines_shown(F.concat(between(text, start, at), F.lit("|"), between(text, at, at + width)))


def unit_length(vector: Column) -> Column:
    """SC-16: a vector of length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm == 0, vector).otherwise(F.transform(vector, lambda x: (x / norm).cast("float")))


def dot(a: Column, b: Column) -> Column:
    """SC-17: dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def refuses(answer: Column) -> Column:
    """SC-19."""
    return answer.rlike(REFUSAL)


def label_score(label: Column) -> Column:
    """SC-21: null for anything but a scored label."""
    out = F.lit(None).cast("double")
    for name, score in LABEL_SCORES.items():
        out = F.when(label == name, F.lit(score)).otherwise(out)
    return out


def percentage(value: Column, digits: int = 1) -> Column:
    """SC-23: a figure for a report; a dash where there is none."""
    return F.coalesce(F.format_string(f"%.{digits}f%%", value), F.lit("—"))


def shown_label(label: Column) -> Column:
    """SC-23: labels of a report; a no stands out."""
    return F.when(label == "no", F.lit("**no**")).otherwise(F.coalesce(label, F.lit("—")))


def window_id(number: Column) -> Column:
    """SC-24: id of a fixed window by its number from 0."""
    return F.format_string("A-%03d", number)


def path_safe(name: Column) -> Column:
    """SC-25: a model name that can be part of a path."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def citations(chunk_ids: Column) -> Column:
    """SC-26: citation number -> chunk id, by rank."""
    return F.map_from_arrays(F.transform(chunk_ids, lambda _, i: (i + 1).cast("string")), chunk_ids)


def first_label(*layers: tuple[str, Column]) -> tuple[Column, Column]:
    """SC-27: the first label that is not blank, and the name of its layer."""
    label, source = F.lit(""), F.lit("")
    for name, column in reversed(layers):
        value = F.nullif(F.trim(column), F.lit(""))
        label = F.coalesce(value, label)
        source = F.when(value.isNotNull(), F.lit(name)).otherwise(source)
    return label, source
