"""Lexical facts of one script as native column expressions.

Tokens follow POSIX shell quoting inside one command segment: words end at
blanks, single quotes keep everything, double quotes allow ``\\"`` and ``\\\\``,
a backslash outside quotes keeps the next character, and an unquoted ``#`` ends
the segment.  A segment whose quotes do not balance is split on white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed as K

WHITE = " \t\n\r\x0b\x0c"
BREAK_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = "\r\n|[" + BREAK_CHARS + "]"
# Possessive repeats keep Java's matcher iterative on segments of any length.
BALANCED = r"""^((?:[^'"\\#]++|\\[\s\S]|'[^']*+'|"(?:[^"\\]++|\\[\s\S])*+")*+)(?:#[\s\S]*)?$"""
WORD = r"""(?:[^ \t\r\n'"\\]++|\\[\s\S]|'[^']*+'|"(?:[^"\\]++|\\[\s\S])*+")++"""
PIECE = r"""[^'"\\]++|\\[\s\S]|'[^']*+'|"(?:[^"\\]++|\\[\s\S])*+\""""


def _count(text: Column, pattern: str, *needs: str) -> Column:
    """Matches of ``pattern``; texts without any of ``needs`` skip the regex."""
    n = F.regexp_count(text, F.lit(pattern)).cast("int")
    return F.when(contains_any(text, needs), n).otherwise(F.lit(0)) if needs else n


def contains_any(text: Column, words) -> Column:
    """A plain substring test, far cheaper than a regex."""
    test = text.contains(words[0])
    for w in words[1:]:
        test = test | text.contains(w)
    return test


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def extract_urls(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.contains("://"), F.array_distinct(
        _all(text, "(?i)" + K.URL_PATTERN))).otherwise(none)


def extract_paths(text: Column) -> Column:
    found = _all(text, r"(?<![\w-])" + K.PATH_BODY, 1)
    return F.array_distinct(F.filter(found, lambda p: ~p.startswith("/dev/")))


def extract_devices(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.contains("/dev/"), F.array_distinct(
        _all(text, K.DEVICE_PATTERN))).otherwise(none)


def line_count(text: Column) -> Column:
    """Lines as an editor shows them: a final break opens no extra line."""
    open_tail = (F.length(text) > 0) & (F.instr(F.lit(BREAK_CHARS), F.right(text, F.lit(1))) == 0)
    breaks = F.when(contains_any(text, BREAK_CHARS[1:]), _count(text, LINE_BREAK)).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))
    return breaks + F.when(open_tail, 1).otherwise(0)


def comment_lines(text: Column) -> Column:
    return _count(text, "(?:^|[" + BREAK_CHARS + r"])\s*#(?!!)", "#")


def pipe_count(text: Column) -> Column:
    return _count(text, r"(?<![|])\|(?![|])", "|")


def command_substitutions(text: Column) -> Column:
    return _count(text, K.SUBSTITUTION_PATTERN, "$(", "`")


def redirections(text: Column) -> Column:
    return _count(text, r"(?<![0-9])>>?|<<?", ">", "<")


def background_jobs(text: Column) -> Column:
    return _count(text, r"&(?!&)", "&")


def heredocs(text: Column) -> Column:
    return _count(text, K.HEREDOC_PATTERN, "<<")


def basename(word: Column) -> Column:
    return F.substring_index(F.btrim(strip(word), F.lit("\"'")), "/", -1)


def pipes_to_shell(text: Column) -> Column:
    # start + length must stay an int; no array reaches 2**30 segments
    fed = F.slice(F.split(text, r"\|"), F.lit(2), F.lit(2**30))
    found = F.exists(
        fed,
        lambda s: basename(F.regexp_extract(strip(s), r"^(sudo\s+)?(\S+)", 2)).isin(
            K.SHELL_INTERPRETERS),
    )
    return text.contains("|") & found


def split_segments(text: Column) -> Column:
    """Command segments, trimmed, without empty ones and comments.

    Every separator is made of the four characters, so the runs between them are
    the segments (extraction keeps one compiled pattern; ``split`` would not).
    """
    trimmed = F.transform(_all(text, r"[^;|&\n]+"), strip)
    return F.filter(trimmed, lambda s: (s != "") & ~s.startswith("#"))


def _unquote(word: Column) -> Column:
    def piece(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - F.lit(2))
        return (
            F.when(p.startswith("'"), inner)
            .when(p.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(p.startswith("\\"), F.substring(p, F.lit(2), F.lit(1)))
            .otherwise(p)
        )

    return F.when(
        word.rlike(r"""['"\\]"""), F.array_join(F.transform(_all(word, PIECE), piece), "")
    ).otherwise(word)


def tokenize(segment: Column) -> Column:
    """Words of one segment with quotes removed."""
    quoted = F.transform(_all(F.regexp_extract(segment, BALANCED, 1), WORD), _unquote)
    return (
        F.when(~segment.rlike(r"""['"\\#]"""), _all(segment, r"[^ \t\r\n]+"))
        .when(segment.rlike(BALANCED), quoted)
        .otherwise(_all(segment, r"\S+"))
    )


def segment_words(segments: Column) -> Column:
    """array<array<string>>: the words of every segment."""
    return F.transform(segments, tokenize)


def _plain_word(word: Column) -> Column:
    """True for a word that can be a command: no assignment, no block keyword."""
    assignment = word.contains("=") & word.rlike(K.ASSIGNMENT_PATTERN)
    return ~assignment & ~word.isin(K.SKIPPED_WORDS)


def commands_of(segments: Column) -> Column:
    """Command names: the first word of a segment that is neither an assignment
    nor a block keyword, without its folder; ordered, distinct.

    Most segments start with the command and hold no quotes: their first word is
    cut off without splitting the rest.  Repeated segments are looked at once.
    """
    def first(segment: Column) -> Column:
        head = F.substring_index(segment, " ", 1)
        simple = ~segment.rlike(r"""['"\\#\t\r]""") & _plain_word(head)
        return F.when(simple, head).otherwise(
            F.get(F.filter(tokenize(segment), _plain_word), F.lit(0)))

    firsts = F.filter(
        F.transform(F.array_distinct(segments), first), lambda c: c.isNotNull() & (c != "") & ~c.startswith("-"))
    return F.array_distinct(F.transform(firsts, basename))


def flags_of(words: Column) -> Column:
    flat = F.flatten(words)
    return F.array_distinct(F.filter(flat, lambda t: t.startswith("-") & (F.length(t) > 1)))


def parse_scripts(df: DataFrame, text: str = "script") -> DataFrame:
    """Add every lexical column; Catalyst drops those nobody reads."""
    t = F.col(text)
    return (
        df.withColumn("segments", split_segments(t))
        .withColumn("seg_words", segment_words(F.col("segments")))
        .withColumns({
            "parsed_with": F.lit("fallback"),
            "commands": commands_of(F.col("segments")),
            "flags": flags_of(F.col("seg_words")),
            "words": F.flatten("seg_words"),
            "paths": extract_paths(t),
            "urls": extract_urls(t),
            "devices": extract_devices(t),
            "pipe_count": pipe_count(t),
            "pipes_to_shell": pipes_to_shell(t),
            "command_substitutions": command_substitutions(t),
            "redirections": redirections(t),
            "background_jobs": background_jobs(t),
            "heredocs": heredocs(t),
            "line_count": line_count(t),
            "comment_lines": comment_lines(t),
        })
    )


PARSED_COLUMNS = ["parsed_with", "commands", "flags", "words", "paths", "urls", "devices",
                  "pipe_count", "pipes_to_shell", "command_substitutions", "redirections",
                  "background_jobs", "heredocs", "line_count", "comment_lines"]


def as_parsed_struct(df: DataFrame) -> DataFrame:
    """Fold the lexical columns into one ``parsed`` struct."""
    return df.withColumn("parsed", F.struct(*PARSED_COLUMNS)).drop(
        "segments", "seg_words", *PARSED_COLUMNS)
