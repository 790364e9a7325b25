"""Column expressions for subtitle texts (srt, vtt, frame-numbered sub)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A timing line with the cue number before it, or the frame numbers that begin a line.
BETWEEN = r"\n(?:(?:[ \t]*\d+[ \t]*\n)?[ \t]*\d[\d:.,]*[ \t]*-+>[^\n]*|\{\d+\}\{\d+\})"
OUTER = " \t\n-"
#: Styling codes of the three formats.
STYLE = r"(?i)</?(?:i|b|u|s|c|v|ruby|rt|lang|font)(?:[ .][^<>\n]*)?>|\{\\[^{}\n]*\}|\{[a-z]:[^{}\n]*\}"


def unified(text: Column) -> Column:
    """Line ends as \n, without byte order marks. Plain replacements: no regular expression over the whole text."""
    t = F.replace(text, F.lit("﻿"), F.lit(""))
    return F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def cues(text: Column) -> Column:
    """array<string>: the texts between timings without outer blanks and dashes; a text without timings is one piece."""
    parts = F.split(F.concat(F.lit("\n"), unified(text)), BETWEEN)
    return F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(OUTER))), lambda p: p != "")


def unstyled(cue: Column) -> Column:
    """A cue without styling codes, with the bars of the frame format as line breaks."""
    return F.trim(F.regexp_replace(F.regexp_replace(cue, STYLE, ""), r"(?<!\*)\|(?!\*)", "\n"), F.lit(OUTER))
