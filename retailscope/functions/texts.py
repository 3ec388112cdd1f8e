"""Text expressions for documents, excerpts and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters, the characters that end a line besides \n, and the
# characters of words (everything else; the common range first, because ranges are tried in order).
SPACES = (
    " \t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = r"[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
WORD = (
    r"[!-~\u00a1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}"
    r"\u0000-\u0008\u000e-\u001b\u007f-\u0084\u0086-\u009f]++"
)
EXCERPT = 200
INSUFFICIENT = "INSUFFICIENT DATA"


def stripped(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.btrim(text, F.lit(SPACES))


def stripped_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def normal_lines(text: Column) -> Column:
    """Every line end as \\n. Texts that have no other line end are passed through."""
    return F.when(text.rlike(LINE_ENDS), F.regexp_replace(text, r"\r\n|" + LINE_ENDS, "\n")).otherwise(text)


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(WORD))


def excerpt(text: Column, length: int = EXCERPT) -> Column:
    """The first `length` characters, with an ellipsis when the text goes on."""
    return F.concat(stripped_end(F.substring(text, 1, length)), F.when(F.length(text) > length, "…").otherwise(""))


def says_insufficient(reply: Column) -> Column:
    return F.upper(stripped(reply)).startswith(INSUFFICIENT)

