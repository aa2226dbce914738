"""A canonical view of a text (NFKC, no zero-width characters) and the way back to its spans."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that vanish, and the one that becomes a space.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
NO_BREAK = "\u00a0"
# Fixed values end.

#: A text of these characters alone is its own canonical form (a test holds this against unicodedata).
PLAIN = r"\x00-\x7F\u00A1-\u00A7\u00AB\u00BB\u00BF-\u0131\u0134-\u013E\u0400-\u0482\u048A-\u052F\u2012-\u2014\u2018-\u201D\u4E00-\u9FFF"
VIEW = "struct<text:string,starts:array<int>,ends:array<int>>"


def canonical(text: str) -> tuple[str, list[int], list[int]]:
    """The canonical text, and for each of its characters the start and end in ``text``.

    A character and the combining marks after it are normalised together.
    """
    out, starts, ends, at = [], [], [], 0
    while at < len(text):
        end = at + 1
        if text[at] not in ZERO_WIDTH:
            while end < len(text) and unicodedata.combining(text[end]):
                end += 1
            made = unicodedata.normalize("NFKC", text[at:end].replace(NO_BREAK, " ", 1) if text[at] == NO_BREAK else text[at:end])
            for c in made.replace(NO_BREAK, " "):
                if c not in ZERO_WIDTH:
                    out.append(c)
                    starts.append(at)
                    ends.append(end)
        at = end
    return "".join(out), starts, ends


def _views(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([canonical(t) if t is not None else (None, None, None) for t in texts], columns=["text", "starts", "ends"])


def view(text: Column) -> Column:
    """struct<text, starts, ends>, of nulls where the text is null or its own canonical form.

    Only texts with other than plain characters reach Python. Marked as not deterministic, so that
    the optimizer never copies the call into the expressions that use it.
    """
    made = F.pandas_udf(_views, VIEW).asNondeterministic()
    # Most characters are ASCII; the class of many ranges is only asked about the others.
    return made(F.when(text.rlike(rf"(?=[^\x00-\x7F])[^{PLAIN}]"), text))


def original_span(view: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end in the original of a span that is not empty in the canonical text."""
    size = end - start
    return F.array_min(F.slice(view["starts"], start + 1, size)), F.array_max(F.slice(view["ends"], start + 1, size))
