"""Text from markup: HTML pages and subtitle files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed names: elements whose content is no text.
HIDDEN = ("script", "style")


def without_elements(html: Column, names: tuple[str, ...]) -> Column:
    """A space for each of the named elements, with all they hold."""
    whole = "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in names)
    return F.regexp_replace(html, f"(?is){whole}", " ")


def html_to_text(html: Column) -> Column:
    """Without script and style elements and tags, white space collapsed; entities stay."""
    words = F.split(F.regexp_replace(without_elements(html, HIDDEN), "<[^>]+>", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def normalized_url(url: Column) -> Column:
    """Lower-case scheme and host, path / by default, no fragment."""
    head = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]*", 0))
    rest = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^#]*)", 1)
    return F.concat(head, F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest))
