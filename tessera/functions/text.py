"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import TASK_STATUS, lookup


def normalize_label(c: Column) -> Column:
    """Trimmed, inner white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))


def normalize_alias(c: Column) -> Column:
    """Trimmed and lower case; inner white space stays."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c: Column, text: str) -> Column:
    """Case-insensitive substring; wildcards in the text are literal."""
    return c.ilike(f"%{escape_like(text)}%")


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis if cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(c.substr(1, most - 1), F.lit("…")))


def first_line(c: Column, most: int = 80) -> Column:
    """First non-blank line, trimmed and cut."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(lines, F.lit(0)).substr(1, most)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def wikilinks_to_text(c: Column) -> Column:
    """[[target|alias]] becomes alias, [[target]] becomes target."""
    return F.regexp_replace(F.regexp_replace(c, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]|]*)\]\]", "$1")


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def bigrams(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"\s+", " ")
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of distinct bigrams."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def coerce_task_status(c: Column) -> Column:
    """Canonical task state of a spelling, null if none."""
    return lookup(TASK_STATUS, F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"))


def label_with_aliases(label: Column, aliases: Column) -> Column:
    """label (aka a, b): aliases other than the label, without repeats by case."""
    other = F.filter(aliases, lambda a: F.lower(a) != F.lower(label))
    kept = F.filter(other, lambda a, i: F.array_position(F.transform(other, F.lower), F.lower(a)) == i + 1)
    return F.when(F.size(kept) > 0, F.concat(label, F.lit(" (aka "), F.array_join(kept, ", "), F.lit(")"))).otherwise(label)


def json_flag(c: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(c, f"$.{key}") == "true", F.lit(False))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A reproducible id: prefix and 26 hex digits of a digest."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.concat_ws("\x1f", *parts), 256).substr(1, 26))


def locate_verbatim(content: Column, quote: Column, most: int = 240) -> Column:
    """The words of a quote as they stand in a text, byte for byte: where it occurs as it is, else where it occurs with other white space between its words. Null for blank and
    longer quotes, and where it isn't found. Case counts."""
    needle = F.regexp_replace(quote, r"(?U)^\s+|\s+$", "")
    words = F.transform(F.split(needle, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    loose = F.call_function("regexp_extract", content, F.concat(F.lit("(?U)"), F.array_join(words, r"\s+")), F.lit(0))
    found = F.when(F.contains(content, needle), needle).when(loose != "", loose)
    return F.when((needle != "") & (F.length(needle) <= most), found)
