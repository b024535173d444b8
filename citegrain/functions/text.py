"""Titles, abstracts and HTML cells. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abstract(inverted: Column) -> Column:
    """The text of a map of tokens to positions. Null stays null, an empty map is empty text; a
    negative, repeated or missing position is an error."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.cast("int").alias("at"), e["key"].alias("word")))))
    placed = F.array_sort(placed)
    ats = F.transform(placed, lambda p: p["at"])
    text = F.array_join(F.transform(placed, lambda p: p["word"]), " ")
    n = F.size(placed)
    return (
        F.when(inverted.isNull(), F.lit(None).cast("string"))
        .when(F.size(inverted) == 0, F.lit(""))
        .when(F.exists(ats, lambda p: p < 0), F.raise_error(F.lit("negative abstract position")).cast("string"))
        .when(F.size(F.array_distinct(ats)) < n, F.raise_error(F.lit("repeated abstract position")).cast("string"))
        .when(F.element_at(ats, -1) != n - 1, F.raise_error(F.lit("missing abstract position")).cast("string"))
        .otherwise(text)
    )


def title_key(title: Column) -> Column:
    """Lower case, letters, digits and underscores of any script only, 80 characters at most."""
    return F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\W+", ""), 1, 80)


#: What titles replace by what, in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))
TYPOGRAPHY = (
    ("′", "$'$"), ("’", "'"), ("″", "$''$"), ("‘", "`"), ("“", "``"), ("”", "''"), ("–", "--"), ("—", "---"), ("\xa0", " "), ("−", "$-$"),
    ("β", r"$\beta$"), ("α", r"$\alpha$"), ("γ", r"$\gamma$"), ("λ", r"$\lambda$"), ("μ", r"$\mu$"), ("∼", r"$\sim$"),
    ("ü", r"\"{u}"), ("ö", r"\"{o}"), ("ä", r"\"{a}"), ("é", r"\'{e}"), ("‐", "-"), ("‑", "-"),
)
MARKUP = ((r"^\[[0-9]+\]\s*", ""), (r"<i>(.*?)</i>", r"\\emph{$1}"), (r"<sub>(.*?)</sub>", r"\\textsubscript{$1}"), (r"<sup>(.*?)</sup>", r"\\textsuperscript{$1}"), (r"<[^>]+>", ""))
ACRONYMS = (("folin", "Folin"), ("i-labelled", "I-labelled"), ("dna", "DNA"), ("rna", "RNA"), ("atp", "ATP"), ("nmr", "NMR"))
ESCAPES = (("&", r"\&"), ("%", r"\%"), ("#", r"\#"), ("_", r"\_"))


def clean_title(title: Column) -> Column:
    """A title for LaTeX: chapter numbers and markup go, entities and typography are rewritten, and
    titles of more than three words in (over 70 %) capitals become sentence case."""
    t = F.trim(F.coalesce(title, F.lit("")))
    for pattern, by in MARKUP:
        t = F.regexp_replace(t, pattern, by)
    for old, new in (*ENTITIES, ("cLone", "clone"), *TYPOGRAPHY):
        t = F.replace(t, F.lit(old), F.lit(new))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    sentence = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))
    for old, new in ACRONYMS:
        sentence = F.regexp_replace(sentence, rf"\b{old}\b", new)
    t = F.when((words > 3) & (letters > 0) & (capitals / letters > 0.7), sentence).otherwise(t)
    for old, new in ESCAPES:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def label(name: Column, aliases: dict[str, str], most: int) -> Column:
    """A name for a table: its alias if it has one, else cut at `most` characters, the last of them an
    ellipsis, with LaTeX's marks escaped."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    t = F.trim(F.coalesce(name, F.lit("")))
    t = F.coalesce(F.try_element_at(known, t), t) if known is not None else t
    t = F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)
    for old, new in ESCAPES:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def thousands(value: Column) -> Column:
    """A whole number with `{,}` between thousands, so that mathematics sets no space."""
    return F.replace(F.format_number(value, 0), F.lit(","), F.lit("{,}"))


def cell_text(html: Column) -> Column:
    """Without tags, common entities resolved, white space collapsed."""
    t = F.regexp_replace(html, "<[^>]*>", " ")
    for old, new in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def ordered_unique(values: Column) -> Column:
    """Distinct non-blank elements in their order, joined by a semicolon."""
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), "; ")
