"""Inline-markup markers such as ⟦E1⟧, ⟦/E1⟧ and ⟦S2⟧."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import SPACE, bound

# Marker formats.
ANY_MARKER = "⟦[^⟧]*⟧"
KNOWN_MARKER = "⟦(?:/?E|S)[0-9]+⟧"

# XML escapes, the ampersand first.
XML_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}

# Dashes allowed in a list of numbers.
DASHES = "\u2010-\u2014"


def markers_in_order(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY_MARKER), F.lit(0))


def sorted_markers(text: Column) -> Column:
    return F.array_sort(markers_in_order(text))


def differ(source: Column, target: Column) -> Column:
    """Do the markers of two texts differ? Texts without any are not searched by pattern."""
    return (source.contains("⟦") | target.contains("⟦")) & (sorted_markers(source) != sorted_markers(target))


def signature(text: Column) -> Column:
    """Sorted ids of the known markers."""
    known = F.filter(markers_in_order(text), lambda m: m.rlike(f"^{KNOWN_MARKER}$"))
    return F.array_sort(F.transform(known, lambda m: F.btrim(m, F.lit("⟦⟧"))))


def has_known_marker(text: Column) -> Column:
    return text.rlike(KNOWN_MARKER)


def visible_text(text: Column) -> Column:
    return F.regexp_replace(text, KNOWN_MARKER, "")


def number_list(text: Column) -> Column:
    """Markers around nothing but numbers and list punctuation."""
    visible = visible_text(text)
    return (
        has_known_marker(text)
        & visible.rlike("[0-9]")
        & ~visible.rlike(rf"[^0-9{SPACE},.;:\-{DASHES}()\[\]]")
    )


def pieces(text: Column) -> Column:
    """Markers and the text between them, in order."""
    return F.filter(
        F.regexp_extract_all(text, F.lit(f"{ANY_MARKER}|[^⟦]+|⟦[^⟧]*$"), F.lit(0)),
        lambda p: p != "",
    )


def tokens(text: Column) -> Column:
    """Ordered (kind, id, text) tokens; unknown or open markers stay text."""

    def token(piece: Column) -> Column:
        known = piece.rlike(f"^{KNOWN_MARKER}$")
        kind = (
            F.when(~known, "text")
            .when(piece.startswith("⟦/E"), "close")
            .when(piece.startswith("⟦E"), "open")
            .otherwise("self")
        )
        ident = F.when(known, F.regexp_extract(piece, "([0-9]+)", 1).cast("long"))
        return F.struct(kind.alias("kind"), ident.alias("id"), piece.alias("text"))

    return F.transform(pieces(text), token)


def escape_xml(text: Column) -> Column:
    for raw, entity in XML_ENTITIES.items():
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def restorable(translated: Column, inline_map: Column) -> Column:
    """Is every saved marker in the text, and no other? Then ``restore`` gives a text."""
    found = markers_in_order(translated)
    required = F.transform(inline_map, lambda e: e["marker"])
    complete = F.size(F.array_except(required, found)) == 0
    known_only = F.size(F.array_except(found, required)) == 0
    return complete & known_only


def restore(translated: Column, inline_map: Column) -> Column:
    """Put the saved tags back; null when a marker is missing, unknown or left over.

    ``inline_map`` is an array of (marker, tag) structs.
    """
    rebuilt = bound(
        F.map_from_entries(inline_map),
        lambda tags: F.transform(
            pieces(translated), lambda p: F.coalesce(F.try_element_at(tags, p), escape_xml(p))
        ),
    )
    return F.when(restorable(translated, inline_map), F.array_join(rebuilt, ""))
