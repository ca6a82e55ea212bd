"""Columns over raw XHTML and HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bound, collapse

# Elements that hold one translatable block each.
BLOCK_TAGS = (
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption",
    "aside", "dt", "dd", "caption", "td", "th", "summary",
)
# Fixed value: id prefix of a div that counts as a block.
POPUP_PREFIX = "popup-"
# Elements whose text is never translated.
CODE_TAGS = ("code", "pre", "kbd", "samp", "var", "tt", "script", "style", "math")
# HTML elements that have no end tag.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "source", "track", "wbr",
)
# Entities decoded to text, the ampersand last.
NAMED_ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&",
}

_BLOCKS = "|".join(BLOCK_TAGS)
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK_EDGE = rf"(?i)<(/?)(?:[a-z0-9]+:)?({_BLOCKS})(?:\s[^>]*)?>"
BLOCK_OPEN = rf"(?i)<(?:[a-z0-9]+:)?(?:{_BLOCKS})(?:\s[^>]*)?>|<div\s[^>]*id=[\"']{POPUP_PREFIX}[^>]*>"
POPUP_OPEN = rf"(?i)<div\s[^>]*id=[\"']{POPUP_PREFIX}[^>]*>"
INLINE_PIECE = r"(?s)<!--.*?-->|<[/!?a-zA-Z][^>]*>|[^<]+|<"
STRICT_PIECE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[/!?a-zA-Z][^>]*>|[^<]+"
CDATA_OPEN, CDATA_CLOSE = "<![CDATA[", "]]>"
EDGE, NAME_END = "\x01", "\x02"
#: Edges that one inner fold takes; appending to a list costs its length, so long pages are folded in stretches.
STRETCH = 256


def local_name(tag: Column) -> Column:
    return F.regexp_extract(tag, "([^:]+)$", 1)


def is_block_tag(tag: Column) -> Column:
    return local_name(tag).isin(*BLOCK_TAGS)


def is_block_start(tag: Column, element_id: Column) -> Column:
    popup = (local_name(tag) == "div") & element_id.startswith(POPUP_PREFIX)
    return is_block_tag(tag) | F.coalesce(popup, F.lit(False))


def raw_block_count(html: Column) -> Column:
    """Every block start, nested and empty ones too."""
    return F.regexp_count(html, F.lit(BLOCK_OPEN))


def decode_entities(text: Column) -> Column:
    numeric = F.array_distinct(
        F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0))
    )

    def char(entity: Column) -> Column:
        digits = F.regexp_extract(entity, "([0-9a-fA-F]+);", 1)
        code = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        hexed = F.lpad(F.hex(code), 8, "0")
        return F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF),
                      F.decode(F.unhex(hexed), "UTF-32")).otherwise(entity)

    decoded = F.when(
        text.contains("&#"),
        F.aggregate(numeric, text, lambda acc, e: F.replace(acc, e, char(e))),
    ).otherwise(text)
    named = decoded
    for entity, plain in NAMED_ENTITIES.items():
        named = F.replace(named, F.lit(entity), F.lit(plain))
    return F.when(text.contains("&"), named).otherwise(text)


def plain_text(html: Column) -> Column:
    """Text outside code, script and style elements, tags turned into spaces."""
    hidden = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in CODE_TAGS)
    visible = F.regexp_replace(html, f"(?is)<!--.*?-->|{hidden}", " ")
    return collapse(decode_entities(F.regexp_replace(visible, "(?s)<[^>]*>", " ")))


def block_pieces(html: Column) -> Column:
    """(tag, body) of each block: a block ends where the next block tag opens or closes."""
    shown = F.regexp_replace(html, HIDDEN, "")
    popup = F.regexp_replace(F.regexp_replace(shown, POPUP_OPEN, f"{EDGE}div{NAME_END}"),
                             r"(?i)</div\s*>", f"{EDGE}/div{NAME_END}")
    with_popups = F.when(shown.contains(POPUP_PREFIX), popup).otherwise(shown)
    edged = F.regexp_replace(with_popups, BLOCK_EDGE, f"{EDGE}$1$2{NAME_END}")
    pieces = F.split(edged, EDGE)
    opened = F.filter(
        F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda p: ~p.startswith("/")
    )
    return F.transform(
        opened,
        lambda p: F.struct(
            F.lower(F.substring_index(p, NAME_END, 1)).alias("tag"),
            F.substring(p, F.instr(p, NAME_END) + 1, F.length(p)).alias("body"),
        ),
    )


def inline_pieces(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(INLINE_PIECE), F.lit(0))


def _is_tag(piece: Column) -> Column:
    return piece.rlike("^</?[a-zA-Z]")


def tag_name(piece: Column) -> Column:
    return F.regexp_extract(piece, r"^</?([^\s/>]+)", 1)


def _is_single(piece: Column, strict: bool = False) -> Column:
    """A tag without an end tag; only raw HTML leaves the slash of void elements out."""
    if strict:
        return piece.endswith("/>")
    return piece.endswith("/>") | F.lower(tag_name(piece)).isin(*VOID_TAGS)


def _tag_numbers(pieces: Column, strict: bool = False) -> Column:
    """Marker number of every piece, 0 for text.

    Start tags and single tags count up from 1; an end tag takes the number of the
    nearest open tag of its name, or a new one. The fold keeps numbers only; texts
    and tags are put together afterwards.
    """
    start = F.struct(
        F.lit(1).alias("next"),
        F.array().cast("array<struct<name:string,id:int>>").alias("open"),
        F.array().cast("array<int>").alias("ids"),
    )

    def step(state: Column, piece: Column) -> Column:
        name = tag_name(piece) if strict else F.lower(tag_name(piece))
        closing = piece.startswith("</")
        same = F.filter(state["open"], lambda o: o["name"] == name)
        match = F.when(closing & (F.size(same) > 0), F.element_at(same, -1)["id"])
        number = F.coalesce(match, state["next"])
        still_open = (
            F.when(match.isNotNull(), F.filter(state["open"], lambda o: o["id"] != match))
            .when(closing | _is_single(piece, strict), state["open"])
            .otherwise(F.array_append(state["open"], F.struct(name.alias("name"), number.alias("id"))))
        )
        tagged = F.struct(
            F.when(match.isNull(), state["next"] + 1).otherwise(state["next"]).alias("next"),
            still_open.alias("open"),
            F.array_append(state["ids"], number).alias("ids"),
        )
        plain = F.struct(
            state["next"].alias("next"),
            state["open"].alias("open"),
            F.array_append(state["ids"], F.lit(0)).alias("ids"),
        )
        return F.when(_is_tag(piece), tagged).otherwise(plain)

    return F.aggregate(pieces, start, step, lambda state: state["ids"])


EMPTY_MAP = "array<struct<marker:string,tag:string>>"


def encode_pieces(pieces: Column, strict: bool = False) -> Column:
    """(source_text, inline_map) of a block's pieces: inline tags replaced by numbered markers.

    Strict pieces keep the case of names and hold the text of CDATA sections as it is.
    """

    def marked(piece: Column, number: Column) -> Column:
        kind = F.when(piece.startswith("</"), "/E").when(_is_single(piece, strict), "S").otherwise("E")
        return F.struct(
            F.when(number > 0, F.concat(F.lit("⟦"), kind, number.cast("string"), F.lit("⟧"))).alias("marker"),
            piece.alias("tag"),
        )

    def put_together(entries: Column) -> Column:
        def text(e: Column) -> Column:
            shown = F.when(e["marker"].isNotNull(), e["marker"])
            if not strict:
                return shown.when(e["tag"].rlike("^<[!?]"), "").otherwise(e["tag"])
            inside = F.substring(e["tag"], F.lit(len(CDATA_OPEN) + 1),
                                 F.length(e["tag"]) - len(CDATA_OPEN) - len(CDATA_CLOSE))
            return shown.when(e["tag"].startswith(CDATA_OPEN), inside).when(e["tag"].startswith("<"), "").otherwise(
                decode_entities(e["tag"]))

        joined = F.array_join(F.transform(entries, text), "")
        return F.struct(
            collapse(joined if strict else decode_entities(joined)).alias("source_text"),
            F.filter(entries, lambda e: e["marker"].isNotNull()).alias("inline_map"),
        )

    return bound(F.zip_with(pieces, _tag_numbers(pieces, strict), marked), put_together)


def encode_inline(body: Column) -> Column:
    """(source_text, inline_map): inline tags replaced by numbered markers."""
    plain_only = F.struct(
        collapse(decode_entities(body)).alias("source_text"), F.array().cast(EMPTY_MAP).alias("inline_map")
    )
    return F.when(~body.contains("<"), plain_only).otherwise(bound(inline_pieces(body), lambda p: encode_pieces(p)))


def strict_pieces(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(STRICT_PIECE), F.lit(0))


def _strict_edges(pieces: Column) -> Column:
    """(at, step, name, starts) of every start and end tag: its place, +1 or -1, and whether it opens a block."""

    def edge(piece: Column, at: Column) -> Column:
        closing, name = piece.startswith("</"), tag_name(piece)
        popup = (local_name(name) == "div") & piece.rlike(rf"\sid\s*=\s*[\"']{POPUP_PREFIX}")
        step = F.when(~_is_tag(piece) | _is_single(piece, True) & ~closing, 0).when(closing, -1).otherwise(1)
        return F.struct(at.alias("at"), step.alias("step"), name.alias("name"),
                        ((step == 1) & (is_block_tag(name) | popup)).alias("starts"))

    return F.filter(F.transform(pieces, edge), lambda e: e["step"] != 0)


BLOCK_PLACES = "array<struct<name:string,first:int,last:int>>"


def outer_block_places(pieces: Column) -> Column:
    """(blocks: (name, first, last) by the places of their tags, problem) of the outermost blocks.

    A fold over the tags carries the open block and the depth inside it. A block ends at the end
    tag at its own depth, which must bear its name; else, or where the page ends inside a block,
    ``problem`` says so and what follows is not looked at.
    """

    def state(name, first, depth, problem, found) -> Column:
        return F.struct(name.alias("name"), first.alias("first"), depth.alias("depth"),
                        problem.alias("problem"), found.alias("found"))

    nothing = F.lit(None).cast("string")
    none_found = F.array().cast(BLOCK_PLACES)
    start = state(nothing, F.lit(-1), F.lit(0), nothing, none_found)

    def step(s: Column, e: Column) -> Column:
        inside = s["name"].isNotNull() & s["problem"].isNull()
        opens = s["name"].isNull() & s["problem"].isNull() & e["starts"]
        at_end = inside & (e["step"] < 0) & (s["depth"] == 0)
        closes = at_end & (s["name"] == e["name"])
        block = F.struct(s["name"].alias("name"), s["first"].alias("first"), e["at"].alias("last"))
        return state(
            F.when(opens, e["name"]).when(closes, nothing).otherwise(s["name"]),
            F.when(opens, e["at"]).otherwise(s["first"]),
            F.when(opens, 0).when(inside & ~at_end, s["depth"] + e["step"]).otherwise(s["depth"]),
            F.when(at_end & ~closes, F.concat(F.lit("</"), e["name"], F.lit("> inside <"), s["name"], F.lit(">"))).otherwise(s["problem"]),
            F.when(closes, F.array_append(s["found"], block)).otherwise(s["found"]),
        )

    def stretch(edges: Column, number: Column, s: Column) -> Column:
        fresh = state(s["name"], s["first"], s["depth"], s["problem"], none_found)
        return F.aggregate(F.slice(edges, number * STRETCH + 1, F.lit(STRETCH)), fresh, step)

    def folded(edges: Column) -> Column:
        outer_start = state(nothing, F.lit(-1), F.lit(0), nothing, F.array().cast(f"array<{BLOCK_PLACES}>"))
        stretches = F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / STRETCH).cast("int"))

        def outer(s: Column, number: Column) -> Column:
            return bound(stretch(edges, number, s), lambda t: state(
                t["name"], t["first"], t["depth"], t["problem"], F.array_append(s["found"], t["found"])))

        def ended(s: Column) -> Column:
            open_end = F.when(s["name"].isNotNull(), F.concat(F.lit("page ends inside <"), s["name"], F.lit(">")))
            return F.struct(F.flatten(s["found"]).alias("blocks"), F.coalesce(s["problem"], open_end).alias("problem"))

        empty = F.struct(none_found.alias("blocks"), nothing.alias("problem"))
        return F.when(F.size(edges) == 0, empty).otherwise(F.aggregate(stretches, outer_start, outer, ended))

    return bound(_strict_edges(pieces), folded)
