"""Tables of contents from navigation pages and NCX documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.markup import decode_entities
from lectern.functions.text import collapse

_ATTRIBUTE = r"\s{}\s*=\s*[\"']([^\"']*)[\"']"


def attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, "(?is)" + _ATTRIBUTE.format(name), 1)
    return F.when(value != "", decode_entities(value))


def is_toc_nav(tag: Column) -> Column:
    kinds = F.split(F.coalesce(attribute(tag, r"(?:[a-z0-9]+:)?type"), F.lit("")), r"\s+")
    return F.array_contains(kinds, "toc") | F.coalesce(attribute(tag, "role") == "doc-toc", F.lit(False))


def nav_section(html: Column, any_nav: bool) -> Column:
    """Inner markup of the first contents navigation (or of the first one at all)."""
    sections = F.regexp_extract_all(html, F.lit(r"(?is)<nav(?:\s[^>]*)?>.*?</nav\s*>"), F.lit(0))
    if not any_nav:
        sections = F.filter(sections, lambda s: is_toc_nav(F.regexp_extract(s, "^<[^>]*>", 0)))
    return F.try_element_at(sections, F.lit(1))


def nav_contents(pages: DataFrame, any_nav: bool = False) -> DataFrame:
    """(corpus_id, page_no, pos, level, label, href) of each anchor in the contents list.

    The list depth before each anchor is counted on the page's own row.
    """
    pieces = F.split(nav_section(F.col("html"), any_nav), "(?i)(?=<a[ >])")
    opened = lambda s: F.regexp_count(s, F.lit("(?i)<[ou]l[ >]"))
    closed = lambda s: F.regexp_count(s, F.lit(r"(?i)</[ou]l\s*>"))
    start = F.struct(
        F.lit(0).alias("depth"),
        F.array().cast("array<struct<level:int,piece:string>>").alias("found"),
    )

    def step(state: Column, piece: Column) -> Column:
        anchor = piece.rlike("(?i)^<a[ >]")
        entry = F.struct(F.greatest(state["depth"], F.lit(1)).alias("level"), piece.alias("piece"))
        return F.struct(
            F.greatest(state["depth"] + opened(piece) - closed(piece), F.lit(0)).alias("depth"),
            F.when(anchor, F.array_append(state["found"], entry)).otherwise(state["found"]).alias("found"),
        )

    entries = F.aggregate(pieces, start, step, lambda s: s["found"])
    body = F.regexp_extract("entry.piece", r"(?is)^<a(?:\s[^>]*)?>(.*?)</a\s*>", 1)
    label = collapse(decode_entities(F.regexp_replace(body, "(?s)<[^>]*>", "")))
    return (
        pages.filter(F.col("html").contains("<nav"))
        .select("corpus_id", "page_no", F.posexplode(entries).alias("pos", "entry"))
        .select(
            "corpus_id", "page_no", "pos", "entry.level", label.alias("label"),
            attribute(F.regexp_extract("entry.piece", "^<[^>]*>", 0), "href").alias("href"),
        )
        .filter("label <> ''")
    )


def ncx_contents(documents: DataFrame) -> DataFrame:
    """Contents of NCX documents: children come before their parent.

    ``documents``: corpus_id, ncx. A point is listed where it ends; its level is the
    number of points still open around it.
    """
    pieces = F.regexp_extract_all(
        F.col("ncx"),
        F.lit(r"(?is)<(?:[a-z0-9]+:)?navPoint(?:\s[^>]*)?>|</(?:[a-z0-9]+:)?navPoint\s*>"
              r"|<(?:[a-z0-9]+:)?text\s*>.*?</(?:[a-z0-9]+:)?text\s*>|<(?:[a-z0-9]+:)?content\s[^>]*>"),
        F.lit(0),
    )
    point = "struct<label:string,href:string>"
    start = F.struct(
        F.array().cast(f"array<{point}>").alias("open"),
        F.array().cast("array<struct<level:int,label:string,href:string>>").alias("found"),
    )

    def with_top(stack: Column, label: Column, href: Column) -> Column:
        top = F.struct(label.alias("label"), href.alias("href"))
        return F.array_append(F.slice(stack, 1, F.size(stack) - 1), top)

    def step(state: Column, piece: Column) -> Column:
        stack, found = state["open"], state["found"]
        top = F.try_element_at(stack, F.lit(-1))
        inside = F.size(stack) > 0
        is_end = piece.rlike("^</")
        is_text = piece.rlike("(?i)^<(?:[a-z0-9]+:)?text")
        is_content = piece.rlike("(?i)^<(?:[a-z0-9]+:)?content")
        words = F.regexp_replace(piece, "(?s)<[^>]*>", "")
        label = collapse(decode_entities(top["label"]))
        done = F.struct(F.size(stack).alias("level"), label.alias("label"), top["href"].alias("href"))
        fresh = F.struct(F.lit("").alias("label"), F.lit(None).cast("string").alias("href"))
        new_stack = (
            F.when(is_end & inside, F.slice(stack, 1, F.size(stack) - 1))
            .when(is_end, stack)
            .when(is_text & inside, with_top(stack, F.concat(top["label"], words), top["href"]))
            .when(is_content & inside,
                  with_top(stack, top["label"], F.coalesce(attribute(piece, "src"), top["href"])))
            .when(is_text | is_content, stack)
            .otherwise(F.array_append(stack, fresh))
        )
        listed = is_end & inside & (label != "")
        return F.struct(
            new_stack.alias("open"), F.when(listed, F.array_append(found, done)).otherwise(found).alias("found")
        )

    return documents.select(
        "corpus_id", F.posexplode(F.aggregate(pieces, start, step, lambda s: s["found"])).alias("pos", "entry")
    ).select("corpus_id", "pos", "entry.*")


def rendered(contents: DataFrame) -> DataFrame:
    """Indented contents lines."""
    line = F.concat(
        F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("label"),
        F.coalesce(F.concat(F.lit(" -> "), F.col("href")), F.lit("")),
    )
    return contents.withColumn("line", line)
