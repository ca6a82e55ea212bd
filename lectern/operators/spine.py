"""Package manifests, reading order and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.markers import XML_ENTITIES
from lectern.functions.text import bound

# Media types and file endings of pages and contents files.
XHTML = "application/xhtml+xml"
NCX = "application/x-dtbncx+xml"
PAGE_ENDINGS = (".xhtml", ".html")
NAV_ENDINGS = ("nav.xhtml", "nav.html", "toc.xhtml", "toc.html")
TARGET_LANGUAGE = "ja"

PACKAGE_SCHEMA = (
    "metadata struct<language:string,title:string>,"
    "manifest struct<item:array<struct<_id:string,_href:string,`_media-type`:string,_properties:string>>>,"
    "spine struct<itemref:array<struct<_idref:string,_linear:string>>>"
)
CONTAINER_SCHEMA = "rootfiles struct<rootfile:array<struct<`_full-path`:string>>>"


def normalise_path(path: Column) -> Column:
    """Drop empty and ``.`` parts; ``..`` stays."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/")


def root_file(container: Column) -> Column:
    """Path of the package file named by a container document; none is an error."""
    found = F.from_xml(container, CONTAINER_SCHEMA)["rootfiles"]["rootfile"]
    path = F.when(F.size(found) > 0, found[0]["_full-path"])
    return F.when(path.isNotNull(), path).otherwise(F.raise_error(F.lit("container names no root file")))


def _ends_with(value: Column, endings: tuple[str, ...]) -> Column:
    out = value.endswith(endings[0])
    for ending in endings[1:]:
        out = out | value.endswith(ending)
    return out


def parsed_packages(packages: DataFrame) -> DataFrame:
    """(corpus_id, doc) with the package document as a struct."""
    return packages.select("corpus_id", F.from_xml("opf", PACKAGE_SCHEMA).alias("doc"))


def _items(doc: Column) -> Column:
    complete = lambda i: i["_id"].isNotNull() & i["_href"].isNotNull() & i["_media-type"].isNotNull()
    return F.filter(doc["manifest"]["item"], complete)


def spine_pages(packages: DataFrame) -> DataFrame:
    """Pages in reading order: (corpus_id, page_no, idref, href, media_type, linear).

    A package is one document, so items and references are matched inside its row;
    of repeated item ids the last counts.
    """
    ids = F.transform("items", lambda i: i["_id"])
    last_of = lambda ident: F.element_at(F.filter("items", lambda i: i["_id"] == ident), -1)
    by_id = F.when(
        F.size(F.array_distinct(ids)) == F.size(ids), F.map_from_arrays(ids, F.col("items"))
    ).otherwise(
        F.map_from_arrays(F.array_distinct(ids), F.transform(F.array_distinct(ids), last_of))
    )
    is_page = lambda i: (i["_media-type"] == XHTML) | _ends_with(i["_href"], PAGE_ENDINGS)

    def resolved(items: Column) -> Column:
        pages = F.transform(
            "refs",
            lambda r: F.struct(
                r["_idref"].alias("idref"),
                F.try_element_at(items, r["_idref"]).alias("item"),
                F.coalesce(r["_linear"] != "no", F.lit(True)).alias("linear"),
            ),
        )
        return F.filter(pages, lambda p: p["item"].isNotNull() & is_page(p["item"]))

    return (
        parsed_packages(packages)
        .select("corpus_id", _items(F.col("doc")).alias("items"), F.col("doc.spine.itemref").alias("refs"))
        .select("corpus_id", F.posexplode(bound(by_id, resolved)).alias("pos", "page"))
        .select(
            "corpus_id",
            (F.col("pos") + 1).alias("page_no"),
            "page.idref",
            F.col("page.item._href").alias("href"),
            F.col("page.item._media-type").alias("media_type"),
            "page.linear",
        )
    )


def contents_source(packages: DataFrame) -> DataFrame:
    """The navigation and NCX items a package offers."""
    first = lambda cond: F.try_element_at(F.filter("items", cond), F.lit(1))["_href"]
    has_nav = lambda i: (i["_media-type"] == XHTML) & F.array_contains(
        F.split(F.coalesce(i["_properties"], F.lit("")), " +"), "nav"
    )
    named_nav = lambda i: (i["_media-type"] == XHTML) & _ends_with(i["_href"], NAV_ENDINGS)
    return parsed_packages(packages).select("corpus_id", _items(F.col("doc")).alias("items")).select(
        "corpus_id",
        F.coalesce(first(has_nav), first(named_nav)).alias("nav_href"),
        first(lambda i: i["_media-type"] == NCX).alias("ncx_href"),
    )


def translated_metadata(packages: DataFrame, model: str) -> DataFrame:
    """Metadata after translation: target language and one more contributor.

    ``packages``: corpus_id, language, contributors (array of name, role structs).
    """
    contributor = F.struct(
        F.lit(f"lectern (model: {model})").alias("name"), F.lit("trl").alias("role")
    )
    return packages.withColumn("language", F.lit(TARGET_LANGUAGE)).withColumn(
        "contributors", F.array_append("contributors", contributor)
    )


_NAME = r"(?:[\w.-]+:)?"


def rewritten_package(document: Column, model: str) -> Column:
    """A package document with the target language and one more contributor; all else stays letter by letter.

    The text of every language element is replaced (an empty one stays empty), and a contributor
    with its role is put at the end of the first metadata element. Without metadata nothing is added.
    """
    language = F.regexp_replace(
        document, rf"(?i)(<{_NAME}language(?:\s[^>]*)?>)[^<]+(</{_NAME}language\s*>)", f"$1{TARGET_LANGUAGE}$2")
    name = f"lectern (model: {model})"
    for raw, entity in XML_ENTITIES.items():
        name = name.replace(raw, entity)
    added = (
        f'<dc:contributor id="lectern-translator">{name}</dc:contributor>'
        '<meta refines="#lectern-translator" property="role" scheme="marc:relators">trl</meta>'
    )
    literal = added.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(language, rf"(?is)\A(.*?)(</{_NAME}metadata\s*>)", f"$1{literal}$2")
