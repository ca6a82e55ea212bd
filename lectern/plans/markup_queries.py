"""Packages, pages, blocks, contents and assembly queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import markers, markup, text
from lectern.operators import assembly, cache as cache_ops, navigation, runs, spine
from lectern.operators import blocks as block_ops
from lectern.plans import oracle as o
from lectern.plans.registry import query
from lectern.plans.tables import BLOCK_IDS, CFG, Tables
from lectern.sources import archives

FIRST_PAGE, LAST_PAGE = 11, 500
PAGE_IDS = ("corpus_id", "page_no")
CONTAINER = ('<container><rootfiles><rootfile full-path="OEBPS/p', '.opf" media-type="x"/></rootfiles></container>')
CONTAINER_SQL = f"({o.quote(CONTAINER[0])} || page_id || {o.quote(CONTAINER[1])})"


@query("ingest_packages", f"""
  SELECT 'b' || page_id AS corpus_id, path, bytes, hash, 'OEBPS/p' || page_id || '.opf' AS root_file FROM (
    SELECT page_id, 'p' || page_id || '.xhtml' AS path, strlen(html) AS bytes, sha256(html) AS hash FROM pages
    UNION ALL SELECT page_id, 'META-INF/container.xml', strlen({CONTAINER_SQL}), sha256({CONTAINER_SQL})
    FROM pages)""")
def ingest_packages(t: Tables) -> DataFrame:
    """Archives unpacked, each with the root file that its own container names."""
    page = F.col("page_id").cast("string")
    books = archives.pack_rows(
        t.pages().select(
            F.concat(F.lit("b"), page).alias("corpus_id"),
            F.concat(F.lit(CONTAINER[0]), page, F.lit(CONTAINER[1])).alias("container"), "href", "html",
        )
    )
    entries = archives.archive_entries(books)
    containers = entries.filter(F.col("path") == "META-INF/container.xml").select(
        "corpus_id", spine.root_file(F.col("content").cast("string")).alias("root_file"))
    return entries.select(
        "corpus_id", "path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("hash"),
    ).join(containers, "corpus_id")


@query("corpus_fingerprint", "SELECT page_id, sha256(html) AS sha256, substr(sha256(html), 1, 32) AS input_hash FROM pages")
def corpus_fingerprint(t: Tables) -> DataFrame:
    content = t.pages().select(F.col("page_id").alias("corpus_id"), F.col("html").cast("binary").alias("content"))
    return runs.fingerprint(content).withColumnRenamed("corpus_id", "page_id")


@query("spine_resolve", o.sql("""
  SELECT volume AS corpus_id, row_number() OVER (PARTITION BY volume ORDER BY page_id) AS page_no,
    'p' || page_id AS idref, 'p' || page_id || '.xhtml' AS href,
    CASE WHEN page_id % 11 = 0 THEN 'text/plain' ELSE 'application/xhtml+xml' END AS media_type,
    page_id % 5 <> 0 AS linear
  FROM hosts WHERE page_id % 11 = 0 OR page_id % 17 <> 0""", "hosts"))
def spine_resolve(t: Tables) -> DataFrame:
    return spine.spine_pages(t.packages())


@query("toc_source", o.sql("""
  SELECT volume AS corpus_id, 'p' || min(CASE WHEN page_id % 7 = 0 AND page_id % 11 <> 0 AND page_id % 17 <> 0
    THEN page_id END) || '.xhtml' AS nav_href, NULL::VARCHAR AS ncx_href FROM hosts GROUP BY volume""", "hosts"))
def toc_source(t: Tables) -> DataFrame:
    return spine.contents_source(t.packages())


@query("package_metadata", f"""
  SELECT source AS corpus_id, 'ja' AS language, source || ':aut,lectern (model: {CFG.model_name}):trl' AS contributors
  FROM documents GROUP BY source""")
def package_metadata(t: Tables) -> DataFrame:
    person = F.struct(F.col("source").alias("name"), F.lit("aut").alias("role"))
    packages = t.given("documents").groupBy("source").agg(F.first("lang").alias("language")).select(
        F.col("source").alias("corpus_id"), "language", F.array(person).alias("contributors")
    )
    return spine.translated_metadata(packages, CFG.model_name).select(
        "corpus_id", "language",
        F.array_join(F.transform("contributors", lambda c: F.concat(c["name"], F.lit(":"), c["role"])), ",")
        .alias("contributors"),
    )


def _package_sql(language: str, added: str) -> str:
    """A package of each document: a third without a language, a third with prefixed elements."""
    return f"""(CASE doc_id % 3 WHEN 0 THEN '<package><metadata><dc:title>' || {{title}} || '</dc:title>{added}</metadata><manifest/></package>'
      WHEN 1 THEN '<opf:package><opf:metadata><dc:language xml:lang="en">' || {language} || '</dc:language><dc:title>' || {{title}} ||
        '</dc:title>{added}</opf:metadata ><metadata></metadata></opf:package>'
      ELSE '<package><language>' || {language} || '</language><language></language><spine/></package>' END)"""


_TITLE_SQL = o.escape("left(text, 40)")
_ADDED = (f'<dc:contributor id="lectern-translator">lectern (model: {CFG.model_name})</dc:contributor>'
          '<meta refines="#lectern-translator" property="role" scheme="marc:relators">trl</meta>')


@query("package_rewrite", f"""
  SELECT doc_id, {o.short_hash(_package_sql("'ja'", _ADDED).format(title=_TITLE_SQL))} AS package_hash FROM documents""")
def package_rewrite(t: Tables) -> DataFrame:
    title = markers.escape_xml(F.left("text", F.lit(40)))
    lang, kind = F.col("lang"), F.col("doc_id") % 3
    opf = F.when(kind == 0, F.concat(F.lit("<package><metadata><dc:title>"), title, F.lit("</dc:title></metadata><manifest/></package>"))).when(
        kind == 1, F.concat(F.lit('<opf:package><opf:metadata><dc:language xml:lang="en">'), lang, F.lit("</dc:language><dc:title>"), title,
                            F.lit("</dc:title></opf:metadata ><metadata></metadata></opf:package>"))).otherwise(
        F.concat(F.lit("<package><language>"), lang, F.lit("</language><language></language><spine/></package>")))
    return t.documents().select("doc_id", text.short_hash(spine.rewritten_package(opf, CFG.model_name)).alias("package_hash"))


@query("plain_text", f"""
  SELECT page_id, length(p) AS chars, {o.short_hash('p')} AS hash FROM (
    SELECT page_id, {o.collapse(o.decode(f"regexp_replace(regexp_replace(html, '{o.CODE}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))} AS p
    FROM pages)""")
def plain_text(t: Tables) -> DataFrame:
    shown = t.pages().select("page_id", markup.plain_text(F.col("html")).alias("p"))
    return shown.select("page_id", F.length("p").alias("chars"), text.short_hash(F.col("p")).alias("hash"))


@query("block_count", o.sql(f"""
  SELECT corpus_id, page_no, len(regexp_extract_all(html, '{o.RAW_BLOCK}')) AS raw_blocks FROM hosts""", "hosts"))
def block_count(t: Tables) -> DataFrame:
    return t.pages().select(*PAGE_IDS, markup.raw_block_count(F.col("html")).alias("raw_blocks"))


BLOCK_NAMES = (
    "p h1 h2 h3 h4 h5 h6 li blockquote figcaption aside dt dd caption td th summary").split()


@query("block_starts", f"""
  SELECT page_id, tag, count(*) AS n, tag IN {o.listed(BLOCK_NAMES)} AS block,
    tag IN {o.listed(BLOCK_NAMES)} OR (tag = 'div' AND page_id % 3 = 0) AS starts
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id, tag""")
def block_starts(t: Tables) -> DataFrame:
    """Element names of each page under a prefix, with the id of a pop-up on every third page."""
    names = F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    tags = t.pages().select("page_id", names.alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    named = F.concat(F.lit("x:"), F.col("tag"))
    element_id = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(markup.POPUP_PREFIX), F.col("page_id").cast("string")))
    return tags.select("page_id", "tag", "n", markup.is_block_tag(named).alias("block"),
                       markup.is_block_start(named, element_id).alias("starts"))


@query("inspect_report", o.sql(f"""
  SELECT corpus_id, page_no, href, 'application/xhtml+xml' AS media_type, page_id % 5 <> 0 AS linear, true AS present,
    strlen(html) AS bytes, len(regexp_extract_all(html, '{o.RAW_BLOCK}')) AS raw_blocks FROM hosts""", "hosts"))
def inspect_report(t: Tables) -> DataFrame:
    pages = t.pages().withColumn("media_type", F.lit(spine.XHTML)).withColumn("linear", F.col("page_id") % 5 != 0)
    return block_ops.inspect_pages(pages)


@query("blocks_extract", o.sql(f"""
  SELECT corpus_id, page_no, block_index, tag, {o.short_hash('shown')} AS text_hash FROM page_blocks""", "page_blocks"))
def blocks_extract(t: Tables) -> DataFrame:
    shown = text.collapse(markers.visible_text(F.col("source_text")))
    return block_ops.extract_blocks(t.pages()).select(
        *PAGE_IDS, "block_index", "tag", text.short_hash(shown).alias("text_hash")
    )


@query("inline_encode", o.sql("""
  SELECT corpus_id, page_no, block_index, starts - singles AS opened, ends AS closed, singles AS single,
    starts + ends AS mapped FROM page_blocks""", "page_blocks"))
def inline_encode(t: Tables) -> DataFrame:
    count = lambda pattern: F.regexp_count("source_text", F.lit(pattern))
    return block_ops.extract_blocks(t.pages()).select(
        *PAGE_IDS, "block_index",
        count("⟦E[0-9]+⟧").alias("opened"), count("⟦/E[0-9]+⟧").alias("closed"),
        count("⟦S[0-9]+⟧").alias("single"), F.size("inline_map").alias("mapped"),
    )


@query("blocks_extract_strict", o.sql("""
  SELECT corpus_id, page_no, block_index, tag, source_text, sha256(tags) AS tags_hash, corrupt_reason
  FROM strict_blocks""", "strict_blocks"))
def blocks_extract_strict(t: Tables) -> DataFrame:
    tags = F.array_join(F.transform("inline_map", lambda m: F.concat(m["marker"], m["tag"])), "")
    return block_ops.extract_blocks_strict(t.pages()).select(
        *PAGE_IDS, "block_index", "tag", "source_text", F.sha2(tags, 256).alias("tags_hash"), "corrupt_reason"
    )


@query("page_range", o.sql(f"""
  SELECT corpus_id, count(*) AS blocks, count(DISTINCT page_no) AS pages FROM doc_blocks
  WHERE page_no BETWEEN {FIRST_PAGE} AND {LAST_PAGE} GROUP BY corpus_id""", "doc_blocks"))
def page_range(t: Tables) -> DataFrame:
    return block_ops.select_pages(t.doc_blocks(), FIRST_PAGE, LAST_PAGE).groupBy("corpus_id").agg(
        F.count("*").alias("blocks"), F.count_distinct("page_no").alias("pages")
    )


def line_map() -> Column:
    """Saved tags of a document line: every third one is bold."""
    entry = lambda marker, tag: F.struct(F.lit(marker).alias("marker"), F.lit(tag).alias("tag"))
    return F.when(
        F.col("block_index") % 3 == 0, F.array(entry("⟦E1⟧", "<b>"), entry("⟦/E1⟧", "</b>"))
    ).otherwise(F.array().cast("array<struct<marker:string,tag:string>>"))


def _restored_sql(x: str) -> str:
    marks = f"list_sort(list_distinct({o.found_markers(x)}))"
    need = "CASE WHEN block_index % 3 = 0 THEN ['⟦/E1⟧', '⟦E1⟧'] ELSE []::VARCHAR[] END"
    return (
        f"CASE WHEN {marks} = list_sort({need}) THEN "
        f"replace(replace({o.escape(x)}, '⟦E1⟧', '<b>'), '⟦/E1⟧', '</b>') END"
    )


@query("inline_restore", o.sql(f"""
  SELECT doc_id, block_index, r IS NOT NULL AS used, {o.short_hash(f"coalesce(r, {_restored_sql('source_text')})")} AS hash
  FROM (SELECT *, {_restored_sql('translated')} AS r FROM responses)""", "responses"))
def inline_restore(t: Tables) -> DataFrame:
    restored = markers.restore(F.col("translated"), line_map())
    original = markers.restore(F.col("source_text"), line_map())
    return t.responses().select(
        "doc_id", "block_index", restored.isNotNull().alias("used"),
        text.short_hash(F.coalesce(restored, original)).alias("hash"),
    )


def assembled(t: Tables) -> DataFrame:
    blocks = t.keyed().withColumn("tag", F.lit("p")).withColumn("inline_map", line_map())
    status = cache_ops.cache_status(blocks, t.cache(), BLOCK_IDS)
    return assembly.assemble_pages(assembly.restored_blocks(status))


ASSEMBLED_SQL = f"""
  SELECT corpus_id, page_no, count(*) AS blocks, count(*) FILTER (r IS NOT NULL) AS translated_blocks,
    count(*) FILTER (status <> 'hit') AS misses,
    string_agg('<p>' || coalesce(r, {_restored_sql('source_text')}) || '</p>', {o.NL} ORDER BY block_index) AS html
  FROM (SELECT *, CASE WHEN status = 'hit' THEN {_restored_sql('translated')} END AS r FROM status)
  GROUP BY corpus_id, page_no"""


@query("assemble_pages", o.sql(f"""
  SELECT corpus_id, page_no, blocks, translated_blocks, misses, {o.short_hash('html')} AS html_hash FROM assembled""",
    "status", assembled=ASSEMBLED_SQL))
def assemble_pages(t: Tables) -> DataFrame:
    return assembled(t).select(
        *PAGE_IDS, "blocks", "translated_blocks", "misses", text.short_hash(F.col("html")).alias("html_hash")
    )


@query("assembly_status", o.sql("""
  SELECT corpus_id, count(*) AS pages, sum(blocks)::BIGINT AS blocks, sum(translated_blocks)::BIGINT AS translated_blocks,
    sum(misses)::BIGINT AS misses, CASE WHEN sum(misses) > 0 THEN 'recoverable' ELSE 'complete' END AS status
  FROM assembled GROUP BY corpus_id""", "status", assembled=ASSEMBLED_SQL))
def assembly_status(t: Tables) -> DataFrame:
    return assembly.assembly_status(assembled(t))


# Contents


@query("toc_nav", o.sql(
    "SELECT corpus_id, page_no, pos, level, label, href FROM nav_toc WHERE label <> ''", "nav_toc"))
def toc_nav(t: Tables) -> DataFrame:
    return navigation.nav_contents(t.pages(), any_nav=True)


@query("toc_render", o.sql("""
  SELECT corpus_id, page_no, pos, repeat('  ', level - 1) || '- ' || label || coalesce(' -> ' || href, '') AS line
  FROM nav_toc WHERE label <> ''""", "nav_toc"))
def toc_render(t: Tables) -> DataFrame:
    return navigation.rendered(toc_nav(t)).select(*PAGE_IDS, "pos", "line")


LANDMARKS = '<nav epub:type="landmarks"><ol><li><a href="x">Start</a></li></ol></nav>'


def typed_pages(t: Tables) -> DataFrame:
    """A third of the pages name their list by type, behind another one; a third by role; a third do not."""
    html = F.col("html")
    by_type = F.regexp_replace(html, "<nav>", LANDMARKS + '<nav epub:type="lot toc">')
    by_role = F.regexp_replace(html, "<nav>", '<nav role="doc-toc">')
    kind = F.col("page_id") % 3
    return t.pages().withColumn("html", F.when(kind == 0, by_type).when(kind == 1, by_role).otherwise(html))


@query("toc_nav_typed", o.sql("""
  SELECT corpus_id, page_no, pos, level, label, href FROM nav_toc WHERE label <> '' AND (page_no - 1) % 3 <> 2""", "nav_toc"))
def toc_nav_typed(t: Tables) -> DataFrame:
    return navigation.nav_contents(typed_pages(t))


@query("toc_render_typed", o.sql("""
  SELECT corpus_id, page_no, pos, repeat('  ', level - 1) || '- ' || label || coalesce(' -> ' || href, '') AS line
  FROM nav_toc WHERE label <> '' AND (page_no - 1) % 3 <> 2""", "nav_toc"))
def toc_render_typed(t: Tables) -> DataFrame:
    return navigation.rendered(toc_nav_typed(t)).select(*PAGE_IDS, "pos", "line")


@query("toc_ncx", o.sql("""
  SELECT corpus_id, page_no, CASE WHEN pos = 0 THEN n - 1 ELSE pos - 1 END AS pos,
    (CASE WHEN pos = 0 THEN 1 ELSE 2 END)::BIGINT AS level, label, href
  FROM (SELECT *, count(*) OVER (PARTITION BY corpus_id, page_no) AS n,
    row_number() OVER (PARTITION BY corpus_id, page_no ORDER BY pos) - 1 AS pos2 FROM nav_toc WHERE label <> '')
  """, "nav_toc"))
def toc_ncx(t: Tables) -> DataFrame:
    """NCX documents made from each page's list: the first entry holds the others."""
    point = F.concat(
        F.lit("<navPoint><navLabel><text>"), markers.escape_xml(F.col("label")), F.lit('</text></navLabel><content src="'),
        F.coalesce(markers.escape_xml(F.col("href")), F.lit("")), F.lit('"/>'),
    )
    points = F.array_sort(F.collect_list(F.struct("pos", point.alias("point"))))
    end = F.lit("</navPoint>")
    rest = F.transform(F.slice("points", 2, F.size("points")), lambda p: F.concat(p["point"], end))
    documents = toc_nav(t).groupBy(*PAGE_IDS).agg(points.alias("points")).select(
        F.concat_ws("|", *PAGE_IDS).alias("corpus_id"),
        F.concat(
            F.lit("<ncx><navMap>"), F.col("points")[0]["point"], F.array_join(rest, ""), end, F.lit("</navMap></ncx>")
        ).alias("ncx"),
    )
    return navigation.ncx_contents(documents).select(
        F.substring_index("corpus_id", "|", 1).alias("corpus_id"),
        F.substring_index("corpus_id", "|", -1).cast("long").alias("page_no"),
        "pos", "level", "label", "href",
    )
