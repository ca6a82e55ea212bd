"""Text features, validation, chunks, glossary and language queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.functions import formats, language, markers, prompts, text, validation
from lectern.operators import cache as cache_ops
from lectern.operators import chunking, glossary, requests, spine
from lectern.plans import oracle as o
from lectern.plans.registry import query
from lectern.plans.tables import CFG, Tables
from lectern.session import new_folder
from lectern.sources import jsonl

IDS = ("doc_id", "block_index")
REJOIN_CHARS = 500


def source() -> Column:
    return F.col("source_text")


def target() -> Column:
    return F.col("translated")


@query("collapse_ws", f"""
  SELECT doc_id, length(c) AS chars, {o.short_hash('c')} AS hash
  FROM (SELECT doc_id, {o.collapse('text')} AS c FROM documents)""")
def collapse_ws(t: Tables) -> DataFrame:
    flat = t.documents().select("doc_id", text.collapse(F.col("text")).alias("c"))
    return flat.select("doc_id", F.length("c").alias("chars"), text.short_hash(F.col("c")).alias("hash"))


@query("text_features", o.sql(f"""
  SELECT doc_id, block_index, {o.letters('source_text')} AS letters, {o.words('source_text')} AS words,
    {o.japanese('translated')} AS japanese, {o.terminal('source_text')} AS terminal,
    {o.letters('source_text')} >= 6 AS english, {o.number_list('translated')} AS number_list,
    {o.short_hash(o.form('source_text'))} AS form_hash FROM responses""", "responses"))
def text_features(t: Tables) -> DataFrame:
    return t.responses().select(
        *IDS,
        text.letter_count(source()).alias("letters"),
        text.word_count(source()).alias("words"),
        text.japanese_count(target()).alias("japanese"),
        F.coalesce(text.ends_terminal(source()), F.lit(False)).alias("terminal"),
        (text.letter_count(source()) >= 6).alias("english"),
        markers.number_list(target()).alias("number_list"),
        text.short_hash(text.compare_form(source())).alias("form_hash"),
    )


@query("longest_ascii_run", o.sql(
    f"SELECT doc_id, block_index, {o.longest_run('translated')} AS run FROM responses", "responses"))
def longest_ascii_run(t: Tables) -> DataFrame:
    return t.responses().select(*IDS, text.longest_ascii_run(target()).alias("run"))


@query("reference_like", o.sql(
    f"SELECT doc_id, block_index, {o.reference_like('source_text')} AS reference_like FROM doc_blocks", "doc_blocks"))
def reference_like(t: Tables) -> DataFrame:
    return t.doc_blocks().select(*IDS, text.reference_like(source()).alias("reference_like"))


@query("marker_multiset", o.sql(f"""
  SELECT doc_id, block_index, coalesce(array_to_string(list_sort({o.found_markers('translated')}), ' '), '') AS markers
  FROM responses""", "responses"))
def marker_multiset(t: Tables) -> DataFrame:
    return t.responses().select(*IDS, F.array_join(markers.sorted_markers(target()), " ").alias("markers"))


@query("marker_signature", o.sql(f"""
  SELECT doc_id, block_index, coalesce(array_to_string(list_sort(list_transform(
    regexp_extract_all(translated, '{o.KNOWN}'), lambda m: trim(m, '⟦⟧'))), ' '), '') AS signature
  FROM responses""", "responses"))
def marker_signature(t: Tables) -> DataFrame:
    return t.responses().select(*IDS, F.array_join(markers.signature(target()), " ").alias("signature"))


@query("marker_tokens", o.sql(f"""
  SELECT doc_id, block_index, place, CASE WHEN NOT known THEN 'text' WHEN starts_with(piece, '⟦/E') THEN 'close'
      WHEN starts_with(piece, '⟦E') THEN 'open' ELSE 'self' END AS kind,
    CASE WHEN known THEN regexp_extract(piece, '[0-9]+')::BIGINT END AS id, {o.short_hash('piece')} AS hash
  FROM (SELECT *, regexp_full_match(piece, '{o.KNOWN}') AS known FROM (
    SELECT doc_id, block_index, unnest(ps) AS piece, generate_subscripts(ps, 1)::BIGINT AS place FROM (
      SELECT doc_id, block_index, regexp_extract_all(translated, '⟦[^⟧]*⟧|[^⟦]+|⟦[^⟧]*$') AS ps FROM responses)))
  """, "responses"))
def marker_tokens(t: Tables) -> DataFrame:
    return t.responses().select(*IDS, F.posexplode(markers.tokens(target())).alias("pos", "token")).select(
        *IDS, (F.col("pos") + 1).alias("place"), "token.kind", "token.id",
        text.short_hash(F.col("token.text")).alias("hash"),
    )


@query("text_hash", o.sql(
    f"SELECT doc_id, block_index, {o.short_hash('source_text')} AS hash FROM doc_blocks", "doc_blocks"))
def text_hash(t: Tables) -> DataFrame:
    return t.doc_blocks().select(*IDS, text.short_hash(source()).alias("hash"))


@query("preview", f"""
  SELECT doc_id, CASE WHEN length(c) <= 60 THEN c ELSE left(c, 60) || '...' END AS preview
  FROM (SELECT doc_id, {o.collapse('text')} AS c FROM documents)""")
def preview(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", text.preview(F.col("text"), 60).alias("preview"))


@query("error_summary", f"""
  SELECT doc_id,
    CASE WHEN c = '' THEN '(empty response body)' WHEN length(c) <= 240 THEN c ELSE left(c, 240) || '...' END AS http,
    CASE WHEN doc_id % 2 = 0 THEN lang || ' | type=' || source || CASE WHEN doc_id % 3 = 0 THEN ' | code=x' ELSE '' END
      WHEN length(s) <= 1000 THEN s ELSE left(s, 1000) || '...' END AS provider
  FROM (SELECT *, {o.collapse('text')} AS c, {o.strip('text')} AS s FROM documents)""")
def error_summary(t: Tables) -> DataFrame:
    error = F.struct(
        F.col("lang").alias("message"), F.col("source").alias("type"),
        F.when(F.col("doc_id") % 3 == 0, "x").alias("code"),
    )
    body = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(error.alias("error")))).otherwise(F.col("text"))
    return t.documents().select(
        "doc_id",
        formats.http_error_summary(F.col("text")).alias("http"),
        formats.json_error_summary(body).alias("provider"),
    )


@query("human_bytes", """
  SELECT doc_id, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0::DOUBLE)
    WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0::DOUBLE)
    WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS size
  FROM (SELECT doc_id, n_chars * (doc_id % 5 * doc_id * doc_id + 1) AS b FROM documents)""")
def human_bytes(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    size = F.col("n_chars") * (doc % 5 * doc * doc + 1)
    return t.given("documents").select("doc_id", formats.human_bytes(size).alias("size"))


@query("duration_fmt", """
  SELECT doc_id, format('{:02d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS hms,
    CASE WHEN s >= 86400 THEN format('{}d {}h {}m', s // 86400, s % 86400 // 3600, s % 3600 // 60)
      WHEN s >= 3600 THEN format('{}h {}m {}s', s // 3600, s % 3600 // 60, s % 60)
      WHEN s >= 60 THEN format('{}m {}s', s // 60, s % 60) ELSE format('{}s', s) END AS age
  FROM (SELECT doc_id, n_chars * (doc_id % 50) AS s FROM documents)""")
def duration_fmt(t: Tables) -> DataFrame:
    secs = F.col("n_chars") * (F.col("doc_id") % 50)
    return t.given("documents").select(
        "doc_id", formats.hms(secs).alias("hms"), formats.compact_age(secs).alias("age")
    )


@query("suggested_action", o.sql(
    "SELECT reason, suggested_action AS action, count(*) AS n FROM recovery_log GROUP BY ALL", "recovery_log"))
def suggested_action(t: Tables) -> DataFrame:
    return t.failures().groupBy("reason").agg(F.count("*").alias("n")).select(
        "reason", formats.suggested_action(F.col("reason")).alias("action"), "n"
    )


@query("path_normalize", """
  SELECT page_id, array_to_string(list_filter(string_split('./' || url, '/'), lambda x: x <> '' AND x <> '.'), '/') AS path
  FROM pages""")
def path_normalize(t: Tables) -> DataFrame:
    return t.given("pages").select(
        "page_id", spine.normalise_path(F.concat(F.lit("./"), F.col("url"))).alias("path")
    )


# Validation


@query("validate_responses", o.sql(f"""
  SELECT doc_id, block_index, coalesce({o.reason('source_text', 'translated')}, 'valid') AS verdict
  FROM responses""", "responses"))
def validate_responses(t: Tables) -> DataFrame:
    return t.responses().select(
        *IDS, F.coalesce(validation.validation_reason(source(), target()), F.lit("valid")).alias("verdict")
    )


@query("validation_summary", o.sql(f"""
  SELECT verdict, count(*) AS n FROM (
    SELECT coalesce({o.reason('source_text', 'translated')}, 'valid') AS verdict FROM responses) GROUP BY 1""",
    "responses"))
def validation_summary(t: Tables) -> DataFrame:
    return validate_responses(t).groupBy("verdict").agg(F.count("*").alias("n"))


@query("cache_revalidate", o.sql(f"""
  SELECT key, min(seq) AS seq, {o.short_hash('translated')} AS hash,
    any_value({o.reason('source_text', 'translated')}) AS reason
  FROM cache_log GROUP BY key, translated""", "cache_log"))
def cache_revalidate(t: Tables) -> DataFrame:
    return cache_ops.validated(t.cache_rows(), cache_ops.key_sources(t.keyed())).select(
        "key", "seq", text.short_hash(target()).alias("hash"), "reason"
    )


@query("error_classify", o.sql("""
  SELECT custom_id, coalesce(contains(last_error, 'HTTP 401'), false) AS auth,
    coalesce(contains(last_error, 'provider returned an explanation or refusal'), false) AS refusal,
    coalesce(contains(last_error, 'translation validation failed'), false) AS validation
  FROM work_items""", "work_items"))
def error_classify(t: Tables) -> DataFrame:
    error, none = F.col("last_error"), F.lit(None).cast("string")
    return t.items().select(
        "custom_id",
        validation.is_auth_error(error).alias("auth"),
        validation.is_refusal_error(none, error).alias("refusal"),
        validation.is_validation_error(none, error).alias("validation"),
    )


# Chunks


def chunk_ctes(max_chars: int, rows: str = "documents", keys: str = "doc_id", column: str = "text") -> dict[str, str]:
    """The cutting rule as a walk over the rest of each text."""
    least = max(max_chars // 3, 1)
    head = f"left(rest, {max_chars})"
    sentence = f"length(regexp_extract({head}, '^((?s:.*)[.!?;:。！？；：])', 1))"
    space = f"length(regexp_extract({head}, '^((?s:.*){o.SPACE})', 1))"
    cut = (
        f"CASE WHEN {sentence} >= {least} THEN {sentence} WHEN {space} >= {least} THEN {space} "
        f"ELSE {max_chars} END"
    )
    return {
        "walk": f"""
      SELECT {keys}, 0 AS i, NULL::VARCHAR AS chunk, {o.strip(column)} AS rest, false AS done FROM {rows}
      UNION ALL
      SELECT {keys}, i + 1, CASE WHEN length(rest) <= {max_chars} THEN rest ELSE {o.strip('left(rest, cut)')} END,
        CASE WHEN length(rest) <= {max_chars} THEN '' ELSE {o.strip('substr(rest, cut + 1)')} END,
        length(rest) <= {max_chars}
      FROM (SELECT *, {cut} AS cut FROM walk WHERE NOT done AND (rest <> '' OR i = 0))""",
        "doc_chunks": f"SELECT {keys}, i::BIGINT AS chunk_index, chunk FROM walk WHERE i > 0",
    }


@query("chunk_documents", o.sql(f"""
  SELECT doc_id, chunk_index, length(chunk) AS chars, {o.short_hash('chunk')} AS hash FROM doc_chunks""",
    **chunk_ctes(CFG.max_chars)).replace("walk AS MATERIALIZED", "walk AS"))
def chunk_documents(t: Tables) -> DataFrame:
    docs = t.documents().select("doc_id", F.col("text").alias("source_text"))
    return chunking.chunk_texts(docs, CFG.max_chars).select(
        "doc_id", "chunk_index", F.length("chunk").alias("chars"), text.short_hash(F.col("chunk")).alias("hash")
    )


@query("chunk_rejoin", o.sql(f"""
  SELECT doc_id, chunks, {o.short_hash('translated')} AS hash,
    {o.reason('text', 'translated')} AS reason
  FROM (SELECT doc_id, count(*) AS chunks, string_agg({o.kana('chunk')}, {o.NL} ORDER BY chunk_index) AS translated
    FROM doc_chunks GROUP BY doc_id) JOIN documents USING (doc_id)""",
    **chunk_ctes(REJOIN_CHARS)).replace("walk AS MATERIALIZED", "walk AS"))
def chunk_rejoin(t: Tables) -> DataFrame:
    docs = t.documents().select("doc_id", F.col("text").alias("source_text"))
    parts = chunking.chunk_texts(docs, REJOIN_CHARS).withColumn("translated", t.kana(F.col("chunk")))
    return chunking.rejoin_chunks(parts, ["doc_id"]).select(
        "doc_id", "chunks", text.short_hash(target()).alias("hash"), "reason"
    )


# Glossary


@query("glossary_terms", o.sql("SELECT term, n FROM term_counts", "term_counts"))
def glossary_terms(t: Tables) -> DataFrame:
    return glossary.term_counts(t.documents().select("text"))


@query("glossary_candidates", o.sql("SELECT term, n FROM candidates", "candidates"))
def glossary_candidates(t: Tables) -> DataFrame:
    return glossary.glossary_candidates(t.documents().select("text"))


def _subset_text(subset):
    return F.array_join(F.transform(subset, lambda e: e["pos"].cast("string")), ",")


@query("glossary_subset", o.sql("SELECT doc_id, block_index, positions FROM keyed", "keyed"))
def glossary_subset(t: Tables) -> DataFrame:
    return glossary.glossary_subset(t.doc_blocks(), t.glossary()).select(
        *IDS, _subset_text(F.col("subset")).alias("positions")
    )


LARGE_TERM_CHARS = (6, 10)


@query("glossary_large", o.sql(f"""
  SELECT doc_id, block_index, count(src) AS hits, {o.short_hash("string_agg(src, ',' ORDER BY src)")} AS digest
  FROM (SELECT DISTINCT doc_id, block_index, unnest(list_transform(range(1, length(low) - w + 2),
      lambda i: substr(low, i, w))) AS src
    FROM (SELECT doc_id, block_index, lower(source_text) AS low, unnest(range({LARGE_TERM_CHARS[0]}, {LARGE_TERM_CHARS[1]} + 1)) AS w
      FROM doc_blocks)) JOIN large_terms USING (src) GROUP BY doc_id, block_index""", "doc_blocks", large_terms=f"""
  SELECT DISTINCT src FROM (SELECT lower(unnest(regexp_extract_all(text, '[^ \n]+'))) AS src FROM documents)
  WHERE length(src) BETWEEN {LARGE_TERM_CHARS[0]} AND {LARGE_TERM_CHARS[1]}"""))
def glossary_large(t: Tables) -> DataFrame:
    """Every word of medium length as an entry: tens of thousands at once."""
    words = t.documents().select(F.explode(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))).alias("word"))
    entries = words.select(F.lower("word").alias("src")).distinct().where(F.length("src").between(*LARGE_TERM_CHARS)).select(
        F.lit(1).alias("pos"), "src", F.lit("t").alias("dst"))
    found = F.array_sort(F.transform("subset", lambda e: e["src"]))
    return glossary.glossary_subset(t.doc_blocks(), entries).select(
        *IDS, F.size("subset").cast("long").alias("hits"), text.short_hash(F.array_join(found, ",")).alias("digest")
    ).where("hits > 0")


@query("glossary_coverage", o.sql("""
  SELECT pos, src, count(*) AS blocks FROM doc_blocks
  JOIN glossary ON dst <> '' AND contains(lower(source_text), lower(src)) GROUP BY ALL""", "doc_blocks", "glossary"))
def glossary_coverage(t: Tables) -> DataFrame:
    found = glossary.glossary_subset(t.doc_blocks(), t.glossary())
    hits = found.select(F.explode("subset").alias("e"))
    return hits.groupBy("e.pos", "e.src").agg(F.count("*").alias("blocks"))


@query("glossary_digest", o.sql(f"""
  SELECT count(*) AS entries,
    {o.short_hash(f"string_agg(CASE WHEN dst <> '' THEN src || '=>' || dst || {o.NL} ELSE '' END, '' ORDER BY pos)")} AS digest
  FROM glossary""", "glossary"))
def glossary_digest(t: Tables) -> DataFrame:
    return glossary.glossary_digest(t.glossary())


@query("glossary_load", o.sql("""
  SELECT row_number() OVER (ORDER BY n DESC, lower(term), term) AS pos, term AS src, '' AS dst FROM candidates""",
    "candidates"))
def glossary_load(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "glossary-file")
    jsonl.write_text(glossary.glossary_document(glossary_candidates(t)), path)
    return jsonl.read_glossary(t.spark, path)


@query("glossary_export", o.sql(f"""
  SELECT 'en' AS source_lang, 'ja' AS target_lang, count(*) AS entries,
    {o.short_hash(f"string_agg(term, {o.NL} ORDER BY n DESC, lower(term), term)")} AS sources
  FROM candidates""", "candidates"))
def glossary_export(t: Tables) -> DataFrame:
    """All entries in their order."""
    parsed = F.from_json("document", "source_lang string, target_lang string, entries array<struct<src:string>>")
    src = F.transform(F.col("d.entries"), lambda e: e["src"])
    return glossary.glossary_document(glossary_candidates(t)).select(parsed.alias("d")).select(
        "d.source_lang", "d.target_lang", F.size("d.entries").alias("entries"),
        text.short_hash(F.array_join(src, "\n")).alias("sources"),
    )


_ENTRY_SQL = f"""'{{' || {o.NL} || '    "src" : "' || term || '",' || {o.NL} || '    "dst" : ""' || {o.NL} || '  }}'"""


@query("glossary_review_doc", o.sql(f"""
  SELECT length(document) AS chars, {o.short_hash("document")} AS document_hash FROM (
    SELECT {o.quote(glossary.REVIEW_INSTRUCTIONS)} || '```json' || {o.NL} || '{{' || {o.NL} || '  "source_lang" : "en",' || {o.NL} ||
      '  "target_lang" : "ja",' || {o.NL} || '  "entries" : [ ' || string_agg({_ENTRY_SQL}, ', ' ORDER BY n DESC, lower(term), term) ||
      ' ]' || {o.NL} || '}}' || {o.NL} || '```' || {o.NL} AS document FROM candidates)""", "candidates"))
def glossary_review_doc(t: Tables) -> DataFrame:
    """The whole document, letter by letter."""
    document = glossary.review_document(glossary.glossary_document(glossary_candidates(t)))
    return document.select(F.length("document").alias("chars"), text.short_hash(F.col("document")).alias("document_hash"))


# Language


FEATURES_SQL = f"""
  SELECT doc_id, block_index, {o.counted('v', r'\x{3040}-\x{309f}')} AS hiragana,
    {o.counted('v', r'\x{30a0}-\x{30ff}')} AS katakana,
    {o.counted('v', r'\x{3400}-\x{9fff}\x{f900}-\x{faff}')} AS ideographs,
    {o.counted('v', r'\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}')} AS hangul,
    {o.counted('v', r'A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}')} AS latin,
    {o.words('v')} AS words, {o.counted('v', r'\p{Nd}\p{P}')} AS digits_punctuation,
    length(regexp_replace(v, '{o.SPACE}', '', 'g')) AS visible_chars,
    coalesce({o.letters(o.longest_run('v'))}, 0) AS longest_run,
    len(regexp_extract_all(translated, '{o.KNOWN}')) AS markers
  FROM (SELECT *, {o.visible('translated')} AS v FROM responses)"""
DETECTED_SQL = """
  SELECT *, CASE WHEN ja AND longest_run >= 45 THEN 'mixed' WHEN ja THEN 'ja' WHEN hangul >= 2 THEN 'ko'
    WHEN zh AND la THEN 'mixed' WHEN zh THEN 'zh' WHEN la THEN 'latin' ELSE 'unknown' END AS language
  FROM (SELECT *, hiragana + katakana >= 4
      AND (hiragana + katakana + ideographs) >= visible_chars * 0.3 AS ja,
    ideographs >= 4 AND hiragana + katakana = 0 AS zh, latin >= 12 AND words >= 3 AS la FROM features)"""
ACTION_SQL = """CASE language WHEN 'ja' THEN 'skip' WHEN 'mixed' THEN 'warn' WHEN 'unknown' THEN 'unknown'
  ELSE 'translate' END"""


def _language_sql(body: str) -> str:
    return o.sql(body, "responses", features=FEATURES_SQL, detected=DETECTED_SQL)


@query("lang_features", _language_sql("SELECT * FROM features"))
def lang_features(t: Tables) -> DataFrame:
    return t.responses().select(*IDS, *language.features(target()))


def _detected(t: Tables) -> DataFrame:
    return lang_features(t).withColumn("language", language.label()).withColumn("action", language.action())


@query("lang_detect", _language_sql("SELECT doc_id, block_index, language FROM detected"))
def lang_detect(t: Tables) -> DataFrame:
    return _detected(t).select(*IDS, "language")


@query("lang_action", _language_sql(f"SELECT doc_id, block_index, {ACTION_SQL} AS action FROM detected"))
def lang_action(t: Tables) -> DataFrame:
    return _detected(t).select(*IDS, "action")


@query("lang_report", _language_sql(
    f"SELECT language, {ACTION_SQL} AS action, count(*) AS blocks FROM detected GROUP BY ALL"))
def lang_report(t: Tables) -> DataFrame:
    return _detected(t).groupBy("language", "action").agg(F.count("*").alias("blocks"))


# Prompts and requests


@query("cache_keys", o.sql("SELECT doc_id, block_index, cache_key FROM keyed", "keyed"))
def cache_keys(t: Tables) -> DataFrame:
    lines = glossary.glossary_lines(t.doc_blocks(), t.glossary())
    return requests.with_cache_key(lines, CFG).select(*IDS, "cache_key")


@query("build_prompts", o.sql(f"""
  SELECT doc_id, block_index, length(p) AS chars, {o.short_hash('p')} AS user_hash,
    {o.short_hash(f"{o.SYSTEM} || {o.NL} || p")} AS prompt_hash
  FROM (SELECT *, {o.PROMPT} AS p FROM keyed)""", "keyed"))
def build_prompts(t: Tables) -> DataFrame:
    prompt = prompts.prompt_with_lines(source(), F.col("prompt_lines"))
    return t.keyed().select(
        *IDS,
        F.length(prompt).alias("chars"),
        text.short_hash(prompt).alias("user_hash"),
        prompts.prompt_hash(prompt, CFG).alias("prompt_hash"),
    )


def _retry_sql() -> str:
    hints = " ".join(f"WHEN {o.quote(k)} THEN {o.NL} || {o.quote(v)} || {o.NL}" for k, v in prompts.RETRY_HINTS.items())
    marks = f"array_to_string(list_transform({o.found_markers('source_text')}, lambda m: '- ' || m || {o.NL}), '')"
    return (
        f"{o.PROMPT} || {o.NL} || {o.NL} || '<retry_instruction>' || {o.NL} || "
        f"'The previous response is not a valid translation.' || {o.NL} || 'Issue: ' || {o.message('r')} || "
        f"CASE WHEN r = 'missing_placeholder' AND {marks} <> '' THEN {o.NL} || 'Required markers:' || {o.NL} || {marks} ELSE '' END || "
        f"CASE r {hints} ELSE '' END || {o.NL} || 'Previous response:' || {o.NL} || {o.strip('translated')} || "
        f"{o.NL} || '</retry_instruction>'"
    )


@query("retry_prompt", o.sql(f"""
  SELECT doc_id, block_index, r AS reason, {o.short_hash(_retry_sql())} AS hash FROM (
    SELECT *, {o.reason('source_text', 'translated')} AS r FROM (
      SELECT *, {o.answer('source_text')} AS translated FROM keyed)) WHERE r IS NOT NULL""", "keyed"))
def retry_prompt(t: Tables) -> DataFrame:
    judged = t.keyed().withColumn("translated", t.answer(source())).withColumn(
        "reason", validation.validation_reason(source(), target())
    )
    prompt = prompts.retry_with_lines(
        source(), F.col("prompt_lines"), target(), validation.reason_message(F.col("reason")), F.col("reason")
    )
    return judged.filter("reason is not null").select(*IDS, "reason", text.short_hash(prompt).alias("hash"))


@query("provider_payloads", o.sql(f"""
  SELECT doc_id, block_index, provider, model, {o.short_hash('p')} AS prompt_hash FROM (
    SELECT *, {o.PROMPT} AS p FROM keyed),
    (VALUES ('ollama', 'qwen3:14b'), ('openai', 'gpt-5-mini'), ('claude', 'claude-sonnet-4-5')) v(provider, model)
  """, "keyed"))
def provider_payloads(t: Tables) -> DataFrame:
    prompt = prompts.prompt_with_lines(source(), F.col("prompt_lines"))
    place = {"ollama": "$.messages[1].content", "openai": "$.input", "claude": "$.messages[0].content"}

    def shape(provider: str):
        payload = prompts.provider_payload(provider, prompt, EngineConfig(provider=provider))
        return F.struct(
            F.lit(provider).alias("provider"),
            F.get_json_object(payload, "$.model").alias("model"),
            text.short_hash(F.get_json_object(payload, place[provider])).alias("prompt_hash"),
        )

    return t.keyed().select(*IDS, F.inline(F.array(*[shape(p) for p in place])))


@query("response_text", o.sql("""
  SELECT part_index, line_no, custom_id, answer FROM outputs""", "outputs"))
def response_text(t: Tables) -> DataFrame:
    return t.outputs().select(
        "part_index", "line_no", "custom_id", prompts.response_text(F.col("body")).alias("answer")
    )


@query("usage_extract", """
  SELECT conv_id, turn, provider, CASE provider WHEN 'ollama' THEN (i + x > 0)::BIGINT ELSE (turn % 5 <> 0)::BIGINT END AS requests,
    CASE WHEN provider <> 'ollama' AND turn % 5 = 0 THEN 0 ELSE i END AS input_tokens,
    CASE WHEN provider <> 'ollama' AND turn % 5 = 0 THEN 0 ELSE x END AS output_tokens,
    CASE WHEN provider <> 'ollama' AND turn % 5 = 0 THEN 0
      WHEN provider = 'openai' AND turn % 2 = 0 THEN i + x + 7 ELSE i + x END AS total_tokens
  FROM (SELECT conv_id, turn, length(role) * turn AS i, length(text) * turn AS x FROM conversations),
    (VALUES ('ollama'), ('openai'), ('claude')) v(provider)""")
def usage_extract(t: Tables) -> DataFrame:
    given, made = F.length("role") * F.col("turn"), F.length("text") * F.col("turn")
    total = F.when(F.col("turn") % 2 == 0, given + made + 7)
    remote = F.when(
        F.col("turn") % 5 != 0,
        F.struct(given.alias("input_tokens"), made.alias("output_tokens"), total.alias("total_tokens")),
    )
    local = F.to_json(F.struct(given.alias("prompt_eval_count"), made.alias("eval_count")))
    hosted = F.to_json(F.struct(remote.alias("usage")))
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("provider"), prompts.usage(local if p == "ollama" else hosted, p).alias("u"))
            for p in ("ollama", "openai", "claude")
        ]
    )
    return t.given("conversations").select("conv_id", "turn", F.inline(rows)).select(
        "conv_id", "turn", "provider", "u.*"
    )
