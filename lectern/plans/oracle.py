"""SQL twins of the columns and derived tables, written for DuckDB.

Each derived table is a common table expression; ``sql`` puts those a query needs
in front of it. They state the same rules by other means (regular expressions
without look-around, islands over exploded words, plain window functions).
"""

from __future__ import annotations

from lectern.config import KEY_NAMESPACE, PROMPT_VERSION
from lectern.functions.markup import BLOCK_TAGS, CODE_TAGS, POPUP_PREFIX, VOID_TAGS
from lectern.functions.prompts import system_prompt
from lectern.functions.text import LINK_HINTS, MONTHS, SENTENCE_TERMINALS
from lectern.functions.validation import PROMPT_TAGS, REASON_MESSAGES, REFUSALS_EN, REFUSALS_JA
from lectern.operators.glossary import FRONT_MATTER, SENTENCE_STARTERS
from lectern.plans.tables import (
    AT, CFG, GLOSSARY_TERMS, ITEM_STATES, KANA_LETTERS, LATIN_LETTERS, PART_ROWS, PART_STATUSES,
)

SPACE = r"[\s\v\x{85}\p{Z}]"
JAPANESE = r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}"
KNOWN = "⟦(?:/?E|S)[0-9]+⟧"
NL = "chr(10)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def form(x: str) -> str:
    return f"lower(regexp_replace({x}, '{SPACE}', '', 'g'))"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z]{{2,}}'))"


def japanese(x: str) -> str:
    return f"length(regexp_replace({x}, '[^{JAPANESE}]', '', 'g'))"


def counted(x: str, chars: str) -> str:
    return f"length(regexp_replace({x}, '[^{chars}]', '', 'g'))"


def found_markers(x: str) -> str:
    return f"regexp_extract_all({x}, '⟦[^⟧]*⟧')"


def visible(x: str) -> str:
    return f"regexp_replace({x}, '{KNOWN}', '', 'g')"


def number_list(x: str) -> str:
    v = visible(x)
    return (
        f"(regexp_matches({x}, '{KNOWN}') AND regexp_matches({v}, '[0-9]') AND "
        f"regexp_full_match({v}, '(?:{SPACE}|[0-9,.;:()\\[\\]\\x{{2010}}-\\x{{2014}}-])*'))"
    )


def terminal(x: str) -> str:
    return f"coalesce(right({strip(x)}, 1) IN {listed(SENTENCE_TERMINALS)}, false)"


def longest_run(x: str) -> str:
    runs = f"""regexp_extract_all({x}, '[A-Za-z \\t\\n\\f\\r''",.;:?!()-]+')"""
    best = (
        f"list_sort(list_transform({runs}, lambda r, i: {{'l': {letters('r')}, 'i': -i, 'r': r}}), 'DESC')[1]"
    )
    return f"(CASE WHEN ({best}).l > 0 THEN trim(({best}).r, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) END)"


def any_contains(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(n)})" for n in needles) + ")"


def any_starts(x: str, needles) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {quote(n)})" for n in needles) + ")"


def commas(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ',', '')))"


def reference_like(x: str) -> str:
    dated = f"({any_contains(f'lower({x})', MONTHS)} OR (contains({x}, '(') AND contains({x}, ')')))"
    title = rf"len(regexp_extract_all({x}, '(?:^|{SPACE})[^\p{{L}}\p{{M}}\p{{N}}\s\v\x{{85}}\p{{Z}}]*[A-Z]'))"
    quoted = any_contains(x, ("“", "”", '"', "⟦E"))
    return (
        f"({any_contains(f'lower({x})', LINK_HINTS)} OR ({commas(x)} >= 3 AND {dated}) OR "
        f"({commas(x)} >= 2 AND {quoted}) OR ({dated} AND {title} >= 4))"
    )


def reason(source: str, target: str) -> str:
    s, t = strip(source), strip(target)
    citation = (
        f"(regexp_matches({s}, '{KNOWN}') AND {form(s)} <> {form(t)} AND regexp_matches({t}, '[、。『』「」]'))"
    )
    english = f"(({words(s)} >= 3 AND {words(t)} >= 3) OR ({letters(s)} >= 24 AND {letters(t)} >= 12))"
    run = longest_run(t)
    short = (
        f"(({terminal(s)} AND NOT {terminal(t)}) OR ({letters(s)} >= 240 AND {japanese(t)} * 6 < {letters(s)}))"
    )
    return f"""(CASE
      WHEN coalesce({t}, '') = '' THEN 'empty'
      WHEN {any_contains(f'lower({t})', PROMPT_TAGS)} THEN 'prompt_leak'
      WHEN list_sort({found_markers(s)}) <> list_sort({found_markers(t)}) THEN 'missing_placeholder'
      WHEN {form(s)} = {form(t)} AND {letters(s)} >= 6 AND NOT {number_list(s)} THEN 'unchanged_source'
      WHEN {any_starts(f'lower({t})', REFUSALS_EN)} OR {any_starts(t, REFUSALS_JA)} THEN 'refusal_or_explanation'
      WHEN {japanese(t)} = 0 AND {english} AND NOT {citation} THEN 'untranslated_text'
      WHEN {japanese(t)} > 0 AND {words(s)} >= 8 AND {words(run)} >= 7 AND {letters(run)} >= 45
        THEN 'untranslated_segment'
      WHEN {japanese(t)} > 0 AND {words(s)} >= 20 AND {short} THEN 'truncated' END)"""


def message(code: str) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in REASON_MESSAGES.items())
    return f"(CASE {code} {whens} END)"


def short_hash(x: str) -> str:
    return f"substr(sha256({x}), 1, 32)"


def kana(x: str) -> str:
    return f"translate({x}, '{LATIN_LETTERS}', '{KANA_LETTERS}')"


CHOICE = "((doc_id * 31 + block_index) % 10)"


def answer(source: str, n: str = CHOICE) -> str:
    marks = f"coalesce(array_to_string({found_markers(source)}, ''), '')"
    return f"""(CASE {n} WHEN 0 THEN '' WHEN 1 THEN '<source>' || {source} WHEN 2 THEN {visible(source)}
      WHEN 3 THEN {source} WHEN 4 THEN 'I''m sorry. ' || {marks} WHEN 5 THEN 'Zz ' || {source}
      WHEN 6 THEN '訳文。' || {source} WHEN 7 THEN {marks} || '訳' ELSE {kana(source)} END)"""


def decode(x: str) -> str:
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', {quote(plain)})"
    return x


def escape(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = f"replace({x}, {quote(raw)}, '{entity}')"
    return x


KEY_HEAD = " || chr(10) || ".join(
    quote(v) for v in (KEY_NAMESPACE, PROMPT_VERSION, CFG.provider, CFG.model_name, CFG.style)
) + " || chr(10)"
SYSTEM = quote(system_prompt(CFG.style))
_TAGS = "|".join(BLOCK_TAGS)
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
CODE = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in CODE_TAGS)
RAW_BLOCK = (
    rf"(?i)<(?:[a-z0-9]+:)?(?:{_TAGS})(?:\s[^>]*)?>|<div\s[^>]*id=[\"'']{POPUP_PREFIX}[^>]*>"
)
VOIDS = "|".join(VOID_TAGS)
RUN_HASH = "substr(sha256(corpus_id), 1, 32)"
PROMPT = (
    f"(CASE WHEN prompt_lines <> '' THEN '<glossary>' || {NL} || prompt_lines || {NL} || '</glossary>' || "
    f"{NL} || {NL} ELSE '' END || '<source>' || {NL} || source_text || {NL} || '</source>')"
)
CUSTOM_ID = (
    "('lectern:' || corpus_id || ':p' || format('{:04d}', page_no) || ':b' || format('{:04d}', block_index) "
    "|| ':' || cache_key)"
)
STATES = "[" + ", ".join(quote(s) for s in ITEM_STATES) + "]"
STATUSES = "[" + ", ".join(quote(s) for s in PART_STATUSES) + "]"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "doc_blocks": ((), f"""
      SELECT corpus_id, page_no, doc_id, n_chars, i::BIGINT AS block_index,
        'd' || doc_id || '.xhtml' AS href,
        CASE WHEN i % 3 = 0 THEN '⟦E1⟧' || line || '⟦/E1⟧' ELSE line END AS source_text
      FROM (SELECT *, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
        FROM (SELECT source AS corpus_id, doc_id + 1 AS page_no, doc_id, n_chars,
          list_filter(list_transform(string_split(text, {NL}), lambda x: {collapse('x')}), lambda x: x <> '') AS lines
          FROM documents))"""),
    "words": ((), """
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9''-]+'), lambda x: x <> '') AS ws
        FROM documents)"""),
    "term_runs": (("words",), """
      SELECT doc_id, g, string_agg(w, ' ' ORDER BY p) AS run, count(*) AS n FROM (
        SELECT doc_id, w, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g
        FROM words WHERE regexp_matches(trim(w, ''''), '^[A-Z].*[a-z]'))
      GROUP BY doc_id, g"""),
    "term_counts": (("term_runs",), f"""
      SELECT term, count(*) AS n FROM (
        SELECT CASE WHEN n = 1 THEN trim(run, '''') ELSE run END AS term FROM term_runs
        WHERE NOT (n = 1 AND trim(run, '''') IN {listed(SENTENCE_STARTERS)}))
      WHERE length(term) >= 4 GROUP BY term"""),
    "candidates": (("term_counts",), f"""
      SELECT term, n FROM term_counts
      WHERE n >= 3 AND term NOT IN {listed(SENTENCE_STARTERS + FRONT_MATTER)}
      ORDER BY n DESC, lower(term), term LIMIT 200"""),
    "glossary": (("candidates",), f"""
      SELECT pos, term AS src, CASE WHEN pos % 10 = 0 THEN '' ELSE 'T' || pos END AS dst FROM (
        SELECT row_number() OVER (ORDER BY n DESC, lower(term), term) AS pos, term FROM candidates)
      WHERE pos <= {GLOSSARY_TERMS}"""),
    "keyed": (("doc_blocks", "glossary"), f"""
      SELECT *, substr(sha256({KEY_HEAD} || key_lines || source_text), 1, 32) AS cache_key FROM (
        SELECT b.*, coalesce(key_lines, '') AS key_lines, coalesce(prompt_lines, '') AS prompt_lines,
          coalesce(positions, '') AS positions
        FROM doc_blocks b LEFT JOIN (
          SELECT doc_id, block_index,
            string_agg(src || '=>' || dst || {NL}, '' ORDER BY pos) AS key_lines,
            string_agg('- ' || src || ' => ' || dst, {NL} ORDER BY pos) AS prompt_lines,
            string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions
          FROM doc_blocks JOIN glossary ON dst <> '' AND contains(lower(source_text), lower(src))
          GROUP BY doc_id, block_index) g USING (doc_id, block_index))"""),
    "responses": (("doc_blocks",), f"SELECT *, {answer('source_text')} AS translated FROM doc_blocks"),
    "cache_log": (("keyed",), f"""
      SELECT doc_id * 1000000 + block_index * 2 + copy AS seq, cache_key AS key, corpus_id,
        CASE WHEN copy = 1 THEN {kana('source_text')} || '二'
          WHEN doc_id % 7 = 0 THEN source_text ELSE {kana('source_text')} END AS translated,
        '{CFG.provider}' AS provider, '{CFG.model_name}' AS model, '{AT}' AS "at", source_text
      FROM keyed, (VALUES (0), (1)) v(copy)
      WHERE (doc_id + block_index) % 10 <> 3 AND (copy = 0 OR doc_id % 5 = 0)"""),
    "cache": (("cache_log",), """
      SELECT key, translated, provider, model, "at", seq, source_text FROM cache_log
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1"""),
    "expected": (("keyed",), f"""
      SELECT {CUSTOM_ID} AS custom_id, cache_key, corpus_id, page_no AS page_index, block_index, href, source_text,
        {short_hash('source_text')} AS source_hash,
        {short_hash(f'{SYSTEM} || {NL} || {PROMPT}')} AS prompt_hash,
        length(source_text) AS source_chars, doc_id, n_chars FROM keyed"""),
    "work_items": (("keyed",), f"""
      SELECT {CUSTOM_ID} AS custom_id, cache_key, corpus_id, page_no AS page_index, block_index, href, source_text,
        CASE WHEN doc_id % 11 = 0 THEN 'x' || substr(sha256(source_text), 2, 31)
          ELSE {short_hash('source_text')} END AS source_hash,
        {short_hash(f'{SYSTEM} || {NL} || {PROMPT}')} AS prompt_hash,
        length(source_text) AS source_chars, {STATES}[n + 1] AS state, 1 + n % 3 AS attempt,
        CASE n WHEN 2 THEN 'HTTP 401 unauthorized' WHEN 3 THEN 'translation validation failed'
          WHEN 7 THEN 'provider returned an explanation or refusal instead of a translation' END AS last_error,
        '2026-01-01T0' || n || ':00:00Z' AS updated_at, doc_id, n
      FROM (SELECT *, {CHOICE} AS n FROM (
        SELECT * FROM keyed
        UNION ALL SELECT * REPLACE (900001 AS block_index) FROM keyed WHERE doc_id % 17 = 0 AND block_index = 1))"""),
    "gapped_items": (("work_items",), "SELECT * FROM work_items WHERE NOT (doc_id % 13 = 0 AND block_index % 2 = 0)"),
    "outputs": (("work_items",), f"""
      WITH base AS (SELECT *, doc_id // 50 + 1 AS part_index FROM work_items WHERE n <> 2)
      SELECT part_index, 1000000000000000 - (doc_id * 100000000 + block_index * 2) + copy AS line_no, custom_id,
        CASE WHEN doc_id % 31 <> 0 THEN CASE WHEN doc_id % 19 = 0 THEN 500 ELSE 200 END END AS status_code,
        CASE WHEN doc_id % 31 <> 0 THEN {strip(answer('source_text'))} END AS answer,
        CASE WHEN doc_id % 29 = 0 THEN 'overloaded' END AS error
      FROM base, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR doc_id % 23 = 0
      UNION ALL SELECT DISTINCT part_index, 0, 'unknown:' || part_index, 200, 'x', NULL FROM base"""),
    "remote_errors": (("work_items",), """
      SELECT 1 AS part_index, doc_id * 100000000 + block_index AS line_no, custom_id,
        CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 429 END AS status_code,
        CASE WHEN doc_id % 2 = 0 THEN 'quota exceeded' END AS error
      FROM work_items WHERE n = 2"""),
    "import_lines": (("outputs", "remote_errors", "work_items", "cache"), f"""
      WITH lines AS (
        SELECT 0 AS stream, * FROM outputs
        UNION ALL SELECT 1, part_index, line_no, custom_id, status_code, NULL, error FROM remote_errors),
      ranked AS (
        SELECT l.*, w.cache_key, w.source_text, w.source_hash, c.translated AS stored,
          row_number() OVER (PARTITION BY l.custom_id ORDER BY stream, part_index, line_no) AS place,
          w.custom_id IS NOT NULL AS known
        FROM lines l LEFT JOIN work_items w USING (custom_id) LEFT JOIN cache c ON c.key = w.cache_key),
      judged AS (
        SELECT *, place = 1 AND known AND stream = 0 AS open, source_hash = {short_hash('source_text')} AS hash_ok,
          stored IS NOT NULL AND {reason('source_text', 'stored')} IS NULL AS stored_ok,
          CASE WHEN error IS NOT NULL THEN 'batch output error: ' || error
            WHEN status_code IS NULL THEN 'batch output line has no response'
            WHEN status_code <> 200 THEN 'batch output status_code was ' || status_code
            WHEN answer IS NULL THEN 'batch response body did not contain output text'
            ELSE {message(reason('source_text', 'answer'))} END AS fault
        FROM ranked),
      run AS (
        SELECT *, coalesce(bool_or(open AND hash_ok AND NOT stored_ok AND fault IS NULL) OVER (
          PARTITION BY cache_key ORDER BY stream, part_index, line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS won_before
        FROM judged),
      told AS (
        SELECT *, CASE WHEN place > 1 THEN 'duplicate' WHEN NOT known THEN 'unknown' WHEN stream = 1 THEN 'failed'
          WHEN NOT hash_ok THEN 'rejected' WHEN stored_ok OR won_before THEN 'already_cached'
          WHEN fault IS NULL THEN 'imported' ELSE 'rejected' END AS outcome FROM run)
      SELECT stream, part_index, line_no, custom_id, cache_key, outcome,
        CASE outcome WHEN 'duplicate' THEN 'duplicate output custom_id'
          WHEN 'unknown' THEN 'output custom_id was not found in work_items.jsonl'
          WHEN 'failed' THEN CASE WHEN error IS NOT NULL THEN 'remote batch error: ' || error
            WHEN status_code IS NOT NULL THEN 'remote batch error status_code: ' || status_code
            ELSE 'remote batch error line did not contain error details' END
          WHEN 'rejected' THEN CASE WHEN NOT hash_ok THEN 'work item source_hash does not match source_text'
            ELSE fault END END AS message
      FROM told"""),
    "numbered": (("keyed",), """
      SELECT corpus_id, row_number() OVER (PARTITION BY corpus_id ORDER BY doc_id, block_index) AS rn,
        strlen(source_text) + 1 AS bytes FROM keyed"""),
    "parts": (("numbered",), f"""
      SELECT *, 'requests.part-' || format('{{:04d}}', part_index) || '.jsonl' AS request_file,
        'file-' || corpus_id || '-' || part_index AS file_id,
        CASE WHEN part_index % 4 <> 0 THEN 'batch-' || corpus_id || '-' || part_index END AS batch_id,
        CASE WHEN status IN ('completed', 'expired', 'cancelled') THEN 'out-' || corpus_id || '-' || part_index END AS output_file_id,
        CASE WHEN status IN ('failed', 'expired') THEN 'err-' || corpus_id || '-' || part_index END AS error_file_id,
        CASE WHEN status = 'completed' AND part_index % 2 = 1 THEN request_count
          WHEN status = 'in_progress' THEN request_count // 2 ELSE 0 END AS completed_count,
        part_index % 3 AS failed_count
      FROM (SELECT *, {STATUSES}[part_index % 9 + 1] AS status FROM (
        SELECT corpus_id, (rn - 1) // {PART_ROWS} + 1 AS part_index, count(*) AS request_count,
          sum(bytes)::BIGINT AS request_bytes FROM numbered GROUP BY ALL))"""),
    "manifests": (("parts",), """
      SELECT corpus_id, sum(request_count)::BIGINT AS request_count, sum(failed_count)::BIGINT AS failed_count,
        sum(CASE WHEN status = 'completed' AND completed_count = 0 THEN request_count ELSE completed_count END)::BIGINT
          AS completed_requests,
        max(CASE WHEN part_index = 1 THEN batch_id END) AS batch_id, min_by(file_id, part_index) AS file_id,
        CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'failed') THEN 'failed'
          WHEN bool_or(status = 'expired') THEN 'expired' WHEN bool_or(status = 'cancelled') THEN 'cancelled'
          WHEN bool_or(status = 'cancelling') THEN 'cancelling' WHEN bool_or(status = 'finalizing') THEN 'finalizing'
          WHEN bool_or(status = 'in_progress') THEN 'in_progress' WHEN bool_or(status = 'validating') THEN 'validating'
          WHEN bool_and(status = 'submitted') THEN 'submitted' ELSE 'partial' END AS status,
        bool_or(batch_id IS NULL) AS needs_submit
      FROM parts GROUP BY corpus_id"""),
    "runs": ((), """
      SELECT substr(sha256(source), 1, 32) AS run_hash, source AS corpus_id, min(doc_id) AS first_doc, count(*) AS docs,
        CASE WHEN min(doc_id) % 6 = 5 THEN NULL WHEN min(doc_id) % 6 = 4 THEN 'not a date'
          ELSE '2025-12-' || lpad((min(doc_id) % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' END AS last_updated_at
      FROM documents GROUP BY source"""),
    "failures": (("keyed",), f"""
      SELECT *, {message('validation_reason')} AS error FROM (
        SELECT *, {reason('source_text', answer('source_text'))} AS validation_reason,
          ['cache_miss', 'inline_restore_failed', 'validation_passthrough', 'original_output', 'unchanged_source']
            [{CHOICE} % 5 + 1] AS reason FROM keyed) WHERE validation_reason IS NOT NULL"""),
    "recovery_log": (("failures",), f"""
      SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'x' || substr(sha256(source_text), 2, 31)
          ELSE {short_hash('source_text')} END AS source_hash, corpus_id AS input,
        CASE reason WHEN 'cache_miss' THEN 'translate_uncached'
          WHEN 'inline_restore_failed' THEN 'retry_translation_or_inspect_inline'
          ELSE 'retry_translation' END AS suggested_action FROM failures"""),
    "recovery_files": (("failures",), f"""
      SELECT {RUN_HASH} AS run_hash, 'out' || (doc_id % 3) AS output,
        CASE WHEN block_index % 5 = 0 THEN 'failed' ELSE 'recovery' END AS file, doc_id AS mtime FROM failures"""),
    "attempts": (("keyed",), f"""
      SELECT cache_key, translated, source_text, doc_id % 4 + 1 AS requests,
        CASE WHEN NOT (doc_id % 37 = 0 AND r IS NOT NULL) THEN r END AS reason,
        CASE WHEN doc_id % 37 = 0 AND r IS NOT NULL THEN 'HTTP 401 unauthorized' END AS error
      FROM (SELECT *, {reason('source_text', 'translated')} AS r FROM (
        SELECT *, {answer('source_text')} AS translated FROM keyed
        QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY doc_id, block_index) = 1))"""),
    "status": (("keyed", "cache"), f"""
      SELECT k.*, c.translated, CASE WHEN c.key IS NULL THEN 'miss'
          WHEN {reason('k.source_text', 'c.translated')} IS NOT NULL THEN 'invalid' ELSE 'hit' END AS status,
        CASE WHEN c.key IS NOT NULL THEN {reason('k.source_text', 'c.translated')} END AS reason
      FROM keyed k LEFT JOIN cache c ON c.key = k.cache_key"""),
    "hosts": ((), """
      SELECT *, regexp_extract(url, '://([^/]+)', 1) AS corpus_id, page_id + 1 AS page_no,
        'p' || page_id || '.xhtml' AS href,
        regexp_extract(url, '://([^/]+)', 1) || '#' || (page_id // 500) AS volume FROM pages"""),
    "page_pieces": (("hosts",), rf"""
      SELECT corpus_id, page_no, p, lower(string_split(piece, chr(2))[1]) AS tag,
        substr(piece, instr(piece, chr(2)) + 1) AS body
      FROM (SELECT corpus_id, page_no, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (
        SELECT corpus_id, page_no, string_split(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'),
          '(?i)<(/?)(?:[a-z0-9]+:)?({_TAGS})(?:\s[^>]*)?>', chr(1) || '\1\2' || chr(2), 'g'), chr(1)) AS ps FROM hosts))
      WHERE p > 1 AND NOT starts_with(piece, '/')"""),
    "page_blocks": (("page_pieces",), rf"""
      SELECT *, row_number() OVER (PARTITION BY corpus_id, page_no ORDER BY p) AS block_index FROM (
        SELECT *, {collapse(decode("regexp_replace(body, '(?s)<[/!?a-zA-Z][^>]*>', '', 'g')"))} AS shown,
          len(regexp_extract_all(body, '<[a-zA-Z][^>]*>')) AS starts,
          len(regexp_extract_all(body, '</[a-zA-Z][^>]*>')) AS ends,
          len(regexp_extract_all(body, '(?i)<(?:{VOIDS})(?:\s[^>]*)?>|<[a-zA-Z][^>]*/>')) AS singles
        FROM page_pieces) WHERE shown <> '' OR starts + ends > 0"""),
    # Tags of a page with the number of elements open after each; ends close to the left of their start's level.
    "strict_tags": (("hosts",), rf"""
      SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY i) AS level FROM (
        SELECT page_id, corpus_id, page_no, i, piece, regexp_extract(piece, '^</?([^\s/>]+)', 1) AS name,
          CASE WHEN NOT regexp_matches(piece, '^</?[a-zA-Z]') THEN 0 WHEN starts_with(piece, '</') THEN -1
            WHEN ends_with(piece, '/>') THEN 0 ELSE 1 END AS step
        FROM (SELECT page_id, corpus_id, page_no, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
          SELECT *, regexp_extract_all(html, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[/!?a-zA-Z][^>]*>|[^<]+') AS ps FROM hosts)))"""),
    "strict_outer": (("strict_tags",), rf"""
      SELECT *, min(CASE WHEN problem IS NOT NULL THEN first END) OVER (PARTITION BY page_id) AS bad FROM (
        SELECT page_id, corpus_id, page_no, name, first, last,
          CASE WHEN last IS NULL THEN 'page ends inside <' || name || '>'
            WHEN closer <> name THEN '</' || closer || '> inside <' || name || '>' END AS problem
        FROM (SELECT *, coalesce(max(coalesce(last, 1000000000)) OVER (PARTITION BY page_id ORDER BY first
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM (
          SELECT s.page_id, s.corpus_id, s.page_no, s.name, s.i AS first, min(e.i) AS last, arg_min(e.name, e.i) AS closer
          FROM strict_tags s LEFT JOIN strict_tags e
            ON e.page_id = s.page_id AND e.i > s.i AND e.step = -1 AND e.level < s.level
          WHERE s.step = 1 AND (regexp_extract(s.name, '([^:]+)$', 1) IN {listed(BLOCK_TAGS)}
            OR (regexp_extract(s.name, '([^:]+)$', 1) = 'div' AND regexp_matches(s.piece, '\sid\s*=\s*["'']{POPUP_PREFIX}')))
          GROUP BY ALL)) WHERE first > covered)"""),
    # An end without a start of its name lowers that name's sum to a new least value; others pair by height.
    "strict_inline": (("strict_outer",), """
      SELECT *, CASE WHEN kind = '/E' AND NOT lone THEN max(CASE WHEN kind = 'E' THEN fresh END)
          OVER (PARTITION BY page_id, first, name, height ORDER BY i) ELSE fresh END AS number
      FROM (SELECT *, count(CASE WHEN kind IN ('E', 'S') OR lone THEN 1 END) OVER (PARTITION BY page_id, first ORDER BY i) AS fresh,
          total - least(0, coalesce(low, 0)) + CASE WHEN kind = '/E' AND NOT lone THEN 1 ELSE 0 END AS height
        FROM (SELECT *, kind = '/E' AND total < least(0, coalesce(lag(low) OVER (PARTITION BY page_id, first, name ORDER BY i), 0)) AS lone
          FROM (SELECT *, min(total) OVER (PARTITION BY page_id, first, name ORDER BY i) AS low
            FROM (SELECT b.page_id, b.first, t.i, t.piece, t.name,
                CASE WHEN NOT regexp_matches(t.piece, '^</?[a-zA-Z]') THEN NULL WHEN t.step = -1 THEN '/E'
                  WHEN t.step = 0 THEN 'S' ELSE 'E' END AS kind,
                sum(CASE WHEN regexp_matches(t.piece, '^</?[a-zA-Z]') THEN t.step ELSE 0 END)
                  OVER (PARTITION BY b.page_id, b.first, t.name ORDER BY t.i) AS total
              FROM strict_outer b JOIN strict_tags t ON t.page_id = b.page_id AND t.i > b.first AND t.i < b.last
              WHERE b.problem IS NULL AND b.first < coalesce(b.bad, 1000000000)))))"""),
    "strict_blocks": (("strict_inline",), rf"""
      SELECT b.corpus_id, b.page_no, row_number() OVER (PARTITION BY b.page_id ORDER BY b.first) AS block_index,
        regexp_extract(b.name, '([^:]+)$', 1) AS tag, source_text, tags, NULL AS corrupt_reason
      FROM strict_outer b JOIN (SELECT page_id, first, {collapse("string_agg(shown, '' ORDER BY i)")} AS source_text,
          coalesce(string_agg(CASE WHEN kind IS NOT NULL THEN shown || piece END, '' ORDER BY i), '') AS tags
        FROM (SELECT *, CASE WHEN kind IS NOT NULL THEN '⟦' || kind || number || '⟧'
            WHEN starts_with(piece, '<![CDATA[') THEN substr(piece, 10, length(piece) - 12) WHEN starts_with(piece, '<') THEN ''
            ELSE {decode('piece')} END AS shown FROM strict_inline) GROUP BY page_id, first) x
        ON x.page_id = b.page_id AND x.first = b.first
      WHERE source_text <> ''
      UNION ALL SELECT corpus_id, page_no, NULL, NULL, NULL, NULL, problem FROM strict_outer WHERE first = bad"""),
    "nav": (("hosts",), """
      SELECT corpus_id, page_no, unnest(a) AS piece, generate_subscripts(a, 1) AS pos, nav FROM (
        SELECT corpus_id, page_no, nav, regexp_extract_all(nav, '(?is)<a [^>]*>.*?</a\\s*>') AS a FROM (
          SELECT *, regexp_extract(html, '(?is)<nav(?:\\s[^>]*)?>.*?</nav\\s*>') AS nav FROM hosts))"""),
    "nav_toc": (("nav",), f"""
      SELECT corpus_id, page_no, (pos - 1)::BIGINT AS pos, greatest(1, len(regexp_extract_all(prefix, '<[ou]l[ >]'))
          - len(regexp_extract_all(prefix, '</[ou]l'))) AS level,
        {collapse(decode("regexp_replace(piece, '(?s)<[^>]*>', '', 'g')"))} AS label,
        {decode("regexp_extract(piece, 'href=\"([^\"]*)\"', 1)")} AS href
      FROM (SELECT *, substr(nav, 1, instr(nav, piece) - 1) AS prefix FROM nav)"""),
    "run_events": ((), """
      SELECT user_id AS run_key, event_id, ts, event_type = 'purchase' AS completed,
        CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'finish'
          WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'heartbeat' END AS kind FROM events"""),
    "usage": ((), """
      SELECT conv_id, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS requests,
        CASE WHEN role = 'assistant' THEN 0 ELSE t END AS input_tokens,
        CASE WHEN role = 'assistant' THEN t ELSE 0 END AS output_tokens, t AS total_tokens
      FROM (SELECT *, (length(text) + 3) // 4 AS t FROM conversations)"""),
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """``body`` behind the tables it needs; ``extra`` adds tables of its own, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS MATERIALIZED ({text})" for n, text in extra.items()]
    recursive = "RECURSIVE " if extra else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body
