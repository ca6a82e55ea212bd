"""Schemas of the stored tables."""

CACHE = "seq bigint, key string, translated string, provider string, model string, at string"

WORK_ITEMS = (
    "custom_id string, cache_key string, corpus_id string, page_index bigint, block_index int, "
    "href string, source_text string, source_hash string, prompt_hash string, source_chars int, "
    "provider string, model string, state string, attempt int, last_error string, updated_at string"
)

OUTPUT_LINE = (
    "custom_id string, response struct<status_code:int,body:string>, error string"
)

RECOVERY = (
    "kind string, reason string, input string, output string, cache_root string, provider string, "
    "model string, style string, page_no bigint, block_index int, href string, cache_key string, "
    "source_hash string, source_text string, error string, suggested_action string, at string"
)

GLOSSARY_FILE = "source_lang string, target_lang string, entries array<struct<src:string,dst:string>>"
