"""Prompt texts, cache keys and provider payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.config import KEY_NAMESPACE, PROMPT_VERSION, EngineConfig
from lectern.functions.markers import markers_in_order
from lectern.functions.text import short_hash, strip

# Style names are part of the interface; any other name means "essay". The wording is free.
STYLES = {
    "novel": "Write fiction a reader would enjoy aloud.",
    "novel-polite": "Write fiction for schoolchildren, courteous in tone.",
    "tech": "Write reference documentation for engineers.",
    "academic": "Write for a scholarly journal.",
    "business": "Write for colleagues at work.",
    "essay": "Write thoughtful non-fiction.",
}

RULES = "\n".join(
    (
        "Task: English in, Japanese out.",
        "Tokens in ⟦⟧ stand for markup: the output holds the same set of them as the input.",
        "Entries under a glossary heading are binding.",
        "Output: one text, nothing around it.",
    )
)

# The remark that a retry prompt adds for a reason; the reason codes are fixed, the wording is free.
RETRY_HINTS = {
    "unchanged_source": "English prose was left in the last answer. Only identifiers and proper names may remain in Latin script.",
    "untranslated_text": "English prose was left in the last answer. Only identifiers and proper names may remain in Latin script.",
    "untranslated_segment": "English prose was left in the last answer. Only identifiers and proper names may remain in Latin script.",
    "truncated": "The last answer ended early. Cover the whole input.",
    "prompt_leak": "The last answer talked about the task. Send the Japanese text by itself.",
    "refusal_or_explanation": "The last answer talked about the task. Send the Japanese text by itself.",
    "empty": "The last answer had no content.",
    "missing_placeholder": "The last answer lost or changed markup tokens; compare with the list above.",
}


def system_prompt(style: str) -> str:
    return RULES + "\nStyle: " + STYLES.get(style, STYLES["essay"])


def usable(subset: Column) -> Column:
    """Glossary entries with a source and a target, both stripped."""
    stripped = F.transform(subset, lambda e: F.struct(strip(e["src"]).alias("src"), strip(e["dst"]).alias("dst")))
    return F.filter(stripped, lambda e: (e["src"] != "") & (e["dst"] != ""))


#: What stands before, between and after source and target of an entry, and between two entries.
KEY_LINE, PROMPT_LINE = ("", "=>", "\n", ""), ("- ", " => ", "", "\n")


def key_lines(subset: Column) -> Column:
    """``src=>dst`` lines as they enter a digest."""
    return F.array_join(
        F.transform(usable(subset), lambda e: F.concat(e["src"], F.lit("=>"), e["dst"], F.lit("\n"))), ""
    )


def prompt_lines(subset: Column) -> Column:
    """``- src => dst`` lines as they enter a prompt."""
    return F.array_join(F.transform(
        subset, lambda e: F.concat(F.lit("- "), strip(e["src"]), F.lit(" => "), strip(e["dst"]))
    ), "\n")


def user_prompt(source: Column, subset: Column) -> Column:
    return prompt_with_lines(source, prompt_lines(subset))


def prompt_with_lines(source: Column, lines: Column) -> Column:
    """As ``user_prompt``, with the lines of the glossary subset; "" where it is empty."""
    glossary = F.concat(F.lit("<glossary>\n"), lines, F.lit("\n</glossary>\n\n"))
    return F.concat(
        F.when(lines != "", glossary).otherwise(""),
        F.lit("<source>\n"),
        source,
        F.lit("\n</source>"),
    )


def retry_prompt(source: Column, subset: Column, invalid: Column, message: Column, reason: Column) -> Column:
    return retry_with_lines(source, prompt_lines(subset), invalid, message, reason)


def retry_with_lines(source: Column, lines: Column, invalid: Column, message: Column, reason: Column) -> Column:
    pairs = [F.lit(v) for kv in RETRY_HINTS.items() for v in kv]
    hint = F.try_element_at(F.create_map(*pairs), reason)
    required = F.array_join(
        F.transform(markers_in_order(source), lambda m: F.concat(F.lit("- "), m, F.lit("\n"))), ""
    )
    marker_list = F.when(
        (reason == "missing_placeholder") & (required != ""),
        F.concat(F.lit("\nRequired markers:\n"), required),
    ).otherwise("")
    return F.concat(
        prompt_with_lines(source, lines),
        F.lit("\n\n<retry_instruction>\nThe previous response is not a valid translation.\nIssue: "),
        message,
        marker_list,
        F.when(hint.isNotNull(), F.concat(F.lit("\n"), hint, F.lit("\n"))).otherwise(""),
        F.lit("\nPrevious response:\n"),
        strip(invalid),
        F.lit("\n</retry_instruction>"),
    )


def cache_key(source: Column, subset: Column, cfg: EngineConfig) -> Column:
    return key_with_lines(source, key_lines(subset), cfg)


def key_with_lines(source: Column, lines: Column, cfg: EngineConfig) -> Column:
    """As ``cache_key``, with the ``key_lines`` of the glossary subset."""
    head = "\n".join((KEY_NAMESPACE, PROMPT_VERSION, cfg.provider, cfg.model_name, cfg.style, ""))
    return short_hash(F.concat(F.lit(head), lines, source))


def prompt_hash(prompt: Column, cfg: EngineConfig) -> Column:
    return short_hash(F.concat(F.lit(system_prompt(cfg.style) + "\n"), prompt))


def provider_payload(provider: str, prompt: Column, cfg: EngineConfig) -> Column:
    """JSON body in the shape each provider takes."""
    system = F.lit(system_prompt(cfg.style))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    model = F.lit(cfg.model_name).alias("model")
    if provider == "ollama":
        options = F.struct(
            F.lit(cfg.temperature).alias("temperature"),
            F.lit(0.9).alias("top_p"),
            F.lit(cfg.num_ctx).alias("num_ctx"),
            F.lit(42).alias("seed"),
        )
        body = F.struct(
            model,
            F.array(message("system", system), message("user", prompt)).alias("messages"),
            F.lit(False).alias("stream"),
            options.alias("options"),
        )
    elif provider == "openai":
        body = F.struct(model, system.alias("instructions"), prompt.alias("input"))
    elif provider == "claude":
        body = F.struct(
            model,
            F.lit(2048).alias("max_tokens"),
            F.lit(cfg.temperature).alias("temperature"),
            system.alias("system"),
            F.array(message("user", prompt)).alias("messages"),
        )
    else:
        raise ValueError(f"unknown provider {provider}")
    return F.to_json(body)


def response_text(body: Column) -> Column:
    """Text of a response body: ``output_text``, else all ``output[].content[].text``."""
    parsed = F.from_json(
        body,
        "output_text string, output array<struct<content:array<struct<text:string>>>>",
    )
    texts = F.filter(
        F.flatten(F.transform(parsed["output"], lambda o: F.coalesce(o["content"], F.array()))),
        lambda c: c["text"].isNotNull(),
    )
    joined = F.array_join(F.transform(texts, lambda c: c["text"]), "")
    return F.coalesce(strip(parsed["output_text"]), F.when(F.size(texts) > 0, strip(joined)))


USAGE_SCHEMA = (
    "usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>,"
    "prompt_eval_count bigint, eval_count bigint"
)


def usage(body: Column, provider: str) -> Column:
    """(requests, input_tokens, output_tokens, total_tokens) of a response body."""
    parsed = F.from_json(body, USAGE_SCHEMA)
    zero = F.lit(0).cast("long")
    if provider == "ollama":
        given_in, given_out = parsed["prompt_eval_count"], parsed["eval_count"]
        total = zero
    else:
        given_in, given_out = parsed["usage"]["input_tokens"], parsed["usage"]["output_tokens"]
        total = parsed["usage"]["total_tokens"] if provider == "openai" else F.lit(None).cast("long")
    tokens_in, tokens_out = F.coalesce(given_in, zero), F.coalesce(given_out, zero)
    if provider == "ollama":
        requests, total = ((tokens_in > 0) | (tokens_out > 0)).cast("long"), tokens_in + tokens_out
    else:
        requests = parsed["usage"].isNotNull().cast("long")
        total = F.coalesce(total, tokens_in + tokens_out)
    return F.struct(
        requests.alias("requests"),
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        total.alias("total_tokens"),
    )
