"""Text and chat functions on columns. All are built-in expressions and so also work on streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a string, Unicode spaces and separators included.
SPACES = "[\\s\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
LINE_END = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"
FENCE, JAVA_FENCE = "```", "```java"


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"\\A{SPACES}+", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"{SPACES}+\\z", "")


def strip(x: Column) -> Column:
    return lstrip(rstrip(x))


def is_blank(x: Column) -> Column:
    return x.rlike(f"\\A{SPACES}*\\z")


def lines(x: Column) -> Column:
    """Lines without their ends; a last line end opens no further line, and an empty text has no lines."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, f"(?:{LINE_END})\\z", ""), LINE_END))


def occurrences(x: Column, part: str) -> Column:
    """How often a string occurs in x, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- chats -----------------------------------------------------------------------------------------------------------

#: For each dialect: begin of text, role header with {role}, end of a message.
DIALECTS = {
    "chatml": ("", "<|im_start|>{role}\n", "<|im_end|>\n"),
    "llama3": ("<|begin_of_text|>", "<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>"),
}
#: Patterns of an assistant's answer, for each dialect.
ANSWERS = {
    "chatml": "(?s)<\\|im_start\\|>assistant\\s*(.*?)\\s*<\\|im_end\\|>",
    "llama3": "(?s)<\\|start_header_id\\|>assistant<\\|end_header_id\\|>(.*?)<\\|eot_id\\|>",
}
HEADERS = "(?:<\\|start_header_id\\|>assistant<\\|end_header_id\\|>|<\\|im_start\\|>assistant)"
MODEL_DIALECTS = {"qwen": "chatml", "chatml": "chatml", "llama": "llama3", "llama3": "llama3"}


def dialect_of(model: str) -> str:
    """The chat dialect of a model family; ValueError for an unknown one."""
    for family, dialect in MODEL_DIALECTS.items():
        if family in model.lower():
            return dialect
    raise ValueError(f"unknown model family: {model}; known are {', '.join(MODEL_DIALECTS)}")


def render_chat(messages: Column, dialect: str = "chatml", add_generation_prompt: bool = True) -> Column:
    """An array of (role, content) as one prompt; messages with null content are left out."""
    begin, header, end = DIALECTS[dialect]
    before, after = header.split("{role}")
    each = F.transform(F.filter(messages, lambda m: m["content"].isNotNull()), lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["content"], F.lit(end)))
    return F.concat(F.lit(begin), F.array_join(each, ""), F.lit(header.format(role="assistant") if add_generation_prompt else ""))


def chat_prompt(source: Column, target: Column | None, system: str, instruction: str, dialect: str = "chatml", add_generation_prompt: bool = True) -> Column:
    """System text, instruction directly followed by the source, the target if there is one, and an assistant header."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    parts = [message("system", F.lit(system)), message("user", F.concat(F.lit(instruction), source))]
    parts += [message("assistant", target)] if target is not None else []
    return render_chat(F.array(*parts), dialect, add_generation_prompt)


def extract_reference(prompt: Column, dialect: str = "chatml") -> Column:
    """The last answer in the prompt that is closed and not blank, stripped; empty if there is none."""
    if dialect not in ANSWERS:
        raise ValueError(f"unknown chat dialect: {dialect}")
    found = F.filter(F.transform(F.regexp_extract_all(prompt, F.lit(ANSWERS[dialect]), F.lit(1)), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def prompt_for_inference(prompt: Column) -> Column:
    """The prompt up to and with its last assistant header, stripped; all of it if there is none."""
    cut = F.regexp_extract(prompt, f"(?s)\\A.*{HEADERS}", 0)
    return strip(F.when(cut == "", prompt).otherwise(cut))


def extract_java_code(text: Column) -> Column:
    """What stands inside a leading java fence, right-stripped; a text without one, or with nothing behind its first line, is unchanged."""
    open_ = lstrip(text)
    body = F.regexp_extract(open_, "(?s)\\A[^\\n]*\\n(.*)\\z", 1)
    closed = F.instr(body, FENCE)
    inner = F.when(closed > 0, F.substr(body, F.lit(1), closed - 1)).otherwise(body)
    return F.when(open_.startswith(JAVA_FENCE) & open_.contains("\n"), rstrip(inner)).otherwise(text)


def preview(prompt: Column, limit: int = 400) -> Column:
    """The first characters on one line, with an ellipsis if there are more."""
    return F.concat(F.replace(F.substring(prompt, 1, limit), F.lit("\n"), F.lit("\\n")), F.when(F.length(prompt) > limit, F.lit("...")).otherwise(F.lit("")))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
