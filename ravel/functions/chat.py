"""Chat messages and their rendering.

Messages are ``array<struct<role:string, content:string>>``.  Rendering
uses the public ChatML layout (``<|im_start|>role\\ncontent<|im_end|>\\n``);
the template is a parameter because model templates are not part of the
data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravel.functions.text import col_
from ravel.params import BOXED_INSTRUCTION, SYSTEM_PROMPT, TOPIC_SYSTEM_PROMPT, TOPIC_USER_PROMPT

IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
GENERATION_SUFFIX = "<think>\n"


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def assistant_content(think: Column | None, response: Column | None) -> Column:
    """``<think>\\n..\\n</think>\\n`` + response; empty think block when only a response exists."""
    t = think if think is not None else F.lit(None).cast("string")
    r = response if response is not None else F.lit(None).cast("string")
    think_part = F.when(t.isNotNull(), F.concat(F.lit("<think>\n"), t, F.lit("\n</think>\n")))
    empty_think = F.when(t.isNull() & r.isNotNull(), F.lit("<think>\n\n</think>\n"))
    body = F.concat(F.coalesce(think_part, F.lit("")), F.coalesce(empty_think, F.lit("")), F.coalesce(r, F.lit("")))
    return F.when(body != "", body)


def build_messages(
    user: Column | str,
    think: Column | None = None,
    response: Column | None = None,
    boxed_force: Column | bool = True,
    add_system: bool = True,
    system_prompt: str = SYSTEM_PROMPT,
) -> Column:
    """system (optional) + user + assistant (only when it has content)."""
    msgs = []
    if add_system:
        bf = F.lit(boxed_force) if isinstance(boxed_force, bool) else boxed_force
        sys_text = F.when(bf, F.lit(system_prompt + BOXED_INSTRUCTION)).otherwise(F.lit(system_prompt))
        msgs.append(_msg("system", sys_text))
    msgs.append(_msg("user", col_(user)))
    asst = assistant_content(think, response)
    msgs.append(F.when(asst.isNotNull(), _msg("assistant", asst)))
    return F.filter(F.array(*msgs), lambda m: m.isNotNull())


def render_chat(messages: Column | str, add_generation_prompt: bool = False, open_ended: Column | None = None) -> Column:
    """Messages -> one prompt string in ChatML layout.

    ``add_generation_prompt`` appends ``<|im_start|>assistant\\n`` and then
    ``<think>\\n`` if the text does not already end with it.  ``open_ended``
    (a boolean Column, e.g. "response is null") cuts the closing
    ``\\n<|im_end|>\\n`` so the last message stays open.
    """
    m = col_(messages)
    text = F.array_join(
        F.transform(m, lambda x: F.concat(F.lit(IM_START), x["role"], F.lit("\n"), x["content"], F.lit(IM_END + "\n"))),
        "",
    )
    if open_ended is not None:
        closing = "\n" + IM_END + "\n"
        cut = text.substr(F.lit(1), F.length(text) - F.lit(len(closing)))
        text = F.when(open_ended & text.endswith(closing), cut).otherwise(text)
    if add_generation_prompt:
        text = F.concat(text, F.lit(IM_START + "assistant\n"))
        text = F.when(text.endswith(GENERATION_SUFFIX), text).otherwise(F.concat(text, F.lit(GENERATION_SUFFIX)))
    return text


def topic_prompts(problem: Column | str, max_chars: int | None = None) -> Column:
    """Classifier request: topic system prompt + user prompt with the problem.

    ``max_chars`` cuts the problem for a model with a short input; the whole text is the default.
    """
    p = col_(problem)
    shown = p if max_chars is None else F.substring(p, 1, max_chars)
    user = F.replace(F.lit(TOPIC_USER_PROMPT), F.lit("{problem}"), shown)
    return F.array(_msg("system", F.lit(TOPIC_SYSTEM_PROMPT)), _msg("user", user))
