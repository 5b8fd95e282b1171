"""Prompts, model routing and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as t, vocab as v


def _pick(level: Column, values: dict[int, str]) -> Column:
    out = F.lit("")
    for n, x in values.items():
        out = F.when(level == n, F.lit(x)).otherwise(out)
    return out


def level_name(level: Column) -> Column:
    return _pick(level, v.LEVELS)


def _verbs(level: Column, n: int) -> Column:
    return _pick(level, {k: ", ".join(x[:n]) for k, x in v.VERBS.items()})


def standard(text: Column, level: Column) -> Column:
    return t.message(v.STANDARD_PROMPT, text=text, name=level_name(level), definition=_pick(level, v.DEFINITIONS), hints=_pick(level, v.HINTS))


def adversarial(text: Column, level: Column, vocab_level: Column) -> Column:
    return t.message(
        v.ADVERSARIAL_PROMPT, text=text, name=level_name(level), other=level_name(vocab_level), definition=_pick(level, v.DEFINITIONS),
        eight=_verbs(vocab_level, 8), avoided=_verbs(level, 6), six=_verbs(vocab_level, 6), hints=_pick(level, v.HINTS),
    )


def backend(model: Column) -> Column:
    """The configured backend of a known model; anthropic has no adapter and goes to ollama, as does every unknown name."""
    out = F.lit("ollama")
    for name, kind, _, _ in v.MODELS:
        if kind in ("openai", "google", "together"):
            out = F.when(model == name, F.lit(kind)).otherwise(out)
    return F.when(model.startswith("gemini-"), F.lit("google")).otherwise(out)


def safe_name(model: Column) -> Column:
    return F.translate(model, ":./", "___")


def display_name(model: Column) -> Column:
    """struct(name, params): of a model's own or safe name; unknown ones show as they are."""
    out = F.struct(model.alias("name"), F.lit("?").alias("params"))
    for name, _, shown, size in v.MODELS:
        out = F.when(model.isin(name, name.translate(str.maketrans(":./", "___"))), F.struct(F.lit(shown).alias("name"), F.lit(size).alias("params"))).otherwise(out)
    return out
