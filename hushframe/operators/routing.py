"""Which provider a request goes to, and whether its body is masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.operators.sessions import trimmed

# The paths whose bodies are masked, and their providers.
PATHS = {"/v1/messages": "anthropic", "/v1/chat/completions": "openai"}


def path_of(url: Column) -> Column:
    return F.coalesce(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/"))


def provider(url: Column, wished: Column) -> Column:
    """By path where it is known, else as the ``x-provider`` header wishes, else the first one."""
    path, wish = path_of(url), F.lower(trimmed(wished))
    out = F.when(wish == "openai", "openai").otherwise("anthropic")
    for known, name in PATHS.items():
        out = F.when(path == known, name).otherwise(out)
    return out


def is_filtered(method: Column, url: Column) -> Column:
    return F.coalesce((method == "POST") & path_of(url).isin(list(PATHS)), F.lit(False))
