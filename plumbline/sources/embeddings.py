"""Vectors from a provider, in batches that shrink when it finds them too large."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[list[str]], list[list[float]]]


class TooLarge(Exception):
    """A provider raises this for a batch that is over its limit."""


def http_provider(url: str, timeout: float = 60.0) -> Provider:
    """A provider behind POST url/embed with {"inputs": [...]}, which answers with a list of vectors; status 413 means too large."""
    import json
    import urllib.error
    import urllib.request

    def provide(texts: list[str]) -> list[list[float]]:
        request = urllib.request.Request(f"{url.rstrip('/')}/embed", json.dumps({"inputs": texts}).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 413:
                raise TooLarge from e
            raise

    return provide


def http_state(url: str, timeout: float = 5.0) -> tuple[bool, dict]:
    """Whether url/health answers, and what url/info says of the model ({} if nothing)."""
    import json
    import urllib.request

    def get(path: str) -> bytes | None:
        try:
            with urllib.request.urlopen(f"{url.rstrip('/')}/{path}", timeout=timeout) as answer:
                return answer.read()
        except OSError:
            return None

    info = get("info")
    return get("health") is not None, json.loads(info) if info else {}


def embed(texts: list[str], provider: Provider) -> list[list[float] | None]:
    """A vector per text; a batch too large is halved, a single text too large has none, and so has a batch answered in part or with an error."""
    if not texts:
        return []
    try:
        out = provider(texts)
    except TooLarge:
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return embed(texts[:half], provider) + embed(texts[half:], provider)
    except Exception:
        return [None] * len(texts)
    return list(out) if len(out) == len(texts) else [None] * len(texts)


def embed_column(df: DataFrame, key: str, text: str, make: Callable[[], Provider], batch: int = 32) -> DataFrame:
    """key and vector of each text that got one. make builds the provider once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                vectors = embed(part[text].fillna("").tolist(), provider)
                keep = [v is not None for v in vectors]
                yield pd.DataFrame({key: part[key][keep].to_numpy(), "vector": [v for v in vectors if v is not None]})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, vector array<float>")
