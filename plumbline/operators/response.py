"""Results held to limits of rows, characters and bytes, and queries that may follow."""

from __future__ import annotations

import json
from typing import Any

from .intent import Parsed

#: Rows, characters of snippets, bytes of JSON.
ROWS, SNIPPET_CHARS, JSON_BYTES = 10, 8000, 16384


def compact(rows: list[dict[str, Any]], metadata: dict[str, Any] | None = None, most: int = ROWS, chars: int = SNIPPET_CHARS, size: int = JSON_BYTES) -> str:
    """JSON of the first rows: a signature stands for content, contents share one budget, last rows go until it fits."""
    out, left = [], chars
    for r in rows[:most]:
        r = {k: (round(v, 2) if isinstance(v, float) else v) for k, v in r.items() if v is not None}
        if r.get("signature"):
            r["sig"] = r.pop("signature")
            r.pop("content", None)
        elif "content" in r:
            r["content"] = r["content"][:left]
            left -= len(r["content"])
            if not r["content"]:
                del r["content"]
        r["reasons"] = r.get("reasons", [])[:3]
        out.append(r)
    while True:
        text = json.dumps({"results": out, "total": len(rows), "metadata": metadata or {}}, ensure_ascii=False, separators=(",", ":"))
        if len(text.encode()) <= size or not out:
            return text
        out.pop()


def suggestions(p: Parsed, rows: list[dict[str, Any]], most: int = 3) -> list[str]:
    """Queries this engine understands that follow from what was found, those not asked already, the nearest first."""
    named = [r for r in rows if r.get("symbol_name")]
    if not named:
        return []
    top = named[0]
    name, out = top["symbol_name"], []
    for other in top.get("related") or []:
        out.append(f"locate {other['name']}")
        break
    if not (p.intent == "Relations" and p.incoming):
        out.append(f"callers of {name}")
    if not (p.intent == "Relations" and not p.incoming):
        out.append(f"dependencies of {name}")
    if p.intent != "Similar" and top.get("id"):
        out.append(f"similar:{top['id']}")
    if p.intent != "Documentation":
        out.append(f"explain {name}")
    return out[:most]
