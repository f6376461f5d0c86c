"""Answers with citations, as a stream of events. The generator is a protocol; the built-in one quotes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Any, Protocol

from ..errors import EmbeddingError, GenerationError, HarrowError, IndexError_


# The names of the events below and of their fields are the wire contract.


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Citation:
    source_index: int
    chunk_id: str
    cited_text: str


@dataclass(frozen=True)
class Complete:
    stop_reason: str
    model: str
    input_tokens: int
    output_tokens: int
    refused: bool = False


Event = Text | Citation | Complete


class Answerer(Protocol):
    """Answers a question from sources, piece by piece; a ``Complete`` is its last event."""

    def stream(self, question: str, sources: Sequence[dict[str, Any]]) -> Iterator[Event]: ...


class Extractive:
    """Quotes the sentence of each source that shares most words with the question."""

    model = "extractive"

    def __init__(self, sentences: int = 3):
        self.sentences = sentences

    def stream(self, question: str, sources: Sequence[dict[str, Any]]) -> Iterator[Event]:
        asked = set(re.findall(r"\w+", question.lower()))
        out = 0
        for i, s in enumerate(sources[: self.sentences]):
            pieces = [p for p in re.split(r"(?<=[.!?])\s+|\n", s["text"]) if p.strip()]
            if not pieces:
                continue
            best = max(pieces, key=lambda p: (len(asked & set(re.findall(r"\w+", p.lower()))), -len(p)))
            out += len(best.split())
            yield Text(best.strip() + " ")
            yield Citation(i, str(s.get("chunk_id", s.get("doc_id"))), best)
        yield Complete("end_turn", self.model, sum(len(s["text"].split()) for s in sources), out, refused=not sources)


def checked(events: Iterable[Event], sources: Sequence[dict[str, Any]], dropped: list[Citation] | None = None) -> Iterator[Event]:
    """Citations of sources that don't exist are left out."""
    for e in events:
        if isinstance(e, Citation) and not 0 <= e.source_index < len(sources):
            if dropped is not None:
                dropped.append(e)
            continue
        yield e


def sse(event: str, data: dict[str, Any]) -> str:
    return f"event: {event}\ndata: {json.dumps(data)}\n\n"


def answer_events(question: str, sources: Sequence[dict[str, Any]], generator: Answerer, request_id: str | None = None) -> Iterator[str]:
    """``sources``, then ``text`` and ``citation``, then exactly one of ``done`` and ``error``."""
    yield sse("sources", {"request_id": request_id or uuid.uuid4().hex, "results": list(sources)})
    try:
        for e in checked(generator.stream(question, sources), sources):
            if isinstance(e, Complete):
                yield sse("done", asdict(e))
                return
            yield sse(type(e).__name__.lower(), asdict(e))
        raise GenerationError("the generator ended without a completion")
    except HarrowError as failed:
        yield sse("error", problem(failed))


def problem(error: HarrowError) -> dict[str, Any]:
    """An error as a problem document; its status says whose fault it is."""
    status = 502 if isinstance(error, EmbeddingError | GenerationError) else 503 if isinstance(error, IndexError_) else 500
    return {"type": "about:blank", "title": type(error).__name__, "status": status, "detail": str(error)}
