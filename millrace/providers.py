"""Models behind names: embedders and chat models. The two that are built in need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from millrace.errors import ProviderFailure


@dataclass(frozen=True)
class Usage:
    prompt: int = 0
    completion: int = 0


@dataclass(frozen=True)
class Message:
    role: str
    content: str
    tool_call_id: str | None = None
    name: str | None = None


#: The name of messages that hold a retrieved block each.
BLOCK = "context"


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, Any]


@dataclass(frozen=True)
class Call:
    id: str
    name: str
    arguments: dict[str, Any]


@dataclass(frozen=True)
class Reply:
    """A chat model's turn; also one piece of a streamed turn."""

    content: str = ""
    tool_calls: tuple[Call, ...] = ()
    usage: Usage | None = None
    finish_reason: str | None = None


class Embedder(Protocol):
    """Texts to vectors. It must be picklable: tasks on executors call it."""

    dimension: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def chat(self, messages: list[Message], tools: list[Tool]) -> Reply: ...

    def stream(self, messages: list[Message], tools: list[Tool]) -> Iterator[Reply]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed counts of words in hashed places, of unit length."""

    dimension: int = 768

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
            row /= np.sqrt((row * row).sum()) or 1.0
        return out.tolist()


@dataclass
class ScriptedChat:
    """Gives prepared replies in turn; the last one again and again."""

    replies: list[Reply]
    asked: list[list[Message]] = field(default_factory=list)

    def chat(self, messages: list[Message], tools: list[Tool]) -> Reply:
        self.asked.append(list(messages))
        return self.replies[min(len(self.asked), len(self.replies)) - 1]

    def stream(self, messages: list[Message], tools: list[Tool]) -> Iterator[Reply]:
        reply = self.chat(messages, tools)
        for word in re.findall(r"\s*\S+", reply.content):
            yield Reply(content=word)
        yield Reply(tool_calls=reply.tool_calls, usage=reply.usage, finish_reason=reply.finish_reason)


class ExtractChat(ScriptedChat):
    """Answers with the first retrieved block, which comes as a message of its own."""

    def __init__(self):
        super().__init__([Reply()])

    def chat(self, messages: list[Message], tools: list[Tool]) -> Reply:
        block = next((m.content for m in messages if m.name == BLOCK), "")
        return Reply(block, usage=Usage(sum(len(m.content.split()) for m in messages), len(block.split())), finish_reason="stop")


_EMBEDDERS: dict[str, Callable[..., Embedder]] = {}
_CHATS: dict[str, Callable[..., ChatModel]] = {}


def _named(name: str) -> str:
    if not name or not name.strip():
        raise ProviderFailure("a provider needs a name")
    return name.strip().lower()


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    _EMBEDDERS[_named(name)] = factory


def register_chat(name: str, factory: Callable[..., ChatModel]) -> None:
    _CHATS[_named(name)] = factory


@contextmanager
def _making(name: str) -> Iterator[None]:
    """Whatever a factory raises comes out as a ``ProviderFailure``."""
    try:
        yield
    except Exception as error:
        raise error if isinstance(error, ProviderFailure) else ProviderFailure("a provider can't be made", {"name": name, "error": str(error)}) from error


def _make(known: dict[str, Callable], name: str, **options: Any):
    with _making(name):
        if (own := _named(name)) not in known:
            raise ProviderFailure("no such provider", {"name": name, "known": sorted(known)})
        return known[own](**options)


def embedder(name: str, **options: Any) -> Embedder:
    return _make(_EMBEDDERS, name, **options)


def chat_model(name: str, **options: Any) -> ChatModel:
    return _make(_CHATS, name, **options)


def embedders() -> list[str]:
    return sorted(_EMBEDDERS)


def chat_models() -> list[str]:
    return sorted(_CHATS)


register_embedder("hashing", HashingEmbedder)
register_chat("extract", ExtractChat)


def embedded(rows: DataFrame, embed: Embedder, text: str = "content", batch: int = 32) -> DataFrame:
    """Adds vector (array<float>). A wrong number or length of vectors fails the task."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(part), batch):
                texts = part[text].iloc[at : at + batch].tolist()
                found = embed(texts)
                if len(found) != len(texts):
                    raise ProviderFailure("as many vectors as texts are needed", {"texts": len(texts), "vectors": len(found)})
                if any(len(v) != embed.dimension for v in found):
                    raise ProviderFailure("vectors of another dimension", {"dimension": embed.dimension})
                vectors += found
            yield part.assign(vector=vectors)

    return rows.mapInPandas(run, schema)
