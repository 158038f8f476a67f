"""Optional model backends. Their packages are imported when a model is first asked, in the process that asks it; keys come
from the environment, as those packages read them, and never from the settings."""

from __future__ import annotations

import importlib
from collections.abc import Sequence
from types import ModuleType
from typing import Any

import numpy as np

from graphloom.errors import AnalysisError, MissingBackend

#: How often a hosted model is asked again after a passing failure.
RETRIES = 2


def _package(name: str) -> ModuleType:
    try:
        return importlib.import_module(name)
    except ImportError as error:
        raise MissingBackend(f"this backend needs the package {name!r}, which is not installed") from error


class LocalEmbedder:
    """Texts to vectors by a model that runs where its caller runs; workers load it once each."""

    def __init__(self, model: str):
        self.model, self.model_name = model, f"fastembed/{model}"
        self._loaded: Any = None

    def __getstate__(self) -> dict[str, Any]:
        return {**self.__dict__, "_loaded": None}

    def embed_texts(self, texts: Sequence[str]) -> list[np.ndarray]:
        if self._loaded is None:
            self._loaded = _package("fastembed").TextEmbedding(model_name=self.model)
        return [np.asarray(v, float) for v in self._loaded.embed(list(texts))]


class HostedEmbedder:
    """Texts to vectors by a hosted model, a request a batch."""

    def __init__(self, model: str, batch: int = 64):
        self.model, self.model_name, self.batch = model, f"api/{model}", batch

    def embed_texts(self, texts: Sequence[str]) -> list[np.ndarray]:
        ask, found = _package("litellm").embedding, []
        for at in range(0, len(texts), self.batch):
            part = list(texts[at : at + self.batch])
            rows = [r["embedding"] for r in ask(model=self.model, input=part, num_retries=RETRIES).data]
            if len(rows) != len(part):
                raise AnalysisError(f"{self.model} gave {len(rows)} vectors for {len(part)} texts")
            found += [np.asarray(v, float) for v in rows]
        return found


class HostedModel:
    """A text model that answers prompts."""

    def __init__(self, model: str, timeout: int = 60):
        self.model, self.timeout = model, timeout

    def complete(self, *, system: str, user: str) -> str:
        said = [{"role": role, "content": text} for role, text in (("system", system), ("user", user))]
        answer = _package("litellm").completion(model=self.model, messages=said, timeout=self.timeout, num_retries=RETRIES)
        text = answer.choices[0].message.content
        if not (text or "").strip():
            raise AnalysisError(f"{self.model} gave an empty answer")
        return text
