"""The public models that can be used, and where their files lie."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from loamdex.errors import ModelError


@dataclass(frozen=True)
class ModelSpec:
    name: str
    repo: str
    dimensions: int
    max_tokens: int
    query_prefix: str = ""
    document_prefix: str = ""
    pooling: str = "mean"
    nested_dimensions: tuple[int, ...] = ()
    kind: str = "text"


# Published models and their properties.
MODELS = {
    m.name: m
    for m in (
        ModelSpec("nomic-embed-text-v1.5", "nomic-ai/nomic-embed-text-v1.5", 768, 8192, "search_query: ", "search_document: ", "mean", (768, 512, 256, 128, 64)),
        ModelSpec("nomic-embed-text-v2", "nomic-ai/nomic-embed-text-v1.5", 768, 8192, "search_query: ", "search_document: ", "mean", (768, 512, 256, 128)),
        ModelSpec("bge-m3", "BAAI/bge-m3", 1024, 8192, "", "", "cls"),
        ModelSpec("nomic-embed-vision-v1.5", "nomic-ai/nomic-embed-vision-v1.5", 768, 0, kind="vision"),
    )
}
#: What a query is given before it is embedded; documents are embedded as they are.
QUERY_PREFIX = "search_query: "
QUANTISED = {"fp32": "model.onnx", "fp16": "model_fp16.onnx", "int8": "model_int8.onnx"}


def get_model(name: str) -> ModelSpec:
    if name not in MODELS:
        raise ModelError(f"no model {name!r}; there are {', '.join(MODELS)}")
    return MODELS[name]


def model_file(quantisation: str = "fp32") -> str:
    """The file name of a quantisation; an unknown one is the full model."""
    return QUANTISED.get(quantisation, QUANTISED["fp32"])


def batch_size(dimensions: int, memory_mb: int) -> int:
    """Texts a batch: a quarter of the memory at 8 KB and 4 bytes a dimension each, 8 to 256."""
    each = 8192 + 4 * dimensions
    return max(8, min(256, memory_mb * 1024 * 1024 // 4 // each))


class ModelManager:
    """Models in a local folder. Nothing is downloaded."""

    def __init__(self, folder: str | os.PathLike):
        self.folder = Path(folder)

    def path(self, name: str, quantisation: str = "fp32") -> Path:
        return self.folder / get_model(name).name / model_file(quantisation)

    def available(self) -> list[str]:
        return [m for m in MODELS if any(self.path(m, q).is_file() for q in QUANTISED)]

    def ensure(self, name: str, quantisation: str = "fp32") -> Path:
        """The model's file; an error that says where it must be put if it isn't there, or is empty."""
        path = self.path(name, quantisation)
        if not path.is_file() or not path.stat().st_size:
            raise ModelError(f"put {get_model(name).repo}'s {path.name} and tokenizer.json into {path.parent}")
        return path
