"""Embedders: anything with ``name``, ``dimensions`` and ``embed_batch``."""

from __future__ import annotations

import hashlib
import os
import re
from typing import Protocol

import numpy as np

from loamdex.errors import EmbeddingError

#: Tokens a text is cut to, and texts a batch.
MAX_TOKENS, BATCH = 8192, 32


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """One row of float32 a text."""


class HashingEmbedder:
    """Signed word hashes, at length 1: no model, but the same vector for the same words, anywhere."""

    name = "hashing"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        return unit(out)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(norm > 0, rows / np.where(norm > 0, norm, 1), rows).astype(np.float32)


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of each text's token vectors where its mask is set, at length 1."""
    weight = mask.astype(np.float32)[:, :, None]
    return unit((hidden * weight).sum(1) / np.maximum(weight.sum(1), 1e-9))


class OnnxEmbedder:
    """A text model in a folder with its tokenizer.json, run on the processor."""

    def __init__(self, path: str | os.PathLike, name: str, dimensions: int, pooling: str = "mean"):
        self.path, self.name, self.dimensions, self.pooling = os.fspath(path), name, dimensions, pooling
        self._session = self._tokenizer = None

    def __getstate__(self):
        return self.__dict__ | {"_session": None, "_tokenizer": None}

    def _load(self) -> None:
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            try:
                self._session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
                self._tokenizer = Tokenizer.from_file(os.path.join(os.path.dirname(self.path), "tokenizer.json"))
            except Exception as e:
                raise EmbeddingError(f"can't load {self.path}: {e}") from e
            self._tokenizer.enable_truncation(MAX_TOKENS)
            self._tokenizer.enable_padding()

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        self._load()
        encoded = self._tokenizer.encode_batch(texts)
        mask = np.array([e.attention_mask for e in encoded], np.int64)
        given = {"input_ids": np.array([e.ids for e in encoded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        wanted = {i.name for i in self._session.get_inputs()}
        hidden = self._session.run(None, {k: v for k, v in given.items() if k in wanted})[0]
        if hidden.ndim == 2:
            return unit(hidden)
        return unit(hidden[:, 0]) if self.pooling == "cls" else mean_pooled(hidden, mask)

    def embed_with_dimensions(self, texts: list[str], dimensions: int) -> np.ndarray:
        return unit(self.embed_batch(texts)[:, :dimensions])


class VisionEmbedder:
    """An image model. Images come decoded as arrays (height, width, 3) of 0..255, as no decoder is at hand."""

    # Size, mean and deviation that the public model was trained with.
    SIZE, MEAN, DEVIATION = 224, (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)

    def __init__(self, path: str | os.PathLike, name: str, dimensions: int):
        self.path, self.name, self.dimensions = os.fspath(path), name, dimensions

    def prepare(self, image: np.ndarray) -> np.ndarray:
        """(3, SIZE, SIZE): resampled by windowed sinc of three lobes, scaled and centred."""
        x = image.astype(np.float32)
        for axis in (0, 1):
            x = np.moveaxis(np.tensordot(_lanczos(x.shape[axis], self.SIZE), x, (1, axis)), 0, axis)
        return ((np.clip(x, 0, 255) / 255 - self.MEAN) / self.DEVIATION).transpose(2, 0, 1).astype(np.float32)

    def embed_images(self, images: list[np.ndarray]) -> np.ndarray:
        import onnxruntime

        session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        out = session.run(None, {session.get_inputs()[0].name: np.stack([self.prepare(i) for i in images])})[0]
        return unit(out.reshape(len(images), -1)[:, : self.dimensions])


def _lanczos(n: int, size: int, lobes: int = 3) -> np.ndarray:
    """The weights (size, n) of resampling n pixels to ``size``."""
    scale = max(1.0, n / size)
    centre = (np.arange(size) + 0.5) * n / size - 0.5
    x = (np.arange(n)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0)
    return w / w.sum(1, keepdims=True)
