"""A transformer token encoder in numpy, from a local weight file: rotary self-attention, post-norm layers, a projection.

Weights are a .npz file's arrays, by the names in `names`; the numbers of heads, layers and sizes follow from their shapes
but for the heads. Texts of a batch are padded to the longest and masked, so a text's rows don't depend on its batch.
"""

from __future__ import annotations

import math

import numpy as np

from .encoder import MARKERS, MAX_ROWS, Kind, TokenEncoder

#: What is added to the scores of masked places, the norm's epsilon, the base of rotary angles.
MASKED, EPSILON, BASE = -1e9, 1e-5, 10_000.0


def names(layers: int) -> list[str]:
    """The arrays of a model of so many layers; matrices are (out, in)."""
    norm = lambda x: [f"{x}.weight", f"{x}.bias"]
    out = ["embeddings.word_embeddings.weight", "embeddings.token_type_embeddings.weight", *norm("emb_ln"), "linear.weight"]
    for i in range(layers):
        for part in ("mixer.Wqkv", "mixer.out_proj", "norm1", "mlp.fc1", "mlp.fc2", "norm2"):
            out += norm(f"encoder.layers.{i}.{part}")
    return out


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x**2).mean(-1, keepdims=True) + EPSILON) * weight + bias


def gelu(x: np.ndarray) -> np.ndarray:
    """By the tanh approximation."""
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def rotated(x: np.ndarray, base: float = BASE) -> np.ndarray:
    """x (batch, places, heads, size): each place turns the pairs (k, k + size / 2) by place * base^(-2k / size)."""
    half = x.shape[-1] // 2
    angle = np.arange(x.shape[1])[:, None] * base ** (-2.0 * np.arange(half) / x.shape[-1])
    cos, sin = np.cos(angle)[None, :, None], np.sin(angle)[None, :, None]
    low, high = x[..., :half], x[..., half:]
    return np.concatenate([low * cos - high * sin, high * cos + low * sin], -1)


def attention(x: np.ndarray, mask: np.ndarray, heads: int, qkv: tuple, out: tuple, base: float = BASE) -> np.ndarray:
    """Self-attention of (batch, places, width), with one matrix for queries, keys and values; mask (batch, places) is 1 for what may be looked at."""
    n, places, width = x.shape
    q, k, v = np.split(x @ qkv[0].T + qkv[1], 3, -1)
    split = lambda y: y.reshape(n, places, heads, width // heads)
    q, k = rotated(split(q), base), rotated(split(k), base)
    score = np.einsum("bihd,bjhd->bhij", q, k) / math.sqrt(width // heads) + ((1 - mask) * MASKED)[:, None, None]
    weight = np.exp(score - score.max(-1, keepdims=True))
    weight /= weight.sum(-1, keepdims=True)
    return np.einsum("bhij,bjhd->bihd", weight, split(v)).reshape(n, places, width) @ out[0].T + out[1]


class TransformerEncoder(TokenEncoder):
    """Rows of a text: its tokens with the kind's marker after the first, at most MAX_ROWS, each projected and of length 1."""

    def __init__(self, weights: str, tokenizer: str, heads: int, markers: dict[str, int] | None = None) -> None:
        self.weights, self.tokenizer, self.heads, self.markers = weights, tokenizer, heads, markers or MARKERS
        with np.load(weights) as w:
            self.dim = len(w["linear.weight"])

    def _loaded(self) -> tuple:
        """Weights and tokenizer, once per worker."""
        if "_model" not in self.__dict__:
            from tokenizers import Tokenizer

            with np.load(self.weights) as w:
                layers = 1 + max((int(k.split(".")[2]) for k in w.files if k.startswith("encoder.layers.")), default=-1)
                if missing := [k for k in names(layers) if k not in w.files]:
                    raise ValueError(f"{self.weights} has no {', '.join(missing)}")
                self._model = {k: w[k].astype(np.float64) for k in w.files}, layers, Tokenizer.from_file(self.tokenizer)
        return self._model

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_model"}

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(batch, places, dim) of token ids; rows aren't normalised yet."""
        w, layers, _ = self._loaded()
        pair = lambda name: (w[f"{name}.weight"], w[f"{name}.bias"])
        x = layer_norm(w["embeddings.word_embeddings.weight"][ids] + w["embeddings.token_type_embeddings.weight"][0], *pair("emb_ln"))
        for i in range(layers):
            at = f"encoder.layers.{i}"
            x = layer_norm(x + attention(x, mask, self.heads, pair(f"{at}.mixer.Wqkv"), pair(f"{at}.mixer.out_proj")), *pair(f"{at}.norm1"))
            up, down = pair(f"{at}.mlp.fc1"), pair(f"{at}.mlp.fc2")
            x = layer_norm(x + gelu(x @ up[0].T + up[1]) @ down[0].T + down[1], *pair(f"{at}.norm2"))
        return x @ w["linear.weight"].T

    def encode_batch(self, texts: list[str], kind: Kind) -> list[np.ndarray]:
        if not texts:
            return []
        _, _, tokenizer = self._loaded()
        every = [tokenizer.encode(t).ids[: MAX_ROWS - 1] for t in texts]
        every = [[*ids[:1], self.markers[kind], *ids[1:]] for ids in every]
        ids = np.zeros((len(every), max(map(len, every))), np.int64)
        mask = np.zeros(ids.shape)
        for i, row in enumerate(every):
            ids[i, : len(row)], mask[i, : len(row)] = row, 1
        rows = self.forward(ids, mask)
        rows = rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)
        return [m[: len(row)] for m, row in zip(rows, every, strict=True)]

    def encode(self, text: str, kind: Kind) -> np.ndarray:
        return self.encode_batch([text], kind)[0]
