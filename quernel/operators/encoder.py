"""Token encoders: text to a matrix of unit rows. The hash encoder keeps shapes, norms and markers; it knows no meaning."""

from __future__ import annotations

import hashlib
import itertools
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stemmer import stem
from ..sources.shared import spread
from .chunking import BATCH_ROWS, Batcher

Kind = Literal["query", "document"]
#: Rows of a text at most, with the start and marker rows; ids of the two markers.
MAX_ROWS, MARKERS = 128, {"query": 250002, "document": 250003}


class TokenEncoder(ABC):
    dim: int

    @abstractmethod
    def encode(self, text: str, kind: Kind) -> np.ndarray:
        """Rows x dim, each row of length 1."""

    def encode_batch(self, texts: list[str], kind: Kind) -> list[np.ndarray]:
        """Of each text what encode gives; an encoder that gains by it overrides this."""
        return [self.encode(t, kind) for t in texts]

    def encode_queries(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_batch(texts, "query")

    def encode_documents(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_batch(texts, "document")

    def each(self, texts: list[str], kind: Kind) -> list[tuple[np.ndarray, str | None]]:
        """A batch's matrices and errors; where the batch fails, each of its texts is tried by itself."""
        try:
            return [(m, None) for m in self.encode_batch(texts, kind)]
        except Exception:  # noqa: BLE001
            out = []
            for t in texts:
                try:
                    out.append((self.encode_batch([t], kind)[0], None))
                except Exception as e:  # noqa: BLE001
                    out.append((np.zeros((0, self.dim)), str(e)))
            return out

    def pack(self, texts: list[str], kind: Kind) -> list[bytes]:
        """Matrices as a store may hold them, in single precision; unpack gives them back."""
        return [np.asarray(m, np.float32).tobytes() for m in self.encode_batch(texts, kind)]

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.float32).reshape(-1, self.dim)

    def packed_table(self, rows: DataFrame, kind: Kind = "document", key: str = "hash", text: str = "formatted") -> DataFrame:
        """(key, num_tokens, packed), as encode_table has them; texts that fail are left out."""
        encoder = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(i, BATCH_ROWS)
                    texts, found = [t or "" for t in part.column(1).to_pylist()], []
                    try:
                        found = encoder.pack(texts, kind)
                    except Exception:  # noqa: BLE001
                        for t in texts:
                            try:
                                found += encoder.pack([t], kind)
                            except Exception:  # noqa: BLE001
                                found.append(None)
                    size = [None if p is None else len(encoder.unpack(p)) for p in found]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int32()), pa.array(found, pa.binary())], ["key", "num_tokens", "packed"])

        rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        return spread(rows).mapInArrow(run, "key string, num_tokens int, packed binary").where("packed is not null").withColumnRenamed("key", key)

    def encode_rows(self, batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
        """(key, num_tokens, embedding, error) of (key, text) batches, by greedy batches: only one's texts and matrices are held beside the input batch."""
        for batch in batches:
            dealer = Batcher()
            dealt = [dealer.next((n or 0) // 4) for n in pc.binary_length(batch.column(1)).to_pylist()]
            cuts = [i for i in range(len(dealt)) if i == 0 or dealt[i] != dealt[i - 1]]
            for i, j in itertools.pairwise([*cuts, len(dealt)]):
                found = self.each([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()], kind)
                size = np.array([len(m) for m, _ in found])
                flat = np.concatenate([m for m, _ in found], dtype=np.float32, casting="same_kind").reshape(-1)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(size.sum() + 1) * self.dim, pa.int32()), pa.array(flat))
                matrices = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int32()), matrices, pa.array([e for _, e in found], pa.string())], ["key", "num_tokens", "embedding", "error"])

    def encode_table(self, rows: DataFrame, kind: Kind = "document", key: str = "hash", text: str = "formatted") -> DataFrame:
        """(key, num_tokens, embedding, error): texts go to the encoder in greedy batches by estimated tokens; a text that fails alone gets an error, not a failed job."""
        encoder = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return encoder.encode_rows(batches, kind)

        rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        return spread(rows).mapInArrow(run, "key string, num_tokens int, embedding array<array<float>>, error string").withColumnRenamed("key", key)


#: Words that a worker's encoder remembers at most, about 25 MB, and their bytes; a longer word is made anew each time.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 100


class Known(dict):
    """An encoder's bytes of the words met, emptied when REMEMBERED are held."""

    def __init__(self, encoder: HashEncoder) -> None:
        self.code, self.stem = encoder.code, stem.__wrapped__ if encoder.stemmed else str

    def __missing__(self, word: str) -> bytes:
        code = self.code(self.stem(word))
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = code
        return code


class HashEncoder(TokenEncoder):
    """Each token's row (stemmed, if wanted) comes from SHA-256 of the token; start and marker rows from their names.

    Words are remembered, and matrices packed, as the bytes that a row is made of: an eighth of the row in double precision."""

    def __init__(self, dim: int = 128, stemmed: bool = True) -> None:
        self.dim, self.stemmed = dim, stemmed
        self.known = Known(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.known = Known(self)

    def code(self, name: str) -> bytes:
        data = name.encode()
        return b"".join([hashlib.sha256(b"%d:%b" % (k, data)).digest() for k in range(-(-self.dim // 32))])[: self.dim]

    def pack(self, texts: list[str], kind: Kind) -> list[bytes]:
        first, known = self.code("[CLS]") + self.code(f"[{MARKERS[kind]}]"), self.known
        return [first + b"".join([known[w] for w in T.code_words(t)[: MAX_ROWS - 2]]) for t in texts]

    def unpack(self, data: bytes) -> np.ndarray:
        v = np.frombuffer(data, np.uint8).reshape(-1, self.dim) - 127.5
        v /= np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]  # the sums are exact
        return v

    def encode(self, text: str, kind: Kind) -> np.ndarray:
        return self.unpack(self.pack([text], kind)[0])


class OnnxEncoder(TokenEncoder):
    """A local ONNX model with a tokenizer file; both are loaded once per worker."""

    def __init__(self, model: str, tokenizer: str, dim: int = 128, providers: tuple[str, ...] = ("CPUExecutionProvider",)) -> None:
        self.model, self.tokenizer, self.dim, self.providers = model, tokenizer, dim, providers

    def _loaded(self) -> tuple:
        if "_session" not in self.__dict__:
            import onnxruntime
            from tokenizers import Tokenizer

            self._session = onnxruntime.InferenceSession(self.model, providers=list(self.providers)), Tokenizer.from_file(self.tokenizer)
        return self._session

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_session"}

    def encode(self, text: str, kind: Kind) -> np.ndarray:
        session, tokenizer = self._loaded()
        ids = tokenizer.encode(text).ids[: MAX_ROWS - 1]
        ids = [ids[0], MARKERS[kind], *ids[1:]] if ids else [MARKERS[kind]]
        feed = {"input_ids": np.array([ids], np.int64), "attention_mask": np.ones((1, len(ids)), np.int64)}
        out = session.run(None, {i.name: feed[i.name] for i in session.get_inputs() if i.name in feed})[0][0].astype(np.float64)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
