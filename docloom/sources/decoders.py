"""Libraries and services that aren't part of this project, imported where they run: PDF rendering and text recognition (SRC4, ING6, SRC10), hosted models (SRC8, SRC9)."""

from __future__ import annotations

import importlib
import importlib.util
import os
import shutil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..config import api_key
from ..operators import images


def pack_image(img: np.ndarray) -> bytes:
    """Rows, columns and channels (1 or 3) as 32-bit numbers, then the pixels."""
    h, w, c = (*img.shape, 1)[:3]
    return np.array([h, w, c], "<u4").tobytes() + np.ascontiguousarray(img, np.uint8).tobytes()


def unpack_image(raw: bytes) -> np.ndarray:
    h, w, c = (int(x) for x in np.frombuffer(raw, "<u4", 3))
    img = np.frombuffer(raw, np.uint8, h * w * c, 12)
    return img.reshape(h, w) if c == 1 else img.reshape(h, w, c)


class OcrDecoder:
    """A PageDecoder by PyMuPDF and Tesseract, which must be installed on the executors; image steps are this project's."""

    def __init__(self, preparation: dict | None = None):
        self.preparation = preparation or {}

    def pages(self, content: bytes, dpi: int = 300) -> list[bytes]:
        fitz = importlib.import_module("fitz")
        with fitz.open(stream=content, filetype="pdf") as doc:
            return [pack_image(np.frombuffer(p.samples, np.uint8).reshape(p.height, p.width, -1)[..., :3]) for p in (page.get_pixmap(dpi=dpi) for page in doc)]

    def ruled_share(self, image: bytes) -> float:
        return images.ruled_share(unpack_image(image))

    def text(self, image: bytes, language: str, psm: int) -> str:
        tesseract, pil = importlib.import_module("pytesseract"), importlib.import_module("PIL.Image")
        page = pil.fromarray(images.prepared(unpack_image(image), **self.preparation))
        return tesseract.image_to_string(page, lang=language, config=f"--psm {psm} --oem 3")


def ocr_resources(spark: SparkSession, languages: tuple[str, ...] = ("eng", "ind"), tasks: int | None = None) -> DataFrame:
    """SRC10: (host, what, found) as tasks see it: the recogniser's program, the libraries and the language data below TESSDATA_PREFIX. Nothing is downloaded."""
    n = tasks or spark.sparkContext.defaultParallelism

    def run(batches):
        for _ in batches:
            pass
        data = Path(os.environ.get("TESSDATA_PREFIX", "/usr/share/tesseract-ocr/5/tessdata"))
        rows = [("program tesseract", shutil.which("tesseract") is not None)]
        rows += [(f"library {m}", importlib.util.find_spec(m) is not None) for m in ("fitz", "pytesseract", "PIL")]
        rows += [(f"language {x}", (data / f"{x}.traineddata").is_file()) for x in languages]
        yield pa.RecordBatch.from_arrays(
            [pa.array([os.uname().nodename] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])],
            names=["host", "what", "found"],
        )

    return spark.range(0, n, 1, n).mapInArrow(run, "host string, what string, found boolean").distinct()


class _Hosted:
    def __init__(self, model: str, key: str = "GEMINI_API_KEY"):
        """`key` names the environment variable, on the executors as well, that holds the service's key."""
        self.genai = importlib.import_module("google.genai")
        self.model, self.client = model, self.genai.Client(api_key=api_key(key))


class HostedEmbedder(_Hosted):
    """An Embedder (SRC8) by the google-genai library: one vector for each text of a call."""

    def __init__(self, model: str = "gemini-embedding-001", dimension: int = 3072, key: str = "GEMINI_API_KEY"):
        super().__init__(model, key)
        self.dimension = dimension

    def embed(self, texts: list[str], task: str = "RETRIEVAL_DOCUMENT") -> list[list[float]]:
        t = self.genai.types
        each = [t.Content(parts=[t.Part.from_text(text=x)]) for x in texts]
        got = self.client.models.embed_content(model=self.model, contents=each, config=t.EmbedContentConfig(task_type=task))
        return [list(e.values) for e in got.embeddings]


class HostedGenerator(_Hosted):
    """A Generator (SRC9) by the google-genai library."""

    def __init__(self, model: str = "gemini-2.5-flash", key: str = "GEMINI_API_KEY"):
        super().__init__(model, key)

    def generate(self, prompt: str, temperature: float = 0.2, max_tokens: int = 4096) -> str:
        config = self.genai.types.GenerateContentConfig(temperature=temperature, max_output_tokens=max_tokens)
        return self.client.models.generate_content(model=self.model, contents=prompt, config=config).text
