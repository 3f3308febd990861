"""Settings (SRC1, SRC11): defaults, overridden by a YAML file; None means "not given", so 0 and 0.0 are kept."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")
    dpi: int = 300
    ocr_lang: str = "ind"
    psm_text: int = 6
    psm_table: int = 6
    psm_mixed: int = 3
    embedding_dimension: int = 3072
    embedding_batch: int = 100
    top_k: int = 5
    min_score: float = 0.6
    collection: str = "academic_docs"
    model: str = "extractive"
    temperature: float = 0.2
    max_tokens: int = 4096
    history_window: int = 6

    def given(self, **values) -> Settings:
        """These settings with the values that aren't None."""
        return replace(self, **{k: v for k, v in values.items() if v is not None})


#: Where each setting stands in the file: section, key.
PLACES = {
    "chunk_size": ("ingestion", "chunk_size"), "chunk_overlap": ("ingestion", "chunk_overlap"), "separators": ("ingestion", "separators"),
    "dpi": ("ocr", "dpi"), "ocr_lang": ("ocr", "tesseract_lang"), "psm_text": ("ocr", "tesseract_psm_text"), "psm_table": ("ocr", "tesseract_psm_table"), "psm_mixed": ("ocr", "tesseract_psm_mixed"),
    "embedding_dimension": ("embedding", "dimension"), "embedding_batch": ("embedding", "batch_size"), "top_k": ("retrieval", "top_k"), "min_score": ("retrieval", "min_score"),
    "collection": ("vector_store", "collection_name"), "model": ("llm", "model"), "temperature": ("llm", "temperature"), "max_tokens": ("llm", "max_tokens"), "history_window": ("chat", "history_window"),
}


def load_config(name: str = "config.yaml", roots: tuple[str, ...] | None = None) -> Settings:
    """The first file of that name in the roots (this project, then the working directory); the defaults if there is none."""
    for root in roots or (str(Path(__file__).resolve().parent.parent), os.getcwd()):
        path = Path(root) / name
        if path.is_file():
            import yaml

            raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
            got = {f: (raw.get(s) or {}).get(k) for f, (s, k) in PLACES.items()}
            if got["separators"] is not None:
                got["separators"] = tuple(got["separators"])
            assert set(got) == {f.name for f in fields(Settings)}
            return Settings().given(**got)
    return Settings()


def api_key(name: str, placeholders: tuple[str, ...] = ("", "your_api_key_here")) -> str:
    """A key from the environment (SRC8, SRC9); missing or placeholder keys are an error."""
    value = os.environ.get(name, "")
    if value in placeholders:
        raise ValueError(f"{name} isn't set")
    return value
