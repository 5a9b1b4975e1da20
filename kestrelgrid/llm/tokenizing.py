"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from functools import lru_cache
from pathlib import Path

#: Where the public vocabulary files lie unless a caller names another folder.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the byte-level vocabularies cut texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_multi_50k"):
    """The byte-level tokenizer ``name`` of the folder; its own pattern where the folder is the installed package."""
    import tiktoken

    pattern = PATTERN
    if (init := Path(folder, "__init__.py")).exists():
        spec = importlib.util.spec_from_file_location("tokenizer_files", init)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        pattern = getattr(module, "PATTERN", PATTERN)
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], folder: str = TOKENIZERS, name: str = "byte_bpe_multi_50k") -> list[int]:
    """Tokens of each text; 0 for NULL."""
    own = encoding(folder, name)
    return [len(own.encode_ordinary(text)) if text else 0 for text in texts]
