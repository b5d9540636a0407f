"""Parameters of the llm subpackage."""

from __future__ import annotations

import os

#: Folder of the public tokenizers' vocabulary files; set ORGWEAVE_TOKENIZERS to use another.
TOKENIZERS = os.environ.get("ORGWEAVE_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the splitting pattern that belongs to the byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_file(name: str) -> str:
    """The rank file of a byte-level tokenizer."""
    return f"{TOKENIZERS}/{name}.tiktoken"
