"""Where tokenizer vocabularies lie: a parameter of the operators, with the installed public files as its default."""

from __future__ import annotations


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
