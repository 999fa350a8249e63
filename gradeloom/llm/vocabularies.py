"""Where the public tokenizer files are; the path is a parameter of every operator that needs one."""

from __future__ import annotations

import os


def vocabulary(name: str) -> str:
    """The installed file's path, or the one in /opt/tokenizers."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)
