"""Public tokenizers inside tasks. The vocabulary files stay where they are; their path is a parameter."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os

#: Folder of the vocabulary files, and the default vocabulary (byte-level BPE for many languages).
TOKENIZER_DIR = os.environ.get("LAWLOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCAB = "byte_bpe_multi_50k.tiktoken"

#: A text is tokenized in pieces of at most this many characters, cut at a blank where there is one.
BLOCK_CHARS = 20_000


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level BPE in a .tiktoken file, loaded once per worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("vocabulary_info", os.path.join(os.path.dirname(path), "__init__.py"))
    info = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(info)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=info.PATTERN, mergeable_ranks=ranks, special_tokens={})


def blocks(text: str, size: int = BLOCK_CHARS):
    """Consecutive parts of a text. A part ends before a blank, where the tokenizer's own pattern also ends a word."""
    start = 0
    while len(text) - start > size:
        end = max(text.rfind(" ", start + size // 2, start + size), text.rfind("\n", start + size // 2, start + size))
        end = end if end > start else start + size
        yield text[start:end]
        start = end
    yield text[start:]


def count_tokens(text: str | None, path: str) -> int | None:
    """Tokens of a text; null for null, 0 for the empty text."""
    if text is None:
        return None
    enc = encoding(path)
    return sum(len(enc.encode_ordinary(part)) for part in blocks(text))


def vocab_path(vocab: str = DEFAULT_VOCAB, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, vocab)
