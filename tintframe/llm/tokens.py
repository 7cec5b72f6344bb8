"""Token ids of a public byte-level BPE vocabulary, in Arrow batches. Vocabularies are read from a path, never copied."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: tiktoken backtracks over runs of white space and panics at about 1,000,000 characters; texts with a run of this length go to ``tokenizers``.
LONG_RUN = 100_000
_LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def byte_level_ids(path: str):
    """text -> ids (an array of uint32) of a byte-level ``tokenizers`` file with its default pattern, by tiktoken over the same merges.

    tiktoken merges the pair of least rank first; a byte-level BPE file lists its merges so that a merged token's id follows its
    merge, which makes both equal (the tests hold them against each other) at a quarter of the CPU time. Added tokens
    written out in a text get their ids, as ``tokenizers`` does by default. Texts with a run of ``LONG_RUN`` white-space characters
    are encoded by ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    @functools.cache
    def library():
        return Tokenizer.from_file(path)

    def exact(text):
        return np.array(library().encode(text, add_special_tokens=False).ids, dtype="<u4")

    spec = json.load(open(path))
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] != {
        "type": "ByteLevel",
        "add_prefix_space": False,
        "trim_offsets": True,
        "use_regex": True,
    }:
        return exact
    byte_of = byte_alphabet()
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    enc = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text):
        if len(text) >= LONG_RUN and _LONG_RUN.search(text):
            return exact(text)
        return enc.encode_to_numpy(text, allowed_special="all")

    return encode


def byte_level_encoder(path: str):
    """text -> list of ids; see ``byte_level_ids``."""
    ids = byte_level_ids(path)
    return lambda text: ids(text).tolist()


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
