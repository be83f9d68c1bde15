"""Token ids of whole texts, exactly as the tokenizers library gives them, by faster ways."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property

#: Pieces and characters that one encoder remembers before it starts anew.
PIECES, CHARS = 400_000, 16_000_000


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def as_bytes(ids: list[int]) -> bytes:
    """Four bytes for each id, the lowest first."""
    return array("I", ids).tobytes()


class ByteEncoder:
    """Ids of texts for a byte-level vocabulary, as bytes (``as_bytes``).

    Where the merges of the file are in the order of their ids, as ranks are, tiktoken encodes with
    them; texts that hold a special token or an endless word, and other files, take the tokenizers
    library. With ``special=False`` the names of special tokens are text like any other.
    """

    LONG = re.compile(r"\S{1000}|\s{1000}")

    def __init__(self, path: str, special: bool = True):
        self.path, self.keep_special = path, special
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.special = [t["content"] for t in parts["added_tokens"] if special]
        self.fast = self.by_rank(parts)

    @cached_property
    def tokenizer(self):
        """The library's own, which takes memory and is seldom needed."""
        tokenizer = load(self.path)
        tokenizer.encode_special_tokens = not self.keep_special
        return tokenizer

    @staticmethod
    def by_rank(parts: dict):
        model, splits = parts["model"], parts["pre_tokenizer"] or {}
        plain = not parts["normalizer"] and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = {t: i for t, i in model["vocab"].items() if t not in {x["content"] for x in parts["added_tokens"]}}
        if not plain or model.get("ignore_merges") or [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others are moved up
        letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        return [as_bytes(self.ids(t)) for t in texts]

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.LONG.search(text) or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


#: Letters whose neighbours never change how they are encoded, and text of such letters and ASCII signs.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ʯ"
PLAIN = re.compile(rf"[{LETTERS}!-&(-;=-@\[-`{{-~]+")
RUNS = re.compile(rf"[{LETTERS}]+|[^{LETTERS}]+")


class WordEncoder:
    """Ids of texts, as bytes, for vocabularies that drop white space and mark the ends of words.

    Every space and newline is a boundary, so the ids of a text are those of its pieces in between.
    A piece of plain letters and ASCII signs is cut further, where letters begin or end; an
    apostrophe, or what could be part of a special token, rules that out. Pieces and runs repeat;
    each is encoded once and remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.chars = 0

    def learn(self, pieces: list[str]) -> None:
        cut = [RUNS.findall(p) if PLAIN.fullmatch(p) else [p] for p in pieces]
        new = list({r for runs in cut for r in runs if r not in self.runs})
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.runs.update(zip(new, (as_bytes(x.ids) for x in found), strict=True))
        get = self.runs.__getitem__
        self.known.update((p, b"".join(map(get, runs))) for p, runs in zip(pieces, cut, strict=True))
        self.chars += sum(map(len, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > PIECES or self.chars > CHARS:
            self.forget()
        cut = [[p for p in t.replace("\n", " ").split(" ") if p] for t in texts]
        known = self.known
        self.learn(list({p for c in cut for p in c if p not in known}))
        get = known.__getitem__
        return [b"".join(map(get, c)) for c in cut]
