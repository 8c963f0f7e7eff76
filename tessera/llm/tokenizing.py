"""Loading public tokenizers inside tasks, and encoding whole texts with them."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from pathlib import Path

import numpy as np

#: A blank that is followed by more white space, or ends the text: such texts are cut with a regex.
_UNEVEN = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")

@functools.cache
def tokenizer(path: str):
    """The tokenizers-library tokenizer at ``path``; one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def version_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: another file is another version."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@functools.cache
def cuts_at_blanks(path: str) -> bool:
    """Whether no token of this tokenizer reaches back over a blank before a visible character.

    That holds for byte-level tokenizers without a normalizer: their pre-tokenizer pattern takes
    one blank together with what follows it, whatever stands before.
    """
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    pre = config.get("pre_tokenizer") or {}
    return (
        config.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in config.get("added_tokens", []))
    )


#: The split pattern of tokenizers that drop white space: none of its alternatives holds any.
_DROPS_WHITE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def drops_white_space(path: str) -> bool:
    """Whether texts may be cut at blanks and line ends and counted part by part.

    That holds if the pre-tokenizer keeps only matches of the pattern above, and the normalizer
    composes, squeezes white space and lower-cases single characters: none reaches over a blank.
    """
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    steps = {s["type"] for s in (config.get("normalizer") or {}).get("normalizers", [])}
    first = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        steps <= {"NFC", "Replace", "Lowercase"}
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True)
        and first.get("pattern", {}).get("Regex") == _DROPS_WHITE
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in config.get("added_tokens", []))
    )


class CachedEncoder:
    """Encodes whole texts piece by piece (a piece runs from one blank to the next) and remembers pieces.

    ``max_pieces`` bounds the memory; pieces that come after that are forgotten after their batch.
    """

    #: New pieces go to the library in texts of so many pieces, which costs less than one by one.
    TOGETHER = 2048

    def __init__(self, path: str, max_pieces: int = 700_000):
        self.tokenizer, self.max_pieces, self.exact = tokenizer(path), max_pieces, cuts_at_blanks(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.whole: dict[str, bytes] = {}  # pieces as they are
        self.after_blank: dict[str, bytes] = {}  # pieces without the blank that stands before them
        # Ids of tokens that begin with a blank; the byte-level alphabet writes it so.
        self.begins = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without added special tokens."""
        if not self.exact:
            return self._batch(texts)
        firsts, rests = [], []
        for text in texts:
            if _UNEVEN.search(text):
                firsts.append(_CUT.split(text))
                rests.append([])
            else:
                first, *rest = text.split(" ")
                firsts.append([first])
                rests.append(rest)
        out = [self._joined(a, b) for a, b in zip(firsts, rests)]
        unknown = [k for k, ids in enumerate(out) if ids is None]
        if not unknown:
            return out
        new_whole = list({x for k in unknown for x in firsts[k] if x not in self.whole})
        new_after = list({x for k in unknown for x in rests[k] if x not in self.after_blank})
        self.whole.update(zip(new_whole, self._batch(new_whole)))
        for k in range(0, len(new_after), self.TOGETHER):
            some = new_after[k : k + self.TOGETHER]
            self.after_blank.update(zip(some, self._together(some)))
        for k in unknown:
            out[k] = self._joined(firsts[k], rests[k])
        if len(self.whole) + len(self.after_blank) > self.max_pieces:
            for x in new_whole:
                del self.whole[x]
            for x in new_after:
                del self.after_blank[x]
        return out

    def _joined(self, first: list[str], rest: list[str]) -> bytes | None:
        """The ids of a text's pieces, None where one isn't known yet: looking up is cheaper than gathering a batch's distinct pieces."""
        try:
            return b"".join(map(self.whole.__getitem__, first)) + b"".join(map(self.after_blank.__getitem__, rest))
        except KeyError:
            return None

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without blanks, each after a blank, encoded as one text.

        There a token begins with a blank just where a piece begins. Special tokens, which would take
        the place of a piece's first token, are encoded one by one.
        """
        text = " " + " ".join(pieces)
        if not self.special.search(text):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            cuts = 4 * np.flatnonzero(self.begins[ids])
            if len(cuts) == len(pieces):
                raw, cuts = ids.astype("<u4").tobytes(), cuts.tolist()
                return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]
        return self._batch([" " + x for x in pieces])

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class CachedCounter:
    """Counts the tokens of whole texts, part by part where that is exact, and remembers parts."""

    def __init__(self, path: str, max_parts: int = 700_000):
        self.tokenizer, self.max_parts, self.exact = tokenizer(path), max_parts, drops_white_space(path)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if not self.exact:
            return self._batch(texts)
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*cut) - self.known.keys())
        self.known.update(zip(new, self._batch(new)))
        get = self.known.__getitem__
        out = [sum(map(get, parts)) for parts in cut]
        if len(self.known) > self.max_parts:
            for x in new:
                del self.known[x]
        return out

    def _batch(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def cached_encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


@functools.cache
def cached_counter(path: str) -> CachedCounter:
    return CachedCounter(path)
