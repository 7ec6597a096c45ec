"""Fast exact use of a byte-level BPE vocabulary, inside tasks.

The pattern that cuts a text into pre-tokens never lets one run on over a blank
between two other characters, and BPE never merges across pre-tokens.  So a text
without doubled blanks splits at its blanks into units that encode alone, and a
bounded memo of units does most of the work.  Texts with doubled blanks at
places where that matters, or with special strings, go to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

MEMO = 200_000

# The pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such a vocabulary file, by the public rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_byte_level(path: str) -> bool:
    """Whether the file is a BPE vocabulary whose texts may be cut at blanks as described above."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (spec.get("normalizer") is None and spec.get("post_processor") is None
            and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges"))


#: Units of these letters are cut and merged here; any other goes to the library, whose tables of letters may be newer.
_KNOWN = re.compile("[\t-\r -~\u00a1-\u024f]*").fullmatch


class Memo(dict):
    """Values by unit; units beyond ``MEMO`` are worked out each time."""

    def __init__(self, of):
        super().__init__()
        self._of = of

    def __missing__(self, unit):
        value = self._of(unit)
        if len(self) < MEMO:
            self[unit] = value
        return value


class Units:
    """A text as values of its units; ``of`` gives a unit's value, ``whole`` that of a text the library must see."""

    def __init__(self, of, whole, special: list[str]):
        self._first, self._rest = Memo(of), Memo(lambda unit: of(" " + unit))
        self._whole, self._special = whole, special

    def values(self, text: str) -> list:
        if "  " in text or text[-1:] == " " or text[:1] == " " or any(s in text for s in self._special):
            return [self._whole(text)]
        first, *rest = text.split(" ")
        return [self._first[first], *map(self._rest.__getitem__, rest)] if text else []


def _spec(path: str) -> tuple[dict[bytes, int], list[str]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return ranks, sorted(added)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def id_units(path: str) -> Units:
    """Units whose values are their ids as 16-bit (small vocabularies) or 32-bit words."""
    import tiktoken
    ranks, special = _spec(path)
    merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    code = id_code(path)
    library = lambda t: array(code, tokenizer(path).encode(t, add_special_tokens=False).ids).tobytes()
    return Units(lambda u: array(code, merge(u)).tobytes() if _KNOWN(u) else library(u), library, special)


@lru_cache(maxsize=2)
def id_code(path: str) -> str:
    return "H" if tokenizer(path).get_vocab_size() <= 1 << 16 else "I"


def whole_tokens(path: str) -> frozenset[str]:
    """Proof of the shortcut: the vocabulary strings that are one pre-token and that the library encodes as one token."""
    import regex
    ranks, _ = _spec(path)
    one = regex.compile(PATTERN)
    texts = {}
    for raw, i in ranks.items():
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if one.findall(text) == [text]:
            texts[text] = i
    names = list(texts)
    got = tokenizer(path).encode_batch(names, add_special_tokens=False)
    return frozenset(t for t, e in zip(names, got, strict=True) if e.ids == [texts[t]])


class Counts:
    """Token counts of texts: pre-tokens in ``whole`` are one token, only the rest are merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex
        cut = regex.compile(PATTERN).findall
        library = tokenizer(path)
        merged = Memo(lambda p: len(library.encode(p, add_special_tokens=False).ids))
        _, special = _spec(path)
        full = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        self._units = Units(lambda u: sum(1 if p in whole else merged[p] for p in cut(u)) if _KNOWN(u) else full(u),
                            full, special)

    def of(self, text: str | None) -> int:
        return sum(self._units.values(text)) if text else 0
