"""Public tokenizers inside tasks, and cutting long texts where tokens cannot cross.

Each worker process builds an encoder once. Vocabulary files are named by path; they have to be
readable at the same path on every executor.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

CHUNK = 1 << 16        # characters after which a long text is cut at the next safe place
MEMO_WORDS = 1 << 20   # words whose ids a worker remembers before it starts anew

# Marks that may join an ASCII letter into one character, which is not the same one for both cases.
JOINING = re.compile(r"[\u0300-\u036f]")
KNOWN_LETTERS = 0x530  # code points below are letters or not in every version of Unicode alike

# A space after a visible character and before another one: every match of the pattern that covers
# such a space starts with it, because only runs of white space have a space inside.
SAFE = re.compile(r"(?<=\S)(?= \S)")


@cache
def byte_bpe(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, chunk: int = CHUNK) -> list[str]:
    """``text`` in parts of about ``chunk`` characters that can be encoded one by one."""
    parts, at = [], 0
    while len(text) - at > chunk:
        cut = SAFE.search(text, at + chunk)
        if cut is None:
            break
        parts.append(text[at:cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts


@cache
def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(others)}


def _letters(text: str) -> bool:
    """Whether ``text`` is letters only, and stays so when it gets lower case."""
    return text.isalpha() and ord(max(text)) < KNOWN_LETTERS and text.lower().isalpha()


class WordIds(dict):
    """Ids of a white-space separated word as little-endian 32-bit bytes, remembered up to a bound.

    Punctuation after a letter starts a token of its own, so a word and its closing punctuation are
    looked up apart; not where lower case ends the word in a mark, which the punctuation would join.
    A word of letters only is one token for the model, which it is handed in the
    spelling that the tokenizer's own normaliser gives it; any other word goes through the whole tokenizer.
    """

    CLOSING = b'.,*#&$%!?;:|"'

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i.to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_ids = added
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        # Texts are parted at special tokens before words are made; in a word their spelling is ordinary text.
        self.tokenizer.encode_special_tokens = True

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(self.CLOSING)
        text = core.decode()
        if len(core) < len(word) and text and _letters(text[-1]):
            ids = self[core] + self[word[len(core):]]
        else:
            ids = b"".join([i.to_bytes(4, "little") for i in self.encode(word.decode())])
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, word: str) -> list[int]:
        if len(word) <= 64 and _letters(word):
            lower = "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
            spelled = lower if lower.isascii() else lower.encode().decode("latin-1").translate(byte_letters())
            return [token.id for token in self.tokenizer.model.tokenize(spelled)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids


@cache
def word_bpe(path: str) -> WordIds:
    return WordIds(path)


def word_ids(text: str, path: str) -> bytes:
    """Ids of ``text``. Its tokenizer takes special tokens out first, as they are spelled; it lowers case, drops
    white space and never joins across either, so words are encoded one by one, most of them from memory."""
    words, out = word_bpe(path), []
    for i, part in enumerate(words.special.split(text) if words.special else [text]):
        if i % 2:
            out.append(words.special_ids[part])
            continue
        data = part.encode()
        if part.isascii() or not JOINING.search(part):
            data = data.lower()
        out += [words[w] for w in data.split()]
    return b"".join(out)
