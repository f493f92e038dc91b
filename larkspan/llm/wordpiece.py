"""Token ids of a word-end BPE file, word by word: each batch encodes its distinct words once.

The file's tokenizer lower-cases, drops white space and ends each word with a mark, so that no token spans white space
and a text's ids are its words' ids in turn. Words of Latin letters, digits and common signs go through a rank-based
encoder built from the same merges; all others (other scripts, combining marks, controls, special tokens, very long
runs) go through the tokenizer itself. Both give the ids that the tokenizer gives for the whole text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ends a word in the ranks; words that contain it are not fast words.
END = "\x02"
#: Characters whose lower case, normal form and class agree in both encoders.
FAST = re.compile(r"[\x21-\x7e\xa1-įı-ɏ]{1,200}")
#: Fixed pattern of the tokenizer file, for those characters, and the line feed that separates words here.
PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of = _byte_of_char()

        def raw(token: str) -> bytes:
            word_end = token.endswith("</w>")
            return bytes(byte_of[c] for c in (token[:-4] if word_end else token)) + END.encode() * word_end

        singles = [bytes([b]) for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        order = singles + [b + END.encode() for b in singles] + [raw(a) + raw(b) for a, b in pairs]
        ids = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        self.id_of_rank = np.array([ids.get(x, 0) for x in order], np.uint32)
        self.line_rank = order.index(b"\n" + END.encode())
        self.ranks = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks={x: i for i, x in enumerate(order)}, special_tokens={})

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's start and length in it."""
        fast = np.array([bool(FAST.fullmatch(w)) and "<|" not in w for w in words], bool)
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts = []
        if fast.any():
            text = "\n".join(w for w, ok in zip(words, fast, strict=True) if ok).lower() + "\n"
            ranks = np.asarray(self.ranks.encode_ordinary(END.join(PIECES.findall(text)) + END), np.int64)
            ends = np.flatnonzero(ranks == self.line_rank)
            starts[fast] = np.concatenate(([0], ends[:-1] + 1))
            lengths[fast] = ends - starts[fast]
            parts.append(self.id_of_rank[ranks])
        at = len(parts[0]) if parts else 0
        slow = [i for i in np.flatnonzero(~fast) if words[i]]
        for i, found in zip(slow, self.whole.encode_batch([words[i] for i in slow], add_special_tokens=False) if slow else [], strict=True):
            ids = np.array(found.ids, np.uint32)
            starts[i], lengths[i] = at, len(ids)
            parts.append(ids)
            at += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), starts, lengths

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the texts in it (one more than there are texts)."""
        lists = pc.ascii_split_whitespace(texts)
        per_text = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        flat, starts, lengths = self.words(coded.dictionary.to_pylist())
        each = lengths[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(total)]
        words_before = np.concatenate(([0], np.cumsum(per_text)))
        return ids, np.concatenate(([0], ends))[words_before]


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    """The tokenizer of a file, once in each Python worker."""
    return WordTokenizer(path)
