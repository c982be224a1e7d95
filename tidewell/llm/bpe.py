"""Byte-level BPE by a tokenization automaton.

The merges are compiled, one merge gadget after the other, into a deterministic automaton over tokens
that accepts exactly the token sequences BPE produces. For a merge (a, b) -> c at step k:

* the state reached by ``a`` is copied without its arc ``b`` and all arcs ``a`` move to the copy,
* every state with an arc ``a`` gets an arc ``c`` to the state that ``b`` led to.

All arcs with one label lead to one state and a copy differs from its parent by one removed arc, so the
automaton of 50,000 merges is six integer tables instead of a transition matrix. A pre-split word has
exactly one accepted path; encoding follows it through the tables, decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters only are split by the faster pattern; both give the same pieces.
_UNUSUAL = re.compile(f"[^\\t-\\r -~{_LETTERS[6:]}]")
_PLAIN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\t-\\r {_LETTERS}0-9]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+"
).findall
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_FULL = regex.compile(
    f"'(?:[stmd]|re|ve|ll)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_WS}\\p{{L}}\\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
).findall


def pre_split(text: str) -> list[str]:
    """The pieces that byte-level pre-tokenization makes of a text; they join to the text again."""
    return _FULL(text) if _UNUSUAL.search(text) else _PLAIN(text)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """Tables of the compiled automaton; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], special: dict[str, int] | None = None):
        letters = byte_letters()
        size = max([*vocab.values(), *(special or {}).values()]) + 1
        self.special = dict(special or {})
        self.label: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.label[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.label[i] = token.encode()
        self.left, self.born = [-1] * size, [0] * size
        self.parent, self.removed, self.made = [0], [-1], [0]  # by state
        self.state = [0] * size  # the state that arcs with this label lead to
        known = {bytes([b]): vocab[c] for c, b in letters.items() if c in vocab}
        for step, (x, y) in enumerate(merges, 1):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            before = self.state[a]
            if self.left[c] >= 0 or not self.arc(before, b):
                continue  # no text brings this pair together
            self.left[c], self.born[c] = a, step
            after_b = self.state[b]
            self.parent.append(before)
            self.removed.append(b)
            self.made.append(step)
            self.state[a] = len(self.parent) - 1
            self.state[c] = after_b
            known[self.label[c]] = c
        self.known = known
        self.longest = max(map(len, known), default=1)
        self._arcs: dict[int, bool] = {}

    def arc(self, state: int, label: int) -> bool:
        """Whether the state has an arc with this label."""
        left, born, parent, removed, made = self.left, self.born, self.parent, self.removed, self.made
        while state:
            if born[label] >= made[state]:
                label = left[label]
            elif label == removed[state]:
                return False
            else:
                state = parent[state]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The only accepted path over one pre-split word.

        Longer tokens are tried first; a place that a token leads to without a way on is not entered by it again,
        so the work is bounded by the word's length times the tokens that match there.
        """
        known, goes, arcs, n, longest = self.known, self.state, self._arcs, len(word), self.longest
        path: list[int] = []
        ends = [0]
        tries = [min(n, longest)]
        dead: set[tuple[int, int]] = set()
        while ends[-1] < n:
            start, stop = ends[-1], tries[-1]
            state = goes[path[-1]] if path else 0
            while stop > start:
                token = known.get(word[start:stop])
                if token is not None and (not dead or (stop, token) not in dead):
                    key = state << 17 | token
                    ok = arcs.get(key)
                    if ok is None:
                        if len(arcs) > 200_000:
                            arcs.clear()
                        ok = arcs[key] = self.arc(state, token)
                    if ok:
                        break
                stop -= 1
            if stop > start:
                tries[-1] = stop - 1
                path.append(token)
                ends.append(stop)
                tries.append(min(n, stop + longest))
            else:  # no arc fits here: back to the last choice
                if not path:
                    raise ValueError(f"the vocabulary has no bytes for {word!r}")
                dead.add((start, path.pop()))
                ends.pop()
                tries.pop()
        return path

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


#: What a vocabulary file may ask for; other settings would change ids, and are refused.
_SUPPORTED = {
    "normalizer": [None],
    "pre_tokenizer.type": ["ByteLevel"],
    "pre_tokenizer.add_prefix_space": [False],
    "pre_tokenizer.use_regex": [True, None],
    "model.type": ["BPE"],
    "model.dropout": [None, 0.0],
    "model.unk_token": [None],
    "model.continuing_subword_prefix": [None, ""],
    "model.end_of_word_suffix": [None, ""],
    "model.byte_fallback": [False, None],
    "model.ignore_merges": [False, None],
    "decoder.type": ["ByteLevel"],
}


def read_vocabulary(path: str) -> dict:
    """A ``tokenizers`` JSON file of the byte-level BPE kind; a ValueError names any setting that is not supported."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for name, allowed in _SUPPORTED.items():
        at = spec
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at not in allowed:
            raise ValueError(f"{path}: {name} is {at!r}; supported: {allowed}")
    for token in spec.get("added_tokens", []):
        if odd := [k for k in ("single_word", "lstrip", "rstrip", "normalized") if token.get(k)]:
            raise ValueError(f"{path}: the added token {token['content']!r} has {', '.join(odd)}, which are not supported")
    return spec


@lru_cache(maxsize=4)
def load_automaton(path: str) -> TokenAutomaton:
    """Compile a ``tokenizers`` JSON file of the byte-level BPE kind; once per process."""
    spec = read_vocabulary(path)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return TokenAutomaton(model["vocab"], merges, special)


class _Words(dict):
    """Packed ids by word, filled as words are asked for; it starts anew when it is full."""

    def __init__(self, encode_word: Callable[[str], list[int]], most_words: int):
        super().__init__()
        self.encode_word, self.most_words = encode_word, most_words

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most_words:
            self.clear()
        ids = self.encode_word(word)
        packed = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class TextEncoder:
    """Whole texts to little-endian 32-bit ids; the cache holds at most ``most_words`` words of about 200 bytes."""

    def __init__(self, encode_word: Callable[[str], list[int]], special: dict[str, int], most_words: int = 600_000):
        self.ids_of = _Words(encode_word, most_words).__getitem__
        self.special = {k: struct.pack("<I", v) for k, v in special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.ids_of, pre_split(text)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._segment(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._segment(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])


@lru_cache(maxsize=4)
def automaton_encoder(path: str) -> TextEncoder:
    auto = load_automaton(path)
    return TextEncoder(lambda word: auto.encode_word(word.encode()), auto.special, most_words=300_000)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for).

    ``vocabulary`` is a byte-level BPE file of the ``tokenizers`` library. A null text counts as empty
    and gives no tokens; special strings inside texts get their special ids, as that library does.
    Rows are independent, so ties, repeated rows and an empty table need no rule, and there is no
    shuffle. Memory holds one Arrow batch, the tables (a few MB) and the bounded word cache.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, auto = automaton_encoder(vocabulary), load_automaton(vocabulary)
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            for text in batch.column(1):
                packed = encode(text.as_py())
                ids = np.frombuffer(packed, "<u4")
                counts.append(len(ids))
                digests.append(hashlib.sha256(packed).hexdigest())
                # As the library does, bytes that are no UTF-8 would come out as replacement characters.
                decoded.append(hashlib.sha256(auto.decode(ids.tolist()).decode("utf-8", "replace").encode()).hexdigest())
                if keep_ids:
                    kept.append(ids.astype("i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
