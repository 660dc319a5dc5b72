"""Fast exact encoding with the tokenizers library: texts are cut where no token can cross, and each distinct piece is encoded once.

Cutting, counting and gathering pieces are done on whole Arrow arrays; the
library merges the distinct pieces that a worker has not met yet. The ids are
those of the plain library call: a text that holds the string of an added
token, or any text under a vocabulary whose normalizer and pre-tokenizer are
not the ones that the cuts are made for, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps; beyond, it starts anew.
CACHE = 400_000
#: New pieces that are encoded in one go.
JOINED = 4000
#: Between pieces; a text that holds it is encoded as it is.
_CUT = "\x1f"
#: Visible characters of which none is white space.
_EDGE = "[!-~¡-ɏ]"
_ODD = re.compile(f"(?<={_EDGE})([ \n])(?={_EDGE})")
_EVEN = f"^{_EDGE}+([ \n]{_EDGE}+)*$"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_TEXT = pa.large_string()
_loaded: dict = {}


#: The normalizer and pre-tokenizer that cutting is right for; fixed formats of the library.
_BYTES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def vocabulary(path: str):
    """The tokenizer at path, loaded once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _cuttable(j: dict, words: bool) -> bool:
    """Whether pieces of a text can be encoded by themselves: normalizer, pre-tokenizer and model are the known ones."""
    known, model = _WORDS if words else _BYTES, j["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
    return plain and all(j.get(k) == v for k, v in known.items()) and (model.get("end_of_word_suffix") or "") == ("</w>" if words else "")


def _merger(j: dict):
    """The same model for text that is normalized and cut already: pieces are what white space parts."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json.dumps(j | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))


class Encoder:
    """ids of whole texts as little-endian bytes, of ``dtype``.

    ``words``: the vocabulary drops white space and lower-cases, so no token
    crosses ASCII white space and pieces are the words in lower case. Otherwise
    (byte-level) a space between two visible characters always begins a token,
    and a newline between two such stands alone; pieces begin at these.
    """

    def __init__(self, path: str, words: bool):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.t, self.merger, self.words, self.cuttable = vocabulary(path), _merger(j), words, _cuttable(j, words)
        # a text with one of these goes to the library; letter case is passed over, as a normalizer might
        marks = [re.escape(a["content"]) for a in j.get("added_tokens") or []] + ([] if words else [_CUT])
        self.marked = "|".join(marks) or "$^"
        vocab = self.t.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65536 else "<u4")
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # ends of words, or bytes (one character each in the byte-level alphabet)
            self.size[i] = token.endswith("</w>") if words else len(token)
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.length, self.ids = pa.array([], _TEXT), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)

    def _raw(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of pieces, each encoded by itself."""
        got = [e.ids for k in range(0, len(pieces), JOINED) for e in self.t.encode_batch_fast(pieces[k : k + JOINED], add_special_tokens=False)]
        return np.fromiter(map(len, got), np.int64, len(got)), np.array([i for x in got for i in x], self.dtype)

    def _joint(self, tokenizer, pieces: pa.Array, forms: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of pieces whose forms, one after the other, are encoded as one text: sizes tell where each ends."""
        lengths, ids = [], []
        for k in range(0, len(pieces), JOINED):
            got = np.array(tokenizer.encode_batch_fast(["".join(forms[k : k + JOINED].to_pylist())], add_special_tokens=False)[0].ids, self.dtype)
            reached, due = np.cumsum(self.size[got]), np.cumsum(sizes[k : k + JOINED])
            ends = np.searchsorted(reached, due)
            if not len(got) or reached[-1] != due[-1] or (reached[ends] != due).any():
                n, got = self._raw(pieces[k : k + JOINED].to_pylist())
            else:
                n = np.diff(ends + 1, prepend=0)
            lengths.append(n)
            ids.append(got)
        return np.concatenate([*lengths, np.empty(0, np.int64)]), np.concatenate([*ids, np.empty(0, self.dtype)])

    def _encoded(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces in some order, lengths, ids)."""
        ascii_ = pc.match_substring_regex(pieces, "^[!-&(-~]+$" if self.words else "^[ \n]?[!-&(-~]+$")
        letters = pc.and_not(pc.match_substring_regex(pieces, f"^[{_LETTER}]+[.,]?$" if self.words else f"^ [{_LETTER}]+[.,]?$"), ascii_)
        a, b = pieces.filter(ascii_), pieces.filter(letters)
        c = pieces.filter(pc.invert(pc.or_(ascii_, letters)))
        if self.words:
            fa = pc.replace_substring_regex(a, "([a-z]+|[0-9]|[^a-z0-9]+)", "\\1 ")
            sa = pc.count_substring(fa, " ").to_numpy()
            fb, sb = pc.replace_substring_regex(b, "$", " "), 1 + pc.match_substring_regex(b, "[.,]$").to_numpy(zero_copy_only=False)
        else:
            fa = pc.replace_substring_regex(a, "(\n| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \n]+)", "\\1" + _CUT)
            for x, y in ((" ", "Ġ"), ("\n", "Ċ"), (_CUT, " ")):  # the byte-level alphabet's signs
                fa = pc.replace_substring(fa, x, y)
            sa, fb, sb = pc.binary_length(a).to_numpy(), b, pc.binary_length(b).to_numpy()
        got = [self._joint(self.merger, a, fa, sa), self._joint(self.t, b, fb, sb), self._raw(c.to_pylist())]
        return pa.concat_arrays([a, b, c]), np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the table has each of the distinct pieces, after learning those that it lacks."""
        found = pc.index_in(pieces, self.known)
        missing = pieces.filter(found.is_null())
        if not len(missing):
            return found.to_numpy()
        if len(self.known) + len(missing) > CACHE:
            self._forget()
            missing = pieces
        new, length, ids = self._encoded(missing)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.known, self.length, self.ids = pa.concat_arrays([self.known, new]), np.concatenate([self.length, length]), np.concatenate([self.ids, ids])
        return pc.index_in(pieces, self.known).to_numpy()

    def _cut(self, texts: list[str]) -> pa.Array:
        """The pieces of each text."""
        if self.words:
            return pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, _TEXT)))
        whole = pa.array(texts, _TEXT)
        even = pc.match_substring_regex(whole, _EVEN).to_numpy(zero_copy_only=False)
        if even.all():
            cut = pc.replace_substring(pc.replace_substring(whole, " ", _CUT + " "), "\n", _CUT + "\n")
        else:  # unusual white space: only marks between visible characters are cut at
            cut = pa.array([t.replace(" ", _CUT + " ").replace("\n", _CUT + "\n") if e else _ODD.sub(_CUT + "\\1", t) for t, e in zip(texts, even)], _TEXT)
        return pc.split_pattern(cut, _CUT)

    def encode(self, texts: list[str]) -> list[bytes]:
        own = np.zeros(len(texts), bool) if self.cuttable else np.ones(len(texts), bool)
        if self.cuttable and texts:
            own = pc.match_substring_regex(pa.array(texts, _TEXT), self.marked, ignore_case=True).to_numpy(zero_copy_only=False)
        if own.any():
            rest = iter(self.encode([t for t, o in zip(texts, own) if not o]) if not own.all() else [])
            return [self._raw([t])[1].tobytes() if o else next(rest) for t, o in zip(texts, own)]
        if not texts:
            return []
        lists = self._cut(texts)
        coded = lists.flatten().dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        n = self.length[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.ids[np.repeat(self.start[place] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        cuts = (ends[at] * self.dtype.itemsize).tolist()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]


_encoders: dict = {}


def release() -> None:
    """Give Arrow's free memory back at the end of a task; the worker may idle while others need it."""
    pa.default_memory_pool().release_unused()


def encoder(path: str, words: bool) -> Encoder:
    if (path, words) not in _encoders:
        _encoders[path, words] = Encoder(path, words)
    return _encoders[path, words]
